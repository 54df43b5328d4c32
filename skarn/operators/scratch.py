"""Tables written once to the shared folder that the cluster names in ``spark.checkpoint.dir``: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes an execution's shuffle files when it ends, instead of when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder; our own only where none is set and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="skarn-")
        spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Tables of one job, removed together by ``clear`` or when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{folder(spark)}/skarn-{uuid.uuid4().hex}"
        self._tables: list[tuple[DataFrame, str]] = []
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str = "table", **options: str) -> DataFrame:
        """``df`` written and read again.  What was shuffled for it goes: the table stands for it from now on."""
        path, before = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}", self.spark.conf.get(TIDY, None)
        self.spark.conf.set(TIDY, "true")
        try:
            df.write.option("compression", "zstd").options(**options).parquet(path)
        finally:
            self.spark.conf.set(TIDY, before) if before is not None else self.spark.conf.unset(TIDY)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((table, path))
        return table

    def drop(self, table: DataFrame) -> None:
        """Removes a table that was written here and that nothing reads any more."""
        for held, path in self._tables:
            if held is table:
                self._delete(path)
        self._tables = [t for t in self._tables if t[0] is not table]

    def clear(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has gone already; the cluster's own clean-up takes the folder
            pass
