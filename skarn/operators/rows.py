"""Row processor: table rows to examples (output, weight, metadata, named features), as one projection."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.scalars import DATE_FEATURES, feature_name
from skarn.operators.text import ngrams, whitespace_tokens

_PAIRS = "array<struct<name:string,value:double>>"


def _none() -> Column:
    return F.array().cast(_PAIRS)


def _one(name: Column, value: Column) -> Column:
    return F.array(F.struct(name.alias("name"), value.cast("double").alias("value")))


class Double:
    """The cell as a number under the field's name (or field@value); what is no number makes no feature, or fails."""

    def __init__(self, only_name: bool = True, strict: bool = False):
        self.only_name, self.strict = only_name, strict

    def features(self, name: str, cell: Column) -> Column:
        x = cell.cast("double") if self.strict else cell.try_cast("double")
        return F.when(x.isNotNull(), _one(F.lit(name if self.only_name else f"{name}@value"), x)).otherwise(_none())


class Identity:
    """One feature, field@cell = 1."""

    def features(self, name: str, cell: Column) -> Column:
        return F.when(F.coalesce(cell, F.lit("")) != "", _one(feature_name(name, cell), F.lit(1.0))).otherwise(_none())


class Regex:
    """MATCH_ALL: field@MATCH_ALL = 1 if the pattern matches the whole cell; MATCH_CONTAINS: if it is found in it; GROUPS: field@group for each group matched."""

    def __init__(self, pattern: str, modes: tuple[str, ...] = ("MATCH_ALL",)):
        self.pattern, self.modes = pattern, modes

    def features(self, name: str, cell: Column) -> Column:
        parts = []
        for mode in self.modes:
            if mode == "GROUPS":
                for g in range(1, re.compile(self.pattern).groups + 1):
                    text = F.regexp_extract(cell, self.pattern, g)
                    parts.append(F.when(text != "", _one(feature_name(name, text), F.lit(1.0))).otherwise(_none()))
            else:
                hit = cell.rlike(f"^(?:{self.pattern})$") if mode == "MATCH_ALL" else cell.rlike(self.pattern)
                parts.append(F.when(hit, _one(F.lit(f"{name}@{mode}"), F.lit(1.0))).otherwise(_none()))
        return F.concat(*parts)


class Date:
    """The calendar features of a date in the given pattern; none if it can't be read."""

    def __init__(self, pattern: str = "yyyy-MM-dd", names: tuple[str, ...] = tuple(DATE_FEATURES)):
        self.pattern, self.names = pattern, names

    def features(self, name: str, cell: Column) -> Column:
        d = F.try_to_timestamp(cell, F.lit(self.pattern)).cast("date")
        pairs = F.array(*[F.struct(F.lit(f"{name}@{n}").alias("name"), DATE_FEATURES[n](d).cast("double").alias("value")) for n in self.names])
        return F.when(d.isNotNull(), pairs).otherwise(_none())


class Text:
    """1- to ``upto``-grams of the cell's tokens, once each, as field@n-N=token."""

    def __init__(self, upto: int = 1, tokens=whitespace_tokens):
        self.upto, self.tokens = upto, tokens

    def features(self, name: str, cell: Column) -> Column:
        tokens = self.tokens(F.coalesce(cell, F.lit("")))
        parts = [self._grams(name, tokens, n) for n in range(1, self.upto + 1)]
        return F.concat(*parts)

    @staticmethod
    def _grams(name: str, tokens: Column, n: int) -> Column:
        return F.transform(F.array_distinct(ngrams(tokens, n)), lambda t: F.struct(F.concat(F.lit(f"{name}@n-{n}="), t).alias("name"), F.lit(1.0).alias("value")))


def field_response(cell: Column, default: str | None = None, upper: bool = True, prefix: str | None = None) -> Column:
    """Trimmed, upper-cased cell; ``default`` for an empty one."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    text = F.when(text == "", F.lit(default)).otherwise(F.upper(text) if upper else text)
    return F.concat(F.lit(f"{prefix}="), text) if prefix else text


def binary_response(cell: Column, positive: str, names: tuple[str, str] = ("1", "0")) -> Column:
    return F.when(cell == positive, names[0]).otherwise(names[1])


def empty_response() -> Column:
    return F.lit(None).cast("string")


# extractors: cell -> value, null where it can't be read


def extract(cell: Column, kind: str, pattern: str | None = None) -> Column:
    """int, float, double, string, date (by pattern) or timestamp (with an offset)."""
    if kind == "date":
        return F.try_to_timestamp(cell, F.lit(pattern or "yyyy-MM-dd")).cast("date")
    if kind == "timestamp":
        return F.try_to_timestamp(cell, F.lit(pattern)) if pattern else F.try_to_timestamp(cell)
    return cell.try_cast(kind)


@dataclass
class RowProcessor:
    """Fields, response, weight and metadata to take from a table's rows.

    fields: processor by column; patterns: processor by regex over column names,
    each of which must match a column not bound yet.  merge: how duplicate names
    of a row become one (FIRST, LAST, MAX, MIN, SUM) or None to keep all.
    """

    response: object = None  # function of the row's columns by name, giving a column
    fields: dict[str, object] = field(default_factory=dict)
    patterns: dict[str, object] = field(default_factory=dict)
    weight: Column | None = None
    metadata: dict[str, Column] = field(default_factory=dict)
    merge: str | None = None
    newlines: bool = True

    def bound(self, columns: list[str]) -> dict[str, object]:
        out = dict(self.fields)
        for pattern, processor in self.patterns.items():
            hits = [c for c in columns if re.fullmatch(pattern, c)]
            if not hits:
                raise ValueError(f"{pattern} matches no field")
            for c in hits:
                if c in out:
                    raise ValueError(f"field {c} is bound twice")
                out[c] = processor
        return out

    def process(self, df: DataFrame, output_required: bool = True) -> DataFrame:
        """(output, weight, metadata, features): rows without a feature go, as do those without a required output."""
        parts = []
        for name, processor in self.bound(df.columns).items():
            cell = F.trim(F.regexp_replace(F.col(f"`{name}`").cast("string"), r"[\r\n]+", " ")) if self.newlines else F.col(f"`{name}`").cast("string")
            parts.append(F.coalesce(processor.features(name, cell), _none()))
        features = F.concat(*parts) if parts else _none()
        if self.merge:
            features = self._merged(features)
        output = self.response if self.response is not None else empty_response()
        meta = F.map_filter(F.create_map(*[x for k, v in self.metadata.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull()) if self.metadata else F.create_map().cast("map<string,string>")
        out = df.select(output.alias("output"), F.coalesce(self.weight.cast("float") if self.weight is not None else F.lit(None).cast("float"), F.lit(1.0).cast("float")).alias("weight"), meta.alias("metadata"), features.alias("features"))
        out = out.where(F.size("features") > 0)
        return out.where(F.col("output").isNotNull()) if output_required else out

    def _merged(self, features: Column) -> Column:
        names = F.array_distinct(F.transform(features, lambda f: f["name"]))
        how = self.merge

        def value(n):
            xs = F.transform(F.filter(features, lambda f: f["name"] == n), lambda f: f["value"])
            if how in ("FIRST", "LAST"):
                return F.element_at(xs, 1 if how == "FIRST" else -1)
            if how in ("MAX", "MIN"):
                return F.array_max(xs) if how == "MAX" else F.array_min(xs)
            return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

        return F.transform(names, lambda n: F.struct(n.alias("name"), value(n).alias("value")))
