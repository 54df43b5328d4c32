"""Best-split trees over all lines of orders, with the SQL of their levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import cart, saved
from skarn.operators.scratch import Scratch
from skarn.plans.feature_queries import table

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
#: The outputs: whole numbers, so that sums don't depend on their order.
TARGETS = ["CAST(round(l_extendedprice) AS DOUBLE)", "CAST(round(l_extendedprice * (1 - l_discount)) AS DOUBLE)"]
DEPTH, LEAST = 2, 5


COLUMNS = (f"array({', '.join(f'CAST({f} AS DOUBLE)' for f in FEATURES)}) AS v", f"array({', '.join(TARGETS)}) AS y")


def _tree(spark, sf_dir, impurity):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*COLUMNS)
    return _nodes(spark, cart.fit(rows, "v", "y", len(FEATURES), len(TARGETS), impurity, depth=DEPTH, bins=128, least_node=LEAST))


def _nodes(spark, trees):
    """The nodes of a joint tree: feature and threshold where they split, mean outputs."""
    part, nodes = trees.parts[0], []
    for (_, node), means in sorted(part.means.items()):  # the model's nodes
        f, cut = part.splits.get((0, node), (None, None))
        nodes.append((node, None if f is None else FEATURES[f], None if cut is None else round(cut, 6), *[round(m, 6) for m in means]))
    return spark.createDataFrame(nodes, "node int, feature string, threshold double, mean_price double, mean_paid double")


def tree_squared(spark, sf_dir):
    return _tree(spark, sf_dir, "squared")


def tree_absolute(spark, sf_dir):
    return _tree(spark, sf_dir, "absolute")


def tree_made_again(spark, sf_dir):
    """The tree of a written model, trained again by its record alone."""
    path = f"{Scratch(spark).path}/tree"
    source = saved.Source(f"{sf_dir}/lineitem.parquet", COLUMNS)
    options = dict(vector="v", outputs="y", width=len(FEATURES), n_outputs=len(TARGETS), depth=DEPTH, bins=128, least_node=float(LEAST))
    saved.save(saved.train(spark, "split_trees", {"df": source}, **options), path)
    again = saved.reproduce(spark, path)
    if not again.same():
        raise ValueError(f"the tree came out otherwise: {again.record} {again.parameters}")
    return _nodes(spark, again.trained.model)


def _sql(impurity: str) -> str:
    union = " UNION ALL ".join(f"SELECT id, node, a, b, {i} AS f, {name} AS x FROM r{{level}}" for i, name in enumerate(FEATURES))
    parts = [f"r0 AS MATERIALIZED (SELECT row_number() OVER () AS id, 1 AS node, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)}, {TARGETS[0]} AS a, {TARGETS[1]} AS b FROM lineitem)"]
    for level in range(DEPTH):
        parts.append(f"e{level} AS MATERIALIZED ({union.format(level=level)})")
        parts.append(f"h{level} AS MATERIALIZED (SELECT node, f, x, count(*) AS n, sum(a) AS a, sum(b) AS b FROM e{level} GROUP BY 1, 2, 3)")
        parts.append(f"""c{level} AS MATERIALIZED (SELECT node, f, x, (x + lead(x) OVER w) / 2 AS cut, sum(n) OVER w AS nl, sum(n) OVER t AS n, sum(a) OVER w AS al, sum(a) OVER t AS a, sum(b) OVER w AS bl, sum(b) OVER t AS b
            FROM h{level} WINDOW w AS (PARTITION BY node, f ORDER BY x ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY node, f))""")
        if impurity == "squared":
            gain = f"SELECT node, f, cut, nl * (n - nl) / n * ((al / nl - (a - al) / (n - nl)) ** 2 + (bl / nl - (b - bl) / (n - nl)) ** 2) / 2 AS gain FROM c{level} WHERE cut IS NOT NULL AND n >= {LEAST}"
        else:
            side = lambda s: f"abs({s} - CASE WHEN x < c.cut THEN c.{s}l ELSE c.{s}r END)"
            parts.append(f"l{level} AS MATERIALIZED (SELECT node, f, list({{'cut': cut, 'al': al / nl, 'bl': bl / nl, 'ar': (a - al) / (n - nl), 'br': (b - bl) / (n - nl)}}) AS cuts FROM c{level} WHERE cut IS NOT NULL AND n >= {LEAST} GROUP BY 1, 2)")
            parts.append(f"u{level} AS (SELECT e.*, unnest(l.cuts) AS c FROM e{level} e JOIN l{level} l ON l.node = e.node AND l.f = e.f)")
            parts.append(f"d{level} AS MATERIALIZED (SELECT node, f, c.cut AS cut, sum({side('a')} + {side('b')}) AS dev FROM u{level} GROUP BY 1, 2, 3)")
            parts.append(f"p{level} AS MATERIALIZED (SELECT node, sum(abs(a - am) + abs(b - bm)) AS dev FROM r{level} JOIN (SELECT node, avg(a) AS am, avg(b) AS bm FROM r{level} GROUP BY 1) USING (node) GROUP BY 1)")
            gain = f"SELECT node, f, cut, (p.dev - d.dev) / 2 AS gain FROM d{level} d JOIN p{level} p USING (node)"
        parts.append(f"b{level} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) AS place FROM ({gain})) WHERE place = 1 AND gain > 1e-9)")
        value = "CASE s.f " + " ".join(f"WHEN {i} THEN r.{name}" for i, name in enumerate(FEATURES)) + " END"
        parts.append(f"r{level + 1} AS MATERIALIZED (SELECT r.* REPLACE (2 * r.node + CAST({value} > s.cut AS INTEGER) AS node) FROM r{level} r JOIN b{level} s USING (node))")
    nodes = " UNION ALL ".join(f"SELECT node, avg(a) AS a, avg(b) AS b FROM r{level} GROUP BY 1" for level in range(DEPTH + 1))
    splits = " UNION ALL ".join(f"SELECT node, f, cut FROM b{level}" for level in range(DEPTH))
    name = "CASE s.f " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FEATURES)) + " END"
    return f"WITH {', '.join(parts)} SELECT CAST(m.node AS INTEGER) AS node, {name} AS feature, round(s.cut, 6) AS threshold, round(m.a, 6) AS mean_price, round(m.b, 6) AS mean_paid FROM ({nodes}) m LEFT JOIN ({splits}) s USING (node)"


QUERIES = {"tree_squared": (tree_squared, _sql("squared")), "tree_absolute": (tree_absolute, _sql("absolute")), "tree_made_again": (tree_made_again, _sql("squared"))}
