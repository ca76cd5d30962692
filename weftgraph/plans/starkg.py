"""A knowledge graph over the star-schema tables, for the registered queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import as_set

#: table, head, relation, tail, whether the triple counts as new
EDGES = [
    ("customer", "c", "c_custkey", "locatedIn", "n", "c_nationkey", True),
    ("supplier", "s", "s_suppkey", "locatedIn", "n", "s_nationkey", False),
    ("nation", "n", "n_nationkey", "partOf", "r", "n_regionkey", False),
    ("orders", "o", "o_orderkey", "placedBy", "c", "o_custkey", True),
    ("lineitem", "o", "l_orderkey", "contains", "p", "l_partkey", True),
    ("lineitem", "o", "l_orderkey", "shippedBy", "s", "l_suppkey", True),
    ("lineitem", "p", "l_partkey", "suppliedBy", "s", "l_suppkey", False),
]
KINDS = [("customer", "c", "c_custkey", "Customer"), ("supplier", "s", "s_suppkey", "Supplier"), ("part", "p", "p_partkey", "Part"), ("orders", "o", "o_orderkey", "Order"), ("nation", "n", "n_nationkey", "Nation"), ("region", "r", "r_regionkey", "Region")]

SQL_KG = "kg AS (SELECT DISTINCT h, r, t, is_new FROM (" + " UNION ALL ".join(f"SELECT '{a}' || {h} AS h, '{r}' AS r, '{b}' || {t} AS t, {f'{h} % 10 = 0' if new else 'FALSE'} AS is_new FROM {tab}" for tab, a, h, r, b, t, new in EDGES) + "))"
SQL_NEAR = "near AS (SELECT 'n' || n_nationkey AS h, 'near' AS r, 'n' || ((n_nationkey + 1) % 25) AS t, FALSE AS is_new FROM nation UNION ALL SELECT 'n' || ((n_nationkey + 1) % 25), 'near', 'n' || n_nationkey, n_nationkey % 2 = 0 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'n' || n_nationkey, 'near', 'n' || n_nationkey, TRUE FROM nation WHERE n_nationkey % 5 = 0)"
SQL_TYPES = "types AS (" + " UNION ALL ".join(f"SELECT '{a}' || {k} AS ent, '{c}' AS cls FROM {tab}" for tab, a, k, c in KINDS) + " UNION ALL SELECT 'c' || c_custkey, 'Segment_' || c_mktsegment FROM customer)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(prefix: str, key: str):  # noqa: ANN202
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


#: Bytes of a table's files to a partition of its pairs. Compact pairs become rows of text, which tasks sort or hash; so many of them bound a task.
PART_BYTES = 8 << 20


def _pairs(spark: SparkSession, sf_dir: str, tab: str, h: str, t: str) -> DataFrame:
    """The distinct pairs of two columns, for a large table in partitions of a stated size."""
    d = read(spark, sf_dir, tab).select(h, t)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{tab}.parquet")
    n = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() // PART_BYTES
    return (d.repartition(n, h, t) if n > 8 else d).distinct()


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (h, r, t, is_new). Each relation is deduplicated by itself, on its keys: the unions never overlap but for locatedIn, whose heads differ."""
    parts = []
    for tab, a, h, r, b, t, new in EDGES:
        d = _pairs(spark, sf_dir, tab, h, t)
        parts.append(d.select(_name(a, h).alias("h"), F.lit(r).alias("r"), _name(b, t).alias("t"), (F.col(h) % 10 == 0 if new else F.lit(False)).alias("is_new")))
    return as_set(reduce(DataFrame.unionByName, parts))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small symmetric-looking relation with loops and mirrored pairs."""
    k = F.col("n_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    me, up = _name("n", "n_nationkey"), F.concat(F.lit("n"), ((k + 1) % 25).cast("string"))
    a = n.select(me.alias("h"), F.lit("near").alias("r"), up.alias("t"), F.lit(False).alias("is_new"))
    b = n.where(k % 3 == 0).select(up.alias("h"), F.lit("near").alias("r"), me.alias("t"), (k % 2 == 0).alias("is_new"))
    c = n.where(k % 5 == 0).select(me.alias("h"), F.lit("near").alias("r"), me.alias("t"), F.lit(True).alias("is_new"))
    return a.unionByName(b).unionByName(c)


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, tab).select(_name(a, k).alias("ent"), F.lit(c).alias("cls")) for tab, a, k, c in KINDS]
    parts.append(read(spark, sf_dir, "customer").select(_name("c", "c_custkey").alias("ent"), F.concat(F.lit("Segment_"), "c_mktsegment").alias("cls")))
    return reduce(DataFrame.unionByName, parts)


def local(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table as literals. Its size is known to the planner, so that rows that meet it stay where they are."""
    cols = [x.split() for x in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, cols)]) for row in rows])))


def pairs(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return local(spark, rows, "k string, v string")


def names(spark: SparkSession, *rows: str) -> DataFrame:
    return local(spark, [(x,) for x in rows], "k string")
