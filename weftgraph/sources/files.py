"""Readers and writers. All read with Spark and explicit schemas; a missing path gives an empty table where stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..model import HRT, PAIR, SCORED, TRIPLE, TYPE
from ..operators.rules import parse_rule, write_rule

SELF = "me_myself_i"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", quote="", mode="PERMISSIVE")


def _trimmed(df: DataFrame) -> DataFrame:
    """Strip fields and drop rows with an empty one."""
    t = df.select(*[F.trim(c).alias(c) for c in df.columns])
    ok = F.lit(True)
    for c in t.columns:
        ok = ok & (F.length(c) > 0)
    return t.where(ok)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return _trimmed(_tsv(spark, path, TRIPLE))


def write_triples(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*HRT).write.mode(mode).csv(path, sep="\t", quote="")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Integer triples (head, rel, tail), distinct; a missing file is an empty table."""
    schema = "head long, rel long, tail long"
    try:
        return _tsv(spark, path, schema).where("head IS NOT NULL AND rel IS NOT NULL AND tail IS NOT NULL").dropDuplicates()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names, one a line, angle brackets removed: (k)."""
    return _lines(spark, path).select(_bare(F.trim("value")).alias("k")).where("length(k) > 0").distinct()


def _bare(c):  # noqa: ANN001, ANN202
    return F.regexp_replace(c, "^<(.*)>$", "$1")


def read_types(spark: SparkSession, path: str, classes: DataFrame | None = None) -> DataFrame:
    """``ent<TAB>c1;c2`` to (ent, cls); only known classes if given. An entity without classes has no row."""
    t = _tsv(spark, path, TYPE).select(F.trim("ent").alias("ent"), F.explode(F.split(F.coalesce("cls", F.lit("")), ";")).alias("cls"))
    t = t.select("ent", F.trim("cls").alias("cls")).where("length(cls) > 0").distinct()
    return t if classes is None else t.join(classes.select(F.col(classes.columns[0]).alias("cls")).distinct(), "cls", "left_semi").select("ent", "cls")


def write_types(types: DataFrame, path: str) -> None:
    types.groupBy("ent").agg(F.array_join(F.array_sort(F.collect_set("cls")), ";").alias("cls")).write.mode("overwrite").csv(path, sep="\t", quote="")


read_pattern_set = read_vocabulary


def read_pattern_map(spark: SparkSession, path: str, sep: str = "@@") -> DataFrame:
    """``key<TAB>v1@@v2`` to (k, v)."""
    t = _tsv(spark, path, PAIR).select(_bare(F.trim("k")).alias("k"), F.explode(F.split("v", sep)).alias("v"))
    return t.select("k", _bare(F.trim("v")).alias("v")).where("length(v) > 0").distinct()


def read_positive_patterns(spark: SparkSession, path: str, last: bool = False) -> DataFrame:
    """``rel<TAB>C1"C2"`` to (k, v). Several lines of a relation intersect; ``last``: the last one counts alone."""
    t = _tsv(spark, path, PAIR).withColumn("_line", F.monotonically_increasing_id()).select(_bare(F.trim("k")).alias("k"), F.array_distinct(F.transform(F.filter(F.split("v", '"'), lambda x: F.trim(x) != ""), lambda x: F.trim(x))).alias("vs"), "_line")
    if last:
        return t.groupBy("k").agg(F.max_by("vs", "_line").alias("vs")).select("k", F.explode("vs").alias("v"))
    n = t.groupBy("k").agg(F.count("*").alias("n"))
    return t.select("k", F.explode("vs").alias("v")).groupBy("k", "v").agg(F.count("*").alias("c")).join(n, "k").where("c = n").select("k", "v")


def read_loose_triples(spark: SparkSession, path: str, self_token: bool = True) -> DataFrame:
    """Tab- or space-separated triples (h, r, t, confidence). A fourth ``.`` is ignored, a fourth number is a
    confidence; five or more columns are a spaced tail, joined by ``_``. Loops are written with a self token,
    and the mirrored loop row is added."""
    parts = _lines(spark, path).where("length(trim(value)) > 0").select(F.when(F.instr("value", "\t") > 0, F.split("value", "\t")).otherwise(F.split(F.trim("value"), " +")).alias("p")).where("size(p) >= 3")
    four = F.try_element_at("p", F.lit(4))
    t = parts.select(F.get("p", F.lit(0)).alias("h"), F.get("p", F.lit(1)).alias("r"), F.when(F.size("p") >= 5, F.array_join(F.slice("p", 3, F.size("p") - 2), "_")).otherwise(F.get("p", F.lit(2))).alias("t"), F.when(F.size("p") == 4, F.coalesce(four.try_cast("double"), F.lit(1.0))).otherwise(1.0).alias("confidence"))
    if not self_token:
        return t
    loop = t.where("h = t")
    return t.where("h <> t").unionByName(loop.withColumn("t", F.lit(SELF))).unionByName(loop.withColumn("h", F.lit(SELF)))


RULE = "predicted long, correct long, confidence double, kind string, head array<string>, body array<array<string>>"


def read_rules(spark: SparkSession, path: str, min_correct: int = 2, min_confidence: float = 0.0001, kinds: Sequence[str] | None = None, max_body: int | None = None) -> DataFrame:
    """Rule lines as rows (predicted, correct, confidence, kind, head, body)."""

    def parse(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = [r for r in map(parse_rule, b["value"]) if r]
            if rows:
                yield pd.DataFrame([{**r, "head": list(r["head"]), "body": [list(a) for a in r["body"]]} for r in rows])

    t = _lines(spark, path).mapInPandas(parse, RULE).where((F.col("correct") >= min_correct) & (F.col("confidence") >= min_confidence))
    t = t if kinds is None else t.where(F.col("kind").isin(list(kinds)))
    return t if max_body is None else t.where(F.size("body") <= max_body)


def read_refinable(spark: SparkSession, path: str) -> DataFrame:
    return read_rules(spark, path, kinds=["cyclic"])


def rule_lines(rows: list[dict]) -> list[str]:
    return [write_rule(r) for r in rows]


def write_rules(df: DataFrame, path: str) -> None:
    """Rule lines, best first."""
    atom = lambda a: F.concat(F.get(a, F.lit(0)), F.lit("("), F.get(a, F.lit(1)), F.lit(","), F.get(a, F.lit(2)), F.lit(")"))
    body = F.array_join(F.transform("body", atom), ", ")
    line = F.concat_ws("\t", F.col("predicted").cast("string"), F.col("correct").cast("string"), F.col("confidence").cast("string"), F.rtrim(F.concat(atom(F.col("head")), F.lit(" <= "), body)))
    df.orderBy(F.desc("confidence"), F.desc("correct")).select(line.alias("value")).write.mode("overwrite").text(path)


def read_rankings(spark: SparkSession, path: str, side: str = "Tails", k: int = 10) -> DataFrame:
    """Ranked completions in blocks of three lines: (h, r, t, side, candidate, score, rank)."""
    whole = spark.read.text(path, wholetext=True)  # a block's lines must stay together; write large rankings as many files
    b = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^([^\n]+)\nHeads:([^\n]*)\nTails:([^\n]*)"), F.lit(0))).alias("b"))
    lines = F.split("b", "\n")
    t = b.select(F.split(F.get(lines, F.lit(0)), r"[\t ]+").alias("x"), F.trim(F.regexp_replace(F.get(lines, F.lit(1 if side == "Heads" else 2)), f"^{side}:", "")).alias("l"))
    t = t.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(HRT)], F.filter(F.split("l", r"[\t ]+"), lambda v: v != "").alias("v"))
    p = F.posexplode(F.when(F.size("v") >= 2, F.sequence(F.lit(0), (F.size("v") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")))
    t = t.select(*HRT, "v", p.alias("i", "j"))
    return t.select(*HRT, F.lit(side).alias("side"), F.get("v", 2 * F.col("i")).alias("candidate"), F.get("v", 2 * F.col("i") + 1).cast("double").alias("score"), (F.col("i") + 1).alias("rank")).where(F.col("rank") <= k)


def ranked_triples(rank: DataFrame) -> DataFrame:
    """Rankings of either side as scored triples."""
    return rank.select(F.when(F.col("side") == "Heads", F.col("candidate")).otherwise(F.col("h")).alias("h"), "r", F.when(F.col("side") == "Heads", F.col("t")).otherwise(F.col("candidate")).alias("t"), "score")


def read_gold(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Test triples with a category in the fourth column."""
    t = _tsv(spark, path, TRIPLE + ", category string")
    return t if category is None else t.where(F.col("category") == category)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Same-as pairs in both directions: (a, b)."""
    t = _trimmed(_tsv(spark, path, "a string, b string"))
    return t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, SCORED).where("h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL")


def read_bracketed(spark: SparkSession, path: str) -> DataFrame:
    """``<h> <r> <t>`` lines, separated by tabs or spaces."""
    p = F.split(F.trim("value"), r"\s+")
    t = _lines(spark, path).where("length(trim(value)) > 0").select(*[_bare(F.get(p, F.lit(i))).alias(c) for i, c in enumerate(HRT)])
    return t.where("h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL")


def write_bracketed(df: DataFrame, path: str) -> None:
    wrap = lambda c: F.concat(F.lit("<"), F.col(c).cast("string"), F.lit(">"))
    df.select(F.concat_ws("\t", *[wrap(c) for c in HRT]).alias("value")).write.mode("overwrite").text(path)


def read_counted_ids(spark: SparkSession, path: str) -> DataFrame:
    """``h t r`` ids after a line with their number: (head, rel, tail)."""
    p = F.split(F.trim("value"), r"\s+")
    t = _lines(spark, path).select(p.alias("p")).where("size(p) = 3")
    return t.select(F.get("p", F.lit(0)).cast("long").alias("head"), F.get("p", F.lit(2)).cast("long").alias("rel"), F.get("p", F.lit(1)).cast("long").alias("tail"))


def write_counted_ids(df: DataFrame, path: str) -> None:
    n = df.agg(F.count("*").cast("string").alias("value"), F.lit(0).alias("o"))
    rows = df.select(F.concat_ws(" ", F.col("head").cast("string"), F.col("tail").cast("string"), F.col("rel").cast("string")).alias("value"), F.lit(1).alias("o"))
    n.unionByName(rows).sort("o").select("value").write.mode("overwrite").text(path)


_NT = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\".*\"\S*)\s*\.\s*$"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    t = _lines(spark, path).where(F.rlike("value", F.lit(_NT)))
    return t.select(_bare(F.regexp_extract("value", _NT, 1)).alias("h"), F.regexp_extract("value", _NT, 2).alias("r"), _bare(F.regexp_extract("value", _NT, 3)).alias("t"))


def ntriples_types(nt: DataFrame, classes: DataFrame) -> DataFrame:
    t = nt.where(F.col("r") == RDF_TYPE).select(F.col("h").alias("ent"), F.col("t").alias("cls"))
    return t.join(classes.select(F.col(classes.columns[0]).alias("cls")).distinct(), "cls", "left_semi").select("ent", "cls")


def ntriples_relations(nt: DataFrame, known: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Triples of known relations; types and excluded relations drop."""
    t = nt.where((F.col("r") != RDF_TYPE) & ~F.col("r").isin(list(exclude) or [""]))
    return t.join(known.select(F.col(known.columns[0]).alias("r")).distinct(), "r", "left_semi").select(*HRT)


def ntriples_lines(t: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """N-Triples of triples, and of types with a declaration for each entity."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    line = lambda a, b, c: F.concat_ws(" ", iri(a), iri(b), iri(c), F.lit(".")).alias("value")
    out = t.select(line(F.col("h"), F.col("r"), F.col("t")))
    if types is None:
        return out
    named = types.select("ent").distinct().select(line(F.col("ent"), F.lit(RDF_TYPE), F.lit("http://www.w3.org/2002/07/owl#NamedIndividual")))
    return out.unionByName(named).unionByName(types.select(line(F.col("ent"), F.lit(RDF_TYPE), F.col("cls"))))


def write_ntriples(t: DataFrame, types: DataFrame | None, path: str) -> None:
    ntriples_lines(t, types).write.mode("overwrite").text(path)


def read_literals(spark: SparkSession, short: str, long: str | None = None) -> DataFrame:
    """(ent, text): the long text where there is one, else the short."""
    a = _tsv(spark, short, "ent string, s string")
    if long is None:
        return a.select("ent", F.col("s").alias("text"))
    b = _tsv(spark, long, "ent string, l string")
    return a.join(b, "ent", "full_outer").select("ent", F.coalesce("l", "s").alias("text"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a space-separated text file."""
    p = F.split("value", " ")
    t = _lines(spark, path).where("length(value) > 0").select(F.get(p, F.lit(0)).alias("word"), F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: x.try_cast("double")).alias("vec"))
    return t.where("size(vec) > 1 AND NOT exists(vec, x -> x IS NULL)")


NEGATIVE_RULE = "ruleId string, predicate string, premise_triples array<struct<subject:string,predicate:string,object:string>>, conclusion_triple struct<subject:string,predicate:string,object:string>, human_confidence double, computed_confidence double"


def read_negative_rules(spark: SparkSession, path: str, predicates: Sequence[str] | None = None, max_premises: int = 2, confidence: float | None = None) -> DataFrame:
    """Negative rules with few premises, of given predicates, whose human or computed confidence is enough."""
    t = spark.read.schema(NEGATIVE_RULE).json(path, multiLine=True).where(F.size("premise_triples") <= max_premises)
    if predicates is not None:
        t = t.where(F.col("predicate").isin(list(predicates)))
    return t if confidence is None else t.where((F.col("human_confidence") >= confidence) | (F.col("computed_confidence") >= confidence))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema) if schema else spark.read.json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
