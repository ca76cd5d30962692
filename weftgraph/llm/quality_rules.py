"""Quality rules with adaptive thresholds.

Fixed base rules reject very short and self-repeating texts. All other thresholds are learned
from the texts that pass them: every (lang, source) group gets a mergeable KLL quantile sketch of
each signal, built on the map side, so a source with a third of all rows sends one sketch a task, and
group sketches merge into those of the language and of the corpus. Two signals have spread in any
prose, the mean word length and the share of characters that are no letters; a text is out when one lies beyond the
quartiles of its group by more than ``FENCE`` spreads, on either side. Two are 0 in most prose,
the shares of repeated lines and of repeated words; a text is out above twice the distance from the
group's median to its ``TAIL`` quantile.

No size decides which thresholds count: quantiles of a group are drawn towards those of its language,
and these towards the corpus's, as if the parent had ``PRIOR`` of the rows. The spread is the
interquartile range, drawn likewise towards the mean range within the groups of the language, and is at least that
mean: a source that is mostly copies of one text has no range of its own.

Native DataFrame operators throughout. Edge cases: null and empty texts have no words and
fail the base rules; null lang and source form groups of their own; repeated rows are
judged alike; texts of any length are judged whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, salted_join, words

WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 5, 10, 20
#: Sketch size, fence in spreads, upper quantile of the shares that are mostly 0, and rows that a parent counts for.
SKETCH_K, FENCE, TAIL, PRIOR = 1024, 5.0, 0.99, 20
SPREAD, SPARSE = ("word_len", "marks"), ("dup", "rep")


def signals(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, lang, source and the base signals."""
    a = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", words(F.col("text")))
    full = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    b = a.select(
        "doc_id", "lang", "source", "w", F.size("w").alias("n"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"[\p{L}\s]++", "")).cast("long").alias("n_marks"), full.alias("full"),
    )
    hashed = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(WINDOW)]))
    c = b.select(
        "doc_id", "lang", "source", "n", "word_chars", "n_symbols", "n_marks", F.size("full").cast("long").alias("n_full"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") >= WINDOW, hashed).alias("h"),
    )
    again = F.size(F.array_distinct("h")) < F.size("h")
    d = c.withColumn("s", F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    same = lambda i, j: F.get(F.col("s"), i)["h"] == F.get(F.col("s"), j)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.coalesce(same(i, i + 1), F.lit(False)) | ((i > 0) & F.coalesce(same(i, F.greatest(i - 1, F.lit(0))), F.lit(False))))
    e = d.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda i: F.get(F.col("s"), i)["p"]))))
    gaps = F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda t, x: t + x), F.lit(0)).cast("long")
    f = e.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_marks", "n_full", "n_dup_lines", covered.alias("n_repeat_words"))
    return f.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def _shares(df: DataFrame) -> DataFrame:
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return df.withColumns({"word_len": share("word_chars", "n_words"), "marks": share("n_marks", "word_chars"), "dup": share("n_dup_lines", "n_full"), "rep": share("n_repeat_words", "n_words")})


def _quantiles(prefix: str = "") -> list[Column]:
    """Quantiles of the sketches: <signal>_1 and _3 (quartiles), or _m and _t (median and tail)."""
    want = [(s, n, q) for s in SPREAD for n, q in (("1", 0.25), ("3", 0.75))] + [(s, n, q) for s in SPARSE for n, q in (("m", 0.5), ("t", TAIL))]
    return [F.kll_sketch_get_quantile_double(F.col(f"k_{s}"), F.lit(q)).alias(f"{prefix}{s}_{n}") for s, n, q in want]


def thresholds(rows: DataFrame, fence: float = FENCE, prior: int = PRIOR) -> DataFrame:
    """(lang, source, lo_<signal>, hi_<signal>) of every group that has rows."""
    signals_ = [*SPREAD, *SPARSE]
    sketches = cut(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(s, F.lit(SKETCH_K)).alias(f"k_{s}") for s in signals_]))
    merged = [F.kll_merge_agg_double(f"k_{s}").alias(f"k_{s}") for s in signals_]
    group = sketches.select("lang", "source", "n", *_quantiles())
    within = lambda p: [F.try_divide(F.sum(F.col("n") * (F.col(f"{s}_3") - F.col(f"{s}_1"))), F.sum("n")).alias(f"{p}{s}_w") for s in SPREAD]
    level = lambda k, p: (sketches.groupBy(*k).agg(F.sum("n").alias(f"{p}n"), *merged).select(*k, f"{p}n", *_quantiles(p)), group.groupBy(*k).agg(*within(p)))
    lang = level(["lang"], "l_")
    corpus = level([], "c_")  # one row
    named = lambda df, x: df.withColumnRenamed("lang", x)
    both = group.join(named(lang[0], "lang_a"), F.col("lang").eqNullSafe(F.col("lang_a"))).join(named(lang[1], "lang_b"), F.col("lang").eqNullSafe(F.col("lang_b")))
    both = both.crossJoin(F.broadcast(corpus[0])).crossJoin(F.broadcast(corpus[1]))
    drawn = lambda own, n, parent: (F.col(n) * own + prior * parent) / (F.col(n) + prior)
    at = lambda x: drawn(F.col(x), "n", drawn(F.col(f"l_{x}"), "l_n", F.col(f"c_{x}")))
    out = []
    for s in SPREAD:
        mean = drawn(F.col(f"l_{s}_w"), "l_n", F.col(f"c_{s}_w"))
        spread = F.greatest(drawn(F.col(f"{s}_3") - F.col(f"{s}_1"), "n", mean), mean)
        out += [(at(f"{s}_1") - fence * spread).alias(f"lo_{s}"), (at(f"{s}_3") + fence * spread).alias(f"hi_{s}")]
    out += [(2 * at(f"{s}_t") - at(f"{s}_m")).alias(f"hi_{s}") for s in SPARSE]
    return both.select("lang", "source", *out)


def judge(docs: DataFrame, fence: float = FENCE, prior: int = PRIOR) -> DataFrame:
    """The base signals, ``base_failed`` and the verdict ``kept`` of every document."""
    rows = cut(_shares(signals(docs)))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    limits = thresholds(rows.where("NOT base_failed"), fence, prior)
    bounds = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(key("lang").alias("_l"), key("source").alias("_s"), *bounds)
    out = salted_join(rows.withColumns({"_l": key("lang"), "_s": key("source")}), limits, ["_l", "_s"], F.col("doc_id"))
    within = F.lit(True)
    for c in bounds:
        side, s = c.split("_", 1)
        off = F.lit(1e-9) + F.abs(c) * 1e-9  # rounding of the means above
        within = within & ((F.col(s) <= F.col(c) + off) if side == "hi" else (F.col(s) >= F.col(c) - off))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))
