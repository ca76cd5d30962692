r"""Personal data: four base patterns, and bootstrapped contextual extraction on top.

Base spans (email, ip, card, phone) are leftmost and non-overlapping within a kind and are
validated; failing matches are dropped without a retry. The regular expressions are
possessive rewritings of the stated ones: the same matches, no backtracking, and no
recursion in the regex engine on long runs.

The base spans are the seeds of a bootstrap. Further instances are whatever has the outer form of an
identifier: words joined by @, and runs of digit groups joined by dots, spaces, hyphens or parentheses,
of any length. The words around an occurrence are its lexical patterns: the word before, the two
before, the two after, and the word on either side. Scores move over the pattern-instance graph for
``ROUNDS`` rounds. A pattern's confidence in a kind is the score its known instances have in that kind, over the
score they have in all kinds, plus one: instances of which nothing is known say nothing, and a pattern
needs several seeds before it is believed. An instance scores the highest confidence of its patterns, and
from ``ACCEPT`` on it is known in the next round. Known instances that are not seeds become further
spans of that kind (email for those with @, else ip, card or phone); base spans always stay, and no
further span overlaps one.

Native DataFrame operators throughout. Work on a text grows in proportion to its length and its
matches (running sums and maxima go by blocks of ``STEP``). The graph holds distinct (pattern, instance)
edges aggregated before the shuffle; joins on patterns, which follow Zipf's law, are salted.

Edge cases: null text is empty and has no spans; repeated rows get the same spans; an empty
table gives an empty result; extra columns are ignored; offsets are code points; a neighbour that doesn't end
within ``CONTEXT`` code points stands as one mark, whatever it is, and so does the next instance of its form.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_RUN, ascii_lower, cut, salted_join

KINDS = ("email", "ip", "card", "phone")
_L, _D = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_LU, _DU = r"[\p{L}\p{N}._%+-]", r"[\p{L}\p{N}-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_L})){_L}++@{_D}++(?:\.{_D}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Instances of open kind: what is joined by @, and runs of digit groups.
FORMS = {"at": rf"(?:\G|(?<!{_LU})){_LU}++@{_DU}++(?:\.{_DU}++)*+", "number": r"\+?\(?[0-9]++(?:[ ().-]{1,3}+[0-9]++)*+"}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "at": "@", "number": "[0-9]"}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]?)"
ROUNDS, ACCEPT, CONTEXT, STEP = 3, 0.8, 128, 256
FOUND = "array<struct<s:int,k:int,e:int,m:string,l:string,r:string>>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
    digits = F.regexp_replace(m, "[^0-9]+", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        back, digit = F.reverse(digits), lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")

        def luhn(total: Column, i: Column) -> Column:
            d = digit(i)
            return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        check = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), luhn) % 10 == 0
        return F.when(F.length(digits).between(14, 19), check).otherwise(False)
    return F.lit(True)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _before(values: Column, zero: int, fold: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of integers, the fold of all values before it, in blocks of ``STEP``."""
    span = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    block = lambda i: F.floor(i / STEP).cast("int")
    sums = lambda v: F.transform(span(F.ceil(F.size(v) / STEP).cast("int")), lambda b: F.aggregate(F.slice(v, b * STEP + 1, F.lit(STEP)), F.lit(zero), fold))
    starts = lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(zero), fold))
    each = lambda v, at: F.transform(v, lambda _, i: F.aggregate(F.slice(v, block(i) * STEP + 1, i % STEP), F.get(at, block(i)), fold))
    return _let(values, lambda v: _let(sums(v), lambda s: _let(starts(s), lambda at: each(v, at))))


def _located(pattern: str, kind: int) -> Column:
    """All matches in ``text``: (start, kind, end, match, what stands before, what stands after)."""
    sized = lambda xs: F.transform(xs, lambda x: F.char_length(x))

    def at(m: Column, gaps: Column) -> Column:
        steps = F.transform(m, lambda _, i: F.char_length(F.get(gaps, i)) + F.when(i > 0, F.char_length(F.get(m, F.greatest(i - 1, F.lit(0))))).otherwise(0))
        return _let(steps, lambda d: _let(_before(d, 0, lambda t, x: t + x), lambda b: F.transform(m, lambda x, i: row(m, gaps, x, i, F.get(b, i) + F.get(d, i)))))

    def row(m: Column, gaps: Column, x: Column, i: Column, start: Column) -> Column:
        near = lambda g: F.char_length(g) <= CONTEXT
        left, right = F.get(gaps, i), F.get(gaps, i + 1)
        before = F.when(~near(left), F.concat(F.lit("… "), F.regexp_replace(F.right(left, F.lit(CONTEXT)), r"^[^ \t-\r]*+", ""))).otherwise(F.concat(F.when(i > 0, "# ").otherwise(""), left))
        after = F.when(~near(right), F.concat(F.regexp_replace(F.left(right, F.lit(CONTEXT)), r"(?<![^ \t-\r])[^ \t-\r]*+$", ""), F.lit(" …"))).otherwise(F.concat(right, F.when(i < F.size(m) - 1, " #").otherwise("")))
        return F.struct(start.cast("int").alias("s"), F.lit(kind).alias("k"), (start + F.char_length(x)).cast("int").alias("e"), x.alias("m"), before.alias("l"), after.alias("r"))

    found = _let(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, _let(F.split("text", pattern, -1), lambda g: at(m, g))))
    return F.coalesce(found, F.array().cast(FOUND))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, open): validated base spans, and instances of open kind (-1 with @, -2 numbers) that overlap none."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast(FOUND)
    every = {**PATTERNS, **FORMS}
    found = text.select("doc_id", *[F.when(F.rlike("text", F.lit(HINTS[n])), _located(p, i if i < len(KINDS) else len(KINDS) - 1 - i)).otherwise(none).alias(n) for i, (n, p) in enumerate(every.items())])
    checked = lambda k: F.filter(k, lambda x: _valid(k, x["m"]))
    base = F.array_sort(F.concat(*[checked(k) for k in KINDS]))
    both = found.select("doc_id", base.alias("base"), F.concat(*FORMS).alias("open"))

    def free(xs: Column) -> Column:
        reach = _before(F.transform(xs, lambda x: F.when(x["k"] >= 0, x["e"]).otherwise(0)), 0, lambda t, x: F.greatest(t, x))
        back = F.reverse(xs)
        ahead = F.reverse(_before(F.transform(back, lambda x: F.when(x["k"] >= 0, x["s"]).otherwise(2**31 - 1)), 2**31 - 1, lambda t, x: F.least(t, x)))
        return _let(reach, lambda r: _let(ahead, lambda a: F.filter(F.transform(xs, lambda x, i: F.when((x["k"] < 0) & (F.get(r, i) <= x["s"]) & (F.get(a, i) >= x["e"]), x)), lambda x: x.isNotNull())))

    # base spans come before open instances of the same start, so that both see one another
    ordered = F.array_sort(F.concat("base", "open"), lambda x, y: F.when(x["s"] != y["s"], x["s"] - y["s"]).otherwise(y["k"] - x["k"]))
    return both.select("doc_id", "base", F.when(F.size("open") == 0, none).when(F.size("base") == 0, F.col("open")).otherwise(_let(ordered, free)).alias("open"))


def _occurrences(rows: DataFrame) -> DataFrame:
    """One row an instance and row: its span, kind (negative: open) and its patterns."""
    o = rows.select("_row", F.explode(F.concat("base", "open")).alias("o"))
    tidy = lambda c: F.filter(F.split(ascii_lower(F.col(c)), WS_RUN), lambda x: x != "")
    a = o.select("_row", "o.s", "o.e", "o.k", F.col("o.m").alias("inst"), tidy("o.l").alias("l"), tidy("o.r").alias("r"))
    near = lambda xs, i: F.coalesce(F.try_element_at(xs, F.lit(i)), F.lit(""))
    l1, l2, r1, r2 = near("l", -1), near("l", -2), near("r", 1), near("r", 2)
    written_ = [F.concat_ws(" ", *x) for x in ((l1, F.lit("_")), (l2, l1, F.lit("_")), (l1, F.lit("_"), r1), (F.lit("_"), r1, r2))]
    return a.select("_row", "s", "e", "k", "inst", F.array(*written_).alias("pats"))


def discover(rows: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(_row, more): spans that the bootstrap finds beyond the base ones."""
    occ = cut(_occurrences(rows))
    edges = cut(occ.select("inst", F.explode("pats").alias("pat"), F.col("k")).groupBy("pat", "inst").agg(F.max("k").alias("k")))  # a seed anywhere is a seed
    seeds = occ.where("k >= 0").select("inst", F.col("k").alias("kind"), F.lit(1.0).alias("score")).distinct()
    fits = F.when(F.col("k") == -1, F.col("kind") == 0).otherwise((F.col("k") == -2) & (F.col("kind") > 0))
    known = seeds
    for _ in range(rounds):
        by_kind = salted_join(edges, known, ["inst"], F.col("pat"), "inner").groupBy("pat", "kind").agg(F.sum("score").alias("mine"))
        total = by_kind.groupBy("pat").agg(F.sum("mine").alias("all"))
        sure = by_kind.join(total, "pat").select("pat", "kind", (F.col("mine") / (F.col("all") + 1)).alias("conf")).where(F.col("conf") >= accept)
        reached = salted_join(edges.where("k < 0"), sure, ["pat"], F.col("inst"), "inner").where(fits).groupBy("inst").agg(F.max(F.struct("conf", (-F.col("kind")).alias("less"))).alias("b"))
        more = reached.select("inst", (-F.col("b.less")).cast("int").alias("kind"), F.col("b.conf").alias("score"))
        known = cut(seeds.unionByName(more))
    best = known.join(seeds.select("inst").distinct(), "inst", "left_anti").select("inst", "kind")
    new = salted_join(occ.where("k < 0"), best, ["inst"], F.col("_row"), "inner")
    return new.groupBy("_row").agg(F.collect_set(F.struct("s", F.col("kind").alias("k"), "e")).alias("more"))


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (s, k, e), k an index into ``KINDS``."""
    some = cut(base_spans(docs).withColumn("_row", F.monotonically_increasing_id()))  # the numbers are kept with the rows
    more = discover(some)
    slim = some.select("doc_id", "_row", F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("base"))
    out = slim.join(more, "_row", "left")
    return out.select("doc_id", "base", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: reduce(lambda c, i: c.when(k == i, KINDS[i]), range(1, 4), F.when(k == 0, KINDS[0]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
