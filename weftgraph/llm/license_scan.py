r"""License scan: fixed phrases, and templates found by an exact set-similarity join.

A block of text (a line, or with ``wrapped`` also a line and those after it in its paragraph,
until these have as many words as the longest template) holds a template when it contains at least ``CONTAIN`` of the
template's distinct words. The templates are a table, joined with the blocks. Template words are put in one
global order, rarest in the scanned blocks first. A block that reaches the threshold shares at least one of the first
``m - ceil(CONTAIN * m) + 1`` words of the template, so the words of the blocks meet the prefixes alone (prefix
filter); it has enough template words at all (length filter), and enough from the first shared
position on (positional filter); only then is the overlap counted. Every filter is a necessary
condition, so no block is missed. A pair is met once, at its first shared prefix word.

``matches`` returns every such block. A label is given for it unless another template explains the block: one that
contains all the words the first one matched, with no lower containment (a "CC BY 4.0" line also holds six of the
seven words of the CC BY-NC template, and a CC BY-SA line all six of CC BY).

The template table is a constant of this module or an argument and is broadcast: its size does not grow with the
documents. Blocks never meet one another, so no group can grow hot, and blocks are not shuffled.

Native DataFrame operators throughout. Edge cases: null or empty text has no words and no
labels; repeated rows are scanned each; texts of any length are scanned whole; without templates only the phrases
count; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z are word characters until they are lower-cased
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
CONTAIN = 0.8
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "the GNU General Public License, version 3",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-short": "Released under the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "copyright": "Copyright all rights reserved",
}


def _tokens(s: str) -> list[str]:
    return list(dict.fromkeys(x for x in re.split("[^0-9a-z]+", s.lower()) if x))


def need(m: int, contain: float = CONTAIN) -> int:
    """Least words of a template of ``m`` distinct words that a block must contain."""
    return math.ceil(contain * m - 1e-9)


def _lits(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _runs(length: int) -> tuple[Column, Column]:
    """Distinct template words of each line and the lines after it, until those have ``length`` words or a line has none, and the number of lines."""
    info = F.transform(F.arrays_zip("known", "lines"), lambda x: F.struct(x["known"].alias("w"), F.size(F.array_remove(F.split(x["lines"], BREAKS), "")).alias("n")))
    start = lambda x: F.struct(x["w"].alias("w"), F.lit(0).alias("n"), F.lit(1).alias("lines"), (x["n"] > 0).alias("open"))

    def more(run: Column, x: Column) -> Column:
        on = run["open"] & (run["n"] < length) & (x["n"] > 0)
        return F.struct(F.when(on, F.array_union(run["w"], x["w"])).otherwise(run["w"]).alias("w"), (run["n"] + F.when(on, x["n"]).otherwise(0)).alias("n"), (run["lines"] + F.when(on, 1).otherwise(0)).alias("lines"), on.alias("open"))

    after = lambda i: F.slice("info", i + 2, F.lit(length))
    return info, F.transform("info", lambda x, i: F.aggregate(after(i), start(x), more))


def _blocks(docs: DataFrame, templates: dict[str, str], contain: float, wrapped: bool) -> DataFrame:
    """(doc_id, _row, n_words, places, blocks): the places of the phrases, and the blocks that have enough template words."""
    sets = {k: _tokens(v) for k, v in templates.items()}
    vocab = sorted({t for v in sets.values() for t in v})
    least = min([need(len(v), contain) for v in sets.values()], default=1)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sep = RAW_BREAKS
    hint = "(?i)(?:" + "|".join(p.replace(" ", sep) for p in PHRASES) + ")"
    a = text.select("doc_id", "text", F.size(F.array_remove(F.split("text", sep), "")).cast("long").alias("n_words"), F.rlike("text", F.lit(hint)).alias("hit"), ascii_lower(F.col("text")).alias("low"))
    b = a.select("doc_id", "n_words", F.when(F.col("hit"), F.array_remove(F.split("low", BREAKS), "")).alias("w"), F.split("low", "\n").alias("lines"))

    def at(i: Column, phrase: str) -> Column:
        ok = F.lit(True)
        for j, x in enumerate(phrase.split()):
            ok = ok & F.coalesce(F.get(F.col("w"), i + j) == x, F.lit(False))
        return ok

    which = lambda i: F.array_compact(F.array(*[F.when(at(i, p), F.lit(x)) for p, x in PHRASES.items()]))
    places = F.filter(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("at"), which(i).alias("what"))), lambda x: F.size(x["what"]) > 0)
    known = F.transform("lines", lambda x: F.array_intersect(F.split(x, BREAKS), _lits(vocab))) if vocab else F.array().cast("array<array<string>>")
    k = b.select("doc_id", "n_words", "w", "lines", known.alias("known"))
    block = lambda line, lines, w: F.struct(line.alias("line"), lines.alias("lines"), w.alias("w"))
    single = F.transform("known", lambda w, i: block(i, F.lit(1), w))
    if wrapped and sets:
        info, runs = _runs(max(len([x for x in re.split("[^0-9a-z]+", v.lower()) if x]) for v in templates.values()))
        may = reduce(lambda x, y: x | y, [F.size(F.array_intersect("every", _lits(v))) >= need(len(v), contain) for v in sets.values()])  # else no block of the text can hold one
        k = k.withColumn("every", F.array_distinct(F.flatten("known"))).withColumn("info", F.when(may, info)).withColumn("runs", runs)
        several = F.filter(F.transform("runs", lambda x, i: block(i, x["lines"], x["w"])), lambda x: x["lines"] > 1)
        single = F.when(F.col("info").isNotNull(), F.concat(single, several)).otherwise(single)
    return cut(k.select("doc_id", F.monotonically_increasing_id().alias("_row"), "n_words", F.when(F.col("w").isNotNull(), places).alias("places"), F.filter(single, lambda x: F.size(x["w"]) >= least).alias("blocks")))


def _joined(c: DataFrame, templates: dict[str, str], contain: float) -> DataFrame:
    """(_row, line, lines, w, label, m, overlap): the blocks that hold a template."""
    spark = c.sparkSession
    sets = [(k, _tokens(v)) for k, v in templates.items()]
    table = spark.createDataFrame([(k, v, len(v), need(len(v), contain)) for k, v in sets if v], "label string, t_words array<string>, m int, k int")
    blocks = c.select("_row", F.explode("blocks").alias("b")).select("_row", "b.line", "b.lines", "b.w")
    freq = blocks.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("f"))  # at most one row a template word
    ranked = table.select("*", F.explode("t_words").alias("word")).join(F.broadcast(freq), "word", "left")
    order = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "word"))), lambda x: x["word"])
    prefixes = ranked.groupBy("label", "m", "k").agg(order.alias("t_order"))  # one row a template
    probes = prefixes.select("*", F.explode(F.slice("t_order", F.lit(1), F.col("m") - F.col("k") + 1)).alias("word"))
    met = blocks.select("*", F.explode("w").alias("word")).join(F.broadcast(probes), "word").where("size(w) >= k")
    first = F.get(F.filter("t_order", lambda t: F.array_contains("w", t)), F.lit(0))
    met = met.where((first == F.col("word")) & (F.col("m") - F.array_position("t_order", F.col("word")) + 1 >= F.col("k")))
    return met.withColumn("overlap", F.size(F.array_intersect("w", "t_order"))).where("overlap >= k").select("_row", "line", "lines", "w", "label", "t_order", "m", "overlap")


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contain: float = CONTAIN, wrapped: bool = False) -> DataFrame:
    """(doc_id, line, lines, label, overlap, containment): every block (first line, number of lines) that holds a template."""
    c = _blocks(docs, templates, contain, wrapped)
    return _joined(c, templates, contain).join(c.select("_row", "doc_id"), "_row").select("doc_id", "line", "lines", "label", "overlap", (F.col("overlap") / F.col("m")).alias("containment"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contain: float = CONTAIN, wrapped: bool = False) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    c = _blocks(docs, templates, contain, wrapped)
    held = F.struct(F.col("label"), (F.col("overlap") / F.col("m")).alias("c"), F.col("m"), F.array_intersect("w", "t_order").alias("got"))
    here = _joined(c, templates, contain).groupBy("_row", "line", "lines").agg(F.collect_list(held).alias("all"))  # at most one a template
    better = lambda y, x: (y["label"] != x["label"]) & (F.size(F.array_except(x["got"], y["got"])) == 0) & ((y["c"] > x["c"]) | ((y["c"] == x["c"]) & ((y["m"] > x["m"]) | ((y["m"] == x["m"]) & (y["label"] < x["label"])))))
    own = F.filter("all", lambda x: ~F.exists("all", lambda y: better(y, x)))
    found = here.select("_row", F.explode(own).alias("x")).groupBy("_row").agg(F.collect_set("x.label").alias("found"), F.max("x.c").alias("most"))
    d = c.select("_row", "doc_id", "n_words", "places").join(found, "_row", "left")
    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_distinct(F.flatten(F.transform("places", lambda x: x["what"]))), none)
    e = d.withColumn("base", base)
    return e.select(
        "doc_id", "n_words",
        F.coalesce(F.aggregate("places", F.lit(0), lambda t, x: t + F.size(x["what"])), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
