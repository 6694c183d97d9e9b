"""License scan by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a document is joined, by its hash, to the places where the pair occurs in the
templates. A place of the document minus a place of the template is a diagonal; a template that occurs in a document
piles up votes on one diagonal, with small edits on neighbouring ones. Votes are aggregated per diagonal, neighbouring
diagonals merged, and runs with enough different template places verified: a span of bounded width must hold enough of
them in ascending order, and the words that tell the template from others in full. A phrase occurs where its diagonal has all
its pairs. Words are compared after the join, so a hash collision cannot give a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import given_id, plain, query, stored, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand consecutively, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Well-known license sentences, as words, with the labels this operator adds.
TEMPLATES = {
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "released under the mit license": "mit-release",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it": "gpl-notice",
    "you may not use this file except in compliance with the license": "apache-notice",
    "licensed under a creative commons attribution": "creative-commons",
    "all rights reserved": "all-rights-reserved",
}

# Parts of a template that tell it from other licenses; their words must stand consecutively in an accepted span.
REQUIRED = {
    "gpl-3.0": ["gnu general public license", "version 3"],
    "apache-2.0": ["apache license", "version 2 0"],
    "cc-by-4.0": ["cc by 4 0"],
    "cc-by-sa-4.0": ["cc by sa 4 0"],
    "cc-by-nc-4.0": ["cc by nc 4 0"],
    "mit-release": ["mit license"],
    "creative-commons": ["creative commons attribution"],
}


def _pairs(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


def marker_words(templates: dict[str, float]) -> list[str]:
    """Words such that every accepted match holds one: among a template's pairs, those without any are too few to be accepted."""
    chosen: list[str] = []
    for text, share in templates.items():
        words = text.split()
        need = share * (len(words) - 1)
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if sum(1 for p in _pairs(words) if not set(p) & set(chosen)) < need:
                break
            if word not in chosen:
                chosen.append(word)
    return chosen


def _template_pairs(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """A row per pair of words of each template. Its size is that of the list above."""
    rows = [
        F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(i).alias("at"), F.lit(a).alias("t1"), F.lit(b).alias("t2"), F.lit(len(text.split()) - 1).alias("pairs"))
        for text, label, base in templates
        for i, (a, b) in enumerate(_pairs(text.split()))
    ]
    return spark.range(1).select(F.inline(F.array(*rows))).withColumn("pair", F.xxhash64("t1", "t2"))


def _required_pairs() -> Column:
    """Label to its required parts, each as the places of its pairs in the template."""
    entries = []
    for text, label in TEMPLATES.items():
        words, parts = text.split(), []
        for part in REQUIRED.get(label, []):
            own = part.split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            parts.append(F.array(*[F.lit(i) for i in range(at, at + len(own) - 1)]))
        entries += [F.lit(label), F.array(*parts) if parts else F.array().cast("array<array<int>>")]
    return F.create_map(*entries)


def _verified(runs: DataFrame, group: list[str], share: float, reach: int) -> DataFrame:
    """Spans of the runs that hold a template: ``group``, place and found, the number of its pairs in ascending order.

    A span starts at a vote and has room for ``reach`` more words at each pair that may be missing. Required pairs weigh more than
    all others together, so the heaviest ascending chain of votes has all of them if any chain has.
    """
    heavy, most = 1 << 10, max(len(t.split()) - 1 for t in TEMPLATES)
    votes = runs.select(*group, "run", F.explode("lines").alias("line"))
    votes = votes.select(*group, "run", "line.diagonal", F.explode("line.ats").alias("at")).withColumn("place", F.col("diagonal") + F.col("at"))
    ahead = Window.partitionBy(*group, "run").orderBy("place").rangeBetween(0, most * (1 + reach))
    # of equal places, the later template place first, so that a place counts once in a chain
    spans = votes.select(*group, "place", F.collect_list(F.struct("place", (-F.col("at")).alias("back"))).over(ahead).alias("span"))
    need = F.ceil(F.lit(share) * F.col("pairs"))
    width = F.col("pairs") + (F.col("pairs") - need) * reach
    spans = spans.withColumn("span", F.array_sort(F.filter("span", lambda v: v["place"] < F.col("place") + width)))
    spans = spans.where(F.size("span") >= need).withColumn("parts", F.element_at(_required_pairs(), F.col("label")))
    whole = F.forall("parts", lambda part: F.exists("span", lambda v: F.forall(part, lambda i: F.exists("span", lambda u: (u["place"] + u["back"] == v["place"] + v["back"]) & (u["back"] == -i)))))
    spans = spans.where(whole).withColumn("must", F.flatten("parts"))

    def longer(chain: Column, vote: Column) -> Column:
        at = -vote["back"]
        value = F.coalesce(F.array_max(F.slice(chain, 1, at)), F.lit(0)) + F.when(F.array_contains("must", at), heavy).otherwise(1)
        return F.transform(chain, lambda x, i: F.when(i == at, F.greatest(x, value)).otherwise(x))

    weight = F.array_max(F.aggregate("span", F.transform(F.sequence(F.lit(1), F.col("pairs")), lambda _: F.lit(0)), longer))
    spans = spans.withColumn("weight", weight).where(F.floor(F.col("weight") / heavy) == F.size("must"))
    spans = spans.withColumn("found", (F.col("weight") % heavy + F.size("must")).cast("int"))
    return spans.where(F.col("found") >= need).select(*group, "place", "found")


def _listed(condition: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")


def scan_licenses(
    docs: DataFrame, share: float = 0.75, reach: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts the places of the phrases, first_word and last_word are the least and greatest start (words from 0, null
    without a place). A template counts where at least ``share`` of its pairs vote on diagonals at most ``reach``
    apart, in ascending order within a span of bounded width that holds its ``REQUIRED`` words. score is the greatest share of a template's or phrase's pairs found on such a span, 0 without an accepted one.

    A null or empty text has no words, no labels (empty strings) and score 0. Rows with a null id or a repeated id are
    scanned one by one. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    templates = [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for t, label in TEMPLATES.items()]
    markers = marker_words(dict.fromkeys(PHRASES, 1.0) | dict.fromkeys(TEMPLATES, share))
    rows = plain(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    rows = rows.withColumn("lower", F.translate("text", _UPPER, _LOWER))
    rows = rows.select("id", "key", "lower", F.filter(F.split("lower", _BETWEEN), lambda w: w != "").alias("words"))
    marked = F.lit(False)
    for word in markers:
        marked = marked | F.contains("lower", F.lit(word))
    # one pass over the texts: a row's votes, and one entry in front of them that carries its number of words
    nothing = F.array(F.lit(""))
    rows = rows.select("id", "key", F.size("words").cast("long").alias("n_words"), F.when(marked, F.col("words")).otherwise(F.array().cast("array<string>")).alias("words"))
    first = F.concat(nothing, "words")
    second = F.concat(nothing, F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))))
    places = rows.select("id", "key", "n_words", F.posexplode(F.arrays_zip(first.alias("w1"), second.alias("w2"))).alias("place", "w"))
    places = places.select("id", "key", "n_words", (F.col("place") - 1).alias("place"), F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    places = places.where("w1 IS NOT NULL AND w2 IS NOT NULL").withColumn("pair", F.xxhash64("w1", "w2"))
    pairs = _template_pairs(spark, templates)
    carrier = spark.range(1).select(
        F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("at"), F.lit("").alias("t1"), F.lit("").alias("t2"), F.lit(0).alias("pairs"), F.xxhash64(F.lit(""), F.lit("")).alias("pair")
    )
    votes = places.join(F.broadcast(pairs.unionByName(carrier)), "pair").where("w1 = t1 AND w2 = t2")
    votes = stored(votes.select("id", "key", "n_words", "label", "base", "pairs", "at", "place"))
    sized = votes.where("label = ''").select("id", "key", "n_words")
    votes = votes.where("label != ''")
    group = ["id", "key", "label", "base", "pairs"]
    diagonals = votes.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(*group, "diagonal")
    diagonals = stored(diagonals.agg(F.collect_set("at").alias("ats"), F.min("place").alias("place")))
    # a phrase must be whole on its diagonal; a template may be spread over neighbouring ones
    whole = diagonals.where(F.col("base") & (F.size("ats") == F.col("pairs")))
    order = Window.partitionBy(*group).orderBy("diagonal")
    near = diagonals.where(~F.col("base")).withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > reach, F.lit(True)).cast("int"))
    near = near.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = near.groupBy(*group, "run").agg(F.collect_list(F.struct("diagonal", "ats")).alias("lines"))
    runs = runs.where(F.size(F.array_distinct(F.flatten(F.col("lines.ats")))) >= share * F.col("pairs"))
    accepted = whole.select(*group, "place", F.size("ats").alias("found")).union(
        _verified(runs, group, share, reach).select(*group, "place", "found")
    )
    found = accepted.groupBy("id", "key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("place"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("place"))).cast("long").alias("last_word"),
        _listed(F.col("base")).alias("base_labels"),
        _listed(F.lit(True)).alias("labels"),
        F.max(F.col("found") / F.col("pairs")).alias("score"),
    )
    return sized.join(found, ["id", "key"], "left").select(
        given_id(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


@query("op8_license_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))
