"""License scan: phrases by definition, templates with edits."""

from __future__ import annotations

import random
import re

from tessera.llm import licenses
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, label string, place int"


def by_definition(text):
    words = WORD.findall((text or "").translate(UPPER))
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return (len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))


def base_of(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_phrases(spark):
    rng = random.Random(1)
    parts = [*licenses.PHRASES, "GNU General", "Public License", "license", "mit", "cc", "by", "CC-BY", "été", "x1", "Apache, License!", "©"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(80)] + [None, "", " ", "mit license " * 4000, "MIT\nLICENSE"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: base_of(r) for r in got} == {i: by_definition(t) for i, t in enumerate(texts)}
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= (r["n_base"] > 0)
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_templates_with_edits(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, f"some words before {mit} and after"),
        (2, mit.replace("hereby ", "").replace("any", "each and any")),
        (3, "permission granted to any copy of this software"),
        (4, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit-text" and got[1]["score"] == 1
    assert got[2]["labels"] == "mit-text" and 0.75 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[3]["score"] == 0
    assert "cc-by-nc-4.0" in got[4]["labels"] and got[4]["base_labels"] == "cc-by"


def test_repeats_null_ids_and_empty(spark):
    rows = [(1, "mit license", None, None), (1, "mit license", None, None), (None, "cc by", "x", 1), (None, "no", "x", 1), (1, "other", "x", 1)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["n_base"], r["n_words"]) for r in got) == [(-1, 0, 1), (-1, 1, 2), (1, 0, 1), (1, 1, 2), (1, 1, 2)]
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_markers_cover_every_accepted_match():
    shares = dict.fromkeys(licenses.PHRASES, 1.0) | dict.fromkeys(licenses.TEMPLATES, 0.75)
    markers = set(licenses.marker_words(shares))
    for text, share in shares.items():
        pairs = licenses._pairs(text.split())
        assert sum(not markers & set(p) for p in pairs) < share * len(pairs)


def test_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    want = {r["doc_id"]: by_definition(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r["doc_id"]: base_of(r) for r in QUERIES["op8_license_scan"](spark, folder).collect()} == want


def test_labels_are_exact(spark):
    gpl = "Licensed under the GNU General Public License"
    notice = "you may not use this file except in compliance with the license".split()
    cases = [
        ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by"),
        (gpl, "gpl"),
        (f"{gpl}, version 2", "gpl"),
        (f"{gpl}, version 3", "gpl,gpl-3.0"),
        (f"{gpl} (GPL), version 3", "gpl,gpl-3.0"),
        (f"version 3 {gpl}", "gpl"),
        ("Licensed under the GNU Lesser General Public License version 3", ""),
        ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),
        ("Licensed under the Apache License, Version 1.1", "apache"),
        ("Released under the MIT-0 license", ""),
        ("Licensed under a Creative Commons Zero", ""),
        (" ".join(notice), "apache-notice"),
        # pairs in reverse order, each a few diagonals from the last, are no notice
        (" ".join(f"{a} {b} x" for a, b in list(zip(notice, notice[1:]))[::-1]), ""),
        # pairs that are far from each other do not make one
        (" ".join(f"{a} {b} x x" for a, b in zip(notice, notice[1:])), ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [labels for _, labels in cases]
