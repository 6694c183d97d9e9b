"""Token files and their counts against direct encoding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts, token_files, tokens
from tessera.llm.common import given_id, shared_folder
from tessera.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, ids int"
ODD = ["", "  a b", "a\n\nb c ", "x\tb", "don't  we're <|endoftext|> ok<|endoftext|>x", "É é 12 345 !!!  z", "a\r\nb", "q\x1cq w", "\n", " ", "one\ntwo three", "ü x   y", "word " * 3000]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "spaceless"), ("byte_bpe_50k.json", "byte-level")])
def test_kept_words_give_the_same_ids(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 40)
    path = public_tokenizers.path(name)
    plain, kept = Tokenizer.from_file(path), tokens.Encoder(path, kind)
    rng = random.Random(3)
    for _ in range(3):
        texts = ODD + [" ".join(rng.choices("it's the End. of, (all) things\n 1999 çà".split(" "), k=30)) for _ in range(20)]
        ids, counts = kept.encode(texts)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (1, 900), (700, 50), (700, 10**7), (300, 300)])
def test_elias_fano_round_trip(n, top):
    values = np.sort(np.random.default_rng(n + top).integers(0, top + 1, n))
    coded = token_files.EliasFano(n, *token_files.EliasFano.encode(values))
    assert coded.all().tolist() == values.tolist()
    assert [coded.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        coded.select(n)
    if n == 700 and top == 10**7:
        assert len(coded.low) + len(coded.high) < 700 * (2 + 14 + 1) / 8 + 8


def rows():
    return [(i, t, "s", i) for i, t in enumerate(ODD)] + [(100, None, None, None), (None, "no id", "s", 0), (3, "x\tb", "s", 3), (-5, "negative", "s", 1)]


def expected():
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for k, t, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark):
    path = shared_folder(spark)
    token_files.write_token_files(spark.createDataFrame(rows(), SCHEMA), path, PATH, 2)
    got = token_files.read_token_files(spark, path).orderBy("start").select(given_id("doc_id"), "start", "n_tokens", "ids_crc32")
    assert [tuple(r) for r in got.collect()] == expected()


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 300)
    path = shared_folder(spark)
    token_files.write_token_files(spark.createDataFrame(rows(), SCHEMA), path, PATH, 2)
    got = token_files.read_token_files(spark, path).orderBy("start").select(given_id("doc_id"), "start", "n_tokens", "ids_crc32")
    assert [tuple(r) for r in got.collect()] == expected()


def test_empty_table(spark):
    path = shared_folder(spark)
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), path, PATH, 2)
    assert token_files.read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("block_ids", [1, 7, 1000])
def test_separator_scan(spark, block_ids):
    path = shared_folder(spark)
    token_counts.write_flat_tokens(spark.createDataFrame(rows(), SCHEMA), path, PATH, 2, block_ids=block_ids)
    counts = token_counts.count_tokens(spark, f"{path}/kind=tokens", 2)
    named = token_counts.with_document_ids(counts, f"{path}/kind=names").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], r["n_tokens"]) for r in named], key=key) == sorted([(k, n) for k, _, n, _ in expected()], key=key)
    assert all(r["closed"] for r in named)
    by_file = {}
    for r in sorted(named, key=lambda r: (r["file"], r["ordinal"])):
        assert r["start"] == by_file.get(r["file"], 0)
        by_file[r["file"]] = r["start"] + r["n_tokens"]


def test_unclosed_tail_and_empty_files(spark):
    path = shared_folder(spark)
    files = [("a", 0, np.array([5, 2, 2, 7], "<u2").tobytes()), ("a", 1, np.array([8, 9], "<u2").tobytes()), ("a", 2, np.array([2, 4], "<u2").tobytes()), ("b", 0, b"")]
    spark.createDataFrame([(f, i, 2, b) for f, i, b in files], token_counts.FLAT).write.parquet(path)
    got = token_counts.count_tokens(spark, path, 2).orderBy("file", "ordinal").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0, 2, True), ("a", 1, 2, 1, True), ("a", 2, 3, 4, True), ("a", 3, 7, 1, False)]


def test_query_counts_texts_that_hold_the_end_of_text_mark(spark, tmp_path):
    texts = dict(enumerate(ODD)) | {50: "<|endoftext|>", 51: "a <|endoftext|><|endoftext|> b", 52: "behind it"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    got = QUERIES["op10_token_counts"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["n_tokens"] for r in got} == want


def test_end_id_that_a_text_yields_is_refused(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    assert token_counts.END_ID >= Tokenizer.from_file(PATH).get_vocab_size()
    with pytest.raises(Exception, match="yields the id 50256"):
        token_counts.write_flat_tokens(docs, shared_folder(spark), PATH, 50256)
