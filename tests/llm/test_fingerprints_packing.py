"""Order MinHash and packing against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, SF_DIR, documents
from pyspark.sql import functions as F

from strata.llm import fingerprints, packing, queries
from strata.llm.common import text_chunks


def test_fingerprint_query_against_plain_edits(spark):
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall(), reverse=True)
    got = {r.doc_id: r for r in queries.op3_order_minhash(spark, SF_DIR).collect()}
    prints = defaultdict(set)
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def _likeness(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = fingerprints.signature(F.col("a")), fingerprints.signature(F.col("b"))
    return df.select(fingerprints.likeness(x, y).alias("l")).first()["l"]


def test_likeness_falls_with_edits_and_with_order(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(600)]
    some, many = list(words), list(words)
    for at in rng.sample(range(600), 6):
        some[at] = "new"
    for at in rng.sample(range(600), 120):
        many[at] = f"other{at}"
    turned = words[300:] + words[:300]
    text = " ".join(words)
    same, few, lots, swapped = (_likeness(spark, text, " ".join(w)) for w in (words, some, many, turned))
    assert same == 1 and same > few > lots
    # the sets of k-mers are nearly equal, the order is not
    assert 0.3 < swapped < 0.75


def test_repeated_kmers_count_as_often_as_they_occur(spark):
    short, long = " ".join(["na"] * 40), " ".join(["na"] * 400)
    assert _likeness(spark, short, short) == 1
    assert _likeness(spark, short, long) < 0.5


def test_fingerprint_defined_cases(spark):
    docs = documents(spark)
    got = fingerprints.fingerprint_with_edits(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[3][0].n_chars == 0 and by[3][0].fingerprint == by[4][0].fingerprint == by[5][0].fingerprint
    assert by[1][0].fingerprint == by[1][1].fingerprint and by[6][0].n_chars == len(LONG)
    assert by[None][0].near_next is not None
    assert fingerprints.fingerprint_with_edits(documents(spark, [])).count() == 0
    alone = fingerprints.fingerprint_with_edits(documents(spark, [(5, "a b c d", None, None, 0)])).collect()
    # 7 characters: the last three are replaced by the first three of itself
    assert alone[0].near_next == 1 and alone[0].edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_next_document_by_descending_id(spark, buckets):
    rng = random.Random(buckets)
    ids = rng.sample(range(-500, 500), 60)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "key bigint, text string")
    got = dict(fingerprints.with_next(df, "key", ["text"], buckets).select("key", "next_text").collect())
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(n + 1) % 60]}" for n, i in enumerate(order)}


def _plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " ", "  ", "\n", "a\nb", "a \n b", "a\n\nb", "don't we'll 'tis it's", "x's'y", "é è\nü", "a b c d e", "日本 語\nテ",
    "tab\tsep a\r\nb", " lead", "trail ", "a  b", "a,b ,c , d", "1,000.5 kg", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y <|endoftext|", "|endoftext|> <|end", "a\n<|endoftext|>\n b.", "🙂 🙂🙂 a🙂 b", "A.B.C...", "x-'s y", "ä, ö. ü!",
    "\u0085a \u0085 b", "word" * 400, "a\x00b c", "ab́c d́ e",
]


def test_cached_parts_give_the_tokenizers_ids():
    rows = duckdb.sql(f"SELECT text FROM '{SF_DIR}/documents.parquet'").fetchall()
    rng = random.Random(9)
    alphabet = [" ", "\n", "a", "B", "é", "ß", " ", " ", "'", "s", ".", "!", "7", "日", "\t", "🙂", "_"]
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts = [*ODD, *noise, *(r[0] for r in rows)]
    want = _plain_ids(texts)
    cache, got = packing._cache("byte_bpe_50k.json"), []
    for a, b, data, offsets in text_chunks(pa.array(texts), 50_000):
        ids, first = packing.token_ids(cache, data, offsets)
        got += [ids[first[i] : first[i + 1]].tolist() for i in range(b - a)]
    assert got == want


def test_added_tokens_have_ids_of_their_own():
    cache = packing._cache("byte_bpe_50k.json")
    data = np.frombuffer(b"a <|endoftext|> b<|endof" + b"text|>", np.uint8)
    ids, first = packing.token_ids(cache, data, np.array([0, 24, 30]))  # the second is cut by the end of a row
    assert ids[: first[1]].tolist()[:4] == [64, 220, 50256, 275] and 50256 not in ids[first[1] :].tolist() + ids[4:].tolist()


def _check_packing(rows, texts_by_id, capacity=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, texts in texts_by_id.items():
        want = []
        for ids in _plain_ids([t or "" for t in texts]):
            ids = [*ids, 2]
            start, piece, length = 0, 0, len(ids) % capacity or capacity
            while start < len(ids):
                part = np.array(ids[start : start + length], "<u4").tobytes()
                want.append((piece, start, length, zlib.crc32(part)))
                start, piece, length = start + length, piece + 1, capacity
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == sorted(want)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing_query_is_whole_and_tight(spark):
    rows = queries.op8_packing(spark, SF_DIR).collect()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    used, bound = _check_packing(rows, {i: [t] for i, t in texts})
    assert used <= bound * 1.02 + 1


def test_packing_defined_cases(spark):
    docs = documents(spark)
    by = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        by[r.doc_id].append(r.text)
    _check_packing(packing.pack(docs).collect(), by)
    assert packing.pack(documents(spark, [])).count() == 0


def test_best_fit_ranges_against_best_fit_decreasing():
    rng = np.random.default_rng(8)
    for capacity in (10, 64, 1024):
        lengths = rng.integers(1, capacity, 700)
        counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        ranges, sequences = packing.best_fit_ranges(counts, capacity)
        plain = []
        for length in sorted(lengths.tolist(), reverse=True):
            fits = [i for i, gap in enumerate(plain) if gap >= length]
            if fits:
                plain[min(fits, key=lambda i: plain[i])] -= length
            else:
                plain.append(capacity - length)
        assert sequences <= len(plain) * 1.02 + 1
        fill = defaultdict(list)
        keys, first_rank, first_sequence, offset = packing._indexed(ranges)
        for length, n in counts.items():
            rank = np.arange(n)
            at = np.searchsorted(keys, (length << 42) | rank, side="right") - 1
            for s, o in zip(first_sequence[at] + rank - first_rank[at], offset[at], strict=True):
                fill[s].append((o, length))
        for places in fill.values():
            end = 0
            for o, length in sorted(places):
                assert o == end
                end += length
            assert end <= capacity
        assert len(fill) == sequences
