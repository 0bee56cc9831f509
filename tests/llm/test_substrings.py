"""Repeated windows against a plain version."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import CLASHING, ROWS, SCHEMA, documents

from strata.llm import substrings
from strata.llm.substrings import _Plan, _coded, _decoded, _groups, _maximal

PASSAGE = " ".join(f"p{i}" for i in range(60))


def plain(rows, depth=20):
    """{(id, text): (words, removed, digest)}; rows of one id are ordered by
    nothing that the contract fixes, so tests give such rows equal texts."""
    first, out = {}, {}
    for key, text in sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows}):
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - depth + 1):
            window = tuple(words[i : i + depth])
            if first.setdefault(window, (key, i)) != (key, i):
                gone[i : i + depth] = [True] * depth
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[key, text] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, depth=20, group=1 << 21):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, doc string, runs string")
    got = substrings.digest(docs, depth=depth, group=group).collect()
    want = plain(rows, depth)
    expected = sorted((i is None, i or 0, *want[2**63 - 1 if i is None else i, t or ""]) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *r[1:]) for r in got) == expected
    return want


def test_repeats_within_and_across_documents(spark):
    tail = " ".join(f"t{i}" for i in range(30))
    rows = [
        (5, PASSAGE), (3, f"before {PASSAGE} after"), (9, f"{PASSAGE} {tail} {PASSAGE}"), (1, tail), (2, " ".join(["w"] * 90)),
        (4, " ".join(f"p{i}" for i in range(19))), (7, None), (8, ""), (None, PASSAGE), (6, PASSAGE), (6, PASSAGE),
    ]
    want = check(spark, rows)
    assert want[3, f"before {PASSAGE} after"][1] == 0  # the smallest id keeps the passage
    assert want[5, PASSAGE][1] == 60 and want[2, " ".join(["w"] * 90)][1] == 89
    assert want[4, rows[5][1]][1] == 0


@pytest.mark.parametrize("group", [1 << 21, 300])
def test_random_texts_match_the_plain_version(spark, group):
    """Small groups need longer prefixes; one passage is in a third of the rows."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    hot = " ".join(rng.choice("ab") for _ in range(50))
    rows = [(i, f"{t} {hot} {t}" if i % 3 == 0 else t) for i, t in enumerate(texts)]
    check(spark, rows, depth=6, group=group)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = substrings.digest(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = {(r["doc_id"], r["n_words"]): r for r in got.collect()}
    assert got.count() == len(ROWS)
    assert rows[7, 60_003]["n_removed"] == 60_000 and rows[6, 60_000]["n_removed"] == 0
    assert rows[3, 0]["n_removed"] == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.digest(empty).collect() == []


def test_remove_keeps_columns_and_untouched_texts(spark):
    rows = [(1, f"a  {PASSAGE}", "en", "s", 1), (2, f"{PASSAGE}\nend", "de", None, None), (3, "two\twords", None, "s", 2)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in substrings.remove(docs).collect()}
    assert substrings.remove(docs).columns == docs.columns
    assert got[1]["text"] == f"a  {PASSAGE}" and got[2]["text"] == "end" and got[3]["text"] == "two\twords"
    assert got[2]["lang"] == "de" and got[2][CLASHING[0]] == "x"


def test_maximal_repeats_join_successive_windows(spark):
    rows = [(1, PASSAGE), (2, f"x {PASSAGE} y " + " ".join(f"p{i}" for i in range(20, 45)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    (found,) = substrings.repeats(docs).collect()
    assert np.frombuffer(found["runs"], np.int32).reshape(-1, 2).tolist() == [[1, 41], [62, 6]]


def test_codes_and_plans():
    rng = np.random.default_rng(1)
    for top in (1 << 12, 1 << 31):
        values = np.unique(rng.integers(0, top, 2000).astype(np.uint64))
        assert (_decoded(_coded(values)) == values).all()
    for words in (1, 10**3, 10**8, 10**13):
        plan = _Plan(words, 1 << 21)
        assert plan.in_range <= 32 and plan.range_bits <= plan.map_bits
    of, used, wholes = _groups(np.array([[10, 5, 900], [450, 450, 0]]), 100)
    assert (of[0] >= 0).tolist() == [True, True, False] and of.max() < used and wholes >= 1
    none = pa.table({n: pa.array([], pa.binary()) for n in ("doc", "version", "at", "run")})
    assert _maximal(none).num_rows == 0
