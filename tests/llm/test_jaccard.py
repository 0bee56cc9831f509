"""The n-gram Jaccard join and its components against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from cases import SF_DIR, components, documents, shingles

from strata.llm import jaccard, queries
from strata.llm.components import components as spark_components


def test_query_equals_all_pairs(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    want = components(rows)
    got = queries.op10_jaccard(spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(shingles(t)), want[i]) for i, t in rows)


def _family(rng, base, n, edits):
    """Copies of a text with a few words changed, all distinct."""
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"w{rng.randrange(10**6)}"
        out.append(" ".join([*words, f"end{i}"]))
    return out


def test_large_groups_of_near_copies_keep_all_links(spark, monkeypatch):
    """Near copies at the threshold: rounds of neighbours, then all the rest."""
    rng = random.Random(11)
    texts = []
    for size, edits in ((40, 1), (40, 2), (30, 3)):
        texts += _family(rng, [f"b{size}{edits}{i}" for i in range(90)], size, edits)
    texts += [" ".join(f"u{rng.randrange(50)}" for _ in range(60)) for _ in range(30)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs = documents(spark, [(i, t, None, None, 0) for i, t in rows])
    want = components(rows)
    assert 40 < len(set(want.values())) < 140
    monkeypatch.setattr(jaccard, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(jaccard, "MAX_ROUNDS", 2)
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == want


def test_defined_cases(spark):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join(documents(spark)).collect())
    by = {}
    for i, n, c in got:
        by.setdefault(i, []).append((n, c))
    assert by[1] == [(8, 1), (8, 1)] and by[2] == [(8, 1)]
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)]
    assert by[6][0][1] == 6 and by[7][0][1] == 6
    assert by[8] == [(1, 8), (1, 8)] and by[9] == [(1, 9)] and by[0] == [(4, None)]
    assert jaccard.join(documents(spark, [])).count() == 0


def test_an_id_with_two_texts_joins_their_groups(spark):
    a, b = "one two three four five six seven", "red green blue black white pink grey"
    rows = [(1, a), (2, b), (3, a), (3, b)]
    docs = documents(spark, [(i, t, None, None, 0) for i, t in rows])
    assert {r.component_id for r in jaccard.join(docs).collect()} == {1}


def test_threshold_is_exact(spark):
    """8 of 10 shingles shared links (100 * 8 >= 80 * 10), 7 of 9 does not."""
    base = [f"t{i}" for i in range(13)]  # 9 shingles
    rows = [(1, " ".join(base[:12])), (2, " ".join(["x", *base])), (3, " ".join(base[1:12] + ["y"]))]
    docs = documents(spark, [(i, t, None, None, 0) for i, t in rows])
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == components(rows)


def test_shared_shingles_are_counted_over_fragments_and_ranges(monkeypatch):
    """Against counting whole sets, for small fragments and many ranges."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(60))) for _ in range(40)]
    ids = list(range(-7, 33))
    sets = [set(shingles(t)) for t in texts]
    held = Counter(x for s in sets for x in s)
    want = {i: sum(held[x] > 1 for x in s) for i, s in zip(ids, sets, strict=True)}
    monkeypatch.setattr(jaccard, "FRAGMENT", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 9]), pa.array(texts[a : a + 9])], names=["id", "text"]) for a in range(0, 40, 9)]
    for parts in (1, 3, 64):
        dealt = pa.Table.from_batches(list(jaccard._fragments(5, 48, parts)(iter(batches)))).sort_by("part")
        got = Counter()
        for batch in jaccard._shared_counts(iter(dealt.to_batches(max_chunksize=2))):
            for i, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                got[i] += c
        assert {i: got[i] for i in ids} == want
    numbers = np.array([0, 1, 255, 256, 2**63 + 5], dtype=np.uint64)
    assert jaccard._numbers(jaccard._planes(numbers)).tolist() == numbers.tolist()


def test_only_documents_with_enough_shared_shingles_are_linkable(spark):
    base = [f"t{i}" for i in range(13)]
    rows = [(1, " ".join(base[:12])), (2, " ".join(["x", *base])), (4, " ".join(f"a{i}" for i in range(30))), (5, "")]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    sizes = spark.createDataFrame([(i, len(shingles(t))) for i, t in rows], "id bigint, n bigint")
    assert {r.id for r in jaccard._linkable(texts, sizes, 5, 80).collect()} == {1, 2}


def test_partition_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool[: 2 * n], n, replace=False)) for n in (1, 5, 40, 41, 300, 1500) for _ in (0, 1)]
    counts = [np.frombuffer(jaccard._partition_counts(s), np.uint8).astype(np.int64) for s in sets]
    for x, a in zip(sets, counts, strict=True):
        for y, b in zip(sets, counts, strict=True):
            assert jaccard.most_overlap(a, b) >= len(np.intersect1d(x, y))


def test_few_unlinked_pairs_of_a_group_of_near_copies_are_compared():
    """Sets of one group that share 70 % do not pass the suffix filter; linked ones do."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)

    def passing(changed: int) -> float:
        sets = []
        for _ in range(40):
            s = base.copy()
            s[rng.choice(150, changed, replace=False)] = rng.integers(0, 2**64, changed, dtype=np.uint64)
            sets.append(np.sort(s))
        pairs = [(i, j) for i in range(40) for j in range(i)]
        counts = [jaccard._partition_counts(s) for s in sets]
        columns = [[i for i, _ in pairs], [j for _, j in pairs], [counts[i] for i, _ in pairs], [counts[j] for _, j in pairs], [150] * len(pairs), [150] * len(pairs)]
        batch = pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=list("abxynm"))
        return sum(b.num_rows for b in jaccard._suffix_filter(80)(iter([batch]))) / len(pairs)

    assert passing(14) < 0.1
    assert passing(8) == 1  # at least 134 of 166 shared


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 200), (41, 40)]
    got = dict(spark_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(1, 42)} == {1}
    assert {got[j] for j in range(100, 140)} == {100} and got[200] == 200 and len(got) == 82
    assert spark_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
