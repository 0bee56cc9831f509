"""Phrase collocations from count streams in prefix and suffix order.

Counting goes order by order. Tasks count the n-grams of a run of texts and send
one row per distinct n-gram; from two words on only those whose first and last
n-1 words are frequent themselves, as told by a bit map of the frequent shorter
ones (at most ``2 ** MAP_BITS`` bits; what it lets through in error is counted
and falls below the threshold). So rare n-grams, most of a corpus, stay at home.

All frequent n-grams then form one stream of counts. Range-partitioned and sorted
in prefix order (by their words), an n-gram comes after each of its prefixes and
right before its extensions: the last counts seen of one, two, ... words are
those of its prefixes, and the next row tells whether its one extension is as
frequent as itself. Sorted in suffix order (by the words backwards) the same walk
gives the counts of its last words and its extension to the left. No count is
looked up by hashing. A range starts with the last counts of the ranges before it,
so that a hot first word is split like any other.

Scores are exact integers (decimals of 38 digits).

Defined cases: NULL and empty texts have no words; a NULL language is ``und``;
repeated rows count each; a language without candidates gives no row; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import settle, text_chunks
from strata.llm.hashing import LOWER, mix, runs, span_hashes

MAP_BITS = 28
SLICES = 64
#: Text bytes counted at once inside a task.
CHUNK = 1 << 22
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEED = np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes_of(column: pa.Array) -> np.ndarray:
    """Hashes of the strings of a column without NULLs."""
    out = [np.empty(0, np.uint64)]
    out += [span_hashes(data, offsets[:-1], offsets[1:]) for _, _, data, offsets in text_chunks(column)]
    return np.concatenate(out)


class _Words:
    """The words of a run of texts: codes into ``names`` (exact), the row of
    each, and whether the next word follows in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        breaks = _BREAK[data]
        inside = ~(breaks | _GAP[data])
        starts, ends = runs(inside, offsets)
        places = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=places[1:])
        # the words' bytes alone, one after the other
        buffers = [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))]
        words = pa.Array.from_buffers(pa.large_string(), len(starts), buffers)
        coded = words.dictionary_encode() if len(starts) else pa.array([], pa.large_string()).dictionary_encode()
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.cumsum(breaks, dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)
        self.follows = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        self.hashes = _hashes_of(self.names)[self.codes]

    def starts(self, n: int) -> np.ndarray:
        """Which words start an n-gram inside a piece (for all that have n-1 words after them)."""
        size = max(0, len(self.codes) - n + 1)
        ok = np.ones(size, bool)
        for j in range(n - 1):
            ok &= self.follows[j : j + size]
        return ok

    def labels(self, n: int, salt: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams from every word on; ``salt`` by word."""
        size = max(0, len(self.codes) - n + 1)
        acc = salt[:size].copy()
        for j in range(n):
            acc += self.hashes[j : j + size] * (mix(np.array([j + 1], np.uint64) * _SEED) | np.uint64(1))
        return mix(acc)


def _bits(labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (labels >> np.uint64(64 - size)).astype(np.int64), (mix(labels) >> np.uint64(64 - size)).astype(np.int64)


def _distinct(label: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An index and the number of each distinct row of ``columns``; ``label``
    is a hash of the rows, checked against them."""
    _, first, of, times = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
    if all((c == c[first][of]).all() for c in columns):
        return first, times
    _, first, times = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_counts=True)
    return first, times


def _counted(docs: DataFrame, n: int, frequent: tuple[Broadcast, int] | None) -> DataFrame:
    """(lang, phrase, c): n-gram counts of parts of ``docs(lang, text)``; with
    single words also the number of all words of a language, as NULL phrase."""

    def count(words: _Words, langs: pa.Array) -> pa.RecordBatch | None:
        langs = langs.dictionary_encode()
        code = langs.indices.to_numpy().astype(np.int64)[words.row]
        salt = _hashes_of(langs.dictionary)[code] if len(code) else np.empty(0, np.uint64)
        ok = words.starts(n)
        if frequent is not None:
            bits, size = frequent[0].value, frequent[1]
            shorter = np.ones(len(words.codes) - n + 2 if len(ok) else 0, bool)
            for at in _bits(words.labels(n - 1, salt), size) if len(ok) else ():
                shorter &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            ok &= shorter[:-1] & shorter[1:]
        at = np.flatnonzero(ok)
        if not len(at):
            return None
        first, times = _distinct(words.labels(n, salt)[at], [code[at], *[words.codes[at + j] for j in range(n)]])
        at = at[first]
        names = [words.names.take(pa.array(words.codes[at + j])) for j in range(n)]
        phrase = pc.binary_join_element_wise(*names, pa.scalar(" ", pa.large_string())) if n > 1 else names[0]
        lang, phrase = langs.dictionary.take(pa.array(code[at])).cast(pa.string()), phrase.cast(pa.string())
        if frequent is None:
            held, total = np.unique(code, return_counts=True)
            lang = pa.concat_arrays([lang, langs.dictionary.take(pa.array(held)).cast(pa.string())])
            phrase = pa.concat_arrays([phrase, pa.nulls(len(held), pa.string())])
            times = np.concatenate([times, total])
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(times, pa.int64())], ["lang", "phrase", "c"])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), CHUNK):
                out = count(_Words(data, offsets), batch.column(0).slice(first, end - first))
                if out is not None:
                    yield out

    return docs.mapInArrow(tasks, "lang string, phrase string, c bigint")


def _bit_map(level: DataFrame, n: int) -> tuple[Broadcast, int]:
    """A bit map of the n-grams of ``level(lang, phrase)``, two bits each, and
    its size; it follows their number up to ``2 ** MAP_BITS``."""
    spark = level.sparkSession
    size = min(MAP_BITS, max(16, int(16 * level.count()).bit_length()))
    inner = size - SLICES.bit_length() + 1

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), CHUNK):
                words = _Words(data, offsets)
                salt = _hashes_of(batch.column(0).slice(first, end - first))[words.row]
                at = np.unique(np.concatenate(_bits(words.labels(n, salt)[::n], size)))
                pieces = np.split(at, np.flatnonzero(np.diff(at >> inner)) + 1) if len(at) else []
                keys = [int(p[0] >> inner) for p in pieces]
                places = [(p & ((1 << inner) - 1)).astype(np.uint32).tobytes() for p in pieces]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.binary())], ["key", "data"])

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        bit = np.zeros(1 << inner, np.uint8)
        for data in rows.column("data").to_pylist():
            bit[np.frombuffer(data, np.uint32)] = 1
        packed = zlib.compress(np.packbits(bit, bitorder="little").tobytes(), 1)
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([packed], pa.binary())})

    schema = "key bigint, data binary"
    out, width = np.zeros((1 << size) // 8, np.uint8), (1 << inner) // 8
    for r in level.select("lang", "phrase").mapInArrow(tasks, schema).groupBy("key").applyInArrow(merged, schema).collect():
        out[r["key"] * width : (r["key"] + 1) * width] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return spark.sparkContext.broadcast(out), size


def frequent_ngrams(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of the n-grams of up to ``longest`` words that
    occur ``least`` times in a language, and (lang, n), its number of words."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    levels, frequent = [], None
    for n in range(1, longest + 1):
        counts = _counted(texts, n, frequent).groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        level = settle(counts.where((F.col("f") >= least) | F.col("phrase").isNull()), f"{n}-grams")
        levels.append(level)
        own = level.where(F.col("phrase").isNotNull())
        if n == longest or own.isEmpty():
            break
        frequent = _bit_map(own, n)
    totals = levels[0].where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    every = reduce(DataFrame.unionByName, levels).where(F.col("phrase").isNotNull())
    return every.select("lang", "phrase", F.split("phrase", " ").alias("words"), "f"), totals


def _stream(counts: DataFrame, words: Column, longest: int, name: str) -> DataFrame:
    """``counts`` walked in the order of (lang, ``words``): ``<name>`` has the
    counts of the first one, two, ... words of ``words``, ``absorbed`` whether an
    n-gram that is one word longer at the end of ``words`` occurs as often."""
    ranged = counts.withColumns({"key__": words, "m__": F.size(words)}).repartitionByRange("lang", "key__")
    stream = settle(ranged.withColumn("part__", F.spark_partition_id()), f"{name}-order")
    f, m, key = F.col("f"), F.col("m__"), F.col("key__")
    place = F.struct("lang", "key__")
    sizes = range(1, longest)
    row = F.struct("lang", "key__", "f")

    ends = stream.groupBy("part__").agg(
        F.min(row).alias("head__"), *[F.max_by(F.when(m == k, f), F.when(m == k, place)).alias(f"end{k}") for k in sizes]
    )
    # one row a range
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "part__",
        F.lead("head__").over(Window.orderBy("part__")).alias("head__"),
        *[F.last(f"end{k}", ignorenulls=True).over(before).alias(f"before{k}") for k in sizes],
    )

    walk = Window.partitionBy("part__").orderBy("lang", "key__")
    so_far = walk.rowsBetween(Window.unboundedPreceding, -1)
    seen = stream.select(
        "*",
        F.lead(row).over(walk).alias("next__"),
        *[F.last(F.when(m == k, f), ignorenulls=True).over(so_far).alias(f"seen{k}") for k in sizes],
    ).join(carried, "part__", "left")
    after = F.coalesce("next__", "head__")
    absorbed = (
        (after["lang"] == F.col("lang"))
        & (F.size(after["key__"]) == m + 1)
        & (F.slice(after["key__"], 1, m) == key)
        & (after["f"] == f)
    )
    given = F.col("absorbed") if "absorbed" in counts.columns else F.lit(False)
    return seen.select(
        *[c for c in counts.columns if c != "absorbed"],
        F.array(*[F.when(m > k, F.coalesce(f"seen{k}", f"before{k}")) for k in sizes]).alias(name),
        (given | F.coalesce(absorbed, F.lit(False))).alias("absorbed"),
        F.col("part__").alias("part"),
    )


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = 5,
    least: int = 100,
    top: int = 2000,
) -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    a, l, r count the phrase and the two parts of its worst cut; the score is
    floor(1000 a n / (l r)). Phrases inside a longer one of the same count go."""
    counts, totals = frequent_ngrams(docs, text, lang, longest, least)
    by_prefix = _stream(counts, F.col("words"), longest, "lefts")
    both = _stream(by_prefix.drop("part"), F.reverse("words"), longest, "rights")
    m = F.size("words")
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        left, right = F.get("lefts", k - 1), F.get("rights", m - k - 1)
        above, below = wide(F.col("f") * 1000) * wide(F.col("n")), wide(left) * wide(right)
        score = F.call_function("div", above, below)
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    scored = (
        both.where((m >= 2) & ~F.col("absorbed"))
        .join(totals, "lang")
        .withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), m - 1), cut)))
        .select("lang", "part", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best are among the best of its ranges
    ahead = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    ranked = ahead.where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")
    )
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
