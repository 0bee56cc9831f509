"""Exact substring de-duplication by prefix-partitioned suffix trees over words.

Every word position starts a suffix of its document. A repeat of ``depth`` words
is an internal node of the corpus' suffix tree at least that deep, so only
suffixes below such nodes matter, and the tree is never needed in one piece:

1. Counting. Tasks send truncated fingerprints of each suffix's first ``depth``
   words, sorted and delta-coded (about two bytes a suffix), by range of the
   value; what a range holds twice becomes its part of a bit map. A suffix whose
   bit is unset hangs off the tree by a leaf edge and is left out; a chance
   agreement only lets one more through. The same pass counts suffixes by
   prefixes of 1, 2, 4 and 8 words.
2. Partitioning. A suffix belongs to its shortest prefix that at most ``group``
   suffixes share (the whole ``depth`` words at last), and prefixes are packed into
   groups of that size. Suffixes of one deep node always share a group.
3. Subtrees. Each group sorts its suffixes by the label of their path down to
   ``depth``; equal neighbours hang from one deep node. All but the first by
   (document, start) are repeats. Joined again by document, runs of successive
   repeats are the maximal repeats, given as word spans.

A task keeps only the first of the suffixes that it holds of a node and reports
the others as repeats itself, so a passage in a third of all documents costs its
group a row a task. Labels are 96-bit hashes of the words; the bit map, at most
``2 ** MAP_BITS`` bits, is all that is broadcast: when it fills up (from some
10^8 distinct repeated windows on) more suffixes are sent, with the same result.

Defined cases: NULL and empty texts have no words; documents of fewer than
``depth`` words have no window; a NULL id counts as the largest; rows of one id
are one document if their texts are equal, else ordered by a hash of the text;
every row is answered; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import text_chunks
from strata.llm.hashing import mix, word_hashes

#: Words of a prefix, tried in this order.
PREFIXES = (1, 2, 4, 8)
MAP_BITS = 28
#: Suffixes held by a task before it sends them.
HELD = 1 << 20
_LAST = (1 << 63) - 1
_FIRST_SEED, _SECOND_SEED = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _seeds(base: np.uint64, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * base) | np.uint64(1)


class _Suffixes:
    """The suffixes of a run of texts that have ``depth`` words at least."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        self.words, first = word_hashes(data, offsets, lower=False)
        counts = np.diff(first)
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(self.words)) - np.repeat(first[:-1], counts)
        self.start = np.flatnonzero(at + depth <= counts[row])
        self.row, self.at, self.depth = row[self.start], at[self.start].astype(np.int32), depth

    def paths(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Labels of the first ``depth`` words, and of each of PREFIXES that is shorter."""
        acc, seeds, shorter = np.zeros(len(self.start), np.uint64), _seeds(_FIRST_SEED, self.depth), []
        for j in range(self.depth):
            acc += self.words[self.start + j] * seeds[j]
            if j + 1 in PREFIXES and j + 1 < self.depth:
                shorter.append(mix(acc))
        return mix(acc), shorter

    def second(self, of: np.ndarray) -> np.ndarray:
        """A further 32 bits of the labels of the suffixes ``of``."""
        acc, seeds = np.zeros(len(of), np.uint64), _seeds(_SECOND_SEED, self.depth)
        for j in range(self.depth):
            acc += self.words[self.start[of] + j] * seeds[j]
        return (mix(acc) >> np.uint64(32)).astype(np.uint32)


# ------------------------------------------------------------- counting ----


def _coded(values: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 as gaps of 16 bits (65535 goes on without a
    number) or, where they lie far apart, plainly."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    if int(values[-1]) > 20000 * len(values):
        return b"w" + values.astype(np.uint32).tobytes()
    more = gaps // 65535
    out = np.full(int((more + 1).sum()), 65535, np.uint16)
    out[np.cumsum(more + 1).astype(np.int64) - 1] = gaps % 65535
    return b"n" + out.tobytes()


def _decoded(data: bytes) -> np.ndarray:
    if data[:1] == b"w":
        return np.frombuffer(data[1:], np.uint32).astype(np.uint64)
    gaps = np.frombuffer(data[1:], np.uint16)
    return np.cumsum(gaps, dtype=np.uint64)[gaps != 65535]


class _Plan:
    """Sizes that follow the number of words: bits of a fingerprint, ranges of
    its values, bits of the map, prefix counters, buckets of documents."""

    def __init__(self, words: int, group: int):
        n = max(words, 2)
        self.bits = min(54, max(16, math.ceil(math.log2(n)) + 6))
        self.range_bits = max(4, math.ceil(math.log2(n / (1 << 21))), self.bits - 31)
        self.map_bits = min(MAP_BITS, self.bits)
        self.range_bits = min(self.range_bits, self.map_bits - 6)
        self.buckets = max(64, n >> 21)
        self.counters = 1 << min(20, max(8, math.ceil(math.log2(4 * n / group))))

    @property
    def in_range(self) -> int:
        return self.bits - self.range_bits


def _levels(depth: int) -> int:
    return sum(p < depth for p in PREFIXES)


def _count(docs: DataFrame, text: str, depth: int, plan: _Plan) -> tuple[np.ndarray, np.ndarray]:
    """The bit map of fingerprints that occur twice, and suffixes by prefix
    (prefix lengths x counters). Both are of bounded size."""
    bits, inner, counters, levels = plan.bits, plan.in_range, plan.counters, _levels(depth)

    def sent(values: np.ndarray) -> Iterator[tuple[int, bytes]]:
        part = values >> np.uint64(inner)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for piece in np.split(values, cuts) if len(values) else ():
            yield int(piece[0] >> np.uint64(inner)), _coded(piece & np.uint64((1 << inner) - 1))

    def packed(labels: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(labels), return_counts=True)
        rows = [*sent(values), *sent(values[times > 1])]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["key", "data"]
        )

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, held, sums = [], 0, np.zeros((levels, counters), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                suffixes = _Suffixes(data, offsets, depth)
                label, shorter = suffixes.paths()
                labels.append(label >> np.uint64(64 - bits))
                held += len(label)
                for level, prefix in enumerate(shorter):
                    sums[level] += np.bincount((prefix % np.uint64(counters)).astype(np.int64), minlength=counters)
                if held >= HELD:
                    yield packed(labels)
                    labels, held = [], 0
        if held:
            yield packed(labels)
        if sums.any():
            keys = [-1 - level for level in range(levels)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sums], pa.binary())], ["key", "data"]
            )

    map_bits, range_bits = plan.map_bits, plan.range_bits

    def reduced(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        parts = rows.column("data").to_pylist()
        if number < 0:
            out = sum(np.frombuffer(p, np.int64) for p in parts).tobytes()
        else:
            values = np.sort(np.concatenate([_decoded(p) for p in parts]))
            twice = values[1:][values[1:] == values[:-1]] >> np.uint64(inner - (map_bits - range_bits))
            bit = np.zeros(1 << (map_bits - range_bits), np.uint8)
            bit[twice.astype(np.int64)] = 1
            out = zlib.compress(np.packbits(bit, bitorder="little").tobytes(), 1)
        return pa.table({"key": pa.array([number], pa.int64()), "data": pa.array([out], pa.binary())})

    found = (
        docs.select(text)
        .mapInArrow(tasks, "key bigint, data binary")
        .groupBy("key")
        .applyInArrow(reduced, "key bigint, data binary")
        .collect()
    )
    width = (1 << (map_bits - range_bits)) // 8
    seen, sums = np.zeros((1 << map_bits) // 8, np.uint8), np.zeros((levels, counters), np.int64)
    for r in found:
        if r["key"] < 0:
            sums[-1 - r["key"]] = np.frombuffer(r["data"], np.int64)
        else:
            seen[r["key"] * width : (r["key"] + 1) * width] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return seen, sums


# --------------------------------------------------------- partitioning ----


def _groups(sums: np.ndarray, size: int) -> tuple[np.ndarray, int, int]:
    """Group by (prefix length, counter), -1 where a longer prefix is needed;
    the first group of whole labels and how many of them there are."""
    of, used = np.full(sums.shape, -1, np.int64), 0
    if not len(sums):
        return of, 1, 1
    for level, counts in enumerate(sums):
        fit = counts <= size
        if level:  # a level's counters also count what shorter prefixes have settled
            share = sums[level - 1][sums[level - 1] > size].sum() / max(counts.sum(), 1)
            counts = counts * share
        filled = np.cumsum(np.where(fit, counts, 0)) // size
        of[level][fit] = used + filled[fit].astype(np.int64)
        used += int(filled[-1]) + 1
    rest = int(sums[-1][sums[-1] > size].sum())
    return of, used, max(1, math.ceil(rest / size))


# ------------------------------------------------------------- subtrees ----

_SENT = "grp bigint, repeats boolean, label binary, label2 binary, doc binary, version binary, at binary, run binary"
_RUN = ("doc", "version", "at", "run")
_SPANS = "doc bigint, version bigint, runs binary"


def _ranks(doc: np.ndarray, version: np.ndarray) -> np.ndarray:
    """Numbers that grow with (doc, version); equal pairs have equal ones."""
    order = np.lexsort((version, doc))
    step = np.zeros(len(doc), np.int64)
    step[1:] = (doc[order[1:]] != doc[order[:-1]]) | (version[order[1:]] != version[order[:-1]])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def _below_deep_nodes(label: np.ndarray, label2: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first suffix of each node, and of the others (a suffix
    that stands there twice, by repeated rows, once)."""
    order = np.lexsort((place, label2, label))
    a, b, p = label[order], label2[order], place[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    again = np.zeros(len(order), bool)
    again[1:] = ~fresh[1:] & (p[1:] != p[:-1])
    return order[fresh], order[again]


def _runs(rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of successive starts in a document."""
    new = np.ones(len(at), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at))).astype(np.int32)


def _send(docs: DataFrame, depth: int, plan: _Plan, seen, of: np.ndarray, whole: int, wholes: int) -> DataFrame:
    """Each task's suffixes that may repeat, by group; repeats that it sees
    itself go along as runs."""
    counters, map_bits = plan.counters, plan.map_bits

    def chosen(label: np.ndarray, shorter: list[np.ndarray]) -> np.ndarray:
        group = (label % np.uint64(wholes)).astype(np.int64) + whole
        for level in reversed(range(len(of))):
            own = of[level][(shorter[level] % np.uint64(counters)).astype(np.int64)]
            group = np.where(own >= 0, own, group)
        return group

    def packed(parts: list[tuple], names: list[tuple]) -> pa.RecordBatch:
        label, label2, group, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc, version = (np.concatenate(x) for x in zip(*names, strict=True))
        place = (_ranks(doc, version)[row] << 32) | at
        first, others = _below_deep_nodes(label, label2, place)
        first = first[np.lexsort((place[first], group[first]))]
        rows = []
        for piece in np.split(first, np.flatnonzero(np.diff(group[first])) + 1):
            data = [x.tobytes() for x in (label[piece], label2[piece], doc[row[piece]], version[row[piece]], at[piece])]
            rows.append((int(group[piece[0]]), False, *data, None))
        others = others[np.argsort(place[others])]
        begin, length = _runs(place[others] >> 32, at[others])
        others = others[begin]
        for n, piece in enumerate(np.array_split(np.arange(len(others)), 1 + len(others) // 4096)):
            if len(piece):
                of = others[piece]
                data = [x.tobytes() for x in (doc[row[of]], version[row[of]], at[of])]
                rows.append((int(doc[row[of[0]]]) % whole + n, True, None, None, *data, length[piece].tobytes()))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 6]
        fields = [f.split()[0] for f in _SENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, parts, names, held, texts = seen.value, [], [], 0, 0
        for batch in batches:
            doc, version = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2))
            for first, end, data, offsets in text_chunks(batch.column(0)):
                suffixes = _Suffixes(data, offsets, depth)
                label, shorter = suffixes.paths()
                bit = (label >> np.uint64(64 - map_bits)).astype(np.int64)
                hit = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                row = (suffixes.row[hit] + texts).astype(np.int32)
                group = chosen(label[hit], [s[hit] for s in shorter]).astype(np.int32)
                parts.append((label[hit], suffixes.second(hit), group, row, suffixes.at[hit]))
                names.append((doc[first:end], version[first:end]))
                held, texts = held + len(hit), texts + end - first
                if held >= HELD:
                    yield packed(parts, names)
                    parts, names, held, texts = [], [], 0, 0
        if held:
            yield packed(parts, names)

    return docs.mapInArrow(tasks, _SENT)


def _joined(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in rows.column(name).to_pylist())])


def _subtrees(sent: DataFrame, buckets: int) -> DataFrame:
    """Runs of repeats of every group, packed by bucket of documents."""

    def subtree(rows: pa.Table) -> pa.Table:
        told, own = (rows.filter(pc.equal(rows.column("repeats"), flag)) for flag in (True, False))
        label, label2 = _joined(own, "label", np.uint64), _joined(own, "label2", np.uint32)
        doc, version, at = _joined(own, "doc", np.int64), _joined(own, "version", np.int64), _joined(own, "at", np.int32)
        place = _ranks(doc, version) << 32 | at
        _, others = _below_deep_nodes(label, label2, place)
        others = others[np.argsort(place[others])]
        begin, length = _runs(place[others] >> 32, at[others])
        others = others[begin]
        columns = [
            np.concatenate([mine, _joined(told, name, mine.dtype.type)])
            for name, mine in (("doc", doc[others]), ("version", version[others]), ("at", at[others]), ("run", length))
        ]
        bucket = (mix(columns[0].view(np.uint64) ^ columns[1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        pieces = np.split(order, cuts) if len(order) else []
        data = {n: pa.array([c[p].tobytes() for p in pieces], pa.binary()) for n, c in zip(_RUN, columns, strict=True)}
        return pa.table({"bucket": pa.array([int(bucket[p[0]]) for p in pieces], pa.int64()), **data})

    return sent.groupBy("grp").applyInArrow(subtree, "bucket bigint, doc binary, version binary, at binary, run binary")


def _maximal(rows: pa.Table) -> pa.Table:
    """A row per document of a bucket: its runs, joined where one goes on in the next."""
    doc, version = _joined(rows, "doc", np.int64), _joined(rows, "version", np.int64)
    at, run = _joined(rows, "at", np.int32), _joined(rows, "run", np.int32)
    order = np.lexsort((at, version, doc))
    doc, version, at, run = doc[order], version[order], at[order].astype(np.int64), run[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    first = np.flatnonzero(fresh)
    # ends so far, by document: texts are set apart by more than any of them is long
    apart = (np.cumsum(fresh) - 1) << 32
    ends = np.maximum.accumulate(apart + at + run)
    starts = fresh.copy()
    starts[1:] |= apart[1:] + at[1:] > ends[:-1]
    begin = np.flatnonzero(starts)
    last = np.append(begin[1:], len(doc))[: len(begin)] - 1
    spans = np.stack([at[begin], ends[last] - apart[last] - at[begin]], 1).astype(np.int32)
    of = np.searchsorted(begin, first)
    return pa.table(
        {
            "doc": pa.array(doc[first], pa.int64()),
            "version": pa.array(version[first], pa.int64()),
            "runs": pa.array([p.tobytes() for p in np.split(spans, of[1:])] if len(of) else [], pa.binary()),
        }
    )


# ------------------------------------------------------------ interface ----


def _named(docs: DataFrame, text: str, key: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = 20, group: int = 1 << 20) -> DataFrame:
    """(doc, version, runs): per document with repeated windows the packed
    (start, number of successive windows) pairs, 32-bit integers, of the windows
    of ``depth`` words that also start earlier. ``version`` is a hash of the text."""
    spark = docs.sparkSession
    # a word and its separator are two characters at least
    chars = docs.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    plan = _Plan(chars // 4 + 1, group)
    seen, sums = _count(docs, text, depth, plan)
    of, whole, wholes = _groups(sums, group)
    name, version = _named(docs, text, key)
    sent = _send(
        docs.select(text, name.alias("doc"), version.alias("version")),
        depth, plan, spark.sparkContext.broadcast(seen), of, whole, wholes,
    )
    return _subtrees(sent, plan.buckets).groupBy("bucket").applyInArrow(_maximal, _SPANS)


def _covered(n: int, runs: bytes, depth: int) -> np.ndarray:
    """Which of ``n`` words lie in a run's windows."""
    edges = np.zeros(n + 1, np.int64)
    pairs = np.frombuffer(runs, np.int32).reshape(-1, 2).astype(np.int64)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, pairs[:, 0] + pairs[:, 1] + depth - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def _kept(text: str | None, runs: bytes | None, depth: int) -> tuple[int, bytes]:
    """Number of words, and the words that stay, joined by one space."""
    words = (text or "").encode().split()  # splits at ASCII white space alone
    if runs:
        gone = _covered(len(words), runs, depth)
        return len(words), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return len(words), b" ".join(words)


def _with_runs(docs: DataFrame, text: str, key: str, depth: int, group: int) -> DataFrame:
    found = repeats(docs, text, key, depth, group)
    doc, version = _named(docs, text, key)
    named = docs.withColumns({"doc__": doc, "version__": version})
    found = found.select(F.col("doc").alias("doc__"), F.col("version").alias("version__"), F.col("runs").alias("runs__"))
    return named.join(found, ["doc__", "version__"], "left")


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = 20, group: int = 1 << 20) -> DataFrame:
    """``docs`` whose texts are the words that stay, joined by one space; texts
    without a repeat are left as they are."""
    columns = [c for c in docs.columns]
    whole = _with_runs(docs, text, key, depth, group)
    at = columns.index(text)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
            new = [_kept(t, r, depth)[1].decode() if r else t for t, r in zip(texts, runs, strict=True)]
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return whole.select(*columns, "runs__").mapInArrow(tasks, docs.schema)


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id", depth: int = 20, group: int = 1 << 20) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row."""
    whole = _with_runs(docs.select(key, text), text, key, depth, group)
    schema = docs.select(key).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sums = [], [], []
            for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total, kept = _kept(t, r, depth)
                n.append(total)
                gone.append(total - (kept.count(b" ") + 1 if kept else 0))
                sums.append(hashlib.sha256(kept).hexdigest())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return whole.select(key, text, "runs__").mapInArrow(tasks, schema)
