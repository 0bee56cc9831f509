"""Packing of tokenised documents into fixed-length sequences by best fit.

A document is its token ids and an end id. Documents longer than ``capacity``
are cut into full pieces, the first of which may be shorter; full pieces are a
sequence each. The rest is packed in bulk-synchronous best-fit steps:

* range sort: every piece gets its rank among the pieces of its length, from
  its rank inside the task that made it plus the counts of earlier tasks;
* a step takes all documents of one length, longest first, and sweeps the open
  gaps from the successor of that length upwards. Equal gaps are one range of
  sequences, so document rank k of a length goes to gap rank k of the range:
  ranks settle who gets which gap. Gaps are updated and the next step begins;
  documents beyond the last fitting gap open new sequences.

The steps work on counts by length (at most ``capacity`` numbers) whatever the
number of documents; documents themselves never leave the tasks, which look
their rank up in the ranges. Ranges number at most a few per length and step.

Defined cases: NULL text is empty, an empty text is the end id alone; repeated
rows are packed each; NULL ids are kept; no documents: no rows; other columns
are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import SMALL_CHUNK_BYTES, settle, text_chunks
from strata.llm.hashing import SPACE, span_hashes

END_ID = 2
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[33:127] = True
_PUNCTUATION[48:58] = _PUNCTUATION[65:91] = _PUNCTUATION[97:123] = False
#: First bytes of characters that are no white space: ASCII, and two-byte ones beyond U+00BF.
_PLAIN = ~SPACE
_PLAIN[:33] = False
_PLAIN[127:] = False
_PLAIN[0xC3:0xE0] = True


def _places(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Where the texts hold added tokens: from the left, without overlap, the
    longest of those that begin at one place, inside one row each."""
    raw, found, out, end = data.tobytes(), [], [], 0
    for token in added:
        at = raw.find(token)
        while at >= 0:
            found.append((at, -len(token)))
            at = raw.find(token, at + 1)
    for at, back in sorted(found):
        row_end = int(offsets[np.searchsorted(offsets, at, side="right")])
        if at >= end and at - back <= row_end:
            end = at - back
            out.append((at, end))
    return out


def safe_cuts(
    data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of parts whose ids, joined, are the ids of the text.

    The tokenizer's own pattern always ends a token at these places: before a
    single space or line end between two visible characters, after such a line
    end, and between an ASCII letter and ASCII punctuation. An ``added`` token of
    the tokenizer in the text is a part of its own."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    if n:
        visible_next = np.zeros(n, dtype=bool)
        visible_next[:-1] = _PLAIN[data[1:]]
        visible_before = np.zeros(n, dtype=bool)
        ascii_visible = _PLAIN[data] & (data < 127)
        visible_before[1:] = ascii_visible[:-1]
        two_byte = np.zeros(n, dtype=bool)
        two_byte[1:] = (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        visible_before[1:] |= two_byte[:-1]
        inner = np.ones(n + 1, dtype=bool)  # not beside a row's edge
        inner[offsets] = False
        lone = visible_before & visible_next & inner[:n] & inner[1:]
        cut[:n] = lone & ((data == 32) | (data == 10))
        cut[1:] |= lone & (data == 10)
        cut[1:n] |= _ASCII_LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
    for start, end in _places(data, offsets, added):
        cut[start + 1 : end] = False
        cut[[start, end]] = True
    cut[offsets] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.append(starts[1:], n)


class TokenCache:
    """Ids of text parts by hash; emptied when it holds ``most`` parts."""

    def __init__(self, tokenizer, most: int = 1_500_000):
        self.tokenizer, self.most = tokenizer, most
        self.added = tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each part has."""
        hashes = span_hashes(data, starts, ends)
        unique, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > self.most:
            self.clear()
        at = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == unique[inside]
        if not known.all():
            self._add(unique[~known], data, starts[example[~known]], ends[example[~known]])
            at = np.searchsorted(self.hashes, unique)
        first, count = self.first[at] & 0xFFFFFFFFFF, self.first[at] >> 40
        counts = count[inverse]
        ends_out = np.cumsum(counts)
        total = int(ends_out[-1]) if len(ends_out) else 0
        source = np.repeat(first[inverse] - (ends_out - counts), counts) + np.arange(total)
        return self.ids[source], counts

    def _add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        counts = np.array([len(x) for x in encoded], dtype=np.int64)
        new = np.concatenate([np.array(x, dtype=np.uint32) for x in encoded])
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        first = self.used + np.cumsum(counts) - counts
        self.used += len(new)
        where = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, where, hashes)
        self.first = np.insert(self.first, where, first | counts << 40)


_caches: dict[str, TokenCache] = {}


def _cache(vocabulary: str) -> TokenCache:
    if vocabulary not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _caches[vocabulary] = TokenCache(Tokenizer.from_file(public_tokenizers.path(vocabulary)))
    return _caches[vocabulary]


def token_ids(cache: TokenCache, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and the index of each row's first id."""
    starts, ends = safe_cuts(data, offsets, cache.added)
    if not len(starts):
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    ids, counts = cache.lookup(data, starts, ends)
    before = np.concatenate(([0], np.cumsum(counts)))
    return ids, before[np.searchsorted(starts, offsets)]


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per piece; ``task`` and ``rank``: the task that made it, and its
    place among the task's pieces of that length."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"

    def run(batches):
        cache, task = _cache(vocabulary), TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), SMALL_CHUNK_BYTES):
                ids, first = token_ids(cache, data, offsets)
                ids = ids.astype("<u4", copy=False)
                rows = []
                for i in range(b - a):
                    own = np.append(ids[first[i] : first[i + 1]], np.array([END_ID], "<u4")).astype("<u4")
                    start, piece = 0, 0
                    length = len(own) % capacity or capacity
                    while start < len(own):
                        part = own[start : start + length]
                        rows.append((a + i, piece, start, length, zlib.crc32(part.tobytes()), task, int(made[length])))
                        made[length] += 1
                        start, piece, length = start + length, piece + 1, capacity
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(columns[0])),
                        pa.array(columns[1], pa.int32()),
                        *(pa.array(c, pa.int64()) for c in columns[2:5]),
                        pa.array(columns[5], pa.int32()),
                        pa.array(columns[6], pa.int64()),
                    ],
                    names=["key", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_fit_ranges(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """The bulk steps over ``counts`` (documents by length < capacity).

    Returns rows (length, first rank, first sequence, offset), in that order:
    documents of a length from the first rank on go to successive sequences
    from the first sequence on, at the offset, up to the next row."""
    open_gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, count)
    sizes: list[int] = []  # the gaps that occur, ascending
    out, sequences = [], 0

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in open_gaps:
                open_gaps[gap] = []
                bisect.insort(sizes, gap)
            open_gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):  # no gap fits: new sequences, filled with this length alone
                each = capacity // length
                opened = -(-left // each)
                add(capacity, sequences, opened)
                sequences += opened
                continue
            gap = sizes[at]
            first, count = open_gaps[gap].pop()
            taken = min(count, left)
            out.append((length, rank, first, capacity - gap))
            rank, left = rank + taken, left - taken
            if taken < count:
                open_gaps[gap].append((first + taken, count - taken))
            if not open_gaps[gap]:
                del open_gaps[gap]
                sizes.pop(at)
            add(gap - length, first, taken)
    return np.array(out, dtype=np.int64).reshape(-1, 4), sequences


def pack(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    capacity: int = 1024,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    if not 0 < capacity < 1 << 20:
        raise ValueError("capacity must be positive and below 2^20")
    made = settle(pieces(docs, vocabulary, capacity, text, key), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    by_task = settle(by_task.withColumn("before", earlier), "piece-counts")
    counts = {
        r["length"]: r["n"]
        for r in by_task.where(F.col("length") < capacity).groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    ranges, sequences = best_fit_ranges(counts, capacity)
    # full pieces: their own sequences behind the packed ones
    full = np.array([[capacity, 0, sequences, 0]], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(_indexed(np.concatenate([ranges, full])))
    kind = docs.schema[key].dataType.simpleString()

    def place(batches):
        keys, first_rank, first_sequence, offset = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 42) | rank, side="right") - 1
            sequence = first_sequence[at] + rank - first_rank[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset[at])],
                names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = made.join(by_task.select("length", "task", "before"), ["length", "task"]).select(
        "key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank")
    )
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("key", key)


def _indexed(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Search keys (length, first rank) ascending, and what they lead to."""
    keys = (ranges[:, 0] << 42) | ranges[:, 1]
    order = np.argsort(keys, kind="stable")
    return keys[order], ranges[order, 1], ranges[order, 2], ranges[order, 3]
