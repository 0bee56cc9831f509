"""Exact Jaccard join of word n-gram sets, as connected components.

Documents link when ``100 * |A & B| >= percent * |A | B|``. The join runs over
64-bit shingle hashes, over whole texts:

1. One pass digests each document's set; equal sets form a class with its
   smallest id for all.
2. A document can only link if ``ceil(t n)`` of its ``n`` shingles stand in
   other sets too: with fewer, its rarest ``n - ceil(t n) + 1`` are its own
   alone. Fragments of sorted, shortened hashes, dealt by hash range, count the
   shared shingles of every document; the others leave here. (Two shingles with
   one shortened hash count as shared: that keeps a document, and loses none.)
3. Those that stay order their shingles rare first (by exact count among them,
   then hash: one order for all); the ``n - ceil(t n) + 1`` rarest are the
   prefix. Any two linked sets share a prefix shingle. Of the shingles that
   stand in the same prefixes only the rarest is joined.
4. Rounds of a few candidates a document, leaders of its shingles' groups
   outside its component, verified once, merge the large groups of near copies.
   When few pairs from different components remain, all of them that pass the
   length, positional and suffix filters are verified: no pair is left out but
   those already connected.

The suffix filter bounds the overlap of two sets before they are compared: a
shingle whose hash partition holds none of the other set is in one set only.
There are two to four partitions to a shingle, one bit each, so that of the pairs
in a large group of near copies few pass but those that link.

Defined cases: NULL and empty texts, and texts of white space only, have an
empty set and link with nothing; texts of fewer than ``k`` words have their
whole sequence as one shingle; rows with equal ids are one node (its links are
those of all its texts) and each keeps a row; a NULL id links with nothing and
has a NULL component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import SMALL_CHUNK_BYTES, only, settle, text_chunks
from strata.llm.components import components
from strata.llm.hashing import mix, shingle_sets

#: Shingles in a fragment, and in the hash range that a task holds.
FRAGMENT = 1 << 20
RANGE = 1 << 20
#: All remaining pairs are verified once they are at most so many a prefix row.
PAIRS_PER_ROW = 4
MAX_ROUNDS = 8
#: Leaders of a token's group in a round, and candidates of a document.
LEADERS = 16


def _sets(batches, k: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids and shingle sets, chunk by chunk; rows without an id are left out."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_chunks(batch.column(1), SMALL_CHUNK_BYTES):
            yield ids[a:b], shingle_sets(data, offsets, k)


def _partition_counts(s: np.ndarray) -> bytes:
    """A set's size, four bytes, and which hash partitions hold any of its
    hashes, one bit each: two to four partitions to a hash."""
    parts = 1 << max(3, len(s).bit_length() + 1)
    held = np.zeros(parts, np.uint8)
    held[(s & np.uint64(parts - 1)).astype(np.int64)] = 1
    return len(s).to_bytes(4, "little") + np.packbits(held, bitorder="little").tobytes()


_SURVEY = "id long, n long, d1 long, d2 long, counts binary"


def _survey(k: int):
    """Rows (id, n, d1, d2, counts) of documents: size, digest and held
    partitions of their sets."""

    def run(batches):
        for ids, sets in _sets(batches, k):
            flat = np.concatenate([*sets, np.empty(0, np.uint64)])
            ends = np.cumsum([len(s) for s in sets])
            digests = []
            for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                total = np.concatenate(([0], np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64))).astype(np.uint64)
                digests.append((total[ends] - np.concatenate(([np.uint64(0)], total[ends[:-1]]))).view(np.int64))
            counts = pa.array([_partition_counts(s) for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), sizes, *map(pa.array, digests), counts], names=["id", "n", "d1", "d2", "counts"]
            )

    return run


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers as eight planes of one byte each: the planes of leading
    zeros cost nothing once compressed."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


_FRAGMENT = "part long, single binary, owner binary, several binary, doc binary, found binary"


def _fragments(k: int, bits: int, parts: int):
    """About ``FRAGMENT`` shingles at a time, one row a hash range: the hashes
    of one document only (as sorted gaps) with its id, those of several, and,
    in one of the rows, how many of the latter each document has. So a shingle
    of many documents is one entry a fragment."""
    bounds = np.array([-(-(p << bits) // parts) for p in range(parts + 1)], dtype=np.uint64)
    names = [c.split()[0] for c in _FRAGMENT.split(", ")]

    def fragment(ids: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        docs = np.concatenate(ids).astype(np.int64)
        tokens = np.concatenate(sets) >> np.uint64(64 - bits)
        order = np.argsort(tokens)
        tokens = tokens[order]
        owners = np.repeat(np.arange(len(docs)), [len(s) for s in sets])[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        sizes = np.diff(np.append(starts, len(tokens)))
        found = np.bincount(owners[np.repeat(sizes > 1, sizes)], minlength=len(docs))
        one, many = starts[sizes == 1], starts[sizes > 1]
        lone, common, owner = tokens[one], tokens[many], docs[owners[one]]
        at, to = np.searchsorted(lone, bounds), np.searchsorted(common, bounds)
        home = int(docs[0]) % parts
        rows = []
        for p in range(parts):
            mine = found > 0 if p == home else np.zeros(0, bool)
            if at[p] == at[p + 1] and to[p] == to[p + 1] and not mine.any():
                continue
            gaps = [
                np.diff(x[i[p] : i[p + 1]], prepend=bounds[p]) for x, i in ((lone, at), (common, to))
            ]
            local = (docs[mine], found[mine]) if len(mine) else (docs[:0], found[:0])
            rows.append((p, _planes(gaps[0]), _planes(owner[at[p] : at[p + 1]]), _planes(gaps[1]), *map(_planes, local)))
        kinds = [pa.int64(), *[pa.binary()] * 5]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        ids, sets, size = [], [], 0
        for some, theirs in _sets(batches, k):
            ids.append(some)
            sets += theirs
            size += sum(map(len, theirs))
            if size >= FRAGMENT:
                yield fragment(ids, sets)
                ids, sets, size = [], [], 0
        if size:
            yield fragment(ids, sets)

    return run


def _shared_counts(batches):
    """Rows sorted by part: (id, c), the shingles of the part's range that a
    document shares with others. One range is held at a time."""

    def counted(rows: list[tuple]) -> pa.RecordBatch:
        lone = [np.cumsum(_numbers(r[0]), dtype=np.uint64) for r in rows]
        common = [np.cumsum(_numbers(r[2]), dtype=np.uint64) for r in rows]
        own = np.concatenate([_numbers(r[1]) for r in rows]).view(np.int64)
        tokens = np.concatenate([*lone, *common])
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = np.concatenate(([False], tokens[1:] == tokens[:-1]))
        if len(same):
            same[:-1] |= same[1:]
        shared = order[same]
        ids, counts = np.unique(own[shared[shared < len(own)]], return_counts=True)
        ids = np.concatenate([ids, *[_numbers(r[3]).view(np.int64) for r in rows]])
        counts = np.concatenate([counts, *[_numbers(r[4]).view(np.int64) for r in rows]])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts.astype(np.int64))], names=["id", "c"])

    at, held = None, []
    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            if part != at and held:
                yield counted(held)
                held = []
            at = part
            held.append(tuple(batch.column(c)[i].as_py() for c in range(1, 6)))
    if held:
        yield counted(held)


def _stored(k: int):
    """(id, set): each text's set as sorted 64-bit hashes."""

    def run(batches):
        for ids, sets in _sets(batches, k):
            raw = pa.array([s.astype("<u8", copy=False).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), raw], names=["id", "set"])

    return run


def _tokens(batches):
    """Rows (token, id, n, text) of stored sets; ``text`` tells the texts of
    one id apart."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            ids = batch.column(0)[a : a + 256].to_numpy()
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)[a : a + 256]]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            texts = np.array([np.bitwise_xor.reduce(mix(s)) for s in sets], dtype=np.uint64)
            columns = [np.concatenate(sets).view(np.int64), np.repeat(ids, sizes), np.repeat(sizes, sizes), np.repeat(texts.view(np.int64), sizes)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["token", "id", "n", "text"])


def _linkable(texts: DataFrame, sizes: DataFrame, k: int, percent: int) -> DataFrame:
    """Ids of the documents with so many shared shingles that they may link."""
    spark = texts.sparkSession
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    bits = min(56, max(16, int(total).bit_length() + 8))  # one of 256 shingles meets another by chance
    dealt = texts.mapInArrow(_fragments(k, bits, parts), _FRAGMENT).repartition(parts, "part").sortWithinPartitions("part")
    counts = dealt.mapInArrow(_shared_counts, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))
    near = counts.join(sizes.select("id", "n"), "id").where(F.col("c") * 100 >= F.col("n") * percent).where("n > 0")
    return settle(near.select("id").distinct(), "linkable")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, pos): a set's ``n - ceil(t n) + 1`` rarest shingles with
    their places, but for those that no other set has."""
    tokens = sets.mapInArrow(_tokens, "token long, id long, n long, text long")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counted = tokens.join(counts, "token", "left")
    rank = F.row_number().over(Window.partitionBy("id", "n", "text").orderBy(F.coalesce("c", F.lit(1)), "token"))
    prefix = F.floor(F.col("n") * (100 - percent) / 100)
    ranked = counted.withColumn("pos", rank - 1).where((F.col("pos") <= prefix) & F.col("c").isNotNull())
    rows = settle(ranked.select("token", "id", "n", "text", "pos", "c"), "prefixes")
    # shingles of the same texts (a passage gives hundreds) make the same pairs:
    # the rarest stands for them, as it is the first that any two of the texts share
    holders = [F.bit_xor(F.xxhash64(F.lit(salt), "id", "n", "text")).alias(f"h{salt}") for salt in (1, 2)]
    groups = rows.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.first("c").alias("c"), *holders).where("many > 1")
    first = groups.groupBy("many", "h1", "h2").agg(F.min_by("token", F.struct("c", "token")).alias("token"))
    return settle(rows.join(first.select("token"), "token", "left_semi").select("token", "id", "n", "pos"), "first-prefixes")


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of linked sets of sizes a and b."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _passes(p: str, q: str, percent: int) -> Column:
    """Length, prefix and positional filters for prefix rows p and q of one
    token. Of two linked sets the smaller shares one of its ``n - ceil(2t / (1
    + t) n) + 1`` rarest shingles with the other's prefix."""
    n_p, n_q, at_p, at_q = F.col(f"{p}n"), F.col(f"{q}n"), F.col(f"{p}pos"), F.col(f"{q}pos")
    p_smaller = (n_p < n_q) | ((n_p == n_q) & (F.col(f"{p}id") < F.col(f"{q}id")))
    most = F.least(at_p, at_q) + 1 + F.least(n_p - 1 - at_p, n_q - 1 - at_q)
    return (
        (F.least(n_p, n_q) * 100 >= F.greatest(n_p, n_q) * percent)
        & F.when(p_smaller, _indexed(n_p, at_p, percent)).otherwise(_indexed(n_q, at_q, percent))
        & (most >= _overlap(n_p, n_q, percent))
    )


def _indexed(n: Column, at: Column, percent: int) -> Column:
    """Whether place ``at`` is in the short prefix of a set of size n."""
    return at <= n - _overlap(n, n, percent)


def most_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of the overlap from the partition counts of two sets: each
    partition that only one of them holds has at least one hash of it alone."""
    a, b = a.astype(np.uint8, copy=False), b.astype(np.uint8, copy=False)
    n, m, a, b = *(int.from_bytes(x[:4].tobytes(), "little") for x in (a, b)), a[4:], b[4:]
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = a & b
    return min(n - int(np.bitwise_count(a ^ both).sum()), m - int(np.bitwise_count(b ^ both).sum()))


def _suffix_filter(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                bound = most_overlap(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
                keep.append(bound * (100 + percent) >= percent * (n + m))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(percent: int):
    """Rows sorted by hub and salt, the hub's own first: the linked pairs. One
    hub's sets are held at a time."""

    def run(batches):
        at, hub_sets = None, []
        for batch in batches:
            hubs, salts, owns, ids = (batch.column(i).to_pylist() for i in range(4))
            linked = []
            for i, key in enumerate(zip(hubs, salts, strict=True)):
                s = np.frombuffer(batch.column(4)[i].as_buffer(), "<u8")
                if key != at:
                    at, hub_sets = key, []
                if owns[i]:
                    hub_sets.append(s.copy())
                    continue
                for h in hub_sets:
                    common = len(h) + len(s) - len(np.union1d(h, s))
                    if common and common * (100 + percent) >= percent * (len(h) + len(s)):
                        linked.append((hubs[i], ids[i]))
                        break
            columns = list(zip(*linked, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return run


def _split(rows: DataFrame, key: str, other: str, name: str, most: int = 100) -> DataFrame:
    """Adds ``name``: the part of its ``key``'s rows that a row falls into, so
    that parts hold about ``most`` rows however many a key has."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts__"))
    part = F.pmod(F.xxhash64(other), F.col("parts__"))
    return rows.join(settle(sizes.where("parts__ > 1"), "parts"), key, "left").withColumn(
        name, F.coalesce(part, F.lit(0)).cast("long")
    ).drop("parts__")


def _verified(pairs: DataFrame, stored: DataFrame, summary: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs(a, b)``, each compared once. A set travels
    only for pairs that pass the suffix filter: a pair's second set to its
    first, whose own set goes once to each part of its pairs."""
    left = summary.select(F.col("id").alias("a"), F.col("counts").alias("x"), "n")
    right = summary.select(F.col("id").alias("b"), F.col("counts").alias("y"), F.col("n").alias("m"))
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m")
    near = settle(near.mapInArrow(_suffix_filter(percent), "a long, b long").distinct(), "near-pairs")

    dealt = settle(_split(near, "a", "b", "salt"), "dealt")
    members = dealt.select(F.col("b").alias("id"), F.col("a").alias("hub"), "salt", F.lit(False).alias("own"))
    hubs = dealt.select(F.col("a").alias("id"), F.col("a").alias("hub"), "salt", F.lit(True).alias("own")).distinct()
    sets = members.union(hubs).join(stored, "id").select("hub", "salt", "own", "id", "set")
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = sets.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.desc("own"))
    return settle(sets.mapInArrow(_compare(percent), "a long, b long").distinct(), "links")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix rows with their component, of tokens with two components."""
    if labels is None:
        return rows.withColumn("comp", F.col("id"))
    rows = rows.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return settle(rows.join(mixed.select("token"), "token", "left_semi"), "mixed-prefixes")


def _cross_pairs(rows: DataFrame, percent: int) -> float:
    """At most how many pairs of rows share a token, but no component, with
    one of the two in its short prefix."""
    short = F.count_if(_indexed(F.col("n"), F.col("pos"), percent)).cast("double")
    by = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"), short.alias("s"))
    by = by.groupBy("token").agg((F.sum("c") * F.sum("s") - F.sum(F.col("c") * F.col("s"))).alias("p"))
    return by.agg(F.sum("p")).first()[0] or 0.0


def _proposals(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each document up to ``LEADERS`` partners outside its component:
    every token's group has as many leaders, the least and greatest by hashes
    that change each turn; a document proposes those it meets most often. So a
    group of near copies gathers around few documents, its links form stars,
    and a document that is far from one leader is near another."""
    seeds = range(turn * LEADERS, turn * LEADERS + LEADERS // 2)
    sides = [(f"{side}{i}", f, F.xxhash64("id", F.lit(i))) for i in seeds for side, f in (("lo", F.min_by), ("hi", F.max_by))]
    row = F.struct(*[F.col(c).alias(f"p_{c}") for c in ("id", "n", "comp")])
    leaders = rows.groupBy("token").agg(*[f(row, h).alias(name) for name, f, h in sides])
    leaders = leaders.select("token", F.array_distinct(F.array(*[name for name, _, _ in sides])).alias("leaders"))
    met = rows.join(settle(leaders, "leaders"), "token").select("id", "n", "comp", F.explode("leaders").alias("l"))
    met = met.select("id", "n", "comp", "l.*")
    near = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
    pairs = met.where((F.col("comp") != F.col("p_comp")) & near).groupBy("id", "p_id").agg(F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "p_id"))
    best = pairs.withColumn("place", place).where(F.col("place") <= LEADERS)
    return best.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()


def _remaining(rows: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs from different components."""
    p, q = (rows.select("token", *[F.col(c).alias(f"{s}{c}") for c in ("id", "n", "pos", "comp")]) for s in ("p_", "q_"))
    both = p.join(q, "token").where(
        (F.col("p_id") < F.col("q_id")) & (F.col("p_comp") != F.col("q_comp")) & _passes("p_", "q_", percent)
    )
    return both.select(F.col("p_id").alias("a"), F.col("q_id").alias("b")).distinct()


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) per row; ``key`` must be an integer."""
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = source.where("id IS NOT NULL")

    sizes = settle(known.mapInArrow(_survey(k), _SURVEY), "survey")
    classes = (
        sizes.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    )
    classes = settle(classes.where("first <> last").drop("last"), "classes")
    rows = sizes.join(classes, ["d1", "d2", "n"], "left").withColumn("first", F.coalesce("first", "id"))
    rows = settle(rows.select("id", "n", "first"), "class-members")
    copies = rows.where("id <> first").select("id").distinct()
    own = rows.where("id = first").select("id")  # an id may have another text that is no copy
    copies = settle(copies.join(own, "id", "left_anti"), "copies")

    linkable = _linkable(only(known, copies, "id", "left_anti"), rows, k, percent)
    stored = settle(only(known, linkable, "id", "left_semi").mapInArrow(_stored(k), "id long, set binary"), "sets")
    summary = settle(only(sizes.select("id", "n", "counts"), linkable, "id", "left_semi"), "linkable-sizes")
    prefixes = _prefixes(stored, percent)
    # an id with several texts is one node: it holds their classes together
    several = rows.groupBy("id").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo <> hi")
    same_id = rows.join(several.select("id"), "id", "left_semi").where("n > 0")
    same_id = settle(same_id.select(F.col("id").alias("a"), F.col("first").alias("b")), "same-id")

    total = prefixes.count()
    labels, before = None, 0.0
    for turn in range(MAX_ROUNDS + 1):
        mixed = _labelled(prefixes, labels)
        left = _cross_pairs(mixed, percent)
        if turn and not left:  # all that could be linked is
            break
        # a round that leaves half has met documents that are not linked: more rounds would not settle them
        last = turn == MAX_ROUNDS or turn > 0 and (left <= PAIRS_PER_ROW * total or left > before / 2)
        before = left
        pairs = _remaining(mixed, percent) if last else _proposals(mixed, turn, percent)
        found = _verified(settle(pairs, "pairs"), stored, summary, percent)
        known_edges = same_id if labels is None else labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
        edges = found.union(known_edges)
        labels = settle(components(edges), "labels")
        if last:
            break

    members = rows.select(F.col("id").alias("doc"), "n", F.col("first").alias("id"))
    members = members.join(labels, "id", "left").select(
        F.col("doc").cast(kind).alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").cast(kind).alias("component_id"),
    )
    unnamed = source.where("id IS NULL").select("text")
    return members.unionByName(
        unnamed.mapInArrow(_count_only(k), "n_shingles long").select(
            F.lit(None).cast(kind).alias(key), "n_shingles", F.lit(None).cast(kind).alias("component_id")
        )
    )


def _count_only(k: int):
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                sizes = [len(s) for s in shingle_sets(data, offsets, k)]
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_shingles"])

    return run
