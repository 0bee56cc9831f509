"""Order MinHash fingerprints of texts (DataFrame functions only).

A text's k-mers of words are numbered by occurrence, so a repeated k-mer counts
as often as it occurs, and hashed once. The hash deals them to ``BINS`` bins;
each bin keeps its two smallest (k-mer, occurrence) hashes and hashes the pair
in the order in which the two stand in the text. Two texts agree in a bin only
if they share both minima *and* their order, so likeness falls with edit
distance, not just with the sets of k-mers.

Likeness is the share of agreeing bins among those filled in either text (one
permutation dealt to bins, as in one-permutation MinHash).

Defined cases: NULL text is empty; texts of fewer than ``k`` words are one
k-mer (the empty text too); equal word sequences have equal fingerprints.
Texts may have up to 2^24 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import let

_SPACES = " \t\n\r\x0b\x0c"
_POSITION = 24  # bits of a position in the text
_BIN_AT = 57  # a packed entry is bin (6 bits), hash (33 bits), position (24 bits)
_PAIR = 26  # bits of a pair's hash in a fingerprint entry, below the bin


def _before(a: Column, j: Column, by: int, shift: int) -> Column:
    return F.shiftright(F.get(a, j - by), shift)


def _run_start(a: Column, j: Column, value: Column) -> Column:
    """Index of the first element of sorted ``a`` with ``value``, below ``j``:
    a binary search in as many steps as the logarithm of ``j``."""
    state = F.struct(F.lit(0).alias("lo"), j.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.shiftright(F.get(a, mid), _POSITION) < value
        return F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")
        )

    steps = F.sequence(F.lit(1), F.length(F.bin(j)) + 1)
    return F.aggregate(steps, state, halve, lambda s: s["lo"])


def _occurrence(a: Column, x: Column, j: Column) -> Column:
    value = F.shiftright(x, _POSITION)
    return (
        F.when((j == 0) | (_before(a, j, 1, _POSITION) != value), 0)
        .when((j == 1) | (_before(a, j, 2, _POSITION) != value), 1)
        .otherwise(j - _run_start(a, j, value))
    )


def _hash(x: Column) -> Column:
    return F.shiftright(x, _POSITION).bitwiseAND(F.lit((1 << 33) - 1))


def _pairs(c: Column) -> Column:
    """Of entries by bin and hash, at most two a bin: one hash a bin."""

    def pair(x: Column, j: Column) -> Column:
        y = F.get(c, j + 1)
        at = F.lit((1 << _POSITION) - 1)
        in_order = x.bitwiseAND(at) < y.bitwiseAND(at)
        both = F.when(in_order, F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))
        has_two = F.shiftright(y, _BIN_AT) == F.shiftright(x, _BIN_AT)
        mixed = F.when(has_two, both).otherwise(F.xxhash64(_hash(x)))
        entry = F.shiftleft(F.shiftright(x, _BIN_AT), _PAIR).bitwiseOR(mixed.bitwiseAND(F.lit((1 << _PAIR) - 1)))
        opens = (j == 0) | (_before(c, j, 1, _BIN_AT) != F.shiftright(x, _BIN_AT))
        return F.when(opens, entry)

    return F.array_compact(F.transform(c, pair))


def signature(text: Column, k: int = 3, bins: int = 64) -> Column:
    """The fingerprint's entries: (bin, pair hash) packed, bins ascending."""
    if not 1 <= bins <= 64 or bins & (bins - 1):
        raise ValueError("bins must be a power of two up to 64")

    def of_words(w: Column) -> Column:
        last = F.greatest(F.size(w) - k, F.lit(0))
        kmers = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.shiftleft(F.xxhash64(*[F.get(w, i + d) for d in range(k)]), _POSITION).bitwiseOR(i),
        )
        return let(F.sort_array(kmers), of_sorted)

    def of_sorted(a: Column) -> Column:
        def entry(x: Column, j: Column) -> Column:
            numbered = F.xxhash64(F.shiftright(x, _POSITION), _occurrence(a, x, j))
            return let(numbered, lambda g: (
                F.shiftleft(g.bitwiseAND(F.lit(bins - 1)), _BIN_AT)
                .bitwiseOR(F.shiftleft(F.shiftrightunsigned(g, 31), _POSITION))
                .bitwiseOR(x.bitwiseAND(F.lit((1 << _POSITION) - 1)))
            ))

        return let(F.sort_array(F.transform(a, entry)), of_dealt)

    def of_dealt(b: Column) -> Column:
        smallest = F.filter(b, lambda x, j: (j < 2) | (_before(b, j, 2, _BIN_AT) != F.shiftright(x, _BIN_AT)))
        return let(smallest, _pairs)

    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return let(F.split(plain, r"[ \t\n\r\x0B\f]+"), of_words)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    filled = F.array_union(
        F.transform(a, lambda x: F.shiftright(x, _PAIR)), F.transform(b, lambda x: F.shiftright(x, _PAIR))
    )
    return F.size(F.array_intersect(a, b)) / F.size(filled)


def with_next(rows: DataFrame, key: str, carried: list[str], buckets: int) -> DataFrame:
    """Each row beside the next one by descending ``key`` (after the last: the
    first), as ``next_<column>`` for the ``carried`` columns.

    Keys are cut into ranges of about equal size; each range also gets the
    largest row of the range below it (the lowest one the largest of all), so
    one shuffle brings all neighbours together and no range needs another.
    Equal keys follow by their carried columns; NULL keys come last."""
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = rows.withColumn("place__", place)
    marks = [i / buckets for i in range(1, buckets)]
    keys = rows.select("place__")
    bounds = keys.agg(F.percentile_approx("place__", marks, 10000).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("place__"))) if bounds else F.lit(0)
    tops = {
        r["bucket__"]: r["top"]
        for r in keys.select(bucket.alias("bucket__"), "place__").groupBy("bucket__").agg(F.max("place__").alias("top")).collect()
    }
    if not tops:
        return rows.select(*[c for c in rows.columns if c != "place__"], *[F.col(c).alias(f"next_{c}") for c in carried])
    filled = sorted(tops)
    above = dict(zip(filled, filled[1:] + filled[:1], strict=True))
    size = len(bounds) + 1
    top_of = F.array(*[F.lit(tops.get(i)).cast("long") for i in range(size)])
    lend_to = F.array(*[F.lit(above.get(i)).cast("int") for i in range(size)])
    rows = rows.withColumn("bucket__", bucket)
    lent = F.when(F.col("place__") == F.get(top_of, F.col("bucket__")), F.get(lend_to, F.col("bucket__")))
    copies = F.array(
        F.struct(F.col("bucket__").alias("bucket"), F.lit(1).alias("own")),
        F.struct(lent.alias("bucket"), F.lit(0).alias("own")),
    )
    placed = rows.withColumn("to__", F.explode(copies)).where("to__.bucket IS NOT NULL")
    upward = Window.partitionBy("to__.bucket").orderBy("to__.own", "place__", *carried)
    beside = placed.select("*", *[F.lag(c).over(upward).alias(f"next_{c}") for c in carried]).where("to__.own = 1")
    return beside.drop("place__", "bucket__", "to__")


def fingerprint_with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3, bins: int = 64) -> DataFrame:
    """Every text beside its edited text, whose last half is replaced by the
    start of the next document's: (key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next). Repeated rows are each other's
    next; a single document is its own; no documents give no rows."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("entries", signature(F.col("text"), k, bins))
    beside = with_next(rows, "key", ["text", "entries"], buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    figures = let(
        edited,
        lambda e: let(
            signature(e, k, bins),
            lambda s: F.struct(
                F.sha2(e.cast("binary"), 256).alias("edited_sha256"),
                as_text(F.col("entries")).alias("fingerprint"),
                as_text(s).alias("edited_fingerprint"),
                likeness(F.col("entries"), s).alias("near_edited"),
                likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
            ),
        ),
    )
    return beside.select(F.col("key").alias(key), n.cast("long").alias("n_chars"), figures.alias("f")).select(
        key, "n_chars", "f.edited_sha256", "f.fingerprint", "f.edited_fingerprint", "f.near_edited", "f.near_next"
    )
