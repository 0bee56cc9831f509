"""WARC archives: deduplicating writer, and a reader that verifies record
boundaries by chains.

Writer: one record per page through Spark's own text writer (its record
separator is the blank lines that end a WARC record), so tasks commit whole
files to any Hadoop file system. Of pages with equal payloads of at least
``min_revisit_bytes`` bytes that with the largest id is stored as a response,
the others are revisits of it.

Reader: splits are read in parallel, cut at the magic ``WARC/1.1`` line. A cut
is only a candidate, the magic may stand inside a payload: its header's
Content-Length gives the offset where the next record must begin. Candidates
that follow each other are contracted to runs inside each split; pointer
jumping over the runs, from the start of each file, keeps what is reachable.
A record that spans rejected cuts is put together again from its pieces.

Defined cases: NULL payload reads as empty, NULL url as an empty target, line
ends in a url are percent-encoded; NULL id: stored and read back as NULL;
equal rows that share the largest id are all responses; no pages: no files and
no rows; other columns are not read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import settle
from strata.session import scratch_dir

MAGIC = "WARC/1.1\r\n"
#: What a revisit record says it is (fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GAP = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1: four groups of 40 bits, eight digits each."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), _DIGITS32, _BASE32)


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_revisit_bytes: int = 0,
    date: dt.datetime | None = None,
) -> None:
    """Write one record per row of ``pages`` under ``path``, dated ``date``
    (default: now)."""
    written = (date or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(
        F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")
    )
    rows = rows.withColumn("digest", sha1_base32(F.col("payload").cast("binary")))
    copies = (
        rows.select("id", "digest", F.octet_length("payload").alias("size"))
        .where(F.col("size") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    # read back from files: a broadcast when small, else a splittable skew join
    rows = rows.join(settle(copies, "warc-copies"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(GAP),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(F.col("id")),
        F.lit(f"\r\nWARC-Date: {written}"),
        F.when(
            revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), record_id(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))
        ).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit("\r\nWARC-Target-URI: "),
        target,
        F.lit(GAP),
    )
    rows.select(F.concat(head, http, body).alias("value")).write.option("lineSep", GAP).text(path)


def _header(head: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract(head, rf"(?:^|\r\n){name}: {pattern}(?:\r\n|\z)", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> dict[str, Column]:
    """Columns of one candidate record (``value``: all after the magic line)."""
    head = F.substring_index(value, GAP, 1)
    rest = F.substr(value, F.length(head) + 5)
    http = F.substring_index(rest, GAP, 1)
    payload = F.substr(rest, F.length(http) + 5)
    length = _header(head, "Content-Length", "([0-9]{1,18})").cast("long")
    return {
        "kind": _header(head, "WARC-Type", "([a-z]+)"),
        "id": _header(head, "WARC-Record-ID", "<urn:page:(-?[0-9]+)>"),
        "refers": _header(head, "WARC-Refers-To", "<urn:page:(-?[0-9]+)>"),
        "digest": _header(head, "WARC-Payload-Digest", "sha1:([A-Z2-7]+)"),
        "http_length": _header(http, "Content-Length", "([0-9]{1,18})").cast("long"),
        "record_bytes": F.octet_length(head) + length + F.lit(len(MAGIC) + 2 * len(GAP)),
        "payload": F.substr(payload, F.lit(1), F.length(payload) - len(GAP)),
    }


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics: ``(file, block, at, value)``, ``at`` rising
    with the place in the split."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            "value",
        )
    )


def _digested(parsed: dict[str, Column]) -> list[Column]:
    own = F.col("payload")
    return [
        *(F.col(c) for c in parsed if c != "payload"),
        F.octet_length(own).cast("long").alias("payload_bytes"),
        sha1_base32(own.cast("binary")).alias("payload_digest"),
    ]


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its offset in the file; payload figures for those
    whose record ends where the piece ends."""
    pieces = _pieces(spark, path)
    parsed = _parsed(F.col("value"))
    raw = pieces.select(
        "file", "block", "at", (F.octet_length("value") + len(MAGIC)).cast("long").alias("bytes"), *[c.alias(n) for n, c in parsed.items()]
    ).select("file", "block", "at", "bytes", *_digested(parsed))
    found = settle(raw, "warc-pieces")
    in_split = Window.partitionBy("file", "block").orderBy("at")
    found = found.withColumn("index", F.row_number().over(in_split))
    found = found.withColumn("inner", F.sum("bytes").over(in_split) - F.col("bytes"))
    splits = found.groupBy("file", "block").agg(F.sum("bytes").alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block")) - F.col("size")
    starts = splits.select("file", "block", before.alias("before"))
    # the piece before a file's first magic is empty and has no magic of its own
    offset = F.col("before") + F.col("inner") - len(MAGIC)
    placed = found.join(starts, ["file", "block"]).withColumn("offset", offset).where("offset >= 0")
    return settle(placed.drop("before", "inner", "at"), "warc-candidates")


def _reachable_runs(runs: DataFrame) -> DataFrame:
    """Pointer jumping from offset 0: each round doubles the known stretch."""
    jumps = settle(runs.select("file", "start", "next"), "warc-jumps")
    reached = settle(jumps.where("start = 0").select("file", "start"), "warc-reached")
    known = reached.count()
    while True:
        ahead = reached.join(jumps, ["file", "start"]).where("next IS NOT NULL")
        reached = settle(
            reached.union(ahead.select("file", F.col("next").alias("start"))).distinct(), "warc-reached"
        )
        now = reached.count()
        if now == known:
            return reached
        known = now
        onward = jumps.select("file", F.col("start").alias("next"), F.col("next").alias("after"))
        jumps = settle(
            jumps.join(onward, ["file", "next"], "left").select("file", "start", F.col("after").alias("next")),
            "warc-jumps",
        )


def _verified(candidates: DataFrame) -> DataFrame:
    """The candidates that the chain from the start of their file reaches."""
    end = F.col("offset") + F.col("record_bytes")
    in_split = Window.partitionBy("file", "block").orderBy("offset")
    linked = candidates.select("file", "block", "offset", end.alias("end")).withColumn(
        "follows", F.lag("end").over(in_split)
    )
    # offsets where something other than the piece before ends
    landings = linked.select(
        "file", F.col("end").alias("offset"), F.lead("offset").over(in_split).alias("near")
    ).where("offset IS NOT NULL AND NOT offset <=> near")
    landings = landings.select("file", "offset").distinct().withColumn("landed", F.lit(True))
    linked = linked.join(landings, ["file", "offset"], "left")
    opens = F.col("landed").isNotNull() | F.col("follows").isNull() | (F.col("follows") != F.col("offset"))
    linked = linked.withColumn("start", F.last(F.when(opens, F.col("offset")), ignorenulls=True).over(in_split))
    linked = settle(linked.select("file", "block", "offset", "end", "start"), "warc-links")
    runs = linked.groupBy("file", "start").agg(F.max_by("end", "offset").alias("next"))
    reached = _reachable_runs(runs)
    kept = linked.join(reached, ["file", "start"], "left_semi").select("file", "offset")
    return candidates.join(kept, ["file", "offset"])


def _stitched(spark: SparkSession, path: str, spanning: DataFrame, candidates: DataFrame) -> DataFrame:
    """Records that span rejected cuts, from all their pieces in file order."""
    spans = spanning.select("file", "offset", F.struct("offset", (F.col("offset") + F.col("record_bytes")).alias("end")).alias("own"))
    places = candidates.select("file", "block", "index", "offset").join(spans.select("file").distinct(), "file", "left_semi")
    # the last spanning record that begins at or before a piece
    so_far = Window.partitionBy("file").orderBy("offset")
    inner = places.join(spans, ["file", "offset"], "left").withColumn("own", F.last("own", ignorenulls=True).over(so_far))
    inner = inner.where(F.col("offset") < F.col("own.end"))
    wanted = settle(inner.select("file", "block", "index", "offset", F.col("own.offset").alias("owner")), "warc-spans")
    pieces = _pieces(spark, path).join(wanted.select("file").distinct(), "file", "left_semi")
    index = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    pieces = pieces.withColumn("index", index).join(wanted, ["file", "block", "index"])
    whole = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    parsed = _parsed(F.array_join(F.col("parts.value"), MAGIC))
    return whole.select(*[c.alias(n) for n, c in parsed.items()]).select(*_digested(parsed))


def read_archives(spark: SparkSession, path: str, key: str = "page_id", kind: str = "bigint") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) per record;
    a revisit's figures are those of the full payload it stands for."""
    candidates = _candidates(spark, path)
    verified = settle(_verified(candidates), "warc-verified")
    alone = F.col("record_bytes") == F.col("bytes")
    columns = [c for c in _parsed(F.lit("")) if c != "payload"] + ["payload_bytes", "payload_digest"]
    records = verified.where(alone).select(*columns)
    spanning = verified.where(~alone & F.col("record_bytes").isNotNull())
    if not spanning.isEmpty():
        records = records.union(_stitched(spark, path, spanning, candidates).select(*columns))
    revisit = F.col("kind") == "revisit"
    return records.select(
        F.col("id").cast(kind).alias(key),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
    )


def round_trip(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(pages, path, key=key, **options)
    return read_archives(spark, path, key, pages.schema[key].dataType.simpleString())
