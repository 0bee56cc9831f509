"""Benchmark decontamination by template windows (DataFrame functions only).

Texts become templates: numbers, units after numbers, and names (capitalised
words inside a sentence) are replaced by typed placeholders; the rest is lower
case without punctuation. Windows of ``width`` template words are hashed and
joined with the windows of the benchmark items. Matches of one item on one
diagonal (the same shift between the two texts) belong together; a document is
contaminated by an item if they cover at least ``min_coverage`` of the item's
windows and the slots inside the matched windows are consistent: every slot
value of the item stands for one value in the document, and different ones for
different ones. So a question with other numbers or names is found, a text that
only looks alike is not.

Windows of fewer than half literal words are not searched as templates. Items
without any other window, and those of one window, are also searched by their
lower-case words as they stand. An item's capitalised first word also matches
the same word where the document's place makes a name of it.

Defined cases: NULL or empty texts match nothing; items of fewer than
``min_words`` words are not searched, those of fewer than ``width`` are
searched as one window of their length; commas before groups of three digits
are no part of a number; documents with a NULL id are not searched; repeated
documents or items give the row once; several items may match one document;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import let, only, settle

# Units of measure that may follow a number.
UNITS = (
    "kg g mg t lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yd yards l ml cl gal gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years dollar dollars usd eur euro euros gbp pound pounds cent cents percent mph kmh degrees c f k w kw "
    "v a hz khz mhz ghz b kb mb gb tb"
).split()
_MARK = "\x01"
#: Windows broadcast where the benchmark has at most so many (24 bytes each).
BROADCAST_WINDOWS = 2_000_000


def cleaned(text: Column) -> Column:
    """Lower-case words parted by single spaces; names carry a mark. Patterns
    look ahead first, which fails at most places after one character."""
    plain = F.translate(F.coalesce(text, F.lit("")), _MARK, " ")
    plain = F.regexp_replace(plain, r",(?=[0-9]{3}(?![0-9]))(?<=(?<![0-9])[0-9]{1,3},|,[0-9]{3},)", "")
    marked = F.regexp_replace(plain, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;] )", _MARK)
    return F.lower(F.btrim(F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{_MARK}]+", " ")))


def template(clean: Column) -> Column:
    """The cleaned text with placeholders; words stay in their places."""
    units = "|".join(UNITS)
    named = F.regexp_replace(clean, rf"{_MARK}[^ ]+", "<name>")
    numbered = F.regexp_replace(named, r"(?=[0-9])(?<![^ ])[0-9]+(?![^ ])", "<num>")
    amounts = F.regexp_replace(numbered, rf"(?=[0-9])(?<![^ ])[0-9]+(?:{units})(?![^ ])", "<amount>")
    measured = F.regexp_replace(amounts, rf"<num> (?:{units})(?![^ ])", "<num> <unit>")
    return F.when(named.rlike("[0-9]"), measured).otherwise(named)


def _windows(words: Column, width: int, *salt: Column) -> Column:
    """Hashes of the windows of ``width`` words, by place. Every word is hashed
    once; two windows side by side make one of double width, and two that
    overlap the rest, so a place costs some four hashes of two numbers."""

    def joined(hashes: Column, by: int) -> Column:
        return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + by))))

    def windows(w: Column) -> Column:
        hashes, size = F.transform(w, lambda x: F.xxhash64(*salt, x)), 1
        while 2 * size <= width:
            hashes, size = joined(hashes, size), 2 * size
        if size < width:
            hashes = joined(hashes, width - size)
        return F.slice(hashes, 1, F.greatest(F.size(w) - width + 1, F.lit(0)))

    return let(words, windows)


def _is_slot(word: Column) -> Column:
    return word.startswith("<")


def _plain_words(clean: str) -> Column:
    return F.split(F.translate(F.col(clean), _MARK, ""), " ")


def _words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``raw`` and ``canon``: words, and their template, in the same places."""
    clean = df.withColumn("clean", cleaned(F.col(text)))
    return clean.select(
        *df.columns, _plain_words("clean").alias("raw"), F.split(template(F.col("clean")), " ").alias("canon")
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    width: int = 8,
    min_words: int = 5,
    min_coverage: float = 0.25,
) -> DataFrame:
    """(key, item_key, n_windows, item_windows, shift, n_slots) per
    contaminated document and item; ``shift`` is the item's first word's place
    in the document, ``n_slots`` the slots compared."""
    items = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL")
    items = _words(items.distinct(), "text").where(F.size("canon") >= min_words)
    items = settle(items.withColumn("width", F.least(F.size("canon"), F.lit(width))), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())

    literal = F.size(F.filter(F.slice("canon", F.col("at") + 1, F.col("width")), lambda w: ~_is_slot(w)))
    as_name = lambda w: _windows(F.concat(F.array(F.lit("<name>")), F.slice("canon", 2, w - 1)), w)[0]
    capital = F.col("text").rlike(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}") & ~_is_slot(F.get("canon", F.lit(0)))
    none = docs.sparkSession.createDataFrame([], f"item {items.schema['item'].dataType.simpleString()}, at int, hash long")

    def windows(of: DataFrame, words: str, sizes: list[int], *salt: Column) -> DataFrame:
        out = none
        for w in sizes:
            part = of.where(F.col("width") == w).select("*", F.posexplode(_windows(F.col(words), w, *salt)).alias("at", "hash"))
            out = out.union(part.where((2 * literal >= w) | F.lit(bool(salt))).select("item", "at", "hash"))
        return out

    first = none
    for w in widths:
        part = items.where(capital & (F.col("width") == w)).select("*", F.lit(0).alias("at"), as_name(w).alias("hash"))
        first = first.union(part.where(2 * literal >= w).select("item", "at", "hash"))
    usable = settle(windows(items, "canon", widths).union(first), "item-windows")
    with_any = usable.select("item").distinct().withColumn("any", F.lit(True))
    as_is = items.join(with_any, "item", "left").where((F.size("canon") <= width) | F.col("any").isNull())
    as_is = settle(as_is.drop("any"), "items-as-they-are")
    word_widths = sorted(r["width"] for r in as_is.select("width").distinct().collect())
    salt = F.lit("words")
    searched = settle(usable.union(windows(as_is, "raw", word_widths, salt)), "searched-windows")
    sizes = searched.groupBy("item").agg(F.countDistinct("at").alias("item_windows"))
    few = searched.count() <= BROADCAST_WINDOWS

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL")
    clean = source.select("key", cleaned(F.col("text")).alias("clean"))
    raw = [_plain_words("clean").alias("raw")] if word_widths else []
    canon = clean.select("key", F.split(template(F.col("clean")), " ").alias("canon"), *raw)
    hashed = canon.select(
        "key",
        *[_windows(F.col("canon"), w).alias(f"w{w}") for w in widths],
        *[_windows(F.col("raw"), w, salt).alias(f"r{w}") for w in word_widths],
    )
    rows = None
    for name in [*(f"w{w}" for w in widths), *(f"r{w}" for w in word_widths)]:
        part = hashed.select("key", F.posexplode(name).alias("place", "hash"))
        rows = part if rows is None else rows.union(part)
    if rows is None:
        rows = canon.select("key", F.lit(0).alias("place"), F.lit(0).cast("long").alias("hash")).where(F.lit(False))
    matches = rows.join(F.broadcast(searched) if few else searched, "hash").select(
        "key", "item", "at", (F.col("place") - F.col("at")).alias("shift")
    )
    # every matched window once, whatever the number of copies of its document
    lines = matches.distinct().groupBy("key", "item", "shift").agg(F.collect_list("at").alias("places"))
    covered = F.size("places") >= min_coverage * F.col("item_windows")
    lines = lines.join(sizes, "item").where(covered)
    lines = settle(lines, "template-matches")

    ids = lines.select("key").distinct()
    suspects = _words(only(source, ids, "key", "left_semi"), "text").select(
        "key", F.col("raw").alias("own"), F.col("canon").alias("own_canon")
    )
    pairs = lines.join(suspects, "key").join(items.select("item", "raw", "canon", "width"), "item")
    # a first word taken for a name must be the item's own
    own_first = _is_slot(F.get("canon", F.lit(0))) | (F.get("raw", F.lit(0)) == F.get("own", F.col("shift")))
    pairs = pairs.withColumn("places", F.filter("places", lambda a: (a > 0) | own_first)).where(covered)
    inside = lambda i: F.exists("places", lambda a: (a <= i) & (i < a + F.col("width")))
    slots = F.filter(
        F.transform(
            F.col("canon"),
            lambda c, i: F.when(
                _is_slot(c) & (F.get("own_canon", i + F.col("shift")) == c) & inside(i),
                F.struct(F.get("raw", i).alias("asked"), F.get("own", i + F.col("shift")).alias("found")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    checked = pairs.select("key", "item", "shift", F.size("places").alias("n_windows"), "item_windows", slots.alias("slots")).withColumn(
        "distinct_slots", F.array_distinct("slots")
    )
    n = F.size("distinct_slots")
    consistent = checked.where(
        (F.size(F.array_distinct("distinct_slots.asked")) == n) & (F.size(F.array_distinct("distinct_slots.found")) == n)
    )
    best = F.max(F.struct("n_windows", (-F.col("shift")).alias("back"), "item_windows", F.size("slots").alias("n_slots")))
    found = consistent.groupBy("key", "item").agg(best.alias("b"))
    return found.select(
        F.col("key").alias(key),
        F.col("item").alias(item_key),
        F.col("b.n_windows").cast("long").alias("n_windows"),
        F.col("b.item_windows").cast("long").alias("item_windows"),
        (-F.col("b.back")).cast("long").alias("shift"),
        F.col("b.n_slots").cast("long").alias("n_slots"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay."""
    hits = settle(contaminated(docs, benchmark, key=key, **options).select(key).distinct(), "contaminated")
    return only(docs, hits, key, "left_anti")
