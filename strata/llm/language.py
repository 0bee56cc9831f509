"""Language identification with a bit-sliced n-gram Bloom filter.

One array of cells serves all languages: a cell holds a bit mask with one bit
per language, in as many words of 64 bits as the languages need. An n-gram of a language sets that language's bit in ``hashes``
cells; AND-ing the cells of an n-gram gives the mask of all languages that may
contain it. A document's score for a language is its share of n-grams whose
mask has the bit, corrected by the filter's own false-positive rate for that
language; the largest corrected share decides (ties: alphabetical order).

N-grams are four consecutive bytes of the lower-cased text in which every run
of non-letters reads as one space. A language keeps the n-grams that make up
at least ``min_share`` of its training documents, which count alike whatever
their length, so at most ``1 / min_share`` n-grams a language reach the driver.

Defined cases: NULL text or a text without a letter is ``und`` with score 0; a
text whose n-grams no language knows gets the language with most training
documents and score 0; without any training row every prediction is ``und``;
rows with a NULL language never train; repeated rows count as often
as they occur; a NULL id is not held out; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import text_chunks
from strata.llm.hashing import mix

UNKNOWN = "und"
NGRAM = 4
WORD_BITS = 64
#: All n-grams of a document together.
WHOLE = 1 << 30
#: N-grams whose cells are looked up at once.
LOOKED_UP = 1 << 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[0x80:] = True


@dataclass(frozen=True)
class LanguageFilters:
    """``cells``: the mask of each cell, (words, cells); ``rates``: false-positive rate by
    language; ``default``: the language with most training documents."""

    languages: tuple[str, ...]
    cells: np.ndarray
    hashes: int
    rates: np.ndarray
    default: str


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all rows and the index of each row's first n-gram.

    Letters keep their byte, a run of other bytes is one space, and every row
    stands between spaces."""
    letter = _LETTER[data]
    n_rows = len(offsets) - 1
    row_lengths = np.diff(offsets)
    # one more byte per row: the space that ends it
    shift = np.repeat(np.arange(n_rows), row_lengths)
    at = np.arange(len(data)) + shift
    spaced = np.full(len(data) + n_rows + 1, 32, dtype=np.uint8)
    spaced[at[letter] + 1] = data[letter]
    keep = np.ones(len(spaced), dtype=bool)
    keep[1:] = (spaced[1:] != 32) | (spaced[:-1] != 32)
    # a row's first space is the separator before it, kept even after a space
    row_starts = offsets[:-1] + np.arange(n_rows)
    keep[row_starts] = True
    position = np.concatenate(([0], np.cumsum(keep)))
    clean = spaced[keep].astype(np.uint32)
    m = max(0, len(clean) - NGRAM + 1)
    packed = np.zeros(m, dtype=np.uint32)
    for j in range(NGRAM):
        packed |= clean[j : j + m] << np.uint32(8 * (NGRAM - 1 - j))
    first = position[row_starts]
    last = np.append(first[1:], len(clean) - 1)
    # rows shorter than an n-gram have none
    return packed, np.minimum(np.stack([first, np.maximum(first, last - NGRAM + 2)]), m)


def _cells(keys: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    h = mix(keys.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(hashes)]


def _masks(keys: np.ndarray, cells: np.ndarray, hashes: int) -> np.ndarray:
    """Of each n-gram the languages that may contain it, by one word of the cells."""
    masks = np.empty(len(keys), dtype=np.uint64)
    for a in range(0, len(keys), LOOKED_UP):
        at = _cells(keys[a : a + LOOKED_UP], hashes, len(cells))
        masks[a : a + LOOKED_UP] = np.bitwise_and.reduce([cells[x] for x in at])
    return masks


def _gram_counts(batches):
    for batch in batches:
        languages = np.array(batch.column(1).to_pylist(), dtype=object)
        counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for a, b, data, offsets in text_chunks(batch.column(0)):
            packed, bounds = grams(data, offsets)
            for name in set(languages[a:b]):
                rows = np.flatnonzero(languages[a:b] == name)
                for r in rows:
                    keys, times = np.unique(packed[bounds[0, r] : bounds[1, r]], return_counts=True)
                    counts.setdefault(name, []).append((keys, times * WHOLE // max(1, times.sum())))
        for name, parts in counts.items():
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([c for _, c in parts]), minlength=len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(total.astype(np.int64))],
                names=["lang", "gram", "n"],
            )


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    sample_docs: int = 6000,
    min_share: float = 5e-5,
    cells: int = 1 << 20,
    hashes: int = 3,
) -> LanguageFilters:
    """Learn the filters from ``docs``: of each language about ``sample_docs``
    documents (all where it has fewer), chosen by a hash of ``key``."""
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    known = docs.select(
        F.lower(F.col(text)).alias("text"), F.col(lang).alias("lang"), F.col(key).cast("string").alias("key")
    ).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    masks = np.zeros((max(1, -(-len(languages) // WORD_BITS)), cells), dtype=np.uint64)
    if not languages:
        return LanguageFilters((), masks, hashes, np.zeros(0), UNKNOWN)
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_docs / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("key")), F.lit(1_000_000)) / 1_000_000
    sample = known.where(draw < shares[F.col("lang")]).select("text", "lang")
    counted = (
        sample.mapInArrow(_gram_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counted = counted.persist()
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for k in languages for x in (k, min_share * totals.get(k, 0))])
    kept = counted.where(F.col("n") >= least[F.col("lang")]).collect()
    counted.unpersist()
    grams_of: dict[str, list[int]] = {name: [] for name in languages}
    for r in kept:
        grams_of[r["lang"]].append(r["gram"])
    fill = np.zeros(len(languages))
    for i, name in enumerate(languages):
        word, bit = masks[i // WORD_BITS], np.uint64(1 << i % WORD_BITS)
        for at in _cells(np.array(grams_of[name], dtype=np.uint64), hashes, cells):
            np.bitwise_or.at(word, at, bit)
        fill[i] = np.mean(word & bit != 0)
    default = max(languages, key=lambda k: (sizes[k], k))
    return LanguageFilters(languages, masks, hashes, fill**hashes, default)


def _has_letter(text: str) -> Column:
    """Whether a text has a letter of any script."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def score_batch(
    filters: LanguageFilters, column: pa.Array, with_letter: np.ndarray
) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each lower-cased text."""
    names, scores = [], []
    n_languages = len(filters.languages)
    for a, b, data, offsets in text_chunks(column):
        packed, (first, last) = grams(data, offsets)
        has_letter = with_letter[a:b]
        total = np.maximum(1, last - first)
        share = np.zeros((n_languages, len(first)))
        for i in range(n_languages):
            if i % WORD_BITS == 0:  # the next word of the masks
                mask = _masks(packed, filters.cells[i // WORD_BITS], filters.hashes)
            seen = np.concatenate(([0], np.cumsum(mask >> np.uint64(i % WORD_BITS) & np.uint64(1), dtype=np.int64)))
            share[i] = (seen[last] - seen[first]) / total
            share[i] = np.clip((share[i] - filters.rates[i]) / max(1e-9, 1 - filters.rates[i]), 0, 1)
        if n_languages:
            best, top = share.argmax(axis=0), share.max(axis=0)
        else:
            best, top = np.zeros(len(first), int), np.zeros(len(first))
        for b, s, ok in zip(best.tolist(), top.tolist(), has_letter.tolist(), strict=True):
            ok = ok and n_languages
            names.append(UNKNOWN if not ok else filters.languages[b] if s > 0 else filters.default)
            scores.append(s if ok else 0.0)
    return names, np.array(scores)


def predict(docs: DataFrame, filters: LanguageFilters, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row of ``docs``; only ``text`` is used."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # words x cells x 8 bytes

    def run(batches):
        for batch in batches:
            names, scores = score_batch(shared.value, batch.column(1), _flags(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["key", "lang_pred", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"), _has_letter(text)).mapInArrow(
        run, f"key {kind}, lang_pred string, score double"
    )
    return out.withColumnRenamed("key", key)


def keep(docs: DataFrame, filters: LanguageFilters, min_score: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a known language with at least
    ``min_score``; all columns stay as they are. Without any learned language
    nothing can be rejected but texts without a letter."""
    lettered = docs.where(_has_letter(text))
    if not filters.languages:
        return lettered
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    # the texts alone go to Python, and one number each comes back
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(score_batch(shared.value, pc.utf8_lower(column), np.ones(len(column), dtype=bool))[1])

    return lettered.where(score(text) >= min_score)
