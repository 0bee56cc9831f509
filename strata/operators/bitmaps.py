"""Exact distinct counts that can be merged (A3).

A count of distinct entities cannot be added up: neither over further keys (a
table by département from one by commune) nor over deliveries. Sets of entities
can. Each entity gets an integer number; a partial holds, per key and word of 64
numbers, a bit map of the entities that meet each condition. Partials are OR-ed and
their bits counted; several tables then come from one stored pre-aggregate.

Numbers follow the order of ``near`` (such as year and area), so the entities of a
key lie in few blocks of 32,768 numbers and in neighbouring words. Bit maps are as
wide as a long: a key with one entity costs a word, not the 4 kB of a block, and
the aggregates have small states of fixed size however many keys there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.sources.sinks import materialize

NUMBER, BLOCK, WORD = "number__", "block__", "word__"
WORD_BITS = 64
#: The bit map of all entities.
EVERY = "every__"


def number_entities(df: DataFrame, entity: str, near: Sequence[str]) -> DataFrame:
    """(entity, number) of every entity but NULL, stored: numbers are unique,
    not gapless, and follow the order of (``near``, entity)."""
    first = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(F.struct(*near)).alias("near__"))
    ranged = first.repartitionByRange("near__", entity).sortWithinPartitions("near__", entity)
    # a number is made once, when it is stored
    return materialize(ranged.select(entity, F.monotonically_increasing_id().alias(NUMBER)), "entity-numbers")


def bitmap_partials(
    df: DataFrame, keys: Sequence[str], entity: str, numbers: DataFrame, conditions: Mapping[str, Column]
) -> DataFrame:
    """(keys, block, word, bit maps): per key and word the entities with a row, and
    with a row where each condition is TRUE, as the 64 bits of a long. Rows are reduced
    to one per key and entity before they meet the numbers, and once more by task
    before bit maps are made. Rows without an entity have no word and no bits."""
    keys, names = list(keys), list(conditions)
    reduced = df.groupBy(*keys, entity).agg(*[F.bool_or(conditions[n]).alias(n) for n in names])
    placed = reduced.join(numbers, entity, "left")
    position = F.bitmap_bit_position(NUMBER)
    word = F.floor(position / WORD_BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(WORD_BITS)).cast("int"))
    bits = placed.select(
        *keys,
        F.bitmap_bucket_number(NUMBER).alias(BLOCK),
        word.alias(WORD),
        bit.alias(EVERY),
        *[F.when(F.col(n), bit).alias(n) for n in names],
    )
    none = F.lit(0).cast("bigint")
    return bits.groupBy(*keys, BLOCK, WORD).agg(*[F.coalesce(F.bit_or(m), none).alias(m) for m in (EVERY, *names)])


def merged_counts(partials: DataFrame, keys: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Distinct entities by ``keys``, some of the partials' keys or all: bit map
    ``m`` is counted as ``names[m]``. Partials of several deliveries or parts, made
    with the same numbers, may be united first."""
    words = partials.groupBy(*keys, BLOCK, WORD).agg(*[F.bit_or(m).alias(m) for m in names])
    return words.groupBy(*keys).agg(*[F.sum(F.bit_count(m).cast("bigint")).alias(name) for m, name in names.items()])
