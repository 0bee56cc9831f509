"""Licence recognition by sentence rules (DataFrame functions only).

Texts are cut into sentences, each normalised sentence is looked up among the
known licence sentences, and the identifiers found, in text order, are matched
against ordered rules. A text is read twice: line by line, where a line end ends a
sentence, for notices without a stop; and by paragraphs, where a sentence goes on
over line ends, as in wrapped licence texts and source headers (comment marks are
no words). A sentence that both readings find stands at the same word and counts
once. A rule is a sequence of identifiers that must follow
each other (other sentences may stand between); an earlier rule uses up what
it matches, so a full licence text is not also reported as its parts.

Defined cases: NULL and empty texts have no sentence; a document without a
known sentence has no row; a document whose sentences fit no rule has an empty
``licenses``; every row of a repeated document has its own row; other columns
are not read. Each licence is listed once per document, in rule order. Rules of
``ONLY_ALONE`` hold where no other does: "All rights reserved." stands in the
copyright line of open licences too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import let, running

# Sentences of public licences and licence notices.
SENTENCES: dict[str, str] = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-long": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "Released under CC0 1.0.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission.",
    "rights-reserved": "All rights reserved.",
}

#: Licence and the identifiers that must follow each other; earlier rules win.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("apache-2.0", ("apache-notice-long", "apache-use", "apache-copy")),
    ("gpl-3.0", ("gpl-free", "gpl-warranty")),
    ("bsd-3-clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-2-clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("mit", ("mit-title", "mit-notice-kept")),
    ("apache-2.0", ("apache-notice",)),
    ("apache-2.0", ("apache-notice-long",)),
    ("mit", ("mit-notice",)),
    ("mit", ("mit-licensed",)),
    ("mit", ("mit-notice-kept",)),
    ("gpl-3.0", ("gpl3-work",)),
    ("gpl-3.0", ("gpl-free",)),
    ("cc-by-nc-4.0", ("cc-by-nc-notice",)),
    ("cc-by-sa-4.0", ("cc-by-sa-notice",)),
    ("cc-by-4.0", ("cc-by-notice",)),
    ("cc0-1.0", ("cc0-notice",)),
    ("proprietary", ("rights-reserved",)),
)

#: Licences that are named only if the document names no other.
ONLY_ALONE = ("proprietary",)

# Everything but letters, digits, stops and line ends reads as one space.
_NOISE = r"[^a-z0-9.!?;\n]+"
_STOP = r"[.!?;:]+( |\n|\z)"


#: A single line end, and the blank lines between paragraphs.
_WRAP = r"(?<!\n)\n(?!\n)"


def _plain(text: Column) -> Column:
    """Lower-case words, stops and line ends, without spaces around line ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), _NOISE, " "), " ?\n ?", "\n")


def sentences(plain: Column) -> Column:
    """Normalised sentences of ``_plain`` text, in order (empty ones included)."""
    return F.transform(F.split(F.regexp_replace(plain, _STOP, "\n"), "\n"), lambda x: F.trim(x))


def _placed(plain: Column, known: Column) -> Column:
    """(place, sentence) of all sentences, place counting the words before;
    none where no sentence is known."""
    none = F.array().cast("array<struct<place:int,sentence:string>>")

    def with_places(all_: Column) -> Column:
        words = F.transform(all_, lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1))
        before = running(words, F.lit(0), lambda n, w: n + w)
        return let(before, lambda n: F.transform(all_, lambda x, i: F.struct(F.get(n, i).alias("place"), x.alias("sentence"))))

    return let(sentences(plain), lambda x: F.when(F.arrays_overlap(x, known), with_places(x)).otherwise(none))


def _normalise(sentence: str) -> str:
    """``sentences`` for one known sentence, on the driver."""
    import re

    plain = re.sub(_NOISE, " ", sentence.lower())
    return re.sub(r"[.!?;:]+( |\n|$)", "\n", plain).strip(" \n")


def recognise(
    docs: DataFrame,
    known: Mapping[str, str] = SENTENCES,
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """(key, licenses, sentence_ids, n_sentences) for documents with a known
    sentence; lists are comma-joined. The join to the known sentences is a
    broadcast of that fixed list."""
    spark = docs.sparkSession
    table = spark.createDataFrame(
        sorted({(_normalise(s), i) for i, s in known.items()}), "sentence string, sentence_id string"
    )
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    listed = F.array(*[F.lit(x) for x in sorted({_normalise(s) for s in known.values()})]).cast("array<string>")
    both = let(
        _plain(F.col("text")),
        lambda p: F.array_union(_placed(p, listed), _placed(F.regexp_replace(p, _WRAP, " "), listed)),
    )
    found = (
        rows.select("key", "row", F.explode(both).alias("s"))
        .select("key", "row", "s.*")
        .join(F.broadcast(table), "sentence")
        .groupBy("key", "row")
        .agg(F.sort_array(F.collect_list(F.struct("place", "sentence_id"))).alias("found"))
    )
    ids = F.col("found.sentence_id")
    left = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    hits: dict[str, Column] = {}
    for name, sequence in rules:
        part = "".join(f",{x}," for x in sequence)
        hits[name] = hits.get(name, F.lit(False)) | left.contains(part)
        left = F.replace(left, F.lit(part), F.lit(""))
    other = F.lit(False)
    for name, hit in hits.items():
        other |= hit if name not in ONLY_ALONE else F.lit(False)
    names = F.array(*[F.when(hit & ~other if name in ONLY_ALONE else hit, F.lit(name)) for name, hit in hits.items()])
    return found.select(
        F.col("key").alias(key),
        F.array_join(F.array_compact(names), ",").alias("licenses"),
        F.array_join(ids, ",").alias("sentence_ids"),
        F.size("found").cast("long").alias("n_sentences"),
    )
