"""Personal data: candidate generation, boosted trees, calibrated thresholds
(DataFrame functions only).

Base spans follow fixed patterns and checks and always stand. Generators of
high recall propose further spans (obfuscated addresses, numbers in other
groupings), which may overlap. Boosted trees score them on format and context
features; a threshold per kind, calibrated on held-out base candidates, selects
them; of overlapping ones the first by place, then the longest, stays, and none
may overlap a base span. Added spans have kinds of their own (``email_like``
and so on), so the base kinds' figures are the base spans' figures.

The trees learn from the candidates of both the base patterns and the generators
in all documents. There are no true labels; a candidate counts as personal if it passes
the check that fits its format (Luhn for 15 and 16 digits, parts up to 255, area
codes, brackets or spelled dots before a known domain ending) and is not
introduced as a code. A few example phrases of every kind, ``EXAMPLES``, take part, so
that the outcome does not hang on chance where a corpus holds few candidates.
Equal rows are counted before they reach the driver, which sees at most one row
per combination of small features.

Everything is linear in the length of a text: places are running sums (``common.running``
builds them block by block), the context of a span is taken from the pieces that
the pattern leaves beside it, overlaps are settled in one sweep by place, and
redacted texts are put together from blocks.

Defined cases: NULL text is empty and has no span; spans count code points, end
exclusive; repeated rows are judged each; without any document to learn from no
span is added; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import boosting
from strata.llm.common import let, running

# The base patterns, in Java's possessive form (they match the
# same spans without backtracking into runs), by kind in order.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no candidate of the kind.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Generators of further spans; the kind they resemble is what they are scored as.
EXTRA = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}(?: ?[\[(](?:at|AT)[\])] ?| (?:at|AT) )[A-Za-z0-9-]{2,63}"
    r"(?:(?: ?[\[(](?:dot|DOT)[\])] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?[\[(]dot[\])] ?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[._/]){3}[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
_EXTRA_NEEDS = {
    "email": r"(?i)[\[( ]at[\]) ].*[\[( .](?:dot|[a-z])",
    "ip": r"[0-9] ?[\[(]",
    "card": r"[0-9]{4}[._/][0-9]{4}|3[47][0-9]{2}",
    "phone": r"[0-9]{3}[ .-][0-9]{4}",
}
KINDS = tuple(BASE)
#: Words that tell of personal data, and of codes, right before a span.
_PERSONAL = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|pay|account|ip|address|host|from|to|reach|write)[^\p{L}]{0,4}$"
_CODE = r"(?i)(?:token|key|secret|hash|sha|id|isbn|version|ref|order|no)[^\p{L}]{0,4}$"
_CONTEXT = 24
#: Domain endings that a spelled address may have (fixed values).
ENDINGS = "com org net edu gov info biz io co de fr es it nl uk ch at be pl pt eu us ca au in jp"
_KNOWN_ENDING = r"(?i)(?:\.|dot[\])]? ?)(?:" + ENDINGS.replace(" ", "|") + ")$"
#: generator, digits, length, separators, groups, character before, after, context, check, spelling
FEATURES = 11
#: Example phrases with one candidate of the generators each, and whether it is personal.
EXAMPLES = (
    ("email", "mail ann (at) example (dot) com", 1),
    ("email", "contact jo [at] firma [dot] de", 1),
    ("email", "write to b.smith(at)mail-host.org today", 1),
    ("email", "reach me: kim at example dot net", 1),
    ("email", "jo (at) firma (dot) org", 1),
    ("email", "please look at example.com", 0),
    ("email", "we met at noon.then left", 0),
    ("email", "arrive at five.thirty or later", 0),
    ("email", "shop at market.com for less", 0),
    ("email", "aim at dot matrix", 0),
    ("ip", "host 10[.]0[.]0[.]1 answered", 1),
    ("ip", "from 192(.)168(.)1(.)20", 1),
    ("ip", "version 310[.]5[.]0[.]999", 0),
    ("ip", "12[.]900[.]3[.]4", 0),
    ("card", "card 3782-822463-10005", 1),
    ("card", "paid with 371449635398431", 1),
    ("card", "visa 4111.1111.1111.1111", 1),
    ("card", "number 3782-822463-10006 here", 0),
    ("card", "order 371449635398431", 0),
    ("card", "serial 370000000000003", 0),
    ("card", "4111/1111/1111/1112", 0),
    ("phone", "call (415) 555-2671", 1),
    ("phone", "tel 212-555-0188 after six", 1),
    ("phone", "(555) 123-4567", 1),
    ("phone", "order 415-555-2671", 0),
    ("phone", "012-155-2671 units", 0),
    ("phone", "ref 111-022-2671", 0),
)
#: How often an example counts.
EXAMPLE_WEIGHT = 20
_TEXT_BLOCK = 1024
_FOUND = "array<struct<start:int,end:int,value:string,left:string,after:string>>"


def _spans(text: Column, pattern: str, needs: str) -> Column:
    """(start, end, value, left, after) of the pattern's matches, in order, with
    the characters beside them. The parts that a split leaves and the matches
    alternate, which gives the places."""

    def placed(found: Column) -> Column:
        parts, values = found["parts"], found["values"]
        lengths = F.transform(values, lambda v, i: F.length(F.get(parts, i)) + F.length(v))

        def located(both: Column) -> Column:
            def span(v: Column, i: Column) -> Column:
                part = F.get(parts, i)
                start = F.get(both["before"], i) + F.length(part)
                return F.struct(
                    start.alias("start"),
                    (start + F.length(v)).alias("end"),
                    v.alias("value"),
                    F.right(part, F.lit(_CONTEXT)).alias("left"),
                    F.left(F.get(parts, i + 1), F.lit(1)).alias("after"),
                )

            return F.transform(values, span)

        before = let(lengths, lambda n: F.struct(running(n, F.lit(0), lambda s, x: s + x).alias("before")))
        return let(before, located)

    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("parts")
    )
    return F.when(text.rlike(needs), let(found, placed)).otherwise(F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weighed(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    parts = F.transform(F.split(F.reverse(digits), ""), weighed)
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: let(
            F.regexp_replace(p, "^0+(?=.)", ""), lambda n: (F.length(n) <= 3) & (F.lpad(n, 3, "0") <= "255")
        )
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    return F.length(_digits(value)).between(8, 15)


def _bucket(n: Column, cuts: tuple[int, ...]) -> Column:
    out = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        out = F.when(n <= cut, i).otherwise(out)
    return out


def _format_holds(kind: str, value: Column) -> Column:
    """The check that fits a generator's candidate."""
    if kind == "email":
        spelled = value.rlike(r"(?i)[\[(]at[\])]") | value.rlike(r"(?i) at .*\bdot\b")
        return spelled & value.rlike(_KNOWN_ENDING)
    if kind == "ip":
        return _passes("ip", F.regexp_replace(value, r"(?i)[^0-9]+", "."))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).isin(15, 16), luhn(d)).otherwise(False))
    return let(_digits(value), lambda d: d.rlike("^[2-9][0-9]{2}[1-9][0-9]{6}$"))


def _features(kind: str, span: Column, extra: bool) -> Column:
    """Small integers about format (digits, length, separators, groups, check,
    spelling) and context (the characters around, words right before)."""
    value, left = span["value"], span["left"]
    char = lambda c: (
        F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3)
        .when(c.rlike("[\"'=]"), 4).otherwise(5)
    )
    separators = F.length(F.regexp_replace(value, "[A-Za-z0-9]", ""))
    groups = F.size(F.split(value, "[^A-Za-z0-9]+"))
    spelling = F.when(value.rlike(r"[\[(]"), 2).when(value.rlike("(?i) dot "), 1).otherwise(0)
    return F.array(
        F.lit(2 * KINDS.index(kind) + int(extra)),
        _bucket(F.length(_digits(value)), (3, 6, 7, 9, 11, 12, 14, 15, 16, 19)),
        _bucket(F.length(value), (5, 8, 11, 14, 16, 19, 23, 30)),
        F.least(separators, F.lit(8)),
        F.least(groups, F.lit(8)),
        char(F.right(left, F.lit(1))),
        char(span["after"]),
        F.when(left.rlike(_PERSONAL), 1).when(left.rlike(_CODE), 2).otherwise(0),
        (_format_holds(kind, value) if extra else _passes(kind, value)).cast("int"),
        spelling,
        F.when(value.rlike(_KNOWN_ENDING), 1).otherwise(0),
    )


@dataclass(frozen=True)
class SpanModel:
    trees: boosting.Boosted
    thresholds: dict[str, float]  # by kind


def _labelled(text: Column, kind: str) -> Column:
    """(features, label) of all candidates of a kind."""

    def one(extra: bool):
        def row(s: Column) -> Column:
            holds = _format_holds(kind, s["value"]) if extra else _passes(kind, s["value"])
            personal = holds & ~s["left"].rlike(_CODE)
            return F.struct(_features(kind, s, extra).alias("x"), personal.cast("int").alias("y"))

        return row

    base = F.transform(_spans(text, BASE[kind], _NEEDS[kind]), one(False))
    return F.concat(base, F.transform(_spans(text, EXTRA[kind], _EXTRA_NEEDS[kind]), one(True)))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", precision: float = 0.95) -> SpanModel:
    """Learn from all candidates of all documents. The documents are halved by a
    hash of the id; one half calibrates the thresholds: per kind the least score
    above which at least ``precision`` of the generator's candidates are personal."""
    if docs.isEmpty():
        return SpanModel(boosting.Boosted(0.0, ()), {})
    hashed = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000))
    halved = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), (hashed % 2).alias("half"))
    t = F.col("t")
    none = F.array().cast("array<struct<x:array<int>,y:int>>")
    counted = lambda df, *by: df.groupBy(*by, "c.x", "c.y").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = [_labelled(t, kind) for kind in KINDS]
    counts = counted(halved.select("half", F.explode(F.concat(*rows)).alias("c")), "half")
    examples = docs.sparkSession.createDataFrame(EXAMPLES, "kind string, t string, y int")

    def example(kind: str) -> Column:
        row = lambda s: F.struct(_features(kind, s, True).alias("x"), F.col("y").alias("y"))
        return F.when(F.col("kind") == kind, F.transform(_spans(t, EXTRA[kind], _EXTRA_NEEDS[kind]), row)).otherwise(none)

    shown = [example(kind) for kind in KINDS]
    shown = counted(examples.select(F.explode(F.concat(*shown)).alias("c")))
    table = [(r["half"], tuple(r["x"]), r["y"], float(r["n"])) for r in counts]
    table += [(half, tuple(r["x"]), r["y"], EXAMPLE_WEIGHT * float(r["n"])) for r in shown for half in (0, 1)]
    table.sort()
    x = np.array([r[1] for r in table], dtype=np.int64).reshape(-1, FEATURES)
    y, w = np.array([r[2] for r in table], float), np.array([r[3] for r in table], float)
    learn = np.array([r[0] == 0 for r in table], dtype=bool)
    # kinds count alike, however many candidates a corpus has of each
    level = np.ones(len(w))
    for group in np.unique(x[:, 0]):
        own = learn & (x[:, 0] == group)
        level[x[:, 0] == group] = 1000.0 / max(w[own].sum(), 1.0)
    trees = boosting.fit(x[learn], y[learn], (w * level)[learn], rounds=60)
    score, thresholds = trees.scores(x), {}
    for i, kind in enumerate(KINDS):
        own = ~learn & (x[:, 0] == 2 * i + 1)
        order = np.argsort(-score[own], kind="stable")
        s, right, all_ = score[own][order], np.cumsum((y * w)[own][order]), np.cumsum(w[own][order])
        # equal scores stand or fall together
        last = np.append(s[1:] != s[:-1], True) if len(s) else np.empty(0, bool)
        good = np.flatnonzero(last & (right >= precision * all_))
        if len(good):
            thresholds[kind] = float(s[good[-1]])
    return SpanModel(trees, thresholds)


_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _numbered(found: Column, number: int) -> Column:
    """Spans (start, end, ...) as (kind, start, end)."""
    return F.transform(
        found, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def _base(text: Column) -> Column:
    def passing(kind: str) -> Column:
        return F.filter(_spans(text, BASE[kind], _NEEDS[kind]), lambda s: _passes(kind, s["value"]))

    return F.concat(*[_numbered(passing(kind), i) for i, kind in enumerate(KINDS)]).cast(_SPAN)


def _added(text: Column, base: Column, model: SpanModel) -> Column:
    """Selected further spans, kinds numbered after the base kinds."""
    none = F.array().cast(_SPAN)

    def selected(kind: str) -> Column:
        def good(s: Column) -> Column:
            return let(_features(kind, s, True), model.trees.expression) >= model.thresholds[kind]

        return F.filter(_spans(text, EXTRA[kind], _EXTRA_NEEDS[kind]), good)

    chosen = [_numbered(selected(k), len(KINDS) + i) for i, k in enumerate(KINDS) if k in model.thresholds]
    if not chosen:
        return none

    def settled(candidates: Column) -> Column:
        by_place = lambda s, rank: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), (-s["end"]).alias("back"), s["kind"].alias("kind"))
        items = F.sort_array(F.concat(F.transform(base, lambda s: by_place(s, 0)), F.transform(candidates, lambda s: by_place(s, 1))))

        def limited(items: Column) -> Column:
            """Each with the start of the next base span behind it."""
            next_base = running(F.reverse(items), F.lit(2**31 - 1), lambda s, x: F.when(x["rank"] == 0, x["start"]).otherwise(s))
            return let(next_base, lambda n: F.transform(items, lambda x, i: F.struct(x.alias("x"), F.get(n, F.size(items) - 1 - i).alias("limit"))))

        fits = lambda it, end: (it["x"]["rank"] == 0) | ((it["x"]["start"] >= end) & (-it["x"]["back"] <= it["limit"]))

        def swept(items: Column) -> Column:
            ends = running(items, F.lit(0), lambda s, it: F.when(fits(it, s), F.greatest(s, -it["x"]["back"])).otherwise(s))

            def kept(ends: Column) -> Column:
                pairs = F.transform(items, lambda it, i: F.struct(it.alias("it"), F.get(ends, i).alias("end")))
                stay = F.filter(pairs, lambda p: (p["it"]["x"]["rank"] == 1) & fits(p["it"], p["end"]))
                span = lambda p: F.struct(p["it"]["x"]["kind"].alias("kind"), p["it"]["x"]["start"].alias("start"), (-p["it"]["x"]["back"]).alias("end"))
                return F.sort_array(F.transform(stay, span))

            return let(ends, kept)

        return let(let(items, limited), swept)

    return let(F.concat(none, *chosen), lambda c: F.when(F.size(c) > 0, settled(c)).otherwise(none))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"{k}_like") for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with ``base__`` and ``added__``: arrays of (kind, start, end)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def both(base: Column) -> Column:
        return F.struct(base.alias("base"), _added(t, base, model).alias("added"))

    return docs.withColumn("spans__", let(_base(t), both))


def detect(docs: DataFrame, model: SpanModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    found = spans(docs.select(F.col(key), F.col(text)), model, text)
    base, added = F.col("spans__.base"), F.col("spans__.added")
    count = lambda i: F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")
    return found.select(
        key,
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(base, added)).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, model: SpanModel, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, overlapping
    spans by that of the first; ``length`` names a column to hold the new
    number of characters. NULL texts stay NULL."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, *KINDS)])
    t = F.coalesce(F.col(text), F.lit(""))
    found = spans(docs, model, text)
    by_place = F.sort_array(
        F.transform(
            F.concat("spans__.base", "spans__.added"),
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")),
        )
    )

    def written(state: Column) -> Column:
        blocks, items, covered = state["blocks"], state["items"], state["covered"]

        def cut(start: Column, end: Column) -> Column:
            """Characters of the text, from the blocks that hold them."""
            first = F.floor(start / _TEXT_BLOCK).cast("int")
            count = F.floor((end - 1) / _TEXT_BLOCK).cast("int") - first + 1
            piece = F.array_join(F.slice(blocks, first + 1, count), "")
            return F.when(end > start, F.substring(piece, start - first * _TEXT_BLOCK + 1, end - start)).otherwise("")

        def piece(s: Column, i: Column) -> Column:
            at = F.get(covered, i)
            return F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.get(names, s["kind"]))).otherwise("")

        end = F.aggregate(items, F.lit(0), lambda e, s: F.greatest(e, -s["back"]))
        return F.concat(F.array_join(F.transform(items, piece), ""), let(end, lambda e: cut(e, state["size"])))

    def prepared(items: Column) -> Column:
        covered = running(items, F.lit(0), lambda e, s: F.greatest(e, -s["back"]))
        blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))
        return F.struct(blocks.alias("blocks"), items.alias("items"), covered.alias("covered"), F.length(t).alias("size"))

    clean = let(let(by_place, prepared), written)
    out = found.withColumn(text, F.when(F.col(text).isNotNull() & (F.size(by_place) > 0), clean).otherwise(F.col(text)))
    if length is not None:
        out = out.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text)).cast("long"))
    return out.select(*docs.columns)
