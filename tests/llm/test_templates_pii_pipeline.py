"""Template decontamination, personal data, and the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from cases import LONG, SF_DIR, components, documents
from pyspark.sql import functions as F

from strata.llm.common import running
from strata.llm import boosting, pii, queries, stages, templates

QUESTION = "The train left Oslo at noon and Anna waited 45 minutes, then drove 120 km to Bergen with 45 kg of luggage"


def _found(spark, texts, items, **options):
    docs = documents(spark, [(i, t, None, None, 0) for i, t in texts])
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hash", F.lit("x"))
    return sorted((r.doc_id, r.item_id) for r in templates.contaminated(docs, bench, **options).collect())


def test_other_numbers_and_names_are_found(spark):
    other = QUESTION.replace("45", "30").replace("120", "99").replace("Oslo", "Turin").replace("Anna", "Marco").replace("Bergen", "Milan")
    texts = [
        (1, f"Some prose before. {QUESTION} And after."),
        (2, f"Here: {other}."),
        (3, "The train left the station at noon and nobody waited for anything at all on that day"),
        (4, QUESTION.upper()),
        (5, None),
        (6, ""),
        (7, LONG),
        (1, f"Some prose before. {QUESTION} And after."),
    ]
    got = _found(spark, texts, [(1, QUESTION), (2, None), (3, "too short")])
    assert (1, 1) in got and (2, 1) in got and {d for d, _ in got} <= {1, 2, 4}


def test_inconsistent_slots_are_no_match(spark):
    """45 stands twice in the item: other values in its two places, or one
    value for 45 and 120, are another question."""
    twice = QUESTION.replace("45 minutes", "30 minutes").replace("45 kg", "31 kg")
    merged = QUESTION.replace("45", "120")
    assert _found(spark, [(1, twice), (2, merged), (3, QUESTION)], [(1, QUESTION)]) == [(3, 1)]


def test_slots_past_the_matched_windows_do_not_reject(spark):
    """The first half of the item, word for word, then an unrelated 12 where
    the item repeats its 45; and a word put in between."""
    head = QUESTION.split(", then")[0]
    texts = [
        (1, f"{head} but she saw that no bus would come for 12 kg of it"),
        (2, QUESTION.replace("Bergen with 45 kg", "Bergen with 45 heavy kg") + " or 7"),
    ]
    place = QUESTION.replace(",", "").split()
    tail = place[:11] + "but she saw it no bus came".split() + ["12"] + "kg more".split()
    assert tail[18] == "12" and place[18] == "45"
    texts.append((3, " ".join(tail)))
    assert _found(spark, texts, [(1, QUESTION)]) == [(1, 1), (2, 1), (3, 1)]


def test_items_without_a_usable_window_are_found_as_they_stand(spark):
    items = [(1, "What is 345 + 678 * 12?"), (2, "What is the capital of France?"), (3, "1 2 3 4 5 6 7 8 9 10 km")]
    texts = [
        (1, "Then he asked: what is 345 + 678 * 12? Nobody knew."),
        (2, "Here he says What is the capital of France? So."),
        (3, "Here he says What is the capital of Norway? So."),
        (4, "We know that Paris is the capital of France by now."),
        (5, "and 1 2 3 4 5 6 7 8 9 10 km on"),
        (6, "and 9 2 3 8 5 6 7 4 9 11 km on"),
    ]
    assert _found(spark, texts, items) == [(1, 1), (2, 2), (3, 2), (5, 3)]


def test_numbers_with_thousands_are_one_number(spark):
    item = "A farmer sold 1,250 sheep at the old market and then bought 1,000,000 seeds"
    texts = [(1, item.replace("1,250", "900").replace("1,000,000", "70")), (2, item), (3, "1,2,3 and 12,3456")]
    assert _found(spark, texts, [(1, item)]) == [(1, 1), (2, 1)]
    words = templates._words(spark.createDataFrame([(texts[2][1],), ("1,250,000.",)], "t string"), "t")
    assert [r.raw for r in words.collect()] == [["1", "2", "3", "and", "12", "3456"], ["1250000"]]


def test_items_shorter_than_a_window(spark):
    items = [(1, "how many apples remain now"), (2, "one two")]
    texts = [(1, "Tell me how many apples remain now please"), (2, "one two three"), (3, "how many pears remain now")]
    assert _found(spark, texts, items) == [(1, 1)]


def test_empty_tables(spark):
    assert _found(spark, [], [(1, QUESTION)]) == []
    assert _found(spark, [(1, QUESTION)], []) == []
    assert templates.decontaminate(documents(spark, []), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_template_words_stay_in_their_places(spark):
    df = spark.createDataFrame([("We met Bob (42) at 5km, then 7 kg. Then 3.5 m\x01x",)], "t string")
    df = templates._words(df, "t")
    r = df.first()
    assert len(r.raw) == len(r.canon)
    assert r.canon == ["we", "met", "<name>", "<num>", "at", "<amount>", "then", "<num>", "<unit>", "then", "<num>", "<num>", "<unit>", "x"]


def test_template_query_finds_exactly_the_held_items(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    want = {(i, j) for j, b in items for i, t in docs if plain(b) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op4_templates(spark, sf).collect()}
    assert want <= got and len({i for i, _ in got} - {i for i, _ in want}) <= 2


# ------------------------------------------------------------------- PII


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _plain_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PII_TEXTS = [
    "write to ann.b+c@mail-1.example.co.uk, or bob@host (no dot) or x@@y.z or a@b.c.d_e@f.gg",
    "é🙂 +47 (22) 33-44.55 66 and +1 2 and +123456789012345678 +12345678",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 12 4111 1111 1111 1111",
    "1.2.3.4.5 256.1.1.1 001.02.3.0255 1.2.3 10.0.0.1, 1.2.3.4.5.6.7.8",
    "a@b.c@d.e +4.5.6.7.8.9.10.11@x.yz",
    "_@-.-, %@a.b..c 5-5 5  5 5--5 +5",
    None,
    "",
    "x" * 20000 + "@example.com " + "9" * 20000 + " 1.2" * 3000,
    " ".join(["me@example.org 10.1.2.3"] * 400),
    "mail ann (at) example (dot) com or 3782-822463-10005, call (555) 123-4567",
]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"mail user{i}@site{i % 7}.org call +1 555 0{i:06d} card 4111 1111 1111 1111 ref 4111 1111 1111 1112 at 10.0.{i % 256}.{i % 300}", None, None, 0) for i in range(300)]
    return pii.fit(documents(spark, rows))


def test_base_spans_equal_the_plain_scan(spark, model):
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(PII_TEXTS)])
    for r in pii.detect(docs, model).collect():
        want = _plain_spans(PII_TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(_listed(want).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS]
        listed = r.spans.split(",") if r.spans else []
        assert set(_listed(want).split(",")) - {""} <= set(listed) and len(listed) == len(want) + r.n_added


def test_added_spans_do_not_overlap(spark, model):
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(PII_TEXTS)])
    for r in pii.detect(docs, model).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        added = [(int(a), int(b)) for k, a, b in spans if k.endswith("_like")]
        base = [(int(a), int(b)) for k, a, b in spans if not k.endswith("_like")]
        for n, (a, b) in enumerate(added):
            assert all(b <= c or d <= a for c, d in base + added[:n])


#: Texts and the spans that the method adds to the base ones.
ADDED = [
    ("write to jo (at) firma (dot) org", "email_like:9:32"),
    ("mail ann [at] example [dot] com", "email_like:5:31"),
    ("please look at example.com", ""),
    ("we met at noon.then left", ""),
    ("host 10[.]1[.]2[.]3 is down", "ip_like:5:19"),
    ("build 300[.]1[.]2[.]3", ""),
    ("card 371449635398431", "card_like:5:20"),
    ("paid by 3782-822463-10005 today", "card_like:8:25"),
    ("card 371449635398432", ""),  # fails the Luhn check
    ("order no 371449635398431", ""),  # named as a code
    ("call (415) 555-2671", "phone_like:5:19"),
    ("order 415-555-2671", ""),
    ("part 115-055-2671", ""),
]


@pytest.mark.parametrize("source", ["small", "corpus"])
def test_added_spans_that_are_found_and_refused(spark, model, source):
    learned = model if source == "small" else pii.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert set(learned.thresholds) == set(pii.KINDS)
    docs = documents(spark, [(i, t, None, None, 0) for i, (t, _) in enumerate(ADDED)])
    got = {r.doc_id: r.spans for r in pii.detect(docs, learned).collect()}
    assert got == {i: want for i, (_, want) in enumerate(ADDED)}


def test_every_candidate_counts_in_learning(spark, monkeypatch):
    """Also of more documents than a sample would hold: weights follow the counts of all of one half."""
    seen, fit = {}, pii.boosting.fit
    monkeypatch.setattr(pii.boosting, "fit", lambda x, y, w, **how: seen.update(x=x, w=w) or fit(x, y, w, **how))
    half = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) % 2
    docs = spark.range(15_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 40 == 0, "to a@b.org").otherwise("zz longer-name@example.org").alias("text")
    )
    pii.fit(docs)
    want = sorted(r["count"] for r in docs.where(half == 0).groupBy("text").count().collect())
    few, many = sorted(seen["w"][seen["x"][:, 0] == 0])
    assert abs(many / few - want[1] / want[0]) < 1e-9


def test_overlapping_candidates_keep_the_first_and_give_way_to_base_spans(spark, model):
    texts = ["a@b.org (at) firma (dot) org", "call 415-555-2671 415-555-2672", "jo (at) a (dot) me@firma.org"]
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r.spans.split(",") for r in pii.detect(docs, model).collect()}
    assert got[0] == ["email:0:7"]
    assert got[1] == ["phone_like:5:17", "phone_like:18:30"]
    assert [s for s in got[2] if s.startswith("email:")] and not [s for s in got[2] if s.endswith(":28") and "_like" in s]


def test_states_of_a_running_walk_over_several_blocks(spark):
    n = 1000
    df = spark.createDataFrame([(list(range(n)),), ([],), ([5],)], "a array<int>")
    got = [r[0] for r in df.select(running(F.col("a"), F.lit(3), lambda s, x: s + x)).collect()]
    assert got == [[3 + i * (i - 1) // 2 for i in range(n)], [], [3]]


def test_long_texts_are_redacted_in_linear_time(spark, model):
    """A million characters with some 40,000 spans each; per-span work on the whole text would take hours."""
    texts = ["call 415-555-2671, " * 52_000, "1234 5678," * 100_000, "jo (at) firma (dot) org; " * 40_000, "10.1.2.3 me@x.org " * 55_000]
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)], extra=False)
    got = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert got[0] == "call [PHONE], " * 52_000 and got[1] == texts[1]
    assert got[2] == "[EMAIL]; " * 40_000 and got[3] == "[IP] [EMAIL] " * 55_000


def test_pii_query_equals_the_plain_scan(spark):
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    got = queries.op7_pii(spark, SF_DIR).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_sha256 == hashlib.sha256(_listed(_plain_spans(rows[r.doc_id])).encode()).hexdigest()


def test_redaction_replaces_spans_and_nothing_else(spark, model):
    texts = ["a me@x.org, b 10.0.0.1; +1 555 000111", None, "clean text", "x +10.0.0.1.5555 y"]  # a phone number over an address
    docs = documents(spark, [(i, t, "en", "s", 7) for i, t in enumerate(texts)])
    out = pii.redact(docs, model)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars, r["rank"]) for r in out.collect()}
    assert got[0] == ("a [EMAIL], b [IP]; [PHONE]", 26, "x")
    assert got[1] == (None, None, "x") and got[2] == ("clean text", 10, "x")
    assert got[3] == ("x [PHONE] y", 11, "x")


def test_pii_without_rows(spark, model):
    none = pii.fit(documents(spark, []))
    assert none.thresholds == {}
    assert pii.detect(documents(spark, []), none).count() == 0
    assert {r.n_added for r in pii.detect(documents(spark), none).collect()} == {0}


def test_boosting_learns_an_interaction_and_its_expression_agrees(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (400, 3))
    y = ((x[:, 0] > 1) ^ (x[:, 2] > 0)).astype(float)
    model = boosting.fit(x, y, np.ones(400))
    score = model.scores(x)
    assert ((score > 0) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int")
    got = [r[0] for r in df.select(model.expression(F.array("a", "b", "c"))).collect()]
    assert got == pytest.approx(score.tolist())


# -------------------------------------------------------------- pipeline


def test_pipeline_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        assert set(out.dtypes) == set(docs.dtypes), name
    one = stages.keep_one_of_each_group(spark, docs, SF_DIR)
    groups = components([(i, r.text) for i, r in rows.items()])
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for c in groups.values()})
    redacted = {r.doc_id: r.text for r in stages.redact_personal_data(spark, docs, SF_DIR).collect()}
    assert len(redacted) == len(rows)
    for i, r in rows.items():
        if not _plain_spans(r.text):
            assert redacted[i] == r.text
        assert not _plain_spans(redacted[i])
    hits = {r.doc_id for r in queries.op4_templates(spark, SF_DIR).collect()}
    assert {r.doc_id for r in stages.drop_contaminated(spark, docs, SF_DIR).collect()} == set(rows) - hits


def test_pipeline_on_awkward_rows(spark, tmp_path):
    sf_dir = str(tmp_path)
    documents(spark, extra=False).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    # 2 copies 1, 7 is a near copy of 6, 3 to 5 and 9 have no letter
    assert {r.doc_id for r in got} == {1, 6, 8, None}
    by = defaultdict(int)
    for r in got:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 1024


def test_pipeline_without_documents(spark, tmp_path):
    sf_dir = str(tmp_path)
    documents(spark, [], extra=False).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
