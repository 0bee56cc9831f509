"""Language ID and toxicity: held-out accuracy and defined cases."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import SF_DIR, documents

from strata.llm import language, queries, toxicity
from strata.llm.hashing import runs


def test_language_query_is_right_on_held_out_documents(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.op6_language(spark, sf).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    held = [i for i in truth if rows[i].held_out]
    assert len(rows) == len(truth) and 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_defined_cases(spark):
    docs = documents(spark)
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for i in (3, 4, 5, 9):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[6].lang_pred == "en"
    odd = documents(spark, [(1, "… — 12", "en", "", 1), (2, "жук", "en", "", 1), (3, "zzz", "en", "", 1)])
    learned = language.fit(docs)
    assert [r.lang_pred for r in language.predict(odd, learned).orderBy("doc_id").collect()] == ["und", "en", "en"]


def test_language_without_training_rows(spark):
    empty = documents(spark, [])
    nothing = language.fit(empty)
    assert language.predict(empty, nothing).count() == 0
    assert {r.lang_pred for r in language.predict(documents(spark), nothing).collect()} == {"und"}
    assert sorted(r.doc_id or 0 for r in language.keep(documents(spark), nothing, 0.1).collect()) == [0, 1, 1, 2, 6, 7, 8, 8]


def test_kept_documents_do_not_pass_through_python(spark):
    """Only texts go to Python; the rows kept are those of enough score."""
    words = (("Thé", "fr"), ("the", "en"), ("xqzv", None))
    rows = [(i, f"{w} {w} {i}", lang, "web", i) for i in range(300) for w, lang in words]
    docs = documents(spark, rows)
    filters = language.fit(docs.where("doc_id % 3 = 0 AND lang IS NOT NULL"))
    kept = language.keep(docs, filters, 0.6)
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    scores = language.predict(docs.withColumn("doc_id", docs.text), filters)
    enough = {r.doc_id for r in scores.collect() if r.score >= 0.6}
    want = [r for r in docs.collect() if r.text in enough]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want)) and 0 < len(want) < len(rows)


def test_more_languages_than_bits_in_a_word(spark):
    word = lambda i: f"{chr(97 + i // 12)}{chr(98 + i % 12)}" * 3
    docs = documents(spark, [(i, f"{word(i)} {word(i)}", f"l{i:03}", "", 1) for i in range(140)])
    filters = language.fit(docs)
    assert filters.cells.shape == (3, 1 << 20)
    got = language.predict(docs, filters).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: f"l{i:03}" for i in range(140)}


def test_filters_return_all_languages_of_an_ngram():
    cells = np.zeros(1 << 12, np.uint64)
    for bit, keys in enumerate(([1, 2, 3], [3, 4])):
        for at in language._cells(np.array(keys), 3, len(cells)):
            np.bitwise_or.at(cells, at, np.uint64(1 << bit))
    masks = np.bitwise_and.reduce([cells[a] for a in language._cells(np.arange(6), 3, len(cells))])
    assert masks.tolist()[1:5] == [1, 1, 3, 2]


def test_grams_stay_inside_their_row():
    data = np.frombuffer("ab1é".encode(), np.uint8)
    packed, (first, last) = language.grams(data, np.array([0, 2, 2, len(data)]))
    text = [bytes(int(p >> s & 255) for s in (24, 16, 8, 0)) for p in packed]
    own = [text[a:b] for a, b in zip(first, last, strict=True)]
    assert own[0] == [b" ab "] and own[1] == [] and own[2] == [" é ".encode()]


def _toxic_rows(n=400):
    words = ["calm", "river", "stone", "cloud", "field", "window", "paper", "green"]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        grade = int(rng.integers(0, 3))
        text = list(rng.choice(words, 30)) + ["nasty"] * (2 * grade)
        rows.append((i, " ".join(rng.permutation(text)), grade))
    return rows


def test_severity_rises_with_the_grade(spark):
    rows = _toxic_rows()
    labelled = spark.createDataFrame(rows[:300], "doc_id bigint, text string, grade int")
    model = toxicity.fit(labelled)
    assert np.all(np.diff(model.thresholds) > 0)
    test = spark.createDataFrame(rows[300:], "doc_id bigint, text string, grade int")
    got = {r.doc_id: r for r in toxicity.predict(test, model).collect()}
    mean = [np.mean([got[i].expected_severity for i, _, g in rows[300:] if g == k]) for k in range(3)]
    assert mean[0] < 0.3 < mean[1] < 1.5 < mean[2]
    assert all(got[i].toxic == (g > 0) for i, _, g in rows[300:])


def test_toxicity_defined_cases(spark):
    docs = documents(spark)
    labelled = spark.createDataFrame(_toxic_rows(), "doc_id bigint, text string, grade int")
    got = toxicity.predict(docs, toxicity.fit(labelled)).collect()
    assert len(got) == docs.count() and not any(r.toxic for r in got if r.doc_id in (3, 4, 5))
    none = toxicity.fit(labelled.where("grade > 9"))
    assert {(r.expected_severity, r.toxic) for r in toxicity.predict(docs, none).collect()} == {(0.0, False)}
    one = toxicity.fit(labelled.where("grade = 1"))
    assert {round(r.expected_severity, 6) for r in toxicity.predict(docs, one).collect()} == {1.0}
    assert toxicity.predict(documents(spark, []), none).count() == 0


def test_rare_toxic_documents_are_told_from_clean_ones(spark):
    """One toxic row in 1,000, more rows than are sampled, four insults."""
    words = [f"word{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(300)]
    rng = np.random.default_rng(7)
    rows = []
    for i in range(20_000):
        text = list(rng.choice(words, 12)) + [("nasty", "vile", "rotten", "foul")[i // 1000 % 4]] * (i % 1000 == 0)
        rows.append((i, " ".join(text), int(i % 1000 == 0)))
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    got = toxicity.predict(labelled, toxicity.fit(labelled)).where("toxic").collect()
    assert {r.doc_id for r in got} == set(range(0, 20_000, 1000))


def test_rare_grades_are_sampled_whole():
    assert toxicity.sampled({0: 100_000, 1: 30, 2: 5000}, 9000) == {1: 30, 2: 4485, 0: 4485}
    assert toxicity.sampled({0: 10, 3: 20}, 9000) == {0: 10, 3: 20}


def test_texts_of_another_table_give_the_same_model(spark):
    labelled = spark.createDataFrame(_toxic_rows(), "doc_id bigint, text string, grade int")
    apart = toxicity.fit(labelled.select("doc_id", "grade"), docs=labelled.select("doc_id", "text"), sample_docs=200)
    joined = toxicity.fit(labelled, sample_docs=200)
    assert apart.buckets.tolist() == joined.buckets.tolist() and apart.flag_at == joined.flag_at


def test_nothing_is_flagged_without_a_feature(spark):
    rows = [(i, "the same calm words", i % 10 == 0) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, grade boolean").selectExpr("doc_id", "text", "int(grade) grade")
    got = toxicity.predict(labelled, toxicity.fit(labelled)).collect()
    assert len(got) == 200 and not any(r.toxic for r in got)
    assert got[0].p_toxic == pytest.approx(0.1, abs=0.02)


def test_toxicity_query_finds_labelled_insults(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    got = {r.doc_id for r in queries.op5_toxicity(spark, sf).where("toxic").collect()}
    rows = duckdb.sql(f"SELECT doc_id, lower(text), toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id)").fetchall()
    insulting = {i for i, t, y in rows if y and any(w in t.split() for w in ("moron", "scum", "idiot", "trash"))}
    clean = {i for i, _, y in rows if not y}
    assert len(insulting & got) >= 0.9 * len(insulting)
    assert len(clean & got) <= 0.02 * len(clean)


def test_cumulative_link_gradient_fits_the_base_rates():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    model = toxicity.fit_rows(np.empty(0, int), np.empty(0, int), np.empty(0), y, 16, 4, 1e-4, 600)
    p = toxicity.grade_probabilities(model, np.zeros(1))[:, 0]
    assert p == pytest.approx(np.bincount(y) / 300, abs=0.02)


def test_runs_are_cut_at_rows():
    starts, ends = runs(np.array([1, 1, 1, 0, 1], bool), np.array([0, 2, 5]))
    assert (starts.tolist(), ends.tolist()) == ([0, 2, 4], [2, 3, 5])


def test_text_chunks_cover_all_rows():
    from strata.llm.common import text_chunks

    texts = ["a" * 10, None, "", "b" * 100, "ccc"]
    column = pa.array(["skip", *texts]).slice(1)
    got = []
    for a, b, data, offsets in text_chunks(column, 20):
        got += [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(b - a)]
    assert got == [t or "" for t in texts]
