"""Gold aggregates on the samples of conftest (hand-computed) and the
equivalence of the two-stage distinct counting with the textbook form."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strata.operators.aggregates import count_distinct_reference, entity_counts, rollup_of_counts
from strata.plans.layers import (
    bronze,
    gold_area_rates,
    gold_nonconformity,
    gold_parameter_evolution,
    gold_region_quality,
    silver,
    silver_codes,
)
from strata.sources.sinks import materialize


@pytest.fixture(scope="module")
def silver_rows(sample_raw, geography):
    return silver(bronze(sample_raw), geography).cache()


def _sorted(df):
    return sorted(map(tuple, df.collect()))


def test_area_rates(silver_rows):
    assert _sorted(gold_area_rates(silver_rows).drop("libelle_departement")) == [
        # samples; conforming bact, pc, global; rates
        ("29019", "Brest", "29", 2022, 1, 1, 0, 0, 100.0, 0.0, 0.0),
        ("29019", "Brest", "29", 2023, 2, 0, 1, 0, 0.0, 50.0, 0.0),
        ("2B033", "Bastia", "2B", 2023, 1, 1, 1, 1, 100.0, 100.0, 100.0),
        ("35238", "Rennes", "35", 2022, 3, 2, 2, 1, 66.67, 66.67, 33.33),
    ]


def test_nonconformity(silver_rows):
    """NULL verdicts count on neither side: A4 and A6 are in no count."""
    assert _sorted(gold_nonconformity(silver_rows).drop("libelle_departement")) == [
        (2022, "29", 1, 0, 0, 0, 0.0),
        (2022, "35", 3, 1, 1, 2, 66.67),
        (2023, "29", 2, 0, 1, 1, 50.0),
        (2023, "2B", 1, 0, 0, 0, 0.0),
    ]


def test_region_quality(silver_rows):
    assert _sorted(gold_region_quality(silver_rows)) == [
        ("29", "Finistère", "53", "Bretagne", 2022, 1, 0, 0.0),
        ("29", "Finistère", "53", "Bretagne", 2023, 2, 0, 0.0),
        ("2B", "Haute-Corse", "94", "Corse", 2023, 1, 1, 100.0),
        ("35", "Ille-et-Vilaine", "53", "Bretagne", 2022, 3, 1, 33.33),
    ]


def test_evolution(silver_rows):
    by = {r.libelle_parametre: r for r in gold_parameter_evolution(silver_rows).collect()}
    assert len(by) == 8  # one group a label here
    twice = by["Entérocoques"]  # A1 and A2, both in March
    assert (twice.annee_prelevement, twice.mois_prelevement, twice.nb_prelevements) == (2022, 3, 2)
    assert (twice.moyenne, twice.minimum, twice.maximum, twice.unite_mesure) == (2.0, 0.0, 4.0, "n/100mL")
    assert (twice.nb_mesures_avec_limite, twice.nb_depassements_limite, twice.taux_depassement_limite_pct) == (2, 1, 50.0)
    none = by["Coliformes"]  # not one value
    assert (none.moyenne, none.nb_mesures_avec_limite, none.nb_depassements_limite) == (None, 0, None)
    assert none.taux_depassement_limite_pct is None and by["Turbidité"].nb_mesures_avec_limite == 0


def test_evolution_unit_and_sample_in_several_units(spark, silver_rows):
    """One sample measured in two units counts once; the unit is the least."""
    one = silver_rows.where("libelle_parametre = 'Plomb'")
    other = one.withColumn("unite_mesure", F.lit("mg/L")).withColumn("resultat_numerique", F.lit(30.0))
    r = gold_parameter_evolution(one.unionByName(other)).first()
    assert (r.nb_prelevements, r.moyenne, r.minimum, r.maximum, r.unite_mesure) == (1, 20.0, 10.0, 30.0, "mg/L")


def test_labels_may_be_joined_after_the_aggregate(sample_raw, silver_rows, geography):
    dims = geography.deduplicated()
    codes = silver_codes(bronze(sample_raw), dims)
    for build in (gold_area_rates, gold_nonconformity, gold_region_quality, gold_parameter_evolution):
        assert sorted(map(str, build(codes, dims).collect())) == sorted(map(str, build(silver_rows).collect()))


def test_rates_follow_from_the_counts(silver_rows):
    for size in (1, 2, 3):
        for names in itertools.combinations(["A1", "A2", "A3"], size):
            r = gold_area_rates(silver_rows.where(F.col("code_prelevement").isin(*names))).first()
            assert r.nb_prelevements == size  # A1 has three rows and counts once
            assert r.taux_global_pct == round(100.0 * ("A1" in names) / size, 2)


def test_nested_aggregate(silver_rows):
    r = rollup_of_counts(silver_rows, ["code_commune", "annee_prelevement"], "code_prelevement").first()
    assert (r.min_nb, r.sum_nb, r.nb_groupes) == (1, 7, 4)


def test_two_stage_equals_count_distinct_on_random_data(spark):
    """Entities with mixed, all-NULL and missing flags; NULL entities; NULL keys."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        entity = None if rng.random() < 0.03 else f"e{rng.randrange(400)}"
        key = rng.choice(["a", "b", None])
        f1 = rng.choice([True, False, None])
        f2 = rng.choice([True, None])
        rows.append((key, entity, f1, f2))
    df = spark.createDataFrame(rows, "k string, e string, f1 boolean, f2 boolean")
    conds = {
        "n1": F.col("f1"),
        "n1_neg": ~F.col("f1"),
        "n2": F.col("f2"),
        "n2_neg": ~F.col("f2"),
    }
    ours = entity_counts(df, ["k"], "e", conds, "total")
    textbook = count_distinct_reference(df, ["k"], "e", conds, "total")
    cols = ["k", "total", "n1", "n1_neg", "n2", "n2_neg"]
    assert sorted(map(tuple, ours.select(cols).collect()), key=str) == sorted(
        map(tuple, textbook.select(cols).collect()), key=str
    )


def test_two_stage_plan_has_no_expand(silver_rows):
    plan = gold_area_rates(silver_rows)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    textbook = count_distinct_reference(
        silver_rows,
        ["code_commune"],
        "code_prelevement",
        {"a": F.col("est_conforme_bact_limites"), "b": F.col("est_conforme_pc_limites")},
        "n",
    )
    assert "Expand" in textbook._jdf.queryExecution().executedPlan().toString()


def test_evolution_moves_a_fact_once(spark, silver_rows):
    """Facts go to their (group, sample); what follows there needs no further exchange of them."""
    stored = materialize(silver_rows, "silver")
    plan = gold_parameter_evolution(stored)._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moves) == 2 and "code_prelevement" not in moves[0] and "code_prelevement" in moves[1]
    # a sample without a number counts as no sample, its measures count
    unnumbered = stored.withColumn("code_prelevement", F.lit(None).cast("string"))
    rows = lambda df: {(r.libelle_parametre, r.annee_prelevement): r for r in gold_parameter_evolution(df).collect()}
    before, after = rows(stored), rows(stored.unionByName(unnumbered))
    assert {k: r.nb_prelevements for k, r in after.items()} == {k: r.nb_prelevements for k, r in before.items()}
    assert all(after[k].nb_mesures_avec_limite == 2 * r.nb_mesures_avec_limite and after[k].moyenne == r.moyenne for k, r in before.items())
