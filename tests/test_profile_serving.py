"""Profiling operators, joins, dedupe and serving queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.operators.dedupe import dedupe_by_key, latest_by_key, upsert
from strata.operators.filters import apply_filters
from strata.operators.joins import Lookup, enrich_left, fanout_left, join_coverage
from strata.operators.profile import (
    distinct_rows,
    null_profile,
    top_counts,
    value_distribution,
    value_distributions,
)
from strata.plans import serving as V
from strata.plans import water as W
from strata.plans.layers import (
    bronze,
    gold_area_rates,
    gold_nonconformity,
    gold_parameter_evolution,
    gold_region_quality,
    silver,
)


@pytest.fixture(scope="module")
def silver_all(all_raw, geography):
    return silver(bronze(all_raw), geography).cache()


def test_value_distribution_with_null_group(sample_raw):
    rows = value_distribution(sample_raw, "conformite_limites_bact_prelevement").collect()
    assert [(r.valeur, r.nb, r.pct) for r in rows] == [
        ("C", 4, 44.4),
        (None, 2, 22.2),
        ("D", 1, 11.1),
        ("N", 1, 11.1),
        ("S", 1, 11.1),
    ]


def test_value_distributions_of_all_codes_are_one_scan(sample_raw):
    df = value_distributions(sample_raw, [*W.CONFORMITY_COLUMNS, "absente"])
    for column in W.CONFORMITY_COLUMNS:
        alone = value_distribution(sample_raw, column).collect()
        got = df.where(F.col("colonne") == column).drop("colonne").collect()
        assert sorted(map(str, got)) == sorted(map(str, alone))
    assert df.select("colonne").distinct().count() == 4
    assert value_distributions(sample_raw, ["absente"]).count() == 0


def test_null_profile_of_the_columns_that_exist(edge_raw):
    prof = null_profile(edge_raw, ["code_commune", "date_prelevement", "nom_commune", "unite_mesure"])
    rows = [(r.colonne, r.pct_null) for r in prof.collect()]
    assert rows == [("code_commune", 14.3), ("date_prelevement", 14.3), ("unite_mesure", 0.0)]
    assert "Union" not in prof._jdf.queryExecution().executedPlan().toString()
    assert null_profile(edge_raw, ["nom_commune"]).count() == 0


def test_top_counts_total_order(sample_raw):
    nc = (F.col("conformite_limites_bact_prelevement") == "N") | (F.col("conformite_limites_pc_prelevement") == "N")
    rows = top_counts(sample_raw, ["libelle_parametre"], 2, where=nc).collect()
    assert [(r.libelle_parametre, r.nb) for r in rows] == [("Cuivre", 1), ("Entérocoques", 1)]


def test_join_coverage(edge_raw, geography):
    r = join_coverage(edge_raw, geography.communes, "code_commune", "com").first()
    # 7 rows: 5 in a known commune, one without area, one unknown
    assert (r.total, r.matched, r.pct_matched) == (7, 5, 71.4)


def test_list_filters(sample_raw):
    count = lambda **kw: apply_filters(sample_raw, kw).count()
    assert count(code_commune=["29019", "2B033"], code_prelevement=None) == 4
    assert count(code_commune=("29019",)) == 3 and count(code_commune=[]) == 0
    assert count(code_commune="29019", code_prelevement={"A4", "A1"}) == 1


def test_enrich_left_chain_and_fanout(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "id int, code string")
    dim = spark.createDataFrame([("a", "A", "p"), ("b", "B", "q")], "k string, label string, parent string")
    parents = spark.createDataFrame([("p", "P")], "parent string, plabel string")
    out = enrich_left(
        fact,
        [
            Lookup(dim, "code", "k", {"label": "label", "parent": "parent_code"}),
            Lookup(parents, "parent_code", "parent", {"plabel": "parent_label"}),
        ],
    )
    assert sorted(map(tuple, out.collect())) == [
        (1, "a", "A", "p", "P"),
        (2, "b", "B", "q", None),
        (3, "z", None, None, None),
    ]
    bridge = spark.createDataFrame([("a", "n1"), ("a", "n2")], "code string, net string")
    assert fanout_left(fact, bridge, "code").count() == 4


def test_dedupe_prefers_parent_then_order(spark):
    df = spark.createDataFrame(
        [("k1", None, "x"), ("k1", "p2", "b"), ("k1", "p1", "c"), ("k2", None, "a")],
        "k string, parent string, v string",
    )
    out = dedupe_by_key(df, ["k"], order_by=["parent", "v"], prefer_non_null=["parent"])
    assert sorted(map(tuple, out.collect()), key=str) == [("k1", "p1", "c"), ("k2", None, "a")]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_dedupe_prefers_complete_rows(spark):
    """A labelled row beats an unlabelled one, one with a region one without;
    columns that cannot be compared may be payload."""
    df = spark.createDataFrame(
        [("k", None, "p", None, {"a": 1}), ("k", "L", "p", None, {"a": 2}), ("k", None, "p", "r", {"a": 3}), ("k", "M", None, "r", {"a": 4})],
        "k string, label string, dep string, reg string, extra map<string,int>",
    )
    out = dedupe_by_key(df, ["k"], order_by=["dep", "reg", "label"], prefer_non_null=["dep", "reg", "label"])
    assert out.first().extra == {"a": 3}


def test_upsert_by_key(spark, all_raw):
    from conftest import RAW_SCHEMA, REDELIVERY

    updates = spark.createDataFrame(REDELIVERY, RAW_SCHEMA)
    merged = upsert(all_raw, updates, ["code_prelevement", "code_parametre"], ["date_prelevement"])
    assert merged.count() == all_raw.count()
    row = merged.filter("code_prelevement = 'A2'").first()
    assert (row.resultat_numerique, row.conformite_limites_bact_prelevement) == ("0", "C")


def test_latest_by_key_versions(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 12, "b"), (2, 5, "c"), (1, 12, "d")], "k int, ver int, v string")
    out = latest_by_key(df, ["k"], ["ver", "v"])
    assert sorted(map(tuple, out.collect())) == [(1, 12, "d"), (2, 5, "c")]


def test_distinct_rows(silver_all):
    assert distinct_rows(silver_all, ["categorie_parametre"]).count() == 4


class TestServing:
    def test_conformite_communes_filters(self, silver_all):
        g = gold_area_rates(silver_all)
        assert {r.annee_prelevement for r in V.conformite_communes(g).collect()} == {2021, 2022, 2023}
        rows = V.conformite_communes(g, annee=2022, code_departement="35").collect()
        assert len(rows) == 1 and rows[0].taux_global_pct == 33.33
        assert tuple(V.conformite_communes(g).columns) == V.AREA_COLUMNS
        assert V.conformite_communes(g, annee=0).count() == 0  # 0 is a value, not "no filter"
        assert V.conformite_communes(g, annee=[2022, 2023]).count() == 4

    def test_rejects_bad_code(self, silver_all):
        with pytest.raises(ValueError):
            V.conformite_communes(gold_area_rates(silver_all), code_departement="35'; DROP")

    def test_qualite_departements(self, silver_all):
        rows = V.qualite_departements(gold_region_quality(silver_all), code_region="94").collect()
        assert [(r.code_departement, r.nb_prelevements) for r in rows] == [("2B", 1)]
        assert tuple(V.qualite_departements(gold_region_quality(silver_all)).columns) == V.REGION_COLUMNS

    def test_evolution_categories(self, silver_all):
        g = gold_parameter_evolution(silver_all)
        rows = V.evolution_parametres(g, annee=2022, categorie="radioactivite").collect()
        assert [r.libelle_parametre for r in rows] == ["Activité bêta"]
        with pytest.raises(ValueError):
            V.evolution_parametres(g, categorie="nitrate")
        months = [r.mois_prelevement for r in V.evolution_parametres(g, annee=2022).collect()]
        assert months == sorted(months)

    def test_non_conformites_order(self, silver_all):
        rows = V.non_conformites(gold_nonconformity(silver_all)).collect()
        years = [r.annee_prelevement for r in rows]
        assert years == sorted(years)
