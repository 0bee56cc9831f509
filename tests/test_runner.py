"""End-to-end medallion run on the samples of conftest."""

from __future__ import annotations

import os
from dataclasses import replace

import pytest
from conftest import RAW_SCHEMA, REDELIVERY
from pyspark.sql import functions as F

from strata.operators.quality import QualityGateError
from strata.plans.runner import LayerConfig, refresh_medallion, run_medallion
from strata.plans.water import SILVER_SUITE_STRICT, WATER


@pytest.fixture
def covered(all_raw):
    """Without the commune that the dimension lacks."""
    return all_raw.filter("code_prelevement <> 'E7'")


def test_run_merges_deliveries_and_writes_every_layer(spark, tmp_root, covered, geography):
    cfg = LayerConfig(root=tmp_root, prefix="t1_")
    when = F.lit("2025-01-01 02:00:00").cast("timestamp")
    later = spark.createDataFrame(REDELIVERY, RAW_SCHEMA)
    res = run_medallion(spark, [covered, later], geography, cfg, WATER, ingested_at=when)
    assert res.facts.count() == covered.count() == 15
    corrected = res.facts.filter("code_prelevement = 'A2'").collect()
    assert [(r.resultat_numerique, r.date_prelevement) for r in corrected] == [("0", "2022-03-19")]
    assert (res.loads["bronze"]["rows_written"], res.loads["silver"]["rows_written"]) == (15, 10)
    assert res.silver_drops == {"rows_in": 15, "dropped: code_commune non nul": 1, "dropped: date valide": 4}
    assert os.path.isdir(os.path.join(res.loads["silver"]["path"], "annee_prelevement=2022", "code_departement=35"))
    # partition values keep their string type ("2B", "35")
    assert {r[0] for r in res.silver.select("code_departement").distinct().collect()} == {"35", "29", "2B"}
    g1 = res.gold["conformite_par_commune"].filter("annee_prelevement = 2022 AND code_commune = '35238'").first()
    assert (g1.nb_prelevements, g1.nb_conformes_global, g1.taux_global_pct) == (3, 2, 66.67)
    assert all(s["succes"] for s in res.summary)
    assert res.report.count() == len(WATER.silver_suite.expectations) + len(WATER.gold_suite.expectations)
    # stored layers are queryable by name, gold as catalog tables with partitions
    assert spark.sql("SELECT COUNT(*) FROM t1_silver_controles_sanitaires").first()[0] == 10
    assert spark.table("t1_conformite_par_commune").count() == res.loads["conformite_par_commune"]["rows_written"] == 5
    pruned = spark.table("t1_conformite_par_commune").filter("annee_prelevement = 2021")
    assert pruned.count() == 1
    assert "PartitionFilters: [isnotnull(annee_prelevement" in pruned._jdf.queryExecution().executedPlan().toString()
    assert spark.catalog.tableExists("t1_non_conformites_par_departement")


def test_a_rerun_merges_into_what_was_landed(spark, tmp_root, covered, geography):
    cfg = LayerConfig(root=tmp_root, prefix="t2_")
    run_medallion(spark, [covered], geography, cfg, WATER)
    res = run_medallion(spark, [spark.createDataFrame(REDELIVERY, RAW_SCHEMA)], geography, cfg, WATER)
    assert res.facts.count() == 15  # history is corrected, not replaced
    assert res.facts.filter("code_prelevement = 'A2'").first().resultat_numerique == "0"
    assert spark.table("t2_conformite_par_commune").filter("annee_prelevement = 2022").agg(F.sum("nb_conformes_global")).first()[0] == 2


def test_nonconformity_is_stored_worst_first(spark, tmp_root, covered, geography):
    res = run_medallion(spark, [covered], geography, LayerConfig(root=tmp_root, prefix="o1_"), WATER)
    rows = res.gold["non_conformites_par_departement"].filter("annee_prelevement = 2022").collect()
    rates = [r.taux_non_conformite_pct for r in rows]
    assert len(rates) == 2 and rates == sorted(rates, reverse=True)


def _gold(spark, cfg, name):
    return sorted(map(tuple, spark.table(cfg.prefix + name).select("*").collect()), key=str)


def test_a_refresh_works_out_its_years_only_and_equals_a_whole_run(spark, tmp_root, covered, geography):
    redelivery = [*REDELIVERY, ("A4", "1034", "29019", "2024-02-01", "Activité bêta", "1 Bq/L", None, "7", "Bq/L", "N", "C", "C", "C")]
    later = spark.createDataFrame(redelivery, RAW_SCHEMA)  # corrects A2, moves A4 from 2022 to 2024
    part, whole = LayerConfig(root=tmp_root + "/part", prefix="r1_"), LayerConfig(root=tmp_root + "/whole", prefix="r2_")
    run_medallion(spark, [covered], geography, part, WATER)
    files = {r[0] for r in spark.table("r1_conformite_par_commune").select(F.input_file_name()).distinct().collect()}
    res = refresh_medallion(spark, [later], geography, part, WATER)
    run_medallion(spark, [covered, later], geography, whole, WATER)
    for name in res.gold:
        assert _gold(spark, part, name) == _gold(spark, whole, name)
    assert {r[0] for r in res.silver.select("annee_prelevement").distinct().collect()} == {2022, 2024}
    now = {r[0] for r in spark.table("r1_conformite_par_commune").select(F.input_file_name()).distinct().collect()}
    old = {f for f in files if "annee_prelevement=2022" not in f}
    assert old and old <= now  # other years keep their files
    assert all("annee_prelevement=2022" in f or "annee_prelevement=2024" in f for f in now - old)


def test_a_year_that_is_left_goes_and_a_failed_gate_publishes_nothing(spark, tmp_root, covered, geography):
    cfg = LayerConfig(root=tmp_root, prefix="r3_")
    run_medallion(spark, [covered], geography, cfg, WATER)
    move = spark.createDataFrame(
        [("E1", "1302", "35238", "2022-02-01", "pH", ">= 6,5 et <= 9", None, "7.2", "pH", "C", "C", "C", "C")], RAW_SCHEMA
    )
    refresh_medallion(spark, [move], geography, cfg, WATER)
    years = lambda: {r[0] for r in spark.table("r3_conformite_par_commune").select("annee_prelevement").collect()}
    assert years() == {2022, 2023}
    before = _gold(spark, cfg, "conformite_par_commune")
    with pytest.raises(QualityGateError):
        bad = [("E7", "1340", "00000", "2021-04-01", "Nitrates", "50 mg/L", None, "60", "mg/L", "C", "N", "C", "C")]
        refresh_medallion(spark, [spark.createDataFrame(bad, RAW_SCHEMA)], geography, cfg, WATER)
    assert _gold(spark, cfg, "conformite_par_commune") == before
    nothing = spark.createDataFrame([], RAW_SCHEMA)
    assert refresh_medallion(spark, [nothing], geography, cfg, WATER) is None


def test_failing_gate_raises_after_the_report_and_publishes_nothing(spark, tmp_root, all_raw, covered, geography):
    strict = replace(WATER, silver_suite=SILVER_SUITE_STRICT)
    cfg = LayerConfig(root=tmp_root, prefix="t3_")
    with pytest.raises(QualityGateError):
        run_medallion(spark, [covered], geography, cfg, strict)
    report = spark.read.option("recursiveFileLookup", True).parquet(cfg.path(cfg.reports))
    assert report.filter("NOT succes").count() > 0
    assert not spark.catalog.tableExists("t3_conformite_par_commune")
    with pytest.raises(QualityGateError):  # the unknown commune fails the coverage share
        run_medallion(spark, [all_raw], geography, LayerConfig(root=tmp_root + "/b", prefix="t4_"), WATER)


def test_unknown_commune_lands_in_the_default_partition(spark, tmp_root, all_raw, geography):
    """Its rows have no département and are read back with a NULL code."""
    cfg = LayerConfig(root=tmp_root, prefix="t5_")
    res = run_medallion(spark, [all_raw], geography, cfg, WATER, enforce_gate=False)
    unknown = res.silver.filter("code_prelevement = 'E7'").collect()
    assert len(unknown) == 1 and unknown[0].code_departement is None
    year_dir = os.path.join(res.loads["silver"]["path"], "annee_prelevement=2021")
    assert "code_departement=__HIVE_DEFAULT_PARTITION__" in os.listdir(year_dir)
    assert not all(s["succes"] for s in res.summary)  # coverage share reported, not enforced
