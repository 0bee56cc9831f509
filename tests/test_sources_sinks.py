"""Landed pages, CSV dimensions, table writes, publication."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.plans.layers import bronze
from strata.session import checkpoint_root, scratch_dir
from strata.sources.csv import read_csv_dimension, write_csv
from strata.sources.pages import PageChainError, chain_problems, read_links, read_pages, verify_chain, write_pages
from strata.sources.sinks import (
    build_version,
    materialize,
    materialize_buckets,
    publish_table,
    published_partitions,
    read_stored,
    replace_load,
    switch_version,
    write_table,
)
from strata.sources.tables import (
    SchemaDriftError,
    describe,
    find_columns,
    has_columns,
    read_declared,
    schema_inventory,
)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_landed_api_pages(spark, tmp_root):
    """Envelopes as an API returns them: one pretty-printed document a file."""
    schema = StructType.fromDDL("code_prelevement string, code_commune string, resultat_numerique string")
    pages = [
        [{"code_prelevement": "P1", "code_commune": "01004", "resultat_numerique": "1,5"}],
        [{"code_prelevement": "P2", "code_commune": "33063", "resultat_numerique": "7"},
         {"code_prelevement": "P3", "code_commune": None, "resultat_numerique": None}],
        [],
        [{"code_prelevement": "P4", "code_commune": "2A004", "resultat_numerique": "0"}],
    ]
    for n, records in enumerate(pages):
        nxt = f"https://api.example/resultats?page={n + 1}" if n + 1 < len(pages) else None
        with open(os.path.join(tmp_root, f"body-{n}.json"), "w") as fh:
            json.dump({"data": records, "next": nxt}, fh, indent=2)
    recs = read_pages(spark, tmp_root, schema, multi_line=True)
    assert sorted(r.code_prelevement for r in recs.collect()) == ["P1", "P2", "P3", "P4"]
    # codes keep leading zeros, values stay text
    assert recs.filter("code_prelevement = 'P1'").first().code_commune == "01004"
    one = read_pages(spark, tmp_root, schema, multi_line=True, where=F.col("code_commune") == "33063")
    assert [r.code_prelevement for r in one.collect()] == ["P2"]


def _events(spark, n=23):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 8).cast("int"))
    return spark.range(0, n).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("v"), day.alias("d"))


def test_pages_round_trip_and_prune_by_day(spark, tmp_root):
    df = _events(spark)
    write_pages(df, tmp_root, 10, "seq", F.col("d"))
    lines = [json.loads(x) for d, _, fs in os.walk(tmp_root) for f in fs if f.endswith(".json") for x in open(os.path.join(d, f))]
    # page 0 holds ids 0-9: eight of the first day, two of the second
    assert sorted((p["page"], len(p["data"]), p.get("next")) for p in lines) == [
        (0, 2, "page=1"), (0, 8, "page=1"), (1, 4, "page=2"), (1, 6, "page=2"), (2, 3, None),
    ]
    assert sorted(map(tuple, read_pages(spark, tmp_root, df.schema).collect())) == sorted(map(tuple, df.collect()))
    late = read_pages(spark, tmp_root, df.schema, since=dt.date(2024, 1, 2))
    assert sorted(r.seq for r in late.collect()) == list(range(8, 23))
    assert "PartitionFilters: [isnotnull(jour" in _plan(late)
    # the number of files follows the days, not the pages
    assert sum(f.endswith(".json") for _, _, fs in os.walk(tmp_root) for f in fs) == 3


def test_compressed_pages_come_back_whole(spark, tmp_root):
    df = _events(spark)
    write_pages(df, tmp_root, 10, "seq", F.col("d"), compression="gzip")
    files = [f for _, _, fs in os.walk(tmp_root) for f in fs if f.startswith("part-")]
    assert len(files) == 3 and all(f.endswith(".json.gz") for f in files)
    assert sorted(map(tuple, read_pages(spark, tmp_root, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_a_clustered_table_is_written_as_it_is_read(spark, tmp_root):
    """Months inside years: each scan task writes its own file, nothing is shuffled together."""
    months = spark.range(0, 4, 1, 4).select((F.col("id") % 2).alias("year"), F.col("id").alias("month"))
    report = write_table(months, tmp_root, ["year"], clustered=True)
    assert report["rows_written"] == 4
    back = read_stored(months, tmp_root).select("year", "month")
    assert sorted(map(tuple, back.collect())) == [(0, 0), (0, 2), (1, 1), (1, 3)]
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(tmp_root) for f in fs) == 4


def test_a_repeated_page_id_raises(spark, tmp_root):
    df = _events(spark)
    with pytest.raises(Exception, match="not unique"):
        write_pages(df.union(df), tmp_root, 8, "seq", F.col("d"))


def test_csv_dimension_all_strings(spark, tmp_root):
    df = spark.createDataFrame([("01004", "Ambérieu", "01"), ("2A004", "Ajaccio", "2A")], "COM string, LIBELLE string, DEP string")
    write_csv(df, tmp_root)
    back = read_csv_dimension(spark, tmp_root)
    assert back.columns == ["com", "libelle", "dep"]
    assert all(t == "string" for _, t in back.dtypes)
    assert sorted(r.com for r in back.collect()) == ["01004", "2A004"]
    fixed = read_csv_dimension(spark, tmp_root, columns=["COM", "LIBELLE", "DEP"])
    assert fixed.columns == ["com", "libelle", "dep"] and fixed.count() == 2


def test_declared_reads_reject_drifted_files(spark, tmp_root):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(tmp_root + "/t")
    assert read_declared(spark, tmp_root + "/t", "k int").columns == ["k"]
    with pytest.raises(SchemaDriftError, match="w: string declared, absent"):
        read_declared(spark, spark.read.parquet(tmp_root + "/t").inputFiles()[0], "k int, w string")
    with pytest.raises(SchemaDriftError, match="k: bigint declared, int"):
        read_declared(spark, tmp_root + "/t/", "k bigint")


def test_write_table_partitioned_and_report(spark, tmp_root, sample_raw):
    b = bronze(sample_raw).drop("_ingested_at")
    report = write_table(b, tmp_root, ["annee_prelevement"])
    assert report["rows_written"] == 9
    assert os.path.isdir(os.path.join(tmp_root, "annee_prelevement=2022"))
    stored = read_stored(b, tmp_root).filter("annee_prelevement = 2022")
    assert "PartitionFilters: [isnotnull(annee_prelevement" in _plan(stored)
    assert stored.count() == 6


def _scanned_rows(df) -> int:
    """Rows that the file scan of ``df`` put out, after row groups were skipped."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan parquet"):
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("partition_by", [(), ("p",)])
def test_rows_stored_in_order_let_row_groups_be_skipped(spark, tmp_root, partition_by):
    rows = spark.range(200_000).selectExpr("pmod(xxhash64(id), 100000) AS v", "id % 2 AS p", "repeat(cast(xxhash64(id, 1) AS string), 4) AS pad")
    options = {"parquet.block.size": "65536", "parquet.page.row.count.limit": "1000"}
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        write_table(rows, tmp_root + "/sorted", partition_by, order_by=["v"])
        write_table(rows, tmp_root + "/plain", partition_by)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    few = {n: read_stored(rows, f"{tmp_root}/{n}").filter("v < 500").select("v") for n in ("sorted", "plain")}
    assert few["sorted"].count() == few["plain"].count() > 0
    assert _scanned_rows(few["sorted"]) < 30_000 < _scanned_rows(few["plain"])
    if not partition_by:
        stored = [r.v for r in read_stored(rows, tmp_root + "/sorted").collect()]
        assert sorted(stored) == sorted(r.v for r in rows.select("v").collect())


def test_replace_load_replaces_all_rows(spark, tmp_root, sample_raw, edge_raw):
    assert replace_load(sample_raw, tmp_root)["rows_written"] == 9
    assert replace_load(edge_raw, tmp_root)["rows_written"] == 7
    assert read_stored(edge_raw, tmp_root).count() == 7


def test_published_table_switches_to_the_complete_new_one(spark, tmp_root, sample_raw, edge_raw):
    for n, df in enumerate((sample_raw, edge_raw)):
        df = df.select("code_prelevement", "code_commune")
        write_table(df, f"{tmp_root}/{n}", ["code_commune"])
        publish_table(spark, "resultats_publies", df, f"{tmp_root}/{n}", "code_commune")
        assert spark.table("resultats_publies").count() == df.count()
    assert spark.table("resultats_publies").filter("code_commune = '00000'").count() == 1
    assert read_stored(df, f"{tmp_root}/0").count() == 9  # what readers of the old one still see


def test_readers_see_a_whole_table_while_the_next_one_is_built(spark, tmp_root):
    """A publication that is interrupted before the switch leaves the name as it was."""
    write = lambda n, rows: write_table(spark.createDataFrame(rows, "v string, an int"), f"{tmp_root}/{n}", ["an"])
    frame = lambda n: spark.read.schema("v string, an int").parquet(f"{tmp_root}/{n}")
    write(0, [("a", 2021), ("b", 2022), ("c", 2023)])
    publish_table(spark, "suivi", frame(0), f"{tmp_root}/0", "an")
    reader = spark.table("suivi")
    write(1, [("B", 2022), ("D", 2024)])
    built = build_version(spark, "suivi", frame(1), f"{tmp_root}/1", "an")  # ... and the process ends here
    assert spark.table("suivi").count() == 3
    spark.sql(f"DROP TABLE {built}")
    # a later publication keeps the partitions that did not change where they are
    kept = {v: p for v, p in published_partitions(spark, "suivi", "an").items() if v == 2021}
    switch_version(spark, "suivi", build_version(spark, "suivi", frame(1), f"{tmp_root}/1", "an", kept))
    assert sorted(r.v for r in spark.table("suivi").collect()) == ["B", "D", "a"]
    assert reader.count() == 3  # began with the version before
    assert "/0/an=2021" in published_partitions(spark, "suivi", "an")[2021]
    assert "PartitionFilters: [isnotnull(an" in _plan(spark.table("suivi").filter("an = 2024"))
    # the version before the last goes from the catalog
    versions = lambda: sorted(t.name for t in spark.catalog.listTables() if t.name.startswith("suivi__"))
    first = versions()
    publish_table(spark, "suivi", frame(0), f"{tmp_root}/0", "an")
    assert len(versions()) == len(first) == 2 and spark.table("suivi").count() == 3


def test_a_whole_chain_has_no_problem_and_a_lost_page_is_found(spark, tmp_root):
    df = _events(spark, 60)
    write_pages(df, tmp_root, 5, "seq", F.col("d"))
    links = read_links(spark, tmp_root).cache()
    assert chain_problems(links).count() == 0
    verify_chain(links)
    problems = lambda frame: sorted(map(tuple, chain_problems(frame).collect()))
    assert problems(links.filter("page <> 4")) == [("page absente", 4, 1), ("page sans lien", 5, 1)]
    # of a gap of several pages its first page and the page behind it show
    assert problems(links.filter("page NOT IN (0, 7, 8, 9)")) == [
        ("page absente", 0, 1), ("page absente", 7, 1), ("page sans lien", 1, 1), ("page sans lien", 10, 1),
    ]
    assert problems(links.filter("page < 11")) == [("page absente", 11, 1)]  # cut off at the end
    assert problems(links.union(links.filter("page = 2").limit(1)))[0][:2] == ("page repetee", 2)
    with pytest.raises(PageChainError, match=r"page absente 4 \(1\); page sans lien 5"):
        verify_chain(links.filter("page <> 4"))


def test_links_that_name_no_page_or_two(spark):
    rows = [(None, 0, "page=1"), (None, 1, "next?2"), (dt.date(2024, 1, 1), 2, "page=3"), (None, 2, "page=4"), (None, 3, None), (None, 4, None)]
    links = spark.createDataFrame(rows, "jour date, page bigint, next string")
    got = sorted(map(tuple, chain_problems(links).collect()))
    assert got == [("lien illisible", 1, 1), ("liens differents", 2, 2), ("page sans lien", 2, 1)]
    assert chain_problems(links.limit(0)).collect()[0]["probleme"] == "page absente"


def test_pages_without_a_record_keep_the_chain_whole(spark, tmp_root):
    df = _events(spark, 60).filter("seq < 12 OR seq >= 40")
    write_pages(df, tmp_root, 5, "seq", F.col("d"))
    verify_chain(read_links(spark, tmp_root))
    assert read_pages(spark, tmp_root, df.schema).count() == 32


def test_inventory_and_columns(spark, sample_raw):
    inv = {r.nom_table: (r.nb_lignes, r.nb_colonnes) for r in schema_inventory({"r": sample_raw}).collect()}
    assert inv == {"r": (9, 13)}
    assert find_columns(sample_raw, "COMMUNE") == ["code_commune"]
    assert has_columns(sample_raw, ["code_commune", "nom_commune"]) == ["code_commune"]
    assert describe(spark, sample_raw).count() == 13


def test_scratch_dirs_under_checkpoint_root(spark):
    root = checkpoint_root(spark)
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)


def test_materialize_cuts_lineage_in_shared_folder(spark, sample_raw):
    m = materialize(sample_raw.filter("conformite_limites_bact_prelevement = 'N'"))
    assert m.count() == 1
    files = m.inputFiles()
    assert files and all(checkpoint_root(spark).split("://")[-1] in f for f in files)
    assert "FileScan parquet" in _plan(m.select("code_prelevement"))


def test_pages_of_rows_stored_in_buckets_need_no_exchange(spark, tmp_root):
    days = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int"))
    rows = spark.range(100).select(F.col("id").alias("seq"), days.alias("d"), F.floor(F.col("id") / 20).alias("lot"))
    stored = materialize_buckets(rows, "lot")
    grouped = stored.groupBy("d", "lot", "seq").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    plain = rows.drop("lot")
    write_pages(plain, f"{tmp_root}/plain", 10, "seq", F.col("d"))
    write_pages(stored, f"{tmp_root}/stored", 10, "seq", F.col("d"), stored_by="lot")
    read = lambda path: sorted(map(tuple, read_pages(spark, path, plain.schema).collect()))
    assert read(f"{tmp_root}/stored") == read(f"{tmp_root}/plain") == sorted(map(tuple, plain.collect()))
    links = [sorted(map(str, read_links(spark, f"{tmp_root}/{path}").collect())) for path in ("plain", "stored")]
    assert links[0] == links[1]
    verify_chain(read_links(spark, f"{tmp_root}/stored"))
