"""Broken lines are set apart and counted."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strata.sources.pages import chain_problems
from strata.sources.tolerant import RejectedLinesError, accept_csv, accept_pages, records_of

RECORD = StructType([StructField("code", StringType()), StructField("n", IntegerType())])


def _text(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_a_broken_csv_line_costs_one_row(spark, tmp_root):
    src = tmp_root + "/src"
    _text(src, "a.csv", ["COM,LIBELLE,DEP", "01004,Ambérieu,01", "33063,Bordeaux", "2A004,Ajaccio,2A", "x,y,z,w"])
    _text(src, "b.csv", ["COM,LIBELLE,DEP", '35238,"Rennes, ville",35'])
    got = accept_csv(spark, src, tmp_root + "/out", ["com", "libelle", "dep"])
    assert sorted(map(tuple, got.rows.collect())) == [("01004", "Ambérieu", "01"), ("2A004", "Ajaccio", "2A"), ("35238", "Rennes, ville", "35")]
    rejects = sorted((r.ligne, os.path.basename(r.fichier)) for r in got.rejects.collect())
    assert rejects == [("33063,Bordeaux", "a.csv"), ("x,y,z,w", "a.csv")]
    assert got.report == {"lignes": 5, "rejetees": 2}


def test_the_load_fails_beyond_the_share_and_keeps_what_it_found(spark, tmp_root):
    src = tmp_root + "/src"
    _text(src, "a.csv", ["1,a", "2", "3,c", "4,d"])
    with pytest.raises(RejectedLinesError, match="1 of 4 lines"):
        accept_csv(spark, src, tmp_root + "/out", ["k", "v"], header=False, max_share=0.2)
    assert os.path.isdir(tmp_root + "/out/_rejected=true")
    assert accept_csv(spark, src, tmp_root + "/out2", ["k", "v"], header=False, max_share=0.25).rows.count() == 3


def test_a_broken_envelope_is_named_by_the_chain(spark, tmp_root):
    src = tmp_root + "/src"
    page = lambda n, records, nxt: json.dumps({"page": n, "data": records, "next": nxt})
    _text(src, "p.json", [
        page(0, [{"code": "01", "n": 1}], "page=1"),
        page(1, [{"code": "02", "n": "many"}], "page=2"),
        page(2, [{"code": "03", "n": None}], "page=3"),
        '{"page": 3, "data": [',
    ])
    got = accept_pages(spark, src, tmp_root + "/out", RECORD)
    assert sorted(map(tuple, records_of(got.rows).collect())) == [("01", 1), ("03", None)]
    assert got.report == {"lignes": 4, "rejetees": 2} and got.rejects.count() == 2
    links = got.rows.selectExpr("cast(NULL AS date) AS jour", "page", "next")
    assert sorted(map(tuple, chain_problems(links).collect())) == [
        ("page absente", 1, 1), ("page absente", 3, 1), ("page sans lien", 2, 1),
    ]


def test_no_lines(spark, tmp_root):
    _text(tmp_root + "/src", "a.csv", ["k,v"])
    got = accept_csv(spark, tmp_root + "/src", tmp_root + "/out", ["k", "v"])
    assert got.rows.collect() == [] and got.report == {"lignes": 0, "rejetees": 0}
