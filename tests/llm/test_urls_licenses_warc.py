"""URL judgement, licence sentences and WARC archives."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

import duckdb
import pytest
from cases import SF_DIR, documents
from pyspark.sql import functions as F

from strata.llm import licenses, queries, urls, warc
from strata.llm.urls import Rule

PAGES = "page_id bigint, url string, html string"


def _judged(spark, rows, outcomes=(), rules=queries.URL_RULES, **options):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], PAGES)
    for name in ("host", "id", "n", "good", "mean", "prior", "verdict"):
        pages = pages.withColumn(name, F.lit("x"))
    labels = spark.createDataFrame(list(outcomes), "page_id bigint, good int")
    return {r.page_id: r for r in urls.judge(pages, labels, rules, **options).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://Example.NET/en/x?q#f": ("example.net", "/en/x", "example.net/en/"),
        "https://blog.example.net/de/": ("blog.example.net", "/de/", "net/"),
        "http://example.net": ("example.net", "", None),  # no path: no rule's path begins it
        "http://example.net?x=/en/": ("example.net", "", None),
        "http://notexample.com/de/": ("notexample.com", "/de/", None),
        "http://a.example.com/de/1": ("a.example.com", "/de/1", "example.com/de/"),
        "ftp://x.org/fr/": ("x.org", "/fr/", "org/fr/"),
        "//x.org/fr/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "a://b.net/c://d.org/fr/": ("b.net", "/c://d.org/fr/", "net/"),
    }
    got = _judged(spark, list(cases))
    for i, (host, path, rule) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        action = {None: "allow", "net/": "block", "example.com/de/": "block"}.get(rule, "allow")
        assert got[i].verdict == action


def test_reputation_shrinks_hosts_towards_their_domain(spark):
    rows = [f"http://bad{i % 4}.spam.test/p" for i in range(80)] + [f"http://good{i % 4}.fine.test/p" for i in range(80)]
    rows += ["http://new.spam.test/", "http://new.fine.test/", "http://other.site/"]
    outcomes = [(i, 0) for i in range(80)] + [(80 + i, 1) for i in range(80)] + [(0, 1), (None, 0), (5, None)]
    got = _judged(spark, rows, outcomes)
    assert {got[i].verdict for i in range(80)} == {"block"} and {got[i].verdict for i in range(80, 160)} == {"allow"}
    # hosts without evidence inherit their domain's
    assert got[160].host_mean < 0.3 < 0.7 < got[161].host_mean
    assert got[160].host_mean < got[162].host_mean < got[161].host_mean
    # a thin record is shrunk more than a thick one
    thin = _judged(spark, [*rows, "http://thin.fine.test/"], [*outcomes, (163, 0)])
    assert got[0].host_mean < thin[163].host_mean < got[80].host_mean


def test_no_labels_and_no_pages(spark):
    assert {r.verdict for r in _judged(spark, ["http://a.b/"] * 3 + [None]).values()} == {"allow"}
    assert _judged(spark, []) == {}


def test_domains_and_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "x.y.z", "localhost", "10.1.2.3", "u@h.com:80", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    d, s = urls._levels(F.col("h"), urls.TWO_LABEL_SUFFIXES)
    got = [tuple(r) for r in df.select(d, s).collect()]
    assert got == [
        ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.z", "z"), ("localhost", "localhost"),
        ("10.1.2.3", "ip"), ("h.com", "com"), ("", ""),
    ]


def test_url_query_covers_all_pages(spark):
    got = queries.op1_urls(spark, SF_DIR).collect()
    want = duckdb.sql(f"""SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') FROM '{SF_DIR}/pages.parquet'""").fetchall()
    assert sorted((r.page_id, r.host) for r in got) == sorted(want)


#: As published, wrapped; the holder's name filled in.
BSD_3 = """Copyright (c) 2020, Jo Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_HEADER = """/*
 * Copyright 2020 Jo Doe. All rights reserved.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */"""
MIT_NOTICE = """MIT License

Copyright (c) 2020 Jo Doe

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.
"""


def test_wrapped_licence_texts_are_found_and_a_copyright_line_is_no_licence(spark):
    hashed = lambda t: "\n".join(f"# {x}".rstrip() for x in t.splitlines())
    texts = [BSD_3, hashed(BSD_3), BSD_3.split("3. ")[0], MIT_NOTICE, "Copyright Jo Doe. All rights reserved.", BSD_3.replace("\n", "\r\n")]
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in licenses.recognise(docs).collect()}
    assert got == {
        0: ("bsd-3-clause", 5), 1: ("bsd-3-clause", 5), 2: ("bsd-2-clause", 4), 3: ("mit", 2), 4: ("proprietary", 1), 5: ("bsd-3-clause", 5),
    }
    (header,) = licenses.recognise(documents(spark, [(1, APACHE_HEADER, None, None, 0)])).collect()
    assert header.licenses == "apache-2.0" and "apache-use" in header.sentence_ids


def test_licence_rules_are_ordered_sequences(spark):
    s = licenses.SENTENCES
    texts = {
        1: "Prose. Licensed under the Apache License,\n# Version 2.0.",  # goes on in the next line
        2: "Intro\nLICENSED under the apache license, version 2.0!\nMore",
        3: "\n".join([s["apache-notice-long"], "other", s["apache-use"], s["apache-copy"]]),
        4: s["bsd-source"] + " " + s["bsd-binary"],  # parts out of a rule
        5: "\n".join([s["mit-title"], "Copyright", s["mit-notice-kept"], s["gpl3-work"]]),
        6: s["gpl3-work"] + "\n" + s["mit-notice"] + "\n" + s["gpl3-work"],
        7: "nothing here",
        8: "All rights reserved",
    }
    docs = documents(spark, [(i, t, None, None, 0) for i, t in texts.items()] + [(8, texts[8], None, None, 0), (9, None, None, None, 0)])
    got = defaultdict(list)
    for r in licenses.recognise(docs).collect():
        got[r.doc_id].append((r.licenses, r.sentence_ids, r.n_sentences))
    assert 7 not in got and 9 not in got
    assert got[1] == [("apache-2.0", "apache-notice", 1)]
    assert got[2] == [("apache-2.0", "apache-notice", 1)]
    assert got[3] == [("apache-2.0", "apache-notice-long,apache-use,apache-copy", 3)]
    assert got[4] == [("", "bsd-source,bsd-binary", 2)]
    # licences are listed in the order of the rules
    assert got[5] == [("gpl-3.0,mit", "mit-title,mit-notice-kept,gpl3-work", 3)]
    assert got[6] == [("gpl-3.0,mit", "gpl3-work,mit-notice,gpl3-work", 3)]
    assert got[8] == [("proprietary", "rights-reserved", 1)] * 2
    assert licenses.recognise(documents(spark, [])).count() == 0


def test_third_bsd_clause_is_told_from_two(spark):
    two = [licenses.SENTENCES[i] for i in ("bsd-redistribute", "bsd-source", "bsd-binary")]
    three = [*two, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
             "or promote products derived from this software without specific prior written permission."]
    rows = [(1, "\n".join(two), None, None, 0), (2, "\n\n".join(three), None, None, 0)]
    got = {r.doc_id: r.licenses for r in licenses.recognise(documents(spark, rows)).collect()}
    assert got == {1: "bsd-2-clause", 2: "bsd-3-clause"}


def test_every_known_sentence_is_recognised(spark):
    rows = [(i, f"Before it.\n{s}\nAfter it.", None, None, 0) for i, s in enumerate(licenses.SENTENCES.values())]
    got = {r.doc_id: r.sentence_ids for r in licenses.recognise(documents(spark, rows)).collect()}
    assert got == dict(enumerate(licenses.SENTENCES))


def _round_trip(spark, rows, extra=True, **options):
    pages = spark.createDataFrame(rows, PAGES)
    for name in ("file", "offset", "digest", "id", "first", "kind") if extra else ():
        pages = pages.withColumn(name, F.lit("x"))
    return sorted(map(tuple, warc.round_trip(pages, **options).collect()), key=str)


def _expected(rows, least=0):
    by = defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        first = max(ids, default=None)
        copy = len(data) >= least and len(by[h or ""]) > 1 and first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if copy else "response", first if copy else None))
    return sorted(out, key=str)


FAKE = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 40\r\n\r\n"
WHOLE_FAKE = (
    warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:998>\r\nContent-Length: 24\r\n\r\n"
    "HTTP/1.1 200 OK\r\n\r\nabc\r\n" + "\r\n\r\n"
)
WARC_ROWS = [
    (1, "http://a/é", "<p>é</p>"),
    (2, "http://b/", "<p>é</p>"),
    (3, None, None),
    (4, "http://x/\r\nInjected: yes\n", ""),
    (5, "http://c/", f"before {FAKE} after"),
    (6, "http://d/", WHOLE_FAKE + "tail"),
    (7, "http://e/", warc.MAGIC),
    (8, "http://f/", "\r\n\r\n" * 3),
    (9, "http://g/", "Content-Length: 5\r\n\r\nx"),
    (10, "http://h/", WHOLE_FAKE * 3 + FAKE),
    (-11, "http://i/", "x" * 5000),
    (12, "http://j/", "WARC/1.1\nWARC/1.0\r\n"),
]


def test_round_trip_with_magic_inside_payloads(spark):
    assert _round_trip(spark, WARC_ROWS) == _expected(WARC_ROWS)


def test_round_trip_of_many_small_splits(spark):
    """Splits far smaller than records: chains run through many of them."""
    rows = WARC_ROWS + [(100 + i, f"http://k/{i}", f"page {i} {'y' * (i * 37 % 900)}" + (FAKE if i % 7 == 0 else "")) for i in range(120)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        assert _round_trip(spark, rows, extra=False) == _expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ties_null_ids_and_least_size(spark):
    rows = [(7, "a", "same"), (7, "b", "same"), (3, "c", "same"), (None, "d", "alone"), (None, "e", None), (4, "f", "")]
    got = _round_trip(spark, rows)
    kinds = sorted((r[0] is None, r[0] or 0, r[3], r[4] or 0) for r in got)
    assert kinds == [
        (False, 3, "revisit", 7), (False, 4, "response", 0), (False, 7, "response", 0), (False, 7, "response", 0),
        (True, 0, "response", 0), (True, 0, "revisit", 4),
    ]
    assert _round_trip(spark, WARC_ROWS, min_revisit_bytes=8) == _expected(WARC_ROWS, 8)
    assert _round_trip(spark, WARC_ROWS, min_revisit_bytes=9) == _expected(WARC_ROWS, 9)
    assert _round_trip(spark, []) == []


def test_warc_query_round_trips_all_pages(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF_DIR}/pages.parquet'").fetchall()
    assert sorted(map(tuple, queries.op9_warc(spark, SF_DIR).collect()), key=str) == _expected(rows)


@pytest.mark.parametrize("text", ["", "abc", "é" * 100])
def test_base32_digest(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(warc.sha1_base32(F.col("t").cast("binary"))).first()[0]
    assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_records_have_the_headers_that_other_readers_need(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/", "x" * 20), (2, "http://b.org/", "x" * 20), (3, None, None)], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), date=warc.dt.datetime(2024, 5, 6, 7, 8, 9))
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    heads = [x.split("\r\n\r\n")[0] for f in files for x in f.read_bytes().decode().split("WARC/1.1\r\n")[1:]]
    assert len(heads) == 3
    for head in heads:
        fields = dict(line.split(": ", 1) for line in head.split("\r\n"))
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
        assert fields["WARC-Date"] == "2024-05-06T07:08:09Z"
        revisit = fields["WARC-Type"] == "revisit"
        assert ("WARC-Profile" in fields) == ("WARC-Refers-To" in fields) == revisit
        assert not revisit or fields["WARC-Profile"] == warc.PROFILE
