import re

import duckdb

from termloom.llm.licences import OP3_SQL, PHRASES, op3_licences, scanned
from tests.llm.brute import lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall(lower_ascii(text or ""))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = op3_licences(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_cases(spark):
    texts = [
        None, "", "...", "Released under the MIT License.", "the terms: LICENSED Under\nthe Apache-License, version 2.0; under the mit license, under the mit license",
        "x cc-by-nc cc by é nc CC BY NC", "This work is licensed under the GNU General Public License, version 3.", "mit license", "under the mit licenseé",
        "Redistribution and use in source and binary forms, with or without modifications, are permitted provided that the following terms are met",
        "all rights reserved", "rights of all are reserved", "w " * 100_000 + "under the MIT license", "of the mit license",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as places", "'l' as labels")
    out = scanned(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        by[r.doc_id] = r
    assert [by[i].labels for i in (0, 3, 4, 6, 9, 10, 11)] == ["", "mit", "apache-2,mit", "gpl-3", "bsd", "all-rights-reserved", ""]
    assert by[6].score > 0.99 and 0.6 <= by[9].score < 1 and by[0].score == 0
    assert scanned(df.limit(0)).count() == 0


def test_notices_cut_short_reworded_and_negated(spark):
    cases = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "BSD 3-Clause License. Released under the BSD 3-Clause License": "bsd-3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl-3",
        "This program is free software: you can redistribute it or modify it under the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl-3",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "Redistributions of source code must retain the above copyright notice": "bsd",
        "the terms of the MIT license do not apply here": "",
        "they were never released under some license": "",
        "under the MIT license": "mit",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "xx " * 40_000 + "Licensed under the ISC license. " + "yy " * 40_000: "isc",
        "mit " * 5_000 + "license " * 5_000: "",
    }
    rows = list(enumerate(cases))
    out = {r.doc_id: r for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].labels for i, _ in rows] == list(cases.values())
    assert all((p.score >= 0.6) for r in out.values() for p in r.places)


def test_whole_table_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(OP3_SQL)
    got = op3_licences(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
