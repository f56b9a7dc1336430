import pytest

from colscope.llm import licences
from tests.llm.common import awkward, empty

LINES = {
    "mit": "Released under the MIT License.",
    "apache": "Licensed under the Apache License, Version 2.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "cc_by_nc": "Licensed under CC BY-NC 4.0.",
    "cc_by_sa": "This page is licensed under CC BY-SA 4.0",
    "all_rights_reserved": "All rights reserved.",
    "lgpl": "Licensed under the GNU Lesser General Public License version 3",
    "bsd": "released under the BSD license",
}


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_families(spark, model):
    texts = [(k, f"Some words of a text.\n{line}\nMore words") for k, line in enumerate(LINES.values())]
    texts += [(100, "The work was in the version of the license office, under general rights"), (101, "filler " * 5000 + LINES["mit"] + " filler" * 5000), (102, LINES["mit"] + "\n" + LINES["gpl"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licences.documents(df, model).collect()}
    for k, family in enumerate(LINES):
        assert rows[k]["families"] == [family], family
        assert rows[k]["licence"] == family
    assert rows[100]["families"] == [] and rows[100]["licence"] is None
    assert rows[101]["families"] == ["mit"]
    assert rows[102]["families"] == ["gpl", "mit"]
    assert {(r["line"], r["family"]) for r in licences.scan(df.filter("doc_id < 2"), model).collect()} == {(1, "mit"), (1, "apache")}


def test_corpus_lines(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r["doc_id"], r["family"]) for r in licences.scan(docs, model).collect()}
    expected = {(r["doc_id"], f) for r in docs.collect() for f, line in LINES.items() if line in r["text"]}
    assert found == expected


def test_awkward_rows(spark, model):
    docs = awkward(spark)
    rows = licences.documents(docs, model).collect()
    assert len(rows) == docs.count() and not any(r["families"] for r in rows)
    assert licences.documents(empty(spark), model).collect() == []
    assert licences.train(empty(spark)).families[-1] == licences.UNKNOWN


def test_broken_lines_and_several_families(spark, model):
    bsd = "Redistribution and use in source and binary forms, with or without modification,\n# are permitted provided that the following conditions are met:"
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files"
    gap = "Licensed under the GNU\n\nAffero words. Licensed under the\n \t\nApache"
    rows = [(0, "Some text.\n\n# " + bsd + "\n\nmore"), (1, "x\n" + mit), (2, LINES["mit"] + " " + LINES["apache"]), (3, bsd + "\n" + mit), (4, gap), (5, LINES["lgpl"] + ". " + LINES["cc_by_nc"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["line"], r["family"]) for r in licences.scan(df, model).collect())
    assert found == [(0, 2, "bsd"), (1, 1, "mit"), (2, 0, "apache"), (2, 0, "mit"), (3, 0, "bsd"), (3, 2, "mit"), (5, 0, "cc_by_nc"), (5, 0, "lgpl")]
