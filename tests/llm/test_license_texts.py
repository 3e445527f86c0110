"""Whole texts of common licences are known to the licence scan."""

from pathlib import Path

import pytest

from rankweave.llm import license_scan

GIVEN = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not GIVEN.exists(), reason="no licence texts on this machine")
def test_whole_texts_are_known(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {name: (GIVEN / file).read_text() for file, name in names.items()}
    texts |= {"BSD-2-Clause": f"Copyright (c) 2020 X\n\n{license_scan.BSD_HEAD}\n{license_scan.BSD_WARRANTY}", "Unlicense": license_scan.UNLICENSE.lower()}
    rows = [*((k, v.replace(" ", "  ")) for k, v in texts.items()), ("cut", texts["Apache-2.0"].split("APPENDIX")[0]), ("part", texts["MPL-2.0"][:3000])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["id"]: r["license"] for r in license_scan.scan_licenses(docs, license_scan.known_digests(spark)).collect()}
    assert got == {**{k: k for k in texts}, "cut": "Apache-2.0", "part": None}


def test_copyright_lines_in_comments_and_without_a_year(spark):
    mit = license_scan.KNOWN[0][2]
    heads = ["# Copyright (c) 2020 X", " * Copyright 2020 X", "// (c) X", "Copyright Acme Inc.", ";; copyright by Jane Doe", "-- Copyright The Tool Authors", "# All rights reserved.", "Copyright Notice Systems Ltd", "All rights reserved.\r"]
    rows = [(i, f"{h}\n{mit}") for i, h in enumerate(heads)]
    rows += [(100, "\n".join(f"# {x}" for x in [heads[3], *mit.split("\n")]))]
    rows += [(101, "Copyright Acme Inc. and then a sentence which runs on for far longer than the name of any holder would\n" + mit)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["license"] for r in license_scan.scan_licenses(docs, license_scan.known_digests(spark)).collect()}
    assert got == {**{i: "MIT" for i, _ in rows}, 101: None}


def test_prose_after_copyright_stays(spark):
    rows = [(i, body, body.replace(" copyright ", "\ncopyright ").replace(" COPYRIGHT ", "\nCOPYRIGHT ")) for i, (_, kind, body) in enumerate(license_scan.KNOWN) if kind == "text"]
    docs = spark.createDataFrame(rows, "i long, a string, b string")
    forms = docs.select("i", license_scan.canonical(docs["a"]).alias("a"), license_scan.canonical(docs["b"]).alias("b"))
    assert forms.where("a != b").count() == 0


def test_holders_stand_in_the_head_only(spark):
    mit = license_scan.KNOWN[1][2]
    first, rest = mit.split("\n", 1)
    rows = [(1, f"MIT License\nCopyright Acme Inc.\n\n{mit}"), (2, f"{first}\nCopyright Acme Inc.\n{rest}"), (3, f"Copyright Acme Inc.\nPortions copyright Other Ltd\nSome project\n\n{mit}")]
    got = {r["id"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.known_digests(spark)).collect()}
    assert got == {1: "MIT", 2: None, 3: None}  # a line in the body is part of the text, and so is a title that no licence has
