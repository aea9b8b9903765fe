"""Whole licences, their usual headers, and what does not name one."""

import pytest

from ticktide.llm import license_scan as L

GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General
Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any
later version."""


@pytest.fixture(scope="module")
def scanner():
    return L.LicenceScanner()


def labels(scanner, text):
    return {s[0] for s in scanner.scan(L.folded_words(text.encode()))[1]}


@pytest.mark.parametrize("kind, version, label", [("", 3, "gpl-3"), ("", 2, "gpl-2"), ("Affero ", 3, "agpl-3"), ("Lesser ", 3, "lgpl-3"), ("Lesser ", 2.1, "lgpl-2.1")])
def test_usual_headers(scanner, kind, version, label):
    text = GPL_HEADER.format(kind=kind, version=version)
    assert labels(scanner, text) == {label}
    assert labels(scanner, "# some words before\n" + text.replace("\n", "\n# ") + "\n# and after") == {label}


def test_a_version_without_a_template_names_none(scanner):
    assert labels(scanner, GPL_HEADER.format(kind="", version=7)) == set()


@pytest.mark.parametrize("label", L.LICENCES)
def test_whole_texts_have_their_own_label_all_through(scanner, label):
    text = (L.files("ticktide.llm") / "licences" / f"{label}.txt").read_text("utf-8")
    words = L.folded_words(text.encode())
    spans = scanner.scan(words)[1]
    assert {s[0] for s in spans} == {label}
    covered = set()
    for _, _, start, end, _ in spans:
        covered.update(range(start, end))
    assert len(covered) >= 0.98 * len(words) - 8


def test_bsd_with_two_clauses_and_another_owner(scanner):
    text = (L.files("ticktide.llm") / "licences" / "bsd.txt").read_text("utf-8")
    head, rest = text.split("3. Neither")
    disclaimer = "THIS SOFTWARE" + rest.split("THIS SOFTWARE", 1)[1].replace("REGENTS", "COPYRIGHT HOLDERS")
    assert labels(scanner, head) == labels(scanner, disclaimer) == {"bsd"}


def test_short_notices_are_not_hidden_by_longer_headers(scanner):
    assert labels(scanner, 'Licensed under the Apache License, Version 2.0 (the "License"); you may') == {"apache-2"}
    assert labels(scanner, "Licensed under the GNU General Public License, version 3") == {"gpl-3"}


def test_table_of_texts(spark):
    docs = spark.createDataFrame([(1, GPL_HEADER.format(kind="", version=3)), (2, "nothing of the kind"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in L.license_spans(docs).collect()}
    assert got == {1: {"gpl-3"}, 2: set(), 3: set()}
