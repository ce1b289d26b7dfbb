"""Owner lines and titles as files have them, and what must not be taken for one."""
from __future__ import annotations

import pytest

from rebuff.llm import licenses
from tests.llm.test_operators import EDGE, frame

TEXTS = {n: t for n, t in licenses.KNOWN[:5]}
HEADS = ["", "Copyright (c) 2020 X\n\n", "Copyright (c) Facebook, Inc. and its affiliates.\n\n", "Copyright The Project Authors\n\n", "Copyright (c) Microsoft Corporation.\n\n",
         "Copyright (c) 2019 Y\nCopyright Contributors\n\n", "The MIT License\n\nCopyright © 2001-2003 by Z. All rights reserved.\n\n", "MIT License (MIT)\n\n(c) 2020 W\n\n"]


def wrapped(text, width):
    """The text with its lines broken at every place, so that some begin with the word copyright."""
    out, line = [], ""
    for word in text.split(" "):
        if len(line) + len(word) > width:
            out.append(line)
            line = ""
        line += word + " "
    return "\n".join([*out, line])


def test_owner_lines_and_titles(spark):
    rows = [(k, head + TEXTS["MIT"]) for k, head in enumerate(HEADS)]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == {k: "MIT" for k in range(len(HEADS))}


@pytest.mark.parametrize("name", list(TEXTS))
def test_wrapped_texts(spark, name):
    rows = [(w, "Copyright Contributors\n\n" + wrapped(TEXTS[name], w)) for w in range(30, 90, 7)] + [(1, TEXTS[name][:-40]), (2, TEXTS[name] + " more")]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == {w: name for w in range(30, 90, 7)} | {1: None, 2: None}


def test_cases(spark):
    long = "word " * 200_000 + TEXTS["MIT"]
    rows = [(7, long), (8, "Copyright Contributors"), (8, "Copyright Contributors"), (9, TEXTS["ISC"]), (9, TEXTS["ISC"]), *EDGE]
    got = licenses.scan(frame(spark, rows), licenses.known_licenses(spark)).collect()
    of = {(r.doc_id, r.license) for r in got}
    assert (7, None) in of and (8, None) in of and (9, "ISC") in of
    assert licenses.scan(frame(spark, []), licenses.known_licenses(spark)).count() == 0
