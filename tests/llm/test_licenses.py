import re
from collections import Counter

import pytest

from flowsift.llm.licenses import DECOYS, TEMPLATES, UNKNOWN, cue_words, licence_notices, vocabulary
from tests.llm.conftest import SCHEMA, prose

LINES = {
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "All rights reserved.": "proprietary",
    "Licensed under CC BY-NC 4.0.": "cc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
}


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(i, "\n".join([prose(20, i), line, prose(20, i + 1)]), "en", "h", 0) for i, line in enumerate(LINES)]
    rows += [(100 + i, f"{prose(10, i)}\n{d}\n{' '.join(reversed(d.split()))}", "en", "h", 0) for i, d in enumerate(DECOYS)]
    rows += [(200, None, None, None, None), (201, "", None, None, None), (202, "Released under the MIT License.\n" * 3, None, None, None), (None, "ALL RIGHTS RESERVED", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_planted_notices(planted):
    rows = licence_notices(planted).collect()
    found = {r.doc_id: r.licence for r in rows if r.doc_id is not None and r.doc_id < 100}
    assert found == dict(enumerate(LINES.values()))
    assert all(r.paragraph == 1 for r in rows if r.doc_id is not None and r.doc_id < 100)
    assert all(r.licence == UNKNOWN for r in rows if r.doc_id is not None and 100 <= r.doc_id < 200)
    assert Counter(r.licence for r in rows if r.doc_id == 202) == {"mit": 3}
    assert [r.licence for r in rows if r.doc_id is None] == ["proprietary"]


def test_documents(documents):
    wanted = Counter()
    for d in documents.collect():
        for n, line in enumerate(d.text.split("\n")):
            if line in LINES:
                wanted[d.doc_id, n, LINES[line]] += 1
    rows = licence_notices(documents)
    assert Counter((r.doc_id, r.paragraph, r.licence) for r in rows.collect() if r.licence != UNKNOWN) == wanted
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_features_need_a_cue_word():
    cues = set(cue_words())
    assert all(cues & set(g.split()) for g in vocabulary(3))
    assert all(re.fullmatch(r"[^A-Z]+", t) for texts in TEMPLATES.values() for t in texts)


def test_odd_documents(odd_documents, empty_documents):
    assert licence_notices(odd_documents).count() == 0
    assert licence_notices(empty_documents).count() == 0


WRAPPED = {
    "gpl": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."],
    "mit": ["Permission is hereby granted, free of charge, to any person", "obtaining a copy of this software and associated documentation files", '(the "Software"), to deal in the Software without restriction'],
    "bsd": ["Redistribution and use in source and binary forms, with or", "without modification, are permitted provided that the following", "conditions are met:"],
    "mpl": ["This Source Code Form is subject to the terms of the", "Mozilla Public License, v. 2.0. If a copy of the MPL was not", "distributed with this file, You can obtain one there."],
}
AGPL = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU Affero General Public License as", "published by the Free Software Foundation."]


def test_wrapped_notices(spark):
    cases = [*WRAPPED.items(), ("gpl", AGPL)]
    rows, wanted = [], Counter()
    for i, (family, lines) in enumerate(cases):
        for j, mark in enumerate(("", " * ", "# ", "// ", "-- ")):
            above = [prose(12, i), "", prose(9, j)] if j % 2 else [prose(12, i), ""]
            rows.append((10 * i + j, "\n".join([*above, *(mark + x for x in lines), "", prose(8, i)]), "en", "h", 0))
            wanted[10 * i + j, len(above), family] += 1
    found = licence_notices(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.paragraph, r.licence) for r in found if r.licence != UNKNOWN) == wanted


PROBES = {
    "MIT License": "mit", "License: MIT": "mit", "BSD 3-Clause License": "bsd", "Apache License\nVersion 2.0, January 2004": "apache",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3": "gpl", "SPDX-License-Identifier: GPL-2.0-only": "gpl", "SPDX-License-Identifier: LGPL-2.1": "gpl",
    "Apache-2.0": "apache", "ISC License": "isc", "Eclipse Public License - v 2.0": "epl", "The zlib License": "zlib",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "mit",
    "\n".join("redistribute it and/or modify it under the terms of the GNU General Public License".split()): "gpl",
}


def test_headings_identifiers_and_a_word_a_line(spark):
    rows = [(i, f"{prose(12, i)}\n\n{text}\n\n{prose(9, i)}", "en", "h", 0) for i, text in enumerate(PROBES)]
    found = licence_notices(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.paragraph, r.licence) for r in found if r.licence != UNKNOWN) == {(i, 2, f): 1 for i, f in enumerate(PROBES.values())}
