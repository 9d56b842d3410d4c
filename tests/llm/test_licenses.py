import random
import re

from quarry.llm import licenses


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_rules_are_many_and_gated():
    assert len(licenses.rules()) > 250
    for r in licenses.rules():
        assert any(len(w) > 1 for w in r.keyword.split())


def test_base_against_brute_force():
    r = random.Random(1)
    words = ["MIT", "license", "Apache", "general", "public", "License", "mit-license", "é", "mit", "x{y", "İ", "K", "\n"]
    for _ in range(500):
        text = "".join(r.choice(words) + r.choice([" ", "\n", "-", ", ", "", "_"]) for _ in range(r.randrange(30)))
        assert licenses.scan(text)[:5] == brute(text), text


def labels(text):
    return licenses.scan(text)[5]


def test_signatures():
    assert labels("# SPDX-License-Identifier: MIT") == "mit"
    assert labels("// SPDX-License-Identifier: GPL-2.0-or-later\n") == "gpl-2.0-or-later"
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert labels("This text is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("GNU Lesser General Public License v2.1") == "gpl,lgpl-2.1"
    assert labels("Released under the MIT License.") == "mit"
    assert labels("see https://creativecommons.org/licenses/by-sa/4.0/") == "cc-by-sa-4.0"
    assert labels("under the 3-clause BSD license") == "bsd-3-clause"
    assert labels("Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated") == "mit"
    assert labels("the limit licensee was apache helicopters in public") == ""


def test_containment():
    spans = licenses.scan("the GNU Affero General Public License, version 3 here")[7]
    assert spans.count(":") == 2 and spans.startswith("agpl-3.0:")


def test_gate_and_priority_against_brute_force():
    """Rules behind keywords find what all rules find, and what stays is what pairwise comparison by priority leaves."""
    r = random.Random(3)
    pieces = ["gnu lesser general public license v2.1", "gnu affero general public license", "version 3", "licensed under the apache license, version 2.0", "mit license", "the mit", "spdx-license-identifier: gpl-2.0-or-later", "bsd", "3-clause bsd license", "permission is hereby granted, free of charge, to any person obtaining a copy", "creativecommons.org/licenses/by-sa/4.0/", "mozilla public license 2.0", "or", "\n", ", ", "x"]
    for _ in range(150):
        text = " ".join(r.choice(pieces) for _ in range(r.randrange(14)))
        every = licenses.candidates(text, gated=False)
        key = lambda d: (-d[2].strength, d[0] - d[1], d[2].order, d[0])
        assert sorted(licenses.candidates(text), key=key) == sorted(every, key=key)
        stay = []
        for d in sorted(every, key=key):
            if all(d[1] <= x[0] or x[1] <= d[0] for x in stay):
                stay.append(d)
        assert licenses.detections(text) == sorted(stay, key=lambda d: d[0])


def test_rows(spark):
    texts = [None, "", "mit license", "mit license", "x " * 300_000 + "MIT License", "license " * 20_000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i])[1:6] == brute(t)
    assert rows[0].labels == "" and rows[0].score == 0 and rows[0].first_word is None and rows[2].score == 1
    assert licenses.scan_licenses(frame.limit(0)).count() == 0
