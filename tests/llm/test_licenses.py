import random
import re

import pytest

from tessera.llm import licenses
from tessera.llm.license_rules import rules

PHRASES = [(("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")]


def base(text):
    """The contract's base columns, word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for i in range(len(words)) for phrase, label in PHRASES if tuple(words[i:i + len(phrase)]) == phrase]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def columns(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_base_columns_of_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = licenses.op13_license_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert columns(r) == base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")


def scan(text):
    n, found = licenses.Scanner().scan(text.encode())
    return sorted({d["label"] for d in found if d["kept"]} | {d["label"] for d in found if d["kind"] == "base"})


def test_prefilter_loses_nothing_and_resolution_is_containment():
    scanner, all_rules = licenses.Scanner(), rules()
    assert len(all_rules) > 300
    rng = random.Random(4)
    parts = ["Licensed under CC BY-NC 4.0.", "GNU Lesser General Public License, version 2.1", "All rights reserved.", "the Apache License, Version 2.0", "MIT license",
             "SPDX-License-Identifier: MIT", "Redistribution and use in source and binary forms, with or without modification, are permitted", "cc by", "words and words",
             "Copyright (c) 2020", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
             "(at your option) any later version", "public domain", "https://creativecommons.org/licenses/by-sa/4.0/", "mit dem Hund"]
    for _ in range(200):
        raw = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))).encode()
        n, found = scanner.detections(raw)
        text = b" " + b" ".join(raw.translate(licenses._WORDS).split()) + b" "
        want = [(i, text.count(b" ", 0, m.start()), text.count(b" ", 0, m.end()) - 1) for i, r in enumerate(all_rules) for m in r.pattern.finditer(text)]
        assert [x[:3] for x in found] == want  # the keyword prefilter never hides a match
        keep = scanner.resolve(found)
        kept = [f for f, k in zip(found, keep) if k]
        for f, k in zip(found, keep):  # a span goes exactly if a kept one of its priority or above covers it
            p = all_rules[f[0]].priority
            others = [g for g in kept if g is not f and all_rules[g[0]].priority >= p and g[1] <= f[1] and g[2] >= f[2]]
            assert k == (not others) or k is False and others


@pytest.mark.parametrize("text, want", [
    ("", []), ("no statement here", []), ("mit dem Hund", []),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl", "gpl-3.0"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by", "cc-by-nc-4.0"]),
    ("Released under the MIT License.", ["mit"]),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ["apache-2.0"]),
    ("GNU Lesser General Public License v2.1", ["gpl", "lgpl-2.1"]),
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
     ["gpl", "gpl-2.0-or-later"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]), ("see http://www.apache.org/licenses/LICENSE-2.0", ["apache-2.0"]),
    ("Copyright (C) 2021 Someone. All rights reserved.", ["copyright", "reserved"]), ("Alle Rechte vorbehalten.", ["reserved"]),
    ("Tous droits réservés", ["reserved"]), ("Creative Commons Attribution-ShareAlike 4.0 International License", ["cc-by-sa-4.0"]),
    ("the Mozilla Public License, v. 2.0", ["mpl-2.0"]), ("under the BSD license", ["bsd"]), ("SPDX-License-Identifier: GPL-3.0-only", ["gpl-3.0"])])
def test_labels(text, want):
    assert scan(text) == want


def test_odd_rows(spark, odd_documents):
    got = {}
    for r in licenses.op13_license_rules(odd_documents).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[6]) == 2 and got[None][0]["n_words"] == 13
    assert columns(got[1][0]) == columns(got[2][0]) == (0, 0, None, None, "") and got[1][0]["labels"] == "" and got[1][0]["score"] == 0
    assert got[3][0]["n_words"] == 60_000 and got[7][0]["n_words"] == 3
    assert licenses.op13_license_rules(odd_documents.where("false")).collect() == []
    rows = [(1, "ALL RIGHTS\x00reserved cc-by, CC\tBY! cc éby all rights réserved general public\nlicense", "x", 3),
            (2, "filler " * 300_000 + "all rights reserved " + "filler " * 300_000 + "cc by", "y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, detections string, N_WORDS int")
    for r in licenses.op13_license_rules(df).collect():
        assert columns(r) == base(dict((i, t) for i, t, *_ in rows)[r["doc_id"]])
    spans = licenses.detect(df)
    assert spans.columns == ["doc_id", "text", "n_words", "detections"]
    first = {d["label"]: (d["first"], d["last"]) for d in spans.where("doc_id = 2").first()["detections"]}
    assert first["reserved"] == (300_000, 300_002) and first["cc-by"] == (600_003, 600_004)
