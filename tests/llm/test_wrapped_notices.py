"""License notices wrapped over lines, side by side, and held against SQL and a plain version."""

import random
import re
from collections import Counter

import duckdb
import pytest

NOTICES = {
    "apache-2": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee",
    "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software",
    "unlicense": "This is free and unencumbered software\nreleased into the public domain.",
    "lgpl-3": "This work is licensed under the GNU Lesser General Public License, version 3",
    "gpl-3": "This work is licensed under the GNU General\nPublic License version 3",
    "gpl-2": "This work is licensed under the GNU General\nPublic License version 2",
    "cc-by": "This work is licensed under\nCC BY 4.0",
    "cc-by-nc": "This work is licensed under CC BY\nNC 4.0",
    "cc-by-sa": "This work is licensed under CC BY SA 4.0",
    "cc0": "Dedicated to the public domain under CC0 1.0 Universal",
}


def scanned(spark, rows):
    from ctxspark.llm.licenses import scan

    return scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))


def test_notices_across_line_feeds(spark):
    rows = [(i, pad + t + "\n" + pad) for i, (t, pad) in enumerate((t, pad) for t in NOTICES.values() for pad in ("", "word " * 50 + "\n", "w\n" * 47))]
    rows += [(100, "\n".join(["Licensed under the MIT license", "other words"] * 3)), (101, "no notice\nhere")]
    got = {r.id: r for r in scanned(spark, rows).collect()}
    assert [got[i].labels for i in range(3 * len(NOTICES))] == [k for k in NOTICES for _ in range(3)]
    assert all(got[i].score >= 0.85 for i in range(3 * len(NOTICES)))
    assert got[100].labels == "mit" and (got[101].labels, got[101].score) == ("", 0.0)


def test_every_notice_of_a_block_is_found(spark):
    pairs = [("cc0", "unlicense"), ("mit", "bsd"), ("gpl-3", "mpl-2"), ("isc", "cc-by-sa")]
    rows = [(i, NOTICES[a] + sep + NOTICES[b].replace("free and", "free")) for i, (a, b, sep) in enumerate((a, b, sep) for a, b in pairs for sep in (" ", "\n"))]
    got = {r.id: r.labels for r in scanned(spark, rows).collect()}
    assert [got[i] for i in range(len(rows))] == [",".join(sorted(p)) for p in pairs for _ in range(2)]


def test_only_ascii_letters_are_folded(spark):
    kelvin = NOTICES["gpl-3"].replace("work", "worK")  # lowered by Unicode, not by the fold
    words = kelvin.lower().split()
    got = {r.id: r for r in scanned(spark, [(1, kelvin), (2, "Kİ UNDER the MIT License"), (3, "theİ mit license")]).collect()}
    assert got[1].n_words == len(words) and got[1].score == pytest.approx(11 / 12) and got[2].n_base == 1 and got[2].first_word == 1 and got[3].n_words == 3


def plain(text):
    """(labels, score) by blocks of words, with sets."""
    from ctxspark.llm.licenses import PHRASES, TEMPLATES

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, best = set(), 0.0
    for a in range(0, max(len(w) - 19, 0) + 1, 6):
        block = set(w[a : a + 24])
        near = [(k, label, set(t.split()) & block, len(set(t.split()) & block) / len(set(t.split()))) for k, (t, label) in enumerate(TEMPLATES)]
        near = [x for x in near if x[3] >= 0.85 - 1e-9]
        kept = [x for x in near if not any(x[0] != y[0] and x[2] <= y[2] and (len(y[2]) > len(x[2]) or y[3] > x[3]) for y in near)]
        labels |= {x[1] for x in kept}
        best = max([best, *(x[3] for x in kept)])
    base = {label for p, label in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
    return ",".join(sorted(labels | base)), 1.0 if base else best


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(5)
    rows = []
    for i in range(400):
        words = []
        for _ in range(r.randrange(4)):
            words += [r.choice("lorem ipsum dolor the of license a version 2 under".split()) for _ in range(r.randrange(90))]
            notice = re.split(r"([\s]+)", r.choice(list(NOTICES.values())))
            words += [x for x in notice if r.random() > 0.06]
        rows.append((i, r.choice(["\n", " "]).join(x for x in words if x.strip())))
    return [*rows, (500, ""), (501, None)]


def test_blocks_against_a_plain_version(spark, mixed):
    got = {r.id: (r.labels, r.score) for r in scanned(spark, mixed).collect()}
    want = {i: plain(t) for i, t in mixed}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()} and all(got[i][1] == pytest.approx(want[i][1]) for i in want)
    assert len({x for x, _ in want.values()}) > 20


def test_blocks_against_sql(spark, mixed):
    import pandas as pd

    from ctxspark.llm.queries import ORACLES

    con = duckdb.connect()
    con.register("rows", pd.DataFrame(mixed, columns=["doc_id", "text"]))
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM rows")
    cells = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5], r[6], round(r[7], 9))
    columns = "n_words, n_base, first_word, last_word, base_labels, labels, score"
    want = Counter(map(cells, con.execute(f"SELECT doc_id, {columns} FROM ({ORACLES['op3_license_scan']})").fetchall()))
    assert Counter(cells(tuple(r)) for r in scanned(spark, mixed).select("id", *columns.split(", ")).collect()) == want


def test_rows_that_share_an_id_are_told_apart(spark):
    got = Counter((r.id, r.labels) for r in scanned(spark, [(7, NOTICES["bsd"]), (7, NOTICES["isc"]), (None, NOTICES["cc0"]), (None, "x"), (7, None)]).collect())
    assert got == Counter([(7, "bsd"), (7, "isc"), (None, "cc0"), (None, ""), (7, "")])
