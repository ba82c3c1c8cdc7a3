from __future__ import annotations

import random

from pyspark.sql import functions as F

from codeweft.llm import license_scan
from codeweft.llm.words import word_hashes


def plain(text):
    return [w for w in license_scan.bare(text.encode().split())]


def most_in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_planted_notices_are_found_with_their_spans(spark):
    r = random.Random(1)
    words = [f"tion{i}" for i in range(60)] + ["the", "license", "version", "under"]
    rows, want = [], {}
    for i in range(200):
        before = [r.choice(words) for _ in range(r.randint(0, 40))]
        after = [r.choice(words) for _ in range(r.randint(0, 40))]
        middle = []
        if i % 2:
            name = r.choice(list(license_scan.TEMPLATES))
            text = max(license_scan.TEMPLATES[name], key=len)
            middle = text.upper().split() if i % 3 else text.split()
            plain_words = [at for at, w in enumerate(text.split()) if 0 < at < 12 and not w.startswith("*")]
            if len(middle) > 12 and i % 5 == 0:
                middle[r.choice(plain_words)] = "changed"
            want[i] = (name, " ".join(middle))
        rows.append((i, " ".join(before) + "\n" + " ".join(middle) + "\n" + " ".join(after)))
    rows += [(900, None), (901, ""), (902, "the the the"), (None, "Released under the MIT License."), (903, "Licensed under nothing at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = license_scan.scan(docs).collect()
    texts = dict(rows)
    assert {(x.id, x.license) for x in got} == {(i, n) for i, (n, _) in want.items()} | {(None, "MIT")}
    for x in got:
        if x.id is not None:
            assert plain(texts[x.id][x.start : x.stop]) == plain(want[x.id][1])
            assert abs(x.coverage - x.matched / x.words) < 1e-12 and x.coverage >= 0.8
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_every_wording_is_found_as_a_line_of_its_own(spark):
    lines = [(name, text) for name, texts in license_scan.TEMPLATES.items() for text in texts]
    # The license lines of the given documents, as they stand there.
    lines = [(name, text.replace("*", "")) for name, text in lines]
    lines += [
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"), ("Proprietary", "All rights reserved"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
        ("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ]
    rows = [(i, f"Some words before it.\n{text}.\nAnd all the rights of some words after it.") for i, (_, text) in enumerate(lines)]
    rows += [(900, "all rights"), (901, "All those rights reserved"), (902, "All rights reserved. All rights reserved.")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.id, x.license) for x in got) == sorted([(i, name) for i, (name, _) in enumerate(lines)] + [(902, "Proprietary")] * 2)
    for x in got:
        if x.id < 900:
            assert plain(dict(rows)[x.id][x.start : x.stop]) == plain(lines[x.id][1].removeprefix("This work is "))


HEADER = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."


def test_similar_licenses_are_told_apart(spark):
    cases = [
        (HEADER.format(":", "", ",", "3"), "GPL-3.0"),
        (HEADER.format(";", "", ";", "2"), "GPL-2.0"),
        (HEADER.format(":", "Lesser ", ",", "3"), "LGPL-3.0"),
        (HEADER.format(";", "Lesser ", ";", "2.1"), "LGPL-2.1"),
        (HEADER.format(":", "Affero ", ",", "3"), "AGPL-3.0"),
        (HEADER.format(":", "", ",", "9"), "GPL"),
        ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("licensed under the GNU General Public License, version 1", "GPL-1.0"),
        ("licensed under the GNU General Public License, version 4", None),
        ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"),
        ("Licensed under CC BY 7.0", None),
        ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
        ("Licensed under the Apache License, Version 1.1", "Apache-1.1"),
        ("Licensed under the Apache License, Version 3.0", None),
        ("Licensed under the Educational Community License, Version 2.0", None),
        ("Released under the new and entirely different MIT like License", None),
    ]
    whole = {"MIT": -1, "MIT-0": 0, "BSD-2-Clause": 0, "BSD-3-Clause": 0, "ISC": -1, "0BSD": 0, "Zlib": 0, "Unlicense": 0, "Apache-2.0": -1, "MPL-2.0": -1}
    for name, at in whole.items():
        text = license_scan.TEMPLATES[name][at].replace("*", "").split()
        cases.append((" ".join(text), name))
        # As a comment, ten words a line, one word changed in three lines.
        lines = [text[i : i + 10] for i in range(0, len(text), 10)]
        for line in lines[1:4]:
            if len(line) > 4 and line[4] not in ("endorse", "substantial", "appear", "2.0", "Mozilla"):
                line[4] = "xyz"
        cases.append(("\n".join(" * " + " ".join(line) for line in lines), name))
    rows = [(i, f"Before it.\n\n{text}\n\nAnd after it.") for i, (text, _) in enumerate(cases)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.id, x.license) for x in got) == sorted((i, name) for i, (_, name) in enumerate(cases) if name)


def test_scan_equals_an_alignment_against_every_span():
    """Best span of every template by exhaustion, then the best template of a text with one notice."""
    r = random.Random(3)
    templates = {
        "one": ["this work is given to you under the terms of license *alpha version *1"],
        "two": ["this work is given to you under the terms of license *alpha version *2"],
        "three": ["this work is given to you under the terms of *lesser license *alpha version *2"],
        "four": ["given to you under the terms"],
    }
    index, least = license_scan._Index(templates, 0.8), 0.8
    for _ in range(150):
        notice = r.choice([t for texts in templates.values() for t in texts]).replace("*", "").split()
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(notice))
            notice[at : at + r.randint(0, 1)] = [r.choice(["this", "lesser", "x", "2", "of", "terms"])] * r.randint(0, 1)
        words = [r.choice("abcdef") for _ in range(r.randint(0, 5))] + notice + [r.choice("abcdef") for _ in range(r.randint(0, 5))]
        want = []
        for t, name in enumerate(index.names):
            size, own = len(index.hashes[t]), index.hashes[t].tolist()
            hashes = word_hashes([w.encode() for w in words]).tolist()
            spans = []
            for a in range(len(words)):
                for b in range(a, len(words)):
                    m = most_in_order(own, hashes[a : b + 1])
                    spans.append((round(1000 * m) - 800 * (b - a + 1 - m), a, -b, m))
            worth, a, b, m = max(spans)
            span = hashes[a : 1 - b]
            runs = {tuple(own[i : i + 3]) for i in range(size - 2)} & {tuple(span[i : i + 3]) for i in range(len(span) - 2)}
            if worth >= 800 * size and index.fits(t, span) and runs:
                want.append((-m, 1 - b - a - m, -m / size, name, a, -b))
        got = [(-x[3], x[4], -x[2], x[1]) for x in license_scan._scan([" ".join(words).encode()], index, least)]
        assert got[:1] == [w[:4] for w in sorted(want)[:1]], words


def test_alignment_equals_the_full_one_inside_the_band():
    r = random.Random(2)
    for _ in range(200):
        a = [r.choice("abcde").encode() for _ in range(r.randint(1, 9))]
        b = [r.choice("abcde").encode() for _ in range(r.randint(1, 14))]
        found = license_scan.align(word_hashes(a), word_hashes(b), -len(a), len(a) + len(b))
        assert (found[0] if found else 0) == most_in_order(a, b)
        if found:
            assert most_in_order(a, b[found[1] : found[2] + 1]) == found[0]
