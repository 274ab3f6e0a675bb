import os
import re

import pytest

from mldiag.llm import licences

FOLDER = "/root/testdata/sf0.1"
#: The notices that the test tables hold.
NOTICES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_finds_the_notices_and_nothing_else(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(8)
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    wrong = []
    for r in rows:
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted = sorted({f for n, f in NOTICES.items() if any(n in x for x in lines)})
        g = got[r.doc_id]
        assert g.n_paragraphs == len(lines)
        if g.families != wanted or g.n_licences != sum(any(n in x for n in NOTICES) for x in lines):
            wrong.append((r.doc_id, g, wanted))
    assert len(wrong) <= 2, wrong[:5]


def test_odd_rows(spark):
    mit = " ".join(licences.TEMPLATES["MIT"][2:])
    texts = [None, "", "\n \n", "a", "x" * 100_000, "nothing here. " * 40_000, "MIT is a university. The license plate is blue.",
             f"intro\n{mit}\noutro", "words and words " * 60 + "Released under the MIT License. " + "more of it " * 60,
             "Licensed under the Apache License, Version 2.0.\r\n\r\nthis work is licensed under the gnu general public license, version 2"]
    docs = spark.createDataFrame([(i, t, "MIT", 1) for i, t in enumerate(texts * 2)] + [(None, "a b", "x", 1)], "doc_id bigint, text string, family string, n_licences int")
    got = licences.scan(docs).collect()
    assert len(got) == 2 * len(texts) + 1
    families = {i: [r.families for r in got if r.doc_id is not None and r.doc_id % len(texts) == i] for i in range(len(texts))}
    for i in range(7):
        assert families[i] == [[], []]
    assert families[7] == [["MIT"]] * 2 and families[8] == [["MIT"]] * 2 and families[9] == [["Apache-2.0", "GPL"]] * 2
    assert all((r.family == licences.UNKNOWN) == (r.n_licences == 0) for r in got)
    assert licences.scan(docs.filter("false")).count() == 0


@pytest.mark.parametrize("family", sorted(licences.TEMPLATES))
def test_templates_are_named(model, family):
    for text in licences.TEMPLATES[family]:
        for shown in (text, text.upper(), "** " + text + " **"):
            hashes = licences._hashes(shown.encode())
            import numpy as np

            found = model.found(hashes, np.array([len(hashes)]))
            assert found and model.families[found[0][0]] == family, (shown, found)


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark.createDataFrame([(1, "The cat sat on the mat and looked at the dog.\nThey were quite happy with it all day long.")], "doc_id bigint, text string"))


GNU = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name}General Public License for more details."""
WRAPPED = {
    "GPL": GNU.format(what="program", mark=":", name="", comma=",", version=3),
    "AGPL": GNU.format(what="program", mark=":", name="Affero ", comma=",", version=3),
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense""",
}
CODE = "\n".join(f"def function_{i}(x):\n    return x + {i}" for i in range(40))


@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// ", ";; ", "% ", "dnl ", "-- "])
@pytest.mark.parametrize("long", [False, True])
def test_wrapped_headers_are_found(spark, model, prefix, long):
    before = ("word " * 30 + "\n") * 3_400 if long else "x = 1\n"
    rows = [(i, before + "Copyright 2020 Someone\n" + "\n".join(prefix + x for x in text.split("\n")) + "\n" + CODE) for i, text in enumerate(WRAPPED.values())]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([*rows, (99, CODE)], "doc_id bigint, text string"), model).collect()}
    assert {f: got[i].families for i, f in enumerate(WRAPPED)} == {f: [f] for f in WRAPPED}
    assert got[99].families == [] and all(got[i].n_licences >= 1 for i in range(len(WRAPPED)))


def plain_found(model, content):
    """Notices that lines hold by themselves, span by span with sets and dictionaries: (line, family, probability, containment)."""
    import math
    import zlib

    import numpy as np

    golden, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mixed(x):
        x = x * golden & mask
        return x ^ (x >> 32)

    def pairs(codes):
        return [mixed((mixed(a) + b) & mask) for a, b in zip(codes, codes[1:])]

    wanted = [(f, {int(x) for x in t}, len(t), [int(x) for x in t]) for f, t in model.templates]
    weights, bias = model.linear.weights, model.linear.bias
    out, paragraph = [], -1
    for line in content.split(b"\n"):
        if not line.split():
            continue
        paragraph += 1
        bare = [w.strip(licences.MARKS).lower() for w in line.split()]
        codes = [zlib.crc32(w) | 1 << 32 for w in bare if w]
        spans = [codes] if codes else []
        if len(codes) > licences.WINDOW:
            spans += [codes[i : i + licences.WINDOW] for i in range(0, len(codes), licences.WINDOW // 2)]
        for span in spans:
            both = pairs(span)
            buckets = [x % licences.BUCKETS for x in [mixed(c) for c in span] + both]
            z = [sum(float(weights[b, c]) for b in buckets) / math.sqrt(max(1, len(buckets))) for c in range(len(model.families))]
            z = [(a + float(bias[c])) / model.linear.temperature for c, a in enumerate(z)]
            e = [math.exp(a - max(z)) for a in z]
            chances = [a / sum(e) for a in e[:-1]]
            best = int(np.argmax(chances))
            if chances[best] >= model.least:
                held = set(both)
                alike = max(sum(x in held for x in t) / n for f, _, n, t in wanted if f == best)
                if alike >= licences.CONFIRMED:
                    out.append((paragraph, best, round(chances[best], 6), round(alike, 9)))
    return out


def test_lines_by_brute_force(spark, model):
    """Each line and window of real texts and notices scored on its own, without batches, tables or running sums."""
    import random

    import numpy as np
    import pyarrow.parquet as pq

    rng = random.Random(2)
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if len(t) < 20_000] if os.path.isdir(FOLDER) else []
    notices = [t for every in licences.TEMPLATES.values() for t in every]
    for _ in range(80):
        words = " ".join(rng.choices(notices, k=2)).split()
        texts.append("\n".join(["some words go first"] + [" ".join(words[i : i + 30]) for i in range(0, len(words), 30)] + [rng.choice(notices) + " tail " * rng.randrange(60)]))
    hits = 0
    for text in texts:
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        hashes = [licences._hashes(x) for x in lines]
        if not sum(map(len, hashes)):
            continue
        got = model.found(np.concatenate(hashes), np.array([len(h) for h in hashes]))
        got = sorted((i, f, round(p, 6), round(c, 9)) for f, p, c, i in got)
        wanted = sorted(plain_found(model, text.encode()))
        assert [x[:2] for x in got] == [x[:2] for x in wanted]
        assert all(abs(a[2] - b[2]) < 1e-4 and abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, wanted))
        hits += len(wanted)
    assert hits > 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in licences.scan(docs, model).collect():
        alone = plain_found(model, texts[r.doc_id].encode())
        assert {model.families[x[1]] for x in alone} <= set(r.families)
        assert r.n_licences >= len({x[0] for x in alone})


def test_background_is_bounded(spark):
    lines = [f"line number {i} of the background" for i in range(3000)] + ["the same line in very many documents"] * 2000
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 50 : i * 50 + 50])) for i in range(100)], "doc_id bigint, text string")
    for most in (50, 500, 10_000):
        found = licences.background_lines(docs, most)
        assert len(found) == len(set(found)) == min(most, 3001) and set(found) <= set(lines)
    assert licences.background_lines(docs.withColumnRenamed("text", "t").selectExpr("t as text").filter("false")) == []
