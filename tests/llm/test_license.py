import random

import pytest
from llmfix import docs

from bazaar.llm import license_scan as S


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    common = ["the", "of", "to", "is", "this", "and", "a", "by", "in", "for", "be", "it"]
    return S.train([[rng.choice(common) for _ in range(rng.randrange(0, 40))] for _ in range(600)])


def test_unseen_wordings_and_unknowns(model):
    for line, family in [
            ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("licensed under Apache License version 2.0, see LICENSE", "Apache-2.0"),
            ("Everything in here is released under the MIT License.", "MIT"), ("THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", "GPL-3.0"),
            ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
            ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "BSD"),
            ("This Source Code Form is subject to the Mozilla Public License, v. 2.0.", "MPL-2.0")]:
        got, p, s = model.classify(line)
        assert got == family and p > 0.5 and s > 0.3, (line, got, p, s)
    for line in ["", "the weather is fine and this is it", "All rights reserved.", "The general public was not admitted to the library.",
                 "He showed his driving license at the border."]:
        assert model.classify(line)[0] == S.UNKNOWN, line


def test_scan_looks_at_every_line_that_could_count(model):
    rng = random.Random(7)
    pool = [t for ts in S.TEMPLATES.values() for t in ts] + ["some words", "", "All rights reserved.", "é license x"]
    for _ in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 8))]
        want = [(i, *model.classify(ln.lower())) for i, ln in enumerate(lines)]
        got = model.scan("\n".join(lines))
        assert [(a, f) for a, b, f, *_ in got if a == b] == [w[:2] for w in want if w[1] != S.UNKNOWN] and all(a == b for a, b, *_ in got)


def test_frames(spark):
    mit, gpl = S.TEMPLATES["MIT"][0], S.TEMPLATES["GPL-3.0"][0]
    rows = [(1, "text\n" + mit), (2, None), (3, ""), (4, "x " * 150000 + "\n" + gpl + "\nmore"), (None, mit), (2 ** 60 + 1, gpl), (2 ** 60 + 1, gpl)]
    rows += [(100 + i, f"plain words number {i} of the text") for i in range(60)]
    got = S.scan(docs(spark, rows).selectExpr("*", "1 as line", "2 as family")).collect()
    assert sorted(((r.doc_id, r.line, r.family) for r in got), key=str) == sorted(
        [(1, 1, "MIT"), (4, 1, "GPL-3.0"), (None, 0, "MIT"), (2 ** 60 + 1, 0, "GPL-3.0"), (2 ** 60 + 1, 0, "GPL-3.0")], key=str)
    assert all(r.confirmed and r.probability >= 0.5 for r in got)
    assert S.scan(docs(spark, [])).count() == 0


HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
          "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")


def test_wrapped_notices_are_one_notice(model):
    import textwrap
    for width in (40, 70, 100, 400):
        wrapped = textwrap.wrap(HEADER, width)
        got = model.scan("some prose before\n\n# tool\n" + "\n".join(wrapped) + "\n\nafter it")
        assert [g[2] for g in got] == ["GPL-3.0"] and got[0][4] >= 0.9, (width, got)
        assert 3 <= got[0][0] <= got[0][1] <= 2 + len(wrapped)
    two = "\n".join(textwrap.wrap(HEADER, 70)) + "\nReleased under the MIT License.\n"
    assert [g[2] for g in model.scan(two)] == ["GPL-3.0", "MIT"]
    apart = "Licensed under the Apache\n\nLicense, Version 2.0."
    assert all(g[0] == g[1] for g in model.scan(apart))


def test_anchors_end_where_words_do(model):
    for text in ("Distributed under the GPLv3+.", "Distributed under the GPLv3", "released under the Apache2.0 license"):
        assert model.scan(text), text
    import re
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["license", "gpl", "3", "2.0", ".", " ", "\n", "x", "é", "mit"]) for _ in range(12))
        anchors = set(model.anchors)
        want = [i for i, ln in enumerate(text.lower().split("\n")) if anchors & set(re.findall(r"[a-z]+|\d+(?:\.\d+)*", ln))]
        assert model._anchored(text.lower()) == want, text
