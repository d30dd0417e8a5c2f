import textwrap

import numpy as np
import pytest

from marlstone.llm import licences as lic
from marlstone.llm.common import documents


@pytest.fixture(scope="module")
def model():
    return lic.fit([f"plain words of no note {i} and some more of them" for i in range(300)])


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("Released under the MIT License.", "MIT"), ("this project is released under the mit license", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("Licensed under CC BY 4.0", "CC-BY"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Redistribution and use in source and binary forms are permitted", "BSD"), ("Copyright 2020 Example Corp. All rights reserved.", "proprietary"),
        ("Under the FooBar Public License, version 9, you may do things", "unknown"), ("Licensed under the Eclipse Public License 2.0", "unknown"),
        ("He lost his license", "none"), ("The general public likes the foundation", "none"), ("", "none"), ("nothing here", "none"),
    ],
)
def test_lines(model, line, family):
    got, p = model.judge(line)
    assert got == family and 0 <= p <= 1


@pytest.mark.parametrize(
    "line",
    [
        "Licensed under the Apache License, Version 1.1", "Licensed under the GNU AGPL v3.", "ISC License", "Boost Software License", "This program is licensed under the GNU Affero General Public License, version 3.",
        "Distributed under the Boost Software License, Version 1.0.", "Licensed under CC BY-ND 4.0.", "Released under the Quux License.",
    ],
)
def test_other_licences_are_unknown(model, line):
    found, other = model.paragraph(line)
    assert not found and other


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""


@pytest.mark.parametrize("width", [40, 60, 78, 100, 10_000])
def test_wrapped_notices_are_one_paragraph(model, width):
    wrapped = ["\n".join(textwrap.wrap(x, width)) for x in (MIT, GPL, BSD)]
    text = "\n\n".join(["A tool of some kind, and how to use it.", *wrapped, "The end of it."])
    own = list(lic.paragraphs(text))
    assert len(own) == 5
    assert [sorted(model.paragraph(p)[0]) for p in own] == [[], ["MIT"], ["GPL"], ["BSD"], []] and not any(model.paragraph(p)[1] for p in own)


def test_paragraphs():
    assert list(lic.paragraphs("")) == [] and list(lic.paragraphs("one\n\n \ntwo\n")) == ["one", "two"]
    assert list(lic.paragraphs("a short line\nthen one that is much longer than it")) == ["a short line", "then one that is much longer than it"]
    long = "word " * 40
    assert list(lic.paragraphs(f"{long}\nnext")) == [long.strip(), "next"]


def test_held_out_variations(model):
    """Variations from another seed: families found, salads of their words left alone."""
    rng = np.random.default_rng(99)
    filler = [f"word{i}" for i in range(50)]
    right = total = 0
    for family, notices in lic.NOTICES.items():
        for s in notices:
            for w in lic._variations(rng, lic.words_of(s), filler, 10):
                right += model.judge(" ".join(w))[0] == family
                total += 1
    assert right / total > 0.85
    pool = [x for own in lic.NOTICES.values() for s in own for x in lic.words_of(s)]
    wrong = sum(model.judge(" ".join(pool[i] for i in rng.integers(0, len(pool), 12)))[0] not in ("none", "unknown") for _ in range(500))
    assert wrong <= 2


def test_skipped_paragraphs_have_no_feature(model):
    p = model.probabilities([])
    assert p[0] > 0.5 and model.judge("zebra")[0] == "none" and all(not model.keys.isdisjoint(g.split()) for g in model.features)


def test_corpus_lines(spark):
    """Every planted licence line is found, and no other document has a finding."""
    docs = documents(spark, "/root/testdata/sf0.01")
    planted = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary"}
    want = {r.doc_id: sorted({planted[x] for x in r.text.split("\n") if x in planted}) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.licences for r in lic.findings(docs).collect()}
    assert got == want and any(want.values())


def test_edge_rows(docs):
    long = "x y z " * 50000 + "\nReleased under the MIT License.\n" + "q" * 100000
    df = docs([(1, None), (2, ""), (3, long), (3, long), (None, "Licensed under CC BY-SA 4.0."), (4, "Released under the MIT License.\nAll rights reserved.\nSomebody else's Special License v7 applies to this licensed work")])
    got = {}
    for r in lic.findings(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].licences == [] and got[2][0].n_findings == 0 and [r.licences for r in got[3]] == [["MIT"]] * 2 and got[None][0].licences == ["CC-BY-SA"]
    assert got[4][0].licences == ["MIT", "proprietary"] and got[4][0].n_findings == 2 and got[4][0].confidence > 0.7
    assert lic.findings(docs([])).count() == 0
