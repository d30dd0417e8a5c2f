import re

import numpy as np
import pytest
import xxhash

from marlstone.llm import simhash
from marlstone.llm.common import documents


def slow_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(rows):
    """doc position to smallest doc_id reachable, comparing all pairs."""
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def as_rows(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_triples_cover_every_four():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


@pytest.mark.parametrize("limit", [2, 16384])
def test_links_equal_all_pairs(spark, limit):
    rng = np.random.default_rng(3)
    fps = set(rng.integers(-(2**63), 2**63, 60).tolist())
    for seed in list(fps)[:6]:
        for _ in range(25):
            x = seed
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b) if b < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    from marlstone.llm.components import components

    got = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3), 4, limit))
    got = {r.node: r.root for r in got.collect()}
    root = {f: f for f in fps}
    changed = True
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in near:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert {f: got.get(f, f) for f in fps} == root


def test_documents(spark, sample, docs):
    rows = [(r.doc_id, r.text) for r in documents(spark, sample).collect()]
    rows += [(None, rows[0][1]), (9001, None), (9002, ""), (None, None), (9003, "one"), (9004, "One"), (9004, "One"), (9005, "a b c d"), (None, "quite alone here in the table"), (9006, "É É\x0bé x " * 30000)]
    assert as_rows(simhash.digest(docs(rows))) == slow_classes(rows)


def test_empty_and_keep_first(docs):
    assert simhash.digest(docs([])).count() == 0
    rows = [(3, "the same old text again"), (1, "the same old text again"), (1, "the same old text again"), (2, "another story with words"), (None, "x y z"), (None, "x y z")]
    df = docs(rows)
    out = simhash.keep_first(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
