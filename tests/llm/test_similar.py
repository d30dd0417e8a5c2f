"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import numpy as np
import pytest

from marlstone.llm import similar
from marlstone.llm.common import documents


def shingle_set(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def first_of_each(rows):
    """Ids that stay, by all pairs: a plain union-find over true similarities. Rows: (doc_id, text, ...)."""
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(("None" if null else str(d)) for null, d in least.values())


def kept(df):
    return sorted(str(r.doc_id) for r in df.collect())


def words(rng, n):
    return [f"w{i}" for i in rng.integers(0, 10**9, n)]


def test_tables_against_all_pairs(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    assert kept(similar.one_of_each(docs)) == first_of_each([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("edits", [3, 7])
def test_variants_of_one_text(docs, edits):
    """300 variants of 400 words, some words changed in each: near 0.8 from both sides, with the original or without it."""
    rng = np.random.default_rng(edits)
    base, rows = words(rng, 400), []
    for v in range(300):
        own = list(base)
        for i in rng.choice(400, edits if v else 0, replace=False):
            own[i] = f"x{v}-{i}"
        rows.append((v, " ".join(own)))
    for some in (rows, rows[1:]):
        assert kept(similar.one_of_each(docs(some))) == first_of_each(some)


def test_a_crowd_around_one_passage(docs, monkeypatch):
    """Hundreds of texts share one long passage at about 0.75; among them are pairs of 0.8 and more. Also with the
    limits for lists and cells made small, which must not change anything."""
    rng = np.random.default_rng(11)
    passage, rows = words(rng, 250), []
    for g in range(300):
        own = words(rng, 36)
        rows.append((len(rows), " ".join(own + passage)))
        if g % 3 == 0:
            rows.append((len(rows), " ".join(own[:17] + words(rng, 19) + passage)))
    want = first_of_each(rows)
    assert kept(similar.one_of_each(docs(rows))) == want
    monkeypatch.setattr(similar, "LIST", 8)
    monkeypatch.setattr(similar, "CELL", 1 << 14)
    assert kept(similar.one_of_each(docs(rows))) == want


def test_chains_and_odd_rows(docs):
    """A chain is one group though its ends differ; copies, case, spaces, nulls, empty and short texts."""
    rng = np.random.default_rng(4)
    rows, now = [], words(rng, 200)
    for i in range(30):
        rows.append((100 + i, " ".join(now)))
        now = now[6:] + words(rng, 6)
    rows += [(7, rows[0][1].upper()), (None, rows[0][1].replace(" ", "\t\n")), (500, None), (501, ""), (502, " \t"), (None, None), (503, "one two"), (504, "One  TWO"), (505, "two one"), (506, "a b c d e f"), (507, "a b c d e"), (508, "x " * 40), (509, "x " * 90)]
    rows += [(510, "alone here"), (510, "alone here"), (None, "nameless text"), (None, "nameless text"), (511, "word " * 200_000)]
    df = docs(rows)
    out = similar.one_of_each(df)
    assert out.columns == df.columns
    assert kept(out) == first_of_each(rows)


def test_clashing_columns_and_empty(docs):
    from pyspark.sql import functions as F

    df = docs([(1, "some words of a text here"), (2, "some words of a text here")])
    for c in ("__id", "__hash", "__place", "node", "tree", "__ID1"):
        df = df.withColumn(c, F.lit("clash"))
    out = similar.one_of_each(df)
    assert out.columns == df.columns and kept(out) == ["1"]
    assert similar.one_of_each(docs([])).count() == 0


def test_runs_stay_whole_or_come_in_part():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for most in (None, 5):
        key = np.sort(rng.integers(0, 12, 200))
        cuts = [0, 3, 50, 51, 52, 120, 200]
        parts = [t.column("key").to_numpy() for t in similar._whole((pa.record_batch([pa.array(key[a:b])], names=["key"]) for a, b in zip(cuts, cuts[1:])), 1, most)]
        assert np.array_equal(np.concatenate(parts), key)
        for a, b in zip(parts, parts[1:]):
            assert a[-1] != b[0] or most and len(a) > most and a[0] == a[-1]


def test_sketch_and_bands_of_border_pairs():
    """Pairs at about 0.8: none is lost by its bands or its sketch."""
    rng = np.random.default_rng(2)
    lost = 0
    for _ in range(400):
        n = int(rng.integers(5, 900))
        shared, rest = rng.integers(1, 2**64, n, np.uint64), rng.integers(1, 2**64, (2, max(1, n // 8)), np.uint64)
        a, b = (np.unique(np.concatenate([shared, r])) for r in rest)
        m = similar.min_hashes([a, b])
        k, s = similar.band_keys(m), similar.sketches(m)
        half = s.shape[1] // 2
        d = s[0] ^ s[1]
        lost += not (k[0] == k[1]).any() or np.bitwise_count(d[:half] | d[half:]).sum() > similar.DIFFER
    assert lost == 0
