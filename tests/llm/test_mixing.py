import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing


def share(sizes, weights, most):
    """Targets by resharing the excess again and again."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        left = total - sum(fixed.values())
        t = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in t if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return fixed | t
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_and_copies(docs):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 3}") for i in range(300)] + [(1000 + i, "a b c", "tiny") for i in range(3)]
    rows += [(2000 + i, "x\x0by z", None) for i in range(4)] + [(3000, None, "empty"), (3001, " \t", "empty"), (None, "q", "s0"), (5, "w", "s1"), (5, "w", "s1")]
    got = mixing.digest(docs(rows)).toPandas()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    want = share(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    full = mixing.copies(docs(rows)).toPandas()
    assert len(got) == len(rows)
    for s in size:
        own = full[full.source.isna() if s is None else full.source == s]
        assert own.target.iloc[0] == pytest.approx(want[s]) and own.source_size.iloc[0] == size[s]
        assert abs((own.copies * own["size"]).sum() - want[s]) <= 2 * own["size"].max()
        assert own.copies.max() <= 3
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.digest(docs(rows).repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, got[key].values.tolist()))


def test_mix_repeats_rows_and_keeps_columns(docs):
    df = docs([(i, "a b", "x" if i else "y") for i in range(50)])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.where("source = 'y'").count() <= 3 and out.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 3").count() == 0


def test_empty(docs):
    assert mixing.digest(docs([])).count() == 0
    assert mixing.digest(docs([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0
