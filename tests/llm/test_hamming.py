import numpy as np

from marlstone.llm import hamming

SCHEMA = "vec_id long, embedding array<float>, label int, code string, query string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], 0, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=10, every=20):
    own = {i: np.array(v) > 0 for i, v in rows if i is not None and v is not None and len(v) == 64 and not any(x is None or np.isnan(x) for x in v)}
    out = []
    for q in own:
        if q % every == 0:
            near = sorted((int((own[q] != own[b]).sum()), b) for b in own if b != q)[:k]
            out += [(q, n + 1, b, d) for n, (d, b) in enumerate(near)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "neighbour_id", "distance").collect())


def test_random_near_and_equal_codes(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(150)]
    base = rng.normal(size=64)
    for i in range(150, 260):
        v = base.copy()
        v[rng.integers(0, 64, rng.integers(0, 6))] *= -1
        rows.append((i, v.tolist()))
    rows += [(i, base.tolist()) for i in range(260, 340)]
    rows += [(400, None), (420, [0.0] * 64), (440, [1.0] * 63), (460, [float("nan")] * 64), (480, [None] * 64), (None, base.tolist()), (0, rows[0][1])]
    want = brute(rows)
    assert as_rows(hamming.search(table(spark, rows))) == want
    assert as_rows(hamming.search(table(spark, rows), list_block=4)) == want


def test_wider_segments(spark):
    """Near groups, so that the fourth-root probes of 16-bit segments end early."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = rng.normal(size=64)
        for k in range(14):
            v = base.copy()
            v[rng.integers(0, 64, rng.integers(0, 5))] *= -1
            rows.append((20 * g + k, v.tolist()))
    assert as_rows(hamming.search(table(spark, rows), segment=16)) == brute(rows)
    assert [hamming.width(n) for n in (0, 4096, 4097, 1 << 24, (1 << 24) + 1)] == [8, 8, 16, 16, 32]


def test_few_rows(spark):
    rows = [(0, [1.0] * 64), (20, [-1.0] * 64), (3, [1.0] * 32 + [-1.0] * 32)]
    assert as_rows(hamming.search(table(spark, rows))) == brute(rows)
    assert hamming.search(table(spark, [(20, [1.0] * 64)])).count() == 0
    assert hamming.search(table(spark, [])).count() == 0
