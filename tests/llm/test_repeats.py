import hashlib
import random

import pytest

from marlstone.llm import repeats
from marlstone.llm.common import documents


def brute(rows, length=repeats.LENGTH):
    """Every string of every text in order of doc_id (null last), then start."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            h = hashlib.blake2b(t[p : p + length], digest_size=12).digest()
            if h in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(h)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def as_rows(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_sample(spark, sample):
    docs = documents(spark, sample)
    assert as_rows(repeats.digest(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_shared_lines_periods_and_near_copies(docs):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(2, 9)))
    line = "All rights reserved under the terms which every document here repeats, word for word, and byte for byte, always."
    base = " ".join(word() for _ in range(400))
    rows = []
    for i in range(90):
        own = " ".join(word() for _ in range(rng.randrange(5, 60)))
        rows.append((i, own + line[: rng.randrange(95, len(line))] + " ".join(word() for _ in range(20))))
    for i in range(90, 120):
        a = rng.randrange(0, 1500)
        rows.append((i, base[: a] + rng.choice("XYZ") + base[a + rng.randrange(0, 3) :]))
    rows += [(200, "a" * 700), (201, "ab" * 300), (202, "b" * 99), (203, "c" * 100), (204, "c" * 101), (205, None), (206, ""), (None, base), (207, line * 4)]
    long = " ".join(word() for _ in range(60000))
    rows += [(300, long), (301, long[5000:300000] + "!" + long[300000:]), (302, long[100:200] * 3)]
    rng.shuffle(rows)
    assert as_rows(repeats.digest(docs(rows))) == brute(rows)


def test_repeated_ids_and_empty(docs):
    t = "0123456789" * 9 + "x" * 30
    got = as_rows(repeats.digest(docs([(1, t), (1, t), (2, "short")])))
    assert [r[2] for r in got] == [0, 120, 0]
    assert repeats.digest(docs([])).count() == 0


def test_removed_spans(docs):
    t = "".join(chr(97 + i * i % 26) for i in range(50)) * 2 + "The end of this is new."
    got = {r.doc_id: r for r in repeats.removed(docs([(1, t), (2, "Before. " + t[:110]), (3, None)])).collect()}
    assert [tuple(s) for s in got[2].spans] == [(8, 118)] and bytes(got[2].kept) == b"Before. " and got[1].spans == [] and got[3].text is None


@pytest.mark.parametrize("n", [1, 5, 100])
def test_pieces_cover_all_starts(n):
    texts = [b"x" * k for k in (0, 99, 100, 150, 300000)] * n
    seen = {}
    for buf, first, starts, offset, text in repeats.pieces(texts):
        assert len(buf) < 1 << 22
        for f, s, o, t in zip(first, starts, offset, text):
            seen[t] = seen.get(t, 0) + s
            assert o + s + 99 <= len(texts[t])
    assert seen == {i: len(t) - 99 for i, t in enumerate(texts) if len(t) >= 100}


@pytest.mark.parametrize("how", [(repeats.BY_CONTEXT,), (repeats.BY_START,)])
def test_ranking_by_context_and_by_start(how):
    import pyarrow as pa

    rng = random.Random(1)
    shared = "".join(rng.choice("abcdef") for _ in range(130))
    texts = ["".join(rng.choice("xyz ") for _ in range(80)) + shared[: rng.randrange(100, 130)] + "".join(rng.choice("uvw ") for _ in range(80)) for _ in range(40)]
    own = []
    for t in texts:
        for buf, first, starts, _, _ in repeats.pieces([t.encode()]):
            _, _, begin, n, _ = repeats.anchors(buf, first, starts)
            own.append([{"start": int(b), "n": int(m), "how": how[0]} for b, m in zip(begin, n)])
    spans = pa.array(own, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("how", pa.int32())])))
    parts = []
    for a in range(0, 40, 10):  # four tasks
        ids = pa.array(range(a, a + 10))
        parts += repeats._to_rank(iter([pa.record_batch([ids, ids, pa.array(texts[a : a + 10]), spans.slice(a, 10)], names=["doc", "doc_id", "text", "spans"])]))
    rows = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("key", "second", "doc", "start")])
    got = set()
    for b in repeats._ranked(iter(rows.to_batches(max_chunksize=7))):
        for d, s, n in zip(*(c.to_pylist() for c in b.columns)):
            got |= {(d, s + k) for k in range(n)}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                want.add((i, p))
            seen.add(t[p : p + 100])
    assert got == want and want
