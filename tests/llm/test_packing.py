import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from marlstone.llm import packing


def brute(lengths, capacity):
    """One-by-one best-fit decreasing: how many bins end with which fill (bins of equal room may swap)."""
    rooms, bins = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            _, i = min(fits)
        else:
            i = len(rooms)
            rooms.append(capacity)
            bins.append([])
        rooms[i] -= n
        bins[i].append(n)
    return Counter(sum(b) for b in bins)


def test_histogram_packing_equals_one_by_one():
    rng = np.random.default_rng(1)
    for capacity, n in ((10, 50), (37, 300), (64, 200), (7, 1), (16, 0)):
        lengths = rng.integers(1, capacity + 1, n).tolist()
        rules, used = packing.best_fit(Counter(lengths), capacity)
        bins = defaultdict(list)
        for length, lo, hi, first, each, offset in rules.tolist():
            for rank in range(lo, hi):
                bins[first + (rank - lo) // each].append((offset + length * ((rank - lo) % each), length))
        assert used == len(bins)
        for b in bins.values():
            b.sort()
            assert all(at == sum(n for _, n in b[:i]) for i, (at, _) in enumerate(b))
        assert Counter(sum(n for _, n in b) for b in bins.values()) == brute(lengths, capacity)


def test_rows(docs):
    texts = ["Hello, world's   end", None, "", "a b\x1cc é́ <|endoftext|>x İΣΣ ſ", "word " * 5000, "word " * 5000, "x" * 3000, "日本語 テスト 123"]
    df = docs([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "tail")])
    got = packing.pack(df, packing.vocabulary()).toPandas()
    tok = Tokenizer.from_file(packing.vocabulary())
    seqs = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in seqs:
        assert g.length.sum() <= packing.CAPACITY and (g.offset == g.length.cumsum() - g.length).all()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 2048)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()) for s in own.start]
    assert (got.doc_id == 3).sum() == 2 and got.doc_id.isna().sum() == 1
    assert packing.pack(docs([]), packing.vocabulary()).count() == 0


def test_sample_ids(spark, sample):
    from marlstone.llm.common import documents

    rows = documents(spark, sample).select("doc_id", "text").collect()
    tok = Tokenizer.from_file(packing.vocabulary())
    enc = packing.ChunkEncoder(packing.vocabulary(), most=500)
    for r, ids in zip(rows, enc.encode([r.text.encode() for r in rows])):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(r.text, add_special_tokens=False).ids
