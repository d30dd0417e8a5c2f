import zlib

import numpy as np

from marlstone.llm import langid
from marlstone.llm.common import documents


def test_counts_equal_slow_count():
    g = langid.Grams(4096)
    texts = ["Hello,  wörld 12 É", "", "a", "ab", "12 3", "日本語 x"]
    counts, letters = g.counts([t.encode() for t in texts])
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    for t, row in zip(texts, counts):
        clean = " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " "
        while "  " in clean:
            clean = clean.replace("  ", " ")
        assert row.sum() == sum(max(0, len(clean) - n + 1) for n in (1, 2, 3))
        alone, _ = g.counts([clean.encode()])
        assert np.array_equal(alone[0], row)


def test_prediction_by_plain_cosines(spark):
    """The registered prediction again, text by text, with dictionaries instead of matrices."""
    docs = documents(spark, "/root/testdata/sf0.001")
    model = langid.fit(langid.training_sample(docs))
    grams = langid.Grams(len(model.idf))
    rows = docs.select("doc_id", "text").limit(40).collect()
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in rows:
        ((counts,), (letters,)) = grams.counts([r.text.encode()])
        if not letters:
            continue
        vector = {i: np.log1p(float(c)) * float(model.idf[i]) for i, c in enumerate(counts) if c}
        size = sum(x * x for x in vector.values()) ** 0.5
        cosines = [sum(x / size * float(c[i]) for i, x in vector.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: (cosines[k], -k))
        assert got[r.doc_id].lang_pred == model.languages[model.owner[best]] and abs(got[r.doc_id].score - cosines[best]) < 1e-4
        assert got[r.doc_id].rejected == bool(cosines[best] < model.radius(np.array([letters]))[0])


def test_ties_go_to_the_first_language():
    sample = [(lang, "the very same words in both of them") for lang in ("zz", "aa") for _ in range(25)]
    model = langid.fit(sample)
    best, _ = model.nearest(langid.Grams(len(model.idf)).counts([b"the very same words"])[0])
    assert model.languages[best[0]] == "aa"


def test_the_sample_is_bounded(docs):
    rows = [(i, "word " * (10 + i), "a", f"l{i % 2}") for i in range(100)]
    df = docs(rows)
    assert len(langid.training_sample(df, per_language=5)) == 10
    few = langid.training_sample(df, language_bytes=600)
    assert few and all(sum(len(t) for la, t in few if la == lang) <= 600 for lang in ("l0", "l1"))
    import pytest

    with pytest.raises(ValueError):
        langid.training_sample(df, languages=1)
    many = langid.predict(docs([(i, "xy", "a", "en") for i in range(3000)]), langid.fit([("en", "some words here")])).collect()
    assert len(many) == 3000


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in langid.digest(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    out = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (d in set(out)) for d in truth)
    assert np.mean([got[d].lang_pred == truth[d] for d in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.rejected for r in got.values()]) < 0.005


def test_edge_rows(docs):
    train = [(i, "the cat and the dog sat on the mat with a hat " * 3, "a", "en") for i in range(30)] + [(100 + i, "der hund und die katze sitzen auf der matte " * 3, "a", "de") for i in range(30)]
    odd = [(500, None, "a", "en"), (501, "12 34 !!", "a", "de"), (502, "", None, None), (None, "the cat", "a", "en"), (503, "x", "a", None), (503, "x", "a", None), (504, "the dog " * 20000, "a", None), (505, "日本語日本語日本語日本語", "a", None)]
    df = docs(train + odd)
    got = {}
    for r in langid.digest(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[d][0].lang_pred for d in (500, 501, 502)] == ["und"] * 3 and got[500][0].rejected and got[501][0].score == 0
    assert len(got[503]) == 2 and got[504][0].lang_pred == "en" and not got[504][0].rejected and got[None][0].held_out is False
    assert all(r.lang_pred == ("en" if d < 100 else "de") for d in got if d is not None and d < 500 for r in got[d])
    assert got[505][0].rejected
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.where("doc_id in (500, 501, 502, 505)").count() == 0 and kept.where("doc_id < 500").count() == 60
    assert langid.digest(docs([])).count() == 0
    unlabelled = docs([(1, "text", "a", None), (2, "12", "a", None)])
    assert sorted((r.doc_id, r.lang_pred, r.rejected) for r in langid.digest(unlabelled).collect()) == [(1, "und", False), (2, "und", True)]
    assert [r.doc_id for r in langid.keep_known(unlabelled).collect()] == [1]
