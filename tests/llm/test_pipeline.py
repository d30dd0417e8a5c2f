import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import langid, packing
from marlstone.llm.common import documents

from .test_mixing import share
from .test_similar import first_of_each


def without(rows, length=100):
    seen, out = set(), []
    for d, t, s in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        out.append((d, bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore"), s))
    return out


def test_stages_against_brute_force(spark, sample, tmp_path):
    docs = documents(spark, sample)
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect())
    model = langid.fit(langid.training_sample(docs))
    keep = {r.doc_id for r in langid.predict(docs, model).where("not rejected").collect()}
    want = [[r for r in rows if r[0] in keep]]
    stay = set(first_of_each(want[-1]))
    want.append([r for r in want[-1] if str(r[0]) in stay])
    want.append(without(want[-1]))
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, now, sample).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert now.columns == docs.columns
        assert sorted((r.doc_id, r.text, r.source) for r in now.collect()) == want[i]
    assert all(r.n_chars == len(r.text) for r in now.collect() if r.text != dict((a, b) for a, b, _ in rows)[r.doc_id])
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in want[2]}
    per = Counter()
    for d, _, s in want[2]:
        per[s] += size[d]
    targets = share(dict(per), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per))}, 3)
    corpus_pipeline.mix_sources(spark, now, sample).write.parquet(f"{tmp_path}/mix")
    mixed = spark.read.parquet(f"{tmp_path}/mix")
    taken, copies = Counter(), Counter()
    for r in mixed.collect():
        assert (r.doc_id, r.text, r.source) in want[2]
        taken[r.source] += size[r.doc_id]
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3 and mixed.columns == docs.columns
    for s in targets:
        assert abs(taken[s] - targets[s]) <= 2 * max(size[d] for d, _, x in want[2] if x == s)
    packed = corpus_pipeline.pack_sequences(spark, mixed, sample).toPandas()
    tok, text = Tokenizer.from_file(packing.vocabulary()), {d: t for d, t, _ in want[2]}
    n = {d: len(tok.encode(text[d], add_special_tokens=False).ids) + 1 for d in copies}
    assert packed.groupby("doc_id").length.sum().to_dict() == {d: n[d] * copies[d] for d in copies}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= np.ceil(packed.length.sum() / 2048) * 1.02 + 1


def test_run_gives_rows_and_the_same_twice(spark, sample):
    key = ["doc_id", "piece", "length", "ids_crc32"]
    a, b = (corpus_pipeline.run(spark, sample).select(*key).toPandas().sort_values(key).reset_index(drop=True) for _ in range(2))
    assert len(a) and a.equals(b)


def test_empty_table_and_odd_rows(spark, docs):
    for df in (docs([], extra=False), docs([(1, None, None), (None, "one two three", None), (2, "", "a"), (3, "words of a kind " * 40, "b"), (3, "words of a kind " * 40, "b")], extra=True)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "unused")
            df.collect()
