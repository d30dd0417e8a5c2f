import subprocess
import sys

import corpus_pipeline
from marlstone.llm import packing, similar
from marlstone.llm.common import lean


def test_a_stage_drops_what_other_stages_keep(spark, docs, monkeypatch):
    """language_id's task in a worker that has packed and compared before."""
    df, seen = docs([(i, "the cat and the dog sat on the mat " * 3) for i in range(40)], extra=False), []
    own = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: seen.append(f) or own(self, f, *a, **b))
    assert corpus_pipeline.language_id(spark, df, "").count() == 40
    packing.encoder(packing.vocabulary())
    similar.shingles(b"some words of an earlier task")
    kept = list(seen[-1](iter(df.toArrow().to_batches())))
    assert sum(b.num_rows for b in kept) == 40
    assert packing.encoder.cache_info().currsize == 0 and not similar._hashes


def test_a_stage_keeps_its_own():
    coder = packing.encoder(packing.vocabulary())
    assert list(lean(lambda batches: batches, "packing")(iter([1, 2]))) == [1, 2]
    assert packing.encoder(packing.vocabulary()) is coder


def test_free_memory_goes_back():
    """200 MB of small arrays below one that stays: without the call the heap can't shrink."""
    code = """
import re, sys
sys.path.insert(0, %r)
import numpy as np
from marlstone.llm.common import lean
def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
def run(batches):
    global last
    arrays = [np.ones(12_000) for _ in range(2100)]
    last = arrays[-1]
    yield mb()
before = mb()
(most,) = lean(run)(iter(()))
print(before, most, mb())
"""
    before, most, after = map(int, subprocess.run([sys.executable, "-c", code % sys.path[0]], capture_output=True, text=True, check=True).stdout.split())
    assert most > before + 150 and after < before + 50
