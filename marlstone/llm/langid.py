"""Language identification by the nearest of several centroids per language, with rejection by distance.

A text's vector: its letters lower-cased, everything else one space; hashed counts of 1-, 2- and 3-grams; tf = log(1 +
count), times idf, scaled to length 1. Each language has `clusters` centroids from spherical k-means, and a text goes
to the language of the centroid with the highest cosine (ties: first language in order of name). It is rejected if
that cosine is below the radius for texts of its length; the radii are half the lowest percentile reached by training
texts, and by pieces of them, of about that many letters, so they only turn away what resembles no language learned.

The model is fitted on a bounded sample: of the labelled rows outside the held-out quarter, the `per_language`
documents of each language with the smallest hash of their id, and of those as many whole texts as fit into
`language_bytes`, the shorter first. These parameters bound what reaches the driver; about four times as many ids per
language are ranked. Prediction is one pass over whole texts with the model in the closure: languages * clusters * dims
floats, for up to `languages` labels; a table with more of them is refused.

Defined cases: null text, or text without a letter, is `und` with score 0 and rejected. Without any labelled row every
text is `und` with score 0, and only texts without a letter are rejected. A null doc_id is never trained on and not held out. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, drawn_texts, lean, pick, slices

DIMS, CLUSTERS, UNKNOWN = 4096, 3, "und"
#: Bounds of the sample: documents and bytes of each language, and languages.
PER_LANGUAGE, LANGUAGE_BYTES, LANGUAGES = 300, 4 << 20, 500
#: Rows and bytes whose dense counts a worker holds at once.
ROWS, BYTES = 256, 1 << 18
#: Letters in the pieces of training texts that set the radii for short texts.
PIECE_LETTERS = (2, 4, 8, 16, 32, 64, 128, 256)


class Grams:
    """Hashed n-gram counts of many texts at once."""

    def __init__(self, dims: int = DIMS):
        self.dims, self.table = dims, np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                self.table[c] = ord(x.lower()[0])

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x dims counts, letters per text)."""
        parts = [np.frombuffer(t.decode().encode("utf-32-le"), "<u4") for t in texts]
        owner = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
        codes = np.full(len(owner), 32, np.uint32)
        at = 1
        for p in parts:
            codes[at : at + len(p)] = self.table[p]
            at += len(p) + 2
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
        codes, owner = codes[keep], owner[keep]
        bounds = np.searchsorted(owner, np.arange(len(parts) + 1))
        letters = np.add.reduceat(np.append(codes != 32, False).astype(np.int64), bounds[:-1]) if len(parts) else np.zeros(0, np.int64)
        out = np.zeros((len(parts), self.dims), np.float32)
        rolled = np.zeros(len(codes), np.uint32)
        shift = np.uint32(32 - (self.dims.bit_length() - 1))
        for n, mult in ((1, 2654435769), (2, 2246822519), (3, 3266489917)):
            rolled = (rolled[: len(codes) - n + 1] if n > 1 else rolled) * np.uint32(31337) + codes[n - 1 :] + np.uint32(n)
            slot = (rolled * np.uint32(mult)) >> shift
            for i in range(len(parts)):
                own = slot[bounds[i] : max(bounds[i], bounds[i + 1] - n + 1)]
                out[i] += np.bincount(own, minlength=self.dims)
        return out, letters


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radii: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, cosine) of the nearest centroid."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)

    def radius(self, letters: np.ndarray) -> np.ndarray:
        return self.radii[np.minimum(np.log2(np.maximum(letters, 1)).astype(int), len(self.radii) - 1)]


def kmeans(rows: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; no randomness."""
    seeds = [unit(rows.mean(axis=0, keepdims=True))[0]]
    seeds = [rows[(rows @ seeds[0]).argmax()]]
    while len(seeds) < min(k, len(rows)):
        seeds.append(rows[(rows @ np.array(seeds).T).max(axis=1).argmin()])
    centroids = np.array(seeds)
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(axis=1)
        centroids = unit(np.array([rows[own == i].sum(axis=0) if (own == i).any() else centroids[i] for i in range(len(centroids))]))
    return centroids


def fit(sample: list[tuple[str, str]], dims: int = DIMS, clusters: int = CLUSTERS) -> Model | None:
    """A model from (language, text) pairs; None without any."""
    grams = Grams(dims)
    sample = sorted(s for s in sample if any(c.isalpha() for c in s[1]))
    if not sample:
        return None
    counts, letters = (np.concatenate(x) for x in zip(*(grams.counts([t.encode() for _, t in sample[i : i + 64]]) for i in range(0, len(sample), 64)), strict=True))
    languages = sorted({s[0] for s in sample})
    label = np.array([languages.index(s[0]) for s in sample])
    idf = (np.log((1 + len(sample)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = unit(np.log1p(counts) * idf)
    per = [kmeans(vectors[label == i], clusters) for i in range(len(languages))]
    owner = np.repeat(np.arange(len(languages)), [len(c) for c in per])
    centroids = np.concatenate(per).astype(np.float32)
    own = np.where(owner[None, :] == label[:, None], vectors @ centroids.T, -1).max(axis=1)
    near = [(int(n), float(c)) for n, c in zip(letters, own, strict=True)]
    for size in PIECE_LETTERS:
        some = [(i, t[len(t) // 3 :][: size + size // 4 + 1]) for i, (_, t) in enumerate(sample) if len(t) > 2 * size]
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            c, n = grams.counts([t.encode() for _, t in part])
            cosine = np.where(owner[None, :] == label[[i for i, _ in part]][:, None], unit(np.log1p(c) * idf) @ centroids.T, -1).max(axis=1)
            near += [(int(a), float(b)) for a, b in zip(n, cosine, strict=True) if a]
    radii = np.zeros(24)
    for bucket in range(len(radii)):
        reached = [c for n, c in near if n and int(np.log2(n)) == bucket]
        radii[bucket] = np.percentile(reached, 1) / 2 if len(reached) >= 20 else (radii[bucket - 1] if bucket else 0.0)
    return Model(languages, idf, centroids, owner, radii)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, language_bytes: int = LANGUAGE_BYTES, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """(lang, text) of a bounded sample; see above."""
    able = pick(docs, "doc_id", "lang", "text").where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")))
    # A language's share of ids by hash, about four times the bound, so that the ranking sees as many rows whatever the table's size.
    counts = able.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages are labelled")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = docs.sparkSession.createDataFrame(counts, "lang string, n long")
    drawn = able.select("lang", "doc_id").join(F.broadcast(known), "lang").where(draw * F.col("n") <= 4 * per_language)  # `languages` rows
    order = Window.partitionBy("lang").orderBy(draw, "doc_id")
    ids = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("doc_id").distinct()
    return [(r.lang, r.text) for r in drawn_texts(able, ids, language_bytes, "lang").collect()]  # bounded by rows and bytes


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(len(model.idf) if model else DIMS)
        for b in slices(batches, most=BYTES, rows=ROWS):
            texts = as_bytes(b.column(1))
            counts, letters = grams.counts(texts)
            some = letters > 0
            pred, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~some
            if model:
                best, cosine = model.nearest(counts)
                pred = [model.languages[i] if x else UNKNOWN for i, x in zip(best, some, strict=True)]
                score, out = np.where(some, cosine, 0.0).astype(float), ~some | (cosine < model.radius(letters))
            yield pa.record_batch([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out)], names=["doc_id", "lang_pred", "score", "rejected"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rejected boolean")


def digest(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    model = fit(training_sample(docs, per_language))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows that are not rejected, with their own columns, in one pass."""
    model, names, at = fit(training_sample(docs, per_language)), docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(len(model.idf) if model else DIMS)
        for b in slices(batches, column=names[at], most=BYTES, rows=ROWS):
            counts, letters = grams.counts(as_bytes(b.column(at)))
            kept = letters > 0
            if model:
                kept &= model.nearest(counts)[1] >= model.radius(letters)
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(lean(run), docs.schema)
