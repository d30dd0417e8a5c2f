"""A corpus pipeline: language ID, near-duplicate removal, repeat removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Its
result is written as Parquet in the shared folder and read again as the next stage's docs, so a lost executor costs at
most the stage at hand. Every stage works on all rows that its predecessor kept.

Defined cases: null and empty texts have no language and go in the first stage; given to a later stage they are one
group of near-duplicates, have no repeats, size 0 in the mix (so are not taken), and one end token each in a sequence.
Of near-duplicates the smallest doc_id stays (null last; ties by a hash of the text), and repeated rows, equal in id
and text, are one. An empty table gives empty results. Columns of other names are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import langid, mixing, packing, repeats, similar
from marlstone.llm.common import documents, fresh_path, remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; texts without letters, or unlike any language learned, go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: candidates of op3's index and of bands, linked if their sets of five-word
    shingles are 0.8 or more alike, compared shingle by shingle."""
    return similar.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without strings of 100 bytes and more that occurred before."""
    return repeats.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every row with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Fingerprints and token ids can't be expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:  # nothing reads the stage before the last any more
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
