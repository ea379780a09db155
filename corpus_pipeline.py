"""The corpus pipeline: five operators of samplegrid.llm applied to documents, each to all that its predecessor kept.

Rows without an id are judged by their texts and kept where these are clean. Rows that repeat are judged alike; near_dedup
leaves one of those that repeat a doc_id. Null texts are empty. Columns besides doc_id and text are carried, whatever their names; n_chars,
if there is one, is counted anew where a text is changed. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplegrid.llm import bpe, decontam, minhash, secrets, toxicity
from samplegrid.llm.common import discard, materialize, small
from samplegrid.llm.queries import VOCAB, held_out, table

#: Per cent of shingles that near duplicates share, in this pipeline; op3 has its own.
SIMILAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the toxicity model predicts as toxic. The model learns from labels that are not held out;
    labels without an id or a class are not used, and without labels of both kinds nothing is dropped unless all are toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Rows without an id or without words stay."""
    return minhash.deduplicate(docs, SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that leak an item of the benchmark. Rows without an id and null texts stay."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(small(materialize(found, "leaks")), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every span that the secret scan reports, base or linked, cut from the text; every row stays."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row; a null text has no ids and decodes to ''."""
    # written in between: chained, both steps would hold a Python worker each for every core, also in later stages
    out = bpe.decode(materialize(bpe.encode(docs, VOCAB), "ids"), VOCAB)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", tokenize),
]

#: Learned scores, near-duplicate components and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*done)
        done = [docs]
    return docs
