"""A training-data pipeline: classify, deduplicate, decontaminate, mask, encode.

Each stage works on all that its predecessor kept. Between stages the rows are written to
the shared folder, so a lost executor costs one stage's task, not the chain.

Decisions are by row, never by id alone: the classifier scores each row, near copies are told by id
and text, and contamination is a property of a text. So a null id, or one that stands on several
rows, decides for no other row.

Cases: a null text counts as empty; it is scored from its statistics and is in no group of near copies;
equal rows of one id are copies, of which one stays; an empty table passes through; columns beside
``documents``' own are carried to the last stage, whatever their names, and are not in its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm import bpe, decontaminate, jaccard_join, pii, quality_model
from evalspark.llm.queries import table, vocabulary
from evalspark.session import cut_lineage

#: Documents scored below this go.
LEAST_QUALITY = 0.3


def _own(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    machine = quality_model.train(docs, table(spark, sf_dir, "labels"))
    score = _own(docs, "score")
    return quality_model.score(docs, machine, docs.columns, score).where(F.col(score) >= LEAST_QUALITY).select(*_columns(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return jaccard_join.one_per_group(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark window."""
    texts = docs.select(F.md5("text").alias("doc_id"), "text")
    found = decontaminate.decontaminate(texts, table(spark, sf_dir, "benchmark"))
    name = _own(docs, "_hit")
    hit = cut_lineage(found.where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(hit, F.md5("text") == F.col(name), "left_anti").select(*_columns(docs))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind."""
    return pii.mask_personal_data(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document as one text, what they decode to, and digests of both."""
    coded = bpe.round_trip_digests(docs, vocabulary("byte_bpe_50k.json"), with_lists=True, with_text=True)
    return coded.withColumn("ids", F.concat_ws(",", F.col("ids").cast("array<string>")))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("BPE encoding", encoding_stage),
]

#: SQL cannot train the classifier; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents: per document kept its token ids, its masked text as decoded from them, and digests."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
