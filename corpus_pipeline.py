"""A corpus pipeline of five training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps,
with the columns of ``docs``; the last returns the packed pieces.  Between
stages the documents are written as Parquet and read again.

Defined cases, for every stage: null and empty texts stay (they score as clean,
hold no shingles, repeats or windows, and pack as an end id); a null id is an id
like any other, learnt from where its hash says so; repeated rows are judged
alike and kept, but for the second stage, where rows of one class, and rows of
equal id and text, become one document, the one of the lowest id (a tie: any
of its equal rows); an empty table gives no rows; columns named like one that an
operator adds keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardrank.llm import decontam, jaccard, queries, suffixes, toxicity
from wardrank.llm.common import id_remainder, read_table, stored

#: A passage of 50 words in bytes, at four letters and a space a word: shorter
#: repeats (idioms, names, lines of a form) stay.
PASSAGE_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    learnt = id_remainder("doc_id", 5) != 0
    labels = read_table(spark, sf_dir, "labels").where(learnt)
    model = toxicity.train_toxicity(docs.where(learnt), labels)
    score = "_toxicity"
    while score in docs.columns:
        score += "_"
    scored = toxicity.score_toxicity(docs, model, out=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of repeated strings of ``PASSAGE_BYTES``."""
    return suffixes.without_repeats(docs, length=PASSAGE_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    # columns named like one that the operator adds are set aside
    aside = {c: f"_own_{c}" for c in decontam.ADDED.names if c in docs.columns}
    found = decontam.find_contamination(docs.withColumnsRenamed(aside), read_table(spark, sf_dir, "benchmark"))
    clean = found.where(F.size("hit_spans") == 0)
    return clean.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences."""
    return queries.packed_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL cannot express the stages; ``tests/llm/test_pipeline.py`` compares each
#: with plain Python on documents planted for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
