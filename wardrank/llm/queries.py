"""Registered queries of the training-data operators (their SQL: ``oracle``)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, brown, decontam, importance, jaccard, linecrf, packing, recompression, sharding, suffixes, tokencount, toxicity,
    wrapper,
)
from .common import id_remainder, read_table, text_or_empty
from .oracle import ORACLE_SQL  # noqa: F401

#: Fixed value: how the byte-level BPE cuts a text before merging.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_join(docs).select("doc_id", "class_id", "class_size", "n_links")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_spans(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("group"))
    out = sharding.shard_by_bytes(docs, 40, F.col("size"), F.col("group"), F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontam.hit_words().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = brown.score_texts(docs, id_remainder("doc_id", 10) != 0)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = linecrf.train_crf(docs, read_table(spark, sf_dir, "labels"))
    return linecrf.judge(docs, model).drop("text")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of all ``docs`` with their places in sequences of 2048."""
    encode = packing.BpeEncoder(tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), BPE_PATTERN)
    pieces = packing.token_pieces(docs, encode)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencount.read_vocabulary(tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    good = importance.labelled_sample(docs, labels, "doc_id", "quality", at_most=20_000)
    share = labels.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]  # as many as are good by the labels
    return importance.resample(docs, good, keep=1.0 if share is None else share)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    learnt = id_remainder("doc_id", 5) != 0
    model = toxicity.train_toxicity(docs.where(learnt), labels.where(learnt))
    scored = toxicity.score_toxicity(docs, model, out="score")
    return scored.select("doc_id", (~learnt).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text); in a tenth of them, by hash of the id, the
    words from a place on repeat their first ``p``."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text_or_empty(), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    cut = cut.withColumn("n", F.size(F.coalesce("w", F.array())).cast("long"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.expr("concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, p), int((n - a) div p + 1))), 1, int(n - a)))")
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = recompression.find_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = found.select("doc_id", "runs", "collapsed", longest.alias("b"), F.concat_ws("\n", listed, F.when(F.size("runs") > 0, "")).alias("list"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"),
        (-F.col("b.p")).alias("period"), F.expr("1000 * b.length div -b.p").alias("exponent_milli"),
        F.sha2("list", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    a = alignment.ByteTokens(tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), BPE_PATTERN)
    out = alignment.align(docs, a, alignment.PieceTokens(tokenizers.path("piece_bpe_32k.model")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *out.columns[1:])


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrapper.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scores": op5_lm_scores,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_alignment": op12_alignment,
    "op13_html_text": op13_html_text,
}
