"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import alignment, decontamination, negatives, ngram_join, oracle, packing, perspectives, quality, sanitising, sharding, suffix_dedup, token_counts, topk, toxicity
from tamis.llm.common import read


def op3_heavy_light_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate_perspectives(read(spark, sf_dir, "conversations")).select(
        F.col("dialogue").alias("conv_id"), "perspective", "part", "start", "text", "n_messages",
        F.array_join(
            F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ","
        ).alias("masks"),
    )


def op2_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed_documents(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        "sequence_id", "offset",
    )


def op5_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _one_if(kind: str) -> Callable:
    return lambda x: F.when(x == kind, 1)


def op7_cooccurrence_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitising.personal_spans(read(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    terms = F.transform(
        "terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))
    )
    counts = [
        F.size(F.array_compact(F.transform("base.kind", _one_if(kind)))).cast("long").alias(f"n_{kind}")
        for kind in ("email", "ip", "card", "phone")
    ]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", terms)).alias("spans"),
    )


def op8_folded_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lexicon = toxicity.learn(docs, labels.where(~held_out))
    return toxicity.score(docs, lexicon).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_term_at_a_time_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op10_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(read(spark, sf_dir, "documents"))


def op12_slot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", relabelled)
    return negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op13_discriminant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = quality.document_statistics(read(spark, sf_dir, "documents"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    classifier = quality.learn(described, read(spark, sf_dir, "labels").where(~held_out))
    return quality.score(described, classifier).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_perspective_rotation": op1_perspective_rotation,
    "op2_residual_packing": op2_residual_packing,
    "op3_heavy_light_ngram_join": op3_heavy_light_ngram_join,
    "op4_prefix_sum_shards": op4_prefix_sum_shards,
    "op5_suffix_merge_dedup": op5_suffix_merge_dedup,
    "op6_winnowing_decontamination": op6_winnowing_decontamination,
    "op7_cooccurrence_sanitising": op7_cooccurrence_sanitising,
    "op8_folded_lexicon_toxicity": op8_folded_lexicon_toxicity,
    "op9_term_at_a_time_top_k": op9_term_at_a_time_top_k,
    "op10_transducer_token_counts": op10_transducer_token_counts,
    "op11_interval_alignment": op11_interval_alignment,
    "op12_slot_hard_negatives": op12_slot_hard_negatives,
    "op13_discriminant_quality": op13_discriminant_quality,
}

LLM_ORACLE_SQL = {
    "op1_perspective_rotation": oracle.OP1,
    "op4_prefix_sum_shards": oracle.OP4,
    "op6_winnowing_decontamination": oracle.OP6,
    "op9_term_at_a_time_top_k": oracle.OP9,
    "op12_slot_hard_negatives": oracle.OP12,
}
