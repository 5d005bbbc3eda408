"""The queries of this subpackage, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import (
    alignment, anchors, conversations, html, jaccard, lines, mtree, packing, suffixes, token_counts, token_store, toxicity,
    winnowing,
)
from terrapanel.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op10_token_binary")
def token_binary(spark, sf_dir):
    path = scratch_path(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_html_text")
def html_text(spark, sf_dir):
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op4_substring_dedup", anchors.ORACLE)
def substring_dedup(spark, sf_dir):
    kept = anchors.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_benchmark_decontamination", winnowing.ORACLE)
def benchmark_decontamination(spark, sf_dir):
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        winnowing.is_contaminated().alias("contaminated"),
    )


@query("op6_line_dedup", lines.ORACLE)
def line_dedup(spark, sf_dir):
    kept = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op6_line_dedup_whole")
def line_dedup_whole(spark, sf_dir):
    kept = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op1_toxicity")
def toxicity_scores(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("bigint").alias("n_passages"))


@query("op7_ngram_jaccard_join")
def ngram_jaccard_join(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op8_exact_top_k", mtree.ORACLE)
def exact_top_k(spark, sf_dir):
    vectors = mtree.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree.top_k(vectors, vectors.filter(F.col("id") % 100 == 0))


@query("op3_token_counts")
def edited_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.counts_after_edits(docs, token_counts.example_edits(docs))
    return counted.select(
        "doc_id", "n_before", "n_tokens", "n_edits", "chars_encoded", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op12_token_alignment")
def token_alignment(spark, sf_dir):
    return alignment.align_corpus(table(spark, sf_dir, "documents"))[0]


@query("op13_conversation_repair")
def conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    whole, parts = conversations.repair(conversations.damaged(turns))
    whole = whole.withColumn("sha256", F.sha2(conversations.joined(F.col("turns")), 256))
    ids = turns.select(F.col("conv_id").cast("bigint")).distinct()
    out = ids.join(whole.withColumnRenamed("conv_id", "_w"), F.col("conv_id").eqNullSafe(F.col("_w")), "left")
    digests = conversations.part_digests(parts).select(F.col("conv_id").alias("_p"), F.col("sha256").alias("_digest"))
    out = out.join(digests, F.col("conv_id").eqNullSafe(F.col("_p")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("sha256", "_digest", F.sha2(F.lit("").cast("binary"), 256))
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), digest.alias("repaired_sha256"))


@query("op11_suffix_array_dedup", suffixes.ORACLE)
def suffix_array_dedup(spark, sf_dir):
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
