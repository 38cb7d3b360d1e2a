"""Fusion of vector hits and reasoning hits, contexts of hits, and figures about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tree import node_map, subtree_contents

VECTOR_WEIGHT, REASONING_WEIGHT = 0.4, 0.6


def fuse(vector: DataFrame, reasoning: DataFrame, max_results: int = 10, vector_weight: float = VECTOR_WEIGHT, reasoning_weight: float = REASONING_WEIGHT) -> DataFrame:
    """doc_name, node_id, title, final_score, vector_score, reasoning_score, reasoning, source of the best hits.

    vector: doc_name, node_id, title, score, rank; reasoning: doc_name, node_id, title, score, reasoning, rank. Of equal
    reasoning hits the last one counts, and they are `both` even without a vector hit. Scores are weighed and added; ties
    go by the vector's rank, then by the first rank of a reasoning hit."""
    keys = ["doc_name", "node_id"]
    v = vector.groupBy(*keys).agg(F.max_by(F.struct("title", "score"), "rank").alias("v"), F.min("rank").alias("_vrank"))
    r = reasoning.groupBy(*keys).agg(F.max_by(F.struct("score", "reasoning"), "rank").alias("r"), F.min_by("title", "rank").alias("_rtitle"), F.count("*").alias("_n"), F.min("rank").alias("_rrank"))
    both = v.join(r, keys, "full_outer")
    vs, rs = F.col("v.score"), F.col("r.score")
    final = F.when(rs.isNull(), vs * vector_weight).otherwise(F.coalesce(vs, F.lit(0.0)) * vector_weight + rs * reasoning_weight)
    source = F.when(rs.isNull(), "vector").when(vs.isNotNull() | (F.col("_n") > 1), "both").otherwise("reasoning")
    fused = both.select(*keys, F.coalesce("v.title", "_rtitle").alias("title"), final.alias("final_score"), vs.alias("vector_score"), rs.alias("reasoning_score"), F.col("r.reasoning").alias("reasoning"), source.alias("source"), "_vrank", "_rrank")
    return fused.orderBy(F.desc("final_score"), F.asc_nulls_last("_vrank"), "_rrank", *keys).limit(max_results).drop("_vrank", "_rrank")


def sources(fused: DataFrame) -> DataFrame:
    return fused.groupBy("source").agg(F.count("*").alias("n"))


def contexts(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_name, node_id, title, content (of the whole subtree), relevance: each hit once (its first by rank), unknown
    nodes left out, best first. hits: doc_name, node_id, relevance (null: 0.5), rank."""
    first = Window.partitionBy("doc_name", "node_id").orderBy("rank")
    once = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    known = once.join(node_map(tree).select("doc_name", "node_id", "title"), ["doc_name", "node_id"])
    full = known.select("doc_name", "node_id", "title", F.coalesce("relevance", F.lit(0.5)).alias("relevance"), "rank").join(subtree_contents(once, tree), ["doc_name", "node_id"], "left")
    return full.select("doc_name", "node_id", "title", F.coalesce("content", F.lit("")).alias("content"), "relevance", "rank")


def combined(found: DataFrame, with_doc: bool = True) -> DataFrame:
    """One row `context`: the contexts under headings, best first. They are those of one answer: a few hits."""
    head = F.concat(F.lit("## ["), "doc_name", F.lit("] "), "title") if with_doc else F.concat(F.lit("## "), "title")
    part = F.struct((-F.col("relevance")).alias("r"), "rank", F.concat(head, F.lit("\n"), "content").alias("part"))
    return found.agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), "\n\n").alias("context"))


def savings(found: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row: characters of the knowledge base and of the contexts, and the share saved in percent."""
    used = found.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("context_chars"))
    both = statistics.select(F.col("total_chars").alias("kb_chars")).crossJoin(used)
    share = F.when(F.col("kb_chars") > 0, F.round((F.col("kb_chars") - F.col("context_chars")) * 100.0 / F.col("kb_chars"), 1))
    return both.select("kb_chars", "context_chars", F.floor(F.col("context_chars") / 3).alias("context_tokens"), share.alias("saved_percent"))


def source_files(found: DataFrame) -> DataFrame:
    return found.agg(F.array_sort(F.collect_set("doc_name")).alias("source_files"))


def relevance_map(found: DataFrame) -> DataFrame:
    """One row `relevance_scores`: a map from doc_name:node_id to the relevance."""
    return found.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "doc_name", "node_id"), "relevance"))).alias("relevance_scores"))
