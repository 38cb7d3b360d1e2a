"""Chunks, vectors and vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.providers import Embedder, embedded
from ..functions.text import strip

# Sizes of chunks, where they break if they can, and the least content that is chunked.
CHUNK, OVERLAP, CHUNKED_FROM = 500, 50, 100
BREAKS = (". ", "。", "\n", "! ", "? ")


def chunk_pattern(size: int, overlap: int) -> str:
    """The pattern whose matches, one behind the other, are what each piece adds to the one before. The first piece is up to
    `size` long; a later one adds up to size - overlap. A piece ends behind the last break of the first kind that begins in
    its second half; the last piece takes what is left."""

    def ends(most: int, half: int) -> str:
        return "|".join([rf".{{{half + 1},{most - len(b)}}}\Q{b}\E" for b in BREAKS] + [f".{{{most}}}"])

    later = size - overlap
    return rf"(?s)\A(?:{ends(size, size // 2)})|.{{1,{later}}}+\z|{ends(later, size // 2 - overlap)}"


def text_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """array<string>: overlapping pieces of a text of up to `size` characters, without white space at their ends; empty ones
    are left out. A text of at most `size` characters is one piece as it is; a null or empty one has none. Time grows with
    the text's length alone: the text is tiled by one pattern, and each piece is the end of the tiles before with its own."""
    if size <= 2 * overlap:
        raise ValueError("size must be more than twice the overlap")
    # A tile but the last is longer than this, so that so many of them hold the overlap.
    back = -(-overlap // (size // 2 - overlap + 2))
    tiles = F.regexp_extract_all(text, F.lit(chunk_pattern(size, overlap)), F.lit(0))

    def piece(all_tiles: Column, tile: Column, i: Column) -> Column:
        if back == 0:
            return tile
        before = F.array_join(F.slice(all_tiles, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), "")
        return F.concat(F.right(before, F.lit(overlap)), tile)

    # Tiles are bound once, as the only element of an array.
    pieces = F.transform(F.array(tiles), lambda t: F.transform(t, lambda x, i: strip(piece(t, x, i))))[0]
    whole = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) > size, F.filter(pieces, lambda p: p != "")).otherwise(whole)


def chunks(df: DataFrame, text: str = "content", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df with one row for each piece of its text: chunk_no (from 0) and chunk. Texts of at most CHUNKED_FROM characters, and
    null, have none."""
    # An outer explode: for a plain one the optimizer tests the array's size below, where texts would be cut twice.
    long = df.where(F.length(text) > CHUNKED_FROM)
    return long.select("*", F.posexplode_outer(text_chunks(F.col(text), size, overlap)).alias("chunk_no", "chunk")).where("chunk IS NOT NULL")


def text_to_embed(summary: Column, title: Column) -> Column:
    """The summary, or else the title; null if both are empty."""
    return F.coalesce(F.nullif(summary, F.lit("")), F.nullif(title, F.lit("")))


def node_vectors(tree: DataFrame, by: Embedder) -> DataFrame:
    """doc_name, node_id, title, level, vector of every node that has a summary or a title."""
    told = tree.withColumn("_text", text_to_embed(F.col("summary"), F.col("title"))).where("_text IS NOT NULL")
    return told.select("doc_name", "node_id", "title", "level", embedded(F.col("_text"), by).alias("vector"))


def chunk_vectors(tree: DataFrame, by: Embedder, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_name, node_id, chunk_no, vector of every piece of the nodes' contents."""
    return chunks(tree.select("doc_name", "node_id", "content"), "content", size, overlap).select("doc_name", "node_id", "chunk_no", embedded(F.col("chunk"), by).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_search(nodes: DataFrame, pieces: DataFrame | None, query: Column | DataFrame, top_k: int = 10, threshold: float = 0.0) -> DataFrame:
    """doc_name, node_id, title, score, chunk_scores of the best top_k nodes with a score of threshold or more. A node's
    score is the greater of its own product with the query and sum(pieces) / sqrt(pieces + 1); pieces: None for nodes alone.

    query: a literal vector, or one row with a column `vector`, which is broadcast: a text is embedded once, not beside each
    row. Scores of pieces are summed in the task that has them before they are exchanged; the best nodes are taken without
    a full sort."""
    if isinstance(query, DataFrame):
        one = F.broadcast(query.select(F.col("vector").alias("_query")).limit(1))
        nodes, pieces, query = nodes.crossJoin(one), None if pieces is None else pieces.crossJoin(one), F.col("_query")
    scored = nodes.select("doc_name", "node_id", "title", dot(F.col("vector"), query).alias("_own"))
    if pieces is not None:
        each = pieces.select("doc_name", "node_id", F.struct("chunk_no", dot(F.col("vector"), query).alias("s")).alias("c"))
        by_node = each.groupBy("doc_name", "node_id").agg(F.sum("c.s").alias("_sum"), F.count("*").alias("_n"), F.sort_array(F.collect_list("c")).alias("_c"))
        scored = scored.join(by_node, ["doc_name", "node_id"], "left")
        score = F.greatest(F.col("_own"), F.col("_sum") / F.sqrt(F.col("_n") + 1))
        lists = F.coalesce(F.transform("_c", lambda c: c["s"]), F.array().cast("array<double>"))
    else:
        score, lists = F.col("_own"), F.array().cast("array<double>")
    hits = scored.select("doc_name", "node_id", "title", score.alias("score"), lists.alias("chunk_scores"))
    return hits.where(F.col("score") >= threshold).orderBy(F.desc("score"), "doc_name", "node_id").limit(top_k)


def vector_statistics(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row: nodes, chunks, dimension, documents."""
    a = nodes.agg(F.count("*").alias("total_nodes"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"), F.count_distinct("doc_name").alias("total_documents"))
    return a.crossJoin(pieces.agg(F.count("*").alias("total_chunks")))
