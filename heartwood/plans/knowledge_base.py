"""A knowledge base: documents, their trees and vectors, and the searches over them."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.providers import Completer, Embedder, completed, completer, embedded, embedder
from ..functions.text import without_thinking
from ..operators import crawl as crawling
from ..operators import fusion, markdown, reasoning, tree, vectors
from ..operators.vector_index import VectorIndex
from ..operators.vector_index import entries as vector_entries
from ..sources import tables
from ..sources.config import Settings


def index(docs: DataFrame, by: Completer | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, tree) of Markdown documents (doc_name, content): sections as nodes with parents, paths and intervals.
    With a completer, empty summaries and descriptions are filled in. The tree is written down once: vectors, views and
    contexts all read it."""
    heads = tables.kept(markdown.headings(docs))
    nodes = tree.nodes(markdown.sections(docs, heads)).withColumn("summary", F.lit(""))
    own = [c for c in ("description", "source_file", "metadata") if c in docs.columns]
    known = docs.select("doc_name", "content", *own, F.size(markdown.lines_of(F.coalesce("content", F.lit("")))).alias("total_lines")).join(markdown.titles(docs, heads), "doc_name")
    for c in ("description", "source_file"):
        known = known if c in own else known.withColumn(c, F.lit(""))
    if by is not None:
        nodes = reasoning.summarised(nodes, by)
        known = reasoning.described(known, nodes, by)
    return known, tables.kept(nodes)


@dataclass
class KnowledgeBase:
    """Immutable: what adds documents returns a new one. All parts are DataFrames; the tree and its vectors are written down."""

    docs: DataFrame
    nodes: DataFrame
    node_vectors: DataFrame
    chunk_vectors: DataFrame
    settings: Settings
    embed: Embedder
    ask: Completer
    vector_index: VectorIndex | None = None

    @classmethod
    def of(cls, docs: DataFrame, settings: Settings | None = None, summarise: bool = False) -> KnowledgeBase:
        settings = settings or Settings()
        e, a = embedder(settings.embedder), completer(settings.completer)
        known, nodes = index(docs, a if summarise else None)
        # Vectors are written down: a model is asked once for each text, not at every search.
        of_nodes, of_chunks = vectors.node_vectors(nodes, e), vectors.chunk_vectors(nodes, e, settings.vector.chunk_size)
        return cls(known, nodes, tables.kept(of_nodes), tables.kept(of_chunks), settings, e, a)

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Settings | None = None) -> KnowledgeBase:
        settings = settings or Settings()
        parts = [spark.read.parquet(f"{path}/{name}") for name in ("docs", "nodes", "node_vectors", "chunk_vectors")]
        return cls(*parts, settings, embedder(settings.embedder), completer(settings.completer))

    def save(self, path: str) -> None:
        """Parquet tables, those of vectors without the texts. Contents and vectors can be read without each other."""
        for name in ("docs", "nodes", "node_vectors", "chunk_vectors"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def add(self, docs: DataFrame, summarise: bool = False) -> KnowledgeBase:
        """With new documents, which replace those of the same name, vectors included."""
        new = KnowledgeBase.of(docs, self.settings, summarise)
        parts = {name: tables.upserted(getattr(self, name), getattr(new, name)) for name in ("docs", "nodes")}
        for name in ("node_vectors", "chunk_vectors"):
            parts[name] = tables.missing(getattr(self, name), new.docs).unionByName(getattr(new, name))
        return replace(self, vector_index=None, **parts)

    def indexed(self, path: str, cells: int | None = None) -> KnowledgeBase:
        """With an index of its vectors in a folder, which vector searches then go by. What is added later leaves it behind."""
        pieces = self.chunk_vectors if self.settings.vector.use_chunk_aggregation else None
        return replace(self, vector_index=VectorIndex.build(vector_entries(self.node_vectors, pieces), path, cells))

    def add_missing(self, docs: DataFrame) -> KnowledgeBase:
        """With those documents whose names aren't known yet."""
        return self.add(tables.missing(docs, self.docs))

    def crawl(self, pages: DataFrame, start: str, depth: int = 0, max_pages: int = 10) -> KnowledgeBase:
        """With documents made of the pages that a crawl finds."""
        seen = crawling.crawl(pages, start, depth, max_pages).where("found").select("url")
        return self.add(crawling.page_documents(pages.join(seen, "url", "left_semi")))

    def save_documents(self, path: str) -> None:
        """The documents' Markdown below path/markdown, and their nested indexes below path/index: as a crawl's pages are kept."""
        tables.write_markdown(self.docs, f"{path}/markdown")
        tables.write_indexes(self.docs, self.nodes, f"{path}/index")

    def cleared(self) -> KnowledgeBase:
        """Without its vectors; documents and trees stay."""
        return replace(self, node_vectors=self.node_vectors.limit(0), chunk_vectors=self.chunk_vectors.limit(0), vector_index=None)

    def statistics(self) -> DataFrame:
        return tree.statistics(self.nodes)

    def documents(self) -> DataFrame:
        return tree.listing(self.nodes, self.docs)

    def query_vector(self, query: str) -> DataFrame:
        """One row: the query's vector."""
        return tables.kept(self.docs.sparkSession.range(1).select(embedded(F.lit(query), self.embed).alias("vector")))

    def vector_hits(self, query: str, top_k: int, threshold: float) -> DataFrame:
        pieces = self.chunk_vectors if self.settings.vector.use_chunk_aggregation else None
        if self.vector_index is not None:
            hits = self.vector_index.search(self.query_vector(query).first()["vector"], top_k, threshold)
        else:
            hits = vectors.vector_search(self.node_vectors, pieces, self.query_vector(query), top_k, threshold)
        return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_name", "node_id")))

    def search(self, query: str, mode: str | None = None) -> DataFrame:
        """doc_name, node_id, title, final_score, vector_score, reasoning_score, reasoning, source: the best max_results."""
        s, mode = self.settings, mode or self.settings.mode
        if mode == "vector":
            hits = self.vector_hits(query, s.max_results, s.vector.threshold)
            return fusion.fuse(hits, _no_reasoning(hits), s.max_results, 1.0, 1.0)
        if mode == "reasoning":
            found = reasoning.tree_search(self.nodes, query, self.ask, s.max_results, s.min_relevance, self.docs)
            return fusion.fuse(_no_vectors(found), found, s.max_results, 1.0, 1.0)
        if mode != "hybrid":
            raise ValueError(f"unknown mode {mode!r}")
        hits = tables.kept(self.vector_hits(query, s.vector.top_k, s.vector.threshold))
        if hits.isEmpty():
            return self.search(query, "reasoning")
        # Documents of the best hits alone are reasoned about: a semi-join keeps the others' trees out of the prompts.
        near = self.nodes.join(hits.where(F.col("rank") <= s.reasoning.max_candidates).select("doc_name").distinct(), "doc_name", "left_semi")
        found = reasoning.tree_search(near, query, self.ask, s.reasoning.max_candidates, s.min_relevance, self.docs)
        return fusion.fuse(hits, found, s.max_results, s.hybrid.vector_weight, s.hybrid.reasoning_weight)

    def contexts(self, hits: DataFrame) -> DataFrame:
        order = Window.orderBy(F.desc("final_score"), "doc_name", "node_id")
        return fusion.contexts(hits.select("doc_name", "node_id", F.col("final_score").alias("relevance"), F.row_number().over(order).alias("rank")), self.nodes)

    def query(self, query: str, mode: str | None = None) -> DataFrame:
        """One row: context, source_files, relevance_scores, and the characters and tokens of the knowledge base."""
        if not query:
            raise ValueError("a query is needed")
        found = tables.kept(self.contexts(self.search(query, mode)))
        size = self.statistics().select("total_chars", "estimated_tokens")
        return fusion.combined(found).crossJoin(fusion.source_files(found)).crossJoin(fusion.relevance_map(found)).crossJoin(size).withColumn("mode", F.lit(mode or self.settings.mode))

    def chat(self, message: str, mode: str | None = None) -> DataFrame:
        """One row: answer, context. The completer sees the context of the search; line feeds separate its parts."""
        context = fusion.combined(tables.kept(self.contexts(self.search(message, mode))), with_doc=False)
        prompt = F.to_json(F.struct(F.lit("answer").alias("task"), F.lit(message).alias("query"), "context"))
        return completed(context.withColumn("prompt", prompt), self.ask).select(F.trim(without_thinking(F.coalesce("reply", F.lit("")))).alias("answer"), "context")

    def analyze(self, query: str) -> tuple[DataFrame, DataFrame]:
        """(sub-questions of a query, the view of the trees that a completer would be shown)."""
        asked = self.docs.sparkSession.createDataFrame([(query,)], "query string")
        return reasoning.decomposed(asked, self.ask), tree.enhanced_view(self.nodes)


def _no_reasoning(hits: DataFrame) -> DataFrame:
    return hits.sparkSession.createDataFrame([], "doc_name string, node_id string, title string, score double, reasoning string, rank int")


def _no_vectors(hits: DataFrame) -> DataFrame:
    return hits.sparkSession.createDataFrame([], "doc_name string, node_id string, title string, score double, rank int")


def echo(settings: Settings) -> str:
    """The settings in force, as JSON."""
    from dataclasses import asdict

    return json.dumps(asdict(settings), ensure_ascii=False)
