"""Registered queries of what keeps a knowledge base usable at scale: indexes, increments, crawls, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import crawl, markdown, reasoning, segmented, tree, vector_index, vectors
from .oracles import _CHATS, _OUTLINE, ORACLES
from .plans import corpora, incremental
from .plans.knowledge_base import KnowledgeBase
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes])


# ---- vector search by an index


def _named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpora.table(spark, sf_dir, "embeddings")
    node = F.format_string("%04d", "vec_id")
    return e.select("vec_id", F.format_string("doc-%d", "label").alias("doc_name"), node.alias("node_id"), F.concat(F.lit("vector "), node).alias("title"), F.col("embedding").alias("vector"))


@query(ORACLES["vec_topk"])
def vec_index_exact(spark, sf_dir):
    """The best twenty of all vectors, from those cells alone whose bounds don't rule them out."""
    rows = _named_vectors(spark, sf_dir)
    index = vector_index.VectorIndex.build(vector_index.entries(rows), tables.scratch(spark, "vector_index"))
    first = rows.where("vec_id = 0").first()["vector"]
    return index.search(first, top_k=20, threshold=-2.0).select("doc_name", "node_id", F.round("score", 6).alias("score"))


@query(ORACLES["vec_chunk_search"])
def vec_index_chunks(spark, sf_dir):
    """Nodes with their pieces, as in vec_chunk_search, by the index."""
    e = corpora.table(spark, sf_dir, "embeddings").withColumn("node_id", F.format_string("%04d", F.floor(F.col("vec_id") / 5)))
    named = e.select(F.lit("all").alias("doc_name"), "node_id", F.col("node_id").alias("title"), (F.col("vec_id") % 5).alias("chunk_no"), F.col("embedding").alias("vector"))
    pieces = named.where("chunk_no > 0")
    index = vector_index.VectorIndex.build(vector_index.entries(named.where("chunk_no = 0"), pieces), tables.scratch(spark, "vector_index"))
    hits = index.search([1.0 / 8] * 64, top_k=25, threshold=-1.0)
    counted = pieces.groupBy("doc_name", "node_id").agg(F.count("*").alias("n_chunks"))
    return hits.join(counted, ["doc_name", "node_id"], "left").select("doc_name", "node_id", F.round("score", 6).alias("score"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


@query("SELECT count(*)::BIGINT AS n_queries, true AS recalled FROM embeddings WHERE vec_id % 20 = 0")
def vec_index_recall(spark, sf_dir):
    """Every twentieth vector as a query of the index, of which as many cells are opened as 64 other queries show to be needed:
    whether 0.95 of the ten best of all vectors are found. Products that tie with the tenth count."""
    rows = _named_vectors(spark, sf_dir)
    index = vector_index.VectorIndex.build(vector_index.entries(rows), tables.scratch(spark, "vector_index"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = index.search_many(asked, 10, index.probes_for(0.98)).select("query_id", F.round("score", 6).alias("score"))
    every = vector_index.exact_many(rows, asked).select("query_id", F.round("score", 6).alias("s"))
    tenth = every.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("s"), False), F.least(F.count("*"), F.lit(10)).cast("int") - 1).alias("tenth"), F.least(F.count("*"), F.lit(10)).alias("of"))
    found = tenth.join(got, "query_id", "left").groupBy("query_id", "of").agg(F.count_if(F.col("score") >= F.col("tenth")).alias("n"))
    return found.agg(F.count("*").alias("n_queries"), (F.sum("n") >= 0.95 * F.sum("of")).alias("recalled"))


# ---- a stored knowledge base, brought up to date


def _synced(spark: SparkSession, sf_dir: str) -> incremental.StoredBase:
    """The outline, stored; then documents of Asia grow, those of Europe go, and a new one comes."""
    docs = corpora.outline(spark, sf_dir)
    stored = incremental.StoredBase(spark, tables.scratch(spark, "stored_base"), buckets=16)
    stored.sync(docs)
    grown = F.when(F.col("doc_name").startswith("AS"), F.concat(F.lit("# New\n## First\n"), "content")).otherwise(F.col("content"))
    later = docs.where("doc_name NOT LIKE 'E%'").withColumn("content", grown)
    stored.sync(later.unionByName(spark.range(1).select(F.lit("EXTRA").alias("doc_name"), F.lit("# One\ntext").alias("content"))))
    return stored


_SYNCED = f"""WITH {_OUTLINE}, n AS (SELECT doc_name, count(*) + CASE WHEN doc_name LIKE 'AS%' THEN 2 ELSE 0 END AS nodes, sum(length(content)) + CASE WHEN doc_name LIKE 'AS%' THEN 13 ELSE 0 END AS chars FROM t WHERE doc_name NOT LIKE 'E%' GROUP BY doc_name
UNION ALL SELECT 'EXTRA', 1, 10)"""


@query(f"{_SYNCED} SELECT doc_name, nodes::BIGINT AS total_nodes, nodes::BIGINT AS n_vectors FROM n")
def incremental_build(spark, sf_dir):
    """What a second sync leaves, document by document, with the vectors that are stored of it."""
    kb = _synced(spark, sf_dir).base()
    vectors_of = kb.node_vectors.groupBy("doc_name").agg(F.count("*").alias("n_vectors"))
    return kb.nodes.groupBy("doc_name").agg(F.count("*").alias("total_nodes")).join(vectors_of, "doc_name")


@query(f"{_SYNCED} SELECT sum(chars)::BIGINT AS total_chars, (sum(chars) // 3)::BIGINT AS estimated_tokens, sum(nodes)::BIGINT AS total_nodes, count(*)::BIGINT AS total_documents FROM n")
def incremental_statistics(spark, sf_dir):
    """Figures of the whole after a second sync, summed over buckets."""
    return _synced(spark, sf_dir).statistics()


@query(f"WITH {_OUTLINE} SELECT DISTINCT doc_name, 2::BIGINT AS version FROM t WHERE doc_name LIKE 'E%'")
def incremental_tombstones(spark, sf_dir):
    return _long(_synced(spark, sf_dir).tombstones().select("doc_name", "version"))


# ---- crawls over a graph of links


def _page_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as a web: each one, at an address with its number, links to those of twice its number and one and two more."""
    pages = corpora.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?id="), F.col("page_id").cast("string")).alias("url"), "html")
    links = pages.select(F.floor((F.col("page_id") - 1) / 2).alias("page_id"), F.concat(F.lit('<a href="'), "url", F.lit('#top">x</a>')).alias("a")).where("page_id >= 0")
    joined = pages.join(links.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list("a")), "").alias("a")), "page_id", "left")
    return joined.select("page_id", "url", F.concat("html", F.coalesce("a", F.lit(""))).alias("html"))


_WEB_URL = "regexp_replace(url, '[?#].*$', '') || '?id=' || page_id"


@query(f"SELECT {_WEB_URL} AS url, floor(log2(page_id + 1))::BIGINT AS level FROM pages")
def crawl_graph(spark, sf_dir):
    """Every page, as a crawl of the whole web comes upon it."""
    pages = _page_web(spark, sf_dir)
    graph = crawl.LinkGraph.build(pages, tables.scratch(spark, "links"))
    visited = graph.crawl(pages.where("page_id = 0").first()["url"], depth=40, same_domain=False)
    return _long(visited.where("found").select("url", "level"))


@query(f"SELECT {_WEB_URL} AS url, floor(log2(page_id + 1))::BIGINT AS level FROM pages WHERE page_id < 31")
def crawl_graph_resumed(spark, sf_dir):
    """A crawl that stops after three levels and goes on to five."""
    pages = _page_web(spark, sf_dir)
    graph = crawl.LinkGraph.build(pages, tables.scratch(spark, "links"))
    start = pages.where("page_id = 0").first()["url"]
    graph.crawl(start, depth=2, same_domain=False, name="one")
    visited = crawl.LinkGraph(spark, graph.path).crawl(start, depth=4, same_domain=False, name="one")
    return _long(visited.where("found").select("url", "level"))


# ---- prompts of a bounded size, and searches by reasoning through the facade


@query(f"""WITH {_OUTLINE}, v AS (SELECT doc_name, level, row_number() OVER (PARTITION BY doc_name, level ORDER BY pos) AS k FROM t WHERE level <= 2),
c AS (SELECT doc_name, string_agg(content, chr(10) ORDER BY pos) AS content, first(title ORDER BY pos) AS title FROM t GROUP BY doc_name)
SELECT doc_name, count(*)::BIGINT AS n_nodes, true AS within, md5(title || '|' || substring(content, 1, 500)) AS shown_md5 FROM v JOIN c USING (doc_name) WHERE level = 1 OR k <= 5 GROUP BY doc_name, title, content""")
def packed_prompts(spark, sf_dir):
    """The first round's prompts at 1500 characters: how many nodes those of a document show together, whether all keep to the
    budget, and the title and description that they begin with."""
    docs = corpora.outline(spark, sf_dir)
    found = tree.nodes(markdown.sections(docs)).withColumn("summary", F.substring("raw_content", 1, 200))
    told = docs.withColumn("description", F.col("content")).join(markdown.titles(docs), "doc_name")
    prompts = reasoning.view_prompts(tree.high_level_view(found), "candidates", "q", ["doc_name"], told, budget=1500)
    read = F.from_json("prompt", "title string, description string, nodes array<struct<node_id:string>>")
    each = prompts.select("doc_name", F.length("prompt").alias("size"), read.alias("p"))
    return each.groupBy("doc_name").agg(F.sum(F.size("p.nodes")).cast("long").alias("n_nodes"), (F.max("size") <= 1500).alias("within"), F.md5(F.concat_ws("|", F.min("p.title"), F.min("p.description"))).alias("shown_md5"))


@query("")
def reasoning_mode(spark, sf_dir):
    """A search by reasoning alone, through the facade."""
    kb = KnowledgeBase.of(corpora.outline(spark, sf_dir))
    return kb.search("machinery of nation 3", mode="reasoning").select("doc_name", "node_id", "title", F.round("final_score", 6).alias("final_score"), "source")


# ---- one document in many parts


@query(f"""WITH {_CHATS}, n AS (SELECT *, substring(doc_name, 6)::BIGINT AS k FROM s),
g AS (SELECT *, row_number() OVER (ORDER BY k, turn) AS p, sum(n_lines) OVER (ORDER BY k, turn) AS e FROM n)
SELECT p::BIGINT AS pos, format('{{:04d}}', p) AS node_id, title, level::BIGINT AS level, (e - n_lines + 1)::BIGINT AS start_line, (CASE level WHEN 1 THEN max(e) OVER (PARTITION BY k) ELSE e END)::BIGINT AS end_line,
CASE level WHEN 2 THEN format('{{:04d}}', min(p) OVER (PARTITION BY k)) END AS parent_id, (level - 1)::BIGINT AS depth, (CASE level WHEN 1 THEN max(p) OVER (PARTITION BY k) ELSE p END)::BIGINT AS last_pos FROM g""")
def one_document(spark, sf_dir):
    """The tree of all conversations as one document, each of them a part."""
    parts = corpora.chats(spark, sf_dir).select(F.lit("all").alias("doc_name"), F.substring("doc_name", 6, 20).cast("long").alias("part"), "content")
    found = segmented.nodes(segmented.sections(parts))
    return _long(found.select("pos", "node_id", "title", "level", "start_line", "end_line", "parent_id", "depth", "last_pos"))


# ---- crawled pages, saved with their indexes and read again


@query("SELECT 'web_' || page_id AS doc_name, 2::BIGINT AS n_nodes, 6::BIGINT AS total_lines, page_id % 7 AS body FROM pages")
def saved_crawl(spark, sf_dir):
    """A web of small pages, one for each page of the table: crawled, saved as Markdown and as indexes, and read as index files."""
    n = F.col("page_id")
    url = lambda k: F.concat(F.lit("http://web/"), k.cast("string"))
    a = lambda k: F.concat(F.lit('<a href="'), url(k), F.lit('"></a>'))
    html = F.concat(F.lit("<title>T"), n.cast("string"), F.lit("</title><h1>H</h1><p>"), (n % 7).cast("string"), F.lit("</p>"), a(2 * n + 1), a(2 * n + 2))
    pages = corpora.table(spark, sf_dir, "pages").select(url(n).alias("url"), html.alias("html"))
    kb = KnowledgeBase.of(corpora.outline(spark, sf_dir).limit(0)).crawl(pages, "http://web/0", depth=40, max_pages=10_000_000)
    path = tables.scratch(spark, "saved_crawl")
    kb.save_documents(path)
    docs, nodes = tables.index_files(spark, f"{path}/index")
    counted = nodes.groupBy("doc_name").agg(F.count("*").alias("n_nodes"), F.max(F.when(F.col("title") == "H", F.regexp_extract("content", "(?s)([0-9]+)\\s*$", 1))).cast("long").alias("body"))
    return docs.join(counted, "doc_name").select("doc_name", "n_nodes", F.col("total_lines").cast("long").alias("total_lines"), "body")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if v}
