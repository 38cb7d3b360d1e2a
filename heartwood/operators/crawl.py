"""Crawling a table of fetched pages (url, html, status_code): breadth first, level by level.

Pages are parsed once, into a graph of their links. A level is one join of the frontier with the graph, within the folders of
the frontier's hosts, and one anti-join with what was visited of these hosts. Each level is written down, so that plans don't
grow with the depth, a lost executor costs one level at most, and a crawl can go on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import html_links, html_page
from ..functions.urls import crawlable, doc_name, domain
from ..sources.tables import in_batches, kept, scratch


def page_links(pages: DataFrame) -> DataFrame:
    """url, link: each link of a page once, absolute and without fragment. Pages with one URL are one page with the links of all."""
    return _linked(pages).select("url", F.explode("links").alias("link"))


def _linked(pages: DataFrame) -> DataFrame:
    """url, links (each once), n_links (of all the pages with this URL)."""
    each = in_batches(pages).select("url", html_links(F.col("html"), F.col("url")).alias("links"))
    one = each.groupBy("url").agg(F.collect_set("links").alias("l"), F.sum(F.size("links")).cast("long").alias("n_links"))
    return one.select("url", F.array_distinct(F.flatten("l")).alias("links"), "n_links")


def successful(status: Column) -> Column:
    return status.between(200, 299)


def fetched(pages: DataFrame) -> DataFrame:
    """The pages whose fetch succeeded; pages without a status were fetched."""
    return pages.where(successful(F.col("status_code"))) if "status_code" in pages.columns else pages


class LinkGraph:
    """The links of a table of pages, in a folder that all executors see: each page is parsed once, when the graph is built.

    Rows are dealt into folders by host, so that a level of a crawl reads the folders of its frontier's hosts alone; a host
    of very many pages is written by several tasks. Levels of a crawl are tables of their own: what a level found, with the
    links that lead on, so that the next one reads no page again. A crawl that died goes on with its last whole level."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.edges = spark.read.schema("url string, links array<string>, n_links long, bucket int").parquet(f"{path}/edges")

    @classmethod
    def build(cls, pages: DataFrame, path: str) -> LinkGraph:
        """Write the graph of the pages that were fetched with success. Pages with one URL are one page with the links of all."""
        edges = _linked(fetched(pages)).withColumn("bucket", host_bucket(F.col("url")))
        edges.repartition("bucket", F.pmod(F.xxhash64("url"), F.lit(PARTS))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/edges")
        return cls(pages.sparkSession, path)

    def _within(self, table: DataFrame, buckets: list[int]) -> DataFrame:
        return table if len(buckets) == BUCKETS else table.where(F.col("bucket").isin(buckets))

    def _buckets(self, urls: DataFrame) -> list[int]:
        return [r[0] for r in urls.select(host_bucket(F.col("url")).alias("b")).distinct().collect()]  # at most BUCKETS

    def levels(self, name: str) -> DataFrame:
        """url, found, links, n_links, bucket, level of the whole levels of a crawl."""
        schema = "url string, found boolean, links array<string>, n_links long, bucket int, level int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/crawls/{name}")

    def _done(self, name: str) -> int:
        """How many levels of a crawl were written whole."""
        jvm = self.spark._jvm
        at = lambda k: jvm.org.apache.hadoop.fs.Path(f"{self.path}/crawls/{name}/level={k}/_SUCCESS")
        fs, k = at(0).getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        while fs.exists(at(k)):
            k += 1
        return k

    def crawl(self, start: str, depth: int = 1, max_pages: int | None = None, same_domain: bool = True, url_filter: Column | None = None, name: str | None = None) -> DataFrame:
        """url, level, found: as crawl() below. name: of a crawl to begin, or to go on with; its other arguments must be those
        that it was begun with."""
        name = name or uuid.uuid4().hex
        base, first = domain(F.lit(start)), self._done(name)
        frontier = self.spark.createDataFrame([(start,)], "url string") if not first else None
        found = self.levels(name).where(F.col("level") < first).where("found").count() if first else 0
        for level in range(first, depth + 1):
            if max_pages is not None and found >= max_pages:
                break
            if frontier is None:
                frontier = self._onward(name, level, base if same_domain else None, url_filter)
                if frontier is None:
                    break
            edges = self._within(self.edges, self._buckets(frontier)).withColumn("found", F.lit(True)).drop("bucket")
            there = _joined(frontier, edges).withColumns({"found": F.coalesce("found", F.lit(False)), "bucket": host_bucket(F.col("url"))})
            if max_pages is not None:
                # Places are given to pages that were found; of the others, those before the last place.
                there = kept(there)
                last = there.where("found").orderBy("url").limit(max_pages - found).agg(F.max("url"), F.count("*")).first()
                there = there.where(F.col("url") <= last[0]) if last[1] == max_pages - found else there
            there.select("url", "found", "links", "n_links", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/crawls/{name}/level={level}")
            found += self.levels(name).where((F.col("level") == level) & F.col("found")).count()
            frontier = None
        self.last = name
        return self.levels(name).where(F.col("level") <= depth).select("url", "level", "found")

    def _onward(self, name: str, level: int, base: Column | None, url_filter: Column | None) -> DataFrame | None:
        """The links of a level that lead to what wasn't visited yet; None where there are none."""
        every = self.levels(name)
        links = every.where((F.col("level") == level - 1) & F.col("found")).select(F.explode("links").alias("url")).distinct().where(crawlable(F.col("url"), base))
        links = kept(links.where(url_filter) if url_filter is not None else links)
        visited = self._within(every.where(F.col("level") < level), self._buckets(links))
        frontier = kept(links.join(visited.select("url").hint("merge"), "url", "left_anti"))
        return None if frontier.isEmpty() else frontier

    def statistics(self, name: str | None = None) -> DataFrame:
        """One row: pages found, pages failed, and links on the found pages, of a crawl (the last one if None)."""
        return self.levels(name or self.last).agg(F.count_if("found").alias("success_count"), F.count_if(~F.col("found")).alias("failed_count"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("total_links"))


#: Folders that hosts are dealt into, and tasks that write one at most.
BUCKETS, PARTS = 64, 16


#: URLs of a frontier that are sent to all tasks; a larger one is exchanged.
SENT = 20_000


def _joined(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """frontier with its edges where there are such. The graph isn't collected, however well its files are compressed: a
    small frontier is sent to where the graph is read, and a large one meets it in an exchange of both."""
    if frontier.limit(SENT + 1).count() > SENT:
        return frontier.join(edges.hint("merge"), "url", "left")
    there = kept(edges.join(F.broadcast(frontier), "url"))
    gone = frontier.join(F.broadcast(there.select("url")), "url", "left_anti")
    return there.unionByName(gone, allowMissingColumns=True)


def host_bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(domain(url)), F.lit(BUCKETS)).cast("int")


def crawl(pages: DataFrame | LinkGraph, start: str, depth: int = 1, max_pages: int | None = None, same_domain: bool = True, url_filter: Column | None = None) -> DataFrame:
    """url, level, found (whether pages has it, with a status of success): what a crawl from `start` visits, `depth` levels down. The start is taken
    as it is given. url_filter: a condition on a column `url`. max_pages: at most so many found pages; within a level, in
    the order of their URLs. Pages that failed aren't counted and their links aren't followed."""
    graph = pages if isinstance(pages, LinkGraph) else LinkGraph.build(pages, scratch(pages.sparkSession, "links"))
    return graph.crawl(start, depth, max_pages, same_domain, url_filter)


def crawl_statistics(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages found, pages failed (not there, or with another status), and links on the found pages. Where the crawl
    went by a graph, its statistics() parse no page."""
    links = _linked(fetched(pages).join(visited.where("found").select("url"), "url", "left_semi")).agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("total_links"))
    return visited.agg(F.count_if("found").alias("success_count"), F.count_if(~F.col("found")).alias("failed_count")).crossJoin(links)


def page_documents(pages: DataFrame) -> DataFrame:
    """Documents (doc_name, content, description, metadata) made of fetched pages; of equal names the page of the greatest
    URL. A page is parsed once; fetched_at is added to the metadata where the table has it."""
    made = in_batches(fetched(pages)).withColumn("_p", html_page(F.col("html"))).withColumns({"_title": F.col("_p.title"), "_meta": F.col("_p.metadata")})
    when = [F.lit("fetched_at"), F.col("fetched_at").cast("string")] if "fetched_at" in pages.columns else []
    own = F.create_map(F.lit("type"), F.lit("web"), F.lit("url"), "url", F.lit("domain"), domain(F.col("url")), F.lit("original_title"), "_title", *when)
    made = made.select(
        doc_name(F.col("url")).alias("doc_name"), F.col("_p.markdown").alias("content"),
        F.coalesce(F.element_at("_meta", "description"), F.lit("")).alias("description"), F.map_concat(F.map_filter("_meta", lambda k, v: ~k.isin("type", "url", "domain", "original_title", "fetched_at")), own).alias("metadata"), "url",
    )
    return made.groupBy("doc_name").agg(F.max_by(F.struct("content", "description", "metadata"), "url").alias("d")).select("doc_name", "d.*")
