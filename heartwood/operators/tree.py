"""The forest of a document's sections, as a flat table of nodes, and what is asked of it.

A node's subtree is an interval of positions: pos..last_pos. Parents, paths and intervals come from two sorts of a
document's headings: for every level the last one before a row (its open ancestors), and from the end, the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6


def nodes(found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """sections -> nodes: with node_id (0001.. in document order), parent_pos, parent_id, depth, path, last_pos, and
    end_line widened to the end of the last descendant. levels: the deepest level that occurs; a deeper one raises an error
    (a table of contents may give levels over 6: deepest() finds them out). Other columns stay."""
    too_deep = F.raise_error(F.concat(F.lit("a section of level "), F.col("level").cast("string"), F.lit(f" where levels={levels}")))
    found = found.withColumn("level", F.when(F.col("level") > levels, too_deep).otherwise(F.col("level")))
    before = Window.partitionBy("doc_name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_name").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    every = range(levels + 1)
    last = [F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(before) for k in every]
    nxt = [F.last(F.when(F.col("level") == k, F.struct("pos", "start_line")), ignorenulls=True).over(after) for k in every]
    out = found.select("*", F.array(*last).alias("_last"))
    return linked(out.select("*", F.array(*nxt).alias("_next"), F.max("end_line").over(Window.partitionBy("doc_name")).alias("_total"), F.max("pos").over(Window.partitionBy("doc_name")).alias("_n")))


def linked(out: DataFrame) -> DataFrame:
    """Nodes of sections that know the last heading of each level before them (_last: pos, title), the next one behind them
    (_next: pos, start_line), and their document's lines (_total) and headings (_n)."""
    above = F.slice("_last", 1, F.col("level"))  # the last heading of each smaller level
    # Of these, an ancestor is one that no heading of a smaller level follows.
    live = F.filter(above, lambda x, i: x.isNotNull() & (x["pos"] > F.coalesce(F.array_max(F.transform(F.slice("_last", 1, i), lambda y: y["pos"])), F.lit(0))))
    out = out.withColumn("_live", live)
    # The next heading that isn't below this one ends its subtree: sections follow each other without gaps.
    out = out.withColumn("_until", F.array_min(F.slice("_next", 1, F.col("level") + 1)))
    out = out.withColumns({
        "node_id": node_id(F.col("pos")), "parent_pos": F.get(F.col("_live"), F.size("_live") - 1)["pos"], "depth": F.size("_live"),
        "path": F.concat(F.transform("_live", lambda x: x["title"]), F.array("title")), "last_pos": F.coalesce(F.col("_until.pos") - 1, F.col("_n")), "end_line": F.coalesce(F.col("_until.start_line") - 1, F.col("_total")),
    })
    return out.withColumn("parent_id", node_id(F.col("parent_pos"))).drop("_last", "_next", "_total", "_n", "_live", "_until")


def deepest(found: DataFrame) -> int:
    """The deepest level of sections, LEVELS at least."""
    return max(LEVELS, found.agg(F.max("level")).first()[0] or 0)


def path_to(tree: DataFrame, wanted: str) -> DataFrame:
    """doc_name, pos, node_id, title of a node and its ancestors, from the root down."""
    target = find(tree, wanted).select("doc_name", F.col("pos").alias("_at"))
    return tree.join(target, "doc_name").where(F.col("_at").between(F.col("pos"), F.col("last_pos"))).select("doc_name", "pos", "node_id", "title")


def node_id(pos: Column) -> Column:
    return F.when(pos.isNotNull(), F.format_string("%04d", pos))


def find(tree: DataFrame, wanted: str) -> DataFrame:
    """The first node with this id of each document."""
    first = Window.partitionBy("doc_name").orderBy("pos")
    return tree.where(F.col("node_id") == wanted).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def node_map(tree: DataFrame) -> DataFrame:
    """One row for each id of a document: of equal ids the last node, of empty ids none."""
    last = Window.partitionBy("doc_name", "node_id").orderBy(F.desc("pos"))
    return tree.where("node_id <> ''").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def contents_table(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """doc_name, toc: an indented line `- [id] title` for each node down to max_depth levels (all if None or 0)."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- ["), "node_id", F.lit("] "), "title")
    shown = tree.where(F.col("depth") < max_depth) if max_depth else tree
    by_pos = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return shown.groupBy("doc_name").agg(F.array_join(F.transform(by_pos, lambda x: x["line"]), "\n").alias("toc"))


def high_level_view(tree: DataFrame, children: int = 5) -> DataFrame:
    """Each root with its summary's first 200 characters, and its first children with 150."""
    rank = F.row_number().over(Window.partitionBy("doc_name", "parent_pos").orderBy("pos"))
    view = tree.where("depth <= 1").withColumn("child_rank", F.when(F.col("depth") == 1, rank)).where(F.col("child_rank").isNull() | (F.col("child_rank") <= children))
    return view.select("doc_name", "pos", "node_id", "title", F.substring("summary", 1, F.when(F.col("depth") == 0, 200).otherwise(150)).alias("summary"), (F.col("last_pos") > F.col("pos")).alias("has_children"), "depth", "child_rank")


def enhanced_view(tree: DataFrame, max_depth: int = 3) -> DataFrame:
    """Nodes down to max_depth below the roots, with shortened summaries and their lines."""
    lines = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return tree.where(F.col("depth") <= max_depth).select("doc_name", "pos", "node_id", "title", "level", "depth", F.substring("summary", 1, 200).alias("summary"), lines.alias("line_range"))


def below(hits: DataFrame, tree: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_name, node_id) hits with each node of their subtrees, themselves first: of_id, and the node's columns. An
    equality on the document goes before the interval of positions, so that the join is never a loop over all pairs."""
    tops = hits.select("doc_name", F.col("node_id").alias("of_id")).distinct().join(tree.select("doc_name", F.col("node_id").alias("of_id"), F.col("pos").alias("_first"), F.col("last_pos").alias("_last"), F.col("depth").alias("_depth")), ["doc_name", "of_id"])
    inside = tree.join(tops, "doc_name").where(F.col("pos").between(F.col("_first"), F.col("_last")))
    inside = inside.withColumn("rel_depth", F.col("depth") - F.col("_depth")).drop("_first", "_last", "_depth")
    return inside.where(F.col("rel_depth") <= depth) if depth is not None else inside


#: Intervals and nodes of a document meet in buckets of so many positions.
BUCKET = 1024


def outermost(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_name, top, top_last, hits: the intervals of those (doc_name, node_id) hits that lie in no other hit's, with all hits
    in them (pos, last_pos, node_id). They don't overlap. Reads no texts; of equal ids the last node counts, empty ids none."""
    found = tree.select("doc_name", "node_id", "pos", "last_pos").join(hits.select("doc_name", "node_id").distinct(), ["doc_name", "node_id"])
    by_pos = Window.partitionBy("doc_name").orderBy("pos")
    covered = F.coalesce(F.max("last_pos").over(by_pos.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("pos"), F.lit(False))
    tops = node_map(found).withColumn("_top", F.when(~covered, F.col("pos"))).withColumn("top", F.max("_top").over(by_pos))
    return tops.groupBy("doc_name", "top").agg(F.max("last_pos").alias("top_last"), F.sort_array(F.collect_list(F.struct("pos", "last_pos", "node_id"))).alias("hits"))


def subtree_contents(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_name, node_id, content: the contents (or else summaries) of each hit's subtree in document order, parted by an empty
    line. Hits without any text have no row.

    A node goes to the one outermost hit above it, however many hits lie between; what is under that is put in order
    once, and each hit is a slice of it. So nodes outside of hits aren't exchanged, and none is exchanged twice."""
    tops = outermost(hits, tree)
    bucket = lambda pos: F.floor(pos / BUCKET)
    spans = tops.select("doc_name", "top", "top_last", F.explode(F.sequence(bucket(F.col("top")), bucket(F.col("top_last")))).alias("_bucket"))
    text = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("summary", F.lit("")))
    inside = tree.select("doc_name", "pos", text.alias("_text"), bucket(F.col("pos")).alias("_bucket")).join(spans, ["doc_name", "_bucket"]).where("pos BETWEEN top AND top_last")
    by_top = inside.groupBy("doc_name", "top").agg(F.sort_array(F.collect_list(F.struct("pos", "_text"))).alias("_texts")).join(tops, ["doc_name", "top"])

    def content(hit: Column) -> Column:
        # Positions without gaps are places; in a tree that lacks nodes they must be looked for.
        whole = F.size("_texts") == F.col("top_last") - F.col("top") + 1
        at = F.slice("_texts", hit["pos"] - F.col("top") + 1, hit["last_pos"] - hit["pos"] + 1)
        part = F.when(whole, at).otherwise(F.filter("_texts", lambda x: x["pos"].between(hit["pos"], hit["last_pos"])))
        return F.array_join(F.filter(F.transform(part, lambda x: x["_text"]), lambda x: x != ""), "\n\n")

    each = F.transform("hits", lambda h: F.struct(h["node_id"].alias("node_id"), content(h).alias("content")))
    # An outer explode: for a plain one the optimizer tests the array's size below, where texts would be joined twice.
    return by_top.select("doc_name", F.explode_outer(each).alias("_hit")).select("doc_name", "_hit.*").where("content <> ''")


def first_roots(tree: DataFrame, each: int = 3, relevance: float = 0.5) -> DataFrame:
    """The first roots of each document, as candidates when a completer fails."""
    rank = F.row_number().over(Window.partitionBy("doc_name").orderBy("pos"))
    return tree.where("depth = 0").withColumn("_n", rank).where(F.col("_n") <= each).select("doc_name", "node_id", F.lit(relevance).alias("relevance"))


def statistics(tree: DataFrame) -> DataFrame:
    """One row: characters, tokens (three characters each), nodes and documents."""
    chars = F.coalesce(F.sum(F.length("content")), F.lit(0))
    return tree.agg(chars.alias("total_chars"), F.floor(chars / 3).alias("estimated_tokens"), F.count("*").alias("total_nodes"), F.count_distinct("doc_name").alias("total_documents"))


def listing(tree: DataFrame, docs: DataFrame) -> DataFrame:
    """Each document with its number of nodes and of nodes with a summary."""
    with_summary = F.count_if(F.coalesce("summary", F.lit("")) != "")
    counted = tree.groupBy("doc_name").agg(F.count("*").alias("total_nodes"), with_summary.alias("nodes_with_summary"))
    listed = docs.select("doc_name", F.substring("description", 1, 200).alias("description")).join(counted, "doc_name", "left")
    n, s = F.coalesce("total_nodes", F.lit(0)), F.coalesce("nodes_with_summary", F.lit(0))
    return listed.select("doc_name", "description", n.alias("total_nodes"), s.alias("nodes_with_summary"), (n == s).alias("has_full_summary"))


def summary_coverage(tree: DataFrame) -> DataFrame:
    """One row: nodes, nodes with a summary, and their share."""
    with_summary = F.count_if(F.coalesce("summary", F.lit("")) != "")
    return tree.agg(F.count("*").alias("total_nodes"), with_summary.alias("nodes_with_summary")).withColumn("coverage", F.try_divide("nodes_with_summary", "total_nodes"))
