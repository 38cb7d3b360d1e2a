"""Search by a completer that reads the tree: candidates from a high-level view, then a look below each one.

Prompts are JSON objects of a bounded size, one or more for each query and document (never one for all documents), asked in
Arrow batches on the executors. A reply's JSON is parsed strictly; what isn't JSON gives no rows, a missing reply gives the fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import html_cleaned, html_title, html_to_simple_markdown
from ..functions.providers import Completer, completed, strict_json
from ..functions.text import clean_reply, json_body, preview, unwrap_fence, without_thinking
from ..sources.tables import in_batches, kept
from .tree import below, contents_table, enhanced_view, first_roots, high_level_view

NODE_LIST = "array<struct<doc_name:string,node_id:string,relevance:double,reason:string>>"


def parsed(reply: Column, schema: str) -> Column:
    """The reply as a struct; null fields where it isn't JSON."""
    return F.from_json(strict_json(json_body(without_thinking(reply))), schema)


def _ask(prompts: DataFrame, by: Completer) -> DataFrame:
    """Prompts with replies, written down so that a model isn't asked again when rows are read twice or executors are lost."""
    return kept(completed(prompts, by))


#: Characters of a prompt at most, of a title and of a description that it shows; three characters count as a token.
BUDGET, TITLE, DESCRIPTION = 24_000, 300, 500


def view_prompts(view: DataFrame, task: str, query: str, keys: list[str], docs: DataFrame | None = None, description: int = DESCRIPTION, budget: int = BUDGET) -> DataFrame:
    """The keys (doc_name first), part and prompt: a view's nodes in as many prompts as the budget asks for, in document order
    and each in one of them. docs: title and description of documents, which every prompt of a document begins with.

    Where a node goes follows from how much stands before it, so that no task holds more than one prompt's nodes."""
    shown = [c for c in ("level", "has_children", "line_range") if c in view.columns]
    cut = view.select(*keys, "pos", F.struct("node_id", F.substring("title", 1, TITLE).alias("title"), *shown, "summary").alias("node"))
    about = [F.lit(task).alias("task"), F.lit(query).alias("query"), *[F.col(k) for k in keys]]
    if docs is not None:
        told = docs.select("doc_name", F.substring("title", 1, TITLE).alias("doc_title"), F.substring(F.coalesce("description", F.lit("")), 1, description).alias("description"))
        cut = cut.join(told, "doc_name", "left")
        about += [F.col("doc_title").alias("title"), F.col("description")]
    else:
        cut = cut.withColumns({"doc_title": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
    head, size = F.length(F.to_json(F.struct(*about))) + 64, F.length(F.to_json("node")) + 1
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_size").over(group.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A part takes what begins within its room; the last of it may go over that by its own size.
    sized = cut.withColumn("_size", size).withColumn("_room", F.greatest(F.lit(budget) - head - F.max("_size").over(group), F.lit(1)))
    parts = sized.withColumn("part", F.floor(before / F.col("_room")).cast("int"))
    listed = parts.groupBy(*keys, "part", "doc_title", "description").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("nodes"))
    return listed.select(*keys, "part", F.to_json(F.struct(*about, "part", F.transform("nodes", lambda n: n["node"]).alias("nodes"))).alias("prompt"))


def place(part: Column, i: Column) -> Column:
    """The place of a reply's entry among those of all parts."""
    return part.cast("long") * 1_000_000 + i


def candidates(tree: DataFrame, query: str, by: Completer, docs: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """doc_name, node_id, relevance, reason: what the completer picks from each document's roots and their first children.
    Without any reply, the document's first roots at 0.5. docs: titles and descriptions to show."""
    asked = _ask(view_prompts(high_level_view(tree), "candidates", query, ["doc_name"], docs, budget=budget), by)
    got = asked.where("reply IS NOT NULL").select("doc_name", "part", F.posexplode(parsed(F.col("reply"), f"candidates {NODE_LIST}")["candidates"]).alias("i", "c"))
    got = got.select(F.coalesce("c.doc_name", "doc_name").alias("doc_name"), F.col("c.node_id").alias("node_id"), F.coalesce("c.relevance", F.lit(0.5)).alias("relevance"), F.coalesce("c.reason", F.lit("")).alias("reason"), place(F.col("part"), F.col("i")).alias("ord"))
    unanswered = asked.groupBy("doc_name").agg(F.count("reply").alias("n")).where("n = 0").select("doc_name")
    lost = first_roots(tree.join(unanswered, "doc_name", "left_semi"))
    return got.unionByName(lost.select("doc_name", "node_id", "relevance", F.lit("Fallback selection").alias("reason"), F.lit(0).cast("long").alias("ord")))


def deep_search(found: DataFrame, tree: DataFrame, query: str, by: Completer, budget: int = BUDGET) -> DataFrame:
    """doc_name, node_id, title, score, reasoning, ord: leaves pass as they are; for other candidates the completer picks
    nodes up to three levels below. An id it makes up stands for the candidate at 0.8 of its relevance, a missing reply
    for the candidate itself, an empty choice for nothing. Unknown candidates are left out; equal ones stay."""
    known = found.join(tree.select("doc_name", "node_id", "title", "pos", "last_pos"), ["doc_name", "node_id"])
    leaves = known.where("pos = last_pos").select("doc_name", "node_id", "title", F.col("relevance").alias("score"), F.col("reason").alias("reasoning"), "ord")
    inner = known.where("pos < last_pos").select("doc_name", F.col("node_id").alias("of_id"), F.col("title").alias("_title"), "relevance", "reason", "ord")
    view = below(inner.select("doc_name", F.col("of_id").alias("node_id")), tree, 3).withColumn("summary", F.substring("summary", 1, 200))
    asked = _ask(view_prompts(view.drop("level"), "select", query, ["doc_name", "of_id"], budget=budget), by)
    replies = inner.join(asked.select("doc_name", "of_id", "reply"), ["doc_name", "of_id"])
    unanswered = asked.groupBy("doc_name", "of_id").agg(F.count("reply").alias("n")).where("n = 0").select("doc_name", "of_id")
    lost = inner.join(unanswered, ["doc_name", "of_id"]).select("doc_name", F.col("of_id").alias("node_id"), F.col("_title").alias("title"), F.col("relevance").alias("score"), F.col("reason").alias("reasoning"), "ord")
    picked = replies.where("reply IS NOT NULL").select("*", F.explode(parsed(F.col("reply"), f"selected_nodes {NODE_LIST}")["selected_nodes"]).alias("s"))
    names = tree.select("doc_name", F.col("node_id").alias("_id"), F.col("title").alias("_of_id"))
    picked = picked.withColumn("_id", F.col("s.node_id")).join(names, ["doc_name", "_id"], "left")
    real = F.col("_of_id").isNotNull()
    score = F.when(real, F.coalesce("s.relevance", "relevance")).otherwise(F.col("relevance") * 0.8)
    picked = picked.select("doc_name", F.when(real, F.col("_id")).otherwise(F.col("of_id")).alias("node_id"), F.coalesce("_of_id", "_title").alias("title"), score.alias("score"), F.coalesce("s.reason", "reason").alias("reasoning"), "ord")
    return leaves.unionByName(lost).unionByName(picked)


def ranked(hits: DataFrame, max_results: int | None, min_relevance: float | None) -> DataFrame:
    """hits with rank from 1, best first."""
    good = hits if min_relevance is None else hits.where(F.col("score") >= min_relevance)
    order = [F.desc("score"), F.col("doc_name"), F.col("node_id"), F.col("ord")]
    good = good.orderBy(*order).limit(max_results) if max_results is not None else good
    return good.withColumn("rank", F.row_number().over(Window.orderBy(*order)) if max_results is not None else F.row_number().over(Window.partitionBy("doc_name").orderBy(*order)))


def tree_search(tree: DataFrame, query: str, by: Completer, max_results: int = 10, min_relevance: float = 0.3, docs: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """The two rounds: candidates, then nodes below them; the best max_results of min_relevance or more. The tree's
    structure, without contents, is read several times and so written down once."""
    tree = kept(tree.select("doc_name", "pos", "last_pos", "parent_pos", "depth", "node_id", "title", "summary"))
    return ranked(deep_search(candidates(tree, query, by, docs, budget), tree, query, by, budget), max_results, min_relevance)


def single_round_search(tree: DataFrame, query: str, by: Completer, max_results: int | None = 5, docs: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """One round over each document's nodes to depth 3; no least relevance applies. docs: titles and descriptions to show."""
    asked = _ask(view_prompts(enhanced_view(tree), "candidates", query, ["doc_name"], docs, 300, budget), by)
    got = asked.select("doc_name", "part", F.posexplode(F.coalesce(parsed(F.col("reply"), f"candidates {NODE_LIST}, node_list {NODE_LIST}")["node_list"], parsed(F.col("reply"), f"candidates {NODE_LIST}")["candidates"])).alias("i", "c"))
    got = got.select(F.coalesce("c.doc_name", "doc_name").alias("doc_name"), F.col("c.node_id").alias("node_id"), F.coalesce("c.relevance", F.lit(0.5)).alias("score"), F.coalesce("c.reason", F.lit("")).alias("reasoning"), place(F.col("part"), F.col("i")).alias("ord"))
    known = got.join(tree.select("doc_name", "node_id", "title"), ["doc_name", "node_id"])
    return ranked(known.select("doc_name", "node_id", "title", "score", "reasoning", "ord"), max_results, None)


def search_with_fallback(tree: DataFrame, query: str, by: Completer, max_results: int = 10, min_relevance: float = 0.3, docs: DataFrame | None = None) -> DataFrame:
    """The two rounds, and where they find nothing at all, one round over the whole trees."""
    found = kept(tree_search(tree, query, by, max_results, min_relevance, docs))
    return single_round_search(tree, query, by, max_results, docs) if found.isEmpty() else found


def summarised(tree: DataFrame, by: Completer) -> DataFrame:
    """tree with summaries where they are empty and there is content (its first 2000 characters are shown)."""
    empty = (F.coalesce("summary", F.lit("")) == "") & (F.trim("raw_content") != "")
    prompts = tree.where(empty).select("doc_name", "pos", F.to_json(F.struct(F.lit("summary").alias("task"), "title", F.substring("raw_content", 1, 2000).alias("content"))).alias("prompt"))
    new = _ask(prompts, by).select("doc_name", "pos", clean_reply(F.col("reply")).alias("_new"))
    return tree.join(new, ["doc_name", "pos"], "left").withColumn("summary", F.coalesce("_new", "summary", F.lit(""))).drop("_new")


def described(docs: DataFrame, tree: DataFrame, by: Completer) -> DataFrame:
    """docs with descriptions where they are empty, from the start of the text and the table of contents to depth 3."""
    shown = docs.join(contents_table(tree, 3), "doc_name", "left").where(F.coalesce("description", F.lit("")) == "")
    prompts = shown.select("doc_name", F.to_json(F.struct(F.lit("summary").alias("task"), preview(F.col("content"), 1000).alias("content"), "toc")).alias("prompt"))
    new = _ask(prompts, by).select("doc_name", clean_reply(F.col("reply")).alias("_new"))
    return docs.join(new, "doc_name", "left").withColumn("description", F.coalesce("_new", "description", F.lit(""))).drop("_new")


#: How much of a page a model is shown, and what stands for the rest.
MOST_HTML, CUT_MARK = 50_000, "\n...[内容已截断]..."


def converted(pages: DataFrame, by: Completer, title: Column | None = None, most_html: int | None = MOST_HTML) -> DataFrame:
    """pages (url, html) with markdown by a completer, which is shown the cleaned page; without a reply, by the simple rules.
    title: that of the page if None. most_html: characters that are shown; None: whole pages, for completers that take them."""
    title = html_title(F.col("html")) if title is None else title
    shown = in_batches(pages).withColumn("_title", title).withColumn("_clean", html_cleaned(F.col("html")))
    cut = F.col("_clean") if most_html is None else F.when(F.length("_clean") > most_html, F.concat(F.substring("_clean", 1, most_html), F.lit(CUT_MARK))).otherwise(F.col("_clean"))
    asked = _ask(shown.withColumn("prompt", F.to_json(F.struct(F.lit("markdown").alias("task"), F.col("_title").alias("title"), "url", cut.alias("content")))).drop("_clean"), by)
    markdown = F.when(F.col("reply").isNotNull(), unwrap_fence(F.col("reply"))).otherwise(html_to_simple_markdown(F.col("html"), F.col("_title")))
    return asked.select(*pages.columns, markdown.alias("markdown"))


def thoughts(hits: DataFrame, shown: int = 3) -> DataFrame:
    """One row `thinking`: a line for each of the best hits (rank), with its reasoning or else its score."""
    why = F.coalesce(F.nullif("reasoning", F.lit("")), F.format_string("score=%.2f", "score"))
    line = F.concat(F.lit("- "), "doc_name", F.lit("/"), "node_id", F.lit(": "), why)
    best = hits.where(F.col("rank") <= shown).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return best.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("thinking"))


def decomposed(queries: DataFrame, by: Completer) -> DataFrame:
    """query, sub_question: the parts of each query, or itself."""
    prompts = queries.select("query", F.to_json(F.struct(F.lit("decompose").alias("task"), "query")).alias("prompt"))
    parts = parsed(F.col("reply"), "is_complex boolean, sub_questions array<string>")
    asked = _ask(prompts, by).select("query", parts.alias("p"))
    return asked.select("query", F.explode(F.when(F.col("p.is_complex") & (F.size("p.sub_questions") > 0), F.col("p.sub_questions")).otherwise(F.array("query"))).alias("sub_question"))


def judged(passages: DataFrame, query: str, by: Completer) -> DataFrame:
    """passages (content) with relevant, confidence, reason; without a usable reply: true, 0.5."""
    prompts = passages.withColumn("prompt", F.to_json(F.struct(F.lit("relevance").alias("task"), F.lit(query).alias("query"), "content")))
    p = parsed(F.col("reply"), "relevant boolean, confidence double, reason string")
    return _ask(prompts, by).withColumn("_p", p).select(*passages.columns, F.coalesce("_p.relevant", F.lit(True)).alias("relevant"), F.coalesce("_p.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("_p.reason", F.lit("")).alias("reason"))


def verified(passages: DataFrame, query: str, by: Completer) -> DataFrame:
    """passages (content; the first 2000 characters are shown) with contains_answer and answer_confidence."""
    prompts = passages.withColumn("prompt", F.to_json(F.struct(F.lit("verify").alias("task"), F.lit(query).alias("query"), F.substring("content", 1, 2000).alias("content"))))
    p = parsed(F.col("reply"), "contains_answer boolean, answer_type string, key_information string, confidence double")
    return _ask(prompts, by).withColumn("_p", p).select(*passages.columns, F.coalesce("_p.contains_answer", F.lit(True)).alias("contains_answer"), F.coalesce("_p.confidence", F.lit(0.5)).alias("answer_confidence"))
