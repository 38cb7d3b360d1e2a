"""Markdown to headings and sections.

A document is a row (doc_name, content). Each document finds its own marker lines (fences, headings, underlined lines) in
place; only these few are dealt out for the running state, so that texts aren't shuffled to find headings. Contents are
cut out of the text where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# The patterns of headings; titles of what has none.
ATX = r"(?Ud)^(#{1,6})\s+(.+?)(?:\s*#*\s*)?$"
UNDERLINE_1, UNDERLINE_2 = r"(?U)^=+\s*\z", r"(?U)^-+\s*\z"
NO_HEADING, NO_TITLE = "Document", "Untitled Document"


def lines_of(content: Column) -> Column:
    """Lines by line feed alone; a text that ends in one has an empty last line."""
    return F.split(content, "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """doc_name, line_no (from 1), line."""
    return docs.select("doc_name", F.posexplode_outer(lines_of(F.coalesce("content", F.lit("")))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def marker_lines(docs: DataFrame) -> DataFrame:
    """doc_name, line_no, line, kind (fence, atx, setext), level: lines that may be headings or fences, in no order."""
    after = lambda i: F.get(F.col("_lines"), i + 1)

    def mark(line: Column, i: Column) -> Column:
        under = F.when(after(i).rlike(UNDERLINE_1), 1).when(after(i).rlike(UNDERLINE_2) & ~line.startswith("-"), 2)
        kind = F.when(strip(line).startswith("```"), "fence").when(line.rlike(ATX), "atx").when(under.isNotNull() & (strip(line) != ""), "setext")
        level = F.when(kind == "atx", F.length(F.regexp_extract(line, ATX, 1))).when(kind == "setext", under)
        return F.struct((i + 1).alias("line_no"), line.alias("line"), kind.alias("kind"), level.alias("level"))

    marked = docs.select("doc_name", lines_of(F.coalesce("content", F.lit(""))).alias("_lines"))
    # Most lines start with a letter: they are told apart by one character and the start of the next line.
    maybe = lambda line, i: line.rlike(r"(?U)^(#|\s*`{3})") | after(i).rlike("^[=-]")
    marked = marked.withColumn("_at", F.filter(F.transform("_lines", lambda x, i: F.when(maybe(x, i), mark(x, i))), lambda x: x["kind"].isNotNull()))
    # An outer explode: for a plain one the optimizer tests the array's size below, where lines would be split for each line.
    return marked.select("doc_name", F.explode_outer("_at").alias("m")).where("m IS NOT NULL").select("doc_name", "m.*")


def fence_states(docs: DataFrame) -> DataFrame:
    """marker_lines with in_code: whether a fence is open before the line. An unclosed fence stays open to the end."""
    before = Window.partitionBy("doc_name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fences = F.coalesce(F.sum((F.col("kind") == "fence").cast("int")).over(before), F.lit(0))
    return marker_lines(docs).withColumn("in_code", fences % 2 == 1)


def headings(docs: DataFrame) -> DataFrame:
    """doc_name, pos (from 1), line_no, level, title of every heading. Of underlined lines that follow each other, every
    second one is a heading: a heading uses up its underline."""
    ok = fence_states(docs).where(~F.col("in_code") & (F.col("kind") != "fence"))
    run = Window.partitionBy("doc_name", "kind").orderBy("line_no")
    ok = ok.withColumn("_run", F.col("line_no") - F.row_number().over(run))
    ok = ok.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_name", "kind", "_run").orderBy("line_no")))
    ok = ok.where((F.col("kind") == "atx") | (F.col("_nth") % 2 == 1))
    title = strip(F.when(F.col("kind") == "atx", F.regexp_extract("line", ATX, 2)).otherwise(F.col("line")))
    pos = F.row_number().over(Window.partitionBy("doc_name").orderBy("line_no"))
    return ok.select("doc_name", pos.alias("pos"), "line_no", "level", title.alias("title"))


def titles(docs: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """doc_name, title: the first heading of level 1, else the first heading, else NO_TITLE."""
    heads = headings(docs) if heads is None else heads
    best = heads.groupBy("doc_name").agg(F.min_by("title", F.struct(F.col("level") != 1, F.col("pos"))).alias("_title"))
    return docs.select("doc_name").join(best, "doc_name", "left").select("doc_name", F.coalesce("_title", F.lit(NO_TITLE)).alias("title"))


def sections(docs: DataFrame, heads: DataFrame | None = None, contents: bool = True) -> DataFrame:
    """doc_name, pos, level, title, start_line, end_line [, content, raw_content] of every section. A section goes up to
    the line before the next heading of any level; text before the first heading belongs to none. A document without
    headings is one section of level 0. raw_content is the section without its heading line, trimmed."""
    heads = headings(docs) if heads is None else heads
    by_doc = heads.groupBy("doc_name").agg(F.sort_array(F.collect_list(F.struct("pos", "line_no", "level", "title"))).alias("_heads"))
    text = F.coalesce("content", F.lit(""))
    found = docs.select("doc_name", text.alias("_text") if contents else F.size(lines_of(text)).alias("_n")).join(by_doc, "doc_name", "left")
    whole = F.array(F.struct(F.lit(1).alias("pos"), F.lit(1).alias("line_no"), F.lit(0).alias("level"), F.lit(NO_HEADING).alias("title")))
    found = found.withColumn("_heads", F.coalesce("_heads", whole))

    def spans(total: Column, lines: Column | None) -> Column:
        def section(h: Column, i: Column) -> Column:
            end = F.coalesce(F.get(F.col("_heads"), i + 1)["line_no"] - 1, total)
            fields = [h["pos"].alias("pos"), h["level"].alias("level"), h["title"].alias("title"), h["line_no"].alias("start_line"), end.alias("end_line")]
            if lines is not None:
                cut = lambda first: F.array_join(F.slice(lines, first, end - first + 1), "\n")
                of_whole = h["level"] == 0
                fields += [F.when(of_whole, F.col("_text")).otherwise(cut(h["line_no"])).alias("content"), F.when(of_whole, F.col("_text")).otherwise(strip(cut(h["line_no"] + 1))).alias("raw_content")]
            return F.struct(*fields)

        return F.transform("_heads", section)

    # Contents are cut out before sections become rows, so that no row carries its document; lines are bound once, as the
    # only element of an array.
    each = F.transform(F.array(lines_of(F.col("_text"))), lambda x: spans(F.size(x), x))[0] if contents else spans(F.col("_n"), None)
    return found.select("doc_name", F.explode(each).alias("s")).select("doc_name", "s.*")


def structure_overview(found: DataFrame) -> DataFrame:
    """doc_name, overview: one indented line for each section, with its lines."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), "title", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    by_pos = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return found.groupBy("doc_name").agg(F.array_join(F.transform(by_pos, lambda x: x["line"]), "\n").alias("overview"))
