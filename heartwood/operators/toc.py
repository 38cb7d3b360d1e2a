"""Tables of contents written in a document: a marker, a list of links, or numbered and dotted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, title_key
from .markdown import lines

# What a title of a table of contents, its marker and its entries look like.
TITLES = (r"^#+\s*(table\s+of\s+contents?|contents?|目录|索引|toc)\s*\z", r"^(table\s+of\s+contents?|contents?|目录|索引)\s*\z")
MARKER = r"(?iU)^\s*\[toc\]\s*\z"
LINK = r"(?U)^\s*[-*+]?\s*\[([^\]]+)\]\(([^)]*)\)\s*\z"
NUMBERED = r"(?Ud)^\s*(\d+\.)+\s*(.+?)(?:\s+\.{2,}\s*\d+)?\s*$"
DOTTED = r"(?Ud)^\s*(.+?)\s*\.{2,}\s*(\d+)\s*$"
HEADING = r"(?U)^#+\s+"
MARKER_LINES, LEAST_ENTRIES = 100, 3
ENTRIES = "array<struct<ord:bigint,title:string,level:int,page_or_line:int,link:string>>"


def markers(docs: DataFrame) -> DataFrame:
    """doc_name, start_line, end_line, is_auto_generated, confidence: the first [TOC] line near the top."""
    first = lines(docs).where(F.col("line").rlike(MARKER) & (F.col("line_no") <= MARKER_LINES)).groupBy("doc_name").agg(F.min("line_no").alias("start_line"))
    return first.select("doc_name", "start_line", F.col("start_line").alias("end_line"), F.lit(True).alias("is_auto_generated"), F.lit(1.0).alias("confidence"))


def _after_title(docs: DataFrame) -> DataFrame:
    """Non-blank lines after the first title line of each document, with the title's line number."""
    whole = Window.partitionBy("doc_name")
    is_title = strip(F.col("line")).rlike("(?iuU)" + TITLES[0]) | strip(F.col("line")).rlike("(?iuU)" + TITLES[1])
    at = lines(docs).withColumn("_start", F.min(F.when(is_title, F.col("line_no"))).over(whole))
    return at.where((F.col("line_no") > F.col("_start")) & (strip(F.col("line")) != ""))


def _entries(after, is_entry, fields) -> DataFrame:
    """Entries up to the first heading after one of them: doc_name, _start, ord, title, level, page_or_line, link."""
    so_far = Window.partitionBy("doc_name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = after.withColumn("_is", is_entry).withColumn("ord", F.sum(F.col("_is").cast("int")).over(so_far))
    stop = ~F.col("_is") & (F.col("ord") > 0) & F.col("line").rlike(HEADING)
    at = at.withColumn("_stopped", F.sum(stop.cast("int")).over(so_far))
    return at.where("_is AND _stopped = 0").select("doc_name", "_start", "ord", *fields)


def link_entries(docs: DataFrame) -> DataFrame:
    """Entries that are links; two more blanks of indent are one more level."""
    indent = F.length("line") - F.length(F.regexp_replace("line", r"(?U)^\s+", ""))
    fields = [strip(F.regexp_extract("line", LINK, 1)).alias("title"), (F.floor(indent / 2) + 1).cast("int").alias("level"), F.lit(None).cast("int").alias("page_or_line"), strip(F.regexp_extract("line", LINK, 2)).alias("link")]
    return _entries(_after_title(docs), F.col("line").rlike(LINK), fields)


def text_entries(docs: DataFrame) -> DataFrame:
    """Numbered and dotted entries. They are of level 1, and of a number with several parts the last part alone is cut."""
    numbered = F.col("line").rlike(NUMBERED)
    title = strip(F.when(numbered, F.regexp_extract("line", NUMBERED, 2)).otherwise(F.regexp_extract("line", DOTTED, 1)))
    page = F.when(~numbered, F.regexp_extract("line", DOTTED, 2).try_cast("int"))
    fields = [title.alias("title"), F.lit(1).alias("level"), page.alias("page_or_line"), F.lit(None).cast("string").alias("link")]
    return _entries(_after_title(docs), numbered | F.col("line").rlike(DOTTED), fields)


def _summary(entries: DataFrame) -> DataFrame:
    found = entries.groupBy("doc_name").agg(F.first("_start").alias("_start"), F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("ord", "title", "level", "page_or_line", "link"))).alias("entries")).where(F.col("_n") >= LEAST_ENTRIES)
    # A title on the first line counts as no title for the last line.
    end = F.when(F.col("_start") > 1, F.col("_start") + F.col("_n") + 1).otherwise(F.col("_n") + 1)
    return found.select("doc_name", F.col("_start").alias("start_line"), end.alias("end_line"), F.lit(False).alias("is_auto_generated"), F.least(F.lit(1.0), F.col("_n") / 5).alias("confidence"), "entries")


def detect(docs: DataFrame) -> DataFrame:
    """doc_name, kind (marker, links, text), start_line, end_line, is_auto_generated, confidence, entries: the best table
    of contents of each document that has one; a marker goes before links, links before text."""
    found = {"marker": markers(docs).withColumn("entries", F.lit(None).cast(ENTRIES)), "links": _summary(link_entries(docs)), "text": _summary(text_entries(docs))}
    all_ = docs.select("doc_name")
    for kind, d in found.items():
        toc = F.struct(F.lit(kind).alias("kind"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "is_auto_generated", "confidence", F.col("entries").cast(ENTRIES).alias("entries"))
        all_ = all_.join(d.where("confidence > 0.5").select("doc_name", toc.alias(kind)), "doc_name", "left")
    return all_.withColumn("toc", F.coalesce(*found)).where("toc IS NOT NULL").select("doc_name", "toc.*")


def with_toc_levels(found: DataFrame, entries: DataFrame) -> DataFrame:
    """sections whose level is that of the table's entry with the same title (the last one), where there is such one."""
    levels = entries.groupBy("doc_name", title_key(F.col("title")).alias("_key")).agg(F.max_by("level", "ord").alias("_level"))
    joined = found.withColumn("_key", title_key(F.col("title"))).join(levels, ["doc_name", "_key"], "left")
    return joined.withColumn("level", F.coalesce("_level", "level")).drop("_key", "_level")


def summary_text(detected: DataFrame) -> DataFrame:
    """doc_name, toc: the entries as indented lines."""
    line = lambda e: F.concat(F.repeat(F.lit("  "), e["level"] - 1), F.lit("- "), e["title"])
    return detected.select("doc_name", F.array_join(F.transform(F.coalesce("entries", F.array().cast(ENTRIES)), line), "\n").alias("toc"))
