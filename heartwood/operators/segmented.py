"""Headings, sections and trees of documents that come in parts, each of which may be in another task.

A part (doc_name, part, content) is some whole lines of a document; parts follow each other in the order of `part`, one line
feed apart. Everything that runs through a document - numbers of lines and headings, open fences, runs of underlined lines, the
last heading of each level - is worked out within a part first, and once more over one row of summary for each part. What came
before (or comes after) a part is then added to its rows. Texts stay in the tasks that read them, and windows over rows never
hold more than a part; those over summaries hold a row for each part of a document.

Results equal those of `markdown` and `tree` over the documents in one piece. Null contents are one empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.tables import kept
from .markdown import ATX, NO_HEADING, lines_of, marker_lines
from .tree import LEVELS, linked

KEY = ["doc_name", "part"]


def _before(value: Column) -> Column:
    """The sum over a document's parts before this one."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("doc_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _markers(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marker lines by part, parts with their number of lines and of lines before). Whether a part's last line is underlined
    depends on the next part's first one: these two lines are looked at by themselves."""
    lines = lines_of(F.coalesce("content", F.lit("")))
    sizes = kept(parts.select(*KEY, F.size(lines).alias("n_lines"), F.get(lines, F.lit(0)).alias("_first"), F.element_at(lines, -1).alias("_last")))
    sizes = sizes.withColumn("_next", F.lead("_first").over(Window.partitionBy("doc_name").orderBy("part")))
    key = F.struct(*KEY).alias("doc_name")
    own = marker_lines(parts.select(key, "content"))
    seams = marker_lines(sizes.where("_next IS NOT NULL").select(F.struct(*KEY, "n_lines").alias("doc_name"), F.concat_ws("\n", "_last", "_next").alias("content")))
    seams = seams.where("line_no = 1 AND kind = 'setext'").select(F.struct("doc_name.doc_name", "doc_name.part").alias("doc_name"), F.col("doc_name.n_lines").alias("line_no"), "line", "kind", "level")
    found = own.unionByName(seams).select("doc_name.*", "line_no", "line", "kind", "level")
    return kept(found), sizes.select(*KEY, "n_lines", _before(F.col("n_lines")).alias("lines_before"))


def headings(parts: DataFrame) -> DataFrame:
    """doc_name, part, pos, line_no, level, title of every heading, numbered through the document."""
    return _headings(*_markers(parts))


def _headings(found: DataFrame, sizes: DataFrame) -> DataFrame:
    in_part = Window.partitionBy(*KEY).orderBy("line_no")
    # Fences: those of the parts before, and those of the part before the line.
    fences = sizes.join(found.where("kind = 'fence'").groupBy(*KEY).agg(F.count("*").alias("_f")), KEY, "left").select(*KEY, "n_lines", "lines_before", _before(F.coalesce("_f", F.lit(0))).alias("_open"))
    at = found.join(fences, KEY).withColumn("_here", F.coalesce(F.sum((F.col("kind") == "fence").cast("int")).over(in_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ok = at.where(((F.col("_open") + F.col("_here")) % 2 == 0) & (F.col("kind") != "fence"))
    # Underlined lines that follow each other: every second one is a heading, counted from where they began.
    ok = ok.withColumn("_run", F.col("line_no") - F.row_number().over(Window.partitionBy(*KEY, "kind").orderBy("line_no")))
    ok = kept(ok.withColumn("_nth", F.row_number().over(Window.partitionBy(*KEY, "kind", "_run").orderBy("line_no"))))
    tails = ok.where("kind = 'setext' AND line_no = n_lines").select(*KEY, F.col("_nth").alias("_tail"))
    ends = sizes.join(tails, KEY, "left").withColumn("_tail", F.coalesce("_tail", F.lit(0)))
    by_part = Window.partitionBy("doc_name").orderBy("part")
    # A part that is underlined throughout goes on with the run of the one before.
    ends = ends.withColumn("_from", F.sum((F.col("_tail") < F.col("n_lines")).cast("int")).over(by_part))
    ends = ends.withColumn("_upto", F.sum("_tail").over(Window.partitionBy("doc_name", "_from").orderBy("part")))
    ends = ends.select(*KEY, F.coalesce(F.lag("_upto").over(by_part), F.lit(0)).alias("_carried"))
    ok = ok.join(ends, KEY).withColumn("_nth", F.col("_nth") + F.when(F.col("line_no") == F.col("_nth"), F.col("_carried")).otherwise(0))
    heads = ok.where((F.col("kind") == "atx") | (F.col("_nth") % 2 == 1))
    title = strip(F.when(F.col("kind") == "atx", F.regexp_extract("line", ATX, 2)).otherwise(F.col("line")))
    heads = kept(heads.select(*KEY, F.row_number().over(in_part).alias("_own"), (F.col("lines_before") + F.col("line_no")).alias("line_no"), "level", title.alias("title")))
    counted = sizes.join(heads.groupBy(*KEY).agg(F.count("*").alias("_n")), KEY, "left").select(*KEY, _before(F.coalesce("_n", F.lit(0))).alias("_heads_before"))
    return heads.join(counted, KEY).select(*KEY, (F.col("_heads_before") + F.col("_own")).cast("int").alias("pos"), F.col("line_no").cast("int").alias("line_no"), "level", "title")


def sections(parts: DataFrame) -> DataFrame:
    """doc_name, part, pos, level, title, start_line, end_line of every section, without contents; part is that of its heading.
    A document without headings is one section of level 0."""
    found, sizes = _markers(parts)
    heads = kept(_headings(found, sizes))
    total = sizes.groupBy("doc_name").agg(F.max(F.col("lines_before") + F.col("n_lines")).cast("int").alias("_total"), F.min("part").alias("_part"))
    first = sizes.join(heads.groupBy(*KEY).agg(F.min("line_no").alias("_first")), KEY, "left")
    after = Window.partitionBy("doc_name").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*KEY, F.last("_first", ignorenulls=True).over(after).alias("_then"))
    following = F.lead("line_no").over(Window.partitionBy(*KEY).orderBy("pos"))
    out = heads.withColumn("_next", following).join(first, KEY).join(total.drop("_part"), "doc_name")
    out = out.select(*KEY, "pos", "level", "title", F.col("line_no").alias("start_line"), (F.coalesce(F.coalesce("_next", "_then") - 1, "_total")).alias("end_line"))
    bare = total.join(heads.select("doc_name").distinct(), "doc_name", "left_anti")
    return out.unionByName(bare.select("doc_name", F.col("_part").alias("part"), F.lit(1).alias("pos"), F.lit(0).alias("level"), F.lit(NO_HEADING).alias("title"), F.lit(1).alias("start_line"), F.col("_total").alias("end_line")))


def nodes(found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree.nodes of sections that know their part: for every level the last heading before a row is that within the part, or
    else the last one of the parts before."""
    too_deep = F.raise_error(F.concat(F.lit("a section of level "), F.col("level").cast("string"), F.lit(f" where levels={levels}")))
    found = kept(found.withColumn("level", F.when(F.col("level") > levels, too_deep).otherwise(F.col("level"))))
    of = lambda k, *fields: F.when(F.col("level") == k, F.struct(*fields))
    every = range(levels + 1)
    ends = [F.max(of(k, "pos", "title")).alias(f"_l{k}") for k in every] + [F.min(of(k, "pos", "start_line")).alias(f"_f{k}") for k in every]
    summary = kept(found.groupBy(*KEY).agg(*ends, F.max("end_line").alias("_e"), F.max("pos").alias("_p")))
    whole = Window.partitionBy("doc_name")
    back, on = (whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.col("part"), F.desc("part")))
    carried = [F.last(f"_l{k}", ignorenulls=True).over(back).alias(f"_l{k}") for k in every] + [F.last(f"_f{k}", ignorenulls=True).over(on).alias(f"_f{k}") for k in every]
    summary = summary.select(*KEY, *carried, F.max("_e").over(whole).alias("_total"), F.max("_p").over(whole).alias("_n"))
    rows = found.join(summary, KEY)
    before = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*KEY).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.coalesce(F.last(of(k, "pos", "title"), ignorenulls=True).over(before), F.col(f"_l{k}")) for k in every]
    nxt = [F.coalesce(F.last(of(k, "pos", "start_line"), ignorenulls=True).over(after), F.col(f"_f{k}")) for k in every]
    rows = rows.select("*", F.array(*last).alias("_last")).select("*", F.array(*nxt).alias("_next"))
    return linked(rows.drop(*[f"_{c}{k}" for c in "lf" for k in every]))
