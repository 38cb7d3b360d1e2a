"""What is sent to tasks and to Python is bounded."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heartwood.functions.providers import completed
from heartwood.operators import crawl
from heartwood.plans import corpora
from heartwood.queries import queries
from heartwood.sources.tables import in_batches


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graphs_of_a_crawl_are_not_broadcast(spark, monkeypatch):
    frontier = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    edges = spark.createDataFrame([("a", ["x"]), ("c", ["y"]), ("d", ["z"])], "url string, links array<string>").withColumn("found", F.lit(True))
    want = [("a", ["x"], True), ("b", None, None), ("c", ["y"], True)]
    rows = lambda df: sorted(map(tuple, df.select("url", "links", "found").collect()))
    assert rows(crawl._joined(frontier, edges)) == want
    monkeypatch.setattr(crawl, "SENT", 2)
    exchanged = crawl._joined(frontier, edges)
    assert rows(exchanged) == want and "Broadcast" not in plan_of(exchanged)


def test_pages_go_to_python_in_small_batches(spark, sf_dir):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    corpora.paged(spark, sf_dir)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{4 << 20}b"


def test_batches_of_pages_are_bounded_in_bytes(spark):
    @F.pandas_udf("long")
    def beside(html: pd.Series) -> pd.Series:
        return pd.Series([len(html)] * len(html))

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(0, 3000, 1, 1).select(F.concat(F.repeat(F.lit("x"), 10_000), "id").alias("html"))
    n = [r.n for r in in_batches(pages).select(beside("html").alias("n")).collect()]
    assert len(n) == 3000 and 100 < max(n) <= 1 + (4 << 20) // 10_000


@pytest.mark.parametrize("name", ["converted_pages", "page_documents", "page_fences", "page_links", "page_markdown", "page_metadata", "page_simple_markdown", "page_texts", "page_titles", "page_toc_texts", "page_whole_texts"])
def test_every_query_over_pages_bounds_its_batches(spark, sf_dir, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    queries()[name](spark, sf_dir)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{4 << 20}b"


def test_batches_of_prompts_are_bounded_in_bytes(spark):
    class Counting:
        def complete(self, prompts):
            return [str(len(prompts))] * len(prompts)

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    prompts = spark.range(0, 9000, 1, 1).select(F.concat(F.repeat(F.lit("x"), 10_000), "id").alias("prompt"))
    n = [int(r.reply) for r in completed(prompts, Counting()).select("reply").collect()]
    assert len(n) == 9000 and 100 < max(n) <= 1 + (4 << 20) // 10_000
