"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset and all runs on one machine, as
    in tests, one of our own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if where is None and known.isDefined():
        where = known.get()
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
    if known.isEmpty():
        sc.setCheckpointDir(where)
    return where


#: Rows of a kept table that one task reads at least, and the number of tasks below which it is not cut down.
ROWS_EACH, LEAST_TASKS = 50_000, 8


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, materialised once in the shared folder (small tables: counts, features, edges). Where they are few
    for the partitions they came in, fewer tasks read them: each exchange that follows writes a block for every pair of
    its tasks, and with many tasks on few rows those blocks would outgrow the rows."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    return kept.coalesce(max(LEAST_TASKS, kept.count() // ROWS_EACH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet into the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Bytes of a batch of rows on its way to a Python worker, unless the session was started with a figure of its own. Each
#: core holds a few batches at once, in both processes.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of bounded size."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def text_or_empty(col: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Half-open index ranges whose sizes sum to at most limit; one larger item stands alone."""
    start = total = 0
    end = -1
    for end, size in enumerate(sizes):
        if end > start and total + size > limit:
            yield start, end
            start, total = end, 0
        total += size
    if end >= start:
        yield start, end + 1


def unused(name: str, columns: Iterable[str]) -> str:
    """name, or one made of it that none of the columns has (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, order: list[Column | str], into: str) -> DataFrame:
    """df with the place of every row in the given order, from 1 on. Rows are dealt out by ranges and sorted there; only how
    many rows each range has goes to the driver, and an offset for each range back to the tasks."""
    at = unused("_at", df.columns)
    kept = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part, first = F.shiftright(F.col(at), 33), 0  # the id's upper bits are the partition, the others the place in it
    starts = []
    for number, rows in sorted(kept.groupBy(part.alias("_part")).count().collect()):
        starts.append((number, first))
        first += rows
    starts = df.sparkSession.createDataFrame(starts, "_part long, _first long")
    names = [unused(c, [*df.columns, at]) for c in starts.columns]
    placed = kept.join(F.broadcast(starts.toDF(*names)), part == F.col(names[0]))
    return placed.withColumn(into, F.col(names[1]) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at, *names)


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes, which SQL has no function for: a fold over them, with the table
    of what a byte does to the register (reflected polynomial 0xEDB88320)."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    u = "unicode(c)"
    last = lambda k: f"128 + (({u} >> {6 * k}) & 63)"
    of_char = f"CASE WHEN {u} < 128 THEN [{u}] WHEN {u} < 2048 THEN [192 + ({u} >> 6), {last(0)}] WHEN {u} < 65536 THEN [224 + ({u} >> 12), {last(1)}, {last(0)}] ELSE [240 + ({u} >> 18), {last(2)}, {last(1)}, {last(0)}] END"
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: {of_char}))::BIGINT[]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"
