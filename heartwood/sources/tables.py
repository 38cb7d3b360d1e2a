"""Reading and writing documents, trees and vectors, and cutting long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A node as it is nested in an index file; children stay JSON until they are flattened.
NODE = "title string, level int, start_line int, end_line int, node_id string, summary string, content string"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that the driver and all executors see; where it is unset and all runs on one machine,
    as in tests, one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a batch of rows on its way to a Python worker, unless the session was started with a figure of its own.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python functions in batches of bounded size, however many rows a task reads."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df


def _file_name(pattern: str):
    return F.regexp_extract(F.regexp_replace(F.col("_metadata.file_name"), "%20", " "), pattern, 1)


#: Folders that saved documents are dealt into by name, and files of a folder at most for each time that it is written.
FOLDERS, PARTS = 16, 8


def _saved(spark: SparkSession, path: str) -> DataFrame:
    """doc_name, text, source_file of the documents that save() has written below a folder."""
    read = spark.read.schema("doc_name string, text string").parquet(path, pathGlobFilter="part-*.parquet", recursiveFileLookup=True)
    return read.select("doc_name", "text", F.col("_metadata.file_path").alias("source_file"))


def save(texts: DataFrame, path: str) -> None:
    """Write (doc_name, text) below a folder, in place of the documents of the same names there; others stay. Many documents
    share a file: a file for each costs some 50 ms of a core, whatever its size. Only folders of these names are rewritten."""
    spark = texts.sparkSession
    dealt = lambda df: df.withColumn("folder", F.pmod(F.xxhash64("doc_name"), F.lit(FOLDERS)).cast("int"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = dealt(texts.select("doc_name", "text"))
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = kept(new)
        old = dealt(_saved(spark, path).select("doc_name", "text")).join(F.broadcast(new.select("folder").distinct()), "folder", "left_semi")
        new = kept(missing(old, new).unionByName(new))
    out = new.repartition("folder", F.pmod(F.xxhash64("doc_name", F.lit(1)), F.lit(PARTS)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_name, content, source_file of every Markdown or text file below a folder, and of what write_markdown has saved there;
    line ends become line feeds."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,markdown,txt}", recursiveFileLookup=True)
    loose = raw.select(_file_name(r"^(.*?)(?:\.[^.]*)?$").alias("doc_name"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_file"))
    return loose.unionByName(_saved(spark, path)).select("doc_name", F.regexp_replace("text", r"\r\n?", "\n").alias("content"), "source_file")


def accepted_upload(name):
    """Whether a file name has an extension that is taken in."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin("md", "markdown", "txt")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """url, html, status_code of a table of fetched pages; pages without a status were fetched."""
    df = spark.read.parquet(path)
    return df if "status_code" in df.columns else df.withColumn("status_code", F.lit(200))


def index_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, tree) of the nested indexes below a folder: files NAME_index.json, texts in folders doc_name=NAME, and what
    write_indexes has saved."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="{*_index.json,part-*.txt}", recursiveFileLookup=True)
    # Folders' names are escaped by the writer, and once more where a path is an address.
    folder = F.url_decode(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), "/doc_name=([^/]*)/", 1), "%25", "%"))
    name = F.coalesce(F.nullif(folder, F.lit("")), _file_name(r"^(.*)_index\.json$"))
    loose = raw.select(name.alias("doc_name"), F.regexp_replace("value", r"\n\z", "").alias("json"))
    return index_tables(loose.unionByName(_saved(spark, path).select("doc_name", F.col("text").alias("json"))))


def write_indexes(docs: DataFrame, tree: DataFrame, path: str, contents: bool = True) -> None:
    """The nested index of each document, saved below a folder; other documents there stay."""
    save(nested_json(docs, tree, contents).select("doc_name", F.col("json").alias("text")), path)


def write_markdown(docs: DataFrame, path: str) -> None:
    """The Markdown of each document, saved below a folder; other documents there stay."""
    save(docs.select("doc_name", F.coalesce("content", F.lit("")).alias("text")), path)


def index_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, tree) of nested indexes (doc_name, json). Children are flattened level by level, one pass over the parsed
    JSON for each; positions are given in document order."""
    spark = files.sparkSession
    files = files.select("doc_name", F.parse_json("json").alias("j"))
    get = lambda v, name, kind: F.try_variant_get(v, f"$.{name}", kind)
    docs = files.select("doc_name", get("j", "title", "string").alias("title"), F.coalesce(get("j", "description", "string"), F.lit("")).alias("description"), F.coalesce(get("j", "source_file", "string"), F.lit("")).alias("source_file"), get("j", "total_lines", "int").alias("total_lines"))
    level = files.select("doc_name", F.posexplode(get("j", "nodes", "array<variant>")).alias("i", "v")).select("doc_name", F.array("i").alias("_at"), "v")
    every = None
    while True:
        level = kept(level)
        if level.isEmpty():
            break
        fields = T._parse_datatype_string(NODE).fields
        here = level.select("doc_name", "_at", *[get("v", f.name, f.dataType.simpleString()).alias(f.name) for f in fields])
        every = here if every is None else every.unionByName(here)
        level = level.select("doc_name", "_at", F.posexplode(get("v", "children", "array<variant>")).alias("i", "c")).select("doc_name", F.concat("_at", F.array("i")).alias("_at"), F.col("c").alias("v"))
    if every is None:
        every = spark.createDataFrame([], f"doc_name string, _at array<int>, {NODE}")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("doc_name").orderBy("_at"))
    flat = every.withColumn("pos", pos)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return docs, flat.select("doc_name", "pos", "title", "level", "start_line", "end_line", "node_id", text("summary"), text("content"), (F.size("_at") - 1).alias("depth"))


def nested_json(docs: DataFrame, tree: DataFrame, contents: bool = False) -> DataFrame:
    """doc_name, json: each document with its tree nested, as an index file holds it. In document order, what stands between
    two nodes follows from their depths alone, so that one exchange by document does at any depth."""
    fields = ["title", "node_id", "level", "start_line", "end_line"]
    more = [F.when(F.col("summary") != "", F.col("summary")).alias("summary")] + ([F.when(F.col("content") != "", F.col("content")).alias("content")] if contents else [])
    head = F.regexp_replace(F.to_json(F.struct(*fields, *more)), r"\}\z", "")
    by_doc = tree.groupBy("doc_name").agg(F.sort_array(F.collect_list(F.struct("pos", "depth", head.alias("head")))).alias("_n"))
    closed = lambda levels: F.repeat(F.lit("}]"), levels)

    def node(n: Column, i: Column) -> Column:
        up = F.get(F.col("_n"), i - 1)["depth"] - n["depth"]
        between = F.when(i == 0, F.lit("")).when(up < 0, F.lit(',"children":[')).otherwise(F.concat(closed(up), F.lit("},")))
        return F.concat(between, n["head"])

    end = F.concat(closed(F.get(F.col("_n"), F.size("_n") - 1)["depth"]), F.lit("}"))
    nested = by_doc.select("doc_name", F.concat(F.array_join(F.transform("_n", node), ""), end).alias("_nodes"))
    start = F.regexp_replace(F.to_json(F.struct("title", "description", "source_file", "total_lines")), r"\}\z", "")
    return docs.join(nested, "doc_name", "left").select("doc_name", F.concat(start, F.lit(',"metadata":{},"nodes":['), F.coalesce("_nodes", F.lit("")), F.lit("]}")).alias("json"))


VECTORS = "dimension int, node_vectors map<string,array<double>>, chunk_vectors map<string,array<array<double>>>, node_metadata map<string,struct<title:string,level:int,doc_name:string,node_id:string>>"


def vector_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node vectors, chunk vectors) of vector index files in JSON."""
    return vector_tables(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def vector_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node vectors, chunk vectors) of vector indexes (json). A node's document and id come from its metadata; its key
    serves only where that is missing, cut at the last colon."""
    files = files.select(F.from_json("json", VECTORS).alias("j"))

    def named(column: str) -> DataFrame:
        rows = files.select(F.explode(f"j.{column}").alias("key", "value"), F.col("j.node_metadata").alias("_meta")).withColumn("_m", F.try_element_at("_meta", F.col("key")))
        parts = [F.coalesce(f"_m.{n}", F.regexp_extract("key", r"^(.*):([^:]*)$", i)).alias(n) for i, n in ((1, "doc_name"), (2, "node_id"))]
        return rows.select(*parts, F.col("_m.title").alias("title"), F.col("_m.level").alias("level"), "value")

    nodes = named("node_vectors").withColumnRenamed("value", "vector")
    return nodes, named("chunk_vectors").select("doc_name", "node_id", F.posexplode("value").alias("chunk_no", "vector"))


def vector_json(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_name, json: a vector index file for each document, in the form that vector_files reads."""
    key = F.concat_ws(":", "doc_name", "node_id")
    meta = F.struct("title", "level", "doc_name", "node_id")
    a = nodes.groupBy("doc_name").agg(F.map_from_entries(F.collect_list(F.struct(key, "vector"))).alias("node_vectors"), F.map_from_entries(F.collect_list(F.struct(key, meta))).alias("node_metadata"), F.max(F.size("vector")).alias("dimension"))
    lists = chunks.groupBy("doc_name", "node_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "vector"))).alias("c"))
    b = lists.groupBy("doc_name").agg(F.map_from_entries(F.collect_list(F.struct(key, F.transform("c", lambda c: c["vector"])))).alias("chunk_vectors"))
    both = a.join(b, "doc_name", "left")
    none = F.create_map().cast("map<string,array<array<double>>>")
    return both.select("doc_name", F.to_json(F.struct(F.lit("1.0").alias("version"), "dimension", "node_vectors", F.coalesce("chunk_vectors", none).alias("chunk_vectors"), "node_metadata")).alias("json"))


def upserted(old: DataFrame, new: DataFrame, key: str = "doc_name") -> DataFrame:
    """old without the documents that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def missing(docs: DataFrame, known: DataFrame, key: str = "doc_name") -> DataFrame:
    """The documents that known doesn't have yet."""
    return docs.join(known.select(key).distinct(), key, "left_anti")
