"""A knowledge base on disk that is brought up to date by what changed.

Documents are dealt into buckets by name; each table has a folder for every version and bucket. A sync compares digests of
contents, indexes what is new or changed, and writes the touched buckets under a new version; all others keep their files. A
manifest says which version of each bucket counts, with the bucket's figures. It is written last, so that a sync that dies
halfway changes nothing, and readers of an older version aren't disturbed until vacuum().

Figures are sums over documents: those of the whole are sums over at most `buckets` rows of the manifest, and no table is read
for them. Deleted documents leave a tombstone (their name, digest and the version that dropped them).

Of documents of one name the one of greatest content counts. Null contents count as empty. Names that are null are left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.providers import completer, embedder
from ..operators import tree
from ..sources.config import Settings
from ..sources.tables import kept, missing
from .knowledge_base import KnowledgeBase

BUCKETS = 64
TABLES = ("docs", "nodes", "node_vectors", "chunk_vectors")
FIGURES = ["documents", "nodes", "with_summary", "chars", "node_vectors", "chunk_vectors", "dimension"]
MANIFEST = "bucket int, version int, " + ", ".join(f"{c} long" for c in FIGURES)
TOMBSTONES = "doc_name string, digest string, version int"


class StoredBase:
    """Tables below `path`, which all executors see."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.settings = spark, path, settings or Settings()
        self.manifest: dict[int, dict] = {}
        self.version, self.buckets = 0, buckets
        self.schemas: dict[str, T.StructType] = {}
        last = self._last_manifest()
        if last is not None:
            self.version, self.buckets = last[0], last[1]
            self.manifest = {r["bucket"]: r.asDict() for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={self.version}").collect()}
            self.schemas = {r["name"]: T.StructType.fromJson(json.loads(r["schema"])) for r in spark.read.parquet(f"{path}/schemas/version={self.version}").collect()}

    def _last_manifest(self) -> tuple[int, int] | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return None
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if not done:
            return None
        number = self.spark.read.parquet(f"{self.path}/buckets").first()[0]
        return max(done), number

    def bucket(self, name: str = "doc_name") -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a table in their newest version, of some buckets or all; others' files aren't read. None: no version yet."""
        if not self.manifest:
            return None
        by_version: dict[int, list[int]] = {}
        for b, row in self.manifest.items():
            if buckets is None or b in buckets:
                by_version.setdefault(row["version"], []).append(b)
        wanted = F.lit(False)
        for v, own in by_version.items():
            wanted = wanted | ((F.col("version") == v) & F.col("bucket").isin(own))
        schema = T.StructType([*self.schemas[name].fields, T.StructField("version", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(wanted).drop("version")

    def base(self) -> KnowledgeBase:
        """The knowledge base as it is stored."""
        if not self.manifest:
            raise ValueError("nothing is stored yet: sync() first")
        parts = [self.table(name).drop("bucket", "digest", "total_nodes", "nodes_with_summary") for name in TABLES]
        return KnowledgeBase(*parts, self.settings, embedder(self.settings.embedder), completer(self.settings.completer))

    def changes(self, docs: DataFrame, complete: bool = True) -> DataFrame:
        """doc_name, digest, bucket, change (added, changed, deleted) of what differs from what is stored. complete: docs are
        all documents, and those that aren't among them are deleted."""
        told = docs.where("doc_name IS NOT NULL").groupBy("doc_name").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))
        new = told.select("doc_name", F.sha2("content", 256).alias("digest"))
        old = self.table("docs")
        if old is None:
            return new.select("doc_name", "digest", self.bucket().alias("bucket"), F.lit("added").alias("change"))
        both = new.join(old.select("doc_name", F.col("digest").alias("_old")), "doc_name", "full")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("digest").isNull(), "deleted" if complete else None).when(F.col("digest") != F.col("_old"), "changed")
        return both.select("doc_name", F.coalesce("digest", "_old").alias("digest"), self.bucket().alias("bucket"), change.alias("change")).where("change IS NOT NULL")

    def sync(self, docs: DataFrame, complete: bool = True, summarise: bool = False) -> dict[str, int]:
        """Bring what is stored up to date with docs (doc_name, content): how many were added, changed and deleted, and how
        many buckets were rewritten."""
        found = kept(self.changes(docs, complete))
        counts = {r["change"]: r["n"] for r in found.groupBy("change").agg(F.count("*").alias("n")).collect()}
        touched = sorted(r[0] for r in found.select("bucket").distinct().collect())  # at most `buckets`
        out = {c: counts.get(c, 0) for c in ("added", "changed", "deleted")} | {"rewritten": len(touched)}
        if not touched:
            return out
        wanted = docs.join(found.where("change <> 'deleted'").select("doc_name"), "doc_name", "left_semi")
        wanted = wanted.groupBy("doc_name").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "doc_name"]), F.coalesce("content", F.lit(""))).alias("_d")).select("doc_name", "_d.*")
        # Texts that come out of a plan of their own are made once, not for every table that is made of them.
        new = KnowledgeBase.of(kept(wanted.withColumn("content", F.coalesce("content", F.lit("")))), self.settings, summarise)
        told = tree.listing(new.nodes, new.docs).select("doc_name", "total_nodes", "nodes_with_summary")
        tables = {name: getattr(new, name) for name in TABLES}
        tables["docs"] = new.docs.join(found.select("doc_name", "digest"), "doc_name").join(told, "doc_name")
        version = self.version + 1
        for name, rows in tables.items():
            rows = rows.withColumn("bucket", self.bucket())
            old = self.table(name, touched)
            if old is not None:
                rows = missing(old, found).unionByName(rows, allowMissingColumns=True)
            self.schemas[name] = T.StructType(sorted(rows.schema.fields, key=lambda f: f.name == "bucket"))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/version={version}")
        if counts.get("deleted"):
            found.where("change = 'deleted'").select("doc_name", "digest").write.mode("overwrite").parquet(f"{self.path}/tombstones/version={version}")
        self.manifest |= {b: {"bucket": b, "version": version} | f for b, f in self._figures(version, touched).items()}
        if self.version == 0:
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/buckets")
        self.spark.createDataFrame([(name, schema.json()) for name, schema in self.schemas.items()], "name string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schemas/version={version}")
        rows = [tuple(r[c] for c in ("bucket", "version", *FIGURES)) for r in self.manifest.values()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self.version = version
        return out

    def _figures(self, version: int, touched: list[int]) -> dict[int, dict]:
        """The figures of the buckets that a version has rewritten; zeros for those that it left empty."""
        read = lambda name: self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}/version={version}").groupBy("bucket")
        out = {b: dict.fromkeys(FIGURES, 0) for b in touched}
        parts = [
            read("docs").agg(F.count("*").alias("documents")),
            read("nodes").agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("with_summary"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars")),
            read("node_vectors").agg(F.count("*").alias("node_vectors"), F.max(F.size("vector")).cast("long").alias("dimension")),
            read("chunk_vectors").agg(F.count("*").alias("chunk_vectors")),
        ]
        for part in parts:
            for r in part.collect():
                out[r["bucket"]] |= {k: v or 0 for k, v in r.asDict().items() if k != "bucket"}
        return out

    def totals(self) -> dict[str, int]:
        """The figures of the whole, from the manifest alone."""
        rows = self.manifest.values()
        return {c: (max if c == "dimension" else sum)([r[c] for r in rows] or [0]) for c in FIGURES}

    def statistics(self) -> DataFrame:
        """One row, as tree.statistics gives it by reading all nodes."""
        t = self.totals()
        return self.spark.createDataFrame([(t["chars"], t["chars"] // 3, t["nodes"], t["documents"])], "total_chars long, estimated_tokens long, total_nodes long, total_documents long")

    def vector_statistics(self) -> DataFrame:
        t = self.totals()
        return self.spark.createDataFrame([(t["node_vectors"], t["dimension"], t["documents"], t["chunk_vectors"])], "total_nodes long, dimension long, total_documents long, total_chunks long")

    def summary_coverage(self) -> DataFrame:
        t = self.totals()
        return self.spark.createDataFrame([(t["nodes"], t["with_summary"], t["with_summary"] / t["nodes"] if t["nodes"] else None)], "total_nodes long, nodes_with_summary long, coverage double")

    def listing(self) -> DataFrame:
        """Each document with its number of nodes and of nodes with a summary, which its row holds."""
        n, s = F.col("total_nodes"), F.col("nodes_with_summary")
        return self.table("docs").select("doc_name", F.substring("description", 1, 200).alias("description"), n, s, (n == s).alias("has_full_summary"))

    def tombstones(self) -> DataFrame:
        """doc_name, digest, version of what was deleted."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tombstones")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], TOMBSTONES)
        return self.spark.read.schema(TOMBSTONES).parquet(f"{self.path}/tombstones").where(F.col("version") <= self.version)

    def vacuum(self) -> int:
        """Delete the folders that no bucket's newest version is in: how many. Readers of older versions lose them."""
        jvm, gone = self.spark._jvm, 0
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in TABLES:
            for v in range(1, self.version + 1):
                folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/version={v}")
                for s in fs.listStatus(folder) if fs.exists(folder) else ():
                    part = s.getPath().getName()
                    if part.startswith("bucket=") and self.manifest[int(part.split("=")[1])]["version"] != v:
                        gone += bool(fs.delete(s.getPath(), True))
        return gone
