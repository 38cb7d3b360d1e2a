"""Token ids, packed sequences and binary output.

Null and empty texts are their end id alone; texts of any length are tokenised whole and cut without loss. Repeated rows
and equal texts are packed as rows of their own; other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped, slices, stored, text_or_empty
from .packing import dealt, pack, planned

TOKENIZER = "byte_bpe_50k.json"
LIMIT, END_ID = 1024, 2


@lru_cache(2)
def exact(path: str):
    """The tokenizers library's own encoder, which takes much memory and is made where a text asks for it."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(2)
def encoder(name: str = TOKENIZER):
    """texts -> lists of ids, as the tokenizers library gives them without added special tokens.

    The rank file beside the JSON file holds the same vocabulary and merges for a faster library; texts that hold a
    special token's string go to the tokenizers library itself, which reads that string as the token."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        added, _ = json.JSONDecoder().raw_decode(re.split(r'"added_tokens"\s*:\s*', f.read(), maxsplit=1)[1])
    special = [t["content"] for t in added]
    with open(path.replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact(path).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what is over, the others are full."""
    first = n % limit or limit
    return [(0, min(first, n)), *((s, limit) for s in range(first, n, limit))]


PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]))


def pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids, end id included; only longer ones are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                ids = np.array([*encode(text), end_id], "<u4")
                out.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n].tobytes())} for k, (s, n) in enumerate(cuts(len(ids), limit))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, PIECES)], ["doc_id", "pieces"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = mapped(table, run, "doc_id long, pieces array<struct<piece: int, start: long, length: int, ids_crc32: long>>")
    return found.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")


def packed_pieces(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every piece of every document with its sequence and its offset there. Null and empty texts are their end id
    alone; an empty table gives no rows. Texts are tokenised once; what is kept is five numbers a piece."""
    kept = stored(pieces(docs, limit), "pieces")
    long = lambda c: F.col(c).cast("long").alias(c)
    return pack(kept, limit, "length").select("doc_id", "piece", "start", long("length"), "ids_crc32", "sequence_id", long("offset"))


#: Rows of the table of first ranks (one for each size and task that tokenises) up to which it is broadcast; beyond, it is
#: joined by a shuffle of the ids.
FIRSTS = 1_000_000
KEPT = "part int, rank long, doc_id long, start long, length int, ids binary"
PACKED = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
    ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids_crc32", pa.int64()),
])


def kept_ids(docs: DataFrame, limit: int, end_id: int, tokenizer: str, id_type: str) -> DataFrame:
    """Every piece of every document with its ids, compressed, and its rank among the pieces of its length that the same
    task has made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encode, small = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text), end_id], id_type)
                for start, n in cuts(len(ids), limit):
                    rows.append((part, int(seen[n]), doc, start, n, small.compress(ids[start : start + n].tobytes())))
                    seen[n] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "rank", "doc_id", "start", "length", "ids"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(table, run, KEPT)


def packed_matrix(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, tokenizer: str = TOKENIZER, id_type: str = "<u2", firsts_up_to: int = FIRSTS) -> DataFrame:
    """One row per packed sequence, ready to be written: the ids of its row of the matrix as little-endian integers
    padded with the end id to `limit`, the documents and starts of its segments, their cumulative lengths, and the
    places where positions start again from 0.

    The whole table is packed, best fit decreasing, from its histogram of lengths; overlong documents are cut without
    loss. Texts are tokenised once and their ids written down, with ranks among the pieces of a length in each task; with
    the number of such pieces in the tasks before, these are ranks in the table, and places follow. Ids are shuffled once,
    to their sequence. Pieces of one length are alike to the packing: which of them goes where depends on the order in
    which the table is read."""
    kept = stored(kept_ids(docs, limit, end_id, tokenizer, id_type), "ids")
    counts = cut(kept.groupBy("length", "part").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = planned(kept.sparkSession, histogram, limit)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    firsts = F.broadcast(firsts) if counts.count() <= firsts_up_to else firsts.hint("merge")
    ranked = kept.join(firsts, ["length", "part"]).withColumn("_rank", F.col("_base") + F.col("rank"))
    segments = dealt(ranked, places, "length", ["doc_id", "start", "length", "ids"])
    rows = segments.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        whole = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[] for _ in PACKED]
            for sequence, inside in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row, ends = np.full(limit, end_id, id_type), [0]
                for x in inside:
                    row[x["offset"] : x["offset"] + x["length"]] = np.frombuffer(whole.decompress(x["ids"]), id_type)
                    ends.append(x["offset"] + x["length"])
                values = (sequence, ends[-1], row.tobytes(), [x["doc_id"] for x in inside], [x["start"] for x in inside], ends, ends[:-1], zlib.crc32(row.astype("<u4").tobytes()))
                for column, value in zip(out, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PACKED)], schema=PACKED)

    return mapped(rows, run, "sequence_id long, n_tokens int, ids binary, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids_crc32 long")


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed matrix as Parquet, through Spark's writer, to any path that Spark reaches."""
    packed_matrix(docs, **options).write.mode("overwrite").parquet(path)


def unpacked(packed: DataFrame, id_type: str = "<u2") -> DataFrame:
    """doc_id, start, ids (array) of every segment of a packed table: the exact way back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices([1] * b.num_rows, 256):
                docs, starts, ids = [], [], []
                for row in b.slice(lo, hi - lo).to_pylist():
                    flat, ends = np.frombuffer(row["ids"], id_type), row["cu_seqlens"]
                    for doc, start, s, e in zip(row["doc_ids"], row["starts"], ends, ends[1:]):
                        docs.append(doc)
                        starts.append(start)
                        ids.append(flat[s:e].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return mapped(packed.select("ids", "doc_ids", "starts", "cu_seqlens"), run, "doc_id long, start long, ids array<int>")
