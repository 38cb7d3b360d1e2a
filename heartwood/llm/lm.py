"""Language-model scores: stupid backoff over the n-gram counts of the corpus.

Every word of a document is scored by the counts of all other documents: the relative frequency of the longest n-gram
(up to ORDER words) that they hold, times BACKOFF for each word of history given up; a word that no other document
holds counts as half a word of the corpus. A document's score is the sum of the logarithms.

The relations are those of the textbook: n-gram counts, partitioned by hash; joined to the n-grams of the documents;
summed per document. To keep shuffles small, what is exchanged are blocks rather than single rows: documents are dealt
into batches, a batch sends each hash partition the sorted distinct n-grams it holds with their counts there, the
partition sums them over batches and returns the totals in the same order, and the batch scores its documents. A
frequent n-gram is one entry of a batch's block, however often it occurs, so that no partition gets a hot group.
N-grams stand for themselves by hashes with SPARE_BITS more bits than it takes to count the n-grams of the corpus, so
that about one lookup in 2**(SPARE_BITS - 1) meets another n-gram's count, up to 2**38 n-grams; hashes have 64 bits at
most, so that beyond, each doubling of the corpus takes one of the spare bits. There are as many blocks as batches times
partitions; with the sizes given here, a block holds some 300 n-grams at 30 GB of Parquet and some 10 at 1 TB, from where
on larger batches (`batch_chars`) and executors are needed. Within a block, sorted hashes
are kept as differences in byte planes, and planes of little entropy are deflated.

Rows are dealt into batches by id and text, so that rows without an id, or with one id, are spread by their texts. Words
are separated by blanks; case is ignored. Null texts count as empty: no words, score 0, null per word. Repeated
rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .neardup import U64, mix, offsets, word_hashes

ORDER = 3
BACKOFF = 0.4
BATCH_CHARS = 8_000_000
PARTITION_ENTRIES = 2_000_000
SPARE_BITS = 26


def grams(words: np.ndarray, ends: np.ndarray, order: int = ORDER, bits: int = 60) -> list[np.ndarray]:
    """For each order 1..n the hash of the n-gram that ends at each word, and 0 where the document has no such one."""
    words = mix(words.view(U64))
    place = np.arange(len(words)) - np.repeat(ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0))
    out, h = [], np.zeros(len(words), U64)
    for k in range(order):
        # n-grams are hashed from their last word back, so that each longer one extends the shorter one's hash
        back = np.roll(words, k)
        h = mix(h * U64(0x9E3779B97F4A7C15) + back + U64(k + 1))
        out.append(np.where(place >= k, h >> U64(64 - bits) | U64(1), U64(0)))
    return out


def bounds(partitions: int, bits: int) -> np.ndarray:
    """First hash of each partition."""
    return np.array([-(-(i << bits) // partitions) for i in range(partitions)], U64)


def packed(x: np.ndarray, even: int = 0) -> bytes:
    """Non-negative integers as bytes: how many bytes each takes, then the planes of their bytes from the lowest up. The
    `even` lowest planes, which look like noise, are kept as they are; the others are deflated together."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    even = min(even, width)
    return bytes([width, even]) + planes[:even].tobytes() + zlib.compress(planes[even:].tobytes(), 1)


def unpacked(data: bytes, n: int) -> np.ndarray:
    width, even = data[0], data[1]
    planes = data[2 : 2 + even * n] + zlib.decompress(data[2 + even * n :])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def batch_grams(table: pa.Table, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(all n-grams of a batch, order after order; ends of the documents' words)."""
    words, ends = offsets(table.column("words").combine_chunks())
    return np.concatenate(grams(words, ends, order, bits)), ends


BLOCK = "part int, batch int, n int, hashes binary, counts binary"
TOTAL = "batch int, part int, n int, others binary"
SCORES = "doc_id long, n_words long, log_score double, n_order3 long, n_order2 long, n_order1 long, n_new long"


def batch_blocks(partitions: int, bits: int, order: int = ORDER):
    edge = bounds(partitions, bits)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found, count = np.unique(batch_grams(table, order, bits)[0], return_counts=True)
        keep = found > 0
        found, count = found[keep], count[keep]
        cut = np.append(np.searchsorted(found, edge), len(found))
        even = max(0, (bits - len(found).bit_length()) // 8 - 1)  # bytes of a difference that are all noise
        rows: list[tuple] = []
        for p in np.flatnonzero(np.diff(cut)):
            part = slice(cut[p], cut[p + 1])
            rows.append((int(p), key[0].as_py(), int(cut[p + 1] - cut[p]), packed(np.diff(found[part], prepend=edge[p]), even), packed(count[part])))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "batch", "n", "hashes", "counts"])

    return run


def partition_totals(partitions: int, bits: int):
    """For each block, how often the other batches hold its n-grams."""
    edge = bounds(partitions, bits)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = edge[key[0].as_py()]
        rows = table.to_pylist()
        hashes = [np.cumsum(unpacked(r["hashes"], r["n"]), dtype=U64) + first for r in rows]
        counts = np.concatenate([unpacked(r["counts"], r["n"]) for r in rows]).astype(np.int64)
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        others = np.bincount(at, counts).astype(np.int64)[at] - counts
        parts = np.split(others, np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table([pa.array([r["batch"] for r in rows], pa.int32()), pa.array([r["part"] for r in rows], pa.int32()), pa.array([r["n"] for r in rows], pa.int32()), pa.array(map(packed, parts), pa.binary())], ["batch", "part", "n", "others"])

    return run


def batch_scores(n_words: int, bits: int, order: int = ORDER, backoff: float = BACKOFF):
    def run(table: pa.Table, totals: pa.Table) -> pa.Table:
        every, ends = batch_grams(table, order, bits)
        found, at, count = np.unique(every, return_inverse=True, return_counts=True)
        at = at.reshape(order, -1)
        del every
        parts = sorted(totals.to_pylist(), key=lambda r: r["part"])
        total = count + np.concatenate([np.zeros(int(len(found) > 0 and found[0] == 0), np.int64), *(unpacked(r["others"], r["n"]).astype(np.int64) for r in parts)])
        sizes = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ends)), sizes)
        rest = np.empty((order, len(doc)), np.int64)
        for k in range(order):  # without what each document itself holds
            _, own_at, own = np.unique(doc * max(1, len(found)) + at[k], return_inverse=True, return_counts=True)
            rest[k] = total[at[k]] - own[own_at]
        del at, total, count
        others = np.maximum(n_words - sizes, 1)[doc]
        place = np.arange(len(doc)) - np.repeat(ends - sizes, sizes)
        score, level, open_ = np.full(len(doc), 0.0), np.zeros(len(doc), np.int64), np.ones(len(doc), bool)
        for n in range(order, 0, -1):
            seen = open_ & (place >= n - 1) & (rest[n - 1] > 0)
            history = others if n == 1 else np.roll(rest[n - 2], 1)
            given_up = np.minimum(place, order - 1) - (n - 1)
            score[seen] = np.log(rest[n - 1][seen] / history[seen]) + given_up[seen] * math.log(backoff)
            level[seen] = n
            open_ &= ~seen
        score[open_] = np.log(0.5 / others[open_]) + np.minimum(place[open_], order - 1) * math.log(backoff)
        by = lambda x: np.bincount(doc, x, len(ends))
        columns = [table.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(by(score), pa.float64()), *(pa.array(by(level == n).astype(np.int64)) for n in (3, 2, 1, 0))]
        return pa.table(columns, ["doc_id", "n_words", "log_score", "n_order3", "n_order2", "n_order1", "n_new"])

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, batch_chars: int = BATCH_CHARS, partition_entries: int = PARTITION_ENTRIES) -> DataFrame:
    """doc_id, n_words, log_score, per_word, and how many words were scored with 3, 2, 1 and no words that others hold."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    words = F.size(F.filter(F.split(F.lower(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    chars, n_words = table.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.sum(words), F.lit(0))).first()
    batches = max(1, -(-chars // batch_chars))
    partitions = max(1, -(-n_words * order // partition_entries))
    bits = min(64, (n_words * order).bit_length() + SPARE_BITS)
    dealt = table.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")).repartition("batch")
    dealt = dealt.select("batch", "doc_id", word_hashes(F.col("text")).alias("words"))
    blocks = dealt.groupBy("batch").applyInArrow(batch_blocks(partitions, bits, order), BLOCK)
    totals = blocks.groupBy("part").applyInArrow(partition_totals(partitions, bits), TOTAL)
    scores = dealt.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(batch_scores(n_words, bits, order, backoff), SCORES)
    return scores.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


ORACLE = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, doc_id, generate_subscripts(ws, 1) AS i, ws FROM d),
w AS (SELECT r, doc_id, i, ws[i] AS w3, CASE WHEN i > 1 THEN ws[i - 1] END AS w2, CASE WHEN i > 2 THEN ws[i - 2] END AS w1 FROM t),
n AS (SELECT count(*) AS n FROM w),
u AS (SELECT w3, count(*) AS c FROM w GROUP BY ALL), ud AS (SELECT r, w3, count(*) AS c FROM w GROUP BY ALL),
b AS (SELECT w2, w3, count(*) AS c FROM w WHERE w2 IS NOT NULL GROUP BY ALL), bd AS (SELECT r, w2, w3, count(*) AS c FROM w WHERE w2 IS NOT NULL GROUP BY ALL),
g AS (SELECT w1, w2, w3, count(*) AS c FROM w WHERE w1 IS NOT NULL GROUP BY ALL), gd AS (SELECT r, w1, w2, w3, count(*) AS c FROM w WHERE w1 IS NOT NULL GROUP BY ALL),
l AS (SELECT r, doc_id, len(ws) AS m FROM d),
k AS (
  SELECT w.r, w.i, l.m, n.n - l.m AS others, u.c - ud.c AS c1, b.c - bd.c AS c2, g.c - gd.c AS c3, hu.c - hud.c AS h2, hb.c - hbd.c AS h3
  FROM w JOIN l USING (r) CROSS JOIN n JOIN u USING (w3) JOIN ud USING (r, w3)
  LEFT JOIN b ON b.w2 = w.w2 AND b.w3 = w.w3 LEFT JOIN bd ON bd.r = w.r AND bd.w2 = w.w2 AND bd.w3 = w.w3
  LEFT JOIN g ON g.w1 = w.w1 AND g.w2 = w.w2 AND g.w3 = w.w3 LEFT JOIN gd ON gd.r = w.r AND gd.w1 = w.w1 AND gd.w2 = w.w2 AND gd.w3 = w.w3
  LEFT JOIN u hu ON hu.w3 = w.w2 LEFT JOIN ud hud ON hud.r = w.r AND hud.w3 = w.w2
  LEFT JOIN b hb ON hb.w2 = w.w1 AND hb.w3 = w.w2 LEFT JOIN bd hbd ON hbd.r = w.r AND hbd.w2 = w.w1 AND hbd.w3 = w.w2
),
s AS (
  SELECT r, CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / h3) WHEN c2 > 0 THEN ln(c2::DOUBLE / h2) + (least(i - 1, 2) - 1) * ln(0.4)
    WHEN c1 > 0 THEN ln(c1::DOUBLE / greatest(others, 1)) + least(i - 1, 2) * ln(0.4) ELSE ln(0.5 / greatest(others, 1)) + least(i - 1, 2) * ln(0.4) END AS x,
    CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS level FROM k
),
a AS (SELECT r, sum(x) AS x, count(*) FILTER (level = 3) AS n3, count(*) FILTER (level = 2) AS n2, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 0) AS n0 FROM s GROUP BY r)
SELECT doc_id, m::BIGINT AS n_words, round(coalesce(x, 0), 4) AS log_score, CASE WHEN m > 0 THEN round(x / m, 4) END AS per_word,
  coalesce(n3, 0)::BIGINT AS n_order3, coalesce(n2, 0)::BIGINT AS n_order2, coalesce(n1, 0)::BIGINT AS n_order1, coalesce(n0, 0)::BIGINT AS n_new
FROM l LEFT JOIN a USING (r)
"""
