"""Importance resampling towards a target distribution, by hashed n-grams.

Features of a text are its runs of one to three consecutive words, hashed to BUCKETS buckets by the crc32 of their bytes.
The first pass counts buckets: every task adds up one vector by np.bincount, and the vectors are merged as a tree. A bucket's
gain is the logarithm of how much likelier the target holds it than the documents, in thousandths, rounded down. The second
pass gathers the gains, which are broadcast (BUCKETS numbers, whatever the input), and sums them for each document. Gumbel
noise, made of a hash of the id, turns the highest scores into a sample without replacement whose odds follow the weights.
Ranks come from a sort by ranges; no task sees all scores.

Words are runs of letters, digits and whatever isn't ASCII; A-Z is lower-cased. All work is done on the bytes of whole
batches: the crc32 of an n-gram is put together from those of its words, since it is linear (crc(ab) is crc(a), moved on
by the length of b, xor crc(b)), so that no n-gram is ever made as a string.

Null texts count as empty: no features, weight 0. A null id is the empty string in the hash, and comes last among ties;
rows that tie in score and id are drawn in any order. Repeated rows count and are drawn as rows of their own. An empty
table of documents gives no rows; an empty target gives the gains of the smoothed counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, mapped, ranked, stored, text_or_empty, unused

BUCKETS, ORDER = 10_000, 3
#: Percent of the documents of at least LEAST_WORDS words that are drawn.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Words longer than this are hashed one by one.
LONG_WORD = 64
#: Bytes of text that a task works on at once (a longer text stands alone).
SLICE_BYTES = 2 << 20
#: Vectors that are merged in one task, at most.
FAN_IN = 64

U32 = np.uint32


def _lower_and_word() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256, dtype=np.uint8)
    lower = np.where((byte >= ord("A")) & (byte <= ord("Z")), byte + 32, byte).astype(np.uint8)
    word = ((byte >= ord("0")) & (byte <= ord("9"))) | ((byte >= ord("a")) & (byte <= ord("z"))) | (byte >= 0x80)
    return lower, word


LOWER, IS_WORD = _lower_and_word()


def _byte_table() -> np.ndarray:
    """The crc register after one byte, for each value of its low byte (reflected polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ U32(0xEDB88320), c >> 1)
    return c


BYTE = _byte_table()
FULL = U32(0xFFFFFFFF)


class Shift:
    """crc registers moved on by so many zero bytes: for each power of two a table for each of a register's four bytes."""

    def __init__(self) -> None:
        low = np.arange(256, dtype=U32)
        places = np.stack([low << U32(8 * j) for j in range(4)])
        self.tables = [BYTE[places & 0xFF] ^ (places >> U32(8))]

    def power(self, k: int, c: np.ndarray) -> np.ndarray:
        while len(self.tables) <= k:
            last = len(self.tables) - 1
            self.tables.append(self.power(last, self.tables[last]))
        t = self.tables[k]
        return t[0][c & 0xFF] ^ t[1][(c >> U32(8)) & 0xFF] ^ t[2][(c >> U32(16)) & 0xFF] ^ t[3][c >> U32(24)]

    def __call__(self, c: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = c.copy()
        for k in range(int(by.max(initial=0)).bit_length()):
            at = np.flatnonzero((by >> k) & 1)
            out[at] = self.power(k, out[at])
        return out


SHIFT = Shift()


def fed(c: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """crc registers after one more byte."""
    return BYTE[(c ^ byte) & 0xFF] ^ (c >> U32(8))


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, first byte, length and text of each word) of texts that lie one after another in data."""
    low = LOWER[data]
    inside = IS_WORD[low]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = cut[ends] = True
    first = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside[:-1])[: len(inside)]))
    last = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False)[: len(inside)]))
    # Empty texts start where the next one does: the last text that starts there is the one that holds the word.
    return low, first, last - first + 1, np.searchsorted(starts, first, "right") - 1


def word_crcs(low: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.full(len(first), FULL, U32)
    on = np.flatnonzero(length <= LONG_WORD)
    k = 0
    while len(on):
        crc[on] = fed(crc[on], low[first[on] + k])
        k += 1
        on = on[length[on] > k]
    crc ^= FULL
    for i in np.flatnonzero(length > LONG_WORD):
        crc[i] = zlib.crc32(low[first[i] : first[i] + length[i]])
    return crc


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, its crc32, words of each text)."""
    low, first, length, text = words_of(data, starts, ends)
    word = word_crcs(low, first, length)
    found, of, here = [word], [text], word
    for k in range(1, order):
        if len(word) <= k:
            break
        spaced = fed(here[: len(word) - k] ^ FULL, 0x20) ^ FULL
        here = SHIFT(spaced, length[k:]) ^ word[k:]
        same = text[k:] == text[:-k]
        found.append(here[same])
        of.append(text[k:][same])
    return np.concatenate(of), np.concatenate(found), np.bincount(text, minlength=len(starts))


def batch_features(texts: pa.Array, order: int = ORDER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices s..e of a batch: s, e, and the features of their texts."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    s = 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(at, at[s] + SLICE_BYTES, "right")) - 1)
        part, offsets = data[at[s] : at[e]], at[s : e + 1] - at[s]
        yield s, e, *features(part, offsets[:-1], offsets[1:], order)
        s = e


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the column `text` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, crc, _ in batch_features(b.column(0)):
                total += np.bincount(crc % U32(buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = mapped(texts.select(text_or_empty().alias("text")), run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    tasks = vectors.getNumPartitions()
    if not tasks:
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(lambda a, b: a + b, depth=max(2, math.ceil(math.log(tasks, FAN_IN))))


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, from how often documents and the target hold it."""
    of, n = int(target.sum()) + len(target), int(docs.sum()) + len(docs)
    return np.array([math.floor(1000 * math.log((t + 1) * n / ((s + 1) * of))) for s, t in zip(docs.tolist(), target.tolist())], np.float64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, of, crc, words in batch_features(b.column(1)):
                weight = np.bincount(of, shared.value[crc % U32(len(shared.value))], e - s)
                columns = [b.column(0).slice(s, e - s), pa.array(words), pa.array(np.bincount(of, minlength=e - s)), pa.array(weight.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(table, run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of docs; target: rows with a text."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = stored(weights(docs, gain).withColumn("score", F.col("weight") + noise), "scores")
    out = F.col("n_words") < least_words
    drawn = scored.where(~out).count() * percent // 100
    at = unused("_rank", scored.columns)
    # Documents that are too short come after all others, so that the others' places are their ranks.
    placed = ranked(scored, [out, F.col("score").desc(), F.col("doc_id").asc_nulls_last()], at)
    rank = F.when(~out & (F.col(at) <= drawn), F.col(at))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")


def selected(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn; ids must tell rows apart (where they don't, all rows of a drawn id stay)."""
    drawn = resampled(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_GRAMS = "list_concat(list_concat(ws, list_transform(ws[:-2], lambda w, i: w || ' ' || ws[i + 1])), list_transform(ws[:-3], lambda w, i: w || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
grams AS (SELECT 0 AS r, unnest({_GRAMS}) AS f FROM b
  UNION ALL SELECT r, unnest({_GRAMS}) FROM d),
g AS (SELECT r, f, count(*) AS n FROM grams GROUP BY ALL),
u AS (SELECT f, {crc32_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM g)),
s AS (SELECT bucket, sum(n) FILTER (r > 0) AS s, sum(n) FILTER (r = 0) AS t FROM g JOIN u USING (f) GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM s),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM s, tot),
w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN u USING (f) JOIN gain USING (bucket) WHERE r > 0 GROUP BY r),
e AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(*) FILTER (n_words >= 20) OVER () AS many FROM e)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= many * 5 // 100 THEN place END::BIGINT AS rank, n_words::BIGINT AS n_words FROM k
"""
