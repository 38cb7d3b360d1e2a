"""Spelling variants of the words of a corpus, grouped by full neighbourhood generation.

Words are counted in the JVM. Each word of the vocabulary emits every distinct string at one edit from it: all deletions, all
replacements and all insertions over the alphabet that the vocabulary is written in. Those candidates that are words
themselves are its near words: a hash join with the vocabulary finds them, and no distance is worked out.

A word of L code points has some 2 A L candidates over an alphabet of A, of which few are words. So that not all of them are
shuffled, a task looks its candidates up in a bitmap of hashes of the vocabulary first, and makes strings only of those that
may be words. The bitmap has 2**FILTER_BITS bits, whatever the size of the vocabulary; what it lets pass in error, the join
drops. It costs a larger vocabulary only shuffled candidates, never a link. Hashes of candidates come from those of
the word's prefixes and suffixes in numpy, long words by pieces.

A word's form is its near word of largest count (ties: the least in code-point order), if that occurs FACTOR times as often;
forms of forms end in the root. As counts grow by FACTOR at each step, a path is at most log(n) / log(FACTOR) long, and roots
are found by doubling it.

Null texts hold no words. A null id is the empty string in the hash that decides on deletions. Repeated rows count as rows of
their own. Words of any length are worked on whole. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, mapped, stored, text_or_empty

LEAST_CHARS, LEAST_COUNT, FACTOR = 7, 2, 10
#: One in so many occurrences loses a code point.
DAMAGED = 31
FILTER_BITS, PROBES = 27, 2
#: Candidates that a task holds hashes of at once, and words that it makes candidates of.
CANDIDATES, WORDS_EACH = 1 << 20, 20_000

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A good hash of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word and n of every word of so many code points and occurrences."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # Runs are maximal, so that shorter ones never match; a damaged run has one code point more than its word.
    runs = F.regexp_extract_all(text_or_empty(), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}+)"), F.lit(1))
    run = F.translate(F.col("_run"), upper, upper.lower())
    table = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.explode(runs).alias("_run")).select("_doc", run.alias("_run"))
    h, at = F.crc32(F.concat("_doc", F.lit(":"), "_run")), F.col("_h") % F.length("_run")
    less = F.concat(F.substring("_run", 1, at), F.substring("_run", at + 2, F.length("_run")))
    words = table.withColumn("_h", h).select(F.when(F.col("_h") % damaged == 0, less).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def code_points(words: list[str]) -> np.ndarray:
    """One row of code points for each of some words of equal length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(U64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashes(codes: np.ndarray) -> np.ndarray:
    return (codes * powers(BASE, codes.shape[1])).sum(1, dtype=U64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, code points) of the words of each length."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), max(1, CANDIDATES // max(int(size), 1))):
            part = at[k : k + max(1, CANDIDATES // max(int(size), 1))]
            yield part, code_points([words[i] for i in part])


def bit_places(h: np.ndarray, bits: int = FILTER_BITS, probes: int = PROBES) -> list[np.ndarray]:
    h = mix(h)
    return [((h >> U64(64 - bits)) if k == 0 else (mix(h + U64(k)) >> U64(64 - bits))).astype(np.int64) for k in range(probes)]


def word_filter(words: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The bitmap of the vocabulary's hashes, as bytes: tasks say which bits, and the JVM puts them together in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes in by_length(b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bit_places(hashes(codes), bits)))], ["bit"])

    found = mapped(words.select("word"), run, "bit long")
    blocks = found.groupBy(F.expr("bitmap_bucket_number(bit)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    # A bucket of Spark's bitmaps holds 32768 bits: bits 1 to 32768 are bucket 1, and bit 0 stands in bucket 0.
    for block, data in blocks.select("block", "bits").collect():
        if block == 0:
            out[0] |= 1
            continue
        place = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(data), np.uint8), bitorder="little")) + (block - 1) * 32768 + 1
        place = place[place < (1 << bits)]
        np.bitwise_or.at(out, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return out


def neighbours(codes: np.ndarray, alphabet: np.ndarray, known) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, kind, code point) of each distinct string at one edit from the rows' words whose hash is known. Kind 0: the
    code point at place is deleted; 1: replaced; 2: another is inserted before place. Of edits that give the same string, the
    first one counts: of a run of equal code points the first is deleted, and a code point is inserted before its equals."""
    n, size = codes.shape
    up = powers(BASE, size + 1)
    prefix = np.concatenate([np.zeros((n, 1), U64), np.cumsum(codes * up[:size], 1, dtype=U64)], 1)
    whole = prefix[:, -1:]
    before = np.concatenate([np.zeros((n, 1), U64), codes], 1)
    width = max(1, CANDIDATES // max(1, n * len(alphabet)))
    for s in range(0, size + 1, width):
        e = min(s + width, size + 1)
        own = slice(s, min(e, size))
        gone = prefix[:, own] + (whole - prefix[:, own.start + 1 : own.stop + 1]) * U64(INVERSE)
        row, place = np.nonzero((codes[:, own] != before[:, own]) & known(gone))
        yield row, place + s, np.zeros(len(row), np.int64), np.zeros(len(row), U64)
        other = whole[:, :, None] + (alphabet - codes[:, own, None]) * up[own][None, :, None]
        row, place, letter = np.nonzero((codes[:, own, None] != alphabet) & known(other))
        yield row, place + s, np.ones(len(row), np.int64), alphabet[letter]
        more = (prefix[:, s:e] + (whole - prefix[:, s:e]) * U64(BASE))[:, :, None] + alphabet * up[s:e][None, :, None]
        row, place, letter = np.nonzero((before[:, s:e, None] != alphabet) & known(more))
        yield row, place + s, np.full(len(row), 2), alphabet[letter]


def candidates(words: DataFrame, alphabet: list[int], bitmap: np.ndarray | None, bits: int = FILTER_BITS) -> DataFrame:
    """word, n and near: strings at one edit from the words; with a bitmap, those that may be words."""
    letters = np.array(sorted(alphabet), U64)
    shared = words.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def known(h: np.ndarray) -> np.ndarray:
        if shared is None:
            return np.ones(h.shape, bool)
        held = shared.value
        hit = np.ones(h.size, bool)
        at = np.arange(h.size)
        for place in (bit_places(h.ravel(), bits, 1)[0], None):
            if place is None:  # only what the first probe lets pass is looked up once more
                at = np.flatnonzero(hit)
                place = bit_places(h.ravel()[at], bits)[1]
            hit[at] = (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return hit.reshape(h.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, codes in by_length(texts):
                step = max(1, CANDIDATES // (max(1, len(letters)) * (codes.shape[1] + 1)))
                for s in range(0, len(at), step):
                    for row, place, kind, letter in neighbours(codes[s : s + step], letters, known):
                        word = [texts[at[s + r]] for r in row]
                        near = [w[:p] + chr(c) * (k > 0) + w[p + (k < 2) :] for w, p, k, c in zip(word, place.tolist(), kind.tolist(), letter.tolist())]
                        for k in range(0, len(word), max(1, CANDIDATES // 16 // max(1, codes.shape[1] // 64))):
                            part = slice(k, k + max(1, CANDIDATES // 16 // max(1, codes.shape[1] // 64)))
                            yield pa.RecordBatch.from_arrays([pa.array(word[part], pa.string()), pa.array([counts[at[s + r]] for r in row[part]], pa.int64()), pa.array(near[part], pa.string())], ["word", "n", "near"])

    return mapped(words.select("word", "n"), run, "word string, n long, near string")


def variants(docs: DataFrame, factor: int = FACTOR, bits: int = FILTER_BITS, **how) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    words = stored(vocabulary(docs, **how), "vocabulary")
    # The alphabet is at most the letters of the pattern: 26 and U+00C0 to U+00FF.
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().select(F.ascii("c")).collect()
    # A short row of the vocabulary is much work: tasks are made by the number of words, not of bytes.
    dealt = words.repartition(max(8, words.count() // WORDS_EACH), "word")
    found = candidates(dealt, [r[0] for r in letters], word_filter(words, bits), bits)
    of = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = found.join(of.hint("shuffle_hash"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    large = F.col("form_n") >= factor * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("form")).alias("form"), F.when(large, F.col("form_n")).alias("form_n"))
    formed = stored(formed, "forms")
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for k in range(max(0, math.ceil(math.log2(max(1, math.log(most) / math.log(max(2, factor))))))):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root")), f"roots{k}")
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {crc32_sql("doc || ':' || run")} AS h FROM d),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS b FROM i),
near AS (
  SELECT p.word, p.n, q.word AS other, q.n AS m FROM x p JOIN x q ON p.a = q.a AND p.b = q.b AND p.word <> q.word
  UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON v.word = a || b
  UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON v.word = a || b
),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN k ON k.word = v.word AND k.k = 1),
r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.up)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN r ON r.word = f.word AND r.up IS NULL
"""
