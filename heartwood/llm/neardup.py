"""Near-duplicate classes by ProbMinHash.

A document is the weighted set of its shingles (five words, weighed by how often they occur). ProbMinHash lets every
shingle arrive at random registers at the times of a Poisson process whose rate is its weight; a register keeps the
shingle that arrives first, and a shingle is left alone as soon as its next arrival is later than all registers'
(early termination). Two documents agree in a register with the probability Jaccard similarity
sum_i 1 / sum_j max(u_j / u_i, v_j / v_i), which is the common Jaccard index where weights are equal.

A shingle that occurs n times weighs 1 + ln n. Counts themselves would make documents equal that share nothing but one
line, if they repeat it often enough. Two documents are linked at a similarity of `threshold` or more by these weights, or
by their sets of shingles.

Registers are cut in bands; documents that share a band are candidates. A document in which shingles repeat has a second
signature, with all weights 1, whose bands lie in the same key space: links by sets are found through it. Copies (equal
shingles in equal number) are first represented by the least id. Every document is compared with the least one of the
bucket that it shares most bands with; members of buckets that then still lie in several classes are joined exactly, by
prefixes of rare shingles, so that no group is compared pair by pair and no link of theirs is left out. All candidates
are verified on the whole texts. Classes are the connected components.

Words are separated by blanks; case is ignored. A text of fewer than five words is one shingle; null, empty and blank
texts are copies of each other. Repeated rows are rows of one class. Different texts with one doc_id are documents of their
own, each compared with all. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, mapped, ranked, slices, stored, text_or_empty, unused

WORDS = 5
BANDS, ROWS = 28, 5
THRESHOLD = 0.8
COUNTERS, COUNTER_BLOCK = 21, 1024
#: Words of the texts that a task works on at once.
SLICE_WORDS = 400_000
#: Longs of a document's bitmap.
BITMAP = 8
#: Parts that a document is dealt out in where it is compared with many.
SALTS = 64

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A good hash of 64-bit integers (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of documents given by the hashes of their words, one after another; sorted."""
    words = words.view(U64) if words.dtype == np.int64 else words.astype(U64)
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    number = np.maximum(sizes - WORDS + 1, 1)
    doc = np.repeat(np.arange(len(ends)), number)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + starts[doc]
    h = np.full(len(doc), 0x9E3779B97F4A7C15, U64)
    padded = np.append(words, np.zeros(WORDS, U64))
    for k in range(WORDS):
        inside = at + k < ends[doc]
        h = np.where(inside, mix(h * U64(31) + padded[np.minimum(at + k, len(padded) - 1)]), h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(doc)])
    return doc[first], h[first], np.diff(np.append(first, len(doc)))


def sublinear(weight: np.ndarray) -> np.ndarray:
    """Weight of a shingle that occurs so often. Counts themselves would make documents equal that share nothing but one
    line, if they repeat it often enough."""
    return 1 + np.log(weight)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: for each of n documents and m registers, the shingle that arrives first."""
    time = np.full(n * m, np.inf)
    kept = np.zeros(n * m, U64)
    rate = sublinear(weight)
    now = np.zeros(len(doc))
    state = mix(shingle + U64(0x632BE59BD9B4E019))
    while len(doc):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        now = now - np.log(((state >> U64(11)).astype(np.float64) + 1) / 2.0**53) / rate
        at = doc * m + (mix(state ^ U64(0xD6E8FEB86659FD93)) % U64(m)).astype(np.int64)
        np.minimum.at(time, at, now)
        won = time[at] == now
        kept[at[won]] = shingle[won]
        on = now < time.reshape(n, m).max(1)[doc]
        doc, shingle, rate, now, state = doc[on], shingle[on], rate[on], now[on], state[on]
    return kept.reshape(n, m)


def band_keys(kept: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each document and band."""
    grid = kept.reshape(len(kept), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), grid.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + grid[:, :, k])
    return key.view(np.int64)


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w))


def offsets(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of an array of lists."""
    ends = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), (ends - ends[0])[1:].astype(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, copy (a digest of the weighted shingles) and the band keys of every row: those by weights and, where
    shingles repeat, those by sets (null where both are the same)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for s, e in slices(sizes, SLICE_WORDS):
                words, ends = offsets(b.column(1).slice(s, e - s))
                doc, shingle, weight = shingles(words, ends)
                n = e - s
                parts = mix(shingle ^ mix(weight.astype(U64)))
                copy = np.zeros((2, n), U64)
                np.add.at(copy[0], doc, parts)
                np.add.at(copy[1], doc, mix(parts + U64(1)))
                keys = band_keys(signatures(doc, shingle, weight, n, bands * rows), bands, rows)
                # With weights all 1, both signatures are the same.
                repeats = np.bincount(doc, weight > 1, n) > 0
                inside, number = repeats[doc], np.cumsum(repeats) - 1
                plain = band_keys(signatures(number[doc[inside]], shingle[inside], np.ones(inside.sum()), int(repeats.sum()), bands * rows), bands, rows)
                grid, there = np.hstack([keys, np.zeros_like(keys)]), np.hstack([np.ones_like(keys, bool), np.zeros_like(keys, bool)])
                grid[repeats, bands:], there[repeats, bands:] = plain, plain != keys[repeats]
                held = np.hstack([np.ones_like(keys, bool), np.repeat(repeats[:, None], bands, 1)])
                ends = np.append(0, np.cumsum(held.sum(1))).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(grid[held], mask=~there[held]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, n), pa.array(copy[0].view(np.int64)), pa.array(copy[1].view(np.int64)), lists], ["doc_id", "copy_a", "copy_b", "bands"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(text_or_empty()).alias("words"))
    return mapped(table, run, "doc_id long, copy_a long, copy_b long, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability Jaccard, Jaccard of the sets) of n pairs, given each side's (pair, shingle, weight), sorted."""
    pair, h, u, v = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.concatenate([sublinear(a[2]), np.zeros(len(b[2]))]), np.concatenate([np.zeros(len(a[2])), sublinear(b[2])])
    order = np.lexsort((h, pair))
    pair, h, u, v = pair[order], h[order], u[order], v[order]
    same = np.append((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]), False)
    both = np.flatnonzero(same)
    u[both] += u[both + 1]
    v[both] += v[both + 1]
    keep = np.append(True, ~same[:-1])[: len(pair)]
    pair, u, v = pair[keep], u[keep], v[keep]
    union, common = np.bincount(pair, minlength=n), np.bincount(pair[(u > 0) & (v > 0)], minlength=n)
    # sum_j max(u_j / u_i, v_j / v_i) depends on i only by the ratio q = v_i / u_i: it is (1 / v_i) sum_j max(q u_j, v_j).
    ratio = np.where(u > 0, v / np.where(u > 0, u, 1), np.inf)
    order = np.lexsort((ratio, pair))
    pair, u, v, ratio = pair[order], u[order], v[order], ratio[order]
    starts = np.searchsorted(pair, np.arange(n))
    su, sv = np.concatenate([[0], np.cumsum(u)]), np.concatenate([[0], np.cumsum(v)])
    i = np.flatnonzero((u > 0) & (v > 0))
    end = np.append(starts[1:], len(pair))[pair[i]]
    below = su[i + 1] - su[starts[pair[i]]]  # ratios up to q: q u_j is the larger
    above = sv[end] - sv[i + 1]  # ties after i have v_j = q u_j
    return np.bincount(pair[i], v[i] / (ratio[i] * below + above), n), common / np.maximum(union, 1)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs (a, b) of ids whose whole texts (_id, _text) reach the threshold, by either form of the index. Texts are
    dealt out by id, pairs are never broadcast to them; a document that many others are compared with is dealt out in
    SALTS parts."""
    pairs = pairs.withColumn("_part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    right = pairs.hint("merge").join(texts, pairs["b"] == F.col("_id")).select("a", "b", "_part", F.col("_text").alias("_right"))
    left = pairs.select("a", "_part").distinct().hint("merge").join(texts, F.col("a") == F.col("_id")).select("a", "_part", "_text")
    both = right.hint("merge").join(left, ["a", "_part"]).select("a", "b", word_hashes(F.col("_text")).alias("x"), word_hashes(F.col("_right")).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False) + batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for s, e in slices(sizes, SLICE_WORDS):
                part = batch.slice(s, e - s)
                weighted, plain = similarity(shingles(*offsets(part.column(2))), shingles(*offsets(part.column(3))), e - s)
                yield part.select(["a", "b"]).filter(pa.array(np.maximum(weighted, plain) >= threshold - 1e-9))

    return mapped(both, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, class: the least id reachable over the edges (a, b), for every id on an edge. Labels go to neighbours and to
    the labels of labels in each round, so that rounds grow with the logarithm of the longest path."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("class")))
    while True:
        there = labels.select(F.col("id").alias("b"), F.col("class").alias("_there"))
        least = both.join(there, "b").groupBy(F.col("a").alias("id")).agg(F.min("_there").alias("_least"))
        near = labels.join(least, "id").select("id", F.col("class").alias("_old"), F.least("class", "_least").alias("_near"))
        of = labels.select(F.col("id").alias("_near"), F.col("class").alias("_of"))
        labels = cut(near.join(of, "_near", "left").select("id", "_old", F.coalesce(F.least("_near", "_of"), F.col("_near")).alias("class")))
        if labels.where("_old <> class").isEmpty():
            return labels.select("id", "class")


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, class) with the classes that new links (a, b) join made one."""
    of = labels.withColumnRenamed("class", "_class")
    joined = links.join(of.withColumnRenamed("id", "a"), "a").select(F.col("_class").alias("_a"), "b").join(of.withColumnRenamed("id", "b"), "b").select(F.col("_a").alias("a"), F.col("_class").alias("b"))
    joined = cut(joined.where("a <> b").distinct())
    if joined.isEmpty():
        return labels
    new = components(joined).select(F.col("id").alias("class"), F.col("class").alias("_new"))
    return cut(labels.join(new, "class", "left").select("id", F.coalesce("_new", "class").alias("class")))


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """doc, class of the members of those buckets whose members lie in several classes."""
    at = members.join(labels.withColumnRenamed("id", "doc").hint("merge"), "doc").select("band", "key", "doc", "class")
    split = at.groupBy("band", "key").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi")).where("_lo <> _hi")
    return cut(at.join(split.select("band", "key"), ["band", "key"]).select("doc", "class").distinct())


def sharing_prefixes(rest: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of documents (doc, class) of different classes whose similarity, by weights or by sets, can reach the
    threshold. With shingles in one order for all, two linked by sets share one of their first n - ceil(threshold n) + 1.
    Similarity by weights is at most the sum of min(p, q) over shingles, p and q being the shares of the documents' weight:
    two linked by weights share one of those at which at least the threshold's share of the weight is still to come (with
    weights all 1 these are the same). Any order finds them all; this one is by how often shingles fall into each of
    2**COUNTERS counters, so that common passages come last. A shingle that is alone in its counter is in no other document
    and goes to no join. The counters are what reaches the driver and is broadcast.

    Where two documents meet, no pair is made that an upper bound of its similarity rules out: by sizes, by the places of
    the shingle in both, and by bitmaps (each shingle flips one of BITMAP * 64 bits, so that the sets differ in at least as
    many shingles as the bitmaps do in bits)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for s, e in slices(b.column(2).value_lengths().to_numpy(zero_copy_only=False), SLICE_WORDS):
                doc, shingle, weight = shingles(*offsets(b.column(2).slice(s, e - s)))
                yield b.slice(s, e - s), doc, shingle, weight, (mix(shingle) >> U64(64 - COUNTERS)).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for *_, at in parts(batches):
            total += np.bincount(at, minlength=1 << COUNTERS)
        blocks = total.astype("<i8").reshape(-1, COUNTER_BLOCK)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in used], pa.binary())], ["block", "counts"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in table.column("counts").to_pylist())
        return pa.table({"block": [key[0].as_py()], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)]})

    words = stored(rest.hint("merge").join(texts, rest["doc"] == F.col("_id")).select("doc", "class", word_hashes(F.col("_text")).alias("words")), "rest")
    sums = mapped(words, counted, "block long, counts binary").groupBy("block").applyInArrow(summed, "block long, counts binary").collect()
    counts = np.zeros(((1 << COUNTERS) // COUNTER_BLOCK, COUNTER_BLOCK), np.uint32)
    for r in sums:
        counts[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), "<u4")
    shared = words.sparkSession.sparkContext.broadcast(counts.reshape(-1))
    marks = [f"m{k}" for k in range(BITMAP)]
    names = ["doc", "class", "n", "at", "before", "repeats", *marks]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, doc, shingle, weight, at in parts(batches):
            n = b.num_rows
            bits = np.bincount(doc * (64 * BITMAP) + (mix(shingle + U64(1)) % U64(64 * BITMAP)).astype(np.int64), minlength=n * 64 * BITMAP) & 1
            bitmap = np.packbits(bits.astype(np.uint8).reshape(n, -1), axis=1).view("<i8").reshape(n, BITMAP)
            order = np.lexsort((shingle, shared.value[at], doc))
            weight = sublinear(weight)[order]
            number, total = np.bincount(doc, minlength=n), np.bincount(doc, weight, n)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + 1
            before = np.maximum(0, np.cumsum(weight) - weight - np.repeat(np.cumsum(total) - total, number)) / total[doc]
            inside = (place <= (number - np.ceil(number * threshold - 1e-9) + 1)[doc]) | (1 - before >= threshold - 1e-6)
            known = inside & (shared.value[at[order]] > 1)
            of = doc[known]
            columns = [number[of], place[known], before[known], (total > number + 1e-6)[of], *(bitmap[of, k] for k in range(BITMAP)), shingle[order][known].view(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), *map(pa.array, columns)], [*names, "h"])

    first = cut(mapped(words, prefixes, f"doc long, class long, n long, at long, before double, repeats boolean, {', '.join(f'{m} long' for m in marks)}, h long"))
    # Documents of one class need no comparison: of each shingle's documents, those outside its largest class meet all
    # others, so that what is compared is at most twice what lies across classes.
    largest = first.groupBy("h", "class").agg(F.count("*").alias("_n")).groupBy("h").agg(F.max_by("class", "_n").alias("main"), F.count("*").alias("_classes")).where("_classes > 1").drop("_classes")
    known = cut(first.join(largest.hint("merge"), "h"))
    x = known.where("class <> main").select("h", *[F.col(c).alias(f"x_{c}") for c in names])
    y = known.select("h", "main", *[F.col(c).alias(f"y_{c}") for c in names])
    less, more = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    overlap = (less + more) * F.lit(threshold / (1 + threshold)) - 1e-9
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in marks])
    once = (F.col("x_class") != F.col("y_class")) & ((F.col("y_class") == F.col("main")) | (F.col("x_doc") < F.col("y_doc")))
    sets = (less >= more * F.lit(threshold) - 1e-9) & (F.least("x_at", "y_at") + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= overlap) & ((less + more - differ) / 2 >= overlap)
    # Where neither has repeats, both forms of the index are the same, and the bounds by sets are the tighter ones.
    weights = (F.col("x_repeats") | F.col("y_repeats")) & (F.least("x_before", "y_before") + F.least(1 - F.col("x_before"), 1 - F.col("y_before")) >= threshold - 1e-6)
    return cut(x.join(y, "h").where(once & (sets | weights)).select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct())


def key_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_duplicates of docs in which no two different texts have one doc_id."""
    sketch = stored(sketches(docs, bands, rows), "sketches")
    # Of the representatives' bands, those that more than one of them has count.
    one = stored(sketch.groupBy("copy_a", "copy_b").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands")), "representatives")
    keyed = one.where("doc IS NOT NULL").select("doc", F.posexplode("bands").alias("_at", "key")).where("key IS NOT NULL")
    keyed = keyed.select("doc", (F.col("_at") % bands).alias("band"), "key")
    several = cut(keyed.groupBy("band", "key").agg(F.min("doc").alias("least"), F.count("*").alias("many")).where("many > 1"))
    members = stored(keyed.join(several.hint("merge"), ["band", "key"]), "members")
    ids = cut(members.select(F.col("doc").alias("id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_text"))
    texts = stored(texts.join(ids.withColumnRenamed("id", "_id").hint("merge"), "_id", "left_semi"), "texts")
    heads = members.where("doc <> least").groupBy("least", "doc").agg(F.count("*").alias("n"))
    nearest = cut(heads.groupBy("doc").agg(F.max_by("least", F.struct("n", -F.col("least"))).alias("a")).select("a", F.col("doc").alias("b")))
    labels = cut(ids.join(components(verified(nearest, texts, threshold)), "id", "left").select("id", F.coalesce("class", "id").alias("class")))
    # What buckets then still hold in several classes is joined exactly, by prefixes of its rarest shingles.
    rest = unresolved(members, labels)
    if not rest.isEmpty():
        labels = contracted(labels, cut(verified(sharing_prefixes(rest, texts, threshold), texts, threshold)))
    of_copy = one.select("copy_a", "copy_b", F.col("doc").alias("id")).join(labels, "id", "left").select("copy_a", "copy_b", F.coalesce("class", "id").alias("class_id"))
    return sketch.select("doc_id", "copy_a", "copy_b").join(of_copy, ["copy_a", "copy_b"]).select("doc_id", "class_id")


def told_apart(docs: DataFrame, into: str) -> tuple[DataFrame, bool]:
    """docs with a key that tells different texts apart and puts them in order of doc_id (null where that is): doc_id itself,
    or where rows share ids (True) the row's place among all by id and text."""
    doc_id = F.col("doc_id").cast("long")
    shared = docs.where(doc_id.isNotNull()).groupBy(doc_id.alias("_id")).count().where("count > 1")
    if shared.isEmpty():
        return docs.withColumn(into, doc_id), False
    placed = ranked(docs, [doc_id.asc_nulls_last(), F.col("text")], into)
    return placed.withColumn(into, F.when(F.col("doc_id").isNotNull(), F.col(into))), True


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of every row of docs. Rows without a doc_id belong to the class
    of their exact copies with one (none: null), and link no others."""
    key = unused("_key", docs.columns)
    table, placed = told_apart(docs.select("doc_id", "text"), key)
    found = key_classes(table.select(F.col(key).alias("doc_id"), "text"), threshold, bands, rows)
    if not placed:
        return found
    of = table.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("doc_id").cast("long").alias("_id"))
    found = found.join(of.hint("merge"), F.col("doc_id") == F.col("_key"), "left").select(F.col("_id").alias("doc_id"), "class_id")
    return found.join(of.hint("merge"), F.col("class_id") == F.col("_key"), "left").select("doc_id", F.col("_id").alias("class_id"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without near-duplicates: the row of least doc_id of each class stays (of rows with one id and nearly equal texts
    that of least text), and all rows without a doc_id."""
    key = unused("_key", docs.columns)
    table, _ = told_apart(docs, key)
    found = key_classes(table.select(F.col(key).alias("doc_id"), "text"), threshold, bands, rows)
    first = found.where("doc_id = class_id").select(F.col("doc_id").alias("_first")).distinct()
    kept = table.join(first, F.col(key) == F.col("_first"), "left_semi")
    return kept.unionByName(table.where(F.col(key).isNull())).select(*docs.columns)
