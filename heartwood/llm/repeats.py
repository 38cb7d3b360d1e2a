"""Long repeats of a corpus by a run-length index, and texts without them.

Every byte that lies in a string of LENGTH bytes which starts earlier too (in a document of smaller id, or in the same one
further to the front) is removed. Strings are judged on the input, so that of each passage the first copy stays whole.

A corpus is no single text that one index could hold, so windows of LENGTH bytes are first brought together. Each has an
anchor: the least by hash of its substrings of ANCHOR bytes. Equal windows have equal anchors. A run of windows with one
anchor is a context, known by two hashes; there is one for some 30 bytes of text.

1. Contexts meet by anchor. Of equal contexts the first counts, and all others are repeats as a whole. An anchor that has one
   context only is done: no two windows of it are equal.
2. What is left are the first ones of different contexts with one anchor, mostly where copies begin, end or were edited. Their
   bytes are cut out of the texts and dealt into buckets by anchor. A bucket is a very repetitive text: its Burrows-Wheeler
   transform has few runs. The suffix array is kept at the ends of runs alone, with the length of the common prefix there;
   from these samples the positions of the bucket are streamed, each with the suffix that precedes it in order and the length
   of the match (both change by one from position to position in between samples). Matches of LENGTH or more chain equal
   windows together, and all but the first of a chain are repeats.
3. An anchor of more than GROUP different contexts, such as the border of a passage that very many documents quote, would
   not fit into a bucket. Its windows are hashed one by one (128 bits) and meet by hash, with an aggregation before the
   exchange; so does what meets by anchors that a sample of documents shows to be frequent, which are dealt out by context.

Runs of repeats then come back to their texts, which are cut. A task hands on one of equal contexts for each FLUSH of its
contexts, so that what is copied very often doesn't meet in one task row by row.

Null texts count as empty. Texts shorter than LENGTH bytes have no windows and stay whole. Rows that share an id, or have
none, are put in order by their texts (without an id last; equal rows in any order) and are documents of their own: of repeated
rows the first stays. Texts are valid UTF-8, as Spark's strings are; cuts are made at bytes, so that what is left need not be.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, ranked, stored, text_or_empty

LENGTH, ANCHOR = 100, 32
#: Different contexts of one anchor that a bucket takes, and bytes that a bucket holds on average.
GROUP, BUCKET_BYTES = 2048, 1 << 20
#: Bytes of text that are worked on at once, and contexts among which a task looks for equal ones.
SLICE_BYTES, FLUSH = 1 << 19, 1_000_000
#: One document in SAMPLED shows which anchors are frequent: those with that many contexts there, at most one in HOT_SHARE.
SAMPLED, HOT_LEAST, HOT_SHARE, SALTS = 256, 32, 2000, 256

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A good hash of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial hashes of substrings of some bytes, from sums over prefixes."""

    def __init__(self, seed: int) -> None:
        self.base = int(mix(np.array([seed], U64))[0]) | 1
        self.value = mix(np.arange(256, dtype=U64) + U64(seed << 9))
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                out = np.full(n, base, U64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        return np.append(U64(0), np.cumsum(self.value[data] * self.up[: len(data)], dtype=U64))

    def of(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[: len(sums)][start])


FIRST, SECOND = Rolling(1), Rolling(2)


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes where the least is, the leftmost one of equals."""
    bits = max(1, int(len(h)).bit_length())
    low = (1 << bits) - 1
    least = (h & U64((1 << 64) - 1 - low)) | np.arange(len(h), dtype=U64)
    n = 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < width:
        least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
    return (least & U64(low)).astype(np.int64)


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, context) of each context of texts that lie one after another in data: its first
    window starts at that byte of the text, and the two hashes."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    sums = FIRST.sums(data)
    h = FIRST.of(sums, slice(0, len(data) - ANCHOR + 1), slice(ANCHOR, len(data) + 1))
    anchor = least_in_windows(h, LENGTH - ANCHOR + 1)
    last = np.zeros(len(data) + 1, np.int64)
    long = ends - starts >= LENGTH
    # Windows that lie within one text.
    np.add.at(last, starts[long], 1)
    np.add.at(last, ends[long] - LENGTH + 1, -1)
    inside = np.flatnonzero(np.cumsum(last)[: len(anchor)] > 0)
    if not len(inside):
        return contexts(data[:0], starts, ends)
    at = anchor[inside]
    new = np.append(True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1))
    text = np.searchsorted(starts, inside, "right") - 1
    new[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(new)
    s, n = inside[first], np.diff(np.append(first, len(inside)))
    e = s + n - 1 + LENGTH
    context = mix(SECOND.of(SECOND.sums(data), s, e) + n.astype(U64))
    return text[first], s - starts[text[first]], n, h[at[first]], context


def pieces(texts: pa.Array, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, keys, offset of each in its text) of a batch's texts, by slices; a long text comes in pieces
    that overlap so far that each of its windows lies in just one."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    zero = np.zeros(1, np.int64)
    s = 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(at, at[s] + SLICE_BYTES, "right")) - 1)
        if e == s + 1 and at[e] - at[s] > SLICE_BYTES:
            for b in range(int(at[s]), int(at[e]) - LENGTH + 1, SLICE_BYTES):
                part = data[b : min(b + SLICE_BYTES + LENGTH - 1, at[e])]
                yield part, zero, zero + len(part), keys[s:e], zero + (b - at[s])
        else:
            offsets = at[s : e + 1] - at[s]
            yield data[at[s] : at[e]], offsets[:-1], offsets[1:], keys[s:e], np.zeros(e - s, np.int64)
        s = e


CONTEXTS = "anchor long, context long, doc long, at long, windows long, known boolean"


def found_contexts(texts: DataFrame) -> DataFrame:
    """The contexts of texts (doc, text). Of equal ones that a task comes upon, those that aren't the first are known to be
    repeats; they come as runs of windows, under anchors of their own."""

    def flushed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, at, n, anchor, context = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, doc, context, anchor))
        same = np.append(False, (anchor[order][1:] == anchor[order][:-1]) & (context[order][1:] == context[order][:-1]))
        known = np.zeros(len(doc), bool)
        known[order[same]] = True
        d, a, m = doc[known], at[known], n[known]
        order = np.lexsort((a, d))
        d, a, m = d[order], a[order], m[order]
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1] + m[:-1]))[: len(d)])
        m = np.add.reduceat(m, first) if len(first) else m
        d, a = d[first], a[first]
        own = mix(mix(d.astype(U64)) + a.astype(U64))
        new = ~known
        columns = [np.append(anchor[new], own).view(np.int64), np.append(context[new], own).view(np.int64), np.append(doc[new], d), np.append(at[new], a), np.append(n[new], m), np.append(np.zeros(new.sum(), bool), np.ones(len(d), bool))]
        for k in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in columns], ["anchor", "context", "doc", "at", "windows", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for data, starts, ends, keys, offset in pieces(b.column(1), b.column(0).to_numpy(zero_copy_only=False)):
                text, at, n, anchor, context = contexts(data, starts, ends)
                parts.append((keys[text], at + offset[text], n, anchor, context))
                held += len(text)
            if held >= FLUSH:
                yield from flushed(parts)
                parts, held = [], 0
        if held:
            yield from flushed(parts)

    return mapped(texts.select("doc", "text"), run, CONTEXTS)


def frequent_anchors(texts: DataFrame) -> list[int]:
    """Anchors with many different contexts in a sample of the documents; at most HOT_SHARE. Results don't depend on them."""
    sample = found_contexts(texts.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0)).where("NOT known")
    counted = stored(sample.groupBy("anchor").agg(F.count("*").alias("n")), "frequent")
    least = max(HOT_LEAST, (counted.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    return [r[0] for r in counted.where(F.col("n") >= least).select("anchor").collect()]


RUN, INDEXED, HASHED = 0, 1, 2


def judged(found: DataFrame, frequent: list[int], group: int = GROUP) -> DataFrame:
    """doc, at, windows, anchor and kind of the contexts that are repeats as a whole (RUN), or that must be compared by their
    bytes, in an index or by hashes. All of an anchor's contexts meet, but those of frequent anchors, where equal ones do."""
    salt = F.when(F.col("anchor").isin(frequent), 1 + F.pmod("context", F.lit(SALTS))).otherwise(0) if frequent else F.lit(0)
    dealt = found.withColumn("salt", salt.cast("long")).repartition("anchor", "salt")
    of_context = Window.partitionBy("anchor", "salt", "context").orderBy("doc", "at")
    dealt = dealt.withColumn("first", F.row_number().over(of_context) == 1)
    dealt = dealt.withColumn("different", F.sum(F.col("first").cast("int")).over(Window.partitionBy("anchor", "salt")))
    hashed = (F.col("different") > group) | (F.col("salt") > 0)
    kind = F.when(F.col("known") | ~F.col("first"), RUN).when(hashed, HASHED).when(F.col("different") > 1, INDEXED)
    return dealt.select("doc", "at", "windows", "anchor", kind.alias("kind")).where("kind IS NOT NULL")


def cut_contexts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """asked (doc, at, windows, anchor, kind) with the contexts' bytes."""
    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "windows", "kind")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(2)
            of = np.repeat(np.arange(b.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            anchor, at, windows, kind = (asked.flatten().field(k) for k in range(4))
            texts = b.column(1).cast(pa.binary())
            place, size = at.to_numpy(zero_copy_only=False), windows.to_numpy(zero_copy_only=False) + LENGTH - 1
            whole, last = b"", -1
            cut = []
            for i, s, n in zip(of.tolist(), place.tolist(), size.tolist()):
                if i != last:
                    whole, last = texts[i].as_py(), i
                cut.append(whole[s : s + n])
            doc = b.column(0).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([doc, at, anchor, kind, pa.array(cut, pa.binary())], ["doc", "at", "anchor", "kind", "bytes"])

    both = texts.join(by_doc.hint("merge"), "doc").select("doc", "text", "asked")
    return mapped(both, run, "doc long, at long, anchor long, kind int, bytes binary")


# ---- the index of a bucket


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number (zeros beyond the end)."""
    padded = np.append(text, np.zeros(8, np.uint8)).astype(U64)
    out = np.zeros(len(text), U64)
    for k in range(8):
        out |= padded[k : k + len(text)] << U64(56 - 8 * k)
    return out


def suffix_array(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length by which they are sorted; what is told apart isn't sorted again."""
    n = len(text)
    order = np.argsort(words, kind="stable")
    new = np.append(True, words[order][1:] != words[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rows, h = np.flatnonzero(~(new & np.append(new[1:], True))), 8
    while len(rows):
        at = order[rows]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[rows] = at
        new = np.append(True, key[1:] != key[:-1])
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rows = rows[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class RunLengthIndex:
    """The runs of a text's Burrows-Wheeler transform, and the suffix array sampled at their ends.

    symbols, sizes: the runs. at: positions of the suffixes in the first rows of runs, sorted; before: the suffix in the row
    above each (the last of the run above; -1 for the first row); match: the length of their common prefix."""

    def __init__(self, text: np.ndarray) -> None:
        words = words_at(text)
        order = suffix_array(text, words)
        last = np.where(order > 0, text[order - 1].astype(np.int16), 256)
        first = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        self.symbols, self.sizes = last[first], np.diff(np.append(first, len(text)))
        at, before = order[first], np.where(first > 0, order[first - 1], -1)
        match = common_prefixes(words, at, before)
        by = np.argsort(at)
        self.at, self.before, self.match = at[by], before[by], match[by]

    def statistics(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the suffix that precedes its own in order, and the length of the match. A suffix whose row isn't
        the first of a run moves on with the one before it: both are preceded by equal symbols."""
        i = np.searchsorted(self.at, positions, "right") - 1
        on = positions - self.at[i]
        return self.before[i] + on, self.match[i] - on


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    on = np.flatnonzero(b >= 0)
    end = len(words)
    while len(on):
        x, y = a[on] + out[on], b[on] + out[on]
        inside = np.maximum(x, y) < end
        on, x, y = on[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        equal = differ == 0
        # Bytes before the first difference, by the highest byte that isn't zero.
        lead = np.zeros(len(on), np.int64)
        rest = differ.copy()
        for k in range(7):
            lead += (rest >> U64(56 - 8 * k) == 0) & (lead == k)
        out[on] += np.where(equal, 8, lead)
        on = on[equal]
    return out


def repeats_among(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows) of the runs of windows of `length` bytes that start earlier too, in these texts in their order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)  # no byte of UTF-8
    begin = np.cumsum(sizes + 1) - sizes - 1
    number = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), number)
    starts = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    if not len(starts):
        return starts, starts, starts
    before, match = RunLengthIndex(joined).statistics(starts)
    linked = np.flatnonzero(match >= length)
    to = np.searchsorted(starts, before[linked])
    real = starts[np.minimum(to, len(starts) - 1)] == before[linked]
    head = np.arange(len(starts))
    head[linked[real]] = to[real]
    while True:  # heads of chains, by doubling
        next_ = head[head]
        if (next_ == head).all():
            break
        head = next_
    first = np.arange(len(starts))
    np.minimum.at(first, head, np.arange(len(starts)))
    again = np.flatnonzero(first[head] < np.arange(len(starts)))
    new = np.flatnonzero(np.append(True, starts[again][1:] != starts[again][:-1] + 1)[: len(again)])
    s = again[new]
    return text[s], starts[s] - begin[text[s]], np.diff(np.append(new, len(again)))


def indexed(cut: DataFrame, buckets: int) -> DataFrame:
    """doc, at, windows of the runs that repeat among the contexts of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        doc, at = (table.column(k).to_numpy() for k in ("doc", "at"))
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        text, start, windows = repeats_among(table.column("bytes").take(pa.array(order)).to_pylist())
        return pa.table({"doc": pa.array(doc[text], pa.int64()), "at": pa.array(at[text] + start, pa.int64()), "windows": pa.array(windows, pa.int64())})

    dealt = cut.select("doc", "at", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(run, "doc long, at long, windows long")


def hashed_windows(cut: DataFrame) -> DataFrame:
    """doc, at, windows (1) of the windows that start earlier too, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = b.column(2)
            sizes = np.array([len(t) for t in texts.to_pylist()], np.int64)
            data, begin = np.frombuffer(b"".join(texts.to_pylist()), np.uint8), np.cumsum(sizes) - sizes
            step = max(1, SLICE_BYTES // max(1, int(sizes.max(initial=1))))
            for k in range(0, b.num_rows, step):
                part = slice(k, min(k + step, b.num_rows))
                own = data[begin[part.start] : begin[part.stop - 1] + sizes[part.stop - 1]]
                number = sizes[part] - LENGTH + 1
                of = np.repeat(np.arange(part.stop - part.start), number)
                place = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
                s = (begin[part] - begin[part.start])[of] + place
                hashes = [h.of(h.sums(own), s, s + LENGTH).view(np.int64) for h in (FIRST, SECOND)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(doc[part][of]), pa.array(at[part][of] + place)], ["a", "b", "doc", "at"])

    windows = mapped(cut.select("doc", "at", "bytes"), run, "a long, b long, doc long, at long")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    again = windows.join(first.hint("merge"), ["a", "b"]).where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    return again.select("doc", "at", F.lit(1).cast("long").alias("windows"))


# ---- whole texts


def keyed(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text: doc puts rows in order. It is the id, or where ids don't tell rows apart the row's place."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    unclear = table.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if unclear.isEmpty():
        return table.withColumn("doc", F.col("doc_id"))
    return ranked(table, [F.col("doc_id").asc_nulls_last(), "text"], "doc")


def repeated_runs(texts: DataFrame) -> DataFrame:
    """doc, at, windows: runs of windows that start earlier too, of texts (doc, text)."""
    verdicts = stored(judged(found_contexts(texts), frequent_anchors(texts)), "verdicts")
    sizes = {r["kind"]: r["bytes"] for r in verdicts.where(F.col("kind") != RUN).groupBy("kind").agg(F.sum(F.col("windows") + LENGTH - 1).alias("bytes")).collect()}
    runs = verdicts.where(F.col("kind") == RUN).select("doc", "at", "windows")
    if sizes:
        cut = stored(cut_contexts(verdicts.where(F.col("kind") != RUN), texts), "contexts")
        if INDEXED in sizes:
            runs = runs.unionByName(indexed(cut.where(F.col("kind") == INDEXED), max(1, sizes[INDEXED] // BUCKET_BYTES)))
        if HASHED in sizes:
            runs = runs.unionByName(hashed_windows(cut.where(F.col("kind") == HASHED)))
    return runs


def spans(at: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal half-open ranges of bytes that windows cover."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate(at[order] + windows[order] + length - 1)
    new = np.flatnonzero(np.append(True, at[1:] > end[:-1])[: len(at)])
    return list(zip(at[new].tolist(), np.append(end[new[1:] - 1], end[-1:]).tolist()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), spans (removed ranges of bytes), kept (the bytes left) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, runs = b.column(1).cast(pa.binary()), b.column(2)
            cuts, kept = [], []
            for i in range(b.num_rows):
                text = texts[i].as_py()
                own = runs[i].values if runs[i].is_valid else None
                cut = spans(own.field(0).to_numpy(), own.field(1).to_numpy()) if own is not None else []
                cuts.append([{"start": s, "end": e} for s, e in cut])
                kept.append(b"".join(text[e:s] for e, s in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(text)])) if cut else text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "text", "spans", "kept"])

    texts = keyed(docs)
    runs = repeated_runs(texts).groupBy("doc").agg(F.collect_list(F.struct("at", "windows")).alias("runs"))
    both = texts.join(runs.hint("merge"), "doc", "left").select("doc_id", "text", "runs")
    return mapped(both, run, "doc_id long, text string, spans array<struct<start: bigint, end: bigint>>, kept binary")


def repeat_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    found = without_repeats(docs)
    n_bytes: Column = F.octet_length("text").cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are cut out of pieces of 200 bytes and what follows: on long strings of digits, each cut would read the whole.
ORACLE = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, len(h) // 2 AS n, h, unnest(range(0, (len(h) // 2 - 100) // 200 + 1)) AS b FROM d WHERE len(h) >= 200),
t AS MATERIALIZED (SELECT r, b, least(200, n - 99 - 200 * b) AS m, substring(h, 400 * b + 1, 598) AS t FROM b),
i AS (SELECT r, b, t, unnest(range(0, m)) AS j FROM t),
w AS MATERIALIZED (SELECT r, 200 * b + j AS i, md5_number(substring(t, 2 * j + 1, 200)) AS w FROM i),
g AS (SELECT w, min((r, i)) AS first FROM w GROUP BY w HAVING count(*) > 1),
s AS (SELECT r, i FROM w JOIN g USING (w) WHERE (r, i) <> first),
p AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM s),
q AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM p),
span AS (SELECT r, k, min(i) AS s, max(i) + 100 AS e FROM q GROUP BY ALL),
piece AS (SELECT d.r, k, substring(h, 2 * lag(e, 1, 0) OVER (PARTITION BY d.r ORDER BY k) + 1, 2 * (s - lag(e, 1, 0) OVER (PARTITION BY d.r ORDER BY k))) AS x, s, e FROM span JOIN d USING (r)),
own AS (SELECT r, string_agg(x, '' ORDER BY k) AS x, sum(e - s) AS gone, count(*) AS n, max(e) AS last FROM piece GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN own USING (r)
"""
