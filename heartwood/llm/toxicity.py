"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms (runs of letters and digits, lower case, and their first four letters, by which a
family of words is known from a few of its members), hashed to 2**bits buckets. The score is
the logistic of w0 + sum w_i + sum_{i<j} <v_i, v_j>: the pairwise part learns that two terms together mean more, or
less, than each alone. The machine is fitted with AdaGrad on a bounded sample of labelled rows (`max_rows`, those of
least hash of doc_id: the bound holds at every size of the corpus); only terms that at least `min_docs` of these rows hold, and
whose shares of the two classes differ clearly, alone or in pairs, get weights, so that what a document was not learnt on adds
nothing. Every text is scored whole.

Null texts count as empty; an empty text scores by w0 alone. With no labelled rows, or labels of one class only, every
score is the smoothed rate of the labels there are (0 for none). Repeated rows and ties score alike; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, text_or_empty, unused

MAX_ROWS = 16_000
BITS = 20
STEM = 4


@dataclass
class Machine:
    """terms: sorted buckets with weights; w: their weights; v: their factors (rows)."""

    bias: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def margins(self, ends: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """One margin per document; ends: where each one's distinct terms end in `terms`."""
        n = len(ends)
        if not len(self.terms) or not len(terms):
            return np.full(n, self.bias)
        doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        doc, at = doc[known], at[known]
        total = self.bias + np.bincount(doc, self.w[at], n)
        for k in range(self.v.shape[1]):
            x = self.v[at, k]
            total += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return total


#: How much likelier than by chance (in nats) a pair of terms must tell the classes apart. There may be some 10**9 pairs to try.
PAIR_EVIDENCE = 18.0


def evidence(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The logarithm of the likelihood ratio of tables ((a, b), (c, d)) of counts to independent rows and columns."""
    total = a + b + c + d
    part = lambda n, row, column: np.where(n > 0, n * np.log(np.maximum(n, 1) * total / np.maximum(row * column, 1)), 0)
    return part(a, a + b, a + c) + part(b, a + b, b + d) + part(c, c + d, a + c) + part(d, c + d, b + d)


def apart(docs: list[np.ndarray], similarity: float = 0.5, bands: int = 40, rows: int = 4, seed: int = 11) -> np.ndarray:
    """Rows but those that hold nearly the terms of one before: copies of a text share whatever terms they have, and are no
    evidence for any of these. A row is compared with the last one before that agrees with it in a band of minimal hashes."""
    rng = np.random.default_rng(seed)
    factor, shift = (rng.integers(1, 1 << 62, bands * rows).astype(np.uint64) for _ in range(2))
    keys = np.zeros((len(docs), bands), np.uint64)
    for i, d in enumerate(docs):
        if len(d):
            least = ((d.astype(np.uint64)[:, None] * (factor | np.uint64(1)) + shift) >> np.uint64(20)).min(0).reshape(bands, rows)
            for k in range(rows):
                keys[i] = keys[i] * np.uint64(0x9E3779B97F4A7C15) + least[:, k]
    before = np.full(keys.shape, -1, np.int32)
    for k in range(bands):
        order = np.argsort(keys[:, k], kind="stable")
        same = np.flatnonzero(keys[order[1:], k] == keys[order[:-1], k])
        before[order[same + 1], k] = order[same]
    kept = []
    for i, d in enumerate(docs):
        common = ((len(np.intersect1d(d, docs[j], assume_unique=True)), j) for j in set(before[i].tolist()) - {-1})
        if not any(c >= similarity * (len(d) + len(docs[j]) - c) for c, j in common):
            kept.append(i)
    return np.array(kept, np.int64)


def telling_pairs(docs: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, min_docs: int) -> np.ndarray:
    """Which terms matter in pairs: among the rows that hold the one, the classes differ by the other, and the other way round
    (a term that tells the classes apart alone does so beside any other, and makes no pair with it). Every pair that min_docs
    rows hold is tried; how much it tells is judged alike for all numbers of rows."""
    out = np.zeros(len(terms), bool)
    single = apart(docs)
    docs, labels = [docs[i] for i in single], labels[single]
    n, n1 = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for d, label in zip(docs, labels):  # row by row: nothing here grows with all rows' terms but what is held of those tried
        at = np.searchsorted(terms, d)
        n[at] += 1
        n1[at] += label == 1
    # No other term can tell more about a term's rows than what there is to tell: their number times the entropy of their labels.
    with np.errstate(divide="ignore", invalid="ignore"):
        untold = -np.where(n1 > 0, n1 * np.log(n1 / n), 0) - np.where(n > n1, (n - n1) * np.log((n - n1) / n), 0)
    tried = np.flatnonzero((n >= min_docs) & (untold >= PAIR_EVIDENCE))
    if not len(tried):
        return out
    rows, chosen = [], terms[tried]
    for d in docs:
        at = np.minimum(np.searchsorted(chosen, d), len(tried) - 1)
        rows.append(at[chosen[at] == d].astype(np.int32))
    n1, n0 = n1[tried], n[tried] - n1[tried]
    first = np.append(0, np.cumsum(n[tried]))  # the rows of each term
    held = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[np.argsort(np.concatenate(rows), kind="stable")]
    for a in range(len(tried)):
        of = held[first[a] : first[a + 1]]
        k1, k0 = (np.bincount(np.concatenate([rows[r] for r in of[labels[of] == kind]]), minlength=len(tried)) for kind in (1, 0))
        b = np.flatnonzero(k1 + k0 >= min_docs)
        b = b[b > a]
        x, y = k1[b], k0[b]
        sure = (evidence(x, n1[a] - x, y, n0[a] - y) >= PAIR_EVIDENCE) & (evidence(x, n1[b] - x, y, n0[b] - y) >= PAIR_EVIDENCE)
        if sure.any():
            out[tried[b[sure]]] = out[tried[a]] = True
    return out


def fit(docs: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 24, batch: int = 128, rate: float = 0.1, decay: float = 1e-3, min_docs: int = 3, min_z: float = 3.5, balance: float = 0.5, seed: int = 7) -> Machine:
    """A machine from the distinct term buckets of documents and their labels (0 or 1). balance: 0 weighs all rows alike, 1 gives
    both classes the same weight. A term is kept if min_docs rows hold it and its shares of the two classes differ by min_z
    standard errors, or it matters in pairs: with more terms than rows, the rest would only be learnt by heart. Nothing here
    depends on how many rows there are."""
    base = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 1e-9
    bias = float(np.log(base / (1 - base)))
    none = Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    if len(set(labels.tolist())) < 2:
        return none
    flat, toxic = np.concatenate(docs), np.repeat(labels == 1, [len(d) for d in docs])
    terms, count = np.unique(flat, return_counts=True)
    in_toxic, times = np.unique(flat[toxic], return_counts=True)
    hits = np.zeros(len(terms))
    hits[np.searchsorted(terms, in_toxic)] = times
    del flat, toxic
    share, n, n1 = count / len(docs), len(docs), labels.sum()
    z = np.abs(hits / n1 - (count - hits) / (n - n1)) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1)) + 1e-12)
    telling = (z >= min_z) | telling_pairs(docs, labels, terms, min_docs)
    terms = terms[(count >= min_docs) & telling].astype(np.int64)
    if not len(terms):
        return none
    kept = []
    for d in docs:
        at = np.minimum(np.searchsorted(terms, d), len(terms) - 1)
        kept.append(at[terms[at] == d])
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), factors))
    gw, gv = np.full(len(terms), 1e-2), np.full((len(terms), factors), 1e-2)
    weight = np.where(labels == 1, 0.5 / base, 0.5 / (1 - base)) ** balance
    for _ in range(epochs):
        order = rng.permutation(len(kept))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            flat = np.concatenate([kept[r] for r in rows])
            doc = np.repeat(np.arange(len(rows)), [len(kept[r]) for r in rows])
            used, local = np.unique(flat, return_inverse=True)
            vx = v[flat]
            sums = np.stack([np.bincount(doc, vx[:, k], len(rows)) for k in range(factors)], 1)
            square = np.stack([np.bincount(doc, vx[:, k] ** 2, len(rows)) for k in range(factors)], 1)
            margin = bias + np.bincount(doc, w[flat], len(rows)) + 0.5 * (sums**2 - square).sum(1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) * weight[rows]
            e = error[doc]
            step_w = np.bincount(local, e, len(used)) + decay * len(rows) * w[used]
            grad_v = e[:, None] * (sums[doc] - vx)
            step_v = np.stack([np.bincount(local, grad_v[:, k], len(used)) for k in range(factors)], 1) + decay * len(rows) * v[used]
            gw[used] += step_w**2
            gv[used] += step_v**2
            w[used] -= rate * step_w / np.sqrt(gw[used])
            v[used] -= 0.5 * rate * step_v / np.sqrt(gv[used])
            bias -= rate * error.mean()
    return Machine(bias, terms, w, v)


def terms_of(text: Column, bits: int = BITS) -> Column:
    """Distinct term buckets of a text."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    bucket = lambda *x: F.shiftrightunsigned(F.xxhash64(*x), 64 - bits).cast("int")
    stems = F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))
    return F.array_distinct(F.concat(F.transform(words, lambda w: bucket(w)), F.transform(stems, lambda w: bucket(w, F.lit("stem")))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS, **options) -> Machine:
    """Fit on at most max_rows labelled rows of docs whose crc32(doc_id) mod 5 is not 0. Only their term buckets reach
    the driver: max_rows is the bound on what does, as rows that repeat a doc_id are one row with the terms of all."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == sample["_id"]).select(sample["_id"], "_label", terms_of(text_or_empty(docs["text"]), bits).alias("_terms"))
    rows = rows.groupBy("_id", "_label").agg(F.array_distinct(F.flatten(F.collect_set("_terms"))).alias("_terms")).select("_label", "_terms").toArrow()
    lists = rows.column("_terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not rows.num_rows:
        return fit([], np.zeros(0))
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    found = [np.sort(x) for x in np.split(flat, (ends - ends[0])[1:-1])]
    y = rows.column("_label").to_numpy()
    del rows, lists, flat
    order = np.lexsort([[int(len(x)) for x in found], [int(x.astype(np.int64).sum()) for x in found], y])  # whatever order rows came in
    return fit([found[i] for i in order], y[order].astype(float), **options)


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score(df: DataFrame, machine: Machine, text: str = "text", into: str = "score", bits: int = BITS) -> DataFrame:
    """df with the probability that each text is toxic. The machine's size is bounded by 2**bits terms."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    hidden = unused("_terms_of_text", [*df.columns, into])
    schema = T.StructType([f for f in df.schema.fields if f.name != into] + [T.StructField(into, T.DoubleType())])
    names = schema.fieldNames()[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index(hidden))
            ends = lists.offsets.to_numpy()
            m = shared.value.margins((ends - ends[0])[1:], lists.flatten().to_numpy(zero_copy_only=False))
            columns = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30))))], schema=pa.schema([*(b.schema.field(n) for n in names), pa.field(into, pa.float64())]))

    return mapped(df.withColumn(hidden, terms_of(text_or_empty(text), bits)).drop(into), run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    machine = train(docs, labels, max_rows=max_rows)
    scored = score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def auc(labels: np.ndarray, scores: np.ndarray) -> float:
    """Area under the curve of labels by scores, with ties shared."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    s = scores[order]
    first = np.searchsorted(s, s, "left")
    last = np.searchsorted(s, s, "right")
    ranks[order] = (first + last + 1) / 2
    pos = labels == 1
    return float((ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum()))
