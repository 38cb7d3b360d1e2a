"""Importance resampling and spelling variants against plain versions of their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heartwood.llm import importance, queries, variants

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def plain_resampling(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    found = [(k, *plain_features(t)) for k, t in docs]
    s = Counter(bucket(f) for _, fs, _ in found for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x)[0])
    total, of = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (of + 10000)))) for b in range(10000)]
    rows = []
    for k, fs, n in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(drawn[: 5 * len(drawn) // 100]):
        r[4] = place + 1
    return rows


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_op12(spark, where):
    sf_dir = f"/root/testdata/{where}"
    docs, target = pd.read_parquet(f"{sf_dir}/documents.parquet"), pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    want = plain_resampling(list(zip(docs["doc_id"].tolist(), docs["text"])), target["text"].tolist())
    got = queries.op12_importance_resampling(spark, sf_dir).select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()
    assert sorted_rows(got) == sorted_rows(want)
    assert sum(r["rank"] is not None for r in got) > 0


def test_crcs_of_any_words():
    rng = np.random.default_rng(3)
    pieces = ["a", "Z9", "é", "中文", "x" * 63, "y" * 64, "z" * 65, "w" * 5000, " ", "  ", ".", "\x00", "\n", "_", "'", "0"]
    texts = ["", " ", "A", *("".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(300)), "", "b" * (3 << 20), "c d", ""]
    import pyarrow as pa

    got: dict = {}
    for s, _, of, crc, words in importance.batch_features(pa.array(texts)):
        for i, c in zip(of.tolist(), crc.tolist()):
            got.setdefault(s + i, []).append(c)
        for i, n in enumerate(words.tolist()):
            assert n == plain_features(texts[s + i])[1]
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(zlib.crc32(f.encode()) for f in plain_features(text)[0])


def test_ranks_with_ties_nulls_and_repeats(spark):
    words = " ".join(f"w{i}" for i in range(25))
    rows = [(7, words), (7, words), (None, words), (1, "short"), (2, None), (3, "")] + [(100 + i, words + " " + "xyz"[i % 3]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "rank", "_at", "n_words", "weight")})
    target = spark.createDataFrame([("w1 w2 w3 x",), (None,)], "text string")
    got = importance.resampled(docs.repartition(5), target).collect()
    want = plain_resampling(rows, ["w1 w2 w3 x", None])
    assert sorted_rows(tuple(r) for r in got) == sorted_rows(want)
    assert importance.selected(docs, target).columns == docs.columns
    assert importance.selected(docs, target).count() == sum(r[4] is not None for r in want)
    assert importance.resampled(docs.where("false"), target).count() == 0
    assert importance.resampled(docs, target.where("false")).count() == len(rows)


# ---- spelling variants


def plain_variants(docs):
    counts = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    # Two words are near if they are equal without one code point at one place, or one is the other without one.
    near = {w: set() for w in counts}
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
            if (less := w[:i] + w[i + 1 :]) in counts:
                near[w].add(less), near[less].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    out = []
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return sorted(out)


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_op13(spark, where):
    sf_dir = f"/root/testdata/{where}"
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_spelling_variants(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(list(zip(docs["doc_id"].tolist(), docs["text"])))
    assert any(r[1] for r in got)


def test_neighbourhoods_are_whole_and_distinct():
    for word, alphabet in [("aab", "abc"), ("é", "aé"), ("aaaa", "a"), ("abcabca", "abc"), ("x" * 40, "xy")]:
        codes = variants.code_points([word])
        letters = np.array(sorted(map(ord, alphabet)), np.uint64)
        seen, hashed = [], []
        for _, place, kind, letter in variants.neighbours(codes, letters, lambda h: (hashed.extend(h.ravel().tolist()), np.ones(h.shape, bool))[1]):
            seen += [word[:p] + chr(c) * (k > 0) + word[p + (k < 2) :] for p, k, c in zip(place.tolist(), kind.tolist(), letter.tolist())]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + d :] for d in (0, 1) for i in range(len(word) + 1 - d) for c in alphabet}
        assert len(seen) == len(set(seen)) and set(seen) == want - {word}
        assert {int(variants.hashes(variants.code_points([w]))[0]) for w in want if w} <= set(hashed)


def test_variants_with_chains_nulls_and_long_words(spark):
    long = "ab" * 3000
    rows = [(1, "wordone " * 4000), (2, "wordonf " * 300), (3, "wordogf " * 25), (4, "worogf " * 2 + "worrogf " * 2), (None, None), (None, "wordone ÀÉÎõü÷× ÀÉÎõü÷×"), (5, ""), (6, f"{long} {long}"), (7, f"{long}x {long}x {long}x"), (7, f"{long}x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "_run", "_doc", "near")})
    want = plain_variants(rows)
    for bits in (variants.FILTER_BITS, 3):  # the second lets nearly everything pass to the join
        assert sorted(tuple(r) for r in variants.variants(docs, bits=bits).select("word", "form", "root", "n", "n_near", "form_n").collect()) == want
    assert variants.variants(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op12_importance_resampling", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    from compare import expected, got

    assert got(queries.queries()[name](spark, sf_dir)) == expected(queries.oracle_sql()[name], sf_dir)
