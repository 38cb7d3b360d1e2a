"""Operators over whole tables against plain versions: near-duplicates, packing, token output, scores, toxicity, pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from heartwood.llm import lm, neardup, packing, queries, tokens, toxicity


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def classes(texts, threshold=0.8):
    """Least ids of components over all pairs of a dictionary of texts."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {k: find(k) for k in keys}


def grouped(found):
    """Classes as sets, whatever represents them."""
    out = {}
    for k, c in found.items():
        out.setdefault(c, set()).add(k)
    return {frozenset(x) for x in out.values()}


def test_op2_against_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = classes(dict(zip(docs["doc_id"], docs["text"])))
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_minhash_neardup(spark, sf_dir).collect()}
    assert all(got[got[k]] == got[k] <= k for k in got)
    # All pairs of the plain version are found; links by weights may join more.
    assert len({frozenset((k, c)) for k, c in want.items() if k != c and got[k] != got[c]}) <= 0.01 * sum(k != c for k, c in want.items())
    assert len(grouped(got) ^ grouped(want)) <= 0.02 * len(grouped(want))


def test_large_buckets_are_resolved(spark):
    """Near copies and texts that share a long common passage."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    texts, n = {}, 0
    for _ in range(40):
        own = common + [word() for _ in range(40)]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(own)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            texts[n], n = " ".join(copy), n + 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert grouped(got) == grouped(classes(texts))


def test_different_texts_with_one_id_are_documents(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    v, w = ([word() for _ in range(80)] for _ in range(2))
    rows = [(1, " ".join(v)), (1, " ".join(w)), (2, " ".join(w + ["x"])), (3, " ".join(w + ["y"])), (4, " ".join(v[1:])), (5, " ".join(word() for _ in range(80))), (5, None), (None, " ".join(w)), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), (r["class_id"] or 0)) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (5, 5)]
    kept = [tuple(r) for r in neardup.representatives(docs).collect()]
    assert sorted(kept, key=repr) == sorted([rows[0], rows[1], rows[5], rows[6], rows[7], rows[8]], key=repr)


def test_links_by_weights_in_large_buckets(spark):
    """200 pairs linked by weights alone among documents that all share a long repeated passage, and so large buckets."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common, texts = [word() for _ in range(100)], {}
    for i in range(200):
        own = [word() for _ in range(25)]
        for _ in range(2):
            texts[len(texts)] = " ".join(common * 60 + own * 40 + [word() for _ in range(25)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(200)] + [(2 * i + 1, 2 * i + 2) for i in range(199)], "a long, b long")
    linked = {r["a"] for r in neardup.verified(pairs, df.toDF("_id", "_text")).collect()}
    assert linked == set(range(0, 400, 2)) and not any(len(shingle_set(texts[k]) & shingle_set(texts[k + 1])) >= 0.8 * len(shingle_set(texts[k]) | shingle_set(texts[k + 1])) for k in linked)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {k: k - k % 2 for k in texts}


def test_documents_that_share_only_a_repeated_line_stay_apart(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {k: " ".join([word() for _ in range(40)] + ["same", "line"] * 300) for k in range(20)}
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: k for k in texts}


def test_links_by_sets_are_found_where_lines_repeat(spark):
    """Near copies in which a line repeats: equal by sets, far apart by weights."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for i in range(30):
        own = [word() for _ in range(200)]
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(own + own[-10:] * rng.choice([20, 40]))
        if i % 3 == 0:  # both have repeats
            texts[2 * i] = " ".join(own[:10] * 30 + own)
    want = classes(texts)
    assert sum(k != c for k, c in want.items()) == 30
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert grouped(got) == grouped(want)


def test_prefixes_cover_both_forms(spark):
    """Random documents with repeated lines: every pair linked by weights or by sets is among those that share prefixes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for _ in range(8):
        line, own = [word() for _ in range(40)], [word() for _ in range(60)]
        for _ in range(6):
            texts[len(texts)] = " ".join(line * rng.randrange(30, 60) + [word() for _ in range(12)])
            texts[len(texts)] = " ".join(own + line * rng.randrange(0, 12) + [word() for _ in range(rng.randrange(6))])
    docs = spark.createDataFrame([(k, k) for k in texts], "doc long, class long")
    rows = spark.createDataFrame(list(texts.items()), "_id long, _text string")
    got = {(r["a"], r["b"]) for r in neardup.sharing_prefixes(docs, rows, 0.8).collect()}
    every = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a long, b long")
    linked = {(r["a"], r["b"]) for r in neardup.verified(every, rows).collect()}
    sets = {k: shingle_set(t) for k, t in texts.items()}
    assert sum(len(sets[a] & sets[b]) < 0.7 * len(sets[a] | sets[b]) for a, b in linked) > 20
    assert linked <= got


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 60, 300).astype(np.uint64), rng.integers(1, 1 << 60, 100).astype(np.uint64)
    sets = [np.sort(a), np.sort(np.concatenate([a[:200], b]))]
    weights = [rng.integers(1, 4, 300), rng.integers(1, 4, 300)]
    doc, shingle, weight = np.repeat([0, 1], 300), np.concatenate(sets), np.concatenate(weights)
    kept = neardup.signatures(doc, shingle, weight, 2, 4096)
    u, v = (dict(zip(s.tolist(), w.tolist())) for s, w in zip(sets, weights))
    u, v = ({s: 1 + np.log(w) for s, w in x.items()} for x in (u, v))
    want = sum(1 / sum(max(u.get(j, 0) / u[i], v.get(j, 0) / v[i]) for j in u.keys() | v.keys()) for i in u.keys() & v.keys())
    assert abs((kept[0] == kept[1]).mean() - want) < 0.03
    one = lambda k: (np.zeros(300, np.int64), sets[k], weights[k])
    weighted, plain = neardup.similarity(one(0), one(1), 1)
    assert abs(weighted[0] - want) < 1e-9 and abs(plain[0] - 200 / 400) < 1e-9


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)], "a long, b long")
    assert {r["id"]: r["class"] for r in neardup.components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


# ---- packing


def plain_best_fit(sizes, limit):
    free = []
    for s in sorted(sizes, reverse=True):
        fitting = [i for i, f in enumerate(free) if f >= s]
        if fitting:
            free[min(fitting, key=lambda i: free[i])] -= s
        else:
            free.append(limit - s)
    return len(free)


def test_best_fit_decreasing_by_both_forms():
    rng = random.Random(2)
    for _ in range(200):
        limit = rng.choice([1, 7, 16, 100])
        sizes = [rng.randint(1, limit) for _ in range(rng.randrange(0, 80))]
        bins, offsets, n = packing.best_fit_decreasing(sizes, limit)
        assert n == plain_best_fit(sizes, limit)
        for at in range(n):
            inside = sorted((o, s) for b, o, s in zip(bins, offsets, sizes) if b == at)
            assert [o for o, _ in inside] == [sum(s for _, s in inside[:i]) for i in range(len(inside))] and sum(s for _, s in inside) <= limit
        places = packing.plan(dict(Counter(sizes)), limit)
        assert sum(p[2] for p in places) == len(sizes) and len({p[3] + k for p in places for k in range(p[2])}) == n


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    t.no_truncation(), t.no_padding()
    return t


def test_op5(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    ids = {k: [*library().encode(t or "", add_special_tokens=False).ids, 2] for k, t in zip(docs["doc_id"], docs["text"])}
    rows = queries.op5_best_fit_packing(spark, sf_dir).toPandas().sort_values(["doc_id", "piece"])
    for k, part in rows.groupby("doc_id"):
        assert part["piece"].tolist() == list(range(len(part)))
        assert part["start"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() == len(ids[k])
        assert (part["length"][1:] == 1024).all() and (len(part) == 1) == (len(ids[k]) <= 1024)
        assert [zlib.crc32(np.array(ids[k][s : s + n], "<u4").tobytes()) for s, n in zip(part["start"], part["length"])] == part["ids_crc32"].tolist()
    assert set(rows["doc_id"]) == set(ids)
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 1024
    assert rows["sequence_id"].nunique() == plain_best_fit(rows["length"], 1024)


def test_op8_packs_the_whole_table(spark, sf_dir):
    """As few sequences as one task needs for all pieces, however many tasks there are, and whichever way ranks are joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    for firsts in (tokens.FIRSTS, 0):
        rows = tokens.packed_matrix(docs, firsts_up_to=firsts).collect()
        sizes = [b - a for r in rows for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:])]
        assert len(rows) == packing.best_fit_decreasing(sizes, tokens.LIMIT)[2] == len({r["sequence_id"] for r in rows})
        assert all(r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1] for r in rows)


def test_op8_comes_back_exactly(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens.write_packed(docs, str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    got: dict = {}
    for r in sorted(tokens.unpacked(packed).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert len(got.get(r["doc_id"], [])) == r["start"]
        got[r["doc_id"]] = got.get(r["doc_id"], []) + r["ids"]
    t = library()
    assert got == {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    for r in packed.collect():
        row = np.frombuffer(r["ids"], "<u2")
        assert len(row) == 1024 and (row[r["n_tokens"] :] == 2).all() and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
        assert zlib.crc32(row.astype("<u4").tobytes()) == r["ids_crc32"]


def test_special_strings_are_tokens_as_in_the_library():
    t = library()
    for text in ("a<|endoftext|>b", "<|endoftext|>", "plain", "", "é 😀 \x00"):
        assert tokens.encoder()(text) == t.encode(text, add_special_tokens=False).ids


# ---- scores


def test_op6(spark, sf_dir):
    from compare import expected, got

    assert got(queries.op6_lm_scores(spark, sf_dir)) == expected(lm.ORACLE, sf_dir)


def test_scores_do_not_depend_on_batches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda df: sorted((r["doc_id"], round(r["log_score"], 6), r["n_order3"]) for r in df.collect())
    assert rows(lm.lm_scores(docs, batch_chars=20_000, partition_entries=5_000)) == rows(lm.lm_scores(docs))


@pytest.mark.parametrize("even", [0, 2, 9])
def test_packed_numbers_come_back(even):
    rng = np.random.default_rng(even)
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 1 << 60, 1000).astype(np.uint64), np.array([2**64 - 1, 0], np.uint64)):
        assert (lm.unpacked(lm.packed(x, even), len(x)) == x).all()


# ---- toxicity


def test_op10_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf_dir).toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.5)).all()
    held = rows[rows["held_out"]].merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert toxicity.auc(held["toxic"].to_numpy(), held["score"].to_numpy()) > 0.95
    assert ((held["predicted"] == held["toxic"]).mean()) > 0.97
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.01


@pytest.mark.parametrize("label", [lambda a, b: a and b, lambda a, b: a != b])
def test_pairs_of_terms_matter(label):
    """Two terms that mean something else together than alone; what either of them does can't be told by adding weights."""
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for _ in range(1500):
        a, b = (bool(x) for x in rng.random(2) < 0.5)
        docs.append(np.sort(np.array([1] * a + [2] * b + [10 + int(x) for x in set(rng.integers(0, 20, 5).tolist())])))
        labels.append(float(label(a, b)))
    machine = toxicity.fit(docs, np.array(labels))
    one, other, both = machine.margins(np.array([1, 2, 4]), np.array([1, 2, 1, 2])) > 0
    assert (one, other, both) == (label(True, False), label(False, True), label(True, True))


@pytest.mark.parametrize("n", [3000, 16_000])
def test_a_rare_pair_is_learnt_at_every_size(n):
    """Two terms that are together in 0.2 % of the rows, all toxic, while each alone is as common among clean ones."""
    rng = np.random.default_rng(n)
    docs, labels = [], []
    for i in range(n):
        own = set(rng.integers(10, 2000, 30).tolist())
        toxic = i % 500 == 0 or i % 50 == 1
        if i % 500 == 0:
            own |= {1, 2}
        elif i % 50 == 1:
            own |= {3}
        elif i % 25 == 2:
            own |= {1 + i % 2}
        docs.append(np.sort(np.array(list(own))))
        labels.append(float(toxic))
    machine = toxicity.fit(docs, np.array(labels))
    assert {1, 2} <= set(machine.terms.tolist())
    one, other, both = machine.margins(np.array([1, 2, 4]), np.array([1, 2, 1, 2])) > 0
    assert (one, other, both) == (False, False, True)


def test_margins_equal_a_sum_over_all_pairs():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(-0.3, np.sort(rng.choice(1000, 60, replace=False)), rng.normal(size=60), rng.normal(size=(60, 4)))
    docs = [np.sort(rng.choice(1000, rng.integers(0, 300), replace=False)) for _ in range(50)]
    plain = []
    for d in docs:
        known = [k for k, t in enumerate(machine.terms) if t in d]
        pairs = sum(float(machine.v[i] @ machine.v[j]) for i in known for j in known if i < j)
        plain.append(machine.bias + sum(machine.w[k] for k in known) + pairs)
    assert np.allclose(machine.margins(np.cumsum([len(d) for d in docs]), np.concatenate(docs)), plain)


def test_rare_toxic_terms_count_at_every_size():
    rng = np.random.default_rng(5)
    labels = (np.arange(16_000) % 10 == 0).astype(float)
    docs = [np.unique(rng.integers(10, 1000, 8)) for _ in labels]
    for i in np.flatnonzero(labels == 1)[:19]:
        docs[i] = np.append(docs[i], 5000)
    machine = toxicity.fit([np.sort(d) for d in docs], labels, epochs=1)
    assert 5000 in machine.terms


def test_repeated_ids_are_one_row_of_training(spark):
    rows = [(i, ("vile " if i % 3 == 0 else "kind ") + f"words {i % 7} here") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    repeated = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id < 50"))
    one, other = toxicity.train(docs, labels), toxicity.train(repeated, labels)
    assert one.bias == other.bias and (one.terms == other.terms).all() and (one.w == other.w).all()


def test_labels_are_not_learnt_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "toxicword here" if i % 2 else "nice here") for i in range(400)], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    right = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, 1 - i % 2 if held(i) else i % 2) for i in range(400)], "doc_id long, toxic int")
    scores = lambda y: sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(docs, y).collect())
    assert scores(right) == scores(wrong)
    assert all((s >= 0.5) == bool(i % 2) for i, s in scores(right))


# ---- pipeline


def test_pipeline_equals_its_stages(spark, sf_dir):
    """run() against the stages' own results: what each rejects is gone, and the rest is packed whole."""
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    toxic = queries.op10_toxicity(spark, sf_dir).toPandas().set_index("doc_id")["score"]
    left = docs[docs["doc_id"].map(toxic) < 0.5]
    from heartwood.llm import quality, secrets

    kept = quality.quality(spark.createDataFrame(left[["doc_id", "text"]])).toPandas()
    left = left[left["doc_id"].isin(kept[kept["kept"]]["doc_id"])]
    want = classes(dict(zip(left["doc_id"], left["text"])))
    assert set(out["doc_id"]) == set(want.values())
    sample = left[left["doc_id"].isin(out["doc_id"])][["doc_id", "text"]]
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(sample)).collect()}
    t = library()
    lengths = out.groupby("doc_id")["length"].sum().to_dict()
    assert lengths == {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in masked.items()}
    assert out["sequence_id"].nunique() == plain_best_fit(out["length"], 1024)
