"""Long repeats against a plain version of their definition."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heartwood.llm import queries, repeats


def plain(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text) in order."""
    seen, out = set(), []
    for k, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int64)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(window)
        covered = np.cumsum(gone)[: len(data)] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        n_spans = int((covered & ~np.append(False, covered[:-1])[: len(covered)]).sum())
        out.append((k, len(data), int(covered.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_op11(spark, where):
    sf_dir = f"/root/testdata/{where}"
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    want = plain(zip(docs["doc_id"].tolist(), docs["text"]))
    assert rows_of(queries.op11_suffix_dedup(spark, sf_dir)) == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in want) > 10


def made_up(rng):
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(14, 60))) for _ in range(6)]
    texts = ["", "x" * 99, "x" * 100, "x" * 350, "ab" * 400, "é" * 120, None, passages[0] * 5]
    for _ in range(120):
        parts = [rng.choice(passages)[rng.randrange(0, 40) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        texts.append(" ".join(parts))
        if rng.random() < 0.3:
            texts.append(rng.choice(texts[8:]) + rng.choice(["", "!", " more"]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("setting", [{}, {"GROUP": 2}, {"SAMPLED": 1, "HOT_LEAST": 2, "HOT_SHARE": 10**9}, {"SLICE_BYTES": 150, "BUCKET_BYTES": 500, "FLUSH": 10}])
def test_all_ways_of_meeting_give_the_same(spark, monkeypatch, setting):
    rows = made_up(random.Random(5))
    for name, value in setting.items():
        monkeypatch.setattr(repeats, name, value)
    if "GROUP" in setting:
        monkeypatch.setattr(repeats.judged, "__defaults__", (setting["GROUP"],))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(repeats.repeat_digest(docs)) == sorted(plain(rows), key=repr)


def test_suffixes_runs_and_statistics():
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) * rng.randrange(1, 9)
        data = np.frombuffer(text.encode() + b"\xff", np.uint8)
        order = repeats.suffix_array(data, repeats.words_at(data))
        want = sorted(range(len(data)), key=lambda i: bytes(data[i:]))
        assert order.tolist() == want
        index = repeats.RunLengthIndex(data)
        before, match = index.statistics(np.arange(len(data)))
        row = {p: k for k, p in enumerate(want)}
        for p in range(len(data)):
            if row[p]:
                q = want[row[p] - 1]
                common = next((k for k in range(len(data)) if p + k >= len(data) or q + k >= len(data) or data[p + k] != data[q + k]), None)
                assert (before[p], match[p]) == (q, common)
        last = [256 if p == 0 else int(data[p - 1]) for p in want]
        assert np.repeat(index.symbols, index.sizes).tolist() == last
        assert (index.symbols[1:] != index.symbols[:-1]).all()
    repeated = np.frombuffer(b"a passage that occurs over and over again. " * 500 + b"\xff", np.uint8)
    assert len(repeats.RunLengthIndex(repeated).at) < len(repeated) / 100


def test_shared_ids_null_ids_and_repeated_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (1, long + " x"), (1, long), (None, long), (None, None), (2, "short"), (2, "short"), (3, long[:99])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "at", "anchor", "windows", "spans", "kept")})
    in_order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert rows_of(repeats.repeat_digest(docs.repartition(3))) == sorted(plain(in_order), key=repr)
    kept = repeats.without_repeats(docs).where("doc_id = 3").first()
    assert kept["kept"] == long[:99].encode() and kept["spans"] == []
    assert repeats.repeat_digest(docs.where("false")).count() == 0


def test_pieces_hold_every_window_once(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (0, 99, 100, 150, 249, 250, 251, 1000, 30, 0, 400)]
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t.encode()) - 99)}
    for size in (100, 150, 333, 1 << 20):
        monkeypatch.setattr(repeats, "SLICE_BYTES", size)
        seen = []
        for data, starts, ends, keys, offset in repeats.pieces(pa.array(texts), np.arange(len(texts))):
            text, at, n, anchor, context = repeats.contexts(data, starts, ends)
            seen += [(int(keys[t]), int(a + offset[t]) + i) for t, a, m in zip(text, at, n) for i in range(m)]
        assert len(seen) == len(set(seen)) and set(seen) == want
