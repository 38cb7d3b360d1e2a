"""Every operator and every stage on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heartwood.llm import bpe, licenses, lm, media, neardup, quality, secrets, tokens, toxicity

LONG = "long words stand here one after another number " * 4000
ROWS = [
    (1, "a plain text of some words that stands alone here", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0),
    (None, "password = hunter22x and the mit license", None, "s", 1), (5, LONG, "en", "t", len(LONG)), (6, LONG, "en", "t", len(LONG)), (7, " \n\t ", "en", "t", 3), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns with the names that operators use themselves."""
    names = ["words", "_words", "bands", "score", "kept", "n_words", "_votes", "_toxic", "_terms_of_text", "secrets", "ids", "batch", "piece", "length", "media", "class_id", "_n", "class", "_id", "_text"]
    return docs.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)] + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "media": lambda d, y: media.media_digest(d), "neardup": lambda d, y: neardup.near_duplicates(d), "secrets": lambda d, y: secrets.secret_digest(d), "quality": lambda d, y: quality.quality(d),
    "packing": lambda d, y: tokens.packed_pieces(d), "lm": lambda d, y: lm.lm_scores(d), "bpe": lambda d, y: bpe.encoding_digest(d), "licenses": lambda d, y: licenses.license_scan(d),
    "toxicity": lambda d, y: toxicity.toxicity(d, y),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(docs, clashing, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if name != "packing" or r["piece"] == 0)
    assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    key = lambda r: repr(tuple(x for k, x in r.asDict().items() if k not in ("sequence_id", "offset")))
    assert sorted(map(key, OPERATORS[name](clashing, labels).collect())) == sorted(map(key, rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_equal_texts_have_equal_rows(docs, labels, name):
    if name == "packing":
        return
    rows = [r.asDict() for r in OPERATORS[name](docs, labels).collect() if r["doc_id"] in (5, 6)]
    for r in rows:
        r.pop("doc_id"), r.pop("held_out", None)
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.where("false"), labels).count() == 0
    assert OPERATORS[name](docs.where("false"), labels.where("false")).count() == 0


def test_packed_matrix_edges(docs, clashing):
    back = tokens.unpacked(tokens.packed_matrix(docs)).collect()
    key = lambda r: (r["doc_id"] or 0, r["start"], r["ids"])
    assert sorted(map(key, back)) == sorted(map(key, tokens.unpacked(tokens.packed_matrix(clashing)).collect()))
    assert sorted({r["doc_id"] or 0 for r in back}) == [0, 1, 2, 3, 5, 6, 7]
    assert tokens.packed_matrix(docs.where("false")).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, clashing, sf_dir, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if not last:
        assert out.columns == docs.columns and stage(spark, clashing, sf_dir).columns == clashing.columns
    assert len(rows) == len(stage(spark, clashing, sf_dir).collect())
    assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_stages_take_effect(spark, docs, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert {r["doc_id"] for r in stages["quality_rules"](spark, docs, sf_dir).collect()} <= {5, 6}
    kept = [r["doc_id"] for r in stages["minhash_neardup"](spark, docs, sf_dir).collect()]
    assert sorted(x or 0 for x in kept) == [0, 0, 1, 2, 5]
    masked = {r["text"] for r in stages["secret_scan"](spark, docs, sf_dir).collect()}
    assert "[SECRET] and the mit license" in masked
