import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heartwood.functions import html, providers, text
from heartwood.operators import crawl, fusion, markdown, reasoning, tree, vectors
from heartwood.plans.knowledge_base import KnowledgeBase
from heartwood.sources.config import Settings, VectorSettings, load
from heartwood.streaming import upsert

DOCS = [("a", "# Alpha\nintro\n## Apples\nred apples grow\n### Cider\napples pressed\n## Pears\ngreen pears"), ("b", "# Beta\n## Boats\nsailing boats"), ("c", "no headings, only apples")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_name string, content string")


@pytest.fixture(scope="module")
def nodes(docs):
    return tree.nodes(markdown.sections(docs)).withColumn("summary", F.lit("")).persist()


def test_fusion_against_a_dictionary(spark):
    rng = random.Random(3)
    for _ in range(5):
        v = [(f"d{i % 3}", f"{i:04d}", f"t{i}", rng.randrange(10) / 10, k) for k, i in enumerate(rng.sample(range(12), 6))]
        r = [(f"d{i % 3}", f"{i:04d}", f"r{i}", rng.randrange(10) / 10, f"why{k}", k) for k, i in enumerate(rng.choices(range(12), k=8))]
        want: dict = {}
        for d, n, t, s, _k in v:
            want[d, n] = [t, s * 0.4, s, None, None, "vector"]
        for d, n, t, s, why, _k in r:
            if (d, n) in want:
                old = want[d, n]
                want[d, n] = [old[0], (old[2] or 0) * 0.4 + s * 0.6, old[2], s, why, "both"]
            else:
                want[d, n] = [t, s * 0.6, None, s, why, "reasoning"]
        want_rows = sorted(((*k, *x) for k, x in want.items()), key=lambda x: -x[3])[:7]
        got = fusion.fuse(spark.createDataFrame(v, "doc_name string, node_id string, title string, score double, rank int"), spark.createDataFrame(r, "doc_name string, node_id string, title string, score double, reasoning string, rank int"), 7)
        assert [tuple(x) for x in got.collect()] == [tuple(x) for x in want_rows]


def plain_chunks(body, size, overlap):
    """A walk from cut to cut: the same rule, one text at a time."""
    if len(body) <= size:
        return [body] if body else []
    out, start = [], 0
    while True:
        end, last = start + size, start > 0 and start + size >= len(body)
        if last:
            end = len(body)
        else:
            for b in vectors.BREAKS:
                at = body.rfind(b, start, end)
                if at > start + size // 2:
                    end = at + len(b)
                    break
        out.append(body[start:end].strip())
        if end >= len(body):
            return [p for p in out if p]
        start = end - overlap


@pytest.mark.parametrize("size,overlap", [(500, 50), (101, 50), (120, 50), (40, 0), (7, 3)])
def test_chunks_against_a_plain_walk(spark, size, overlap):
    rng = random.Random(size)
    alphabets = ["ab. ", "a。! \n", "word? ", "x", "é😀\n. ", " \u2003\x1f\x85", "a$\\E.*", "\r\n. "]
    texts = [None, "", "  short ", "x" * size, "x" * (size + 1), "x" * (3 * size), " " * (3 * size), "a. " * 20 * size, "😀" * (2 * size + 1), "word " * 90 + "end. " + "more " * 90]
    for _ in range(300):
        mix = "".join(rng.choice(alphabets) for _ in range(3))
        texts.append("".join(rng.choice(mix) for _ in range(rng.randrange(6 * size))))
        texts.append("".join(rng.choice(["long" * rng.randrange(1, 30), ". ", "。", "\n", "! ", "? ", " "]) for _ in range(rng.randrange(60))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r["i"]: r["p"] for r in df.select("i", vectors.text_chunks(F.col("t"), size, overlap).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_chunks(t or "", size, overlap) for t in texts]


def test_chunks(spark):
    body = "word " * 90 + "end. " + "more " * 90
    df = spark.createDataFrame([(1, body, 7), (2, "y" * 100, 8), (3, None, 9), (4, " " * 2000, 5), (5, "z" * 101, 6)], "i int, content string, _lines int")
    got = vectors.chunks(df).orderBy("i", "chunk_no").collect()
    assert [(r["i"], r["chunk_no"], r["_lines"]) for r in got] == [(1, 0, 7), (1, 1, 7), (5, 0, 6)]
    assert got[0]["chunk"].endswith("end.") and all(len(r["chunk"]) <= 500 for r in got)
    with pytest.raises(ValueError):
        vectors.text_chunks(F.col("content"), 100, 50)


def test_one_bad_prompt_leaves_its_batch_alone(spark):
    class Picky:
        def complete(self, prompts):
            if "bad" in prompts:
                raise ValueError("bad")
            return [p.upper() for p in prompts]

    asked = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string").coalesce(1)
    replied = providers.completed(asked, Picky())
    assert sorted(map(tuple, replied.collect())) == [("a", "A"), ("bad", None), ("c", "C")]
    assert tuple(providers.unanswered(replied).first()) == (3, 1)


def test_subtree_contents_against_the_interval_join(spark):
    """Nested hits, leaves, roots, unknown ids, nodes without text, a tree that lacks nodes, and documents over many buckets."""
    rng, rows = random.Random(11), []
    for d, n in (("a", 40), ("b", 3000), ("c", 1), ("untouched", 50)):
        depths = [0]
        while len(depths) < n:
            depths.append(rng.randrange(min(depths[-1] + 2, 6)))
        for pos, depth in enumerate(depths, 1):
            last = next((k for k in range(pos, n) if depths[k] <= depth), n)
            rows.append((d, f"{pos:04d}", pos, last, depth, rng.choice(["", f"text {d} {pos}"]), rng.choice([None, f"sum {pos}"])))
    full = spark.createDataFrame(rows, "doc_name string, node_id string, pos int, last_pos int, depth int, content string, summary string")
    keys = [r[:2] for r in rows if r[0] != "untouched" and (r[0] != "b" or rng.random() < 0.4)]
    hits = spark.createDataFrame([*keys, *keys[:5], ("a", "9999"), ("nowhere", "0001")], "doc_name string, node_id string")
    for nodes in (full, full.where("pos % 7 <> 3")):
        inside = tree.below(hits, nodes).withColumn("t", F.expr("CASE WHEN content <> '' THEN content ELSE summary END")).where("t <> ''")
        plain: dict = {}
        for r in sorted(inside.collect(), key=lambda r: r["pos"]):
            plain.setdefault((r["doc_name"], r["of_id"]), []).append(r["t"])
        got = tree.subtree_contents(hits, nodes).collect()
        assert len(got) == len(plain) > 500
        assert {(r["doc_name"], r["node_id"]): r["content"] for r in got} == {k: "\n\n".join(v) for k, v in plain.items()}
    tops = tree.outermost(hits, full).collect()
    assert sum(len(r["hits"]) for r in tops) == len(set(keys))
    assert all(x["last_pos"] <= r["top_last"] and x["pos"] >= r["top"] for r in tops for x in r["hits"])


def test_vector_search_with_and_without_chunks(spark):
    n = spark.createDataFrame([("d", "1", "t", [1.0, 0.0]), ("d", "2", "u", [0.0, 1.0])], "doc_name string, node_id string, title string, vector array<double>")
    c = spark.createDataFrame([("d", "2", 0, [0.9, 0.0]), ("d", "2", 1, [0.9, 0.0])], "doc_name string, node_id string, chunk_no int, vector array<double>")
    q = vectors.literal([1.0, 0.0])
    assert [(r["node_id"], round(r["score"], 4)) for r in vectors.vector_search(n, c, q).collect()] == [("2", round(1.8 / 3**0.5, 4)), ("1", 1.0)]
    assert [r["node_id"] for r in vectors.vector_search(n, None, q, threshold=0.5).collect()] == ["1"]
    assert vectors.vector_search(n.where("false"), c.where("false"), q).count() == 0


def test_candidates_and_deep_search(nodes):
    class Scripted:
        def complete(self, prompts):
            out = []
            for p in map(json.loads, prompts):
                if p["task"] == "candidates":
                    out.append({"a": '{"candidates": [{"node_id": "0001", "relevance": 0.9}, {"node_id": "0004", "relevance": 0.7}, {"node_id": "7777"}]}', "b": "no json at all", "c": None}[p["doc_name"]])
                else:
                    out.append('```json\n{"selected_nodes": [{"node_id": "0003", "relevance": 0.8}, {"node_id": "0042"}, {"node_id": "0002"}]}\n```')
            return out

    got = reasoning.tree_search(nodes, "q", Scripted(), 10, 0.3)
    rows = [(r["doc_name"], r["node_id"], round(r["score"], 3), r["rank"]) for r in got.orderBy("rank").collect()]
    # 0002 takes the candidate's relevance, the made-up 0042 stands for the candidate at 0.8 of it, c falls back to its root.
    assert rows == [("a", "0002", 0.9, 1), ("a", "0003", 0.8, 2), ("a", "0001", 0.72, 3), ("a", "0004", 0.7, 4), ("c", "0001", 0.5, 5)]


def test_a_completer_that_raises_gives_the_fallback(nodes):
    class Broken:
        def complete(self, prompts):
            raise RuntimeError("down")

    got = reasoning.tree_search(nodes, "q", Broken(), 10, 0.3)
    assert sorted((r["doc_name"], r["node_id"], r["score"]) for r in got.collect()) == [("a", "0001", 0.5), ("b", "0001", 0.5), ("c", "0001", 0.5)]


def test_summaries_and_judgements(spark, docs, nodes):
    told = reasoning.summarised(nodes, providers.OverlapCompleter())
    assert {r["node_id"]: r["summary"] for r in told.where("doc_name = 'a'").collect()} == {"0001": "intro", "0002": "red apples grow", "0003": "apples pressed", "0004": "green pears"}
    described = reasoning.described(docs.withColumn("description", F.lit("")), nodes, providers.OverlapCompleter())
    assert described.where("description = ''").count() == 0
    passages = spark.createDataFrame([("red apples",), (None,)], "content string")
    judged = reasoning.judged(passages, "red apples", providers.RecordedCompleter({}))
    assert [(r["relevant"], r["confidence"]) for r in judged.collect()] == [(True, 0.5)] * 2


def test_html():
    page = '<html><head><title> T &amp; x </title><meta name="description" content="about"><meta property="og:type" content="web"></head><body><nav>n</nav><main><h1>Head</h1><p>one <b>two</b></p><ul><li>a</li><li>b</li></ul><ol><li>c</li></ol><pre class="language-py">x = 1\n</pre><blockquote>q</blockquote><a href="/l?x=1#f">link</a><a href="#top">top</a><hr><!-- note --><table><tr><td>lost</td></tr></table><div><p>deep</div></main></body></html>'
    assert html.markdown_of(html.Page(page), "T").split("\n") == ["# T", "", "## Head", "", "onetwo", "", "- a", "- b", "", "1. c", "", "```py", "x = 1\n".rstrip("\n"), "", "```", "", "> q", "", "[link](/l?x=1#f)", "---", "", "note", "deep", ""]
    assert html.title_of(html.Page(page)) == "T & x" and html.title_of(html.Page("<h1>H</h1>")) == "H" and html.title_of(html.Page("")) == "Untitled"
    assert html.links_of(html.Page(page), "http://h/p/") == ["http://h/l?x=1"]
    assert html.metadata_of(html.Page(page)) == {"description": "about", "og_type": "web"}
    assert html.text_of(html.Page("<p>a<script>no</script></p><header>no</header>\n b ")) == "a\nb"
    assert html.simple_markdown_of(html.Page("<div><ul><li>a<p>b</p></li></ul></div>")) == "- ab\nb\n"


def test_clean_html_and_conversion_by_a_completer(spark):
    page = '<html><head><title>T</title></head><body><script>x</script><div><img src="a"></div><p>a &lt; b <br><span> </span></p><!-- c --></body></html>'
    assert html.clean_html_of(html.Page(page)) == "<body><p>a &lt; b <br/></p></body>"
    long = "<p>" + "x" * 60_000 + "</p>"
    pages = spark.createDataFrame([("u1", page), ("u2", "<h1>H</h1><p>p</p>"), ("u3", long)], "url string, html string")

    class Converter:
        def complete(self, prompts):
            asked = [json.loads(p) for p in prompts]
            return [None if a["url"] == "u2" else "```markdown\n# " + str(len(a["content"])) + "\n```" for a in asked]

    rows = {r["url"]: r["markdown"] for r in reasoning.converted(pages, Converter()).collect()}
    assert rows == {"u1": "# 34", "u2": "# H\n\n## H\n\np\n", "u3": "# " + str(50_000 + len(reasoning.CUT_MARK))}


@pytest.mark.parametrize("deep", ["<div>x<p>" * 30_000, "<div>" * 100_000 + "</b>" * 100_000, "<ul><li>" * 20_000])
def test_deeply_nested_pages(deep):
    assert html.title_of(html.Page(deep)) == "Untitled"
    made = [f(html.Page(deep)) for f in (html.markdown_of, html.text_of, html.clean_html_of)]
    assert all(isinstance(x, str) for x in made)


def test_whole_text_and_page_struct(spark):
    df = spark.createDataFrame([("<title>T</title><header>h</header><style>s</style><p>a</p>",)], "html string")
    row = df.select(html.html_whole_text("html").alias("t"), html.html_page("html").alias("p")).first()
    assert row["t"] == "T\nh\na" and row["p"]["title"] == "T" and row["p"]["markdown"] == "# T\n\nT\na\n".replace("T\na", "a") and row["p"]["metadata"] == {}


def test_failing_pages_are_not_found(spark):
    rows = [("http://h/", '<a href="/a">a</a><a href="/b">b</a>', 200), ("http://h/a", '<a href="/c">c</a>', 404), ("http://h/b", '<a href="/d">d</a>', 204), ("http://h/c", "", 200), ("http://h/d", "", 500)]
    pages = spark.createDataFrame(rows, "url string, html string, status_code int")
    seen = crawl.crawl(pages, "http://h/", depth=5)
    assert sorted((r["url"], r["level"], r["found"]) for r in seen.collect()) == [("http://h/", 0, True), ("http://h/a", 1, False), ("http://h/b", 1, True), ("http://h/d", 2, False)]
    assert tuple(crawl.crawl_statistics(seen, pages).first()) == (2, 2, 3)
    capped = crawl.crawl(pages, "http://h/", depth=5, max_pages=2)
    assert sorted(r["url"] for r in capped.where("found").collect()) == ["http://h/", "http://h/b"]
    assert crawl.page_documents(pages).count() == 3


def test_an_embedder_is_asked_once(spark, docs, tmp_path):
    """A query is one call, and texts are embedded when they come in, not at each search."""
    import uuid

    folder = str(tmp_path)

    class Counting(providers.HashingEmbedder):
        def embed(self, text):
            @F.pandas_udf("string")
            def noted(texts: pd.Series) -> pd.Series:
                for t in texts:
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                        f.write(t)
                return texts

            return super().embed(noted(text))

    providers.register_embedder("counting", lambda **o: Counting(16))
    kb = KnowledgeBase.of(docs, Settings(mode="vector", embedder="counting", vector=VectorSettings(threshold=0.0)))
    before = len(list(tmp_path.iterdir()))
    assert before == kb.node_vectors.count() + kb.chunk_vectors.count()
    assert kb.search("red apples").count() and kb.search("boats").count()
    assert sorted(f.read_text() for f in tmp_path.iterdir() if f.read_text() in ("red apples", "boats")) == ["boats", "red apples"]
    assert len(list(tmp_path.iterdir())) == before + 2
    assert kb.cleared().node_vectors.count() == 0 and kb.cleared().docs.count() == 3


def test_blank_texts_are_one_blank(spark):
    class Told:
        dimension = 1

        def embed(self, text):
            return F.array(F.length(text).cast("double"))

    df = spark.createDataFrame([("",), ("  ",), (None,), ("ab",)], "t string")
    assert [r["v"] for r in df.select(providers.embedded(F.col("t"), Told()).alias("v")).collect()] == [[1.0], [1.0], [1.0], [2.0]]


def test_paths_and_the_fallback_to_one_round(nodes):
    assert [(r["node_id"], r["title"]) for r in tree.path_to(nodes, "0003").orderBy("pos").collect()] == [("0001", "Alpha"), ("0002", "Apples"), ("0003", "Cider")]

    class OneRound:
        """Nothing from the high-level view's prompts, which are asked first; the enhanced view shows nodes at depth 2."""

        def complete(self, prompts):
            asked = [json.loads(p) for p in prompts]
            return [json.dumps({"candidates": [], "node_list": [{"node_id": "0003", "relevance": 0.9}] if any(n["node_id"] == "0003" for n in a["nodes"]) else []}) for a in asked]

    got = reasoning.search_with_fallback(nodes, "q", OneRound())
    assert [(r["doc_name"], r["node_id"], r["score"]) for r in got.collect()] == [("a", "0003", 0.9)]


def test_levels_beyond_the_table_raise(spark):
    deep = spark.createDataFrame([("d", k, k, f"t{k}", k, k) for k in range(1, 10)], "doc_name string, pos int, level int, title string, start_line int, end_line int")
    with pytest.raises(Exception, match="level 7"):
        tree.nodes(deep).collect()
    made = tree.nodes(deep, tree.deepest(deep))
    assert [r["depth"] for r in made.orderBy("pos").collect()] == list(range(9))
    known = spark.createDataFrame([("d", "t", "", "", 9)], "doc_name string, title string, description string, source_file string, total_lines int")
    from heartwood.sources import tables

    text = tables.nested_json(known, made.withColumn("summary", F.lit("")).withColumn("content", F.lit("x"))).first()["json"]
    assert text.count('"node_id"') == 9 and json.loads(text)


def test_vector_files_round_trip(spark, docs, nodes, tmp_path):
    from heartwood.sources import tables

    e = providers.HashingEmbedder(8)
    n, c = vectors.node_vectors(nodes, e), vectors.chunk_vectors(nodes.withColumn("content", F.repeat(F.col("content"), 20)), e, 200)
    for r in tables.vector_json(n, c).collect():
        (tmp_path / f"{r['doc_name']}.json").write_text(r["json"], encoding="utf-8")
    n2, c2 = tables.vector_files(spark, str(tmp_path))
    rows = lambda df, *k: sorted((*(r[x] for x in k), [round(v, 9) for v in r["vector"]]) for r in df.collect())
    assert rows(n2, "doc_name", "node_id", "title", "level") == rows(n, "doc_name", "node_id", "title", "level")
    assert rows(c2, "doc_name", "node_id", "chunk_no") == rows(c, "doc_name", "node_id", "chunk_no")


def test_page_markdown_equals_a_plain_reading(spark, sf_dir):
    """The driver's pages have one article with a heading and paragraphs that may not be closed."""
    import pandas as pd

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    for page in pages["html"]:
        lines = html.markdown_of(html.Page(page)).split("\n")
        assert lines[0].startswith("# ") and "track(" not in "".join(lines) and "copy;" not in "".join(lines)
        assert html.text_of(html.Page(page))


def test_crawl_counts_levels_and_caps(spark):
    rows = [("http://h/", '<a href="/a">a</a><a href="/b.pdf">b</a><a href="http://x/">x</a>'), ("http://h/a", '<a href="/">up</a><a href="c#f">c</a><a href="d">d</a>'), ("http://h/c", ""), ("http://h/d", "")]
    pages = spark.createDataFrame(rows, "url string, html string")
    see = lambda **k: sorted((r["url"], r["level"]) for r in crawl.crawl(pages, "http://h/", **k).collect())
    assert see(depth=0) == [("http://h/", 0)]
    assert see(depth=5) == [("http://h/", 0), ("http://h/a", 1), ("http://h/c", 2), ("http://h/d", 2)]
    assert see(depth=5, max_pages=3) == [("http://h/", 0), ("http://h/a", 1), ("http://h/c", 2)]
    assert see(depth=5, url_filter=F.col("url").endswith("a")) == [("http://h/", 0), ("http://h/a", 1)]


def test_knowledge_base(spark, docs, tmp_path):
    kb = KnowledgeBase.of(docs, Settings(vector=VectorSettings(threshold=0.2)), summarise=True)
    hits = kb.search("apples", "hybrid").collect()
    assert hits[0]["source"] == "both" and hits[0]["title"] in ("Apples", "Cider")
    assert kb.search("zebra", "vector").count() == 0
    answer = kb.query("sailing boats").first()
    assert "sailing boats" in answer["context"] and answer["source_files"] == ["b"] and answer["total_chars"] == sum(len(c) for _, c in DOCS) - 4
    assert kb.chat("sailing boats").first()["answer"]
    kb.save(str(tmp_path / "kb"))
    again = KnowledgeBase.load(spark, str(tmp_path / "kb"), kb.settings)
    newer = again.add(spark.createDataFrame([("b", "# Beta\n## Trains\nfast trains"), ("d", "# Delta\nrivers")], "doc_name string, content string"))
    assert sorted(r["doc_name"] for r in newer.documents().collect()) == ["a", "b", "c", "d"]
    assert newer.search("trains", "vector").first()["doc_name"] == "b" and newer.search("boats", "vector").count() == 0
    assert again.add_missing(spark.createDataFrame([("b", "# X"), ("e", "# E")], "doc_name string, content string")).docs.count() == 4
    with pytest.raises(ValueError):
        kb.search("x", "other")


def test_crawled_knowledge_base(spark):
    pages = spark.createDataFrame([("http://h/", "<html><head><title>Home</title></head><body><p>apples</p><a href='/b'>b</a></body></html>"), ("http://h/b", "<body><p>boats</p></body>")], "url string, html string")
    kb = KnowledgeBase.of(spark.createDataFrame([("h", "# Old\nx"), ("z", "# Z")], "doc_name string, content string"))
    assert sorted(r["doc_name"] for r in kb.crawl(pages, "http://h/", depth=1).documents().collect()) == ["h", "h_b", "z"]


def test_settings(tmp_path):
    (tmp_path / "config.yaml").write_text("retrieval:\n  mode: vector\n  max_results: 4\n  vector: {top_k: 7}\n  other: 1\n")
    s = load(folder=str(tmp_path))
    assert (s.mode, s.max_results, s.vector.top_k, s.vector.threshold) == ("vector", 4, 7, 0.3)
    assert load(folder=str(tmp_path / "none")).mode == "hybrid"
    with pytest.raises(ValueError):
        Settings(mode="odd")


def test_settings_of_the_environment(monkeypatch, tmp_path):
    monkeypatch.setenv("HEARTWOOD_MODE", "vector")
    monkeypatch.setenv("HEARTWOOD_MAX_RESULTS", "3")
    monkeypatch.setenv("HEARTWOOD_MIN_RELEVANCE", "0.5")
    s = load(folder=str(tmp_path))
    assert (s.mode, s.max_results, s.min_relevance, s.embedder) == ("vector", 3, 0.5, "hashing")


def test_providers_can_be_registered():
    providers.register_embedder("eight", lambda **o: providers.HashingEmbedder(8))
    assert providers.embedder("eight").dimension == 8
    with pytest.raises(ValueError):
        providers.completer("unknown")


def test_reply_json(spark):
    cases = {'{"a": 1} trailing }': None, '{"a": 1} trailing': '{"a":1}', "```\n[1]\n```": "[1]", '{"b": 2, "a": [1.5, null]}': '{"a":[1.5,null],"b":2}', "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", providers.strict_json(text.json_body(F.col("r"))).alias("j"))
    assert {r["r"]: r["j"] for r in df.collect()} == cases


def test_streamed_index_equals_the_batch_index(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "# A\nx", 1), ("b", "# B", 1)], "doc_name string, content string, version int").write.parquet(str(source / "1"))
    read = lambda: spark.readStream.schema("doc_name string, content string, version int").option("recursiveFileLookup", "true").parquet(str(source))
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    upsert.stream_index(read(), out, at).awaitTermination()
    spark.createDataFrame([("a", "# A2\n## C", 2), ("a", "# old", 1)], "doc_name string, content string, version int").write.parquet(str(source / "2"))
    upsert.stream_index(read(), out, at).awaitTermination()
    assert sorted((r["doc_name"], r["title"]) for r in upsert.current(spark, out).collect()) == [("a", "A2"), ("a", "C"), ("b", "B")]


def test_streamed_windows_equal_batch_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = upsert.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("event_windows").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lambda df: sorted((r["window_start"], r["event_type"], r["n"], round(r["total"], 4)) for r in df.collect())
    assert rows(spark.table("event_windows")) == rows(upsert.event_counts(events))


def test_prompts_keep_to_the_budget_and_show_every_node(spark):
    content = "# Top\n" + "\n".join(f"## Part {i} \"quoted\"\nsome text {i} " + "x" * (i * 7 % 90) for i in range(300))
    docs = spark.createDataFrame([("a", content), ("b", "# One\ntext"), ("c", "")], "doc_name string, content string")
    found = tree.nodes(markdown.sections(docs)).withColumn("summary", F.substring("raw_content", 1, 200))
    told = docs.select("doc_name", F.lit("A title").alias("title"), F.lit("d" * 900).alias("description"))
    seen: dict = {}

    class Noting:
        def complete(self, prompts):
            return [json.dumps({"node_list": [{"node_id": n["node_id"], "relevance": 0.5 if n["node_id"] != "0290" else 0.9} for n in json.loads(p)["nodes"]]}) for p in prompts]

    prompts = reasoning.view_prompts(tree.enhanced_view(found), "candidates", "q", ["doc_name"], told, 300, 2500).collect()
    for r in prompts:
        p = json.loads(r["prompt"])
        assert len(r["prompt"]) <= 2500 and p["title"] == "A title" and p["description"] == "d" * 300
        seen.setdefault(r["doc_name"], []).extend((r["part"], n["node_id"]) for n in p["nodes"])
    assert [n for _, n in sorted(seen["a"])] == [f"{i:04d}" for i in range(1, 302)] and len(seen["b"]) == len(seen["c"]) == 1
    assert len({part for part, _ in seen["a"]}) > 5
    got = reasoning.single_round_search(found, "q", Noting(), 3, told, 2500).collect()
    assert (got[0]["doc_name"], got[0]["node_id"], got[0]["score"]) == ("a", "0290", 0.9) and len(got) == 3
    assert reasoning.single_round_search(found, "q", Noting(), None, told, 2500).count() == 303


def test_ampersands_without_a_closed_reference():
    page = '<title>T &quot;a&&amp</title><!-- a & b --><script>a && b</script><p class="x&y">&amp;&a &lt; &notit; &#38;</p>'
    assert html.title_of(html.Page(page)) == 'T "a&&' and html.title_of(html.Page(html.closed_references(page))) == 'T "a&&amp'
    closed = html.Page(html.closed_references(page))
    assert closed.held[closed.names.index(html.COMMENT)] == " a & b " and "&& b" in "".join(closed.strings(0)) and closed.text(closed.first("p")) == "&&a < &notit; &"
    assert html.cleaned(page) == '<title>T "a&&amp</title><p class="x&y">&amp;&a &lt; &notit; &amp;</p>'
    assert html.closed_references(None) is None and html.closed_references("") == ""


def test_converted_pages_hand_ampersands_on(spark):
    class Echo:
        def complete(self, prompts):
            import json

            return [json.loads(p)["title"] + "|" + json.loads(p)["content"] for p in prompts]

    pages = spark.createDataFrame([("http://h/", "<title>T&amp</title><body><p>a&amp;&a</p></body>")], "url string, html string")
    title = html.html_title(html.html_closed(F.col("html")))
    assert reasoning.converted(pages, Echo(), title).first()["markdown"] == "T&amp|<body><p>a&amp;&a</p></body>"
