"""Headings and trees against a plain line-by-line reading."""

import json
import random
import re

import pytest

from heartwood.operators import markdown, toc, tree
from heartwood.sources import tables

ATX = re.compile(r"^(#{1,6})\s+(.+?)(?:\s*#*\s*)?$")


def kinds_of(lines):
    """What each line may be by itself and with the next one: fence, (level, title) of a heading, (level, None) over a line."""
    for line, below in zip(lines, [*lines[1:], ""]):
        under = {"=": 1, "-": 2}.get(below[:1]) if re.fullmatch(r"(=+|-+)\s*", below) else None
        mark = ATX.match(line)
        if line.strip()[:3] == "```":
            yield "fence"
        elif mark:
            yield len(mark[1]), mark[2].strip()
        else:
            yield (under, None) if under and line.strip() and not (under == 2 and line[:1] == "-") else None


def headings_of(text):
    """First all lines are told apart; then fences switch, and a heading over a line uses that line up."""
    lines = text.split("\n")
    out, fences, used = [], 0, -1
    for i, kind in enumerate(kinds_of(lines)):
        fences += kind == "fence"
        if kind in (None, "fence") or fences % 2 or i == used:
            continue
        level, title = kind
        out.append((i + 1, level, lines[i].strip() if title is None else title))
        used = i + 1 if title is None else -1
    return out


def nodes_of(text):
    lines, heads = text.split("\n"), headings_of(text)
    if not heads:
        return [("Document", 0, 1, len(lines), None, 1, text, ["Document"])]
    out, open_ = [], []
    for k, (line, level, title) in enumerate(heads):
        while open_ and heads[open_[-1]][1] >= level:
            open_.pop()
        last = next((j for j in range(k + 1, len(heads)) if heads[j][1] <= level), len(heads))
        end = heads[last][0] - 1 if last < len(heads) else len(lines)
        own = heads[k + 1][0] - 1 if k + 1 < len(heads) else len(lines)
        path = [heads[j][2] for j in open_] + [title]
        out.append((title, level, line, end, open_[-1] + 1 if open_ else None, last, "\n".join(lines[line - 1 : own]), path))
        open_.append(k)
    return out


@pytest.fixture(scope="module")
def random_docs(spark):
    rng = random.Random(5)
    kinds = ["# A", "## B ##", "### C", "###### F", "#x", "text", "", "===", "---", "```", "  ```py", "- item", " # no", "T\r", "#\tTab", "= =", "--- ", "####"]
    docs = {f"d{i}": "\n".join(rng.choice(kinds) for _ in range(rng.randrange(0, 25))) for i in range(400)}
    return docs, spark.createDataFrame(list(docs.items()), "doc_name string, content string")


def test_headings(random_docs):
    docs, df = random_docs
    found = {}
    for r in markdown.headings(df).orderBy("doc_name", "pos").collect():
        found.setdefault(r["doc_name"], []).append((r["line_no"], r["level"], r["title"]))
    assert found == {k: h for k, v in docs.items() if (h := headings_of(v))}


def test_nodes(random_docs):
    docs, df = random_docs
    found = {}
    for r in tree.nodes(markdown.sections(df)).orderBy("doc_name", "pos").collect():
        found.setdefault(r["doc_name"], []).append((r["title"], r["level"], r["start_line"], r["end_line"], r["parent_pos"], r["last_pos"], r["content"], r["path"]))
    assert found == {k: nodes_of(v) for k, v in docs.items()}


def test_null_content_and_no_documents(spark):
    none = spark.createDataFrame([("n", None)], "doc_name string, content string")
    assert [(r["title"], r["content"]) for r in tree.nodes(markdown.sections(none)).collect()] == [("Document", "")]
    assert tree.nodes(markdown.sections(none.where("false"))).count() == 0


def test_levels_beyond_six(spark):
    df = spark.createDataFrame([("d", 1, 7, "x", 1, 1), ("d", 2, 9, "y", 2, 2), ("d", 3, 8, "z", 3, 3)], "doc_name string, pos int, level int, title string, start_line int, end_line int")
    assert [(r["parent_pos"], r["last_pos"]) for r in tree.nodes(df, levels=9).orderBy("pos").collect()] == [(None, 3), (1, 2), (1, 3)]


def test_index_files_round_trip(spark, tmp_path, random_docs):
    docs, df = random_docs
    few = df.where("doc_name < 'd13'")
    nodes = tree.nodes(markdown.sections(few))
    from pyspark.sql import functions as F

    nodes = nodes.withColumn("summary", F.when(F.col("pos") % 2 == 0, "even \"s\"").otherwise(""))
    described = few.select("doc_name", F.lit("T").alias("title"), F.lit("d").alias("description"), F.lit("f.md").alias("source_file"), F.lit(3).alias("total_lines"))
    for r in tables.nested_json(described, nodes, contents=True).collect():
        (tmp_path / f"{r['doc_name']}_index.json").write_text(r["json"], encoding="utf-8")
    known, flat = tables.index_files(spark, str(tmp_path))
    columns = ["doc_name", "pos", "title", "level", "start_line", "end_line", "node_id", "summary", "content", "depth"]
    assert sorted(map(tuple, flat.select(columns).collect())) == sorted(map(tuple, nodes.select(columns).collect()))
    assert known.count() == few.count()


def test_deep_index_files_in_few_exchanges(spark):
    """Fifty levels, jumps up over many levels, and a document without nodes."""
    rng, rows, want = random.Random(5), [], {}
    for d in ("x", "y", "z"):
        depth, stack = 0, []
        for pos in range(1, 200):
            depth = 0 if pos == 1 else pos - 1 if d == "x" and pos <= 50 else rng.randrange(depth + 2)
            node = {"title": f't"{pos}', "node_id": f"{pos:04d}", "level": depth, "start_line": pos, "end_line": pos}
            stack = stack[:depth]
            (stack[-1].setdefault("children", []) if stack else want.setdefault(d, [])).append(node)
            stack.append(node)
            rows.append((d, pos, depth, *node.values(), "", ""))
    tree_rows = spark.createDataFrame(rows, "doc_name string, pos int, depth int, title string, node_id string, level int, start_line int, end_line int, summary string, content string")
    docs = spark.createDataFrame([(d, "T", "", "", 1) for d in ("x", "y", "z", "none")], "doc_name string, title string, description string, source_file string, total_lines int")
    nested = tables.nested_json(docs, tree_rows)
    assert nested._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    got = {r["doc_name"]: json.loads(r["json"])["nodes"] for r in nested.collect()}
    assert got == want | {"none": []}
    _, flat = tables.index_tables(nested)
    assert sorted((r["doc_name"], r["pos"], r["depth"]) for r in flat.collect()) == sorted(r[:3] for r in rows)


def test_markdown_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.md").write_bytes(b"# A\r\nx\r\n")
    (tmp_path / "sub" / "c.txt").write_text("# C")
    (tmp_path / "skip.json").write_text("{}")
    assert sorted((r["doc_name"], r["content"]) for r in tables.markdown_files(spark, str(tmp_path)).collect()) == [("a b", "# A\nx\n"), ("c", "# C")]


def plain_toc(text):
    """A table of contents by a walk over lines, with the library's patterns as Python reads them."""
    py = lambda p: re.compile(re.sub(r"\(\?[a-zA-Z]+\)", "", p).replace("\\z", "\\Z"))
    all_lines = text.split("\n")
    for n, x in enumerate(all_lines[: toc.MARKER_LINES], 1):
        if re.match(r"\s*\[toc\]\s*\Z", x, re.I):
            return "marker", n, n, None
    titles = [re.compile(t.replace("\\z", "\\Z"), re.I) for t in toc.TITLES]
    start = next((n for n, x in enumerate(all_lines, 1) if any(t.search(x.strip()) for t in titles)), None)
    for kind, patterns in (("links", [py(toc.LINK)]), ("text", [py(toc.NUMBERED), py(toc.DOTTED)])):
        found = []
        for x in all_lines[start:] if start else []:
            hit = next((m for m in (p.search(x) for p in patterns) if m), None)
            if hit:
                found.append((hit[2] if hit.re is py(toc.NUMBERED) else hit[1]).strip())
            elif found and re.search(toc.HEADING.replace("(?U)", ""), x):
                break
        if len(found) >= 3:
            return kind, start, (start + len(found) + 1 if start > 1 else len(found) + 1), found
    return None


def test_tables_of_contents_against_a_walk(spark):
    rng = random.Random(8)
    some = ["# Contents", "Table of  Contents", "## toc", "目录", "- [A](#a)", "  - [B b](#b)", "* [C](c)", "[D](d)", "1. One", "1.2. Two ... 7", "Intro .... 3", "Body ..... 12", "# Intro", "## B", "", "  ", "plain text", "[E](e) more"]
    texts = ["", "x", " [TOC] ", "\n" * 99 + "[toc]", "\n" * 100 + "[toc]", "# toc\n# [A](a)\n- [A](a)\n- [A](a)\n- [B](b)"]
    texts += ["\n".join(rng.choice(some + ["[TOC]"] * (k % 9 == 0)) for _ in range(rng.randrange(30))) for k in range(600)]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("none", None)], "doc_name string, content string")
    got = {r["doc_name"]: (r["kind"], r["start_line"], r["end_line"], r["entries"] and [e["title"] for e in r["entries"]]) for r in toc.detect(df).collect()}
    want = {str(k): t for k, t in enumerate(map(plain_toc, texts)) if t}
    assert len({k for k, *_ in want.values()}) == 3 and got == want
