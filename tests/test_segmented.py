"""Documents in parts against the same ones in one piece."""

import random
import re

import pytest

from heartwood.operators import markdown, segmented, tree

COLUMNS = ["doc_name", "pos", "node_id", "title", "level", "start_line", "end_line", "parent_id", "depth", "path", "last_pos"]
LINES = ["# A", "## B", "### C", "###### F", "text", "", "```", "   ```py", "Title", "===", "---", "- item", "==", "a\r", "# x #", "####### no"]


def parted(rng, docs):
    """The documents cut into parts of one to six lines."""
    rows = []
    for name, content in docs.items():
        lines, at, k = content.split("\n"), 0, 0
        while at < len(lines):
            n = rng.randrange(1, 7)
            rows.append((name, k, "\n".join(lines[at : at + n])))
            at, k = at + n, k + rng.randrange(1, 3)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_equal_the_whole(spark, seed):
    rng = random.Random(seed)
    docs = {f"d{k}": "\n".join(rng.choice(LINES if k % 3 else ["Title", "===", "===", "x"]) for _ in range(rng.randrange(1, 60))) for k in range(60)}
    docs |= {"empty": "", "plain": "no\nheading", "under": "A\n" + "\n".join(["==="] * 23) + "\nB"}
    whole = spark.createDataFrame(list(docs.items()), "doc_name string, content string")
    parts = spark.createDataFrame(parted(rng, docs), "doc_name string, part int, content string").repartition(5)
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*COLUMNS).collect())))
    assert rows(segmented.nodes(segmented.sections(parts))) == rows(tree.nodes(markdown.sections(whole, contents=False)))


def test_no_window_holds_more_than_a_part(spark):
    """Windows over rows are by part; those by document alone are over summaries."""
    parts = spark.createDataFrame([("d", k, f"# T{k}\n" + "## S\ntext\n" * 50 + "end") for k in range(200)], "doc_name string, part int, content string")
    found = segmented.nodes(segmented.sections(parts))
    assert found.count() == 200 * 51 and found.where("parent_pos IS NOT NULL").count() == 200 * 50
    plan = found._jdf.queryExecution().analyzed().toString()
    by_row = [w for w in re.findall(r"windowspecdefinition\(([^)]*)", plan) if "pos#" in w]
    assert by_row and all(re.search(r"doc_name#\d+, part#\d+", w) for w in by_row)
