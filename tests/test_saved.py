"""Documents saved below a folder."""

from heartwood.sources import tables


def test_saved_documents_share_files_and_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "x")
    docs = lambda k, n, text: spark.range(k, n).selectExpr("concat('d ', id, '/%20') AS doc_name", f"concat('{text}', id, '\\r\\n\\n') AS content")
    tables.write_markdown(docs(0, 400, "# a"), path)
    assert len(list((tmp_path / "x").rglob("part-*"))) <= tables.FOLDERS * tables.PARTS
    tables.write_markdown(docs(395, 405, "# b"), path)
    (tmp_path / "x" / "loose.md").write_text("# L", encoding="utf-8")
    got = {r["doc_name"]: r["content"] for r in tables.markdown_files(spark, path).collect()}
    assert got == {f"d {k}/%20": f"# {'ab'[k >= 395]}{k}\n\n" for k in range(405)} | {"loose": "# L"}
