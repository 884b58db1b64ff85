"""The engine over files and columns, and the questions asked of its tables."""

from __future__ import annotations

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

import samples
from arbora.engine import Engine, first_seen
from arbora.model import LimitError, Limits, is_zero, locator_string, node_id, path_string, resource_uri, uri_digest
from arbora.operators import breadcrumbs, extract_table, find, find_node, provenance, read_node, select_table, summarize, wide
from arbora.operators import resources as res
from arbora.operators.render import to_json, to_markdown


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, (data, _, _) in samples.FILES.items():
        (path / name).write_bytes(data)
    (path / "odd.bin").write_bytes(bytes([0, 1, 2, 3]))
    (path / "bad.json").write_bytes(b"{} {}")
    (path / "copy of pump.txt").write_bytes(samples.MARKDOWN)
    return path


@pytest.fixture(scope="module")
def corpus(spark, folder):
    return Engine(spark).inspect_path(str(folder))


def by_name(corpus, name):
    return corpus.artifacts.filter(F.col("name") == name).head()


def test_every_format_is_found_and_parsed(corpus):
    formats = {r.name: r.format for r in corpus.artifacts.collect()}
    first = {r.artifact_id: r.kind for r in corpus.nodes.filter("path = array(0)").collect()}
    for name, (data, fmt, kind) in samples.FILES.items():
        assert formats[name] == fmt, name
        # equal bytes show the first source's tree
        if name != "pump.md":
            assert first[f"sha256:{hashlib.sha256(data).hexdigest()}"] == kind, name


def test_errors_are_rows(corpus):
    errors = {r.name: r.error for r in corpus.errors.collect()}
    assert set(errors) == {"odd.bin", "bad.json"}
    assert errors["odd.bin"].stage == "detect"
    assert "parse JSON" in errors["bad.json"].message


def test_nodes_are_consistent(corpus):
    nodes = corpus.nodes.persist()
    assert nodes.count() == nodes.select("artifact_id", "path").distinct().count()
    lost = nodes.filter("parent_id is not null").join(nodes.select("artifact_id", F.col("node_id").alias("parent_id")), ["artifact_id", "parent_id"], "left_anti")
    assert lost.isEmpty()
    row = nodes.filter("kind = 'cell'").head()
    digest, path = row.artifact_id.removeprefix("sha256:"), "root" + "".join(f"/{i}" for i in row.path)
    assert row.node_id == "node_" + hashlib.sha256(f"{digest}\0cell\0{path}".encode()).hexdigest()[:20]


def test_strict_raises(spark):
    with pytest.raises(LimitError) as e:
        Engine(spark, Limits(max_input_bytes=3), strict=True).inspect_bytes([("a.txt", b"abcd")])
    assert (e.value.limit, e.value.value, e.value.max) == ("input bytes", 4, 3)
    with pytest.raises(ValueError, match="unsupported"):
        Engine(spark, strict=True).inspect_bytes([("a.bin", bytes([0, 1, 2, 3]))])
    with pytest.raises(ValueError, match="positive"):
        Limits(max_nodes=0)


def test_csv_cell_has_its_place(spark):
    c = Engine(spark).inspect_bytes([("beds.csv", samples.CSV)])
    cell = c.nodes.filter("name = 'B2'").head()
    span = cell.locator.byte_range
    assert samples.CSV[span.start : span.end] == b"north,12,ok\n"
    assert c.nodes.filter("name = 'B2'").select(locator_string(F.col("locator")).alias("s")).head().s == f"cell:B2#bytes:{span.start}-{span.end}"


def test_find(spark):
    c = Engine(spark).inspect_bytes([("config.json", samples.JSON)])
    hits = find(c.nodes, "gardener").collect()
    assert [h.locator.path for h in hits] == ["/agent/name"]
    assert find(c.nodes, "gardener missing").count() == find(c.nodes, "  ").count() == find(c.nodes, "x", 0).count() == 0
    rows = [("a", "n1", "paragraph", "", "Pump pump PUMP seal", {}), ("a", "n2", "section", "Pump", "seal", {}), ("a", "n3", "paragraph", "", "pump", {"k": "seal"}), ("a", "n0", "paragraph", "", "pump", {"seal": ""})]
    nodes = spark.createDataFrame(rows, "artifact_id string, node_id string, kind string, name string, text string, attributes map<string,string>")
    assert [(r.node_id, r.score) for r in find(nodes, "pump SEAL", -1).collect()] == [("n2", 42), ("n1", 24), ("n0", 22), ("n3", 22)]
    assert [r.node_id for r in find(nodes, "pump", 1, per="kind").orderBy("kind").collect()] == ["n1", "n2"]


def test_snippet_is_cut(spark):
    nodes = spark.createDataFrame([("a", "n", "paragraph", "", "x  " * 200)], "artifact_id string, node_id string, kind string, name string, text string")
    s = find(nodes, "x").head().snippet
    assert len(s) == 220
    assert s.endswith("...")


def test_read_node_windows(corpus):
    row = corpus.nodes.filter("text like 'Stopped%'").head()
    view = read_node(corpus.nodes, row.node_id, 8, 2).head()
    assert (view.text, view.offset, view.more) == ("at", 8, True)
    end = read_node(corpus.nodes, row.node_id, 9999).head()
    assert (end.text, end.offset, end.more) == ("", len(row.text), False)
    for bad in ((-1, 0), (0, -1), (0, 50_001)):
        with pytest.raises(ValueError, match="node"):
            read_node(corpus.nodes, row.node_id, *bad)
    top = read_node(corpus.nodes.filter(F.col("artifact_id") == row.artifact_id), row.parent_id).head()
    assert row.node_id in top.children
    assert find_node(corpus.nodes, row.node_id).count() == 1


def test_provenance(corpus):
    cell = corpus.nodes.filter("kind = 'cell' and locator.path like 'word/%' and name = 'B2'")
    row = provenance(corpus.nodes, cell).head()
    assert [(t.kind, t.name) for t in row.trail] == [("document", "brief.docx"), ("table", "Table 1"), ("row", "2"), ("cell", "B2")]
    assert breadcrumbs(corpus.nodes).count() == corpus.nodes.count()


def test_summary_and_outline_cap(spark):
    c = Engine(spark).inspect_bytes([("s.md", b"# a\n" * 250)])
    row = summarize(c.nodes, c.resources, c.warnings).head()
    assert (row.node_count, len(row.outline), row.resource_count) == (251, 200, 0)
    assert [o.position for o in row.outline] == list(range(1, 201))


def test_tables(spark, corpus):
    c = Engine(spark).inspect_bytes([("beds.csv", samples.CSV)])
    row = extract_table(c.nodes, "", 1, 1).head()
    assert [x.value for x in row.columns] == ["bed", "depth", "state"]
    assert [[x.value for x in r] for r in row.rows] == [["south", "7", "dry"]]
    assert (row.offset, row.total_rows, row.more) == (1, 3, True)
    late = extract_table(c.nodes, "BEDS.csv", 99).head()
    assert (late.offset, late.rows, late.more) == (3, [], False)
    for bad in ((-1, 0), (0, 501)):
        with pytest.raises(ValueError, match="table"):
            extract_table(c.nodes, "", *bad)
    assert select_table(c.nodes, "nothing").isEmpty()
    assert {(r.A, r.C) for r in wide(c.nodes, "", ["A", "C"]).collect()} == {("north", "ok"), ("south", "dry"), ("west", "ok")}
    sheet = corpus.nodes.filter("kind = 'sheet'").head()
    assert select_table(corpus.nodes, sheet.node_id).head().name == "Beds"


def test_resources(spark, corpus):
    uri = corpus.resources.filter("name = 'docs/readme.txt'").head().uri
    part = res.read_resource(corpus, uri, 10, 8).head()
    assert (bytes(part.data), part.eof, part.size) == (b"northern", False, 28)
    assert res.read_resource(corpus, uri, 99).head().eof
    for bad in ((uri, -1, 0), (uri, 0, (16 << 20) + 1), ("artifact://x/y", 0, 0)):
        with pytest.raises(ValueError, match="resource"):
            res.read_resource(corpus, *bad)
    wanted = {"docs/readme.txt": b"Water the northern bed daily", "metrics/status.csv": samples.CSV, "report.txt": b"seals are in the shed", "beds.json": b'{"a": 1}', "pixel.png": samples.png()}
    whole = res.read_all(corpus).collect()
    assert all(r.error is None for r in whole)
    assert {r.name: bytes(r.data) for r in whole if r.name in wanted} == wanted
    assert res.read_all(corpus, max_bytes=5).filter("error is null").isEmpty()
    seen = {r.name: r for r in res.content_view(res.read_all(corpus)).collect()}
    assert seen["beds.json"].text == '{"a": 1}'
    assert base64.b64decode(seen["pixel.png"].base64) == samples.png()


def test_nested_inspection(spark):
    inner = samples.zipped({"deep/note.txt": b"far below"})
    engine = Engine(spark)
    c = engine.inspect_bytes([("outer.zip", samples.zipped({"in.zip": inner, "top.txt": b"above"}))])
    one = res.inspect_resources(engine, c)
    assert {(r.name, r.format) for r in one.artifacts.collect()} == {("in.zip", "zip"), ("top.txt", "text")}
    two = res.inspect_resources(engine, c, depth=2)
    assert "far below" in {r.text for r in two.nodes.collect()}
    with pytest.raises(LimitError, match="archive depth"):
        res.inspect_resources(engine, c, depth=5)


def test_rendering(corpus):
    ids = {r.name: r.artifact_id for r in corpus.artifacts.collect()}
    text = {r.artifact_id: r.rendered for r in to_markdown(corpus).collect()}
    assert "| bed | depth | state |\n| --- | --- | --- |\n| north | 12 | ok |\n" in text[ids["beds.csv"]]
    assert "- **agent**\n  - **agent**\n    - **name:** gardener\n" in text[ids["config.json"]]
    assert "- `docs/readme.txt` (size=28)\n" in text[ids["all.zip"]]
    assert "![A bed](a.png)\n" in text[ids["page.html"]]
    assert "# Spring\n" in text[ids["deck.pptx"]]
    made = {r.artifact_id: json.loads(r.rendered) for r in to_json(corpus, True).collect()}
    tree = made[ids["brief.docx"]]
    assert tree["root"]["children"][0]["name"] == "Beds"
    assert tree["resources"][0]["locator"] == {"path": "word/media/pixel.png"}
    assert made[ids["config.json"]]["root"]["children"][0]["kind"] == "object"


def test_identity_columns(spark):
    row = spark.range(1).select(
        path_string(F.array(F.lit(0), F.lit(12))).alias("p"),
        node_id(F.lit("d"), F.lit("row"), F.array(F.lit(0))).alias("n"),
        resource_uri(F.lit("d"), F.lit("a/b"), F.lit("x y/ü*~$&+=:@(")).alias("u"),
        resource_uri(F.lit("d"), F.lit(" "), F.lit("x")).alias("v"),
        uri_digest(F.lit(f"artifact://{'a' * 64}/entry/x")).alias("g"),
        uri_digest(F.lit(f"artifact://{'A' * 64}/entry/x")).alias("h"),
    )
    r = row.head()
    assert r.p == "root/0/12"
    assert r.n == "node_" + hashlib.sha256(b"d\0row\0root/0").hexdigest()[:20]
    assert r.u == "artifact://d/a-b/x%20y%2F%C3%BC%2A~$&+=:@%28"
    assert (r.v, r.g, r.h) == ("artifact://d/resource/x", "a" * 64, None)


def test_empty_locators(spark):
    df = spark.createDataFrame([(None,), ((None, "", None, 0, None, None, None),), (("p", None, None, None, None, None, None),)], "l struct<path:string,subpath:string,page:int,slide:int,sheet:string,cell:string,byte_range:struct<start:bigint,end:bigint>>")
    assert [r.z for r in df.select(is_zero(F.col("l")).alias("z")).collect()] == [True, True, False]


def test_first_seen(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "artifact_id string, n int")
    assert sorted((r.artifact_id, r.n) for r in first_seen(df, ["n"]).collect()) == [("x", 1), ("y", 3)]


def test_save_and_stats(spark, corpus, tmp_path):
    corpus.save(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/nodes").count() == corpus.nodes.count()
    s = corpus.stats().head()
    assert s.artifacts == corpus.resources.select("artifact_id").distinct().count()


def test_pushdown_reaches_the_scan(spark, folder):
    from arbora.sources.files import binary_files, listing

    plan = binary_files(spark, str(folder)).filter("length <= 10")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan
    assert "LessThanOrEqual(length,10)" in plan
    assert "content" not in listing(spark, str(folder))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_equal_bytes_have_one_tree(spark):
    c = Engine(spark).inspect_bytes([("b.txt", b"same"), ("a.md", b"same")])
    assert c.artifacts.count() == 2
    assert [(r.kind, r.name) for r in c.nodes.orderBy("path").collect()] == [("document", "b.txt"), ("paragraph", "")]


def test_nodes_by_source_show_equal_bytes_for_each(spark):
    c = Engine(spark).inspect_bytes([("a.txt", b"one"), ("b.txt", b"one"), ("a.txt", b"two"), ("bad.json", b"{")])
    rows = c.source_nodes.collect()
    assert sorted((r.source_path[-1], r.kind, r.name, r.text) for r in rows) == [("0", "document", "a.txt", ""), ("0", "paragraph", "", "one"), ("1", "document", "b.txt", ""), ("1", "paragraph", "", "one"), ("2", "document", "a.txt", ""), ("2", "paragraph", "", "two")]
    assert {r.artifact_id for r in rows} == {r.artifact_id for r in c.nodes.collect()}


def test_trees_are_rendered_where_they_are_parsed(spark):
    from arbora.operators.render import source_json, source_markdown

    c = Engine(spark).inspect_bytes([("a.yaml", b"k: [1, {x: y}]\n"), ("b.yaml", b"k: [1, {x: y}]\n"), ("bad.json", b"{"), ("odd.bin", b"\0\1")])
    body = "- **k**\n  - **k**\n    - 1\n    - **1**\n      - **x:** y\n"
    assert sorted((r.source_path[-1], r.rendered) for r in source_markdown(c).collect()) == [("0", f"# a.yaml\n\n{body}"), ("1", f"# b.yaml\n\n{body}")]
    assert [r.rendered for r in to_markdown(c).collect()] == [f"# a.yaml\n\n{body}"]
    ids = {(tuple(r.path), r.kind): r.node_id for r in c.nodes.collect()}

    def walk(node, path=()):
        assert ids.pop((path, node["kind"])) == node["id"]
        for i, x in enumerate(node.get("children", [])):
            walk(x, (*path, i))

    walk(json.loads(to_json(c).head().rendered)["root"])
    assert not ids
    for df in (source_markdown(c), source_json(c)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert "Exchange" not in plan


def test_nested_corpora_are_rendered(spark):
    engine = Engine(spark)
    c = engine.inspect_bytes([("outer.zip", samples.zipped({"in.zip": samples.zipped({"deep/note.txt": b"far below"}), "top.txt": b"above"}))])
    text = sorted(r.rendered for r in to_markdown(res.inspect_resources(engine, c, depth=2)).collect())
    assert [t.split("\n")[0] for t in text] == ["# deep/note.txt", "# in.zip", "# top.txt"]
    assert text[0].endswith("far below\n\n")
