"""Sandbox, listing, tools, command line, streams."""

from __future__ import annotations

import io
import json
import os
import sys

import pytest

import samples
from arbora import cli
from arbora.engine import Engine
from arbora.sources.files import Roots
from arbora.streaming.ingest import ingest
from arbora.tools import Service


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "b.txt").write_text("bee")
    (root / "a.txt").write_text("ay")
    (root / "sub" / "c.txt").write_text("sea")
    (tmp_path / "out.txt").write_text("outside")
    os.symlink(tmp_path / "out.txt", root / "link.txt")
    return root


def test_sandbox(tree):
    roots = Roots([str(tree)])
    assert roots.secure("a.txt") == str((tree / "a.txt").resolve())
    for bad in ("../out.txt", "link.txt", str(tree.parent / "out.txt")):
        with pytest.raises(PermissionError):
            roots.secure(bad)
    with pytest.raises(ValueError, match="directory"):
        Roots([str(tree / "a.txt")])


def test_listing(tree):
    roots = Roots([str(tree)])
    names = lambda r: [f["relative_path"] for f in r["files"]]
    assert names(roots.list_files(".")) == ["a.txt", "b.txt"]
    assert names(roots.list_files(".", True)) == ["a.txt", "b.txt", "sub/c.txt"]
    cut = roots.list_files(".", True, 1)
    assert cut["truncated"]
    assert len(cut["files"]) == 1
    for bad in (-1, 2001):
        with pytest.raises(ValueError, match="limit"):
            roots.list_files(".", limit=bad)
    with pytest.raises(NotADirectoryError):
        roots.list_files("a.txt")


def test_tools(spark, tmp_path):
    (tmp_path / "beds.csv").write_bytes(samples.CSV)
    (tmp_path / "all.zip").write_bytes(samples.FILES["all.zip"][0])
    s = Service(spark, [str(tmp_path)], most=2)
    beds = s.artifact_inspect("beds.csv")
    assert beds["format"] == "csv"
    hit = s.artifact_find(beds["artifact_id"], "north")[0]
    assert s.artifact_read(beds["artifact_id"], hit["node_id"])["text"] == "north"
    assert [t["kind"] for t in s.artifact_get_provenance(beds["artifact_id"], hit["node_id"])["trail"]] == ["document", "table", "row", "cell"]
    assert s.artifact_extract_table(beds["artifact_id"])["total_rows"] == 3
    zipped = s.artifact_inspect("all.zip")
    uri = s.artifact_list_attachments(zipped["artifact_id"])[0]["uri"]
    assert s.artifact_read(resource_uri=uri, offset=6, limit=3)["text"] == "the"
    assert s.artifact_inspect_resource(uri)["name"] == "docs/readme.txt"
    with pytest.raises(KeyError):  # forgotten, as only two are kept
        s.artifact_find(beds["artifact_id"], "north")
    with pytest.raises(ValueError, match="exactly one"):
        s.artifact_read(zipped["artifact_id"])
    assert len(s.artifact_formats()) == 21
    assert [f["relative_path"] for f in s.artifact_list_files()["files"]] == ["all.zip", "beds.csv"]


def test_cli(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "pump.md"
    path.write_bytes(samples.MARKDOWN)
    assert cli.main(["inspect", str(path), "--pretty"]) == 0
    assert json.loads(capsys.readouterr().out)["format"] == "markdown"
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b"a worn seal")))
    assert cli.main(["find", "-", "seal"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["snippet"] == "a worn seal"
    assert cli.main(["formats"]) == 0
    assert cli.main(["version"]) == 0
    assert cli.main(["inspect", str(tmp_path / "nothing")]) == 1
    assert cli.main(["wrong"]) == 2


def test_stream_appends_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.md").write_bytes(samples.MARKDOWN)
    (source / "copy.md").write_bytes(samples.MARKDOWN)
    engine = Engine(spark)
    ingest(engine, str(source), str(target), str(tmp_path / "check")).awaitTermination()
    (source / "b.csv").write_bytes(samples.CSV)
    ingest(engine, str(source), str(target), str(tmp_path / "check")).awaitTermination()
    formats = sorted(r.format for r in spark.read.parquet(f"{target}/artifacts").collect())
    assert formats == ["csv", "markdown"]
    assert spark.read.parquet(f"{target}/nodes").filter("kind = 'section'").count() == 3


def test_tools_over_lines(spark, tmp_path):
    from arbora import stdio

    (tmp_path / "beds.csv").write_bytes(samples.CSV)
    service = Service(spark, [str(tmp_path)])
    call = lambda i, name, **arguments: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": arguments}}
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        call(3, "artifact_inspect", path="beds.csv"),
        call(4, "artifact_inspect", path="absent.csv"),
        call(5, "artifact_inspect", road="beds.csv"),
        call(6, "nothing"),
        {"jsonrpc": "2.0", "id": 7, "method": "other"},
        {"jsonrpc": "2.0", "id": 8, "method": "ping"},
        [],
    ]
    out = io.StringIO()
    stdio.serve(service, "1", io.StringIO("".join(json.dumps(x) + "\n" for x in asked) + "\n{nonsense\n"), out)
    found = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in found] == [1, 2, 3, 4, 5, 6, 7, 8, None, None]
    tools = found[1]["result"]["tools"]
    assert len(tools) == 9
    assert {t["name"]: t["inputSchema"]["required"] for t in tools}["artifact_find"] == ["reference", "query"]
    assert found[2]["result"]["structuredContent"]["format"] == "csv"
    assert found[3]["result"]["isError"]
    assert [found[i]["error"]["code"] for i in (4, 5, 6, 8, 9)] == [-32602, -32602, -32601, -32600, -32700]
    listed = stdio.answer(service, "1", call(9, "artifact_formats"))["result"]["structuredContent"]["items"]
    assert len(listed) == 21


def test_stored_bytes_are_bounded(spark, tmp_path):
    from arbora.model import Limits

    data = samples.FILES["all.zip"][0]
    for i in range(3):
        (tmp_path / f"{i}.zip").write_bytes(samples.zipped({f"{i}.txt": b"some text"}))
    (tmp_path / "a.csv").write_bytes(samples.CSV)
    s = Service(spark, [str(tmp_path)], Limits(max_stored_bytes=2 * len(samples.zipped({"0.txt": b"some text"})), max_input_bytes=max(1000, len(data))))
    ids = [s.artifact_inspect(x)["artifact_id"] for x in ("0.zip", "a.csv", "1.zip", "2.zip")]
    assert list(s.documents) == ids[1:]


def test_help(capsys):
    assert cli.main(["help"]) == 0
    assert "mcp" in capsys.readouterr().out
