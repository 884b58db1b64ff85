"""Each registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from arbora.plans import catalog, composed

QUERIES = catalog.QUERIES | composed.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | composed.ORACLE_SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows
    if name not in ORACLE_SQL:
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(str(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in order) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_paragraph_columns_agree_with_the_reader(spark):
    from arbora.formats import plain
    from arbora.formats.tree import Source
    from arbora.model import Limits
    from arbora.operators.paragraphs import markdown_blocks, paragraphs

    texts = ["", "\n", "a", "a\n\n\nb\r\n \t\nc\n", "# t ##\nx\ny\n\nz\n## u\n", "pre\n# h\nq\n####### no\n\n#also no", "\r\n\r\né\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {(r.doc_id, r.paragraph): (r.text, r.start, r.end) for r in paragraphs(df).collect()}
    blocks = {(r.doc_id, tuple(r.path)): (r.kind, r.name, r.text, r.level, r.start, r.end) for r in markdown_blocks(df).collect()}
    for i, t in enumerate(texts):
        flat = plain.read(Source("a.txt", t.encode()), Limits()).root.children
        assert {k[1]: v for k, v in spans.items() if k[0] == i} == {j: (n.text, *n.locator["byte_range"].values()) for j, n in enumerate(flat)}
        tree = plain.read(Source("a.md", t.encode()), Limits()).root
        want = {p: (n.kind, n.name, n.text, n.level, *n.locator["byte_range"].values()) for p, _, n in tree.walk() if p}
        assert {k[1]: v for k, v in blocks.items() if k[0] == i} == want


def test_rows_that_share_a_key_or_have_none_keep_their_own_nodes(spark):
    from arbora.operators.paragraphs import document_nodes, line_spans, markdown_blocks, paragraphs

    long = "\n\n".join(f"part {i}\nof it" for i in range(900))
    data = [(1, "a\nb"), (1, "c\n\nd"), (None, "e"), (None, None), (2, "# t\nx\n\ny"), (3, long), (4, "")]
    df = spark.createDataFrame(data, "doc_id int, text string")
    assert sorted((r.doc_id or 0, r.text) for r in paragraphs(df).filter("doc_id is null or doc_id < 2").collect()) == [(0, "e"), (1, "a\nb"), (1, "c"), (1, "d")]
    assert sorted((r.doc_id or 0, r.line, r.text) for r in line_spans(df).filter("doc_id is null or doc_id < 2").collect()) == [(0, 0, "e"), (1, 0, "a"), (1, 0, "c"), (1, 1, ""), (1, 1, "b"), (1, 2, "d")]
    spans = paragraphs(df).filter("doc_id = 3").orderBy("paragraph").collect()
    assert [long[r.start : r.end] for r in spans] == [r.text for r in spans] == [f"part {i}\nof it" for i in range(900)]
    assert [(r.path, r.name, r.text) for r in markdown_blocks(df).filter("doc_id = 2").orderBy("path").collect()] == [([0], "t", ""), ([0, 0], "", "x"), ([0, 1], "", "y")]
    assert document_nodes(df).filter("kind = 'document'").count() == len(data)
    for plan in (paragraphs(df), line_spans(df), markdown_blocks(df), document_nodes(df)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_search_tests_tokens_before_it_cuts_texts_up(spark):
    plan = QUERIES["find_ranked"](spark, DIR)._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("filescan") == 1
    assert plan.rindex("contains(") > plan.rindex("generate ")


def test_long_runs_of_white_space_and_snippets(spark):
    from pyspark.sql import functions as F

    from arbora.operators import snippet

    texts = [" " * 5000 + "a" + "\n\t " * 3000 + "b", "x" * 220, "x" * 221, "y " * 300, "", "  \n", "é" * 219 + "  z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.s for r in df.select(snippet(F.col("t"), F.lit(" the  name ")).alias("s")).collect()]
    want = [" ".join(t.split()) or "the name" for t in texts]
    assert found == [w if len(w) <= 220 else w[:217] + "..." for w in want]


@pytest.mark.parametrize("name", ["html_tables", "csv_nodes", "mail_nodes", "docx_nodes"])
def test_nodes_of_a_query_are_parsed_once_on_all_cores(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    parsed = [x for x in plan.splitlines() if "MapInArrow" in x and "parent_kind" in x]
    assert len(parsed) == 1
    assert "Join" not in plan
    assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan


def test_pictures_wider_than_a_gif_are_cut_into_strips(spark, tmp_path):
    keys = [0, 1, 65533, 65534, 65535, 65536, 65537, 131069, 131071, 196603, 1199999, 1199999]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE part AS SELECT unnest({keys})::BIGINT AS p_partkey, 7::INTEGER AS p_size")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    want = con.execute(f"SELECT id, format, media_type, locator, attributes FROM ({ORACLE_SQL['picture_nodes']})").fetchall()
    found = QUERIES["picture_nodes"](spark, str(tmp_path)).select("id", "format", "media_type", "locator", "attributes").collect()
    assert sorted(map(tuple, found)) == sorted(want)
