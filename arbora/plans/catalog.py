"""Registered queries over the driver's tables, and SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.engine import Engine, first_seen
from arbora.functions.detect import detections, formats, media_type
from arbora.functions.text import cell_name, column_letters, escape_pointer
from arbora.model import LOCATOR, Limits, identified, locator_string, resource_uri
from arbora.operators import extract_table, find, provenance, read_node, snippet
from arbora.operators.limits import audit
from arbora.operators.outline import summarize
from arbora.operators.paragraphs import document_nodes, line_spans, markdown_blocks, paragraphs
from arbora.operators.render import markdown_lines
from arbora.operators.search import may_hold

QUERY = "the idiot"
AUDIT = Limits(max_nodes=5, max_text_bytes=4000)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated texts, the smallest id of each."""
    docs = _docs(spark, sf_dir).withColumn("artifact_id", F.sha2(F.coalesce("text", F.lit("")), 256))
    return first_seen(docs, ["doc_id"]).drop("artifact_id")


def artifact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("artifact_id"), F.octet_length(text).cast("bigint").alias("size"))


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_nodes(_docs(spark, sf_dir)).select("doc_id", "node_id", "parent_id", "kind", "depth", "ordinal")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spans(_docs(spark, sf_dir)).select("doc_id", "line", "text", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(_docs(spark, sf_dir)).select("doc_id", "paragraph", "text", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under a heading of its language, its lines as paragraphs."""
    marked = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# "), F.coalesce("lang", F.lit("?")), F.lit(" ##\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return markdown_blocks(marked).select("doc_id", F.array_join("path", "/").alias("path"), "kind", "name", "level", F.sha2("text", 256).alias("text_sha256"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


def _hopeful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that can hold a node with all tokens."""
    return _docs(spark, sf_dir).filter(may_hold(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")), QUERY))


def find_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best paragraphs for two tokens."""
    return find(document_nodes(_hopeful(spark, sf_dir)), QUERY, 20).withColumn("locator", locator_string(F.col("locator")))


def find_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each source."""
    return find(document_nodes(_hopeful(spark, sf_dir), keep=["source"]), QUERY, 3, per="source").select("source", "node_id", "score")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", snippet(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("snippet"))


def read_node_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters 100 to 300 of every node, with its children."""
    view = read_node(document_nodes(_distinct(spark, sf_dir)).withColumn("attributes", F.lit(None).cast("map<string,string>")), None, 100, 200)
    return view.select("node_id", "kind", "text", F.col("offset").alias("at"), "more", F.array_join("children", ",").alias("children"))


def dedupe_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(artifact_ids(spark, sf_dir), ["doc_id"])


def limits_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(document_nodes(_docs(spark, sf_dir)), AUDIT, "doc_id").select("doc_id", "nodes", "text_bytes", F.col("limit").alias("over"))


def locator_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_nodes(_docs(spark, sf_dir)).filter("kind = 'paragraph'").select("doc_id", "node_id", locator_string(F.col("locator")).alias("locator"))


def resource_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", resource_uri(F.sha2("html", 256), F.lit("entry"), F.col("url")).alias("uri"))


def json_pointer_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), escape_pointer(F.col("url"))).alias("pointer"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the events' JSON objects, read in the JVM."""
    fields = _table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return fields.select("event_id", F.concat(F.lit("/"), escape_pointer(F.col("key"))).alias("pointer"), "key", "value")


def json_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each kind in the trees of the events' different JSON texts."""
    corpus = Engine(spark).inspect_column(_table(spark, sf_dir, "events").select("props").distinct(), "props", F.lit("event.json"))
    return corpus.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("attributes")["type"] == "number", 1)).alias("numbers"))


def _html(spark: SparkSession, sf_dir: str):
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html"))
    return Engine(spark).inspect_column(_table(spark, sf_dir, "pages"), "html", name, F.col("page_id").cast("string"))


def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of all pages."""
    return _html(spark, sf_dir).nodes.select("artifact_id", "node_id", F.array_join("path", "/").alias("path"), "kind", "name", "text", "level", locator_string(F.col("locator")).alias("locator"))


def html_title_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and first heading of each page."""
    corpus = _html(spark, sf_dir)
    heads = corpus.nodes.filter("kind = 'section' and level = 1").groupBy("artifact_id").agg(F.min_by("name", "path").alias("heading"))
    pages = corpus.artifacts.select("artifact_id", F.col("source_path").cast("bigint").alias("page_id"), F.col("metadata")["title"].alias("title"))
    return pages.join(heads, "artifact_id", "left").select("page_id", "title", "heading")


def detect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning parser for each document under four names, and for each page without one."""
    ext = F.element_at(F.array(F.lit(".txt"), F.lit(".md"), F.lit(".csv"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("document").alias("what"), F.concat(F.lit("doc"), ext).alias("name"), F.coalesce("text", F.lit("")).alias("body"))
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("what"), F.lit("page").alias("name"), F.coalesce("html", F.lit("")).alias("body"))
    rows = docs.unionByName(pages).withColumn("content", F.col("body").cast("binary"))
    best = detections(F.col("name"), F.col("content"), media_type(F.col("name"), F.col("content")), text=F.col("body"))
    return rows.select("what", "id", best.alias("found")).select("what", "id", F.col("found")[0]["parser"].alias("parser"), F.col("found")[0]["score"].alias("score"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees: a section for each turn, its text below."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    digest, here = F.sha2(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), 256), F.lit(None).cast(LOCATOR)
    common = [digest.alias("digest"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("artifact_id"), here.alias("locator")]
    root = rows.select("conv_id").distinct().select(*common, F.array().cast("array<int>").alias("path"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("parent_kind"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("name"), F.lit("").alias("text"), F.lit(0).alias("level"))
    turns = rows.select(*common, F.array("turn").alias("path"), F.lit("section").alias("kind"), F.lit("document").alias("parent_kind"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("name"), F.lit("").alias("text"), F.lit(1).alias("level"))
    said = rows.select(*common, F.array(F.col("turn"), F.lit(0)).alias("path"), F.lit("paragraph").alias("kind"), F.lit("section").alias("parent_kind"), F.lit("").alias("name"), "text", F.lit(0).alias("level"))
    return identified(root.unionByName(turns).unionByName(said))


def outline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summarize(_conversations(spark, sf_dir))
    return found.select("artifact_id", "node_count", F.size("outline").cast("bigint").alias("entries"), F.col("outline")[0]["name"].alias("first"), F.element_at("outline", -1)["name"].alias("last"))


def provenance_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _conversations(spark, sf_dir)
    found = provenance(nodes, nodes.filter("kind = 'paragraph'"))
    return found.select("artifact_id", "node_id", F.array_join(F.transform("trail", lambda x: F.concat(x["kind"], F.lit(":"), x["name"])), " > ").alias("trail"))


def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _conversations(spark, sf_dir).filter("depth > 0")
    line = F.struct("path", markdown_lines(F.col("kind"), F.col("name"), F.col("text"), F.col("level")).alias("line"))
    body = nodes.groupBy("artifact_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return body.select("artifact_id", F.concat(F.lit("# "), F.col("artifact_id"), F.lit("\n\n"), F.array_join("lines.line", "")).alias("markdown"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a grid with cell names."""
    rows = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).alias("row"), F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))).alias("column", "value"))
    return rows.select(cell_name(F.col("column") + 1, F.col("row")).alias("cell"), "value")


def spreadsheet_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", column_letters(F.col("p_partkey") + 1).alias("letters"))


def table_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 101 to 150 of the customers as a table in a tree; keys count from 0 without gaps, so they place the rows."""
    digest = F.sha2(F.lit("customer"), 256)
    rows = _table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("int").alias("n"), F.col("c_custkey").cast("string").alias("a"), F.col("c_name").alias("b"), F.col("c_mktsegment").alias("c"))
    head = spark.createDataFrame([(0, "key", "name", "segment")], "n int, a string, b string, c string")
    grid = head.unionByName(rows)
    base = [F.lit("customer").alias("artifact_id"), digest.alias("digest"), F.lit(None).cast(LOCATOR).alias("locator"), F.lit(None).cast("map<string,string>").alias("attributes")]
    top = spark.range(1).select(*base, F.array(F.lit(0)).alias("path"), F.lit("table").alias("kind"), F.lit("document").alias("parent_kind"), F.lit("customer").alias("name"), F.lit("").alias("text"))
    body = grid.select(*base, F.array(F.lit(0), F.col("n")).alias("path"), F.lit("row").alias("kind"), F.lit("table").alias("parent_kind"), (F.col("n") + 1).cast("string").alias("name"), F.lit("").alias("text"))
    cells = grid.select("n", F.posexplode(F.array("a", "b", "c")).alias("p", "value")).select(*base, F.array(F.lit(0), F.col("n"), F.col("p")).alias("path"), F.lit("cell").alias("kind"), F.lit("row").alias("parent_kind"), cell_name(F.col("p") + 1, F.col("n") + 1).alias("name"), F.col("value").alias("text"))
    found = extract_table(identified(top.unionByName(body).unionByName(cells)), "CUSTOMER", 100, 50)
    rows = found.select("total_rows", "more", F.col("columns.value").alias("header"), F.posexplode("rows").alias("i", "cells"))
    return rows.select((F.col("i") + 101).alias("row"), F.array_join("header", ",").alias("header"), F.array_join("cells.value", ",").alias("row_values"), "total_rows", "more")


def formats_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats(spark).select("name", "media_type", F.array_join("extensions", " ").alias("extensions"))


QUERIES = {
    "find_ranked": find_ranked,
    "artifact_ids": artifact_ids,
    "node_ids": node_ids,
    "line_spans": lines,
    "paragraphs": paragraph_spans,
    "markdown_sections": markdown_sections,
    "find_topk_per_source": find_topk_per_source,
    "snippets": snippets,
    "read_node_window": read_node_window,
    "dedupe_by_digest": dedupe_by_digest,
    "limits_audit": limits_audit,
    "locator_strings": locator_strings,
    "resource_uris": resource_uris,
    "json_pointer_escape": json_pointer_escape,
    "json_fields": json_fields,
    "json_kind_counts": json_kind_counts,
    "html_nodes": html_nodes,
    "html_title_heading": html_title_heading,
    "detect_scores": detect_scores,
    "outline_summary": outline_summary,
    "provenance_trail": provenance_trail,
    "markdown_render": markdown_render,
    "table_cells": table_cells,
    "spreadsheet_letters": spreadsheet_letters,
    "table_window": table_window,
    "formats_catalog": formats_catalog,
}

_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ID = "'node_' || substr(sha256({digest} || chr(0) || '{kind}' || chr(0) || {path}), 1, 20)"


def _lines(source: str = "SELECT doc_id, coalesce(text, '') AS t FROM documents") -> str:
    return f"""src AS ({source}),
        raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line FROM src),
        spans AS (SELECT doc_id, line, raw, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
                         row_number() OVER (PARTITION BY doc_id ORDER BY line DESC) AS last FROM raw),
        lines AS (SELECT doc_id, CAST(line AS INTEGER) AS line, regexp_replace(raw, '\\r$', '') AS text, CAST(s AS BIGINT) AS start_byte, CAST(s + strlen(raw) AS BIGINT) AS end_byte
                  FROM spans WHERE NOT (last = 1 AND raw = ''))"""


def _paragraphs(source: str = "SELECT doc_id, coalesce(text, '') AS t FROM documents") -> str:
    return f"""{_lines(source)},
        marked AS (SELECT *, CASE WHEN regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') = '' THEN 1 ELSE 0 END AS blank FROM lines),
        islands AS (SELECT *, sum(blank) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM marked),
        joined AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS text, min(start_byte) AS start_byte, max(end_byte) AS end_byte FROM islands WHERE blank = 0 GROUP BY doc_id, island),
        paras AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_byte) - 1 AS INTEGER) AS paragraph, text, start_byte, end_byte FROM joined)"""


def _nodes(source: str = "SELECT doc_id, coalesce(text, '') AS t FROM documents") -> str:
    root, para = _ID.format(digest="sha256(t)", kind="document", path="'root'"), _ID.format(digest="sha256(t)", kind="paragraph", path="'root/' || paragraph")
    return f"""{_paragraphs(source)},
        nodes AS (SELECT doc_id, 'sha256:' || sha256(t) AS artifact_id, {root} AS node_id, NULL AS parent_id, 'document' AS kind, 0 AS depth, 0 AS ordinal,
                         'doc-' || doc_id || '.txt' AS name, '' AS text, '' AS locator FROM src
                  UNION ALL
                  SELECT p.doc_id, 'sha256:' || sha256(t), {para}, {root}, 'paragraph', 1, paragraph, '', p.text, 'bytes:' || start_byte || '-' || end_byte
                  FROM paras p JOIN src USING (doc_id))"""


def _found() -> str:
    count = "((length(hay) - length(replace(hay, '{t}', ''))) // length('{t}'))"
    tokens = QUERY.split()
    return f"""hay AS (SELECT *, lower(regexp_replace(name || ' ' || text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS hay FROM nodes),
        found AS (SELECT *, CAST({" + ".join(f"10 + {count.format(t=t)} + CASE WHEN lower(name) = '{t}' THEN 20 ELSE 0 END" for t in tokens)} AS INTEGER) AS score
                  FROM hay WHERE {" AND ".join(f"contains(hay, '{t}')" for t in tokens)})"""


def _snippet(text: str, name: str) -> str:
    value = f"regexp_replace(regexp_replace(CASE WHEN regexp_replace(coalesce({text}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') <> '' THEN {text} ELSE {name} END, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g')"
    return f"CASE WHEN length({value}) <= 220 THEN {value} ELSE substr({value}, 1, 217) || '...' END"


def _unescaped(text: str) -> str:
    """Text of HTML with its references, a last one perhaps cut before its semicolon, and blanks put in order."""
    whole = f"regexp_replace({text}, '&(amp|lt|gt|quot|copy)\\b;?', '&\\1;', 'g')"
    for reference, character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("copy", "©"), ("amp", "&")):
        whole = f"replace({whole}, '&{reference};', '{character}')"
    return f"trim(regexp_replace({whole}, '[ \\t\\n\\r]+', ' ', 'g'))"


_DISTINCT = "SELECT min(doc_id) AS doc_id, coalesce(text, '') AS t FROM documents GROUP BY coalesce(text, '')"
_CONV = "'conv-' || conv_id"

ORACLE_SQL: dict[str, str] = {
    "artifact_ids": "SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS artifact_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents",
    "node_ids": f"WITH {_nodes()} SELECT doc_id, node_id, parent_id, kind, depth, ordinal FROM nodes",
    "line_spans": f"WITH {_lines()} SELECT doc_id, line, text, start_byte, end_byte FROM lines",
    "paragraphs": f"WITH {_paragraphs()} SELECT doc_id, paragraph, text, start_byte, end_byte FROM paras",
    "markdown_sections": f"""WITH {_paragraphs("SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents")},
        head AS (SELECT doc_id, coalesce(lang, '?') AS lang, strlen(coalesce(lang, '?')) + 5 AS size FROM documents)
        SELECT doc_id, '0' AS path, 'section' AS kind, lang AS name, 1 AS level, sha256('') AS text_sha256, CAST(0 AS BIGINT) AS start_byte, CAST(size AS BIGINT) AS end_byte FROM head
        UNION ALL
        SELECT p.doc_id, '0/' || paragraph, 'paragraph', '', 0, sha256(p.text), CAST(start_byte + size + 1 AS BIGINT), CAST(end_byte + size + 1 AS BIGINT) FROM paras p JOIN head USING (doc_id)""",
    "find_ranked": f"WITH {_nodes()}, {_found()} SELECT artifact_id, node_id, kind, name, {_snippet('text', 'name')} AS snippet, score, locator FROM found ORDER BY score DESC, node_id LIMIT 20",
    "find_topk_per_source": f"""WITH {_nodes()}, {_found()}, ranked AS (SELECT d.source, f.node_id, f.score, row_number() OVER (PARTITION BY d.source ORDER BY f.score DESC, f.node_id) AS n FROM found f JOIN documents d USING (doc_id))
        SELECT source, node_id, score FROM ranked WHERE n <= 3""",
    "snippets": f"SELECT doc_id, {_snippet('text', _CONV.replace('conv', 'doc', 1).replace('conv_id', 'doc_id'))} AS snippet FROM documents",
    "read_node_window": f"""WITH {_nodes(_DISTINCT)}, kids AS (SELECT parent_id AS node_id, string_agg(node_id, ',' ORDER BY ordinal) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id)
        SELECT n.node_id, kind, substr(text, 101, 200) AS text, CAST(least(100, length(text)) AS INTEGER) AS at, length(text) > 300 AS more, coalesce(children, '') AS children FROM nodes n LEFT JOIN kids k ON n.node_id = k.node_id""",
    "dedupe_by_digest": "SELECT min(doc_id) AS doc_id, 'sha256:' || sha256(coalesce(text, '')) AS artifact_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents GROUP BY coalesce(text, '')",
    "limits_audit": f"""WITH {_nodes()}, facts AS (SELECT doc_id, count(*) AS nodes, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes FROM nodes GROUP BY doc_id)
        SELECT doc_id, nodes, text_bytes, CASE WHEN nodes > {AUDIT.max_nodes} THEN 'nodes' WHEN text_bytes > {AUDIT.max_text_bytes} THEN 'text bytes' END AS over FROM facts""",
    "locator_strings": f"WITH {_nodes()} SELECT doc_id, node_id, locator FROM nodes WHERE kind = 'paragraph'",
    "resource_uris": "SELECT page_id, 'artifact://' || sha256(html) || '/entry/' || replace(replace(replace(replace(replace(replace(url_encode(url), '%7E', '~'), '%24', '$'), '%26', '&'), '%2B', '+'), '%3D', '='), '%3A', ':') AS uri FROM pages",
    "json_pointer_escape": "SELECT page_id, '/' || replace(replace(url, '~', '~0'), '/', '~1') AS pointer FROM pages",
    "json_fields": "WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) SELECT event_id, '/' || replace(replace(key, '~', '~0'), '/', '~1') AS pointer, key, json_extract_string(props, '$.' || key) AS value FROM k",
    "json_kind_counts": """WITH p AS (SELECT DISTINCT props FROM events), n AS (SELECT count(*) AS docs, CAST(sum(len(json_keys(props))) AS BIGINT) AS fields FROM p)
        SELECT 'document' AS kind, docs AS nodes, CAST(0 AS BIGINT) AS numbers FROM n UNION ALL SELECT 'object', docs, 0 FROM n UNION ALL SELECT 'field', fields, 0 FROM n UNION ALL SELECT 'value', fields, fields FROM n""",
    "html_nodes": rf"""WITH page AS (SELECT *, 'sha256:' || sha256(html) AS artifact_id, sha256(html) AS d, regexp_replace(html, '<[^>]*$', '') AS h FROM pages),
        item AS (SELECT page_id, unnest(regexp_extract_all(h, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS raw, generate_subscripts(regexp_extract_all(h, '<li><a href="[^"]*">([^<]*)</a></li>', 1), 1) AS n FROM page),
        article AS (SELECT page_id, split_part(split_part(h, '<article>', 2), '</article>', 1) AS a FROM page WHERE contains(h, '<article>')),
        para AS (SELECT page_id, unnest(string_split(a, '<p>')) AS raw, generate_subscripts(string_split(a, '<p>'), 1) - 1 AS n FROM article),
        block AS (SELECT page_id, 1 AS part, n, 'paragraph' AS kind, {_unescaped("raw")} AS said, 'nav[1]/ul[1]/li[' || n || ']' AS place FROM item
                  UNION ALL SELECT page_id, 2, 0, 'section', {_unescaped("regexp_extract(a, '<h1>([^<]*)', 1)")}, 'h1[1]' FROM article WHERE contains(a, '<h1>')
                  UNION ALL SELECT page_id, 3, n, 'paragraph', {_unescaped("regexp_replace(raw, '<[^>]*>', '', 'g')")}, 'article[1]/p[' || n || ']' FROM para WHERE n > 0),
        seen AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, n) - 1 AS i FROM block WHERE kind = 'section' OR said <> '')
        SELECT artifact_id, {_ID.format(digest="d", kind="document", path="'root'")} AS node_id, '' AS path, 'document' AS kind, 'page-' || page_id || '.html' AS name, '' AS text, CAST(0 AS INTEGER) AS level, '' AS locator FROM page
        UNION ALL SELECT artifact_id, 'node_' || substr(sha256(d || chr(0) || kind || chr(0) || 'root/' || i), 1, 20), CAST(i AS VARCHAR), kind, CASE kind WHEN 'section' THEN said ELSE '' END, CASE kind WHEN 'section' THEN '' ELSE said END,
            CAST(CASE kind WHEN 'section' THEN 1 ELSE 0 END AS INTEGER), '/html[1]/body[1]/' || CASE kind WHEN 'section' THEN 'article[1]/' ELSE '' END || place FROM seen JOIN page USING (page_id)""",
    "html_title_heading": f"SELECT page_id, {_unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {_unescaped("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")} AS heading FROM pages",
    "detect_scores": """SELECT 'document' AS what, doc_id AS id, CASE doc_id % 4 WHEN 2 THEN 'delimited' ELSE 'text' END AS parser, CAST(CASE doc_id % 4 WHEN 0 THEN 75 WHEN 1 THEN 85 WHEN 2 THEN 90 ELSE 45 END AS INTEGER) AS score FROM documents
        UNION ALL SELECT 'page', page_id, CASE WHEN lower(substr(html, 1, 14)) = '<!doctype html' THEN 'html' ELSE 'text' END, CAST(CASE WHEN lower(substr(html, 1, 14)) = '<!doctype html' THEN 100 ELSE 45 END AS INTEGER) FROM pages""",
    "outline_summary": f"""SELECT {_CONV} AS artifact_id, 1 + 2 * count(*) AS node_count, least(200, count(*)) AS entries, arg_min(role || ' ' || turn, turn) AS first,
        arg_max(role || ' ' || turn, turn) AS last FROM conversations GROUP BY conv_id""",
    "provenance_trail": f"""SELECT {_CONV} AS artifact_id, {_ID.format(digest=f"sha256({_CONV})", kind="paragraph", path="'root/' || turn || '/0'")} AS node_id,
        'document:' || {_CONV} || ' > section:' || role || ' ' || turn || ' > paragraph:' AS trail FROM conversations""",
    "markdown_render": f"""SELECT {_CONV} AS artifact_id, '# ' || {_CONV} || chr(10) || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn) AS markdown
        FROM conversations GROUP BY conv_id""",
    "table_cells": "SELECT 'A' || (n_nationkey + 2) AS cell, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT 'B' || (n_nationkey + 2), n_name FROM nation UNION ALL SELECT 'C' || (n_nationkey + 2), CAST(n_regionkey AS VARCHAR) FROM nation",
    "spreadsheet_letters": """WITH n AS (SELECT p_partkey, p_partkey + 1 AS n FROM part)
        SELECT p_partkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 27) % 26 AS INTEGER))
            WHEN n <= 18278 THEN chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER))
            ELSE chr(CAST(65 + (n - 18279) // 17576 AS INTEGER)) || chr(CAST(65 + (n - 18279) // 676 % 26 AS INTEGER)) || chr(CAST(65 + (n - 18279) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 18279) % 26 AS INTEGER)) END AS letters FROM n""",
    "table_window": """WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n, count(*) OVER () AS total FROM customer)
        SELECT CAST(n AS INTEGER) AS row, 'key,name,segment' AS header, c_custkey || ',' || c_name || ',' || c_mktsegment AS row_values, CAST(total AS INTEGER) AS total_rows, total > 150 AS more FROM r WHERE n BETWEEN 101 AND 150""",
    "formats_catalog": """SELECT * FROM (VALUES ('csv', 'text/csv', '.csv'), ('docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', '.docx'), ('eml', 'message/rfc822', '.eml'),
        ('gif', 'image/gif', '.gif'), ('gzip', 'application/gzip', '.gz'), ('html', 'text/html', '.html .htm'), ('jpeg', 'image/jpeg', '.jpg .jpeg'), ('json', 'application/json', '.json'),
        ('markdown', 'text/markdown', '.md .markdown'), ('pdf', 'application/pdf', '.pdf'), ('png', 'image/png', '.png'), ('pptx', 'application/vnd.openxmlformats-officedocument.presentationml.presentation', '.pptx'),
        ('tar', 'application/x-tar', '.tar'), ('tar.gz', 'application/gzip', '.tar.gz .tgz'), ('text', 'text/plain', '.txt .text .log'), ('toml', 'application/toml', '.toml'), ('tsv', 'text/tab-separated-values', '.tsv'),
        ('xlsx', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', '.xlsx'), ('xml', 'application/xml', '.xml'), ('yaml', 'application/yaml', '.yaml .yml'), ('zip', 'application/zip', '.zip')) AS t(name, media_type, extensions)""",
}
