"""The corpus pipeline against a brute-force version of each stage, and the registry."""

from __future__ import annotations

import collections

import corpus_pipeline
from arbora.llm import queries
from arbora.llm.common import staged

from .test_llm_ops import _checked, _groups, _near, texts_of

DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark, docs, labels):
    from arbora.llm import mixing, packing, quality

    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, frames[-1], DIR))
        assert out.columns == docs.columns
        frames.append(out)
    ids = [collections.Counter(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    good = {r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    assert set(ids[1]) == good
    assert set(ids[2]) == {min(keys) for keys in _groups(frames[1]).values()}
    assert set(ids[3]) == {root for _, root in _near(texts_of(frames[2]), 5, 80).values()}
    assert ids[4] == collections.Counter(r.doc_id for r in mixing.mixed(frames[3], mixing.graded).collect())
    data = collections.defaultdict(list)
    for k, t in texts_of(frames[4]):
        data[k].append(t)
    found = [r.asDict() for r in corpus_pipeline.run(spark, DIR).collect()]
    assert _checked(found, data, packing.default_tokenizer()) > 0.95


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert names >= {*queries.QUERIES, "pipeline"}
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        df = queries.QUERIES[name](spark, DIR)
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == want
