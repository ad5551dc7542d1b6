import math
import os

import duckdb
import pytest

import corpus_pipeline
from marlstone.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    assert got.num_rows > 0
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
        rows = lambda t: sorted(zip(*[map(str, t[c].to_pylist()) for c in sorted(got.column_names)]))
        assert rows(got) == rows(want)


def test_stages(spark, odd_docs):
    """Each stage on the odd documents: their columns, and what must stay and go."""
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, SF).columns == docs.columns
    exact = stages["exact_dedup"](spark, docs, SF).collect()
    ids = sorted((r.doc_id for r in exact if r.doc_id is not None))
    assert len(exact) == len({(r.text or "").lower() for r in exact}) and 129 in ids and 1 not in ids and ids.count(30) == 1 and 11 in ids and 10 not in ids
    near = stages["jaccard_join"](spark, docs, SF)
    assert near.columns == docs.columns
    kept = [r.doc_id for r in near.collect()]
    assert 1 in kept and 129 not in kept and 12 not in kept and {20, 21, 22, 23} <= set(kept)
    cut = stages["decontaminate"](spark, docs, SF)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert stages["bpe"](spark, docs, SF).count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) == len({r.doc_id for r in rows}) and all(r.n_tokens >= 0 and math.isfinite(r.n_tokens) for r in rows)
