import duckdb
import pytest

import brute
import corpus_pipeline
from lectern.llm import langid, secrets
from lectern.llm.oracle import oracle_sql
from lectern.llm.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf_dir, name):
    got = queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_pipeline_against_plain_versions(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    rows = [r.asDict() for r in docs.collect()]
    for r, lang in zip(rows, model.predict([r["text"] for r in rows])[0]):
        r["lang"] = lang
    rows = [r for r in rows if r["lang"] != "und"]
    groups = brute.jaccard_components([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r, (d, _, c) in zip(rows, groups) if d == c]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r, h in zip(rows, brute.benchmark_hits([(r["doc_id"], r["text"]) for r in rows], items)) if not h[-1]]
    for r in rows:
        r["text"] = secrets.redacted(r["text"], 400)
        r["n_chars"] = len(r["text"])
        assert not brute.base_spans(r["text"])
    mixed = brute.mixture([(r["doc_id"], r["source"], len(r["text"].split())) for r in rows])
    want = {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"], m[3], m[4]) for r, m in zip(rows, mixed) if m[4]}
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars, r.target, r.taken) for r in got} == want
