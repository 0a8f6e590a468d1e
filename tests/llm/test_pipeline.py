"""The pipeline on the smallest tables, stage by stage."""

import duckdb

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    import corpus_pipeline
    from evidar.llm import decontaminate, mixing, near_dedup
    from evidar.llm.common import Workspace

    docs, ws = spark.read.parquet(f"{DIR}/documents.parquet"), Workspace(spark, "test")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = ws.save(stage(spark, docs, DIR), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    ids = lambda df: [r[0] for r in df.select("doc_id").collect()]
    before, after = seen["quality_rules"]
    assert 0 < after.count() < before.count()
    before, after = seen["near_dedup"]
    groups = near_dedup.groups(before, Workspace(spark, "test")).filter("doc_id = component_id")
    assert sorted(ids(after)) == sorted(set(ids(groups)))
    before, after = seen["decontamination"]
    texts = [t for (t,) in duckdb.sql(f"select text from '{DIR}/benchmark.parquet'").fetchall()]
    leaky = {r["doc_id"] for r in before.collect() if any(t in r["text"] for t in texts)}
    assert leaky and not leaky & set(ids(after))
    assert set(ids(before)) - set(ids(after)) >= leaky and after.count() >= before.count() - len(leaky) - 2
    before, after = seen["mixing"]
    assert set(ids(after)) <= set(ids(before))
    assert after.count() == docs.count()
    assert mixing.TARGETS.keys() == set(mixing.DOMAINS) and decontaminate.LEAK > decontaminate.PARAPHRASE


def test_queries_with_sql(spark):
    from evidar.llm import queries

    sql, run = queries.oracle_sql(), queries.queries()
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name, text in sql.items():
        got, want = run[name](spark, DIR).toPandas(), con.sql(text).df()
        cols = sorted(got.columns)
        key = lambda df: sorted((tuple(str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)))
        assert key(got) == key(want), name
