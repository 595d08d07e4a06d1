"""The stages one by one, and the whole run, against the operators' own rules."""

import corpus_pipeline
from tessella.llm import toxicity
from tessella.llm.queries import QUERIES, SQL


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    assert before == docs.select("doc_id").distinct().count() == docs.select("text").distinct().count()
    assert docs.filter("n_chars <> length(text)").count() == 0


def test_run_packs_what_the_stages_keep(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in pieces} == kept
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.start + r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in pieces)


def test_stages_on_odd_tables(spark, docs, clashing, odd_rows, tmp_path):
    """Null, empty, very long and repeated texts, clashing columns; then empty tables. Brute force: one row of each set of words stays."""
    for name, df in (("odd", clashing(odd_rows)), ("none", docs([]))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} == ({3, 5, 7, 9} if name == "odd" else set())
        assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_clean_documents_pass_toxicity(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r.doc_id for r in toxicity.keep_clean(docs, toxicity.model(docs, labels)).select("doc_id").collect()}
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert len(clean - kept) <= 1


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
