"""The queries against their SQL, and the pipeline against its parts, over the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def names():
    from docweave.llm import queries

    return sorted(queries.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_query_agrees_with_sql(spark, sql, name):
    from docweave.llm import queries

    df = queries.queries()[name](spark, FOLDER)
    cur = sql.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_pipeline_keeps_one_of_each_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as p
    from docweave.llm import near_duplicates

    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in p.STAGES:
        made = stage(spark, docs, FOLDER)
        made.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert docs.count() and (name == "encoding" or tuple(docs.columns) == p.COLUMNS)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = labels.filter("quality = 1").select("doc_id")
    assert seen["quality"].join(good, "doc_id").count() >= 0.97 * spark.read.parquet(f"{FOLDER}/documents.parquet").join(good, "doc_id").count()
    again = near_duplicates.link(seen["near_copies"], words=5, percent=80)
    assert again.filter("component_id <> _doc").count() == 0
    assert seen["lines"].count() == seen["quality"].count() and seen["encoding"].count() == seen["mixture"].count()
    assert p.run(spark, FOLDER).count() == seen["encoding"].count()


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_pipeline_with_nulls_and_repeats(spark):
    import corpus_pipeline as p

    text = "Words of a clean document that goes on for a while, with sentences. And then one more. " * 8
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, text, None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.near_copies(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id or -1, bool(r.text)) for r in kept) == [(-1, False), (1, True), (3, False)]
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    assert p.encoding(spark, docs, FOLDER).count() == docs.count()
