import glob
import os

import duckdb
import pytest

import corpus_pipeline
from alarmlake.llm.queries import MIX_SQL
from tests.llm.brute import kept_lines
from tests.llm.test_best_fit import check
from tests.llm.test_set_join import kept


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(steps):
    _, before, after = steps[0]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}


def test_lines(steps):
    _, before, after = steps[1]
    rows = rows_of(before)
    assert rows_of(after) == sorted((d, k[2]) for (d, _), k in zip(rows, kept_lines(rows)))


def test_near_duplicates(steps):
    _, before, after = steps[2]
    rows = rows_of(before)
    assert sorted((str(d), str(t)) for d, t in rows_of(after)) == kept(rows)


def test_mixture(steps, tmp_path):
    _, before, after = steps[3]
    before.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet({[p for p in glob.glob(os.path.join(tmp_path, 'documents', '*.parquet'))]})")
    want = sorted(d for (d,) in con.execute(f"SELECT doc_id FROM ({MIX_SQL})").fetchall())
    assert sorted(r.doc_id for r in after.collect()) == want and set(want) == {r.doc_id for r in before.collect()}


def test_packing(steps):
    _, before, after = steps[4]
    check(after.withColumnRenamed("doc_id", "key"), rows_of(before))


def test_run(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[4][2].count()


def test_edge_cases(spark, edge, nothing, sf_dir):
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()
