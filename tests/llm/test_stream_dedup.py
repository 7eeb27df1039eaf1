from collections import Counter

from pyspark.sql import functions as F

from alarmlake.llm import stream_dedup


def check(spark, df, path, **options):
    df.write.parquet(str(path))
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    got = stream_dedup.exact_dedup(spark, str(path), **options).collect()
    size, keep = Counter(t for _, t in rows), {}
    for d, t in rows:
        if d is not None:
            keep[t] = max(d, keep.get(t, d))
    want = sorted((str(d), str(keep.get(t)), size[t]) for d, t in rows)
    assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(size)
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_edge_cases(spark, edge, clashing, nothing, tmp_path):
    check(spark, edge, tmp_path / "a")
    check(spark, clashing.repartition(5), tmp_path / "b", files_per_trigger=1)
    check(spark, nothing, tmp_path / "c")


def test_texts_that_share_a_digest(spark, edge, tmp_path):
    check(spark, edge.repartition(3), tmp_path / "a", digest=lambda t: (F.length(t) % 3).cast("string"), files_per_trigger=1)


def test_state_outlives_the_run(spark, edge, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    edge.write.parquet(path)
    stream_dedup.fold_stream(spark, path, state)
    before = {r.digest: r for r in stream_dedup.keyed_state(spark, state).collect()}
    spark.createDataFrame([(900, "word"), (901, "only here")], "doc_id long, text string").select("doc_id", "text", *(F.lit(None).cast(t).alias(n) for n, t in edge.dtypes[2:])).write.mode("append").parquet(path)
    stream_dedup.fold_stream(spark, path, state)
    after = {r.digest: r for r in stream_dedup.keyed_state(spark, state).collect()}
    assert len(after) == len(before) + 1
    changed = {d for d in before if before[d] != after[d]}
    assert [(after[d].keep.id, after[d].n) for d in changed] == [(900, 2)]
    by = {r.id: r for r in stream_dedup.verdicts(spark, path, state).collect()}
    assert by[6].keep_id == 900 and not by[6].kept and by[900].kept and by[901].group_size == 1
