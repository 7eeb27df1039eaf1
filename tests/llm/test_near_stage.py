from pyspark.sql import functions as F

import corpus_pipeline
from alarmlake.llm import trie_join
from tests.llm.test_set_join import alike, shingle_set


def test_stage_links_near_fingerprints_too(spark, sf_dir):
    """Texts of one repeated passage and different ends: equal SimHash, low similarity of shingle sets."""
    passage = " ".join(f"p{i}" for i in range(21))
    texts = [" ".join([passage] * 50 + [f"{end}{i}" for i in range(20)]) for end in "xy"]
    assert alike(*map(shingle_set, texts)) < 0.8
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, "a text of its own that nothing else is near to")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == [1, 3]


def test_texts_are_shuffled_once(spark):
    """Rows that repeat an identifier and a text, also without identifier, are found again and dropped by one exchange."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (None, None), (None, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark")).withColumn("group", F.hash("id", "mark"))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = trie_join.one_each(docs, placed, "group", "doc_id", "text")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, set(rows)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert plan.count("Exchange hashpartitioning") == 3  # the groups, those that stay, the rows
