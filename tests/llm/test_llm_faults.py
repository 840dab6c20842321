"""Cases that once went wrong: ids of batches, nulls beside large ids, clashing columns, likeness from fingerprints alone."""

import pytest
from pyspark.sql import functions as F

from corvane.llm import exact_dedup, fingerprints, near_dedup, packing, token_counts


@pytest.mark.parametrize("ids", [["2024/01/05", "2024/01/06"], ["day[1]", "day1"], ["a*", "ab", "a?"], ["", " ", "._x", "ä{b}", "%2F", "/"]])
def test_batches_of_any_id_count_once(spark, ids):
    docs = spark.createDataFrame([(1, "s", "en", "a b c")], "doc_id long, source string, lang string, text string")
    changes = token_counts.signed(token_counts.counted(docs, {"w": r"[^\x20]+"}), 1)
    rollup = token_counts.Rollup(spark)
    for k, batch in enumerate(ids, 1):
        assert rollup.commit(batch, changes) and not rollup.commit(batch, changes)
        assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "w", k, 3 * k)]
    assert rollup.committed() == set(ids)
    rollup.compact()
    assert rollup.committed() == set(ids) and not rollup.commit(ids[0], changes)
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "w", len(ids), 3 * len(ids))]


def test_a_batch_id_of_more_than_a_file_name_is_refused(spark):
    with pytest.raises(ValueError):
        token_counts.Rollup(spark).commit("x" * 200, spark.createDataFrame([], token_counts.SCHEMA))


def test_packing_keeps_large_ids_beside_a_null(spark):
    docs = spark.createDataFrame([(9007199254740993, "one two"), (None, "three"), (2**62 + 1, None)], "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"] for r in packing.pack(docs).collect()), key=str) == sorted([9007199254740993, None, 2**62 + 1], key=str)


def test_dedup_with_columns_named_like_its_own(spark):
    text = "one two three four five six seven eight"
    columns = "doc_id long, text string, _gone long, _stay_id long, _stay_digest string, _digest string, digest int"
    docs = spark.createDataFrame([(1, text, 1, 1, "x", "y", 1), (2, text, 2, 2, "x", "y", 2), (3, "other", 3, 3, "x", "y", 3)], columns)
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs).collect()) == [2, 3]
    assert sorted(r["doc_id"] for r in near_dedup.deduplicate(docs).collect()) == [1, 3]
    twice = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    got = exact_dedup.deduplicate(twice)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 3]


def test_likeness_follows_from_two_fingerprints(spark):
    texts = ["A b. C d", "A b.\nC d", "A b.\nC d", "A b. C d. E f. G h. I j. K l. M n", "nothing of that", None, ""]
    got = fingerprints.compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    both = fingerprints.likeness_between(F.col("fingerprint"), F.col("edited_fingerprint"))
    rows = {r["doc_id"]: r for r in got.withColumn("again", both).collect()}
    assert all(r["again"] == pytest.approx(r["near_edited"], abs=1e-12) for r in rows.values())
    follow = got.select(F.col("doc_id").alias("next"), F.col("fingerprint").alias("other"))
    pairs = got.join(follow, F.pmod(F.col("doc_id") + 1, F.lit(len(texts))) == F.col("next"))
    for r in pairs.withColumn("again", fingerprints.likeness_between(F.col("fingerprint"), F.col("other"))).collect():
        assert r["again"] == pytest.approx(r["near_next"], abs=1e-12)
    assert rows[0]["fingerprint"] != rows[1]["fingerprint"] and rows[1]["fingerprint"] == rows[2]["fingerprint"]
    assert rows[1]["near_next"] == 1.0 and rows[5]["fingerprint"] == rows[6]["fingerprint"]


def test_rows_without_an_id_do_not_meet(spark):
    docs = spark.createDataFrame([(None, "a\nb"), (None, "c"), (4, "d")], "doc_id long, text string")
    assert fingerprints.edited(docs).select("key").distinct().count() == 3
    assert sorted((r["doc_id"] is None, r["near_next"]) for r in fingerprints.compare(docs).collect()) == [(False, 1.0), (True, None), (True, None)]
