import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import base_rows
from topiclake.llm import shards


def placed(df, n, slot=True):
    out = shards.assign(df, "doc_id", [1.0] * n)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return shards.with_slots(out, "shard", [order, F.col("doc_id")]) if slot else out


def test_one_more_shard_only_takes(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    old = shards.assign(df, "doc_id", [1.0] * 16)
    both = shards.assign(old, "doc_id", [1.0] * 17, "grown").collect()
    moved = [r for r in both if r.shard != r.grown]
    assert moved and all(r.grown == 16 for r in moved)
    assert abs(len(moved) - 4000 / 17) < 4 * (4000 / 17) ** 0.5


def test_weights_share_the_rows(spark):
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    found = Counter(r.shard for r in shards.assign(df, "doc_id", [1, 0, 2, 3]).collect())
    assert set(found) == {0, 2, 3}
    for shard, weight in {0: 1, 2: 2, 3: 3}.items():
        assert abs(found[shard] - weight * 1000) < 150
    with pytest.raises(ValueError):
        shards.assign(df, "doc_id", [0.0])


def test_slots_have_no_gaps(spark, docs, no_docs, clashing):
    rows = placed(docs, 4).collect()
    assert len(rows) == len(base_rows())
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    # A key is always in one shard, nulls are one key.
    keys = {(r.doc_id, r.shard) for r in rows}
    assert len(keys) == len({r.doc_id for r in rows})
    assert placed(no_docs, 4).count() == 0
    assert placed(clashing, 4).filter("kept = 'own kept'").count() == len(rows)


def test_one_key_for_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = placed(df, 2)
        found = out.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert all(r.a == 0 and r.b == r.n - 1 for r in found)
    assert sum(r.n for r in found) == 30_000


def test_written_shards(spark, docs, tmp_path):
    shards.write_shards(docs, str(tmp_path / "out"), "doc_id", [1.0] * 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert back.filter("doc_id is not null").join(shards.assign(docs, "doc_id", [1.0] * 3).select("doc_id", F.col("shard").alias("s")), "doc_id").filter("shard != s").count() == 0


def test_query_columns(spark, docs, tmp_path):
    from topiclake.llm.queries import Q

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = Q["op3_rendezvous_shards"](spark, str(tmp_path)).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in base_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
