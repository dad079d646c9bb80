"""Texts without a partner are left out before op10's joins shuffle them."""

from pyspark.sql import functions as F

from tessera.llm.common import sifted
from tests.test_blocks import shuffled


def test_sifted_loses_no_partner(spark):
    rows = spark.range(50_000).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("k"))
    keys = spark.range(0, 50_000, 50).select((F.col("id")).alias("other"), F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("name"))
    got = {r["id"] for r in sifted(rows, ["k", "id"], keys, ["name", "other"]).collect()}
    assert got >= set(range(0, 50_000, 50)) and len(got) < 1_100
    assert sifted(rows, ["k", "id"], keys.where("false"), ["name", "other"]).collect() == []


def test_op10_shuffles_few_texts(spark, tmp_path):
    from tessera.llm.suffix_dedup import op10_suffix_dedup

    # random texts share nothing, but for one pair
    noise = F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(60)])
    texts = spark.range(1_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, F.concat(F.lit("ab" * 400), noise)).otherwise(noise).alias("text"))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, size = shuffled(spark, lambda: op10_suffix_dedup(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 1_000 and {r["doc_id"] for r in rows if r["n_removed"]} == {0, 1}
    assert size < 3_000_000  # of 3.9 MB of text, which three joins shuffled
