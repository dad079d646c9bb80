"""op10's repeated anchors are told by a filter; the texts that hold any are shuffled once for all kinds of symbols."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup
from tests.test_blocks import shuffled


def test_filter_loses_no_anchor(spark, monkeypatch):
    rng = np.random.default_rng(4)
    own, others = rng.integers(0, 1 << 63, 50_000), rng.integers(0, 1 << 63, 50_000)
    df = spark.createDataFrame([(int(x),) for x in [*own, 0, 2**63 - 1]], "anchor long")
    bits = suffix_dedup.bits_of(df)
    assert suffix_dedup.holds(bits, np.r_[own, 0, 2**63 - 1]).all()
    assert suffix_dedup.holds(bits, others).mean() < 0.002  # a text has dozens of anchors
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", 1 << 15)  # too few: nothing is lost then either
    full = suffix_dedup.bits_of(df)
    assert len(full) == 1 << 12 and suffix_dedup.holds(full, own).all()
    assert not suffix_dedup.holds(suffix_dedup.bits_of(df.where("false")), own).any()


@pytest.mark.parametrize("most, max_group", [(1 << 29, 50_000), (1 << 15, 50_000), (1 << 15, 3)])
def test_rows_by_a_full_filter(spark, tmp_path, monkeypatch, most, max_group):
    """Null and equal doc_ids, copies, passages that only words or only bytes share; with a filter that holds nearly all anchors."""
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", most)
    monkeypatch.setattr(suffix_dedup.repeats, "__defaults__", (5, max_group))
    rng = np.random.default_rng(3)
    words = lambda n, size: " ".join("".join(rng.choice(list("abcdefgh"), size)) for _ in range(n))
    short, long = words(60, 2), words(70, 9)  # 60 words of 179 bytes, 70 of 699
    texts = [(None, None), (1, ""), (2, long), (2, long), (None, long), (None, long), (3, words(300, 6))]
    texts += [(10 + i, f"{words(20, 5)} {short} {words(20 + i, 5)}") for i in range(5)]
    texts += [(20 + i, f"{words(30, 7)} {long} {words(i, 4)}") for i in range(5)]
    texts += [(30, f"{words(5, 4)} {long[:450]}x {words(9, 4)} {long[:450]}y"), (31, "z" * 900), *[(None, words(80, 6))] * 4]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, (tuple(r) for r in suffix_dedup.op10_suffix_dedup(spark, str(tmp_path)).collect())))
    data = [(t or "").encode() for _, t in texts]
    places, seen = {}, {}
    for i, b in enumerate(data):
        for k in range(len(b) - 399):
            places.setdefault(b[k : k + 400], []).append((i, k))
        for k in range(len(b.split()) - 50):
            seen.setdefault(tuple(b.split()[k : k + 51]), []).append((i, k))
    cut = [np.zeros(len(b), bool) for b in data]
    shared = [set() for _ in data]
    for at in places.values():
        for i, k in at if len(at) > 1 else []:
            cut[i][k : k + 400] = True
    for at in seen.values():
        for i, k in at if len({i for i, _ in at}) > 1 else []:
            shared[i].update(range(k, k + 51))
    want = []
    for (doc, _), b, c, s in zip(texts, data, cut, shared):
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        want.append((doc, len(b), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), len(s)))
    assert got == sorted(map(repr, want))


def test_op10_shuffles_texts_once(spark, tmp_path):
    """Texts that share a passage by bytes and by words: one shuffle of texts, none of places that occur once."""
    words = lambda of, n: F.expr(f"concat_ws(' ', transform(sequence(1, {n}), i -> substring(sha2(concat_ws('-', {of}, i), 256), 1, 7)))")
    noise, passage = words("id", 600), words("'shared', id div 2", 60)
    spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", noise, passage).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, size = shuffled(spark, lambda: suffix_dedup.op10_suffix_dedup(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 2_000 and all(r["n_removed"] >= 400 and r["n_passage_words"] == 60 for r in rows)
    assert size < 30_000_000
