"""Whole buckets and blocks reach one task, however Spark deals the join before them anew."""

import random

import pytest

pytest.importorskip("sievework.llm")

from sievework.llm import common, simhash_covering, substring_rlz  # noqa: E402

AQE = "spark.sql.adaptive."
#: A side that proves small is broadcast, and the other's shuffle read where it was written; or each partition counts as skewed.
DEALT = {
    "local": {AQE + "coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "10m"},
    "skewed": {
        AQE + "coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
        AQE + "skewJoin.skewedPartitionThresholdInBytes": "1b", AQE + "skewJoin.skewedPartitionFactor": "0", AQE + "advisoryPartitionSizeInBytes": "1k",
    },
}


@pytest.fixture(params=sorted(DEALT))
def dealt(spark, request):
    before = {k: spark.conf.get(k) for k in DEALT[request.param]}
    for k, v in DEALT[request.param].items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_buckets_stay_whole(dealt):
    """200 families of five fingerprints, each within three bits of the family's first."""
    rng, fps = random.Random(11), []
    for _ in range(200):
        x = rng.getrandbits(64)
        fps += [x ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 2, 3)]
    rows = [(i, simhash_covering.signed(x)) for i, x in enumerate(fps)]
    df = common.checkpointed(dealt.createDataFrame(rows, "doc_id long, fp long").repartition(8))
    got = {r.doc_id: r.component_id for r in simhash_covering.components(df, 3).collect()}
    assert got == {i: i - i % 5 for i in range(1000)}


def test_blocks_stay_whole(dealt, monkeypatch):
    """More blocks than are broadcast: documents that share a passage of 20 words, with words of their own on both sides."""
    monkeypatch.setattr(substring_rlz, "lookup", lambda left, small, on, how="left", limit=0: common.lookup(left, small, on, how, -1))
    rng = random.Random(12)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(100):
        passage = own(20)
        rows += [(len(rows) + k, " ".join(own(15) + passage + own(15))) for k in range(4)]
    df = dealt.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.n_removed for r in substring_rlz.remove_repeats(df).collect()}
    assert got == {i: 20 if i % 4 else 0 for i in range(400)}
