"""The streamed forest: its sample, its versions, its alerts."""

import random

from pyspark.sql import functions as F

from seclog.config import SECOND_US, ForestLimits
from seclog.operators import iforest
from seclog.operators.features import FEATURES
from seclog.schema import meta_struct
from seclog.sources import sinks
from seclog.streaming.detect import ForestDetector

LIMITS = ForestLimits(trees=7, sample_size=40, min_samples=100, retrain_sec=400, buffer_sec=1600, cooldown_sec=50, window_sec=30)


def windows(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(f"10.0.0.{rng.randrange(30)}", i * SECOND_US, *[float(rng.randrange(9)) for _ in FEATURES]) for i in range(n)]
    return spark.createDataFrame(rows, "src_ip string, us long, " + ", ".join(f"{f} double" for f in FEATURES))


def test_the_sample_merged_over_batches_is_that_of_all_rows(spark):
    rows = windows(spark, 900)
    whole = iforest.sample_state(rows.repartition(5), LIMITS, bucket_us=300 * SECOND_US)
    state = None
    for k in range(3):
        state = iforest.sample_state(rows.filter(F.pmod(F.xxhash64("us"), F.lit(3)) == k), LIMITS, bucket_us=300 * SECOND_US, known=state)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, whole.collect()))
    per = {(r.bucket, r.tree): r["count"] for r in whole.groupBy("bucket", "tree").count().collect()}
    assert per == {(b, t): 40 for b in range(3) for t in range(7)}
    forest = iforest.fit_state(state, LIMITS).toPandas()
    assert set(forest[forest.node == 0]["size"]) == {40} and sorted(forest.tree.unique()) == list(range(7))
    same = iforest.fit_state(whole, LIMITS).toPandas()
    assert forest.sort_values(["tree", "node"]).to_numpy().tolist() == same.sort_values(["tree", "node"]).to_numpy().tolist()


def test_a_stream_trains_when_it_may_and_scores_by_the_version_before(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, i * SECOND_US, f"10.0.0.{i % 20}", "auth", rng.choice(["SSH_FAIL", "SSH_SUCCESS"]), "u") for i in range(1500)]
    rows += [(5000 + i, (1300 + i // 40) * SECOND_US, "6.6.6.6", rng.choice(["auth", "nginx", "mysql"]), rng.choice(["WEB_SCAN", "DB_AUTH_FAIL", "SSH_FAIL"]), f"u{i}") for i in range(400)]

    def frame(part):
        df = spark.createDataFrame(part, "event_id long, us long, src_ip string, source string, kind string, user string")
        return df.withColumn("meta", meta_struct())

    handler = ForestDetector(str(tmp_path / "s"), str(tmp_path / "out"), LIMITS, delay_us=0)
    models = []
    for k, (low, high) in enumerate([(0, 60), (60, 300), (300, 500), (500, 800), (800, 1100), (1100, 2000)]):
        handler(frame([r for r in rows if low <= r[1] // SECOND_US < high]), k)
        models.append(handler.model(spark, k))
    assert [m[0] for m in models] == [0, 1, 1, 2, 2, 3]
    # batch 0 has too few rows; after a training the next waits for its time
    assert models[0][1] < 0 and models[1][1] == 299 * SECOND_US and models[3][1] == 799 * SECOND_US
    alerts = sinks.read_appended(spark, str(tmp_path / "out")).collect()
    assert {r.version for r in alerts} <= {1, 2} and min(r.us for r in alerts) >= 300 * SECOND_US
    cuts = {1: models[1][3], 2: models[3][3]}
    assert all(r.score < cuts[r.version] and r.reasons for r in alerts)
    assert any(r.src_ip == "6.6.6.6" for r in alerts)
    for a in alerts:
        assert not [b for b in alerts if b.src_ip == a.src_ip and 0 < b.us - a.us < LIMITS.cooldown_sec * SECOND_US]
