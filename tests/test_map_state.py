"""Map state with an end of life, in several batches of files out of order, and read back."""

import random
import time
from collections import Counter

from millrace.streaming import operators, runs


def run(spark, folder, hours, batches, wait=0.0):
    """The rows of all batches, and the state after each one."""
    given, states = [], []
    provider = spark.conf.get(runs.PROVIDER)
    spark.conf.set(runs.PROVIDER, runs.ROCKS)
    spark.conf.set(runs.IDLE, "false")
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, "u bigint, kind string").coalesce(1).write.parquet(f"{folder}/in/{k}")
            stream = spark.readStream.schema("u bigint, kind string").parquet(f"{folder}/in/*")
            counts = operators.kind_counts(stream, "u", "kind", hours)
            keep = lambda batch, n: given.append([tuple(r) for r in batch.collect()])
            counts.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
            states.append({(r["key"]["u"], r["user_map_key"]["kind"]): r["user_map_value"]["value"]["n"] if "value" in r["user_map_value"] else r["user_map_value"]["n"] for r in operators.state_of(spark, f"{folder}/state", "seen").collect()})
            time.sleep(wait)
    finally:
        spark.conf.set(runs.PROVIDER, provider)
        spark.conf.set(runs.IDLE, "true")
    return given, states


def test_counts_go_on_over_batches_and_can_be_read_back(spark, tmp_path):
    rnd = random.Random(1)
    batches = [[(rnd.randrange(5), rnd.choice(["view", "buy", None])) for _ in range(40)] for _ in range(3)]
    given, states = run(spark, str(tmp_path), 24, batches)
    total = Counter()
    for k, rows in enumerate(batches):
        total.update(r for r in rows if r[1] is not None)
        assert states[k] == total and len(states[k]) <= 10
        assert set(given[k]) == {(*key, total[key]) for key in {r for r in rows if r[1] is not None}}


def test_entries_end_and_state_stays_bounded(spark, tmp_path):
    batches = [[(k, f"kind {k}")] * 2 for k in range(3)] + [[(0, "kind 0")]]
    given, states = run(spark, str(tmp_path), 1 / 3600, batches, wait=2.0)
    assert given[-1] == [(0, "kind 0", 1)]  # counted anew
    assert all(len(s) <= 2 for s in states)
