import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import entropy_mix


def expected_targets(sizes):
    """sizes by source in order; weights 3, 1, 2, 150 % of all, at most twice each."""
    weights = [entropy_mix.WEIGHTS[k % 3] for k in range(len(sizes))]
    total, open_, target = 1.5 * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(2 * s for k, s in enumerate(sizes) if k not in open_)
        for k in open_:
            target[k] = left * weights[k] / sum(weights[j] for j in open_)
        over = [k for k in open_ if target[k] >= 2 * sizes[k]]
        if not over:
            break
        for k in over:
            target[k] = 2.0 * sizes[k]
        open_ = [k for k in open_ if k not in over]
    return target


def mixed(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, copies string, key string")
    return entropy_mix.mix(df, entropy_mix.n_words(F.col("text")))


def test_targets_caps_and_reruns(spark):
    rnd = random.Random(3)
    docs = [(k, rnd.choice(["b", "a", "a", "a", "ä", None]), " ".join("w" * rnd.randint(1, 4) for _ in range(int(rnd.paretovariate(0.9)) % 900 + 1)), "x", "y") for k in range(1500)]
    rows = mixed(spark, docs).collect()
    assert len(rows) == 1500
    sources = sorted({d[1] for d in docs if d[1] is not None}) + [None]
    sizes = [sum(len(d[2].split()) for d in docs if d[1] == s) for s in sources]
    for s, size, target in zip(sources, sizes, expected_targets(sizes), strict=True):
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {size}
        assert own[0]["target"] == pytest.approx(target)
        assert abs(sum(r["taken"] for r in own) - target) <= 0.01 * target + 2
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in rows)
    again = mixed(spark, docs[::-1]).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, copies string, `a.b` string")
    more = entropy_mix.repeated(df, entropy_mix.n_words(F.col("text"))).collect()
    copies = {r["doc_id"]: r["copies"] for r in rows}
    assert sorted(r["doc_id"] for r in more) == sorted(k for k, n in copies.items() for _ in range(n))
    assert {tuple(r) for r in more} <= set(docs)


def test_rates_are_tilted_by_size(spark):
    docs = [(k, s, "w " * n, "", "") for k, (s, n) in enumerate((s, n) for s in ("a", "b", "c") for n in [5] * 200 + [50] * 200)]
    rows = mixed(spark, docs).collect()
    mean = lambda s, n: sum(r["copies"] for r in rows if r["source"] == s and r["size"] == n) / 200
    assert mean("a", 5) == mean("a", 50) == 2.0
    assert mean("b", 50) < mean("b", 5) < 1.5


def test_nulls_empty_and_repeated_rows(spark):
    docs = [(1, "a", None, "", ""), (1, "a", "x y", "", ""), (1, "a", "x y", "", ""), (None, None, "", "", ""), (None, None, "z", "", "")]
    rows = mixed(spark, docs).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 1, 2, 2]
    assert mixed(spark, []).collect() == []
    assert all(r["taken"] == 0 for r in mixed(spark, [(1, "a", "", "", "")]).collect())


def test_neither_partitions_nor_the_order_of_rows_change_the_copies(spark):
    docs = [(k // 3, "ab"[k % 2], f"{'w ' * (k % 5)}{k}", "", "") for k in range(600)]  # ids of three documents each
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for parts, rows in ((4, docs), (11, docs), (3, docs[::-1])):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted((r["text"], r["copies"]) for r in mixed(spark, rows).collect()))
        assert found[0] == found[1] == found[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_very_long_texts(spark):
    docs = [(k, "ab"[k % 2], "w " * n, "", "") for k, n in enumerate([400_000, 300_000, *[50] * 4000])]
    rows = mixed(spark, docs).collect()
    for s in "ab":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 50 and max(r["copies"] for r in own) <= 2


def test_an_error_tells_that_the_steps_end(spark, monkeypatch):
    monkeypatch.setattr(entropy_mix, "STEPS", 1)
    with pytest.raises(RuntimeError, match="converged"):
        mixed(spark, [(k, "abc"[k % 3], "w " * (k % 17 + 1), "", "") for k in range(300)])


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entropy_mix.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"]))
    sources = sorted({d["source"] for d in docs.values()})
    sizes = [sum(r["size"] for r in rows if docs[r["doc_id"]]["source"] == s) for s in sources]
    for s, target in zip(sources, expected_targets(sizes), strict=True):
        own = [r for r in rows if docs[r["doc_id"]]["source"] == s]
        assert own[0]["target"] == pytest.approx(target)
        assert abs(sum(r["taken"] for r in own) - target) <= 0.02 * target + min(r["size"] for r in own)
