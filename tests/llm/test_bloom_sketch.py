import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bloom_sketch as b


def jaccard(x, y):
    p, q = Counter(b.PARAGRAPH.findall(x)), Counter(b.PARAGRAPH.findall(y))
    return sum((p & q).values()) / sum((p | q).values()) if p or q else 1.0


def pairwise(xs, ys):
    at = np.arange(len(xs))
    return b.likeness(b.digests(xs), b.digests(ys), at, at)


def test_peeling_gives_the_exact_likeness():
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice(["a", "bb", "c.", "d\n", "ee"]) + str(rnd.randint(0, 9)) for _ in range(n))
    xs = [text(rnd.choice([0, 1, 5, 60, 900])) for _ in range(60)]
    ys = [x if k % 3 == 0 else b.edited(x, text(300)) if k % 3 == 1 else text(200) for k, x in enumerate(xs)]
    assert np.allclose(pairwise(xs, ys), [jaccard(x, y) for x, y in zip(xs, ys, strict=True)])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.text(max_size=200))
def test_any_texts(x, y):
    assert np.allclose(pairwise([x, y], [y, y]), [jaccard(x, y), 1.0])


def test_long_and_repetitive_texts_peel():
    x = "De " * 40_000 + "\n".join(map(str, range(30_000)))
    y = "\n".join(map(str, range(15_000, 60_000)))
    assert np.allclose(pairwise([x], [y]), [jaccard(x, y)])


def compared(spark, rows, buckets):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return b.compare_with_next(df, buckets).collect()


def test_the_next_document_across_buckets(spark):
    rnd = random.Random(2)
    docs = [(3 * k, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randint(0, 40)))) for k in range(80)]
    rnd.shuffle(docs)
    order = sorted(docs, reverse=True)
    want = {d: b.edited(t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order)}
    for buckets in (1, 3, 9):
        got = compared(spark, docs, buckets)
        assert {r["doc_id"]: r["edited_text"] for r in got} == want
        assert len(got) == len(docs)


def test_hot_ids_and_nulls_are_dealt_over_buckets(spark):
    rnd = random.Random(5)
    words = lambda: " ".join(rnd.choice("abcdefgh") * 3 for _ in range(30))
    docs = [(k, words()) for k in range(-40, 40)] + [(7, words()) for _ in range(200)] + [(None, words()) for _ in range(200)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h", b.F.xxhash64("text"))
    dealt, n = b._bucketed(rows, 12)
    got = dealt.collect()
    for hot in (7, None):
        own = {}
        for r in got:
            if r["doc_id"] == hot:
                own.setdefault(r["bucket"], []).append(r)
        assert len(own) >= 4 and max(map(len, own.values())) <= 90
    order = sorted(got, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    assert [r["bucket"] for r in order] == sorted(r["bucket"] for r in order) and max(r["bucket"] for r in got) < n
    want = sorted((str(r["doc_id"]), b.edited(r["text"], order[(k + 1) % len(order)]["text"])) for k, r in enumerate(order))
    assert sorted((str(r["doc_id"]), r["edited_text"]) for r in compared(spark, docs, 12)) == want


def test_nulls_ties_single_and_empty(spark):
    got = compared(spark, [(1, "a b c"), (1, "a b c"), (1, "x y z"), (None, None), (None, "q r s")], 2)
    assert len(got) == 5
    assert len({r["fingerprint"] for r in got}) == 4
    (one,) = compared(spark, [(5, "abcdef")], 3)
    assert one["edited_text"] == "abcdab" and one["near_next"] == 1.0
    (none,) = compared(spark, [(5, None)], 3)
    assert (none["n_chars"], none["near_edited"], none["near_next"]) == (0, 1.0, 1.0)
    assert compared(spark, [], 3) == []


def test_query(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in b.query(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for k, (doc_id, text) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1]
        changed = b.edited(text, other)
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(text, changed)) < 1e-9
        assert abs(r["near_next"] - jaccard(text, other)) < 1e-9
    by_text = {}
    for doc_id, text in docs:
        assert by_text.setdefault(text, got[doc_id]["fingerprint"]) == got[doc_id]["fingerprint"]
