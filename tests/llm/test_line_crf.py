import itertools
import random
import zlib

import numpy as np

from millrace.llm import line_crf


def test_forward_backward_equals_all_labellings():
    rnd = np.random.default_rng(0)
    first = np.array([0, 1, 5, 7])
    unary, pair = rnd.normal(size=7), rnd.normal(size=(2, 2))
    good, pairs = line_crf.forward_backward(unary, pair, first)
    total = np.zeros((2, 2))
    for a, z in itertools.pairwise(first):
        weights, marginal, joint = 0.0, np.zeros(z - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=z - a):
            w = np.exp(sum(u for u, k in zip(unary[a:z], y, strict=True) if k) + sum(pair[i, j] for i, j in itertools.pairwise(y)))
            weights += w
            marginal += w * np.array(y)
            for i, j in itertools.pairwise(y):
                joint[i, j] += w
        assert np.allclose(good[a:z], marginal / weights)
        total += joint / weights
    assert np.allclose(pairs, total)


def test_features_look_at_neighbours_and_whole_lines():
    bins, length, first = line_crf.described(["a b\n\nA!! A!! A!!", "", "x" * 100_000])
    assert first.tolist() == [0, 3, 4, 5]
    assert length.tolist() == [3, 0, 11, 0, 100_000]
    active = line_crf.indices(bins, first)
    assert active.shape == (5, line_crf.N_FEATURES * line_crf.PLACES)
    assert line_crf.described([])[0].shape == (0, line_crf.N_FEATURES)


def made(spark, n=160):
    rnd = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        line = lambda: " ".join(rnd.choice(["the", "river", "was", "calm", "and", "wide,", "then."]) for _ in range(9)) if good else " ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "###"]) for _ in range(9))
        docs.append((k, "\n".join(line() for _ in range(5)), "x"))
        labels.append((k, int(good)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, quality_found string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_learns_and_scores(spark):
    docs, labels = made(spark)
    model = line_crf.learn(docs, labels.where("doc_id < 100"))
    rows = line_crf.score(docs, model).collect()
    assert all((r["quality_found"]["score"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in rows)
    assert all(len(r["quality_found"]["lines"]) == 5 for r in rows)
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "\n" * 50_000), (3, "w " * 200_000)], "doc_id bigint, text string")
    scores = [r["quality_found"]["score"] for r in line_crf.score(odd, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] == scores[2]
    assert line_crf.score(odd.limit(0), model).collect() == []


def test_without_labels_of_both_kinds(spark):
    docs, labels = made(spark, 12)
    assert {r["quality_found"]["score"] for r in line_crf.score(docs, line_crf.learn(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert {r["quality_found"]["score"] for r in line_crf.score(docs, line_crf.learn(docs, labels.limit(0))).collect()} == {1.0}




def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in line_crf.query(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for k, r in rows.items())
    held = [(rows[x["doc_id"]]["score"], x["quality"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    pairs = [(g > b) + 0.5 * (g == b) for g, q in held if q for b, p in held if not p]
    assert sum(pairs) / len(pairs) > 0.97
    assert sum((s >= 0.7) == q for s, q in held) / len(held) > 0.95


def test_memory_for_a_long_text():
    import tracemalloc

    text = "The river was calm and wide, then it rose again over the banks.\n" * 30_000
    for run in (lambda: line_crf.described([text]), lambda: line_crf.described([text.replace("\n", " ")])):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] <= 16 * len(text)
        tracemalloc.stop()


def test_hashes_of_spans_don_t_depend_on_pieces(monkeypatch):
    from millrace.llm import common

    b = np.random.default_rng(1).integers(0, 4, common.PIECE * 2 + 77, np.uint8)
    cut = np.sort(np.random.default_rng(2).choice(len(b), 4000, replace=False))
    start, stop = cut[::2], cut[1::2]
    got = common.span_hashes(b, start, stop)
    for k in range(0, 2000, 37):
        span = b[start[k] : stop[k]]
        assert got[k] == common.span_hashes(span.copy(), np.array([0]), np.array([len(span)]))[0]
    whole = common.span_hashes(b, np.array([0]), np.array([len(b)]))
    assert whole[0] == common.span_hashes(np.concatenate([b, b]), np.array([len(b)]), np.array([2 * len(b)]))[0]


def test_columns_of_any_name_are_kept(spark):
    docs, labels = made(spark, 30)
    model = line_crf.learn(docs, labels)
    wide = docs.select("doc_id", "text", "quality_found", *(docs["text"].alias(c) for c in ("a.b", "score", "lines", "h", "good")))
    rows = line_crf.score(wide, model, found="found").collect()
    assert all(r["a.b"] == r["text"] == r["h"] and r["quality_found"] == "x" and 0 <= r["found"]["score"] <= 1 for r in rows)


def test_of_repeated_ids_one_text_teaches(spark):
    docs, labels = made(spark, 60)
    more = docs.unionByName(docs.limit(5)).unionByName(docs.where("doc_id = 7").crossJoin(spark.range(300)).drop("id"))
    one, two = line_crf.learn(docs, labels), line_crf.learn(more, labels)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.curve, two.curve)


def test_lines_of_the_sample_are_bounded(spark):
    docs, labels = made(spark, 60)
    plain = line_crf.learn(docs, labels)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(k, "one line\n" * 200_000) for k in (10_000, 10_001)], "doc_id bigint, text string"))
    marked = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(10_000, 0), (10_001, 1)], "doc_id bigint, quality int"))
    bounded = line_crf.learn(more, marked, lines_per_label=100_000)
    assert np.allclose(plain.weights, bounded.weights)
    assert plain.prior == 40 / 60 and bounded.prior == 41 / 62  # rates are of all labels, the sample's or not
