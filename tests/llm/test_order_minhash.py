import random

import numpy as np
import pytest

from millrace.llm import order_minhash as om


def text(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def edited(rnd, t, share):
    return " ".join(text(rnd, 1) if rnd.random() < share else w for w in t.split())


def likeness(x, y):
    w, begin = om.words([x, y])
    return om.similarity(w[: begin[1]], w[begin[1] :])


def lcs_share(x, y):
    a, b = x.lower().split(), y.lower().split()
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1] / max(len(a), len(b), 1)


@pytest.mark.parametrize("places", [5, 64, 1024])
def test_alignment_equals_the_longest_common_subsequence(monkeypatch, places):
    """Whole texts in one part or in many, within the band and at its edges."""
    monkeypatch.setattr(om, "PLACES", places)
    rnd = random.Random(3)
    for _ in range(150):
        x = text(rnd, rnd.randint(1, 120)) if rnd.random() < 0.7 else " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        y = edited(rnd, x, rnd.choice([0.0, 0.03, 0.1, 0.2]))
        words = y.split()
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(words))
            words[at:at] = text(rnd, rnd.randint(1, 6)).split()
        if rnd.random() < 0.3:
            del words[: rnd.randint(0, len(words) // 4)]
        y = " ".join(words)
        got, exact = likeness(x, y), lcs_share(x, y)
        assert got == pytest.approx(exact if exact >= om.SIMILARITY else 0.0)


def test_counts_of_words_never_rule_out_a_near_pair():
    rnd = random.Random(9)
    texts = [text(rnd, 100)]
    texts += [edited(rnd, texts[0], 0.15) for _ in range(40)]
    rows = [{"text": t, "label": k, "digest": bytes([k]), "side": int(k > 0), "keys": None, "bucket": None} for k, t in enumerate(texts)]
    want = {k for k in range(1, 41) if lcs_share(texts[0], texts[k]) >= om.SIMILARITY}
    assert {a[0] for a, _, _ in om._links(rows)} == want and want


def test_special_texts():
    assert likeness("", "...") == 1.0
    assert likeness("a b c", "A, b. C!") == 1.0
    assert likeness("a b c d e f g", "") == 0.0
    assert likeness("x " * 500, "x " * 500) == 1.0
    rnd = random.Random(4)
    one, two = text(rnd, 60), text(rnd, 60)
    assert likeness(f"{one} {two}", f"{two} {one}") < 0.8  # order counts


def test_sketches_keep_text_order_and_whole_texts():
    rnd = random.Random(5)
    one, two = text(rnd, 60), text(rnd, 60)
    texts = [f"{one} {two}", f"{two} {one}", "", "a", "a b", "x " * 100_000]
    keys = [r["keys"] for r in om._sketches(texts).to_pylist()]
    assert [len(k) for k in keys] == [om.BANDS, om.BANDS, 0, om.BANDS, om.BANDS, om.BANDS]
    assert sum(a == b for a, b in zip(keys[0], keys[1], strict=True)) < om.BANDS


def brute(docs):
    """Classes by all pairs: the least id of each row's class."""
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or (docs[i][1] and docs[j][1] and likeness(docs[i][1], docs[j][1]) >= om.SIMILARITY):
                parent[root(i)] = root(j)
    out = []
    for k in range(len(docs)):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(k) and docs[j][0] is not None]
        out.append((docs[k][0], min(ids, default=None)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(6)
    base = [text(rnd, rnd.randint(30, 150)) for _ in range(25)]
    rows = [b for b in base]
    rows += [edited(rnd, b, 0.03) for b in base[:12] for _ in range(3)]
    rows += [base[0]] * 30 + [edited(rnd, base[1], 0.04) for _ in range(40)]  # hot groups
    passage = text(rnd, 60)
    rows += [f"{text(rnd, 90)} {passage} {text(rnd, 90)}" for _ in range(30)]  # not near to each other
    rows += [None, None, "", "!!", "one two", "One, two.", "one two three"]
    rnd.shuffle(rows)
    return [(1000 - k, t) for k, t in enumerate(rows)] + [(None, base[2]), (5, base[3]), (5, base[3]), (5, base[4]), (None, "alone here")]


def test_classes_equal_all_pairs(spark, docs):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, label string")
    rows = om.with_class(df).collect()
    assert all(r["label"] == "x" for r in rows)
    assert sorted(((r["doc_id"], r["class_id"]) for r in rows), key=str) == brute(docs)


def test_one_row_of_each_class_is_kept(spark, docs):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, text_digest string")
    kept = om.first_of_each_class(df).collect()
    want = brute(docs)
    n_classes = len({c for _, c in want if c is not None}) + sum(c is None for _, c in want)
    # base[3] and base[4] share an id, so that their classes have one name.
    assert n_classes <= len(kept) <= n_classes + 1
    assert om.first_of_each_class(df.limit(0)).collect() == []
    assert om.with_class(df.limit(0)).collect() == []


def test_components(spark):
    rnd = random.Random(7)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 50)] + [(300, 301), (301, 300)] + [(rnd.randint(400, 440), rnd.randint(400, 440)) for _ in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["label"] for r in om.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    assert got == parent


def test_hot_buckets_make_no_pairs_of_all(spark):
    rnd = random.Random(8)
    base = text(rnd, 80)
    copies = spark.createDataFrame([(k, edited(rnd, base, 0.02)) for k in range(300)], "doc_id bigint, text string")
    assert {r["class_id"] for r in om.with_class(copies).collect()} == {0}
    assert np.mean([likeness(base, edited(rnd, base, 0.02)) for _ in range(20)]) > 0.9


@pytest.mark.parametrize("share", [0.03, 0.05, 0.08, 0.1, 0.15])
def test_recall_of_near_pairs(share):
    """Of pairs that are near, nine in ten at least have a key in common, and one is enough for the two to meet."""
    rnd = random.Random(int(share * 100))
    near = met = 0
    for n in (300, 300, 300, 2000):
        for _ in range(60):
            x = text(rnd, n)
            y = edited(rnd, x, share)
            if likeness(x, y) >= om.SIMILARITY:
                a, b = (r["keys"] for r in om._sketches([x, y]).to_pylist())
                near += 1
                met += any(p == q for p, q in zip(a, b, strict=True))
    assert near >= 200 and met >= 0.9 * near


@pytest.mark.parametrize("chunk", [4, 512])
def test_all_pairs_of_mixed_buckets_meet_in_blocks(spark, monkeypatch, chunk):
    """Chunks of any size, of like and unlike lengths: each two members of different classes and like lengths meet once."""
    monkeypatch.setattr(om, "CHUNK", chunk)
    rnd = random.Random(12)
    members = [(b, bytes([b, k]), rnd.randint(20, 90), rnd.choice([bytes([b, 0]), bytes([b, 1]), bytes([b, k])])) for b in range(3) for k in range(40)]
    frame = spark.createDataFrame([(b, d, n) for b, d, n, _ in members], "bucket bigint, digest binary, words bigint")
    labels = spark.createDataFrame([(d, x) for _, d, _, x in members], "node binary, label binary")
    nodes = spark.createDataFrame([(d, [b]) for b, d, _, _ in members], "digest binary, keys array<bigint>")
    blocks = {}
    for r in om._mixed(frame, labels, nodes).collect():
        blocks.setdefault(r["block"], []).append(r)
    met = []
    for rows in blocks.values():
        met += [frozenset((bytes(x["digest"]), bytes(y["digest"]))) for i, x in enumerate(rows) for y in rows[:i] if x["label"] != y["label"] and (x["side"] == 1) + (y["side"] == 1) == 1 or x["label"] != y["label"] and x["side"] == y["side"] == 2]
    near = [frozenset((x[1], y[1])) for i, x in enumerate(members) for y in members[:i] if x[0] == y[0] and x[3] != y[3] and min(x[2], y[2]) >= om.SIMILARITY * max(x[2], y[2])]
    assert set(near) <= set(met) and len(met) == len(set(met)) and near


def test_pairs_in_a_mixed_hot_bucket_meet(spark):
    """Texts that share a passage and little else fill the buckets; of each some pairs are near, by a key or more."""
    rnd = random.Random(11)
    passage = text(rnd, 150)
    rows, pairs = [], []
    for k in range(700):
        rows.append((k, f"{text(rnd, 75)} {passage} {text(rnd, 75)}"))
    for k in range(60):
        one = rows[k * 7][1].split()
        two = [text(rnd, 1) if rnd.random() < 0.1 else w for w in one]
        rows.append((1000 + k, " ".join(two)))
        pairs.append((k * 7, 1000 + k, likeness(rows[k * 7][1], " ".join(two)) >= om.SIMILARITY))
    got = {r["doc_id"]: r["class_id"] for r in om.with_class(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = [(a, b) for a, b, is_near in pairs if is_near]
    assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near) > 40
    assert all(got[k] == k for k in range(700))


def test_a_text_is_moved_once_for_each_chunk_that_it_meets(spark, monkeypatch):
    """A bucket of a chunk at most is one block, whatever its lengths and classes; in a longer one the rows of a text are
    bounded by the chunks that the bucket has."""
    monkeypatch.setattr(om, "CHUNK", 64)
    sizes = {0: 40, 1: 64, 2: 300}
    members = [(b, bytes([b, k // 256, k % 256]), 20 + k % 70, bytes([b, 0, k % 3 * (k % 20)])) for b, n in sizes.items() for k in range(n)]
    frame = spark.createDataFrame([m[:3] for m in members], "bucket bigint, digest binary, words bigint")
    labels = spark.createDataFrame([(m[1], m[3]) for m in members], "node binary, label binary")
    nodes = spark.createDataFrame([(m[1], [m[0]]) for m in members], "digest binary, keys array<bigint>")
    rows = om._mixed(frame, labels, nodes).collect()
    for b in (0, 1):
        own = [r for r in rows if r["bucket"] == b]
        assert len(own) == sizes[b] and len({r["block"] for r in own}) == 1 and {r["side"] for r in own} == {2}
    assert sum(r["bucket"] == 2 for r in rows) <= 300 * (300 // 64 + 3)
