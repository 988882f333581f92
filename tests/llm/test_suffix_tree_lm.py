import math
import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import suffix_tree_lm as lm

START, END = ("start",), ("end",)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


class Brute:
    """The same tree from whole dictionaries of tuples of words."""

    def __init__(self, texts, depth):
        self.grams, self.depth = [None] + [Counter() for _ in range(depth + 1)], depth
        for text in texts:
            seq = [START, *words(text), END]
            self.grams[1].update((w,) for w in seq)
            for n in range(2, depth + 2):
                self.grams[n].update(tuple(seq[k : k + n]) for k in range(len(seq) - n + 1))
        self.n = sum(c for (w,), c in self.grams[1].items() if w != START)
        self.v = sum((w,) != (START,) for (w,) in self.grams[1])
        self.states = {}
        after = {}
        for n in range(2, depth + 2):
            for gram, c in self.grams[n].items():
                if c >= lm.KEPT:
                    after.setdefault(gram[:-1], []).append((gram[-1], c))
        for context in sorted(after, key=len):
            times = self.grams[len(context)][context]
            kept = after[context]
            mass = sum(c - lm.DISCOUNT for _, c in kept)
            gain = sum(c * math.log10((c - lm.DISCOUNT) / (times * self.p(w, context[1:]))) for w, c in kept)
            gain += (times - sum(c for _, c in kept)) * math.log10(1 - mass / times)
            if gain >= lm.GAIN:
                self.states[context] = (times, mass, dict(kept))

    def p(self, w, context):
        if not context:
            return (self.grams[1][(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))
        shorter = self.p(w, context[1:])
        if context not in self.states:
            return shorter
        times, mass, kept = self.states[context]
        return ((kept[w] - lm.DISCOUNT if w in kept else 0) + (times - mass) * shorter) / times

    def score(self, text):
        seq = [START, *words(text), END]
        known = sum(self.grams[1][(w,)] > 0 for w in seq[1:])
        base = sum(math.log10(self.p(w, ())) for w in seq[1:])
        return len(seq) - 1, known, base, sum(math.log10(self.p(seq[k], tuple(seq[max(0, k - self.depth) : k]))) for k in range(1, len(seq)))


def made(rnd, n):
    common = "the of and a to in is it that was".split()
    phrase = "licence granted free of charge to any person".split()
    rows = []
    for k in range(n):
        text = []
        for _ in range(rnd.randrange(0, 15)):
            text += phrase if rnd.random() < 0.2 else [rnd.choice(common) if rnd.random() < 0.7 else f"w{rnd.randrange(60)}é"]
        rows.append((k, " ".join(text).title() if rnd.random() < 0.3 else rnd.choice([" ", "\n", "\t\x0b"]).join(text)))
    return rows


def compare(got, rows, depth, trains):
    model = Brute([t for k, t in rows if trains(k)], depth)
    want = Counter((k, *(round(x, 6) for x in model.score(t))) for k, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {model.n}
    return model


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_against_whole_dictionaries(spark, depth):
    """Nulls, empty and wordless texts, copies, repeated ids, null ids, a very common word, and a clashing column."""
    rows = made(random.Random(depth), 150)
    rows += [(900, None), (901, ""), (902, " \n "), (None, "the of the"), (903, "the " * 3000)] + rows[:7] * 3
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id bigint, text string, score double").repartition(3)
    got = lm.scored(docs, "coalesce(doc_id % 5 <> 0, true)", depth=depth).collect()
    model = compare(got, rows, depth, lambda k: k is None or k % 5 != 0)
    assert max(map(len, model.states)) == depth and any(w == () or START in w for w in model.states)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_tree")]


def test_probabilities_sum_to_one():
    rows = made(random.Random(9), 200)
    model = Brute([t for _, t in rows], 2)
    known = [w for (w,) in model.grams[1] if w != START]
    for context in random.Random(1).sample(sorted(model.states, key=str), 20):
        assert abs(sum(model.p(w, context) for w in known) + model.p("unseen", context) - 1) < 1e-9


def test_long_texts_are_cut_and_scored_as_one(spark):
    """Chunks of a few words, built by the chunk functions themselves: contexts go across cuts."""
    rows = made(random.Random(4), 60)
    rows.append((99, " ".join(t for _, t in rows)))
    old, lm.CHUNK_BYTES = lm.CHUNK_BYTES, 64
    try:
        import pyarrow as pa

        batch = pa.record_batch([pa.array([k for k, _ in rows]), pa.array([k % 3 != 0 for k, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "train", "text"])
        chunks = [(b.column(0)[0].as_py(), b.column(2)[0].as_py(), b.column(1)[0].as_py(), b.column(3)[0].as_py()) for b in lm.chunked(iter([batch]), pa.int64())]
    finally:
        lm.CHUNK_BYTES = old
    assert len(chunks) > 20
    answers, known, total = {c[0]: {} for c in chunks}, 0, sum(c[3] for c in chunks)
    for done in range(4):
        asked = {}
        for chunk, data, *_ in chunks:
            for b, what, d in lm.asking(done, 2, 3, total, known)(data, answers[chunk]):
                asked.setdefault((b, what), []).append((chunk, d))
        for (b, what), found in asked.items():
            t = lm.answered(pa.table({"bucket": pa.array([b] * len(found), pa.int32()), "chunk": pa.array([c for c, _ in found]), "what": pa.array([what] * len(found), pa.int32()), "data": pa.array([d for _, d in found], pa.binary())}))
            for r in t.to_pylist():
                answers[r["chunk"]][(r["what"], r["bucket"])] = r["data"]
                known += r["different"] if what == 1 else 0
    got = {}
    for chunk, data, ids, _ in chunks:
        for doc, *x in zip(ids, *lm.scoring(2, 3, total, known)(data, answers[chunk]), strict=True):
            old = got.setdefault((doc, x[0]), [0, 0, 0, 0])
            got[(doc, x[0])] = [a + b for a, b in zip(old, x[1:], strict=True)]
    model = Brute([t for k, t in rows if k % 3 != 0], 2)
    assert len(got) == len(rows)
    for (doc, _), x in got.items():
        assert all(abs(a - b) < 1e-6 for a, b in zip(x, model.score(dict(rows)[doc]), strict=True))


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id bigint, text string")
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["train_tokens"]) for r in lm.scored(docs, "false").orderBy("doc_id").collect()] == [(3, 0, 0.0, 0.0, 0), (1, 0, 0.0, 0.0, 0)]
    assert lm.scored(docs.limit(0), "true").collect() == []


def test_query_against_the_stated_base_and_held_out_gain(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    got = lm.query(spark, sf_dir).collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    compare(got, rows, lm.DEPTH, lambda k: not held(k))
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
