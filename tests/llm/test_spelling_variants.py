import os
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np

from millrace.llm import spelling_variants as sv


def one_error(a, b):
    """Whether one insertion, deletion or replacement makes b of a: by plain cases."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    words = {w: n for w, n in total.items() if n >= 3}
    near = {w: [x for x in words if one_error(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def test_search_equals_all_pairs():
    """Both sides together give each ordered pair once, also with repeated letters and letters that no word has."""
    rnd = random.Random(7)
    for letters, shift in (("ab", 0), ("abcdé", 0), ("aÿ", 3)):
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 10))) for _ in range(300)})
        old = sv.RANK_BYTES
        sv.RANK_BYTES = old if not shift else len(words) * 8 * 3 * 4 >> shift
        try:
            asked = [(w, first) for w in [*words, "zzzzz", words[0] + "q"] for first in (True, False)]
            got = Counter((asked[a][0], words[b]) for q, w in sv.near_words(words, asked) for a, b in zip(q.tolist(), w.tolist(), strict=True))
        finally:
            sv.RANK_BYTES = old
        want = {(a, b) for a in dict(asked) for b in words if one_error(a, b)}
        assert set(got) == want and set(got.values()) == {1}


def test_intervals_are_those_of_the_suffixes():
    words = sorted(["banana", "bandana", "ananas", "ÿana"])
    codes = np.full(256, 99)
    present = sorted(set("".join(words)))
    codes[0] = 0
    for k, c in enumerate(present, 1):
        codes[ord(c)] = k
    codes[codes == 99] = len(present) + 1
    index = sv.FMIndex(words, codes)
    joined = "$" + "$".join(words) + "$"
    for pattern in ("ana", "$ban", "a$", "nda", "x", "$ananas$", "an"):
        low, size = np.zeros(1, np.int64), np.array([index.size])
        for c in reversed(pattern):
            low, size = index.step(low, size, codes[[0 if c == "$" else ord(c)]])
        assert size[0] == sum(joined.startswith(pattern, k) for k in range(len(joined)))
        if pattern == "$ananas$":
            assert words[index.word[low[0]]] == "ananas"


def texts(rnd):
    base = ["colour", "color", "colours", "harbour", "harbor", "größe", "grösse", "aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "naïve", "naive", "x" * 300, "x" * 299, "short", "shorts", "shart"]
    rows = [(k, " ".join(rnd.choice(base[: rnd.randrange(2, len(base) + 1)]) for _ in range(30))) for k in range(120)]
    rows += [(None, "Colour COLOUR colour ÉCOLE école ÉCOLE ÉCOLE"), (None, None), (7, ""), (8, "1 2, 3")] + rows[:5] * 2
    return rows


def test_odd_rows_against_all_pairs(spark):
    rows = texts(random.Random(11))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    assert {tuple(r) for r in sv.variants(docs).collect()} == brute(rows)
    assert sv.variants(docs.limit(0)).collect() == []


def test_hot_halves_are_split_and_lose_nothing(spark):
    """Shards of a few words: nearly all halves are hot, each word is still found once."""
    rnd = random.Random(13)
    rows = [(k, " ".join("same" + "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(40))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    for size in (3, 20):
        got = [tuple(r) for r in sv.variants(docs, shard_words=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_texts_are_read_in_pieces():
    old, sv.PIECE_CHARS = sv.PIECE_CHARS, 50
    try:
        text = " ".join(f"wörd{'abc'[k % 3]}" * (1 + k % 20) for k in range(300))
        assert sv.runs(text) == Counter(re.findall("[a-zÀ-ÿ]+", text))
    finally:
        sv.PIECE_CHARS = old


def test_chains_of_forms_end_at_their_root(spark):
    words = spark.createDataFrame([(str(k), str(k + 1) if k < 40 else None) for k in range(41)] + [("a", None)], "word string, form string")
    assert {r["word"]: r["root"] for r in sv.with_roots(words).collect()} == {**{str(k): "40" for k in range(41)}, "a": "a"}


def test_query_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = sv.query(spark, sf_dir)
    want = c.sql(sv.ORACLE).select(*df.columns).fetchall()
    assert want and sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
