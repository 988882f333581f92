import os
import random
import re
from collections import Counter

import duckdb
import numpy as np

from millrace.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, min_docs, top):
    """The same rows from whole dictionaries; `rows` are (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = set()
    for lang in {r[0] for r in rows}:
        docs, counts = Counter(), {}
        for _, source, text in (r for r in rows if r[0] == lang):
            terms = TERM.findall(lowered(text))
            docs.update(set(terms))
            counts.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in docs.items() if n >= min_docs]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        whole, own = shares(sum(counts.values(), Counter())), {s: shares(c) for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in own.items():
            pairs = sorted(((-sum(f(p[t], q[t]) for t in kept), o.encode(), o) for o, q in own.items() if o != s))
            found |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-f(p[t], whole[t]), t.encode(), t) for t in kept if counts[s][t] and p[t] > whole[t])
            found |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)}
    return found


def test_radix_order_is_stable():
    rnd = np.random.default_rng(1)
    for high in (1, 5, 1 << 17, 1 << 63):
        keys = [rnd.integers(0, high, 1000, dtype=np.uint64), rnd.integers(0, 3, 1000).astype(np.uint32)]
        assert sd.radix_order(*keys).tolist() == np.lexsort(keys[::-1]).tolist()


def test_terms_of_all_lengths_come_back():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abzé中") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 17, 40) for _ in range(9)]
    text = " ".join(rnd.choice(words) for _ in range(3000)).encode()
    got = Counter()
    for runs in sd.packed([text, b"", text], np.array([0, 1, 2], np.uint32), np.array([0, 0, 1], np.uint32)):
        if not len(runs.n):
            continue
        total, docs = runs.of_documents().of_groups()
        for term, g, n, d in zip(sd.term_strings(total.term).to_pylist(), total.group, total.n, docs, strict=True):
            got[(term, int(g))] += int(n)
            assert d == 1
    want = Counter(text.decode().split())
    assert got == {(t, g): n for t, n in want.items() for g in (0, 1)}


def test_odd_rows_against_whole_dictionaries(spark):
    """Nulls, empty texts, copies, ties, groups without terms, long terms and long texts."""
    rnd = random.Random(5)
    words = ["Ab", "aB", "c", "É", "é", "zz-y", "x" * 9, "y" * 16, "w" * 30, "v" * 29 + "ü", "a1b", "中文字中文字"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12))), rnd.choice(["en", None, ""]), rnd.choice(["s", "t", None, "ü"])) for k in range(150)]
    rows += [(900, None, "en", "s"), (901, "", "fr", "only"), (902, "12 34", "en", "numbers"), (903, " ".join(words * 400), "en", "t"), (904, "q" * 5000, "en", "s")] + rows[:9] * 2
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)
    got = {tuple(r) for r in sd.audit(docs, min_docs=10, top=4).collect()}
    assert got == brute([(r[2], r[3], r[1]) for r in rows], 10, 4)
    assert sd.audit(docs.limit(0)).collect() == []


def test_blocks_and_pieces_count_as_one_document():
    rows = [("en", "s", b"ab cd ab " * 20), ("en", "s", b"cd"), ("fr", "s", b"ab")]
    import pyarrow as pa

    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array(["s"] * 3), pa.array([r[2].decode() for r in rows])], ["lang", "source", "text"])
    old, sd.BLOCK_BYTES = sd.BLOCK_BYTES, 16
    try:
        got = Counter()
        for b in sd.counted(iter([batch])):
            for r in b.to_pylist():
                got[(r["lang"], r["term"], "n")] += r["n"]
                got[(r["lang"], r["term"], "docs")] += r["docs"]
    finally:
        sd.BLOCK_BYTES = old
    assert got == {("en", "ab", "n"): 40, ("en", "ab", "docs"): 1, ("en", "cd", "n"): 21, ("en", "cd", "docs"): 2, ("fr", "ab", "n"): 1, ("fr", "ab", "docs"): 1}


def test_query_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = sd.query(spark, sf_dir)
    assert set(df.columns) == {"lang", "source", "part", "item", "value", "rank"}
    want = c.sql(sd.ORACLE).select(*df.columns).fetchall()
    assert want and sorted(tuple(r) for r in df.collect()) == sorted(want)
