import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import regex

from millrace.llm import disclosure

# The base patterns as they are stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in STATED.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    None, "", "a@b", "a@b.c", "x a@b.c_d@e.f.g, .@x.y", "a@b.c.@x.y", "%%a@b-.c--d@-.-", "é@b.c a@é.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0001.02.3.255", "12.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "x4111111111111111y 12345678901234567890", "+1 (706) 555-3138", "++49.30-1234567)", "+1 2", "+4111 1111 1111 1111", "4111 1111 1111 1111 4111 1111 1111 1111",
    "😀 a@b.co 😀 10.0.0.1", "1" * 30_000, "+1 " * 5_000, "a" * 50_000 + "@", "1." * 20_000, "a@b.c " * 500,
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, added string")
    return {r["doc_id"]: r for r in disclosure.with_spans(docs).collect()}


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_base_spans_equal_the_stated_patterns(found, k):
    assert [(s["kind"], s["start"], s["end"]) for s in found[k]["spans"]] == brute(TEXTS[k])


def corpus(spark):
    near = [(k, f"Report {k}: contact zorblat at jane@corp.example for item{k} now\nother line w{k}") for k in range(5)]
    plain = [(100 + k, f"plain text number {k} with contact words at noon for all and now") for k in range(600)]
    copies = [(800 + k, "copy of glimmer by joe@corp.example here") for k in range(9)]
    return spark.createDataFrame(near + plain + copies, "doc_id bigint, text string")


def test_terms_that_disclose_are_found_and_others_left(spark):
    docs = corpus(spark)
    rows = {r["doc_id"]: r for r in disclosure.with_spans(docs).collect()}
    assert [a["term"] for a in rows[0]["added"]] == ["report", "zorblat"]
    assert all(rows[k]["text"][a["start"] : a["end"]].lower() == a["term"] for k in range(5) for a in rows[k]["added"])
    assert not any(r["added"] or r["spans"] for k, r in rows.items() if 100 <= k < 800)
    assert not any(rows[k]["added"] for k in range(800, 809))  # copies are one context
    texts = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs).collect()}
    assert texts[1] == " 1: contact  at [EMAIL] for item1 now\nother line w1"
    assert texts[100] == "plain text number 0 with contact words at noon for all and now"


def added(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    return {r["text"]: [(a["term"], round(a["share"], 9)) for a in r["added"]] for r in disclosure.with_spans(docs).collect()}


def test_neither_copies_nor_the_size_of_the_table_change_the_terms(spark):
    near = [f"zorblat {w} jane@corp.example" for w in ("one", "two", "three")]
    plain = [f"plain text number {k}" for k in range(20)]
    got = added(spark, near + plain)
    assert all(got[t] == [("zorblat", 1.0)] for t in near)
    assert not any(got[t] for t in plain)
    assert added(spark, near + near[:1] * 30 + plain + plain[:1] * 40) == got
    more = added(spark, near + plain + [f"plain text number {k}" for k in range(20, 300)])
    assert {t: more[t] for t in got} == got


def test_a_disclosing_term_is_marked_wherever_it_stands(spark):
    far = "😀 " + "filler " * 20
    near = [f"zorblat {w} jane@corp.example {far}Zorblat\nand ZORBLAT zorblat@corp.example" for w in ("one", "two", "three")]
    apart = f"jane@corp.example\n{far}\nzorblat"
    same = "zorblat joe@corp.example"  # another address of the domain that the term discloses
    other = "zorblat 10.1.2.3"
    docs = spark.createDataFrame([(t,) for t in [*near, apart, same, other] + [f"filler and one two three {k}" for k in range(40)]], "text string")
    rows = {r["text"]: r["added"] for r in disclosure.with_spans(docs).collect()}
    for text in (*near, apart):
        got = [(a["start"], a["end"]) for a in rows[text] if a["term"] == "zorblat"]
        assert got == [m.span() for m in re.finditer("zorblat(?!@)", text, re.I)]
    assert [a["term"] for a in rows[same]] == ["zorblat"]
    assert not rows[other]  # it has an entity of another kind


def test_an_entity_of_all_texts_has_no_information(spark):
    assert not any(added(spark, [f"zorblat {w} jane@corp.example" for w in ("one", "two", "three")]).values())


def test_passages_with_an_entity_alone_count(spark):
    near = [f"zorblat {w} jane@corp.example" for w in ("one", "two", "three")]
    alone = [f"jane@corp.example {k}\n{k} {k}" for k in range(10, 16)]
    # Passages: 3 near, 12 of those alone, 501 plain. n_pair 3 of n_entity 9, n_term 3 + 1, total 516.
    plain = ["zorblat"] + [f"plain {k}" for k in range(500)]
    assert added(spark, near + alone + plain)[near[0]] == [("zorblat", round(math.log(516 * 3 / 36) / math.log(516 / 9), 9))]
    assert not added(spark, near + alone + plain[:11])[near[0]]  # of 26 passages: once in eleven tables by chance


def test_near_copies_with_one_value_are_no_sign_of_its_kind(spark):
    near = [f"zorblat {k} glimmer jane@corp.example" for k in range(30)]
    several = [f"token {k} k{k}@host{k}.example" for k in range(30)]
    docs = spark.createDataFrame([(t,) for t in [*near, *several, *(f"plain {k}" for k in range(3000))]], "text string")
    got = {(r["entity"], r["term"]) for r in disclosure.disclosing(docs).collect()}
    assert {("email:jane@corp.example", "zorblat"), ("email", "token")} <= got and ("email", "zorblat") not in got


def test_words_that_stand_beside_addresses_by_chance_are_left(spark):
    """Addresses put to lines of the given table by a hash disclose nothing."""
    lines = sorted({line for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect() for line in (r["text"] or "").split("\n") if line and not brute(line)})
    texts = [f"{line} {k % 50}@corp.example" if zlib.crc32(line.encode()) % 60 == 0 else line for k, line in enumerate(lines)]
    assert sum("@corp.example" in t for t in texts) > 500
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert disclosure.disclosing(docs).collect() == []


def test_very_many_matches_in_one_text(spark):
    text = "".join(f"é user{k}@host{k % 7}.example, 10.{k % 256}.0.1 zorblat\n" for k in range(100_000))
    docs = spark.createDataFrame([(text,), *((f"plain {k}",) for k in range(20_000))], "text string")
    row = disclosure.with_spans(docs).where("size(spans) > 0").collect()
    assert len(row) == 1 and [(s["kind"], s["start"], s["end"]) for s in row[0]["spans"]] == brute(text)
    assert [(a["start"], a["end"]) for a in row[0]["added"] if a["term"] == "zorblat"] == [m.span() for m in re.finditer("zorblat", text)]
    got = disclosure.sanitise(docs).where("text like '%EMAIL%'").collect()
    assert [r["text"] for r in got] == ["é [EMAIL], [IP] \n" * 100_000]


def chance(m, n_entity, n_term, n):
    """The probability that of n_term of n passages m are among n_entity."""
    log_choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return math.exp(log_choose(n_entity, m) + log_choose(n - n_entity, n_term - m) - log_choose(n, n_term))


def expected(texts):
    """Disclosing terms by plain counting: (entity, term) to share."""
    units = {m[0] for t in texts for m in re.finditer(rf"[^\n]{{1,{disclosure.PASSAGE}}}(?!\S)|[^\n]{{1,{disclosure.PASSAGE}}}", t)}
    n_term, n_entity, n_pair = Counter(), Counter(), Counter()
    for unit in units:
        spans, keys, free = brute(unit), set(), list(unit)
        for kind, a, b in spans:
            value = unit[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", unit[a:b])
            wide = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": value[:6], "phone": value[:4]}[kind]
            keys |= {f"{kind}:{value}", f"{kind}~{wide}", kind}
            free[a:b] = " " * (b - a)
        words = {w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", "".join(free)) if len(w) >= disclosure.SHORTEST}
        n_term.update(words)
        n_entity.update(keys)
        n_pair.update((k, w) for k in keys for w in words)
    n, out = len(units), {}
    again = Counter()
    for (k, w), m in n_pair.items():
        if ":" in k and m >= disclosure.SUPPORT:
            again[k.split(":")[0], w] += m - 1
    tests = sum(m >= disclosure.SUPPORT for m in n_term.values()) * sum(m >= disclosure.SUPPORT for m in n_entity.values())
    for (k, w), m in n_pair.items():
        m -= again[k, w]
        if m >= disclosure.SUPPORT and n_entity[k] < n and chance(m, n_entity[k], n_term[w], n) * tests <= disclosure.CHANCE and (share := math.log(n * m / (n_entity[k] * n_term[w])) / math.log(n / n_entity[k])) >= disclosure.GENERALISE:
            out[k, w] = round(share, 9)
    return out


def test_shares_equal_plain_counting_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    got = {(r["entity"], r["term"]): round(r["share"], 9) for r in disclosure.disclosing(docs).collect()}
    assert got == expected([r["text"] for r in docs.collect() if r["text"]]) and got


def test_long_lines_are_counted_in_pieces_and_searched_whole(spark):
    long = "filler " * 60_000 + "zorblat one jane@corp.example " + "filler " * 60_000 + "zorblat"
    texts = [long, "zorblat two jane@corp.example", "zorblat three jane@corp.example", *(f"plain {k}" for k in range(30))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    row = next(r for r in disclosure.with_spans(docs).collect() if r["text"] == long)
    assert [(a["start"], a["end"]) for a in row["added"]] == [m.span() for m in re.finditer("zorblat", long)]
    assert max(len(r["passage"]) for r in disclosure.passages(docs).collect()) <= disclosure.PASSAGE


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a jane@corp.example", "p", "q", None)], "doc_id bigint, text string, `a.b` string, text_digest string, added string")
    assert disclosure.sanitise(docs).collect() == [(1, "a [EMAIL]", "p", "q", None)]


def test_sanitised_text_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "+4111 1111 1111 1111x 10.0.0.1", 5), (1, "+4111 1111 1111 1111x 10.0.0.1", 5), (None, None, None)], "doc_id bigint, text string, spans int")
    got = disclosure.sanitise(docs).collect()
    assert [r["text"] for r in got] == ["+[CARD]x [IP]"] * 2 + [None]
    assert [r["spans"] for r in got] == [5, 5, None]
    assert disclosure.sanitise(docs.limit(0)).collect() == []


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = disclosure.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in STATED] == [sum(x[0] == k for x in base) for k in STATED]
