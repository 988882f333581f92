import random
import re
import zlib

from millrace.llm import compression_language as cl

WORDS = {"aa": "ana bana kana lana mana".split(), "oo": "ono bono kono lono mono".split()}


def sentence(lang, rnd, n=40):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "s", "ti"]) for _ in range(n))


def test_learns_within_its_bound_and_classifies(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(k, sentence(lang := rnd.choice(["aa", "oo"]), rnd), lang) for k in range(300)] + [(900, "zzz", None), (901, None, "aa"), (902, "123", "digits")], "doc_id bigint, text string, lang string")
    contents = cl.learn(docs, docs_per_language=20)
    assert sorted(contents) == ["aa", "oo"] and all(v.count(b"\n") == 19 for v in contents.values())
    rows = cl.identify(docs, contents, found="lang2").collect()
    assert sum(r["lang2"]["lang"] == r["lang"] for r in rows if r["doc_id"] < 300) > 294
    by_id = {r["doc_id"]: r["lang2"] for r in rows}
    assert [(by_id[k]["lang"], by_id[k]["score"], by_id[k]["rejected"]) for k in (901, 902)] == [("und", 0.0, True)] * 2
    assert all(0 <= r["lang2"]["score"] <= 1 for r in rows)


def test_copies_teach_once(spark):
    rnd = random.Random(4)
    texts = [sentence("aa", rnd) for _ in range(20)]
    learned = lambda rows: cl.learn(spark.createDataFrame([(t, "aa") for t in rows], "text string, lang string"), docs_per_language=8)["aa"]
    assert learned(texts) == learned(texts + texts[:1] * 100 + texts[5:6] * 50) and learned(texts).count(b"\n") == 7


def test_letters_are_those_of_unicode(spark):
    contents = {"aa": b"ana bana kana", "oo": b"ono bono kono"}
    for text in ("½", "²①", "Ⅷ", "½ ² ① Ⅷ 7", "५", "_", "\u0301"):
        assert cl.classify(text, contents)[0] == "und"
    for text in ("ª", "é", "中", "½x"):
        assert cl.classify(text, contents)[0] != "und"
    docs = spark.createDataFrame([("Ⅷ ½ ²", "no"), ("中", "yes")], "text string, lang string")
    assert list(cl.learn(docs)) == ["yes"]


def test_bytes_of_the_sample_are_bounded(spark):
    texts = [("xx", f"kort tekst {k}") for k in range(8)] + [("xx", "lang " * 30_000), ("yy", "bred " * 30_000), ("zz", "stor " * 300_000)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    got = cl.learn(docs, docs_per_language=10, bytes_per_language=200_000)
    assert sorted(got) == ["xx", "yy"] and max(map(len, got.values())) <= 200_000
    assert b"lang lang" in got["xx"] and all(f"tekst {k}".encode() in got["xx"] for k in range(8))
    assert b"lang lang" not in cl.learn(docs, docs_per_language=10, bytes_per_language=150_010)["xx"]  # the long one comes last
    assert all(f"tekst {k}".encode() in cl.learn(docs, docs_per_language=10, bytes_per_language=150_010)["xx"] for k in range(8))


def test_odd_texts():
    contents = {"aa": b"ana bana kana", "oo": b"ono bono kono"}
    assert cl.classify(None, contents)[0] == cl.classify("", contents)[0] == cl.classify(" 1,2! ", contents)[0] == "und"
    assert cl.classify("x", {})[0] == "und"
    assert cl.classify("x", {"aa": b"y"}) == ("aa", 1.0, 1.0, False)
    assert cl.classify("q" * 3, contents)[3]  # nothing tells the two apart
    assert cl.classify("bono kono " * 100_000, contents)[0] == "oo"
    assert cl.classify("BANA, KANA!! ", contents)[0] == "aa"


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "bana", "aa", 7)], "doc_id bigint, text string, lang string, language int")
    contents = cl.learn(docs)
    assert cl.identify(docs.limit(0), contents).collect() == []
    assert cl.identify(docs, contents, found="found").first()["language"] == 7
    assert cl.learn(docs.limit(0)) == {}


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = cl.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.96


def test_query_equals_plain_compression(spark, sf_dir):
    """Samples by their hashes, and all sizes by new compressors, one for each block."""
    import regex
    import xxhash
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    plain = lambda t: re.sub(r"[\W_]+", " ", t.lower())
    contents = {}
    for lang in sorted({r["lang"] for r in docs if r["lang"]}):
        texts = sorted({r["text"] for r in docs if r["lang"] == lang and not held(r) and regex.search(r"\p{L}", r["text"] or "")}, key=signed)[: cl.DOCS_PER_LANGUAGE]
        contents[lang] = "\n".join(dict.fromkeys(map(plain, texts[::-1]))).encode()

    def size(raw, content):
        return sum(len(zstandard.ZstdCompressor(level=cl.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[k : k + cl.BLOCK_BYTES])) for k in range(0, len(raw), cl.BLOCK_BYTES))

    assert cl.learn(spark.createDataFrame([r for r in docs if not held(r)], "doc_id bigint, text string, lang string, source string, n_chars bigint")) == contents
    got = {r["doc_id"]: r for r in cl.query(spark, sf_dir).collect()}
    for r in docs[:60]:
        raw = plain(r["text"]).encode()
        sizes = sorted((size(raw, content), lang) for lang, content in contents.items())
        margin = 1 - sizes[0][0] / sizes[1][0]
        assert got[r["doc_id"]]["lang_pred"] == sizes[0][1] and abs(got[r["doc_id"]]["margin"] - margin) < 0.02
