"""Personal data, and terms that disclose it, by information-theoretic sanitisation.

Protected entities are e-mail addresses, IP addresses, payment cards and telephone numbers, found by pattern and check
sum. What is protected is the value itself, its class (the domain, the first half of an IP address, the first six
digits of a card, the first four of a telephone number) and its kind. Entities and terms are counted over the corpus by
passage, which is a line, or a piece of up to `PASSAGE` characters of a longer one; equal passages count once, so that
copies change nothing. The pointwise mutual information of entity and term, by the entity's own information, is the
share of the entity that the term discloses (1: the term occurs with it only). Terms that do so in at least `SUPPORT`
passages are generalised from a share of `GENERALISE` on and removed from `REMOVE` on, wherever they stand in a text
that has the value, class or kind. Terms have `SHORTEST` characters at least. A pair must also be no chance: the
probability that the term's passages meet those of the entity so often if they were drawn at random, times the number of
pairs of frequent entities and terms, is at most `CHANCE`. An entity of many passages so asks for more support. For a
kind, a value that meets the term in `SUPPORT` passages or more counts once, so that the near copies of one passage
don't make its words signs of the kind.

Only DataFrame functions are used. One aggregation counts passages, terms, entities and their pairs.

The patterns are written so that a search never starts twice in one run of characters: a match begins where the run
begins or where the last match ended, which finds the same as trying each place. Places of n matches take log n passes
over an array of them, and a sanitised text is joined from pieces once.

Defined results: null counts as empty; texts of any length are searched whole; matches of one kind don't overlap, of
different kinds they may, and both are kept; overlapping spans are replaced as one; an entity that all passages have has
no information, so no term discloses it; a term with too little evidence is left; without entities or repeated passages no terms are added; equal texts, and so
repeated rows and ids, get equal spans; there is nothing to tie; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, cut, free_name, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a valid match of the kind.
HINTS = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9][ ().0-9-]{5}"}
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
WORD = r"[\p{L}\p{N}]+"
PASSAGE, SUPPORT, GENERALISE, REMOVE, SHORTEST = 1000, 3, 0.5, 0.8, 3
#: Pairs of entity and term that chance alone may make in a whole corpus, as expected.
CHANCE = 0.01
#: Bytes that are sent to all executors at most; more are joined by shuffle.
SENT_BYTES = 4 << 20
#: Flags of a text by which its words are looked through for marked terms.
FLAGS = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What `join` makes of each value and all before it. The reach of a value doubles with each pass, so that an array
    of n values takes log n passes."""

    def passes(v: Column) -> Column:
        back = lambda k: F.call_function("shiftleft", F.lit(1), k)
        step = lambda acc, k: F.transform(acc, lambda x, i: F.when(i < back(k), x).otherwise(join(F.get(acc, i - back(k)), x)))
        return F.aggregate(F.sequence(F.lit(0), F.char_length(F.bin(F.size(v))) - 1), v, step)

    return let(values, passes)


def placed(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their places in code points: what stands between them gives the distances."""
    between = F.split(text, pattern, -1)

    def spans(found: Column) -> Column:
        lengths = F.transform(F.arrays_zip(between.alias("gap"), found.alias("value")), lambda x: (F.char_length(x["gap"]) + F.coalesce(F.char_length(x["value"]), F.lit(0))).cast("bigint"))
        span = lambda end, value: F.struct(F.lit(kind).alias("kind"), (end - F.char_length(value)).alias("start"), end.alias("end"), value.alias("value"))
        return let(running(lengths, lambda x, y: x + y), lambda ends: F.transform(found, lambda value, i: span(F.get(ends, i), value)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans).cast(SPAN)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.char_length(number)
    digit = lambda k: F.substr(number, n - k, F.lit(1)).cast("int")
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + F.when(k % 2 == 1, doubled(digit(k))).otherwise(digit(k))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.char_length(digits(value))
        return F.when(n.between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def checked(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["value"])


def base_spans(text: Column) -> Column:
    """Entities of a text: array<struct<kind, start, end, value>>, by kind and place."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    return F.concat(*(F.when(text.rlike(HINTS[k]), F.filter(placed(text, PATTERNS[k], k), checked(k))).otherwise(none) for k in KINDS))


def entities(spans: Column) -> Column:
    """What spans are counted by: array<string> of their values, classes and kinds."""

    def of(span: Column) -> Column:
        kind, value = span["kind"], F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"]))
        wide = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2)).when(kind == "card", F.substring(value, 1, 6)).otherwise(F.substring(value, 1, 4))
        return F.array(F.concat(kind, F.lit(":"), value), F.concat(kind, F.lit("~"), wide), kind)

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def replaced(text: Column, marks: Column) -> Column:
    """The text with marks, array<struct<start, end, by>> in order, put in place; overlapping ones are replaced as one.
    Parts are taken from pieces of `PASSAGE` characters, so that a mark doesn't read the text from its start."""

    def put(pieces: Column, marks: Column, ends: Column) -> Column:
        part = lambda a, n: F.substr(F.array_join(F.slice(pieces, (F.floor(a / PASSAGE) + 1).cast("int"), (F.floor(n / PASSAGE) + 2).cast("int")), ""), (a % PASSAGE + 1).cast("int"), n.cast("int"))
        at = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))
        mark = lambda m, i: F.when(m["end"] <= at(i), "").when(m["start"] < at(i), "").otherwise(F.concat(part(at(i), m["start"] - at(i)), m["by"]))
        last = at(F.size(marks))
        return F.array_join(F.concat(F.transform(marks, mark), F.array(part(last, F.char_length(text) - last))), "")

    furthest = lambda m: running(F.transform(m, lambda x: x["end"]), F.greatest)
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0)), lambda pieces: let(marks, lambda m: let(furthest(m), lambda ends: put(pieces, m, ends))))


def terms(text: Column, spans: Column) -> Column:
    """The words of a text outside its spans, each once, in lower case."""
    marks = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("by"))))
    free = F.when(F.size(spans) > 0, replaced(text, marks)).otherwise(text)
    return F.array_distinct(F.transform(F.filter(F.split(free, r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= SHORTEST), F.lower))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def passages(docs: DataFrame) -> DataFrame:
    """Rows of (passage), each once: pieces of a long line end at white space if they can. Outer explodes here and below,
    since Spark puts a filter in front of others that makes the array once more."""
    piece = rf"[^\n]{{1,{PASSAGE}}}(?!\S)|[^\n]{{1,{PASSAGE}}}"
    return docs.select(F.explode_outer(F.regexp_extract_all("text", F.lit(piece), F.lit(0))).alias("passage")).distinct().where("passage is not null")


def counted(docs: DataFrame) -> DataFrame:
    """Rows of (entity, term, n): the passages that have both, with a null for any; nulls for both: all passages."""
    rows = passages(docs).withColumn("spans", base_spans(F.col("passage")))
    any_of = lambda x: F.concat(F.array(F.lit(None).cast("string")), x)
    rows = rows.select(any_of(entities(F.col("spans"))).alias("entities"), any_of(terms(F.col("passage"), F.col("spans"))).alias("terms"))
    return rows.select("terms", F.explode_outer("entities").alias("entity")).select("entity", F.explode_outer("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n"))


def log_choose(n: Column, k: Column) -> Column:
    """The logarithm of n over k, by Stirling's series."""
    log_factorial = lambda x: F.when(x < 2, 0.0).otherwise((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x))
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def disclosing(docs: DataFrame) -> DataFrame:
    """Rows of (entity, term, share): terms that disclose an entity. docs: text."""
    counts = cut(counted(docs.select("text")).where(F.col("entity").isNull() | F.col("term").isNull() | (F.col("n") >= SUPPORT)))
    entity, term, often = F.col("entity"), F.col("term"), F.col("n") >= SUPPORT
    total, n_entities, n_terms = counts.agg(F.sum(F.when(entity.isNull() & term.isNull(), F.col("n"))), F.count_if(entity.isNotNull() & term.isNull() & often), F.count_if(entity.isNull() & term.isNotNull() & often)).first()
    total = float(total or 0)
    by_term = counts.where("entity is null and term is not null").select("term", F.col("n").alias("n_term"))
    by_entity = counts.where("term is null and entity is not null").select("entity", F.col("n").alias("n_entity")).where(F.col("n_entity") < total)
    pairs = counts.where("entity is not null and term is not null")
    again = pairs.where(F.instr("entity", ":") > 0).groupBy(F.substring_index("entity", ":", 1).alias("entity"), "term").agg(F.sum(F.col("n") - 1).alias("again"))
    pairs = pairs.join(again, ["entity", "term"], "left").withColumn("n", F.col("n") - F.coalesce("again", F.lit(0))).where(F.col("n") >= SUPPORT)
    rows = pairs.join(by_entity, "entity").join(by_term, "term")
    # Where n_entity is total, this is not asked for.
    share = F.when(F.col("n_entity") < total, F.log(F.lit(total) * F.col("n") / (F.col("n_entity") * F.col("n_term"))) / F.log(F.lit(total) / F.col("n_entity")))
    rows = rows.withColumn("share", share).where(F.col("share") >= GENERALISE)
    n, n_entity, n_term = (F.col(c).cast("double") for c in ("n", "n_entity", "n_term"))
    by_chance = log_choose(n_entity, n) + log_choose(total - n_entity, n_term - n) - log_choose(F.lit(total), n_term)
    return cut(rows.where(by_chance <= math.log(CHANCE) - math.log(max(1, n_entities * n_terms))).select("entity", "term", "share"))


def _found(docs: DataFrame) -> DataFrame:
    """Rows of (digest, text, spans): each text with entities once."""
    rows = docs.where(F.size(base_spans(F.col("text"))) > 0).select(digest(F.col("text")).alias("digest"), "text").dropDuplicates(["digest"])
    return cut(rows.withColumn("spans", base_spans(F.col("text"))))


def _sent(rows: DataFrame, n_bytes: Column) -> DataFrame:
    """`rows` to be broadcast, if they are few enough; n_bytes: of a row."""
    return F.broadcast(rows) if (rows.agg(F.sum(n_bytes + 48)).first()[0] or 0) <= SENT_BYTES else rows


def _words(found: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of (digest, term, start, end): the places of words that may be marked in their text. A text's marked terms
    set flags by hash, so that of its words only those with a flag leave the row; the join that follows is exact."""
    flag = lambda term: F.pmod(F.xxhash64(term), F.lit(FLAGS)).cast("int")
    flags = marked.groupBy("digest").agg(F.collect_set(flag(F.col("term"))).alias("flags"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(FLAGS - 1)), lambda k: F.array_contains("flags", k))
    words = let(slots, lambda s: F.filter(placed(F.col("text"), WORD, "term"), lambda w: F.get(s, flag(F.lower(w["value"])))))
    rows = found.join(flags, "digest").select("digest", F.explode_outer(words).alias("w"))
    return rows.select("digest", F.lower("w.value").alias("term"), "w.start", "w.end")


def _marked(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of (digest, term, share): the terms of each text that disclose one of its entities. Entities and terms
    meet within a text only, so that an entity of many texts doesn't meet all its terms in each."""
    chosen = _sent(chosen, F.octet_length("entity") + F.octet_length("term"))
    held = found.select("digest", F.explode_outer(entities(F.col("spans"))).alias("entity")).join(chosen.select("entity").distinct(), "entity", "left_semi")
    said = found.select("digest", F.explode_outer(terms(F.col("text"), F.col("spans"))).alias("term")).join(chosen.select("term").distinct(), "term", "left_semi")
    return cut(said.join(held, "digest").join(chosen, ["entity", "term"]).groupBy("digest", "term").agg(F.max("share").alias("share")))


def added_spans(docs: DataFrame) -> DataFrame:
    """Rows of (digest, added): for each text with disclosing terms, array<struct<start, end, term, share>>."""
    found = _found(docs)
    marked = _marked(found, disclosing(docs))
    texts = found.join(marked.select("digest").distinct(), "digest", "left_semi")
    words = _words(found, marked).join(marked, ["digest", "term"]).select("digest", "start", "end", "term", "share", (F.col("end") - 1).alias("place"))
    spans = texts.select("digest", F.explode_outer("spans").alias("s")).select("digest", "s.start", "s.end", F.col("s.start").alias("place"))
    # A word lies in a span if one that begins before the word's end ends behind its start.
    reach = F.max(F.when(F.col("term").isNull(), F.col("end"))).over(Window.partitionBy("digest").orderBy("place", F.col("term").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    chosen = words.unionByName(spans, allowMissingColumns=True).withColumn("reach", reach).where(F.col("term").isNotNull() & (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    return cut(chosen.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term", "share"))).alias("added")))


ADDED = "array<struct<start:bigint,end:bigint,term:string,share:double>>"


def with_spans(docs: DataFrame, spans: str = "spans", added: str = "added") -> DataFrame:
    """All columns of `docs`, `spans` (entities) and `added` (disclosing terms)."""
    more = added_spans(docs.select("text"))
    key = free_name(docs, "text_digest")
    more = more.select(F.col("digest").alias(key), F.col("added").alias(added))
    more = _sent(more, F.aggregate(F.col(added), F.lit(0), lambda n, t: n + F.octet_length(t["term"]) + 40))
    rows = docs.drop(spans, added).withColumn(key, digest(F.col("text"))).join(more, key, "left").drop(key)
    return rows.withColumn(added, F.coalesce(F.col(added), F.array().cast(ADDED))).withColumn(spans, base_spans(F.col("text")))


def sanitised(text: Column, spans: Column, added: Column) -> Column:
    """The text with entities replaced by their kinds and terms generalised to what they are, or removed."""
    term = lambda t: F.when(t["share"] >= REMOVE, "").when(t["term"].rlike(r"^\p{N}+$"), "[NUMBER]").otherwise("[TERM]")
    marks = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"))), F.transform(added, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), term(t).alias("by"))))
    made = replaced(text, F.array_sort(marks))
    return F.when(F.size(spans) + F.size(added) > 0, made).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with sanitised texts; nulls stay null."""
    s, a = free_name(docs, "spans"), free_name(docs, "added")
    rows = with_spans(docs, s, a)
    return rows.withColumn("text", sanitised(F.col("text"), F.col(s), F.col(a))).select(*columns(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    mark = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("spans", lambda s: mark(s["kind"], s))
    more = F.transform("added", lambda s: mark(F.lit("term"), s))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))
