"""Source divergence audit: how far the terms of each source of a language stray from those of the others.

Terms are runs of ASCII letters and signs beyond ASCII; only A-Z are lower-cased. They are counted by length-bucketed
packing, in blocks of texts within a task: terms of up to 8 bytes become one big-endian uint64 word and those of up to
16 bytes two, which are sorted by radix (16 bits a pass) and run-counted in numpy; longer terms go to one bucket for
each length and are sorted as bytes. A block gives one row for each (language, source, term), so that a hot source or
term is added up before anything is shuffled; Spark adds up the blocks.

Each language keeps the V terms that at least `MIN_DOCS` of its documents have. A group (language, source) gives a kept
term of count n the share p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N being the group's count of kept terms; the language
as a whole likewise. The divergence of two shares is floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

Sums over all kept terms don't list the terms that a group lacks: with p0 and q0 the shares of a term of count 0,
  sum f(p, q) = sum over the group's shares f(p, q0) + sum over the other's shares f(p0, q)
                + (V - terms of one - terms of the other) f(p0, q0)
                + sum over common terms (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)),
where the first two sums run over the different shares and their frequencies. Only terms that two sources have make a
pair of sources, inside the term's row; no row meets another one in a join.

Defined results: null text, language or source count as ''; empty texts have no terms but their group occurs; with V = 0
every value is 0; ties go by the item's UTF-8 bytes; repeated rows are documents of their own; very long texts are
counted piece by piece and count as one document for each of their terms; an empty table gives no rows; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Documents of a language that must have a term, terms that are reported for a group, and the scale of shares.
MIN_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Groups that are sent to all executors at most.
SENT_ROWS = 100_000
#: Text bytes that are counted at once.
BLOCK_BYTES = 8 << 20

IS_TERM = np.ones(256, bool)
IS_TERM[:0x41] = IS_TERM[0x5B:0x61] = IS_TERM[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
COUNTED = "lang string, source string, term string, n long, docs long"


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by unsigned keys, the first one weighing most: passes over 16 bits from the last digit on."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        top = int(key.max()) if len(key) else 0
        for shift in range(0, top.bit_length(), 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def words_of(b: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as a big-endian word with zeros behind; `b` has eight spare bytes."""
    view = np.ndarray(len(b) - 7, ">u8", b, 0, (1,))
    drop = ((8 - length) * 8).astype(np.uint64)
    return view[start].astype(np.uint64) >> drop << drop


class Runs:
    """Counted terms: group, document, a term as one or two words or as bytes, and occurrences."""

    def __init__(self, group: np.ndarray, doc: np.ndarray, term: tuple[np.ndarray, ...], n: np.ndarray):
        self.group, self.doc, self.term, self.n = group, doc, term, n

    def by(self, *more: str) -> tuple[np.ndarray, np.ndarray]:
        """The order by group, term and `more`, and where runs of these start in it."""
        extra = [getattr(self, k) for k in more]
        keys = [self.group, *self.term, *extra]
        if self.term[0].dtype.kind == "S":  # bytes of one length
            order = radix_order(*extra) if extra else np.arange(len(self.n))
            order = order[np.argsort(self.term[0][order], kind="stable")]
            order = order[radix_order(self.group[order])]
        else:
            order = radix_order(*keys)
        first = np.zeros(len(order), bool)
        first[:1] = True
        for key in keys:
            k = key[order]
            first[1:] |= k[1:] != k[:-1]
        return order, np.flatnonzero(first)

    def of_documents(self) -> Runs:
        """One run for each term of a document."""
        order, first = self.by("doc")
        at = order[first]
        return Runs(self.group[at], self.doc[at], tuple(k[at] for k in self.term), np.add.reduceat(self.n[order], first) if len(first) else self.n)

    def of_groups(self) -> tuple[Runs, np.ndarray]:
        """One run for each term of a group, and its documents; self has one run for each term of a document."""
        order, first = self.by()
        at = order[first]
        docs = np.diff(np.append(first, len(order)))
        return Runs(self.group[at], self.doc[at], tuple(k[at] for k in self.term), np.add.reduceat(self.n[order], first) if len(first) else self.n), docs


def term_strings(term: tuple[np.ndarray, ...]) -> pa.Array:
    """Packed terms or bytes of one length as an Arrow column of strings."""
    if term[0].dtype.kind == "S":
        width = term[0].dtype.itemsize
        return pa.Array.from_buffers(pa.large_utf8(), len(term[0]), [None, pa.py_buffer(np.arange(0, width * len(term[0]) + 1, width, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(term[0]))]).cast(pa.utf8())
    b = np.stack(term, axis=1).astype(">u8").view(np.uint8)
    offsets = np.zeros(len(b) + 1, np.int32)
    np.cumsum(np.count_nonzero(b, axis=1), out=offsets[1:])
    return pa.Array.from_buffers(pa.utf8(), len(b), [None, pa.py_buffer(offsets), pa.py_buffer(b[b != 0])])


def packed(texts: list[bytes], doc: np.ndarray, group: np.ndarray) -> list[Runs]:
    """The terms of a block of texts by length: up to 8 bytes, up to 16 bytes, then each longer length."""
    raw = np.frombuffer(b" ".join(texts) + b" " * 16, np.uint8)
    edges = np.flatnonzero(np.diff(IS_TERM[raw].view(np.int8), prepend=np.int8(0)))
    b = LOWER[raw]
    start, length = edges[::2], edges[1::2] - edges[::2]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    of = np.searchsorted(begin, start, "right") - 1
    doc, group = doc[of], group[of]
    one = np.ones(len(start), np.int64)
    made = []
    for low, high in ((1, 8), (9, 16)):
        m = np.flatnonzero((length >= low) & (length <= high))
        s, n = start[m], length[m]
        term = (words_of(b, s, np.minimum(n, 8)),) if high == 8 else (words_of(b, s, np.full(len(s), 8)), words_of(b, s + 8, n - 8))
        made.append(Runs(group[m], doc[m], term, one[m]))
    for n in np.unique(length[length > 16]).tolist():
        m = np.flatnonzero(length == n)
        held = np.empty((len(m), n), np.uint8)
        for row, s in zip(held, start[m], strict=True):
            row[:] = b[s : s + n]
        made.append(Runs(group[m], doc[m], (held.reshape(-1).view(f"S{n}"),), one[m]))
    return made


def together(parts: list[Runs]) -> Runs:
    return Runs(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("group", "doc")), tuple(np.concatenate(t) for t in zip(*(p.term for p in parts), strict=True)), np.concatenate([p.n for p in parts]))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about a block, cut where no term is."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        end = at + BLOCK_BYTES
        while end < len(text) and IS_TERM[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of each group in each block of lang, source and text."""

    def flush(block: list[list[Runs]], groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        by_kind: dict[tuple, list[Runs]] = {}
        for part in block:
            for runs in part:
                if len(runs.n):
                    by_kind.setdefault((len(runs.term), runs.term[0].dtype.str), []).append(runs)
        for parts in by_kind.values():
            runs, docs = (together(parts) if len(parts) > 1 else parts[0]).of_documents().of_groups()
            names = [pa.array(x, pa.utf8()).take(pa.array(runs.group)) for x in zip(*groups, strict=True)]
            yield pa.record_batch([*names, term_strings(runs.term), pa.array(runs.n), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    block: list[list[Runs]] = []
    groups: dict[tuple[str, str], int] = {}
    texts: list[bytes] = []
    doc: list[int] = []
    size, number = 0, 0

    def pack() -> None:
        if texts:
            ids = np.array(doc, np.uint32)
            block.append(packed(texts, ids[:, 0], ids[:, 1]))
            texts.clear()
            doc.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).cast(pa.binary()).to_pylist() if k == 2 else batch.column(k).to_pylist() for k in range(3)), strict=True):
            group = groups.setdefault((lang, source), len(groups))
            if len(text) > BLOCK_BYTES:
                for piece in pieces(text):
                    pack()
                    block.append([r.of_documents() for r in packed([piece], np.array([number], np.uint32), np.array([group], np.uint32))])
                size = BLOCK_BYTES
            elif text:
                texts.append(text)
                doc.append((number, group))
                size += len(text)
            number += 1
            if size >= BLOCK_BYTES:
                pack()
                yield from flush(block, list(groups))
                block, groups, size, number = [], {}, 0, 0
    pack()
    yield from flush(block, list(groups))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 kept)), exact beyond the range of a long."""
    return F.expr("1L") + F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * kept).cast("decimal(20,0)"))


def strays(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, q, value, rank: part `pair` compares a source with each other one of its language over
    all kept terms, part `term` names its `top` most overused kept terms."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = rows.mapInArrow(counted, COUNTED).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # One row for each kept term: the sources that have it are at most those of the language.
    terms = cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("has")).where(F.col("docs") >= min_docs).select("lang", "term", "n", "has"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    sums = terms.select("lang", F.explode("has").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("own"), F.count("*").alias("own_terms"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "own_terms", "kept", "total"])
    zero = F.when(F.col("kept") > 0, share(F.lit(0), F.col("own"), F.col("kept"))).otherwise(F.lit(1))
    groups = cut(groups.withColumn("p0", zero))

    sent = F.broadcast(groups) if groups.count() <= SENT_ROWS else groups
    shares = terms.select("lang", "term", "n", F.explode("has").alias("h")).withColumn("source", F.col("h.source")).join(sent, ["lang", "source"])
    shares = cut(shares.select("lang", "term", "source", share(F.col("h.n"), F.col("own"), F.col("kept")).alias("p"), "p0", share(F.col("n"), F.col("total"), F.col("kept")).alias("q")))

    a, b = F.col("a"), F.col("b")
    f = strays(a["p"], b["p"]) - strays(a["p"], b["p0"]) - strays(a["p0"], b["p"]) + strays(a["p0"], b["p0"])
    has = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("has"))
    common = has.select("lang", "has", F.explode("has").alias("a")).select("lang", "a", F.explode("has").alias("b")).where(a["source"] != b["source"]).groupBy("lang", a["source"].alias("source"), b["source"].alias("item")).agg(F.sum(f).alias("common"))

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own_terms").alias("item_terms"))
    pairs = groups.join(others, "lang").where(F.col("source") != F.col("item"))
    often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    against = often.join(others.select("lang", "item", "q0"), "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.col("times") * strays(F.col("p"), F.col("q0"))).alias("against"))
    pairs = pairs.join(against, ["lang", "source", "item"], "left").join(against.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("against").alias("back")), ["lang", "source", "item"], "left").join(common, ["lang", "source", "item"], "left").na.fill(0, ["against", "back", "common"])
    rest = (F.col("kept") - F.col("own_terms") - F.col("item_terms")) * strays(F.col("p0"), F.col("q0"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("against") + F.col("back") + F.col("common") + rest).alias("value"))

    first = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    over = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), strays(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(first)).unionByName(over)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
every AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT e.lang, e.source, coalesce(sum(c.n), 0) AS own FROM every e LEFT JOIN counts c ON c.lang = e.lang AND c.source = e.source GROUP BY e.lang, e.source),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.own + 2 * l.v)::HUGEINT AS p, 1 + ({SCALE}::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q
  FROM sums s JOIN langs l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sum_f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM every a JOIN every b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sum_f f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
over_terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over_terms))
SELECT lang, source, part, item, value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= {TOP_TERMS}
"""
