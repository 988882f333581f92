"""Spelling variant grouping: each word's near words, its usual form and the root of its chain of forms.

Words are the lower-cased (A-Z only) runs of Latin letters up to U+00FF of all texts, `MIN_CHARS` code points at least
and `MIN_TIMES` occurrences; one run in `SLIP` for each document, chosen by crc32, loses a letter first. Two words are
near if one inserted, deleted or replaced code point makes one of the other.

Near words are found by search schemes over a bidirectional FM-index. One error leaves the first or the second half of
the word whole, so each word is filed under its first halves and its last halves, for its own length and the lengths
next to it, and looked up under its own two halves. Groups of halves make shards of about `SHARD_WORDS` filings. For each
shard an FM-index of the delimited words and one of the delimited reversed words are built, whose intervals of suffix
ranks move together: the whole half is matched towards the word's edge and its delimiter, keeping both intervals, then
the other half is matched away from it with exactly one error, all words of the shard side by side. No pairs of a group
are listed; the work follows the words and the near words that exist. Halves with more words than a shard are split by a
hash of the word, and each of their words is looked up in every part.

A pair whose first half is whole is reported by that search alone, so that counts need no table of pairs. Words give a
row for each lookup (near words found, the best of them); chains of forms are followed by doubling, with one checkpoint
a step; a form has twice the occurrences, so chains are short.

Defined results: null and empty texts have no words, a null doc_id counts as ''; very long texts are read piece by piece;
ties of occurrences go to the first word in code-point order; repeated rows count again; without words there are no
rows; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

MIN_CHARS, MIN_TIMES, SLIP, RATIO = 5, 3, 97, 2
#: Filings of an index, the characters of a long text that are read at once, the entries of counted words that are kept
#: in a task, and the bytes of a table of ranks.
SHARD_WORDS, PIECE_CHARS, KEPT_WORDS, RANK_BYTES = 16_384, 1 << 20, 1 << 18, 32 << 20
#: Halves with more filings than a shard are sent to all executors up to this number.
SENT_ROWS = 100_000
RUN, OTHER = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
FOUND = "word string, n long, n_near long, best_n long, best string"


def runs(text: str) -> Counter:
    """Lower-cased runs of a text, counted; a long text is read in pieces that end between runs."""
    if len(text) <= PIECE_CHARS:
        return Counter(RUN.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        end = OTHER.search(text, at + PIECE_CHARS)
        stop = end.start() if end else len(text)
        found.update(RUN.findall(text[at:stop]))
        at = stop
    return found


def slipped(doc_id: str, run: str) -> str:
    h = crc32(f"{doc_id}:{run}".encode())
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of doc_id (string) and text with their occurrences, added up in blocks."""

    def flush() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(list(total), pa.utf8()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return made

    total: dict[str, int] = {}
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            for run, n in runs(raw.lower().decode("utf-8", "replace")).items():
                if len(run) >= MIN_CHARS:
                    word = slipped(doc_id, run)
                    if len(word) >= MIN_CHARS:
                        total[word] = total.get(word, 0) + n
            if len(total) >= KEPT_WORDS:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word and n of the words that occur at least MIN_TIMES times."""
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TIMES)


class FMIndex:
    """Suffix ranks of words, each between delimiters (code 0). `words` are different, Latin-1 and in order."""

    def __init__(self, words: list[str], codes: np.ndarray):
        text = codes[np.frombuffer(b"\0" + b"".join(w.encode("latin-1") + b"\0" for w in words), np.uint8)]
        n, self.size = len(words), len(text)
        ends = np.flatnonzero(text == 0)
        # Delimiters are ordered as what follows them: the last one first, then by the words.
        rank = text.astype(np.int64) + n
        rank[ends] = np.arange(1, n + 2)
        rank[ends[-1]] = 0
        step = 1
        while True:
            key = rank * (self.size + n + 300)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key)
            rank = np.empty(self.size, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            if rank[order[-1]] == self.size - 1 or step >= self.size:
                break
            step *= 2
        self.word = np.searchsorted(ends, order, "right") - 1  # the word at or behind a suffix's delimiter
        self.before = text[order - 1]
        width = int(codes.max()) + 1  # the last code is that of letters which no word has
        self.first = np.zeros(width + 1, np.int64)
        self.first[1:] = np.cumsum(np.bincount(text, minlength=width))
        self.shift = 0
        while (self.size >> self.shift) * width * 4 > RANK_BYTES:
            self.shift += 1
        blocks = (self.size >> self.shift) + 2
        held = np.bincount((np.arange(self.size) >> self.shift) * width + self.before, minlength=blocks * width).reshape(blocks, width)
        self.ranks = np.zeros((blocks, width), np.int32)
        np.cumsum(held[:-1], axis=0, out=self.ranks[1:])

    def counts(self, at: np.ndarray) -> np.ndarray:
        """For each place the occurrences of every letter in front of it in the transformed text."""
        found = self.ranks[at >> self.shift]
        block = at >> self.shift << self.shift
        for k in range((1 << self.shift) - 1):
            m = np.flatnonzero(block + k < at)
            if not len(m):
                break
            found[m, self.before[block[m] + k]] += 1
        return found

    def step(self, low: np.ndarray, size: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more letter in front."""
        a, b = self.counts(low), self.counts(low + size)
        row = np.arange(len(low))
        return self.first[letter] + a[row, letter], (b[row, letter] - a[row, letter]).astype(np.int64)


def search(toward: FMIndex, away: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of `away`) that differ by one error behind the first `half` letters. Queries are `length` letters
    of the coded `text` from `start` on, with delimiters around them."""
    query = np.arange(len(start))
    low, other, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.full(len(start), toward.size, np.int64)
    for k in range(int(half.max(initial=-1)) + 1):  # the half from its inner end to the delimiter
        m = np.flatnonzero((k <= half) & (size > 0))
        letter = text[start[m] + half[m] - 1 - k]
        a, b = toward.counts(low[m]), toward.counts(low[m] + size[m])
        held, row = b - a, np.arange(len(m))
        other[m] += np.cumsum(held, axis=1, dtype=np.int64)[row, letter] - held[row, letter]
        low[m] = toward.first[letter] + a[row, letter]
        size[m] = held[row, letter]
    m = size > 0
    query, low, size = query[m], other[m], size[m]
    begin, rest = start + half, length - half + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pool = (np.zeros(0, np.int64),) * 4  # query, letters read, interval
    k = 0
    while len(query) or len(pool[0]):
        q, at, lo, n = pool
        if len(q):
            lo, n = away.step(lo, n, text[begin[q] + at])
            at = at + 1
            done = (n > 0) & (at == rest[q])
            found.append((q[done], away.word[lo[done]]))
            m = (n > 0) & ~done
            q, at, lo, n = q[m], at[m], lo[m], n[m]
        new = [(q, at, lo, n)]
        if len(query):
            letter = text[begin[query] + k]
            inner = letter != 0
            new.append((query[inner], np.full(int(inner.sum()), k + 1), low[inner], size[inner]))  # a letter left out
            a, b = away.counts(low), away.counts(low + size)
            held = b - a
            row, code = np.nonzero(held[:, 1:])
            code += 1
            next_low, next_size = away.first[code] + a[row, code], held[row, code].astype(np.int64)
            new.append((query[row], np.full(len(row), k), next_low, next_size))  # a letter put in
            m = inner[row] & (code != letter[row])
            new.append((query[row[m]], np.full(int(m.sum()), k + 1), next_low[m], next_size[m]))  # a letter replaced
            row = np.arange(len(query))
            low, size = away.first[letter] + a[row, letter], held[row, letter].astype(np.int64)
            k += 1
            m = (size > 0) & (k < rest[query])
            query, low, size = query[m], low[m], size[m]
        pool = tuple(np.concatenate(x) for x in zip(*new, strict=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, word = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(q * away.size + word)
    return pairs // away.size, pairs % away.size


def near_words(words: list[str], asked: list[tuple[str, bool]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each side, pairs (place in `asked`, place in `words`) of near words. `words` are different and in order; `asked`
    are words and whether their first half is the whole one (else the last half)."""
    present = np.unique(np.frombuffer("".join(words).encode("latin-1"), np.uint8))
    codes = np.full(256, len(present) + 1)
    codes[0], codes[present] = 0, np.arange(1, len(present) + 1)
    reverse = sorted(range(len(words)), key=[w[::-1] for w in words].__getitem__)
    forward_index, reverse_index = FMIndex(words, codes), FMIndex([words[k][::-1] for k in reverse], codes)
    place = np.array(reverse)
    for side in (True, False):
        chosen = np.array([k for k, (_, first) in enumerate(asked) if first == side], np.int64)
        texts = [asked[k][0] if side else asked[k][0][::-1] for k in chosen]
        text = codes[np.frombuffer(b"\0" + b"".join(w.encode("latin-1") + b"\0" for w in texts), np.uint8)]
        length = np.array([len(w) for w in texts], np.int64)
        start = 1 + np.cumsum(length + 1) - length - 1
        half = length // 2 if side else length - length // 2
        if side:
            q, w = search(forward_index, reverse_index, text, start, length, half)
            w = place[w]
        else:
            q, w = search(reverse_index, forward_index, text, start, length, half)
        q = chosen[q]
        if not side:  # those with a whole first half are the other search's
            m = np.fromiter((not words[b].startswith(asked[a][0][: len(asked[a][0]) // 2]) for a, b in zip(q.tolist(), w.tolist(), strict=True)), bool, len(q))
            q, w = q[m], w[m]
        yield q, w


def looked_up(shard: pa.Table) -> pa.Table:
    """One row for each lookup of a shard: word, n, near words found, and the most frequent of them."""
    rows = list(zip(*(shard.column(k).to_pylist() for k in ("word", "n", "target", "ask_first", "ask_last")), strict=True))
    times = {word: n for word, n, target, _, _ in rows if target}
    words = sorted(times)
    asked = [(word, first) for first, at in ((True, 3), (False, 4)) for word in sorted({r[0] for r in rows if r[at]})]
    own = {r[0]: r[1] for r in rows}
    n_near = np.zeros(len(asked), np.int64)
    best = np.full(len(asked), -1)
    if words:
        n = np.array([times[w] for w in words], np.int64)
        for q, w in near_words(words, asked):
            n_near += np.bincount(q, minlength=len(asked))
            order = np.lexsort((w, -n[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            best[q[first]] = w[first]  # a lookup has one side only
    return pa.table({"word": pa.array([w for w, _ in asked], pa.utf8()), "n": pa.array([own[w] for w, _ in asked], pa.int64()), "n_near": pa.array(n_near), "best_n": pa.array([None if b < 0 else times[words[b]] for b in best.tolist()], pa.int64()), "best": pa.array([None if b < 0 else words[b] for b in best.tolist()], pa.utf8())})


def near(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n, n_near, best_n and best (its most frequent near word) for each row of `words` (word, n)."""
    size = F.char_length("word")
    halves = [f"named_struct('first', true, 'half', substring(word, 1, (size + {d}) div 2)), named_struct('first', false, 'half', right(word, size + {d} - (size + {d}) div 2))" for d in (0, -1, 1)]
    rows = words.withColumn("size", size).withColumn("f", F.explode(F.expr(f"array_distinct(array({', '.join(halves)}))")))
    asks = F.expr("char_length(f.half) = if(f.first, size div 2, size - size div 2)")
    rows = rows.select("word", "n", F.xxhash64("f.first", "f.half").alias("key"), (asks & F.col("f.first")).alias("ask_first"), (asks & ~F.col("f.first")).alias("ask_last"))
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("filings")))
    total = sizes.agg(F.sum("filings")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    hot = sizes.where(F.col("filings") > shard_words).select("key", F.ceil(F.col("filings") / shard_words).cast("long").alias("parts"))
    if (n_hot := hot.count()) == 0:
        rows = rows.withColumn("parts", F.lit(None).cast("long"))
    else:
        rows = rows.join(F.broadcast(hot) if n_hot <= SENT_ROWS else hot, "key", "left")
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("parts"))
    cold = rows.where("parts is null").select(F.lit(0).cast("long").alias("key"), F.pmod("key", F.lit(shards)).alias("part"), "word", "n", F.lit(True).alias("target"), "ask_first", "ask_last")
    spread = rows.where("parts is not null").withColumn("p", F.explode(F.expr("if(ask_first or ask_last, sequence(0L, parts - 1), array(pmod(xxhash64(word, 1), parts)))")))
    spread = spread.select("key", (-1 - F.col("p")).alias("part"), "word", "n", (F.col("p") == own).alias("target"), "ask_first", "ask_last")
    found = cold.unionByName(spread).groupBy("key", "part").applyInArrow(looked_up, FOUND)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def with_roots(words: DataFrame) -> DataFrame:
    """word, form and the other columns of `words` with `root`, where following forms ends; no chain may be a circle."""
    links = cut(words.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("end"))
        links = cut(links.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
        moved = links.where("moved").limit(1).count()
        links = links.drop("moved")
        if not moved:
            return words.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of `docs`."""
    words = near(cut(vocabulary(docs, text, doc_id)), shard_words)
    usual = F.col("best_n") >= RATIO * F.col("n")
    words = cut(words.select("word", "n", "n_near", F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n")))
    return with_roots(words).select("word", "form", "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH RECURSIVE steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
docs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM docs WHERE length(run) >= {MIN_CHARS} GROUP BY id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, steps),
slipped AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substring(run, 1, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_TIMES}),
cuts AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INTEGER AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON b.word = a.rest),
ranked AS (SELECT p.word, p.other, o.n AS other_n, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS place, count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN words o ON o.word = p.other),
forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= {RATIO} * w.n THEN r.other END AS form, CASE WHEN r.other_n >= {RATIO} * w.n THEN r.other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chains AS (SELECT word, word AS here, 0 AS far FROM forms UNION ALL SELECT c.word, f.form, c.far + 1 FROM chains c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, here AS root FROM (SELECT word, here, row_number() OVER (PARTITION BY word ORDER BY far DESC) AS place FROM chains) WHERE place = 1)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""
