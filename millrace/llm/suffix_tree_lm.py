"""Language-model scores of a probabilistic suffix tree over words, learned from the training documents of a table.

Symbols are lower-cased (A-Z only) words and one end for each document. The root gives a word of c of the N training
tokens the base probability (c + 0.1) / (N + 0.1 (V + 1)). A context of up to `DEPTH` preceding words (the start of a
document counts as a word) is a state of the tree if it passes a divergence test: with n training occurrences and c for
each successor seen at least `KEPT` times,
  sum c log10((c - D) / (n Q)) + (n - sum c) log10(1 - K / n) >= `GAIN`,
where Q is the successor's probability in the next shorter state and K = sum (c - D): what the state adds to the log
probability of what follows it. A state's distribution is smoothed by the shorter one, ((c - D) + (n - K) Q) / n, and is
a distribution over all words, unknown ones included. A token is scored by its longest suffix that is a state.

How it runs. Texts become chunks of hashed tokens, written once as a table that is bucketed by chunk. Then chunks ask
and buckets of hashes answer, in DEPTH + 2 rounds: a chunk sends each different n-gram (or context) once with its counts,
a bucket adds them up and answers what the whole corpus has. So a word or word pair that makes up a third of all tokens
is one entry of a chunk like any other. An n-gram is asked for only if both (n-1)-grams in it have `KEPT` occurrences;
one of the chunks that have a frequent n-gram, its owner, adds it to the sums of its context. Nothing but N and V reaches
the driver; what is gathered grows with the different n-grams. Chunks and buckets hold a bounded number of text bytes,
and shuffle files go round by round.

Defined results: null and empty texts have the end only; a null doc_id learns; a long text is cut into chunks between
words, with the words in front of each cut as its context, and is scored as one; repeated rows and ids are documents of
their own; without training documents every probability is that of the one unknown word, 1; ties don't arise; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaning, cut, span_hashes, table

DEPTH, KEPT, DISCOUNT, GAIN, ADDED = 2, 2, 0.75, 2.0, 0.1
#: Text bytes of a chunk, and those whose n-grams a bucket answers for.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
START, END = U(0x5157AB1E0D15EA5E), U(0xE2D0F7EC7C0FFEE1)
ASKED = "bucket int, chunk long, what int, data binary"
ANSWERED = "chunk long, what int, bucket int, data binary, different long"


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """8-byte numbers as compressed bytes, by places; `rising` ones as differences."""
    import zstandard

    x = np.ascontiguousarray(x)
    if rising and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(b: bytes, dtype: type, rising: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    x = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(dtype)
    return np.cumsum(x, dtype=dtype) if rising else x


def framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframed(b: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        parts.append(b[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


def different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, a place of each, and each place's number among them."""
    order = np.argsort(h)
    first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0) if len(h) else order
    number = np.empty(len(h), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    return h[order[first]], order[first], number


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each text."""
    joined = np.frombuffer((b" ".join(texts) + b" ").lower(), np.uint8)
    edges = np.flatnonzero(np.diff((~IS_SPACE[joined]).view(np.int8), prepend=np.int8(0)))
    start, stop = edges[::2], edges[1::2]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mixed(span_hashes(joined, start, stop)), np.diff(np.searchsorted(start, begin))


def cuts(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about a chunk that end between words."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        end = at + CHUNK_BYTES
        while end < len(text) and not IS_SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def chunked(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """Chunks of doc_id, train and text: the documents' ids, then numbers of 8 bytes for each part of a document (its key,
    preceding tokens, tokens, whether it trains and is the first part), the different tokens and each token's place."""
    partition = TaskContext.get().partitionId() if TaskContext.get() else 0
    parts: list[tuple] = []
    size, made, key = 0, 0, partition << 32

    def flush() -> tuple[pa.RecordBatch, np.ndarray]:
        nonlocal made
        words, count = tokens([p[4] for p in parts])
        lead = np.array([len(p[3]) for p in parts])
        length = lead + count + np.array([p[5] for p in parts])
        begin = np.cumsum(length) - length
        all_tokens = np.full(int(length.sum()), END)
        for p, b in zip(parts, begin.tolist(), strict=True):
            all_tokens[b : b + len(p[3])] = p[3]
        all_tokens[np.repeat(begin + lead - (np.cumsum(count) - count), count) + np.arange(len(words))] = words
        found, _, place = different(all_tokens)
        train = np.array([p[2] for p in parts])
        facts = np.stack([np.array([p[0] for p in parts]), lead, length, train, np.array([p[6] for p in parts])]).astype(np.int64)
        data = framed(packed(facts.reshape(-1)), packed(found, rising=True), packed(place))
        chunk = partition << 32 | made
        made += 1
        last = np.concatenate([parts[-1][3], words[len(words) - count[-1] :]])[-depth:]
        row = pa.record_batch([pa.array([chunk], pa.int64()), pa.array([[p[1] for p in parts]], pa.list_(id_type)), pa.array([data], pa.binary()), pa.array([int(((length - lead) * train).sum())], pa.int64()), pa.array([size], pa.int64())], ["chunk", "ids", "data", "train_tokens", "bytes"])
        parts.clear()
        return row, last

    for batch in batches:
        for doc_id, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            lead, first = np.array([START]), True
            pieces = [text] if len(text) <= CHUNK_BYTES else cuts(text)
            before = 0
            for piece in pieces:
                before += len(piece)
                whole = before == len(text)
                parts.append((key, doc_id, train, lead, piece, whole, first))
                size += len(piece) + 8
                if size >= CHUNK_BYTES or not whole:
                    row, lead = flush()
                    size, first = 0, False
                    yield row
            key += 1
    if parts:
        yield flush()[0]


class Chunk:
    """A chunk's tokens and what was answered about them."""

    def __init__(self, data: bytes, buckets: int, total: int, known: int):
        facts, found, place = unframed(data)
        self.key, lead, self.length, train, first = unpacked(facts, np.int64).reshape(5, -1)
        self.buckets, self.total, self.known = buckets, total, known
        self.begin = np.cumsum(self.length) - self.length
        n = int(self.length.sum())
        self.at = np.arange(n) - np.repeat(self.begin, self.length)  # place in the part
        self.scored = self.at >= np.repeat(lead, self.length)
        self.counted = np.repeat(train, self.length).astype(bool) & (self.scored | ((self.at == 0) & np.repeat(first, self.length).astype(bool)))
        place = unpacked(place, np.int64)
        #: By n: hashes at all places, different ones, a place of each, numbers at all places (-1: not asked), counts, owner.
        self.hash, self.different, self.place, self.number = [None], [None], [None], [None]
        self.count, self.owner, self.mass = [None], [None], [None]
        words = unpacked(found, U, rising=True)
        self.hash.append(words[place])
        self.different.append(words)
        self.place.append(np.zeros(0, np.int64))
        self.number.append(place)

    def spans(self, h: np.ndarray) -> np.ndarray:
        """Where the buckets of hashes in order end."""
        bucket = (h >> U(32)) * U(self.buckets) >> U(32)
        return np.searchsorted(bucket, np.arange(self.buckets + 1))

    def longer(self) -> None:
        """The n-grams of the next length."""
        n = len(self.hash)
        h, number, count = self.hash[-1], self.number[-1], self.count[-1]
        often = np.append(count, 0)[number] >= KEPT
        ok = np.zeros(len(h), bool)
        ok[1:] = (self.at[1:] >= n - 1) & often[1:] & often[:-1]
        made = np.zeros(len(h), U)
        made[1:] = mixed(h[:-1] * U(0x9E3779B97F4A7C15) + self.hash[1][1:])
        where = np.flatnonzero(ok)
        values, place, short = different(made[where])
        number = np.full(len(h), -1)
        number[where] = short
        self.hash.append(made)
        self.different.append(values)
        self.place.append(where[place])
        self.number.append(number)

    def learn(self, n: int, data: bytes) -> None:
        answer = unpacked(data, U)
        self.count.append((answer >> U(1)).astype(np.int64))
        self.owner.append((answer & U(1)).astype(bool))

    def weights(self, n: int) -> np.ndarray:
        m = self.counted & (self.number[n] >= 0) & (self.scored | (n == 1))
        return np.bincount(self.number[n][m], minlength=len(self.different[n]))

    def contexts(self, n: int) -> np.ndarray:
        """Numbers of the n-grams in front of each place; -1 where there is none."""
        found = np.full(len(self.at), -1)
        found[1:] = np.where(self.at[1:] >= n, self.number[n][:-1], -1)
        return found

    def base(self) -> np.ndarray:
        return (self.count[1] + ADDED) / (self.total + ADDED * (self.known + 1))

    def probability(self, depth: int) -> np.ndarray:
        """For each place, given contexts of up to `depth` words."""
        p = self.base()[self.number[1]]
        for n in range(1, depth + 1):
            context = self.contexts(n)
            times = np.maximum(np.append(self.count[n], 1)[context], 1)
            mass = np.append(self.mass[n], -1.0)[context]
            c = np.append(self.count[n + 1], 0)[self.number[n + 1]]
            p = np.where(mass < 0, p, (np.where(c >= KEPT, c - DISCOUNT, 0) + (times - mass) * p) / times)
        return p

    def questions(self, n: int) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, n, hashes and training counts of the n-grams)."""
        h, w = self.different[n], self.weights(n)
        span = self.spans(h)
        for b in range(self.buckets):
            if span[b] < span[b + 1]:
                s = slice(span[b], span[b + 1])
                yield b, n, framed(packed(h[s], rising=True), packed(w[s]))

    def of_context(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams that may be states, and for them their successors and the sums that this chunk owns."""
        context = self.contexts(n)
        used = np.zeros(len(self.different[n]) + 1, bool)
        used[context] = True
        asked = np.flatnonzero(used[:-1] & (self.count[n] >= KEPT))
        c = self.count[n + 1]
        mine = np.flatnonzero(self.owner[n + 1] & (c >= KEPT))
        place = self.place[n + 1][mine]
        of, c = context[place], c[mine]
        q = self.probability(n - 1)[place]
        gain = c * np.log10((c - DISCOUNT) / (self.count[n][of] * q))
        size = len(self.different[n])
        sums = np.stack([self.count[n].astype(float), np.bincount(of, minlength=size).astype(float), np.bincount(of, c, minlength=size), np.bincount(of, gain, minlength=size)])
        return asked, sums[:, asked]

    def questions_of_contexts(self, n: int) -> Iterator[tuple[int, int, bytes]]:
        asked, sums = self.of_context(n)
        h = self.different[n][asked]
        span = self.spans(h)
        for b in range(self.buckets):
            if span[b] < span[b + 1]:
                s = slice(span[b], span[b + 1])
                yield b, -n, framed(packed(h[s], rising=True), packed(sums[:, s].reshape(-1)))

    def learn_contexts(self, n: int, data: bytes) -> None:
        asked, mass = self.of_context(n)[0], np.full(len(self.different[n]), -1.0)
        mass[asked] = unpacked(data, np.float64)
        self.mass.append(mass)


def rounds_of(chunk: Chunk, answers: dict[tuple[int, int], bytes], done: int, depth: int) -> None:
    """Replays `done` rounds of answers: round r answers the r-grams and the contexts of r - 2 words."""

    def of(what: int, dtype: type) -> bytes:
        parts = [unpacked(answers[k], dtype) for k in sorted(k for k in answers if k[0] == what)]
        return packed(np.concatenate(parts) if parts else np.zeros(0, dtype))

    for r in range(1, done + 1):
        if r <= depth + 1:
            if r > 1:
                chunk.longer()
            chunk.learn(r, of(r, U))
        if r >= 3:
            chunk.learn_contexts(r - 2, of(2 - r, np.float64))


def asking(done: int, depth: int, buckets: int, total: int, known: int) -> Callable:
    """A chunk's questions of the round after `done` ones."""

    def ask(data: bytes, answers: dict[tuple[int, int], bytes]) -> Iterator[tuple[int, int, bytes]]:
        chunk = Chunk(data, buckets, total, known)
        rounds_of(chunk, answers, done, depth)
        r = done + 1
        if r <= depth + 1:
            if r > 1:
                chunk.longer()
            yield from chunk.questions(r)
        if r >= 3:
            yield from chunk.questions_of_contexts(r - 2)

    return ask


def scoring(depth: int, buckets: int, total: int, known: int) -> Callable:
    """Scores of the parts of documents of a chunk: key, tokens, known tokens, base and score."""

    def score(data: bytes, answers: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, ...]:
        chunk = Chunk(data, buckets, total, known)
        rounds_of(chunk, answers, depth + 2, depth)
        sums = lambda x: np.add.reduceat(np.where(chunk.scored, x, 0), chunk.begin)
        count = chunk.count[1][chunk.number[1]]
        base = np.log10(chunk.base())[chunk.number[1]]
        return chunk.key, sums(1), sums((count > 0).astype(np.int64)), sums(base), sums(np.log10(chunk.probability(depth)))

    return score


def answered(asked: pa.Table) -> pa.Table:
    """One bucket's answers: for n-grams twice their count in training (0 below KEPT but for words), plus one for the
    chunk that owns it; for contexts the mass of the kept successors, or -1 if it is no state."""
    asked = asked.sort_by("chunk")
    what, bucket = asked.column("what")[0].as_py(), asked.column("bucket")[0].as_py()
    parts = [unframed(b) for b in asked.column("data").to_pylist()]
    h = [unpacked(p[0], U, rising=True) for p in parts]
    ends = np.cumsum([len(x) for x in h])
    h = np.concatenate(h)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
    of = np.empty(len(h), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    different = 0
    if what > 0:
        w = np.concatenate([unpacked(p[1], np.int64) for p in parts])
        count = np.add.reduceat(w[order], first)
        if what == 1:
            different = int(((count > 0) & (h[order[first]] != START)).sum())
        else:
            count[count < KEPT] = 0
        found = (count[of] << 1).astype(U)
        found[order[first]] |= U(1)
    else:
        n, successors, times, gain = (np.concatenate(x) for x in zip(*(unpacked(p[1], np.float64).reshape(4, -1) for p in parts), strict=True))
        successors, times, gain = (np.add.reduceat(x[order], first) for x in (successors, times, gain))
        n = n[order[first]]
        mass = times - DISCOUNT * successors
        keeps = (successors > 0) & (gain + (n - times) * np.log10(1 - mass / n) >= GAIN)
        found = np.where(keeps, mass, -1.0)[of]
    data = [packed(x) for x in np.split(found, ends[:-1])]
    size = len(data)
    return pa.table({"chunk": asked.column("chunk"), "what": pa.array([what] * size, pa.int32()), "bucket": pa.array([bucket] * size, pa.int32()), "data": pa.array(data, pa.binary()), "different": pa.array([different] + [0] * (size - 1), pa.int64())})


def given(answers: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(w, b): d for w, b, d in zip(*(answers.column(k).to_pylist() for k in ("what", "bucket", "data")), strict=True)}


def of_stream(ask: Callable) -> Callable:
    def run(key: tuple, stream: pa.Table) -> pa.Table:
        return of_stream_and_answers(ask)(key, stream, None)

    return run


def of_stream_and_answers(ask: Callable) -> Callable:
    def run(key: tuple, stream: pa.Table, answers: pa.Table | None) -> pa.Table:
        found = list(ask(stream.column("data")[0].as_py(), given(answers) if answers is not None else {})) if stream.num_rows else []
        bucket, what, data = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(found), pa.int64()), "what": pa.array(what, pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def scored(docs: DataFrame, train: str, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`; rows whose `train` (SQL) is true
    are learned from."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.expr(train).alias("train"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    name = f"suffix_tree_{uuid.uuid4().hex}"
    buckets_of_chunks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = rows.mapInArrow(lambda b: chunked(b, arrow_id, depth), f"chunk long, ids array<{id_type.simpleString()}>, data binary, train_tokens long, bytes long")
    made.write.bucketBy(buckets_of_chunks, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    total, size = (x or 0 for x in chunks.agg(F.sum("train_tokens"), F.sum("bytes")).first())
    buckets = max(-(-size // BUCKET_BYTES), 2 * spark.sparkContext.defaultParallelism)
    known, answers = 0, None
    data = chunks.select("chunk", "data")
    for done in range(depth + 2):
        ask = asking(done, depth, buckets, total, known)
        with cleaning(spark):
            if answers is None:
                questions = data.groupBy("chunk").applyInArrow(of_stream(ask), ASKED)
            else:
                questions = data.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(of_stream_and_answers(ask), ASKED)
            new = cut(questions.groupBy("bucket", "what").applyInArrow(answered, ANSWERED))
        if done == 0:
            known = new.agg(F.sum("different")).first()[0] or 0
        answers = new if answers is None else answers.unionByName(new)
    score = scoring(depth, buckets, total, known)

    def result(stream: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["key", "doc_id", "n_tokens", "n_known", "base_score", "score"]
        if not stream.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), arrow_id, pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        key, n, n_known, base, full = score(stream.column("data")[0].as_py(), given(answers))
        return pa.table([pa.array(key), stream.column("ids").combine_chunks().flatten(), pa.array(n), pa.array(n_known), pa.array(base), pa.array(full)], names)

    parts = chunks.select("chunk", "ids", "data").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(result, f"key long, doc_id {id_type.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    found = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    found = cut(found.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"))
    spark.sql(f"DROP TABLE {name}")
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "coalesce(crc32(cast(doc_id AS string)) % 10 = 0, false)"
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), f"not {held_out}")
    return found.withColumn("held_out", F.expr(held_out)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
