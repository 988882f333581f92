"""Exact SentencePiece BPE encoding by backtracking, and decoding.

The published backtracking scheme: an Aho-Corasick automaton gives the longest piece at each position; a piece is
taken if it is compatible with the piece before it, which is so when merging the two pieces' characters again gives
these two pieces; otherwise the next shorter piece is tried, and when none is left the last piece is taken back and
its end is marked as failed in a bitfield. The result equals the greedy merge order, in linear time for real texts.

Pieces of the supported models hold the space mark only as a prefix, so text falls into units (a run of space marks
and what follows it) which encode on their own, each different one once; what a worker keeps of them is bounded by
`KEPT_BYTES`.

Defined results: null counts as empty; an empty text has only the end id; texts of any length are encoded whole, a long
one in pieces of whole units; characters that no piece has become byte pieces; equal texts, and so repeated rows and
ids, have equal ids; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, free_name, table

SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Characters of a text that are cut into units at once, about.
PART_CHARS = 1 << 20
PART = re.compile(r"(?<=[^ \n])(?= )")
#: Bytes of units with their ids that a worker keeps, about, and pairs of pieces known to be compatible or not.
KEPT_BYTES, KEPT_PAIRS = 48 << 20, 1 << 17

codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class PieceCodec:
    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.end = model.eos_id()
        self.unknown = model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in ids]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: (-model.get_score(i), i) for p, i in normal.items()}
        self.score = {p: r[0] for p, r in self.rank.items()}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space mark behind another character")
        self.letters = {p for p in normal if len(p) == 1}
        # A piece that merging its own characters doesn't give can never be part of a result.
        self.ids = {p: i for p, i in normal.items() if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p) - 1)
        self.automaton.make_automaton()
        self.shorter = {p: next((n for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), 0) for p in self.ids}
        self.compatible = lru_cache(KEPT_PAIRS)(self._compatible)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        raw = [byte_of.get(i) or (" ⁇ ".encode() if i == self.unknown else b"" if special[i] else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        self.raw = pa.array(raw, pa.binary())
        self.starts_space = np.array([not special[i] and p.startswith(SPACE) for i, p in enumerate(self.pieces)])
        self.silent = np.array([model.is_control(i) for i in ids])

    def merged(self, text: str) -> list[str]:
        """Plain greedy merging, best score first and leftmost among equals: only for strings of a piece or two."""
        parts = list(text)
        never = float("inf")
        score = self.score.get
        costs = [score(a + b, never) for a, b in pairwise(parts)]
        while costs and (best := min(costs)) < never:
            k = costs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = score(parts[k - 1] + parts[k], never)
            if k < len(costs):
                costs[k] = score(parts[k] + parts[k + 1], never)
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def known(self, text: str) -> list[str]:
        """Pieces of a text that has only characters which are pieces."""
        if text in self.ids:
            return [text]
        longest = [1] * len(text)
        for end, n in self.automaton.iter(text):  # the ends rise, so the longest from each start comes last
            longest[end - n] = n + 1
        out: list[str] = []
        failed = bytearray(len(text) // 8 + 1)  # a bit for each place
        at, take, n_all = 0, longest[0], len(text)
        compatible, shorter = self.compatible, self.shorter
        while at < n_all:
            piece = text[at : at + take]
            end = at + take
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or compatible(out[-1], piece)):
                out.append(piece)
                at = end
                if at < n_all:
                    take = longest[at]
                continue
            while True:
                take = shorter[text[at : at + take]]
                if take:
                    break
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no segmentation")
                take = len(out.pop())
                at -= take
        return out

    def _unit(self, unit: str) -> bytes:
        letters, ids = self.letters, self.ids
        if letters.issuperset(unit):
            return array("i", [ids[p] for p in self.known(unit)]).tobytes()
        found: list[int] = []
        start = 0
        for k, c in enumerate(unit):
            if c not in letters:
                if start < k:
                    found += [self.ids[p] for p in self.known(unit[start:k])]
                found += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = k + 1
        if start < len(unit):
            found += [self.ids[p] for p in self.known(unit[start:] if start else unit)]
        return array("i", found).tobytes()

    def part_bytes(self, text: str) -> bytes:
        """Ids of whole units. What is kept is of two ages: units that come again get young again, and the older ones go
        when the young ones take half of the bound."""
        if self.kept_bytes > KEPT_BYTES // 2:
            self.older, self.kept, self.kept_bytes = self.kept, {}, 0
        units, kept, older = UNITS.findall(text), self.kept, self.older
        for u in set(units).difference(kept):
            kept[u] = ids = older.get(u) or self._unit(u)
            self.kept_bytes += 150 + 2 * len(u) + len(ids)  # with what the dictionary takes
        return b"".join(map(kept.__getitem__, units))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as 32-bit integers, with the end id."""
        parts, at = [], 0
        while at < len(text):
            found = PART.search(text, at + PART_CHARS)
            end = found.start() if found else len(text)
            part = text[at:end].replace(" ", SPACE)
            parts.append(self.part_bytes(part if at else SPACE + part))
            at = end
        parts.append(np.int32(self.end).tobytes())
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), np.int32).tolist()

    def encode_lists(self, texts: list[str]) -> pa.ListArray:
        made = [self.encode_bytes(t) for t in texts]
        offsets = np.zeros(len(made) + 1, np.int32)
        np.cumsum([len(m) // 4 for m in made], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))

    def runs(self, ids: list[int]) -> list[list[int]]:
        """Ids between control ids."""
        out: list[list[int]] = [[]]
        for i in ids:
            if self.silent[i]:
                out.append([])
            else:
                out[-1].append(i)
        return out

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. Bytes that are no UTF-8 become U+FFFD one by one; the first space mark is dropped."""
        offsets = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False)
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.raw.take(pa.array(values, pa.int32()))), pa.scalar(b"", pa.binary()))
        out = []
        for k, raw in enumerate(joined.to_pylist()):
            at, end = offsets[k], offsets[k + 1]
            while at < end and self.silent[values[at]]:
                at += 1
            if at < end and self.starts_space[values[at]]:
                raw = raw[1:]
            if self.silent[values[at : end - 1]].any():  # a control id inside ends a run of byte pieces
                out.append("".join(b"".join(self.raw[i].as_py() for i in run).decode("utf-8", "one_byte") for run in self.runs(values[at:end].tolist()))[bool(at < end and self.starts_space[values[at]]) :])
                continue
            out.append(raw.decode("utf-8", "one_byte"))
        return pa.array(out, pa.string())


_codecs: dict[bytes, PieceCodec] = {}


def codec(proto: bytes) -> PieceCodec:
    """The codec of a model, made once in each process."""
    if proto not in _codecs:
        _codecs.clear()
        _codecs[proto] = PieceCodec(proto)
    return _codecs[proto]


def encode_column(spark: SparkSession, model_path: str) -> callable:
    """A column function from text to array<int> of ids with the end id. The model file is read on the driver."""
    proto = spark.sparkContext.broadcast(open(model_path, "rb").read())  # its size doesn't depend on the data

    return arrow_column(lambda texts: codec(proto.value).encode_lists(texts), "array<int>")


def both_column(spark: SparkSession, model_path: str) -> callable:
    """A column function from text to struct<ids, decoded>, decoded being made of the ids: one worker for each core does
    both, where two columns would keep two."""
    proto = spark.sparkContext.broadcast(open(model_path, "rb").read())

    def rows(texts: list[str]) -> pa.Array:
        ids = codec(proto.value).encode_lists(texts)
        return pa.StructArray.from_arrays([ids, codec(proto.value).decode_lists(ids)], ["ids", "decoded"])

    return arrow_column(rows, "struct<ids:array<int>,decoded:string>")


def decode_column(spark: SparkSession, model_path: str) -> callable:
    """A column function from array<int> of ids to text; null is read as no ids."""
    from collections.abc import Iterator

    from .common import slices

    proto = spark.sparkContext.broadcast(open(model_path, "rb").read())

    def run(batches):
        for batch in batches:
            batch = pc.fill_null(batch.cast(pa.list_(pa.int32())), pa.scalar([], pa.list_(pa.int32())))
            if not len(batch):
                yield pa.array([], pa.string())
            for part in slices(batch):
                part = pa.concat_arrays([part])
                flat = part.flatten()
                offsets = pc.subtract(part.offsets, part.offsets[0])
                yield codec(proto.value).decode_lists(pa.ListArray.from_arrays(offsets, flat))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of `docs` and `ids`: array<int> of the whole text. A column of that name is replaced."""
    return docs.withColumn(ids, encode_column(docs.sparkSession, model_path)(F.col(f"`{text}`").cast("string")))


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of `rows` and `text`, decoded from `ids`. A column of that name is replaced."""
    return rows.withColumn(text, decode_column(rows.sparkSession, model_path)(F.col(f"`{ids}`")))


def encode_and_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns of `docs`, `ids` of the whole text and `decoded`, made of the ids. Columns of these names are
    replaced."""
    both = free_name(docs, "both")
    made = docs.withColumn(both, both_column(docs.sparkSession, model_path)(F.col(f"`{text}`").cast("string")))
    return made.withColumn("ids", F.col(both)["ids"]).withColumn("decoded", F.col(both)["decoded"]).drop(both)


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_and_decode(docs, path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
