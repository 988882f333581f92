"""Media columns of MPEG transport streams: a muxer that stores bytes, and a reader.

The reader follows the public layout of 188-byte packets: it puts together the sections of the program association and
map tables over all their packets and keeps those whose checksums are right, checks the continuity counter of each
elementary stream of each program, reassembles its elementary packets over the payloads, and stores the timestamp, the
place and the random-access mark of each access unit.

Defined results: null text counts as empty and gives one block of padding; a stream that isn't one (null, empty,
wrong length, lost sync, no program, no elementary stream) has a null payload and a reason in `error`; of several sound
map tables of a program the first counts; a lost, repeated or reordered packet shows in `continuity_errors` or
`duplicates`; very long texts are one stream, whole; equal texts, and so repeated rows and ids, give equal streams; an
empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, slices, table

PACKET, BLOCK, UNIT_BYTES, UNITS_PER_ACCESS = 188, 192, 12_288, 8
PMT_PID, ES_PID, PROGRAM, PRIVATE_PES, STREAM_ID, TICKS = 0x1000, 0x0100, 1, 0x06, 0xBD, 3600
STREAM = "struct<error:string,program:int,pmt_pid:int,pid:int,stream_type:int,packets:bigint,continuity_errors:bigint,duplicates:bigint,pts:array<bigint>,unit_offset:array<bigint>,random_access:array<boolean>,payload:binary>"


@lru_cache(4096)
def checksum(section: bytes) -> int:
    """CRC-32 of MPEG-2 sections: polynomial 0x04C11DB7, not reflected; 0 over a section with its own checksum."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + checksum(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = (0x47000010 | 0x4000 << 8 | pid << 8).to_bytes(4, "big")
    return np.frombuffer((head + b"\x00" + section).ljust(PACKET, b"\xff"), np.uint8)


PAT = _table_packet(0, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _unit_packets(number: int, data: bytes, counter: int) -> np.ndarray:
    """Packets of one access unit: clock and access mark in the first, stuffing in the last."""
    pts = number * TICKS & 0x1FFFFFFFF
    pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data
    access = number % UNITS_PER_ACCESS == 0
    room = PACKET - 4 - 8  # behind an adaptation field that has the clock
    n = 1 + max(0, -(-(len(pes) - room) // 184))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
    out[:, 3] = 0x10 | counter + np.arange(n) & 0x0F
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    first = min(room, len(pes))
    out[0, 4] = PACKET - 5 - first
    out[0, 5] = 0x10 | 0x40 * access
    out[0, 6:12] = np.frombuffer((pts << 15 | 0x3F << 9).to_bytes(6, "big"), np.uint8)
    raw = np.frombuffer(pes, np.uint8)
    out[0, PACKET - first :] = raw[:first]
    if n > 1:
        full = (len(pes) - first) // 184
        out[1 : 1 + full, 4:] = raw[first : first + 184 * full].reshape(full, 184)
        if left := len(pes) - first - 184 * full:
            out[-1, 3] |= 0x20
            out[-1, 4] = PACKET - 5 - left
            if left < 183:
                out[-1, 5] = 0
            out[-1, PACKET - left :] = raw[-left:]
    return out


def padded(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")


def mux(payload: bytes) -> bytes:
    """A transport stream with the payload as one private elementary stream."""
    parts, counter, tables = [], 0, 0
    for number, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        if number % UNITS_PER_ACCESS == 0:
            pair = np.stack([PAT, PMT])
            pair[:, 3] |= tables & 0x0F
            tables += 1
            parts.append(pair)
        packets = _unit_packets(number, payload[at : at + UNIT_BYTES], counter)
        counter += len(packets)
        parts.append(packets)
    return b"".join(p.tobytes() for p in parts)


def _sections(packets: np.ndarray) -> Iterator[bytes]:
    """Sound sections of one table, each over as many packets as it has."""
    part, last = None, b""
    for p in packets:
        raw = p.tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        if not raw[3] & 0x10 or at >= PACKET or raw == last:
            continue
        if last and (raw[3] - last[3]) & 0x0F != 1:
            part = None
        last = raw
        if raw[1] & 0x40:  # a section begins behind the end of the one before
            end = at + 1 + raw[at]
            whole = [(part or b"") + raw[at + 1 : end] if part is not None else b"", raw[end:]]
        else:
            whole = [part + raw[at:] if part is not None else b""]
        for part in whole:
            while len(part) >= 3 and part[0] != 0xFF and len(part) >= (n := 3 + ((part[1] & 0x0F) << 8 | part[2])):
                if n >= 12 and checksum(part[:n]) == 0:
                    yield part[:n]
                part = part[n:]
        if not part or part[0] == 0xFF:
            part = None


def streams(stream: bytes | None) -> list[dict]:
    """All elementary streams of all programs, in the order of the tables; or one row with an error."""
    if not stream or len(stream) % PACKET:
        return [{"error": "not whole packets"}]
    a = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (a[:, 0] != 0x47).any():
        return [{"error": "lost sync"}]
    pids = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    programs: dict[int, int] = {}
    for s in _sections(a[pids == 0]):
        for k in range(8, len(s) - 4, 4):
            if s[0] == 0 and (program := s[k] << 8 | s[k + 1]):
                programs.setdefault(program, (s[k + 2] & 0x1F) << 8 | s[k + 3])
    found, seen = [], False
    for program, pmt_pid in programs.items():
        pmt = next((s for s in _sections(a[pids == pmt_pid]) if s[0] == 2 and s[3] << 8 | s[4] == program), None)
        if pmt is None:
            continue
        seen = True
        at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
        while at + 5 <= len(pmt) - 4:
            found.append({"error": None, "program": program, "pmt_pid": pmt_pid} | _elementary(a, pids, pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]))
            at += 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])
    return found or [{"error": "no elementary stream" if seen else "no program"}]


def demux(stream: bytes | None) -> dict:
    """The first elementary stream."""
    return streams(stream)[0]


def _elementary(a: np.ndarray, pids: np.ndarray, kind: int, pid: int) -> dict:
    rows = a[pids == pid]
    rows = rows[rows[:, 3] & 0x10 > 0]
    counter = rows[:, 3].astype(np.int32) & 0x0F
    step = np.diff(counter) & 0x0F
    again = np.zeros(len(rows), bool)
    again[1:] = (step == 0) & (rows[1:, 4:] == rows[:-1, 4:]).all(axis=1)
    lost = int(((step != 1) & ~again[1:]).sum())
    rows = rows[~again]
    adapted = rows[:, 3] & 0x20 > 0
    start = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    access = adapted & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0)
    body = rows[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(np.maximum(PACKET - start, 0))
    heads = np.flatnonzero(rows[:, 1] & 0x40)
    pts, marks, offsets, parts, size = [], [], [], [], 0
    for k, head in enumerate(heads):
        begin = int(ends[head - 1]) if head else 0
        pes = body[begin : int(ends[heads[k + 1] - 1]) if k + 1 < len(heads) else len(body)]
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            continue
        length = pes[4] << 8 | pes[5]
        data = pes[9 + pes[8] : 6 + length if length else None]
        p = pes[9:14]
        pts.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1 if pes[7] & 0x80 and len(p) == 5 else None)
        marks.append(bool(access[head]))
        offsets.append(size)
        parts.append(data)
        size += len(data)
    return {"pid": pid, "stream_type": kind, "packets": len(rows), "continuity_errors": lost, "duplicates": int(again.sum()), "pts": pts, "unit_offset": offsets, "random_access": marks, "payload": b"".join(parts)}


def _stored(texts: list[str]) -> pa.Array:
    return pa.array([mux(padded(t)) for t in texts], pa.binary())


_STREAM = pa.struct([("error", pa.string()), ("program", pa.int32()), ("pmt_pid", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("continuity_errors", pa.int64()), ("duplicates", pa.int64()), ("pts", pa.list_(pa.int64())), ("unit_offset", pa.list_(pa.int64())), ("random_access", pa.list_(pa.bool_())), ("payload", pa.binary())])


def _reader(one: Callable[[bytes | None], object], kind: pa.DataType) -> Callable[..., Column]:
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], kind)
            for part in slices(batch):
                yield pa.array([one(x) for x in part.to_pylist()], kind)

    return found


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """All columns of `docs` and `media`: the padded UTF-8 text as a transport stream."""
    return docs.withColumn(media, arrow_column(_stored, "binary")(F.col(f"`{text}`").cast("string")))


def read(rows: DataFrame, media: str = "media", stream: str = "stream") -> DataFrame:
    """All columns of `rows` and `stream`: the first elementary stream that the reader found in `media`."""
    return rows.withColumn(stream, F.arrow_udf(_reader(demux, _STREAM), STREAM)(F.col(f"`{media}`").cast("binary")))


def read_all(rows: DataFrame, media: str = "media", found: str = "streams") -> DataFrame:
    """All columns of `rows` and `found`: an array of all elementary streams of all programs in `media`."""
    return rows.withColumn(found, F.arrow_udf(_reader(streams, pa.list_(_STREAM)), f"array<{STREAM}>")(F.col(f"`{media}`").cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = read(store(docs))
    s = F.col("stream")
    payload = s["payload"]
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", s["pid"], s["stream_type"], s["packets"], s["continuity_errors"], F.size(s["pts"]), F.array_max(s["pts"]), F.size(F.filter(s["random_access"], lambda x: x))).alias("feature"),
    )
