import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import transport_stream as ts


@pytest.mark.parametrize("n", [0, 1, 150, 162, 163, 175, 176, 177, 191, 192, 193, 12_274, 12_288, 12_289, 100_000, 1_000_000])
def test_round_trip(n):
    payload = ts.padded("ab\né "[: n % 5] + "x" * max(0, n - 6))
    stream = ts.mux(payload)
    got = ts.demux(stream)
    assert len(stream) % 188 == 0 and len(payload) % 192 == 0 and payload
    assert (got["error"], got["payload"], got["continuity_errors"], got["duplicates"]) == (None, payload, 0, 0)
    assert got["pts"] == [k * ts.TICKS for k in range(len(got["pts"]))]
    assert [k for k, x in enumerate(got["random_access"]) if x] == list(range(0, len(got["pts"]), ts.UNITS_PER_ACCESS))


def test_checksum_is_the_published_one():
    assert ts.checksum(b"123456789") == 0x0376E6E7


def test_faults_are_seen():
    rnd = random.Random(1)
    payload = ts.padded("".join(rnd.choice("abcdef") for _ in range(40_000)))
    stream = ts.mux(payload)
    k = 188 * 50
    lost = ts.demux(stream[:k] + stream[k + 188 :])
    assert lost["continuity_errors"] == 1 and lost["payload"] != payload
    twice = ts.demux(stream[: k + 188] + stream[k:])
    assert (twice["duplicates"], twice["continuity_errors"], twice["payload"]) == (1, 0, payload)
    swapped = ts.demux(stream[:k] + stream[k + 188 : k + 376] + stream[k : k + 188] + stream[k + 376 :])
    assert swapped["continuity_errors"] >= 1
    for broken, why in ((None, "not whole packets"), (b"", "not whole packets"), (stream[:-1], "not whole packets"), (b"x" * 188, "lost sync"), (stream[188 * 2 :][: 188 * 5], "no program")):
        assert ts.demux(broken)["error"] == why
    bad_table = stream[:188] + stream[188:200] + b"\xaa" + stream[201:]
    assert ts.demux(bad_table)["error"] == "no program"


def packets_of(pid, section):
    """A section over as many packets as it takes."""
    raw, out = b"\x00" + section, []
    for k in range(0, len(raw), 184):
        head = bytes([0x47, (0x40 if not k else 0) | pid >> 8, pid & 0xFF, 0x10 | k // 184 & 0x0F])
        out.append((head + raw[k : k + 184]).ljust(188, b"\xff"))
    return b"".join(out)


def test_tables_behind_damaged_ones_are_found():
    payload = ts.padded("some text")
    stream = ts.mux(payload)
    bad = stream[:20] + b"\xaa" + stream[21:188]
    many = b"".join(bad[:3] + bytes([0x10 | k & 0x0F]) + bad[4:] for k in range(200))
    assert ts.demux(many)["error"] == "no program"
    assert ts.demux(many + stream)["payload"] == payload


def test_all_streams_of_all_programs_and_long_sections():
    def es(pid, text):  # the stream of one text, moved to another place
        a = np.frombuffer(ts.mux(ts.padded(text)), np.uint8).reshape(-1, 188)[2:].copy()
        a[:, 1] = a[:, 1] & 0xE0 | pid >> 8
        a[:, 2] = pid & 0xFF
        return a.tobytes()

    entry = lambda kind, pid, more=b"": bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(more)).to_bytes(2, "big") + more
    pat = ts._section(0, 1, b"\x00\x00\xe0\x10" + b"\x00\x01" + (0xE000 | 0x1000).to_bytes(2, "big") + b"\x00\x02" + (0xE000 | 0x1001).to_bytes(2, "big"))
    one = ts._section(2, 1, (0xE000 | 0x100).to_bytes(2, "big") + b"\xf0\x00" + entry(6, 0x100, b"x" * 300) + entry(15, 0x101))
    two = ts._section(2, 2, (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00" + entry(6, 0x200))
    stream = packets_of(0, pat) + packets_of(0x1000, one) + packets_of(0x1001, two) + es(0x100, "first") + es(0x101, "second" * 99) + es(0x200, "third")
    got = ts.streams(stream)
    assert [(x["program"], x["pid"], x["stream_type"], x["continuity_errors"]) for x in got] == [(1, 0x100, 6, 0), (1, 0x101, 15, 0), (2, 0x200, 6, 0)]
    assert [x["payload"] for x in got] == [ts.padded(t) for t in ("first", "second" * 99, "third")]
    lost = packets_of(0, pat) + packets_of(0x1000, one)[:188] + packets_of(0x1001, two) + es(0x200, "third")
    assert [x["program"] for x in ts.streams(lost)] == [2]


def reader_by_the_layout(stream):
    """A plain reader of one stream, packet by packet: its counts and payload."""
    pes, packets, units, last_pts, access = [], 0, 0, None, 0
    for k in range(0, len(stream), 188):
        p = stream[k : k + 188]
        if (p[1] & 0x1F) << 8 | p[2] != ts.ES_PID:
            continue
        packets += 1
        at = 4
        if p[3] & 0x20:
            access += bool(p[4] and p[5] & 0x40)
            at += 1 + p[4]
        if p[1] & 0x40:
            pes.append(b"")
        pes[-1] += p[at:]
    for x in pes:
        units += 1
        last_pts = (x[9] >> 1 & 7) << 30 | x[10] << 22 | x[11] >> 1 << 15 | x[12] << 7 | x[13] >> 1
    return b"".join(x[14 : 6 + (x[4] << 8 | x[5])] for x in pes), f"{ts.ES_PID}:6:{packets}:0:{units}:{last_pts}:{access}"


def test_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, None, b"old"), (1, None, b"old"), (None, "é", b"old")], "doc_id bigint, text string, media binary")
    rows = ts.read(ts.store(docs)).collect()
    assert rows[0]["media"] == rows[1]["media"]
    assert [bytes(r["stream"]["payload"]) for r in rows] == [b" " * 192] * 2 + ["é".encode().ljust(192)]
    assert ts.read(ts.store(docs.limit(0))).collect() == []
    assert [len(r["streams"]) for r in ts.read_all(ts.store(docs)).collect()] == [1, 1, 1]
    assert ts.read(spark.createDataFrame([(None,)], "media binary")).first()["stream"]["error"] == "not whole packets"


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = ts.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        payload = ts.padded(docs[r["doc_id"]])
        stream = ts.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(docs[r["doc_id"]].encode()), len(payload), len(stream))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stream).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (payload, r["feature"]) == reader_by_the_layout(stream)
