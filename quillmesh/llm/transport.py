"""Media columns: payloads in MPEG transport streams, written and read back.

A stream is packets of 188 bytes. It begins with a program association table and a program map table
(with their checksums), which name one program of one elementary stream of private data. The payload
goes into access units of ``UNIT`` bytes; each is an elementary packet with a presentation time
(90 kHz clock, one unit a tick of ``TICK``) that starts a new transport packet. Every
``RANDOM_ACCESS``-th unit is a random-access point and carries a program clock reference. Each PID
counts its packets modulo 16; the last packet of a unit is filled up by the adaptation field.

Reading starts from the bytes alone: it checks sync bytes and continuity counters, parses the tables
to find the elementary stream, reassembles its packets and returns payload, times and the units at
which one can start.

Edge cases. Null or empty text: 64 zero bytes. Any text, however long: UTF-8 whole and zero bytes up
to a positive multiple of 64, in time linear in its length; times wrap at 33 bits. A stream with a broken counter, checksum, sync byte or length: ValueError. Null
doc_id: kept as null. Repeated rows and equal texts: equal values. Empty table: no rows. Columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_arrow

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x0100, 0x0101
PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 1, 0x06, 0xBD
UNIT, TICK, RANDOM_ACCESS = 8192, 3600, 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The checksum of tables: polynomial 0x04C11DB7, not reflected, starting from all ones."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return packet + b"\xff" * (PACKET - len(packet))


def _time(marker: int, pts: int) -> bytes:
    return bytes([marker << 4 | (pts >> 29 & 0x0E) | 1]) + ((pts >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + ((pts << 1 & 0xFFFE) | 1).to_bytes(2, "big")


_HEAD = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _adaptation(fields: bytes, size: int) -> bytes:
    """An adaptation field of exactly size bytes, its length byte included."""
    if size < 2:
        return b"\x00" * size
    return bytes([size - 1]) + (fields or b"\x00").ljust(size - 1, b"\xff")


def write(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out = [_HEAD]
    counter = 0
    start, inner = (bytes([SYNC]) + (flag | STREAM_PID).to_bytes(2, "big") for flag in (0x4000, 0))
    plain = [inner + bytes([0x10 | c]) for c in range(16)]
    for n, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = n * TICK & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _time(2, pts) + unit
        fields = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if n % RANDOM_ACCESS == 0 else b""
        # The first packet has the clock reference; it, or the last one, is filled up.
        size = max(len(fields) + 1 if fields else 0, 184 - len(pes))
        out += [start, bytes([(0x30 if size else 0x10) | counter]), _adaptation(fields, size), pes[: 184 - size]]
        counter = counter + 1 & 15
        done = 184 - size
        whole = done + (len(pes) - done) // 184 * 184
        for i in range(done, whole, 184):
            out += [plain[counter], pes[i : i + 184]]
            counter = counter + 1 & 15
        if whole < len(pes):
            out += [inner, bytes([0x30 | counter]), _adaptation(b"", 184 - (len(pes) - whole)), pes[whole:]]
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    packets: int = 0
    pids: dict[int, int] = field(default_factory=dict)
    program: int | None = None
    stream_pid: int | None = None
    times: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)


def _table(data: bytes, table: int) -> bytes:
    section = data[1 + data[0] :]
    length = int.from_bytes(section[1:3], "big") & 0x0FFF
    section = section[: 3 + length]
    if section[0] != table or len(section) != 3 + length or crc32_mpeg(section):
        raise ValueError("broken table")
    return section[8:-4]


def read(data: bytes) -> Stream:
    """Parse a transport stream; see the module's head."""
    if len(data) % PACKET or not data:
        raise ValueError("not whole packets")
    out = Stream(packets=len(data) // PACKET)
    counters: dict[int, int] = {}
    parts: list[bytes] = []
    units: list[bytes] = []
    pmt_pid = None

    def close() -> None:
        if not parts:
            return
        pes = b"".join(parts)
        parts.clear()
        length = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or length != len(pes) - 6:
            raise ValueError("broken elementary packet")
        t = pes[9:14]
        out.times.append((t[0] >> 1 & 7) << 30 | (int.from_bytes(t[1:3], "big") >> 1) << 15 | int.from_bytes(t[3:5], "big") >> 1)
        units.append(pes[9 + pes[8] :])

    for at in range(0, len(data), PACKET):
        if data[at] != SYNC:
            raise ValueError("lost sync")
        one, two, three = data[at + 1], data[at + 2], data[at + 3]
        pid = (one & 0x1F) << 8 | two
        out.pids[pid] = out.pids.get(pid, 0) + 1
        begin, access = at + 4, False
        if three & 0x20:
            size = data[begin]
            access = size > 0 and bool(data[begin + 1] & 0x40)
            begin += 1 + size
        if not three & 0x10:
            continue
        if pid in counters and three & 15 != counters[pid] + 1 & 15:
            raise ValueError(f"a packet of {pid} is missing")
        counters[pid] = three & 15
        if pid == out.stream_pid:
            if one & 0x40:
                close()
                if access:
                    out.random_access.append(len(out.times))
            parts.append(data[begin : at + PACKET])
        elif pid == PAT_PID and one & 0x40:
            body = _table(data[begin : at + PACKET], 0x00)
            out.program, pmt_pid = int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big") & 0x1FFF
        elif pid == pmt_pid and one & 0x40:
            body = _table(data[begin : at + PACKET], 0x02)
            rest = body[4 + (int.from_bytes(body[2:4], "big") & 0x0FFF) :]
            out.stream_pid = int.from_bytes(rest[1:3], "big") & 0x1FFF
    close()
    out.payload = b"".join(units)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\x00" * (64 if not raw else -len(raw) % 64)


STORED = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's transport stream for every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = [payload_of(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, STORED)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, random_access array<int>"


def features(stored: DataFrame) -> DataFrame:
    """Streams read back: payload digests, the stream's own, presentation times and random-access units.

    feature is packets:units:last time:random-access points:PIDs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [f.split(" ")[0] for f in READ.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = media.as_py()
                s = read(data)
                feature = f"{s.packets}:{len(s.times)}:{s.times[-1]}:{len(s.random_access)}:{'/'.join(f'{p:#06x}={k}' for p, k in sorted(s.pids.items()))}"
                rows.append((doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.times, s.random_access))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_arrow(stored, run, READ)
