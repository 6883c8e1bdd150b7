import hashlib
import random
import zlib

import pytest

from quillmesh.llm import registry, transport


@pytest.mark.parametrize("n", [*range(1, 210), 8179, 8180, 8191, 8192, 8193, 8370, 100_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = transport.write(payload)
    found = transport.read(media)
    units = -(-n // transport.UNIT)
    assert found.payload == payload and len(media) % 188 == 0
    assert found.times == [i * transport.TICK for i in range(units)]
    assert found.random_access == list(range(0, units, transport.RANDOM_ACCESS))
    assert found.stream_pid == transport.STREAM_PID and found.program == transport.PROGRAM


def test_packets_are_well_formed():
    media = transport.write(b"x" * 50_000)
    counters = {}
    for i in range(0, len(media), 188):
        p = media[i : i + 188]
        pid = (p[1] & 31) << 8 | p[2]
        assert p[0] == 0x47 and (pid not in counters or counters[pid] == (p[3] & 15) - 1 & 15)
        counters[pid] = p[3] & 15
    assert set(counters) == {0, 0x100, 0x101}


def test_checksum_of_tables():
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7


@pytest.mark.parametrize("damage", ["lost", "swapped", "sync", "table", "cut"])
def test_damage_is_noticed(damage):
    media = bytearray(transport.write(random.Random(1).randbytes(30_000)))
    if damage == "lost":
        del media[188 * 10 : 188 * 11]
    elif damage == "swapped":
        media[188 * 5 : 188 * 7] = media[188 * 6 : 188 * 7] + media[188 * 5 : 188 * 6]
    elif damage == "sync":
        media[188 * 4] = 0
    elif damage == "table":
        media[188 + 10] ^= 1
    else:
        media = media[:-5]
    with pytest.raises(ValueError):
        transport.read(bytes(media))


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op10_transport_stream(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64)
        media = transport.write(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, b"x"), (2, "", b"x"), (None, "é" * 32, b"x"), (3, "a" * 500_000, b"x"), (4, "a" * 500_000, b"x")], "doc_id long, text string, media binary")
    rows = transport.features(transport.store(docs)).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].payload_bytes == by[2].payload_bytes == 64 and by[1].n_bytes == 0
    assert by[1].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert by[None].payload_bytes == by[None].n_bytes == 64
    assert by[3].feature == by[4].feature and by[3].media_sha256 == by[4].media_sha256
    assert transport.features(transport.store(docs.limit(0))).count() == 0
