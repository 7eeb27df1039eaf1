import hashlib
import random

import pytest
import zstandard

from alarmlake.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, id long, refers_to long"


def put(spark, rows, path, **options):
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    warc.write_archives(pages, str(path), **options)
    return warc.read_archives(spark, str(path)).collect()


def pages(n, seed=1):
    draw = random.Random(seed)
    return [(i, f"http://host{i % 3}.example/ä {i}", "<p>" + " ".join(draw.choices(["alpha", "beta", "gamma", "délta"], k=200)) + "</p>") for i in range(n)]


def test_round_trip(spark, tmp_path):
    rows = pages(300) + [(1000, None, None), (1001, "x", ""), (1002, "x", "a" * 99), (1003, "x", "a" * 99), (1004, "x", "b" * 100), (1005, "x", "b" * 100), (1005, "x", "b" * 100), (1006, "x", "c" * 2_000_000)]
    got = put(spark, rows, tmp_path / "w", records=64)
    assert len(got) == len(rows) and len({r.archive for r in got}) >= 5
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    for key, _, html in rows:
        payload = (html or "").encode()
        for r in by[f"<urn:page:{key}>"]:
            assert (r.payload_digest, r.payload_bytes) == (hashlib.sha256(payload).hexdigest(), len(payload))
            assert r.warc_type == ("revisit" if key == 1005 else "response")
            assert r.refers_to == ("<urn:page:1004>" if key == 1005 else None)
            assert key == 1005 or bytes(r.payload) == payload


def test_null_key_and_nothing(spark, tmp_path):
    got = put(spark, [(None, None, None)], tmp_path / "a")
    assert [(r.record_id, r.target_uri, r.payload_bytes) for r in got] == [("<urn:page:>", "about:blank", 0)]
    empty = spark.createDataFrame([], SCHEMA)
    warc.write_archives(empty, str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).collect() == []


def record(payload=b"<p>x</p>", **change):
    row = {"id": 7, "url": "http://a/", "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "refers_to": None}
    return warc._record(row | change, "2024-01-01T00:00:00Z")


def test_headers_lengths_and_digests_are_checked():
    good = record()
    assert warc.parse_record(good)["payload"] == b"<p>x</p>"
    bad = [
        good.replace(b"WARC/1.1", b"WORC/1.1"),
        good.replace(b"WARC-Date", b"X-Date"),
        good[:-1],
        good + b"x",
        good.replace(b"<p>x</p>", b"<p>y</p>"),
        good.replace(b"Content-Length: 8", b"Content-Length: 9"),
        good.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
        good.replace(b"WARC-Type: response", b"WARC-Type: banana"),
        good.replace(b"WARC-Type: response", b"WARC-Type response"),
    ]
    for content in bad:
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(content)


def test_frames_need_their_dictionary_and_their_end():
    records = [record(p[2].encode()) for p in pages(300)]
    data = b"".join(warc._frames(iter(records), 1000))
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    assert [c for _, c in warc.frames_of(data)] == records
    size = int.from_bytes(data[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    assert [c for _, c in warc.frames_of(data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + size :])] == records
    for broken in (data[8 + size :], data[:-3], data[: 8 + size] + b"junk", data[:8] + b"x" * size + data[8 + size :]):
        with pytest.raises(warc.ArchiveError):
            list(warc.frames_of(broken))


def test_standard_decoder_reads_an_archive(spark, tmp_path):
    put(spark, pages(20), tmp_path / "w")
    for path in (tmp_path / "w").glob("part-*"):
        data = path.read_bytes()
        plain = [c for _, c in warc.frames_of(data)]
        if int.from_bytes(data[:4], "little") != warc.DICTIONARY_FRAME:
            assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(plain)
