from __future__ import annotations

import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomstead.llm import warc
from loomstead.llm._shared import shared_path


def test_chunked_framing_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 1000):
        data = rng.randbytes(n)
        assert warc.dechunked(warc.chunked(data, 16)) == data
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def rows_of():
    rng = random.Random(2)
    long = "".join(rng.choice("ab\r\n é字😀<>") for _ in range(5000))
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\nx"
    return [(5, "http://a/", "same"), (3, "http://b/\r\nx", "same"), (9, None, "same"), (4, "u", long), (7, "u", long), (1, "u", tricky), (2, "u", ""), (8, "u", None), (None, "u", "no id"), (None, "u", "same"), (11, "u", "twice"), (11, "u", "twice")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("block", F.lit(2))


def brute(rows):
    first = {}
    for i, _, h in rows:
        k = (i is None, i or 0)
        first[h or ""] = min(first.get(h or "", k), k)
    out = []
    for i, _, h in rows:
        raw, f = (h or "").encode(), first[h or ""]
        revisit = f != (i is None, i or 0)
        out.append((i, len(raw), warc.digest32(raw), "revisit" if revisit else "response", f[1] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [40, 300, warc.SEGMENT])
def test_round_trip(spark, segment):
    rows = rows_of()
    out = warc.round_trip(frame(spark, rows), segment=segment, chunk=64)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_payloads_come_back(spark, tmp_path):
    rows = [(i, "u", f"{i} é " * 200) for i in range(5)]
    warc.write_archives(frame(spark, rows), f"{tmp_path}/w", segment=100)
    back = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert {r.page_id: bytes(r.payload).decode() for r in back} == {i: h for i, _, h in rows}
    assert all(r.problem is None for r in back)
    archive = next((tmp_path / "w").glob("part-*"))
    data = archive.read_bytes()
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    members, rest = [], data
    while rest:
        d = zlib.decompressobj(31)
        members.append(d.decompress(rest))
        rest = d.unused_data
    assert len(members) > 1 and all(x.startswith(b"WARC/1.1\r\n") and x.count(b"WARC-Record-ID") == 1 for x in members)


def test_ordinary_pages_are_segmented_and_archives_parsed_once(spark):
    """The archives of the query itself hold continuation records."""
    path = shared_path(spark, "warc")
    warc.write_archives(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), path)
    parsed = warc.parsed_archives(spark, path, keep_payload=False)
    kinds = {r.record_type: r["count"] for r in parsed.groupBy("record_type").count().collect()}
    assert kinds["continuation"] > 100 and kinds["response"] > 0
    plan = warc.whole_records(parsed, False)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and plan.count("MapInArrow") <= 1


def test_a_lost_segment_of_repeated_rows_is_a_problem(spark):
    rows = [(1, "u", "some text " * 40)] * 3
    path = shared_path(spark, "warc")
    warc.write_archives(frame(spark, rows), path, segment=100)
    parsed = warc.parsed_archives(spark, path)
    assert [bytes(r.payload).decode() for r in warc.whole_records(parsed).collect()] == [rows[0][2]] * 3
    lost = parsed.where("segment IS NULL OR segment <> 2")
    assert {r.problem for r in warc.whole_records(lost).collect()} == {"a segment is missing"}


def test_archives_in_one_member_or_none_are_read():
    raw = b"".join(r.encode() + b"\r\n\r\n" for i in range(300) for r in warc.records_of(i, "u", f"{i} text " * 300, "X", None, 500, 64))
    want = [r["record_id"] for r in warc.parse_archive(raw)]
    assert len(want) > 1000
    assert [r["record_id"] for r in warc.parse_archive(gzip.compress(raw))] == want
    with pytest.raises(ValueError):
        list(warc.parse_archive(raw[:-5]))


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    out = {r.page_id: r.record_type for r in warc.round_trip(frame(spark, rows), revisit_from=3).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def segments(text, size):
    parts = [warc.parse_archive(r.encode() + b"\r\n\r\n") for r in warc.records_of(1, "u", text, warc.digest32(text.encode()), None, size, 16)]
    return [next(iter(p)) for p in parts]


def test_reassembly_checks_numbers_and_length():
    text = "some text that is cut into segments " * 5
    parts = segments(text, 50)
    assert len(parts) > 3
    whole = warc.joined_segments(random.Random(1).sample(parts, len(parts)))
    assert [bytes(r["payload"]).decode() for r in whole] == [text] and whole[0]["problem"] is None
    assert len(warc.joined_segments(parts + parts)) == 2
    assert warc.joined_segments(parts[:1] + parts[2:])[0]["problem"] == "a segment is missing"
    assert warc.joined_segments(parts[1:])[0]["problem"] == "a segment is missing"
    wrong = [*parts[:-1], parts[-1] | {"total_length": 1}]
    assert warc.joined_segments(wrong)[0]["problem"] == "total length differs"


def test_a_broken_archive_is_an_error():
    record = warc.records_of(1, "u", "text", "X", None)[0].encode()
    assert len(list(warc.parse_archive(record + b"\r\n\r\n"))) == 1
    for bad in (record, record[:-3] + b"\r\n\r\n", b"x" + record + b"\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, rows_of()).limit(0)).collect() == []
