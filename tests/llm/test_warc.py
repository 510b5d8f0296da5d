import hashlib
import io
import struct

import pytest

from tessera.llm import warc
from tessera.session import scratch_path


def archive(records, samples=None):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, samples if samples is not None else records)
    for r in records:
        writer.write(r)
    return out.getvalue()


def some_records(n=40):
    return [warc.record_bytes("response", i, f"http://x.example/{i}", (f"<html><p>page {i} with some text of its own {i * 7919}</p></html>" * 9).encode())
            for i in range(n)]


def test_round_trip_with_a_dictionary_in_the_leading_frame():
    records = some_records()
    data = archive(records)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME
    for chunk in (7, 1 << 20):
        got = list(warc.read_archive(io.BytesIO(data), chunk))
        assert [f["x-page-id"] for f, _ in got] == [str(i) for i in range(40)]
        assert all(p == r.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4] for (_, p), r in zip(got, records))


def test_without_a_dictionary():
    data = archive(some_records(2))
    assert struct.unpack("<I", data[:4])[0] == 0xFD2FB528 and len(list(warc.read_archive(io.BytesIO(data)))) == 2


def test_damage_is_found():
    records = some_records()
    data = archive(records)
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(data[:-5])))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(data[:20])))
    good = records[0]
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"page 0", b"page 1"),
                good[:-1], good.replace(b"Content-Length: ", b"Content-Length: 1", 1), b"", good.replace(b"X-Page-ID: 0", b"X-Page-ID")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)


def plan(rows):
    """Kinds by the rule, from (page id, payload) pairs."""
    last = {}
    for i, p in rows:
        if len(p) >= 1000 and i is not None:
            last[p] = max(last.get(p, i), i)
    return [("revisit", last[p]) if len(p) >= 1000 and p in last and i != last[p] else ("response", None) for i, p in rows]


def test_query_on_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    doubled = pages.unionByName(pages.selectExpr("page_id + 100000 as page_id", "url", "html").where("page_id % 3 = 0"))
    rows = [(r["page_id"], r["html"].encode()) for r in doubled.collect()]
    want = {i: (len(p), hashlib.sha1(p).hexdigest(), *k) for (i, p), k in zip(rows, plan(rows))}
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.op7_warc_zstd(doubled).collect()}
    assert got == want and any(v[2] == "revisit" for v in got.values())


def test_payloads_come_back_and_only_the_manifest_is_read(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(warc.plan_records(pages).repartition(3), folder)
    assert manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == pages.count()
    with warc.open_file(f"{folder}/left-by-a-lost-task.warc.zst", "wb") as f:
        f.write(b"rubbish")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest).where("record_type = 'response'").collect()}
    assert got.items() <= {r["page_id"]: r["html"] for r in pages.collect()}.items() and len(got) > 0


def test_odd_rows(spark):
    big = "é" * 600
    rows = [(1, None, None, "a"), (2, "u\r\nX: y", "", "b"), (None, "u", big, "c"), (3, "u", big, "d"), (3, "u", big, "d"), (4, "u", "short", "e"), (5, "v", "short", "f"),
            (6, "w", "z" * 999, "g"), (7, "w", "z" * 999, "h"), (8, "w", "x" * 3_000_000, "i")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op7_warc_zstd(df).collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (0, 1200, "revisit", 3), (3, 1200, "response", None), (3, 1200, "response", None),
                          (4, 5, "response", None), (5, 5, "response", None), (6, 999, "response", None), (7, 999, "response", None),
                          (8, 3_000_000, "response", None)], key=str)
    assert warc.op7_warc_zstd(df.where("false")).collect() == []
