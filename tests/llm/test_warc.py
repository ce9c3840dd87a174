import base64
import gzip
import hashlib
import io

import pytest

from casetide.llm import warc as W

PAGES = "page_id long, url string, html string, payload string, bytes string"


def made(n):
    # Payloads that hold the gzip magic, header look-alikes and blank lines.
    odd = "\x1f\x08 WARC/1.1\r\n\r\n" + "ÿ" * 5
    return [W.encode_record(i, f"http://h/{i}", f"{odd}{i} {'x' * (i * 37)}".encode(), 0 if i % 4 == 3 else None) for i in range(n)]


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 1 << 20])
def test_every_record_has_one_owner(split):
    data = b"".join(made(40))
    found = [r for at in range(0, len(data), split) for r in W.read_range(io.BytesIO(data), at, at + split)]
    assert [r.page_id for r in found] == list(range(40))
    assert [r.kind for r in found[:4]] == ["response"] * 3 + ["revisit"]


@pytest.mark.parametrize("split", [50, 5000])
def test_magic_inside_a_member_is_no_record(monkeypatch, split):
    # Stored, not compressed: a whole record lies in the payload, byte for byte.
    monkeypatch.setattr(W, "_LEVEL", 0)
    inner = W.encode_record(99, "http://inner/", b"inner", None)
    outer = [W.encode_record(i, "http://o/", b"a" * 300 + b"\x1f\x8b\x08" + inner[3:40] + b"b" * 300, None) for i in range(5)]
    data = b"".join(outer)
    found = [r.page_id for at in range(0, len(data), split) for r in W.read_range(io.BytesIO(data), at, at + split)]
    assert found == [0, 1, 2, 3, 4]


def test_large_members(monkeypatch):
    monkeypatch.setattr(W, "_CHUNK", 64)
    data = b"".join(made(30))
    for split in (63, 64, 65, 4096):
        found = [r.page_id for at in range(0, len(data), split) for r in W.read_range(io.BytesIO(data), at, at + split)]
        assert found == list(range(30))


def test_record_is_plain_warc():
    raw = gzip.decompress(W.encode_record(5, "http://x/\r\nWARC-Type: evil\u2028", "é".encode(), None))
    head, block = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and lines[1] == "WARC-Type: response"
    assert "WARC-Target-URI: http://x/%0D%0AWARC-Type: evil%E2%80%A8" in lines
    assert block.endswith("é".encode() + b"\r\n\r\n") and block.startswith(b"HTTP/1.1 200 OK\r\n")


def test_damage_is_an_error():
    raw = gzip.decompress(W.encode_record(1, "u", b"payload", None))
    with pytest.raises(W.BadRecord):
        W.decode_record(raw.replace(b"payload", b"PAYLOAD"))
    with pytest.raises(W.BadRecord):
        W.decode_record(raw[:-3])


def test_odd_rows(spark):
    rows = [(4, "u", "same", "", ""), (2, None, "same", "", ""), (2, "v", "same", "", ""), (None, "w", "same", "", ""), (7, "x", None, "", ""),
            (3, "y", "", "", ""), (None, "z", "alone", "", ""), (9, "big", "é" * 200_000, "", "")]
    df = spark.createDataFrame(rows, PAGES)
    out = W.archived(df).collect()
    key = lambda r: (r["page_id"] or -1, r["url"] or "")
    got = [(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in sorted(out, key=key)]
    assert got == [
        (None, "w", "revisit", 2, 4), (None, "z", "response", None, 5), (2, None, "response", None, 4), (2, "v", "response", None, 4),
        (3, "y", "response", None, 0), (4, "u", "revisit", 2, 4), (7, "x", "revisit", 3, 0), (9, "big", "response", None, 400_000),
    ]
    assert {r["payload_digest"] for r in out if r["payload_bytes"] == 4} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    assert [bytes(r["payload"]) for r in out if r["page_id"] == 9] == [("é" * 200_000).encode()]
    assert W.archived(df.limit(0)).count() == 0


def test_small_splits_and_archives(spark, monkeypatch):
    from casetide.runtime import scratch_path

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    root = scratch_path(spark, "warc-test")
    archives = W.write(W.with_revisits(pages), root)
    found = W.read(archives, root, split_bytes=500).select("page_id", "payload").collect()
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in found if r["payload"] is not None} <= {
        (r["page_id"], r["html"]) for r in pages.collect()
    }
    assert len(found) == pages.count()


def test_query_equals_brute_force(spark):
    from casetide.llm.catalog import op5_warc

    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    first = {}
    for page_id, html in pages:
        first[html or ""] = min(page_id, first.get(html or "", page_id))
    wanted = set()
    for page_id, html in pages:
        raw = (html or "").encode()
        to = first[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        wanted.add((page_id, len(raw), digest, "response" if to == page_id else "revisit", None if to == page_id else to))
    out = op5_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(out) == len(pages) and set(map(tuple, out)) == wanted


def test_statement_agrees(spark):
    import duckdb

    from casetide.llm.catalog import op5_warc, oracle_sql

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    theirs = con.sql(oracle_sql()["op5_warc"])
    mine = op5_warc(spark, sf)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert set(map(tuple, mine.select(*theirs.columns).collect())) == set(theirs.fetchall())


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_damage_is_an_error_wherever_it_is(split):
    """Two bytes of any member changed, or the end cut off: some range fails, whatever the ranges are."""
    members = made(6)
    whole = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(7)]

    def read(data):
        return [r for at in range(0, len(data), split) for r in W.read_range(io.BytesIO(data), at, at + split)]

    assert len(read(whole)) == 6
    for i in range(6):
        for at in (starts[i], starts[i] + 1, (starts[i] + starts[i + 1]) // 2, starts[i + 1] - 6):
            broken = bytearray(whole)
            broken[at] ^= 0x55
            broken[at + 1] ^= 0xAA
            with pytest.raises((W.BadRecord, ValueError)):
                read(bytes(broken))
    for cut in (1, 8, 30, len(members[-1]) - 2):
        with pytest.raises(W.BadRecord):
            read(whole[:-cut])
    # A whole number of members is a shorter archive, not a damaged one.
    assert len(read(whole[: starts[5]])) == 5


def test_revisits_name_the_page_they_refer_to(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x"), (1, "http://c/", "y"), (None, "http://d/", "x")], "page_id long, url string, html string")
    found = {r["url"]: (r["refers_to"], r["refers_url"]) for r in W.with_revisits(pages).collect()}
    assert found["http://b/"] == found["http://d/"] == (1, "http://a/") and found["http://a/"][0] is None
    raw = gzip.decompress(W.encode_record(2, "http://b/", b"x", 1, "http://a/")).decode()
    assert "WARC-Refers-To-Target-URI: http://a/\r\n" in raw and "WARC-Refers-To-Date: " in raw
