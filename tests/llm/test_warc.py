import gzip
import hashlib

import pytest

SCHEMA = "page_id bigint, url string, html string, extra int"


@pytest.fixture(scope="module")
def odd_pages(spark):
    big, small = "x" * 1000 + "é", "y" * 999
    nasty = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40
    rows = [(1, "http://a/b", big, 0), (2, "http://a/c#d", big, 0), (3, "u", small, 0), (4, "u", small, 0), (5, None, None, 0), (6, "u", "", 0), (7, "x\r\ny: z", nasty, 0), (8, "u", nasty, 0), (8, "u", nasty, 0), (None, "u", "z" * 2000, 0), (9, "u", "\x00\n\r\n\r\n" * 400, 0), (10, "u", "long " * 300_000, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    last = {}
    for p, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and p is not None:
            last[b] = max(p, last.get(b, p))
    out = []
    for p, html in rows:
        b = (html or "").encode()
        to = last.get(b) if len(b) >= 1000 and last.get(b) != p else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_round_trip(spark, odd_pages, tmp_path):
    from loomlint.llm import warc

    for name, df in (("odd", odd_pages), ("none", odd_pages.limit(0)), ("real", spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))):
        df.write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = warc.op7_warc(spark, f"{tmp_path}/{name}")
        assert got.where("not (has_request and has_metadata)").count() == 0
        got = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        want = brute([(r["page_id"], r["html"]) for r in df.collect()])
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_payloads_and_members(spark, odd_pages, tmp_path):
    from loomlint.llm import warc

    warc.write(odd_pages, str(tmp_path / "w"))
    x = warc.assemble(warc.read(spark, str(tmp_path / "w"))).where("response.type = 'response'").select("response.page_id", "response.payload").collect()
    pages = {str(r["page_id"]): (r["html"] or "").encode() for r in odd_pages.collect() if r["page_id"] is not None}
    assert all(pages[r["page_id"]] == r["payload"] for r in x if r["page_id"]) and len(x) >= 9
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r["payload"] for r in warc.parse(gzip.compress(one) + gzip.compress(one))] == [b"abc", b"abc"]


def test_damaged_archives(spark, odd_pages, tmp_path):
    from loomlint.llm import warc

    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    kinds = lambda data: [r["head"]["WARC-Type"] for r in warc.parse(data)]
    whole = gzip.compress(one * 3)
    assert kinds(one * 2) == ["metadata"] * 2 and kinds(whole) == ["metadata"] * 3 and kinds(b"") == []
    assert kinds(one + one[:-6]) == ["metadata", "damaged"] and kinds(one + one[:30]) == ["metadata", "damaged"]
    assert kinds(whole + b"trailing bytes") == ["metadata"] * 3 + ["damaged"]
    assert kinds(gzip.compress(one) + b"\x1f\x8b\x00\x00") == ["metadata", "damaged"]
    assert kinds(b"WARC/1.0\r\nContent-Length: many\r\n\r\n" + one) == ["damaged", "metadata"]
    big = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5000000\r\n\r\n" + b"x" * 5_000_000 + b"\r\n\r\n"
    cut = gzip.compress(one + big)
    assert [len(r["payload"]) for r in warc.parse(cut)] == [3, 5_000_000] and kinds(cut[: len(cut) // 2]) == ["metadata", "damaged"]
    # in a table, a damaged archive gives what comes before, and belongs to no capture
    warc.write(odd_pages.where("page_id < 7"), str(tmp_path / "w"))
    n = warc.assemble(warc.read(spark, str(tmp_path / "w"))).count()
    (tmp_path / "w" / "cut.gz").write_bytes(whole + b"zzz")
    x = warc.read(spark, str(tmp_path / "w"))
    assert x.where("type = 'damaged'").count() == 1 and warc.assemble(x).count() == n


def test_revisits_name_their_response(spark, odd_pages, tmp_path):
    from loomlint.llm import warc

    warc.write(odd_pages, str(tmp_path / "w"))
    x = warc.read(spark, str(tmp_path / "w")).collect()
    ids = {r["id"]: r for r in x}
    revisits = [r for r in x if r["type"] == "revisit"]
    assert len(revisits) == 2 and len(ids) == len(x)
    for r in revisits:
        to = ids[r["refers_to"]]
        assert to["type"] == "response" and to["digest"] == r["digest"] and r["headers"]["WARC-Profile"] == warc.PROFILE and not r["payload"]
        assert r["headers"]["WARC-Refers-To-Target-URI"] == to["uri"]
