import gzip
import hashlib

import pytest

from quern.llm import warc

PAGES = [(1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "short"), (6, "http://e/", "short"), (7, "u", "é" * 80), (0, "v", "é" * 80), (8, "w", "long " * 50_000), (2, "http://b/", "x" * 150)]


def test_round_trip_and_revisits(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(warc.page_records(pages), str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted(hashlib.sha256(r.payload).hexdigest() for r in rows) == sorted(hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in PAGES)
    assert all(r.payload_digest == "sha256:" + hashlib.sha256(r.payload).hexdigest() and r.payload_bytes == len(r.payload) for r in rows)
    refers = {r.record_id: r.refers_to for r in rows}
    assert refers == {f"<urn:page:{i}>": {2: "<urn:page:1>", 7: "<urn:page:0>"}.get(i) for i, _, _ in PAGES}


def test_filters_and_headers_only(spark, tmp_path):
    warc.write(warc.page_records(spark.createDataFrame(PAGES, "page_id long, url string, html string")), str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"), payload=False).filter("warc_type = 'revisit' AND target_uri IN ('u', 'http://b/')")
    assert sorted(r.record_id for r in got.collect()) == ["<urn:page:2>", "<urn:page:2>", "<urn:page:7>"]
    assert all(r.payload is None and r.payload_bytes > 0 for r in got.collect())
    assert warc.read(spark, str(tmp_path / "w")).filter("target_uri IS NULL").count() == 1


def test_archives_of_others(spark, tmp_path):
    records = [warc.head({"warc_type": t, "record_id": f"<{k}>"}, len(b)) + b + b"\r\n\r\n" for k, (t, b) in enumerate([("warcinfo", b"a: b\r\n\r\nc"), ("response", b"z" * 100_000), ("response", b"")])]
    folder = tmp_path / "o"
    folder.mkdir()
    (folder / "plain.warc").write_bytes(b"".join(records))
    (folder / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    rows = warc.read(spark, str(folder)).collect()
    assert sorted(len(r.payload) for r in rows) == [0, 0, 9, 9, 100_000, 100_000]
    assert warc.read(spark, str(folder)).filter("warc_type = 'response'").count() == 4


def test_hostile_headers_and_ids(spark, tmp_path):
    from quern.llm import queries

    url = "http://x/\r\n\r\nWARC/1.1\r\nWARC-Type: revisit"
    rows = [(-5, url, "y" * 120), (-7, "http://z/\nWARC-Type: revisit", "y" * 120), (None, None, "y" * 120), (None, "http://n/", None), (9, " spaced ", "q")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in queries.op1_warc(spark, str(tmp_path)).collect())
    assert found == [(-7, "response", None, 120), (-5, "revisit", -7, 120), (0, "response", None, 0), (0, "response", None, 120), (9, "response", None, 1)]
    data = warc.head({"warc_type": "response", "target_uri": url}, 3)
    assert warc.parse_head(data[: data.index(b"\r\n\r\n")]) == {"warc-type": "response", "warc-target-uri": url.replace("\r", "%0D").replace("\n", "%0A"), "content-length": "3"}


def test_no_pages(spark, tmp_path):
    warc.write(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_members_of_several_records_and_records_of_several_members(spark, tmp_path):
    bodies = [b"one", b"", b"\r\n\r\n" * 40, b"z" * 300_000, b"WARC/1.1\r\nWARC-Type: fake\r\n\r\n"]
    records = [warc.head({"warc_type": "response" if k % 2 else "metadata", "record_id": f"<{k}>"}, len(b)) + b + b"\r\n\r\n" for k, b in enumerate(bodies)]
    folder = tmp_path / "m"
    folder.mkdir()
    whole = b"".join(records)
    (folder / "one.warc.gz").write_bytes(gzip.compress(whole))
    (folder / "cut.warc.gz").write_bytes(b"".join(gzip.compress(whole[k : k + 70_001]) for k in range(0, len(whole), 70_001)))
    (folder / "plain.warc").write_bytes(whole)
    rows = warc.read(spark, str(folder)).collect()
    assert sorted((r.record_id, r.payload) for r in rows) == sorted((f"<{k}>", b) for k, b in enumerate(bodies) for _ in range(3))
    assert warc.read(spark, str(folder), payload=False).filter("warc_type = 'response'").count() == 6
    (folder / "torn.warc.gz").write_bytes(gzip.compress(whole)[:-40_000] if len(gzip.compress(whole)) > 50_000 else gzip.compress(whole)[:-9])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, str(folder)).collect()


def test_an_archive_is_split_by_its_index(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h{k}/", f"{k} " * 400) for k in range(300)], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.page_records(pages).coalesce(1), str(tmp_path / "w"))
    warc.register(spark)
    rows = spark.read.format("warc").option("path", str(tmp_path / "w")).option("split_bytes", "4096").load()
    assert rows.rdd.getNumPartitions() > 10 and sorted(r.record_id for r in rows.collect()) == sorted(f"<urn:page:{k}>" for k in range(300))


def test_order_and_prefix_filters(spark, tmp_path):
    warc.write(warc.page_records(spark.createDataFrame([(k, f"http://{'ab'[k % 2]}/{k}", "x") for k in range(20)], "page_id long, url string, html string")), str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w"))
    found = rows.filter("target_uri LIKE 'http://a/%' AND target_uri > 'http://a/2' AND date >= '2024' AND date < '2025'")
    assert {r.target_uri for r in found.collect()} == {f"http://a/{k}" for k in range(0, 20, 2) if f"{k}" > "2"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "LIKE" not in plan


def test_columns_that_clash(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200, "a", "b", 7), (2, "v", "x" * 200, "a", "b", 7)], "page_id long, url string, html string, payload string, _digest string, _first int")
    warc.write(warc.page_records(pages), str(tmp_path / "w"))
    assert sorted(r.warc_type for r in warc.read(spark, str(tmp_path / "w")).collect()) == ["response", "revisit"]
