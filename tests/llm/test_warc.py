"""WARC archives: round trips, revisits, and files that are not right."""

import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from vertexmill.llm import queries, warc

LONG = "<p>" + "é" * 600 + "</p>"
SCHEMA = "page_id long, url string, html string, record_type int, file string"


def _pages():
    rows = [(k, f"http://h{k % 7}.net/{k}", f"<html>{k} " + "word " * (k % 50) + "</html>") for k in range(700)]
    rows += [(1000 + k, "u", LONG) for k in range(250)] + [(1300 + k, None, "short") for k in range(5)]
    rows += [(1400, "a b\r\nX: y", None), (1401, "", ""), (1402, "v", "x" * 999), (1403, "v", "x" * 999), (1404, "v", "y" * 1000), (1405, "v", "y" * 1000), (1405, "v", "y" * 1000), (-7, "v", "y" * 1000)]
    rows += [(None, "n", LONG), (None, "n", "z" * 2000), (None, "n", "z" * 2000), (1500, "long", "é\n" * 1_500_000), (1501, "crlf", "\r\n\r\nWARC/1.1\r\n" * 90), (2**62, "big", "b" * 1200), (3, "again", "b" * 1200)]
    return rows


def expected(rows):
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html] = max(largest.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and html in largest and largest[html] != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[html] if revisit else None))
    return out


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, 1, "f") for r in _pages()], SCHEMA).repartition(3)


def test_report(pages):
    got = [tuple(r) for r in warc.report(pages).collect()]
    assert sorted(got, key=str) == sorted(expected(_pages()), key=str)
    assert {r[3] for r in got} == {"response", "revisit"}


def test_join_by_digest(spark, pages):
    """The same where the repeated digests are not broadcast."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [tuple(r) for r in warc.report(pages).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(got, key=str) == sorted(expected(_pages()), key=str)


def test_files(spark, pages, tmp_path, monkeypatch):
    manifest = warc.write(pages, folder=f"file://{tmp_path}/w", date="2020-02-02T00:00:00Z")
    rows = manifest.collect()
    assert sum(r.records for r in rows) == len(_pages()) and sorted(p.name for p in (tmp_path / "w").iterdir()) == sorted(r.file.rsplit("/", 1)[1] for r in rows)
    for r in rows:
        data = open(r.file.removeprefix("file://"), "rb").read()
        assert len(data) == r.bytes and int.from_bytes(data[:4], "little") == warc.SKIPPABLE
        assert zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")]).dict_id()
    found = warc.read(warc.archives(spark, f"{tmp_path}/w")).collect()
    assert len(found) == len(_pages()) and {r.error for r in found} == {None} and {r.date for r in found} == {"2020-02-02T00:00:00Z"}
    bodies = {r.record_id: bytes(r.payload) for r in found if r.record_type == "response"}
    for i, _, html in _pages():
        data = (html or "").encode()
        digest = hashlib.sha1(data).hexdigest()
        mine = [r for r in found if r.record_id == warc.record_id(i, digest)]
        assert mine and all(bodies[r.refers_to if r.record_type == "revisit" else r.record_id] == data for r in mine)
    assert {r.target_uri for r in found if r.record_id.startswith("<urn:x-page:1400:")} == {"a%20b%0D%0AX:%20y"}


def test_several_archives_a_task(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)

    class Task:  # the limit holds where the module is, so this one task runs here
        def __init__(self, df):
            self.df = df

        def mapInArrow(self, run, _):
            return list(run(iter(self.df.toArrow().to_batches())))

    few = pages.filter("page_id < 700").select("page_id", "url", "html")
    monkeypatch.setattr(warc, "with_revisits", lambda p, least: Task(p.withColumn("refers_to", F.lit(None).cast("long"))))
    monkeypatch.setattr(warc, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda s: 3, "taskAttemptId": lambda s: 9})())}))
    monkeypatch.setattr(warc, "cut", lambda made: made)
    made = [r for b in warc.write(few, folder=f"file://{tmp_path}/s") for r in b.to_pylist()]
    assert len(made) > 1 and sum(r["records"] for r in made) == few.count() and len({r["file"] for r in made}) == len(made)
    assert warc.read(warc.archives(spark, f"{tmp_path}/s")).filter("error is null").count() == few.count()


def _archive(records, **kw):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    return out.getvalue()


def test_records_that_are_not_right(spark, tmp_path):
    good = [warc.record(k, f"u{k}", f"body {k} ".encode() * 9, None, "2020-01-01T00:00:00Z") for k in range(40)]
    revisit = warc.record(50, "u", b"z" * 1000, 51, "2020-01-01T00:00:00Z")
    assert warc.parse(revisit)["payload_bytes"] == 1000 and warc.parse(revisit)["payload"] is None
    wrong = {
        "no version line": good[0].replace(b"WARC/1.1", b"WARC/9"),
        "missing field: WARC-Date": good[0].replace(b"WARC-Date", b"X-Date"),
        "missing field: WARC-Record-ID": good[0].replace(b"WARC-Record-ID", b"X"),
        "Content-Length is not the block's length": good[0][:-4] + b"more\r\n\r\n",
        "the HTTP head's Content-Length is not the payload's length": good[0].replace(b"charset=utf-8\r\nContent-Length: 63", b"charset=utf-8\r\nContent-Length: 62"),
        "the payload has another digest": good[0].replace(b"body 0", b"body 1"),
        "no SHA-1 of the payload": good[0].replace(b"sha1:", b"md5:"),
        "no HTTP head with a length": good[0].replace(b"utf-8\r\nContent-Length", b"utf-8\r\nContent-Lengts"),
        "a revisit with a payload, or of no record": revisit.replace(b"WARC-Refers-To", b"X-Refers-To"),
        "a header line without a field: WARC-Date 2020-01-01T00:00:00Z": good[0].replace(b"WARC-Date: ", b"WARC-Date "),
    }
    data = _archive(good)
    (tmp_path / "a.warc.zst").write_bytes(_archive([*good, *wrong.values(), good[1]]))
    (tmp_path / "cut.warc.zst").write_bytes(data[:-5])
    (tmp_path / "more.warc.zst").write_bytes(data + b"junk")
    (tmp_path / "bits.warc.zst").write_bytes(data[:-3] + bytes(x ^ 255 for x in data[-3:]))
    (tmp_path / "early.warc.zst").write_bytes(data[:100])
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    (tmp_path / "plain.warc.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(r) for r in good))
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + int.from_bytes(data[4:8], "little")])
    (tmp_path / "packed.warc.zst").write_bytes(data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + int.from_bytes(data[4:8], "little") :])
    rows = warc.read(warc.archives(spark, str(tmp_path))).withColumn("file", F.element_at(F.split("file", "/"), -1)).collect()
    of = lambda name: sorted([r for r in rows if r.file == f"{name}.warc.zst"], key=lambda r: r.place)
    assert [r.error for r in of("a")] == [None] * 40 + list(wrong) + [None]
    for name, n in (("cut", 39), ("bits", 39), ("more", 40), ("early", 0)):
        assert sum(r.error is None for r in of(name)) == n and sum(r.error is not None for r in of(name)) == 1, name
    assert not of("empty") and len(of("plain")) == len(of("packed")) == 40 and all(r.error is None for r in of("plain") + of("packed"))


def test_a_bad_archive_fails_the_report(spark, tmp_path, monkeypatch):
    (tmp_path / "x.warc.zst").write_bytes(b"not an archive at all")
    monkeypatch.setattr(warc, "write", lambda pages: warc.archives(spark, str(tmp_path)))
    with pytest.raises(Exception, match="after the record there"):
        warc.report(None).collect()


def test_empty_table_and_query(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.report(empty).count() == 0
    rows = [(k, "u", LONG if k % 3 else f"{k}") for k in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_warc_round_trip"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected(rows))
