import base64
import gzip
import hashlib

import pytest

from quillspark.llm import warc
from quillspark.llm.storage import filesystem

PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/ c", "<p>é</p>"), (3, None, None), (9, "http://d", ""), (2**40, "http://e", "x" * 300_000), (-5, "http://f", "only"), (7, "http://g", "<p>é</p>"), (None, "http://h", "n\r\n\r\n")]


def expected(pages, least=0):
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == raw and p is not None]
        refers = max(same, default=None) if len(raw) >= least else page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers == page else "revisit", None if refers == page else refers))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def folder(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "url AS digest", "html AS payload").repartition(3)
    return warc.write_warc(df)


def test_round_trip(spark, folder):
    for payload in (False, True):
        assert sorted((tuple(r) for r in warc.pages_of(warc.read_warc(spark, folder, payload)).collect()), key=str) == expected(PAGES)
    rows = {warc.page_of(r.record_id): r for r in warc.read_warc(spark, folder).where("record_type = 'response'").collect()}
    texts = {p: (h or "").encode() for p, _, h in PAGES}
    assert rows and all(bytes(r.payload) == texts[p] for p, r in rows.items())


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.pages_of(warc.read_warc(spark, warc.write_warc(df, least=1))).collect()), key=str) == expected(PAGES, 1)


def test_predicates_are_pushed_down(spark, folder):
    reader = warc.WarcReader({"path": folder, "payload": "false"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.StringStartsWith(("target_uri",), "http://a"), warc.EqualTo(("payload_bytes",), 3)]))
    assert [f.attribute for f in left] == [("payload_bytes",)]
    rows = [r for p in reader.partitions() for r in reader.records(p.uri)]
    assert [warc.page_of(r["record_id"]) for r in rows] == [1]
    df = warc.read_warc(spark, folder).where("record_type = 'revisit' AND content_length < 1000 AND target_uri LIKE 'http://%' AND payload_bytes > 3")
    assert sorted(warc.page_of(r.record_id) for r in df.collect()) == [1, 2]


def test_unwanted_payloads_are_not_inflated(folder, monkeypatch):
    inflated = []

    class Counting(warc._Inflater):
        def next(self):
            inflated.append(len(self.data))
            return super().next()

    monkeypatch.setattr(warc, "_Inflater", Counting)
    reader = warc.WarcReader({"path": folder, "payload": "false"})
    rows = [r for p in reader.partitions() for r in reader.records(p.uri)]
    assert max(r["content_length"] for r in rows) > 300_000 and max(inflated) < 100_000


def test_other_archives(spark, tmp_path):
    """Members without skip lengths, and plain archives, are read too."""
    blocks = [b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nmore", b"", b"plain text"]
    raw = [f"WARC/1.0\r\nWARC-Type: {t}\r\nwarc-target-uri: http://x/{i}\r\nContent-Type: {c}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, (t, c, b) in enumerate(zip(("response", "metadata", "resource"), ("application/http; msgtype=response", "text/plain", "text/plain"), blocks, strict=True))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "b.warc").write_bytes(b"".join(raw))
    (tmp_path / ".c.warc").write_bytes(b"unfinished")
    rows = warc.read_warc(spark, f"file://{tmp_path}").orderBy("target_uri").collect()
    own = [(r.record_type, r.payload_bytes, bytes(r.payload)) for r in rows]
    assert own[::2] == own[1::2] == [("response", 12, b"body\r\n\r\nmore"), ("metadata", 0, b""), ("resource", 10, b"plain text")]
    assert rows[0].headers["warc-type"] == "response"


def test_members_are_gzip(folder):
    system, where = filesystem(folder)
    [path, *_] = [p.uri for p in warc.WarcReader({"path": folder}).partitions()]
    with system.open_input_stream(filesystem(path)[1], compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_ids_survive(spark):
    for i in (None, 0, 1, -1, 2**63 - 1, -(2**63), 65_536):
        assert warc.page_of(f"<{warc.record_id(i)}>") == i


def test_empty_table(spark):
    folder = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_warc(spark, folder).count() == 0


def test_other_attempts_add_no_record(spark, folder):
    """What a task's other attempt left behind is not in the manifest."""
    system, where = filesystem(folder)
    [path, *_] = [p.uri for p in warc.WarcReader({"path": folder}).partitions()]
    with system.open_input_stream(filesystem(path)[1], compression=None) as f:
        raw = f.read()
    with system.open_output_stream(f"{where}/part-000000-0000-0123.warc.gz", compression=None) as f:
        f.write(raw)
    assert sorted((tuple(r) for r in warc.pages_of(warc.read_warc(spark, folder)).collect()), key=str) == expected(PAGES)
    system.delete_file(f"{where}/part-000000-0000-0123.warc.gz")


def test_frequent_digests(spark, monkeypatch):
    """A third of the pages share a payload, which then meets its response by broadcast."""
    rows = [(i, f"http://{i}", ["same", "two", f"own {i}"][i % 3 if i < 90 else 2]) for i in range(120)] + [(None, "http://n", "same"), (87, "http://again", "same")]
    monkeypatch.setattr(warc, "FREQUENT_ROWS", 45)
    got = warc.pages_of(warc.read_warc(spark, warc.write_warc(spark.createDataFrame([*rows, *((200 + i, None, "same") for i in range(20))], "page_id long, url string, html string").repartition(4))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected([*rows, *((200 + i, None, "same") for i in range(20))])


def test_rows_that_repeat_the_largest_id_are_responses(spark):
    rows = [(1, "a", "x"), (5, "b", "x"), (5, "b", "x"), (5, "c", "x")]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.pages_of(warc.read_warc(spark, warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string")))).collect())
    assert got == [(1, "revisit", 5)] + [(5, "response", None)] * 3


@pytest.mark.parametrize("suffix", ["warc.gz", "warc"])
def test_malformed_records_are_kept_apart(spark, tmp_path, suffix):
    def record(i, length=None, kind="resource"):
        body = f"body {i}".encode()
        raw = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x/{i}\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n".encode() + body + b"\r\n\r\n"
        return gzip.compress(raw) if suffix.endswith("gz") else raw

    broken = record(1, "many")
    (tmp_path / f"a.{suffix}").write_bytes(record(0) + broken + record(2) + b"rubbish" + record(3) + record(4)[:-12 if suffix == "warc" else -20])
    df = warc.read_warc(spark, f"file://{tmp_path}", malformed="keep")
    rows = df.collect()
    assert [r.target_uri for r in rows if r.record_type == "resource"] == ["http://x/0", "http://x/2", "http://x/3"]
    assert len([r for r in rows if r.record_type == "malformed"]) == 3 and all("error" in r.headers for r in rows if r.record_type == "malformed")
    assert df.where("record_type = 'malformed'").count() == 3
    with pytest.raises(Exception, match="byte"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()


def test_foreign_record_ids():
    assert [warc.page_of(x) for x in (None, "", "<urn:uuid:nonsense>", "<urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8>")] == [None] * 4
