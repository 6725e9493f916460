import gzip
import json

import pytest
from pyspark.sql import functions as F

from assayer.sources import archives

WIKI = json.dumps({"query": {"pages": [{"title": "Green tea", "extract": "Tea improves focus.", "touched": "2024-01-02T03:04:05Z"}, {"title": "Blank", "extract": " ", "touched": "2024-01-02T03:04:05Z"}]}})
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.1v1</id><title>On  tea</title><summary>Tea helps.</summary><published>2024-01-01T00:00:00Z</published></entry></feed>'
ROWS = [
    ("https://en.example.org/w/api.php?q=tea", 1.7e9, 200, "application/json", WIKI.encode()),
    ("https://export.example.org/api?q=tea", 1.7e9 + 0.25, 200, "application/atom+xml", ATOM.encode()),
    ("https://en.example.org/lost", 1.7e9 + 2, 404, "text/html", b"gone"),
    ("https://de.example.org/empty", None, None, None, None),
]
INPUT = "url string, fetched double, status int, content_type string, body binary"


@pytest.fixture
def known(spark):
    archives.register(spark)
    return spark


def load(spark, folder, **options):
    return spark.read.format("responses").options(**options).load(str(folder))


def put(spark, folder, rows, mode="append", **options):
    spark.createDataFrame(rows, INPUT).coalesce(1).write.format("responses").options(**options).mode(mode).save(str(folder))


def test_round_trip(known, tmp_path):
    put(known, tmp_path / "a", ROWS)
    got = sorted(map(tuple, load(known, tmp_path / "a").collect()))
    want = sorted((u, u.split("/")[2], f, s or 200, c, bytes(b or b"")) for u, f, s, c, b in ROWS)
    assert [(*g[:5], bytes(g[5])) for g in got] == want
    put(known, tmp_path / "a", ROWS[:1], mode="overwrite", file_bytes=1)
    assert load(known, tmp_path / "a").count() == 1


def test_rolls_over_and_publishes_whole_files(known, tmp_path):
    put(known, tmp_path / "a", ROWS, file_bytes=1)
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) == 4 and load(known, tmp_path / "a").count() == 4
    (tmp_path / "a/_unfinished.warc.gz").write_bytes(b"half")
    assert load(known, tmp_path / "a").count() == 4
    with pytest.raises(Exception, match="line break"):
        put(known, tmp_path / "a", [("https://x.example.org/\r\nWARC-Type: no", None, None, None, None)])
    assert load(known, tmp_path / "a").count() == 4


def test_filters_reach_the_source(known, tmp_path):
    put(known, tmp_path / "a", ROWS)
    whole = load(known, tmp_path / "a")
    for condition in ("host = 'en.example.org'", "status = 200 AND fetched >= 1700000000.25", "host IN ('en.example.org', 'de.example.org') AND fetched < 1.70000001e9", "host = 'en.example.org' OR status = 404", "status <> 200", "fetched IS NULL", "NOT status = 200"):
        kept = [r for r in ROWS if known.createDataFrame([r], INPUT).withColumn("host", F.parse_url("url", F.lit("HOST"))).fillna(200, ["status"]).filter(condition).count()]
        assert sorted(r["url"] for r in whole.filter(condition).collect()) == sorted(r[0] for r in kept), condition
    tests = archives._Tests()
    from pyspark.sql.datasource import EqualTo, StringContains

    assert [type(f) for f in tests.take([EqualTo(("host",), "en.example.org"), EqualTo(("url",), "x"), StringContains(("host",), "en")])] == [EqualTo, StringContains]
    assert tests.pass_by(host="en.example.org") and not tests.pass_by(host="de.example.org") and not tests.pass_by(host=None)


def record(block, kind="response", url="https://a.example.org/x"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: <{url}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_codings_and_other_records(known, tmp_path):
    squeezed = gzip.compress(b"plain words")
    blocks = [
        record(b"about", "warcinfo"),
        record(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=y\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"),
        record(b"HTTP/1.0 200\r\nContent-Encoding: gzip\r\nContent-Type: text/plain\r\n\r\n" + squeezed),
        record(b"GET / HTTP/1.1\r\n\r\n", "request"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(blocks))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(blocks)))  # one member
    (tmp_path / "many.warc.gz").write_bytes(b"".join(map(gzip.compress, blocks)))  # a member a record
    (tmp_path / "none.warc").write_bytes(b"")
    got = [bytes(r["body"]) for r in load(known, tmp_path).collect()]
    assert sorted(got) == [b"hello world"] * 3 + [b"plain words"] * 3
    assert {r["fetched"] for r in load(known, tmp_path).collect()} == {1704067200.0}


@pytest.mark.parametrize("damage", [lambda b: b[:-20], lambda b: b + b"rubbish\r\n", lambda b: b + record(b"no response"), lambda b: b + b"WARC/1.0\r\nContent-Length: -4\r\n\r\n"])
@pytest.mark.parametrize("ending", [".warc", ".warc.gz"])
def test_damage(known, tmp_path, damage, ending):
    good = record(b"HTTP/1.1 200 OK\r\n\r\nfirst")
    raw = damage(good + record(b"HTTP/1.1 200 OK\r\n\r\nsecond, longer than what is cut"))
    (tmp_path / f"a{ending}").write_bytes(gzip.compress(raw) if ending.endswith("gz") else raw)
    with pytest.raises(Exception, match="is damaged"):
        load(known, tmp_path).collect()
    assert bytes(load(known, tmp_path, damaged="skip").collect()[0]["body"]) == b"first"


def test_cut_compressed_file(known, tmp_path):
    whole = b"".join(gzip.compress(record(b"HTTP/1.1 200 OK\r\n\r\n" + bytes(k))) for k in range(3))
    (tmp_path / "a.warc.gz").write_bytes(whole[:-15])
    with pytest.raises(Exception, match="is damaged"):
        load(known, tmp_path).collect()
    assert load(known, tmp_path, damaged="skip").count() == 2


def test_no_folder(known, tmp_path):
    assert load(known, tmp_path / "absent").collect() == []


def test_documents(known, tmp_path):
    put(known, tmp_path / "a", ROWS)
    got = sorted(map(tuple, archives.documents(load(known, tmp_path / "a")).collect()))
    assert got == [("arxiv.org/abs/2401.1v1", "On tea. Tea helps.", 1704067200.0), ("en.example.org/wiki/Green_tea", "Tea improves focus.", 1704164645.0)]


def test_stream(known, tmp_path):
    def run(name):
        stream = known.readStream.format("responses").load(str(tmp_path / "a"))
        writer = stream.select("url", "status").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r["url"] for r in known.read.parquet(str(tmp_path / "out")).collect())

    put(known, tmp_path / "a", ROWS[:2])
    assert run("one") == sorted(r[0] for r in ROWS[:2])
    put(known, tmp_path / "a", ROWS[2:])
    assert run("two") == sorted(r[0] for r in ROWS)  # each once
    assert run("again") == sorted(r[0] for r in ROWS)
    (tmp_path / "a/0.warc").write_bytes(record(b"HTTP/1.1 200 OK\r\n\r\nlate"))
    put(known, tmp_path / "a", ROWS[:1])
    with pytest.raises(Exception, match="before those"):
        run("late")
