"""Stored responses of services: WARC files as a Spark data source for batches, streams and writing.

`register(spark)` makes the format known; then `spark.read.format("responses").load(path)`, `spark.readStream` and
`df.write.format("responses").mode("append").save(path)` work on a folder of .warc and .warc.gz files, on a file system that
pyarrow reaches. Rows are (url, host, fetched, status, content_type, body): fetched in seconds or null, body without transfer
and content codings. A task reads a file, record by record. Filters on host, fetched and status are applied before
a record's HTTP part is read where they can be.

Option `damaged`: "fail" (the default), or "skip", which leaves out the rest of a file from the first damaged record on.
"""

from __future__ import annotations

import gzip
import io
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from assayer.sources import corpus

SCHEMA = "url string, host string, fetched double, status int, content_type string, body binary"
_ARROW = pa.schema([("url", pa.string()), ("host", pa.string()), ("fetched", pa.float64()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary())])
ENDINGS = (".warc", ".warc.gz")
#: Bodies that a batch holds before it is handed on; bytes of records, before compression, after which a writing task begins its next file.
BATCH_BYTES, FILE_BYTES = 4 << 20, 1 << 30
DAMAGE = (ValueError, EOFError, OSError, zlib.error)
_COMPARED = {ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b}


def _files(folder: str) -> tuple[fs.FileSystem, list[str]]:
    """The file system and its archives in or below folder, by name. Names that begin with _ or . are not ready."""
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ENDINGS) and f.base_name[0] not in "_.")


def _headers(stream) -> dict[str, str]:
    """Header lines up to the empty one; of a name that comes again the last."""
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise EOFError("headers without an end")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC stream; raises one of DAMAGE where it isn't one."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        head = _headers(stream)
        size = int(head.get("content-length", ""))
        if size < 0:
            raise ValueError("a record of negative length")
        block = stream.read(size)
        if len(block) < size:
            raise EOFError("a record ends early")
        yield head, block


def _unchunked(body: bytes) -> bytes:
    stream, out = io.BytesIO(body), []
    while size := int(stream.readline().split(b";")[0], 16):
        part = stream.read(size)
        if len(part) < size:
            raise EOFError("a chunk ends early")
        out.append(part)
        stream.readline()
    return b"".join(out)


def _response(block: bytes) -> tuple[int, str | None, bytes]:
    """Status, content type and plain body of an HTTP response."""
    stream = io.BytesIO(block)
    words = stream.readline().split()
    if len(words) < 2 or not words[0].startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    head, body = _headers(stream), stream.read()
    if head.get("transfer-encoding", "").lower() == "chunked":
        body = _unchunked(body)
    coding = head.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip"):
        body = gzip.decompress(body)
    elif coding == "deflate":
        body = zlib.decompress(body)
    return int(words[1]), head.get("content-type"), body


def _seconds(date: str | None) -> float | None:
    try:
        return datetime.fromisoformat(date).timestamp() if date else None
    except ValueError:
        return None


def _host(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


class _Tests:
    """Filters that this source applies itself; a null passes none of them."""

    def __init__(self):
        self.held: list[ds.Filter] = []

    def take(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Keeps the filters on host, fetched and status that it knows, and gives back the others."""
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("host",), ("fetched",), ("status",)):
                self.held.append(f)
            else:
                yield f

    def pass_by(self, **values) -> bool:
        mine = [(f, values[f.attribute[0]]) for f in self.held if f.attribute[0] in values]
        return all(v is not None and _COMPARED[type(f)](v, f.value) for f, v in mine)


def _read(system: fs.FileSystem, path: str, tests: _Tests, skip: bool) -> Iterator[tuple]:
    with system.open_input_stream(path, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=io.BufferedReader(raw)) if path.endswith(".gz") else io.BufferedReader(raw)
        try:
            for head, block in records(stream):
                if head.get("warc-type") != "response":
                    continue
                url, fetched = head.get("warc-target-uri", "").strip("<>"), _seconds(head.get("warc-date"))
                if tests.pass_by(host=_host(url), fetched=fetched):
                    status, content_type, body = _response(block)
                    if tests.pass_by(status=status):
                        yield url, _host(url), fetched, status, content_type, body
        except DAMAGE as cause:
            if not skip:
                raise ValueError(f"{path} is damaged: {cause}") from cause


def _batches(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in found:
        held.append(r)
        size += len(r[5]) + 200
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW, strict=True)], schema=_ARROW)


class _File(ds.InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Source:
    """What readers of batches and of streams share."""

    def __init__(self, options: dict):
        self.folder, self.skip, self.tests = options["path"], options.get("damaged", "fail") == "skip", _Tests()

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        """The rows of a file; Spark asks with none where there is no file."""
        return iter(()) if partition is None else _batches(_read(_files_system(self.folder), partition.value, self.tests, self.skip))


def _files_system(folder: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()


class Reader(_Source, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        return self.tests.take(filters)

    def partitions(self) -> list[_File]:
        return [_File(path) for path in _files(self.folder)[1]]


class StreamReader(_Source, ds.DataSourceStreamReader):
    """An offset is the last file's name and the number of files up to it. Files must come under names that sort behind those there;
    one that comes before them, or one that is gone, is told as an error rather than missed."""

    def initialOffset(self) -> dict:
        return {"name": "", "files": 0}

    def latestOffset(self) -> dict:
        names = _files(self.folder)[1]
        return {"name": names[-1], "files": len(names)} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_File]:
        names = [n for n in _files(self.folder)[1] if n <= end["name"]]
        fresh = [n for n in names if n > start["name"]]
        if len(names) != end["files"] or len(names) - len(fresh) != start["files"]:
            raise ValueError("archives came before those that have been read, or are gone")
        return [_File(n) for n in fresh]


class Written(ds.WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def _record(url: str, fetched: float | None, status: int | None, content_type: str | None, body: bytes | None) -> bytes:
    told = [f"HTTP/1.1 {200 if status is None else status} ", *([] if content_type is None else [f"Content-Type: {content_type}"]), f"Content-Length: {len(body or b'')}"]
    dated = [] if fetched is None else [f"WARC-Date: {datetime.fromtimestamp(fetched, timezone.utc).isoformat(timespec='microseconds').replace('+00:00', 'Z')}"]
    block = "\r\n".join([*told, "", ""]).encode() + (body or b"")
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {fetched}')}>", f"WARC-Target-URI: {url}", *dated, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if any(c in url + (content_type or "") for c in "\r\n"):
        raise ValueError("a line break in an address or a content type")
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class Writer(ds.DataSourceArrowWriter):
    """Tasks write under names that no reader takes; the driver gives the files of tasks that have succeeded their names, which sort behind all earlier ones."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.most = options["path"].rstrip("/"), overwrite, int(options.get("file_bytes", FILE_BYTES))

    def _begin(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
        system.create_dir(path, recursive=True)
        return system, path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._begin()
        names, out, size = [], None, 0
        for batch in iterator:
            known = set(batch.schema.names)
            for r in batch.to_pylist():
                if r["url"] is None:
                    raise ValueError("a response without an address")
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    names.append(f"{folder}/_{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(names[-1], compression=None), 0
                record = _record(r["url"], *(r[c] if c in known else None for c in ("fetched", "status", "content_type", "body")))
                out.write(gzip.compress(record, 6, mtime=0))
                size += len(record)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._begin()
        old, at, k = _files(self.folder)[1], time.time_ns(), 0
        for m in messages:
            for name in m.names if m else []:
                system.move(name, f"{folder}/{at:020d}-{k:06d}.warc.gz")
                k += 1
        for name in old if self.overwrite else []:
            system.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = self._begin()
        for m in messages:
            for name in m.names if m else []:
                system.delete_file(name)


class Responses(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format "responses" known to the session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)


def documents(responses: DataFrame) -> DataFrame:
    """(locator, text, added) of what wikis (JSON) and preprint services (Atom) have answered with status 200; other responses say nothing."""
    good = responses.filter("status = 200").select("host", F.lower(F.coalesce("content_type", F.lit(""))).alias("kind"), F.col("body").cast("string").alias("body"))
    wiki, preprints = good.filter(F.col("kind").contains("json")), good.filter(F.col("kind").contains("xml"))
    return corpus.parse_wiki(wiki, F.col("host")).unionByName(corpus.parse_preprints(preprints))
