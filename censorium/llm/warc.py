"""WARC archives as a Spark data source in Python: ``spark.read.format("warc")``.

Reading: files are planned into partitions by size.  A filter on ``record_type``, on
``uri`` or on a header pseudo-column reaches the reader, which parses a record's headers
first and seeks past the payload of every record that the filter rejects, or of all
records when the schema has no ``payload``.
Writing: each task writes its own archive under a temporary name; the commit of the job
gives the final names, so that lost tasks and executors leave nothing behind that counts.

Archives are reached through pyarrow's file systems (local, hdfs, s3, ...).  Compressed archives (.warc.gz) are read
too, from front to back.  Headers may be written in any case and without a space; a record without a length
or a file that isn't an archive is an error.  Line breaks in a value are written percent-encoded.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from censorium.llm.common import rows_are_few, scratch, table

#: Planned bytes of a read partition; rows of an Arrow batch and their payload bytes.
PARTITION_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 4_096, 16 << 20
#: Duplicate payloads that are sent to all executors at most.
BROADCAST_ROWS = 200_000
VERSION = b"WARC/1.1"
#: Profile of a revisit with an equal payload (fixed value).
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, content_length long, payload binary"
#: Columns that are headers (fixed names of the format).
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "content_length": "Content-Length"}


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], [f.name for f in schema.fields])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.columns = options["path"], columns
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        #: Header name to the values that pass.
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column in HEADERS and column not in ("payload_bytes", "content_length") and values is not None:
                self.wanted[HEADERS[column]] = self.wanted.get(HEADERS[column], values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = open_fs(self.path)
        files = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.base_name.endswith((".warc", ".warc.gz")))
        out: list[Files] = []
        room = 0
        for path, size in files:
            if not out or size > room:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].paths.append(path)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(self.path)
        kinds = {c: pa.int64() if c in ("payload_bytes", "content_length") else pa.binary() if c == "payload" else pa.string() for c in self.columns}
        rows: list[list] = []
        held = 0
        for path in partition.paths:
            with Unpacked(system.open_input_stream(path, compression="gzip")) if path.endswith(".gz") else system.open_input_file(path) as raw:
                for headers, payload in records(raw, self.wanted, "payload" in self.columns):
                    rows.append([payload if c == "payload" else _value(c, headers) for c in self.columns])
                    held += len(payload or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, kinds)


def _value(column: str, headers: dict[str, str]) -> str | int | None:
    found = headers.get(HEADERS[column])
    return int(found) if found is not None and column in ("payload_bytes", "content_length") else found


def _batch(rows: list[list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


class Unpacked:
    """A compressed archive, read forwards; what lies before the last place asked for is gone."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.at = stream, 0

    def read_at(self, n: int, at: int) -> bytes:
        while self.at < at:
            skipped = len(self.stream.read(min(1 << 20, at - self.at)))
            if not skipped:
                return b""
            self.at += skipped
        found = self.stream.read(n)
        self.at += len(found)
        return found

    def __enter__(self) -> Unpacked:
        return self

    def __exit__(self, *_: object) -> None:
        self.stream.close()


#: Header names in lower case to the names used here.
_NAMES = {h.lower(): h for h in HEADERS.values()}


def headers_of(lines: list[bytes]) -> dict[str, str]:
    """Headers by name: any case, with or without space after the colon, continued lines joined; others are passed over."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if colon:
            last = _NAMES.get(name.strip().lower(), name.strip())
            out[last] = value.strip()
    return out


def records(raw: pa.NativeFile | Unpacked, wanted: dict[str, set[str]], payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and, if asked for, payload of each record that passes; other payloads are not read (of compressed archives: not kept)."""
    at, window, base = 0, b"", 0
    step = 64 << 10
    while True:
        # headers first: read on only until the blank line
        if not base <= at < base + len(window):
            window, base = raw.read_at(step, at), at
        if not window[at - base :].strip(b"\r\n"):
            more = raw.read_at(step, base + len(window))
            if not more:
                return
            window, base = window[at - base :] + more, at
            continue
        while window[at - base : at - base + 1] in (b"\r", b"\n"):
            at += 1
        while (end := window.find(b"\r\n\r\n", at - base)) < 0:
            more = raw.read_at(step, base + len(window))
            if not more:
                raise ValueError(f"cut-off WARC header at byte {at}")
            window, base = window[at - base :] + more, at
        lines = window[at - base : end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = headers_of(lines[1:])
        if not headers.get("Content-Length", "").isdigit():
            raise ValueError(f"no Content-Length in the WARC record at byte {at}")
        begin, length = base + end + 4, int(headers["Content-Length"])
        if all(headers.get(k) in v for k, v in wanted.items()):
            payload = None
            if payloads:
                inside = begin - base
                payload = window[inside : inside + length]
                if len(payload) < length:
                    payload += raw.read_at(length - len(payload), begin + len(payload))
                    window, base = b"", begin + length
            yield headers, payload
        at = begin + length


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    """Columns of SCHEMA that the input has; ``payload`` null: a record without block (a revisit)."""

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.job = path, columns, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = open_fs(self.path)
        task = TaskContext.get()
        temporary = posixpath.join(root, f"_temporary-{self.job}", f"{task.partitionId():06d}-{uuid.uuid4().hex}")
        system.create_dir(posixpath.dirname(temporary), recursive=True)
        with system.open_output_stream(temporary, buffer_size=1 << 20) as out:
            for batch in iterator:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(record(dict(zip(batch.schema.names, row, strict=True))))
        return Written(temporary, posixpath.join(root, f"part-{task.partitionId():06d}-{self.job}.warc"))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_fs(self.path)
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, f"_temporary-{self.job}")
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def record(row: dict) -> bytes:
    payload = row.get("payload") or b""
    lines = [VERSION]
    for column, header in HEADERS.items():
        if column != "content_length" and (value := row.get(column)) is not None:
            text = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in str(value))  # a header is one line
            lines.append(f"{header}: {text}".encode())
    if row.get("record_type") == "revisit":
        lines.append(b"WARC-Profile: " + PROFILE)
    lines += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()]
    return b"\r\n".join([*lines, b"", payload, b"", b""])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, *, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """WARC records of ``pages(page_id, url, html)``: one response or revisit per row.

    Of equal payloads of at least ``least_bytes`` that with the largest page_id is the
    response.  Null html is an empty payload.  Repeated rows with the largest page_id are
    all responses; a null page_id is never the largest unless all are null.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    copies = pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= least_bytes).groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = _persisted(copies)
    if rows_are_few(copies, BROADCAST_ROWS):
        marked = rows.join(F.broadcast(copies), "digest", "left")
    else:
        marked = rows.join(copies, "digest", "left")  # AQE splits the partition of a frequent digest
    revisit = F.col("original").isNotNull() & (F.coalesce(F.col("page_id"), F.lit(-(2**63))) < F.col("original")) & (F.col("bytes") >= least_bytes)
    uuid_of = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return marked.select(
        uuid_of(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("uri"),
        F.lit(date).alias("date"),
        F.when(revisit, uuid_of(F.col("original"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.col("bytes").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _persisted(df: DataFrame) -> DataFrame:
    from censorium.llm.common import saved

    return saved(df, "copies")


def page_of(record_id: str) -> F.Column:
    return F.regexp_extract(record_id, "<urn:page:(-?[0-9]*)>", 1).try_cast("long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, from the archives read back.

    Responses are read with their payloads, whose length and digest are computed anew;
    of revisits only the headers are read.
    """
    register(spark)
    path = scratch(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    archive = spark.read.format("warc").load(path)
    responses = archive.where("record_type = 'response'").select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    heads = spark.read.format("warc").schema(SCHEMA.rsplit(",", 1)[0]).load(path)
    revisits = heads.where("record_type = 'revisit'").select("record_id", "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", "refers_to")
    return responses.union(revisits).select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


#: The same from the pages themselves.
OP9_SQL = """
with b as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages
), m as (select d, max(page_id) as last from b where n >= 1000 group by d)
select page_id, cast(n as bigint) as payload_bytes, b.d as payload_digest, case when n >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < last then last end as refers_to
from b left join m on m.d = b.d
"""
