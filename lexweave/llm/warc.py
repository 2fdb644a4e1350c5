"""WARC archives as a PySpark data source: planned by splits, filtered by headers before any payload is read."""
from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)

from lexweave.llm.common import filesystem, ready
from lexweave.sources.tables import stage

VERSION = b"WARC/1.1\r\n"
SPLIT_BYTES = 16 << 20
LEAST_REVISIT = 100
#: Own files: manifests, one per commit, and archives, which count only once a manifest names them.
MANIFEST, OWN = "_manifest-", "lexweave-"
CHUNK = 64 << 10
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FORMAT = "lexweave_warc"
DATE = "2000-01-01T00:00:00Z"
#: Headers in the order in which they are written: (column, header). Predicates on these columns are pushed down.
HEADERS = (("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("uri", "WARC-Target-URI"), ("date", "WARC-Date"),
           ("payload_digest", "WARC-Payload-Digest"), ("refers_to", "WARC-Refers-To"), ("payload_bytes", "X-Payload-Length"))
CONTROL, UNSAFE, FOLD = re.compile(r"[\x00-\x1f\x7f]|^\s|\s$"), re.compile(r"[%\x00-\x1f\x7f]|^\s|\s$"), re.compile(r"\r\n[ \t]+")
ESCAPED = "X-Escaped"
SCHEMA = ("record_type string, record_id string, uri string, date string, payload_digest string, refers_to string, "
          "payload_bytes long, payload binary")


class Split(NamedTuple):
    """A stretch of whole records in one archive."""
    file: str
    start: int
    end: int


def record(fields: dict[str, str | int | None], payload: bytes) -> bytes:
    """One record. Where a value holds control characters, values are percent-escaped, and a header says so."""
    named = [(name, str(fields[c])) for c, name in HEADERS if fields.get(c) is not None]
    if any(CONTROL.search(v) for _, v in named):
        named = [(name, UNSAFE.sub(lambda m: quote(m[0]), v)) for name, v in named] + [(ESCAPED, "percent")]
    named.append(("WARC-Profile", SAME_PAYLOAD) if fields.get("record_type") == "revisit" else ("Content-Type", "text/html; charset=utf-8"))
    lines = "".join(f"{name}: {v}\r\n" for name, v in named)
    return VERSION + lines.encode() + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, splits: list[tuple[str, int, int]]):
        self.splits = splits


class WarcWriter(DataSourceArrowWriter):
    """One archive per task, under a name of its own. Each commit adds a manifest of the archives of its committed tasks."""

    def __init__(self, path: str, split_bytes: int, overwrite: bool):
        self.path, self.split_bytes, self.overwrite = path, split_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, at, start, splits, out = f"{OWN}{uuid.uuid4().hex}.warc", 0, 0, [], None
        for b in iterator:
            columns = [b.column(c).to_pylist() for c, _ in HEADERS]
            for *fields, payload in zip(*columns, b.column("payload")):
                out = out or fs.open_output_stream(f"{root}/{name}")
                body = payload.as_py() or b""
                at += out.write(r := record(dict(zip([c for c, _ in HEADERS], fields)), body)) or len(r)
                if at - start >= self.split_bytes:
                    splits.append((name, start, at))
                    start = at
        if out:
            out.close()
        return Written(splits + [(name, start, at)] if at > start else splits)

    def commit(self, messages: list[Written | None]) -> None:
        """The new manifest names those it replaces, so that a reader sees the old archives or the new ones, never both."""
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        old = manifests(fs, root) if self.overwrite else {}
        body = {"splits": [s for m in messages if m for s in m.splits], "replaces": sorted(old), "alone": self.overwrite}
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(body).encode())
        for name in {s[0] for m in old.values() for s in m["splits"]}:
            fs.delete_file(f"{root}/{name}")
        for name in old:
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for name in {s[0] for m in messages if m for s in m.splits}:
            fs.delete_file(f"{root}/{name}")


def listed(fs: pafs.FileSystem, root: str) -> dict[str, int]:
    return {f.base_name: f.size for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file}


def manifests(fs: pafs.FileSystem, root: str) -> dict[str, dict]:
    """The manifests in force by file name."""
    found = {}
    for name in listed(fs, root):
        if name.startswith(MANIFEST) and name.endswith(".json"):
            with fs.open_input_stream(f"{root}/{name}") as f:
                found[name] = json.loads(f.read())
    gone = {x for m in found.values() for x in m["replaces"]}
    return {k: m for k, m in found.items() if k not in gone}


class Part(InputPartition):
    def __init__(self, split: Split):
        super().__init__(split)


class Plain:
    """Any stretch of an archive; small ones come from a chunk read ahead."""

    def __init__(self, f):
        self.f, self.base, self.held = f, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.base <= at <= at + n <= self.base + len(self.held):
            self.f.seek(at)
            self.base, self.held = at, self.f.read(max(n, CHUNK))
        return self.held[at - self.base: at - self.base + n]

    def free(self, at: int) -> None:
        pass


class Inflated:
    """A gzip archive of one or many members, from the front: what lies before ``free`` is forgotten."""

    def __init__(self, f):
        self.f, self.base, self.held, self.z = f, 0, bytearray(), zlib.decompressobj(31)

    def grow(self) -> bool:
        raw = self.z.unused_data or self.f.read(CHUNK)
        if not raw:
            return False
        if self.z.eof:
            raw = raw.lstrip(b"\0")
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(raw)
        return True

    def get(self, at: int, n: int) -> bytes:
        while self.base + len(self.held) < at + n:
            full = self.base + len(self.held)
            if full <= at:
                self.base, self.held = full, bytearray()
            if not self.grow():
                break
        return bytes(self.held[at - self.base: at - self.base + n]) if at >= self.base else b""

    def free(self, at: int) -> None:
        cut = max(0, min(at - self.base, len(self.held)))
        del self.held[:cut]
        self.base += cut


class WarcReader(DataSourceReader):
    """Parses headers first; a payload is read only if the headers pass and the schema has the payload."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tests = path, columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = {c for c, _ in HEADERS}
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in names:
                value = tuple(f.value) if isinstance(f, In) else getattr(f, "value", None)
                self.tests.append((f.attribute[0], type(f).__name__, value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        """Splits of the archives in the manifests, and every other archive in the folder whole (an uncommitted one of our own is none)."""
        fs, root = filesystem(self.path)
        known, files = manifests(fs, root), listed(fs, root)
        splits = [Split(*s) for m in known.values() for s in m["splits"]]
        if not any(m["alone"] for m in known.values()):
            splits += [Split(name, 0, size) for name, size in sorted(files.items()) if name.endswith((".warc", ".warc.gz")) and not name.startswith(OWN)]
        return [Part(s) for s in splits] or [Part(Split("", 0, 0))]

    def passes(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            got = row[column]
            ok = got is not None and (kind == "IsNotNull" or (got == value if kind == "EqualTo" else got in value if kind == "In" else str(got).startswith(value)))
            if not ok:
                return False
        return True

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        split = partition.value
        if not split.file:
            return
        fs, root = filesystem(self.path)
        held: list[dict] = []
        size = 0
        with fs.open_input_file(f"{root}/{split.file}") as f:
            zipped = split.file.endswith(".gz")
            source = Inflated(f) if zipped else Plain(f)
            for row, length, at in headers(source, split.start, None if zipped else split.end):
                if not self.passes(row):
                    continue
                if "payload" in self.columns:
                    row["payload"] = source.get(at, length)
                    size += length
                held.append(row)
                size += 500
                if size > 4 << 20:
                    yield batch(held, self.columns)
                    held, size = [], 0
        if held:
            yield batch(held, self.columns)


ARROW = {c: pa.int64() if c == "payload_bytes" else pa.string() for c, _ in HEADERS} | {"payload": pa.binary()}


def batch(rows: list[dict], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, ARROW[c]) for c in columns]))


def headers(source: Plain | Inflated, start: int, end: int | None) -> Iterator[tuple[dict, int, int]]:
    """(header columns, payload length, where the payload is) of every record from ``start`` on, passing over payloads.

    Header names are of either case, folded lines belong to the one before, values stay as they are.
    """
    column = {name.lower(): c for c, name in HEADERS}
    while end is None or start < end:
        n = CHUNK // 16
        head = source.get(start, n)
        while head[:1] in (b"\r", b"\n"):
            skip = len(head) - len(head.lstrip(b"\r\n"))
            start += skip
            head = source.get(start, n)
        if not head or end is not None and start >= end:
            return
        while (stop := head.find(b"\r\n\r\n")) < 0:
            more = source.get(start, 2 * n)
            if len(more) == len(head):
                raise ValueError(f"record at {start} has no end of header")
            n, head = 2 * n, more
        row: dict = {c: None for c, _ in HEADERS} | {"payload": None}
        length, escaped = 0, False
        lines = FOLD.sub(" ", head[:stop].decode("utf-8", "replace")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {start}")
        for line in lines[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "content-length":
                length = int(value)
            elif name in column:
                row[column[name]] = value
            elif name == ESCAPED.lower():
                escaped = True
        if escaped:
            row = {c: unquote(v) if v else v for c, v in row.items()}
        row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] is not None else length
        at = start + stop + 4
        yield row, length, at
        start = at + length
        source.free(start)


class WarcSource(DataSource):
    """``path``; the schema may name fewer columns (without ``payload``, payloads stay unread); ``split_bytes`` when writing."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], list(schema.names))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known. Filters reach Python sources only if the session allows it, so this is switched on."""
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """One WARC record per page: responses, and revisits without payload of the page with the smallest key and equal payload.

    Null html is an empty payload; a null key gives a record with a row number as its id, which never is referred to and
    itself revisits if a page with a key has its payload; rows that repeat the smallest key are all
    responses; an empty table gives no record; other columns play no part. Only digests that occur
    twice are joined back: they are staged, so that their size on disk decides whether they are broadcast.
    """
    payload = F.coalesce(F.encode(F.col(html), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    shared = stage(rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("times"))
                   .where("times > 1 and first is not null").select("digest", "first"), "warc")
    revisit = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.join(shared, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.coalesce(name(F.col("k")), F.concat(F.lit("<urn:row:"), F.monotonically_increasing_id().cast("string"), F.lit(">"))).alias("record_id"), "uri", F.lit(DATE).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.col("n").alias("payload_bytes"), F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"))


def write(rows: DataFrame, path: str, split_bytes: int = SPLIT_BYTES, mode: str = "append") -> None:
    """Write rows as of ``records``: ``append`` adds archives to the folder, ``overwrite`` replaces all it held.

    Null columns give no header, a null payload an empty block; repeated rows give repeated records;
    of an empty table nothing is written but a manifest.
    """
    register(rows.sparkSession)
    rows.write.format(FORMAT).option("split_bytes", split_bytes).mode(mode).save(path)


def read(spark: SparkSession, path: str, payload: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """All records of a folder, with or without the payload, or some ``columns`` of them: own archives by splits, others (``.warc``, ``.warc.gz``) file by file.

    Headers that a record lacks are null, and ``payload_bytes`` is then its block's length; payloads are skipped
    where the columns lack ``payload`` or a filter on headers (equality, in, prefix) fails. An empty folder has no rows.
    """
    register(spark)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    wanted = columns or tuple(c for c in kinds if payload or c != "payload")
    return spark.read.format(FORMAT).schema(", ".join(f"{c} {kinds[c]}" for c in wanted)).load(path)


def page_key(name: Column) -> Column:
    """The key in a record id."""
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1)
