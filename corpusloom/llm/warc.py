"""Web archives (WARC 1.1): one Zstandard frame a record, under a dictionary built from the records themselves.

A file begins with a skippable frame that holds the dictionary, so any record
can be read on its own by its offset: `write_archives` returns that index. Of
equal payloads one is archived, the others are revisit records that refer to
it. Each task writes its own files and starts a new one, with a dictionary
of its own, beyond a size; it holds the records that a dictionary is built from, and else one
at a time. A file is written under a temporary name and moved; only files of
tasks that were committed stand in the index, so a task that runs again does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_uneven, load, materialize, new_path

#: Payloads of fewer bytes are archived each time.
LEAST_BYTES = 1000
#: Bytes of a file before the next is begun, of records that a dictionary is built from, and of a dictionary at most.
FILE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 29, 1 << 21, 1 << 16
LEVEL = 3
#: The magic number of the skippable frame, and the profile of revisits of equal payloads.
DICTIONARY_FRAME = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"
#: Bytes of records that a task holds before it puts them out.
HELD = 1 << 23


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def record_id(page: str | None, payload_key: str) -> str:
    """The same page and payload have the same id in any archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}\n{payload_key}')}>"


def _field(value: str) -> str:
    """A header's value: what could break the line is percent-encoded, as it stands in an address anyway."""
    return quote(value, safe="%!#$&'()*+,/:;=?@[]~") if any(not 0x21 <= ord(c) <= 0x7E for c in value) else value


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return CRLF.join([*(x.encode() for x in head), b"", block, b"", b""])


def page_record(page: str | None, url: str | None, payload: bytes, key: str, refers_to: str | None, date: str = DATE) -> tuple[str, bytes]:
    """(record id, record): a response with its payload, or a revisit of the page whose payload is the same."""
    name, digest = record_id(page, key), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page is not None:
        fields.append(("Page-ID", quote(page, safe="")))
    if url is not None:
        fields.append(("WARC-Target-URI", _field(url)))
    if refers_to is None:
        return name, _record("response", fields, http + payload)
    return name, _record("revisit", [*fields, ("WARC-Refers-To", record_id(refers_to, key)), ("WARC-Profile", PROFILE)], http)


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on these records, cut into pieces; None where they are too few to train one."""
    pieces = [r[i : i + 4096] for r in records for i in range(0, len(r), 4096)]
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8) if size >= 256 else None
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Streams one archive to a file: (offset, length) of each record as it goes in."""

    def __init__(self, folder: str, sample: list[bytes]) -> None:
        self.files, base = _open(folder)
        self.files.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.final, self.temp, self.at = f"{base}/{self.name}", f"{base}/.{self.name}", 0
        self.out = self.files.open_output_stream(self.temp, compression=None)  # the name would have it compressed once more
        trained = dictionary(sample)
        if trained:
            trained.precompute_compress(level=LEVEL)
            data = trained.as_bytes()
            self._put(DICTIONARY_FRAME + len(data).to_bytes(4, "little") + data)
            self.zstd = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
        else:
            self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        about = b"software: corpusloom\r\nformat: WARC File Format 1.1\r\n"
        self.add(_record("warcinfo", [("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, record: bytes) -> tuple[int, int]:
        return self.at, self._put(self.zstd.compress(record))

    def close(self) -> None:
        self.out.close()
        self.files.move(self.temp, self.final)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Archives every page under `folder`; the index: (id, record_id, record_type, file, offset, length), a row a record.

    A null html is an empty payload. Of the pages whose equal payloads have
    least_bytes or more, the one of the largest id is a response and the
    others revisit it; rows that share that largest id are all responses, and so are rows with a null id. Repeated rows
    are records of their own under the same record id. A null address has no header; one with
    blanks, line ends or signs beyond ASCII is percent-encoded. An empty table
    gives an empty index and no file. Extra columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    p = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("key", F.sha2("payload", 256))
    same = p.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("n__")).where("n__ > 1 and last is not null")
    joined = join_uneven(p, materialize(same, "equal-payloads"), "key", F.octet_length("payload") >= least_bytes)
    dealt = joined.select(F.col("page").cast("string"), "url", "payload", "key", F.when(F.col("page") < F.col("last"), F.col("last").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, waiting, held, rows = None, [], 0, []

        def flush() -> None:
            nonlocal writer, waiting, held
            if waiting and writer is None:
                writer = ArchiveWriter(folder, [r for _, _, _, r in waiting])
            for page, name, type_, r in waiting:
                rows.append((page, name, type_, writer.name, *writer.add(r)))
            waiting, held = [], 0

        for b in batches:
            pages_, urls, keys, refers = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i in range(b.num_rows):
                name, r = page_record(pages_[i], urls[i], b.column(2)[i].as_py(), keys[i], refers[i])
                waiting.append((pages_[i], name, "response" if refers[i] is None else "revisit", r))
                held += len(r)
                if writer or held >= sample_bytes:
                    flush()
                    if writer.at >= file_bytes:
                        writer.close()
                        writer = None
            if rows:
                yield _batch(rows, INDEX)
                rows.clear()
        flush()
        if writer:
            writer.close()
        if rows:
            yield _batch(rows, INDEX)

    index = materialize(dealt.mapInArrow(write, "page string, record_id string, record_type string, file string, offset long, length long"), "warc-index")
    return index.withColumnRenamed("page", id_col).withColumn(id_col, F.col(id_col).cast(kind))


INDEX = pa.schema([("page", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
FOUND = pa.schema([("page", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _dictionary_of(head: bytes, rest: io.RawIOBase | pa.NativeFile) -> tuple[zstandard.ZstdCompressionDict | None, bytes]:
    """The dictionary that a file begins with, and what was read beyond it."""
    if head[:4] != DICTIONARY_FRAME:
        return None, head
    data = rest.read(int.from_bytes(head[4:8], "little"))
    if data[:4] == zstandard.FRAME_HEADER:  # the dictionary may itself be compressed
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data), b""


def parse_record(stream: io.BufferedIOBase) -> tuple[dict[str, str], bytes] | None:
    """(headers, block) of the record that the stream stands at; None at its end."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    headers = {}
    while (line := stream.readline().strip()) != b"":
        name, _, value = line.decode().partition(":")
        headers[name.strip().lower()] = value.strip()
    block = stream.read(int(headers["content-length"]))
    if len(block) != int(headers["content-length"]) or stream.read(4) != CRLF + CRLF:
        raise ValueError("a WARC record is cut short")
    return headers, block


def _page(headers: dict[str, str], block: bytes) -> tuple:
    """A row of FOUND; the payload's digest is computed and must be the header's."""
    page, kind = headers.get("page-id"), headers["warc-type"]
    row = (None if page is None else unquote(page), headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers.get("warc-refers-to"))
    if kind == "revisit":
        return (*row, None, None, None)
    payload = block[block.index(CRLF + CRLF) + 4 :]
    digest = hashlib.sha1(payload).digest()
    if headers["warc-payload-digest"] != f"sha1:{base64.b32encode(digest).decode()}":
        raise ValueError(f"the payload of {row[1]} isn't that of its digest")
    return (*row, len(payload), digest.hex(), payload)


def read_archive(folder: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, in order."""
    files, base = _open(folder)
    with files.open_input_stream(f"{base}/{name}", compression=None) as f:
        trained, rest = _dictionary_of(f.read(8), f)
        if rest:
            f.close()
            f = files.open_input_stream(f"{base}/{name}", compression=None)  # noqa: PLW2901 - a file without a dictionary begins with a record
        zstd = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
        stream = io.BufferedReader(zstd.stream_reader(f, read_across_frames=True), 1 << 16)
        while (found := parse_record(stream)) is not None:
            yield found


def read_record(folder: str, name: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by the index: the file's dictionary and the record's own frame are all that is read."""
    files, base = _open(folder)
    with files.open_input_file(f"{base}/{name}") as f:
        trained, _ = _dictionary_of(f.read(8), f)
        zstd = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
        return parse_record(io.BytesIO(zstd.decompressobj().decompress(f.read_at(length, offset))))


def read_archives(spark: SparkSession, folder: str, names: DataFrame, id_type: str = "long", id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """(id, record_id, record_type, url, refers_to, payload_bytes, payload_digest[, payload]) of every page's record.

    names: a column `file`, a row a file. refers_to is a record id; revisits have null payload columns (`resolved` fills them).
    """
    columns = FOUND if with_payload else pa.schema(list(FOUND)[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                for headers, block in read_archive(folder, name):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    rows.append(_page(headers, block)[: len(columns)])
                    held += len(block) if with_payload else 256
                    if held >= HELD:
                        yield _batch(rows, columns)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, columns)

    kinds = "page string, record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = names.select("file").repartitionByRange(n, "file").mapInArrow(read, kinds)
    return found.withColumnRenamed("page", id_col).withColumn(id_col, F.col(id_col).cast(id_type))


def resolved(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records with the payload columns of the response that a revisit refers to, and that page's id as refers_to.

    A revisit whose response isn't among the records keeps nulls there.
    """
    value = [c for c in records.columns if c.startswith("payload")]
    asked = records.where("record_type = 'revisit'").groupBy(F.col("refers_to").alias("record_id")).agg(F.count(F.lit(1)).alias("n__"))
    answers = records.where("record_type = 'response'").groupBy("record_id").agg(F.first(id_col).alias("at__"), *(F.first(c).alias(f"{c}__") for c in value))
    answers = materialize(asked.join(answers, "record_id").withColumnRenamed("record_id", "refers_to"), "responses")
    j = join_uneven(records, answers, "refers_to", F.col("refers_to").isNotNull())
    filled: dict[str, Column] = {c: F.coalesce(c, f"{c}__") for c in value} | {"refers_to": F.col("at__")}
    return j.withColumns(filled).select(*records.columns)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = load(spark, sf_dir, "pages"), new_path(spark, "warc")
    index = write_archives(pages, folder)
    records = materialize(read_archives(spark, folder, index.select("file").distinct(), pages.schema["page_id"].dataType.simpleString()), "warc-records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY payload) END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM g"""
