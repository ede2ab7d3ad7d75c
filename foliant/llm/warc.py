"""WARC archives of one gzip member a record: written by tasks, read by byte ranges.

The reader takes no index. A task gets a range of bytes, tries every gzip
magic in it, and takes a candidate for a member only if its first bytes decode
to the head of a WARC record. It owns the records that start in its range and
reads on beyond the range for the last of them. A payload may hold an archive
of its own, whose members a range that begins inside that payload can't tell
from true ones; they lie inside the record around them, which an earlier range
owns, and go by comparing ends.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import materialize, possible_ids, shared_dir

VERSION = "WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive file is closed beyond FILE_BYTES, a range has RANGE_BYTES, output batches PART_BYTES of payload.
FILE_BYTES, RANGE_BYTES, PART_BYTES = 1 << 30, 1 << 25, 1 << 23
#: Files are read AHEAD_BYTES at a time and searched in blocks; a candidate's head must end in its first decoded HEAD_BYTES.
AHEAD_BYTES, BLOCK_BYTES, HEAD_BYTES = 1 << 22, 1 << 16, 1 << 16
NO_DATE = "1970-01-01T00:00:00Z"

RECORD = "record_type string, page_id long, refers_to long, target_uri string, warc_date string, payload_bytes long, payload_digest string, intact boolean, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary in base 32 (RFC 4648): five hex digits are four digits of base 32."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(value: object) -> str:
    """A header's value: control characters and blanks, which no URI has, as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def _record_id(page: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>"


def member(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str | None) -> bytes:
    """One record as a gzip member; a revisit (refers_to given) has the HTTP head alone."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, digest, kind)}", f"WARC-Date: {_header(date or NO_DATE)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 'response')}", f"X-Refers-To-Page-ID: {refers_to}"]
    block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{block_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([raw.compress("\r\n".join(head).encode() + b"\r\n\r\n"), raw.compress(block), raw.compress(b"\r\n\r\n"), raw.flush()])


def _write(folder: str, file_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives under names of their own: what a failed or repeated attempt left is in no manifest."""
    store, path = fs.FileSystem.from_uri(folder)
    out, name, size, n = None, "", 0, 0

    def closed() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "length", "n_records"])

    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "date")]):
            if out is None:
                name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            raw = member(*[x.as_py() for x in row])
            out.write(raw)
            size, n = size + len(raw), n + 1
            if size >= file_bytes:
                yield closed()
                out = None
    if out is not None:
        yield closed()


def records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, date): of equal payloads of least_bytes bytes or more the least id's is the response.

    Null payloads are empty. Rows that repeat the least id are responses too,
    and so are equal payloads that have no id at all; a row without an id
    beside one with an id revisits it. Only payloads whose digest may stand
    twice (a bitmap of fixed size tells) are shuffled to be told apart; one
    with very many copies is a skewed join, which adaptive execution splits.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), (F.col(date).cast("string") if date else F.lit(NO_DATE)).alias("date"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    large = F.octet_length("payload") >= least_bytes
    firsts = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    firsts = materialize(firsts.select("digest", "first_id"), "firsts")
    marked = possible_ids(rows, "digest", firsts.select("digest"), mark="maybe")
    same = marked.filter("maybe").join(firsts, "digest", "left")
    copy = large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    columns = ["page_id", "url", "payload", "digest", "refers_to", "date"]
    told = same.withColumn("refers_to", F.when(copy, F.col("first_id"))).select(columns)
    return marked.filter("not maybe").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(told)


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The archives of records() in a folder that all executors reach, and their manifest (path, length, n_records).

    A task writes its rows to files of its own and names them when they are
    closed; the manifest has those of the tasks that count, whatever a lost
    executor left. An empty table writes nothing.
    """
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    made = rows.mapInArrow(lambda it: _write(folder, file_bytes, it), "path string, length long, n_records long")
    return materialize(made, "manifest")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the .warc.gz files below a folder; the files' content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length")


class _Reader:
    """Bytes of one file, read ahead."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        self.size, self.base, self.cache = self.file.size(), 0, b""

    def at(self, place: int, n: int) -> bytes:
        n = max(0, min(n, self.size - place))
        if place < self.base or place + n > self.base + len(self.cache):
            self.base, self.cache = place, self.file.read_at(min(max(n, AHEAD_BYTES), self.size - place), place)
        return self.cache[place - self.base : place - self.base + n]

    def candidates(self, start: int, end: int) -> Iterator[int]:
        """Places of the magic in [start, end); after each the search goes on from the place that is sent."""
        place, base, block = start, start, b""
        while place < end:
            if place + len(MAGIC) > base + len(block):
                base, block = place, self.at(place, min(BLOCK_BYTES, end - place) + len(MAGIC) - 1)
                if len(block) < len(MAGIC):
                    return
            found = block.find(MAGIC, place - base)
            if found < 0:
                place = base + len(block) - len(MAGIC) + 1
            else:
                place = yield base + found


def _head(raw: bytes) -> dict[str, str] | None:
    """The headers of a record from its first bytes, null if these aren't one."""
    if not raw.startswith(b"WARC/1."):
        return None
    lines = raw.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    found = {name.strip().lower(): value.strip() for name, sep, value in pairs if sep}
    return found if found.get("warc-type") and found.get("content-length", "").isdigit() else None


def decode(reader: _Reader, place: int) -> tuple[int, dict[str, str], bytes, bool] | None:
    """(end, headers, block, whole) of the record whose member starts at a place; None if no record starts there.

    The head is decoded and judged first; only then is the rest. whole is
    false if the member breaks off, fails its checksum or has another length
    than its head says.
    """
    inflate, raw, at, head, split = zlib.decompressobj(31), bytearray(), place, None, -1
    whole, step = True, 1 << 12
    while not inflate.eof:
        block = inflate.unconsumed_tail
        if not block:
            block = reader.at(at, step)
            at, step = at + len(block), min(2 * step, AHEAD_BYTES)
        try:
            made = inflate.decompress(block, 64 if head is None else 0)  # a little of the head, before a broken end is met
        except zlib.error:
            made, block = b"", b""
        if not block:
            whole = False
            break
        raw += made
        if head is None:
            if bytes(raw[:7]) != b"WARC/1."[: len(raw)]:
                return None
            split = raw.find(b"\r\n\r\n")
            if split >= 0:
                head = _head(bytes(raw[:split]))
            if head is None and (split >= 0 or len(raw) > HEAD_BYTES):
                return None
    if head is None:
        return None
    n = int(head["content-length"])
    body = bytes(raw[split + 4 : split + 4 + n])
    whole = whole and len(body) == n and raw[split + 4 + n :] == b"\r\n\r\n"
    return (at - len(inflate.unused_data) if inflate.eof else place + 1), head, body, whole


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and x.lstrip("-").isdigit() else None


def described(head: dict[str, str], block: bytes, whole: bool) -> tuple:
    """The columns of RECORD: payload figures of a response from its bytes, of a revisit from its heads."""
    http, sep, payload = block.partition(b"\r\n\r\n") if "application/http" in head.get("content-type", "") else (b"", b"", block)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    said = head.get("warc-payload-digest", "").partition(":")[2]
    n = len(payload)
    if head["warc-type"] == "revisit":
        lengths = [line.partition(b":")[2].strip().decode() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        n, digest = _number(lengths[0]) if lengths else None, said or None
    intact = whole and (not said or said == digest)
    page, refers = _number(head.get("x-page-id")), _number(head.get("x-refers-to-page-id"))
    return head["warc-type"], page, refers, head.get("warc-target-uri"), head.get("warc-date"), n, digest, intact, payload


def _scan(columns: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}
    place_of = [names.index(c) for c in columns]

    def part(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * (4 + len(columns))
        types = [pa.string(), *[pa.int64()] * 3, *[kinds.get(c, pa.string()) for c in columns]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "range_start", "start", "end", *columns])

    for batch in batches:
        for path, first, end in zip(*[batch.column(c).to_pylist() for c in ("path", "range_start", "range_end")]):
            reader, rows, size = _Reader(path), [], 0
            places = reader.candidates(first, end)
            place = next(places, None)
            while place is not None:
                found = decode(reader, place)
                if found:
                    stop, head, block, whole = found
                    values = described(head, block, whole)
                    rows.append((path, first, place, stop, *[values[k] for k in place_of]))
                    size += len(block)
                    if size > PART_BYTES:
                        yield part(rows)
                        rows, size = [], 0
                try:
                    place = places.send(found[0] if found else place + 1)
                except StopIteration:
                    place = None
            if rows:
                yield part(rows)


def read(files: DataFrame, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end, columns...) of the records in files (path, length); columns are names of RECORD, payload not by default.

    A damaged member (broken off, wrong checksum or length) whose head can be
    decoded is a row that isn't intact; bytes that are no member are passed
    over. Every record is read by the task in whose range it starts, however
    far it reaches. Records nest in none. No files, or empty ones, give an
    empty table; a file that is named twice is read twice.
    """
    columns = columns or [c.split()[0] for c in RECORD.split(", ") if not c.startswith("payload ")]
    types = dict(c.split() for c in RECORD.split(", "))
    spark = files.sparkSession
    listed = files.select("path", "length").filter("length > 0")
    starts = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("range_start"))
    ranges = starts.withColumn("range_end", F.least(F.col("range_start") + range_bytes, F.col("length"))).drop("length")
    # so many partitions, or adaptive execution would put all these short rows into one task
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "range_start")
    schema = ", ".join(["path string, range_start long, start long, end long", *[f"{c} {types[c]}" for c in columns]])
    found = materialize(ranges.mapInArrow(lambda it: _scan(columns, it), schema), "records")
    # what a range has found before the last end of earlier ranges of its file lies inside a payload
    last = found.groupBy("path", "range_start").agg(F.max("end").alias("last_end"))
    overlap = last.select("path", (F.floor((F.col("last_end") - 1) / range_bytes) * range_bytes).alias("into"), "range_start", "last_end").filter("into > range_start")
    reached = overlap.select("path", F.explode(F.sequence(F.col("range_start") + range_bytes, F.col("into"), F.lit(range_bytes).cast("long"))).alias("range_start"), "last_end")
    bound = reached.groupBy("path", "range_start").agg(F.max("last_end").alias("from_here"))
    return found.join(bound, ["path", "range_start"], "left").filter("from_here is null or start >= from_here").select("path", "start", "end", *columns)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives, among the application's own in the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of archives. What read() has given doesn't need them any more: it is written apart."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
