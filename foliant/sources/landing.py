"""What was fetched, as a data source: spark.read.format("captures") over a landing folder, one partition a source and day.

The folder holds {source}/{yyyy-mm-dd}/ with the files as they came, beside
each {file}.json what is known of its fetch (url, http_status, content_type),
and run.json where the listing itself failed or the source wasn't collected.
Failures are rows with a status, never exceptions.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

CAPTURE = "source string, day date, name string, url string, status string, http_status int, content_type string, charset string, n_bytes long, sha256 string, body string, error string"
#: A larger body is OVERSIZED and not read into a row.
CEILING = 4_000_000
#: Bytes of a page in which a charset may be declared.
HEAD_BYTES = 2048
#: HTTP statuses that mean no access (fixed values).
NO_ACCESS = (401, 403)
_META = re.compile(rb"charset=[\"']?\s*([^\"'\s;>]+)", re.I)
_HEADER = re.compile(r"charset=[\"']?\s*([^\"'\s;]+)", re.I)


def decoded(content: bytes, content_type: str | None) -> tuple[str, str]:
    """(text, charset) of a page: by its header, else by what it declares at its start, else UTF-8; malformed bytes are replaced.

    A charset that nobody knows is passed over.
    """
    told = _HEADER.search(content_type or "")
    meta = _META.search(content[:HEAD_BYTES])
    names = [told[1]] if told else [meta[1].decode("ascii", "ignore")] if meta else []
    for name in [*names, "utf-8"]:
        try:
            return content.decode(name, "replace"), name.lower()
        except (LookupError, UnicodeError):  # an unknown one, or one of Python's that isn't a charset
            continue
    return content.decode("utf-8", "replace"), "utf-8"


def _decode(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(None, None) if c is None else decoded(c, t) for c, t in zip(batch.column("content_").to_pylist(), batch.column("type_").to_pylist())]
        made = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *made], [*keys, "text_", "charset_"])


def with_text(captures: DataFrame, content: str = "content", content_type: str | None = None, into: tuple[str, str] = ("text", "charset")) -> DataFrame:
    """captures with the decoded text of their bytes and its charset in the columns into, which replace others of those names; null bytes have none."""
    kept = [c for c in captures.columns if c not in into]
    names = [f"c{k}" for k in range(len(kept))]
    kind = F.col(content_type) if content_type else F.lit(None).cast("string")
    rows = captures.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(content).alias("content_"), kind.alias("type_"))
    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], "text_ string, charset_ string"])
    made = rows.mapInArrow(lambda it: _decode(names, it), schema)
    return made.withColumnsRenamed(dict(zip(names, kept)) | {"text_": into[0], "charset_": into[1]})


@dataclass
class Day(InputPartition):
    source: str
    day: str
    path: str


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.ceiling = options["path"], int(options.get("ceiling", CEILING))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Tests of the source choose the folders; all others are left to Spark."""
        for test in filters:
            if isinstance(test, EqualTo) and test.attribute == ("source",):
                self._keep({test.value})
            elif isinstance(test, In) and test.attribute == ("source",):
                self._keep(set(test.value))
            else:
                yield test

    def _keep(self, sources: set) -> None:
        self.wanted = sources if self.wanted is None else self.wanted & sources

    def partitions(self) -> list[Day]:
        store, root = fs.FileSystem.from_uri(self.path)
        out = []
        for folder in store.get_file_info(fs.FileSelector(root)):
            if folder.type == fs.FileType.Directory and (self.wanted is None or folder.base_name in self.wanted):
                days = store.get_file_info(fs.FileSelector(folder.path))
                out += [Day(folder.base_name, d.base_name, d.path) for d in days if d.type == fs.FileType.Directory and re.fullmatch(r"\d{4}-\d{2}-\d{2}", d.base_name)]
        return sorted(out, key=lambda d: (d.source, d.day))

    def read(self, partition: Day | None) -> Iterator[tuple]:
        if partition is None:  # no folder at all
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        day = datetime.date.fromisoformat(partition.day)
        files = {f.base_name: f for f in store.get_file_info(fs.FileSelector(partition.path)) if f.type == fs.FileType.File}

        def note(name: str) -> tuple[dict, str | None]:
            if name not in files:
                return {}, None
            try:
                with store.open_input_file(files[name].path) as f:
                    found = json.loads(f.read())
                return (found, None) if isinstance(found, dict) else ({}, f"{name} holds no object")
            except (ValueError, OSError) as error:
                return {}, f"{name}: {error}"[:200]

        run, broken = note("run.json")
        if run or broken:
            yield (partition.source, day, None, None, run.get("status", "LISTING_FAILURE"), None, None, None, None, None, None, (run.get("error") or broken))
        bodies = {n for n in files if not n.endswith(".json")}
        for name in sorted(bodies | {n.removesuffix(".json") for n in files if n.endswith(".json") and n != "run.json"}):
            about, broken = note(f"{name}.json")
            http, kind = about.get("http_status"), about.get("content_type")
            head = (partition.source, day, name, about.get("url"))
            if http in NO_ACCESS:
                yield (*head, "AUTH_FAILURE", http, kind, None, None, None, None, f"HTTP {http}")
            elif name not in bodies or (http is not None and not 200 <= http < 300):
                yield (*head, "FETCH_FAILURE", http, kind, None, None, None, None, about.get("error") or broken or f"HTTP {http}")
            elif files[name].size > self.ceiling:
                yield (*head, "OVERSIZED", http, kind, None, files[name].size, None, None, f"{files[name].size} bytes")
            else:
                with store.open_input_file(files[name].path) as f:
                    content = f.read()
                text, charset = decoded(content, kind)
                yield (*head, "OK", http, kind, charset, len(content), hashlib.sha256(content).hexdigest(), text, broken)


class Captures(DataSource):
    """Options: path (any folder that pyarrow.fs opens) and ceiling, in bytes."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CAPTURE

    def reader(self, schema: object) -> CaptureReader:
        return CaptureReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("captures") known to the session, tests of the source pushed down to the folders."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captures)
