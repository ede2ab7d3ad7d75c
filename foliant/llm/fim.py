"""Fill-in-middle order of texts: each Arrow batch is one DuckDB query inside mapInArrow.

A text is cut into units (a word with the white space before it, or white
space at the end). Two cuts that depend on the id alone give prefix, middle
and suffix; a third draw decides whether the text is rearranged, a fourth in
which of the two orders. DuckDB works on the columns of a batch as a whole:
no value becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Shares in a hundred: of texts that are rearranged, and of these in the order suffix, prefix, middle.
SHARE, SPM_SHARE = 50, 80
#: A part of a batch holds so many bytes of text at most, or one longer text.
PART_BYTES = 1 << 23

TYPES = {
    "n": ("long", pa.int64()),
    "form": ("string", pa.string()),
    "prefix_chars": ("long", pa.int64()),
    "middle_chars": ("long", pa.int64()),
    "output": ("string", pa.string()),
    "output_sha256": ("string", pa.string()),
    "restored": ("string", pa.string()),
    "restored_sha256": ("string", pa.string()),
}


def _draw(k: int) -> str:
    return f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS UBIGINT)"


def statement(columns: list[str], seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> str:
    """The SQL over a batch (place, id, text); restored takes the output apart at its marks, nothing else of the text."""
    marks = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    cut = lambda part, mark, k: f"split_part({part}, '{mark}', {k})"
    after = f"substr(output, {len(PREFIX) + 1})"
    psm = [cut(after, SUFFIX, 1), cut(after, MIDDLE, 2), cut(cut(after, SUFFIX, 2), MIDDLE, 1)]
    spm = [cut(cut(after, PREFIX, 2), MIDDLE, 1), cut(after, MIDDLE, 2), cut(after, PREFIX, 1)]
    wanted = {c: c for c in TYPES} | {
        "prefix_chars": "CASE WHEN form <> 'plain' THEN length(prefix) END",
        "middle_chars": "CASE WHEN form <> 'plain' THEN length(middle) END",
        "output_sha256": "sha256(output)",
        "restored_sha256": "sha256(restored)",
    }
    return f"""WITH a AS (SELECT place, text, sha256('{seed}:' || id) AS h, regexp_extract_all(text, '{UNIT}') AS units FROM batch),
b AS (SELECT *, len(units) AS n, {_draw(1)} % (len(units) + 1) AS x, {_draw(2)} % (len(units) + 1) AS y,
  CASE WHEN text = '' OR {marks} OR {_draw(3)} % 100 >= {share} THEN 'plain' WHEN {_draw(4)} % 100 < {spm_share} THEN 'spm' ELSE 'psm' END AS form FROM a),
c AS (SELECT place, n, form, text, array_to_string(list_slice(units, 1, least(x, y)), '') AS prefix,
  array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') AS middle, array_to_string(list_slice(units, greatest(x, y) + 1, n), '') AS suffix FROM b),
d AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
  ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM c),
e AS (SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {" || ".join(psm)} ELSE {" || ".join(spm)} END AS restored FROM d)
SELECT {", ".join(f"{wanted[c]} AS {c}" for c in columns)} FROM e ORDER BY place"""


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    text = batch.column("text")
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())).to_numpy()
    i = 0
    while i < len(batch):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(ends.searchsorted(before + PART_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def _transform(sql: str, columns: list[str], keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = duckdb.connect(config={"threads": 1})
    for whole in batches:
        for part in _parts(whole):
            rows = {"place": pa.array(range(len(part)), pa.int64()), "id": part.column("draw"), "text": pc.fill_null(part.column("text"), "")}
            con.register("batch", pa.table(rows))
            found = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("batch")
            made = [found.column(c).cast(TYPES[c][1]).combine_chunks() for c in columns]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], *made], [*keys, *columns])


def transform(
    docs: DataFrame, keys: list[str], id: str = "doc_id", text: str = "text", columns: list[str] | None = None, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE
) -> DataFrame:
    """The columns keys of each row, then columns: by default n, form, output, prefix_chars and middle_chars.

    The draws are taken from the SHA-256 of seed:id, so that a text is cut
    alike wherever it is and in every run. A null text is empty, a null id
    draws as an empty one; empty texts and those that hold a mark are plain.
    Texts are taken whole, whatever their length; memory is some ten times the
    longest one. Rows that stand twice come out twice, alike; an empty table
    gives an empty one. Other columns go; a key named like one of columns is
    refused.
    """
    columns = columns or ["n", "form", "output", "prefix_chars", "middle_chars"]
    clash = set(keys) & set(columns)
    if clash:
        raise ValueError(f"keys are named like results: {sorted(clash)}")
    # the work columns come last under names of their own places, so that no key can be mistaken for them
    names = [f"key{i}" for i in range(len(keys))]
    rows = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.coalesce(F.col(id).cast("string"), F.lit("")).alias("draw"), F.col(text).alias("text"))
    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], *[f"{c} {TYPES[c][0]}" for c in columns]])
    sql = statement(columns, seed, share, spm_share)
    made = rows.mapInArrow(lambda it: _transform(sql, columns, names, it), schema)
    return made.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *columns)


def restored(made: DataFrame, form: str = "form", output: str = "output") -> DataFrame:
    """made with text, rebuilt from output and form alone; another column text is replaced."""
    pattern = {"psm": f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$", "spm": f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$"}
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    part = lambda f, g: F.regexp_extract(output, pattern[f], g)
    rebuilt = {f: F.concat(*[part(f, g) for g in order[f]]) for f in pattern}
    return made.withColumn("text", F.when(F.col(form) == "psm", rebuilt["psm"]).when(F.col(form) == "spm", rebuilt["spm"]).otherwise(F.col(output)))
