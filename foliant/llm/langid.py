"""Language identification with a bit-sliced Bloom filter over character n-grams.

Every slot of the filter holds a bitmask of languages. The masks at the k
slots of an n-gram, and-ed, are all the languages that contain it, with the
filter's false positives. A text's per-language popcounts, less the false
positives expected from the share of slots that have a language's bit, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import materialize
from foliant.llm.textops import chunks

SIZES = (3, 4)
#: Slots of the filter, fixed whatever the corpus, and multipliers that choose two of them for an n-gram.
SLOT_BITS = 21
_CHOOSE = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
#: An n-gram belongs to a language in which its share is at least this (so that a language has 500,000 at most), and at least SHARE_OF_MOST of its largest share in any.
LEAST_SHARE = 2e-6
SHARE_OF_MOST = 0.15
#: Distinct n-grams of all languages that a task holds before it hands its counts on.
HELD = 2_000_000
#: Below this share of known n-grams a text is in none of the languages (pipeline stage).
LEAST_SCORE = 0.25

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _letters_only(data: np.ndarray) -> np.ndarray:
    """Bytes folded to lower case; whatever is no letter, of ASCII and of the symbols and punctuation beyond it, is a gap (32).

    Beyond ASCII these are U+0080 to U+00BF less the three letters there, the
    signs of multiplication and division, U+2000 to U+2BFF, U+3000 to U+303F
    and U+1F000 to U+1FFFF.
    """
    row = _FOLD[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[(data[lead] == 0xC2) | (data[lead] == 0xC3) | (data[lead] == 0xE2) | (data[lead] == 0xE3) | (data[lead] == 0xF0)]
    after = data[np.minimum(lead + 1, len(data) - 1)]
    first = data[lead]
    latin = (first == 0xC2) & ~np.isin(after, (0xAA, 0xB5, 0xBA)) | (first == 0xC3) & np.isin(after, (0x97, 0xB7))
    symbol = (first == 0xE2) & (after < 0xB0) | (first == 0xE3) & (after == 0x80)
    picture = (first == 0xF0) & (after == 0x9F)
    for gone, width in ((latin, 2), (symbol, 3), (picture, 4)):
        for k in range(width):
            row[np.minimum(lead[gone] + k, len(row) - 1)] = 32
    return row


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    low = data | 32
    total = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):  # texts without an ASCII letter
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode())
    return found


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows, and for each row (n + 1) the number of its first.

    Letters are folded to lower case, all other characters are a gap; an n-gram
    has gaps at its ends only and at least one letter. Its bytes and length
    are its identity.
    """
    n = len(offsets) - 1
    row = np.insert(_letters_only(data), offsets, 32)  # a gap before, between and after the rows
    heads = offsets + np.arange(n + 1)
    upper = np.flatnonzero((row[:-1] == 0xC3) & (row[1:] >= 0x80) & (row[1:] <= 0x9E)) + 1
    row[upper] += 32
    gap = row == 32
    codes = row.astype(np.int64)
    ids, at = [], []
    for size in SIZES:
        m = len(row) - size + 1
        if m <= 0:
            continue
        fine = ~(gap[:m] & gap[size - 1 :])
        for k in range(1, size - 1):
            fine &= ~gap[k : k + m]
        if size > 2:
            fine |= gap[:m] & gap[size - 1 :] & ~gap[1 : 1 + m] & ~gap[size - 2 : size - 2 + m]
        where = np.flatnonzero(fine)
        packed = codes[where] + (size << 32)
        for k in range(1, size):
            packed += codes[where + k] << 8 * k
        ids.append(packed)
        at.append(where)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    if len(ids) == 1:
        return ids[0], np.searchsorted(at[0], heads)
    counts = sum(np.diff(np.searchsorted(a, heads)) for a in at)
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.int64)
    filled = starts[:-1].copy()
    for i, a in zip(ids, at):
        own = np.searchsorted(a, heads)
        size = np.diff(own)
        out[np.repeat(filled - own[:-1], size) + np.arange(len(i))] = i
        filled += size
    return out, starts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of one task, summed over its batches until HELD n-grams are held."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(which, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

    def emitted() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, j, data, offsets in chunks(batch.column("text")):
            ids, starts = _grams(data, offsets)
            names = langs[i:j]
            for lang in dict.fromkeys(names):
                own = np.repeat(np.array([x == lang for x in names]), np.diff(starts))
                if own.any():
                    held.setdefault(lang, []).append(np.unique(ids[own], return_counts=True))
        for lang, parts in held.items():
            held[lang] = [summed(parts)]
        if sum(len(parts[0][0]) for parts in held.values()) > HELD:
            yield from emitted()
    yield from emitted()


@dataclass
class Filters:
    langs: list[str]
    masks: np.ndarray  # (slots, words): bit l of the 64-bit words is language l
    false_rate: np.ndarray

    def slots(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (((ids.astype(np.uint64) * x) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for x in _CHOOSE)
        return a, b


def selected(counts: DataFrame) -> DataFrame:
    """(lang, gram) of the n-grams that belong to a language, from (lang, gram, n): 1 / LEAST_SHARE a language at most."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))  # one row a language
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    large = shares.filter(F.col("share") >= LEAST_SHARE)
    return large.join(most, "gram").filter(F.col("share") >= SHARE_OF_MOST * F.col("most")).select("lang", "gram")


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Filters:
    """Filters from all rows of docs with a language and a text.

    Counts are summed by language and n-gram in Spark, and n-grams are chosen
    there; what comes to the driver are the chosen ones, at most 500,000 a
    language whatever the corpus. Rows without a language or text, or without
    letters, teach nothing; no rows at all give a model without languages.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = selected(materialize(counts, "counts")).toPandas()
    langs = sorted(found["lang"].unique())
    width = max(1, -(-len(langs) // 64))
    model = Filters(langs, np.zeros((1 << SLOT_BITS, width), np.uint64), np.zeros(len(langs)))
    for k, name in enumerate(langs):
        for slots in model.slots(found.loc[found["lang"] == name, "gram"].to_numpy()):
            model.masks[slots, k // 64] |= np.uint64(1 << (k % 64))
        fill = np.count_nonzero(model.masks[:, k // 64] & np.uint64(1 << (k % 64))) / (1 << SLOT_BITS)
        model.false_rate[k] = fill * fill
    return model


def _predict(model: Filters, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_langs = len(model.langs)
    narrow = model.masks[:, 0].astype(np.uint8) if n_langs <= 8 else None
    for batch in batches:
        langs, scores = [], []
        for i, j, data, offsets in chunks(batch.column("text")):
            ids, starts = _grams(data, offsets)
            n = np.diff(starts)
            known = np.zeros((n_langs, j - i))
            a, b = model.slots(ids)
            for w in range(model.masks.shape[1] if n_langs else 0):
                table = narrow if narrow is not None else model.masks[:, w]
                hit = table[a] & table[b]
                for k in range(w * 64, min(n_langs, w * 64 + 64)):
                    bits = ((hit >> table.dtype.type(k % 64)) & table.dtype.type(1)).astype(np.int32)
                    total = np.concatenate([[0], np.cumsum(bits)])
                    hits = total[starts[1:]] - total[starts[:-1]]
                    f = model.false_rate[k]
                    known[k] = np.maximum(0, hits - n * f) / (1 - f)
            letters = has_letters(data, offsets)
            best = known.argmax(axis=0) if n_langs else np.zeros(j - i, int)
            share = (known.max(axis=0) if n_langs else np.zeros(j - i)) / np.maximum(n, 1)
            langs += [model.langs[x] if ok and n_langs else "und" for x, ok in zip(best, letters)]
            scores += np.where(letters, np.clip(share, 0, 1), 0.0).tolist()
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])


def predict(docs: DataFrame, model: Filters, keys: list[str], text: str = "text") -> DataFrame:
    """The columns keys of each row of docs with lang_pred and score.

    score is the share of the text's n-grams that the language contains,
    corrected for false positives. A null text and one without a letter of any
    script are 'und' with score 0; ties go to the first language by name. Very
    long texts count whole. Repeated rows are predicted each; columns other
    than keys go, whatever their names; without learned languages all rows are
    'und', and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keys, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lambda it: _predict(shared.value, it), f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document stay out of training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
