"""Fill-in-middle, archives by byte ranges and resampling against plain versions."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import fim, resample, warc

ODD = [None, "", " ", "\n\t ", "one", " one", "one ", "é🙂 ü\x00x y  \x0b z\n", "a <P> b c d", "a < P> b <S", "<S", "x<M>y", "<", "<S <P <M " * 40, "w " * 3000]
CLASH = ["place", "draw", "units", "h", "form", "output", "n", "digest", "copies", "at", "range_no", "before", "score", "rank", "payload", "first_id", "maybe", "_bucket", "_bits", "refers_to"]


def texts(n=300, seed=5):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma7", "über", "数据", "x", "the", "of", "<P", "🙂"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ".", "-"]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return ODD + made


def frame(spark, name="doc_id", column="text"):
    rows = [(k, t) for k, t in enumerate(texts())] + [(7, ODD[7]), (None, "no id here at all"), (None, None)]
    df = spark.createDataFrame(rows, f"{name} long, {column} string").repartition(5)
    return df.select("*", *[F.lit("old").alias(c) for c in CLASH if c not in (name, column)]), rows


def middle(key, text):
    text = text or ""
    units = re.findall(fim.UNIT, text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    df, rows = frame(spark)
    got = fim.transform(df, ["doc_id", "text"], columns=["n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256", "restored_sha256"]).collect()
    want = Counter((k, t, *middle(k, t)) for k, t in rows)
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert all(r.restored == (r.text or "") and r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.text or "") for r in got)
    back = fim.restored(fim.transform(df, ["doc_id"])).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((k, t or "") for k, t in rows)
    assert fim.transform(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        fim.transform(df, ["doc_id", "form"])


def test_fill_in_middle_of_a_long_text_in_small_parts(spark, monkeypatch):
    long = "ab é\n" * 400_000
    got = fim.transform(spark.createDataFrame([(k, long) for k in range(6)], "doc_id long, text string"), ["doc_id"]).collect()
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in sorted(got, key=lambda r: r.doc_id)] == [middle(k, long) for k in range(6)]


def drawn(docs, aims, n, buckets, share, least):
    fold = str.maketrans(resample.UPPER, resample.UPPER.lower())

    def grams(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
        return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)

    slot = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(slot, grams(text)[0]))
    for text in aims:
        t.update(map(slot, grams(text)[0]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        own, n_words = grams(text)
        weight = sum(gain[slot(g)] for g in own)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    limit = share * len(able) // 100
    return Counter([(*r, k + 1) for k, r in enumerate(able[:limit])] + [(*r, None) for r in able[limit:]] + [(*r, None) for r in rows if r[1] < least])


@pytest.mark.parametrize("n, chunk_chars", [(1, 1 << 15), (1, 40), (3, 25), (2, 1)])
def test_resample(spark, n, chunk_chars):
    df, rows = frame(spark)
    aims = ["alpha gamma7 the the of", None, "", "ÜBER über Beta", "x" * 500]
    target = spark.createDataFrame([(t, 1) for t in aims], "body string, digest int")
    got = resample.resample(df, target, target_text="body", n=n, buckets=97, drawn=30, least_words=5, chunk_chars=chunk_chars)
    assert Counter(map(tuple, got.collect())) == drawn(rows, aims, n, 97, 30, 5)


def test_resample_of_nothing_and_towards_nothing(spark):
    df, rows = frame(spark)
    assert resample.resample(df.limit(0), df).count() == 0
    got = resample.resample(df, df.limit(0), buckets=50, drawn=100, least_words=0)
    assert Counter(map(tuple, got.collect())) == drawn(rows, [], 1, 50, 100, 0)


def test_chunks_own_each_start_once(spark):
    long = " ".join(f"w{k}" for k in range(5000)) + "." * 3000 + " end " + "y" * 2000
    df = spark.createDataFrame([(1, long), (2, "." * 900), (3, "z" * 900)], "doc_id long, text string")
    for n in (1, 4):
        parts = resample.chunks(df, n, chunk_chars=100).collect()
        words = re.findall("[0-9a-z]+", long)
        own = [w for p in sorted(parts, key=lambda p: p.chunk_no) if p.id == 1 for w in re.findall("[0-9a-z]+", p.owned)]
        assert own == words
        place = 0
        for p in sorted((p for p in parts if p.id == 1), key=lambda p: p.chunk_no):
            place += len(re.findall("[0-9a-z]+", p.owned))
            assert p.carried.split() == words[place : place + n - 1]
        assert max(len(p.owned) for p in parts if p.id == 1) <= 100 + 2000


def pages(spark):
    rng = random.Random(9)
    body = lambda: "".join(rng.choice(["<p>", "text ", "é🙂", "\r\n\r\n", "WARC/1.1\r\n", "\x1f\x08"]) for _ in range(rng.randrange(1, 200)))
    same = [body() for _ in range(6)]
    rows = [(k, f"http://h.example/{k}?q=a b\r\nX: y", rng.choice(same) if k % 3 else body()) for k in range(5, 400)]
    rows += [(1, None, ""), (2, "http://e.example/", None), (3, "", same[0]), (3, "", same[0]), (None, "u", same[0]), (None, "u", "alone " * 50), (None, "v", "alone " * 50), (9000, "long", "long page " * 60_000)]
    return rows


def recorded(rows, least=0):
    first = {}
    for k, _, t in rows:
        if k is not None and len((t or "").encode()) >= least:
            first[t or ""] = min(first.get(t or "", k), k)
    out = Counter()
    for k, _, t in rows:
        raw = (t or "").encode()
        head = first.get(t or "")
        copy = head is not None and head != k
        out[(k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if copy else "response", head if copy else None)] += 1
    return out


@pytest.mark.parametrize("least, file_bytes, range_bytes", [(0, 1 << 30, 1 << 25), (300, 3000, 700), (0, 1 << 30, 57)])
def test_archives(spark, tmp_path, least, file_bytes, range_bytes):
    rows = pages(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    df = df.select("*", *[F.lit("old").alias(c) for c in CLASH])
    made = warc.write(warc.records(df, least_bytes=least), f"{tmp_path}/a", file_bytes)
    found = warc.read(made, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "payload", "target_uri"], range_bytes).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == recorded(rows, least)
    assert all(r.intact for r in found)
    whole = Counter((k, (t or "").encode()) for k, _, t in rows)
    assert all(bytes(r.payload) in {b for k, b in whole if k == r.page_id} for r in found if r.record_type == "response")
    assert {r.target_uri for r in found if r.page_id == 7} == {"http://h.example/7?q=a%20b%0D%0AX:%20y"}
    # the files are plain concatenations of members, and a listing of the folder reads alike
    members = 0
    for path in (r.path for r in made.collect()):
        raw = open(path.removeprefix("file:"), "rb").read()
        members += gzip.decompress(raw).count(b"WARC-Record-ID")
    assert members == len(rows)
    again = warc.read(warc.archives(spark, f"{tmp_path}/a"), ["page_id", "payload_digest"], range_bytes)
    assert again.count() == len(rows)


def test_archives_are_removed(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"page {k}") for k in range(20)], "page_id long, url string, html string")
    made = warc.write(warc.records(df), f"{tmp_path}/gone")
    found = warc.read(made, ["page_id"])
    warc.remove(spark, f"{tmp_path}/gone")
    assert found.count() == 20 and not (tmp_path / "gone").exists()


def test_archives_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    made = warc.write(warc.records(df), f"{tmp_path}/none")
    assert made.count() == 0 and warc.read(made).count() == 0
    assert warc.archives(spark, f"{tmp_path}/none").count() == 0


def test_archives_inside_payloads_and_damage(spark, tmp_path):
    """Members inside a stored payload aren't records, wherever ranges begin; broken members are told, what follows stays."""
    inner = b"".join(warc.member(k, "http://in.example/", b"inner %d" % k, "D", None, None) for k in range(100, 130))
    outer = warc.member(1, "http://out.example/", inner, base64.b32encode(hashlib.sha1(inner).digest()).decode(), None, None)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = stored.compress(gzip.decompress(outer)) + stored.flush()
    assert outer.count(warc.MAGIC) >= 31
    plain = lambda k: warc.member(k, "http://x.example/", b"page %d" % k * 40, base64.b32encode(hashlib.sha1(b"page %d" % k * 40).digest()).decode(), None, None)
    bad = bytearray(plain(5))
    bad[-6] ^= 255
    junk = warc.MAGIC + b"no member" * 5
    raw = plain(2) + outer + plain(3) + junk + bytes(bad) + plain(4) + gzip.compress(b"not an archive " * 50) + plain(6) + plain(7)[:-30]
    path = tmp_path / "mixed.warc.gz"
    path.write_bytes(raw)
    files = spark.createDataFrame([(str(path), len(raw))], "path string, length long")
    for size in (1 << 25, 4000, 333, 64):
        found = sorted(warc.read(files, ["page_id", "intact", "payload_bytes"], size).collect(), key=lambda r: r.start)
        assert [(r.page_id, r.intact) for r in found] == [(2, True), (1, True), (3, True), (5, False), (4, True), (6, True), (7, False)], size
        assert found[1].payload_bytes == len(inner) and found[0].end == found[1].start and found[1].end == found[2].start
