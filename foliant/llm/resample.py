"""Importance resampling towards a target distribution, by hashed word n-grams.

Texts are cut into chunks at word boundaries. Each chunk owns the n-grams that
start in it and carries the n - 1 words that follow, so that a very long text
is many rows for many tasks; counts and weights of chunks are summed by
document. The draw is one sort by score (weight plus Gumbel noise that depends
on the id alone), in ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import materialize

#: Characters of lower-case words (all but the ASCII ones of GAP, as ranges that Java tests fastest), and those between words.
WORD, GAP = r"[0-9a-z\x80-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Code points of a chunk, before the rest of its last word.
CHUNK_CHARS = 1 << 15
BUCKETS, SEED = 10_000, 2024
#: Of a hundred documents with LEAST_WORDS words, so many are drawn.
DRAWN, LEAST_WORDS = 10, 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def chunks(docs: DataFrame, n: int = 1, id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id, digest, chunk_no, owned, carried): the chunks of all texts, lower-case in A-Z, each run between words one space.

    owned ends with a whole word and carried holds the next n - 1 words. A
    text without words, or a null one, is one empty chunk. Chunks of texts
    that have several are dealt to all tasks.
    """
    plain = F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), f"{GAP}+", " ")
    pattern = F.lit(f"(?s).{{1,{chunk_chars}}}+{WORD}*+(?=((?: ?{WORD}++){{0,{n - 1}}}))")
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("digest"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"), plain.alias("plain"))
    short = F.col("n_chars") <= chunk_chars
    one = rows.filter(short).select("id", "digest", F.lit(0).alias("chunk_no"), F.col("plain").alias("owned"), F.lit("").alias("carried"))
    parts = F.arrays_zip(F.regexp_extract_all("plain", pattern, F.lit(0)).alias("owned"), F.regexp_extract_all("plain", pattern, F.lit(1)).alias("carried"))
    many = rows.filter(~short).select("id", "digest", F.posexplode(parts).alias("chunk_no", "part")).select("id", "digest", "chunk_no", "part.owned", "part.carried")
    return one.unionByName(many.repartition("id", "digest", "chunk_no"))


def features(n: int) -> tuple[Column, Column]:
    """The n-grams (of 1 to n words) that start in a chunk, and the number of its words."""
    own = F.regexp_extract_all("owned", F.lit(f"{WORD}++"), F.lit(0))
    if n == 1:
        return own, F.size(own)
    words = F.concat(own, F.regexp_extract_all("carried", F.lit(f"{WORD}++"), F.lit(0)))

    def runs(k: int) -> Column:
        starts = F.least(F.size(own), F.size(words) - (k - 1))
        made = F.transform(F.sequence(F.lit(1), starts), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(starts >= 1, made).otherwise(F.array().cast("array<string>"))  # sequence(1, 0) would count down

    return F.concat(own, *[runs(k) for k in range(2, n + 1)]), F.size(own)


def _slot(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(parts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all chunks fall into each bucket; empty buckets have no row."""
    grams, _ = features(n)
    return parts.select(F.explode(grams).alias("gram")).groupBy(_slot(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, floor(1000 ln of the smoothed ratio of shares); buckets numbers, whatever the input's size."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    x = lambda c: F.col(c).cast("double")
    ratio = (x("t") + 1) * (x("all_s") + buckets) / ((x("s") + 1) * (x("all_t") + buckets))
    rows = both.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weights(parts: DataFrame, gain: list[int], n: int = 1) -> DataFrame:
    """(id, copies, n_words, n_features, weight): the sums over the chunks of a document; equal rows are one row with copies."""
    grams, n_words = features(n)
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # folded into one constant
    found = parts.select("id", "digest", "chunk_no", n_words.cast("long").alias("n_words"), grams.alias("grams"))
    weight = F.aggregate("grams", F.lit(0).cast("long"), lambda acc, g: acc + F.get(table, _slot(g, len(gain))))
    found = found.select("id", "digest", (F.col("chunk_no") == 0).cast("long").alias("first"), "n_words", F.size("grams").cast("long").alias("n_features"), weight.alias("weight"))
    sums = found.groupBy("id", "digest").agg(F.sum("first").alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    return sums.select("id", "copies", *[F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")])


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by the first 32 bits of the SHA-256 of seed:id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
    n: int = 1, buckets: int = BUCKETS, drawn: int = DRAWN, least_words: int = LEAST_WORDS, seed: int = SEED, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs, under docs' own name of the id.

    Of the rows with least_words words, drawn in a hundred are ranked by
    score, ties by id (nulls first); the others have a null rank. Null and
    empty texts have no features and weight 0. Texts are whole, whatever their
    length. Rows that stand twice have two ranks side by side. An empty docs
    gives an empty result, an empty target one by noise and rarity. Other
    columns go, whatever their names.
    """
    own = chunks(docs, n, id, text, chunk_chars)
    aim = chunks(target.select(F.col(target_text).alias("text"), F.lit(None).cast("long").alias("id")), n, "id", "text", chunk_chars)
    gain = gains(bucket_counts(own, n, buckets), bucket_counts(aim, n, buckets), buckets)
    rows = weights(own, gain, n)
    rows = rows.select("id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "n_words", "n_features", "weight")
    rows = rows.withColumns({"score": F.col("weight") + noise(F.col("id"), seed), "short": F.col("n_words") < least_words})
    order = [F.col("short"), F.col("score").desc(), F.col("id"), F.col("copy")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # the upper bits of at number the range, the lower 33 the row inside it; written once, since another run would cut other ranges
    placed = materialize(placed, "draw").withColumns({"range_no": F.shiftright("at", 33), "within": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    ranges = placed.groupBy("range_no").agg(F.count("*").alias("rows"), F.count_if(~F.col("short")).alias("eligible")).orderBy("range_no").collect()  # one row a partition
    before, starts = 0, []
    for r in ranges:
        starts.append((r["range_no"], before))
        before += r["rows"]
    limit = drawn * sum(r["eligible"] for r in ranges) // 100
    offsets = docs.sparkSession.createDataFrame(starts, "range_no long, before long")
    rank = F.col("before") + F.col("within") + 1
    return placed.join(F.broadcast(offsets), "range_no").select(F.col("id").alias(id), "n_words", "n_features", "weight", "score", F.when(rank <= limit, rank).alias("rank"))
