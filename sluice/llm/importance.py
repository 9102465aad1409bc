"""Importance resampling towards a target distribution, in Spark SQL functions only.

Documents and target texts are bags of hashed n-grams. A bucket's gain says how
much more frequent it is in the target, a document's weight is the mean gain of
its n-grams, and Gumbel noise by document id turns the largest weights into a
draw without replacement. Hashing is one scan that writes two bytes per n-gram;
counts are one row per bucket, the gains are one broadcast table of ``buckets``
rows, and ranks come from one range sort whose partitions learn how many rows
lie before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import scratch

#: Words once A-Z is lower-cased; matched before that, so A-Z count as well.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20


def folded(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORDS), F.lit(0)), folded)


def ngrams(words: Column, longest: int) -> Column:
    """All runs of one to ``longest`` words, joined by a space, repeats included."""

    def runs(k: int) -> Column:
        last = F.size(words) - k + 1
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, k), " "))

    return words if longest == 1 else F.concat(words, *[runs(k) for k in range(2, longest + 1)])


def hashed(docs: DataFrame, longest: int, buckets: int, *keep: str) -> DataFrame:
    """(``keep``, n_words, buckets): the bucket of every n-gram, in two bytes where they suffice."""
    kind = "short" if buckets <= 1 << 15 else "int"
    split = docs.select(*keep, words(F.col("text")).alias("words"))
    return split.select(*keep, F.size("words").alias("n_words"), F.transform(ngrams(F.col("words"), longest), lambda x: (F.crc32(F.encode(x, "UTF-8")) % buckets).cast(kind)).alias("buckets"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket from two tables as ``hashed`` gives them; a table without n-grams has only the pseudo-counts."""
    counted = lambda df, name: df.select(F.explode("buckets").alias("bucket")).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias(name))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(counted(docs, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy()  # one row per bucket
    total = lambda name: F.sum(name).over(whole) + buckets
    ratio = ((F.col("t") + 1) * total("s")) / ((F.col("s") + 1) * total("t"))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256('<seed>:<doc_id>')."""
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def floor_div(a: Column, b: Column) -> Column:
    """a / b rounded down, exact in whole numbers, for a positive b."""
    return F.call_function("div", a - F.pmod(a, b), b)


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` with rank: of the rows with ``may``, floor(percent * N / 100) by descending score and then ascending doc_id; others null.

    One range sort; a row's place is its place in its partition plus the rows of
    the partitions before, of which there is one count per partition.
    """
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = scratch.keep(scored.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("may").alias("able"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), floor_div(F.lit(percent) * F.sum("able").over(Window.partitionBy()), F.lit(100)).alias("drawn"))
    found = placed.withColumn("part", part).join(F.broadcast(counts), "part")
    place = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return found.withColumn("rank", F.when(F.col("may") & (place <= F.col("drawn")), place)).drop("part", "before", "drawn", "place", "may")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs``; rank is null for those not drawn.

    Null and wordless texts have no features and weight 0, and count with the
    others of fewer than ``least_words`` words, which are never drawn. A null
    doc_id is hashed as an empty one and comes last in ties. Repeated rows are
    documents of their own, with the same score. Further columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mine = scratch.keep(hashed(texts, longest, buckets, "doc_id").withColumn("row", F.monotonically_increasing_id()), "hashed")
    gain = scratch.keep(gains(mine, hashed(target.select("text"), longest, buckets), buckets), "gains")
    each = mine.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket")).withColumn("bucket", F.col("bucket").cast("long"))
    met = each.join(F.broadcast(gain), "bucket", "left")  # ``buckets`` rows, whatever the input
    total = met.groupBy("row", "doc_id", "n_words", "n_features").agg(F.sum("gain").alias("gain"))
    weight = F.when(F.col("n_features") > 0, floor_div(F.col("gain"), F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    scored = total.select("doc_id", "n_features", weight.alias("weight"), (F.col("n_words") >= least_words).alias("may"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")
