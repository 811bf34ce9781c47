"""Importance resampling of documents towards a target distribution over hashed n-grams, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What lies between words: everything below U+0080 but 0-9, a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Rows of the gain table that is sent to all executors at most.
MOST_BUCKETS = 1_000_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and all characters from U+0080, A-Z in lower case; of a null none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


def ngrams(w: Column, least: int, most: int) -> Column:
    """All runs of `least` to `most` consecutive words, joined by one space, repeats counted."""

    def of(n: int) -> Column:
        if n == 1:
            return w
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.concat(*(of(n) for n in range(least, most + 1)))


def _exploded(rows: DataFrame, least: int, most: int, buckets: int, outer: bool) -> DataFrame:
    """rows (any columns besides the list w of words) with a row for each n-gram's bucket."""
    keep = [c for c in rows.columns if c != "w"]
    each = (F.explode_outer if outer else F.explode)(ngrams(F.col("w"), least, most))
    return rows.select(*keep, each.alias("ngram")).select(*keep, F.pmod(F.crc32(F.col("ngram").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, least: int, most: int, buckets: int) -> DataFrame:
    """bucket, gain: floor of 1000 times the logarithm of how much likelier the target's features fall into the bucket, with one added to each count.

    Buckets that no document has are left out: nothing looks them up.
    """
    if buckets > MOST_BUCKETS:
        raise ValueError(f"at most {MOST_BUCKETS} buckets: the gain table is sent to all executors")
    side = lambda rows, n: _exploded(rows.select(words(F.col("text")).alias("w"), F.lit(n).alias("side")), least, most, buckets, False)
    sides = side(docs, 0).unionByName(side(target, 1))
    counted = cut(sides.groupBy("bucket").agg(F.count_if(F.col("side") == 0).alias("s"), F.count_if(F.col("side") == 1).alias("t")))
    total = counted.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    d = lambda x: x.cast("double")
    odds = d(F.col("t") + 1) * d(F.lit(total["s"] + buckets)) / (d(F.col("s") + 1) * d(F.lit(total["t"] + buckets)))
    return counted.filter("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.ln(odds)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel variate told by the identifier's hash; a null identifier is hashed as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], eligible: Column) -> DataFrame:
    """rows that are eligible, with rank (1, 2, 3...) in the order given, which must leave no ties.

    A distributed sort: rows are dealt to ranges, sorted there and written; a row's rank is its place in its range, and the
    rows of the ranges before it. The driver sees one count for each range.
    """
    spark = rows.sparkSession
    own = rows.filter(eligible)
    placed = cut(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftright("_place", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    offsets = spark.createDataFrame(offsets, "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + inside + 1).drop("_part", "_before", "_place")


def importance(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    least: int = 1,
    most: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank.

    Features are the n-grams of `least` to `most` words; each falls into the bucket that its CRC-32 names. A bucket's gain tells
    how much likelier it is in the target than in docs, weight is the floored mean of a document's gains (0 without features), score adds Gumbel noise, so
    that the highest scores are a sample without replacement. Of the N documents with least_words or more the percent of N (floored)
    with the highest scores are drawn, ties to the smaller identifier; rank is their order, and null for the others.

    Words are counted in two passes over docs, each with sums on the map side: a bucket that holds a third of all features is one row of each
    task, a long document too. The gain table has `buckets` rows at most and is broadcast. The sort is by ranges, with a row number that leaves
    no ties, so that repeated rows don't meet in one task.

    A null text has no features and is never drawn (with least_words over 0). A null identifier is hashed as an empty one, and comes last in ties.
    Rows that repeat have a row and a rank each. Empty docs give no rows; an empty target leaves all gains to the rarity of their buckets.
    Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _scored(rows.withColumn("_row", F.monotonically_increasing_id()), target.select(F.col(target_text).alias("text")), least, most, buckets, seed, least_words, percent).drop("_row")


def _scored(rows: DataFrame, target: DataFrame, least: int, most: int, buckets: int, seed: int, least_words: int, percent: int) -> DataFrame:
    gain = gains(rows, target, least, most, buckets)
    own = rows.select("_row", "doc_id", words(F.col("text")).alias("w")).withColumn("enough", F.size("w") >= least_words)
    met = _exploded(own, least, most, buckets, True).join(F.broadcast(gain), "bucket", "left")
    summed = met.groupBy("_row", "doc_id", "enough").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = cut(summed.select("_row", "doc_id", "enough", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    drawn = scored.filter("enough").count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("_row")]
    placed = ranked(scored, order, F.col("enough"))
    rest = scored.filter("not enough").withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "_row")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", **kw) -> DataFrame:
    """The rows of docs that importance draws, all columns: each row by itself, whatever its identifier. Takes importance's further arguments."""
    name = "_row_of_docs"
    while name in docs.columns:
        name += "_"
    numbered = cut(docs.withColumn(name, F.monotonically_increasing_id()))
    rows = numbered.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(name).alias("_row"))
    of = {"least": 1, "most": 1, "buckets": BUCKETS, "seed": SEED, "least_words": LEAST_WORDS, "percent": PERCENT} | kw
    drawn = _scored(rows, target.select(F.col(target_text).alias("text")), **of).filter("rank is not null").select(F.col("_row").alias(name))
    return numbered.join(drawn, name, "left_semi").select(*docs.columns)
