"""Substring search by a trigram index.

The index holds a row for each trigram of a row's text, in folders by a hash of
the trigram. A needle's rows are those that all of its rarest trigrams lead to,
and of these only the ones that hold it count. A needle of under three
characters is looked for in all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index, and the trigrams of a needle that are intersected, the rarest.
BUCKETS, RAREST = 256, 4


def folded(text: Column) -> Column:
    """The text as it is searched: in lower case, null as empty."""
    return F.lower(F.coalesce(text, F.lit("")))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _grams(text: Column) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))
    return F.when(F.length(text) > 2, cut).otherwise(F.array().cast("array<string>"))


def write_index(rows: DataFrame, key: str, texts: list[str], folder: str, buckets: int = BUCKETS) -> str:
    """Writes the trigrams of ``texts`` of ``rows``, each column by itself, as ``gram, key`` in folders by bucket; returns where.

    Each row gives a trigram once. Keys must be unique and not null.
    """
    path = f"{folder}/trigrams-{uuid.uuid4().hex}"
    grams = F.array_distinct(F.flatten(F.array(*[_grams(folded(F.col(c))) for c in texts])))
    posted = rows.select(F.col(key).alias("key"), F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    # a bucket is several files where it is large: rows are dealt by trigram and key, sorted for the reader's filters
    posted.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "gram", "key").write.partitionBy("bucket").parquet(path)
    return path


def needle_grams(needle: str) -> list[str]:
    low = needle.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def posted(spark: SparkSession, path: str, needle: str, buckets: int = BUCKETS) -> DataFrame:
    """``gram, key``: the postings of a needle's trigrams; only their folders are read."""
    grams = needle_grams(needle)
    own = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), buckets).alias("b"))
    named = sorted({r["b"] for r in own.collect()})  # as many as the needle has trigrams at most
    return spark.read.schema("gram string, key " + _key_type(spark, path) + ", bucket int").parquet(path).where(F.col("bucket").isin(named) & F.col("gram").isin(grams)).select("gram", "key")


def _key_type(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(path).schema["key"].dataType.simpleString()


def search(rows: DataFrame, key: str, texts: list[str], path: str, needle: str, rarest: int = RAREST, buckets: int = BUCKETS) -> DataFrame:
    """The ``rows`` of which one of ``texts`` holds ``needle``, in any case; an empty needle is in all.

    ``path`` is what :func:`write_index` wrote of the same rows.
    """
    held = F.lit(False)
    for c in texts:
        held = held | F.contains(folded(F.col(c)), F.lit(needle.lower()))
    if len(needle) < 3:
        return rows.where(held)
    found = posted(rows.sparkSession, path, needle, buckets)
    counts = found.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").limit(rarest)
    some = [r["gram"] for r in counts.collect()]  # RAREST rows
    if len(some) < min(rarest, len(needle_grams(needle))):
        return rows.limit(0)  # a trigram that no row has
    keys = found.where(F.col("gram").isin(some)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(some)).select(F.col("key").alias(key))
    return rows.join(keys, key, "left_semi").where(held)
