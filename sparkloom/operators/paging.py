"""Deep pages of a sorted table: rows are written in their order, and a small table says which file holds which places."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from sparkloom.operators.ranking import PART, SEAT, ranged
from sparkloom.sources.staging import shared_dir


class OrdinalIndex:
    """Rows in an order under ``path``, in folders of at most some ``rows`` each, and ``parts``, a row for each folder.

    A page opens the folders that its places lie in and no others, however deep it is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # an empty table has no folders, so its schema is kept beside them
        kinds = spark.read.parquet(f"{path}/schema").schema
        self.rows = spark.read.schema(StructType([*kinds, StructField(PART, LongType())])).parquet(f"{path}/rows")
        self.parts = spark.read.schema(f"{PART} long, n long, first long").parquet(f"{path}/parts")

    @classmethod
    def write(cls, rows: DataFrame, order: list[Column | str], rows_per_part: int = 100_000, folder: str | None = None) -> OrdinalIndex:
        """Sorts ``rows`` by sampled ranges and writes them with their index; rows equal in ``order`` come in any order, the same for all pages."""
        spark = rows.sparkSession
        path = f"{folder or shared_dir(spark)}/sparkloom-ordinal-{uuid.uuid4().hex}"
        parts = max(1, -(-rows.count() // rows_per_part))
        held = ranged(rows, order, "ordinal", parts)
        held.drop(PART).limit(0).write.parquet(f"{path}/schema")
        held.withColumn(PART, F.col(PART).cast("long")).write.partitionBy(PART).parquet(f"{path}/rows")
        earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        counts = held.groupBy(F.col(PART).cast("long").alias(PART)).agg(F.count("*").alias("n"))
        counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).write.parquet(f"{path}/parts")
        return cls(spark, path)

    def total(self) -> int:
        return self.parts.agg(F.sum("n")).first()[0] or 0

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """The rows at places ``offset`` to ``offset + limit``, in order, with ``place`` from 0."""
        low, high = max(0, offset), max(0, offset) + max(1, limit)
        some = self.parts.where((F.col("first") < high) & (F.col("first") + F.col("n") > low)).collect()  # as many as a page has rows at most
        names = [c for c in self.rows.columns if c not in (PART, SEAT)]
        if not some:
            return self.rows.limit(0).select(*names, F.lit(0).cast("long").alias("place"))
        first = F.create_map(*[F.lit(x) for r in some for x in (r[PART], r["first"])])
        own = self.rows.where(F.col(PART).isin([r[PART] for r in some])).withColumn("place", F.col(SEAT) + F.element_at(first, F.col(PART).cast(self.parts.schema[PART].dataType)))
        return own.where((F.col("place") >= low) & (F.col("place") < high)).orderBy("place").select(*names, "place")
