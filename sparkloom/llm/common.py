"""Small Spark helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.staging import shared_dir, staged

__all__ = ["components", "forget", "marked", "shared_dir", "table", "temporary", "unused", "written"]

_SCOPES: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what was written survives the loss of any executor.
    """
    out = staged(df, label)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def _folders(df: DataFrame) -> set[str]:
    return {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/sparkloom-" in name}


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nobody reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in _folders(df):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that a frame given to what this yields still reads."""
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df))
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.remove(made)
    for df in made:
        if not _folders(df) & kept:
            forget(df)
        elif _SCOPES:
            _SCOPES[-1].append(df)


def unused(name: str, columns: list[str]) -> str:
    """``name``, or with a number, so that it is none of ``columns`` (in any case)."""
    taken, k = {c.lower() for c in columns}, 0
    while (found := name if not k else f"{name}_{k}").lower() in taken:
        k += 1
    return found


def marked(df: DataFrame, key: str, keys: DataFrame, flag: str = "may", bits: int = 1 << 22) -> DataFrame:
    """``df`` with ``flag``: whether its key may be among ``keys`` (one column).

    A bitmap of fixed size over the keys' hashes; at most ``bits / 64`` rows of
    16 bytes, whatever the number of keys, so it is broadcast. False is certain,
    so only rows with true need the join that decides, and the others' texts
    are never shuffled. Null keys are false. ``flag`` must be no column of ``df``.
    """
    cell_at, bitmap = unused("sparkloom_cell", df.columns), unused("sparkloom_bitmap", df.columns)
    place = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits))
    cells = keys.where(F.col(keys.columns[0]).isNotNull()).select(place.alias("h"))
    cells = cells.groupBy((F.col("h") / 64).cast("int").alias(cell_at)).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias(bitmap))
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    found = df.withColumn(cell_at, (h / 64).cast("int")).join(F.broadcast(written(cells, "bitmap")), cell_at, "left")
    bit = F.call_function("shiftrightunsigned", F.col(bitmap), (h % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return found.select(*df.columns, (F.col(key).isNotNull() & F.coalesce(bit, F.lit(False))).alias(flag))


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows ``(node, component)``.

    Alternating large-star and small-star contraction (Kiveris et al., 2014):
    each round is two joins on narrow rows, a hub's rows are split by AQE, and
    the edge list is written between rounds. ``component`` is the smallest node.
    Nodes without an edge (self loops included) are not listed.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select("b", "a")).toDF("u", "v")
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        return (
            down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select("u", "m")).distinct()
        )

    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = None
    for _ in range(max_rounds):
        following = written(star(star(current, True), False), label)
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(current)
        current = following
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    tops = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
