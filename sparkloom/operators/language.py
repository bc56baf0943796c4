"""Languages by profiles learned from labelled documents.

A profile is how likely each run of three bytes is in a language; a text's
language is the one that makes its runs likeliest. Runs are hashed to a table
of fixed size, so what is sent to the tasks does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.staging import staged

#: Cells of the table, characters of a text that are looked at, rows that are learned from, languages at most.
CELLS, HEAD, BOUND, MOST = 1 << 15, 4000, 8192, 64


def held_out(doc_id: Column) -> Column:
    """One row in five, by a hash of its id: never learned from."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(5)), F.lit(5)) == 0


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all runs of three bytes within a text, A-Z in lower case and digits as one, and the texts' numbers."""
    column = texts.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] - offsets[0] < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = np.arange(256, dtype=np.uint32)
    plain[65:91] += 32
    plain[48:58], plain[9:14] = 48, 32
    b = plain[np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    row = np.searchsorted(offsets - offsets[0], np.arange(len(code)), side="right") - 1
    inside = np.arange(len(code)) + 3 <= (offsets - offsets[0])[row + 1]
    return (code[inside] >> np.uint32(17)).astype(np.int64), row[inside]


def learned(documents: DataFrame, bound: int = BOUND) -> tuple[list[str], np.ndarray]:
    """Languages, by name, and for each cell and language the log likelihood of a run, from ``documents(doc_id, lang, text)``.

    At most ``bound`` rows with a lang and a text, those of least hash outside
    the held-out fifth; the MOST commonest languages of those.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", F.substring("text", 1, HEAD).alias("text"))
    some = staged(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            cell, row = _runs(batch.column(1).fill_null(""))
            for lang in sorted(set(names)):
                own = np.array([n == lang for n in names])
                cells, n = np.unique(cell[own[row]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(n)], names=["lang", "cell", "n"])

    common = [r["lang"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST).collect()]
    langs = sorted(common)
    counts = some.select("lang", "text").mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = np.zeros((CELLS, max(1, len(langs))))
    for batch in counts.where(F.col("lang").isin(langs)).toArrow().to_batches():  # CELLS rows for each language at most
        table[batch.column(1).to_numpy(), [langs.index(x) for x in batch.column(0).to_pylist()]] = batch.column(2).to_numpy()
    return langs, np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * CELLS)).astype(np.float32)


def detected(documents: DataFrame, profiles: tuple[list[str], np.ndarray], default: str = "es", least: int = 40, name: str = "detected") -> DataFrame:
    """``documents`` with the language of each text; a tie goes to the first by name.

    Texts of under ``least`` characters, null ones and all where nothing was
    learned get ``default``. Texts are looked at as far as HEAD characters.
    """
    langs, table = profiles
    sent = documents.sparkSession.sparkContext.broadcast(table)

    def find(texts: pa.Array) -> pa.Array:
        cell, row = _runs(texts.fill_null(""))
        sums = np.zeros((len(texts), max(1, len(langs))))
        for k in range(len(langs)):
            sums[:, k] = np.bincount(row, weights=sent.value[cell, k], minlength=len(texts))
        best = sums.argmax(axis=1)
        return pa.array([langs[i] if langs else None for i in best], pa.string())

    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.arrow_udf(find, "string")(F.substring(text, 1, HEAD))
    return documents.withColumn(name, F.when(F.length(text) >= least, F.coalesce(own, F.lit(default))).otherwise(F.lit(default)))


def confusion(rows: DataFrame) -> DataFrame:
    """``lang, detected, n`` of the held-out rows with a lang."""
    return rows.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).groupBy("lang", "detected").agg(F.count("*").alias("n"))
