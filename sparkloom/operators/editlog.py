"""Edits of examples as a log: appended, folded over a base that stays as it is, and compacted.

An edit is a row ``seq, example_id, split, action`` and what it changes. Edits
of one example are applied in the order of ``seq``, in one pass over its rows;
examples without edits are not touched. Compaction writes the folded table as a
new base and begins a new log; readers see the one or the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from sparkloom.operators.curation import MANUAL
from sparkloom.sources import files

ACTIONS = ("accept", "reject", "delete", "patch")
PATCHABLE = {"question": "string", "answer": "string", "difficulty": "string", "reasoning": "string", "question_type": "string", "evidence": "array<string>", "is_answerable": "boolean"}
SCHEMA = "seq long, example_id string, split string, action string, reason string, " + ", ".join(f"new_{c} {t}" for c, t in PATCHABLE.items())


class EditLog:
    """A base table and its log under ``folder``; ``CURRENT.json`` there names both."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _current(self) -> dict:
        found = files.read_json(self.spark, f"{self.folder}/CURRENT.json")
        if not found:
            raise FileNotFoundError(f"no edit log in {self.folder}")
        return found

    def begin(self, base: DataFrame) -> None:
        """Writes the base, with ``example_id, split, example_ord, reason``, and an empty log."""
        name = uuid.uuid4().hex
        base.write.parquet(f"{self.folder}/base-{name}")
        # the name is written last, so a base half written is never read
        files.write_json(self.spark, {"base": f"base-{name}", "log": f"log-{name}", "before": self._next() if files.exists(self.spark, f"{self.folder}/CURRENT.json") else 0}, f"{self.folder}/CURRENT.json")

    def base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._current()['base']}")

    def log(self) -> DataFrame:
        path = f"{self.folder}/{self._current()['log']}"
        return self.spark.read.schema(SCHEMA).parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], SCHEMA)

    def _next(self) -> int:
        last = self.log().agg(F.max("seq")).first()[0]
        return self._current()["before"] if last is None else last + 1

    def append(self, ids: DataFrame, action: str, reason: str = "manual_rejection") -> int:
        """Logs one edit of these ``ids(example_id[, split])``, or with ``patch`` of ``ids(example_id, question, ...)``; without a split it goes to all. Returns its seq.

        One writer at a time.
        """
        if action not in ACTIONS:
            raise ValueError(f"unknown action: {action}")
        seq = self._next()
        own = {f"new_{c}": F.col(c).cast(t) if action == "patch" and c in ids.columns else F.lit(None).cast(t) for c, t in PATCHABLE.items()}
        split = F.col("split").cast("string") if "split" in ids.columns else F.lit(None).cast("string")
        rows = ids.select(F.lit(seq).cast("long").alias("seq"), F.col("example_id"), split.alias("split"), F.lit(action).alias("action"), F.lit(reason).alias("reason"), *[v.alias(k) for k, v in own.items()])
        rows.distinct().write.mode("append").parquet(f"{self.folder}/{self._current()['log']}")
        return seq

    def folded(self) -> DataFrame:
        """The base with all edits applied."""
        return fold(self.base(), self.log())

    def compact(self) -> None:
        """The folded table becomes the base and the log begins anew; sequence numbers go on."""
        old = self._current()
        self.begin(self.folded())
        for name in (old["base"], old["log"]):
            files.remove(self.spark, f"{self.folder}/{name}")


def fold(base: DataFrame, log: DataFrame) -> DataFrame:
    """``base`` with the edits of ``log`` applied in order.

    An example is its rows of one id and split. Accepting keeps the last of its
    rows when none is accepted; rejecting keeps of its accepted rows the last;
    deleting takes the accepted rows away if there are any, else the rejected
    ones; patching sets what is given. Only examples that the log names are
    gathered, each as an array of its rows.
    """
    names = base.columns
    # an example's own difficulty is a word, not a score
    numbers = {name for name, kind in base.dtypes if kind in ("double", "float")}
    everywhere = log.where("split is null").drop("split")
    splits = base.select("example_id", "split").distinct()
    edits = log.where("split is not null").unionByName(everywhere.join(splits, "example_id").select(*log.columns))
    own = edits.groupBy("example_id", "split").agg(F.array_sort(F.collect_list(F.struct(*[c for c in log.columns if c not in ("example_id", "split")]))).alias("edits_"))
    rest = base.join(own.select("example_id", "split"), ["example_id", "split"], "left_anti").select(*names)
    kept = F.array_sort(F.collect_list(F.struct("example_ord", F.struct(*names).alias("row"))))
    rows = base.join(own, ["example_id", "split"]).groupBy("example_id", "split").agg(F.transform(kept, lambda x: x["row"]).alias("rows_"), F.first("edits_").alias("edits_"))

    def step(state, e):
        ok = F.filter(state, lambda r: r["reason"].isNull())
        last = lambda a: F.slice(a, F.greatest(F.size(a), F.lit(1)), 1)
        accepted = F.transform(last(state), lambda r: _with(r, names, _accepted(r, numbers, names)))
        kept_no = F.filter(state, lambda r: r["reason"].isNotNull())
        rejected = F.array_sort(F.concat(kept_no, F.transform(last(ok), lambda r: _with(r, names, {"reason": e["reason"]}))), lambda a, b: F.when(a["example_ord"] < b["example_ord"], -1).otherwise(1))
        patched = F.transform(state, lambda r: _with(r, names, {c: F.coalesce(e[f"new_{c}"], r[c]) for c in PATCHABLE if c in names}))
        some = F.size(ok) > 0
        return (
            F.when((e["action"] == "accept") & ~some & (F.size(state) > 0), accepted).when((e["action"] == "reject") & some, rejected)
            .when(e["action"] == "delete", F.when(some, kept_no).otherwise(F.slice(state, 1, 0))).when(e["action"] == "patch", patched).otherwise(state)
        )

    # a fold keeps one type, in which all may be null
    kind = ArrayType(StructType([StructField(f.name, f.dataType) for f in base.schema.fields]))
    done = rows.select(F.explode(F.aggregate("edits_", F.col("rows_").cast(kind), lambda state, e: step(state, e).cast(kind))).alias("r")).select("r.*")
    return rest.unionByName(done.select(*names))


def _with(row, names, changed):
    return F.struct(*[(changed[c] if c in changed else row[c]).alias(c) for c in names])


def _accepted(row, numbers, names):
    unscored = row["overall"].isNull() if "overall" in names else F.lit(False)
    out = {c: F.when(unscored, F.lit(v)).otherwise(row[c]) for c, v in MANUAL.items() if c in numbers}
    if "rationale" in names:
        out["rationale"] = F.when(unscored, "manual override").otherwise(row["rationale"])
    return out | {"reason": F.lit(None).cast("string")}
