"""Files: documents in folders, JSON lines, JSON, CSV, and where a run's files lie."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.ranking import numbered


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, store = _path(spark, path)
    return store.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder of part files, if it is there."""
    hadoop, store = _path(spark, path)
    store.delete(hadoop, True)


def discover(spark: SparkSession, folder: str, recursive: bool = True, limit: int | None = None, pattern: str = "*.pdf") -> DataFrame:
    """``path, length, modificationTime`` of the files named ``pattern`` (case counts) under a folder, in the order of their paths; the contents are not read.

    A path to one file is that file, if it ends in the pattern's ending in any case.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    hadoop, store = _path(spark, folder)
    none = spark.createDataFrame([], "path string, modificationTime timestamp, length long")
    if not store.exists(hadoop):
        return none
    if store.getFileStatus(hadoop).isFile():
        found = reader.load(folder) if folder.lower().endswith(pattern.lstrip("*").lower()) else none
    else:
        found = reader.option("pathGlobFilter", pattern).load(folder)
    found = found.select("path", "modificationTime", "length").orderBy("path")
    return found if limit is None else found.limit(max(0, limit))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, length, modificationTime`` of all files under a folder, without those of which a part of the path begins with a dot."""
    files = discover(spark, folder, pattern="*")
    return files.where(~F.col("path").rlike(r"/\.[^/]")).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def document_name(path: Column) -> Column:
    """A document's id: the file's name without its ending, in lower case with dashes, and a digest of its path."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.replace(F.lower(stem), F.lit(" "), F.lit("-")), F.lit("-"), F.substring(F.sha1(path), 1, 10))


def chosen(files: DataFrame, folder: str, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """``files`` that ``wanted(ord, name)`` lists by their names under ``folder``, in its order; unknown names are left out."""
    paths = wanted.select("ord", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("name")).alias("path"))
    found = files.join(paths, "path").orderBy("ord").drop("ord")
    return found if limit is None else found.limit(max(0, limit))


def link_names(files: DataFrame) -> DataFrame:
    """``files(ord, path)`` with ``name``: the file's own, or with -1, -2 and so on where that was taken before it.

    A name that occurs once, and that no repeated name can be numbered to, is
    the file's own. Of the rest, files that share one name only are numbered by
    sampled ranges, however many they are. Where a repeated name meets others
    that look like its numbered ones, each depends on those before it, so these
    few are gone through in order, each such group in one task.
    """
    own = F.element_at(F.split("path", "/"), -1)
    stem, suffix = F.regexp_replace(own, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(own, r"(?<=.)(\.[^.]*)$", 1)
    rows = files.select("ord", "path", stem.alias("stem"), suffix.alias("suffix"))
    counts = rows.groupBy("stem", "suffix").agg(F.count("*").alias("n"))
    # a name, and what it may be a numbered form of, the shortest first
    tail = F.regexp_extract("stem", r"((?:-[1-9][0-9]*)*)$", 1)
    family, numbers = F.expr("left(stem, length(stem) - length(tail))"), F.filter(F.split("tail", "-"), lambda x: x != "")
    forms = F.transform(F.sequence(F.lit(0), F.size("numbers")), lambda i: F.concat_ws("-", "family", F.slice("numbers", F.lit(1), i)))
    named_forms = counts.withColumn("tail", tail).withColumns({"family": family, "numbers": numbers}).select("stem", "suffix", F.posexplode(forms).alias("i", "root"))
    repeated = counts.where("n > 1").select(F.col("stem").alias("root"), "suffix")
    roots = named_forms.join(repeated, ["root", "suffix"]).groupBy("stem", "suffix").agg(F.min_by("root", "i").alias("root"))
    mixed = roots.groupBy("root", "suffix").agg((F.count("*") > 1).alias("mixed"))
    asked = rows.join(roots, ["stem", "suffix"], "left").join(mixed, ["root", "suffix"], "left").select("ord", "path", "stem", "suffix", "root", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    alone = asked.where("root is null").select("ord", "path", F.concat("stem", "suffix").alias("name"))
    same = numbered(asked.where("root is not null and not mixed"), ["root", "suffix"], ["ord"], "place", label="link-names")
    same = same.select("ord", "path", F.concat("stem", F.when(F.col("place") > 0, F.concat(F.lit("-"), F.col("place").cast("string"))).otherwise(""), "suffix").alias("name"))

    def named(part: pd.DataFrame) -> pd.DataFrame:
        part, used, last, out = part.sort_values("ord"), set(), {}, []
        for s in part["stem"]:
            name = s
            while name in used:
                last[s] = last.get(s, 0) + 1
                name = f"{s}-{last[s]}"
            used.add(name)
            out.append(name)
        return part[["ord", "path"]].assign(name=[n + x for n, x in zip(out, part["suffix"], strict=True)])

    rest = asked.where("mixed").groupBy("root", "suffix").applyInPandas(named, rows.select("ord", "path").schema.add("name", "string"))
    return alone.union(same).union(rest)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad row raises, a missing path is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_json(spark: SparkSession, data: dict, path: str) -> None:
    """One JSON object (a manifest, a summary), ASCII with an indent of two."""
    hadoop, store = _path(spark, path)
    out = store.create(hadoop, True)
    try:
        out.write(bytearray(json.dumps(data, indent=2, ensure_ascii=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """The object of a JSON file; empty if there is none."""
    if not exists(spark, path):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays as JSON. Without rows, a file without a header."""
    flat = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema.fields])
    flat.write.mode("overwrite").option("header", str(not df.isEmpty()).lower()).option("escape", '"').csv(path)


@dataclass(frozen=True)
class RunPaths:
    """Where a run's files lie: beside its sources, or under a project's ``artifacts``."""

    run: str
    work: str
    exports: str
    reports: str

    def file(self, name: str) -> str:
        return f"{self.work}/{name}"


def run_paths(project: str, source: str | None = None, job: str | None = None) -> RunPaths:
    if source is None:
        run = f"{project.rstrip('/')}/artifacts"
        return RunPaths(run, run, f"{run}/exports", f"{run}/reports")
    folder = source.rstrip("/")
    folder = folder.rpartition("/")[0] if folder.lower().endswith(".pdf") else folder
    run = f"{folder}/extraccion_dataset" + (f"/{job}" if job else "")
    return RunPaths(run, f"{run}/.work" + (f"/{job}" if job else ""), run, run)
