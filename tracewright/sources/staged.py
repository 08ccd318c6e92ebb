"""Outputs that appear whole or not at all.

Rows go to a staging folder first. With them go a manifest (what they were made from,
how many rows were written) and a table of their files with sizes. Only then the
folder takes the place of the target, by renaming. A run that ends half-way leaves the
last whole output, or none, but never a part of one; readers pass over staging folders,
since their names begin with an underscore. Rows are counted by the write itself.
One writer for a target at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST, PARTS, STAGING = "_manifest", "_parts", "_staging"
_MANIFEST_SHAPE = "made_from string, n_rows long, facts map<string,string>"
_PARTS_SHAPE = "part string, length long"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder, by their path inside it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    top = _files(spark, path).makeQualified(_path(spark, path)).toUri().getPath()
    inside = F.substring_index("path", top.rstrip("/") + "/", -1)
    return files.select(inside.alias("part"), "length")


def commit(
    df: DataFrame, target: str, write: Callable[[DataFrame, str], None], made_from: str = "",
    facts: Mapping[str, object] | None = None, observed: Mapping[str, Column] | None = None,
) -> dict[str, object]:
    """Write ``df`` by ``write(df, folder)`` and put the folder in the place of ``target``.

    ``observed`` are aggregates over the rows, taken while they are written; they, the
    number of rows (``n_rows``) and ``facts`` are returned and kept in the manifest. An
    empty frame is an output too; its aggregates are null.
    """
    spark = df.sparkSession
    fs, target = _files(spark, target), target.rstrip("/")
    parent, name = target.rsplit("/", 1)
    stage, old = f"{parent}/{STAGING}/{name}", f"{parent}/{STAGING}/{name}-old"
    for left in (stage, old):  # by a run that ended half-way
        fs.delete(_path(spark, left), True)
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in (observed or {}).items()])
    write(rows, stage)
    counts = {"n_rows": 0, **dict.fromkeys(observed or {}), **seen.get}
    facts = {**(facts or {}), **counts}
    _listing(spark, stage).coalesce(1).write.json(f"{stage}/{PARTS}")
    texts = {k: None if v is None else str(v) for k, v in facts.items()}
    spark.createDataFrame([(made_from, counts["n_rows"], texts)], _MANIFEST_SHAPE).coalesce(1).write.json(f"{stage}/{MANIFEST}")
    if fs.exists(_path(spark, target)):
        _rename(spark, target, old)
    _rename(spark, stage, target)
    fs.delete(_path(spark, old), True)
    return facts


def _rename(spark: SparkSession, source: str, target: str) -> None:
    if not _files(spark, source).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"cannot rename {source} to {target}")


def committed(spark: SparkSession, target: str, made_from: str | None = None) -> dict[str, str] | None:
    """Facts of a whole output; None if there is none, if it was made from something else, or if files changed."""
    folder = f"{target.rstrip('/')}/{MANIFEST}"
    if not _files(spark, target).exists(_path(spark, f"{folder}/_SUCCESS")):
        return None
    manifest = spark.read.schema(_MANIFEST_SHAPE).json(folder).first()
    if made_from is not None and manifest["made_from"] != made_from:
        return None
    return dict(manifest["facts"]) if changed_parts(spark, target).isEmpty() else None


def changed_parts(spark: SparkSession, target: str) -> DataFrame:
    """``part, problem`` of the files that are missing, new or of another size than when they were written."""
    wrote = spark.read.schema(_PARTS_SHAPE).json(f"{target.rstrip('/')}/{PARTS}").withColumnRenamed("length", "wrote")
    there = _listing(spark, target).withColumnRenamed("length", "found")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("wrote").isNull(), "new").when(
        F.col("found") != F.col("wrote"), "other size")
    return wrote.join(there, "part", "full").select("part", problem.alias("problem")).where("problem IS NOT NULL")
