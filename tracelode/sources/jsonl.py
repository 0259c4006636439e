"""Append-only JSON-lines logs: scan, select, route, validate, write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import constraint, rows_of
from ..functions.rules import VIOLATIONS, Rule, as_line, plain_fields, plainly_valid, settle, typed, valid_line, violations
from ..functions.scalars import identity, notebook_hash

#: Equal lines of one file that one task numbers.
BLOCK = 10_000
#: Directory of each kind of event.
DIRECTORIES = {"runtime": "runtime", "lineage": "lineage", "dataframe_lineage": "dataframe_lineage"}


def with_origin(lines: DataFrame) -> DataFrame:
    """Adds path, kind (from the directory; null for others) and notebook_hash (from the file name)."""
    path = F.col("_metadata.file_path")
    parent = F.element_at(F.split(path, "/"), -2)
    kind = F.when(parent.isin(list(DIRECTORIES)), parent)
    return lines.select("value", path.alias("path"), kind.alias("kind"), F.regexp_extract(path, r"/([0-9a-f]{8})_[^/]*$", 1).alias("notebook_hash"))


def hash_of(spark: SparkSession, notebook: str) -> str:
    return spark.range(1).select(notebook_hash(F.lit(notebook))).first()[0]


def scan(spark: SparkSession, root: str, notebook: str | None = None) -> DataFrame:
    """Lines of all kinds under root, blank ones left out; only one notebook's files, if its path is given. Directories of kinds that aren't there yet are left out."""
    named = f"{hash_of(spark, notebook)}_*.jsonl" if notebook else "*.jsonl"
    lines = spark.read.option("pathGlobFilter", named).text(f"{root}/{{{','.join(DIRECTORIES.values())}}}")
    return with_origin(lines).where("kind is not null").where(F.trim("value") != "")


def unrouted(spark: SparkSession, root: str) -> DataFrame:
    """What lies under root in directories of no kind, and so is never read: directory, n_lines."""
    lines = with_origin(spark.read.option("pathGlobFilter", "*.jsonl").text(f"{root}/*")).where("kind is null")
    return lines.groupBy(F.element_at(F.split("path", "/"), -2).alias("directory")).agg(F.count("*").alias("n_lines"))


def land(lines: DataFrame, root: str, directory: str, notebook: str) -> None:
    """Lines (value) as files of one notebook in a directory. They are written aside and appear by renaming, whole, so that no reader sees half a file."""
    spark = lines.sparkSession
    staged, name = f"{root}/_staged/{uuid.uuid4().hex}", f"{hash_of(spark, notebook)}_{uuid.uuid4().hex[:8]}"
    lines.select("value").write.text(staged)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{root}/{directory}"))
    for k, part in enumerate(sorted(str(f.getPath()) for f in files.globStatus(path(f"{staged}/part-*")))):
        if not files.rename(path(part), path(f"{root}/{directory}/{name}-{k}.jsonl")):
            raise OSError(f"{part} can't be put in place; it stays in {staged}")
    files.delete(path(staged), True)


def identified(lines: DataFrame) -> DataFrame:
    """Adds row_id, the same in every scan of the same files. Other columns must follow from path and value.

    Equal lines of a file are alike, so they are counted, with partial sums, and numbered anew; a line that stands there very often is numbered in blocks, by many tasks."""
    count = lines.groupBy("path", "value").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in lines.columns if c not in ("path", "value")))
    few = count.where(F.col("n") <= BLOCK).withColumn("occurrence", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    many = count.where(F.col("n") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}")))).repartition("path", "value", "block")
    many = many.withColumn("occurrence", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least("n", (F.col("block") + 1) * BLOCK)))).drop("block")
    return few.unionByName(many).select(*lines.columns, identity(F.col("path"), F.col("value"), F.col("occurrence")).alias("row_id"))


def looked(lines: DataFrame, kind: str | Rule, value: str = "value") -> DataFrame:
    """Adds _first, the line as its rules' types read it where it is valid at first sight, else null; and _v, the parsed line of all others."""
    read = settle(settle(lines, "_line", as_line(F.col(value), kind)), "_first", valid_line(F.col(value), "_line", kind)).drop("_line")
    return settle(read, "_v", F.when(F.col("_first").isNull(), F.try_parse_json(F.col(value))))


def checked(lines: DataFrame, kind: str | Rule, value: str = "value", strict: bool = True, deep: bool = True) -> DataFrame:
    """Adds v (the parsed line) and violations. Without strict nothing but JSON itself is asked for."""
    if not strict:
        parsed = settle(lines, "v", F.try_parse_json(F.col(value)))
        return settle(parsed, "violations", F.filter(violations("v", kind, deep=False), lambda x: x["rule"] == "json"))
    # Most lines are valid as they stand, and parsed no further but by who asks for v; others are written in sorted form, of which again most are valid. Only those that aren't are walked rule by rule, and of them only the fields that aren't.
    read = settle(settle(looked(lines, kind, value), "_canonical", F.to_json("_v")), "_read", typed(F.col("_canonical"), kind))
    plain = settle(read, "_plain", F.col("_first").isNotNull() | plainly_valid("_canonical", "_read", kind)).drop("_canonical")
    fields = plain_fields("_v", "_read", kind)
    plain = plain if fields is None else settle(plain, "_kept", F.when(~F.col("_plain"), fields))
    every = violations("_v", kind, deep, None if fields is None else "_kept")
    found = settle(plain, "violations", F.when(F.col("_plain"), F.array().cast(VIOLATIONS)).otherwise(every))
    return found.withColumn("v", F.when(F.col("_first").isNull(), F.col("_v")).otherwise(F.try_parse_json(F.col(value)))).drop("_plain", "_kept", "_read")


def split(checked_lines: DataFrame, kind: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): rows of the kind's table, and bad lines with their reason: a rule's, or a table constraint's."""
    good = checked_lines.where(F.size("violations") == 0).withColumn("key", key)
    rows = rows_of(good, kind).withColumn("broken", constraint(kind))
    names = [c for c in rows.columns if c != "broken"]
    bad = checked_lines.where(F.size("violations") > 0).select(key.alias("key"), F.concat_ws(":", F.col("violations")[0]["rule"], F.col("violations")[0]["path"]).alias("reason"))
    late = rows.where("broken is not null").select(F.col(names[0]).alias("key"), F.col("broken").alias("reason"))
    return rows.where("broken is null").select(names), bad.unionByName(late)


def emit(events: DataFrame, path: str) -> None:
    """JSON-lines sink: an object a row, null fields left out."""
    events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("append").text(path)
