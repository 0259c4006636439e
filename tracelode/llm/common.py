"""Helpers that the operators share: inputs, scratch tables, folds and prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a local one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-llm-")
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows, where the session has Spark's default of 10000: a batch of long texts is held several times over on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def documents(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null: empty) and the columns named in keep; other columns, whatever their names, are left behind."""
    small_batches(df.sparkSession)
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus (null id: as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a text by which rows that share an id are told apart where they are dealt out.
PREFIX = 7
Cut = tuple[int, int, int]  # whether there is an id, the id, the text's first bytes as a number


def _first_bytes(text: Column) -> Column:
    """The first bytes of a text as a number that has their order."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("long")


def id_buckets(rows: DataFrame, n: int) -> list[Cut]:
    """At most 2 * n ascending cut points of (doc_id, text), null ids first, so that the buckets between them hold like numbers of rows.

    An id that more than two buckets' worth of rows share (or that many rows lack) is cut by its texts' first bytes; rows alike in these stay together. A row for each such id, n / 2 at most, passes the driver."""
    if n < 2:
        return []
    ids = rows.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    cuts = {(1, int(c), 0) for c in ids}
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n"), F.max("n")).first()
    if total[1] and total[1] > 2 * total[0] / n:
        heavy = counts.where(F.col("n") > 2 * total[0] / n)
        own = rows.join(F.broadcast(heavy.withColumnRenamed("doc_id", "hot")), F.col("doc_id").eqNullSafe(F.col("hot")))
        at = F.percentile_approx(_first_bytes(F.col("text")), [i / n for i in range(1, n)], 100 * n)
        for r in own.groupBy("hot").agg(at.alias("p"), F.count("*").alias("n")).collect():
            step = max(1, total[0] // r["n"])  # of the n quantiles of this id as many as it has buckets' worth of rows
            key = (0, 0) if r["hot"] is None else (1, int(r["hot"]))
            cuts |= {(*key, int(p)) for p in r["p"][step - 1 :: step]} | ({(1, int(r["hot"]), 0), (1, min(int(r["hot"]) + 1, 2**63 - 1), 0)} if key[0] else set())
    return sorted(cuts)


def bucket_of(doc_id: Column, text: Column, cuts: list[Cut]) -> Column:
    """Which bucket of id_buckets a row falls in. The cut list has some entries a bucket, so it is as small as the partition count. Texts are looked at only where a cut tells them apart."""
    if not cuts:
        return F.lit(0)
    whole = any(c[2] for c in cuts)
    n, long = len(cuts), lambda x: F.lit(x).cast("long")
    if whole:
        array = F.array(*[F.struct(F.lit(c[0]), long(c[1]), long(c[2])) for c in cuts])
        key = F.struct(doc_id.isNotNull().cast("int"), F.coalesce(doc_id.cast("long"), long(0)), _first_bytes(text))
    else:
        array, key = F.array(*[long(c[1]) for c in cuts]), doc_id.cast("long")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])  # binary search, a step a halving

    def step(at, width):
        nxt = at + width
        return F.when((nxt <= n) & (key >= F.element_at(array, F.least(nxt, F.lit(n)))), nxt).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)
