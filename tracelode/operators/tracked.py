"""DataFrame operations that return their result together with a table of lineage events.

Counts in an event are aggregates of the frames, so the events stay lazy. With observe=True a result carries an observation of its rows
instead, read after its action without a second pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.rules import PRODUCER

SCHEMA_URL = "https://openlineage.io/spec/1-0-5/OpenLineage.json#/$defs/RunEvent"
TYPES = {"__getitem__": "selection", "groupby": "aggregation", "sum": "aggregation", "mean": "aggregation", "count": "aggregation", "merge": "join"}


def operation_type(method: Column) -> Column:
    return F.when(method == "merge", "join").when(method.isin("groupby", "sum", "mean", "count"), "aggregation").otherwise("selection")


def column_mapping(inputs: list[tuple[str, list[str]]], outputs: list[str], target: str) -> dict[str, list[str]]:
    """An output column comes from the columns of its name in any of the inputs (frame, columns), or else from all of them."""
    every = [f"{frame}.{c}" for frame, columns in inputs for c in columns]
    named = {o: [f"{frame}.{o}" for frame, columns in inputs if o in columns] for o in outputs}
    return {f"{target}.{o}": named[o] or every for o in outputs}


@dataclass
class Tracked:
    result: DataFrame
    events: DataFrame
    observation: Observation | None = None


@dataclass(frozen=True)
class Place:
    """Where an operation ran: what every event of it tells."""

    execution_id: str = "00000000"
    cell_id: str = "cell"
    session_id: str = "00000000"


HERE = Place()


def _stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _event(method: str, parameters: dict, inputs: list[tuple[str, DataFrame]], output: tuple[str, DataFrame], observe: bool, place: Place, code: str) -> Tracked:
    name, result = output

    def info(name: str, df: DataFrame) -> DataFrame:  # counts alone, so that no column is read
        shape = F.array(F.count("*"), F.lit(len(df.columns)).cast("long")).alias("shape")
        return df.agg(shape).select(F.struct(F.lit(name).alias("variable_name"), "shape", F.array(*map(F.lit, df.columns)).alias("columns")).alias("f"))

    sides = [info(n, df).select(F.array("f").alias(f"i{k}")) for k, (n, df) in enumerate(inputs)]
    row = info(name, result).select(F.array("f").alias("output_dataframes"))
    for side in sides:
        row = row.join(F.broadcast(side))  # each side is one row of counts
    columns = [c for _, df in inputs for c in df.columns]
    mapping = column_mapping([(n, df.columns) for n, df in inputs], result.columns, name)
    plain = F.to_json(F.struct(*(F.array(*map(F.lit, v)).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in parameters.items())))
    now = _stamp(F.current_timestamp())
    events = row.select(
        F.lit("dataframe_lineage").alias("event_type"), F.lit(place.execution_id).alias("execution_id"), F.lit(place.cell_id).alias("cell_id"), F.lit(place.session_id).alias("session_id"), now.alias("timestamp"), now.alias("emitted_at"),
        F.lit(TYPES[method]).alias("operation_type"), F.lit(method).alias("operation_method"), F.lit(code).alias("operation_code"), F.parse_json(plain).alias("operation_parameters"),
        F.concat(*(f"i{k}" for k in range(len(inputs)))).alias("input_dataframes"), "output_dataframes",
        F.struct(F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), F.array(*map(F.lit, v))))).alias("column_mapping"), F.array(*map(F.lit, columns)).alias("input_columns"), F.array(*map(F.lit, result.columns)).alias("output_columns"), F.lit(method).alias("operation_method"), F.lit(TYPES[method]).alias("lineage_type")).alias("column_lineage"),
    )
    if not observe:
        return Tracked(result, events)
    seen = Observation(name)
    return Tracked(result.observe(seen, F.count(F.lit(1)).alias("rows")), events, seen)


#: Bytes of values of a fixed width.
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def frame_info(df: DataFrame, name: str) -> DataFrame:
    """One row: variable_name, object_id (of its schema and name), shape, columns and memory_usage_mb, an estimate: widths of fixed types (nulls too), bytes of texts, and bytes as JSON of all else. Reads all columns."""

    def size(field) -> Column:
        kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in _WIDTH:
            return F.lit(_WIDTH[kind])
        text = c if kind in ("string", "binary") else F.to_json(F.struct(c))
        return F.coalesce(F.octet_length(text), F.lit(0))

    row = F.lit(0).cast("long")
    for field in df.schema:
        row = row + size(field)
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes"))
    identity = F.substring(F.sha2(F.concat_ws(",", F.lit(name), F.lit(df.schema.simpleString())), 256), 1, 16)
    return found.select(F.lit(name).alias("variable_name"), identity.alias("object_id"), F.array("n", F.lit(len(df.columns)).cast("long")).alias("shape"), F.array(*map(F.lit, df.columns)).alias("columns"), (F.col("bytes") / 1048576.0).alias("memory_usage_mb"))


def lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines, as the log has them: value."""
    return events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def track_select(df: DataFrame, columns: list[str], name: str = "df", out: str = "out", observe: bool = False, place: Place = HERE) -> Tracked:
    return _event("__getitem__", {"columns": columns}, [(name, df)], (out, df.select(columns)), observe, place, f"{name}[{columns}]")


def track_filter(df: DataFrame, condition: str, name: str = "df", out: str = "out", observe: bool = False, place: Place = HERE) -> Tracked:
    return _event("__getitem__", {"condition": condition, "is_boolean_mask": True}, [(name, df)], (out, df.where(condition)), observe, place, f"{name}[{condition}]")


def track_group(df: DataFrame, by: list[str], how: str, columns: list[str], name: str = "df", out: str = "out", observe: bool = False, place: Place = HERE) -> Tracked:
    """how: sum, mean or count."""
    made = {"sum": F.sum, "mean": F.avg, "count": F.count}[how]
    return _event(how, {"columns": by}, [(name, df)], (out, df.groupBy(by).agg(*(made(c).alias(c) for c in columns))), observe, place, f"{name}.groupby({by})[{columns}].{how}()")


def track_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", names: tuple[str, str] = ("left", "right"), out: str = "out", observe: bool = False, place: Place = HERE) -> Tracked:
    return _event("merge", {"how": how, "on": on}, [(names[0], left), (names[1], right)], (out, left.join(right, on, how)), observe, place, f"{names[0]}.merge({names[1]}, on={on!r}, how={how!r})")


def track_with_column(df: DataFrame, column: str, value: Column, name: str = "df", out: str = "out", observe: bool = False, place: Place = HERE) -> Tracked:
    """The event tells the type of the value, too. (The list of methods has none for setting a column: it is a selection.)"""
    made = df.withColumn(column, value)
    kind = made.schema[column].dataType.simpleString()
    return _event("__getitem__", {"columns": [column], "value_type": kind}, [(name, df)], (out, made), observe, place, f"{name}[{column!r}] = {kind}")


def dataset(df: DataFrame, name: str, namespace: str = "spark") -> Column:
    """A dataset with its schema facet."""
    fields = F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema))
    schema = F.struct(F.lit(PRODUCER).alias("_producer"), F.lit(SCHEMA_URL).alias("_schemaURL"), fields.alias("fields"))
    return F.struct(F.lit(namespace).alias("namespace"), F.lit(name).alias("name"), F.struct(schema.alias("schema")).alias("facets"))


#: Facets that a job may have; others are left out.
JOB_FACETS = ("cell_id", "cell_source", "termination_reason", "failure_context", "modification_type", "key", "value_type", "test_field", "custom_field", "abortion_context")


def run_event(state: str, run_id: Column, job: str, inputs: list[Column], outputs: list[Column], time: Column, place: Place = HERE, elapsed_ms: Column | None = None, error: Column | None = None, job_facets: dict[str, Column] | None = None) -> Column:
    """An OpenLineage run event as JSON: START, COMPLETE, ABORT or FAIL, with the execution and session it belongs to, how long it took, facets of its job (texts, of JOB_FACETS), and an error only where it failed or was aborted. A failed run gives the outputs it had made."""
    made = F.lit(PRODUCER).alias("_producer")
    facets = [F.struct(made, F.lit(place.execution_id).alias("executionId"), F.lit(place.session_id).alias("sessionId")).alias("marimoExecution")]
    if elapsed_ms is not None:
        facets.append(F.struct(made, elapsed_ms.cast("double").alias("durationMs")).alias("performance"))
    if error is not None and state in ("FAIL", "ABORT"):
        facets.append(F.struct(made, error.alias("message"), F.lit("python").alias("programmingLanguage")).alias("errorMessage"))
    some = lambda x: F.array(*x) if x else F.array().cast("array<struct<name:string>>")
    told = [(k, c.cast("string")) for k, c in (job_facets or {}).items() if k in JOB_FACETS]
    facet = F.create_map(*(x for k, c in told for x in (F.lit(k), c))) if told else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    job_ = F.struct(F.lit("spark").alias("namespace"), F.lit(job).alias("name"), facet.alias("facets"))
    event = F.struct(
        F.lit(state).alias("eventType"), _stamp(time).alias("eventTime"), F.struct(run_id.alias("runId"), F.struct(*facets).alias("facets")).alias("run"), job_.alias("job"), some(inputs).alias("inputs"), some(outputs).alias("outputs"),
        F.lit(PRODUCER).alias("producer"), F.lit(SCHEMA_URL).alias("schemaURL"), F.lit(place.session_id).alias("session_id"), _stamp(F.current_timestamp()).alias("emitted_at"),
    )
    return F.to_json(event, {"ignoreNullFields": "true"})


def track_source(df: DataFrame, name: str, place: Place = HERE) -> tuple[DataFrame, DataFrame]:
    """A new frame (T1): itself, and its START event as a line (value), whose run has a random id and whose output is the frame."""
    line = run_event("START", F.expr("uuid()"), f"create_{name}", [], [dataset(df, name)], F.current_timestamp(), place)
    return df, df.sparkSession.range(1).select(line.alias("value"))


def set_column(df: DataFrame, column: str, value: Column, name: str, place: Place = HERE) -> tuple[DataFrame, DataFrame]:
    """A frame with a column set (T2): itself, and its COMPLETE event as a line (value), with the column's name and the type of its values as facets of the job."""
    made = df.withColumn(column, value)
    facets = {"modification_type": F.lit("set_column"), "key": F.lit(column), "value_type": F.lit(made.schema[column].dataType.simpleString())}
    line = run_event("COMPLETE", F.expr("uuid()"), f"modify_{name}", [dataset(df, name)], [dataset(made, name)], F.current_timestamp(), place, job_facets=facets)
    return made, df.sparkSession.range(1).select(line.alias("value"))


def sampled(df: DataFrame, key: str, megabytes: float, limit: float = 10.0, percent: int = 10) -> DataFrame:
    """Frames above the size limit are sampled by hash of a key, the same rows each time and on any engine that has MD5; sampled says so."""
    large = megabytes > limit
    drawn = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    rows = df.where(drawn < percent) if large else df
    return rows.withColumn("sampled", F.lit(large))
