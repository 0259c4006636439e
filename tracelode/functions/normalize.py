"""Valid events to typed rows of the three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settled
from .rules import in_order
from .scalars import null_if_empty, parse_time

UUID = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def get(path: str, kind: str = "string", v: Column | None = None) -> Column:
    return F.try_variant_get(F.col("v") if v is None else v, f"$.{path}", kind)


def as_json(v: Column) -> Column:
    return null_if_empty(F.to_json(v))


def sub_json(path: str) -> Column:
    return as_json(get(path, "variant"))


def _runtime_columns() -> dict[str, Column]:
    return {
        **{c: get(c) for c in ("event_type", "execution_id", "cell_id", "cell_source")}, "cell_source_lines": get("cell_source_lines", "int"), **{c: get(c, "double") for c in ("start_memory_mb", "end_memory_mb", "duration_ms")},
        "timestamp": parse_time(get("timestamp")), "session_id": get("session_id"), "emitted_at": parse_time(get("emitted_at")), "error_info": sub_json("error_info"),
    }


def _by_name(entries: Column) -> Column:
    """Output name to one of its facets, from (name, facet) of each output that has it; a later one of the same name wins."""
    # An array of one array, so that the lambda below stands for entries made once.
    last = F.transform(F.array(entries), lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["name"] == x["name"])))
    return null_if_empty(F.to_json(F.map_from_entries(F.get(last, F.lit(0)))))


def _facet_map(facet: str) -> Column:
    """An output without a name is "unknown"."""
    outs = F.coalesce(get("outputs", "array<variant>"), F.array().cast("array<variant>"))
    having = F.filter(outs, lambda o: get(f"facets.{facet}", "variant", o).isNotNull())
    return _by_name(F.transform(having, lambda o: F.struct(F.coalesce(get("name", "string", o), F.lit("unknown")).alias("name"), get(f"facets.{facet}", "variant", o).alias("facet"))))


def _other_facets() -> Column:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    run = F.coalesce(get("run.facets", "map<string,variant>"), empty)
    job = F.coalesce(get("job.facets", "map<string,variant>"), empty)
    run = F.map_filter(run, lambda k, _: ~k.isin("marimoExecution", "performance"))
    named = lambda m, prefix: F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k))
    return null_if_empty(F.to_json(F.map_concat(named(run, "run."), named(job, "job."))))


def _lineage_columns(session_fallback: bool = False, metrics_facet: str = "dataQualityMetrics") -> dict[str, Column]:
    nested = get("run", "variant").isNotNull() & get("job", "variant").isNotNull()
    both = lambda path, flat, kind="string": F.when(nested, get(path, kind)).otherwise(get(flat, kind))
    session = both("run.facets.marimoExecution.sessionId", "session_id")
    return {
        "run_id": both("run.runId", "run_id"), "execution_id": both("run.facets.marimoExecution.executionId", "execution_id"), "event_type": get("eventType"),
        "job_name": both("job.name", "job_name"), "event_time": parse_time(get("eventTime")), "duration_ms": both("run.facets.performance.durationMs", "duration_ms", "double"),
        "session_id": F.coalesce(session, get("session_id")) if session_fallback else session, "emitted_at": parse_time(get("emitted_at")),
        "inputs_json": sub_json("inputs"), "outputs_json": sub_json("outputs"), "column_lineage_json": _facet_map("columnLineage"), "column_metrics_json": _facet_map(metrics_facet), "other_facets_json": _other_facets(),
    }


def _frame_columns() -> dict[str, Column]:
    return {
        **{c: get(c) for c in ("event_type", "execution_id", "cell_id", "session_id")}, **{c: parse_time(get(c)) for c in ("timestamp", "emitted_at")},
        **{c: get(c) for c in ("operation_type", "operation_method", "operation_code")}, **{c: sub_json(c) for c in ("operation_parameters", "input_dataframes", "output_dataframes", "column_lineage")},
        "overhead_ms": get("performance.overhead_ms", "double"), "df_size_mb": get("performance.df_size_mb", "double"), "sampled": get("performance.sampled", "boolean"),
    }


def _rows(events: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    return events.select(F.col("key").alias(key), *(c.alias(name) for name, c in columns.items()))


def runtime_rows(events: DataFrame) -> DataFrame:
    """events: key and v."""
    return _rows(events, "event_id", _runtime_columns())


def lineage_rows(events: DataFrame, session_fallback: bool = False, metrics_facet: str = "dataQualityMetrics") -> DataFrame:
    return _rows(events, "ol_event_id", _lineage_columns(session_fallback, metrics_facet))


def frame_rows(events: DataFrame) -> DataFrame:
    return _rows(events, "df_event_id", _frame_columns())


def unique(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key comes first by `order`, the others): the unique key of a table. A null key is no key and stays. Exactly one row of each key is kept: of rows alike in `order` one by what else it holds, and of rows alike in everything any.

    The first of each key is found by an aggregation, which is partial before its shuffle; no key's rows are brought together to be sorted. Rows are written once with a number each, so that a task that runs again numbers nothing anew."""
    told = settled(rows.withColumn("_rank", F.struct(F.col(order).alias("o"), F.xxhash64(F.to_json(F.struct(*rows.columns))).alias("h"), F.monotonically_increasing_id().alias("n"))), "unique")
    first = told.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("_rank")["n"].alias("_first"))
    marked = told.join(first, F.col(key) == F.col("_k"), "left").withColumn("_keep", F.coalesce(F.col("_rank")["n"] == F.col("_first"), F.lit(True)))
    return marked.where("_keep").select(rows.columns), marked.where("NOT _keep").select(rows.columns)


ROWS = {"runtime": runtime_rows, "lineage": lineage_rows, "dataframe_lineage": frame_rows}


# The same rows from lines that are valid at first sight, whose fields are known and typed in _first: name of a column to its value.

def _sub_read(kind: str, name: str) -> Column:
    return as_json(F.expr(in_order(kind, "_first", name)))


def _runtime_read() -> dict[str, Column]:
    r, plain = F.col("_first"), ("event_type", "execution_id", "cell_id", "cell_source", "start_memory_mb", "end_memory_mb", "duration_ms", "session_id")
    return {c: r[c] for c in plain} | {"cell_source_lines": r["cell_source_lines"].try_cast("int"), "error_info": _sub_read("runtime", "error_info")} | {c: parse_time(r[c]) for c in ("timestamp", "emitted_at")}


def _lineage_read() -> dict[str, Column]:
    r = F.col("_first")
    facets, job = r["run"]["facets"], r["job"]["facets"]

    def of_outputs(facet: str) -> Column:
        ordered = in_order("lineage", "o", "outputs", "[]", "facets", facet)
        return _by_name(F.expr(f"transform(filter(_first.outputs, o -> o.facets.{facet} IS NOT NULL), o -> named_struct('name', o.name, 'facet', {ordered}))"))

    return {
        "run_id": r["run"]["runId"], "execution_id": facets["marimoExecution"]["executionId"], "event_type": r["eventType"], "job_name": r["job"]["name"], "event_time": parse_time(r["eventTime"]),
        "duration_ms": F.try_variant_get(facets["performance"]["durationMs"], "$", "double"), "session_id": facets["marimoExecution"]["sessionId"], "emitted_at": parse_time(r["emitted_at"]),
        "inputs_json": _sub_read("lineage", "inputs"), "outputs_json": _sub_read("lineage", "outputs"), "column_lineage_json": of_outputs("columnLineage"), "column_metrics_json": of_outputs("dataQualityMetrics"),
        "other_facets_json": null_if_empty(F.to_json(F.transform_keys(F.try_variant_get(job, "$", "map<string,variant>"), lambda k, _: F.concat(F.lit("job."), k)))),
    }


def _frame_read() -> dict[str, Column]:
    r, plain = F.col("_first"), ("event_type", "execution_id", "cell_id", "session_id", "operation_type", "operation_method", "operation_code")
    nested = ("operation_parameters", "input_dataframes", "output_dataframes", "column_lineage")
    return {c: r[c] for c in plain} | {c: _sub_read("dataframe_lineage", c) for c in nested} | {c: parse_time(r[c]) for c in ("timestamp", "emitted_at")} | {c: r["performance"][c] for c in ("overhead_ms", "df_size_mb", "sampled")}


#: By kind: the key's name, columns from v, and columns from a line's fields.
_COLUMNS = {"runtime": ("event_id", _runtime_columns, _runtime_read), "lineage": ("ol_event_id", _lineage_columns, _lineage_read), "dataframe_lineage": ("df_event_id", _frame_columns, _frame_read)}


def rows_of(events: DataFrame, kind: str) -> DataFrame:
    """Typed rows of events: of key and v, or, where jsonl.looked has told lines that are valid at first sight, of key, _first and _v."""
    if "_first" not in events.columns:
        return ROWS[kind](events)
    key, parsed, read = _COLUMNS[kind]
    known = read()
    return _rows(events.select("key", "_first", F.col("_v").alias("v")), key, {name: F.when(F.col("_first").isNull(), c).otherwise(known[name]) for name, c in parsed().items()})


#: Columns that a stored row must have.
NOT_NULL = {"runtime": (), "lineage": (), "dataframe_lineage": ("event_type", "execution_id", "cell_id", "session_id", "timestamp", "emitted_at", "operation_type", "operation_method", "input_dataframes", "output_dataframes")}


def constraint(kind: str) -> Column:
    """What a typed row breaks of its table's constraints: the first of not_null:column and cast:run_id, or null."""
    broken = F.lit(None).cast("string")
    for column in reversed(NOT_NULL[kind]):
        broken = F.when(F.col(column).isNull(), f"not_null:{column}").otherwise(broken)
    if kind == "lineage":
        broken = F.when(~F.col("run_id").rlike(UUID), "cast:run_id").otherwise(broken)
    return broken
