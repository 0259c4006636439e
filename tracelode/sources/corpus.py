"""Event lines derived from the driver's tables, with planted defects, as DataFrames of key and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import PRODUCER


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """Rows dealt over all tasks: making and checking a line costs far more than moving its few columns, and the driver's tables are single files. by: the time in whose order each task writes its log; few columns are sorted here, not lines."""
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt if by is None else dealt.sortWithinPartitions(by)


def hex8(n: str) -> str:
    return f"format_string('%08x', {n})"


def iso(column: str) -> str:
    return f"date_format({column}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"


_SILENT = {"ignoreNullFields": "true"}


def runtime_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events an execution. Defects by modulus of event_id, the first wins: 97 cut, 89 no cell_id, 83 one field more, 79 bad id, 73 bad type, 71 no lines."""
    e = spread(load(spark, sf_dir, "events"), "ts").withColumn("t", F.expr(iso("ts")))
    defect = F.expr("CASE WHEN event_id % 97 = 0 THEN 97 WHEN event_id % 89 = 0 THEN 89 WHEN event_id % 83 = 0 THEN 83 WHEN event_id % 79 = 0 THEN 79 WHEN event_id % 73 = 0 THEN 73 WHEN event_id % 71 = 0 THEN 71 ELSE 0 END")
    e = e.withColumn("d", defect).withColumn("odd", F.expr("event_id % 2 = 1"))
    body = F.struct(
        F.expr("CASE WHEN d = 73 THEN 'cell_paused' WHEN NOT odd THEN 'cell_execution_start' WHEN event_type = 'error' THEN 'cell_execution_error' ELSE 'cell_execution_end' END").alias("event_type"),
        F.expr(f"CASE WHEN d = 79 THEN 'XYZ' ELSE {hex8('event_id div 2')} END").alias("execution_id"),
        F.expr("CASE WHEN d <> 89 THEN concat('cell_', user_id % 20) END").alias("cell_id"), F.expr("concat('x = ', event_id)").alias("cell_source"),
        F.expr("CASE WHEN d = 71 THEN 0 ELSE 1 + event_id % 5 END").alias("cell_source_lines"), F.expr("100.0D + event_id % 64").alias("start_memory_mb"),
        F.expr("CASE WHEN odd THEN 100.0D + event_id % 64 + event_id % 17 END").alias("end_memory_mb"), F.expr("CASE WHEN odd THEN round(value * 10, 3) END").alias("duration_ms"),
        F.col("t").alias("timestamp"), F.expr(hex8("user_id")).alias("session_id"), F.col("t").alias("emitted_at"),
        F.expr("CASE WHEN odd AND event_type = 'error' THEN named_struct('error_type', concat('E', user_id % 3), 'error_message', concat('failed ', event_id), 'traceback', 'at 1') END").alias("error_info"),
        F.expr("CASE WHEN d = 83 THEN 1 END").alias("surplus"),
    )
    line = F.to_json(body, _SILENT)
    return e.select(F.col("event_id").alias("key"), F.when(F.col("d") == 97, F.substring(line, 1, 40)).otherwise(line).alias("value"))


def lineage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run an order. Defects: modulus 67 a run id that is no UUID, 61 a foreign producer, 11 (kept) no outputs."""
    o = spread(load(spark, sf_dir, "orders"), "o_orderdate").withColumn("t", F.expr(iso("o_orderdate"))).withColumn("m", F.expr("md5(cast(o_orderkey as string))"))
    uuid = "concat_ws('-', substring(m, 1, 8), substring(m, 9, 4), substring(m, 13, 4), substring(m, 17, 4), substring(m, 21, 12))"
    made = f"'_producer', '{PRODUCER}', '_schemaURL', 'u'"
    source = f"named_struct('namespace', 'db', 'name', concat('customer_', o_custkey % 40), 'facets', named_struct('schema', named_struct({made}, 'fields', array(named_struct('name', 'c_custkey', 'type', 'long'), named_struct('name', 'c_name', 'type', 'string')))))"
    second = "named_struct('namespace', 'db', 'name', concat('part_', o_orderkey % 30), 'facets', cast(null as struct<schema:struct<_producer:string,_schemaURL:string,fields:array<struct<name:string,type:string>>>>))"
    target = f"named_struct('namespace', 'db', 'name', concat('order_', o_orderkey % 50), 'facets', named_struct('columnLineage', named_struct({made}, 'fields', map('total', named_struct('inputFields', array(named_struct('namespace', 'db', 'name', concat('customer_', o_custkey % 40), 'field', 'c_custkey'))))), 'dataQualityMetrics', named_struct('columnMetrics', map('total', named_struct('nullCount', o_orderkey % 7, 'distinctCount', o_orderkey % 100)))))"
    body = F.struct(
        F.expr("element_at(array('START', 'COMPLETE', 'COMPLETE', 'FAIL'), cast(o_orderkey % 4 as int) + 1)").alias("eventType"), F.col("t").alias("eventTime"),
        F.expr(f"named_struct('runId', CASE WHEN o_orderkey % 67 = 0 THEN substring(m, 1, 8) ELSE {uuid} END, 'facets', named_struct('marimoExecution', CASE WHEN o_orderkey % 9 <> 0 THEN named_struct('_producer', 'p', 'executionId', {hex8('o_orderkey % 4096')}, 'sessionId', {hex8('o_custkey % 64')}) END, 'performance', named_struct('_producer', 'p', 'durationMs', o_orderkey % 3000), 'extra', CASE WHEN o_orderkey % 13 = 0 THEN named_struct('x', 1) END))").alias("run"),
        F.expr("named_struct('namespace', 'n', 'name', concat('job_', substring(o_orderpriority, 1, 1)))").alias("job"),
        F.expr(f"CASE WHEN o_orderkey % 3 = 0 THEN array({source}, {second}) ELSE array({source}) END").alias("inputs"),
        F.expr(f"CASE WHEN o_orderkey % 11 = 0 THEN slice(array({target}), 1, 0) ELSE array({target}) END").alias("outputs"),
        F.expr(f"CASE WHEN o_orderkey % 61 = 0 THEN 'other' ELSE '{PRODUCER}' END").alias("producer"), F.lit("u").alias("schemaURL"), F.lit("s").alias("session_id"), F.col("t").alias("emitted_at"),
    )
    return o.select(F.col("o_orderkey").alias("key"), F.to_json(body, _SILENT).alias("value"))


def frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation a customer. Defects: modulus 53 a method outside the list, 59 no output (breaks a table constraint), 47 a time that is no time (likewise)."""
    c = spread(load(spark, sf_dir, "customer"), "c_custkey")
    method = "element_at(array('__getitem__', 'groupby', 'sum', 'mean', 'count', 'merge'), cast(c_custkey % 6 as int) + 1)"
    frame = lambda name, rows, columns: f"named_struct('variable_name', {name}, 'shape', array({rows}, size({columns})), 'columns', {columns})"
    source = frame("concat('df', c_nationkey)", "c_custkey % 500", "array('id', 'name', 'value')")
    target = frame("concat('out', c_nationkey)", "c_custkey % 500 div 2", "array('id', 'value')")
    body = F.struct(
        F.lit("dataframe_lineage").alias("event_type"), F.expr(hex8("c_custkey % 4096")).alias("execution_id"), F.expr("concat('cell_', c_custkey % 20)").alias("cell_id"), F.expr(hex8("c_nationkey")).alias("session_id"),
        F.expr("CASE WHEN c_custkey % 47 = 0 THEN 'never' ELSE cast(1700000000 + c_custkey as string) END").alias("timestamp"), F.lit("2024-01-01T00:00:00Z").alias("emitted_at"),
        F.expr("CASE WHEN c_custkey % 6 = 0 THEN 'selection' WHEN c_custkey % 6 = 5 THEN 'join' ELSE 'aggregation' END").alias("operation_type"), F.expr(f"CASE WHEN c_custkey % 53 = 0 THEN 'groupby.sum' ELSE {method} END").alias("operation_method"),
        F.lit("df[...]").alias("operation_code"), F.expr("named_struct('columns', array('id', 'value'))").alias("operation_parameters"),
        F.expr(f"array({source})").alias("input_dataframes"), F.expr(f"CASE WHEN c_custkey % 59 = 0 THEN slice(array({target}), 1, 0) ELSE array({target}) END").alias("output_dataframes"),
        F.expr("named_struct('column_mapping', map(concat('out', c_nationkey, '.value'), array(concat('df', c_nationkey, '.value'), concat('df', c_nationkey, '.id'))), 'input_columns', array('id', 'name', 'value'), 'output_columns', array('id', 'value'), 'operation_method', 'sum', 'lineage_type', 'aggregation')").alias("column_lineage"),
        F.expr("named_struct('overhead_ms', (c_custkey % 40) / 8.0D, 'df_size_mb', (c_custkey % 16) / 4.0D, 'sampled', c_custkey % 2 = 0)").alias("performance"),
    )
    return c.select(F.col("c_custkey").alias("key"), F.to_json(body, _SILENT).alias("value"))


def chained_frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made of frames: that of customer c is read into that of c div 3 and, for an even c, also into that of c div 5 (which takes its ids, too)."""
    c = spread(load(spark, sf_dir, "customer")).where("c_custkey > 0").withColumn("step", F.explode(F.expr("IF(c_custkey % 2 = 0, array(3, 5), array(3))"))).withColumn("to", F.expr("c_custkey div step"))
    frame = lambda name, rows: f"named_struct('variable_name', {name}, 'shape', array({rows}, 2), 'columns', array('id', 'value'))"
    source, target = "concat('f', c_custkey)", "concat('f', to)"
    body = F.struct(
        F.lit("dataframe_lineage").alias("event_type"), F.expr(hex8("c_custkey % 4096")).alias("execution_id"), F.lit("cell_1").alias("cell_id"), F.expr(hex8("c_nationkey")).alias("session_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("2024-01-01T00:00:00Z").alias("emitted_at"),
        F.lit("selection").alias("operation_type"), F.lit("__getitem__").alias("operation_method"), F.lit("df[...]").alias("operation_code"), F.expr("named_struct('columns', array('id', 'value'))").alias("operation_parameters"),
        F.expr(f"array({frame(source, '100 + c_custkey % 400')})").alias("input_dataframes"), F.expr(f"array({frame(target, '(100 + c_custkey % 400) div (step - 1)')})").alias("output_dataframes"),
        F.expr(f"named_struct('column_mapping', map(concat({target}, '.value'), IF(step = 5, array(concat({source}, '.value'), concat({source}, '.id')), array(concat({source}, '.value')))), 'input_columns', array('id', 'value'), 'output_columns', array('id', 'value'), 'operation_method', '__getitem__', 'lineage_type', 'selection')").alias("column_lineage"),
        F.expr("named_struct('overhead_ms', (c_custkey % 40) / 8.0D, 'df_size_mb', 1.0D, 'sampled', false)").alias("performance"),
    )
    return c.select(F.expr("c_custkey * 10 + step").alias("key"), F.to_json(body, _SILENT).alias("value"))


def chained_run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets made of datasets: that of part p goes into that of p div 2; every tenth is made of the frame of customer p div 10, too."""
    p = spread(load(spark, sf_dir, "part")).where("p_partkey > 0").withColumn("m", F.expr("md5(cast(p_partkey as string))"))
    uuid = "concat_ws('-', substring(m, 1, 8), substring(m, 9, 4), substring(m, 13, 4), substring(m, 17, 4), substring(m, 21, 12))"
    own, frame, into = "concat('s', p_partkey)", "concat('f', p_partkey div 10)", "concat('s', p_partkey div 2)"
    dataset = lambda name: f"named_struct('namespace', 'db', 'name', {name})"
    field = lambda name, column: f"named_struct('namespace', 'db', 'name', {name}, 'field', '{column}')"
    fields = f"map('total', named_struct('inputFields', IF(p_partkey % 10 = 0, array({field(own, 'total')}, {field(frame, 'value')}), array({field(own, 'total')}))), 'key', named_struct('inputFields', array({field(own, 'key')})))"
    body = F.struct(
        F.lit("COMPLETE").alias("eventType"), F.lit("2024-01-01T00:00:00Z").alias("eventTime"), F.expr(f"named_struct('runId', {uuid})").alias("run"), F.expr("named_struct('namespace', 'n', 'name', 'chain')").alias("job"),
        F.expr(f"IF(p_partkey % 10 = 0, array({dataset(own)}, {dataset(frame)}), array({dataset(own)}))").alias("inputs"),
        F.expr(f"array(named_struct('namespace', 'db', 'name', {into}, 'facets', named_struct('columnLineage', named_struct('_producer', '{PRODUCER}', '_schemaURL', 'u', 'fields', {fields}))))").alias("outputs"),
        F.lit(PRODUCER).alias("producer"), F.lit("u").alias("schemaURL"), F.lit("s").alias("session_id"), F.lit("2024-01-01T00:00:00Z").alias("emitted_at"),
    )
    return p.select(F.col("p_partkey").alias("key"), F.to_json(body, _SILENT).alias("value"))


LINES = {"runtime": runtime_lines, "lineage": lineage_lines, "dataframe_lineage": frame_lines}
