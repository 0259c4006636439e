"""Read-only SQL: an audit of query texts as columns, and guarded execution."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import excerpt
from ..plans.scratch import settled

# Forbidden words, allowed tables, and patterns that are refused wherever they stand.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "MERGE", "REPLACE", "EXEC", "EXECUTE", "CALL", "LOAD", "INSTALL", "SET", "PRAGMA", "ATTACH", "DETACH", "COPY")
TABLES = ("runtime_events", "lineage_events", "dataframe_lineage_events", "vw_lineage_io", "vw_performance_metrics", "vw_dataframe_lineage")
DANGEROUS = (
    "--", "/*", "*/", "xp_", "sp_", "exec(", "execute(", "union select", "drop table", "delete from", "update set", "insert into", "create table", "alter table", "truncate table", "load_extension(",
    "system(", "load_file(", "file_read(", "file_write(", "shell(", "cmd(", "command(", "subprocess(", "into outfile", "into dumpfile", "load data", "backup", "restore", "copy to", "copy from", "bulk insert",
)
MOST_ROWS = 1000


#: Functions that run code of the machine; data needs none of them.
REFLECTION = ("reflect", "try_reflect", "java_method")
#: Words at which a list of tables ends.
_ENDS = "from|join|where|group|order|having|limit|offset|on|using|union|intersect|except|minus|window|qualify|lateral|tablesample|pivot|unpivot|select|sort|cluster|distribute|natural|left|right|inner|full|cross|semi|anti"
_DEPTH = 12


def _once(value: Column, f) -> Column:
    """f of a value that is made once, however often f names it, and only where the whole is asked for."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tables_read(text: Column) -> Column:
    """What stands where a query names tables, in lower case, as an array; "?" for what can't be read with certainty.

    Texts in quotes vanish and plain names lose their back-ticks. Then brackets are taken off from the innermost: a subquery is kept to be read and
    leaves a mark that may stand for a table, any other bracket leaves one that may not. What is left has no brackets, so its lists after FROM and JOIN
    end at the next clause, and their members are told apart by commas."""
    low = F.lower(text)
    bare = F.regexp_replace(low, r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`([a-z_][a-z0-9_]*)`""", "$1")

    def off(acc: Column, _: Column) -> Column:
        inner = F.regexp_extract_all(acc["text"], F.lit(r"\(\s*(select\b[^()]*)\)"), F.lit(1))
        left = F.regexp_replace(F.regexp_replace(acc["text"], r"\(\s*select\b[^()]*\)", " \u00a7 "), r"\([^()]*\)", " \u00a4 ")
        return F.when(F.contains(acc["text"], F.lit("(")), F.struct(left.alias("text"), F.concat(acc["queries"], inner).alias("queries"))).otherwise(acc)

    def members(query: Column) -> Column:
        lists = F.regexp_extract_all(query, F.lit(rf"(?s)\b(?:from|join)\b(.*?)(?=\b(?:{_ENDS})\b|;|$)"), F.lit(1))
        return F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda y: F.coalesce(F.nullif(F.regexp_extract(F.trim(F.translate(y, "\n\t\r", "   ")), r"^(\S+)", 1), F.lit("")), F.lit("?")))))

    start = F.struct(bare.alias("text"), F.array().cast("array<string>").alias("queries"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(_DEPTH)), start, off, lambda acc: F.concat(F.flatten(F.transform(F.array_append(acc["queries"], acc["text"]), members)), F.when(acc["text"].rlike(r"[()`'\"]|\btable\b"), F.array(F.lit("?"))).otherwise(F.array().cast("array<string>"))))
    # Raw texts escape nothing, so their ends can't be told from here.
    return F.filter(F.when(low.rlike(r"\br['\"]"), F.array(F.lit("?"))).otherwise(found), lambda t: t != "\u00a7")


def audit(text: Column) -> Column:
    """verdict (valid, empty, not_select, dangerous_pattern, forbidden_operation, unauthorized_table), what was matched ("?": tables that can't be read), and an excerpt."""
    said = lambda verdict, matched=None: F.struct(F.lit(verdict).alias("verdict"), (F.lit(None).cast("string") if matched is None else matched).alias("matched"))
    first = lambda x: F.get(x, F.lit(0))

    def tables(_: Column) -> Column:
        return _once(first(F.array_except(tables_read(text), F.array(*map(F.lit, TABLES)))), lambda x: F.when(x.isNotNull(), said("unauthorized_table", x)).otherwise(said("valid")))

    def words(low: Column) -> Column:
        bare = F.regexp_replace(low, r"'(?:[^']|'')*'", "''")
        found = F.filter(F.regexp_extract_all(bare, F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)), lambda w: w.isin([*(x.lower() for x in FORBIDDEN), *REFLECTION]))
        return _once(first(found), lambda x: F.when(x.isNotNull(), said("forbidden_operation", x)).otherwise(tables(low)))

    def judged(low: Column) -> Column:
        pattern = F.filter(F.array(*map(F.lit, DANGEROUS)), lambda p: F.contains(low, p))
        rest = _once(first(pattern), lambda x: F.when(x.isNotNull(), said("dangerous_pattern", x)).otherwise(words(low)))
        return F.when(low == "", said("empty")).when(~low.startswith("select"), said("not_select")).otherwise(rest)

    def whole(a: Column) -> Column:
        advice = F.when(a["verdict"] == "valid", None).when(a["verdict"] == "not_select", "Start with SELECT.").when(a["verdict"] == "unauthorized_table", "Use a table of the catalogue.").otherwise("Ask for data only.")
        return F.struct(a["verdict"].alias("verdict"), a["matched"].alias("matched"), advice.alias("suggestion"), excerpt(F.trim(text)).alias("excerpt"))

    return _once(_once(F.lower(F.trim(text)), judged), whole)


def syntax_report(text: Column) -> Column:
    """valid, issues and suggestions (lists), the query and its excerpt."""
    one = lambda x: F.filter(F.array(x), lambda y: y.isNotNull())

    def report(a: Column) -> Column:
        issue = F.when(a["verdict"] != "valid", F.concat_ws(": ", a["verdict"], a["matched"]))
        return F.struct((a["verdict"] == "valid").alias("valid"), one(issue).alias("issues"), one(a["suggestion"]).alias("suggestions"), text.alias("query"), a["excerpt"].alias("query_excerpt"))

    return _once(audit(text), report)


def limit_of(text: str, limit: int) -> int | None:
    """The limit to append: none if the text has its own or the limit isn't positive; at most MOST_ROWS."""
    return None if "limit" in text.lower() or limit <= 0 else min(limit, MOST_ROWS)


def limit_column(text: Column, limit: Column) -> Column:
    """limit_of for a table of texts and limits: null where none is appended."""
    return F.when(~F.lower(text).contains("limit") & (limit > 0), F.least(limit, F.lit(MOST_ROWS)))


def relations(query: DataFrame) -> set[str]:
    """Tables and table functions that a query names, in lower case, as Spark's parser has read them: in subqueries, joins and lists, whatever the spelling.

    They are taken from the parsed plan that explain() shows. A text in the query that looks like a part of a plan can add names, but hide none."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        query.explain(extended=True)
    parsed = out.getvalue().split("== Analyzed Logical Plan ==")[0]
    tables = re.findall(r"UnresolvedRelation \[([^\]]*)\]", parsed)
    functions = re.findall(r"UnresolvedTableValuedFunction \[([^\]]*)\]", parsed)
    return {t.replace(", ", ".").lower() for t in tables} | {f"{f.replace(', ', '.').lower()}()" for f in functions}


def guarded_sql(spark: SparkSession, text: str, limit: int | None = 100, args: list | None = None) -> DataFrame:
    """The rows of a text that the audit lets pass and that reads tables of the catalogue only, as its parsed plan tells: never more than MOST_ROWS, whatever limits it names. Else ValueError.

    limit=None: all rows, as a table to go on with or to write; the cap is for rows that are shown.

    What the audit can't read with certainty (bracketed joins, say) is left to the plan."""
    verdict = spark.range(1).select(audit(F.lit(text)).alias("a")).first()["a"]
    unread = verdict["verdict"] == "unauthorized_table" and verdict["matched"] in ("?", "\u00a4")
    if verdict["verdict"] != "valid" and not unread:
        raise ValueError(f"{verdict['verdict']}: {verdict['matched'] or verdict['excerpt']}")
    try:
        found = spark.sql(text, args=args) if args else spark.sql(text)
        foreign = relations(found) - set(TABLES)
    except (AnalysisException, ParseException) as wrong:
        raise ValueError(f"unreadable: {excerpt_of(str(wrong))}") from wrong
    if foreign:
        raise ValueError(f"unauthorized_table: {min(foreign)}")
    return found if limit is None else found.limit(limit_of(text, limit) or MOST_ROWS)


def excerpt_of(text: str, most: int = 100) -> str:
    return text if len(text) <= most else f"{text[:most]}..."


def _first_rows(df: DataFrame, n: int) -> DataFrame:
    """The n first rows by the first column. Their place is found by that column alone, so what the others are made of (a view's JSON, say) is read and made for these rows only."""
    c = F.col(f"`{df.columns[0]}`")
    if df.schema[0].dataType.typeName() not in ("byte", "short", "integer", "long", "string", "date"):  # a literal may not be the same value
        return df.orderBy(c).limit(n)
    firsts = [r[0] for r in df.select(c).orderBy(c).limit(n).collect()]  # n values
    least = [x for x in firsts if x is not None]
    kept = c.isNull() if not least else (c <= least[-1]) if len(least) == len(firsts) else c.isNull() | (c <= least[-1])
    return (df.where(kept) if len(firsts) == n else df).orderBy(c).limit(n)


def inspect_schema(tables: dict[str, DataFrame], with_views: bool = True, samples: int = 0) -> DataFrame:
    """A row for each column of each table (views, by their prefix vw_, only if asked for): type, nullability, the table's row count, `samples` values as texts, and error.

    A table that can't be read has one row, with its error; the others aren't touched by it."""
    none = F.lit(None).cast("string")
    out = None
    for name, df in sorted(tables.items()):
        if not with_views and name.startswith("vw_"):
            continue
        try:
            n = F.count("*").alias("n_rows")
            values = [F.slice(F.array_sort(F.collect_set(F.col(f"`{f.name}`").cast("string"))), 1, samples).alias(f"s{i}") for i, f in enumerate(df.schema)] if samples else []
            source = _first_rows(df, samples).agg(*values) if samples else None
            empty = F.array().cast("array<string>")
            fields = F.array(*(F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"), (F.col(f"s{i}") if samples else empty).alias("samples")) for i, f in enumerate(df.schema)))
            part = df.agg(n)
            part = part.join(F.broadcast(source)) if samples else part  # one row each
            part = part.select(F.lit(name).alias("table_name"), "n_rows", F.explode(fields).alias("f")).select("table_name", "f.*", "n_rows", none.alias("error"))
            part = settled(part, "inspected")  # a table that fails while it is read fails here, alone
        except Exception as failed:  # a broken view or file, say
            part = df.sparkSession.createDataFrame([(name, str(failed)[:500])], "table_name string, error string").select("table_name", F.lit(None).cast("int").alias("position"), none.alias("column_name"), none.alias("data_type"), F.lit(None).cast("boolean").alias("nullable"), F.array().cast("array<string>").alias("samples"), F.lit(None).cast("long").alias("n_rows"), "error")
        out = part if out is None else out.unionByName(part)
    return out
