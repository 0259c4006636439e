"""Declared rules for events, compiled to column expressions.

A rule tree says which fields an object has, of what type and range. violations() walks it once and gives an array column of the broken rules;
members of arrays and maps are tested with higher-order functions, so a table of events is checked in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    types: tuple[str, ...]
    required: dict[str, "Rule"] = field(default_factory=dict)
    optional: dict[str, "Rule"] = field(default_factory=dict)
    closed: bool = False
    items: "Rule | None" = None
    length: int | None = None
    values: "Rule | None" = None
    keys: str | None = None
    among: tuple[str, ...] = ()
    pattern: str | None = None
    least: float | None = None
    seen: tuple[str, ...] = ()  # names that an open object often has besides; their values are free
    shapes: dict[str, "Rule"] = field(default_factory=dict)  # of those, what they mostly look like; another look is as valid
    order: tuple[str, ...] = ()  # fields as their writer orders them; without it required ones come first
    read: str = "variant"  # the type by which a first look at a line reads a number


def text(**k) -> Rule:
    return Rule(("string",), **k)


def number(least: float | None = None, read: str = "variant") -> Rule:
    return Rule(("number",), least=least, read=read)


def integer(least: float | None = None, *more: str) -> Rule:
    return Rule(("integer", *more), least=least)


def record(required: dict | None = None, optional: dict | None = None, closed: bool = False, seen: tuple[str, ...] = (), shapes: dict | None = None, order: tuple[str, ...] = ()) -> Rule:
    return Rule(("object",), required or {}, optional or {}, closed, seen=seen, shapes=shapes or {}, order=order)


def listing(items: Rule | None = None, length: int | None = None) -> Rule:
    return Rule(("array",), items=items, length=length)


def mapping(values: Rule, keys: str | None = None) -> Rule:
    return Rule(("object",), values=values, keys=keys, closed=keys is not None)


# Names, enumerations and patterns of the three event formats.
HEX8 = "^[a-f0-9]{8}$"
PRODUCER = "marimo-lineage-tracker"
_made = {"_producer": text(among=(PRODUCER,)), "_schemaURL": text()}
_names = listing(text())
_quality = record(optional=_made | {"rowCount": integer(), "bytes": integer(), "columnMetrics": mapping(record(optional={"nullCount": integer(), "distinctCount": integer()}))})
_dataset = record(
    {"namespace": text(), "name": text()},
    {"facets": record(optional={
        "schema": record(_made | {"fields": listing(record({"name": text(), "type": text()}, {"description": text()}, True))}, closed=True),
        "dataSource": record(_made | {"name": text(), "uri": text()}, closed=True),
        "columnMetrics": record(_made | {"columnMetrics": mapping(record(optional={"nullCount": integer(None, "null"), "distinctCount": integer(None, "null"), "min": Rule(("number", "null")), "max": Rule(("number", "null"))}))}, closed=True),
        "columnLineage": record(_made | {"fields": mapping(record({"inputFields": listing(record({"namespace": text(), "name": text(), "field": text()}))}))}, closed=True),
        "version": record(_made | {"datasetVersion": text()}, closed=True),
    }, seen=("catalog", "dataQualityAssertions", "dataQualityMetrics", "documentation", "inputStatistics", "lifecycleStateChange", "outputStatistics", "ownership", "storage", "symlinks", "tags"), shapes={"dataQualityMetrics": _quality})},
    True,
)
_frame = record({"variable_name": text(), "shape": listing(integer(0), 2), "columns": _names}, {"object_id": text(), "memory_usage_mb": number(0)}, True)

RUNTIME = record(
    {"event_type": text(among=("cell_execution_start", "cell_execution_end", "cell_execution_error")), "execution_id": text(pattern=HEX8), "cell_id": text(), "cell_source": text(), "cell_source_lines": integer(1), "start_memory_mb": number(0, "double"), "timestamp": text(), "session_id": text(pattern=HEX8), "emitted_at": text()},
    {"end_memory_mb": number(0, "double"), "duration_ms": number(0, "double"), "error_info": record(optional={"error_type": text(), "error_message": text(), "traceback": text()})},
    True,
    order=("event_type", "execution_id", "cell_id", "cell_source", "cell_source_lines", "start_memory_mb", "end_memory_mb", "duration_ms"),
)
LINEAGE = record(
    {
        "eventType": text(among=("START", "COMPLETE", "ABORT", "FAIL")), "eventTime": text(),
        "run": record({"runId": text()}, {"facets": record(optional={"marimoExecution": record({"_producer": text(), "executionId": text(), "sessionId": text()}), "performance": record({"_producer": text(), "durationMs": number(0)})}, seen=("errorMessage", "externalQuery", "nominalTime", "parent", "processing_engine", "tags"))}, True),
        "job": record({"namespace": text(), "name": text()}, {"facets": record()}, True),
        "inputs": listing(_dataset), "outputs": listing(_dataset), "producer": text(among=(PRODUCER,)), "schemaURL": text(), "session_id": text(), "emitted_at": text(),
    },
    closed=True,
)
FRAMES = record(
    {
        "event_type": text(among=("dataframe_lineage",)), "execution_id": text(pattern=HEX8), "cell_id": text(), "session_id": text(pattern=HEX8), "timestamp": text(), "emitted_at": text(),
        "operation_type": text(among=("selection", "aggregation", "join")), "operation_method": text(among=("__getitem__", "groupby", "sum", "mean", "count", "merge")), "operation_code": text(),
        "input_dataframes": listing(_frame), "output_dataframes": listing(_frame),
    },
    {
        "operation_parameters": record(optional={"columns": _names, "how": text(), "on": Rule(("string", "array")), "condition": text(), "is_boolean_mask": Rule(("boolean",))}),
        "column_lineage": record({"column_mapping": mapping(_names, r"^[^.]+\.[^.]+$"), "input_columns": _names, "output_columns": _names, "operation_method": text(), "lineage_type": text(among=("selection", "aggregation", "join", "basic", "error"))}, closed=True),
        "performance": record(optional={"overhead_ms": number(0, "double"), "df_size_mb": number(0, "double"), "sampled": Rule(("boolean",))}),
    },
    True,
    order=("event_type", "execution_id", "cell_id", "session_id", "timestamp", "emitted_at", "operation_type", "operation_method", "operation_code", "operation_parameters"),
)
KINDS = {"runtime": RUNTIME, "lineage": LINEAGE, "dataframe_lineage": FRAMES}

# Expressions are written as SQL text: a rule set has thousands of nodes, and a call to the JVM for each takes seconds.

def _pair(path: str, rule: str) -> str:
    return f"named_struct('path', '{path}', 'rule', '{rule}')"


VIOLATIONS = "array<struct<path:string,rule:string>>"
_NONE = f"cast(array() AS {VIOLATIONS})"


def _listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


def _has_type(v: str, at: str, kinds: tuple[str, ...]) -> str:
    """Whether the value at a path has one of some JSON types. A number without a fraction is an integer."""
    shown = f"schema_of_variant(try_variant_get({v}, '{at}', 'variant'))"
    # A schema is told of scalars only: that of an object would be written out with all that lies in it.
    holds = lambda kind: f"if(try_variant_get({v}, '{at}', 'variant') IS NULL, NULL, try_variant_get({v}, '{at}', '{kind}') IS NOT NULL)"
    tests = {
        "string": f"{shown} = 'STRING'", "boolean": f"{shown} = 'BOOLEAN'", "null": f"{shown} = 'VOID'", "object": holds("map<string,variant>"), "array": holds("array<variant>"),
        "number": f"{shown} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'",
        "integer": f"({shown} = 'BIGINT' OR ({shown} RLIKE '^(DECIMAL|DOUBLE|FLOAT)' AND try_variant_get({v}, '{at}', 'double') % 1 = 0))",
    }
    return "(" + " OR ".join(tests[k] for k in kinds) + ")"


def _checks(rule: Rule, v: str, at: str, label: str, scalars: list[str], groups: list[str], deep: bool, depth: int, kept: str | None = None) -> None:
    """Adds what is tested at one path of a root variant. Objects are walked by path; lists and maps become one group each, which tests their members in one pass. depth: of lambdas around; kept: a column that tells which of this object's fields needn't be tested."""
    get = lambda kind: f"try_variant_get({v}, '{at}', '{kind}')"
    x = f"x{depth}"

    def mark(broken: str, what: str, where: str = label) -> None:
        scalars.append(f"CASE WHEN coalesce({broken}, false) THEN {_pair(where, what)} END")

    if rule.types:
        mark(f"NOT {_has_type(v, at, rule.types)}", "type")
    if rule.among:
        mark(f"{_has_type(v, at, ('string',))} AND {get('string')} NOT IN {_listed(rule.among)}", "enum")
    if rule.pattern:
        mark(f"{_has_type(v, at, ('string',))} AND NOT {get('string')} RLIKE r'{rule.pattern}'", "pattern")
    if rule.least is not None:
        mark(f"{_has_type(v, at, ('number',))} AND {get('double')} < {rule.least}", "minimum")
    if rule.closed and rule.keys is None:
        mark(f"size(array_except(map_keys({get('map<string,variant>')}), array{_listed((*rule.required, *rule.optional))})) > 0", "additional")
    if rule.keys:
        mark(f"exists(map_keys({get('map<string,variant>')}), {x} -> NOT {x} RLIKE r'{rule.keys}')", "key")
    if rule.length is not None:
        mark(f"size({get('array<variant>')}) <> {rule.length}", "length")
    for name in rule.required:
        here = f"{get('variant')} IS NOT NULL AND " if at != "$" else ""
        mark(f"{here}try_variant_get({v}, '{at}.{name}', 'variant') IS NULL", "required", f"{label}.{name}")
    if kept:
        # Field by field, in the same order; what is tested of a field is passed over where the field is known to be right.
        for name, sub in (*rule.required.items(), *rule.optional.items()):
            own, more = [], []
            _checks(Rule((), *(({name: sub}, {}) if name in rule.required else ({}, {name: sub}))), v, at, label, own, more, deep, depth)
            own = own[1:] if name in rule.required else own  # that the field is there was asked above
            for found, all_found in ((own, scalars), (more, groups)):
                all_found += [f"CASE WHEN NOT {kept}.`{name}` THEN {x} END" for x in found]
        return
    for name, sub in rule.required.items():
        _checks(sub, v, f"{at}.{name}", f"{label}.{name}", scalars, groups, deep, depth)
    for name, sub in rule.optional.items():
        if not sub.required and not sub.optional:
            _checks(sub, v, f"{at}.{name}", f"{label}.{name}", scalars, groups, deep, depth)
            continue
        own: list[str] = []
        more: list[str] = []
        _checks(sub, v, f"{at}.{name}", f"{label}.{name}", own, more, deep, depth)  # looked at only where there is such an object
        groups.append(f"CASE WHEN try_variant_get({v}, '{at}.{name}', 'variant') IS NOT NULL THEN {_together(own, more, x)} END")
    if deep and rule.items:
        groups.append(f"flatten(transform({get('array<variant>')}, {x} -> {_broken(rule.items, x, f'{label}[]', deep, depth + 1)}))")
    if deep and rule.values:
        groups.append(f"flatten(transform(map_values({get('map<string,variant>')}), {x} -> {_broken(rule.values, x, f'{label}.*', deep, depth + 1)}))")


def _together(scalars: list[str], groups: list[str], x: str) -> str:
    own = f"filter(array({', '.join(scalars)}), {x} -> {x} IS NOT NULL)"
    return f"concat({', '.join([own, *(f'coalesce({g}, {_NONE})' for g in groups)])})" if groups else own


def _broken(rule: Rule, v: str, label: str, deep: bool, depth: int = 0, kept: str | None = None) -> str:
    scalars: list[str] = []
    groups: list[str] = []
    _checks(rule, v, "$", label, scalars, groups, deep, depth, kept)
    return _together(scalars, groups, f"x{depth}")


def violations(v: str, kind: str | Rule, deep: bool = True, kept: str | None = None) -> Column:
    """All broken rules of an event of a kind, or by a rule of one's own: array of (path, rule), each once. v names a variant column, null where the line isn't JSON. deep=False leaves out what lies in arrays and maps. kept names a column of plain_fields(), whose fields aren't walked."""
    rule = _rule_of(kind)
    kept = kept if _fields(rule) else None
    return F.expr(f"CASE WHEN {v} IS NULL THEN array({_pair('$', 'json')}) ELSE array_distinct({_broken(rule, v, '$', deep, kept=kept)}) END")


def breaking(old: Rule, new: Rule, path: str = "$") -> list[tuple[str, str]]:
    """(path, change) of what in a new rule may refuse events that the old one takes, or drop what readers of old events rely on:
    a field no longer required, or newly so; another type; a value taken from an enumeration; a new pattern, a higher minimum, another length; a field no longer known to a closed object."""
    out = []
    if not set(old.types) <= set(new.types):
        out.append((path, "type"))
    if new.among and (not old.among or set(old.among) - set(new.among)):
        out.append((path, "enum"))
    if new.pattern not in (None, old.pattern):
        out.append((path, "pattern"))
    if new.least is not None and (old.least is None or new.least > old.least):
        out.append((path, "minimum"))
    if new.length not in (None, old.length):
        out.append((path, "length"))
    if new.keys not in (None, old.keys):
        out.append((path, "key"))
    before, now = {**old.required, **old.optional}, {**new.required, **new.optional}
    out += [(f"{path}.{k}", "no longer required") for k in old.required if k not in new.required]
    out += [(f"{path}.{k}", "required") for k in new.required if k not in old.required]
    if new.closed and new.keys is None:
        out += [(f"{path}.{k}", "additional") for k in before if k not in now]
        if not old.closed:
            out.append((path, "additional"))
    for k in before:
        if k in now:
            out += breaking(before[k], now[k], f"{path}.{k}")
    for a, b, at in ((old.items, new.items, "[]"), (old.values, new.values, ".*")):
        if b is not None:
            out += breaking(a or Rule(()), b, path + at)
    return out


def beyond(old: Rule, new: Rule) -> Rule:
    """What of a new rule for objects an event that keeps the old one can still break: fields under the same rule in both are left out, and so is what both ask of the object itself."""
    plain = lambda r: r.types == ("object",) and r.values is None and r.keys is None
    before = {**old.optional, **old.required}
    if not plain(old) or not plain(new) or (new.closed and not (old.closed and set(before) <= {*new.required, *new.optional})):
        return new
    required = {k: r for k, r in new.required.items() if old.required.get(k) != r}
    return replace(new, types=(), required=required, optional={k: r for k, r in new.optional.items() if before.get(k) != r}, closed=False)


def _rule_of(kind: str | Rule) -> Rule:
    return kind if isinstance(kind, Rule) else KINDS[kind]


def _typed_as(rule: Rule, line: bool = False) -> str:
    """The type by which an object of a rule is read. What has no single type of Spark's, numbers too, stays a variant. line: for a line as its writer wrote it."""
    if rule.values:
        return f"map<string,{_typed_as(rule.values, line)}>"
    if rule.items:
        return f"array<{_typed_as(rule.items, line)}>"
    fields = _of_line(rule) if line else {**rule.required, **rule.optional, **{k: Rule(()) for k in rule.seen}}
    if fields:
        # In the order in which a variant is written; a line's fields in the order of its rules.
        return "struct<" + ",".join(f"`{k}`:{_typed_as(fields[k], line)}" for k in (fields if line else sorted(fields))) + ">"
    if line and rule.types == ("number",):
        return rule.read
    return {("string",): "string", ("integer",): "bigint", ("boolean",): "boolean"}.get(rule.types, "variant")


def _of_line(rule: Rule) -> dict[str, Rule]:
    fields = {**rule.required, **rule.optional, **rule.shapes}
    return {k: fields[k] for k in (*rule.order, *fields) if k in fields}


def _kept(rule: Rule, c: str, depth: int = 0, line: bool = False) -> str:
    """Whether a typed value that isn't null keeps a rule; its fields' names and types are known to be right."""
    held, x = ["true"], f"x{depth}"
    if line and rule.values:
        # A key that is there twice is read as two, and a variant takes neither; it also sorts its keys.
        held.append(f"(size({c}) < 2 OR map_keys({c}) = array_sort(array_distinct(map_keys({c}))))")
    if rule.values:
        held.append(f"forall(map_values({c}), {x} -> {x} IS NOT NULL AND {_kept(rule.values, x, depth + 1, line)})")
        if rule.keys:
            held.append(f"forall(map_keys({c}), {x} -> {x} RLIKE r'{rule.keys}')")
    elif rule.items:
        held.append(f"forall({c}, {x} -> {x} IS NOT NULL AND {_kept(rule.items, x, depth + 1, line)})")
        if rule.length is not None:
            held.append(f"size({c}) = {rule.length}")
    elif rule.required or rule.optional:
        held += [f"({c}.`{k}` IS NOT NULL AND {_kept(r, f'{c}.`{k}`', depth, line)})" for k, r in rule.required.items()]
        held += [f"({c}.`{k}` IS NULL OR {_kept(r, f'{c}.`{k}`', depth, line)})" for k, r in (rule.optional | (rule.shapes if line else {})).items()]
    elif _typed_as(rule, line) == "variant":
        held.append(_has_type(c, "$", rule.types))
        if rule.least is not None:
            held.append(f"try_variant_get({c}, '$', 'double') >= {rule.least}")
    elif _typed_as(rule, line) == "double":
        # Texts such as "NaN" are read as doubles, too.
        held.append(f"{c} > {'-1.7976931348623157E308D' if rule.least is None else f'{rule.least - 1}D'} AND {c} <= 1.7976931348623157E308D")
        held += [f"{c} >= {rule.least}D"] if rule.least is not None else []
    else:
        held += [f"{c} IN {_listed(rule.among)}"] if rule.among else []
        held += [f"{c} RLIKE r'{rule.pattern}'"] if rule.pattern else []
        held += [f"{c} >= {rule.least}"] if rule.least is not None else []
    return f"coalesce({' AND '.join(held)}, false)"


def typed(canonical: Column, kind: str | Rule) -> Column:
    """An event, as a variant writes it, read by the types of its rules."""
    return F.from_json(canonical, _typed_as(_rule_of(kind)))


def plainly_valid(canonical: str, read: str, kind: str | Rule) -> Column:
    """Whether an event is valid at first sight: read by type (a column's name) and written again it is the same text, so it has no other fields and no other types,
    and its values keep their rules. False means only that violations() must look closer."""
    return F.expr(f"coalesce(to_json({read}) = {canonical} AND {_kept(_rule_of(kind), read)}, false)")


def _fields(rule: Rule) -> dict[str, Rule]:
    """Fields of an object that is read as such."""
    return {} if rule.values or rule.items else {**rule.required, **rule.optional}


def plain_fields(v: str, read: str, kind: str | Rule) -> Column | None:
    """The same as plainly_valid, for each field of the event by itself: a struct of booleans, or None for rules without fields. False means only that violations() must look closer."""
    tests = []
    for k, rule in _fields(_rule_of(kind)).items():
        same = f"to_json(named_struct('x', {read}.`{k}`)) = to_json(named_struct('x', try_variant_get({v}, '$.{k}', 'variant')))"
        tests.append(f"'{k}', coalesce({read}.`{k}` IS NOT NULL AND {_kept(rule, f'{read}.`{k}`')} AND {same}, false)")
    return F.expr(f"named_struct({', '.join(tests)})") if tests else None


#: Bytes of a line that a first look takes; longer ones may be more than a variant holds.
LONGEST = 1 << 20


def as_line(value: Column, kind: str | Rule) -> Column:
    """A line read by the types of its rules, without a variant."""
    return F.from_json(value, _typed_as(_rule_of(kind), line=True))


def valid_line(value: Column, read: str, kind: str | Rule) -> Column:
    """What was read by as_line (a column's name) where it is the line and nothing but the line, written again it is the same text, and keeps the rules; else null. Null means only that the line must be parsed and looked at as a whole."""
    return F.when((F.octet_length(value) < LONGEST) & (F.to_json(read) == value) & F.expr(_kept(_rule_of(kind), read, line=True)), F.col(read))


def in_order(kind: str | Rule, read: str, *path: str) -> str:
    """SQL text of what lies at a path of names of what was read by as_line, with fields in the order in which a variant is written; "[]" stands for a member of a list, which read names."""
    rule = _rule_of(kind)
    for name in path:
        rule = rule.items if name == "[]" else _of_line(rule)[name]
    return _ordered(rule, ".".join((read, *(f"`{name}`" for name in path[len(path) - path[::-1].index("[]") if "[]" in path else 0:]))))


def _ordered(rule: Rule, c: str, depth: int = 0) -> str:
    x = f"x{depth}"
    if rule.values:
        inner = _ordered(rule.values, x, depth + 1)
        return c if inner == x else f"transform_values({c}, (k{depth}, {x}) -> {inner})"
    if rule.items:
        inner = _ordered(rule.items, x, depth + 1)
        return c if inner == x else f"transform({c}, {x} -> {inner})"
    fields = _of_line(rule)
    if not fields:
        return c
    made = ", ".join(f"'{k}', {_ordered(fields[k], f'{c}.`{k}`', depth)}" for k in sorted(fields))
    return f"if({c} IS NULL, NULL, named_struct({made}))"


def settle(df, name: str, value: Column):
    """Adds a column that later expressions refer to instead of repeating it: a generator of one row, which the optimizer doesn't look through."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
