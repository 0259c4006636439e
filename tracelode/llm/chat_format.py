r"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into spans of whole turns: a turn belongs to the span in which its last
token falls, and where a span's first turn sticks out so far that the span would exceed its share of the budget, that
turn is a span of its own. Each window is then: the conversation's first system turn (unless the span holds it, or the
budget that the span leaves doesn't: system_left_out), the last few turns before the span within the history budget and
within what span and system turn leave, and the span. So a window is over budget only if its one new turn alone is.
Tokens are those of turns, each encoded for itself, and of `<s>` and `</s>`. Repeated turns carry no loss, so each assistant
text is a target exactly once. System turns after the first are never repeated.

Template: `<s>`, then for each turn `<|turn|>role<|text|>text<|end|>`, then `</s>`. Control strings inside roles and
texts (those of this template and the bracketed ones of others) get one backslash more after their first character; taking
one off restores them. Loss spans are code points [from, to) of the formatted text and hold assistant texts alone.

Prefix sums are taken in two steps, inside ranges of turns and over the ranges, and a window holds no more turns than the
budget lets in, so a conversation of any length is spread over tasks. Texts are tokenised once and written; windows are worked out on places and sums alone.

Cases: a null text counts as empty, a null role as "", a null turn comes first; equal turns are ordered by role and text;
a turn longer than the budget makes a window of its own, over_budget; a null conv_id is one conversation; an empty table
gives an empty result; columns other than conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, tasks_for
from .textnum import slices
from .tokens import chunked

#: Strings that structure this template or other common ones.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|(?:turn|text|end)\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>|\|(?:turn|text|end)\|>)"
BATCH_CHARS = 2_000_000
TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


def _turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Every turn with its tokens, place (pos) and prefix sum (to): conv_id, pos, to, tokens, role, head, body, as a written table.

    Turns are dealt out in order, by ranges, so that a conversation of any length, turns without numbers and equal ones spread over tasks. Each task
    counts tokens and sums from its own start of a conversation; what earlier tasks hold of it is added after."""
    spark = conversations.sparkSession
    small_batches(spark)
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    # Range bounds come to the driver, so they hold the beginnings of texts alone.
    dealt = rows.repartitionByRange(tasks_for(spark), "conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.select("conv_id", "role", F.concat(F.lit("<|turn|>"), escape(F.col("role")), F.lit("<|text|>")).alias("head"), escape(F.col("text")).alias("body"))
    names = ["conv_id", "role", "head", "body", "part", "pos", "to", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, held = chunked(tokenizer), TaskContext.get().partitionId(), (None, 0, 0)
        for batch in batches:
            heads, bodies = batch.column("head").to_pylist(), batch.column("body").to_pylist()
            for a, b in slices([len(t) for t in bodies], BATCH_CHARS):
                own = batch.slice(a, b - a)
                tokens = coder.encode([f"{x}{y}<|end|>" for x, y in zip(heads[a:b], bodies[a:b])])[1]
                pos, to = [], []
                for conv, n in zip(own.column("conv_id").to_pylist(), tokens.tolist()):
                    at, so_far = held[1:] if conv == held[0] else (0, 0)
                    held = (conv, at + 1, so_far + n)
                    pos.append(at)
                    to.append(so_far + n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([part] * (b - a), pa.int32()), pa.array(pos, pa.int64()), pa.array(to, pa.int64()), pa.array(tokens, pa.int64())], names)

    rows = materialise(dealt.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, role string, head string, body string, part int, pos long, to long, tokens long"), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("t0"))
    more = materialise(parts.where("n0 > 0"), "parts").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "n0", "t0")
    rows = rows.join(more, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return rows.select("conv_id", plus("pos", "n0"), plus("to", "t0"), "tokens", "role", "head", "body")


def windows(conversations: DataFrame, tokenizer: str, budget: int = 2048, history_budget: int = 512, history_turns: int = 4) -> DataFrame:
    """conv_id, window (from 0, ascending with the turns), formatted, loss_spans, n_tokens, n_repeated (turns at the head that earlier windows hold), n_turns, over_budget, system_left_out."""
    frame = int(chunked(tokenizer).encode(["<s>", "</s>"])[1].sum())
    turns = _turns(conversations, tokenizer)
    rows = turns.select("conv_id", "pos", "to", "tokens", (F.col("role") == "system").alias("is_system"))

    # One row for each conversation: its first system turn, and what that leaves for spans.
    heads = rows.groupBy("conv_id").agg(F.min(F.when(F.col("is_system"), F.struct("pos", "tokens"))).alias("system"))
    share = F.greatest(F.lit(budget - frame - history_budget) - F.coalesce(F.col("system.tokens"), F.lit(0)), F.lit(budget // 4))
    heads = materialise(heads.select(F.col("conv_id").alias("c"), "system", share.cast("long").alias("share")), "heads")
    rows = rows.join(heads.select("c", "share"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    rows = rows.withColumn("span", F.floor((F.col("to") - 1) / F.col("share")))
    group = Window.partitionBy("conv_id", "span")
    sticks = (F.col("to") - F.col("tokens") < F.col("span") * F.col("share")) & (F.sum("tokens").over(group) > F.col("share"))
    rows = materialise(rows.withColumn("span", F.col("span") * 2 + F.when(sticks, 0).otherwise(1)).drop("share"), "spans")

    # Turns that a later span repeats: by the places just before its first turn. From here on rows are places; texts join them last.
    spans = rows.groupBy("conv_id", "span").agg(F.min("pos").alias("p0"), F.min(F.col("to") - F.col("tokens")).alias("from"), F.sum("tokens").alias("size"))
    spans = spans.join(heads.select(F.col("c").alias("k"), "system"), F.col("conv_id").eqNullSafe(F.col("k")))
    led = F.coalesce(F.col("system.pos") < F.col("p0"), F.lit(False))
    room = F.lit(budget - frame) - F.col("size")
    spans = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "p0", "from", "system", led.alias("led"), room.alias("room")).withColumn("fits", F.col("led") & (F.col("system.tokens") <= F.col("room")))
    spans = materialise(spans.withColumn("history", F.least(F.lit(history_budget), F.col("room") - F.when(F.col("fits"), F.col("system.tokens")).otherwise(0))), "starts")
    wanted = spans.where("p0 > 0 and history > 0").select("c", "s", "from", "history", F.explode(F.sequence(F.greatest(F.col("p0") - history_turns, F.lit(0)), F.col("p0") - 1)).alias("p"))
    past = rows.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")))
    past = past.where((F.col("from") - F.col("to") + F.col("tokens") <= F.col("history")) & ~F.col("is_system"))
    lead = spans.where("fits")
    placed = rows.select("conv_id", "span", "pos", F.col("pos").alias("order"), F.lit(0).alias("again"))
    placed = placed.unionByName(past.select("conv_id", F.col("s").alias("span"), "pos", F.col("pos").alias("order"), F.lit(1).alias("again")))
    placed = placed.unionByName(lead.select(F.col("c").alias("conv_id"), F.col("s").alias("span"), F.col("system.pos").alias("pos"), F.lit(-1).cast("long").alias("order"), F.lit(1).alias("again")))
    placed = materialise(placed.select(F.col("conv_id").alias("c"), "span", F.col("pos").alias("p"), "order", "again"), "placed")
    every = placed.join(turns, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p"))).select("conv_id", "span", F.col("order").alias("pos"), "again", "role", "head", "body", "tokens")

    rendered = F.concat("head", "body", F.lit("<|end|>"))
    before = Window.partitionBy("conv_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("whole", rendered).withColumn("at", F.coalesce(F.sum(F.length("whole")).over(before), F.lit(0)) + 3 + F.length("head"))
    target = F.when((F.col("role") == "assistant") & (F.col("again") == 0), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    turns = F.array_sort(F.collect_list(F.struct("pos", "whole")))
    out = every.groupBy("conv_id", "span").agg(
        F.concat(F.lit("<s>"), F.array_join(F.transform(turns, lambda t: t["whole"]), ""), F.lit("</s>")).alias("formatted"),
        F.array_sort(F.collect_list(target)).alias("loss_spans"), (F.sum("tokens") + frame).alias("n_tokens"), F.sum("again").alias("n_repeated"), F.count("*").alias("n_turns"),
    )
    bare = spans.where("led and not fits").select("c", "s", F.lit(True).alias("left"))
    out = out.join(bare, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")), "left").withColumn("system_left_out", F.coalesce("left", F.lit(False))).drop("c", "s", "left")
    return out.withColumn("over_budget", F.col("n_tokens") > budget).withColumnRenamed("span", "window")


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows alone, a row for each conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Windows of a conversation meet in one task in order, as a digest needs, but stream through it: only hash states are kept."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, none = None, object()
        conv = none

        def close() -> tuple:
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv or conv is none:
                    if conv is not none:
                        out.append(close())
                    conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                whole = row["formatted"]
                for role, text in TURN.findall(whole)[row["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss_spans"]:
                    text = unescape(whole[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(whole)
                state[5] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if conv is not none:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(close(), kinds)], names)

    dealt = formatted.select("conv_id", "window", "n_repeated", "loss_spans", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
