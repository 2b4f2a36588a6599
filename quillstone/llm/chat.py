"""Chat formatting from event logs: fold a log of streamed deltas, edits and regenerations into messages, render them, read them back.

A log has rows (conv_id, seq, kind, place, role, text); `place` orders the messages of a conversation and names the one an event is about:

    message     the message begins, with a role and its first text
    delta       text goes on at its end
    edit        its text is replaced, its role stays
    regenerate  it begins again with an empty text, and all messages after it that the log has so far are gone
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import bound_batches

#: Marks of the template: of a role's beginning, and of a turn's end. No mark has "[" or "<" but at its start, so none arises across the border of a text.
OPEN = {"system": "[SYS] ", "user": "[INST] ", "assistant": "<s>"}
CLOSE = {"system": " [/SYS]", "user": " [/INST]", "assistant": "</s>"}
#: Other roles: the name stands in the mark, percent-encoded.
OTHER_OPEN, OTHER_OPEN_END, OTHER_CLOSE = "[ROLE=", "] ", " [/ROLE]"

#: What marks are recognised by. In texts a backslash goes in after the first character of each, and one more if there are some already.
_CONTROL = r"(/?SYS\]|/?INST\]|ROLE=|/ROLE\]|/?s>)"
_TURN = r"(?s)(?:\[SYS\] (.*?) \[/SYS\])|(?:\[INST\] (.*?) \[/INST\])|(?:<s>(.*?)</s>)|(?:\[ROLE=([^\]]*)\] (.*?) \[/ROLE\])"


def escape(text: Column) -> Column:
    """text without control strings."""
    return F.regexp_replace(text, r"([\[<])(\\*)" + _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, r"([\[<])(\\*)\\" + _CONTROL, "$1$2$3")


def fold(events: DataFrame, block: Column | None = None) -> DataFrame:
    """The final messages of a log: conv_id, place, role, text.

    Read from its end, an event counts unless a regeneration of a message before its own comes later: of all later regenerations
    only the first place matters. That minimum is taken in blocks of the sequence (`block`, a long that never falls as seq grows; by default
    seq div 4096), then over the blocks, so that no task holds a whole conversation. What is left of a message is folded by itself.

    A null conv_id is a conversation of its own. Events of a null place, of another kind, or about a message that hasn't begun change nothing; a second
    `message` begins it anew. A null text is empty; a null role is that of the message so far, or ''. Events of equal seq go by kind and text: repeated events apply twice. No events, no messages. Other columns are not read.
    """
    log = events.select("conv_id", "seq", "place", F.array_position(F.array(*map(F.lit, ("message", "regenerate", "edit", "delta"))), F.col("kind")).cast("int").alias("_kind"), "role", F.coalesce("text", F.lit("")).alias("text"), (F.expr("seq div 4096") if block is None else block).alias("_block"))
    log = log.where("place IS NOT NULL AND seq IS NOT NULL AND _kind > 0")
    again = F.when(F.col("_kind") == 2, F.col("place"))
    order = (F.desc("seq"), F.desc("_kind"), F.desc("text"))
    later = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = log.where("_kind = 2").groupBy("conv_id", "_block").agg(F.min("place").alias("_first"))
    known = log.select("conv_id", "_block").distinct().join(_renamed(blocks, "_c", "_b"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    after = Window.partitionBy("conv_id").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = known.withColumn("_ahead", F.min("_first").over(after)).where("_ahead IS NOT NULL").select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), "_ahead")
    log = log.withColumn("_cut", F.min(again).over(later)).join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    cut = F.least("_cut", "_ahead")
    alive = log.where(cut.isNull() | (F.col("place") <= cut))
    steps = F.array_sort(F.collect_list(F.struct("seq", "_kind", "text", "role")))
    messages = alive.groupBy("conv_id", "place").agg(steps.alias("steps"))
    return messages.select("conv_id", "place", F.inline(F.array(_folded(F.col("steps"))))).where("begun").select("conv_id", "place", "role", "text")


def _renamed(df: DataFrame, conv: str, block: str) -> DataFrame:
    return df.withColumnsRenamed({"conv_id": conv, "_block": block})


def _folded(steps: Column) -> Column:
    """begun, role and text after the steps (seq, _kind, text, role) of one message: what follows its beginning and its last new text."""
    places = lambda of: F.transform(steps, lambda x, i: F.when(of(x["_kind"]), i + 1))
    first, last = F.array_min(places(lambda k: k == 1)), F.array_max(places(lambda k: k < 4))
    roles = F.transform(F.filter(steps, lambda x: (x["_kind"] == 1) & x["role"].isNotNull()), lambda x: x["role"])
    text = F.array_join(F.transform(F.slice(steps, F.greatest(last, first), F.size(steps)), lambda x: x["text"]), "")
    return F.struct(first.isNotNull().alias("begun"), F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.when(first.isNotNull(), text).alias("text"))


def rendered(role: Column, text: Column) -> tuple[Column, Column]:
    """A turn in the template, and the characters before its text there."""
    other = F.concat(F.lit(OTHER_OPEN), F.url_encode(role), F.lit(OTHER_OPEN_END))
    begin, end = other, F.lit(OTHER_CLOSE)
    for name in OPEN:
        begin, end = F.when(role == name, F.lit(OPEN[name])).otherwise(begin), F.when(role == name, F.lit(CLOSE[name])).otherwise(end)
    return F.concat(begin, escape(text), end), F.length(begin)


def render(messages: DataFrame, part: Column, mask_role: str = "assistant") -> DataFrame:
    """conv_id, part, text, loss: messages (conv_id, place, role, text) as formatted text, in parts that follow one another.

    `part` is a long that never falls as place grows; it bounds a row. loss holds the spans (start, end, in code points of the row's text) of the
    texts of mask_role, marks left out. Null roles and texts are empty. A conversation's text is that of its parts, in order.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole, ahead = rendered(role, text)
    turn = F.struct("place", whole.alias("turn"), ahead.alias("ahead"), F.length(escape(text)).alias("n"), (role == mask_role).alias("mask"))
    parts = messages.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["turn"])).alias("at"),
        F.when(x["mask"], F.concat(s["loss"], F.array(F.struct((s["at"] + x["ahead"]).alias("start"), (s["at"] + x["ahead"] + x["n"]).alias("end"))))).otherwise(s["loss"]).alias("loss"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return parts.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("text"), F.aggregate("turns", none, step)["loss"].alias("loss"))


def parse(text: Column) -> Column:
    """array<role, text> of the turns of a formatted text."""
    groups = {name: F.regexp_extract_all(text, F.lit(_TURN), F.lit(i)) for i, name in enumerate(("whole", "system", "user", "assistant", "name", "other"))}
    rows = F.arrays_zip(*(c.alias(name) for name, c in groups.items()))

    def turn(x: Column) -> Column:
        known = [(x["whole"].startswith(OPEN[name]), F.lit(name), x[name]) for name in OPEN]
        role, said = F.url_decode(x["name"]), x["other"]
        for there, name, value in known:
            role, said = F.when(there, name).otherwise(role), F.when(there, value).otherwise(said)
        return F.struct(role.alias("role"), unescape(said).alias("text"))

    return F.transform(rows, turn)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGEST rows of parts that come in order: a conversation is as many updates as it has turns, and is never held."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    at, turns, loss, n, masked, length = (), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    done = []
    for batch in batches:
        for conv, said, heard, size in zip(*(batch[c].to_pylist() for c in ("conv_id", "turns", "masked", "size")), strict=True):
            if at != (conv,):
                if at:
                    done.append((*at, n, turns.hexdigest(), masked, loss.hexdigest(), length))
                at, turns, loss, n, masked, length = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for x in said:
                turns.update(f"{x['role']}\n{x['text']}\n".encode())
            for x in heard:
                loss.update(x.encode())
            n, masked, length = n + len(said), masked + sum(map(len, heard)), length + size
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    if at:
        done = [(*at, n, turns.hexdigest(), masked, loss.hexdigest(), length)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGEST of each conversation of what render wrote, from its text and its loss spans alone.

    A conversation's parts pass one task in order, as a digest is a chain, but none of them stays there. No rows give no rows.
    """
    bound_batches(formatted.sparkSession)
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), parse(F.col("text")).alias("turns"), masked.alias("masked"), F.length("text").cast("long").alias("size")).mapInArrow(_digests, DIGEST)


#: Characters of a streamed delta, and of the first attempt at a text.
DELTA, DRAFT = 512, 16


def as_log(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as the event log that a chat server could have kept of them; place is (turn, copy).

    An assistant's turn begins, streams its first characters, is regenerated and streams its text; another's begins as a draft and is edited.
    Null turns come first; rows of equal conv_id and turn are messages of their own, in the order of role and text.
    """
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    text, draft = F.col("text"), F.substring("text", 1, DRAFT)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / DELTA)).cast("int")), lambda i: event("delta", F.substring(text, i * DELTA + 1, F.lit(DELTA))))
    streamed = F.concat(F.array(event("message", F.lit("")), event("delta", draft), event("regenerate", F.lit(""))), pieces)
    steps = F.when(F.col("role") == "assistant", streamed).otherwise(F.array(event("message", draft), event("edit", text)))
    log = said.select("conv_id", "turn", "copy", "role", F.posexplode(steps).alias("step", "e"))
    return log.select("conv_id", F.struct("turn", "copy", "step").alias("seq"), F.col("e.kind").alias("kind"), F.struct("turn", "copy").alias("place"), "role", F.col("e.text").alias("text"))


#: Turns of a block of the log and of a part of the formatted text.
TURNS = 64


def format_log(log: DataFrame, turns: int = TURNS) -> DataFrame:
    """render(fold(log)) for logs of as_log, in blocks and parts of `turns` turns; rows that repeat a turn of a conversation share its part."""
    return render(fold(log, F.floor(F.col("place.turn") / turns)), F.floor(F.col("place.turn") / turns))
