"""Identifier spans: rules, propagation, overlap resolution, lossless chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as t


def rule_spans(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans of all identifier rules, rule after rule."""
    return F.concat(*(t.match_spans(text, pattern, kind, group) for kind, pattern, group in fixed.RULES if not kinds or kind in kinds))


def priority(kind: Column) -> Column:
    """0 for the strongest kind; null for an unknown one."""
    return F.create_map(*(F.lit(x) for i, k in enumerate(fixed.KINDS) for x in (k, i)))[kind]


def label(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in fixed.KINDS.items() for x in (k, v)))[kind]


def additional_spans(text: Column, values: Column) -> Column:
    """Spans of identifiers that the user lists."""
    return F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: t.occurrences(text, v, "OTHER_ID")))


def propagate(text: Column, spans: Column) -> Column:
    """spans and, with their kinds, all other occurrences of the surfaces in them.

    Surfaces whose literal occurrences have all been found already need no search.
    """
    surface = lambda s: F.lower(t.piece(text, s["start"], s["end"]))
    counted = lambda low, v: (F.length(low) - F.length(F.replace(low, v, F.lit("")))) / F.length(v)

    def more(low: Column, found: Column, known: Column) -> Column:
        surfaces = F.array_distinct(known)
        seen = lambda x: F.size(F.filter(known, lambda k: k == x))
        open_ = F.filter(surfaces, lambda x: counted(low, x["value"]) > seen(x))
        return F.array_distinct(F.concat(found, F.flatten(F.transform(open_, lambda x: t.occurrences(text, x["value"], x["kind"])))))

    known = lambda found: F.transform(found, lambda s: F.struct(surface(s).alias("value"), s["kind"].alias("kind")))
    return t.let(F.lower(text), lambda low: t.let(spans, lambda found: t.let(known(found), lambda k: more(low, found, k))))


def resolve(spans: Column) -> Column:
    """Non-overlapping spans in order of place: strongest kind first, then the longer, then the earlier one."""
    ranked = F.array_sort(F.transform(F.array_distinct(spans), lambda s: F.struct(priority(s["kind"]).alias("p"), (s["start"] - s["end"]).alias("l"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    plain = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    keep = lambda kept, s: F.when(F.exists(kept, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"])), kept).otherwise(F.concat(kept, F.array(s)))
    return F.array_sort(F.aggregate(plain, F.array().cast(f"array<{t.SPAN}>"), keep))


def chunks(text: Column, most: int = fixed.CHUNK_CHARS) -> Column:
    """array<struct<start,text>>: pieces of at most `most` characters that make up the text.

    A piece ends after its last line feed in its second half, else after the last space there, else at its limit.
    """
    size, half = F.length(text), most // 2
    empty = F.array().cast("array<struct<start:int,text:string>>")

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        end = F.least(at + most, size)
        tail = t.piece(text, at + half, end)
        line, space = t.last_index(tail, "\n"), t.last_index(tail, " ")
        cut = F.when(end == size, end).when(line >= 0, at + half + line + 1).when(space >= 0, at + half + space + 1).otherwise(end)
        chunk = F.struct(at.alias("start"), t.piece(text, at, cut).alias("text"))
        return F.when(at < size, F.struct(cut.alias("at"), F.concat(state["out"], F.array(chunk)).alias("out"))).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(size / F.lit(half)).cast("int")))
    return F.when(size > 0, F.aggregate(steps, start, step, lambda s: s["out"])).otherwise(empty)


def passages(text: Column) -> Column:
    """array<struct<start,text>> of the text between page and document markers, each with its marker; passages of markers alone go."""
    starts = F.transform(t.match_spans(text, fixed.PAGE_MARKER, ""), lambda s: s["start"])
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), starts, F.array(F.length(text)))))
    spans = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts)), lambda a, b: F.struct(a.alias("start"), t.piece(text, a, b).alias("text")))
    return F.filter(spans, lambda p: F.length(t.strip(F.regexp_replace(p["text"], fixed.PAGE_MARKER, ""))) > 0)


def page_chunks(text: Column, most: int = fixed.CHUNK_CHARS) -> Column:
    """array<struct<start,text>>: chunks that respect page and document markers, with offsets into the whole text."""
    return F.flatten(F.transform(passages(text), lambda p: F.transform(chunks(p["text"], most), lambda c: F.struct((p["start"] + c["start"]).alias("start"), c["text"].alias("text")))))


def entity_valid(kind: Column, value: Column, text: Column) -> Column:
    """A detector's suggestion counts if its kind is known and its text, of 2 to 180 characters without a token, is in the passage."""
    right = kind.isin(*fixed.KINDS) & F.length(value).between(2, 180) & text.contains(value) & ~value.rlike(fixed.TOKEN)
    return F.coalesce(right, F.lit(False))


def explode_spans(df: DataFrame, spans: str, text: str) -> DataFrame:
    """A row for each span with its start, end, kind and value."""
    valued = t.let(F.col(text), lambda x: F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), t.piece(x, s["start"], s["end"]).alias("value"))))
    rows = df.withColumn("_valued", valued).drop(spans)  # values first: a text that isn't asked for isn't repeated for each span
    return rows.select(*(c for c in rows.columns if c != "_valued"), F.posexplode("_valued").alias("span_no", "_s")).select("*", "_s.start", "_s.end", "_s.kind", "_s.value").drop("_s")
