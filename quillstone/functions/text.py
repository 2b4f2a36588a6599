"""Column functions on text. All are built-in expressions, so they run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import fixed

#: White space of any alphabet, as Java's (?U)\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPAN = "struct<start:int,end:int,kind:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: inside a lambda an expression would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: Column | str) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))


def strip(text: Column) -> Column:
    """text without white space, of any alphabet, at its ends."""
    return F.btrim(text, F.lit(WHITE))


def match_spans(text: Column, pattern: Column | str, kind: Column | str, group: int = 0) -> Column:
    """array<struct<start,end,kind>> of all matches in order, as half-open character offsets.

    What lies between the matches (split) and the matches themselves give the offsets. A captured group must end its match.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    k = F.lit(kind) if isinstance(kind, str) else kind
    hits = [F.regexp_extract_all(text, p, F.lit(0)).alias("hit")] + ([F.regexp_extract_all(text, p, F.lit(group)).alias("part")] if group else [])
    pieces = F.arrays_zip(F.split(text, p, -1).alias("gap"), *hits)  # the last gap has no match after it

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.length(x["gap"]) + F.length(x["hit"])
        span = F.struct((end - F.length(x["part" if group else "hit"])).alias("start"), end.alias("end"), k.alias("kind"))
        return F.when(x["hit"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(pieces, start, step, lambda s: s["out"])


def occurrences(text: Column, value: Column, kind: Column | str) -> Column:
    """Spans of a literal value, in any case, that aren't part of a longer word."""
    quoted = F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return match_spans(text, quoted, kind)


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start + 1, end - start)


def last_index(text: Column, wanted: str) -> Column:
    """Zero-based place of the last occurrence of a short string, or -1."""
    back = F.instr(F.reverse(text), wanted[::-1])
    return F.when(back > 0, F.length(text) - back - (len(wanted) - 1)).otherwise(-1)


def word_count(text: Column) -> Column:
    """Words between white space; a blank text has none."""
    clean = strip(text)
    return F.when(F.length(clean) == 0, 0).otherwise(F.size(F.split(clean, r"(?U)\s+")))


def critical_tokens(text: Column) -> Column:
    """Numbers with sign, comparison and unit, and negations: lower case, without white space, with repetitions, in order."""
    return F.transform(matches(text, fixed.CRITICAL), lambda x: F.regexp_replace(F.lower(x), r"(?U)\s+", ""))


def number_tokens(text: Column) -> Column:
    return matches(F.regexp_replace(text, r"\[[A-Z_0-9]+\]", ""), fixed.NUMBER)


def multiset(items: Column) -> Column:
    """Sorted array of the items, by which multisets compare."""
    return F.array_sort(items)


def has_word(text: Column) -> Column:
    return text.rlike(r"(?U)\w")


def is_degenerate(text: Column) -> Column:
    """A letter or digit at least twenty times in a row."""
    return text.rlike(fixed.DEGENERATE)


def is_loop(text: Column) -> Column:
    """A line of twenty characters or more at least five times in a row."""
    return text.rlike(fixed.LOOP)


def has_private_use(text: Column) -> Column:
    return text.rlike(r"[\p{Co}\x{FFFD}]")


def strip_thinking(text: Column) -> Column:
    """A model's answer without its reasoning and without a code fence around it."""
    plain = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    fenced = plain.startswith("```") & plain.endswith("```")
    lines = F.split(plain, r"\r\n|[\n\r]", -1)
    return F.when(fenced, strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))).otherwise(plain)


def placeholders(text: Column) -> Column:
    return matches(text, fixed.PLACEHOLDER)


def safe_filename(name: Column) -> Column:
    """The last part of a path, with characters that file systems refuse replaced."""
    base = F.element_at(F.split(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"/+$", ""), "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^./]+)$", 1))


def compatible_version(version: Column) -> Column:
    """The leading three numbers of a version are at least the oldest one that will do."""
    part = lambda i: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)", i).try_cast("int")
    given = F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    least = F.struct(*(F.lit(v).alias(n) for v, n in zip(fixed.LEAST_RUNTIME, "abc", strict=True)))
    return F.coalesce(part(1).isNotNull() & (given >= least), F.lit(False))


def is_overflow(message: Column) -> Column:
    """A server's error says that the input is over the context; only its first 500 characters count."""
    low = F.lower(F.substring(message, 1, 500))
    found = F.lit(False)
    for phrase in fixed.OVERFLOW_PHRASES:
        found = found | low.contains(phrase)
    return found


def valid_identity(value: Column) -> Column:
    """The last ten digits are a date (day over 60: a coordination number) with a right check digit."""
    digits = F.regexp_replace(value, r"(?U)\D", "")
    ten = F.substring(digits, -10, 10)
    day = F.substring(ten, 5, 2).try_cast("int")
    real = F.lpad(F.when(day > 60, day - 60).otherwise(day).cast("string"), 2, "0")
    date = F.try_to_date(F.concat(F.lit("20"), F.substring(ten, 1, 4), real), "yyyyMMdd")
    return F.coalesce((F.length(ten) == 10) & date.isNotNull() & F.call_function("luhn_check", ten), F.lit(False))
