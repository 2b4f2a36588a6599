"""Run records as rows: names, lists, changes, exports. store.py keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as t

# Titles, headings and defaults.
TITLES = {"summary": "Clinical summary", "pseudonymised": "Pseudonymised documents"}
QUESTIONS, NOTES = "Unresolved questions", "Transcription review notes"
UNTITLED, PASTED = "Untitled", "Pasted text"
FORMATS = ("txt", "md")


def derive_name(files: Column, text: Column) -> Column:
    """A run's name: its first file's stem and how many more there are, else the first words of the first telling line."""
    base = F.element_at(F.split(F.get(files, F.lit(0)), "/"), -1)
    stem = F.regexp_replace(base, r"(?s)(?<=.)\.[^.]+$", "")
    named = F.when(F.size(files) == 1, stem).otherwise(F.concat(stem, F.lit(" + "), (F.size(files) - 1).cast("string"), F.lit(" documents")))
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"[*#]", ""), r"^[ \-—\t]+|[ \-—\t]+$", ""))
    telling = F.get(F.filter(lines, lambda x: (F.length(x) > 0) & ~F.lower(x).startswith("sida ") & (F.lower(x) != "image transcription")), F.lit(0))
    words = F.split(t.strip(telling), r"(?U)\s+")
    short = F.concat(F.array_join(F.slice(words, F.lit(1), F.lit(6)), " "), F.when(F.size(words) > 6, "…").otherwise(""))
    return F.when(F.size(F.coalesce(files, F.array().cast("array<string>"))) > 0, named).otherwise(F.coalesce(short, F.lit(PASTED)))


def history_list(records: DataFrame) -> DataFrame:
    """id, name, created_at, input_type of records (id, record as JSON), newest first; records that aren't JSON objects are left out."""
    parsed = records.select("id", "record", F.try_parse_json("record").alias("_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    rows = parsed.select("id", F.from_json("record", "id string, name string, created_at double, input struct<type:string>").alias("j"))
    out = rows.select(F.coalesce("j.id", "id").alias("id"), F.coalesce("j.name", F.lit(UNTITLED)).alias("name"), F.coalesce("j.created_at", F.lit(0.0)).alias("created_at"), F.coalesce("j.input.type", F.lit("")).alias("input_type"))
    return out.orderBy(F.desc("created_at"))


def get_record(records: DataFrame, record_id: str) -> DataFrame:
    return records.where(F.col("id") == record_id)


def delete_record(records: DataFrame, record_id: str) -> DataFrame:
    return records.where(F.col("id") != record_id)


def rename_record(records: DataFrame, record_id: str, name: str) -> DataFrame:
    """A blank name changes nothing."""
    new = name.strip()
    return records.withColumn("name", F.when((F.col("id") == record_id) & F.lit(bool(new)), F.lit(new)).otherwise(F.coalesce("name", F.lit(UNTITLED))))


def export_parts(records: DataFrame, kind: str) -> DataFrame:
    """id, title, body, error of records (id, summary, uncertainties, warnings, implemented, units, pseudonymised_text)."""
    if kind not in TITLES:
        raise ValueError("choose summary or pseudonymised")
    none = F.array().cast("array<string>")
    part = lambda head, items: F.when(F.size(F.coalesce(items, none)) > 0, F.concat(F.lit(f"\n\n{head}\n"), F.array_join(items, "\n"))).otherwise("")
    review = part(NOTES, F.col("warnings"))
    if kind == "summary":
        body = F.concat(F.col("summary"), part(QUESTIONS, F.col("uncertainties")), review)
        error = F.when(F.coalesce(F.length("summary"), F.lit(0)) == 0, "No summary is available.")
    else:
        units = F.array_join(F.transform("units", lambda u: F.concat(F.lit("["), u["id"], F.lit("] "), F.coalesce(u["document"], F.lit("")), F.lit("\n"), u["text"])), "\n\n")
        body = F.concat(F.when(F.size("units") > 0, units).otherwise(F.col("pseudonymised_text")), review)
        error = F.when(~F.coalesce("implemented", F.lit(False)), "This older run has no pseudonymised document. Process its source again.")
    return records.select("id", F.lit(TITLES[kind]).alias("title"), F.when(error.isNull(), body).alias("body"), error.alias("error"))


def render(title: Column, body: Column, format: str) -> Column:
    """A text or Markdown document without the control characters that XML forbids."""
    if format not in FORMATS:
        raise ValueError("this format needs an export package that isn't installed")
    clean = F.regexp_replace(body, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.concat(F.lit("# " if format == "md" else ""), title, F.lit("\n\n"), clean, F.lit("\n"))


def review_notes(*lists: Column) -> Column:
    """One list of all notes in order; missing lists are empty."""
    none = F.array().cast("array<string>")
    return F.concat(*(F.coalesce(x, none) for x in lists))


def batch_warnings(prefix: str, number: Column, warnings: Column) -> Column:
    """Each different warning once, in order, with the name of its page or document."""
    return F.transform(F.array_distinct(warnings), lambda w: F.concat(F.lit(f"{prefix} "), number.cast("string"), F.lit(": "), w))


def next_state(status: Column, event: Column) -> Column:
    """A stage's status after an event; what makes no sense changes nothing."""
    return (
        F.when((status == "pending") & (event == "start"), "active")
        .when(status.isin("pending", "active") & (event == "finish"), "done")
        .when((status == "pending") & (event == "skip"), "skipped")
        .when(status.isin("pending", "active") & (event == "fail"), "error")
        .otherwise(status)
    )


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "running").alias("active_jobs"))
