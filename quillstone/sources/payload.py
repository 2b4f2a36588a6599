"""Request payloads as rows: the first rule that a payload breaks, its status, and what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as t

# Reasons.
BAD_IDENTIFIERS = "Additional identifiers must be up to 50 entries, 2 to 180 characters each."
BAD_MODE = "Choose balanced, thorough or fast transcription."
BAD_COUNT = "Select between 1 and 10 documents."
BOTH = "Send documents or pasted text, not both."
NEITHER = "Provide documents or pasted text."
TOO_MUCH = "Documents exceed the 64 MB combined limit."


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """payloads (batch_id, text, files array<struct<filename,content_b64>>, additional array<string>, mode) checked:
    batch_id, error, status, text, files (filename, content), additional, mode, bytes. error is null for a good payload.
    """
    ids = F.transform(F.coalesce("additional", F.array().cast("array<string>")), lambda x: t.strip(x))
    mode = F.coalesce("mode", F.lit("balanced"))
    bad_ids = (F.size(ids) > fixed.MAX_IDENTIFIERS) | F.exists(ids, lambda x: x.isNull() | ~F.length(x).between(2, fixed.MAX_NAME_CHARS))
    given = F.col("files").isNotNull()
    files = F.transform("files", lambda f: F.struct(t.safe_filename(f["filename"]).alias("filename"), F.try_to_binary(f["content_b64"], F.lit("base64")).alias("content"), (F.length(t.strip(f["filename"])) > 0).alias("named"), f["content_b64"].alias("raw")))
    size = F.aggregate(files, F.lit(0).cast("long"), lambda n, f: n + F.coalesce(F.octet_length(f["content"]), F.lit(0)))

    def reason(i, f):
        no = F.format_string("Document %d", i + 1)
        name = f["filename"]
        ext = t.extension(name)
        return (
            F.when(~F.coalesce(f["named"], F.lit(False)), F.concat(no, F.lit(" needs a filename.")))
            .when(F.length(name) > fixed.MAX_NAME_CHARS, F.concat(no, F.lit(": filename is too long (max 180 characters).")))
            .when(~ext.isin(*fixed.EXTENSIONS), F.concat(name, F.lit(": unsupported file type. Supported: " + ", ".join(fixed.EXTENSIONS))))
            .when(f["raw"].isNull(), F.concat(name, F.lit(": missing file content.")))
            .when(f["content"].isNull(), F.concat(name, F.lit(": invalid base64 content.")))
            .when(F.octet_length(f["content"]) == 0, F.concat(name, F.lit(": the document is empty.")))
        )

    rows = payloads.withColumns({"_files": files, "_bytes": F.coalesce(size, F.lit(0).cast("long"))})
    first = F.get(F.filter(F.transform("_files", lambda f, i: reason(i, f)), lambda r: r.isNotNull()), F.lit(0))
    error = (
        F.when(bad_ids, BAD_IDENTIFIERS)
        .when(~mode.isin(*fixed.MODES), BAD_MODE)
        .when(given & ~F.size("files").between(1, fixed.MAX_DOCUMENTS), BAD_COUNT)
        .when(given & F.col("text").isNotNull(), BOTH)
        .when(~given & (F.length(t.strip(F.coalesce("text", F.lit("")))) == 0), NEITHER)
        .when(given, F.coalesce(first, F.when(F.col("_bytes") > fixed.MAX_UPLOAD_BYTES, TOO_MUCH)))
    )
    out = rows.withColumn("error", error)
    status = F.when(F.col("error") == TOO_MUCH, 413).when(F.col("error").isNotNull(), 400)
    kept = F.transform("_files", lambda f: F.struct(f["filename"].alias("filename"), f["content"].alias("content")))
    return out.select("batch_id", "error", status.alias("status"), "text", kept.alias("files"), ids.alias("additional"), mode.alias("mode"), F.col("_bytes").alias("bytes"))


def drop_repeated(uploads: DataFrame, keys: list[str]) -> DataFrame:
    """One of the files of each request that have the same name, size and time of change."""
    return uploads.dropDuplicates([*keys, "name", "size", "mtime"])


def stored_name(job_id: str, index: int, filename: str) -> str:
    """The name that a file is kept under: two of one name stay apart by their place."""
    return f"{job_id}_{index:02d}_{filename}"
