"""Pages read once: text layers first, then a cascade of readers over different images only, in stages that are written between."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as t
from quillstone.operators import calls, readings
from quillstone.sources.boundary import written
from quillstone.sources.files import clean_text

#: A reader: an image's bytes -> {text, confidence, low, critical_low}; it may raise one of calls.FAILURES. low is the share of words of low confidence.
Reader = Callable[[bytes], dict]
#: A generative reader: (an image's bytes, attempt from 0) -> (its raw answer, whether it finished).
Vision = Callable[[bytes, int], tuple[str, bool]]

READING = "struct<text:string,confidence:double,low:double,critical_low:boolean>"
READ = "digest binary, text string, engine string, need_second boolean, rejected boolean, warnings array<string>, error string"
ATTEMPTS = 2


@dataclass
class Readers:
    """The readers that are there: a first one, one that checks it, and a generative one for pages on which neither finds text."""

    first: Reader | None = None
    second: Reader | None = None
    vision: Vision | None = None
    names: tuple[str, str, str] = ("first", "second", "vision_model")


def _asked(images: DataFrame, reader: Reader, number: int, name: str, limits: dict) -> DataFrame:
    """A reading (page_id, reader_no, engine, text, confidence, low, critical_low, error) of each image, asked for once. A blank text is no reading."""

    def call(row: dict) -> dict:
        found = reader(row["image"])
        return {"text": clean_text(found["text"]), "confidence": float(found["confidence"]), "low": float(found.get("low", 0)), "critical_low": bool(found.get("critical_low", False))}

    told = calls.ask(images, call, READING, name=f"reader-{number}", keep=["digest"], **limits)
    return told.select(F.col("digest").alias("page_id"), F.lit(number).alias("reader_no"), F.lit(name).alias("engine"), "answer.*", "error")


def _has_text(column: str = "text") -> Column:
    return F.length(t.strip(F.coalesce(column, F.lit("")))) > 0


def _generated(images: DataFrame, vision: Vision, limits: dict) -> DataFrame:
    """digest, text, error: what a generative reader makes of each image. An answer that broke off or loops is asked for again, ATTEMPTS times in all.

    The attempts are stages of their own, so that only images whose answer failed the checks are asked for again.
    """
    done, left = None, images
    for attempt in range(ATTEMPTS):

        def call(row: dict, attempt: int = attempt) -> dict:
            raw, finished = vision(row["image"], attempt)
            return {"raw": raw, "finished": finished}

        told = calls.ask(left, call, "struct<raw:string,finished:boolean>", name=f"vision-{attempt}", keep=["digest"], **limits)
        text = t.strip(t.strip_thinking(F.coalesce("answer.raw", F.lit(""))))
        rows = told.select("digest", text.alias("text"), F.coalesce("answer.finished", F.lit(True)).alias("_finished"), "error")
        bad = (
            F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("_finished"), fixed.VISION_STOPPED)
            .when(t.is_degenerate(F.col("text")) | t.is_loop(F.col("text")), fixed.VISION_LOOPS).when(~t.has_word(F.col("text")), fixed.VISION_NOTHING)
        )
        rows = rows.select("digest", F.when(bad.isNull(), F.col("text")).alias("text"), F.when(bad.isNotNull(), F.concat(bad, F.lit(fixed.REPLACE_SCAN))).alias("error"), F.col("error").isNotNull().alias("_failed"))
        last = attempt == ATTEMPTS - 1
        final = rows if last else rows.where("error IS NULL OR _failed")
        done = final if done is None else done.unionByName(final)
        if not last:
            left = images.join(rows.where("error IS NOT NULL AND NOT _failed").select("digest"), "digest", "left_semi")
    return done.select("digest", "text", "error")


def cascade(images: DataFrame, readers: Readers, mode: str = "balanced", **limits: int) -> DataFrame:
    """READ of each of images (digest, image; digests are distinct). No reader is asked about an image that doesn't need it.

    The first reader sees all images; the second those on which the first has no text, isn't reliable, is unsure of a critical token, or sees columns (all in
    mode `thorough`); the generative one those without any text from both. Each stage's answers are written before the next begins. `limits`:
    in_flight and tasks of calls.ask. A null image is an empty one. Text of low confidence or in endless runs is rejected: it has an error and no text.
    """
    if mode not in fixed.MODES:
        raise ValueError("unknown transcription mode")
    pages = images.select("digest", F.coalesce("image", F.lit(b"")).alias("image"))
    schema = "page_id binary, reader_no int, engine string, text string, confidence double, low double, critical_low boolean, error string"
    read = images.sparkSession.createDataFrame([], schema)
    if readers.first:
        read = _asked(pages, readers.first, 1, readers.names[0], limits)
    sure = readings.reliable(F.col("text"), F.col("confidence"), F.col("low"))
    enough = read.where(_has_text()).where(~F.coalesce(readings.needs_second(F.lit(mode), sure, F.col("critical_low"), F.col("text")), F.lit(True)))
    need = pages.join(enough.select(F.col("page_id").alias("digest")), "digest", "left_anti")
    if readers.second:
        read = read.unionByName(_asked(need, readers.second, 2, readers.names[1], limits))
    with_text = read.where(_has_text())
    routed = readings.route(with_text, mode)
    failed = read.where("error IS NOT NULL").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("reader_no", "engine"))).alias("f"))
    failed = failed.select(F.col("page_id").alias("_failed_id"), F.transform("f", lambda x: F.format_string(fixed.READER_FAILED, x["engine"])).alias("_failures"))
    out = routed.join(failed, F.col("page_id") == F.col("_failed_id"), "left").withColumn("_failures", F.coalesce("_failures", F.array().cast("array<string>")))
    good = out.select(
        F.col("page_id").alias("digest"), F.when(~F.col("rejected"), F.col("text")).alias("text"), "engine", "need_second", "rejected", F.array_distinct(F.concat("_failures", "warnings")).alias("warnings"),
        F.when(F.col("rejected"), fixed.PAGE_REJECTED).alias("error"),
    )
    bare = pages.join(with_text.select(F.col("page_id").alias("digest")).distinct(), "digest", "left_anti")
    if readers.vision:
        seen = _generated(bare, readers.vision, limits)
    else:
        seen = bare.select("digest", F.lit(None).cast("string").alias("text"), F.lit(fixed.VISION_NOTHING + fixed.REPLACE_SCAN).alias("error"))
    marked = F.when(F.contains(F.upper("text"), F.lit(fixed.UNREADABLE)), fixed.UNREADABLE_MARKERS)
    notes = F.array_compact(F.array(F.when(F.col("text").isNotNull(), fixed.VISION_READ), marked))
    rest = seen.select("digest", "text", F.lit(readers.names[2]).alias("engine"), F.lit(True).alias("need_second"), F.col("error").isNotNull().alias("rejected"), notes.alias("warnings"), "error")
    return good.unionByName(rest)


def known_readings(spark: SparkSession, cache: str) -> DataFrame:
    """READ rows of a cache, one for each digest, whoever wrote them. A cache that isn't there yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    rows = spark.read.schema(READ).parquet(cache) if there else spark.createDataFrame([], READ)
    value = F.struct("text", "engine", "need_second", "rejected", "warnings", "error")
    return rows.groupBy("digest").agg(F.min(value).alias("v")).select("digest", "v.*")


def read_pages(pages: DataFrame, readers: Readers, mode: str = "balanced", cache: str | None = None, most_pages: int = fixed.MAX_PAGES, **limits: int) -> DataFrame:
    """pages (doc_id, page_num, native, uncovered, image) to doc_id, page_num, text, method, cached, warnings, error: each different image is read once.

    A page whose text layer is reliable (readings.native_reliable) keeps it. Of the others, the distinct images that `cache`, a table of READ rows, lacks go
    through the cascade and, if they could be read, are added to it; readings come back to all pages by digest. `cached` marks pages of a
    document whose image an earlier page of it has. Values of a text layer that the reading lacks are a warning. A page that couldn't be read has an error; the
    others aren't affected. Of a document of more than most_pages pages none is read. A null image is an empty one, a null text layer none. Rows of equal doc_id and page_num are pages of their own; the first counts as read.
    """
    rows = pages.select("doc_id", "page_num", F.coalesce("native", F.lit("")).alias("native"), readings.native_reliable(F.coalesce("native", F.lit("")), F.coalesce("uncovered", F.lit(0))).alias("_layer"), F.coalesce("image", F.lit(b"")).alias("image"))
    long = rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most_pages).select(F.struct("doc_id").alias("_k"), F.lit(True).alias("_long"))
    rows = rows.withColumn("_k", F.struct("doc_id")).join(long, "_k", "left").drop("_k")
    refused = rows.where("_long").select("doc_id", "page_num", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("method"), F.lit(False).alias("cached"), F.array().cast("array<string>").alias("warnings"), F.lit(fixed.TOO_MANY_PAGES % most_pages).alias("error"))
    rows = rows.where("_long IS NULL")
    scans = rows.where("NOT _layer").withColumn("digest", F.unhex(F.sha2("image", 256)))
    images = scans.groupBy("digest").agg(F.first("image").alias("image"))
    known = None
    if cache:
        known = written(known_readings(pages.sparkSession, cache), "known-readings")
        images = images.join(known.select("digest"), "digest", "left_anti")
    read = written(cascade(written(images, "images"), readers, mode, **limits), "readings")
    if cache:
        read.where("error IS NULL").write.mode("append").parquet(cache)
        read = read.unionByName(known)
    light = scans.select("doc_id", "page_num", "native", "digest")
    first = light.groupBy("doc_id", "digest").agg(F.min("page_num").alias("_first")).select(F.struct("doc_id", "digest").alias("_k"), "_first")
    placed = light.withColumn("_k", F.struct("doc_id", "digest")).join(first, "_k").join(read.withColumnRenamed("engine", "method"), "digest")
    lost = F.size(readings.lost_tokens(F.col("native"), F.col("text"))) > 0
    notes = F.concat("warnings", F.when(F.coalesce(lost, F.lit(False)), F.array(F.lit(fixed.LAYER_VALUES_LOST))).otherwise(F.array().cast("array<string>")))
    scanned = placed.select("doc_id", "page_num", "text", "method", (F.col("page_num") > F.col("_first")).alias("cached"), notes.alias("warnings"), "error")
    own = rows.where("_layer").select("doc_id", "page_num", F.col("native").alias("text"), F.lit("native").alias("method"), F.lit(False).alias("cached"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("error"))
    return own.unionByName(scanned).unionByName(refused)


def transcriptions(read: DataFrame) -> DataFrame:
    """doc_id, text, warnings, error of read_pages' rows: pages in order under their markers, each warning with its page; a document with an unread page fails with that of its first."""
    marked = F.when(_has_text(), F.concat(F.format_string("--- Sida %d ---\n\n", F.col("page_num")), F.col("text")))
    page = F.struct("page_num", marked.alias("text"), F.transform("warnings", lambda w: F.concat(F.format_string("Page %d: ", F.col("page_num")), w)).alias("notes"), F.concat(F.format_string("Page %d: ", F.col("page_num")), F.col("error")).alias("error"))
    docs = read.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    error = F.get(F.array_compact(F.transform("p", lambda x: x["error"])), F.lit(0))
    text = F.array_join(F.array_compact(F.transform("p", lambda x: x["text"])), "\n\n")
    return docs.select("doc_id", F.when(error.isNull(), text).alias("text"), F.flatten(F.transform("p", lambda x: x["notes"])).alias("warnings"), error.alias("error"))


def symbols_first(images: DataFrame, symbols: DataFrame, readers: Readers, mode: str = "balanced", **limits: int) -> DataFrame:
    """READ of images of a document (digest, width, height, pixels, image; digests are distinct): a known symbol's description, and a reading of the others.

    symbols: (symbol_id, width, height, digest, description), found by exact size and pixels (readings.lookup_symbols). No reader is asked about a symbol.
    """
    known = readings.lookup_symbols(images.withColumnRenamed("digest", "_id"), symbols)
    found = known.where("symbol_id IS NOT NULL").groupBy(F.col("_id").alias("digest")).agg(F.min_by("description", "symbol_id").alias("text"))
    found = written(found, "symbols")
    rest = cascade(images.join(found.select("digest"), "digest", "left_anti").select("digest", "image"), readers, mode, **limits)
    plain = found.select("digest", "text", F.lit("symbol").alias("engine"), F.lit(False).alias("need_second"), F.lit(False).alias("rejected"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("error"))
    return plain.unionByName(rest)
