"""The whole job: batches of documents in, records out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.operators import batches, calls, evidence, pseudonym
from quillstone.operators import spans as sp
from quillstone.sources import files
from quillstone.sources.boundary import Progress, written

#: A detector: a passage's text -> (kind, text) suggestions, or None where it fails. It may raise one of calls.FAILURES too.
Detector = Callable[[str], list[tuple[str, str]] | None]
#: A generator: (prompt, units) -> (sentences, uncertainties).
Generator = Callable[[str, list[dict]], tuple[list[dict], list[str]]]


def detect_passages(parts: DataFrame, detector: Detector, **options) -> tuple[DataFrame, DataFrame]:
    """Spans (batch_id, doc_index, start, end, kind) that a detector finds in the passages of documents, and counts by batch: passages, fallback_passages (failed ones), discarded (invalid suggestions).

    Each passage is asked for once; both results read the written answers. One on which the detector fails keeps its rules; its batch counts it.
    """
    passages = parts.select("batch_id", "doc_index", F.inline(sp.page_chunks(F.col("text"))))

    def call(row: dict) -> list[dict]:
        found = detector(row["text"])
        if found is None:
            raise ValueError("the detector failed")
        return [{"kind": k, "value": v} for k, v in found]

    told = calls.ask(passages, call, "array<struct<kind:string,value:string>>", name="suggestions", **options)
    good = lambda x: sp.entity_valid(x["kind"], x["value"], F.col("text"))
    valid = F.filter("answer", good)
    count = lambda c: F.sum(c).cast("long")
    counts = told.groupBy("batch_id").agg(F.count("*").alias("passages"), F.count_if(F.col("error").isNotNull()).alias("fallback_passages"), F.coalesce(count(F.size(F.coalesce("answer", F.array())) - F.size(F.coalesce(valid, F.array()))), F.lit(0)).alias("discarded"))
    places = told.select("batch_id", "doc_index", "start", "text", F.explode(valid).alias("v"))
    places = places.select("batch_id", "doc_index", "start", F.explode(sp.t.occurrences(F.col("text"), F.col("v.value"), F.col("v.kind"))).alias("s"))
    return places.select("batch_id", "doc_index", (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"), F.col("s.kind").alias("kind")), counts


#: Of a batch: passages that a detector read, those on which it failed, and its invalid suggestions.
COUNTS = ("passages", "fallback_passages", "discarded")


def privacy_warnings() -> Column:
    """What a reader of a pseudonymised batch should know, from the columns of `process`."""
    failed = F.format_string(fixed.DETECTOR_FAILED, "fallback_passages", "passages")
    some = F.when(F.col("fallback_passages") > 0, failed), F.when(F.col("discarded") > 0, F.format_string(fixed.SUGGESTIONS_DISCARDED, "discarded"))
    return F.array_compact(F.array(F.lit(fixed.REVIEW_BEFORE_SHARING), *some, F.when(F.size("residual_flags") > 0, fixed.IDENTIFIERS_REMAIN)))


_MADE = "struct<sentences:array<struct<text:string,evidence:array<string>>>,uncertainties:array<string>>"


def _by_kind(documents: DataFrame, column: str) -> DataFrame:
    """batch_id and the sums of a map of counts over the batch's documents, as a map."""
    return batches.by_batch(documents, column).groupBy("batch_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "hits")))).alias(column))


def process(documents: DataFrame, generator: Generator, detector: Detector | None = None, progress: Progress | None = None, **limits: int) -> DataFrame:
    """documents (batch_id, doc_index, text) to one record for each batch: pseudonymised text, summary with originals restored, counts, error.

    A batch with an empty document or more than MAX_DOCUMENTS fails; so does one whose summary changes a placeholder, or whose generator raises one of
    calls.FAILURES; others aren't affected. Detector and generator are asked once for each passage and batch; `limits` (in_flight, tasks) bounds the
    calls under way; `progress` hears of each stage that is done and of its counts. Documents stay rows until a batch's prompt is made. The mapping is not in the result.
    """
    joined = written(files.batch_text(documents, fixed.MAX_DOCUMENTS).select("batch_id", "document_count", F.col("error").alias("_empty")), "batches", progress, batches=F.count(F.lit(1)), documents=F.sum("document_count"), failed=F.count("_empty"))
    parts = files.document_parts(documents.join(joined.where("_empty IS NULL").select("batch_id"), "batch_id", "left_semi"))
    detected, counts = detect_passages(parts, detector, progress=progress, **limits) if detector else (None, None)
    anon = batches.pseudonymise(parts, detected)
    done = written(anon.documents, "pseudonymised", progress, documents=F.count(F.lit(1)), hits=F.sum(F.aggregate(F.map_values("phi_hits"), F.lit(0), lambda a, b: a + b)))
    texts = files.joined_parts(done)
    units = written(evidence.document_units(done), "units")
    packed = units.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "id", "document", "text"))).alias("units"))

    def call(row: dict) -> dict:
        sentences, notes = generator(row["prompt"], row["units"])
        return {"sentences": sentences, "uncertainties": notes}

    made = calls.ask(evidence.user_prompts(units).join(packed, "batch_id"), call, _MADE, name="summaries", progress=progress, **limits)
    made = made.select("batch_id", "error", evidence.render_summary(F.col("answer.sentences")).alias("summary"), F.col("answer.uncertainties").alias("uncertainties"))
    order = F.array_sort(F.collect_list(F.struct("doc_index", "start", "surface", "token")))
    mapping = anon.mapping.groupBy("batch_id").agg(F.transform(order, lambda m: F.struct(m["surface"].alias("surface"), m["token"].alias("token"))).alias("mapping"))
    rows = joined.join(texts.withColumnRenamed("text", "pseudonymised_text"), "batch_id", "left").join(made, "batch_id", "left").join(mapping, "batch_id", "left")
    for column in ("phi_hits", "residual_flags"):
        none = F.when(F.col("_empty").isNull(), F.create_map().cast("map<string,bigint>"))
        rows = rows.join(_by_kind(done, column), "batch_id", "left").withColumn(column, F.coalesce(column, none))
    if counts is None:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in COUNTS})
    else:
        rows = rows.join(counts, "batch_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS})
    rows = rows.withColumn("mapping", F.coalesce("mapping", F.array().cast("array<struct<surface:string,token:string>>")))
    tokens = F.transform("mapping", lambda m: m["token"])
    generated = F.concat_ws("\n", F.col("summary"), F.array_join("uncertainties", "\n"))
    changed = F.size(pseudonym.unknown_placeholders(generated, F.col("pseudonymised_text"), tokens)) > 0
    error = F.coalesce(F.col("_empty"), F.col("error"), F.when(changed, "the model changed an identifier placeholder"))
    restored = pseudonym.restore(F.col("summary"), F.col("mapping"))
    return rows.select("batch_id", "document_count", error.alias("error"), F.when(error.isNull(), F.col("pseudonymised_text")).alias("pseudonymised_text"), F.when(error.isNull(), restored).alias("summary"), "phi_hits", "residual_flags", *COUNTS, privacy_warnings().alias("warnings"))


def export_text(records: DataFrame, path: str) -> None:
    """Writes rendered documents (id, document) as text files under path, a folder for each id."""
    records.select("id", F.col("document").alias("value")).write.partitionBy("id").text(path)
