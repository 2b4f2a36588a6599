"""Evidence units, prompts, and checks of machine-written summaries against the passages that they cite."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import fixed
from quillstone.functions import text as t


_WHITE = re.escape(t.WHITE)
_BLANK_LINES, _LEADING = re.compile(rf"\n[{_WHITE}]*\n"), re.compile(f"[{_WHITE}]*")
_MARKER = re.compile(fixed.DOCUMENT_MARKER, re.ASCII)


def _pieces(block: str) -> Iterator[str]:
    """A stripped block in pieces of at most UNIT_CHARS: each ends after its last line feed or full stop with a space past UNIT_LEAST."""
    at, most, least = 0, fixed.UNIT_CHARS, fixed.UNIT_LEAST
    while len(block) - at > most:
        split = max(block.rfind(end, at + least, at + most) for end in ("\n", ". "))
        cut = split + 1 if split >= 0 else at + most
        if piece := block[at:cut].strip(t.WHITE):
            yield piece
        at = _LEADING.match(block, cut).end()
    yield block[at:]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("document", "text")])))
def _passages(text: pa.Array) -> pa.Array:
    """The passages of each text in order, with the document that the last marker before them names. A text is walked once, by offsets."""
    cuts, documents, pieces = [0], [], []
    for value in text:
        document = "Document 1"
        for block in _BLANK_LINES.split(value.as_py() or ""):
            if block := block.strip(t.WHITE):
                if found := _MARKER.match(block):
                    document = f"Document {found[1]}"
                pieces += _pieces(block)
                documents += [document] * (len(pieces) - len(documents))
        cuts.append(len(pieces))
    rows = pa.StructArray.from_arrays([pa.array(documents, pa.string()), pa.array(pieces, pa.string())], names=["document", "text"])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows)


def evidence_units(batches: DataFrame) -> DataFrame:
    """batch_id, unit_no, id, document, text of the passages of each batch (batch_id, text), in order, losing nothing but white space.

    Blocks between blank lines are cut into pieces; a block that starts with a document marker names the document of itself and of what follows.
    A batch is one row and its units are numbered there, without a shuffle.
    """
    units = batches.select("batch_id", F.posexplode(_passages(F.col("text"))).alias("_i", "_u"))
    no = F.col("_i") + 1
    return units.select("batch_id", no.alias("unit_no"), F.format_string("E%04d", no).alias("id"), "_u.document", "_u.text")


def batch_units(batches: DataFrame) -> DataFrame:
    """batch_id, units (unit_no, id, document, text): the same as one row for each batch that has any, for what needs a batch's units together again.

    Blank texts are left out ahead of the passages: a condition on the units would be put below them and cut each text twice.
    """
    number = lambda u, i: F.struct((i + 1).alias("unit_no"), F.format_string("E%04d", i + 1).alias("id"), u["document"].alias("document"), u["text"].alias("text"))
    full = batches.where(F.length(t.strip(F.col("text"))) > 0)
    return full.select("batch_id", F.transform(_passages(F.col("text")), number).alias("units"))


#: Documents whose units are counted together.
DOCUMENTS = 1024


def document_units(parts: DataFrame) -> DataFrame:
    """The same for batches whose documents stay rows: parts (batch_id, doc_index, text), each under its marker, in the order of doc_index.

    A document's units are made inside its row. Their numbers follow from the sizes of the documents before it, added up in blocks of DOCUMENTS documents and over
    the blocks, so that no task holds a batch. A null text is empty; a null doc_index comes first. Documents of equal doc_index follow each other in the order of their texts.
    """
    rows = parts.select(F.struct("batch_id").alias("_b"), F.coalesce(F.col("doc_index").cast("long"), F.lit(-1)).alias("_d"), F.xxhash64("text").alias("_h"), _passages(F.col("text")).alias("_units"))
    rows = rows.select("_b", "_d", "_h", F.floor(F.col("_d") / DOCUMENTS).alias("_block"), "_units", F.size("_units").cast("long").alias("_n"))
    within = Window.partitionBy("_b", "_block").orderBy("_d", "_h").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("_b").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_b", "_block").agg(F.sum("_n").alias("_sum")).select("_b", "_block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_ahead"))
    placed = rows.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(sums, ["_b", "_block"])
    units = placed.select("_b.batch_id", (F.col("_ahead") + F.col("_before")).alias("_before"), F.posexplode("_units").alias("_i", "_u"))
    no = (F.col("_before") + F.col("_i") + 1).cast("int")
    return units.select("batch_id", no.alias("unit_no"), F.format_string("E%04d", no).alias("id"), "_u.document", "_u.text")


def user_prompts(units: DataFrame) -> DataFrame:
    """batch_id, prompt: a batch's units with their ids, in order."""
    return units.groupBy("batch_id").agg(F.expr("listagg(concat('[', id, ']\\n', text), '\\n\\n') WITHIN GROUP (ORDER BY unit_no)").alias("prompt"))


def batch_prompts(batches: DataFrame) -> DataFrame:
    """user_prompts of batch_units, without a shuffle."""
    return batch_units(batches).select("batch_id", F.array_join(F.transform("units", lambda u: F.concat(F.lit("["), u["id"], F.lit("]\n"), u["text"])), "\n\n").alias("prompt"))


_WORD = re.compile(r"\b\w+\b")


def check_response(raw: str, known: set[str]) -> tuple[str | None, list | None, list | None, int | None]:
    """(first rule that fails, sentences, notes, words) of a model's answer. JSON types matter, so this is Python."""
    try:
        data = json.loads(raw)
    except (TypeError, ValueError):
        return "invalid JSON", None, None, None
    text = lambda x: isinstance(x, str)
    data = data if isinstance(data, dict) else {}
    given, notes = data.get("sentences"), data.get("uncertainties")
    if not isinstance(given, list) or not given:
        return fixed.BAD_SUMMARY, None, None, None
    if not isinstance(notes, list) or not all(map(text, notes)):
        return fixed.BAD_NOTES, None, None, None
    if len(notes) > fixed.MAX_NOTES or any(not n.strip() or len(n) > fixed.MAX_NOTE_CHARS for n in notes):
        return fixed.TOO_MANY_NOTES, None, None, None
    out, words = [], 0
    for s in given:
        body, cited = (s.get("text"), s.get("evidence")) if isinstance(s, dict) else (None, None)
        if not text(body) or not body.strip() or not isinstance(cited, list) or not cited or not all(text(c) and c in known for c in cited):
            return fixed.BAD_REFERENCES, None, None, None
        if len(cited) > fixed.MAX_EVIDENCE or len(body) > fixed.MAX_SENTENCE_CHARS:
            return fixed.TOO_LONG_SENTENCE, None, None, None
        out.append({"text": body.strip(), "evidence": list(dict.fromkeys(cited))})
        words += len(_WORD.findall(body))
    if words > fixed.MAX_WORDS or len(out) > fixed.MAX_SENTENCES:
        return fixed.TOO_LONG_SUMMARY, None, None, None
    return None, out, notes, words


CHECKED = "batch_id long, error string, sentences array<struct<text:string,evidence:array<string>>>, uncertainties array<string>, words int"


def validate_responses(responses: DataFrame, units: DataFrame) -> DataFrame:
    """CHECKED for each response (batch_id, response): error is null for a valid one, else the first rule that it breaks."""
    known = units.groupBy("batch_id").agg(F.collect_set("id").alias("known"))
    rows = responses.select(F.col("batch_id").cast("long").alias("batch_id"), "response").join(known.withColumn("batch_id", F.col("batch_id").cast("long")), "batch_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"batch_id": r["batch_id"], **dict(zip(("error", "sentences", "uncertainties", "words"), check_response(r["response"], set(r["known"] or ())), strict=True))} for r in batch.to_pylist()]
            kind = pa.struct([("text", pa.string()), ("evidence", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("batch_id", pa.int64()), ("error", pa.string()), ("sentences", pa.list_(kind)), ("uncertainties", pa.list_(pa.string())), ("words", pa.int32())]))

    return rows.mapInArrow(run, CHECKED)


def unknown_citations(sentences: DataFrame, units: DataFrame) -> DataFrame:
    """Citations (batch_id, sentence_no, id) that name no unit of their batch."""
    cited = sentences.select("batch_id", "sentence_no", F.explode("evidence").alias("id"))
    return cited.join(units.select("batch_id", "id"), ["batch_id", "id"], "left_anti").select("batch_id", "sentence_no", "id")


def cited_sources(sentences: DataFrame, units: DataFrame) -> DataFrame:
    """batch_id, sentence_no, text, source: each sentence with the text of the units that it cites, in its order."""
    cited = sentences.select("batch_id", "sentence_no", "text", F.posexplode("evidence").alias("cite_no", "id"))
    joined = cited.join(units.select("batch_id", "id", F.col("text").alias("unit")), ["batch_id", "id"])
    return joined.groupBy("batch_id", "sentence_no", "text").agg(F.expr("listagg(unit, ' ') WITHIN GROUP (ORDER BY cite_no)").alias("source"))


def number_warnings(sentences: DataFrame, units: DataFrame) -> DataFrame:
    """batch_id, sentence_no, warning for sentences with a number that their cited source doesn't have."""
    odd = F.size(F.array_except(t.number_tokens(F.col("text")), t.matches(F.col("source"), fixed.NUMBER))) > 0
    warning = F.format_string("Sentence %d contains a number not found in its cited source; check it.", F.col("sentence_no"))
    return cited_sources(sentences, units).where(odd).select("batch_id", "sentence_no", warning.alias("warning"))


def render_summary(sentences: Column) -> Column:
    """Sentences with their citations, a blank line between them."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(s["text"], F.lit(" ["), F.array_join(s["evidence"], ", "), F.lit("]"))), "\n\n")


def summary_words(sentences: Column) -> Column:
    return F.aggregate(sentences, F.lit(0), lambda n, s: n + F.size(t.matches(s["text"], r"(?U)\b\w+\b")))
