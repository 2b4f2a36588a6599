"""Pseudonymisation of batches: consistent typed tokens, replacement, restoration, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as t
from quillstone.operators import batches
from quillstone.operators.detect import all_rule_spans


def _documents(frame: DataFrame) -> DataFrame:
    """Batches (batch_id, text) as documents of operators/batches.py: one each."""
    return frame.select("batch_id", F.lit(0).alias("doc_index"), "text")


def pseudonymise(frame: DataFrame, detected: DataFrame | None = None, canonical: bool = False) -> DataFrame:
    """batch_id, text (pseudonymised), phi_hits, mapping (array of surface, token, kind; `canonical` too if asked for), residual_flags, for each batch (batch_id, text, and `additional` if there is one).

    For batches that are one text each, such as those of a job of few documents; operators/batches.py does the same where documents stay rows.
    detected: (batch_id, start, end, kind). The mapping is in the order of first places. It restores the original; keep it apart from what is written.
    """
    listed = frame.select("batch_id", F.explode("additional").alias("value")) if "additional" in frame.columns else None
    found = None if detected is None else detected.select("batch_id", F.lit(0).alias("doc_index"), "start", "end", "kind")
    done = batches.pseudonymise(_documents(frame), found, listed)
    fields = ("surface", *(["canonical"] if canonical else []), "token", "kind")
    rows = F.array_sort(F.collect_list(F.struct("doc_index", "start", *fields)))
    mapping = done.mapping.groupBy(F.struct("batch_id").alias("_b")).agg(F.transform(rows, lambda m: F.struct(*(m[c].alias(c) for c in fields))).alias("mapping"))
    none = F.array().cast(mapping.schema["mapping"].dataType)
    joined = done.documents.withColumn("_b", F.struct("batch_id")).join(mapping, "_b", "left")
    return joined.select("batch_id", "text", "phi_hits", F.coalesce("mapping", none).alias("mapping"), "residual_flags")


def residual(text: Column) -> Column:
    """map<kind, count> of rule matches in a text that should have none."""
    return batches._counts(F.transform(all_rule_spans(text), lambda s: s["kind"]))


def restore(text: Column, mapping: Column) -> Column:
    """text with each token that the mapping has replaced by a surface of it (the last one, where case variants share a token)."""
    gaps, hits = F.split(text, fixed.TOKEN, -1), t.matches(text, fixed.TOKEN)
    back = F.transform(hits, lambda h: F.coalesce(F.try_element_at(F.filter(mapping, lambda m: m["token"] == h), F.lit(-1))["surface"], h))
    both = F.zip_with(gaps, F.concat(back, F.array(F.lit(""))), lambda g, b: F.concat(g, b))
    return F.when(F.size(mapping) > 0, F.array_join(both, "")).otherwise(text)


def apply_mapping(text: Column, mapping: Column) -> Column:
    """text with each surface (array of surface, token) replaced in one pass, the longest first, whole words, in the case given."""
    longest = F.array_sort(F.transform(mapping, lambda m: F.struct((-F.length(m["surface"])).alias("l"), m["surface"].alias("surface"), m["token"].alias("token"))))
    quoted = F.transform(longest, lambda m: F.concat(F.lit("\\Q"), F.replace(m["surface"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)(?:"), F.array_join(quoted, "|"), F.lit(r")(?!\w)"))
    lookup = F.map_from_entries(F.transform(F.array_distinct(F.transform(mapping, lambda m: m["surface"])), lambda k: F.struct(k, F.filter(mapping, lambda m: m["surface"] == k)[0]["token"])))
    both = F.zip_with(F.split(text, pattern, -1), F.concat(t.let(lookup, lambda known: F.transform(t.matches(text, pattern), lambda h: known[h])), F.array(F.lit(""))), lambda g, b: F.concat(g, b))
    return F.when(F.size(mapping) > 0, F.array_join(both, "")).otherwise(text)


def unknown_placeholders(generated: Column, source: Column, tokens: Column) -> Column:
    """Placeholders of a generated text that neither its source nor the mapping has."""
    return F.array_except(F.array_except(t.placeholders(generated), t.placeholders(source)), tokens)


def seal(mapping: Column, key: Column) -> Column:
    """A mapping as AES-GCM ciphertext; the key should live only as long as the run."""
    return F.aes_encrypt(F.to_json(mapping).cast("binary"), key, F.lit("GCM"))


def unseal(sealed: Column, key: Column) -> Column:
    return F.from_json(F.aes_decrypt(sealed, key, F.lit("GCM")).cast("string"), "array<struct<surface:string,token:string,kind:string>>")
