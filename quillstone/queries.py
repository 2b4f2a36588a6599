"""One query for each operator, over whole tables, with the SQL that gives the same rows.

Batches of documents are made by `source`; batches of notes (see sources/corpus.py) by customer.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import fixed
from quillstone.functions import text as t
from quillstone.operators import batches, codebook, evidence, images, planning, pseudonym, readings
from quillstone.operators import spans as sp
from quillstone.operators.detect import find_spans
from quillstone.plans import reading, records, store, summarise
from quillstone.sources import boundary, corpus, files, payload, sink
from quillstone.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- Identifier spans -------------------------------------------------------------------------------------------------

_EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-zÅÄÖåäö]{2,}\b"
_NOTES = f"SELECT o_orderkey AS note_id, o_custkey AS batch_id, o_orderkey, o_custkey, o_orderdate, {corpus.note_sql('duckdb')} AS text FROM orders"
_SPANS = " UNION ALL ".join(f"SELECT o_orderkey AS note_id, o_custkey AS batch_id, '{k}' AS kind, CAST({s} AS BIGINT) AS start, {v} AS value FROM orders" for k, s, v in corpus.expected_spans_sql("duckdb"))
_LABEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.KINDS.items()) + " END"


@query(f"""
    WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS hits FROM documents),
    e AS (SELECT doc_id, unnest(hits) AS value, generate_subscripts(hits, 1) - 1 AS span_no FROM m WHERE len(hits) > 0)
    SELECT doc_id, CAST(span_no AS BIGINT) AS span_no, value, CAST(length(value) AS BIGINT) AS n_chars FROM e
""")
def email_spans(spark, sf_dir):
    docs = corpus.spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text").where(F.contains("text", F.lit("@")))
    rows = sp.explode_spans(docs.withColumn("spans", sp.rule_spans(F.col("text"), ("EMAIL",))), "spans", "text")
    return rows.select("doc_id", long("span_no").alias("span_no"), "value", long(F.col("end") - F.col("start")).alias("n_chars"))


@query(f"""
    WITH e AS (SELECT lang, doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents)
    SELECT lang, count(*) AS spans, count(DISTINCT doc_id) AS docs, count(DISTINCT lower(v)) AS surfaces FROM e GROUP BY lang
""")
def email_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where(F.contains("text", F.lit("@")))
    rows = sp.explode_spans(docs.withColumn("spans", sp.rule_spans(F.col("text"), ("EMAIL",))), "spans", "text")
    return rows.groupBy("lang").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"), F.countDistinct(F.lower("value")).alias("surfaces"))


@query(f"""
    WITH e AS (SELECT doc_id // 8 AS batch_id, doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) AS v, generate_subscripts(regexp_extract_all(text, '{_EMAIL}'), 1) AS k FROM documents),
    f AS (SELECT batch_id, v, min(doc_id * 100000 + k) AS first FROM e GROUP BY batch_id, v)
    SELECT batch_id, v AS canonical, '[EMAIL_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || ']' AS token FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY first) AS n FROM f)
""")
def email_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 8").alias("batch_id"), "text").where(F.contains("text", F.lit("@")))
    rows = sp.explode_spans(docs.withColumn("spans", sp.rule_spans(F.col("text"), ("EMAIL",))), "spans", "text")
    firsts = rows.groupBy("batch_id", F.lower("value").alias("canonical")).agg(F.min(F.struct("doc_id", "start")).alias("first"))
    n = F.row_number().over(Window.partitionBy("batch_id").orderBy("first"))
    return firsts.select("batch_id", "canonical", F.format_string("[EMAIL_%02d]", n).alias("token"))


@query(f"SELECT note_id, kind, start, start + length(value) AS stop, value FROM ({_SPANS})")
def rule_spans(spark, sf_dir):
    notes = corpus.notes(spark, sf_dir).select("note_id", "text", find_spans(F.col("text")).alias("spans"))
    return sp.explode_spans(notes, "spans", "text").select("note_id", "kind", long("start").alias("start"), long("end").alias("stop"), "value")


@query()
def document_rule_spans(spark, sf_dir):
    """All identifier rules over all documents. Without SQL: DuckDB has no look-around; a property test holds the Arrow and the column version together."""
    docs = corpus.spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", find_spans(F.col("text")).alias("spans"))
    return sp.explode_spans(docs, "spans", "text").select("doc_id", "kind", long("start").alias("start"), long("end").alias("stop"), "value")


@query(f"SELECT kind, count(*) AS hits FROM ({_SPANS}) GROUP BY kind")
def phi_hits_by_kind(spark, sf_dir):
    notes = corpus.notes(spark, sf_dir).select(F.explode(find_spans(F.col("text"))).alias("s"))
    return notes.groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("hits"))


def _parts(spark, sf_dir) -> DataFrame:
    return files.document_parts(corpus.notes(spark, sf_dir))


_NUMBERED = f"""
    WITH s AS (SELECT batch_id, kind, note_id * 10000 + start AS place, lower(value) AS canonical FROM ({_SPANS})),
    f AS (SELECT batch_id, kind, canonical, min(place) AS first FROM s GROUP BY batch_id, kind, canonical),
    n AS (SELECT *, row_number() OVER (PARTITION BY batch_id, kind ORDER BY first) AS n FROM f),
    k AS (SELECT batch_id, kind, canonical, '[' || {_LABEL} || '_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || ']' AS token FROM n)
"""


@query(_NUMBERED + "SELECT * FROM k")
def token_assignment(spark, sf_dir):
    return batches.mapping(_parts(spark, sf_dir)).select("batch_id", "canonical", "kind", "token").distinct()


@query(
    _NUMBERED
    + ", "
    + "p AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, "
    + " || ".join(f"({s})" if k is None else f"(SELECT token FROM k WHERE k.batch_id = o.o_custkey AND k.kind = '{k}' AND k.canonical = lower({s}))" for k, s in corpus.segments("duckdb"))
    + " AS part FROM orders o) SELECT o_custkey AS batch_id, string_agg('--- Document ' || i || ' ---' || chr(10) || part, chr(10) || chr(10) ORDER BY i) AS text FROM p GROUP BY o_custkey"
)
def pseudonymised_text(spark, sf_dir):
    return files.joined_parts(batches.pseudonymise(_parts(spark, sf_dir)).documents)


@query(f"SELECT batch_id, kind, count(*) AS hits FROM ({_SPANS}) GROUP BY batch_id, kind")
def phi_hits(spark, sf_dir):
    return batches.by_batch(batches.pseudonymise(_parts(spark, sf_dir)).documents, "phi_hits")


@query("SELECT o_custkey AS batch_id, CAST(0 AS BIGINT) AS residual FROM orders GROUP BY o_custkey")
def residual_screen(spark, sf_dir):
    left = F.aggregate(F.map_values("residual_flags"), F.lit(0), lambda a, b: a + b)
    return batches.pseudonymise(_parts(spark, sf_dir)).documents.groupBy("batch_id").agg(long(F.sum(left)).alias("residual"))


_BATCH_SQL = f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY note_id) AS i FROM ({_NOTES}))
    SELECT batch_id, string_agg('--- Document ' || i || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS text FROM n GROUP BY batch_id
"""


@query(_BATCH_SQL)
def restore_roundtrip(spark, sf_dir):
    done = batches.pseudonymise(_parts(spark, sf_dir))
    return files.joined_parts(batches.restore(done.documents, done.mapping))


@query(
    "SELECT c_custkey AS batch_id, CASE WHEN c_custkey % 3 = 0 THEN '[EMAIL_02]' ELSE '[EMAIL_01]' END AS token_1, CASE WHEN c_custkey % 3 = 0 THEN '[EMAIL_04]' WHEN c_custkey % 3 = 1 THEN '[EMAIL_03]' ELSE '[EMAIL_02]' END AS token_2 FROM customer"
)
def occupied_tokens(spark, sf_dir):
    taken = F.when(F.col("c_custkey") % 3 == 0, "[EMAIL_01] [EMAIL_03]").when(F.col("c_custkey") % 3 == 1, "[EMAIL_02]").otherwise("[EMAIL_1] [EMAIL_002]")
    text = F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@example.invalid, b@example.invalid, "), taken)
    docs = table(spark, sf_dir, "customer").select(long("c_custkey").alias("batch_id"), F.lit(1).alias("doc_index"), text.alias("text"))
    tokens = batches.mapping(docs)
    first = F.col("canonical").startswith("a")
    return tokens.groupBy("batch_id").agg(F.max(F.when(first, F.col("token"))).alias("token_1"), F.max(F.when(~first, F.col("token"))).alias("token_2"))


_GENERATED = """
    SELECT l_orderkey AS batch_id, CAST((l_partkey * 7) % 60 AS INT) AS start, CAST((l_partkey * 7) % 60 + 1 + l_suppkey % 12 AS INT) AS stop,
           CASE l_linenumber % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'DATE' ELSE 'OTHER_ID' END AS kind FROM lineitem
"""
_PRIORITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(fixed.KINDS)) + " END"


@query(f"""
    WITH RECURSIVE g AS (SELECT DISTINCT * FROM ({_GENERATED})),
    r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY {_PRIORITY}, start - stop, start, stop) AS n FROM g),
    w(batch_id, n, kept) AS (
        SELECT batch_id, n, [{{'start': start, 'stop': stop, 'kind': kind}}] FROM r WHERE n = 1
        UNION ALL
        SELECT r.batch_id, r.n, CASE WHEN len(list_filter(w.kept, lambda k: r.start < k.stop AND r.stop > k.start)) > 0 THEN w.kept ELSE list_append(w.kept, {{'start': r.start, 'stop': r.stop, 'kind': r.kind}}) END
        FROM w JOIN r ON r.batch_id = w.batch_id AND r.n = w.n + 1),
    l AS (SELECT batch_id, unnest(arg_max(kept, n)) AS k FROM w GROUP BY batch_id)
    SELECT batch_id, CAST(k.start AS BIGINT) AS start, CAST(k.stop AS BIGINT) AS stop, k.kind AS kind FROM l
""")
def resolve_overlaps(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    rows = spark.sql(_GENERATED.replace("lineitem", "_lineitem"))
    spans = rows.groupBy("batch_id").agg(F.collect_list(F.struct("start", F.col("stop").alias("end"), "kind")).alias("spans"))
    out = spans.select("batch_id", F.explode(sp.resolve(F.col("spans"))).alias("s"))
    return out.select("batch_id", long("s.start").alias("start"), long("s.end").alias("stop"), "s.kind")


@query("SELECT o_orderkey AS note_id, CAST(1 AS BIGINT) AS found, 'X-' || o_orderkey AS value FROM orders")
def additional_identifiers(spark, sf_dir):
    key = F.concat(F.lit("X-"), F.col("o_orderkey").cast("string"))
    text = F.concat(F.lit("ref "), F.lower(key), F.lit(", not "), key, F.lit("0 nor a"), key)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), key.alias("value"), text.alias("text"))
    return rows.select("note_id", long(F.size(sp.additional_spans(F.col("text"), F.array("value")))).alias("found"), "value")


@query("""
    WITH e AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'NOBODY' ELSE 'ORG' END AS kind, substr(text, 3, (turn * 7 % 12)::INT) AS value FROM conversations)
    SELECT conv_id, turn, kind <> 'NOBODY' AND length(value) BETWEEN 2 AND 180 AND contains(text, value) AS valid FROM e
""")
def entity_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.expr("CASE turn % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'NOBODY' ELSE 'ORG' END AS kind"), F.expr("substr(text, 3, CAST(turn * 7 % 12 AS INT)) AS value"))
    return rows.select("conv_id", "turn", sp.entity_valid(F.col("kind"), F.col("value"), F.col("text")).alias("valid"))


@query("""
    WITH d AS (SELECT o_orderkey, lpad(((o_orderkey * 7919) % 100)::VARCHAR, 2, '0') || lpad((1 + o_orderkey % 13)::VARCHAR, 2, '0') || lpad((1 + o_orderkey * 3 % 95)::VARCHAR, 2, '0') || lpad((o_orderkey * 104729 % 10000)::VARCHAR, 4, '0') AS v FROM orders),
    p AS (SELECT o_orderkey, v, CAST(v[5:6] AS INT) AS day0, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(v[i] AS INT)) // 10 + (2 * CAST(v[i] AS INT)) % 10 ELSE CAST(v[i] AS INT) END)) AS total FROM d)
    SELECT o_orderkey, v AS value, total % 10 = 0 AND TRY_CAST('20' || v[1:2] || '-' || v[3:4] || '-' || lpad((CASE WHEN day0 > 60 THEN day0 - 60 ELSE day0 END)::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS valid FROM p
""")
def luhn_identity(spark, sf_dir):
    digits = lambda e, n: f"lpad(CAST(({e}) AS STRING), {n}, '0')"
    value = " || ".join((digits("o_orderkey * 7919 % 100", 2), digits("1 + o_orderkey % 13", 2), digits("1 + o_orderkey * 3 % 95", 2), digits("o_orderkey * 104729 % 10000", 4)))
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{value} AS value").withColumn("valid", t.valid_identity(F.col("value")))


# --- Chunks and evidence ----------------------------------------------------------------------------------------------

_LAST = "(CASE WHEN instr(reverse({tail}), '{c}') > 0 THEN length({tail}) - instr(reverse({tail}), '{c}') - {w} ELSE -1 END)"


def _chunk_sql(most: int) -> str:
    tail = f"substr(text, pos + {most // 2} + 1, least(pos + {most}, length(text)) - pos - {most // 2})"
    lf, space = _LAST.format(tail=tail, c="' || chr(10) || '", w=0), _LAST.format(tail=tail, c=" ", w=0)
    return f"CASE WHEN pos + {most} >= length(text) THEN length(text) WHEN {lf} >= 0 THEN pos + {most // 2} + {lf} + 1 WHEN {space} >= 0 THEN pos + {most // 2} + {space} + 1 ELSE pos + {most} END"


@query(f"""
    WITH RECURSIVE c(doc_id, text, n, pos, stop) AS (
        SELECT doc_id, text, 0, 0, {_chunk_sql(3500).replace("pos", "0")} FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, text, n, pos, {_chunk_sql(3500)} FROM (SELECT doc_id, text, n + 1 AS n, stop AS pos FROM c WHERE stop < length(text)))
    SELECT doc_id, CAST(n AS BIGINT) AS chunk_no, CAST(pos AS BIGINT) AS start, CAST(stop - pos AS BIGINT) AS n_chars, md5(substr(text, pos + 1, stop - pos)) AS digest FROM c
""")
def chunks(spark, sf_dir):
    rows = corpus.spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.posexplode(sp.chunks(F.col("text"))).alias("n", "c"))
    return rows.select("doc_id", long("n").alias("chunk_no"), long("c.start").alias("start"), long(F.length("c.text")).alias("n_chars"), F.md5(F.col("c.text").cast("binary")).alias("digest"))


@query("SELECT doc_id, text FROM documents WHERE length(text) > 0")
def chunk_lossless(spark, sf_dir):
    rows = corpus.spread(table(spark, sf_dir, "documents"), "doc_id").where("length(text) > 0")
    return rows.select("doc_id", F.array_join(F.transform(sp.chunks(F.col("text")), lambda c: c["text"]), "").alias("text"))


_PAGED = "SELECT conv_id, string_agg('--- Sida ' || (turn + 1) || ' ---' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


@query(f"""
    WITH RECURSIVE p AS (SELECT conv_id, turn, '--- Sida ' || (turn + 1) || ' ---' || chr(10) || text || CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN chr(10) ELSE '' END AS page FROM conversations),
    s AS (SELECT conv_id, page AS text, CAST(coalesce(sum(length(page)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p),
    c(conv_id, start, text, pos, stop) AS (
        SELECT conv_id, start, text, 0, {_chunk_sql(3500).replace("pos", "0")} FROM s
        UNION ALL
        SELECT conv_id, start, text, pos, {_chunk_sql(3500)} FROM (SELECT conv_id, start, text, stop AS pos FROM c WHERE stop < length(text)))
    SELECT conv_id, CAST(start + pos AS BIGINT) AS start, substr(text, pos + 1, stop - pos) AS text FROM c
""")
def page_chunks(spark, sf_dir):
    part = F.concat(F.lit("--- Sida "), (F.col("turn") + 1).cast("string"), F.lit(" ---\n"), F.col("text"))
    text = table(spark, sf_dir, "conversations").withColumn("_p", part).groupBy("conv_id").agg(F.expr("listagg(_p, '\\n') WITHIN GROUP (ORDER BY turn)").alias("text"))
    rows = text.select("conv_id", F.explode(sp.page_chunks(F.col("text"))).alias("c"))
    return rows.select("conv_id", long("c.start").alias("start"), F.col("c.text").alias("text"))


def _sources(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("batch_id", F.expr("doc_id div 8"))
    return docs.select("batch_id", (F.col("doc_id") % 8 + 1).cast("int").alias("doc_index"), "text")


def _source_batches(spark, sf_dir) -> DataFrame:
    """Texts of batches as their SQL joins them, those with an empty document too; a row without an id has no text."""
    rows = _sources(spark, sf_dir).withColumn("text", F.when(F.col("batch_id").isNotNull(), F.col("text")))
    return files.batch_text(rows, white=" \n\t\r").select("batch_id", "text")


_UNITS = r"""
    WITH RECURSIVE b AS (SELECT doc_id // 8 AS batch_id, doc_id % 8 + 1 AS i, '--- Document ' || (doc_id % 8 + 1) || ' ---' || chr(10) || trim(text, E' \n\t\r') AS block FROM documents),
    p(batch_id, i, n, piece, rest) AS (
        SELECT batch_id, i, 0, '', block FROM b
        UNION ALL
        SELECT batch_id, i, n + 1, trim(substr(rest, 1, cut), E' \n\t\r'), trim(substr(rest, cut + 1), E' \n\t\r') FROM (
            SELECT *, CASE WHEN length(rest) <= 1800 THEN length(rest)
                WHEN greatest(lf, dot) >= 0 THEN greatest(lf, dot) + 601 ELSE 1800 END AS cut FROM (
                SELECT *, CASE WHEN instr(reverse(tail), chr(10)) > 0 THEN length(tail) - instr(reverse(tail), chr(10)) ELSE -1 END AS lf,
                       CASE WHEN instr(reverse(tail), ' .') > 0 THEN length(tail) - instr(reverse(tail), ' .') - 1 ELSE -1 END AS dot
                FROM (SELECT *, substr(rest, 601, 1200) AS tail FROM p WHERE length(rest) > 0))))
    SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY i, n) AS BIGINT) AS unit_no, 'Document ' || i AS document, piece AS text FROM p WHERE n > 0 AND length(piece) > 0
"""


@query(_UNITS)
def evidence_units(spark, sf_dir):
    return evidence.document_units(files.document_parts(corpus.spread(_sources(spark, sf_dir), "batch_id"))).select("batch_id", long("unit_no").alias("unit_no"), "document", "text")


@query(f"SELECT batch_id, string_agg('[E' || lpad(unit_no::VARCHAR, 4, '0') || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY unit_no) AS prompt FROM ({_UNITS}) GROUP BY batch_id")
def user_prompts(spark, sf_dir):
    return evidence.batch_prompts(_source_batches(spark, sf_dir))


_SENT = """
    SELECT CAST(l_orderkey AS BIGINT) AS batch_id, CAST(l_linenumber AS INT) AS sentence_no, 'Dos ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' mg till [NAME_01] vid ' || CAST(l_suppkey % 7 AS STRING) || '.' AS text,
           CAST(l_linenumber AS INT) AS e1, CAST(l_linenumber + l_partkey % 3 AS INT) AS e2 FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""
_UNIT = "SELECT CAST(l_orderkey AS BIGINT) AS batch_id, 'E' || lpad(CAST(l_linenumber AS STRING), 4, '0') AS id, 'Given ' || CAST(CAST(l_quantity AS INT) AS STRING) || ', ' || CAST(l_suppkey % 5 AS STRING) || ' times' AS text FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _sentences(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    cite = lambda c: F.format_string("E%04d", F.col(c))
    rows = spark.sql(_SENT.replace("lineitem", "_lineitem"))
    return rows.select("batch_id", "sentence_no", "text", F.array_distinct(F.array(cite("e1"), cite("e2"))).alias("evidence")), spark.sql(_UNIT.replace("FROM lineitem", "FROM _lineitem"))


_CITED = f"""
    s AS ({_SENT}), u AS ({_UNIT}),
    c AS (SELECT batch_id, sentence_no, text, e1 AS e, 1 AS k FROM s UNION ALL SELECT batch_id, sentence_no, text, e2, 2 FROM s WHERE e2 <> e1),
    j AS (SELECT c.batch_id, sentence_no, c.text, k, u.text AS unit FROM c JOIN u ON u.batch_id = c.batch_id AND u.id = 'E' || lpad(e::VARCHAR, 4, '0')),
    src AS (SELECT batch_id, sentence_no, text, string_agg(unit, ' ' ORDER BY k) AS source FROM j GROUP BY batch_id, sentence_no, text)
"""


@query(f"WITH {_CITED} SELECT batch_id, CAST(sentence_no AS BIGINT) AS sentence_no, source FROM src")
def join_evidence(spark, sf_dir):
    return evidence.cited_sources(*_sentences(spark, sf_dir)).select("batch_id", long("sentence_no").alias("sentence_no"), "source")


@query(f"WITH {_CITED} SELECT batch_id, CAST(sentence_no AS BIGINT) AS sentence_no, 'E' || lpad(e::VARCHAR, 4, '0') AS id FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.batch_id = c.batch_id AND u.id = 'E' || lpad(c.e::VARCHAR, 4, '0'))")
def anti_evidence(spark, sf_dir):
    return evidence.unknown_citations(*_sentences(spark, sf_dir)).withColumn("sentence_no", long("sentence_no"))


@query(f"""
    WITH {_CITED},
    n AS (SELECT batch_id, sentence_no, unnest(regexp_extract_all(replace(text, '[NAME_01]', ''), '[0-9]+')) AS x, regexp_extract_all(source, '[0-9]+') AS have FROM src)
    SELECT DISTINCT batch_id, CAST(sentence_no AS BIGINT) AS sentence_no, 'Sentence ' || sentence_no || ' contains a number not found in its cited source; check it.' AS warning FROM n WHERE NOT list_contains(have, x)
""")
def number_discrepancy(spark, sf_dir):
    return evidence.number_warnings(*_sentences(spark, sf_dir)).withColumn("sentence_no", long("sentence_no"))


@query(f"WITH s AS ({_SENT}) SELECT batch_id, string_agg(text || ' [E' || lpad(e1::VARCHAR, 4, '0') || CASE WHEN e2 <> e1 THEN ', E' || lpad(e2::VARCHAR, 4, '0') ELSE '' END || ']', chr(10) || chr(10) ORDER BY sentence_no) AS summary FROM s GROUP BY batch_id")
def summary_render(spark, sf_dir):
    rows = _sentences(spark, sf_dir)[0].groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "text", "evidence"))).alias("s"))
    return rows.select("batch_id", evidence.render_summary(F.col("s")).alias("summary"))


@query(f"""
    WITH r AS (SELECT o_orderkey AS batch_id, o_orderkey % 9 AS k FROM orders)
    SELECT batch_id, CASE k WHEN 1 THEN '{fixed.BAD_SUMMARY}' WHEN 2 THEN '{fixed.BAD_NOTES}' WHEN 3 THEN '{fixed.TOO_MANY_NOTES}' WHEN 4 THEN '{fixed.BAD_REFERENCES}'
        WHEN 5 THEN '{fixed.TOO_LONG_SENTENCE}' WHEN 6 THEN '{fixed.TOO_LONG_SUMMARY}' WHEN 7 THEN 'invalid JSON' END AS error,
        CAST(CASE WHEN k IN (0, 8) THEN 3 ELSE -1 END AS BIGINT) AS words, CAST(CASE k WHEN 0 THEN 1 WHEN 8 THEN 2 ELSE -1 END AS BIGINT) AS cited FROM r
""")
def validate_sentences(spark, sf_dir):
    good = '{"sentences": [{"text": " Dos 5 mg ", "evidence": [%s]}], "uncertainties": []}'
    nine = ", ".join(['"E0001"'] * 9)
    cases = [
        good % '"E0001", "E0001"', '{"sentences": [], "uncertainties": []}', '{"sentences": [{"text": "a", "evidence": ["E0001"]}], "uncertainties": [1, "x"]}',
        '{"sentences": [{"text": "a", "evidence": ["E0001"]}], "uncertainties": [" "]}', good % '"E0009"', good % nine,
        '{"sentences": [{"text": "' + "ord " * 201 + '", "evidence": ["E0001"]}], "uncertainties": []}', '{"sentences": [', good % '"E0002", "E0001"',
    ]
    response = F.element_at(F.array(*map(F.lit, cases)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    orders = corpus.spread(table(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("batch_id"), response.alias("response"))
    units = orders.select("batch_id", F.explode(F.array(F.lit("E0001"), F.lit("E0002"))).alias("id"))
    out = evidence.validate_responses(orders, units)
    return out.select("batch_id", "error", F.coalesce(long("words"), F.lit(-1)).cast("long").alias("words"), F.coalesce(long(F.size(F.get("sentences", F.lit(0))["evidence"])), F.lit(-1)).cast("long").alias("cited"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS unknown FROM orders")
def anti_placeholder(spark, sf_dir):
    made = F.concat(F.lit("See [NAME_01], [DATE_"), F.when(F.col("o_orderkey") % 2 == 0, "99").otherwise("07"), F.lit("]."))
    odd = pseudonym.unknown_placeholders(made, F.lit("old [date_07] and [DATE_07]"), F.array(F.lit("[NAME_01]")))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.size(odd) > 0).alias("unknown"))


# --- Text ---------------------------------------------------------------------------------------------------------------


@query(r"""
    WITH h AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)(?:[<>≤≥]\s*)?[-−]?\d+(?:[.,:/+−-]\d+)*(?:\s*(?:mg|µg|ug|mcg|g/l|mmol/l|ml|mmhg|%))?'), lambda x: regexp_replace(lower(x), '\s+', '', 'g')) AS a,
        list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w IN ('ingen', 'inga', 'inget', 'ej', 'inte', 'utan', 'nekar')) AS b FROM documents)
    SELECT doc_id, CAST(len(a) + len(b) AS BIGINT) AS tokens, array_to_string(list_sort(list_concat(a, b)), '|') AS sorted FROM h WHERE len(a) + len(b) > 0
""")
def critical_tokens(spark, sf_dir):
    rows = corpus.spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", t.critical_tokens(F.col("text")).alias("c")).where("size(c) > 0")
    return rows.select("doc_id", long(F.size("c")).alias("tokens"), F.array_join(F.array_sort("c"), "|").alias("sorted"))


@query()
def number_tokens(spark, sf_dir):
    """Every number of every document. Without SQL: DuckDB has no word boundaries of all alphabets and no look-around."""
    docs = corpus.spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", t.number_tokens(F.col("text")).alias("numbers"))
    return docs.select("doc_id", F.posexplode("numbers").alias("n", "number")).select("doc_id", long("n").alias("n"), "number")


_PAIRS = """SELECT a.conv_id, a.turn, a.text AS first, CASE a.turn % 4 WHEN 0 THEN a.text WHEN 1 THEN a.text || ' <5 mg' WHEN 2 THEN reverse(a.text) ELSE substr(a.text, 1, CAST(length(a.text) / 2 AS INT)) END AS second FROM conversations a"""


def _pairs(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "conversations").createOrReplaceTempView("_conversations")
    return spark.sql(_PAIRS.replace("conversations", "_conversations").replace("length(a.text) / 2", "round(length(a.text) / 2 + 0.0000001)"))


@query()
def reader_disagreement(spark, sf_dir):
    """Every turn, with numbers and negations too. Without SQL: DuckDB has no look-around."""
    found = readings.disagreement(F.col("first"), F.col("second"), F.col("second"))
    out = _pairs(spark, sf_dir).select("conv_id", "turn", found.alias("w"))
    tokens = F.get(F.filter("w", lambda x: x != fixed.READERS_DIFFER_COVERAGE), F.lit(0))
    return out.select("conv_id", "turn", tokens.alias("warning"), F.array_contains("w", fixed.READERS_DIFFER_COVERAGE).alias("short"))


@query("""
    WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN repeat('Samma rad som upprepas helt' || chr(10), 5) WHEN 1 THEN repeat('Samma rad som upprepas helt' || chr(10), 4) WHEN 2 THEN repeat('kort' || chr(10), 9) WHEN 3 THEN 'x' || repeat('å', 20) ELSE repeat('ab', 30) END AS text FROM orders)
    SELECT o_orderkey, o_orderkey % 5 = 0 AS loop, o_orderkey % 5 = 3 AS degenerate FROM d
""")
def loop_detect(spark, sf_dir):
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN repeat('Samma rad som upprepas helt\\n', 5) WHEN 1 THEN repeat('Samma rad som upprepas helt\\n', 4) WHEN 2 THEN repeat('kort\\n', 9) WHEN 3 THEN 'x' || repeat('å', 20) ELSE repeat('ab', 30) END")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", t.is_loop(F.col("text")).alias("loop"), t.is_degenerate(F.col("text")).alias("degenerate"))


@query("SELECT doc_id, regexp_matches(text, '[\\p{L}\\p{N}_]') AS has_word, contains(text, '�') OR regexp_matches(text, '\\p{Co}') AS private_use, contains(upper(text), '[OLÄSLIGT]') AS unreadable FROM documents")
def text_predicates(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.has_word(c).alias("has_word"), t.has_private_use(c).alias("private_use"), F.contains(F.upper(c), F.lit(fixed.UNREADABLE)).alias("unreadable"))


@query("""
    WITH w AS (SELECT source, doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(w)) AS BIGINT) AS words, CAST(max(len(w)) AS BIGINT) AS longest FROM w GROUP BY source
""")
def doc_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.length("text").alias("c"), t.word_count(F.col("text")).alias("w"))
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("c").alias("chars"), long(F.sum("w")).alias("words"), long(F.max("w")).alias("longest"))


@query("SELECT doc_id // 8 AS batch_id, string_agg('--- Document ' || (doc_id % 8 + 1) || ' ---' || chr(10) || trim(text, E' \\n\\t\\r'), chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY doc_id // 8")
def batch_concat(spark, sf_dir):
    return _source_batches(spark, sf_dir)


@query("SELECT conv_id AS doc_id, string_agg('--- Sida ' || (turn + 1) || ' ---' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def page_concat(spark, sf_dir):
    return files.page_concat(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_num"), "text"))


@query("SELECT doc_id, source, sha256(text) AS digest, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) > 1 AS cached FROM documents")
def dedupe_cached(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return readings.first_of_digest(docs, ["source"], "doc_id", "text").select("doc_id", "source", "digest", "cached")


@query("SELECT url, page_id, regexp_replace(regexp_replace(regexp_extract(replace(url, '\\', '/'), '([^/]*)/*$', 1), '[<>:\"/\\\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name FROM pages")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", "page_id", t.safe_filename(F.col("url")).alias("name"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS compatible, o_orderkey % 3 = 1 AS overflow FROM orders")
def runtime_checks(spark, sf_dir):
    version = F.element_at(F.array(*map(F.lit, ("0.32.0", "0.32.1", "1.0.0-rc1", "v1.0"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    message = F.when(F.col("o_orderkey") % 3 == 1, "The input EXCEEDS the context of the model").otherwise("model not found")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.compatible_version(version).alias("compatible"), t.is_overflow(message).alias("overflow"))


# --- Planning -----------------------------------------------------------------------------------------------------------

_SIZES = "[" + ", ".join(map(str, fixed.CONTEXT_SIZES)) + "]"


@query(f"""
    WITH e AS (SELECT doc_id, CAST(ceil(octet_length(encode(text)) * (1 + doc_id % 9) / 3.0) + 4096 + 768 AS BIGINT) AS tokens, CAST(CASE doc_id % 3 WHEN 0 THEN 131072 WHEN 1 THEN 60000 ELSE 20000 END AS BIGINT) AS maximum FROM documents),
    s AS (SELECT *, list_sort(list_distinct(list_append(list_filter({_SIZES}, lambda x: x <= maximum), maximum))) AS sizes FROM e),
    c AS (SELECT *, coalesce(list_filter(sizes, lambda x: x >= tokens)[1], maximum) AS chosen FROM s)
    SELECT doc_id, tokens, chosen, array_to_string(list_filter(sizes, lambda x: x >= chosen), ',') AS contexts FROM c
""")
def context_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    need = (F.ceil(F.octet_length("text") * (1 + F.col("doc_id") % 9) / F.lit(3)) + 4096 + fixed.RESERVE_TOKENS).cast("long")
    limit = F.expr("CASE doc_id % 3 WHEN 0 THEN 131072 WHEN 1 THEN 60000 ELSE 20000 END")
    rows = docs.select("doc_id", need.alias("tokens"), limit.alias("m"))
    return rows.select("doc_id", "tokens", long(planning.choose_context(F.col("tokens"), F.col("m"))).alias("chosen"), F.array_join(planning.context_plan(F.col("tokens"), F.col("m"), F.lit(262144)).cast("array<string>"), ",").alias("contexts"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 3.0) + 4096 + 768 AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", planning.estimate_tokens(F.col("text"), 4096).alias("tokens"))


@query("""
    SELECT o_orderkey AS batch_id, CASE o_orderkey % 6 WHEN 4 THEN 'invalid JSON' WHEN 5 THEN 'the model repeatedly stopped early' END AS error, CAST(CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 5 THEN 3 ELSE 2 END AS BIGINT) AS attempts,
           CASE o_orderkey % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete|complete' WHEN 2 THEN 'invalid_format|complete' WHEN 3 THEN 'context_overflow|complete' WHEN 4 THEN 'invalid_format|invalid_format' ELSE 'incomplete|incomplete|incomplete' END AS outcomes FROM orders
""")
def summary_retries(spark, sf_dir):
    """A summary of each order by a model whose answers depend on the order's key and on the attempt, through the rounds of retries."""
    import json

    good = json.dumps({"sentences": [{"text": "Dos 5 mg", "evidence": ["E0001"]}], "uncertainties": []})
    answers = [[{"response": good}], [{"done_reason": "length"}, {"response": good}], [{"response": "{"}, {"response": good}], ["The input EXCEEDS the context", {"response": good}], [{"response": "{"}, {"response": "{"}], [{"done": False}] * 3]

    def model(request: dict) -> dict:
        answer = answers[request["batch_id"] % 6][request["attempt"]]
        if isinstance(answer, str):
            raise RuntimeError(answer)
        return answer

    prompts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.lit("p" * 3000).alias("prompt"), F.array(F.lit("E0001")).alias("known"))
    out = summarise.summaries(corpus.spread(prompts, "batch_id"), model, F.array(*map(F.lit, (8192, 16384, 24576, 32768))))
    return out.select("batch_id", "error", long(F.size("attempts")).alias("attempts"), F.array_join(F.transform("attempts", lambda a: a["outcome"]), "|").alias("outcomes"))


# --- Readings -----------------------------------------------------------------------------------------------------------

_WORDS = """
    SELECT CAST(l_orderkey AS BIGINT) AS page_id, CAST(l_suppkey AS INT) AS word_num, CAST(l_linenumber % 2 AS INT) AS line_num, CASE l_partkey % 4 WHEN 0 THEN 'Hb' WHEN 1 THEN CAST(l_suppkey AS STRING) WHEN 2 THEN '--' ELSE 'värde' END AS text,
           CAST(60 + (l_partkey * 13 + l_linenumber) % 40 AS DOUBLE) AS confidence, CAST(l_linenumber * 100 + l_partkey % 60 AS INT) AS x0, CAST(l_suppkey % 5 AS INT) AS y0,
           CAST(l_linenumber * 100 + l_partkey % 60 + 40 AS INT) AS x1, CAST(10 + l_suppkey % 5 AS INT) AS y1 FROM lineitem
"""


def _words(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    return spark.sql(_WORDS.replace("lineitem", "_lineitem"))


@query(f"""
    WITH w AS ({_WORDS}), l AS (SELECT *, lag(x1) OVER o AS px1, lag(x0) OVER o AS px0, lag(length(text)) OVER o AS pl, row_number() OVER o AS place FROM w WINDOW o AS (PARTITION BY page_id, line_num ORDER BY x0, word_num, x1, text)),
    p AS (SELECT *, CASE WHEN px1 IS NULL THEN '' WHEN x0 - px1 > 3 * greatest(3.0, (px1 - px0) / greatest(1, pl)) THEN chr(9) ELSE ' ' END || text AS part FROM l)
    SELECT page_id, CAST(line_num AS BIGINT) AS line_num, string_agg(part, '' ORDER BY place) AS text, CAST(min(x0) AS BIGINT) AS x0, CAST(max(x1) AS BIGINT) AS x1, CAST(min(y0) AS BIGINT) AS y0, CAST(max(y1) AS BIGINT) AS y1, round(avg(confidence), 6) AS confidence FROM p GROUP BY page_id, line_num
""")
def line_group(spark, sf_dir):
    lines = readings.lines_of(_words(spark, sf_dir), ["page_id"], ["line_num"])
    return lines.select("page_id", long("line_num").alias("line_num"), "text", *(long(c).alias(c) for c in ("x0", "x1", "y0", "y1")), F.round("confidence", 6).alias("confidence"))


@query(f"""
    WITH w AS ({_WORDS})
    SELECT page_id, round(sum(length(text) * confidence) / greatest(1, sum(length(text))), 6) AS confidence, round(count(*) FILTER (WHERE text <> '--' AND confidence < 75) / greatest(1, count(*) FILTER (WHERE text <> '--')), 6) AS low,
           coalesce(bool_or(confidence < 88 AND regexp_matches(text, '[0-9]')), false) AS critical_low FROM w GROUP BY page_id
""")
def quality_gate(spark, sf_dir):
    rows = _words(spark, sf_dir).groupBy("page_id").agg(readings.weighted_confidence().alias("confidence"), readings.low_fraction().alias("low"), readings.critical_low().alias("critical_low"))
    return rows.select("page_id", F.round("confidence", 6).alias("confidence"), F.round("low", 6).alias("low"), "critical_low")


_READ = """SELECT o_orderkey AS page_id, 'Hb 5 mg' AS a, CASE o_orderkey % 3 WHEN 0 THEN 'Hb 5 mg' WHEN 1 THEN 'Hb 6 mg' ELSE 'mg 5 Hb' END AS b, CAST(20 + o_orderkey % 80 AS DOUBLE) AS ca, CAST(40 + o_orderkey % 60 AS DOUBLE) AS cb FROM orders"""


@query(f"""
    WITH r AS ({_READ}), n AS (SELECT *, ca < 91 AS need FROM r), c AS (SELECT *, need AND cb >= 70 AS second FROM n)
    SELECT page_id, CASE WHEN second THEN 'two' ELSE 'one' END AS engine, need AS need_second, CASE WHEN second THEN cb ELSE ca END < 35 AS rejected,
           need AND page_id % 3 <> 0 OR CASE WHEN second THEN cb ELSE ca END < 91 AS review_required FROM c
""")
def route_reader(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    pages = spark.sql(_READ.replace("FROM orders", "FROM _orders"))
    reading = lambda no, engine, text, confidence: F.struct(F.lit(no).alias("reader_no"), F.lit(engine).alias("engine"), F.col(text).alias("text"), F.col(confidence).alias("confidence"), F.lit(0.0).alias("low"), F.lit(False).alias("critical_low"))
    rows = pages.select("page_id", F.inline(F.array(reading(1, "one", "a", "ca"), reading(2, "two", "b", "cb"))))
    return readings.route(rows).select("page_id", "engine", "need_second", "rejected", "review_required")


@query(f"""
    WITH w AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, text) AS i FROM (SELECT page_id, text, x0 % 300 AS x0, 7 * (x0 // 300) + y0 AS y0, x0 % 300 + 40 AS x1, 7 * (x0 // 300) + y1 AS y1 FROM ({_WORDS}))),
    m AS (SELECT page_id, (min(x0) + max(x1)) / 2.0 AS middle, max(x1) - min(x0) AS width FROM w GROUP BY page_id),
    s AS (SELECT w.*, middle, width, CASE WHEN x1 < middle THEN 1 WHEN x0 > middle THEN 2 ELSE 0 END AS side FROM w JOIN m ON m.page_id = w.page_id),
    p AS (SELECT page_id, count(*) FILTER (WHERE side = 1) >= 3 AND count(*) FILTER (WHERE side = 2) >= 3 AND count(*) FILTER (WHERE side = 0) <= 2 AND coalesce(max(y1) FILTER (WHERE side = 0) <= min(y0) FILTER (WHERE side > 0), true)
                 AND min(x0) FILTER (WHERE side = 2) - max(x1) FILTER (WHERE side = 1) > 0.05 * any_value(width) AND count(*) FILTER (WHERE side = 2 AND regexp_matches(text, '[0-9]')) < 0.25 * count(*) FILTER (WHERE side = 2) AS prose FROM s GROUP BY page_id),
    r AS (SELECT page_id, max(i) AS n, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'text': text}} ORDER BY i) AS l FROM w GROUP BY page_id),
    a AS (SELECT page_id, list_reduce(list_prepend([], list_transform(l, lambda c: [[c]])), lambda rows, c: CASE
              WHEN len(list_filter(range(1, len(rows) + 1), lambda k: list_max(list_transform(rows[k], lambda d: d.y1)) >= c[1][1].y0
                   AND len(list_filter(rows[k], lambda d: NOT ((d.x1 <= c[1][1].x0 OR c[1][1].x1 <= d.x0) AND least(d.y1, c[1][1].y1) - greatest(d.y0, c[1][1].y0) >= 0.5 * least(d.y1 - d.y0, c[1][1].y1 - c[1][1].y0)))) = 0)) > 0
              THEN list_transform(rows, lambda row, k: CASE WHEN k = list_max(list_filter(range(1, len(rows) + 1), lambda j: list_max(list_transform(rows[j], lambda d: d.y1)) >= c[1][1].y0
                   AND len(list_filter(rows[j], lambda d: NOT ((d.x1 <= c[1][1].x0 OR c[1][1].x1 <= d.x0) AND least(d.y1, c[1][1].y1) - greatest(d.y0, c[1][1].y0) >= 0.5 * least(d.y1 - d.y0, c[1][1].y1 - c[1][1].y0)))) = 0)) THEN row || c[1] ELSE row END)
              ELSE rows || c END) AS rows FROM r)
    SELECT a.page_id, CASE WHEN prose THEN (SELECT string_agg(text, chr(10) ORDER BY side, y0, i) FROM s WHERE s.page_id = a.page_id)
           ELSE array_to_string(list_transform(rows, lambda row: array_to_string(list_transform(list_sort(row), lambda d: d.text), chr(9))), chr(10)) END AS text FROM a JOIN p ON p.page_id = a.page_id
""")
def line_layout(spark, sf_dir):
    """Words as lines, folded into three columns of uneven rows."""
    fold = F.floor(F.col("x0") / 300) * 7
    words = _words(spark, sf_dir).select("page_id", "text", (F.col("x0") % 300).alias("x0"), (F.col("y0") + fold).alias("y0"), (F.col("x0") % 300 + 40).alias("x1"), (F.col("y1") + fold).alias("y1"))
    line = F.struct("y0", "x0", "text", F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))).alias("box"))
    return readings.page_layouts(words.groupBy("page_id").agg(F.array_sort(F.collect_list(line)).alias("lines")))


@query("""
    WITH r AS (SELECT l_orderkey AS page_id, l_linenumber, l_partkey % 4 AS k, l_suppkey FROM lineitem)
    SELECT page_id, CAST(l_linenumber AS BIGINT) AS line_num, 'ord' || l_suppkey AS text, CAST(l_linenumber AS BIGINT) AS x0, CAST(l_linenumber + 30 AS BIGINT) AS x1, CAST(90 AS DOUBLE) AS confidence FROM r WHERE k = 0
""")
def tsv_words(spark, sf_dir):
    text = F.expr("CASE l_partkey % 4 WHEN 3 THEN '  ' ELSE ' ord' || l_suppkey || ' ' END")
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line_num"), F.expr("CASE l_partkey % 4 WHEN 1 THEN '4' ELSE '5' END").alias("level"), F.expr("CASE l_partkey % 4 WHEN 2 THEN 'x' ELSE CAST(l_linenumber AS STRING) END").alias("left"),
        F.lit("0").alias("top"), F.lit("30").alias("width"), F.lit("9").alias("height"), F.lit("90").alias("conf"), text.alias("text"),
    )
    return readings.parse_tsv(raw).select("page_id", long("line_num").alias("line_num"), "text", long("x0").alias("x0"), long("x1").alias("x1"), "confidence")


@query("""
    WITH p AS (SELECT doc_id, 10 + doc_id % 3 AS w, text FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 's' || doc_id END AS symbol_id FROM p
""")
def symbol_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (10 + F.col("doc_id") % 3).alias("width"), F.lit(4).alias("height"), F.concat(F.col("doc_id").cast("string"), F.col("text")).cast("binary").alias("pixels"))
    digest = F.sha2(F.concat(F.format_string("%dx4:", F.col("width")).cast("binary"), F.col("pixels")), 256)
    known = docs.where("doc_id % 3 = 1").select("width", "height", digest.alias("digest"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("symbol_id"), F.lit("a symbol").alias("description"))
    return readings.lookup_symbols(docs, known).select("doc_id", "symbol_id")


_CRITICAL_SQL = r"""list_concat(list_transform(regexp_extract_all({text}, '(?i)(?:[<>≤≥]\s*)?[-−]?\d+(?:[.,:/+−-]\d+)*(?:\s*(?:mg|µg|ug|mcg|g/l|mmol/l|ml|mmhg|%))?'), lambda x: regexp_replace(lower(x), '\s+', '', 'g')),
        list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w IN ('ingen', 'inga', 'inget', 'ej', 'inte', 'utan', 'nekar')))"""


@query(f"""
    WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN replace(text, '1', '7') WHEN doc_id % 3 = 1 THEN substr(text, 1, CAST(doc_id % 500 AS INT)) ELSE text END AS read FROM documents),
    t AS (SELECT doc_id, {_CRITICAL_SQL.format(text="text")} AS a, {_CRITICAL_SQL.format(text="read")} AS b FROM d),
    l AS (SELECT doc_id, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS lost FROM t)
    SELECT doc_id, CAST(len(lost) AS BIGINT) AS n, array_to_string(lost, '|') AS lost FROM l WHERE len(lost) > 0
""")
def native_ocr_check(spark, sf_dir):
    """Every document as a text layer, held against readings that have it with other digits, cut off, or whole."""
    docs = corpus.spread(table(spark, sf_dir, "documents"), "doc_id")
    read = F.expr("CASE WHEN doc_id % 3 = 0 THEN replace(text, '1', '7') WHEN doc_id % 3 = 1 THEN substr(text, 1, CAST(doc_id % 500 AS INT)) ELSE text END")
    rows = docs.select("doc_id", readings.lost_tokens(F.col("text"), read).alias("lost")).where("size(lost) > 0")
    return rows.select("doc_id", long(F.size("lost")).alias("n"), F.array_join(F.array_sort("lost"), "|").alias("lost"))


# --- Codebooks ----------------------------------------------------------------------------------------------------------

_BOOK = """
    SELECT CAST(c_nationkey AS STRING) AS book_id, CAST(c_custkey AS BIGINT) AS ord, CASE c_custkey % 3 WHEN 0 THEN 'Enhet ' || CAST(c_custkey % 5 AS STRING) WHEN 1 THEN 'Enhet 1' ELSE 'Norra Enhet 1' END AS real,
           'Kund ' || CAST(c_custkey % 11 AS STRING) || ' Påhittad' AS fake, CASE c_custkey % 2 WHEN 0 THEN 'ORG' ELSE 'ADDRESS' END AS type FROM customer
"""


def _books(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("_customer")
    return spark.sql(_BOOK.replace("FROM customer", "FROM _customer"))


_RESOLVED = f"""
    b AS ({_BOOK}), v AS (SELECT book_id, fake, lower(real) AS k, arg_max(real, ord) AS last, arg_max(ord, ord) AS last_ord, arg_min(real, ord) AS first, min(ord) AS first_ord FROM b GROUP BY book_id, fake, lower(real)),
    g AS (SELECT book_id, fake, count(*) AS n, arg_min(first, first_ord) AS first, arg_min(last, length(last) * 1000000000 + first_ord) AS core, list(k) AS keys FROM v GROUP BY book_id, fake),
    r AS (SELECT book_id, fake, CASE WHEN n = 1 THEN first WHEN len(list_filter(keys, lambda k: NOT contains(k, lower(core)))) = 0 THEN core END AS real FROM g)
"""


@query(f"WITH {_RESOLVED} SELECT book_id, fake, real FROM r WHERE real IS NOT NULL")
def drop_ambiguous(spark, sf_dir):
    return codebook.drop_ambiguous(codebook.clean_pairs(_books(spark, sf_dir))).select("book_id", "fake", "real")


_TEXTS = "SELECT o_orderkey AS text_id, 'Brev om Kund ' || CAST(o_orderkey % 11 AS STRING) || ' Påhittad och åter Kund ' || CAST(o_orderkey % 11 AS STRING) || ' Påhittad, nära Kund ' || CAST(o_orderkey % 7 AS STRING) || ' Påhittad.' AS text FROM orders"


def _texts(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return spark.sql(_TEXTS.replace("FROM orders", "FROM _orders"))


@query(f"""
    WITH {_RESOLVED}, x AS ({_TEXTS}), h AS (SELECT text_id, book_id, CAST(sum((length(text) - length(replace(text, fake, ''))) / length(fake)) AS BIGINT) AS score FROM x JOIN r ON contains(text, fake) AND real IS NOT NULL GROUP BY text_id, book_id)
    SELECT text_id, book_id, score FROM h WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, book_id) = 1
""")
def codebook_score(spark, sf_dir):
    return codebook.detect(_texts(spark, sf_dir), codebook.drop_ambiguous(codebook.clean_pairs(_books(spark, sf_dir))))


_PEOPLE = "SELECT CAST(c_nationkey AS STRING) AS book_id, CAST(c_custkey AS BIGINT) AS ord, 'Anna' || CAST(c_custkey % 9 AS STRING) || ' Berg' || CAST(c_custkey % 4 AS STRING) AS real, 'Fia' || CAST(c_custkey AS STRING) || ' Lund' || CAST(c_custkey % 13 AS STRING) AS fake, CASE c_custkey % 6 WHEN 0 THEN 'ORG' ELSE 'PER' END AS type FROM customer"


@query(f"""
    WITH p AS ({_PEOPLE}), e AS (SELECT book_id, ord, split_part(fake, ' ', 1) AS fake, split_part(real, ' ', 1) AS real FROM p WHERE type = 'PER' UNION ALL SELECT book_id, ord, split_part(fake, ' ', 2), split_part(real, ' ', 2) FROM p WHERE type = 'PER'),
    o AS (SELECT DISTINCT book_id, unnest(regexp_split_to_array(lower(real), ' ')) AS w FROM p WHERE type = 'ORG'),
    n AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.book_id = e.book_id AND o.w = lower(e.real)))
    SELECT book_id, ord, fake, real FROM n QUALIFY count(*) OVER (PARTITION BY book_id, fake) = 1
""")
def partial_names(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("_customer")
    return codebook.partial_names(spark.sql(_PEOPLE.replace("FROM customer", "FROM _customer"))).select("book_id", "ord", "fake", "real")


@query(f"""
    WITH {_RESOLVED}, x AS ({_TEXTS}), h AS (SELECT text_id, book_id, CAST(sum((length(text) - length(replace(text, fake, ''))) / length(fake)) AS BIGINT) AS score FROM x JOIN r ON contains(text, fake) AND real IS NOT NULL GROUP BY text_id, book_id),
    d AS (SELECT text_id, book_id FROM h WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, book_id) = 1)
    SELECT x.text_id, d.book_id, fake, real, CAST((length(text) - length(replace(text, fake, ''))) / length(fake) AS BIGINT) AS n FROM x JOIN d ON d.text_id = x.text_id JOIN r ON r.book_id = d.book_id AND contains(text, fake) AND real IS NOT NULL
""")
def replacement_counts(spark, sf_dir):
    pairs = codebook.drop_ambiguous(codebook.clean_pairs(_books(spark, sf_dir)))
    rows = codebook.deanonymise(_texts(spark, sf_dir).withColumn("summary", F.col("text")), pairs)
    return rows.where("fake IS NOT NULL").select("text_id", "book_id", "fake", "real", long("count").alias("n"))


# --- Payloads, records, exports -----------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey AS batch_id, CASE o_orderkey % 8 WHEN 1 THEN 'Choose balanced, thorough or fast transcription.' WHEN 2 THEN 'Provide documents or pasted text.' WHEN 3 THEN 'Send documents or pasted text, not both.'
        WHEN 4 THEN 'a_b.txt: invalid base64 content.' WHEN 5 THEN 'b.exe: unsupported file type. Supported: .pdf, .docx, .txt, .json, .png, .jpg, .jpeg' WHEN 6 THEN 'Additional identifiers must be up to 50 entries, 2 to 180 characters each.' END AS error,
        CAST(CASE WHEN o_orderkey % 8 BETWEEN 1 AND 6 THEN 400 ELSE 200 END AS BIGINT) AS status, CAST(CASE WHEN o_orderkey % 8 IN (3, 5, 7) THEN 5 ELSE 0 END AS BIGINT) AS bytes FROM orders
""")
def payloads(spark, sf_dir):
    file = lambda name, raw: F.array(F.struct(F.lit(name).alias("filename"), F.lit(raw).alias("content_b64")))
    k = F.col("o_orderkey") % 8
    given = F.when(k.isin(3, 7), file("x\\y/c.txt", "aGVsbG8=")).when(k == 4, file("a|b.txt", "***")).when(k == 5, file("b.exe", "aGVsbG8="))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("batch_id"), F.when(k.isin(0, 1, 3, 6), "text").when(k == 2, " ").alias("text"), given.alias("files"), F.when(k == 6, F.array(F.lit(" x "))).alias("additional"), F.when(k == 1, "slow").alias("mode")
    )
    return payload.parse_payloads(rows).select("batch_id", "error", F.coalesce(long("status"), F.lit(200)).cast("long").alias("status"), long("bytes").alias("bytes"))


@query("SELECT c_custkey AS job, CAST(sum(o_totalprice > 100000) AS BIGINT) AS over FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def upload_total(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_custkey").alias("job")).agg(F.count_if(F.col("o_totalprice") > 100000).alias("over"))


@query("""
    WITH r AS (SELECT 'r' || o_orderkey AS id, o_orderkey % 3 AS k, o_totalprice AS made FROM orders WHERE o_orderkey % 4 <> 3)
    SELECT id, CASE k WHEN 0 THEN 'Untitled' ELSE 'Run ' || id END AS name, CASE k WHEN 1 THEN 0.0 ELSE made END AS created_at, CASE k WHEN 2 THEN 'files' ELSE '' END AS input_type FROM r
""")
def history_list(spark, sf_dir):
    record = F.expr("""CASE WHEN o_orderkey % 4 = 3 THEN '{"broken' WHEN o_orderkey % 3 = 0 THEN to_json(named_struct('created_at', o_totalprice)) WHEN o_orderkey % 3 = 1 THEN to_json(named_struct('name', 'Run r' || o_orderkey))
        ELSE to_json(named_struct('name', 'Run r' || o_orderkey, 'created_at', o_totalprice, 'input', named_struct('type', 'files'))) END""")
    return records.history_list(table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"), record.alias("record")))


@query("""
    WITH l AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda x: trim(regexp_replace(x, '[*#]', '', 'g'), E' -—\\t')), lambda x: x <> '' AND NOT starts_with(lower(x), 'sida ') AND lower(x) <> 'image transcription')[1] AS line FROM conversations),
    w AS (SELECT conv_id, turn, regexp_split_to_array(trim(line), '\\s+') AS w FROM l)
    SELECT conv_id, turn, coalesce(array_to_string(w[1:6], ' ') || CASE WHEN len(w) > 6 THEN '…' ELSE '' END, 'Pasted text') AS name FROM w
""")
def derive_name(spark, sf_dir):
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", records.derive_name(none, F.col("text")).alias("name"))


@query("""
    WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS s, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id AS id, '# Clinical summary' || chr(10) || chr(10) || s || chr(10) || chr(10) || 'Unresolved questions' || chr(10) || 'turns: ' || n || chr(10) AS document FROM c
""")
def export_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY turn)").alias("summary"), F.count("*").alias("n"))
    questions = F.array(F.concat(F.lit("turns: "), F.col("n").cast("string")))
    ready = rows.select(F.col("conv_id").alias("id"), "summary", questions.alias("uncertainties"), F.array().cast("array<string>").alias("warnings"))
    return records.export_parts(ready, "summary").select("id", records.render(F.col("title"), F.col("body"), "md").alias("document"))


@query(f"""
    WITH u AS ({_UNITS}) SELECT batch_id AS id, string_agg('[E' || lpad(unit_no::VARCHAR, 4, '0') || '] ' || document || chr(10) || text, chr(10) || chr(10) ORDER BY unit_no) AS body FROM u GROUP BY batch_id
""")
def export_units(spark, sf_dir):
    units = evidence.batch_units(_source_batches(spark, sf_dir))
    ready = units.select(F.col("batch_id").alias("id"), "units", F.lit(True).alias("implemented"), F.lit("").alias("pseudonymised_text"), F.array().cast("array<string>").alias("warnings"))
    return records.export_parts(ready, "pseudonymised").select("id", "body")


@query("""
    WITH e AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT user_id, string_agg('Document ' || user_id || ': ' || event_type, '|' ORDER BY first) AS notes FROM e GROUP BY user_id
""")
def batch_warnings(spark, sf_dir):
    """Each user's events as warnings of a document, each once, in their order."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    rows = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("w"))
    twice = F.concat("w", F.slice("w", F.lit(1), F.lit(2)))  # repeats don't count
    return rows.select("user_id", F.array_join(records.batch_warnings("Document", F.col("user_id"), F.transform(twice, lambda x: x["event_type"])), "|").alias("notes"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'active' WHEN event_id % 3 < 2 AND event_id % 4 = 1 THEN 'done' WHEN event_id % 3 = 0 AND event_id % 4 = 2 THEN 'skipped' WHEN event_id % 3 < 2 AND event_id % 4 = 3 THEN 'error'
        WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 3 = 1 THEN 'active' ELSE 'done' END AS status FROM events
""")
def job_states(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", records.next_state(pick(("pending", "active", "done"), 3), pick(("start", "finish", "skip", "fail"), 4)).alias("status"))


@query("SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS active_jobs FROM orders")
def active_jobs(spark, sf_dir):
    return records.active_jobs(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status")))


@query("""
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '--- Sida 1 ---' || chr(10) || chr(10) || text || chr(10) || chr(10) || '--- Sida 3 ---' || chr(10) || chr(10) || 'z' END AS text,
           CASE doc_id % 4 WHEN 2 THEN 'a page without text' WHEN 3 THEN 'neither full_text nor pages' END AS error FROM documents
""")
def json_transcriptions(spark, sf_dir):
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN to_json(named_struct('full_text', text)) WHEN 1 THEN to_json(named_struct('full_text', ' ', 'pages', array(named_struct('text', text), named_struct('text', ' '), named_struct('text', 'z'))))
        WHEN 2 THEN '{"pages": [{"text": "a"}, {}]}' ELSE '{"other": 1}' END""")
    return files.json_transcriptions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), raw.alias("raw"))).withColumnRenamed("id", "doc_id")


@query("SELECT source AS patient, round(avg(n_chars), 6) AS mean_chars, CAST(min(n_chars) AS BIGINT) AS least, CAST(max(n_chars) AS BIGINT) AS most, round(sum(n_chars) / sum(length(text)), 6) AS ratio FROM documents GROUP BY source")
def gt_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("patient"))
    return rows.agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.sum("n_chars") / F.sum(F.length("text")), 6).alias("ratio"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE 'Svar ' || o_orderkey END AS answer FROM orders")
def think_strip(spark, sf_dir):
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '<think>a\\nb</think> Svar ' || o_orderkey WHEN 1 THEN '```text\\nSvar ' || o_orderkey || '\\n```' WHEN 2 THEN ' Svar ' || o_orderkey || '\\n' ELSE '```' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.strip_thinking(raw).alias("answer"))


@query("SELECT c_custkey, 'A [1] [2], Kund' || c_custkey || 'x [1]' AS text FROM customer")
def apply_mapping(spark, sf_dir):
    name = F.concat(F.lit("Kund"), F.col("c_custkey").cast("string"))
    mapping = F.array(F.struct(name.alias("surface"), F.lit("[1]").alias("token")), F.struct(F.concat(name, F.lit(" Berg")).alias("surface"), F.lit("[2]").alias("token")))
    text = F.concat(F.lit("A "), name, F.lit(" "), name, F.lit(" Berg, "), name, F.lit("x "), name)
    return table(spark, sf_dir, "customer").select("c_custkey", pseudonym.apply_mapping(text, mapping).alias("text"))


@query("SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'a|b|c' ELSE 'b|c' END AS notes FROM orders")
def review_notes(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a")))
    notes = records.review_notes(first, F.array(F.lit("b")), F.lit(None).cast("array<string>"), F.array(F.lit("c")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(notes, "|").alias("notes"))


@query("SELECT user_id, count(*) AS files FROM (SELECT DISTINCT user_id, event_type, length(props) AS size FROM events) GROUP BY user_id")
def upload_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), F.length("props").alias("size"), F.lit(0).alias("mtime"))
    return payload.drop_repeated(rows, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("files"))


# --- Pages, jobs, stores and files ----------------------------------------------------------------------------------------

_IMAGE = "CASE WHEN page_id % 2 = 0 THEN html ELSE 'scan ' || CAST(octet_length(encode(html)) % 11 AS VARCHAR) END"


def _first_reader(image: bytes) -> dict:
    """Stands for a text reader: what it says, and how sure it is, depends on the image's bytes."""
    return {"text": f"Hb {len(image)} mg", "confidence": 30 + len(image) % 70}


def _second_reader(image: bytes) -> dict:
    return {"text": f"Hb {len(image) + (len(image) % 3 == 0)} mg", "confidence": 50 + len(image) % 50}


_CASCADE = f"""
    i AS (SELECT DISTINCT coalesce(image, '') AS image, CAST(octet_length(encode(image)) AS BIGINT) AS n FROM (SELECT {_IMAGE} AS image FROM pages)),
    a AS (SELECT *, 30 + n % 70 AS ca, 50 + n % 50 AS cb, n + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS m FROM i),
    b AS (SELECT *, ca < 91 AS need, ca < 91 AND cb >= 70 AS second FROM a),
    c AS (SELECT image, CASE WHEN second THEN 'second' ELSE 'first' END AS engine, need, CASE WHEN second THEN cb ELSE ca END < 35 AS rejected, 'Hb ' || CASE WHEN second THEN m ELSE n END || ' mg' AS text,
                 CASE WHEN need AND n <> m THEN 1 ELSE 0 END + CASE WHEN CASE WHEN second THEN cb ELSE ca END < 91 THEN 1 ELSE 0 END AS notes FROM b)
"""


def _images(spark, sf_dir) -> DataFrame:
    image = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat(F.lit("scan "), (F.octet_length("html") % 11).cast("string"))).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", "url", image.alias("image"))


@query(f"WITH {_CASCADE} SELECT sha256(image) AS digest, engine, need AS need_second, rejected, CASE WHEN NOT rejected THEN text END AS text, CAST(notes AS BIGINT) AS notes FROM c")
def reader_cascade(spark, sf_dir):
    images = _images(spark, sf_dir).select(F.unhex(F.sha2("image", 256)).alias("digest"), "image").groupBy("digest").agg(F.first("image").alias("image"))
    out = reading.cascade(images, reading.Readers(_first_reader, _second_reader))
    return out.select(F.lower(F.hex("digest")).alias("digest"), "engine", "need_second", "rejected", "text", long(F.size("warnings")).alias("notes"))


@query(f"""
    WITH {_CASCADE}, p AS (SELECT page_id, page_id // 8 AS doc_id, page_id % 8 AS page_num, CASE WHEN page_id % 5 = 0 THEN url ELSE '' END AS native, coalesce({_IMAGE}, '') AS image FROM pages),
    l AS (SELECT *, regexp_matches(native, '\\w') AS layer FROM p),
    f AS (SELECT doc_id, image, min(page_num) AS first FROM l WHERE NOT layer GROUP BY ALL)
    SELECT l.doc_id, l.page_num, CASE WHEN layer THEN native WHEN NOT rejected THEN text END AS text, CASE WHEN layer THEN 'native' ELSE engine END AS method, NOT layer AND l.page_num > first AS cached, NOT layer AND rejected AS failed
    FROM l JOIN c ON c.image = l.image LEFT JOIN f ON f.doc_id = l.doc_id AND f.image = l.image
""".replace("\\\\", "\\"))
def pages_read_once(spark, sf_dir):
    pages = _images(spark, sf_dir).select(
        F.expr("page_id div 8").alias("doc_id"), (F.col("page_id") % 8).alias("page_num"), F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise("").alias("native"), F.lit(0).alias("uncovered"), "image"
    )
    out = reading.read_pages(pages, reading.Readers(_first_reader, _second_reader))
    return out.select("doc_id", "page_num", "text", "method", "cached", F.col("error").isNotNull().alias("failed"))


_EVENT = "CASE event_id % 5 WHEN 2 THEN 'finish' WHEN 3 THEN 'skip' WHEN 4 THEN 'fail' ELSE 'start' END"


@query(f"""
    WITH e AS (SELECT user_id AS job_id, event_type AS stage, list({{'at': ts, 'event': {_EVENT}}} ORDER BY event_id) AS e FROM events GROUP BY ALL),
    s AS (SELECT job_id, stage, list_reduce(list_prepend({{'status': 'pending', 'since': NULL::TIMESTAMP, 'until': NULL::TIMESTAMP}}, list_transform(e, lambda x: {{'status': x.event, 'since': x.at, 'until': NULL::TIMESTAMP}})),
            lambda s, x: CASE WHEN s.status = 'pending' AND x.status = 'start' THEN {{'status': 'active', 'since': x.since, 'until': NULL::TIMESTAMP}}
                              WHEN s.status = 'pending' THEN {{'status': CASE x.status WHEN 'finish' THEN 'done' WHEN 'skip' THEN 'skipped' ELSE 'error' END, 'since': NULL::TIMESTAMP, 'until': NULL::TIMESTAMP}}
                              WHEN s.status = 'active' AND x.status IN ('finish', 'fail') THEN {{'status': CASE x.status WHEN 'finish' THEN 'done' ELSE 'error' END, 'since': s.since, 'until': x.since}} ELSE s END) AS s FROM e)
    SELECT job_id, stage, s.status AS status, CAST(coalesce(round((epoch_us(s.until) - epoch_us(s.since)) / 1e6), -1) AS BIGINT) AS seconds FROM s
""")
def job_stages(spark, sf_dir):
    event = F.expr(_EVENT)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), event.alias("event"))
    return jobs.stages(events, digits=0).select("job_id", "stage", "status", F.coalesce(long("seconds"), F.lit(-1)).cast("long").alias("seconds"))


@query("""
    SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Ny ' || o_orderkey ELSE 'Order' END AS name, CAST(o_custkey AS BIGINT) AS customer FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 2 = 0
""")
def stored_records(spark, sf_dir):
    """Every order is saved; some are named, deleted, and, of these, saved anew or named after their end."""
    path = f"{boundary.shared_dir(spark)}/store-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderkey", F.to_json(F.struct(F.lit("Order").alias("name"), F.col("o_custkey").alias("customer"))).alias("record"))
    name = F.concat(F.lit("Ny "), F.col("o_orderkey").cast("string"))
    store.save(orders.withColumn("changed", F.lit(1.0)), path)
    changes = orders.where("o_orderkey % 7 = 0").select("id", F.lit("delete").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(2.0).alias("changed"))
    store.change(changes.unionByName(orders.where("o_orderkey % 5 = 0").select("id", F.lit("rename").alias("kind"), name.alias("value"), F.lit(4.0).alias("changed"))), path)
    store.save(orders.where("o_orderkey % 14 = 0").withColumn("changed", F.lit(3.0)), path)
    got = F.from_json("record", "name string, customer long")
    return store.stored(spark, path).select("id", got["name"].alias("name"), got["customer"].alias("customer"))


@query("SELECT 's' || s_suppkey || '.txt' AS name, s_name || chr(10) || chr(10) || 'Saldo ' || CAST(s_nationkey AS VARCHAR) || chr(10) AS content FROM supplier")
def exported_files(spark, sf_dir):
    """A file for each supplier, written by the sink and read back."""
    sink.register(spark)
    path = f"{boundary.shared_dir(spark)}/export-{uuid.uuid4().hex}"
    body = F.concat(F.lit("Saldo "), F.col("s_nationkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("name"), records.render(F.col("s_name"), body, "txt").alias("content"))
    rows.write.format(sink.FORMAT).mode("append").save(path)
    files_ = spark.read.text(path, wholetext=True)
    return files_.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("content"))


@functools.lru_cache
def _line_masks(turn: int) -> np.ndarray:
    """Where each of nine lines of a page lies that are so many degrees aslant."""
    rows, columns = np.mgrid[:96, :128]
    line = np.rint(rows - 12 + (columns - 64) * np.tan(np.deg2rad(turn))).astype(int)
    return np.stack([line // 2 == 4 * i for i in range(9)])


def page_image(text: str | None, number: int) -> bytes:
    """A page of 128 x 96 grey pixels made from a document: each word is a run of ink as long as it is, lines lie four degrees aslant at most, every third page is dark."""
    ink, masks = np.zeros((96, 128), bool), _line_masks(number % 9 - 4)
    for words, mask in zip((text or "").split("\n", 9), masks):
        inside, at = np.zeros(128, bool), 8
        for w in words.split(None, 38)[:38]:  # of three columns at least, so later ones lie beyond the margin
            inside[at : min(at + len(w), 120)] = True
            at += len(w) + 2
        ink |= mask & inside
    grey = np.where(ink, 20, 240).astype(np.uint8)
    return (255 - grey if number % 3 == 0 else grey).tobytes()


@F.arrow_udf(T.BinaryType())
def _page_images(text: pa.Array, number: pa.Array) -> pa.Array:
    return pa.array([page_image(*x) for x in zip(text.to_pylist(), number.to_pylist(), strict=True)], pa.binary())


@query()
def prepared_pages(spark, sf_dir):
    """A page image of each document, made ready for a reader. Without SQL: a test holds it against all turns one by one."""
    docs = corpus.spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", _page_images(F.col("text"), F.col("doc_id")).alias("grey"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(128).alias("width"), F.lit(96).alias("height"), "grey")
    return images.prepare(pages).select("page_id", "blank", "inverted", "turned", long("width").alias("width"), long("height").alias("height"), F.md5("grey").alias("digest"))


_PICTURE = "CAST(o_custkey * 7 % 400 AS INT) AS x0, 0 AS y0, CAST(o_custkey * 7 % 400 + 40 + o_orderkey % 260 AS INT) AS x1, 16 AS y1"


@query(f"""
    WITH w AS ({_WORDS}), i AS (SELECT CAST(o_orderkey AS BIGINT) AS page_id, {_PICTURE} FROM orders),
    l AS (SELECT *, (x1 - x0) * 16 AS area FROM i WHERE ((x1 - x0) * 16)::DOUBLE / (800 * 60) > 0.04::DOUBLE),
    e AS (SELECT l.page_id, any_value(l.area) AS area, max(w.x1) - min(w.x0) AS ew, max(w.y1) - min(w.y0) AS eh FROM l JOIN w ON w.page_id = l.page_id AND w.x0 < l.x1 AND l.x0 < w.x1 AND w.y0 < l.y1 AND l.y0 < w.y1 GROUP BY l.page_id)
    SELECT i.page_id, CASE WHEN l.page_id IS NULL THEN 0 ELSE 1 END::BIGINT AS large, CASE WHEN l.page_id IS NOT NULL AND coalesce((ew * eh)::DOUBLE / e.area < 0.55::DOUBLE, true) THEN 1 ELSE 0 END::BIGINT AS uncovered
    FROM i LEFT JOIN l ON l.page_id = i.page_id LEFT JOIN e ON e.page_id = i.page_id
""")
def native_coverage(spark, sf_dir):
    """Pages with a picture each: is there text of the text layer on it."""
    orders = table(spark, sf_dir, "orders")
    pages = orders.select(long("o_orderkey").alias("page_id"), F.lit(800).alias("width"), F.lit(60).alias("height"))
    pictures = orders.selectExpr("CAST(o_orderkey AS BIGINT) AS page_id", *_PICTURE.split(", "))
    return readings.uncovered_images(pages, _words(spark, sf_dir), pictures).select("page_id", "large", "uncovered")
