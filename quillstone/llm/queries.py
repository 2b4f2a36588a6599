"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import chat, decontaminate, divergence, hash_search, jaccard, maxent, packing, quality, resampling, sharding, substring, suffix_dedup, warc
from quillstone.llm.common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hash_search.sign_code(F.col("embedding")).alias("code"))
    found = hash_search.search(vectors, vectors.where("id % 100 = 0"), k=10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 50, digests=True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_table(spark, sf_dir, "documents"), 13)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = materialise(warc.archive(_table(spark, sf_dir, "pages")), "warc")
    return warc.read_archive(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(materialise(chat.format_log(chat.as_log(rows)), "chat"))


QUERIES = {"op1_hash_search": op1_hash_search, "op2_packing": op2_packing, "op3_maxent": op3_maxent, "op4_ngram_jaccard": op4_ngram_jaccard, "op5_decontamination": op5_decontamination, "op6_suffix_array": op6_suffix_array, "op7_sharding": op7_sharding, "op8_substring": op8_substring, "op9_quality": op9_quality, "op10_warc": op10_warc, "op11_resampling": op11_resampling, "op12_divergence": op12_divergence, "op13_chat": op13_chat}
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: CRC-32 of distinct strings `f`: a table of 256 steps, made from the polynomial, and one step for each byte.
_CRC_TABLE = "SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"
_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = "1 + 1000000000::HUGEINT * ({c} + 1) // ({n} + {v})"
_CONTROL = r"(/?SYS\]|/?INST\]|ROLE=|/ROLE\]|/?s>)"
_CHAR = "substr('" + _BASE32 + "', 1 + CAST((v >> {shift}) & 31 AS INT), 1)"

ORACLES: dict[str, str] = {
    "op1_hash_search": """
        WITH d AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
                   list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] >= 0) <> (v.embedding[i] >= 0) THEN 1 ELSE 0 END))::BIGINT AS distance
            FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d)
        SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
    """,
    "op4_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 90 * (x.n + y.n - o.o)),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op6_suffix_array": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 48)) AS i, h FROM h),
        k AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 100)) AS k FROM w),
        f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
        b AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (k) WHERE first < doc_id),
        m AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS z FROM b),
        e AS (SELECT doc_id, p AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM m WHERE z IS NULL OR z > p + 1),
        t AS (SELECT doc_id, p AS start, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM m WHERE q IS NULL OR q < p - 1),
        g AS (SELECT t.doc_id, t.n, start, stop, coalesce(lag(stop) OVER (PARTITION BY t.doc_id ORDER BY t.n), 0) AS before, max(stop) OVER (PARTITION BY t.doc_id) AS last FROM t JOIN e ON e.doc_id = t.doc_id AND e.n = t.n),
        c AS (SELECT h.doc_id, sum(stop - start + 1) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (start - 1 - before)), '' ORDER BY n) || substr(any_value(h), 2 * any_value(last) + 1) AS kept FROM g JOIN h ON h.doc_id = g.doc_id GROUP BY h.doc_id)
        SELECT h.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(kept, h))) AS kept_sha256
        FROM h LEFT JOIN c ON c.doc_id = h.doc_id
    """,
    "op8_substring": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
        f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
        b AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (k) WHERE first < doc_id),
        g AS (SELECT doc_id, count(*) AS gone, list(p) AS p FROM b GROUP BY doc_id),
        u AS (SELECT w.doc_id, len(w) AS n, coalesce(gone, 0) AS gone, CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE (SELECT coalesce(string_agg(x, ' ' ORDER BY i), '') FROM (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS i) WHERE i NOT IN (SELECT p FROM b WHERE b.doc_id = w.doc_id)) END AS kept
              FROM w LEFT JOIN g ON g.doc_id = w.doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM u
    """,
    "op10_warc": f"""
        WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(list_transform(range(0, 8), lambda k: CAST('0x' || substr(x, CAST(1 + 5 * k AS INT), 5) AS INT)), lambda v: {" || ".join(_CHAR.format(shift=k) for k in (15, 10, 5, 0))}), '') AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d
    """,
    "op11_resampling": rf"""
        WITH t AS ({_CRC_TABLE}),
        x AS (SELECT true AS raw, doc_id, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
              UNION ALL SELECT false, NULL, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        g AS (SELECT raw, doc_id, len(w) AS n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM x),
        b AS (SELECT f, CAST({_CRC} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT f FROM g), t),
        k AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM g JOIN b USING (f) GROUP BY bucket),
        z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM k),
        v AS (SELECT bucket, CAST(floor(1000 * ln((k.t + 1)::DOUBLE * (z.s + 10000) / ((k.s + 1)::DOUBLE * (z.t + 10000)))) AS BIGINT) AS gain FROM k, z),
        d AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM g JOIN b USING (f) JOIN v USING (bucket) WHERE raw GROUP BY doc_id),
        e AS (SELECT x.doc_id, len(x.w) AS n_words, coalesce(d.n, 0) AS n_features, CAST(coalesce(floor(total::DOUBLE / d.n), 0) AS BIGINT) AS weight,
                     CAST('0x' || substr(sha256('7:' || x.doc_id), 1, 8) AS BIGINT) AS h FROM x LEFT JOIN d ON d.doc_id = x.doc_id WHERE raw),
        c AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM c)
        SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM r
    """,
    "op12_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_AZ}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
        c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY 1, 2, 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
        p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS c, {_SHARE.format(c="coalesce(c.n, 0)", n="s.n", v="v.v")} AS p, {_SHARE.format(c="k.total", n="v.n", v="v.v")} AS q
              FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM x)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
    """,
    "op13_chat": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT *, CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 16 + length(url_encode(role)) END AS marks, regexp_replace(text, '([\[<])(\\*){_CONTROL}', '\1\2\\\3', 'g') AS safe FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(marks + length(safe)) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id
    """,
}
