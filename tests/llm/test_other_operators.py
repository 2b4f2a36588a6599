"""Search, components, WARC, and the registered queries."""

import base64
import hashlib
import io
import random
import zlib

from pyspark.sql import functions as F

from quillstone.llm import graph, hash_search, warc


def test_search_is_exact(spark):
    r = random.Random(5)
    codes = [(i, r.getrandbits(64) - 2**63) for i in range(400)]
    codes += [(1000 + i, codes[0][1] ^ (1 << (i % 60))) for i in range(60)] + [(2000 + i, codes[1][1]) for i in range(40)] + [(None, 5), (7777, None), codes[3]]
    table = spark.createDataFrame(codes, "id long, code long").withColumn("rank", F.lit(0))
    queries = spark.createDataFrame([(q, codes[q][1]) for q in (0, 1, 2, 3)] + [(9, 12345)], "id long, code long")
    known = sorted({c for c in codes if None not in c})
    for k in (1, 10):
        got = {}
        for x in hash_search.search(table, queries, k).collect():
            got.setdefault(x["query_id"], []).append((x["distance"], x["id"], x["rank"]))
        for q in queries.collect():
            want = sorted(((c ^ q["code"]) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in known)[:k]
            assert sorted(d * 10**6 + i for d, i, _ in got[q["id"]]) == want and sorted(n for *_, n in got[q["id"]]) == list(range(1, k + 1))
    few = hash_search.search(table.where("id < 3"), queries, 10).groupBy("query_id").count().collect()
    assert all(x["count"] <= 3 for x in few) and hash_search.search(table.limit(0), queries).count() == 0


def test_every_query_ends_by_the_index(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), hash_search.sign_code(F.col("embedding")).alias("code"))
    asked, rounds = table.where("id % 100 = 0"), []
    got = hash_search.search(table, asked, 10, rounds)
    codes, count = table.select("code").distinct().count(), hash_search.segment_count(table.count())
    assert got.count() == 10 * asked.count() and rounds[-1][0] < 64 // count  # done before a segment's whole width was probed
    assert [c for _, c, _ in rounds] == [count * r + some.stop - 1 for r, some in hash_search._steps(count)[: len(rounds)]] and codes > 100
    last = {r["query_id"]: r["distance"] for r in got.where("rank = 10").collect()}
    for (_, before, _), (_, covered, waiting) in zip([(0, -1, 0), *rounds], rounds):
        assert waiting >= len({q for q, d in last.items() if before < d <= covered})


def test_probes_cover_each_value_once(spark):
    one = spark.createDataFrame([(0x0123456789ABCDEF,)], "query long")
    for count, r in ((7, 2), (16, 4), (16, 0), (5, 1)):
        got = [(x["seg"], x["value"]) for x in hash_search._probes(one, count, r).collect()]
        cuts = [i * 64 // count for i in range(count + 1)]
        want = {(i, v) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) for v in range(1 << (b - a)) if (v ^ (0x0123456789ABCDEF >> a & ((1 << (b - a)) - 1))).bit_count() == r}
        assert len(got) == len(set(got)) and set(got) == want


def test_sign_code(spark):
    rows = spark.createDataFrame([([1.0, -1.0, 0.0, None],), (None,)], "v array<float>")
    assert [r[0] for r in rows.select(hash_search.sign_code(F.col("v"))).collect()] == [0b101, None]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(None, 1), (5, 5)]
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["id"]: x["comp"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_round_trip(spark):
    r = random.Random(1)
    big = "".join(r.choice("abcdé\r\n") for _ in range(5000))
    pages = [(3, "http://a/", "x"), (1, "http://b/\r\nX: y", "x"), (2, None, None), (5, "u", ""), (4, "v", big), (6, "w", big), (6, "w", big), (None, "n", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, t in pages:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for chunk in (1 << 18, 300, 40):
        for least in (0, 2):
            stored = warc.archive(table, least, chunk)
            got = sorted(map(tuple, warc.read_archive(stored).drop("url").collect()), key=str)
            refers = lambda i, t: None if len((t or "").encode()) < least or first[t or ""] == i else first[t or ""]
            want = [(i, len((t or "").encode()), digest(t), "response" if refers(i, t) is None else "revisit", refers(i, t)) for i, _, t in pages]
            assert got == sorted(want, key=str)
    out = io.BytesIO()
    size = warc.copy_to(stored.orderBy("record_no", "chunk_no").toLocalIterator(), out)
    assert size == len(out.getvalue()) and out.getvalue().count(b"WARC/1.1\r\n") == len(pages)


def test_warc_payloads_of_several_megabytes(spark):
    """The production chunk: payloads just around it, and some of many chunks."""
    r = random.Random(8)
    sizes = [(1 << 18) - 600, 1 << 18, (1 << 18) + 1, 3_000_000, 7_500_001, 0, 1]
    pages = [(i, f"http://x/{i}", "".join(r.choices("abcdé\n", k=1000)) * (n // 1000) + "z" * (n % 1000)) for i, n in enumerate(sizes)]
    stored = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3))
    assert stored.groupBy("record_no").count().where("count > 20").count() == 1
    got = {x["page_id"]: (x["payload_bytes"], x["payload_digest"]) for x in warc.read_archive(stored).collect()}
    assert got == {i: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()) for i, _, t in pages}


def test_damage_is_found(spark):
    stored = warc.archive(spark.createDataFrame([(1, "u", "hello " * 200)], "page_id long, url string, html string"), 0, 256)
    damaged = stored.withColumn("data", F.when(F.col("chunk_no") == 3, F.unhex(F.regexp_replace(F.hex("data"), "68656C", "68656D"))).otherwise(F.col("data")))
    for bad, why in ((damaged, "damaged"), (stored.where("chunk_no != 2"), "lacks chunk")):
        try:
            warc.read_archive(bad).collect()
        except Exception as e:
            assert why in str(e)
        else:
            raise AssertionError(why)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    pieces = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_catches_what_is_planted(spark):
    import corpus_pipeline

    sf, r = "/root/testdata/sf0.001", random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, near, item = prose(60), prose(200), spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    texts = {1: near, 2: near.replace(near.split()[100], "changed"), 3: f"{prose(80)} {passage} {prose(80)}", 4: f"{prose(70)} {passage} {prose(90)}", 5: f"{prose(60)} {item} {prose(60)}", 6: prose(150), 7: None, 8: "", 9: near}
    rows = [(i + 10**9, t, "x") for i, t in texts.items()] + [(None, prose(90), "n"), (6 + 10**9, texts[6], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string").selectExpr("*", "1 AS rest", "'b' AS bucket")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame([tuple(x) for x in out.collect()], docs.schema)
    kept = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert set(kept) == {i + 10**9 for i in (1, 3, 4, 6, 7, 8)} | {None}
    assert all(kept[i + 10**9] == texts[i] for i in (1, 3, 6)) and kept[4 + 10**9] == texts[4].replace(passage + " ", "")
    ids = {x[0] for x in corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().collect()}
    assert ids == set(kept)


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(none).count() == 0 and warc.read_archive(warc.archive(none)).count() == 0


def test_pipeline_carries_token_ids(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words to pack " * 30), (2, "")], "doc_id long, text string")
    for r in corpus_pipeline.packed(spark, docs, "").collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]


def test_queries_return_whole_tables(spark):
    from quillstone.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op3_maxent", "op4_ngram_jaccard", "op6_suffix_array", "op7_sharding", "op8_substring", "op9_quality"):
        assert QUERIES[name](spark, sf).count() == n, name
