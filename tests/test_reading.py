"""Pages read once, the cascade of readers, jobs over a stream, the store of versions, the file sink, and the index of codebooks."""

import json
import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.operators import codebook
from quillstone.plans import reading, store
from quillstone.sources import sink
from quillstone.streaming import jobs

PAGE = "doc_id long, page_num int, native string, uncovered int, image binary"


def counted(folder):
    folder.mkdir()

    def note(value):
        (folder / uuid.uuid4().hex).write_bytes(value)

    return note, lambda: sorted(p.read_bytes() for p in folder.iterdir())


def test_each_image_is_read_once(spark, tmp_path):
    note, seen = counted(tmp_path / "first")
    cache = str(tmp_path / "cache")

    def first(image):
        note(image)
        if image == b"broken":
            raise OSError("no")
        return {"text": f"Hb {len(image)} mg", "confidence": 95.0}

    pages = [(1, 1, "Textlager", 0, b"unused"), (1, 2, "", 0, b"scan"), (1, 3, None, 0, b"scan"), (1, 4, "Hb 9 mg", 1, b"scan"), (2, 1, "�", 0, b"scan"), (2, 2, "", 0, b"other"), (3, 1, "", 0, b"broken"), (4, 1, "", 0, None), (5, 1, "bra", None, b"z")]
    df = spark.createDataFrame([(*p, "x") for p in pages], PAGE + ", digest string").repartition(3)
    out = reading.read_pages(df, reading.Readers(first=first), cache=cache, tasks=2)
    rows = {(r["doc_id"], r["page_num"]): r for r in out.collect()}
    assert seen() == sorted([b"scan", b"other", b"broken", b""]) and len(rows) == len(pages)
    assert {k: (r["text"], r["method"], r["cached"]) for k, r in rows.items() if r["error"] is None} == {
        (1, 1): ("Textlager", "native", False), (1, 2): ("Hb 4 mg", "first", False), (1, 3): ("Hb 4 mg", "first", True), (1, 4): ("Hb 4 mg", "first", True),
        (2, 1): ("Hb 4 mg", "first", False), (2, 2): ("Hb 5 mg", "first", False), (4, 1): ("Hb 0 mg", "first", False), (5, 1): ("bra", "native", False),
    }
    assert rows[1, 4]["warnings"] == [fixed.LAYER_VALUES_LOST] and rows[1, 2]["warnings"] == [] and "usable" in rows[3, 1]["error"]
    again = reading.read_pages(df, reading.Readers(first=first), cache=cache)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect())) and len(seen()) == 5  # only what failed is asked for again
    docs = {r["doc_id"]: r for r in reading.transcriptions(out).collect()}
    assert docs[1]["text"] == "--- Sida 1 ---\n\nTextlager" + "".join(f"\n\n--- Sida {i} ---\n\nHb 4 mg" for i in (2, 3, 4)) and docs[1]["warnings"] == [f"Page 4: {fixed.LAYER_VALUES_LOST}"]
    assert docs[3]["text"] is None and docs[3]["error"].startswith("Page 1: ")
    assert reading.read_pages(df.limit(0), reading.Readers(first=first)).count() == 0


def test_a_reader_only_sees_what_needs_it(spark, tmp_path):
    """Weak first readings go to the second reader, pages without text from both to the generative one, whose loops are asked for again."""
    logs = [counted(tmp_path / n) for n in ("a", "b", "c")]

    def first(image):
        logs[0][0](image)
        kind = image.split(b"-")[0]
        if kind == b"down":
            raise TimeoutError("late")
        return {"text": "" if kind in (b"blank", b"loop", b"dead", b"cut") else "Hb\t5 mg" if kind == b"table" else "Hb 5 mg", "confidence": 50 if kind == b"weak" else 20 if kind == b"bad" else 95, "critical_low": kind == b"unsure"}

    def second(image):
        logs[1][0](image)
        kind = image.split(b"-")[0]
        return {"text": "" if kind in (b"loop", b"dead", b"cut") else "Hb 6 mg", "confidence": 30 if kind in (b"bad", b"down") else 80}

    def vision(image, attempt):
        logs[2][0](image + b"%d" % attempt)
        kind = image.split(b"-")[0]
        if kind == b"dead" or kind == b"loop" and not attempt:
            return "Samma rad som upprepas helt\n" * 6, True
        return f"<think>x</think>```\nläst [oläsligt] {attempt}\n```", kind != b"cut" or attempt > 0

    kinds = ["good", "weak", "bad", "table", "unsure", "blank", "down", "loop", "dead", "cut"]
    images = [f"{k}-{i}".encode() for k in kinds for i in range(3)]
    df = spark.createDataFrame([(i.ljust(8), i) for i in images], "digest binary, image binary")
    out = reading.cascade(df, reading.Readers(first, second, vision), in_flight=2)
    rows = {bytes(r["digest"]).strip(): r for r in out.collect()}
    of = lambda *ks: sorted(i for i in images if i.split(b"-")[0].decode() in ks)
    assert len(rows) == len(images) and logs[0][1]() == sorted(images)
    assert logs[1][1]() == of(*(set(kinds) - {"good"}))
    assert logs[2][1]() == sorted([i + b"0" for i in of("loop", "dead", "cut")] + [i + b"1" for i in of("loop", "dead", "cut")])
    assert all(rows[i]["engine"] == "second" and rows[i]["text"] == "Hb 6 mg" and fixed.READERS_DIFFER_CRITICAL in rows[i]["warnings"] for i in of("weak", "table", "unsure"))
    assert all(rows[i]["engine"] == "first" and rows[i]["error"] is None and not rows[i]["warnings"] for i in of("good"))
    assert all(rows[i]["error"] == fixed.PAGE_REJECTED and rows[i]["text"] is None for i in of("bad", "down"))
    assert all(fixed.READER_FAILED % "first" in rows[i]["warnings"] for i in of("down"))
    assert all(rows[i]["text"] == "läst [oläsligt] 1" and rows[i]["warnings"] == [fixed.VISION_READ, fixed.UNREADABLE_MARKERS] for i in of("loop", "cut"))
    assert all(rows[i]["error"] == fixed.VISION_LOOPS + fixed.REPLACE_SCAN and rows[i]["engine"] == "vision_model" for i in of("dead"))
    one = reading.cascade(df, reading.Readers(first)).where("digest = cast('weak-0  ' as binary)").first()
    assert one["warnings"][0] == fixed.NO_SECOND_READER and one["error"] is None
    with pytest.raises(ValueError):
        reading.cascade(df, reading.Readers(first), "odd")


def test_long_documents_are_refused(spark, tmp_path):
    note, seen = counted(tmp_path / "r")

    def first(image):
        note(image)
        return {"text": "Hb", "confidence": 95}

    pages = spark.createDataFrame([(1, i, "", 0, b"a%d" % i) for i in range(4)] + [(2, 0, "", 0, b"b"), (None, 0, "", 0, b"c")], PAGE)
    rows = reading.read_pages(pages, reading.Readers(first), most_pages=3).collect()
    assert seen() == [b"b", b"c"] and {(r["doc_id"], r["error"]) for r in rows} == {(1, fixed.TOO_MANY_PAGES % 3), (2, None), (None, None)} and len(rows) == 6


def test_symbols_are_not_read(spark, tmp_path):
    import hashlib

    note, seen = counted(tmp_path / "r")

    def first(image):
        note(image)
        return {"text": "Hb", "confidence": 95}

    sha = lambda b: hashlib.sha256(b).digest()
    symbols = spark.createDataFrame([(1, 1, 1, hashlib.sha256(b"1x1:abc").hexdigest(), "man"), (2, 1, 2, hashlib.sha256(b"1x1:xyz").hexdigest(), "size differs")], "symbol_id int, width int, height int, digest string, description string")
    images = spark.createDataFrame([(sha(b"p"), 1, 1, b"abc", b"p"), (sha(b"q"), 1, 1, b"xyz", b"q"), (sha(b"r"), 2, 2, b"abc", b"r")], "digest binary, width int, height int, pixels binary, image binary")
    rows = {bytes(r["digest"]): (r["text"], r["engine"]) for r in reading.symbols_first(images, symbols, reading.Readers(first)).collect()}
    assert rows == {sha(b"p"): ("man", "symbol"), sha(b"q"): ("Hb", "first"), sha(b"r"): ("Hb", "first")} and seen() == [b"q", b"r"]


def test_uncovered_images(spark):
    from quillstone.operators import readings

    r = random.Random(6)
    box = lambda: (x := r.randrange(-20, 90), y := r.randrange(-20, 90), x + r.randrange(0, 70), y + r.randrange(0, 70))
    pages = [(i, 100, 100) for i in range(40)] + [(90, 0, 0), (91, 50, 50)]
    words = [(r.randrange(40), *box()) for _ in range(150)] + [(0, None, 1, 2, 3), (91, 0, 0, 10, 10)]
    pictures = [(r.randrange(40), *box()) for _ in range(120)] + [(1, 0, 0, None, 9), (91, 0, 0, 50, 50), (777, 0, 0, 9, 9)]
    want = {}
    for page, w, h in pages:
        large = uncovered = 0
        for i, *b in pictures:
            if i != page or None in b:
                continue
            x0, y0, x1, y1 = max(0, b[0]), max(0, b[1]), min(w, b[2]), min(h, b[3])
            if x1 <= x0 or y1 <= y0 or (x1 - x0) * (y1 - y0) <= 0.04 * max(1, w * h):
                continue
            large += 1
            on = [o for j, *o in words if j == page and None not in o and o[0] < x1 and x0 < o[2] and o[1] < y1 and y0 < o[3]]
            around = (max(o[2] for o in on) - min(o[0] for o in on)) * (max(o[3] for o in on) - min(o[1] for o in on)) if on else 0
            uncovered += not on or around / max(1, (x1 - x0) * (y1 - y0)) < 0.55
        want[page] = (large, uncovered)
    ends = "page_id long, x0 int, y0 int, x1 int, y1 int"
    got = readings.uncovered_images(spark.createDataFrame(pages, "page_id long, width int, height int"), spark.createDataFrame(words, ends), spark.createDataFrame(pictures, ends))
    assert {x["page_id"]: (x["large"], x["uncovered"]) for x in got.collect()} == want and any(b for _, b in want.values())


def test_uncovered_images_have_no_ids_of_their_place(spark):
    """Numbers given by place differ where a shuffle is read twice; equal images of a page count each."""
    from quillstone.operators import readings

    ends = "page_id long, x0 int, y0 int, x1 int, y1 int"
    pages, pictures = spark.createDataFrame([(1, 100, 100)], "page_id long, width int, height int"), spark.createDataFrame([(1, 0, 0, 50, 50)] * 3 + [(1, 50, 50, 90, 90)], ends)
    got = readings.uncovered_images(pages, spark.createDataFrame([(1, 51, 51, 89, 89)], ends), pictures)
    assert [tuple(r)[3:] for r in got.collect()] == [(4, 3)]
    assert "monotonically" not in got._jdf.queryExecution().toString()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abåß", min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.text("abåß ", max_size=40), max_size=5))
def test_the_index_finds_every_fake(spark, fakes, texts):
    fakes = sorted(set(fakes))
    got = codebook.occurrences(spark.createDataFrame([*enumerate(texts), (99, None)], "text_id long, text string"), spark.createDataFrame([(f,) for f in fakes], "fake string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, f, x.count(f)) for i, x in enumerate(texts) for f in fakes if f in x)


def test_codebooks_of_many_texts(spark):
    """A fake that all books have, a run of characters that all texts have, long texts, and identity numbers."""
    shared, names = "Anna Gemensam", [f"Anna Person{i:05d}" for i in range(400)]
    pairs = [(f"b{i}", n, "PER") for i, n in enumerate(names)] + [(f"b{i}", shared, "PER") for i in range(400)] + [("b7", "19500101-1234", "PERSONNUMMER"), ("b8", "Kort", "PER"), ("b9", "55", "PERSONNUMMER")]
    texts = [(i, f"Patient Anna Person{i % 500:05d}, xAnna Gemensam" + (" 19500101-1234" if i % 500 == 7 else "")) for i in range(1000)] + [(5000, "Anna Gemensam " * 20_000), (5001, "555"), (5002, None)]
    got = codebook.scores(spark.createDataFrame(texts, "text_id long, text string").repartition(5), spark.createDataFrame(pairs, "book_id string, fake string, type string"))
    want = {}
    for i, x in texts:
        for book, fake, kind in pairs:
            if x and fake in x and (kind == "PERSONNUMMER" or len(fake) >= 8):
                want[i, book] = want.get((i, book), 0) + x.count(fake) * (fixed.IDENTITY_WEIGHT if kind == "PERSONNUMMER" else 1)
    assert {(r["text_id"], r["book_id"]): r["score"] for r in got.collect()} == want
    none = spark.createDataFrame([], "book_id string, fake string, type string")
    assert codebook.scores(spark.createDataFrame(texts, "text_id long, text string"), none).count() == 0


def test_texts_of_one_book_are_restored_in_parts(spark):
    """A book of many texts has several parts; texts without a book go through no join by their null book."""
    pairs = [("a", 1, "Eva Ask", "Anna Gemensam", "PER"), ("b", 1, "Bo Ek", "Per Annan Stor", "ORG"), ("c", 1, "Ida", "Ingen Har Denna", "ORG")]
    n, text = 3 * codebook.PART_TEXTS, "CASE WHEN id % 100 = 1 THEN 'Per Annan Stor, Per Annan Stor' WHEN id % 100 = 2 THEN 'inget' WHEN id % 100 > 3 THEN 'Anna Gemensam och Anna Gemensam' END AS text"
    texts = spark.range(n).selectExpr("id AS text_id", text).withColumn("summary", F.col("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = codebook.deanonymise(texts, spark.createDataFrame(pairs, "book_id string, ord long, real string, fake string, type string")).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    some = {1: ("b", 2, "Bo Ek, Bo Ek", "Per Annan Stor", "Bo Ek", 2), 2: (None, 0, "inget", None, None, 0), **dict.fromkeys((0, 3), (None, 0, None, None, None, 0))}
    want = {i: some.get(i % 100, ("a", 2, "Eva Ask och Eva Ask", "Anna Gemensam", "Eva Ask", 2)) for i in range(n)}
    assert len(out) == n and {r["text_id"]: tuple(r)[1:7] for r in out} == want
    assert all(len({r["at"] for r in out if r["book_id"] == book}) > 1 for book in ("a", None))


EVENT = "job_id long, stage string, seq long, at timestamp, event string"


def some_events(seed, n=300):
    r = random.Random(seed)
    return [(r.randrange(6), r.choice(["read", "write"]), i, 1_700_000_000 + r.randrange(0, 400), r.choice(["start", "start", "finish", "fail", "skip", "odd"])) for i in range(n)]


def folded(events):
    """Event after event, as a service keeps its jobs."""
    out, last = {}, {}
    for job, stage, seq, at, event in sorted(events, key=lambda e: (e[2], e[3], e[4])):
        if event not in jobs.KNOWN:
            continue
        last[job] = max(at, last.get(job, at))
        status, since, took = out.get((job, stage), ("pending", None, None))
        if (status, event) == ("pending", "start"):
            status, since = "active", at
        elif status == "pending" or status == "active" and event in ("finish", "fail"):
            took = None if status == "pending" else float(at - since)
            status = jobs.ENDS[event]
        out[job, stage] = status, since, took
    return {k: (v[0], v[2]) for k, v in out.items()}, last


def as_rows(spark, events):
    return spark.createDataFrame(events, "job_id long, stage string, seq long, t long, event string").withColumn("at", F.timestamp_seconds("t")).drop("t")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stages_of_a_table(spark, seed):
    events = some_events(seed)
    want, last = folded(events)
    got = {(r["job_id"], r["stage"]): (r["status"], r["seconds"]) for r in jobs.stages(as_rows(spark, events)).collect()}
    assert got == want
    now = 1_700_000_000 + 420
    silent = {(r["job_id"], r["stage"]): (r["status"], r["detail"]) for r in jobs.stages(as_rows(spark, events), 25, F.timestamp_seconds(F.lit(now))).collect()}
    assert silent == {k: ("error", jobs.SILENT) if v[0] == "active" and now - last[k[0]] > 25 else (v[0], None) for k, v in want.items()}


def test_stages_of_a_stream(spark, tmp_path):
    """Events in random micro-batches, with a restart from the checkpoint in between, end as the table's do; a silent job's stages are ended by its timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = some_events(9, 120) + [(77, "read", 10_000, 1_700_000_000, "start")]
    random.Random(4).shuffle(events)
    src, out = str(tmp_path / "in"), []

    def run(lateness, silence):
        rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)
        query = jobs.stage_updates(rows, lateness, silence).writeStream.outputMode("update").foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(300)

    def state():
        return {(r[0], r[1]): (r[2], r[3], r[4]) for part in out for r in part}

    for k in range(2):
        as_rows(spark, events[k * 40 : (k + 1) * 40]).select("job_id", "stage", "seq", "at", "event").coalesce(1).write.mode("append").parquet(src)
    run("1000 seconds", 3600.0)
    as_rows(spark, events[80:]).select("job_id", "stage", "seq", "at", "event").coalesce(1).write.mode("append").parquet(src)
    run("1000 seconds", 3600.0)
    want, _ = folded(events)
    assert {k: v[:2] for k, v in state().items()} == want
    late = [(500, "read", 1, 1_700_100_000, "start"), (500, "read", 2, 1_700_100_002, "finish")]
    for e in late:  # the watermark passes all that is before
        as_rows(spark, [e]).select("job_id", "stage", "seq", "at", "event").coalesce(1).write.mode("append").parquet(src)
        run("1000 seconds", 3600.0)
    want, _ = folded(events + late)
    assert state() == {k: ("error", v[1], jobs.SILENT) if v[0] == "active" else (*v, None) for k, v in want.items()}


REC = "id string, record string, changed double"


def test_store_of_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.get_record(spark, path, "a") is None and not store.rename_record(spark, path, "a", "x", 1.0)
    rows = [(f"r{i}", json.dumps({"id": f"r{i}", "name": "old", "n": [1, {"x": None}]}), 1.0) for i in range(40)]
    store.save(spark.createDataFrame(rows, REC), path)
    assert store.rename_record(spark, path, "r1", ' né"w ', 2.0) and store.rename_record(spark, path, "r1", " ", 9.0) and not store.rename_record(spark, path, "zz", "x", 2.0)
    assert json.loads(store.get_record(spark, path, "r1")) == {"id": "r1", "name": 'né"w', "n": [1, {"x": None}]}
    assert store.delete_record(spark, path, "r2", 3.0) and not store.delete_record(spark, path, "r2", 4.0) and not store.rename_record(spark, path, "r2", "x", 9.0)
    left = {r["id"]: json.loads(r["record"])["name"] for r in store.stored(spark, path).collect()}
    assert len(left) == 39 and left["r1"] == 'né"w' and "r2" not in left and left["r3"] == "old"
    files = store.changes_of(spark, path, "r1").inputFiles()
    bucket = {f.split("bucket=")[1].split("/")[0] for f in files}
    assert len(bucket) == 1 and 2 <= len(files) < 6 and len(store.stored(spark, path).inputFiles() or store._read(spark, files).inputFiles()) >= len(files)


def test_writers_lose_nothing(spark, tmp_path):
    """Two writers change a record from the same state; a third adds changes while a bucket is compacted."""
    path = str(tmp_path / "store")
    store.save(spark.createDataFrame([("a", '{"name": "old", "n": 1}', 1.0), ("b", '{"name": "b"}', 1.0)], REC), path)
    seen = [store.get_record(spark, path, "a") for _ in range(2)]  # both have read, neither has written
    assert seen[0] == seen[1]
    store.rename_record(spark, path, "a", "new", 2.0)
    store.save(spark.createDataFrame([("a", '{"name": "old", "n": 2}', 1.5)], REC), path)  # was made before the name, and arrives after it
    assert json.loads(store.get_record(spark, path, "a")) == {"name": "new", "n": 2}
    bucket = int(store.changes_of(spark, path, "a").inputFiles()[0].split("bucket=")[1].split("/")[0])
    real = store._read

    def while_it_reads(session, files):  # a change comes in after the compaction has listed its files
        store._read = real
        store.save(session.createDataFrame([("a", '{"name": "late", "n": 3}', 5.0)], REC), path)
        return real(session, files)

    store._read = while_it_reads
    try:
        needless = store.compact(spark, path, bucket)
    finally:
        store._read = real
    assert needless and json.loads(store.get_record(spark, path, "a"))["n"] == 3
    store.sweep(spark, needless)
    assert json.loads(store.get_record(spark, path, "a")) == {"name": "late", "n": 3} and len(store.changes_of(spark, path, "a").inputFiles()) == 2
    store.delete_record(spark, path, "a", 6.0)
    store.sweep(spark, store.compact(spark, path, bucket))
    store.save(spark.createDataFrame([("a", '{"name": "copy"}', 4.0)], REC), path)  # a late copy of something old
    assert store.get_record(spark, path, "a") is None and store.get_record(spark, path, "b") is not None


def test_files_are_there_whole_or_not_at_all(spark, tmp_path):
    sink.register(spark)
    out, flag = tmp_path / "out", tmp_path / "failed-once"
    rows = spark.createDataFrame([(f"n{i}.txt", f"text {i} å") for i in range(20)], "name string, content string").repartition(4)
    rows.write.format(sink.FORMAT).mode("append").save(str(out))
    assert {p.name: p.read_text() for p in out.iterdir()} == {f"n{i}.txt": f"text {i} å" for i in range(20)}
    binary = spark.createDataFrame([("n1.txt", b"\x00new"), ("z.bin", None)], "name string, content binary")
    binary.write.format(sink.FORMAT).mode("append").save(str(out))
    assert (out / "n1.txt").read_bytes() == b"\x00new" and (out / "z.bin").read_bytes() == b"" and len(list(out.iterdir())) == 21

    def fails_once(batches):
        for batch in batches:
            yield batch
        if not flag.exists():
            flag.write_text("x")
            raise OSError("lost")

    writer = sink._Writer(str(tmp_path / "retry"), rows.schema)
    part = [dict(name=f"{i}", content=str(i)) for i in range(3)]
    with pytest.raises(OSError):
        writer.write(fails_once(iter(part)))
    done = writer.write(fails_once(iter(part)))  # the attempt that the job takes
    writer.commit([done, None])
    assert sorted(p.name for p in (tmp_path / "retry").iterdir()) == ["0", "1", "2"]
    for bad in ([("a/b", "x")], [("twice", "x"), ("twice", "y")], [(None, "x")]):
        with pytest.raises(Exception, match="file"):
            spark.createDataFrame(bad, "name string, content string").write.format(sink.FORMAT).mode("append").save(str(tmp_path / "bad"))
        assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
