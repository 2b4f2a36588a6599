"""Pseudonymisation of batches whose documents stay rows, and calls to outside services."""

import itertools
import random
import re
import threading
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.functions import fixed
from quillstone.operators import batches, calls, detect
from quillstone.plans import process, progress
from quillstone.sources import files

DOC = "batch_id long, doc_index int, text string"


@settings(max_examples=300, deadline=None)
@given(st.text("aAßſsSıiİIKkσςΣ µμ.-_1é", max_size=30), st.lists(st.text("aAßſsSıiİIKkσςΣ µμ.-_1é", min_size=1, max_size=4), max_size=6))
def test_occurrences_are_those_of_a_search(text, values):
    want = {(*m.span(), "X") for v in values for m in re.finditer(rf"(?<!\w){re.escape(v)}(?!\w)", text, re.IGNORECASE)}
    assert set(detect.occurrences(text, [(v, "X") for v in values])) == want
    known = set(batches.text_keys(text).tolist())
    assert all(batches.surface_key(v) in known for v in values if re.search(rf"(?<!\w){re.escape(v)}(?!\w)", text, re.IGNORECASE))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["19500101", "-1234", "a@b", ".se", "2024-", "05-06", "3", " MAJ ", "oKtober", "2021", "070", "+46", " 123", " 45", "67", "Journal-ID", "ÄRENDE", "-id ", "AB12", "Postnr", "Dr", "läkare", " Alma", " Berg", "Stora", "gatan", "VÄGEN", " 5", "45", "Årig", " år", " gammal", "s ålder", " ", "\n", "ſ"]), max_size=14).map("".join))
def test_anchors_lose_nothing(text):
    want = [(*m.span(group), kind) for kind, pattern, group in fixed.RULES for m in re.finditer(detect._python(pattern), text)]
    assert detect.by_rules(text) == want


def expected(docs, detected=(), listed=()):
    """For small data: everything of a batch held against everything."""
    texts, mapping = {}, {}
    for batch in {b for b, *_ in docs}:
        mine = sorted((i, x or "") for b, i, x in docs if b == batch)
        spans = {i: set(detect.by_rules(x)) | {(s, e, k) for b, d, s, e, k in detected if (b, d) == (batch, i)} for i, x in mine}
        values = {(x[s:e], k) for i, x in mine for s, e, k in spans[i]} | {(v, "OTHER_ID") for b, v in listed if b == batch}
        for i, x in mine:
            spans[i] |= {(*m.span(), k) for v, k in values for m in re.finditer(rf"(?<!\w){re.escape(v)}(?!\w)", x, re.IGNORECASE)}
        kept = [(i, *s) for i, _ in mine for s in detect.resolved(list(spans[i]))]
        used = set(itertools.chain(*(re.findall(fixed.TOKEN, x) for _, x in mine)))
        whole, token, last = dict(mine), {}, dict.fromkeys(fixed.KINDS, 0)
        for i, s, e, k in kept:
            if (name := whole[i][s:e].casefold()) not in token:
                last[k] = next(n for n in itertools.count(last[k] + 1) if f"[{fixed.KINDS[k]}_{n:02d}]" not in used)
                token[name] = f"[{fixed.KINDS[k]}_{last[k]:02d}]"
            mapping[batch, whole[i][s:e]] = token[name]
        for i, x in mine:
            out = x
            for d, s, e, _ in reversed(kept):
                if d == i:
                    out = out[:s] + token[x[s:e].casefold()] + out[e:]
            texts[batch, i] = out
    return texts, mapping


def mixed(r, n, batches_=(1, 2, None)):
    words = ["Patient: Alma Berg", "ALMA BERG", "alma berg", "Straße 5", "STRASSE 5", "070-123 45 67", "0701234567", "19500101-1234", "a@b.se", "A@B.SE", "Lindgatan 5", "2024-05-06", "3 maj 2021", "123 45 Lund", "45 årig", "[EMAIL_01]", "[NAME_02]", "[NAME_2]", "x", "Berg", "och", "\n", "??", "Ärende-ID: AB-1234"]
    return [(r.choice(batches_), i, " ".join(r.choice(words) for _ in range(r.randrange(14)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_everything(spark, seed, monkeypatch):
    monkeypatch.setattr(batches, "DOCUMENTS", 4)
    docs = mixed(random.Random(seed), 40) + [(5, 0, None), (5, 1, ""), (6, 0, "Patient: Alma Berg " + "ord " * 30_000 + "alma berg")]
    detected = [(b, i, 0, 1, "ORG") for b, i, x in docs if x and x[0] == "x" and b is not None] + [(1, 10**6, 0, 1, "ORG")]
    listed = [(1, "och"), (2, "??"), (2, "Berg"), (None, "x"), (2, "")]
    table = spark.createDataFrame([(*d, 1, "t") for d in docs], DOC + ", start int, token string").repartition(3)
    done = batches.pseudonymise(table, spark.createDataFrame(detected, "batch_id long, doc_index int, start int, end int, kind string"), spark.createDataFrame(listed, "batch_id long, value string"))
    texts, mapping = expected(docs, detected, [x for x in listed if x[1]])
    assert {(r["batch_id"], r["doc_index"]): r["text"] for r in done.documents.collect()} == texts
    assert {(r["batch_id"], r["surface"]): r["token"] for r in done.mapping.collect()} == mapping
    back = {(r["batch_id"], r["doc_index"]): r["text"] for r in batches.restore(done.documents, done.mapping).collect()}
    for b, i, x in docs:
        if x and "[" not in x:
            assert back[b, i].casefold() == x.casefold()


def test_a_hot_batch(spark):
    """One batch has nearly all documents: no row holds more than one of them, and numbers still go through all."""
    docs = [(1, i, f"Patient: Alma Berg\nkod{i} c{i}@example.invalid, c{i // 2}@EXAMPLE.invalid") for i in range(3000)] + [(2, 0, "c1@example.invalid")]
    table = spark.createDataFrame(docs, DOC).repartition(8)
    spans = batches.spans_of(table)
    assert spans.count() == len(docs) and max(len(r["text"]) for r in spans.select("text").collect()) < 100
    mapping = batches.mapping_of(spans)
    numbers = {r["canonical"]: r["token"] for r in mapping.where("batch_id = 1 AND kind = 'EMAIL'").select("canonical", "token").distinct().collect()}
    assert numbers == {f"c{i}@example.invalid": f"[EMAIL_{i + 1:02d}]" for i in range(3000)}
    assert mapping.where("batch_id = 1 AND kind = 'PERSON'").count() == 1
    assert [r["token"] for r in mapping.where("batch_id = 2").collect()] == ["[EMAIL_01]"]


def test_repeated_and_no_documents(spark):
    docs = [(1, 0, "a@b.se"), (1, 0, "a@b.se"), (1, 0, "c@b.se")]
    done = batches.pseudonymise(spark.createDataFrame(docs, DOC))
    texts = sorted(r["text"] for r in done.documents.collect())
    assert len(texts) == 3 and set(texts) == {"[EMAIL_01]", "[EMAIL_02]"}
    none = batches.pseudonymise(spark.createDataFrame([], DOC))
    assert none.documents.count() == none.mapping.count() == 0


class Meter:
    """Counts calls, and how many are under way."""

    def __init__(self):
        self.lock, self.now, self.most, self.calls = threading.Lock(), 0, 0, 0

    def __enter__(self):
        with self.lock:
            self.now += 1
            self.calls += 1
            self.most = max(self.most, self.now)

    def __exit__(self, *_):
        with self.lock:
            self.now -= 1


def test_calls_keep_their_order_and_bound():
    meter = Meter()

    def call(row):
        with meter:
            time.sleep(0.002 * (row["i"] % 4))
            if row["i"] % 7 == 3:
                raise TimeoutError("late")
            return row["i"] * 2

    taken = []
    rows = ({"i": i} for i in range(60) if not taken.append(i))
    got = []
    for x in calls._in_order(call, rows, 5):
        got.append(x)
        assert len(taken) - len(got) < 5  # no row is taken before there is room for it
    assert got == [(None, "TimeoutError: late") if i % 7 == 3 else (2 * i, None) for i in range(60)]
    assert meter.calls == 60 and meter.most == 5
    with pytest.raises(KeyError):
        list(calls._in_order(lambda row: row["no"], iter([{"i": 1}]), 2))


def counted(tmp_path, name):
    """A function that leaves a line in a file of its own for each call, whatever process it runs in."""
    import uuid

    folder = tmp_path / name
    folder.mkdir()

    def note(value):
        (folder / uuid.uuid4().hex).write_text(value)

    return note, lambda: sorted(p.read_text() for p in folder.iterdir())


def test_ask(spark, tmp_path):
    note, seen = counted(tmp_path, "asked")

    def call(row):
        note(row["x"])
        if row["x"] == "bad":
            raise ValueError("no")
        return {"n": len(row["x"]), "of": [row["x"]]}

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc"), (4, "a")], "id long, x string")
    got = calls.ask(rows, call, "struct<n:int,of:array<string>>", in_flight=2, tasks=1)
    assert [(r["answer"] and r["answer"]["n"], r["error"]) for r in got.orderBy("id").collect()] == [(1, None), (None, "ValueError: no"), (3, None), (1, None)]
    assert got.count() == 4 and got.where("error IS NULL").count() == 3 and seen() == ["a", "a", "bad", "ccc"]
    assert calls.ask(rows.limit(0), call, "struct<n:int,of:array<string>>").count() == 0 and len(seen()) == 4


def test_one_call_for_each_passage_and_batch(spark, tmp_path):
    asked, passages = counted(tmp_path, "passages")
    made, prompts = counted(tmp_path, "prompts")

    def detector(text):
        asked(text)
        if "trasig" in text:
            raise OSError("down")
        return [("PATIENT_MALE", "Erik Exempelsson"), ("ORG", "saknas"), ("NOBODY", "Note")]

    def generator(prompt, units):
        made(prompt)
        if "vägrar" in prompt:
            raise RuntimeError("overloaded")
        return [{"text": "[NAME_PATIENT_MALE_01]: Metformin 500 mg.", "evidence": [units[0]["id"]]}], []

    docs = [(1, i, f"Erik Exempelsson. Metformin 500 mg. Note {i}") for i in range(5)] + [(2, 1, "trasig"), (3, 1, "Erik Exempelsson vägrar")]
    table = progress.ProgressTable(spark, str(tmp_path / "progress"), "job 1")
    out = process.process(spark.createDataFrame(docs, DOC), generator, detector, table, in_flight=3, tasks=2)
    rows = {r["batch_id"]: r for r in out.collect()}
    assert {r["batch_id"]: r for r in out.collect()} == rows  # a second action asks nobody again
    assert passages() == sorted(f"--- Document {i} ---\n{x}" for _, i, x in docs) and len(prompts()) == 3
    one = rows[1]
    assert one["summary"] == "Erik Exempelsson: Metformin 500 mg. [E0001]" and "Erik" not in one["pseudonymised_text"] and one["pseudonymised_text"].count("[NAME_PATIENT_MALE_01]") == 5
    assert (one["passages"], one["fallback_passages"], one["discarded"], one["phi_hits"]) == (5, 0, 10, {"PATIENT_MALE": 5})
    assert (rows[2]["passages"], rows[2]["fallback_passages"], rows[2]["discarded"]) == (1, 1, 0) and "placeholder" in rows[2]["error"]
    seen = {r["stage"]: r["counts"] for r in table.read().where("job = 'job 1'").collect()}
    total = lambda c: sum(r[c] for r in rows.values())
    assert seen == {
        "batches": {"batches": 3, "documents": 7, "failed": 0}, "suggestions": {"asked": total("passages"), "failed": total("fallback_passages")},
        "pseudonymised": {"documents": 7, "hits": sum(sum(r["phi_hits"].values()) for r in rows.values())}, "summaries": {"asked": 3, "failed": 1},
    }
    assert rows[3]["error"] == "RuntimeError: overloaded" and rows[3]["summary"] is None
    assert files.joined_parts(files.document_parts(spark.createDataFrame(docs, DOC))).where("batch_id = 1").first()["text"].count("--- Document") == 5


def test_progress_of_a_stream(spark, tmp_path):
    """Counts are there while the query runs: each micro-batch waits until those before it can be read."""
    from pyspark.sql import functions as F

    for i in range(3):
        spark.createDataFrame([(i, k, "x" * i) for k in range(4 + i)], DOC).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = progress.ProgressTable(spark, str(tmp_path / "progress"), "stream")
    listener, read = progress.StreamProgress(table, "documents"), []
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("read", F.count(F.lit(1)).alias("documents"))

        def see(batch, epoch):
            batch.count()
            until = time.time() + 60
            while epoch and time.time() < until and (done := table.read().where("stage = 'read'")).count() < epoch:
                time.sleep(0.2)
            read.append([] if not epoch else sorted(r["counts"]["batch"] for r in done.collect()))

        query = rows.writeStream.queryName("documents").foreachBatch(see).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        until = time.time() + 60
        while table.read().where("stage = 'read'").count() < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert read == [[], [0], [0, 1]]
    assert sum(r["counts"]["documents"] for r in table.read().where("stage = 'read'").collect()) in (15, 30) and table.read().where("stage = 'started'").count() == 1


def test_summaries_in_rounds(spark, tmp_path):
    """Each batch is asked for until it is done and no more, with the context and output budget that its outcomes call for."""
    from pyspark.sql import functions as F

    from quillstone.plans import summarise

    note, seen = counted(tmp_path, "requests")
    good = '{"sentences": [{"text": "Dos 5 mg", "evidence": ["E0001"]}], "uncertainties": []}'

    def model(r):
        note(f"{r['batch_id']} {r['attempt']} {r['num_ctx']} {r['num_predict']} {r['prompt'][-2:]}")
        if r["batch_id"] == 1:
            return {"response": good}
        if r["batch_id"] == 2:
            return {"response": good, "done_reason": "length", "prompt_eval_count": 9000} if r["num_predict"] < 8192 else {"response": good}
        if r["batch_id"] == 3:
            return {"response": "{", "prompt_eval_count": True}
        if r["batch_id"] == 4:
            raise RuntimeError("the prompt exceeds the context" if r["attempt"] < 5 else "never")
        if r["batch_id"] == 5:
            raise OSError("down")
        return {"response": good.replace("E0001", "E0009")} if not r["attempt"] else {"response": good}

    prompts = spark.createDataFrame([(i, "p" * (50_000 if i == 6 else 9)) for i in range(1, 7)], "batch_id long, prompt string").withColumn("known", F.array(F.lit("E0001")))
    out = summarise.summaries(prompts, model, F.array(*map(F.lit, (8192, 16384, 24576, 32768))), shorter=" s", repair=" r")
    rows = {r["batch_id"]: r for r in out.collect()}
    tried = {b: [(a["num_ctx"], a["num_predict"], a["outcome"]) for a in r["attempts"]] for b, r in rows.items()}
    assert tried == {
        1: [(8192, 4096, "complete")], 2: [(8192, 4096, "incomplete"), (24576, 8192, "complete")], 3: [(8192, 4096, "invalid_format")] * 2,
        4: [(c, 4096, "context_overflow") for c in (8192, 16384, 24576, 32768)], 5: [(8192, 4096, "failed")], 6: [(24576, 4096, "invalid_format"), (24576, 4096, "complete")],
    }
    assert {b: r["error"] for b, r in rows.items()} == {1: None, 2: None, 3: "invalid JSON", 4: fixed.DOES_NOT_FIT, 5: "OSError: down", 6: None}
    assert rows[1]["words"] == 3 and rows[6]["sentences"][0]["evidence"] == ["E0001"] and rows[3]["sentences"] is None
    asked = seen()
    assert len(asked) == sum(map(len, tried.values())) and "2 1 24576 8192  s" in asked and "3 1 8192 4096  r" in asked and "6 1 24576 4096  r" in asked
    assert summarise.summaries(prompts.limit(0), model, F.array(F.lit(8192))).count() == 0 and seen() == asked


def test_runtimes_are_probed_once(spark, tmp_path):
    from quillstone.plans import summarise

    note, seen = counted(tmp_path, "probes")

    def probe(model):
        note(model)
        if model == "down":
            raise TimeoutError("late")
        return {"good": {"version": "0.32.1", "context": 8192}, "old": {"version": "0.31.9", "context": 8192}, "odd": {"version": "1.0.0", "context": True}, "small": {"version": "1.0.0", "context": 4095}}[model]

    models = spark.createDataFrame([(m,) for m in ("good", "good", "old", "odd", "small", "down", None)], "model string")
    got = {r["model"]: (r["model_context"], r["error"]) for r in summarise.check_runtimes(models, probe).collect()}
    assert got == {"good": (8192, None), "old": (8192, fixed.RUNTIME_TOO_OLD), "odd": (None, fixed.NO_CONTEXT), "small": (None, fixed.NO_CONTEXT), "down": (None, "TimeoutError: late")}
    assert seen() == ["down", "good", "odd", "old", "small"]


_FRAGMENTS = ["Patient", "PATIENT", "namn", " ", "  ", "\t", "\n", "-", ":", "#", "1", "19", "20", "0", "12", "2001", "01", "/", ".", "Lind", "gatan", "vägen", "VÄGEN", "A", "Åsa", "anna", "Bo", "ÅR", "årig", "år gammal", "års ålder", "@", "a.b", ".se", "+46", "(0)",
    "1234567", "6", "123 45", "Stad", "postnummer", "postnr", "Journal-id", "ÄRENDEID", "ß", "µ", "ſ", "İ", "\u212a", "maj", "januari", "\u0663", "x", "_", "é", "dr", "torget", "500101-0000", "J0001", "+"]


def test_rules_run_where_their_anchors_stand_find_what_rules_find():
    import random
    import re

    from quillstone.functions import fixed
    from quillstone.operators import detect

    r, rules = random.Random(7), [(kind, re.compile(detect._python(pattern)), group) for kind, pattern, group in fixed.RULES]
    for _ in range(20_000):
        text = "".join(r.choice(_FRAGMENTS) for _ in range(r.randrange(1, 14)))
        assert detect.by_rules(text) == [(*m.span(group), kind) for kind, rule, group in rules for m in rule.finditer(text)], text
        assert detect.coarse(text) == text.translate(detect._coarse), text


def test_rules_are_tried_at_their_anchors_alone():
    """A street's rule took every character of a text that has one street; now only the stretch before it is read."""
    from quillstone.operators import detect

    find, tried = dict((kind, f) for kind, f, _ in detect._FINDERS)["ADDRESS"], []

    class Rule:
        def search(self, text, at):
            tried.append(at)

    assert len(list(find("ord, " * 1000 + "Lindgatan 1", ""))) == 1
    list(detect._around_words(Rule(), ("gatan",))("ord, " * 1000 + "Lindgatan", ""))
    assert tried == [4999]


def test_batches_held_by_a_task_and_spread_ones_agree(spark, monkeypatch):
    """The same batches both ways, some with tokens in use, null ids, null texts, repeated and empty documents, detected and listed values."""
    note = "Patient: Alma Vinterlund, c{0}@example.invalid, 0{0}0-1234567, ALMA VINTERLUND {1} ål"
    docs = [(b, d, note.format(b, "[EMAIL_01] [EMAIL_001] [NAME_02]" if d == 2 else "")) for b in range(1, 7) for d in range(1, 5)]
    docs += [(None, 1, "x@example.invalid"), (None, None, "X@example.invalid y@example.invalid"), (7, 1, None), (7, 2, ""), (8, 1, "a@b.se")]
    table = spark.createDataFrame(docs, DOC)
    detected = spark.createDataFrame([(1, 1, 0, 7, "ORG"), (1, 2, 5, 900, "ORG"), (None, 1, 0, 1, "PERSON")], "batch_id long, doc_index int, start int, end int, kind string")
    listed = spark.createDataFrame([(2, "Ål"), (7, "nothing"), (3, "")], "batch_id long, value string")

    def run():
        done = batches.pseudonymise(table, detected, listed)
        rows = lambda df: sorted(map(repr, df.collect()))
        return rows(done.documents), rows(done.mapping), rows(batches.mapping(table, detected, listed)), rows(batches.restore(done.documents, done.mapping)), done

    *held, done = run()
    assert "Exchange" not in done.documents._jdf.queryExecution().executedPlan().toString()
    for rows, chars in ((0, 1 << 20), (1024, 60)):
        monkeypatch.setattr(batches, "HELD_ROWS", rows)
        monkeypatch.setattr(batches, "HELD_CHARS", chars)
        assert run()[:4] == tuple(held)


def test_prompts_that_compress_well_are_joined_in_parts_of_their_full_size(spark, monkeypatch):
    """An adaptive plan gathers partitions by compressed size."""
    from pyspark.sql import functions as F

    from quillstone.plans import summarise

    joined, join = [], summarise._with_prompts
    monkeypatch.setattr(summarise, "PART_BYTES", 30_000)

    def spy(state, texts, parts):
        out = join(state, texts, parts)
        joined.append((parts, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(summarise, "_with_prompts", spy)
    prompts = spark.createDataFrame([(i, "p" * 3000, ["E0001"]) for i in range(100)], "batch_id long, prompt string, known array<string>")
    out = summarise.summaries(prompts, lambda request: {"response": "{" if request["attempt"] == 0 else "["}, F.array(F.lit(8192)))
    assert out.count() == 100 and joined == [(10, 10)]
