"""Invariants and hand-made cases of the operators."""

import io
import json
import re
import time
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone import queries
from quillstone.functions import fixed
from quillstone.functions import text as t
from quillstone.operators import codebook, evidence, images, planning, pseudonym, readings
from quillstone.operators import spans as sp
from quillstone.operators.detect import find_spans
from quillstone.plans import process, records
from quillstone.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_rules_keep_clinical_values(spark):
    note = "Patient: Alma Vinterlund 19500101-1234, tel 070-123 45 67, alma@example.invalid, 2024-05-06.\nAlvedon 500 mg, CRP <5, ej feber, 45 årig."
    spans = one(spark, sp.resolve(sp.rule_spans(F.col("text"))), text=note)
    assert [(s["kind"], note[s["start"] : s["end"]]) for s in spans] == [
        ("PERSON", "Alma Vinterlund"), ("PERSONNUMMER", "19500101-1234"), ("PHONE", "070-123 45 67"), ("EMAIL", "alma@example.invalid"), ("DATE", "2024-05-06"), ("AGE", "45 årig"),
    ]


def test_more_rules(spark):
    note = "Ärende-ID: AB-123 postnr 123 45, 543 21 Lund, Stora Nygatan 5B, 3 maj 2021, 7 års ålder, +46 (0)70 123 45 67"
    spans = one(spark, sp.resolve(sp.rule_spans(F.col("text"))), text=note)
    assert [(s["kind"], note[s["start"] : s["end"]]) for s in spans] == [
        ("RECORD_ID", "AB-123"), ("POSTAL_CODE", "123 45"), ("POSTAL_CODE", "543 21"), ("ADDRESS", "Stora Nygatan 5B"), ("DATE", "3 maj 2021"), ("AGE", "7 års ålder"), ("PHONE", "+46 (0)70 123 45 67"),
    ]


def test_priority_beats_length_and_earlier_wins(spark):
    rows = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("kind")) for a, b, k in ((0, 20, "ORG"), (5, 8, "EMAIL"), (8, 12, "PERSON"), (10, 14, "PERSON"))))
    assert [(s["start"], s["end"]) for s in one(spark, sp.resolve(rows))] == [(5, 8), (8, 12)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["Patient: Alma Berg", "ALMA BERG", "070-123 45 67", "19500101-1234", "a@b.se", "Lindgatan 5", " ", "\n", "x", "alma berg,", "45 årig", "2024-05-06", "123 45 Lund"]), max_size=12))
def test_arrow_and_column_spans_agree(spark, parts):
    rows = spark.createDataFrame([(" ".join(parts), ["Berg", "x"])], "text string, extra array<string>")
    both = F.concat(sp.rule_spans(F.col("text")), sp.additional_spans(F.col("text"), F.col("extra")))
    a, b = rows.select(sp.resolve(sp.propagate(F.col("text"), both)), find_spans(F.col("text"), F.col("extra"), propagate=True)).first()
    assert a == b


def test_occurrences_are_words_in_any_case(spark):
    spans = one(spark, t.occurrences(F.col("text"), F.lit("Anna Berg"), "PERSON"), text="ANNA BERG, Annaberg, xanna berg, anna berg")
    assert [(s["start"], s["end"]) for s in spans] == [(0, 9), (33, 42)]


def test_valid_identity(spark):
    assert [one(spark, t.valid_identity(F.lit(x))) for x in ("811218-9876", "811218-9875", "811278-9873", "811318-9876", "81")] == [True, False, True, False, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n.", max_size=60), min_size=1, max_size=8))
def test_chunks_and_units_lose_nothing(spark, parts):
    text = "".join(p * 97 for p in parts)
    got = spark.createDataFrame([(1, text)], "batch_id long, text string")
    chunks = got.select(sp.chunks(F.col("text")).alias("c")).first()["c"]
    assert "".join(c["text"] for c in chunks) == text and all(len(c["text"]) <= 3500 and text[c["start"] :].startswith(c["text"]) for c in chunks)
    units = evidence.evidence_units(got).orderBy("unit_no").collect()
    assert "".join("".join(u["text"].split()) for u in units) == "".join(text.split())
    assert all(0 < len(u["text"]) <= 1800 for u in units)


def test_units_carry_their_document(spark):
    text = "first\n\n--- Document 2 ---\nsecond\n\nthird"
    rows = evidence.evidence_units(spark.createDataFrame([(1, text)], "batch_id long, text string")).orderBy("unit_no").collect()
    assert [(r["id"], r["document"]) for r in rows] == [("E0001", "Document 1"), ("E0002", "Document 2"), ("E0003", "Document 2")]


def test_strip_takes_white_space_of_any_alphabet_at_the_ends_alone(spark):
    """In a time that grows with the text: the search for a run of white space at the end went over each run once for each of its characters."""
    inner, began = "a" + " " * 200_000 + "b", time.monotonic()
    odd = "\x00\x1c\u180e\u200b\ufeff"  # no white space to Java
    texts = ["", " ", t.WHITE, f"{t.WHITE}å{t.WHITE}", odd, f" {odd}\n", inner, f"\u3000{inner}\x85"]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, text string").select("i", t.strip(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in sorted(rows)] == ["", "", "", "å", odd, odd, inner, inner, None] and time.monotonic() - began < 20


def test_exports_need_no_window(spark):
    plan = queries.QUERIES["export_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "aggregate(" not in plan


def test_exported_units_stay_in_their_batch(spark):
    """The texts meet in one shuffle and are cut once; units were made rows and shuffled again to meet in the batch that they came from."""
    plan = queries.QUERIES["export_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange hashpartitioning"), plan.count("ArrowEvalPython"), plan.count("Generate")) == (1, 1, 0)
    long = "ord. " * 900
    texts = [None, "", t.WHITE, "\x1c", "\x00", f"{t.WHITE}å", "--- Document 4 ---", f"{long}\n\n--- Document 12 ---\n{long}\n \u2003\nslut", "å" * 5401, "a\n\n" * 10_001]
    batches = spark.createDataFrame([*enumerate(texts), (None, "x\n\ny")], "batch_id long, text string")
    want, got = {}, evidence.batch_units(batches).collect()
    for r in evidence.evidence_units(batches).orderBy("unit_no").collect():
        want.setdefault(r["batch_id"], []).append(tuple(r)[1:])
    assert {r["batch_id"]: list(map(tuple, r["units"])) for r in got} == want and len(got) == len(want) == 8
    assert want[9][-1] == (10_001, "E10001", "Document 1", "a") and {u[2] for u in want[7]} == {"Document 1", "Document 12"}


def test_prompts_of_batches_stay_in_their_row(spark):
    plan = queries.QUERIES["user_prompts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange hashpartitioning"), plan.count("ArrowEvalPython"), plan.count("Generate")) == (1, 1, 0)
    batches = spark.createDataFrame([(1, "a\n\n" * 10_001), (2, None), (3, t.WHITE), (4, "--- Document 2 ---\n" + "å. " * 3000), (None, "x")], "batch_id long, text string")
    got = sorted(map(str, evidence.batch_prompts(batches).collect()))
    assert got == sorted(map(str, evidence.user_prompts(evidence.evidence_units(batches)).collect())) and len(got) == 3


def test_a_batch_is_cut_in_one_walk_in_its_row(spark):
    """No shuffle, no window and no copy of the rest for each piece, which took a time that grew with the square of a block's length."""
    text = "--- Document 3 ---\n" + "ord och ord. " * 150_000 + "\n \u2003\n" + "å" * 4000 + "\n" + " " * 2000 + "\n\u3000slut"
    got = evidence.evidence_units(spark.createDataFrame([(1, text), (2, None), (3, " \n\n\x0b "), (None, "x")], "batch_id long, text string"))
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Window"))
    rows = got.collect()
    units = [r["text"] for r in sorted((r for r in rows if r["batch_id"] == 1), key=lambda r: r["unit_no"])]
    assert units[-4:] == ["å" * 1800, "å" * 1800, "å" * 400, "slut"] and "".join("".join(units).split()) == "".join(text.split())
    assert all(u.endswith("ord.") and 1786 < len(u) <= 1800 for u in units[:100]) and {r["document"] for r in rows if r["batch_id"] == 1} == {"Document 3"}
    assert [tuple(r) for r in rows if r["batch_id"] != 1] == [(None, 1, "E0001", "Document 1", "x")]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["ord och ord. ", "x" * 700, "\n\n", "\n \n", "--- Document 7 ---\n", "\n\n--- Document 3 ---\nrad", " ", "slut.\n"]), max_size=9).map("".join), min_size=1, max_size=7))
def test_units_of_documents_are_those_of_the_batch(spark, texts):
    docs = spark.createDataFrame([(b, i, x) for b in (1, None) for i, x in enumerate(texts)] + [(5, 0, None)], "batch_id long, doc_index int, text string")
    parts, size = files.document_parts(docs), evidence.DOCUMENTS
    evidence.DOCUMENTS = 2
    try:
        got = sorted(map(str, evidence.document_units(parts).collect()))
    finally:
        evidence.DOCUMENTS = size
    assert got == sorted(map(str, evidence.evidence_units(files.joined_parts(parts)).collect()))


def test_pseudonymise_is_consistent_and_reversible(spark):
    text = "Patient: Alma Vinterlund. alma vinterlund mår bra. ALMA@example.invalid och alma@example.invalid, [EMAIL_01], Almaq."
    row = pseudonym.pseudonymise(spark.createDataFrame([(7, text)], "batch_id long, text string")).first()
    assert row["text"] == "Patient: [NAME_01]. [NAME_01] mår bra. [EMAIL_02] och [EMAIL_02], [EMAIL_01], Almaq."
    assert row["phi_hits"] == {"EMAIL": 2, "PERSON": 2} and row["residual_flags"] == {}


def test_restore_and_apply_in_one_pass(spark):
    mapping = F.array(*(F.struct(F.lit(s).alias("surface"), F.lit(k).alias("token"), F.lit("ORG").alias("kind")) for s, k in (("Berg", "Sten"), ("Sten Berg", "X"), ("Sten", "Berg"))))
    assert one(spark, pseudonym.apply_mapping(F.lit("Berg Sten Berg Stenen"), mapping)) == "Sten X Stenen"
    tokens = F.array(F.struct(F.lit("a [NAME_02]").alias("surface"), F.lit("[NAME_01]").alias("token"), F.lit("PERSON").alias("kind")))
    assert one(spark, pseudonym.restore(F.lit("[NAME_01] [NAME_02]"), tokens)) == "a [NAME_02] [NAME_02]"
    key = F.lit(b"0123456789abcdef")
    assert one(spark, pseudonym.unseal(pseudonym.seal(tokens, key), key))[0]["token"] == "[NAME_01]"


def test_response_rules():
    known = {f"E{i:04d}" for i in range(1, 10)}
    ok = lambda n, notes=(), text="ok": evidence.check_response(json.dumps({"sentences": [{"text": text, "evidence": sorted(known)[:n]}], "uncertainties": list(notes)}), known)[0]
    assert ok(8) is None and ok(9) and ok(1, ["x"] * 9) and ok(1, ["x" * 401]) and ok(1, [" "]) and ok(0) and ok(1, text="x" * 1201)
    assert ok(1, ["x" * 400] * 8) is None


def test_context_plans(spark):
    plan = lambda n, limit: one(spark, planning.context_plan(F.lit(n), F.lit(limit), F.lit(262144)))
    assert plan(5000, 131072)[0] == 8192 and plan(70000, 131072) == [98304, 131072] and plan(5000, 60000)[-1] == 60000 and plan(90000, 60000) == [60000]
    with pytest.raises(ValueError):
        planning.configured_limit("100")


def test_critical_tokens_and_disagreement(spark):
    assert one(spark, t.critical_tokens(F.lit("< 5 mg, -4,2 EJ 3/4"))) == ["<5mg", "-4,2", "ej", "3/4"]
    assert one(spark, readings.disagreement(F.lit("CRP <5"), F.lit("CRP >5"), F.lit("CRP >5")))
    assert one(spark, readings.disagreement(F.lit("CRP 5"), F.lit("crp 5"), F.lit("crp 5"))) == []


def _numbers(text):
    text, out, i = re.sub(r"\[[A-Z_0-9]+\]", "", text), [], 0
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    run = lambda k: next((j for j in range(k, len(text)) if not text[j].isdecimal()), len(text))
    while i < len(text):
        end = 0
        if text[i].isdecimal() and not word(i - 1):
            whole = run(i)
            part = run(whole + 1) if text[whole : whole + 1] in tuple(".,") else whole
            end = next((e for e in ((part,) if part > whole + 1 else ()) + (whole,) if not word(e)), 0)
        if end:
            out.append(text[i:end])
        i = end or i + 1
    return out


def test_numbers_of_whole_documents(spark, tmp_path):
    texts = ["Hb 4,2 och 3.14, 12 mg", "x5 5x ä7 _8 9_ 1,2mg 1.2.3 7, 8.", "[NAME_01] 1234567890123 [EMAIL_02]3", "inga tal", "", "5", "1-2/3 (4) 5%", "٣٤ 2024-05-06"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["number_tokens"](spark, str(tmp_path)).select("doc_id", "n", "number").collect())
    want = [(d, n, x) for d, text in enumerate(texts) for n, x in enumerate(_numbers(text))]
    assert got == want and (0, 0, "4,2") in got and (1, 0, "1") in got


def test_readers_of_all_turns(spark, tmp_path):
    texts = ["CRP <5 mg, ej feber", "inte 4,2", "jej ninte utanför", "Utan 12 mmol/l och 3/4", "nekar  smärta", "vanlig text", "7", "5 mg 5 mg inga", "åäö ÅÄÖ"]
    turns = [(c, k, x) for c, x in enumerate(texts) for k in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    critical = re.compile(fixed.CRITICAL.replace("(?iuU)", "(?i)"))
    tokens = lambda x: sorted(re.sub(r"\s+", "", m.lower()) for m in critical.findall(x))
    want = []
    for c, k, x in turns:
        y = (x, x + " <5 mg", x[::-1], x[: int(len(x) / 2 + 0.5)])[k]
        differ = fixed.READERS_DIFFER_CRITICAL if tokens(x) != tokens(y) else fixed.READERS_DIFFER_WORDS if re.findall(r"\w+", x.lower()) != re.findall(r"\w+", y.lower()) else None
        want.append((c, k, differ, len(y) < len(x) * 0.65))
    got = queries.QUERIES["reader_disagreement"](spark, str(tmp_path)).select("conv_id", "turn", "warning", "short").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len({w[2] for w in want}) == 3


def _line(text, x0, y0, x1, y1):
    return {"text": text, "box": [x0, y0, x1, y1]}


def test_layouts_of_a_table_of_pages_make_no_arrays(spark):
    """Pages of a table as one by one, without pages too; a page of a few lines took a dozen arrays."""
    import numpy as np

    box = lambda x, y: [float(x), float(y), x + 40.0, y + 10.0]
    pages = [(1, [("b", box(90, 2)), ("a", box(0, 0)), ("c", box(0, 30))]), (2, []), (3, [("x", box(5, 5))]), (4, [(str(i), box(i % 2 * 200, i // 2 * 20)) for i in range(8)])]
    got = readings.page_layouts(spark.createDataFrame(pages, "page_id long, lines array<struct<text:string,box:array<double>>>"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {1: "a\tb\nc", 2: "", 3: "x", 4: "0\t1\n2\t3\n4\t5\n6\t7"}
    assert not any(isinstance(x, np.ndarray) for x in readings._columns([(0.0, 0.0, 1.0, 1.0)])) and "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_layouts():
    prose = [_line("vwx"[i], 0, 10 * i, 40, 10 * i + 8) for i in range(3)] + [_line("hij"[i], 60, 10 * i, 100, 10 * i + 8) for i in range(3)]
    assert readings.layout(prose) == "v\nw\nx\nh\ni\nj"
    table = [_line("Analys", 0, 0, 20, 8), _line("Resultat", 60, 0, 80, 8), _line("4,2", 60, 11, 70, 19), _line("Hb", 0, 10, 10, 18)]
    assert readings.layout(table) == "Analys\tResultat\nHb\t4,2"
    assert readings.layout([]) == ""


def test_lines_keep_tied_words_apart(spark):
    """Words of equal place and text: one is first and follows the gap, the others a space, however rows are dealt."""
    lines = {0: [(0, "Hb"), (0, "Hb")], 1: [(0, "--"), (0, "--"), (200, "--")], 2: [(0, "5"), (300, "--"), (300, "--"), (300, "--"), (345, "värde"), (345, "värde")]}
    want = ["Hb Hb", "-- --\t--", "5\t-- -- -- värde värde"]
    rows = [(page, n, 1 - k // 9, text, 60.0 + k, x, 0, x + 40, 10) for page in range(200) for n, words in lines.items() for k, (x, text) in enumerate(words)]
    for parts, seed in ((1, 1), (7, 2)):
        dealt = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
        words = spark.createDataFrame(dealt, "page_id long, line_num int, word_num int, text string, confidence double, x0 int, y0 int, x1 int, y1 int").repartition(parts)
        got = readings.lines_of(words, ["page_id"], ["line_num"]).collect()
        assert len(got) == 600 and all((r["text"], r["confidence"]) == (want[r["line_num"]], 60 + (len(lines[r["line_num"]]) - 1) / 2) for r in got)


def test_words_of_one_place_keep_the_readers_order(spark):
    words = [(1, 0, 3, "a", 1.0, 5, 0, 9, 1), (1, 0, 1, "z", 1.0, 5, 0, 9, 1), (1, 0, 2, "m", 1.0, 5, 0, 9, 1), (1, 0, 0, "last", 1.0, 6, 0, 9, 1)]
    rows = spark.createDataFrame(words, "page_id long, line_num int, word_num int, text string, confidence double, x0 int, y0 int, x1 int, y1 int")
    assert readings.lines_of(rows, ["page_id"], ["line_num"]).first()["text"] == "z m a last"


def test_codebooks_do_not_chain(spark):
    books = spark.createDataFrame([("1", 1, "Mölnby", "Stockby Gård", "ORG"), ("1", 2, "Hönby", "Mölnby", "LOC"), ("2", 3, "Ö", "Annan Stor Gård", "ORG")], "book_id string, ord long, real string, fake string, type string")
    texts = spark.createDataFrame([(1, "Stockby Gård Stockby Gård", "Stockby Gård i Mölnby, Mölnbyn"), (2, "inget", "Mölnby")], "text_id long, text string, summary string")
    rows = {r["text_id"]: r["text"] for r in codebook.deanonymise(texts, codebook.drop_ambiguous(books)).collect()}
    assert rows == {1: "Mölnby i Hönby, Mölnbyn", 2: "Mölnby"}


def test_restoration_with_partial_names(spark):
    pairs = [("1", 1, "Alma Vinterlund", "Fia Sommarlund", "PER"), ("1", 2, "Doktor Sten Berg", "Ola Ek Holm", "PER"), ("1", 3, "Berg Vård", "Annan Stor Gård", "ORG"), ("1", 4, "Eva Ask", "Fia Lind", "PER")]
    books = spark.createDataFrame(pairs, "book_id string, ord long, real string, fake string, type string")
    text = "Fia Sommarlund, Annan Stor Gård. Sommarlund, Fia, Ola, Holm, Lind, Linda; Fia Sommarlund."
    rows = codebook.deanonymise(spark.createDataFrame([(1, text, text)], "text_id long, text string, summary string"), books).collect()
    # Fia stands for two names; Ola for a title or Doktor; Holm for a word of the organisation.
    known = {"Fia Sommarlund": "Alma Vinterlund", "Annan Stor Gård": "Berg Vård", "Sommarlund": "Vinterlund", "Lind": "Ask"} | ({} if "doktor" in fixed.TITLES else {"Ola": "Doktor"})
    want = re.sub(r"\b(?:" + "|".join(sorted(known, key=len, reverse=True)) + r")\b", lambda m: known[m[0]], text)
    assert {r["text"] for r in rows} == {want} and "Vinterlund, Fia" in want
    assert {r["fake"]: (r["real"], r["count"]) for r in rows} == {f: (v, len(re.findall(r"\b" + f + r"\b", re.sub("Fia Sommarlund", "", text) if f == "Sommarlund" else text))) for f, v in known.items()}


def _docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    cell = lambda *x: "<w:tc>" + "".join(map(p, x)) + "</w:tc>"
    (tmp_path / "a.docx").write_bytes(_docx(p("Hej") + p("") + "<w:tbl><w:tr>" + cell("Hb") + cell("") + cell("a", "b") + "</w:tr><w:tr>" + cell("1") + "</w:tr></w:tbl>"))
    (tmp_path / "b.txt").write_bytes("åäö".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes("åäö".encode("utf-16"))
    (tmp_path / "d.json").write_text(json.dumps({"full_text": " ", "pages": [{"text": "x"}, {"text": " "}, {"text": "z"}]}))
    (tmp_path / "e.json").write_text(json.dumps({"pages": [{"text": 1}]}))
    (tmp_path / "f.xyz").write_text("?")
    rows = {r["path"][-5:]: (r["text"], r["error"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.docx"[-5:]][0] == "Hej\n\nHb\t\ta / b\n1" and rows["b.txt"][0] == rows["c.txt"][0] == "åäö"
    assert rows[".json"] and all(rows[k][1] for k in ("f.xyz",))
    assert files.decode_json((tmp_path / "d.json").read_bytes()) == "--- Sida 1 ---\n\nx\n\n--- Sida 3 ---\n\nz"


def first_words():
    """A generator that quotes the beginnings of units; made here, so that workers get it by value."""
    return lambda prompt, units: ([{"text": " ".join(u["text"].split()[:12]), "evidence": [u["id"]]} for u in units[:8]], [])


def test_whole_job(spark):
    docs = spark.createDataFrame([(1, 1, "Patient: Alma Vinterlund, a@example.invalid"), (1, 2, "Alma Vinterlund åter."), (2, 1, " ")], "batch_id long, doc_index int, text string")
    rows = {r["batch_id"]: r for r in process.process(docs, first_words(), detector=lambda text: [("ORG", "åter")] if "åter" in text else None).collect()}
    assert rows[2]["error"] and "Alma" in rows[1]["summary"] and "Alma" not in rows[1]["pseudonymised_text"] and "[ORGANISATION_01]" in rows[1]["pseudonymised_text"]
    changed = process.process(docs.where("batch_id = 1"), generator=lambda prompt, units: ([{"text": "[NAME_09]", "evidence": ["E0001"]}], [])).first()
    assert "placeholder" in changed["error"] and changed["summary"] is None


def test_records(spark):
    rows = spark.createDataFrame([("a", "s", ["q"], ["w"])], "id string, summary string, uncertainties array<string>, warnings array<string>")
    body = records.export_parts(rows, "summary").first()
    assert body["body"] == "s\n\nUnresolved questions\nq\n\nTranscription review notes\nw"
    assert one(spark, records.render(F.lit("T"), F.lit("a\x01b"), "txt")) == "T\n\nab\n"
    assert one(spark, records.derive_name(F.array(F.lit("x.pdf"), F.lit("y.txt")), F.lit(""))) == "x + 1 documents"
    named = spark.createDataFrame([("a", "old"), ("b", None)], "id string, name string")
    assert [r["name"] for r in records.rename_record(named, "a", " new ").orderBy("id").collect()] == ["new", "Untitled"]
    assert records.delete_record(named, "a").count() == 1


def test_stream(spark, tmp_path):
    from quillstone.streaming import ingest

    docs = spark.createDataFrame([(1, 1, "Patient: Alma Vinterlund")], ingest.DOCUMENTS)
    docs.write.parquet(str(tmp_path / "in"))
    ingest.start(ingest.stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), lambda rows: process.process(rows, first_words())).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_export_files(spark):
    from quillstone.plans import exports

    rows = spark.createDataFrame([("a", "One (1)\n\nTwo åäö \\ " + "lång rad " * 400, ["q"], ["w"], True, [("E1", "Document 1", "x\x01")], "p"), ("b", "", [], [], False, [], "")], "id string, summary string, uncertainties array<string>, warnings array<string>, implemented boolean, units array<struct<id:string,document:string,text:string>>, pseudonymised_text string")
    for form in exports.FORMATS:
        got = {r["id"]: r for r in exports.export_files(rows, "both", form).collect()}
        assert got["b"]["error"] and got["b"]["content"] is None and got["a"]["filename"] == "documents.zip"
        with zipfile.ZipFile(io.BytesIO(got["a"]["content"])) as z:
            assert len(z.namelist()) == 2
            one_file = z.read(z.namelist()[0])
        alone = exports.export_files(rows, "summary", form).where("id = 'a'").first()
        assert bytes(alone["content"]) == one_file and alone["media_type"] == exports.FORMATS[form][0]
        if form == "docx":
            text = files.decode_docx(one_file)
            assert text.startswith("Clinical summary\n\nOne (1)\n\nTwo åäö \\ lång rad") and text.endswith("Unresolved questions\nq\n\nTranscription review notes\nw")
        if form == "pdf":
            streams = [zlib.decompress(x) for x in re.findall(rb"stream\n(.*?)\nendstream", one_file, re.S)]
            shown = b" ".join(x.replace(b"\\(", b"(").replace(b"\\)", b")").replace(b"\\\\", b"\\") for s in streams for x in re.findall(rb"\((.*)\) Tj", s)).decode("cp1252")
            assert len(streams) > 1 and "One (1)" in shown and shown.count("lång") == 400 and one_file.startswith(b"%PDF")
            assert all(one_file[int(p) :].startswith(b"%d 0 obj" % i) for i, p in enumerate(re.findall(rb"(\d{10}) 00000 n", one_file), 1))


def lined(turn, h=300, w=240):
    y, x = np.mgrid[:h, :w]
    a = np.deg2rad(turn)
    return np.where((np.rint((y - h / 2) * np.cos(a) + (x - w / 2) * np.sin(a)) % 20 < 2) & (np.abs(y - h / 2) < h * 0.45), 10, 250).astype(np.uint8)


def turns_one_by_one(grey):
    """The skew by turning each point of ink, for each turn alone."""
    small = images.shrunk(grey, fixed.SKEW_PIXELS)
    y, x = np.nonzero(small < 128)
    y, x = y - small.shape[0] / 2, x - small.shape[1] / 2

    def score(degrees):
        row = np.rint(y * np.cos(np.deg2rad(degrees)) + x * np.sin(np.deg2rad(degrees))).astype(int)
        return float(np.square(np.diff(np.bincount(row + 3 * sum(small.shape)))).sum())

    return max((d / 5 for d in range(-28, 29)), key=score)


def test_skew_and_blank_pages():
    page = np.full((300, 240), 250, np.uint8)
    assert images.prepared(page)[1:4] == (True, False, 0.0)
    for turn in (-4.6, -3, -0.6, 0, 2, 4.8):
        got = images.skew(lined(turn))
        assert abs(got - turn) <= 0.4 and (abs(turn) < 1 or abs(got - turns_one_by_one(lined(turn))) <= 0.4)
        straight, *_ = images.prepared(lined(turn))
        assert abs(images.skew(straight)) <= 0.6
    assert images.skew(np.zeros((50, 50), np.uint8)) == 0
    side = np.rot90(lined(0), -1)  # a quarter clockwise
    assert np.array_equal(images.prepared(side, lambda grey: (90, 4.0))[0], lined(0)) and images.prepared(side, lambda grey: (90, 3.9))[0].shape == side.shape
    assert images.prepared(side, lambda grey: int("none"))[0].shape == side.shape


def test_pages_are_prepared(spark):
    wide = np.full((40, 5000), 250, np.uint8)
    wide[::10] = 5
    pages = {1: lined(0), 2: 255 - lined(0), 3: lined(3), 4: np.full((9, 7), 255, np.uint8), 5: np.full((9, 7), 3, np.uint8), 6: wide, 7: np.full((1, 1), 9, np.uint8)}
    rows = [(i, p.shape[1], p.shape[0], p.tobytes(), "x") for i, p in pages.items()]
    rows += [(8, 0, 0, b"", "x"), (9, 3, 3, b"12", "x"), (10, None, 3, b"123", "x"), (11, 3, 1, None, "x"), (12, 100_000, 100_000, b"", "x"), (1, 1, 1, b"z", "x")]
    df = spark.createDataFrame(rows, "page_id long, width int, height int, grey binary, blank string").repartition(3)
    out = images.prepare(df).collect()
    got = {r["page_id"]: r for r in out if r["page_id"] != 1 or r["width"] > 1}
    assert len(out) == len(rows)
    assert {i: (r["blank"], r["inverted"]) for i, r in got.items() if i < 8} == {1: (False, False), 2: (False, True), 3: (False, False), 4: (True, False), 5: (True, True), 6: (False, False), 7: (True, True)}
    assert got[1]["grey"] == got[2]["grey"] == pages[1].tobytes() and abs(got[3]["turned"] - 3) <= 0.4 and len(got[3]["grey"]) == got[3]["width"] * got[3]["height"] > pages[3].size
    assert {got[i]["error"] for i in (8, 9, 10, 11, 12)} == {fixed.BAD_IMAGE} and got[6]["grey"] == wide.tobytes()
    assert images.shrunk(wide, 1000).shape == (8, 1000) and images.prepare(df.limit(0)).count() == 0


def test_pages_go_on_together_as_they_would_alone():
    """Small pages share an Arrow batch; levels and turns are those of numpy's percentiles and of a walk over the pixels."""
    r = np.random.default_rng(5)
    pages = [lined(2, 90, 70), *(r.integers(0, top, size=(h, w), dtype=np.uint8) for top, h, w in ((256, 1, 1), (256, 7, 5), (3, 40, 90), (250, 31, 2)))]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(pages))), "width": [p.shape[1] for p in pages], "height": [p.shape[0] for p in pages], "grey": [p.tobytes() for p in pages]})
    (out,) = images._prepare(iter([batch, batch]), None)
    assert out.num_rows == 2 * len(pages) and out["grey"].to_pylist()[: len(pages)] == [images.prepared(p)[0].tobytes() for p in pages]
    for p in pages:
        assert all(images._percentile(images._levels(p), q) == np.percentile(p, q) for q in (0, 33, 60, 90, 100))
        light = np.percentile(p, fixed.INK_PERCENTILE)
        assert images.ink_share(p) == np.mean(p < min(fixed.DARK_BELOW, light - fixed.INK_STEP))
        for degrees in (-4.2, 3.0):
            a, got = np.deg2rad(degrees), images.turned(p, degrees)
            (high, wide), (h, w) = got.shape, p.shape
            for i, j in np.ndindex(high, wide):
                y, x = i - (high - 1) / 2, j - (wide - 1) / 2
                k, m = int(np.rint(y * np.cos(a) - x * np.sin(a) + (h - 1) / 2)), int(np.rint(y * np.sin(a) + x * np.cos(a) + (w - 1) / 2))
                assert got[i, j] == (p[k, m] if 0 <= k < h and 0 <= m < w else 255)


def test_mapping_files(spark, tmp_path):
    (tmp_path / "p 1_mapping.json").write_text(json.dumps(indent=1, obj={"Alma": {"fake": "Fia", "type": "PER"}, "x": 3, "Berg": {"fake": "Ek"}, " ": {"fake": "q"}}))
    (tmp_path / "p2_mapping.json").write_text("[1]")
    (tmp_path / "other.json").write_text("{}")
    got = [tuple(r) for r in codebook.clean_pairs(codebook.read_books(spark, str(tmp_path))).orderBy("ord").select("book_id", "real", "fake", "type").collect()]
    assert got == [("p 1", "Alma", "Fia", "PER"), ("p 1", "Berg", "Ek", "")]


def test_large_batches_fail(spark):
    docs = spark.createDataFrame([(1, i, "x") for i in range(11)] + [(2, 1, "y")], "batch_id long, doc_index int, text string")
    got = {r["batch_id"]: (r["text"], r["document_count"], r["error"]) for r in files.batch_text(docs, 10).collect()}
    assert got == {1: (None, 11, "more than 10 documents"), 2: ("--- Document 1 ---\ny", 1, None)}


def test_records_count_passages(spark):
    docs = spark.createDataFrame([(1, 1, "Alma"), (1, 2, "Berit åter.")], "batch_id long, doc_index int, text string")
    row = process.process(docs, first_words(), detector=lambda text: [("ORG", "åter"), ("ORG", "saknas")] if "åter" in text else None).first()
    assert (row["passages"], row["fallback_passages"], row["discarded"]) == (2, 1, 1) and len(row["warnings"]) == 3


#: (doc_id, text): an empty document, a blank one and a null one among others, a batch of null ones, an id past 2^53, a row without an id.
ODD = [(0, "a. b"), (1, ""), (2, "c\r\n"), (3, None), (4, " \n\t "), (8, ""), (16, None), (17, None), (2**53 + 7, "past"), (2**53 + 8, "next"), (None, "x")]


def as_its_sql(spark, path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(path)).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))
    return got


def test_a_batch_with_an_empty_document_is_joined_whole(spark, tmp_path):
    """Its text was null, while its SQL joins all documents but null ones."""
    got = dict(as_its_sql(spark, tmp_path, "batch_concat", [*ODD, (24, "\xa0x ")]))
    assert got[0] == "--- Document 1 ---\na. b\n\n--- Document 2 ---\n\n\n--- Document 3 ---\nc\n\n--- Document 5 ---\n" and got[2] is got[None] is None and len(got) == 7
    docs = spark.createDataFrame([(1, 1, "x"), (1, 2, "\xa0"), (2, 1, None)], "batch_id long, doc_index int, text string")
    assert {r["batch_id"]: (r["text"], r["error"]) for r in files.batch_text(docs).collect()} == {
        1: ("--- Document 1 ---\nx\n\n--- Document 2 ---\n", "no text could be extracted"), 2: (None, "no text could be extracted"),
    }


def test_a_batch_with_an_empty_document_is_exported(spark, tmp_path):
    """It was left out of the result."""
    got = dict(as_its_sql(spark, tmp_path, "export_units", ODD))
    assert got[1] == "[E0001] Document 1\n--- Document 1 ---" and got[0].count("[E") == 4 and 2 not in got and None not in got


def test_a_batch_with_an_empty_document_has_a_prompt(spark, tmp_path):
    """It was left out of the result."""
    got = dict(as_its_sql(spark, tmp_path, "user_prompts", ODD))
    assert got[1] == "[E0001]\n--- Document 1 ---" and got[0].count("[E") == 4 and 2 not in got and None not in got
