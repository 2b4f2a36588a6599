"""Resampling, source divergence and chat formatting against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import chat, divergence, resampling, terms

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def test_crc_states():
    r = random.Random(3)
    raw = [bytes(r.randrange(256) for _ in range(r.choice([1, 2, 7, 63, 64, 65, 900]))) for _ in range(60)]
    buf, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
    starts = ends - [len(x) for x in raw]
    begin = np.array([r.randrange(1 << 32) for _ in raw], np.uint32)
    got = terms.crc_states(buf, starts, ends, begin ^ terms.CRC_START) ^ terms.CRC_START
    assert got.tolist() == [zlib.crc32(x, int(b)) for x, b in zip(raw, begin)]


def features(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, share, seed, n, buckets, least):
    S, T = Counter(), Counter()
    at = lambda f: zlib.crc32(f.encode()) % buckets
    for _, text in rows:
        S.update(map(at, features(text, n)))
    for text in target:
        T.update(map(at, features(text, n)))
    s, t = sum(S.values()), sum(T.values())
    gain = lambda b: math.floor(1000 * math.log((T[b] + 1) * (s + buckets) / ((S[b] + 1) * (t + buckets))))
    out, able = [], []
    for doc, text in rows:
        f = features(text, n)
        weight = sum(gain(at(x)) for x in f) // len(f) if f else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words_of(text)) >= least:
                able.append((-score, doc, len(f)))
        out.append((doc, len(f), weight, score))
    drawn = sorted(able)[: share * len(able) // 100]
    return out, drawn


@pytest.mark.parametrize("share, n, buckets, least", [(25, 2, 10_000, 20), (60, 3, 97, 0), (100, 1, 1, 1)])
def test_resample(spark, corpus, rows, share, n, buckets, least):
    target = ["The of and W1 w2", None, "w3 w4 the of " * 50]
    docs = corpus.unionByName(spark.createDataFrame([(None, "the of and " * 30, None, None, None, 1, "x")], corpus.schema))
    rows = [*rows, (None, "the of and " * 30)]
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), share, 7, n, buckets, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = got.collect()
    want, drawn = resampled(rows, target, share, 7, n, buckets, least)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert sorted((r["rank"], -r["score"], r["doc_id"], r["n_features"]) for r in got if r["rank"]) == [(i, *d) for i, d in enumerate(drawn, 1)]


def test_resample_hot_and_empty(spark):
    hot = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words again and again").otherwise(F.concat(F.lit("word "), F.col("id").cast("string"))).alias("text"))
    target = spark.createDataFrame([("again word",)], "text string")
    got = resampling.resample(hot, target, least_words=1).collect()
    want, drawn = resampled([(r["doc_id"], r["text"]) for r in hot.collect()], ["again word"], 25, 7, 2, 10_000, 1)
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [d for _, d, _ in drawn]
    assert resampling.resample(hot.limit(0), target).count() == 0
    assert {r["weight"] for r in resampling.resample(hot.limit(2), target.limit(0)).collect()} != {None}


def audited(rows, least, ranks):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, w in mine for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        counts = defaultdict(Counter)
        for _, source, w in mine:
            counts[source].update(t for t in w if df[t] >= least)
        p = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        shares = {s: {t: p(c[t], c.total()) for t in kept} for s, c in counts.items()}
        whole = sum(counts.values(), Counter())
        for s in counts:
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in counts if o != s]
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)]
            over = [(-f(shares[s][t], q), t) for t in kept if counts[s][t] and shares[s][t] > (q := p(whole[t], whole.total()))]
            out += [(lang, s, "term", t, -v, i) for i, (v, t) in enumerate(sorted(over, key=lambda x: (x[0], x[1].encode()))[:ranks], 1)]
    return sorted(out)


@pytest.mark.parametrize("width, sources", [(8, 1024), (1 << 18, 2)])
def test_audit(spark, width, sources, monkeypatch):
    """With a sketch of 8 cells nothing is filtered; with 2 sources a block, terms' sources are dealt out."""
    monkeypatch.setattr(divergence, "_SOURCES", sources)
    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdé" for b in ("x", "Y", "zö", "q" * 70)]
    rows = [(" ".join(r.choice(vocabulary[: 4 + k % 17]) for _ in range(r.randrange(40))), ["en", "sv", None][k % 3], f"s{k % 7}" if k % 11 else None) for k in range(120)]
    rows += [(None, "de", "only"), ("", "de", "empty"), ("1 2 3 @@", "fr", "digits"), ("rare words here", "it", "a"), *[("one one", "nl", "x")] * 3, ("long " * 30_000, "en", "s1")]
    docs = spark.createDataFrame([(*x, 1, "t") for x in rows], "text string, lang string, source string, n int, term string").repartition(5)
    got = divergence.audit(docs, width=width, ranks=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows, 3, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_sketch_discards(spark):
    """Terms of one document don't pass a wide sketch, those of three do."""
    docs = spark.createDataFrame([(f"common {chr(97 + i // 26)}{chr(97 + i % 26)}z", "en", "s") for i in range(300)], "text string, lang string, source string")
    flags = divergence.possible_terms(docs, 3, 1 << 20, 3)
    assert 1 <= flags[0].sum() <= 2


CONTROL = ["<s>", "</s>", "[INST] ", " [/INST]", "[SYS]", "[/SYS] ", "[ROLE=x] ", " [/ROLE]", "\\", "[", "<", "[\\INST]", "<\\\\/s>", "a", "å\n", " ", "]", "INST]", "/s>", "𝄞"]


def folded(log):
    """Messages of a log, event after event."""
    convs = defaultdict(dict)
    rank = {"message": 1, "regenerate": 2, "edit": 3, "delta": 4}
    for conv, seq, kind, place, role, text in sorted((e for e in log if e[2] in rank and e[3] is not None), key=lambda e: (e[1], rank[e[2]], e[5] or "")):
        now, text = convs[conv], text or ""
        if kind == "message":
            now[place] = [role if role is not None or place not in now else now[place][0], text]
        elif kind == "regenerate":
            for later in [p for p in now if p > place]:
                del now[later]
            if place in now:
                now[place][1] = ""
        elif place in now:
            now[place][1] = text if kind == "edit" else now[place][1] + text
    return sorted((c is not None, c, p, r or "", x) for c, now in convs.items() for p, (r, x) in now.items())


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_fold(spark, block):
    r = random.Random(block)
    log = []
    for conv in (1, 2, None, 9):
        for seq in range(r.choice([3, 40, 90])):
            kind = r.choice(["message", "message", "delta", "delta", "delta", "edit", "regenerate", "other"])
            role = r.choice(["user", "assistant"]) if kind == "message" else None
            log.append((conv, seq, kind, r.choice([0, 1, 2, 3, 4, None]), role, r.choice([None, "", "ab", "c"])))
    # whoever says nothing of a message that is gone or hasn't begun
    got = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, kind string, place long, role string, text string"), F.floor(F.col("seq") / block))
    assert sorted((x["conv_id"] is not None, x["conv_id"], x["place"], x["role"], x["text"]) for x in got.collect()) == folded(log)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CONTROL), max_size=8).map("".join), min_size=1, max_size=12))
def test_escapes_round_trip(spark, texts):
    roles = ["user", "assistant", "system", "tool [/ROLE] x", ""]
    turns = [(0, i, roles[i % 5], x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(turns, "conv_id long, place long, role string, text string")
    row = chat.render(df, F.lit(0).cast("long")).select("text", chat.parse(F.col("text")).alias("turns"), "loss").first()
    assert [(x["role"], x["text"]) for x in row["turns"]] == [(r, x) for *_, r, x in turns]
    masked = [row["text"][s["start"] : s["end"]] for s in row["loss"]]
    back = spark.createDataFrame([(m,) for m in masked] or [("",)], "m string").select(chat.unescape(F.col("m")).alias("m")).collect()
    assert [b["m"] for b in back][: len(masked)] == [x for _, _, r, x in turns if r == "assistant"]


def test_conversations(spark):
    r = random.Random(2)
    rows = [(conv, turn, r.choice(["user", "assistant", "system", "tool", None]), "".join(r.choice(CONTROL) for _ in range(r.randrange(30)))) for conv in range(6) for turn in range(r.choice([1, 5, 200]))]
    rows += [(7, 0, "assistant", None), (7, 0, "assistant", None), (7, None, "user", "first"), (None, 3, "user", "x"), (None, 1, "assistant", "y"), (8, 2, "assistant", "é" * 5000), (8, 1, "user", "q" * 100_000)]
    rows += [(9, 0, "user", "again")] * 3
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn long, role string, text string, seq int, place string")
    got = {x["conv_id"]: tuple(x) for x in chat.read_back(chat.format_log(chat.as_log(docs), 16)).collect()}
    assert len(got) == len({c for c, *_ in rows})
    for conv, digest in got.items():
        mine = sorted(((t if t is not None else -(1 << 63), role or "", x or "") for c, t, role, x in rows if c == conv))
        loss = "".join(x for _, role, x in mine if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for _, role, x in mine)
        assert digest[:5] == (conv, len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_log(chat.as_log(docs.limit(0)))).count() == 0


def test_a_message_may_become_empty(spark):
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "dra"), (1, 2, "delta", 1, None, "ft"), (1, 3, "regenerate", 1, None, None), (1, 4, "edit", 0, None, "")]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, kind string, place long, role string, text string")).orderBy("place").collect()
    assert [(x["role"], x["text"]) for x in got] == [("user", ""), ("assistant", "")]
