"""Text operators against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, jaccard, maxent, packing, quality, sharding, substring, suffix_dedup
from quillstone.llm import text as tx
from quillstone.llm.common import grown
from quillstone.llm.queries import tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
lower = lambda b: re.sub(rb"[A-Z]", lambda m: m[0].lower(), b)


def repeats(rows, width, split):
    toks, first = [], {}
    for d, t in sorted((d, t or "") for d, t in rows):
        x = split(t.encode())
        toks.append((d, x))
        for i in range(len(x) - width + 1):
            first.setdefault(tuple(x[i : i + width]), d)
    out = collections.Counter()
    for d, x in toks:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if first[tuple(x[i : i + width])] < d:
                gone[i : i + width] = True
        kept = [w for w, g in zip(x, gone) if not g]
        data = bytes(kept) if kept and isinstance(kept[0], int) else b" ".join(kept) if kept else b""
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])
        out[d, len(x), int(gone.sum()), spans, hashlib.sha256(data).hexdigest()] += 1
    return out


@pytest.mark.parametrize("width", [50, 20])
def test_suffix_dedup(corpus, rows, width):
    got = suffix_dedup.remove_repeats(corpus, width, digests=True).collect()
    assert collections.Counter(map(tuple, got)) == repeats(rows, width, list)


@pytest.mark.parametrize("width", [13, 3])
def test_substring_dedup(corpus, rows, width):
    got = substring.removal_digests(corpus, width).collect()
    want = repeats(rows, width, WORD.findall)
    assert collections.Counter(map(tuple, got)) == collections.Counter({(k[0], k[1], k[2], k[4]): n for k, n in want.items()})


def test_substring_keeps_rows(corpus):
    lean = substring.remove_repeats(corpus, 50)
    assert lean.columns == corpus.columns and lean.count() == corpus.count()
    assert lean.where("doc_id = -4").first()["text"] == corpus.where("doc_id = -4").first()["text"]


def test_word_hashes_tell_words_apart():
    words = [w for n in (8, 64, 1024, 4096) for w in ("".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n)))]
    words += ["a" * k for k in range(1, 40)] + ["\0" * k for k in range(1, 20)] + ["abcdefgh" * 2, "abcdefghhgfedcba"]
    buf, _ = tx.joined([w.encode() for w in words])
    a, b = tx.word_spans(buf)
    h = tx.span_hashes(buf, a, b)
    assert len(set(h.tolist())) == len(set(words)) and (h == tx.span_hashes(buf, a, b, slab=64)).all()
    assert tx.same_bytes(buf, a, a, b - a) and not tx.same_bytes(buf, a[:2], a[[1, 0]], (b - a)[:2])


def test_words_of_one_hash(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tx, "span_hashes", lambda buf, a, b: (b - a).astype(np.uint64))
    texts = ["one two ten", "", "six two Två"]
    got = packing.encoder(tokenizer_path()).encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [Tokenizer.from_file(tokenizer_path()).encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_grow_with_the_root():
    rows = [(t / grown(4 << 20, t)) ** 2 for t in (1 << 32, 1 << 34)]  # a row for each chunk and bucket
    assert 3.9 < rows[1] / rows[0] < 4.1 and grown(4 << 20, 1 << 50) == 64 << 20 and grown(4 << 20, 5) == 4 << 20


def test_multikey_sort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order = suffix_dedup.multikey_sort(words)
    assert [tuple(x) for x in words[order]] == sorted(tuple(x) for x in words)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(corpus, rows, n, percent):
    sets = collections.defaultdict(list)
    for d, t in rows:
        w = WORD.findall(lower((t or "").encode()))
        sets[d].append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    comp = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y)]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = jaccard.jaccard_components(corpus, n, percent).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == collections.Counter((d, len(s)) for d in sets for s in sets[d])
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def test_derived_answers_are_exact(spark):
    r = np.random.default_rng(4)
    sets, near = {}, []
    for f in range(5):
        base = r.choice(400, 60, replace=False) if f % 2 == 0 else np.append(sets[100 * (f - 1)][:57], 1000 + f)
        sets[100 * f] = np.unique(base)
        for k in range(1, 12):
            sets[100 * f + k] = np.unique(np.append(r.choice(sets[100 * f], len(sets[100 * f]) - k % 5, replace=False), 2000 + 100 * f + np.arange(k % 3)))
    meet = lambda a, b: (a, b, len(n := np.intersect1d(sets[a], sets[b])), len(sets[a]) - len(n), len(sets[b]) - len(n))
    links = lambda m: 100 * m[2] >= 90 * sum(m[2:])
    near = [m for a in sets for b in sets if a < b and a % 100 == 0 and a // 100 == b // 100 and links(m := meet(a, b))]
    pairs = [(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and a // 100 != b // 100]
    content = spark.createDataFrame([(i, v.astype(np.uint64).tobytes()) for i, v in sets.items()], "id long, content binary")
    table = spark.createDataFrame(pairs, "a long, b long, n_a long, n_b long")
    got = {tuple(x) for x in jaccard.derived_links(table, spark.createDataFrame(near, jaccard.MET), content, 90).collect()}
    assert got == {p[:2] for p in pairs if links(meet(*p[:2]))} and 10 < len(got) < len(pairs) and near


def test_blocks_lose_no_pair(spark):
    r = np.random.default_rng(6)
    rows = [(i, int(n), int(r.integers(0, 3)), int(r.integers(0, max(1, n // 8))), int(i if r.random() < 0.5 else r.integers(0, 4))) for i, n in enumerate(r.integers(5, 60, 400))]
    table = spark.createDataFrame(rows, "id long, n long, token long, place int, comp long")
    for percent in (80, 100):
        may = lambda x, y: 100 * min(x[1], y[1]) >= percent * max(x[1], y[1]) and (100 + percent) * min(x[1] - x[3], y[1] - y[3]) >= percent * (x[1] + y[1])
        want = {(x[0], y[0], x[1], y[1]) for x in rows for y in rows if x[0] < y[0] and x[2] == y[2] and x[4] != y[4] and may(x, y)}
        got = [tuple(x) for x in jaccard._cross_pairs(table, percent).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_packing(corpus, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = collections.defaultdict(list)
    out = packing.pack(corpus, tokenizer_path(), longest=64, with_ids=True).collect()
    for r in out:
        got[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in out}) == len(out)
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in got[d] if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
        copies = sum(x == d for x, _ in rows)
        assert sum(r["length"] for r in mine) == copies * len(ids) and all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 for r in mine)
        assert all(r["ids"] == ids[r["start"] : r["start"] + r["length"]] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)


def test_sharding(corpus, rows):
    got = sharding.shard_documents(corpus, shards=5, blocks=7).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert all(r["shard"] == sharding.jump_hash_python(r["doc_id"], 5) and r["grown_shard"] in (r["shard"], 5) for r in got)
    for s in range(5):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))


def test_language_model(corpus, rows):
    counts, total = collections.Counter(), 0
    split = lambda t: [*WORD.findall(lower((t or "").encode())), None]
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(split(t))
    total = sum(counts.values())
    got = maxent.score_documents(corpus).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for d, t in rows:
        w = split(t)
        want[d, zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(x in counts for x in w), total, round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w), 5)] += 1
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)


def test_language_model_beats_its_base(spark):
    got = maxent.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got) and sum(r["score"] > r["base_score"] for r in got) > 0.8 * len(got)


def test_rows_follow_from_counts():
    r = np.random.default_rng(2)
    words = [[f"w{int(x)}" for x in r.zipf(1.4, 3000) % 700] for _ in range(3)]
    t = maxent.Text.of(pa.table({"doc_id": [1, 2, 3], "text": [" ".join(w) for w in words]}))
    count = np.bincount(t.at, minlength=len(t.keys))
    total = int(count.sum())
    keys, at = t.contexts(count, total)
    by_word = collections.Counter(w for doc in words for w in [*doc, "END"]) | {"START": total}
    own = lambda w: (w,) if by_word[w] >= maxent.own_row(total) else None
    seen = [{}, {}, {}]
    for row, (one, two) in zip(at.tolist(), [(h[i + 1], h[i]) for doc in words for h in (["START", "START", *doc],) for i in range(len(doc) + 1)], strict=True):
        pair = (one, two) if min(by_word[one], by_word[two]) >= maxent.COMMON * total else "other"
        for f, name in enumerate((own(one), own(two), pair)):
            if name is not None:
                assert seen[f].setdefault(name, row[f]) == row[f]
    named = [r for s in seen for r in s.values()]
    assert len(named) == len(set(named)) and len(named) < len(keys) and (np.diff(keys.astype(object)) > 0).all() and len(seen[2]) > 100
    assert maxent.own_row(10**5) == maxent.OWN < maxent.own_row(10**10) and set(np.unique(at)) == set(range(len(keys)))


@pytest.mark.parametrize("n, many", [(1, 1), (7, 1), (5, 2), (300, 300), (4096, 100), (4096, 3000)])
def test_gradients_are_summed_by_row(n, many):
    r = np.random.default_rng(n + many)
    at, values, want = r.integers(0, many, n).astype(np.int32), r.normal(size=(n, 50)).astype(np.float32), np.zeros((many, 50))
    np.add.at(want, at, values)
    rows, sums = maxent._sums_by_row(values, at)
    assert sorted(rows) == sorted(set(at.tolist())) and np.allclose(want[rows], sums, atol=1e-4)


def test_packed_rows():
    rows = np.random.default_rng(1).normal(size=(50, 7)).astype(np.float32)
    rows[3] = 0
    back = maxent.unpack_rows(maxent.pack_rows(rows))
    assert (np.abs(back - rows).max(1) <= np.abs(rows).max(1) / 200 + 1e-4).all() and not back[3].any()


def test_scores_of_a_model_trained_by_hand(spark, monkeypatch):
    """The whole training in plain loops, on a corpus of which each chunk's half is one batch."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words[int(40 * r.random() ** 2)] for _ in range(r.randint(0, 60)))) for i in range(60)] + [(60, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(maxent, "chunk_count", lambda *_: 2)
    got = {x["doc_id"]: x for x in maxent.score_documents(table).collect()}
    chunk_of = {x["doc_id"]: x["chunk"] for x in maxent.in_chunks(table, 2).collect()}
    text = {i: [*(t or "").encode().split(), None] for i, t in docs}
    train = [i for i in text if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for i in train for w in text[i])
    total, S = sum(count.values()), maxent.SUB
    digit = lambda w: int(maxent.digits_of(np.array([maxent.END if w is None else tx.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]], np.uint64))[0])
    digits, cls = {w: digit(w) for d in text.values() for w in d}, lambda c: min(c.bit_length(), 31)
    mass, less = np.zeros((2, 32, S * S))
    for w, c in count.items():
        mass[cls(c), digits[w]] += c
        less[cls(c - 1), digits[w]] += c
    width = int(np.flatnonzero((mass + less).sum(1)).max()) + 1
    bias = np.log(less.sum(1)[:width] + 0.5) - np.log(less.sum() + 0.5 * width)
    known = count | {"START": total}

    def features(doc, i):
        h = ["START", "START", *doc]
        one, two = h[i + 1], h[i]
        row = lambda f, w: (f, w) if known.get(w, 0) >= maxent.OWN else (f, cls(known.get(w, 0)), digits[w])
        return row(1, one), row(2, two), (3, one, two) if min(known.get(one, 0), known.get(two, 0)) >= total * maxent.COMMON else (3,)

    def chances(rows, fs, k, d, table):
        z = sum(rows.get(f, np.zeros(width + 2 * S)) for f in fs)
        parts = [bias + z[:width]]
        tree = table[k].reshape(S, S)
        with np.errstate(divide="ignore"):
            for base, cut in ((tree.sum(1), slice(width, width + S)), (tree[d // S], slice(width + S, None))):
                parts.append(z[cut] + (np.log(base / base.sum()) if k else 0))
        return [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in parts]

    rows = {}
    for part in (0, 1):
        sent = collections.defaultdict(list)
        for chunk in (0, 1):
            mine, uses, grads = sorted(i for i in text if chunk_of[i] == chunk), collections.Counter(), [collections.defaultdict(lambda: np.zeros(width + 2 * S)) for _ in range(3)]
            for i in mine[part::2]:
                if i in train:
                    for n, w in enumerate(text[i]):
                        fs, k, d = features(text[i], n), cls(count[w] - 1), digits[w]
                        p = chances(rows, fs, k, d, less)
                        g = np.concatenate(p)
                        g[[k, width + d // S, width + S + d % S]] -= 1
                        g[width:] *= k > 0
                        for f, name in enumerate(fs):
                            grads[f][name] += g
                            uses[name] += 1
            for name, g in ((name, g) for by in grads for name, g in by.items()):
                cuts = (slice(0, width), slice(width, width + S), slice(width + S, None))
                change = np.concatenate([-maxent.RATE * g[c] / math.sqrt(0.2 + np.square(g[c]).mean()) for c in cuts])
                sent[name].append((uses[name], maxent.unpack_rows(maxent.pack_rows(change[None].astype(np.float32)))[0]))
        for name, changes in sent.items():
            mean = sum(n * c for n, c in changes) / (sum(n for n, _ in changes) + maxent._HALF)
            rows[name] = rows.get(name, 0) + maxent.unpack_rows(maxent.pack_rows(mean[None].astype(np.float32)))[0]
    trained = 0
    for i, doc in text.items():
        want = 0
        for n, w in enumerate(doc):
            k, d = cls(count[w]), digits[w]
            a, b, c = chances(rows, features(doc, n), k, d, mass)
            want += math.log10(a[k]) + (math.log10(b[d // S] * c[d % S] * count[w] / mass[k, d]) if k else 0)
        assert abs(got[i]["score"] - want) < 0.01 * len(doc), (i, got[i]["score"], want)
        trained += got[i]["score"] - got[i]["base_score"]
    assert trained > 0


def test_weights_are_averaged_over_chunks():
    keys, r = np.arange(1, 41, dtype=np.uint64) << np.uint64(57), np.random.default_rng(1)
    uses, rows = r.integers(0, 3, (2, 40)), r.normal(size=(2, 40, 3)).astype(np.float32)
    table = pa.concat_tables([maxent._send(c, keys, uses[c], rows[c], 4) for c in (0, 1)])
    got = {0: [], 1: []}
    for b in range(4):
        for x in maxent._average(3)((pa.scalar(b),), table.filter(pa.compute.equal(table["bucket"], b)), table.slice(0, 0)).to_pylist():
            got.setdefault(x["chunk"], []).append(maxent.unpack_rows(np.frombuffer(x["payload"], "u1").reshape(-1, 5)))
    want = (uses[:, :, None] * rows).sum(0) / (uses.sum(0) + maxent._HALF)[:, None]
    assert all(np.allclose(np.concatenate(got[c]), want, atol=2e-2) for c in (0, 1, -1))


def test_words_of_a_class_depend_on_the_history():
    r = np.random.default_rng(3)
    tokens, count = r.integers(0, 2**63, 500).astype(np.uint64), r.integers(1, 200, 500).astype(float)
    digits, kind, size = maxent.digits_of(tokens), maxent.class_of(count), maxent.SUB**2
    mass = np.bincount(kind * size + digits, count, maxent.CLASSES * size).reshape(-1, size)
    rows = r.normal(size=(8, maxent.CLASSES + 2 * maxent.SUB)).astype(np.float32)
    model = maxent.Model(int(count.sum()), 500, mass, np.zeros(maxent.CLASSES, np.float32), rows)
    model.bias[(mass.sum(1) == 0) & (np.arange(maxent.CLASSES) > 0)] = -np.inf
    logs = [model.token_logs(np.tile(np.array(at, np.int32), (501, 1)), np.append(count, 0), np.append(digits, 0)) for at in ((0, 1, 2, 3), (4, 5, 6, 7))]
    assert all(np.isclose((10**x).sum(), 1, atol=1e-4) for x in logs)
    some = np.flatnonzero(kind == kind[0])
    change = (logs[0] - logs[1])[some]
    assert np.ptp(change) > 0.1


def distance(p, t):
    row, best = list(range(len(p) + 1)), len(p)
    for c in t:
        new = [0]
        for i, q in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (q != c)))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination(spark):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(12)] + [(20 + i, " ".join(word() for _ in range(1 + i // 2))) for i in range(12)] + [(90, "kort"), (91, None), (None, "x" * 50)]
    docs = []
    for i in range(80):
        text = " ".join(word() for _ in range(30))
        if i % 2:
            leak = list(items[i % 24][1])
            for _ in range(i % 11 if i % 24 < 12 else i // 24 % 3):
                leak[r.randrange(len(leak))] = r.choice("abcdeé")
            text += ", " + "".join(leak).upper() + ". " + text
        docs.append((i, text))
    docs += [(200, None), (201, ""), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_leaky", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in docs:
        for k, x in items:
            if i is not None and k is not None and t and x:
                x = decontaminate.normal(x)
                e, most = distance(f" {x} ", f" {decontaminate.normal(t)} "), int(len(x) * decontaminate.ERROR_RATE)
                if e <= most:
                    want[i, k] = (e, most)
    lengths = {k: len(x) for k, x in items if x}
    assert len(want) > 20 and sum(e > 0 and lengths[k] < 32 for (_, k), (e, _) in want.items()) > 2
    for chars in (decontaminate.BLOCK_CHARS, 200):
        got = decontaminate.find_leaks(d, b, block_chars=chars).collect()
        assert {(r["doc_id"], r["item_id"]): (r["errors"], r["allowed"]) for r in got} == want and len(got) == len(want)
    kept = decontaminate.drop_leaks(d, b)
    assert kept.columns == d.columns and kept.count() == len(docs) - len({i for i, _ in want})
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0


def test_short_items_have_edges(spark):
    items = [(1, "Vem skrev Hamlet?"), (2, "42"), (3, "今日は天気がいいです"), (4, "?!"), (5, "kort"), (6, "vem  skrev hamlet")]
    docs = [(1, "Fråga: vem skrev HAMLET, och när?"), (2, "vem skrev hamletarna"), (3, "svaret är 42"), (4, "svaret är 142 eller 421"), (5, "彼は今日は天気がいいですと言った"), (6, "vem skriv hamlet ?!"), (7, "kort"), (8, "kort, kort"), (9, "akort kortb"), (10, "jvem skriv hamlet"), (11, "en vem skrev hamleta")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(3, 2): (0, 12), (5, 3): (0, 12), (7, 5): (0, 4), (8, 5): (0, 4), (6, 1): (1, 16), (11, 1): (1, 18)}
    want[1, 1] = 0, decontaminate.normal(docs[0][1]).index("hamlet") + 6
    want[2, 1] = 1, 15  # the edge is missing
    want |= {(d, 6): v for (d, i), v in want.items() if i == 1}
    for chars in (decontaminate.BLOCK_CHARS, 8):
        got = decontaminate.find_leaks(d, b, block_chars=chars).collect()
        assert {(r["doc_id"], r["item_id"]): (r["errors"], r["end"]) for r in got} == want and len(got) == len(want)


def test_quality(spark):
    rows = [(i, "Some plain words in a row of text. " * (1 + i % 5) if i % 2 else "BUY!! NOW!! " * (3 + i % 7)) for i in range(240)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(5))
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(None, 1), (3000, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_documents(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["predicted"] == i % 2 for i in range(240) if got[i]["held_out"]) and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 100 < kept.count() < 125
    empty = quality.train(docs, labels.limit(0))
    assert quality.score_documents(docs, empty).count() == len(rows)


def test_repeated_labels_count_once(spark, monkeypatch):
    rows = [(i, "plain words of text " * (1 + i % 5) if i % 2 else "BUY!! " * (3 + i % 7)) for i in range(90)]
    docs = spark.createDataFrame(rows + [rows[0]] * 500 + [(0, "BUY!! NOW " * 400_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda x, y, **_: sizes.append(len(y)) or quality.Trees(np.zeros((1, 1), int), np.zeros((1, 1)), np.zeros((1, 2)), 0.0))
    model = quality.train(docs, labels)
    assert sizes == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(90))] and quality.score_documents(docs, model).count() == docs.count()


def test_trees_match_a_plain_walk():
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, trees=120, depth=3)

    def walk(row):
        out = model.base
        for f, t, v in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            out += v[node - len(f)]
        return 1 / (1 + math.exp(-out))

    assert np.allclose(model.score(x), [walk(row) for row in x]) and ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_empty_and_long_documents(spark):
    item = "this is one benchmark item of some length that is looked for"
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.drop_leaks(none, items).count() == 0
    assert quality.score_documents(none, quality.train(none, labels)).count() == 0 and quality.keep_good(none, quality.train(none, labels)).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000 + item + " and more"), (2, "word " * 400_000), (3, "x" * 2_000_000)], "doc_id long, text string")
    assert [(r["doc_id"], r["errors"]) for r in decontaminate.find_leaks(long, items).collect()] == [(1, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for out in (
        suffix_dedup.remove_repeats(none, 50), substring.removal_digests(none), substring.remove_repeats(none), jaccard.jaccard_components(none), packing.pack(none, tokenizer_path()),
        sharding.shard_documents(none), maxent.score_documents(none), jaccard.keep_first(none),
    ):
        assert out.count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (2, None)], "doc_id long, text string")
    assert jaccard.keep_first(rows).count() == 3 and substring.remove_repeats(rows, 3).count() == 3
    assert {r["doc_id"] for r in jaccard.jaccard_components(rows).collect()} == {1, 2}
    assert packing.pack(rows, tokenizer_path()).select("doc_id").distinct().count() == 3 and sharding.shard_documents(rows).count() == 3


def test_op3_words_keep_their_own_rows_in_a_large_input():
    """A word needed more training tokens the larger the input was, and shared its rows below that."""
    t = maxent.Text.of(pa.table({"doc_id": [1], "text": ["aa bb cc dd"]}))
    count = np.full(len(t.keys), maxent.OWN, np.int64)
    small, large = (t.contexts(count, n) for n in (10**5, 10**10))
    assert np.array_equal(small[0], large[0]) and np.array_equal(small[1], large[1])
    shared = t.contexts(count - 1, 10**5)[0]
    assert len(np.intersect1d(shared, large[0])) < len(large[0]) - len(t.keys)
