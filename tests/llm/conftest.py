import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Small documents with copies, near copies, shared passages, nulls, empties, repeated rows, long and odd texts, and clashing column names."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["Ärlig", "the", "of", "and", "ÉTÉ"]
    make = lambda n: [r.choice(words) for _ in range(n)]
    base, passage = make(160), make(60)
    texts = [" ".join(make(r.randint(1, 120))) for _ in range(60)]
    texts += [" ".join(base)] * 3
    for k in range(12):
        near = base[:]
        for _ in range(k % 4):
            near[r.randrange(len(near))] = f"x{r.randrange(10**6)}"
        texts.append("  ".join(near))
    texts += [" ".join(make(20) + passage + make(20)) for _ in range(6)]
    texts += [" ".join(make(10) + passage[:13] + make(3)), " ".join(passage[5:40]), "\n".join(["same line of text again"] * 12), "aaaa" * 60, "a" * 300, None, "", " \t\n", "one", "one two", "ONE two", "a b c\x1cd"]
    texts += ["long " + " ".join(make(30_000)), " ".join(make(40)) + "é" * 70]
    for n, k in ((1024, 14), (4096, 1)):  # words that sums of powers modulo 2**64 can't tell apart
        word = "".join("ab"[i.bit_count() % 2] for i in range(n))
        texts += [" ".join([word] * k), " ".join([word.translate(str.maketrans("ab", "ba"))] * k)]
    rows = [(i * 3 % 1009, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (-4, " ".join(passage), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumnRenamed("source", "chunk").selectExpr("*", "1 AS bucket", "'x' AS content").cache()
    return df


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.collect()]
