"""Restoration with codebooks: tables (book_id, ord, real, fake, type) of invented values for real ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import fixed
from quillstone.functions import text as t
from quillstone.operators.detect import _is_word
from quillstone.sources.boundary import written


#: Characters of the runs that fakes are filed under, bits of the filter that texts' runs pass, and how often the index is dealt out.
GRAM, FILTER_BITS, SALTS = 8, 1 << 24, 16

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of all mapping files (`*_mapping.json`: an object from real values to objects with `fake` and `type`) under path; a book's id is its file's name.

    A file that isn't such an object has no pairs, nor has an entry that isn't an object.
    """
    files = spark.read.option("pathGlobFilter", "*_mapping.json").option("recursiveFileLookup", "true").text(path, wholetext=True)
    book = F.regexp_extract(F.input_file_name(), r"([^/]+)_mapping\.json$", 1)
    rows = files.select(F.url_decode(book).alias("book_id"), F.posexplode(F.map_entries(F.from_json("value", "map<string,string>", {"allowDuplicateKeys": "true"}))).alias("ord", "e"))
    entry = F.from_json("e.value", "fake string, type string")
    return rows.select("book_id", F.col("ord").cast("long").alias("ord"), F.col("e.key").alias("real"), entry["fake"].alias("fake"), entry["type"].alias("type")).where("fake IS NOT NULL")


def clean_pairs(books: DataFrame) -> DataFrame:
    """Trimmed pairs without blank, equal, deleted ('[...') and multi-line ones."""
    rows = books.withColumns({c: t.strip(F.coalesce(c, F.lit(""))) for c in ("real", "fake", "type")})
    return rows.where((F.length("real") > 0) & (F.length("fake") > 0) & (F.col("real") != F.col("fake")) & ~F.col("fake").startswith("[") & ~F.contains("real", F.lit("\n")) & ~F.contains("fake", F.lit("\n")))


def drop_ambiguous(books: DataFrame) -> DataFrame:
    """One pair for each fake of a book, or none: the first one if all reals agree in lower case, else the shortest real if all contain it.

    Of reals that agree in lower case the last one counts; at a tie of lengths, the one that came first.
    """
    key = F.lower("real")
    by = Window.partitionBy("book_id", "fake", "_key")
    rows = books.withColumn("_key", key).withColumn("_first", F.min("ord").over(by))
    variants = rows.groupBy("book_id", "fake", "_key").agg(F.max_by(F.struct("ord", "real", "type"), "ord").alias("last"), F.min_by(F.struct("ord", "real", "type"), "ord").alias("first"), F.min("_first").alias("_first"))
    groups = variants.groupBy("book_id", "fake").agg(
        F.count("*").alias("n"), F.min_by("first", "_first").alias("first"), F.min_by("last", F.struct(F.length("last.real"), F.col("_first"))).alias("core"), F.collect_list("_key").alias("keys")
    )
    chosen = F.when(F.col("n") == 1, F.col("first")).when(F.forall("keys", lambda k: F.contains(k, F.lower("core.real"))), F.col("core"))
    return groups.withColumn("c", chosen).where("c IS NOT NULL").select("book_id", F.col("c.ord").alias("ord"), F.col("c.real").alias("real"), "fake", F.col("c.type").alias("type"))


def distinctive(kind: Column, fake: Column) -> Column:
    """An identity number, or a name, organisation or address of two words and eight characters at least."""
    return (kind == "PERSONNUMMER") | (kind.isin(*fixed.DETECT_TYPES) & (t.word_count(fake) >= 2) & (F.length(fake) >= 8))


def _grams(value: str, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n characters, by their code points."""
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(max(0, len(points) - n + 1), np.uint64)
    for i in range(n):
        h = (h ^ h >> np.uint64(29)) * _PRIME + points[i : i + len(h)] + np.uint64(n)
    return h ^ h >> np.uint64(32)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    cuts = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).astype(np.int64)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _own_grams(fake: pa.Array) -> pa.Array:
    return _lists([np.unique(_grams(x, min(GRAM, len(x)))) for x in fake.to_pylist()])


def _bits(gram: Column) -> Column:
    """The two bits of the filter that a gram sets."""
    return F.array(F.pmod(gram, F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned(gram, 32), F.lit(FILTER_BITS)))


def _filter(filed: DataFrame) -> np.ndarray:
    """A bit for each bit of the grams that fakes are filed under: FILTER_BITS / 8 bytes, whatever the number of fakes."""
    bits = filed.select(F.explode(_bits(F.col("gram"))).alias("bit")).selectExpr("bitmap_bucket_number(bit + 1) AS bucket", "bitmap_bit_position(bit + 1) AS place")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.groupBy("bucket").agg(F.expr("bitmap_construct_agg(place)").alias("bits")).collect():
        at = (r["bucket"] - 1) * len(r["bits"])  # a bucket holds 32768 bits, buckets of positive numbers count from one
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _text_grams(bits: bytes, lengths: list[int]):
    """text_id, gram for the distinct grams of a text that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        size = np.uint64(FILTER_BITS)
        for batch in batches:
            ids, grams = [], []
            for text_id, text in zip(batch["text_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for n in lengths if text else ():
                    h = np.unique(_grams(text, n))
                    h = h[known[(h.view(np.int64) % np.int64(FILTER_BITS)).astype(np.int64)] & known[((h >> np.uint64(32)) % size).astype(np.int64)]]
                    grams.append(h.view(np.int64))
                    ids += [text_id] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)]))], names=["text_id", "gram"])

    return run


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _counts(text: pa.Array, fakes: pa.Array) -> pa.Array:
    """How often each of some values occurs in a text, without overlaps."""
    return pa.array([[text.count(f) for f in values] for text, values in zip(text.to_pylist(), fakes.to_pylist(), strict=True)], pa.list_(pa.int32()))


def occurrences(texts: DataFrame, fakes: DataFrame) -> DataFrame:
    """text_id, fake, n: how often each value of fakes (fake, distinct, not empty) occurs in a text (text_id, text), where it does.

    A fake is filed under that run of GRAM characters of it (all of it, if it is shorter) which fewest others have; texts send theirs that pass a
    filter of fixed size, and meet the fakes filed there. What meets is counted in the text. The index is dealt out SALTS times, so that
    a run that many texts have isn't one task's. Nothing goes through the driver but the filter and the few lengths of runs.
    """
    grams = fakes.select("fake", F.explode(_own_grams(F.col("fake"))).alias("gram"))
    grams = written(grams.withColumn("_n", F.least(F.length("fake"), F.lit(GRAM))), "fake-grams")
    often = grams.groupBy("gram").agg(F.count("*").alias("_often"))
    filed = written(grams.join(often, "gram").groupBy("fake", "_n").agg(F.min_by("gram", F.struct("_often", "gram")).alias("gram")), "filed-fakes")
    lengths = [r["_n"] for r in filed.select("_n").distinct().collect()]  # GRAM values at most
    rows = texts.select(F.col("text_id").cast("long").alias("text_id"), "text")
    if not lengths:
        return texts.sparkSession.createDataFrame([], "text_id long, fake string, n int")
    asked = rows.mapInArrow(_text_grams(_filter(filed).tobytes(), lengths), "text_id long, gram long").withColumn("salt", F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int"))
    index = filed.select("fake", "gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = asked.join(index, ["gram", "salt"]).groupBy("text_id").agg(F.collect_set("fake").alias("fakes"))
    counted = rows.join(met, "text_id").select("text_id", "fakes", _counts(F.col("text"), F.col("fakes")).alias("counts"))
    return counted.select("text_id", F.inline(F.arrays_zip(F.col("fakes").alias("fake"), F.col("counts").alias("n")))).where("n > 0")


def scores(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """text_id, book_id, score for books with a hit: occurrences of distinctive fakes, identity numbers weighing three times.

    Fakes may start and end inside words. Equal fakes are looked for once, however many books have them. Texts of equal text_id count as one if
    they are equal, else each; a null text has no hits.
    """
    weight = F.when(F.col("type") == "PERSONNUMMER", fixed.IDENTITY_WEIGHT).otherwise(1)
    good = pairs.where(distinctive(F.col("type"), F.col("fake"))).select("book_id", "fake", weight.alias("weight"))
    found = occurrences(texts, good.select("fake").distinct())
    salt = F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int")  # a fake of many texts isn't one task's
    dealt = good.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.withColumn("salt", salt).join(dealt, ["fake", "salt"]).groupBy("text_id", "book_id").agg(F.sum((F.col("n") * F.col("weight")).cast("long")).alias("score"))


def detect(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """text_id, book_id, score of the best book with a score of two at least; the first id in text order wins a tie."""
    best = Window.partitionBy("text_id").orderBy(F.desc("score"), "book_id")
    return scores(texts, pairs).where(F.col("score") >= fixed.LEAST_SCORE).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def partial_names(pairs: DataFrame) -> DataFrame:
    """book_id, ord, real, fake: first and last names of full names, where the fake one occurs once in the book.

    The real part must not be a title nor a word of an organisation, place or address of the book.
    """
    words = lambda c: F.split(t.strip(F.col(c)), r"(?U)\s+")
    people = pairs.where("type = 'PER'").withColumns({"f": words("fake"), "r": words("real")}).where("size(f) >= 2 AND size(r) >= 2")
    ends = people.select("book_id", "ord", F.posexplode(F.array(*(F.struct(F.element_at("f", i).alias("fake"), F.element_at("r", i).alias("real")) for i in (1, -1)))).alias("edge", "e"))
    ends = ends.select("book_id", "ord", "edge", "e.*").where((F.length("fake") >= 3) & (F.length("real") >= 2) & ~F.lower("real").isin(*fixed.TITLES))
    other = pairs.where("type IN ('ORG', 'LOC', 'ADDRESS')").select("book_id", F.explode(words("real")).alias("w")).select("book_id", F.lower("w").alias("_w")).distinct()
    names = ends.withColumn("_w", F.lower("real")).join(other, ["book_id", "_w"], "left_anti").drop("_w")
    once = names.withColumn("_n", F.count("*").over(Window.partitionBy("book_id", "fake"))).where("_n = 1")
    return once.select("book_id", "ord", "edge", "real", "fake")


RESTORED = "text_id long, book_id string, score long, text string, fake string, real string, count int"
#: Parts that texts with a book are dealt into at most, besides one for each book; texts of a part at least.
MOST_PARTS, PART_TEXTS = 4096, 4096


def deanonymise(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """texts (text_id, text, summary) restored: text_id, book_id, score, text, and one row for each fake that was replaced.

    The longest fake goes first, whole words, in one pass, so what is put in is never replaced again. Texts without a book pass through.

    A book is sent once to each part of its texts, ahead of them. Books of many texts have several parts; they are fewer than MOST_PARTS, so that their numbers of parts are broadcast.
    """
    found = written(detect(texts.select("text_id", "text"), pairs), "found-books")
    most = max(PART_TEXTS, found.count() // MOST_PARTS + 1)
    sizes = found.groupBy("book_id").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = found.join(F.broadcast(sizes.where("parts > 1")), "book_id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("text_id"), "parts"), F.lit(0)))
    partial = partial_names(pairs).select("book_id", (F.col("ord") + F.lit(1 << 30) + F.col("edge")).alias("ord"), "real", "fake")
    whole = pairs.select("book_id", "ord", "real", "fake").unionByName(partial)
    book = whole.groupBy("book_id").agg(F.collect_list(F.struct("ord", "fake", "real")).alias("book"))
    ahead = book.join(sizes, "book_id").select("book_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "book")
    rows = texts.select(F.col("text_id").cast("long").alias("text_id"), "summary").join(dealt, "text_id", "left")
    met = rows.where("book_id IS NOT NULL").select("book_id", "part", "text_id", "score", "summary").unionByName(ahead, allowMissingColumns=True)
    restored = met.repartition("book_id", "part").sortWithinPartitions("book_id", "part", F.col("book").isNull()).mapInArrow(_restore, RESTORED)
    none = {"score": F.lit(0).cast("long"), "fake": F.lit(None).cast("string"), "real": F.lit(None).cast("string"), "count": F.lit(0)}
    return restored.unionByName(rows.where("book_id IS NULL").withColumns(none).select("text_id", "book_id", "score", F.col("summary").alias("text"), "fake", "real", "count"))


class _Book:
    """Finds the fakes of a book as whole words: of those that start at one place the longest, from left to right, without overlaps."""

    def __init__(self, book: list[dict]) -> None:
        import ahocorasick

        self.real = {p["fake"]: p["real"] for p in sorted(book, key=lambda p: p["ord"], reverse=True)}  # of equal fakes the first counts
        self.automaton = ahocorasick.Automaton()
        for fake in self.real:
            self.automaton.add_word(fake, len(fake))
        if self.real:
            self.automaton.make_automaton()

    def restore(self, text: str) -> tuple[str, Counter[str]]:
        if not self.real:
            return text, Counter()
        longest: dict[int, int] = {}
        for last, n in self.automaton.iter(text):
            a, b = last + 1 - n, last + 1
            if not (a and _is_word(text[a - 1])) and not (b < len(text) and _is_word(text[b])):
                longest[a] = max(b, longest.get(a, b))
        out, at, counts = [], 0, Counter()
        for a in sorted(longest):
            if a >= at:
                fake = text[a : longest[a]]
                out += [text[at:a], self.real[fake]]
                counts[fake] += 1
                at = longest[a]
        return "".join([*out, text[at:]]), counts


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESTORED rows of texts, each book (a row with `book`) ahead of its own; one book is kept at a time."""
    book_id, book = None, _Book([])
    schema = pa.schema([("text_id", pa.int64()), ("book_id", pa.string()), ("score", pa.int64()), ("text", pa.string()), ("fake", pa.string()), ("real", pa.string()), ("count", pa.int32())])
    for batch in batches:
        out = []
        for key, text_id, score, text, pairs in zip(*(batch[c].to_pylist() for c in ("book_id", "text_id", "score", "summary", "book")), strict=True):
            if pairs is not None:
                if key != book_id:
                    book_id, book = key, _Book(pairs)
                continue
            counts: Counter[str] = Counter()
            if text is not None:
                text, counts = book.restore(text)
            row = {"text_id": text_id, "book_id": key, "score": score, "text": text}
            out.extend(row | {"fake": f, "real": book.real[f], "count": n} for f, n in counts.items())
            if not counts:
                out.append(row | {"fake": None, "real": None, "count": 0})
        yield pa.RecordBatch.from_pylist(out, schema=schema)
