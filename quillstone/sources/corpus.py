"""Notes of invented people, made from the order tables: their identifiers are known from the columns that they're made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = ("Alma", "Bertil", "Cecilia", "David", "Elsa", "Folke", "Greta")
LAST = ("Vinterlund", "Sommarek", "Dalbergh", "Fjellner", "Strandquist")
STREETS = ("Lindgatan", "Kullavägen", "Torpstigen")


def _pick(names: tuple[str, ...], key: str, dialect: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    array = f"array({listed})" if dialect == "spark" else f"[{listed}]"
    return f"({array})[CAST({key} % {len(names)} AS INT)" + ("]" if dialect == "spark" else " + 1]")


def _digits(expr: str, width: int) -> str:
    return f"lpad(CAST(({expr}) AS STRING), {width}, '0')"


def segments(dialect: str = "spark") -> list[tuple[str | None, str]]:
    """(kind, SQL) of the parts of a note in order; kind is null for what isn't an identifier."""
    c, o = "o_custkey", "o_orderkey"
    name = f"{_pick(FIRST, c, dialect)} || ' ' || {_pick(LAST, c, dialect)}"
    identity = f"{_digits(f'50 + {c} % 50', 2)} || {_digits(f'1 + {c} % 12', 2)} || {_digits(f'1 + {c} % 28', 2)} || '-' || {_digits(f'{c} * 7919 % 10000', 4)}"
    lf = "chr(10)"
    return [
        (None, "'Patient: '"), ("PERSON", name), (None, f"{lf} || 'Personnummer '"), ("PERSONNUMMER", identity), (None, f"{lf} || 'Besök '"),
        ("DATE", "CAST(CAST(o_orderdate AS DATE) AS STRING)"), (None, "', tel '"), ("PHONE", f"'070-' || {_digits(f'{c} * 104729 % 10000000', 7)}"),
        (None, "', e-post '"), ("EMAIL", f"'c' || CAST({c} AS STRING) || '@example.invalid'"), (None, f"{lf} || 'Journal-id: '"), ("RECORD_ID", f"'J' || {_digits(o, 8)}"),
        (None, f"{lf} || 'Postnummer: '"), ("POSTAL_CODE", f"{_digits(f'100 + {c} % 900', 3)} || ' ' || {_digits(f'{c} % 100', 2)}"), (None, f"{lf} || 'bor på '"),
        ("ADDRESS", f"{_pick(STREETS, c, dialect)} || ' ' || CAST(1 + {c} % 99 AS STRING)"), (None, "', '"), ("AGE", f"CAST(20 + {c} % 70 AS STRING) || ' årig'"),
        (None, f"' person. P-CRP ' || CAST({o} % 200 AS STRING) || ' mg/l, inte feber. Alvedon ' || CAST(500 * (1 + {o} % 2) AS STRING) || ' mg.'"),
    ]


def note_sql(dialect: str = "spark") -> str:
    """SQL of a note's text over orders."""
    return " || ".join(f"({sql})" for _, sql in segments(dialect))


def expected_spans_sql(dialect: str = "spark") -> list[tuple[str, str, str]]:
    """(kind, start, value) in SQL for each identifier of a note: a start is the length of what is before it."""
    parts = segments(dialect)
    return [(kind, " + ".join(f"length({s})" for _, s in parts[:i]), sql) for i, (kind, sql) in enumerate(parts) if kind]


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by a key if its table has fewer files than the session has cores: costly work would run in a few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, batch_id, doc_index, text: a note for each order; a customer's orders, by key, are the documents of a batch."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    index = "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS doc_index"
    return spread(orders, "o_custkey").selectExpr("o_orderkey AS note_id", "o_custkey AS batch_id", index, f"{note_sql()} AS text")
