"""Inputs of the queries. The expressions that build labelled text from table columns are valid in Spark SQL and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivel.streaming.shared import prepare, spread


#: Tables of short rows: a file of a few megabytes, which is one task or few, holds a million of them.
SHORT = ("customer", "part", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in SHORT else rows


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str, expr: str) -> DataFrame:
    """A table of short rows with one more column, dealt by it: joins by that column need no other dealing, and have as many tasks."""
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").selectExpr("*", f"{expr} AS {key}"), key)


def made(table_name: str, /, **columns: str):
    """(Spark frame maker, SQL text) of the same projection of a table."""
    exprs = [f"{e} AS {c}" for c, e in columns.items()]

    def spark_side(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, table_name).selectExpr(*exprs)

    return spark_side, f"(SELECT {', '.join(exprs)} FROM {table_name})"


def pick(number: str, *options: str) -> str:
    """The option that a number picks."""
    cases = " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options))
    return f"CASE ({number}) % {len(options)} {cases} END"


#: White space of many kinds for made texts.
TAB, NBSP, CR, WIDE = "\t", "\u00a0", "\r", "\u2003"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


KEY = "cast(c_custkey as string)"
#: Names in many shapes, good and bad ones.
NAMES = made(
    "customer",
    id="c_custkey",
    name=pick("c_custkey", q("Nguyễn Văn An"), q("DR. TRẦN THỊ BÌNH"), q("Mr. John Smith"), q("O BRIEN MARY ANN"), q("Lê"), q("Công ty TNHH Mai"), q("jane@example.org x"), q("Work Experience"), q("Phạm Q H Long"), f"concat('Customer ', {KEY})", q("  Prof Vũ Đức  Minh "), q("Anna-Maria del Carmen")),
)
#: A number that orders the line items of an order; their line numbers repeat.
PLACE = "cast(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as bigint)"
#: Blocks of a form: geometry and type from line items.
BLOCKS = made(
    "lineitem",
    doc_id="cast(l_orderkey as string)",
    block_no=PLACE,
    page="cast(l_partkey % 2 as int)",
    x0="cast(CASE WHEN l_suppkey % 2 = 0 THEN 20 ELSE 330 END + l_linenumber as double)",
    y0="cast(l_partkey % 5 * 40 as double)",
    x1="cast(CASE WHEN l_suppkey % 2 = 0 THEN 180 ELSE 560 END as double)",
    y1="cast(l_partkey % 5 * 40 + 12 as double)",
    text="CASE WHEN l_partkey % 7 = 0 THEN 'Tran Thi Mai' WHEN l_partkey % 7 = 1 THEN 'Phone:' WHEN l_partkey % 7 = 2 THEN 'From *' WHEN l_partkey % 7 = 3 THEN 'Page 1 of 2' ELSE concat('value ', cast(l_partkey as string)) END",
    is_bold="l_returnflag = 'R'",
    font_size="cast(9 + l_suppkey % 8 as double)",
)
