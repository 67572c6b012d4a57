"""Derive the input tables of the operators from an order-and-line star schema.

The case extract itself is not public, so tests and benchmarks read order lines as
cases: one line is one case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight import schema

# Kept beside the case columns: they make the order of repeated case ids unambiguous.
SOURCE_KEYS = ("l_partkey", "l_suppkey", "l_extendedprice")
CASE_ORDER = ("registered_at", *SOURCE_KEYS)


# Declared layouts: reading a table then needs no job to look into its files.
LAYOUTS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their dimensions.

    The supplier side comes first: it is small, and a filter on the area or on a specialist
    then takes lines away before the join with orders moves them. Parts are joined last, so
    their text is not moved with the lines. Customers are joined to orders, which are fewer
    than lines. Lines and orders are the two large tables; the hint keeps their join the same in
    every branch of a plan, which lets branches share its shuffles, and other joins are left to
    the optimizer.
    """
    nation = table(spark, sf_dir, "nation")
    client = nation.selectExpr("n_nationkey AS site_key", "n_name AS site")
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(client, F.expr("c_nationkey = site_key"))
    )
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(suppliers, F.expr("l_suppkey = s_suppkey"))
        .join(orders.hint("merge"), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    )


def lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order: keys, figures and ``registered_at``, no texts of dimensions yet.

    The rows lie together by order.
    """
    orders = table(spark, sf_dir, "orders").hint("merge")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
    return lines.selectExpr("*", f"{_REGISTERED_AT} AS registered_at", f"{_CASE_ID} AS case_id")


def complete(lines: DataFrame, sf_dir: str) -> DataFrame:
    """The ``cases`` of some ``lines_with_orders``: their dimensions are joined now."""
    spark = lines.sparkSession
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(
        nation.selectExpr("n_nationkey AS site_key", "n_name AS site"), F.expr("c_nationkey = site_key")
    )
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    wide = (
        lines.drop("registered_at", "case_id")
        .join(suppliers, F.expr("l_suppkey = s_suppkey"))
        .join(customers, F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    )
    return wide.selectExpr(*CASE_EXPRESSIONS).selectExpr("*", *DERIVED_EXPRESSIONS)


_CASE_ID = "l_orderkey * 10 + l_linenumber"
_REGISTERED_AT = "o_orderdate + make_dt_interval(0, (l_linenumber * 3) % 24, cast(l_partkey % 60 AS int), 0)"
# What the cases ask of lines and of orders, to be answered by yes or not.
LINE_QUESTIONS = (
    "l_linestatus = 'O'",
    "l_returnflag = 'A'",
    "l_returnflag = 'N'",
    "round(l_discount * 100) < 2",
    "round(l_discount * 100) < 5",
    "round(l_discount * 100) = 10",
    "round(l_tax * 100) = 6",
    "round(l_tax * 100) = 7",
    "round(l_tax * 100) = 8",
)
ORDER_QUESTIONS = (
    "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "o_orderstatus = 'O'",
    "o_orderstatus = 'P'",
    "o_orderstatus = 'F'",
)


def _case_expressions(ask: Callable[[str], str]) -> tuple[str, ...]:
    """The columns of the cases; ``ask`` gives the expression for a question."""
    o_status, p_status, f_status = (ask(f"o_orderstatus = '{s}'") for s in "OPF")
    a_flag, n_flag = (ask(f"l_returnflag = '{s}'") for s in "AN")
    return (
        f"{_CASE_ID} AS case_id",
        "r_name AS area",
        "if(n_nationkey = 7, '', n_name) AS grp",
        "c_mktsegment AS subgrp",
        "s_name AS specialist",
        "p_brand AS service",
        f"""if({ask("l_linestatus = 'O'")}, 'END_USER', 'INTERNAL') AS service_type""",
        f"""if({ask("o_orderpriority IN ('1-URGENT', '2-HIGH')")}, 'INCIDENT', 'REQUEST') AS case_type""",
        f"""CASE WHEN {o_status} THEN 'OPEN'
            WHEN {p_status} THEN 'PENDING'
            WHEN {a_flag} THEN 'CLOSED'
            WHEN {n_flag} THEN 'SOLVED'
            ELSE 'DENIED' END AS state""",
        """CASE WHEN p_size % 10 = 0 THEN p_type
            WHEN p_size > 40 THEN concat_ws('.', p_type, replace(p_name, ' ', '.'), p_brand, 'extra')
            WHEN p_size > 20 THEN concat_ws('.', p_type, replace(p_name, ' ', '.'), p_brand)
            ELSE concat_ws('.', p_type, replace(p_name, ' ', '.')) END AS category_path""",
        "p_type AS category",
        "if(p_size % 7 = 0, '', p_name) AS ci",
        "site",
        f"""if({f_status} AND ({a_flag}
           OR ({n_flag} AND {ask("round(l_discount * 100) < 2")})),
         'INCLUDED', 'EXCLUDED') AS inclusion""",
        "cast(l_quantity * 60 AS int) AS elapsed_minutes",
        "p_size * 60 AS sla_minutes",
        "if(l_quantity <= p_size, 1, 0) AS met_sla",
        f"{_REGISTERED_AT} AS registered_at",
        f"if({ask('round(l_discount * 100) < 5')}, 1, 0) AS due_in_month",
        f"if({ask('round(l_discount * 100) = 10')}, 1, 0) AS overdue_prev_months",
        f"if({ask('round(l_tax * 100) = 6')}, 1, 0) AS closed_early_prev",
        f"if({ask('round(l_tax * 100) = 7')}, 1, 0) AS closed_early_next",
        f"if({ask('round(l_tax * 100) = 8')}, 1, 0) AS solved_early_next",
        "l_linenumber",
    )


CASE_EXPRESSIONS = (*_case_expressions(str), *SOURCE_KEYS)
DERIVED_EXPRESSIONS = (
    "registered_at + make_dt_interval(0, 0, sla_minutes, 0) AS due_at",
    """if(state IN ('CLOSED', 'SOLVED'),
         registered_at + make_dt_interval(0, 0, elapsed_minutes, 0), NULL) AS solved_at""",
    """concat(cast(elapsed_minutes * 100 div sla_minutes AS string), ',',
              cast(l_linenumber AS string)) AS progress_text""",
    "if(state = 'CLOSED', 1, 0) AS closed_in_period",
    "if(state = 'CLOSED', met_sla, 0) AS closed_met_sla",
    "if(state = 'SOLVED', 1, 0) AS solved_pending_close",
    "if(state = 'SOLVED', met_sla, 0) AS solved_pending_close_met_sla",
    "if(state IN ('OPEN', 'PENDING'), 1, 0) AS still_pending",
    "if(state IN ('OPEN', 'PENDING'), met_sla, 0) AS still_pending_met_sla",
)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``cases`` table plus ``SOURCE_KEYS``."""
    return _lines(spark, sf_dir).selectExpr(*CASE_EXPRESSIONS).selectExpr("*", *DERIVED_EXPRESSIONS)


def cases_by_narrow_rows(
    spark: SparkSession, sf_dir: str, chosen: str = "true", share: int = 0, of: int = 1
) -> DataFrame:
    """The case columns of ``cases``, for jobs that write them all.

    Every line is moved for each table that is too large to be sent to all tasks, so it is kept short until the
    last move: figures that only answer questions become the bits of one number, parts with their texts are
    joined after orders and suppliers, and names of nations and regions last of all.

    ``chosen`` is a condition on the case id. Of so many shares of the orders one is taken, by a hash of the key
    that is not the one of shuffles. Both take rows away before the first move.
    """
    answered = {q: f"(answers & {1 << i}) <> 0" for i, q in enumerate((*LINE_QUESTIONS, *ORDER_QUESTIONS))}

    def answers(questions: tuple[str, ...], first: int = 0) -> str:
        return " | ".join(f"if({q}, {1 << i}, 0)" for i, q in enumerate(questions, first))

    def taken(key: str) -> str:
        return f"pmod(xxhash64({key}), {of}) = {share}"

    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = (
        table(spark, sf_dir, "orders")
        .filter(taken("o_orderkey"))
        .selectExpr("o_orderkey", "o_custkey", "o_orderdate", f"{answers(ORDER_QUESTIONS, len(LINE_QUESTIONS))} AS order_answers")
        .join(customers, F.expr("o_custkey = c_custkey"))
        .drop("o_custkey", "c_custkey")
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .selectExpr("*", f"{_CASE_ID} AS case_id")
        .filter(chosen)
        .filter(taken("l_orderkey"))
        .selectExpr(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", f"{answers(LINE_QUESTIONS)} AS line_answers"
        )
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    parts = table(spark, sf_dir, "part").drop("p_retailprice")
    nation = table(spark, sf_dir, "nation")
    narrow = (
        lines.join(orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr("*", "line_answers | order_answers AS answers")
        .drop("o_orderkey", "line_answers", "order_answers")
        .join(suppliers, F.expr("l_suppkey = s_suppkey"))
        .drop("l_suppkey", "s_suppkey")
    )
    wide = (
        narrow.join(parts, F.expr("l_partkey = p_partkey"))
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .join(nation.selectExpr("n_nationkey AS site_key", "n_name AS site"), F.expr("c_nationkey = site_key"))
    )
    rows = wide.selectExpr(*_case_expressions(answered.__getitem__)).selectExpr("*", *DERIVED_EXPRESSIONS)
    return rows.select(*schema.CASE_COLUMNS)


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region and day of the month."""
    return (
        table(spark, sf_dir, "region")
        .selectExpr("*", "explode(sequence(1, 31)) AS day")
        .selectExpr(
            "r_name AS area", "day", "cast((r_regionkey + 1) * 100 * (32 - day) AS double) AS p0"
        )
    )


def client_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines stand for the cases that wait for the client."""
    return (
        _lines(spark, sf_dir)
        .filter("l_returnflag = 'R'")
        .selectExpr(
            "r_name AS area",
            "s_name AS specialist",
            "l_orderkey * 10 + l_linenumber AS case_id",
            "p_type AS category",
            "p_brand AS service",
        )
    )
