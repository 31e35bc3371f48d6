"""Tables with known defects, derived from the given ones by key arithmetic.

The SQL runs unchanged in Spark and in DuckDB, so both sides of a comparison see the same
rows. Defects follow the keys: every tenth date is written differently, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.dataset import ROW_ID, Dataset

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _padded(expression: str, width: int) -> str:
    return f"lpad({_text(expression)}, {width}, '0')"


VIEWS = {
    "dirty_customer": f"""
        SELECT c_custkey AS row_key,
          concat('CUST-', {_padded("CASE WHEN c_custkey % 97 = 1 THEN c_custkey - 1 ELSE c_custkey END", 9)}) AS customer_id,
          CASE WHEN c_custkey % 7 = 0 THEN concat('  ', c_name, ' ') WHEN c_custkey % 11 = 0 THEN upper(c_name)
               ELSE c_name END AS full_name,
          CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '  '
               WHEN c_custkey % 19 = 0 THEN concat('user', {_text("c_custkey")}, '@')
               ELSE concat('user', {_text("c_custkey")}, '@example.com') END AS email,
          CASE WHEN c_custkey % 29 = 0 THEN 'unknown'
               WHEN c_custkey % 23 = 0 THEN concat(substr(c_mktsegment, 1, 3), '-', substr(c_mktsegment, 4))
               WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
          CASE WHEN c_custkey % 101 = 0 THEN '199' WHEN c_custkey % 103 = 0 THEN '-5'
               WHEN c_custkey % 31 = 0 THEN NULL ELSE {_text("18 + c_custkey % 60")} END AS age,
          CASE WHEN c_custkey % 211 = 0 THEN 'twelve'
               ELSE concat(CASE WHEN c_custkey % 31 = 0 THEN '$' ELSE '' END, {_text("1 + c_custkey % 9")}, ',',
                           {_padded("(c_custkey * 37) % 1000", 3)}, '.50') END AS revenue,
          CASE WHEN c_custkey % 103 = 5 THEN '2023-02-30' WHEN c_custkey % 211 = 7 THEN '2999-01-01'
               WHEN c_custkey % 10 = 3 THEN concat({_padded("1 + c_custkey % 28", 2)}, '/', {_padded("1 + c_custkey % 12", 2)},
                                                   '/', {_text("2015 + c_custkey % 9")})
               ELSE concat({_text("2015 + c_custkey % 9")}, '-', {_padded("1 + c_custkey % 12", 2)}, '-',
                           {_padded("1 + c_custkey % 28", 2)}) END AS signup_date,
          CASE WHEN c_custkey % 37 = 0 THEN 'MalmÃ¶' WHEN c_custkey % 41 = 0 THEN 'Krak�w'
               WHEN c_custkey % 3 = 0 THEN 'Malmö' WHEN c_custkey % 3 = 1 THEN 'Kraków' ELSE 'Rome' END AS city,
          'EUR' AS currency
        FROM customer""",
    "dirty_orders": f"""
        SELECT o_orderkey AS row_key,
          CASE WHEN o_orderkey % 103 = 5 THEN '2023-02-30' WHEN o_orderkey % 211 = 7 THEN '2999-01-01'
               WHEN o_orderkey % 10 = 3 THEN concat({_padded("day(o_orderdate)", 2)}, '/', {_padded("month(o_orderdate)", 2)},
                                                    '/', {_text("year(o_orderdate)")})
               ELSE concat({_text("year(o_orderdate)")}, '-', {_padded("month(o_orderdate)", 2)}, '-',
                           {_padded("day(o_orderdate)", 2)}) END AS order_date,
          concat({_text("year(o_orderdate) + CASE WHEN o_orderkey % 53 = 0 THEN -1 ELSE 1 END")}, '-06-15') AS delivery_date,
          CASE WHEN o_orderkey % 17 = 0 THEN concat('(', {_text("o_orderkey % 900 + 1")}, ')')
               WHEN o_orderkey % 19 = 0 THEN concat({_text("o_orderkey % 90")}, '%')
               ELSE {_text("o_orderkey % 5000")} END AS amount,
          CASE WHEN o_orderkey % 9 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority
        FROM orders""",
    "dirty_company": f"""
        SELECT o_orderkey AS row_key,
          concat(CASE WHEN o_orderkey % 5 = 0 THEN 'ACME ' ELSE 'Acme ' END, {_text("o_orderkey % 3000")},
                 CASE WHEN o_orderkey % 4 = 0 THEN ' Ltd' WHEN o_orderkey % 4 = 1 THEN ', S.p.A.'
                      WHEN o_orderkey % 4 = 2 THEN ' GmbH' ELSE '' END) AS company_name,
          CASE WHEN o_orderkey % 6 = 0 THEN concat('Info', {_text("o_orderkey % 3000")}, '@Acme.example.com')
               ELSE concat('info', {_text("o_orderkey % 3000")}, '@acme.example.com') END AS contact_email,
          CASE WHEN o_orderkey % 9 = 0 THEN concat('X', {_text("o_orderkey % 1000")})
               ELSE concat('FR', {_padded("o_orderkey % 3000", 9)}) END AS vat_code,
          o_orderstatus AS status
        FROM orders""",
    "dirty_part": f"""
        SELECT p_partkey AS row_key,
          CASE WHEN p_partkey % 8 = 0 THEN concat(substr(p_type, 1, 2), ' ', substr(p_type, 3))
               WHEN p_partkey % 8 = 1 THEN concat(' ', lower(p_type)) ELSE p_type END AS part_type,
          CASE WHEN p_partkey % 3 = 0 THEN {_text("p_partkey % 400")}
               WHEN p_partkey % 3 = 1 THEN concat('2024-01-', {_padded("1 + p_partkey % 28", 2)})
               ELSE p_name END AS mixed,
          CASE WHEN p_partkey % 12 = 0 THEN concat('=', p_name) WHEN p_partkey % 12 = 1 THEN concat(' +', p_name)
               WHEN p_partkey % 12 = 2 THEN '-42.5' ELSE p_name END AS remark,
          CASE WHEN p_partkey % 2 = 0 THEN 'Yes' WHEN p_partkey % 5 = 0 THEN 'oui' ELSE 'no' END AS in_stock
        FROM part""",
    "repeated_orders": f"""
        SELECT o_orderkey AS row_key, concat('C', {_text("o_custkey % 40")}) AS customer, o_orderstatus AS status,
          CASE WHEN o_orderkey % 9 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 11 = 0 THEN concat(' ', o_orderpriority)
               ELSE o_orderpriority END AS priority
        FROM orders""",
    "shared_ids": f"""
        SELECT o_orderkey % 100 AS row_key, concat('C', {_text("o_custkey % 40")}) AS customer, o_orderstatus AS status,
          CASE WHEN o_orderkey % 9 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority
        FROM orders""",
    "repeated_lines": """
        SELECT l_orderkey * 10 + l_linenumber AS row_key, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status,
          CAST(l_quantity AS BIGINT) % 7 AS lot
        FROM lineitem""",
    "long_notes": """
        SELECT o_orderkey AS row_key,
          CASE WHEN o_orderkey % 7 = 0 THEN upper(repeat(concat(o_orderpriority, ' and so on '), 20))
               ELSE lower(repeat(concat(o_orderpriority, ' and so on '), 20)) END AS note,
          CASE WHEN o_orderkey % 5 = 0 THEN repeat(concat(o_orderstatus, ' '), 200) ELSE o_orderstatus END AS code
        FROM orders""",
    "marked_parts": """
        SELECT p_partkey AS row_key,
          CASE WHEN p_partkey % 10 = 0 THEN '-' WHEN p_partkey % 10 = 1 THEN '?' WHEN p_partkey % 10 = 2 THEN '  '
               WHEN p_partkey % 10 = 3 THEN concat(substr(p_brand, 1, 5), '-', substr(p_brand, 6))
               WHEN p_partkey % 10 = 4 THEN lower(p_brand) ELSE p_brand END AS brand
        FROM part""",
    "wide_nation": f"""
        SELECT c_custkey AS row_key, c_mktsegment AS segment,
          CASE WHEN c_custkey % 70 = 0 THEN NULL ELSE {_text("c_nationkey")} END AS nation_key,
          CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE n_name END AS nation_name,
          {", ".join(f"{_text(f'c_custkey % {i}')} AS extra_{i}" for i in range(2, 60))}
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "dated_orders": f"""
        SELECT row_key, y, m, d, CASE row_key % 17
            WHEN 0 THEN concat(ys, '-', ms, '-', ds) WHEN 1 THEN concat(ds, '/', ms, '/', ys) WHEN 2 THEN concat(ms, '/', ds, '/', ys)
            WHEN 3 THEN concat(ds, '-', ms, '-', ys) WHEN 4 THEN concat(ys, '/', ms, '/', ds) WHEN 5 THEN concat(ds, '.', ms, '.', ys)
            WHEN 6 THEN concat(ds, ' ', substr(mn, 1, 3), ' ', ys) WHEN 7 THEN concat(substr(mn, 1, 3), ' ', ds, ', ', ys)
            WHEN 8 THEN concat(ds, ' ', mn, ' ', ys) WHEN 9 THEN concat(mn, ' ', ds, ', ', ys) WHEN 10 THEN concat(ys, ms, ds)
            WHEN 11 THEN concat(ds, '/', ms, '/', substr(ys, 3)) WHEN 12 THEN concat(ms, '/', ds, '/', substr(ys, 3))
            WHEN 13 THEN concat(ys, '-', ms, '-', ds, ' 10:20:30') WHEN 14 THEN concat(ys, '-', ms, '-', ds, 'T10:20:30')
            WHEN 15 THEN concat(ds, '/', ms, '/', ys, ' 10:20') ELSE concat(ms, '/', ds, '/', ys, ' 10:20') END AS written
        FROM (SELECT o_orderkey AS row_key, 2000 + o_orderkey % 25 AS y, 1 + o_orderkey % 12 AS m, 13 + o_orderkey % 15 AS d,
            {_text("2000 + o_orderkey % 25")} AS ys, {_padded("1 + o_orderkey % 12", 2)} AS ms, {_text("13 + o_orderkey % 15")} AS ds,
            CASE 1 + o_orderkey % 12 WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April'
              WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September'
              WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS mn
          FROM orders)""",
    "european_prices": f"""
        SELECT p_partkey AS row_key, concat({_text("1 + p_partkey % 9")}, '.', {_padded("(p_partkey * 31) % 1000", 3)}, ',',
          {_padded("p_partkey % 100", 2)}, CASE WHEN p_partkey % 4 = 0 THEN ' €' ELSE '' END) AS price
        FROM part""",
    "gappy_nation": f"""
        SELECT c_custkey AS row_key, c_mktsegment AS segment,
          CASE WHEN c_custkey % 70 = 0 THEN NULL ELSE {_text("c_nationkey")} END AS nation_key,
          CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE n_name END AS nation_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}


#: A unique integer for the rows of given tables whose first column is none.
ROW_NUMBERS = {"lineitem": "l_orderkey * 10 + l_linenumber", "labels": "doc_id", "conversations": "conv_id * 10000 + turn"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as its files are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sources = {source: table(spark, sf_dir, source) for source in TABLES if source in VIEWS[name]}
    sql = VIEWS[name]
    for source in sources:
        for keyword in ("FROM", "JOIN"):
            sql = sql.replace(f"{keyword} {source}", f"{keyword} {{{source}}}")
    return spark.sql(sql, **{k: v for k, v in sources.items() if f"{{{k}}}" in sql})


def dataset(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> Dataset:
    """A table with all its columns, or a view without its made-up key, rows numbered by a unique key."""
    df = frame(spark, sf_dir, name)
    number = ROW_NUMBERS.get(name, df.columns[0])
    df = df.withColumn(ROW_ID, F.expr(number).cast("bigint"))
    kept = [column for column in df.columns if column not in (ROW_ID, "row_key")] if columns is None else columns
    return Dataset(df.select(ROW_ID, *kept), name)


def with_views(sql: str) -> str:
    """``sql`` preceded by the definitions of the views it mentions."""
    used = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in sql]
    if not used:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(used)}, {body[5:]}"
    return f"WITH {', '.join(used)} {body}"
