"""A purchase ledger derived from the star-schema tables.

The test tables hold no tax ledger, so the statement that suppliers file
(``gstr2a``) and the company's own purchase register (``books``) are derived
from line items: one invoice per supplier and order, in whole paise.  The text
is SQL that both Spark and DuckDB run; Spark binds the tables as DataFrames.

``suppkey % 10`` decides how a supplier's two sides differ: 2 is missing in the
statement, 7 missing in the books; 4 lacks some invoices in the statement; 3
and 9 have amounts or tax heads that differ; 5, 6 and 8 have voucher numbers
that are bare, spelled otherwise or blank.  Order keys plant the row checks:
multiples of 101 and 103 are entered twice in the books, those below 100 of
suppliers with 1 are plain numbers with and without leading zeros, multiples of 53 carry
a wrong tax amount, some carry reverse-charge flags and telling particulars.

``row_index`` is ``(orderkey * 100000 + suppkey) * 4 + copy``: unique, and in
the order in which rows stand on the sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "supplier", "orders", "customer")

BASE_CTES = """
inv AS (
  SELECT l.l_suppkey AS suppkey, l.l_orderkey AS orderkey,
    lpad(cast(s.s_nationkey % 24 + 1 AS string), 2, '0') || 'AAAPL' || lpad(cast(l.l_suppkey AS string), 4, '0') || 'Q1Z5' AS gstin,
    s.s_name AS trade_legal_name, cast(o.o_orderdate AS date) AS invoice_date,
    lpad(cast(c.c_nationkey % 24 + 1 AS string), 2, '0') || '-State' AS place_of_supply,
    (s.s_nationkey % 24) = (c.c_nationkey % 24) AS intra,
    cast((l.l_orderkey + l.l_suppkey) % 5 AS int) AS slab,
    cast(sum(cast(round(l.l_extendedprice * 100) AS bigint)) AS bigint) AS tv
  FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
    JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey
  GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
rated AS (
  SELECT *, cast(CASE slab WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 12 WHEN 3 THEN 18 ELSE 28 END AS bigint) AS rate FROM inv),
taxed AS (
  SELECT *, cast(floor(cast(tv * rate + 50 AS double) / 100) AS bigint) AS tax, cast(suppkey % 10 AS int) AS m,
    (cast(orderkey AS bigint) * 100000 + cast(suppkey AS bigint)) * 4 AS base_index FROM rated),
halved AS (SELECT *, cast(floor(cast(tax AS double) / 2) AS bigint) AS half FROM taxed),
split AS (
  SELECT *, CASE WHEN intra THEN cast(0 AS bigint) ELSE tax END AS igst0,
    CASE WHEN intra THEN half ELSE cast(0 AS bigint) END AS cgst0, CASE WHEN intra THEN tax - half ELSE cast(0 AS bigint) END AS sgst0
  FROM halved)"""

GSTR2A_CTE = """
gstr2a AS (
  SELECT base_index AS row_index, gstin,
    CASE WHEN m = 1 AND orderkey < 100 THEN cast(orderkey AS string) ELSE 'INV/' || cast(orderkey AS string) || '/21-22' END AS identifier, trade_legal_name,
    cast(NULL AS string) AS particulars, place_of_supply,
    CASE WHEN orderkey % 97 = 0 THEN 'Y' WHEN orderkey % 89 = 0 THEN ' no ' ELSE '' END AS reverse_charge,
    rate, tv AS taxable_value, igst0 AS igst, cgst0 + CASE WHEN orderkey % 53 = 0 THEN 50000 ELSE 0 END AS cgst, sgst0 AS sgst, invoice_date
  FROM split WHERE m <> 2 AND NOT (m = 4 AND orderkey % 7 = 0))"""

BOOKS_CTE = """
entered AS (SELECT *, copy FROM split CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) k
  WHERE m <> 7 AND (copy = 0 OR orderkey % 101 = 0 OR orderkey % 103 = 0)),
books AS (
  SELECT base_index + copy AS row_index, gstin,
    CASE WHEN m = 1 AND orderkey < 100 THEN '00' || cast(orderkey AS string)
         WHEN m = 5 AND orderkey % 3 = 0 THEN cast(orderkey AS string)
         WHEN m = 6 AND orderkey % 3 = 0 THEN 'INV-' || cast(orderkey AS string) || '-2021-22'
         WHEN m = 8 AND orderkey % 5 = 0 THEN ''
         WHEN copy = 1 AND orderkey % 101 <> 0 THEN 'RE/' || cast(orderkey AS string) || '/77/A'
         ELSE 'INV/' || cast(orderkey AS string) || '/21-22' END AS identifier,
    trade_legal_name,
    CASE cast(orderkey % 40 AS int) WHEN 0 THEN 'Lorry freight inward' WHEN 1 THEN 'Legal fees, advocate' WHEN 2 THEN 'Outdoor catering'
         WHEN 3 THEN 'Motor vehicle repair' WHEN 4 THEN 'Metal scrap' WHEN 5 THEN 'Security guard' WHEN 6 THEN 'Staff health insurance'
         ELSE 'Goods lot ' || cast(orderkey % 40 AS string) END AS particulars,
    cast(NULL AS string) AS place_of_supply, cast(NULL AS string) AS reverse_charge, rate, tv AS taxable_value,
    CASE WHEN m = 3 AND orderkey % 11 = 0 THEN igst0 + 12345 WHEN m = 9 AND orderkey % 13 = 0 THEN cgst0 + sgst0 ELSE igst0 END AS igst,
    CASE WHEN m = 9 AND orderkey % 13 = 0 THEN cast(floor(cast(igst0 AS double) / 2) AS bigint) ELSE cgst0 END AS cgst,
    CASE WHEN m = 9 AND orderkey % 13 = 0 THEN igst0 - cast(floor(cast(igst0 AS double) / 2) AS bigint) ELSE sgst0 END AS sgst,
    cast(CASE WHEN copy = 0 THEN invoice_date WHEN orderkey % 101 = 0 THEN invoice_date + interval 20 day ELSE invoice_date + interval 1 day END AS date) AS invoice_date
  FROM entered)"""

CTES = f"{BASE_CTES},{GSTR2A_CTE},{BOOKS_CTE}"


def _bound(spark: SparkSession, sf_dir: str, ctes: str, name: str) -> DataFrame:
    tables = {table: spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in TABLES}
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}", **tables)


def gstr2a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement that suppliers filed, one row per invoice."""
    return _bound(spark, sf_dir, f"{BASE_CTES},{GSTR2A_CTE}", "gstr2a")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase register, one row per entry."""
    return _bound(spark, sf_dir, f"{BASE_CTES},{BOOKS_CTE}", "books")


def duckdb_ctes() -> str:
    """The same views as the head of a DuckDB query."""
    return CTES.format(**{table: table for table in TABLES})
