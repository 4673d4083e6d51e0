"""SQL of the judgment corpora that are derived from the given tables.

Each text runs unchanged in Spark and in DuckDB. ``JUDGMENT_PAGES`` has one
header page, one page per order line and one outcome page per order.
``COURT_PAGES`` varies the layout by order: named benches, signatures, law
reports, counsel across pages, remands, procedural history, file-name dates.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from decretum.sources.tables import dealt

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

JUDGMENT_PAGES = """
WITH base AS (
  SELECT o.o_orderkey AS record_id, o.o_orderstatus AS st, o.o_orderdate AS d, c.c_name AS cn, n.n_nationkey AS nk
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
ln AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem l)
SELECT record_id, 1 AS page, concat('IN THE HIGH COURT OF ',
    CASE nk % 4 WHEN 0 THEN 'KARNATAKA' WHEN 1 THEN 'BOMBAY' WHEN 2 THEN 'KERALA' ELSE 'DELHI' END, chr(10),
    'Writ Petition No. ', CAST(record_id AS VARCHAR(20)), ' of ', CAST(year(d) AS VARCHAR(20)), chr(10),
    cn, ' v. State of Kerala and BBMP', chr(10),
    'Judgment dated ', CAST(day(d) AS VARCHAR(20)), '-', CAST(month(d) AS VARCHAR(20)), '-', CAST(year(d) AS VARCHAR(20)), '.') AS text
FROM base
UNION ALL
SELECT l_orderkey, 1 + CAST(rn AS INT), concat('Counsel for ', l_returnflag, ' was heard at length on the record. The ',
    CASE l_suppkey % 3 WHEN 0 THEN 'Revenue Department' WHEN 1 THEN 'BBMP' ELSE 'Urban Development Department' END,
    CASE l_partkey % 3 WHEN 0 THEN ' shall file a compliance report'
                       WHEN 1 THEN ' is directed to release the arrears due'
                       ELSE ' shall remove the encroachment on the road' END,
    CASE WHEN l_linestatus = 'O' THEN concat(' within ', CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ' days') ELSE '' END, '.')
FROM ln
UNION ALL
SELECT record_id, 99, concat('In the result, the petition is ',
    CASE st WHEN 'F' THEN 'allowed' WHEN 'O' THEN 'dismissed' ELSE 'partly allowed' END, '. No order as to costs.') FROM base
"""

COURT_BASE = """
SELECT o.o_orderkey AS record_id, o.o_orderstatus AS st, o.o_orderdate AS d, c.c_name AS cn,
  o.o_orderkey % 6 AS v,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'Arun Mehta' WHEN 1 THEN 'Leela Nair' WHEN 2 THEN 'Kavya Rao'
    WHEN 3 THEN 'Dev Sharma' ELSE 'Neel Bose' END AS j1,
  CASE o.o_custkey % 3 WHEN 0 THEN 'Tara Sen' WHEN 1 THEN 'Rohan Das' ELSE 'Mira Pillai' END AS j2,
  CASE n.n_nationkey % 4 WHEN 0 THEN 'Karnataka' WHEN 1 THEN 'Bombay' WHEN 2 THEN 'Kerala' ELSE 'Delhi' END AS place,
  o.o_custkey % 8 AS user_id
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

COURT_PAGES = f"""
WITH cb AS ({COURT_BASE})
SELECT record_id, 1 AS page, concat('order_', CAST(record_id AS VARCHAR(20)), '_28-Sep-',
    CAST(CASE WHEN v = 3 THEN year(d) - 1 ELSE year(d) + 1 END AS VARCHAR(20)), '.pdf') AS original_file_name,
  CASE v
  WHEN 0 THEN concat('REPORTABLE', chr(10), 'IN THE SUPREME COURT OF INDIA', chr(10), 'CIVIL APPEAL NO. ',
    CAST(record_id AS VARCHAR(20)), ' of ', CAST(year(d) AS VARCHAR(20)), chr(10), cn, ' ... Petitioner(s)', chr(10),
    'VERSUS', chr(10), 'State of ', place, ' ... Respondent(s)', chr(10), 'CORAM: HON''BLE MR. JUSTICE ', upper(j1), chr(10),
    'HON''BLE MS. JUSTICE ', upper(j2), chr(10), chr(10), 'For Petitioner(s) Mr. ', j2, ', Adv. Ms. ', j1, ', Adv.', chr(10),
    'UPON hearing the counsel the matter stood over.')
  WHEN 1 THEN concat('IN THE HIGH COURT OF ', upper(place), chr(10), 'SLP No. ', CAST(record_id AS VARCHAR(20)), ' of ',
    CAST(year(d) AS VARCHAR(20)), chr(10), cn, chr(10), 'versus', chr(10), 'Union Territory of ', place, chr(10),
    'HON''BLE SMT. JUSTICE ', upper(j1), chr(10), 'Order dated 3rd March 1961 in an earlier case is noted.')
  WHEN 2 THEN concat(CAST(100 + record_id % 800 AS VARCHAR(20)), ' SUPREME COURT REPORTS [1974]', chr(10),
    'RAM LAL v. STATE OF ', upper(place), ' (', j1, ', J.)', chr(10),
    'An earlier decision dated 12-3-1975 was cited. The relief was allowed to stand there.')
  WHEN 3 THEN concat('DISTRICT COURT ', upper(place), chr(10), 'Criminal Appeal No. ', CAST(record_id AS VARCHAR(20)), ' of ',
    CAST(year(d) AS VARCHAR(20)), chr(10), cn, ' vs. Municipal Board', chr(10),
    'Appeal from the High Court of ', place, ', decided before.', chr(10), 'Judgment dated ', CAST(day(d) AS VARCHAR(20)), '-', CAST(month(d) AS VARCHAR(20)), '-', CAST(year(d) AS VARCHAR(20)), '.')
  WHEN 4 THEN concat('IN THE HIGH COURT OF ', upper(place), chr(10), 'Writ Petition No. ', CAST(record_id AS VARCHAR(20)), ' of ',
    CAST(year(d) AS VARCHAR(20)), chr(10), cn, ' v. Collector & Ors.', chr(10), 'We heard Mr. ', j2, ', learned senior')
  ELSE concat('Proceedings of the tribunal as follows', chr(10), 'Item ', CAST(record_id AS VARCHAR(20)), chr(10),
    'The matter stood over for hearing.') END AS text
FROM cb
UNION ALL
SELECT record_id, 2, CAST(NULL AS VARCHAR(20)), CASE v
  WHEN 0 THEN 'The High Court held that the petition was dismissed. Accordingly, we allow the appeal.'
  WHEN 1 THEN concat('In view of the above we grant leave and tag this appeal with Civil Appeal No. 7 of 2001. Page 2 of the order follows.', chr(10),
    'CJI.', chr(10), '[', upper(j2), ']')
  WHEN 2 THEN 'The petitioner submits that the claim was dismissed. The costs are left open.'
  WHEN 3 THEN 'The order, on facts, is set aside and the matter is remitted to the High Court for fresh consideration.'
  WHEN 4 THEN concat('counsel appearing for the appellant, at length. Ms. ', j1, ', learned counsel for the respondents, replied. ',
    'The Municipal Board shall update the records within six weeks.')
  ELSE 'We direct that the Collector is directed to pay the compensation within 2 months. The parties shall bear their own costs.' END
FROM cb
UNION ALL
SELECT record_id, 3, CAST(NULL AS VARCHAR(20)), CASE v
  WHEN 0 THEN 'Liberty to approach this Court is reserved. The State is directed to forward the compliance report within ten days.'
  WHEN 1 THEN 'Leave is granted. The Registry shall issue notice to all the parties concerned.'
  WHEN 2 THEN 'The appeal is accordingly quashed in part only.'
  WHEN 3 THEN concat('The petition is disposed of.', chr(10), 'J. [', j1, ']')
  WHEN 4 THEN 'In the result, the petition is allowed. There shall be no order as to costs.'
  ELSE 'The application is partly allowed. Annexure A and the schedule form part hereof.' END
FROM cb
"""


def register_tables(spark: SparkSession, sf_dir: str, by: dict[str, str] | None = None) -> None:
    """Temporary views of the given tables; Parquet is read lazily, column by column. ``by`` names tables to deal, with their key."""
    for name in TABLES:
        rows = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
        (dealt(rows, by[name]) if by and name in by else rows).createOrReplaceTempView(name)


def sql_table(spark: SparkSession, sf_dir: str, text: str, by: dict[str, str] | None = None) -> DataFrame:
    register_tables(spark, sf_dir, by)
    return spark.sql(text)


#: Order lines are many to a record: dealt by record, so that no task's memory grows with the table.
BY_RECORD = {"lineitem": "l_orderkey"}


def judgment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return sql_table(spark, sf_dir, JUDGMENT_PAGES).withColumn("chunk_id", F.concat(F.lit("p"), F.col("page")))


def court_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return sql_table(spark, sf_dir, COURT_PAGES).withColumn("chunk_id", F.concat(F.lit("p"), F.col("page")))
