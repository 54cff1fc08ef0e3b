"""Views that shape the driver's tables like procurement data, as SQL that Spark and DuckDB both read.

Every view is derived from the given tables in full; a query's input is `view(spark, sf_dir, name)`
and its SQL twin starts with `with_views(name, ...)`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "tenders": """
SELECT lpad(CAST(o_orderkey AS STRING), 12, '0') AS reference,
  CASE o_orderkey % 9 WHEN 0 THEN 'صيانة طرق وجسور' WHEN 1 THEN 'إنشاء مبنى مدرسة' WHEN 2 THEN 'توريد أثاث مكاتب' WHEN 3 THEN 'شبكة مياه وصرف صحي'
    WHEN 4 THEN 'تشجير حدائق' WHEN 5 THEN 'هدم وإزالة' WHEN 6 THEN 'توريد أجهزة' WHEN 7 THEN 'إنارة طرق' ELSE 'تطوير شبكات اتصالات' END || ' ' || o_orderpriority AS title,
  c_name AS agency,
  CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 1200 AS DOUBLE) END AS fee,
  CASE o_orderkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'card-observed' ELSE 'detail-verified' END AS fee_verification,
  CASE WHEN o_orderkey % 23 = 0 THEN 'متعدد المناطق: ' || n_name || '، ' || c_mktsegment WHEN o_orderkey % 19 = 0 THEN 'منطقة الرياض' WHEN o_orderkey % 17 = 0 THEN 'غير محددة' ELSE n_name END AS region,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS published_at,
  CASE WHEN o_orderkey % 29 = 0 THEN 'أدخل الموعد' WHEN o_orderkey % 31 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS STRING) || ' 09:59' END AS deadline,
  CASE o_orderstatus WHEN 'O' THEN 'المنافسات النشطة (تقديم العروض)' WHEN 'F' THEN 'منتهية' ELSE NULL END AS platform_status,
  CASE o_orderkey % 5 WHEN 0 THEN 'مناسبة' WHEN 1 THEN 'جديدة' ELSE 'قيد المراجعة' END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS activity,
  CASE o_orderkey % 4 WHEN 0 THEN 'شراء مباشر' WHEN 1 THEN 'منافسة عامة' WHEN 2 THEN NULL ELSE 'منافسة محدودة' END AS tender_type,
  CASE o_orderkey % 6 WHEN 0 THEN 'لا يوجد ضمان' WHEN 1 THEN 'ضمان 2%' WHEN 2 THEN '' ELSE NULL END AS guarantee,
  CAST(o_orderkey % 9 AS INT) AS n_attachments,
  CAST(40 + o_custkey % 50 AS INT) AS score,
  o_orderkey AS k
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "snapshot_prev": """
SELECT reference, CASE WHEN k % 41 = 0 THEN '' ELSE title END AS title, agency, fee, fee_verification, region, deadline, published_at, platform_status, activity,
  TRUE AS active, published_at AS first_seen, published_at AS last_seen, k FROM tenders WHERE k % 10 <> 0""",
    "incoming": """
SELECT reference, CASE WHEN k % 5 = 0 THEN title || ' (معدلة)' ELSE title END AS title, agency, CASE WHEN k % 3 = 0 THEN fee + 50 ELSE fee END AS fee,
  CASE k % 4 WHEN 0 THEN 'detail-verified' WHEN 1 THEN 'unknown' ELSE 'card-observed' END AS fee_verification,
  CASE WHEN k % 37 = 0 THEN '' ELSE region END AS region, deadline, published_at, platform_status, activity, k FROM tenders WHERE k % 7 <> 0""",
    "observations": """
SELECT CAST(extract(year FROM l_shipdate) AS INT) AS sync_run_id, lpad(CAST(l_orderkey AS STRING), 12, '0') AS reference, CAST(s_nationkey AS STRING) AS region_id, n_name AS region_name,
  CASE WHEN l_discount < 0.05 THEN 'free' ELSE 'paid-1-1000' END AS fee_bucket, l_linenumber AS page_number,
  'منافسة ' || CAST(l_partkey AS STRING) AS title, s_name AS agency,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS DOUBLE) END AS fee,
  CASE l_returnflag WHEN 'N' THEN 'unknown' WHEN 'A' THEN 'card-observed' ELSE 'detail-verified' END AS fee_verification,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) AS seq
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "fee_texts": """
SELECT l_orderkey AS k, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) AS seq,
  CASE l_linenumber % 7 WHEN 0 THEN 'قيمة الكراسة: ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || ' ر.س' WHEN 1 THEN '١٬' || CAST(100 + l_partkey % 900 AS STRING) || '٫50'
    WHEN 2 THEN '- ' || CAST(l_partkey AS STRING) WHEN 3 THEN CAST(l_partkey AS STRING) || ' أو ' || CAST(l_suppkey AS STRING) WHEN 4 THEN '' WHEN 5 THEN CAST(l_partkey AS STRING) || ',000 = ' || CAST(l_partkey AS STRING) || '000' ELSE NULL END AS fee_text,
  CASE l_suppkey % 4 WHEN 0 THEN 'https://tenders.etimad.sa/Tender/DetailsForSupplier?id=' || CAST(l_partkey AS STRING) WHEN 1 THEN 'http://tenders.etimad.sa/Tender/Details/1' WHEN 2 THEN 'https://tenders.etimad.sa.example.org/Tender/Details' ELSE 'not a url' END AS source_url
FROM lineitem""",
    "attachments": """
SELECT DISTINCT lpad(CAST(l_orderkey AS STRING), 12, '0') AS reference,
  CASE l_partkey % 5 WHEN 0 THEN 'كراسة الشروط ' WHEN 1 THEN 'جدول الكميات ' WHEN 2 THEN 'Evaluation ' WHEN 3 THEN 'ملحق ' ELSE 'Penalties ' END || CAST(l_partkey AS STRING) || CASE l_linenumber % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx' ELSE '.exe' END AS display_name,
  CAST(CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE (l_partkey % 120) * 1000000 END AS BIGINT) AS size_bytes,
  CASE l_suppkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'free-available' WHEN 2 THEN 'metadata-only' ELSE 'purchased-available' END AS availability,
  l_orderkey AS k FROM lineitem""",
    "runs": """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS run_id, min(ts) AS started_at, max(ts) AS finished_at, CASE WHEN count(*) % 5 = 0 THEN 'partial' WHEN count(*) % 7 = 0 THEN 'failed' ELSE 'complete' END AS status,
  count(DISTINCT user_id % 13) AS regions_completed, 13 AS regions_targeted, count(*) AS checked_count, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS new_count, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS changed_count
FROM events GROUP BY CAST(CAST(ts AS DATE) AS STRING)""",
    "run_regions": """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS run_id, CAST(user_id % 13 + 1 AS STRING) AS region_id, count(*) AS checked_count, CASE WHEN max(value) > 50 THEN 'complete' ELSE 'running' END AS status
FROM events GROUP BY CAST(CAST(ts AS DATE) AS STRING), CAST(user_id % 13 + 1 AS STRING)""",
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The views and those below them, each after what it reads."""
    found: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in found:
            for other in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", VIEWS[name]):
                if other != name:
                    add(other)
            found.append(name)

    for name in names:
        add(name)
    return found


def with_views(*names: str, body: str = "") -> str:
    """WITH clause of the views, and body after it (its own CTEs may follow with a leading comma)."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed(names)) + "\n" + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view, or one of the driver's tables, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    at = lambda sql: re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(BASE)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql)
    return spark.sql(at(with_views(name, body=f"SELECT * FROM {name}")))
