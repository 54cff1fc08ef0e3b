"""Queries of dashboards, operational reports, intake and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..sources import intake
from ..sources.adapters import view, with_views
from .boards import CROWDING, FREE
from .boards import NOW as BOARD_NOW
from .catalog import query

NOW = "2024-02-01 00:00:00"


@query(with_views("runs", "run_regions", body=f""", last_ AS (SELECT * FROM runs WHERE status = 'complete' ORDER BY started_at DESC, run_id DESC LIMIT 1)
, tops AS (SELECT run_id, string_agg(region_id || '=' || CAST(checked_count AS STRING), ',' ORDER BY place) AS top_regions FROM (SELECT r.*, row_number() OVER (ORDER BY r.checked_count DESC, region_id) AS place FROM run_regions r JOIN last_ USING (run_id)) t WHERE place <= 6 GROUP BY run_id)
, timed AS (SELECT *, epoch_us(finished_at) // 1000 - epoch_us(started_at) // 1000 AS duration_ms, epoch_ms(TIMESTAMP '{NOW}') - epoch_us(finished_at) // 1000 AS age_ms FROM last_ LEFT JOIN tops USING (run_id))
, secs AS (SELECT *, CAST(round(duration_ms / 1000.0) AS BIGINT) AS s FROM timed)
SELECT run_id, duration_ms, CASE WHEN s // 60 = 0 THEN printf('%d ثانية', s % 60) WHEN s % 60 = 0 THEN printf('%d دقيقة', s // 60) ELSE printf('%d دقيقة و%d ثانية', s // 60, s % 60) END AS duration_label,
  checked_count, new_count, changed_count, regions_completed = regions_targeted AS complete, age_ms, age_ms > 14400000 AS stale, top_regions FROM secs"""))
def last_run_summary(spark, sf_dir):
    return reports.last_run_summary(view(spark, sf_dir, "runs"), view(spark, sf_dir, "run_regions"), NOW)


@query(with_views("tenders", body=""", c AS (SELECT region, count(*) AS n FROM tenders GROUP BY region)
SELECT region, n, starts_with(region, 'متعدد') AS is_multi, (SELECT count(*) FROM c WHERE starts_with(region, 'متعدد')) AS multi_groups, (SELECT coalesce(sum(n), 0) FROM c WHERE starts_with(region, 'متعدد')) AS multi_tenders, (SELECT sum(n) FROM c) AS total FROM c"""))
def region_stats(spark, sf_dir):
    return reports.region_stats(view(spark, sf_dir, "tenders"))


@query(with_views("tenders", body=""", c AS (SELECT region, count(*) AS n FROM tenders GROUP BY region), o AS (SELECT region, n, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY n DESC, region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT region, n, CAST(floor(n * CAST(100 AS DOUBLE) / total + 0.5) AS BIGINT) AS percent, floor(before * CAST(10000 AS DOUBLE) / total + 0.5) / 100 AS "offset" FROM o"""))
def region_share(spark, sf_dir):
    return reports.region_share(view(spark, sf_dir, "tenders"))


_STORED = "SELECT o_orderkey AS file_id, o_orderpriority AS kind, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '/files/' || CAST(o_orderkey AS STRING) END AS local_path, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS stored_at FROM orders"


def _stored(spark, sf_dir):
    return view(spark, sf_dir, "orders").selectExpr("o_orderkey AS file_id", "o_orderpriority AS kind", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '/files/' || CAST(o_orderkey AS STRING) END AS local_path", "CAST(floor(o_totalprice) AS BIGINT) AS size_bytes", "o_orderdate AS stored_at")


@query(f"WITH f AS ({_STORED}) SELECT kind, count(*) AS files, sum(size_bytes) AS bytes, max(stored_at) AS newest FROM f WHERE local_path <> '' GROUP BY kind")
def storage_overview(spark, sf_dir):
    return reports.storage_overview(_stored(spark, sf_dir))


@query(f"WITH f AS ({_STORED}) SELECT file_id, kind, local_path, size_bytes, stored_at FROM f WHERE local_path <> ''")
def storage_listing(spark, sf_dir):
    return reports.storage_listing(_stored(spark, sf_dir))


@query(f"""WITH f AS ({_STORED}), m AS (SELECT *, stored_at < TIMESTAMP '1996-06-15' - INTERVAL 300 DAY AND local_path IS NOT NULL AS old FROM f)
SELECT file_id, CASE WHEN NOT old THEN local_path END AS local_path, CASE WHEN NOT old THEN size_bytes END AS size_bytes, CASE WHEN old THEN 'purged-old' ELSE 'stored' END AS state, CASE WHEN old THEN size_bytes ELSE 0 END AS freed_bytes FROM m""")
def retention_preview(spark, sf_dir):
    return reports.retention_preview(_stored(spark, sf_dir), "1996-06-15 00:00:00", 300)


@query("""WITH d AS (SELECT CAST(user_id AS STRING) AS reference, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'complete' END AS status, event_type FROM events), h AS (SELECT DISTINCT reference, event_type FROM d WHERE status = 'complete')
, v AS (SELECT reference, count(*) AS versions FROM h GROUP BY reference)
SELECT reference, count(*) AS inspected, sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END) AS complete, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed, coalesce(max(versions), 0) AS versions FROM d LEFT JOIN v USING (reference) GROUP BY reference""")
def details_stats(spark, sf_dir):
    d = view(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS reference", "CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'complete' END AS status", "event_type")
    return reports.details_stats(d, d.where("status = 'complete'").select("reference", "event_type").distinct())


@query(with_views("runs", "run_regions", body="""SELECT r.run_id, l.status AS run_status, region_id, r.status, r.checked_count FROM run_regions r JOIN (SELECT run_id, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1) l ON r.run_id = l.run_id"""))
def run_progress(spark, sf_dir):
    return reports.run_progress(view(spark, sf_dir, "runs"), view(spark, sf_dir, "run_regions"))


@query(with_views("runs", body="""SELECT run_id, status, checked_count FROM runs WHERE status IN ('partial', 'running') AND started_at > coalesce((SELECT max(started_at) FROM runs WHERE status = 'complete'), TIMESTAMP '1900-01-01') ORDER BY started_at DESC, run_id LIMIT 1"""))
def resumable_run(spark, sf_dir):
    return reports.resumable_run(view(spark, sf_dir, "runs")).select("run_id", "status", "checked_count")


@query(with_views("observations", body=""", p AS (SELECT sync_run_id, region_id, max(page_number) AS pages, count(*) AS checked, arg_max(fee_bucket, lpad(CAST(page_number AS STRING), 5, '0') || reference || lpad(CAST(seq AS STRING), 5, '0')) AS last_bucket FROM observations GROUP BY ALL)
SELECT *, CASE WHEN row_number() OVER (PARTITION BY sync_run_id ORDER BY CAST(region_id AS INT) DESC) = 1 THEN 'running' ELSE 'complete' END AS status, count(*) OVER (PARTITION BY sync_run_id) - 1 AS regions_completed FROM p"""))
def region_rollup(spark, sf_dir):
    return reports.region_rollup(view(spark, sf_dir, "observations"))


@query(with_views("tenders", "runs", body=f"""SELECT count(*) FILTER (WHERE status = 'مناسبة') AS suitable, count(*) FILTER (WHERE n_attachments >= 3) AS files_complete, count(*) FILTER (WHERE {FREE}) AS verified_free,
  count(*) FILTER (WHERE {CROWDING} <= 38) AS quiet, (SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1) AS run_id FROM tenders"""))
def board_kpis(spark, sf_dir):
    return reports.board_kpis(view(spark, sf_dir, "tenders"), view(spark, sf_dir, "runs"), BOARD_NOW)


_ACT = "SELECT event_id AS activity_id, CASE event_type WHEN 'click' THEN 'classifier' WHEN 'purchase' THEN 'courier' ELSE event_type END AS role, ts AS created_at, 'value ' || CAST(user_id AS STRING) AS detail FROM events"


def _activity(spark, sf_dir):
    return view(spark, sf_dir, "events").selectExpr("event_id AS activity_id", "CASE event_type WHEN 'click' THEN 'classifier' WHEN 'purchase' THEN 'courier' ELSE event_type END AS role", "ts AS created_at", "'value ' || CAST(user_id AS STRING) AS detail")


@query(f"SELECT * FROM ({_ACT}) a ORDER BY created_at DESC, activity_id DESC LIMIT 50")
def recent_activity(spark, sf_dir):
    return reports.recent_activity(_activity(spark, sf_dir))


@query(with_views("runs", body=f""", a AS ({_ACT}) SELECT (SELECT detail FROM a WHERE role = 'classifier' ORDER BY created_at DESC, activity_id DESC LIMIT 1) AS classifier, (SELECT detail FROM a WHERE role = 'courier' ORDER BY created_at DESC, activity_id DESC LIMIT 1) AS courier,
  run_id, checked_count, new_count, changed_count FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1"""))
def nightly_summary(spark, sf_dir):
    return reports.nightly_summary(_activity(spark, sf_dir), view(spark, sf_dir, "runs"))


_QUEUE = "SELECT event_id AS queue_id, CASE event_id % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'approved' WHEN 2 THEN 'done' ELSE 'failed' END AS state, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 10 END AS size_bytes, ts AS created_at FROM events"


def _queue(spark, sf_dir):
    return view(spark, sf_dir, "events").selectExpr("event_id AS queue_id", "CASE event_id % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'approved' WHEN 2 THEN 'done' ELSE 'failed' END AS state", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 10 END AS size_bytes", "ts AS created_at")


@query(f"SELECT * FROM ({_QUEUE}) q WHERE state = 'approved' ORDER BY created_at DESC, queue_id LIMIT 500")
def queue_list(spark, sf_dir):
    return reports.queue_list(_queue(spark, sf_dir), "approved")


@query(f"""WITH q AS ({_QUEUE}), u AS (SELECT queue_id AS id, 'done' AS n_state, CASE WHEN queue_id % 2 = 0 THEN queue_id ELSE NULL END AS n_size FROM q WHERE state = 'approved')
SELECT queue_id, coalesce(n_state, state) AS state, coalesce(n_size, size_bytes) AS size_bytes, created_at FROM q LEFT JOIN u ON queue_id = id""")
def queue_transition(spark, sf_dir):
    q = _queue(spark, sf_dir)
    return reports.queue_transition(q, q.where("state = 'approved'").selectExpr("queue_id", "'done' AS state", "CASE WHEN queue_id % 2 = 0 THEN queue_id ELSE NULL END AS size_bytes"))


# --- intake ---------------------------------------------------------------------------------------


_CARD = """'<div class="card"><h5><a href="/Tender/Details/' || CAST(k AS STRING) || '">' || title || '</a></h5><h5>' || agency || '</h5><p>الرقم المرجعي' || chr(10) || CASE WHEN k % 7 = 0 THEN 'غير متاح' ELSE reference END || '</p><p>قيمة الكراسة: '
 || CASE k % 4 WHEN 0 THEN '</p><p>' || CAST(CAST(fee AS BIGINT) AS STRING) || ' ر.س' WHEN 1 THEN CAST(CAST(fee AS BIGINT) AS STRING) || ' ر.س' ELSE 'مجانًا' END || '</p><p>' || published_at || ' - 2024-05-' || lpad(CAST(1 + k % 28 AS STRING), 2, '0') || '</p></div>'"""


@query(with_views("tenders", body=""", c AS (SELECT k, reference, title, agency, fee, published_at, row_number() OVER (PARTITION BY k // 30 ORDER BY k) AS pos FROM tenders WHERE published_at IS NOT NULL)
, v AS (SELECT *, CASE WHEN k % 4 <= 1 THEN CAST(CAST(fee AS BIGINT) AS STRING) || ' ر.س' ELSE 'مجانًا' END AS fee_text FROM c WHERE k % 7 <> 0)
SELECT k // 30 AS page_id, '1' AS region_id, pos, reference, title, agency, fee_text, CASE WHEN published_at >= '2000' THEN published_at ELSE '2024-05-' || lpad(CAST(1 + k % 28 AS STRING), 2, '0') END AS published_at,
  CASE WHEN published_at >= '2000' THEN '2024-05-' || lpad(CAST(1 + k % 28 AS STRING), 2, '0') || ' 09:59' ELSE '' END AS deadline, CASE WHEN k % 4 <= 1 THEN fee END AS fee, CASE WHEN k % 4 <= 1 THEN 'card-observed' ELSE 'unknown' END AS fee_verification FROM v"""))
def card_extract(spark, sf_dir):
    """Listing pages of up to 30 cards, put together from the tenders in order."""
    cards = view(spark, sf_dir, "tenders").where("published_at is not null").selectExpr("k div 30 AS page_id", "k", f"{_CARD.replace('chr(10)', 'char(10)')} AS card")
    pages = cards.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), "").alias("html"))
    return intake.card_extract(pages.withColumn("region_id", F.lit("1")))


_KINDS = ("pdf", "DOCX", "exe", "zip", "7z", "rar", "doc", "xls", "ppt", "xlsx", "pptx", "tar.pdf")
#: First bytes of the files: those of their kind, of another, or of none.
_HEADS = ("255044462D", "504B0304", "377ABCAF271C", "526172211A0700", "D0CF11E0A1B11AE1", "504B0506", "")
_NAME = "'file-' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 31 = 7 THEN ' ' ELSE CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '.{k}'" for i, k in enumerate(_KINDS)) + " END END"
_HEAD = "CASE WHEN doc_id % 5 = 3 THEN CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS)) + " END ELSE CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{_HEADS[k]}'" for i, k in enumerate((0, 1, 6, 5, 2, 3, 4, 4, 4, 1, 5, 0))) + " END END"
_MIME = "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN ' Application/PDF; charset=binary' WHEN 3 THEN 'application/x-zip-compressed' WHEN 4 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 5 THEN 'application/msword;v=1' ELSE NULL END"
_FILE = f"""WITH f AS (SELECT doc_id AS file_id, {_NAME} AS name, lower(split_part({_MIME}, ';', 1)) AS mime_, CASE WHEN doc_id % 11 = 0 THEN encode('') ELSE unhex({_HEAD}) || encode(coalesce(text, '')) END AS c FROM documents)
, e AS (SELECT *, octet_length(c) AS n, lower(coalesce(regexp_extract(trim(name), '\\.([^.]+)$', 1), '')) AS ext, substr(hex(c), 1, 32) AS head, trim(coalesce(mime_, '')) AS mime FROM f)"""
_SIGNED = lambda profile: "CASE ext " + " ".join(f"WHEN '{e}' THEN " + " OR ".join(f"starts_with(head, '{h}')" for h in heads) for e, (heads, _) in profile.kinds.items()) + " ELSE FALSE END"
_TYPED = "CASE ext " + " ".join(f"WHEN '{e}' THEN mime IN ({', '.join(repr(t) for t in types)})" for e, (_, types) in intake.QUARANTINE.kinds.items()) + " END"
_EXTENSIONS = lambda profile: ", ".join(f"'{e}'" for e in profile.kinds)


def _files(spark, sf_dir):
    return view(spark, sf_dir, "documents").selectExpr("doc_id AS file_id", f"{_NAME} AS name", f"{_MIME} AS mime", f"CASE WHEN doc_id % 11 = 0 THEN encode('', 'UTF-8') ELSE unhex({_HEAD}) || encode(coalesce(text, ''), 'UTF-8') END AS content")


@query(_FILE + f""" SELECT file_id, name, n AS size_bytes, sha256(c) AS sha256, CASE WHEN n = 0 THEN 'empty' WHEN n > {100 << 20} THEN 'too-large' WHEN ext NOT IN ({_EXTENSIONS(intake.QUARANTINE)}) THEN 'extension' WHEN NOT ({_SIGNED(intake.QUARANTINE)}) THEN 'signature'
  WHEN mime NOT IN ('', 'application/octet-stream') AND NOT {_TYPED} THEN 'mime' ELSE 'accepted' END AS verdict FROM e""")
def file_intake_audit(spark, sf_dir):
    """Files kept apart after their download."""
    return intake.file_intake_audit(_files(spark, sf_dir))


@query(_FILE + f""" SELECT file_id, name, n AS size_bytes, sha256(c) AS sha256, CASE WHEN ext NOT IN ({_EXTENSIONS(intake.ANALYSIS)}) THEN 'extension' WHEN n = 0 THEN 'empty' WHEN n > {30 << 20} THEN 'too-large' WHEN NOT ({_SIGNED(intake.ANALYSIS)}) THEN 'signature' ELSE 'accepted' END AS verdict FROM e""")
def analysis_intake_audit(spark, sf_dir):
    """The same files before their analysis."""
    return intake.file_intake_audit(_files(spark, sf_dir).drop("mime"), intake.ANALYSIS)


_ITEMS = "SELECT CAST(CAST(ts AS DATE) AS STRING) || '/' || CAST(event_id // 500 AS STRING) AS envelope_id, event_id, CASE WHEN user_id % 19 = 0 THEN '' ELSE ' ' || CAST(user_id AS STRING) || ' ' END AS reference, event_type AS title, CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE CAST(event_id % 900 AS STRING) END AS fee FROM events"


@query(f"""WITH i AS ({_ITEMS}), p AS (SELECT *, row_number() OVER (PARTITION BY envelope_id ORDER BY event_id) - 1 AS pos FROM i WHERE envelope_id NOT LIKE '%5'), t AS (SELECT *, trim(reference) AS r FROM p)
SELECT envelope_id, envelope_id AS sync_id, r AS reference, min(pos) AS pos, arg_max(title, pos) AS title, coalesce(TRY_CAST(arg_max(fee, pos) AS DOUBLE), 0) AS fee FROM t WHERE r <> '' GROUP BY envelope_id, r""")
def envelope_parse(spark, sf_dir):
    """One JSON envelope for each day and 500 ids of events; those whose name ends in 5 carry an unknown schema version."""
    items = view(spark, sf_dir, "events").selectExpr("CAST(CAST(ts AS DATE) AS STRING) || '/' || CAST(event_id div 500 AS STRING) AS envelope_id", "event_id", "CASE WHEN user_id % 19 = 0 THEN '' ELSE ' ' || CAST(user_id AS STRING) || ' ' END AS reference", "event_type AS title", "CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE CAST(event_id % 900 AS STRING) END AS fee")
    nested = items.groupBy("envelope_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "reference", "title", "fee"))), lambda x: x.dropFields("event_id")).alias("items"))
    body = F.to_json(F.struct(F.when(F.col("envelope_id").endswith("5"), 2).otherwise(1).alias("schema_version"), F.lit(intake.KNOWN_SOURCE).alias("source"), F.col("envelope_id").alias("sync_id"), "items"))
    found, _ = intake.envelope_parse(nested.select("envelope_id", body.alias("body")))
    return found.select("envelope_id", "sync_id", "reference", "pos", "title", "fee")


@query()
def board_csv_export(spark, sf_dir):
    t = view(spark, sf_dir, "tenders").withColumns({"files": F.lit(None).cast("string"), "notes": F.when(F.col("k") % 2 == 0, 'قال "نعم"')})
    return intake.board_csv(t)


@query("SELECT o_orderstatus, CAST(extract(year FROM o_orderdate) AS INT) AS run, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY ALL")
def table_sources(spark, sf_dir):
    """Orders written as a table partitioned by run, read back by its schema and rolled up."""
    from ..sources.storage import scratch

    orders = view(spark, sf_dir, "orders").withColumn("run", F.year("o_orderdate").cast("int"))
    path = scratch(spark)
    intake.write_table(orders, path, "run")
    return intake.read_table(spark, path, orders.schema).groupBy("o_orderstatus", "run").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(with_views("tenders", body="SELECT reference, title, fee, 'unknown' AS fee_verification, 60 AS score FROM tenders WHERE k % 2 = 0 UNION ALL SELECT reference, title, fee, fee_verification, score FROM tenders WHERE k % 2 = 1"))
def schema_evolve(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    return intake.schema_evolve(t.where("k % 2 = 0").select("reference", "title", "fee"), t.where("k % 2 = 1").select("reference", "title", "fee", "fee_verification", "score"), {"fee_verification": "unknown", "score": 60})


@query("""WITH e AS (SELECT doc_id AS path, sha256(text) AS e FROM documents WHERE doc_id % 9 <> 0), a AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS a FROM documents WHERE doc_id % 8 <> 0)
SELECT path, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'unregistered' WHEN a <> e THEN 'checksum' ELSE 'ok' END AS verdict FROM e FULL OUTER JOIN a USING (path)""")
def snapshot_audit(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    expected = d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    actual = d.where("doc_id % 8 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return intake.snapshot_audit(expected, actual)


_TABLES = ("region", "nation", "customer", "supplier", "orders")


@query("""WITH e(name, rows) AS (SELECT 'region', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'nation', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'customer', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'ledger', count(*) FROM region)
, a(name, rows) AS (""" + " UNION ALL ".join(f"SELECT '{t}', count(*) FROM {t}" for t in _TABLES) + """)
SELECT name, CASE WHEN a.rows IS NULL THEN 'missing' WHEN e.rows IS NULL THEN 'unregistered' WHEN a.rows <> e.rows THEN 'row-count' ELSE 'ok' END AS verdict FROM e FULL OUTER JOIN a USING (name)""")
def snapshot_count_audit(spark, sf_dir):
    """Tables and their rows against a manifest of the keys that other tables refer to."""
    keys = {"region": ("nation", "n_regionkey"), "nation": ("customer", "c_nationkey"), "customer": ("orders", "o_custkey"), "orders": ("lineitem", "l_orderkey")}
    count = lambda name, df, what: df.agg(what.alias("rows")).select(F.lit(name).alias("name"), "rows")
    expected = count("ledger", view(spark, sf_dir, "region"), F.count("*"))
    for name, (table, key) in keys.items():
        expected = expected.unionByName(count(name, view(spark, sf_dir, table), F.count_distinct(key)))
    actual = None
    for name in _TABLES:
        own = count(name, view(spark, sf_dir, name), F.count("*"))
        actual = own if actual is None else actual.unionByName(own)
    return intake.count_audit(expected, actual)
