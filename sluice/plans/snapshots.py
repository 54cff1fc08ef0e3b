"""Queries of the incremental snapshot family."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import merge
from ..sources.adapters import view, with_views
from .catalog import query

RANK = "CASE {0} WHEN 'detail-verified' THEN 2 WHEN 'card-observed' THEN 1 ELSE 0 END"
NOW = "2026-01-01"


@query(with_views("observations", body="""
SELECT sync_run_id, reference, region_id, region_name, fee_bucket, page_number, title, agency, fee, fee_verification, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY sync_run_id, reference, region_id ORDER BY seq DESC) AS rn FROM observations) t WHERE rn = 1"""))
def observation_upsert(spark, sf_dir):
    return merge.observation_upsert(view(spark, sf_dir, "observations"))


@query(with_views("observations", body="""
SELECT sync_run_id, reference, region_id, fee_bucket, page_number, fee, place, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY sync_run_id, region_id ORDER BY CASE WHEN fee_bucket = 'free' THEN 0 ELSE 1 END, page_number, reference, seq) AS place FROM observations) t
WHERE place <= 100 AND (fee_bucket = 'free' OR fee BETWEEN 0 AND 600)"""))
def region_cap(spark, sf_dir):
    return merge.region_cap(view(spark, sf_dir, "observations")).select("sync_run_id", "reference", "region_id", "fee_bucket", "page_number", "fee", "place", "seq")


@query(with_views("observations", body=f""", firsts AS (
  SELECT sync_run_id, reference, region_name, min(seq) AS first_seen FROM observations GROUP BY ALL)
, labels_ AS (SELECT sync_run_id, reference, string_agg(region_name, '، ' ORDER BY first_seen, region_name) AS names, count(*) AS n_regions FROM firsts GROUP BY ALL)
, picked AS (SELECT sync_run_id, reference, arg_min(title, seq) AS title, arg_min(agency, seq) AS agency,
    arg_max(fee, {RANK.format('fee_verification')} * 1000 + seq) FILTER (WHERE fee IS NOT NULL) AS fee,
    coalesce(arg_max(fee_verification, {RANK.format('fee_verification')} * 1000 + seq) FILTER (WHERE fee IS NOT NULL), 'unknown') AS fee_verification
  FROM observations GROUP BY ALL)
SELECT sync_run_id, reference, title, agency, fee, fee_verification, CASE WHEN n_regions > 1 THEN 'متعدد المناطق: ' || names ELSE names END AS region, n_regions
FROM picked JOIN labels_ USING (sync_run_id, reference)"""))
def appearance_merge(spark, sf_dir):
    return merge.appearance_merge(view(spark, sf_dir, "observations"))


_CLEAN = "trim(translate(coalesce(fee_text, ''), '٠١٢٣٤٥٦٧٨٩٫٬', '0123456789.,'))"


@query(with_views("fee_texts", body=f""", plain AS (SELECT *, {_CLEAN} AS p FROM fee_texts)
, parsed AS (SELECT *, list_distinct(list_transform(regexp_extract_all(p, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE))) AS vals,
  regexp_matches(p, '(?:^|\\s)[−-]\\s*\\d') AS negative FROM plain)
, valued AS (SELECT *, CASE WHEN NOT negative AND len(vals) = 1 THEN vals[1] END AS v, regexp_matches(source_url, '^https://tenders\\.etimad\\.sa/[Tt]ender/[Dd]etails([Ff]or[Ss]upplier)?(/|\\?|$)') AS trusted_ FROM parsed)
SELECT k, line, seq, fee_text, source_url, v AS fee, CASE WHEN v IS NULL THEN 'unknown' ELSE 'card-observed' END AS fee_verification, trusted_ AS trusted, CASE WHEN trusted_ THEN v END AS detail_fee FROM valued"""))
def fee_evidence(spark, sf_dir):
    return merge.fee_evidence(view(spark, sf_dir, "fee_texts"))


_PREV = "CASE WHEN p.fee_verification IN ('unknown', 'card-observed', 'detail-verified') THEN p.fee_verification ELSE 'unknown' END"
_BETTER = f"(i.fee_verification <> 'unknown' AND i.fee >= 0 AND {RANK.format('i.fee_verification')} >= {RANK.format(_PREV)})"


@query(with_views("snapshot_prev", "incoming", body=f"""
SELECT i.reference, i.title, i.agency, i.region, i.deadline, i.published_at, i.platform_status, i.activity, i.k,
  CASE WHEN p.reference IS NULL THEN CASE WHEN i.fee_verification = 'unknown' THEN 0 ELSE coalesce(i.fee, 0) END WHEN {_BETTER} THEN i.fee ELSE CASE WHEN p.fee >= 0 THEN p.fee ELSE 0 END END AS fee,
  CASE WHEN p.reference IS NULL OR {_BETTER} THEN i.fee_verification ELSE {_PREV} END AS fee_verification
FROM incoming i LEFT JOIN snapshot_prev p USING (reference)"""))
def fee_evidence_merge(spark, sf_dir):
    return merge.fee_evidence_merge(view(spark, sf_dir, "snapshot_prev"), view(spark, sf_dir, "incoming"))


@query(with_views("snapshot_prev", "incoming", "tenders", body="""
SELECT reference, title, agency, fee FROM incoming WHERE reference NOT IN (SELECT reference FROM snapshot_prev) AND reference NOT IN (SELECT reference FROM tenders WHERE k % 50 = 0)"""))
def new_tenders(spark, sf_dir):
    baseline = view(spark, sf_dir, "tenders").where("k % 50 = 0")
    return merge.new_tenders(view(spark, sf_dir, "snapshot_prev"), view(spark, sf_dir, "incoming"), baseline).select("reference", "title", "agency", "fee")


@query(with_views("snapshot_prev", "incoming", body="""
SELECT i.reference, i.title, i.agency, i.fee, i.region FROM incoming i JOIN snapshot_prev p USING (reference) WHERE p.title <> '' AND (i.title IS DISTINCT FROM p.title OR i.agency IS DISTINCT FROM p.agency
  OR i.fee IS DISTINCT FROM p.fee OR i.region IS DISTINCT FROM p.region OR i.deadline IS DISTINCT FROM p.deadline OR i.published_at IS DISTINCT FROM p.published_at)"""))
def changed_tenders(spark, sf_dir):
    return merge.changed_tenders(view(spark, sf_dir, "snapshot_prev"), view(spark, sf_dir, "incoming")).select("reference", "title", "agency", "fee", "region")


_LOG = " UNION ALL ".join(f"SELECT i.reference, '{c}' AS field, {'printf(chr(37) || chr(46) || chr(49) || chr(102), p.fee)' if c == 'fee' else 'p.' + c} AS old_value, {'printf(chr(37) || chr(46) || chr(49) || chr(102), i.fee)' if c == 'fee' else 'i.' + c} AS new_value FROM incoming i JOIN snapshot_prev p USING (reference) WHERE i.{c} IS DISTINCT FROM p.{c}" for c in merge.LOGGED)


@query(with_views("snapshot_prev", "incoming", body=_LOG))
def change_log(spark, sf_dir):
    return merge.change_log(view(spark, sf_dir, "snapshot_prev"), view(spark, sf_dir, "incoming"))


#: The columns that the views lack, told apart by side.
_MORE = {
    "sub_activity": "activity || ' {0}'", "tender_type": "CASE WHEN k % 2 = 0 THEN 'منافسة عامة {0}' END", "etimad_url": "'https://portal/{0}/' || reference", "tender_number": "CAST(k AS STRING) || '{0}'", "contract_duration": "CAST(k % 36 AS STRING) || ' شهر {0}'",
    "guarantee": "CASE WHEN k % 3 = 0 THEN '{0}' END", "location": "region || '{0}'", "quantity_summary": "'q{0}' || CAST(k % 9 AS STRING)", "attachment_names": "'[\"{0}' || CAST(k % 4 AS STRING) || '\"]'", "fee_raw_text": "CAST(fee AS STRING) || '{0}'", "source_hash": "md5(title || '{0}')",
}
_WIDE = lambda side: ", ".join(f"{e.format(side)} AS {n}" for n, e in _MORE.items())
_UP = tuple(c for c in merge.SNAPSHOT_COLUMNS if c != "region")


@query(with_views("snapshot_prev", "incoming", body=f""", p AS (SELECT *, {_WIDE('p')}, CASE WHEN k % 2 = 0 THEN published_at END AS fee_verified_at FROM snapshot_prev), i AS (SELECT *, {_WIDE('i')} FROM incoming)
SELECT coalesce(p.reference, i.reference) AS reference, {", ".join(f"CASE WHEN i.reference IS NOT NULL THEN i.{c} ELSE p.{c} END AS {c}" for c in _UP)}, fee_verified_at,
  CASE WHEN i.reference IS NOT NULL THEN coalesce(nullif(i.region, ''), 'غير محددة') ELSE p.region END AS region,
  CASE WHEN i.reference IS NOT NULL THEN TRUE WHEN p.activity = 'BUILDING' THEN FALSE ELSE p.active END AS active,
  coalesce(p.first_seen, '{NOW}') AS first_seen, CASE WHEN i.reference IS NOT NULL THEN '{NOW}' ELSE p.last_seen END AS last_seen
FROM p FULL OUTER JOIN i ON p.reference = i.reference"""))
def snapshot_upsert(spark, sf_dir):
    wide = lambda name, side: view(spark, sf_dir, name).selectExpr("*", *[f"{e.format(side)} AS {n}" for n, e in _MORE.items()])
    return merge.snapshot_upsert(wide("snapshot_prev", "p").withColumn("fee_verified_at", F.expr("CASE WHEN k % 2 = 0 THEN published_at END")), wide("incoming", "i"), NOW, "BUILDING")


@query(with_views("snapshot_prev", "incoming", body="""
SELECT p.reference, p.activity, p.active AND NOT (coalesce(p.activity = 'MACHINERY', FALSE) AND i.reference IS NULL) AS active FROM snapshot_prev p LEFT JOIN (SELECT DISTINCT reference FROM incoming) i USING (reference)"""))
def snapshot_deactivate(spark, sf_dir):
    return merge.snapshot_deactivate(view(spark, sf_dir, "snapshot_prev"), view(spark, sf_dir, "incoming"), "MACHINERY", True).select("reference", "activity", "active")


@query(with_views("tenders", "incoming", body=""", states AS (SELECT reference, status, CAST('مكتملة' AS STRING) AS documents, score FROM tenders WHERE k % 4 <> 0)
SELECT * FROM states UNION ALL SELECT DISTINCT reference, 'جديدة', 'بانتظار الكراسة', 60 FROM incoming WHERE reference NOT IN (SELECT reference FROM states)"""))
def user_state_init(spark, sf_dir):
    states = view(spark, sf_dir, "tenders").where("k % 4 <> 0").select("reference", "status", F.lit("مكتملة").alias("documents"), "score")
    return merge.user_state_init(states, view(spark, sf_dir, "incoming"))


_ATT = """, known AS (SELECT reference, display_name, min('file') AS kind, min(availability) AS availability, TRUE AS visible FROM attachments WHERE k % 3 <> 0 GROUP BY reference, display_name)
, listed AS (SELECT DISTINCT reference, display_name, 'listed' AS kind FROM attachments WHERE k % 2 = 0 AND size_bytes > 30000000)"""


@query(with_views("attachments", body=_ATT + """, read_ AS (SELECT DISTINCT reference AS r FROM listed), both_ AS (
SELECT coalesce(a.reference, l.reference) AS reference, coalesce(a.display_name, l.display_name) AS display_name, a.kind AS a_kind, l.kind AS l_kind, a.availability, a.visible, l.reference IS NOT NULL AS now_
FROM known a FULL OUTER JOIN listed l ON a.reference = l.reference AND a.display_name = l.display_name)
SELECT reference, display_name, coalesce(l_kind, a_kind) AS kind, CASE WHEN now_ AND coalesce(availability, 'unknown') = 'unknown' THEN 'metadata-only' ELSE availability END AS availability,
  CASE WHEN now_ THEN TRUE WHEN r IS NOT NULL THEN FALSE ELSE visible END AS visible FROM both_ LEFT JOIN read_ ON reference = r"""))
def attachment_merge(spark, sf_dir):
    a = view(spark, sf_dir, "attachments")
    known = a.where("k % 3 <> 0").groupBy("reference", "display_name").agg(F.lit("file").alias("kind"), F.min("availability").alias("availability"), F.lit(True).alias("visible"))
    listed = a.where("k % 2 = 0 and size_bytes > 30000000").select("reference", "display_name", F.lit("listed").alias("kind")).distinct()
    return merge.attachment_merge(known, listed)


@query(with_views("attachments", "tenders", body="""
SELECT a.reference, a.display_name, a.size_bytes, CASE WHEN a.availability = 'free-available' AND t.reference IS NOT NULL THEN 'restricted' ELSE a.availability END AS availability, a.k
FROM attachments a LEFT JOIN (SELECT DISTINCT reference FROM tenders WHERE fee > 0 AND fee_verification = 'detail-verified') t USING (reference)"""))
def availability_demote(spark, sf_dir):
    return merge.availability_demote(view(spark, sf_dir, "attachments"), view(spark, sf_dir, "tenders"))


_OWN = ", ".join(f"'{c[:3]} ' || CAST(k % 7 AS STRING) AS {c}" for c in merge.DETAIL_COLUMNS if c not in ("tender_type", "guarantee")) + ", CASE WHEN k % 5 = 0 THEN '9' END AS fee_raw_text, CAST(NULL AS STRING) AS fee_verified_at"
_GIVEN = ", ".join(f"CASE WHEN k % {i + 3} = 0 THEN '' WHEN k % {i + 4} = 0 THEN NULL ELSE 'd{i} ' || title END AS {c}" for i, c in enumerate(merge.DETAIL_COLUMNS))
_DETAILS = f"SELECT reference, CASE k % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' END AS status, '2025-03-0' || CAST(1 + k % 9 AS STRING) AS inspected_at, CASE k % 5 WHEN 0 THEN 'http://tenders.etimad.sa/Tender/Details/1' ELSE 'https://tenders.etimad.sa/Tender/Details/' || CAST(k AS STRING) END AS source_url, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '1 أو 2' ELSE CAST(k % 900 AS STRING) || ' ريال' END AS booklet_fee, {_GIVEN} FROM tenders WHERE k % 3 = 0"
_PATCHED = ("reference", *merge.DETAIL_COLUMNS, "fee", "fee_verification", "fee_raw_text", "fee_verified_at")


@query(with_views("tenders", body=f""", t AS (SELECT *, {_OWN} FROM tenders), d AS (SELECT *, CASE WHEN coalesce(status, 'complete') <> 'failed' AND starts_with(source_url, 'https://') AND booklet_fee NOT IN ('', '1 أو 2') THEN CAST(split_part(booklet_fee, ' ', 1) AS DOUBLE) END AS f FROM ({_DETAILS}) d0)
SELECT t.reference, {", ".join(f"coalesce(nullif(d.{c}, ''), t.{c}) AS {c}" for c in merge.DETAIL_COLUMNS)}, coalesce(d.f, t.fee) AS fee, CASE WHEN d.f IS NOT NULL THEN 'detail-verified' ELSE t.fee_verification END AS fee_verification,
  CASE WHEN d.f IS NOT NULL THEN d.booklet_fee ELSE t.fee_raw_text END AS fee_raw_text, CASE WHEN d.f IS NOT NULL THEN d.inspected_at ELSE t.fee_verified_at END AS fee_verified_at FROM t LEFT JOIN d USING (reference)"""))
def detail_patch(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    details = t.where("k % 3 = 0").selectExpr(*_select_list(_DETAILS))
    return merge.detail_patch(t.selectExpr("*", *_select_list(f"SELECT {_OWN} FROM tenders")), details).select(*_PATCHED)


def _select_list(sql: str) -> list[str]:
    """The columns of a SELECT, split at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for ch in sql[len("SELECT ") : sql.rindex(" FROM ")]:
        quoted ^= ch == "'"
        depth += (ch in "([") - (ch in ")]") if not quoted else 0
        if ch == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out]


# reads of a page: the time remaining stands in a field and on the line after its label
_SECTION = "'النوع' || chr(10) || event_type || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'الوقت المتبقي' ELSE 'الوقت المتبقى' END || ' ' || chr(10) || CAST(event_id AS STRING) || ' يوم' || chr(10) || 'المجموعة' || chr(10) || CAST(event_id % 3 AS STRING)"
_STABLE = """to_json(json_object('fields', json_object('group', CAST(event_id % 3 AS STRING), 'type', event_type), 'sections', [json_object('title', 's', 'text', regexp_replace(section, '(الوقت المتبق[ىي]\\s*\\n)[^\\n]+', '\\1[قيمة متغيرة]', 'g'))], 'attachments', ['a.pdf'], 'pageTitle', 'صفحة', 'sourceUrl', ''))"""
_READ = f"""WITH r AS (SELECT CAST(user_id AS STRING) AS reference, event_id AS inspected_at, event_id, event_type, {_SECTION} AS section FROM events), h AS (SELECT *, sha256(CAST({_STABLE} AS STRING)) AS content_hash FROM r)"""


def _reads(spark, sf_dir):
    e = view(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS reference", "event_id AS inspected_at", "event_id", "event_type", f"{_SECTION} AS section")
    fields = F.create_map(F.lit("type"), F.col("event_type"), F.lit("timeRemaining"), F.col("event_id").cast("string"), F.lit("group"), (F.col("event_id") % 3).cast("string"))
    return e.select("reference", "inspected_at", fields.alias("fields"), F.array(F.struct(F.lit("s").alias("title"), F.col("section").alias("text"))).alias("sections"), F.array(F.lit("a.pdf")).alias("attachments"), F.lit("صفحة").alias("page_title"), F.lit(None).cast("string").alias("source_url"))


@query(_READ + """, f AS (SELECT reference, content_hash, min(inspected_at) AS inspected_at, count(*) AS reads FROM h GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY reference ORDER BY inspected_at, content_hash) AS version FROM f""")
def detail_history(spark, sf_dir):
    return merge.detail_history(_reads(spark, sf_dir)).drop("payload")


@query(_READ + " SELECT reference, max(inspected_at) AS inspected_at, arg_max(event_type, inspected_at) AS type, arg_max(content_hash, inspected_at) AS content_hash FROM h GROUP BY reference")
def detail_current(spark, sf_dir):
    return merge.detail_current(_reads(spark, sf_dir)).select("reference", "inspected_at", F.col("fields")["type"].alias("type"), "content_hash")


@query(f"""WITH cat AS (SELECT p_brand AS name_ar, CASE WHEN min(p_size) > 1 THEN min(p_type) END AS portal_value, '2025-01-01' AS last_seen FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_brand)
, seen AS (SELECT p_type AS name_ar, min(p_brand) AS portal_value FROM part GROUP BY p_type UNION ALL SELECT p_brand, max(p_type) FROM part WHERE p_partkey % 5 = 0 GROUP BY p_brand)
, new_ AS (SELECT name_ar, min(portal_value) AS v FROM seen GROUP BY name_ar)
SELECT 'act-' || substr(sha256(name_ar), 1, 12) AS activity_id, name_ar, coalesce(portal_value, v) AS portal_value, CASE WHEN new_.v IS NOT NULL THEN '{NOW}' ELSE last_seen END AS last_seen FROM cat FULL OUTER JOIN new_ USING (name_ar)""")
def catalog_upsert(spark, sf_dir):
    part = view(spark, sf_dir, "part")
    catalog = part.where("p_partkey % 3 <> 0").groupBy(F.col("p_brand").alias("name_ar")).agg(F.when(F.min("p_size") > 1, F.min("p_type")).alias("portal_value"), F.lit("2025-01-01").alias("last_seen"))
    seen = part.groupBy(F.col("p_type").alias("name_ar")).agg(F.min("p_brand").alias("portal_value")).union(part.where("p_partkey % 5 = 0").groupBy("p_brand").agg(F.max("p_type")))
    return merge.catalog_upsert(catalog, seen, NOW)


@query(f"""WITH cat AS (SELECT DISTINCT p_brand AS activity FROM part WHERE p_size > 2), subs AS (SELECT DISTINCT p_brand AS activity, p_type AS sub_activity, '2025-01-01' AS last_seen FROM part WHERE p_partkey % 4 = 0)
, seen AS (SELECT DISTINCT p_brand AS activity, p_type AS sub_activity FROM part WHERE p_partkey % 3 <> 0), known AS (SELECT *, TRUE AS seen FROM seen WHERE activity IN (SELECT activity FROM cat))
SELECT 'sub-' || substr(sha256(activity || ':' || sub_activity), 1, 12) AS sub_id, activity, sub_activity, CASE WHEN seen THEN '{NOW}' ELSE last_seen END AS last_seen FROM subs FULL OUTER JOIN known USING (activity, sub_activity)""")
def sub_catalog_upsert(spark, sf_dir):
    part = view(spark, sf_dir, "part").withColumns({"activity": F.col("p_brand"), "sub_activity": F.col("p_type")})
    subs = part.where("p_partkey % 4 = 0").select("activity", "sub_activity", F.lit("2025-01-01").alias("last_seen")).distinct()
    return merge.sub_catalog_upsert(part.where("p_size > 2").select(F.col("activity").alias("name_ar")), subs, part.where("p_partkey % 3 <> 0").select("activity", "sub_activity"), NOW)


_APP = """WITH requests AS (SELECT event_id, user_id AS approval_id, CASE WHEN event_id % 4 = 0 THEN 'all' WHEN event_id % 9 = 1 THEN NULL ELSE event_type END AS scope FROM events)
, approvals AS (SELECT user_id AS approval_id, CASE WHEN user_id % 11 = 0 OR user_id % 23 = 0 THEN NULL ELSE min(event_type) END AS approved_scope, CASE WHEN user_id % 13 = 0 OR user_id % 23 = 0 THEN NULL ELSE max(ts) END AS expires_at, CASE WHEN user_id % 19 = 0 OR user_id % 23 = 0 THEN NULL ELSE min(ts) END AS requested_at, user_id % 7 = 0 AS revoked, user_id % 5 = 0 AS consumed FROM events WHERE user_id % 17 <> 0 GROUP BY user_id)"""
_AT = "2024-01-20 00:00:00"


@query(_APP + f"""
SELECT r.event_id, r.approval_id, r.scope, CASE WHEN r.approval_id NOT IN (SELECT approval_id FROM approvals) THEN 'not-found' WHEN revoked THEN 'revoked' WHEN consumed THEN 'consumed' WHEN expires_at <= TIMESTAMP '{_AT}' THEN 'expired'
  WHEN approved_scope IS NULL OR expires_at IS NULL OR requested_at IS NULL THEN 'revoked' WHEN scope IS NOT NULL AND approved_scope <> scope THEN 'scope-mismatch' ELSE 'usable' END AS verdict FROM requests r LEFT JOIN approvals a USING (approval_id)""")
def approval_ledger(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    requests = e.selectExpr("event_id", "user_id AS approval_id", "CASE WHEN event_id % 4 = 0 THEN 'all' WHEN event_id % 9 = 1 THEN NULL ELSE event_type END AS scope")
    none = lambda n, v: F.expr(f"CASE WHEN user_id % {n} = 0 OR user_id % 23 = 0 THEN NULL ELSE {v} END")
    approvals = e.where("user_id % 17 <> 0").groupBy("user_id").agg(none(11, "min(event_type)").alias("approved_scope"), none(13, "max(ts)").alias("expires_at"), none(19, "min(ts)").alias("requested_at")).withColumnRenamed("user_id", "approval_id")
    approvals = approvals.withColumns({"revoked": F.col("approval_id") % 7 == 0, "consumed": F.col("approval_id") % 5 == 0})
    return merge.approval_ledger(requests, approvals, _AT).select("event_id", "approval_id", "scope", "verdict")


_FILES = """, files AS (SELECT reference, CASE WHEN k % 37 = 5 THEN '  ' ELSE ' ' || display_name END AS display_name, CASE WHEN k % 13 = 4 THEN -size_bytes ELSE size_bytes END AS size_bytes, row_number() OVER (PARTITION BY reference ORDER BY display_name DESC, size_bytes NULLS FIRST, availability) AS pos FROM attachments WHERE k % 2 = 0 OR size_bytes > 60000000)
, known AS (SELECT reference, display_name, max(CASE WHEN k % 29 = 3 THEN 'withdrawn' ELSE availability END) AS availability FROM attachments WHERE k % 8 <> 0 GROUP BY reference, display_name)"""
_OK_EXT, _OK_AV = (", ".join(f"'{x}'" for x in xs) for xs in (merge.ALLOWED, merge.AVAILABILITIES))


@query(with_views("attachments", body=_FILES + f""", once AS (SELECT reference, trim(display_name) AS name, first(greatest(size_bytes, 0) ORDER BY pos) AS given, first(size_bytes ORDER BY pos) IS NULL AS open_ FROM files GROUP BY reference, trim(display_name))
, sized AS (SELECT reference, name, CASE WHEN NOT open_ THEN given END AS size_bytes FROM once WHERE name <> '')
, coded AS (SELECT s.*, CASE WHEN coalesce(lower(regexp_extract(name, '\\.([^.]+)$', 1)), '') NOT IN ({_OK_EXT}) THEN 'extension' WHEN availability IS NULL THEN 'not-listed' WHEN availability NOT IN ({_OK_AV}) THEN 'availability' WHEN size_bytes > {100 << 20} THEN 'file-size' END AS code FROM sized s LEFT JOIN known ON s.reference = known.reference AND name = display_name)
, per AS (SELECT reference, count(*) AS n, sum(size_bytes) AS total, count(size_bytes) AS known_, arg_min(code, name) FILTER (WHERE code IS NOT NULL) AS code, min(name) FILTER (WHERE code IS NOT NULL) AS bad, string_agg('[' || CAST(to_json(name) AS STRING) || ',' || coalesce(CAST(size_bytes AS STRING), 'null') || ']', ',' ORDER BY name) AS listed FROM coded GROUP BY reference)
SELECT r.reference, coalesce(n, 0) AS n_files, CASE WHEN n IS NULL THEN 'no-files' WHEN n > 5 THEN 'count' WHEN code IS NOT NULL THEN code WHEN known_ = n AND total > {300 << 20} THEN 'batch-size' ELSE 'ok' END AS verdict, CASE WHEN n <= 5 THEN bad END AS failing_file,
  sha256('{{"tenderReference":"' || r.reference || '","files":[' || coalesce(listed, '') || ']}}') AS manifest_hash FROM (SELECT DISTINCT reference FROM files) r LEFT JOIN per ON r.reference = per.reference"""))
def manifest_audit(spark, sf_dir):
    a = view(spark, sf_dir, "attachments")
    order = W.partitionBy("reference").orderBy(F.col("display_name").desc(), "size_bytes", "availability")
    asked = a.where("k % 2 = 0 or size_bytes > 60000000").withColumn("pos", F.row_number().over(order))
    files = asked.selectExpr("reference", "CASE WHEN k % 37 = 5 THEN '  ' ELSE ' ' || display_name END AS display_name", "CASE WHEN k % 13 = 4 THEN -size_bytes ELSE size_bytes END AS size_bytes", "pos")
    return merge.manifest_audit(files, a.where("k % 8 <> 0").withColumn("availability", F.expr("CASE WHEN k % 29 = 3 THEN 'withdrawn' ELSE availability END")))


#: Attachments in the order listed: by size, the unknown first, names backwards.
_QUEUE = """, q AS (SELECT reference, display_name, row_number() OVER (PARTITION BY reference ORDER BY size_bytes NULLS FIRST, display_name DESC, availability) AS place FROM attachments)"""


def _queue(spark, sf_dir, **policy):
    order = W.partitionBy("reference").orderBy("size_bytes", F.col("display_name").desc(), "availability")
    return merge.download_queue_build(view(spark, sf_dir, "attachments").withColumn("pos", F.row_number().over(order)), **policy)


@query(with_views("attachments", body=_QUEUE + " SELECT reference, display_name, 'proposed' AS state, place FROM q WHERE place <= 5"))
def download_queue_build(spark, sf_dir):
    return _queue(spark, sf_dir).select("reference", "display_name", "state", "place")


@query(with_views("attachments", body=_QUEUE + " SELECT count(*) AS rows_created, 0 AS proposed, count(*) AS auto_approved FROM q WHERE place <= 3"))
def download_queue_summary(spark, sf_dir):
    """Under a policy that approves at once, three files to a tender."""
    return merge.download_queue_summary(_queue(spark, sf_dir, per_tender=3, auto_approve=True))
