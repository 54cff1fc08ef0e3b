"""Queries of the board, search, profile and scoring families."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import board, score
from ..sources.adapters import view, with_views
from .catalog import query

NOW = "1996-06-15 00:00:00"
DAYS = f"ceil((epoch(try_strptime(deadline, '%Y-%m-%d %H:%M')) - epoch(TIMESTAMP '{NOW}')) / 86400.0)"
FREE = "(fee = 0 AND fee_verification = 'detail-verified')"
CROWDING = f"""greatest(10, least(90, 52 + CASE WHEN tender_type = 'شراء مباشر' THEN -12 WHEN tender_type = 'منافسة عامة' THEN 8 ELSE 0 END
 + CASE WHEN {FREE} THEN 10 WHEN fee = 0 THEN 0 WHEN fee >= 500 THEN -7 ELSE 3 END
 + CASE WHEN coalesce(guarantee, '') LIKE '%لا يوجد%' THEN 8 WHEN coalesce(guarantee, '') LIKE '%ضمان%' THEN -8 ELSE 0 END + CASE WHEN n_attachments >= 7 THEN -6 ELSE 0 END
 + CASE WHEN region LIKE '%الرياض%' OR region LIKE '%مكة%' OR region LIKE '%الشرقية%' THEN 5 ELSE 0 END + CASE WHEN region = 'غير محددة' THEN -4 ELSE 0 END
 + CASE WHEN {DAYS} <= 5 THEN -9 WHEN {DAYS} >= 18 THEN 5 ELSE 0 END))"""
_DETAILS = """, details_ AS (SELECT reference AS r, CASE WHEN k % 4 = 0 THEN '' ELSE title || ' +' END AS d_title, CASE WHEN k % 6 = 0 THEN NULL ELSE 'جهة ' || agency END AS d_agency FROM tenders WHERE k % 3 = 0)"""


def _details(t):
    payload = F.to_json(F.struct(F.expr("CASE WHEN k % 4 = 0 THEN '' ELSE title || ' +' END").alias("title"), F.expr("CASE WHEN k % 6 = 0 THEN NULL ELSE 'جهة ' || agency END").alias("agency")))
    return t.where("k % 3 = 0").select("reference", payload.alias("payload"))


@query(with_views("tenders", body=_DETAILS + f"""
SELECT reference, coalesce(nullif(d_title, ''), nullif(title, '')) AS title, coalesce(nullif(d_agency, ''), nullif(agency, '')) AS agency, nullif(region, '') AS region, nullif(published_at, '') AS published_at, nullif(activity, '') AS activity, nullif(tender_type, '') AS tender_type,
 coalesce(nullif(status, ''), 'جديدة') AS status, coalesce(score, 60) AS score, coalesce(nullif(deadline, ''), '{board.PLACEHOLDER_DEADLINE}') AS deadline, fee, fee_verification FROM tenders LEFT JOIN details_ ON reference = r"""))
def tender_projection(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    return board.tender_projection(t, _details(t))


@query(with_views("tenders", body="""
SELECT reference, title, fee, deadline FROM tenders WHERE lower(concat_ws(' ', title, agency, reference, region, status)) LIKE '%طرق%' AND (region LIKE '%الرياض%' OR lower(region) LIKE '%china%' OR lower(region) LIKE '%متعدد%' OR lower(region) LIKE '%france%')
 AND coalesce(platform_status, 'المنافسات النشطة (تقديم العروض)') = 'المنافسات النشطة (تقديم العروض)' AND (activity IS NULL OR activity = 'BUILDING' OR activity = '')
 AND published_at >= '1993-01-01' AND (deadline = 'أدخل الموعد' OR substring(deadline, 1, 10) >= '1993-06-01') AND (deadline = 'أدخل الموعد' OR substring(deadline, 1, 10) <= '1998-06-01') AND fee >= 10 AND fee <= 900"""))
def tender_filter(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    return board.tender_filter(t, query=" طرق ", regions=("منطقة الرياض", "CHINA", "متعدد", "FRANCE"), platform_status=board.ACTIVE, activity="BUILDING", published_after="1993-01-01", deadline_from="1993-06-01", deadline_to="1998-06-01", fee_mode="range", fee_min=10, fee_max=900).select("reference", "title", "fee", "deadline")


@query(with_views("tenders", body=f"SELECT reference, {CROWDING} AS crowding, score FROM tenders ORDER BY crowding, score DESC, reference"))
def tender_sort(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    return board.tender_sort(t.withColumn("crowding", score.crowding_score(NOW)), "crowding").select("reference", "crowding", "score")


@query(with_views("tenders", "attachments", body=_DETAILS + """, states AS (SELECT reference AS s, status AS user_status FROM tenders WHERE k % 4 <> 0)
, files_ AS (SELECT reference AS f, string_agg(display_name || '=' || availability, ';' ORDER BY display_name, availability) AS files FROM attachments GROUP BY reference)
SELECT reference, title, user_status, d_title, coalesce(files, '') AS files FROM tenders LEFT JOIN states ON reference = s LEFT JOIN details_ ON reference = r LEFT JOIN files_ ON reference = f"""))
def tender_board(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    states = t.where("k % 4 <> 0").select("reference", F.col("status").alias("user_status"))
    details = t.where("k % 3 = 0").selectExpr("reference", "CASE WHEN k % 4 = 0 THEN '' ELSE title || ' +' END AS d_title")
    out = board.tender_board(t, states, details, view(spark, sf_dir, "attachments"))
    return out.select("reference", "title", "user_status", "d_title", F.array_join(F.transform("files", lambda x: F.concat(x["display_name"], F.lit("="), x["availability"])), ";").alias("files"))


_JOBS = """WITH findings AS (SELECT doc_id AS job_id, unnest(range(0, len(l))) AS pos, unnest(l) AS statement FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
, runs_ AS (SELECT conv_id AS job_id, turn AS pos, role AS provider FROM conversations)"""


@query(_JOBS + """, f AS (SELECT job_id, string_agg(statement, ' / ' ORDER BY pos, statement) AS findings FROM findings GROUP BY job_id), r AS (SELECT job_id, string_agg(provider, ',' ORDER BY pos, provider) AS runs FROM runs_ GROUP BY job_id)
SELECT l.doc_id AS job_id, d.n_chars AS n_chars, f.findings, r.runs FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id LEFT JOIN f ON l.doc_id = f.job_id LEFT JOIN r ON l.doc_id = r.job_id""")
def job_bundle(spark, sf_dir):
    docs, conv = view(spark, sf_dir, "documents"), view(spark, sf_dir, "conversations")
    findings = docs.select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("pos", "statement"))
    runs = conv.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("pos"), F.col("role").alias("provider"))
    jobs = view(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), F.col("doc_id").alias("document_id"))
    out = board.job_bundle(jobs, docs.select(F.col("doc_id").alias("document_id"), "n_chars"), findings, runs)
    return out.select("job_id", "n_chars", F.array_join("findings.statement", " / ").alias("findings"), F.array_join("runs.provider", ",").alias("runs"))


@query("""WITH subs AS (SELECT DISTINCT p_brand AS activity, p_type AS sub FROM part WHERE p_size > 3), s AS (SELECT activity, string_agg(sub, '|' ORDER BY sub) AS subs FROM subs GROUP BY activity)
SELECT b.activity, coalesce(s.subs, '') AS subs FROM (SELECT DISTINCT p_brand AS activity FROM part) b LEFT JOIN s USING (activity)""")
def catalog_tree(spark, sf_dir):
    part = view(spark, sf_dir, "part")
    out = board.catalog_tree(part.select(F.col("p_brand").alias("activity")).distinct(), part.where("p_size > 3").select(F.col("p_brand").alias("activity"), F.col("p_type").alias("sub_activity")).distinct())
    return out.select("activity", F.array_join("subs", "|").alias("subs"))


SEARCHES = [(1, "طرق الرياض مجاني"), (2, "صيانة"), (3, "000000000005"), (4, "مدفوعة تطوير"), (5, "حدائق"), (6, "Customer#000000001"), (7, "هذا الشهر شبكات")]
_CHIPS = {1: "title_ LIKE '%طرق%' AND region LIKE '%الرياض%' AND fee = 0", 2: "title_ LIKE '%صيانة%'", 3: "reference = '000000000005'", 4: "fee > 0 AND concat_ws(' ', title, agency) LIKE '%تطوير%'", 5: "title_ LIKE '%حدائق%'", 6: "concat_ws(' ', title, agency) LIKE '%Customer#000000001%'",
          7: f"concat_ws(' ', title, agency) LIKE '%شبكات%' AND try_strptime(deadline, '%Y-%m-%d %H:%M') BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 30 DAY"}


@query(with_views("tenders", body=", t AS (SELECT *, concat_ws(' ', activity, title) AS title_ FROM tenders), hits AS (" + " UNION ALL ".join(f"SELECT {i} AS search_id, reference FROM t WHERE {c}" for i, c in _CHIPS.items()) + """)
SELECT search_id, place, reference, n_hits FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY reference) AS place, count(*) OVER (PARTITION BY search_id) AS n_hits FROM hits) h WHERE place <= 8"""))
def saved_search_match(spark, sf_dir):
    searches = spark.createDataFrame(SEARCHES, "search_id int, text string")
    return board.saved_search_match(searches, view(spark, sf_dir, "tenders"), NOW)


_PROFILES = """SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name || CASE WHEN c_custkey % 40 = 1 THEN '' ELSE '' END END AS name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS activity_id,
 CASE WHEN c_custkey % 3 = 0 THEN 'المنافسات النشطة (تقديم العروض)' ELSE 'منتهية' END AS platform_status, CAST(c_custkey % 7 - 1 AS DOUBLE) AS fee_min, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 11 AS DOUBLE) END AS fee_max,
 CAST(c_custkey % 150 AS INT) AS target, c_custkey % 2 = 0 AS enabled, c_custkey % 4 AS n_subs, c_nationkey FROM customer"""


def _profiles(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    return c.selectExpr(
        "c_custkey AS profile_id", "CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS name", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS activity_id",
        f"CASE WHEN c_custkey % 3 = 0 THEN '{board.ACTIVE}' ELSE 'منتهية' END AS platform_status", "CAST(c_custkey % 7 - 1 AS DOUBLE) AS fee_min", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 11 AS DOUBLE) END AS fee_max",
        "CAST(c_custkey % 150 AS INT) AS target", "c_custkey % 2 = 0 AS enabled",
        "CASE WHEN c_custkey % 4 = 0 THEN array() ELSE transform(sequence(1, CAST(c_custkey % 4 AS INT)), i -> CAST(i + c_nationkey % 3 AS STRING)) END AS sub_ids",
        "array(CAST(c_nationkey AS STRING), '3', '99') AS regions",
    )


def _activities(spark, sf_dir):
    names = view(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("activity_id")).distinct()
    return names.select("activity_id", F.concat(F.lit("نشاط "), "activity_id").alias("activity_name"), F.when(F.col("activity_id") != "BUILDING", F.length("activity_id").cast("string")).alias("portal_value"))


def _subs(spark):
    return spark.createDataFrame([("1", "BUILDING", "فرع أ"), ("2", "MACHINERY", "فرع ب"), ("3", "BUILDING", "فرع ج"), ("4", "FURNITURE", "فرع د")], "sub_id string, activity_id string, sub_name string")


_SUBS = """, subs(sub_id, owner, sub_name) AS (VALUES ('1', 'BUILDING', 'فرع أ'), ('2', 'MACHINERY', 'فرع ب'), ('3', 'BUILDING', 'فرع ج'), ('4', 'FURNITURE', 'فرع د'))
, sub_of AS (SELECT profile_id, activity_id, CAST(i + c_nationkey % 3 AS STRING) AS sub_id FROM p, range(1, 4) r(i) WHERE i <= n_subs)
, acts AS (SELECT DISTINCT c_mktsegment AS act, 'نشاط ' || c_mktsegment AS activity_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(length(c_mktsegment) AS STRING) END AS portal_value FROM customer)"""


@query(f"WITH p AS ({_PROFILES})" + _SUBS + """, named AS (SELECT profile_id, string_agg(sub_name, '|' ORDER BY sub_name) AS sub_names FROM sub_of LEFT JOIN subs USING (sub_id) GROUP BY profile_id)
, b AS (SELECT p.profile_id, activity_name, portal_value, coalesce(sub_names, '') AS sub_names, concat_ws(',', CASE WHEN activity_id IS NULL OR activity_name IS NULL THEN 'no-activity' END, CASE WHEN activity_name IS NOT NULL AND portal_value IS NULL THEN 'no-portal-value' END,
  CASE WHEN n_subs > 0 THEN 'sub-activities' END, CASE WHEN platform_status <> 'المنافسات النشطة (تقديم العروض)' THEN 'status' END) AS blockers FROM p LEFT JOIN acts ON activity_id = act LEFT JOIN named USING (profile_id))
SELECT *, blockers = '' AS sync_ready FROM b""")
def profile_resolve(spark, sf_dir):
    subs = _subs(spark).select("sub_id", "sub_name")
    out = board.profile_resolve(_profiles(spark, sf_dir), _activities(spark, sf_dir), subs)
    return out.select("profile_id", "activity_name", "portal_value", F.array_join("sub_names", "|").alias("sub_names"), F.array_join("blockers", ",").alias("blockers"), "sync_ready")


@query(f"WITH p AS ({_PROFILES})" + _SUBS + """, alien AS (SELECT profile_id, max(CAST(coalesce(owner <> activity_id, TRUE) AS INT)) AS alien FROM sub_of LEFT JOIN subs USING (sub_id) GROUP BY profile_id)
, same_ AS (SELECT name, count(*) AS n FROM p GROUP BY name), on_ AS (SELECT count(*) AS n_on FROM p WHERE enabled)
SELECT p.profile_id, concat_ws(',', CASE WHEN NOT (length(trim(p.name)) BETWEEN 1 AND 120) THEN 'name' END, CASE WHEN act IS NULL THEN 'activity' END, CASE WHEN alien = 1 THEN 'sub-activity' END, CASE WHEN fee_min < 0 THEN 'fee-min' END,
  CASE WHEN fee_max < fee_min THEN 'fee-max' END, CASE WHEN n > 1 THEN 'duplicate-name' END, CASE WHEN enabled AND n_on > 1 THEN 'several-enabled' END) AS codes, greatest(1, least(100, target)) AS target,
  CASE WHEN c_nationkey BETWEEN 1 AND 13 THEN CAST(c_nationkey AS STRING) || ',3' ELSE '3' END AS regions
FROM p LEFT JOIN (SELECT DISTINCT act FROM acts) a ON activity_id = act LEFT JOIN alien USING (profile_id) LEFT JOIN same_ ON p.name = same_.name CROSS JOIN on_""")
def profile_audit(spark, sf_dir):
    return board.profile_audit(_profiles(spark, sf_dir), _activities(spark, sf_dir), _subs(spark))


@query(f"""WITH p AS ({_PROFILES}), r AS (SELECT CAST(i AS STRING) AS region_id FROM range(1, 14) t(i)), b(bucket_id) AS (VALUES ('free'), ('paid-1-1000'))
SELECT profile_id, region_id, bucket_id, greatest(1, least(100, target)) AS target, concat_ws('|', 'activity:' || activity_id, 'region:' || region_id, 'fee:' || CAST(CAST(coalesce(fee_min, 0) AS BIGINT) AS STRING) || '-' || CAST(CAST(coalesce(fee_max, 600) AS BIGINT) AS STRING)) AS scope_key
FROM p, r, b WHERE enabled AND region_id IN (CAST(c_nationkey AS STRING), '3', '99') AND ((bucket_id = 'free' AND coalesce(fee_min, 0) <= 0) OR (bucket_id <> 'free' AND coalesce(fee_max, 600) > 0))""")
def scan_scope_expand(spark, sf_dir):
    regions = spark.range(1, 14).select(F.col("id").cast("string").alias("region_id"))
    return board.scan_scope_expand(_profiles(spark, sf_dir), regions, spark.createDataFrame([("free",), ("paid-1-1000",)], "bucket_id string"))


@query(with_views("attachments", "tenders", body="""SELECT a.reference, min(display_name) AS file FROM attachments a WHERE a.reference IN (SELECT reference FROM tenders WHERE k % 3 = 0) GROUP BY a.reference HAVING count(*) = 1"""))
def allowlist_gate(spark, sf_dir):
    requests = view(spark, sf_dir, "attachments").groupBy("reference").agg(F.array_sort(F.collect_list("display_name")).alias("files"))
    return board.allowlist_gate(requests, view(spark, sf_dir, "tenders").where("k % 3 = 0")).select("reference", F.col("files")[0].alias("file"))


# --- scores ---------------------------------------------------------------------------------------


def _sql_fold(column: str) -> str:
    return f"replace(translate(lower(coalesce({column}, '')), 'أإآة', 'اااه'), 'ـ', '')"


def _points(words: str) -> str:
    folded = [w.lower().translate(str.maketrans("أإآة", "اااه")).replace("ـ", "") for w in words.split("|")]
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN 3 WHEN contains(f, '{w}') THEN 1 ELSE 0 END" for w in folded)


CLASSES = (
    f""", folded AS (SELECT reference, k, {_sql_fold('title')} AS t, {_sql_fold("concat_ws(' ', nullif(agency, ''), nullif(activity, ''), nullif(tender_type, ''))")} AS f FROM tenders)
, points AS (""" + " UNION ALL ".join(f"SELECT reference, {i} AS ord, '{code}' AS code, {_points(words)} AS p FROM folded" for i, (code, words) in enumerate(score.RULEBOOK)) + """)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY p DESC, ord) AS rn, sum(p) OVER (PARTITION BY reference) AS total FROM points WHERE p > 0)
, classes AS (SELECT folded.reference, folded.k, CASE WHEN coalesce(a.p * 1.0 / a.total, 0) >= 0.5 THEN a.code ELSE 'general-works' END AS specialty_code, coalesce(floor(CAST(a.p AS DOUBLE) / a.total * 100 + 0.5) / 100, 0) AS confidence, b.code AS runner_up,
  CASE WHEN a.p * 1.0 / a.total < 0.5 THEN a.code END AS demoted FROM folded LEFT JOIN ranked a ON folded.reference = a.reference AND a.rn = 1 LEFT JOIN ranked b ON folded.reference = b.reference AND b.rn = 2)"""
)


@query(with_views("tenders", body=CLASSES + "SELECT reference, specialty_code, confidence, runner_up, demoted FROM classes"))
def specialty_classify(spark, sf_dir):
    return score.specialty_classify(view(spark, sf_dir, "tenders"))


@query(with_views("tenders", body=CLASSES + """, stored AS (SELECT reference, 'roads' AS specialty_code, 0.25 AS confidence FROM tenders WHERE k % 2 = 0), new_ AS (SELECT reference, specialty_code, confidence FROM classes WHERE k % 5 <> 0)
SELECT * FROM stored WHERE reference NOT IN (SELECT reference FROM new_) UNION ALL SELECT * FROM new_"""))
def classification_store(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    stored = t.where("k % 2 = 0").select("reference", F.lit("roads").alias("specialty_code"), F.lit(0.25).alias("confidence"))
    return score.classification_store(stored, score.specialty_classify(t), t.where("k % 5 <> 0"))


@query(with_views("tenders", body=CLASSES + "SELECT count(*) FILTER (WHERE k % 5 <> 0) AS classified, count(*) FILTER (WHERE k % 5 = 0) AS skipped FROM classes"))
def classification_counts(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    return score.classification_counts(score.specialty_classify(t), t.where("k % 5 <> 0"))


@query(with_views("tenders", body=f"""SELECT reference, greatest(25, least(90, 60 + CASE WHEN fee >= 500 THEN 6 ELSE 0 END + CASE WHEN regexp_matches(title, 'صيانة|ترميم|تأهيل|إنشاء|إصلاح|تطوير') THEN 8 ELSE 0 END
  - CASE WHEN CASE WHEN deadline = '' THEN 10 ELSE {DAYS} END <= 2 THEN 8 ELSE 0 END)) AS suitability FROM tenders"""))
def suitability_score(spark, sf_dir):
    return view(spark, sf_dir, "tenders").select("reference", score.suitability_score(NOW).alias("suitability"))


@query(with_views("tenders", body=f""", s AS (SELECT *, {CROWDING} AS crowding, {DAYS} AS d FROM tenders)
SELECT reference, crowding, CASE WHEN crowding <= 38 THEN 'منخفض' WHEN crowding <= 62 THEN 'متوسط' ELSE 'مرتفع' END AS level,
  CASE WHEN coalesce(tender_type, '') <> '' AND coalesce(guarantee, '') <> '' AND region <> '' AND deadline <> '' THEN 'متوسطة' ELSE 'منخفضة' END AS confidence,
  concat_ws(',', CASE tender_type WHEN 'شراء مباشر' THEN 'direct' WHEN 'منافسة عامة' THEN 'public' END, CASE WHEN {FREE} THEN 'free' WHEN fee = 0 THEN 'fee-unverified' WHEN fee >= 500 THEN 'fee-high' ELSE 'fee-low' END,
  CASE WHEN guarantee LIKE '%لا يوجد%' THEN 'no-guarantee' WHEN guarantee LIKE '%ضمان%' THEN 'guarantee' END, CASE WHEN n_attachments >= 7 THEN 'many-files' END, CASE WHEN region LIKE '%الرياض%' OR region LIKE '%مكة%' OR region LIKE '%الشرقية%' THEN 'big-region' END,
  CASE WHEN region = 'غير محددة' THEN 'no-region' END, CASE WHEN d <= 5 THEN 'short' WHEN d >= 18 THEN 'long' END) AS factors FROM s"""))
def crowding_signal(spark, sf_dir):
    return score.crowding_signal(view(spark, sf_dir, "tenders"), NOW)


_REVIEW_COLUMNS = (
    "reference",
    "k % 2 = 0 AS booklet",
    "CASE WHEN k % 3 = 0 THEN NULL ELSE k % 5 <> 0 END AS boq",
    "k % 7 <> 0 AS conditions",
    "CASE k % 6 WHEN 0 THEN 'غير مطابق' WHEN 1 THEN NULL ELSE 'مطابق' END AS scope_fit",
    "CASE k % 8 WHEN 0 THEN 'غير مطابق' ELSE 'مطابق' END AS classification",
    "CASE k % 9 WHEN 0 THEN 'غير متاح' WHEN 1 THEN 'غير معروف' ELSE 'متاح' END AS guarantee_state",
    "CASE k % 10 WHEN 0 THEN 'توجد ملاحظة حرجة' WHEN 1 THEN NULL ELSE 'تمت المراجعة' END AS special_terms",
)
_REVIEW = f"SELECT {', '.join(_REVIEW_COLUMNS)} FROM tenders"


@query(with_views("tenders", body=f""", v AS ({_REVIEW}), m AS (SELECT *, concat_ws(',', CASE WHEN NOT coalesce(booklet, FALSE) THEN 'booklet' END, CASE WHEN NOT coalesce(boq, FALSE) THEN 'boq' END, CASE WHEN NOT coalesce(conditions, FALSE) THEN 'conditions' END) AS missing,
  concat_ws(',', CASE WHEN scope_fit = 'غير مطابق' THEN 'scope' END, CASE WHEN classification = 'غير مطابق' THEN 'classification' END, CASE WHEN guarantee_state = 'غير متاح' THEN 'guarantee' END, CASE WHEN special_terms = 'توجد ملاحظة حرجة' THEN 'terms' END) AS risks FROM v)
SELECT reference, missing, risks, CASE WHEN coalesce(scope_fit, '') = 'غير مطابق' OR classification = 'غير مطابق' OR guarantee_state = 'غير متاح' THEN 'استبعاد مبدئي'
  WHEN missing = '' AND scope_fit = 'مطابق' AND classification = 'مطابق' AND guarantee_state NOT IN ('غير معروف', 'غير متاح') AND special_terms = 'تمت المراجعة' THEN 'مناسب مبدئيًا' ELSE 'مطلوب استكمال' END AS decision FROM m"""))
def assessment_decision(spark, sf_dir):
    return score.assessment_decision(view(spark, sf_dir, "tenders").selectExpr(*_REVIEW_COLUMNS))


@query(with_views("tenders", body="""SELECT region, CASE WHEN fee = 0 THEN CASE WHEN fee_verification = 'detail-verified' THEN 'مجانية مؤكدة' ELSE 'السعر غير متحقق' END WHEN fee_verification = 'detail-verified' THEN 'مؤكد من التفاصيل'
  WHEN fee_verification = 'card-observed' THEN 'من القائمة' ELSE 'غير مؤكد' END AS label, count(*) AS n FROM tenders GROUP BY ALL"""))
def fee_evidence_mix(spark, sf_dir):
    return score.fee_evidence_mix(view(spark, sf_dir, "tenders"))


@query(with_views("tenders", body=f"SELECT reference, {CROWDING} AS crowding, score, row_number() OVER (ORDER BY {CROWDING}, score DESC, reference) AS rank FROM tenders ORDER BY rank LIMIT 3"))
def priority_topk(spark, sf_dir):
    return score.priority_topk(view(spark, sf_dir, "tenders"), NOW)
