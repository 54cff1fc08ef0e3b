"""Queries of detail pages and text corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import detail
from ..sources.adapters import view, with_views
from .catalog import query

_S1 = "'اسم المنافسة: ' || title || chr(10) || 'الجهة الحكومية' || chr(10) || agency || chr(10) || 'قيمة الكراسة：' || CAST(CAST(fee AS BIGINT) AS STRING) || ' ر.س' || chr(10) || 'ملاحظة عامة'"
_S2 = "'النشاط الأساسي' || chr(10) || 'التفاصيل' || chr(10) || coalesce(activity, 'الضمان النهائي') || chr(10) || 'نطاق العمل:' || chr(10) || 'اسم المنافسة: مكرر'"


@query(with_views("tenders", body="""SELECT reference, 'title' AS field, title AS value FROM tenders UNION ALL SELECT reference, 'agency', agency FROM tenders UNION ALL SELECT reference, 'bookletFee', CAST(CAST(fee AS BIGINT) AS STRING) || ' ر.س' FROM tenders
UNION ALL SELECT reference, 'activity', coalesce(activity, 'اسم المنافسة: مكرر') FROM tenders WHERE activity IS NOT NULL
UNION ALL SELECT reference, 'description', 'اسم المنافسة: مكرر' FROM tenders UNION ALL SELECT reference, 'activity', 'اسم المنافسة: مكرر' FROM tenders WHERE FALSE UNION ALL SELECT reference, 'finalGuarantee', 'اسم المنافسة: مكرر' FROM tenders WHERE activity IS NULL"""))
def detail_field_extract(spark, sf_dir):
    t = view(spark, sf_dir, "tenders")
    first = t.selectExpr("reference", "1 AS section_ord", "'المعلومات' AS name", f"{_S1.replace('chr(10)', 'char(10)')} AS text")
    second = t.selectExpr("reference", "2 AS section_ord", "'التفاصيل' AS name", f"{_S2.replace('chr(10)', 'char(10)')} AS text")
    return detail.detail_field_extract(first.union(second))


@query(with_views("attachments", body=r""", c AS (SELECT reference, CASE WHEN k % 5 = 0 THEN 'شراء الكراسة' WHEN k % 5 = 1 THEN upper(display_name) ELSE display_name END AS text, CASE WHEN k % 7 = 0 THEN NULL ELSE replace(display_name, ' ', '%20') END AS file_name, row_number() OVER (PARTITION BY reference ORDER BY display_name, size_bytes, availability) AS pos FROM attachments)
, v AS (SELECT reference, pos, list_filter([text, replace(coalesce(file_name, ''), '%20', ' ')], lambda x: length(x) > 0 AND NOT regexp_matches(x, '^(تحميل الملف|ملفات داعمة|المرفق)$|شراء|انضمام') AND (regexp_matches(lower(x), '\.(pdf|xlsx?|docx?|pptx?|zip|rar|7z)\b') OR regexp_matches(x, 'كراسة|جدول.*كم|كميات|الغرامات|الجزاءات|معايير.*(العروض|التقييم)|المحتوى المحلي|نموذج|ملحق')))[1] AS display_name FROM c)
, o AS (SELECT reference, lower(display_name) AS k, arg_min(display_name, pos) AS display_name FROM v WHERE display_name IS NOT NULL GROUP BY ALL)
SELECT reference, display_name, CASE WHEN regexp_matches(lower(display_name), 'جدول.*كم|كميات|boq') THEN 'boq' WHEN regexp_matches(lower(display_name), 'غرام|جزاء|penalt') THEN 'penalties' WHEN regexp_matches(lower(display_name), 'evaluation') THEN 'evaluation' WHEN regexp_matches(display_name, 'شرط|مواصف|كراسة') THEN 'booklet' ELSE 'supporting' END AS kind FROM o"""))
def attachment_names(spark, sf_dir):
    from pyspark.sql.window import Window as W

    a = view(spark, sf_dir, "attachments").selectExpr("reference", "CASE WHEN k % 5 = 0 THEN 'شراء الكراسة' WHEN k % 5 = 1 THEN upper(display_name) ELSE display_name END AS text", "CASE WHEN k % 7 = 0 THEN NULL ELSE replace(display_name, ' ', '%20') END AS file_name", "display_name", "size_bytes", "availability")
    return detail.attachment_names(a.withColumn("pos", F.row_number().over(W.partitionBy("reference").orderBy("display_name", "size_bytes", "availability"))))


@query("""WITH t AS (SELECT conv_id AS reference, max(turn) % 4 AS tab_count FROM conversations GROUP BY conv_id), r AS (SELECT conv_id AS reference, count(*) AS n FROM conversations WHERE turn % 3 <> 1 AND text <> '' GROUP BY conv_id)
SELECT reference, tab_count AS expected, coalesce(n, 0) AS sections_read, CASE WHEN CASE WHEN tab_count = 0 THEN coalesce(n, 0) > 0 ELSE coalesce(n, 0) >= tab_count END THEN 'complete' ELSE 'partial' END AS status,
  CASE WHEN tab_count > 0 AND coalesce(n, 0) < tab_count THEN 'قراءة ناقصة: قُرئ ' || CAST(coalesce(n, 0) AS STRING) || ' من ' || CAST(tab_count AS STRING) || ' أقسام متوقعة رغم ظهور تبويبات التفاصيل؛ الوسم partial وليس complete.' END AS reason,
  NOT (CASE WHEN tab_count = 0 THEN coalesce(n, 0) > 0 ELSE coalesce(n, 0) >= tab_count END) AS retry FROM t LEFT JOIN r USING (reference)""")
def detail_completeness(spark, sf_dir):
    c = view(spark, sf_dir, "conversations")
    tabs = c.groupBy(F.col("conv_id").alias("reference")).agg((F.max("turn") % 4).alias("tab_count"))
    return detail.detail_completeness(c.where("turn % 3 <> 1").select(F.col("conv_id").alias("reference"), F.col("role").alias("name"), "text"), tabs)


_DIRTY = "CASE doc_id % 5 WHEN 0 THEN 'ar-SA ' || text || ' Page 3 of 12' WHEN 1 THEN '• ' || text WHEN 2 THEN 'ابجد هوز' || chr(10) || text ELSE text END"
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '\bar-SA\b', ' ', 'g'), '\bPage\s+\d+\s+of\s+\d+\b', ' ', 'g'), '[•▪◦·]+', ' ', 'g'), '\s{2,}', ' ', 'g'))"""


@query(f"""WITH d AS (SELECT doc_id, source, {_DIRTY} AS t FROM documents), c AS (SELECT *, list_filter(list_transform(string_split({_CLEAN}, chr(10)), lambda x: CASE WHEN length(regexp_replace(trim(x), '[^؀-ۿ]', '', 'g')) > 0.7 * length(regexp_replace(trim(x), '\\s', '', 'g')) THEN reverse(trim(x)) ELSE trim(x) END), lambda x: x <> '') AS l FROM d)
SELECT doc_id, source, md5(array_to_string(l, chr(10))) AS cleaned_md5, length(t) - length(array_to_string(l, chr(10))) AS removed_chars FROM c""")
def text_cleanup(spark, sf_dir):
    d = view(spark, sf_dir, "documents").selectExpr("doc_id", "source", f"{_DIRTY.replace('chr(10)', 'char(10)')} AS text")
    return detail.text_cleanup(d).select("doc_id", "source", F.md5("cleaned").alias("cleaned_md5"), (F.length("text") - F.length("cleaned")).cast("long").alias("removed_chars"))


_FOLDS = {
    "classifier": "translate(lower(surface), 'أإآةـ', 'اااه')",
    "board": "replace(lower(trim(surface)), 'ـ', '')",
    "claim": f"translate(regexp_replace(lower(nfc_normalize(surface)), '{text.MARKS}', '', 'g'), '{text.FOLDED}٠١٢٣٤٥٦٧٨٩', '{text.FOLDED_TO}0123456789')",
    "attachment": "lower(trim(translate(surface, 'أإآىةـ', 'ااايه')))",
}
#: Marked and composed spellings beside the corpora's own words.
_SPELT = "(VALUES ('مُنَافَسَة'), ('منافسه'), ('مـنافسة'), ('أعمال'), ('أعمال'), ('اعمال'), ('مبنى'), ('مبني'), ('١٢٣'), ('123'), ('Ａ')) spelt(surface)"


@query(with_views("tenders", body=r""", w AS (SELECT unnest(string_split_regex(text, '\s+')) AS surface FROM documents UNION ALL SELECT unnest(string_split_regex(title, '\s+')) FROM tenders UNION ALL SELECT surface FROM """ + _SPELT + """), s AS (SELECT surface, count(*) AS n FROM w WHERE surface <> '' GROUP BY surface)
, k AS (""" + " UNION ALL ".join(f"SELECT '{p}' AS profile, surface, n, {e} AS key FROM s" for p, e in _FOLDS.items()) + """)
SELECT profile, key, sum(n) AS n, count(*) AS n_surfaces, first(surface ORDER BY n DESC, surface DESC) AS commonest FROM k GROUP BY profile, key"""))
def match_key_build(spark, sf_dir):
    """The four profiles over documents, tender titles and some marked spellings."""
    corpus = view(spark, sf_dir, "documents").select("text").unionByName(view(spark, sf_dir, "tenders").select(F.col("title").alias("text"))).unionByName(spark.sql(f"SELECT surface AS text FROM {_SPELT.replace('(VALUES', 'VALUES', 1).replace(') spelt', ' AS spelt', 1)}"))
    return detail.match_keys(corpus)


def blocks(spark, sf_dir):
    """Lines of the documents as blocks."""
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", F.posexplode(F.split("text", "\n")).alias("ord", "text"))


BLOCKS = "SELECT doc_id AS document_id, lang, unnest(generate_series(0, len(l) - 1)) AS ord, unnest(l) AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)"
_GATE = """, g AS (SELECT document_id, count(*) AS blocks, avg(CASE WHEN length(trim(text)) <= 2 THEN 1.0 ELSE 0.0 END) AS fragmented, avg(CASE WHEN regexp_matches(trim(text), '^[.,،:؛;\\-–—]+$') THEN 1.0 ELSE 0.0 END) AS punctuation FROM b GROUP BY document_id)
, gates AS (SELECT *, fragmented > 0.9 AS is_fragmented, punctuation > 0.15 AS arabic_lost, fragmented > 0.9 OR punctuation > 0.15 AS needs_alternate FROM g)"""
_WORDS = "SELECT doc_id AS document_id, unnest(string_split(text, ' ')) AS text FROM documents"


@query(f"WITH b AS ({_WORDS})" + _GATE + " SELECT * FROM gates")
def block_quality_gate(spark, sf_dir):
    """Words of each document's whole text as blocks: short ones occur there."""
    words = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", " ")).alias("text"))
    return detail.block_quality_gate(words)


@query(f"WITH b AS ({_WORDS})" + _GATE + " SELECT * FROM gates")
def block_quality_gate_whole(spark, sf_dir):
    """Words of each document's whole text as blocks, split like those of block_quality_gate."""
    words = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", " ")).alias("text"))
    return detail.block_quality_gate(words)


@query(f"WITH b AS ({BLOCKS})" + _GATE + """, a AS (SELECT doc_id AS attempt_id, doc_id // 4 AS document_id, doc_id % 4 AS attempt_ord FROM documents), j AS (SELECT a.*, NOT coalesce(needs_alternate, TRUE) AS usable FROM a LEFT JOIN gates ON attempt_id = gates.document_id)
SELECT document_id, arg_min(attempt_id, attempt_ord + CASE WHEN usable THEN 0 ELSE 100 END) AS attempt_id, arg_min(attempt_ord, attempt_ord + CASE WHEN usable THEN 0 ELSE 100 END) AS attempt_ord, NOT bool_or(usable) AS flagged, count(*) AS attempts FROM j GROUP BY document_id""")
def extraction_choice(spark, sf_dir):
    attempts = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("attempt_id"), F.floor(F.col("doc_id") / 4).alias("document_id"), (F.col("doc_id") % 4).alias("attempt_ord"))
    return detail.extraction_choice(attempts, detail.block_quality_gate(blocks(spark, sf_dir)))
