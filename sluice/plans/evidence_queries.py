"""Queries of the evidence pipeline, grounding, benchmark scoring and envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..sources.adapters import view
from ..sources.storage import scratch, stored
from ..streaming import envelopes
from .catalog import query

CATS = ", ".join(f"'{c}'" for c in ev.CATEGORIES)


def _cat(index: str) -> str:
    """SQL of the category with a number, for both engines."""
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{c}'" for i, c in enumerate(ev.CATEGORIES)) + " END"


def docs(spark, sf_dir):
    return view(spark, sf_dir, "documents")


def blocks(spark, sf_dir):
    """Whole documents as blocks with their places: every third one a pdf, a line a block, twenty to a
    page; a workbook, a line a row, two hundred to a sheet, thirty to a table; or a text document, three
    lines a block, its headings and tables of four blocks in sections."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    threes = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 3).cast("int")), lambda i: F.array_join(F.slice("lines", i * 3 + 1, 3), "\n"))
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' ELSE 'docx' END")
    parted = docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), kind.alias("t"), lines.alias("lines"))
    b = parted.select("document_id", "t", F.posexplode(F.when(F.col("t") == "docx", threes).otherwise(F.col("lines"))).alias("ord", "text"))
    table = "CASE WHEN t = 'xlsx' THEN 'sheet-' || floor(ord / 30) WHEN t = 'docx' AND floor(ord / 4) % 5 = 4 THEN 'tbl-' || floor(ord / 4) END"
    return b.selectExpr(
        "document_id", "ord", "'b' || ord AS block_id", f"CASE WHEN {table} IS NOT NULL THEN 'table-row' WHEN length(text) < 30 THEN 'heading' WHEN t = 'pdf' THEN 'page-text' ELSE 'paragraph' END AS kind", "text", f"{table} AS table_id",
        "CASE WHEN t = 'pdf' THEN CAST(floor(ord / 20) + 1 AS INT) END AS page_number", "CASE WHEN t = 'xlsx' THEN 'ورقة ' || (floor(ord / 200) + 1) END AS sheet_name", "CASE WHEN t = 'xlsx' THEN 'A' || (ord % 200 + 1) || ':D' || (ord % 200 + 1) END AS cell_range", "CASE WHEN t = 'docx' THEN 'القسم ' || (floor(ord / 12) + 1) END AS section",
    )


def _lines(spark, sf_dir):
    """Lines of whole documents of any kind, twenty to a page; a document without a text has none."""
    lines = docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.withColumn("page_number", F.floor(F.col("ord") / 20 + 1).cast("int"))


def _filed(spark, sf_dir):
    return docs(spark, sf_dir).selectExpr("doc_id AS document_id", "sha2(coalesce(text, ''), 256) AS checksum", "CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' ELSE 'docx' END AS document_type")


@query()
def doc_chunk(spark, sf_dir):
    return ev.doc_chunk(blocks(spark, sf_dir)).select("document_id", "ordinal", "chunk_id", F.md5("text").alias("text_md5"), "char_count", F.array_join("block_ids", ",").alias("block_ids"), F.to_json("sources").alias("sources"), F.array_join("table_ids", ",").alias("table_ids"))


def _parts(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return _filed(spark, sf_dir), b, ev.doc_chunk(b)


@query()
def candidate_catalog(spark, sf_dir):
    return ev.candidate_catalog(*_parts(spark, sf_dir))


@query()
def catalog_summary(spark, sf_dir):
    """How many candidates the catalogs have no room for."""
    return ev.catalog_summary(*_parts(spark, sf_dir))


@query()
def catalog_fingerprint(spark, sf_dir):
    return ev.catalog_fingerprint(ev.candidate_catalog(*_parts(spark, sf_dir)))


@query()
def catalog_grounding(spark, sf_dir):
    """The candidates of each document as a report's evidence, held against the chunks: grounded, all."""
    files, b, chunks = _parts(spark, sf_dir)
    chunks = stored(chunks)
    found = ev.candidate_catalog(files, b, chunks).withColumns({"run_id": F.col("document_id"), "pos": F.col("idx"), "evidence_id": F.col("candidate_id")})
    return ev.grounding_check(found, files.select(F.col("document_id").alias("run_id"), "document_id", "document_type"), chunks)


_RULED = "CASE doc_id % 6 WHEN 0 THEN 'الضمان الابتدائي: ' || CAST(doc_id AS STRING) || '%' WHEN 1 THEN 'غرامة تأخير: يومية' WHEN 2 THEN 'البند غير واضح: كذا' WHEN 3 THEN 'سؤال للجهة: متى؟' ELSE 'نص عادي' END"


_ALL_RULES = [*ev.RULES, (ev.RISK[0], "", ev.RISK[1])]
_RULE_SQL = " UNION ALL ".join(
    f"SELECT *, {i} AS rule, '{c}' AS category, '{label}' AS label, " + (f"regexp_extract(text, '{p}', 1)" if i < len(ev.RULES) else f"CASE WHEN regexp_matches(text, '{p}') THEN text ELSE '' END") + " AS hit FROM b" for i, (c, label, p) in enumerate(_ALL_RULES)
)
_STATED = f", h AS (SELECT * FROM ({_RULE_SQL}) WHERE hit <> ''), r AS (SELECT document_id, 0 AS part, ord, rule, block_id, category, CASE WHEN label = '' THEN substring(trim(hit), 1, 160) ELSE label || ': ' || trim(hit) END AS statement, CASE WHEN category IN ('unclearItems', '{ev.RISK[0]}') THEN 'medium' ELSE 'info' END AS severity, substring(text, 1, 200) AS excerpt FROM h)"
_LINED = f"WITH b AS (SELECT doc_id AS document_id, unnest(range(0, len(l))) AS ord, 'b' || CAST(unnest(range(0, len(l))) AS STRING) AS block_id, unnest(l) AS text FROM (SELECT doc_id, string_split(text || chr(10) || {_RULED}, chr(10)) AS l FROM documents))"
#: Chunks of ten lines, the last line of every seventh document in none; a table per conversation, at its document's third line.
_TIED = _LINED + _STATED + """, k AS (SELECT document_id, block_id, 'k' || CAST(ord // 10 AS STRING) AS chunk_id FROM b WHERE NOT (document_id % 7 = 3 AND ord = (SELECT max(ord) FROM b x WHERE x.document_id = b.document_id)))
, t AS (SELECT conv_id AS document_id, count(*) + 1 AS n, string_agg(role || ' = ' || CAST(length(text) AS STRING), '؛ ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id), th AS (SELECT t.*, b.block_id, substring(b.text, 1, 200) AS excerpt FROM t JOIN b ON b.document_id = t.document_id AND ord = 2)
, w AS (SELECT * FROM r UNION ALL SELECT document_id, 1, 0, 0, block_id, 'boqSummary', 'جدول (القسم 1): ' || CAST(n AS STRING) || ' صفًا — الأعمدة: ' || CASE WHEN document_id % 2 = 0 THEN 'البند | الكمية' ELSE 'البند | ملاحظة' END, 'info', excerpt FROM th UNION ALL SELECT document_id, 1, 0, 1, block_id, 'criticalQuantities', 'القسم 1: ' || substring(body, 1, 300), 'info', excerpt FROM th WHERE document_id % 2 = 0)
, f AS (SELECT w.document_id, 'ev-' || CAST(dense_rank() OVER (PARTITION BY w.document_id ORDER BY part, ord, CASE WHEN part = 0 THEN rule END) AS STRING) AS evidence_id, w.block_id, category, statement, severity, excerpt, chunk_id FROM w JOIN k ON w.document_id = k.document_id AND w.block_id = k.block_id)"""


def _ruled_lines(spark, sf_dir):
    planted = docs(spark, sf_dir).selectExpr("doc_id AS document_id", f"text || char(10) || {_RULED} AS text")
    lines = planted.select("document_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.select("document_id", "ord", F.concat(F.lit("b"), "ord").alias("block_id"), "text", F.when(F.col("ord") == 2, "t").alias("table_id"))


def _tied_findings(spark, sf_dir):
    b = _ruled_lines(spark, sf_dir)
    last = b.groupBy("document_id").agg(F.max("ord").alias("last"))
    held = b.join(last, "document_id").where("not (document_id % 7 = 3 and ord = last)")
    chunks = held.groupBy("document_id", F.floor(F.col("ord") / 10).cast("int").alias("ordinal")).agg(F.collect_list("block_id").alias("block_ids")).withColumn("chunk_id", F.concat(F.lit("k"), "ordinal"))
    row = F.array("role", F.length("text").cast("string"))
    body = view(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    header = F.array(F.array(F.lit("البند"), F.when(F.col("document_id") % 2 == 0, "الكمية").otherwise("ملاحظة")))
    tables = body.select("document_id", F.lit(0).alias("table_ord"), F.lit("t").alias("table_id"), F.lit("القسم 1").alias("location"), F.concat(header, "rows").alias("rows"))
    return ev.rule_findings(b, chunks=chunks, tables=tables)


@query(_TIED + " SELECT * FROM f")
def rule_findings(spark, sf_dir):
    """The rules over all lines of the documents with a planted line each, tied to chunks, with tables."""
    return _tied_findings(spark, sf_dir)


@query(_TIED + """, p AS (SELECT document_id, count(DISTINCT evidence_id) AS e, count(*) AS n FROM f GROUP BY document_id)
SELECT doc_id AS document_id, coalesce(e, 0) AS n_evidence, coalesce(n, 0) AS n_findings, CASE WHEN e > 0 THEN 'partial' ELSE 'insufficient' END AS evidence_sufficiency, CASE WHEN e > 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN e > 0 THEN 'ev-1' END AS sufficiency_id FROM documents LEFT JOIN p ON doc_id = document_id""")
def rule_report(spark, sf_dir):
    return ev.rule_report(docs(spark, sf_dir).select(F.col("doc_id").alias("document_id")), _tied_findings(spark, sf_dir))


@query(_LINED + _STATED + " SELECT document_id, 'ev-' || CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY ord, rule) AS STRING) AS evidence_id, block_id, category, statement, severity, excerpt FROM r")
def rule_findings_whole(spark, sf_dir):
    """The same rules without chunks and tables."""
    return ev.rule_findings(_ruled_lines(spark, sf_dir))


# selections: JSON objects whose ids name lines of their document, known ones or not; some break rules
_FINDING = """'{' || CASE WHEN doc_id % 9 = 4 THEN '' ELSE '"severity":"' || CASE WHEN doc_id % 7 = 3 THEN 'huge' ELSE 'info' END || '",' END || '"confidence":"' || CASE WHEN doc_id % 15 = 7 THEN 'sure' ELSE 'medium' END || '","evidenceIds":[' || {ids} || ']' || CASE WHEN doc_id % 16 = 5 THEN ',"statement":"x"' ELSE '' END || '}'"""
_TWO = """'"c' || CAST(doc_id % 3 AS STRING) || '","c' || CAST(doc_id % 4 AS STRING) || '"'"""
_ONE = """CASE WHEN doc_id % 19 = 2 THEN '' ELSE '"c' || CAST(doc_id % 7 AS STRING) || '"' END"""
_LISTS = " || ','  || ".join(f"""'"{c}":' || CASE WHEN doc_id % 23 = 11 AND doc_id % 12 = {i} THEN '"none"' ELSE '[' || CASE WHEN doc_id % 12 = {i} AND doc_id % 21 <> 0 THEN {_FINDING.replace("{ids}", _TWO)} || CASE WHEN doc_id % 2 = 0 THEN ',' || {_FINDING.replace("{ids}", _ONE)} ELSE '' END WHEN (doc_id + 5) % 12 = {i} AND doc_id % 21 <> 0 THEN {_FINDING.replace("{ids}", _ONE)} ELSE '' END || ']' END""" for i, c in enumerate(ev.CATEGORIES))
_SELECTION = f"""CASE WHEN doc_id % 29 = 1 THEN 'nothing' ELSE '{{' || {_LISTS} || ',"evidenceSufficiency":"' || CASE doc_id % 10 WHEN 0 THEN 'sufficient' WHEN 1 THEN 'maybe' WHEN 2 THEN 'insufficient' ELSE 'partial' END || '"' || CASE WHEN doc_id % 17 = 6 THEN '' ELSE ',"confidence":"low"' END
 || ',"sufficiencyEvidenceIds":[' || CASE WHEN doc_id % 11 = 5 THEN '' ELSE '"c' || CAST(doc_id % 5 AS STRING) || '"' END || CASE WHEN doc_id % 18 = 3 THEN ',"c0","c0"' ELSE '' END || ']' || CASE WHEN doc_id % 13 = 8 THEN ',"evidence":[]' ELSE '' END || '}}' END"""


def _selections(spark, sf_dir):
    return docs(spark, sf_dir).selectExpr("doc_id AS selection_id", "doc_id AS document_id", f"{_SELECTION} AS body")


def _candidates(spark, sf_dir):
    """Lines of whole documents of 8 to 400 characters."""
    return _lines(spark, sf_dir).where("length(text) between 8 and 400").select("document_id", F.concat(F.lit("c"), "ord").alias("candidate_id"), F.col("text").alias("excerpt"))


_LINES = "lines AS (SELECT doc_id, unnest(range(0, len(l))) AS ord, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_PICKED = f"""WITH {_LINES}, c AS (SELECT doc_id, 'c' || CAST(ord AS STRING) AS id, line AS excerpt FROM lines WHERE length(line) BETWEEN 8 AND 400), s AS (SELECT doc_id, {_SELECTION} AS body FROM documents)
, t AS (SELECT doc_id, body, CASE WHEN json_valid(body) THEN json_keys(body) END AS keys FROM s), good AS (SELECT * FROM t WHERE keys IS NOT NULL), cats AS (SELECT unnest(range(0, 12)) AS cat_ord, unnest({_listed(ev.CATEGORIES)}) AS cat)
, l AS (SELECT doc_id, cat_ord, cat, json_extract(body, '$.' || cat) AS j FROM good, cats), f AS (SELECT doc_id, cat_ord, cat, unnest(range(0, CAST(json_array_length(j) AS BIGINT))) AS pos, unnest(CAST(j AS JSON[])) AS f FROM l WHERE json_type(j) = 'ARRAY')
, i AS (SELECT doc_id, cat_ord, cat, pos, unnest(range(0, CAST(json_array_length(f, '$.evidenceIds') AS BIGINT))) AS spot, unnest(from_json(json_extract(f, '$.evidenceIds'), '["VARCHAR"]')) AS id FROM f)
, o AS (SELECT doc_id, unnest(range(0, CAST(json_array_length(body, '$.sufficiencyEvidenceIds') AS BIGINT))) AS spot, unnest(from_json(json_extract(body, '$.sufficiencyEvidenceIds'), '["VARCHAR"]')) AS id FROM good)
, per AS (SELECT doc_id, bool_or(list_sort(json_keys(f)) <> ['confidence', 'evidenceIds', 'severity']) AS shape, bool_or(NOT list_contains({_listed(ev.SEVERITIES)}, coalesce(json_extract_string(f, '$.severity'), ''))) AS severity, bool_or(NOT list_contains({_listed(ev.CONFIDENCES)}, coalesce(json_extract_string(f, '$.confidence'), ''))) AS confidence, bool_or(json_array_length(f, '$.evidenceIds') = 0) AS none FROM f GROUP BY doc_id)
, rep AS (SELECT doc_id, bool_or(n > 1) AS repeated FROM (SELECT doc_id, cat_ord, pos, id, count(*) AS n FROM i GROUP BY ALL) GROUP BY doc_id), unk AS (SELECT doc_id, TRUE AS unknown FROM i ANTI JOIN c USING (doc_id, id) GROUP BY doc_id)
, orep AS (SELECT doc_id, bool_or(n > 1) AS o_repeated FROM (SELECT doc_id, id, count(*) AS n FROM o GROUP BY ALL) GROUP BY doc_id), ounk AS (SELECT doc_id, TRUE AS o_unknown FROM o ANTI JOIN c USING (doc_id, id) GROUP BY doc_id), bad AS (SELECT doc_id, bool_or(json_type(j) <> 'ARRAY') AS not_list FROM l GROUP BY doc_id)
, codes AS (SELECT doc_id, CASE WHEN keys IS NULL THEN 'not-an-object' WHEN len(list_filter({_listed(ev.SELECTION_FIELDS)}, lambda x: NOT list_contains(keys, x))) > 0 THEN 'missing-field' ELSE concat_ws(',', CASE WHEN len(list_filter(keys, lambda x: NOT list_contains({_listed(ev.SELECTION_FIELDS)}, x))) > 0 THEN 'unknown-field' END, CASE WHEN not_list THEN 'not-a-list' END, CASE WHEN shape THEN 'finding-fields' END,
  CASE WHEN severity THEN 'severity' END, CASE WHEN confidence THEN 'confidence' END, CASE WHEN none THEN 'evidence-ids' END, CASE WHEN repeated THEN 'repeated-id' END, CASE WHEN unknown THEN 'unknown-id' END, CASE WHEN NOT list_contains({_listed(ev.SUFFICIENCIES)}, json_extract_string(body, '$.evidenceSufficiency')) THEN 'sufficiency' END, CASE WHEN NOT list_contains({_listed(ev.CONFIDENCES)}, json_extract_string(body, '$.confidence')) THEN 'own-confidence' END,
  CASE WHEN o_repeated THEN 'sufficiency-repeated-id' END, CASE WHEN o_unknown THEN 'sufficiency-unknown-id' END, CASE WHEN json_extract_string(body, '$.evidenceSufficiency') IN ('sufficient', 'partial') AND json_array_length(body, '$.sufficiencyEvidenceIds') = 0 THEN 'sufficiency-without-ids' END) END AS codes
  FROM (SELECT doc_id, keys, CASE WHEN keys IS NULL THEN '{{}}' ELSE body END AS body FROM t) LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN unk USING (doc_id) LEFT JOIN orep USING (doc_id) LEFT JOIN ounk USING (doc_id) LEFT JOIN bad USING (doc_id))"""


@query(_PICKED + " SELECT doc_id AS selection_id, codes FROM codes")
def selection_audit(spark, sf_dir):
    return ev.selection_audit(_selections(spark, sf_dir), _candidates(spark, sf_dir))


@query(_PICKED + """, st AS (SELECT doc_id, cat_ord, cat, pos, string_agg(excerpt, '؛ ' ORDER BY spot) AS statement FROM i JOIN c USING (doc_id, id) GROUP BY ALL), once AS (SELECT doc_id, statement, min(cat_ord * 1000 + pos) AS k FROM st GROUP BY ALL)
, r AS (SELECT doc_id, count(*) AS n, string_agg(cat || ':' || CAST(pos AS STRING), ',' ORDER BY cat_ord, pos) AS findings FROM st GROUP BY doc_id), sm AS (SELECT doc_id, string_agg(statement, '؛ ' ORDER BY k) AS summary FROM once GROUP BY doc_id)
, u AS (SELECT doc_id, id, min(k) AS k FROM (SELECT doc_id, id, cat_ord * 1000000 + pos * 1000 + spot AS k FROM i UNION ALL SELECT doc_id, id, 12000000 + spot FROM o) GROUP BY ALL), e AS (SELECT doc_id, string_agg(id, ',' ORDER BY k) AS evidence FROM u GROUP BY doc_id)
SELECT doc_id AS selection_id, CASE WHEN codes <> '' THEN 'invalid' WHEN n IS NULL THEN 'no-findings' ELSE 'ok' END AS status, CASE WHEN codes = '' AND n > 0 THEN md5(summary) END AS summary_md5, CASE WHEN codes = '' AND n > 0 THEN n END AS n_findings, CASE WHEN codes = '' AND n > 0 THEN findings END AS findings, CASE WHEN codes = '' AND n > 0 THEN evidence END AS evidence
FROM codes LEFT JOIN r USING (doc_id) LEFT JOIN sm USING (doc_id) LEFT JOIN e USING (doc_id)""")
def selection_materialize(spark, sf_dir):
    out = ev.selection_materialize(_selections(spark, sf_dir), _candidates(spark, sf_dir))
    place = F.transform("findings", lambda f, i: F.concat(f["category"], F.lit(":"), F.size(F.filter(F.slice("findings", 1, i), lambda g: g["category"] == f["category"])).cast("string")))
    return out.select("selection_id", "status", F.md5("summary").alias("summary_md5"), F.when(F.col("findings").isNotNull(), F.size("findings")).cast("long").alias("n_findings"), F.array_join(place, ",").alias("findings"), F.array_join(F.transform("evidence", lambda e: e["candidate_id"]), ",").alias("evidence"))


_JOB = "'job_' || lpad(CAST({0} AS STRING), 14, '0')"
_OLD = "'ev-' || CAST(CASE WHEN doc_id % 40 = 1 THEN 0 ELSE doc_id % 4 END AS STRING)"
_REKEY = f"""WITH e AS (SELECT doc_id, {_JOB.format('doc_id // 4')} AS job_id, {_OLD} AS evidence_id FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY job_id, evidence_id) AS same FROM e)
, k AS (SELECT job_id, doc_id AS pos, evidence_id, 'ev-' || right(regexp_replace(job_id, '[^A-Za-z0-9]', '', 'g'), 12) || '-' || CAST(n AS STRING) AS new_id, max(same) OVER (PARTITION BY job_id) > 1 AS rejected FROM n)"""


def _job_evidence(spark, sf_dir):
    return docs(spark, sf_dir).selectExpr(f"{_JOB.format('doc_id div 4')} AS job_id", "doc_id AS pos", f"{_OLD} AS evidence_id")


@query(_REKEY + " SELECT * FROM k")
def evidence_rekey(spark, sf_dir):
    return ev.evidence_rekey(_job_evidence(spark, sf_dir))


@query(_REKEY + f""", f AS (SELECT {_JOB.format('conv_id')} AS job_id, turn AS pos, ['ev-' || CAST(turn % 5 AS STRING), 'ev-' || CAST(length(text) % 4 AS STRING)] AS ids FROM conversations), x AS (SELECT job_id, pos, unnest(range(0, 2)) AS spot, unnest(ids) AS evidence_id FROM f)
SELECT job_id, x.pos, string_agg(coalesce(new_id, evidence_id), ',' ORDER BY spot) AS evidence_ids FROM x LEFT JOIN k USING (job_id, evidence_id) WHERE job_id NOT IN (SELECT job_id FROM k WHERE rejected) GROUP BY job_id, x.pos""")
def rekeyed_references(spark, sf_dir):
    """Turns of conversations as findings of the jobs of the same number."""
    f = view(spark, sf_dir, "conversations").selectExpr(f"{_JOB.format('conv_id')} AS job_id", "turn AS pos", "array('ev-' || CAST(turn % 5 AS STRING), 'ev-' || CAST(length(text) % 4 AS STRING)) AS evidence_ids")
    return ev.rekeyed_references(f, ev.evidence_rekey(_job_evidence(spark, sf_dir))).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


# reports whose findings are their documents' lines, dealt to categories by number
_SORTED_LINES = f"WITH {_LINES}, l AS (SELECT doc_id, ord, line, (doc_id + ord) % 12 AS cat FROM lines WHERE line <> ''), named AS (SELECT unnest({_listed(ev.CATEGORIES)}) AS category, unnest(range(0, 12)) AS cat), stored AS (SELECT unnest({_listed(ev.STORED_ORDER)}) AS category, unnest(range(0, 12)) AS place)"


def _stored_reports(spark, sf_dir):
    lines = _lines(spark, sf_dir).where("text <> ''").withColumn("cat", (F.col("document_id") + F.col("ord")) % 12)
    names = F.array(*[F.lit(c) for c in ev.CATEGORIES])
    lines = lines.withColumn("category", F.get(names, F.col("cat").cast("int")))
    f = F.struct("ord", F.col("text").alias("statement"), F.lit("info").alias("severity"), F.lit("medium").alias("confidence"), F.array(F.concat(F.lit("ev-"), "ord")).alias("evidence_ids"))
    per = lines.groupBy("document_id", "category").agg(F.transform(F.array_sort(F.collect_list(f)), lambda x: x.dropFields("ord")).alias("rows"))
    findings = per.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "rows"))).alias("findings"))
    e = F.struct("ord", F.concat(F.lit("ev-"), "ord").alias("evidence_id"), "document_id", F.lit("pdf").alias("source_type"), "page_number", F.col("text").alias("excerpt"), F.lit("all").alias("chunk_id"))
    evidence = lines.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x.dropFields("ord")).alias("evidence"))
    run = F.struct(F.col("lang").alias("provider"), F.col("source").alias("model"), F.lit("succeeded").alias("status"), F.col("n_chars").cast("long").alias("duration_ms"), F.lit("p1").alias("prompt_version"), F.lit("v3").alias("schema_version"), F.lit(None).cast("string").alias("error_code"))
    head = docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), run.alias("run"), F.lit("2025-01-01").alias("finished_at"))
    return head.join(findings, "document_id").join(evidence, "document_id").withColumnRenamed("document_id", "report_id")


@query(_SORTED_LINES + """ SELECT doc_id AS report_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, ord) AS finding_no, category, md5(line) AS statement_md5, 'info' AS severity, 'medium' AS confidence, 'ev-' || CAST(ord AS STRING) AS evidence_ids FROM l JOIN named USING (cat) JOIN stored USING (category)""")
def report_flatten(spark, sf_dir):
    rows = ev.report_flatten(_stored_reports(spark, sf_dir))["findings"]
    return rows.withColumns({"statement_md5": F.md5("statement"), "evidence_ids": F.array_join("evidence_ids", ",")}).drop("statement")


@query(_SORTED_LINES + """ SELECT doc_id AS report_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos, 'ev-' || CAST(ord AS STRING) AS evidence_id, doc_id AS document_id, 'pdf' AS source_type, CAST(ord // 20 + 1 AS INT) AS page_number, md5(line) AS excerpt_md5, 'all' AS chunk_id FROM l""")
def report_flatten_evidence(spark, sf_dir):
    return ev.report_flatten(_stored_reports(spark, sf_dir))["evidence"].withColumn("excerpt_md5", F.md5("excerpt")).drop("excerpt")


@query(_SORTED_LINES + """, n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) SELECT doc_id AS report_id, 'completed' AS job_status, '2025-01-01' AS finished_at, n AS n_findings, n AS n_evidence, lang AS provider, source AS model, 'succeeded' AS run_status, CAST(n_chars AS BIGINT) AS duration_ms, 'p1' AS prompt_version, 'v3' AS schema_version, CAST(NULL AS STRING) AS error_code FROM documents JOIN n USING (doc_id)""")
def report_flatten_jobs(spark, sf_dir):
    """The completed job and the model run of each stored report."""
    rows = ev.report_flatten(_stored_reports(spark, sf_dir))
    return rows["jobs"].withColumnRenamed("status", "job_status").join(rows["runs"].withColumnRenamed("status", "run_status"), "report_id")


@query("""SELECT role AS provider, CASE WHEN turn % 3 = 0 THEN '' ELSE 'm' || CAST(turn % 4 AS STRING) END AS model, count(*) AS runs, count(*) FILTER (WHERE length(text) % 7 = 0) AS failed, round(avg(CASE WHEN conv_id % 5 = 0 THEN 0 ELSE length(text) END), 4) AS mean_ms, max(CASE WHEN conv_id % 5 = 0 THEN 0 ELSE length(text) END) AS max_ms FROM conversations GROUP BY ALL""")
def model_run_outcomes(spark, sf_dir):
    """Turns of conversations as model runs."""
    c = view(spark, sf_dir, "conversations").selectExpr("role AS provider", "CASE WHEN turn % 3 = 0 THEN NULL ELSE 'm' || CAST(turn % 4 AS STRING) END AS model", "CASE WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status", "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE length(text) END AS duration_ms")
    return ev.model_run_outcomes(c)


@query("""SELECT event_type AS status, CASE WHEN user_id % 4 = 0 THEN 'E' || CAST(user_id % 3 AS STRING) END AS error_code, count(*) AS jobs, round(avg(CAST(user_id % 1000 AS DOUBLE)), 4) AS mean_ms, max(user_id % 1000) AS max_ms FROM events GROUP BY ALL""")
def job_outcomes(spark, sf_dir):
    jobs = view(spark, sf_dir, "events").selectExpr("event_type AS status", "CASE WHEN user_id % 4 = 0 THEN 'E' || CAST(user_id % 3 AS STRING) END AS error_code", "ts AS started_at", "ts + make_dt_interval(0, 0, 0, (user_id % 1000) / 1000.0) AS finished_at")
    return ev.job_outcomes(jobs)


_PER_FILE = """WITH p AS (SELECT source AS tender, doc_id AS pos, 'file-' || CAST(doc_id % 90 AS STRING) AS file_name, CASE WHEN doc_id % 6 = 0 THEN 'E' END AS error, CASE doc_id % 3 WHEN 0 THEN 'insufficient' WHEN 1 THEN 'partial' ELSE CASE WHEN doc_id % 2 = 0 THEN 'sufficient' ELSE 'partial' END END AS evidence_sufficiency,
  CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars % 7 + 1 END AS evidence_count, n_chars AS size_bytes, CASE WHEN doc_id % 6 = 0 THEN 'm' || lang END AS message, ['e' || CAST(doc_id % 7 AS STRING), 'e' || CAST(n_chars % 5 AS STRING)] AS ids FROM documents)"""
_BALANCE = _PER_FILE + """, l AS (SELECT tender, file_name, first(coalesce(evidence_count, 0) ORDER BY pos DESC) AS n FROM p GROUP BY ALL), t AS (SELECT tender, count(*) AS files, sum(n) AS evidence, max(n) AS most, count(*) FILTER (WHERE n = 0) AS zero FROM l GROUP BY tender)
, bal AS (SELECT tender, files, evidence, zero, round(CASE WHEN evidence > 0 THEN most * CAST(1 AS DOUBLE) / evidence ELSE 0 END, 4) AS ratio, (evidence > 0 AND most * CAST(1 AS DOUBLE) / evidence >= 0.8) OR zero >= 2 AS unbalanced FROM t)
, b AS (SELECT *, CASE WHEN unbalanced THEN 'التغطية غير متوازنة: ' || CAST(zero AS STRING) || ' من ' || CAST(files AS STRING) || ' ملفات لم تساهم بأدلة' END AS warning FROM bal)"""


def _per_file(spark, sf_dir):
    return docs(spark, sf_dir).selectExpr(
        "source AS tender", "doc_id AS pos", "'file-' || CAST(doc_id % 90 AS STRING) AS file_name", "CASE WHEN doc_id % 6 = 0 THEN 'E' END AS error",
        "CASE doc_id % 3 WHEN 0 THEN 'insufficient' WHEN 1 THEN 'partial' ELSE CASE WHEN doc_id % 2 = 0 THEN 'sufficient' ELSE 'partial' END END AS evidence_sufficiency",
        "CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars % 7 + 1 END AS evidence_count", "n_chars AS size_bytes", "CASE WHEN doc_id % 6 = 0 THEN 'm' || lang END AS message", "array('e' || doc_id % 7, 'e' || n_chars % 5) AS sufficiency_ids",
    )


@query(_BALANCE + " SELECT * FROM b")
def coverage_balance(spark, sf_dir):
    return ev.coverage_balance(_per_file(spark, sf_dir))


@query(_BALANCE + """, r AS (SELECT tender, max(CASE WHEN error IS NULL THEN CASE evidence_sufficiency WHEN 'sufficient' THEN 20 WHEN 'partial' THEN 10 ELSE 0 END + CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END END) AS m, sum(coalesce(evidence_count, 0)) AS total_evidence, string_agg(file_name || ':' || error || ':' || message, ',' ORDER BY pos) FILTER (WHERE error IS NOT NULL) AS errors,
  string_agg(file_name || ':' || CAST(size_bytes AS STRING) || ':' || evidence_sufficiency || ':' || confidence || ':' || coalesce(CAST(evidence_count AS STRING), ''), ',' ORDER BY pos) AS files FROM p GROUP BY tender)
, i AS (SELECT tender, pos, file_name, unnest(range(0, len(ids))) AS spot, unnest(ids) AS id FROM p WHERE error IS NULL), o AS (SELECT tender, id, min(pos * 100 + spot) AS k, arg_min(file_name, pos * 100 + spot) AS file_name FROM i GROUP BY ALL), u AS (SELECT tender, string_agg(id || '@' || file_name, ',' ORDER BY k) AS sufficiency_ids FROM o GROUP BY tender)
SELECT tender, CASE m // 10 WHEN 2 THEN 'sufficient' WHEN 1 THEN 'partial' ELSE 'insufficient' END AS evidence_sufficiency, CASE WHEN unbalanced THEN 'low' ELSE CASE m % 10 WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END END AS confidence, coalesce(sufficiency_ids, '') AS sufficiency_ids, r.files, coalesce(errors, '') AS errors, total_evidence, warning FROM r JOIN b USING (tender) LEFT JOIN u USING (tender)""")
def multidoc_merge(spark, sf_dir):
    out = ev.multidoc_merge(_per_file(spark, sf_dir))
    told = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[F.coalesce(x[n].cast("string"), F.lit("")) for n in names])), ",")
    ids = F.array_join(F.transform("sufficiency_ids", lambda x: F.concat(x["evidence_id"], F.lit("@"), x["file_name"])), ",")
    return out.withColumns({"sufficiency_ids": ids, "files": told("files", "file_name", "size_bytes", "evidence_sufficiency", "confidence", "evidence_count"), "errors": told("errors", "file_name", "code", "message")})


@query(_PER_FILE + """, l AS (SELECT tender, file_name, max(pos) AS pos FROM p WHERE error IS NULL GROUP BY ALL) SELECT tender, file_name, ord AS at, 'e' || CAST(ord AS STRING) AS evidence_id, CAST(ord // 20 + 1 AS INT) AS page_number, md5(line) AS excerpt_md5 FROM l JOIN (SELECT doc_id AS pos, unnest(range(0, len(t))) AS ord, unnest(t) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)) USING (pos)""")
def multidoc_evidence(spark, sf_dir):
    """The lines of the documents as evidence of the files of their number."""
    e = _lines(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("source").alias("tender")), "document_id")
    e = e.select("tender", F.col("document_id").alias("pos"), F.col("ord").alias("at"), F.concat(F.lit("e"), "ord").alias("evidence_id"), "page_number", F.col("text").alias("excerpt"))
    return ev.multidoc_evidence(_per_file(spark, sf_dir), e).withColumn("excerpt_md5", F.md5("excerpt")).drop("excerpt")


# --- envelopes ------------------------------------------------------------------------------------


def _items(spark, sf_dir):
    return view(spark, sf_dir, "events").selectExpr("CAST(CAST(ts AS DATE) AS STRING) AS sync_id", "CAST(user_id AS STRING) AS reference", "event_id AS pos", "' ' || event_type AS title", "CAST(floor(value) AS DOUBLE) AS fee", "CAST(user_id % 3 AS STRING) AS region")


# every sixth envelope is a dry run; the first other one declares some of its references
_DRY = "day(CAST(sync_id AS DATE)) % 6 = 0"
_SIDE = f"SELECT sync_id, {_DRY} AS dry_run FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS STRING) AS sync_id FROM events)"


def _envelopes(spark, sf_dir):
    return _items(spark, sf_dir).select("sync_id").distinct().withColumn("dry_run", F.expr(_DRY))


def _declared(spark, sf_dir):
    number = F.col("reference").cast("int") % 3
    return _items(spark, sf_dir).where(number < 2).select("sync_id", "reference", F.when(number == 0, "new").otherwise("changed").alias("kind")).distinct()


_DIFF = """WITH i AS (SELECT CAST(CAST(ts AS DATE) AS STRING) AS sync_id, CAST(user_id AS STRING) AS reference, event_id AS pos, event_type AS title, coalesce(floor(value), 0) AS fee FROM events), n AS (SELECT sync_id, reference, arg_max(title, pos) AS title, arg_max(fee, pos) AS fee FROM i GROUP BY ALL)
, e AS (""" + _SIDE + """), f AS (SELECT min(sync_id) AS first_sync FROM e WHERE NOT dry_run)
, l AS (SELECT *, lag(title) OVER w AS pt, lag(fee) OVER w AS pf, row_number() OVER w AS rn, min(sync_id) OVER w AS seen, CASE CAST(reference AS INT) % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'unchanged' END AS declared FROM n JOIN e USING (sync_id), f WINDOW w AS (PARTITION BY reference, dry_run ORDER BY sync_id))
, s AS (SELECT *, CASE WHEN dry_run THEN 'unchanged' WHEN sync_id = first_sync THEN declared WHEN rn = 1 THEN 'new' WHEN title <> pt OR fee <> pf THEN 'changed' ELSE 'unchanged' END AS status FROM l)
, d AS (SELECT sync_id, reference, status, CASE WHEN status <> 'changed' THEN '' WHEN sync_id = first_sync THEN 'declared' ELSE concat_ws(',', CASE WHEN title <> pt THEN 'title' END, CASE WHEN fee <> pf THEN 'fee' END) END AS changed_fields,
  CASE WHEN NOT dry_run THEN pt END AS previous_title, CASE WHEN NOT dry_run THEN CAST(pf AS DOUBLE) END AS previous_fee, CASE WHEN NOT dry_run THEN seen END AS first_seen, CASE WHEN NOT dry_run THEN sync_id END AS last_seen, dry_run FROM s)"""


def _shown(diff):
    return diff.select("sync_id", "reference", "status", "changed_fields", F.col("previous.title").alias("previous_title"), F.col("previous.fee").alias("previous_fee"), "first_seen", "last_seen", "dry_run")


@query(_DIFF + " SELECT * FROM d")
def envelope_diff(spark, sf_dir):
    return _shown(envelopes.envelope_diff(_items(spark, sf_dir), _envelopes(spark, sf_dir), _declared(spark, sf_dir)))


def _streamed(spark, sf_dir):
    """Folder of what the stream makes of the same items, and its rows."""
    source, out = scratch(spark), scratch(spark)
    side = _envelopes(spark, sf_dir)
    first = side.where("not dry_run").agg(F.min("sync_id").alias("first_sync"))
    number = F.col("reference").cast("int") % 3
    declared = F.when(F.col("sync_id") == F.col("first_sync"), F.when(number == 0, "new").when(number == 1, "changed").otherwise("unchanged"))
    items = _items(spark, sf_dir).withColumn("dry_run", F.expr(_DRY)).crossJoin(F.broadcast(first)).withColumn("declared", declared).drop("first_sync")
    items.write.parquet(source)
    return out, envelopes.run_available(spark, source, "sync_id string, reference string, pos long, title string, fee double, region string, dry_run boolean, declared string", out)


@query(_DIFF + " SELECT * FROM d")
def envelope_stream(spark, sf_dir):
    """The same items through the stream; what comes out equals the batch."""
    return _shown(_streamed(spark, sf_dir)[1])


@query(_DIFF + " SELECT sync_id, count(*) FILTER (WHERE status = 'new') AS added, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) AS total FROM d WHERE NOT dry_run GROUP BY sync_id ORDER BY sync_id DESC LIMIT 500")
def stream_history(spark, sf_dir):
    """The log that the stream's batches write."""
    return envelopes.stream_history(spark, _streamed(spark, sf_dir)[0])


@query(_DIFF + " SELECT sync_id, count(*) FILTER (WHERE status = 'new') AS added, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) AS total, coalesce(string_agg(reference, ',' ORDER BY reference) FILTER (WHERE status = 'new'), '') AS new_references, coalesce(string_agg(reference, ',' ORDER BY reference) FILTER (WHERE status = 'changed'), '') AS changed_references FROM d WHERE NOT dry_run GROUP BY sync_id ORDER BY sync_id DESC LIMIT 500")
def envelope_history(spark, sf_dir):
    found = envelopes.envelope_history(envelopes.envelope_diff(_items(spark, sf_dir), _envelopes(spark, sf_dir), _declared(spark, sf_dir)))
    return found.withColumns({c: F.array_join(c, ",") for c in ("new_references", "changed_references")})


@query("""WITH d AS (SELECT event_type AS source, event_id AS sync_id, ts AS t_, CASE WHEN user_id % 9 = 0 THEN 'timeout' END AS error, user_id % 4 = 0 AS duplicate, event_id % 3 AS added, event_id % 2 AS changed, event_id % 10 = 0 AS dry_run FROM events)
SELECT source, first(CASE WHEN error IS NOT NULL THEN 'error' WHEN duplicate THEN 'duplicate' WHEN added + changed > 0 THEN 'changes' ELSE 'ready' END ORDER BY t_ DESC, sync_id DESC) AS status, first(sync_id ORDER BY t_ DESC, sync_id DESC) AS sync_id, count(*) FILTER (WHERE NOT dry_run AND error IS NULL) AS history FROM d GROUP BY source""")
def automation_status(spark, sf_dir):
    d = view(spark, sf_dir, "events").selectExpr("event_type AS source", "event_id AS sync_id", "ts AS at", "CASE WHEN user_id % 9 = 0 THEN 'timeout' END AS error", "user_id % 4 = 0 AS duplicate", "event_id % 3 AS added", "event_id % 2 AS changed", "event_id % 10 = 0 AS dry_run")
    return envelopes.automation_status(d)
