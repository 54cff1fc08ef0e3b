"""Queries that take whole texts, on small tables with known answers."""

import re
from hashlib import md5

from sluice.operators import evidence
from sluice.plans import all_queries


def documents(spark, tmp_path, texts):
    """A folder with the texts as documents 0, 1, ..."""
    spark.createDataFrame([(i, t, "ar", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_gate_reads_words_after_400_characters(spark, tmp_path):
    texts = ["كلمة " * 100 + "؛ " * 60 + "نهاية", "word " * 90 + "a " * 2000 + "z", "كلمة " * 300 + "نهاية", "short text - here"]
    got = {r["document_id"]: r for r in all_queries()["block_quality_gate_whole"](spark, documents(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        words = t.split(" ")
        tiny, marks = sum(len(w) <= 2 for w in words) / len(words), sum(bool(re.fullmatch(r"[.,،:؛;\-–—]+", w)) for w in words) / len(words)
        assert (got[i]["blocks"], round(got[i]["fragmented"], 9), round(got[i]["punctuation"], 9)) == (len(words), round(tiny, 9), round(marks, 9))
        assert (got[i]["is_fragmented"], got[i]["arabic_lost"]) == (tiny > 0.9, marks > 0.15)
    assert [got[i]["needs_alternate"] for i in range(4)] == [True, True, False, True]


def test_narratives_are_read_whole(spark, tmp_path):
    """Summaries and warnings are sentences of the documents; what follows 400 characters counts."""
    long = "نص مؤسس طويل " * 60
    path = documents(spark, tmp_path, ["x"] + [f"{long}\nجملة أولى\n{last}" for last in ("المبلغ " * 80 + "777 ريال", "نص مؤسس", "مدينة " * 90 + "بعيدة")])
    got = {r["run_id"]: r["issue"] for r in all_queries()["narrative_check"](spark, path).collect()}
    assert 300000 not in got and 100000 not in got and got[200000] == "token:بلده"


def test_rules_fit_long_blocks(spark):
    rows = [(1, 0, "b0", "كلمة " * 8000 + "فسخ " + "كلمة " * 8000), (1, 1, "b1", "سطر\nإنهاء العقد\nسطر"), (1, 2, "b2", "كلمة " * 8000), (2, 0, "b0", "غرامة تأخير: يومية")]
    blocks = spark.createDataFrame(rows, "document_id long, ord int, block_id string, text string")
    got = [(r["document_id"], r["evidence_id"], r["block_id"], r["category"], r["statement"]) for r in evidence.rule_findings(blocks).orderBy("document_id", "evidence_id").collect()]
    assert got == [
        (1, "ev-1", "b0", "contractualRisks", rows[0][3][:160]), (1, "ev-2", "b1", "contractualRisks", rows[1][3]),
        (2, "ev-1", "b0", "penalties", "الغرامات: يومية"), (2, "ev-2", "b0", "contractualRisks", "غرامة تأخير: يومية"),
    ]


def test_rules_read_the_documents(spark, tmp_path):
    texts = ["كلمة\nنطاق العمل: طرق\n" + "كلمة " * 5000 + "فسخ", "كلمة"]
    got = {(r["document_id"], r["evidence_id"]): (r["block_id"], r["category"]) for r in all_queries()["rule_findings_whole"](spark, documents(spark, tmp_path, texts)).collect()}
    assert got == {(0, "ev-1"): ("b1", "scopeOfWork"), (0, "ev-2"): ("b2", "contractualRisks"), (0, "ev-3"): ("b3", "bidBonds"), (1, "ev-1"): ("b1", "penalties"), (1, "ev-2"): ("b1", "contractualRisks")}


def lines_as(spark, tmp_path):
    """Documents of each of the three kinds that blocks() makes, with blank lines and one without a text."""
    texts = ["\n".join(f"سطر رقم {i} من {d}" if i % 6 != 4 else "" for i in range(45)) for d in range(21)]
    texts[3] = None
    spark.createDataFrame([(i, t, "ar", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), {i: t.split("\n") for i, t in enumerate(texts) if t is not None}


def test_evidence_of_files_is_their_lines(spark, tmp_path):
    path, lines = lines_as(spark, tmp_path)
    got = sorted((int(r["file_name"][5:]), r["at"], r["evidence_id"], r["page_number"], r["excerpt_md5"]) for r in all_queries()["multidoc_evidence"](spark, path).collect())
    assert got == [(d, i, f"e{i}", i // 20 + 1, md5(x.encode()).hexdigest()) for d in lines if d % 6 for i, x in enumerate(lines[d])]


def test_stored_reports_are_of_lines(spark, tmp_path):
    path, lines = lines_as(spark, tmp_path)
    said = {d: [(i, x) for i, x in enumerate(own) if x] for d, own in lines.items()}
    place = {c: evidence.STORED_ORDER.index(c) for c in evidence.CATEGORIES}
    want = []
    for d, own in said.items():
        of = lambda i, d=d: evidence.CATEGORIES[(d + i) % 12]
        want += [(d, n, of(i), f"ev-{i}") for n, (i, _) in enumerate(sorted(own, key=lambda x: (place[of(x[0])], x[0])), 1)]
    got = all_queries()["report_flatten"](spark, path).select("report_id", "finding_no", "category", "evidence_ids").collect()
    assert sorted(map(tuple, got)) == want
    got = all_queries()["report_flatten_evidence"](spark, path).select("report_id", "pos", "evidence_id", "page_number", "excerpt_md5").collect()
    assert sorted(map(tuple, got)) == [(d, n, f"ev-{i}", i // 20 + 1, md5(x.encode()).hexdigest()) for d, own in said.items() for n, (i, x) in enumerate(own)]
    got = all_queries()["report_flatten_jobs"](spark, path).select("report_id", "n_findings", "n_evidence").collect()
    assert sorted(map(tuple, got)) == [(d, len(own), len(own)) for d, own in said.items()]


def test_selections_choose_among_lines(spark, tmp_path):
    """Document 20 names lines 6, 2 and 0; document 3, without a text, some that it has not."""
    path, lines = lines_as(spark, tmp_path)
    got = all_queries()["selection_materialize"](spark, path).where("selection_id = 20").first()
    assert (got["status"], got["findings"], got["evidence"]) == ("ok", "eligibilityRequirements:0,criticalQuantities:0,criticalQuantities:1", "c6,c2,c0")
    assert got["summary_md5"] == md5("؛ ".join(lines[20][i] for i in (6, 2, 0)).encode()).hexdigest()
    codes = {r["selection_id"]: r["codes"] for r in all_queries()["selection_audit"](spark, path).collect()}
    assert (codes[20], codes[3]) == ("", "severity,unknown-id,sufficiency-repeated-id,sufficiency-unknown-id")
