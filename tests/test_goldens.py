"""Small cases with known answers."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from sluice.functions import fees, text
from sluice.operators import board, detail, evidence, merge, reports, score
from sluice.operators import benchmarking as bench
from sluice.sources import intake
from sluice.streaming import envelopes


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_fee_values(spark):
    cases = {"٣٠٠٫٥٠ ر.س": 300.5, "1,200 ريال": 1200.0, "- 5": None, "5 أو 6": None, "5 = 5.0": 5.0, "": None, None: None, "مجانًا": None, "0": 0.0}
    for raw, want in cases.items():
        assert one(spark, fees.fee_value, raw) == want, raw


def test_trusted_urls(spark):
    cases = {"https://tenders.etimad.sa/Tender/DetailsForSupplier?x=1": True, "https://tenders.etimad.sa/tender/details/9": True, "http://tenders.etimad.sa/Tender/Details": False, "https://tenders.etimad.sa.example.org/Tender/Details": False, "https://tenders.etimad.sa/tender/detailsX": False, "::": False, None: False}
    for url, want in cases.items():
        assert one(spark, fees.is_trusted_detail_url, url) is want, url


def test_appearances_merge(spark):
    rows = [(1, "a", "t1", "g", None, "unknown", "الرياض", 1), (1, "a", "t2", "h", 5.0, "detail-verified", "القصيم", 2), (1, "a", "t3", "i", 9.0, "card-observed", "الرياض", 3), (1, "b", "x", "y", None, "unknown", "حائل", 4)]
    df = spark.createDataFrame(rows, "sync_run_id int, reference string, title string, agency string, fee double, fee_verification string, region_name string, seq int")
    got = {r["reference"]: r for r in merge.appearance_merge(df).collect()}
    assert (got["a"]["title"], got["a"]["fee"], got["a"]["fee_verification"], got["a"]["region"]) == ("t1", 5.0, "detail-verified", "متعدد المناطق: الرياض، القصيم")
    assert (got["b"]["fee"], got["b"]["fee_verification"], got["b"]["region"]) == (None, "unknown", "حائل")


def test_cap_comes_before_the_fee_range(spark):
    rows = [(1, f"{i}", "1", "paid-1-1000", 1, 9999.0 if i < 3 else 10.0, i) for i in range(5)]
    df = spark.createDataFrame(rows, "sync_run_id int, reference string, region_id string, fee_bucket string, page_number int, fee double, seq int")
    assert [r["reference"] for r in merge.region_cap(df, target=4).collect()] == ["3"]


def test_classifier(spark):
    rows = [("1", "صيانة طرق", "", ""), ("2", "توريد", "وزارة", ""), ("3", "إنشاء مدرسة", None, None)]
    got = {r["reference"]: r for r in score.specialty_classify(spark.createDataFrame(rows, "reference string, title string, agency string, activity string")).collect()}
    assert got["2"]["specialty_code"] == "general-works" and got["2"]["confidence"] == 0
    assert got["3"]["specialty_code"] == "buildings" and got["3"]["confidence"] == 1.0
    assert got["1"]["specialty_code"] == "maintenance-operation"


def test_quality_gates(spark):
    rows = [(1, "."), (1, "،"), (1, "نص كامل"), (2, "ab"), (2, "c"), (3, "كلام طويل"), (3, "كلام آخر")]
    got = {r["document_id"]: r for r in detail.block_quality_gate(spark.createDataFrame(rows, "document_id int, text string")).collect()}
    assert got[1]["arabic_lost"] and got[2]["is_fragmented"] and not got[3]["needs_alternate"]


def test_field_extraction(spark):
    section = "اسم المنافسة\nصيانة المبنى\nالجهة الحكومية: وزارة\nقيمة الكراسة\nرقم المنافسة\n٣٠٠"
    df = spark.createDataFrame([("r", 1, "س", section)], "reference string, section_ord int, name string, text string")
    got = {r["field"]: r["value"] for r in detail.detail_field_extract(df).collect()}
    assert got == {"title": "صيانة المبنى", "agency": "وزارة", "bookletFee": "٣٠٠", "tenderNumber": "٣٠٠"}


def test_claims(spark):
    got = one(spark, text.claims, "بتاريخ 2024-01-05 الساعة 09:30 نسبة ٥٪ ومبلغ 1,200.50 في m0a و TEST-1")
    assert [(c["kind"], c["value"]) for c in got] == [("date", "2024-01-05"), ("time", "09:30"), ("percent", "5%"), ("number", "1200.5")]


def test_token_variants(spark):
    assert set(one(spark, text.token_variants, "والتنفيذ")) >= {"والتنفيذ", "التنفيذ", "تنفيذ"}
    assert text.word_variants("والتنفيذ")[-1] == "تنفيذ"


def test_chunks_keep_their_limit_and_all_words():
    words = [(f"b{i}", "heading" if i % 5 == 0 else "paragraph", (f"w{i} " * (1 + i * 7 % 40)).strip(), {"page_number": 1 + i // 20}, "t" if i % 4 == 0 else None) for i in range(60)]
    words.append(("long", "paragraph", "x" * 500 + " y" * 300, {"page_number": 4}, None))
    rows = evidence._chunks_of(7, words, 200, 40)
    assert all(size == len(body) <= 200 for _, _, _, body, size, *_ in rows)
    assert {re.sub(r"#p\d+$", "", b) for r in rows for b in r[5]} == {w[0] for w in words}
    assert [r[1] for r in rows] == list(range(1, len(rows) + 1))


def test_chunk_rules():
    pack = lambda sizes, headings="", tables="": evidence.pack(sizes, [str(k) in headings for k in range(len(sizes))], [t if t != "-" else None for t in (tables or "-" * len(sizes))], 100, 30)
    assert pack([40, 40, 40]) == [[0, 1], [2]]  # too large to be carried over
    assert pack([60, 20, 10, 50]) == [[0, 1, 2], [1, 2, 3]]  # small ones at the end are carried over
    assert pack([60, 20, 10, 90]) == [[0, 1, 2], [1, 2], [2], [3]]  # and dropped one by one where they do not fit
    assert pack([60, 20, 50], "1") == [[0], [1, 2]]  # a heading moves on
    assert pack([60, 20, 90], "1") == [[0], [1], [2]]
    assert pack([20, 70, 60], tables="ttt") == [[0, 1], [0, 2]]  # a table's header comes again
    assert pack([]) == [] and pack([0, 0]) == [[0, 1]]
    assert evidence.cut_text("aa bb cc " + "d" * 25, 10) == ["aa bb cc", "d" * 10, "d" * 10, "d" * 5]


def test_chunk_of_known_id(spark):
    rows = [(1, 0, "b0", "heading", "عنوان", 1, None), (1, 1, "b1", "paragraph", "نص أول", 1, None), (2, 0, "b0", "paragraph", None, 3, "t")]
    df = spark.createDataFrame(rows, "document_id long, ord int, block_id string, kind string, text string, page_number int, table_id string")
    got = {r["document_id"]: r for r in evidence.doc_chunk(df).collect()}
    assert got[1]["text"] == "عنوان\nنص أول" and (got[1]["char_count"], got[1]["block_ids"], [r["page_number"] for r in got[1]["sources"]]) == (12, ["b0", "b1"], [1])
    assert got[1]["chunk_id"] == "chk-" + hashlib.sha256("11b0,b1".encode()).hexdigest()[:16] == "chk-1302f58f74b3f715"
    assert (got[2]["text"], got[2]["table_ids"]) == ("", ["t"])


def test_catalog_and_fingerprint(spark):
    blocks = spark.createDataFrame([(1, 0, "b0", 1, "سطر أول طويل\nقصير\nسطر أول طويل"), (1, 1, "b1", 2, "another line of text")], "document_id long, ord int, block_id string, page_number int, text string")
    chunks = spark.createDataFrame([(1, 1, "chk-a", "سطر أول طويل قصير سطر أول طويل", ["b0"]), (1, 2, "chk-b", "another  line of text", ["b1"])], "document_id long, ordinal int, chunk_id string, text string, block_ids array<string>")
    documents = spark.createDataFrame([(1, "sum")], "document_id long, checksum string")
    got = evidence.candidate_catalog(documents, blocks, chunks).orderBy("idx")
    rows = got.collect()
    assert [(r["idx"], r["excerpt"], r["start_offset"], r["end_offset"], r["chunk_id"]) for r in rows] == [(0, "سطر أول طويل قصير", 0, 17, "chk-a"), (1, "another line of text", 0, 20, "chk-b")]
    key = "sum|1|b1|chk-b|page:2|0|20|another line of text"
    assert rows[1]["candidate_id"] == "cand-" + hashlib.sha256(key.encode()).hexdigest()[:24]
    nulls = {"sheetName": None, "cellRange": None, "section": None}
    lines = [json.dumps({"index": r["idx"], "candidateId": r["candidate_id"], "documentId": "1", "sourceType": "pdf", "excerpt": r["excerpt"], "chunkId": r["chunk_id"], "blockId": r["block_id"], "startOffset": r["start_offset"], "endOffset": r["end_offset"], "pageNumber": r["page_number"]} | nulls, ensure_ascii=False, separators=(",", ":")) for r in rows]
    assert evidence.catalog_fingerprint(got).first()["catalog_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_segments_are_literal():
    value = "سطر أول طويل بما يكفي\n\nقصير\n" + "كلمة " * 200 + "\nسطر أول طويل بما يكفي"
    flat = " ".join(value.split())
    found = evidence.segments(value)
    assert found and all(flat[s:e] == x and 8 <= e - s <= 400 for s, e, x in found)


def test_lone_file_is_low(spark):
    df = spark.createDataFrame([("t", 1, "f", 9, None, None, "sufficient", "high", 5, ["e2", "e1"])], FILES)
    r = evidence.multidoc_merge(df).first()
    assert (r["evidence_sufficiency"], r["confidence"]) == ("sufficient", "low")


FILES = "tender string, pos int, file_name string, size_bytes int, error string, message string, evidence_sufficiency string, confidence string, evidence_count int, sufficiency_ids array<string>"


def test_sufficiency_ids_keep_their_first_file(spark):
    rows = [("t", 1, "a", 1, "E", "failed", "sufficient", "high", None, ["x"]), ("t", 2, "b", 2, None, None, "partial", "low", 4, ["e2", "e1"]), ("t", 3, "c", 3, None, None, "partial", "medium", 3, ["e3", "e2"]), ("t", 4, "d", 4, None, None, "insufficient", "high", 3, None)]
    r = evidence.multidoc_merge(spark.createDataFrame(rows, FILES)).first()
    assert (r["evidence_sufficiency"], r["confidence"], r["total_evidence"], r["warning"]) == ("partial", "medium", 10, None)
    assert [tuple(x) for x in r["sufficiency_ids"]] == [("e2", "b"), ("e1", "b"), ("e3", "c")] and [tuple(x) for x in r["errors"]] == [("a", "E", "failed")]
    assert [(x["file_name"], x["evidence_count"], x["error"]) for x in r["files"]] == [("a", None, "E"), ("b", 4, None), ("c", 3, None), ("d", 3, None)]


def test_verdict_tiers(spark):
    runs = spark.createDataFrame([(i, "m") for i in range(4)], "run_id int, model string")
    gates = spark.createDataFrame([(0, "safety", True), (1, "safety", False), (2, "contract", False), (2, "safety", False), (3, "input", False), (3, "contract", False)], "run_id int, tier string, passed boolean")
    scores = runs.selectExpr("run_id", "100.0D AS score")
    got = {r["run_id"]: (r["verdict"], r["score"]) for r in bench.run_verdict(runs, gates, scores).collect()}
    assert got == {0: ("PASS", 100.0), 1: ("SAFETY_FAILURE", None), 2: ("SAFE_REJECTION", None), 3: ("INVALID_BENCHMARK_INPUT", None)}


EXPECTED = "case_id int, ord int, expected_id string, category string, critical_terms array<string>, expected_value string, availability string, required boolean, candidate_ids array<string>"
STATED = "run_id int, category string, pos int, statement string, evidence_ids array<string>"
SHOWN = "run_id int, pos int, evidence_id string, excerpt string"
MADE = "case_id int, ord int, assertion_id string, terms array<string>, categories array<string>"


def frames(spark, findings, expectations, evidence=(), assertions=()):
    runs = spark.createDataFrame([(i,) for i in sorted({f[0] for f in findings})], "run_id int").withColumn("case_id", F.lit(1))
    return runs, *(spark.createDataFrame(list(rows), schema) for rows, schema in ((findings, STATED), (expectations, EXPECTED), (evidence, SHOWN), (assertions, MADE)))


def test_score_by_nearest_expectation(spark):
    """One of two factual findings is as expected; its evidence holds an id that is no candidate."""
    runs, f, x, _, _ = frames(spark, [(1, "penalties", 0, "x y", ["k1", "zz"]), (1, "deadlines", 0, "foreign", ["zz"])], [(1, 0, "e", "penalties", ["x"], "x", "explicit", True, ["k1"])])
    r = bench.quality_score(f, runs, x).first()
    assert (r["facts"], r["categories"], r["evidence"], r["ambiguity"], r["completeness"], r["score"]) == (35.0, 7.5, 0.0, 15.0, 10.0, 67.5)


def test_nearest_is_the_first_of_equals(spark):
    expected = [(1, 0, "a", "penalties", ["x", "y"], "x y", "explicit", True, ["k"]), (1, 1, "b", "deadlines", ["x"], "x", "explicit", True, ["k"]), (1, 2, "c", "unclearItems", ["z"], "z", "missing", False, ["k"])]
    runs, f, x, _, _ = frames(spark, [(1, "deadlines", 0, "x", ["k"]), (2, "penalties", 0, "x y", ["k"])], expected)
    got = {r["run_id"]: (r["facts"], r["categories"], r["evidence"], r["ambiguity"], r["score"]) for r in bench.quality_score(f, runs, x).collect()}
    # run 1 states as many terms of the first expectation as of its own: the first is nearest, and is not stated in full
    assert got == {1: (17.5, 0.0, 25.0, 0.0, 47.5), 2: (17.5, 15.0, 25.0, 0.0, 62.5)}


def test_matches_are_one_to_one(spark):
    expected = [(1, i, f"e{i}", "penalties", ["x"], "x", "explicit", True, ["k"]) for i in range(3)]
    runs, f, x, _, _ = frames(spark, [(1, "penalties", 4, "x", ["k"]), (1, "penalties", 2, "x", ["k"]), (1, "penalties", 9, "y", ["k"])], expected)
    assert sorted((r["ord"], r["pos"]) for r in bench.expectation_match(f, runs, x).collect()) == [(0, 2), (1, 4)]
    gaps = sorted((r["kind"], r["id"], r["detail"]) for r in bench.expectation_gaps(f, runs, x).collect())
    assert gaps == [("missed", "e2", "required:explicit"), ("unexpected", "9", "y")]


def test_tokens_rest_on_own_evidence_and_expected_values(spark):
    expected = [(1, 0, "e", "penalties", ["غرامة"], "غرامة بالأسبوع", "explicit", True, ["k1"])]
    findings = [(1, "penalties", 0, "غرامة بالأسبوع", ["k1"]), (1, "penalties", 1, "غرامة في مكة", ["k1"]), (1, "deadlines", 0, "مكة", ["k2"]), (1, "guarantees", 0, "بالأسبوع", ["k2"])]
    runs, f, x, e, _ = frames(spark, findings, expected, [(1, 0, "k1", "غرامة"), (1, 1, "k2", "مكة"), (1, 2, "k2", "مكة بالأسبوع")])
    assert {(r["category"], r["pos"]): r["unfounded"] for r in bench.token_grounding(f, e, runs, x).collect()} == {("penalties", 1): "مكه", ("guarantees", 0): "بالاسبوع"}


def test_words_are_folded_once(monkeypatch):
    """However often a word stands in texts, a worker folds it once; long words are not kept."""
    seen, fold = [], text.fold_word
    monkeypatch.setattr(text, "fold_word", lambda w: seen.append(w) or fold(w))
    texts = ["والمدرسةِ،\u00a0١٬٢٣٤ كتابًا" + " " * (i % 3) for i in range(50)] + ["س" * 500] * 2
    got = [text.tokens_of(t) for t in texts]
    assert got[:50] == [["والمدرسه", "1234", "كتابا"]] * 50 and got[50:] == [["س" * 500]] * 2
    assert len(seen) <= 4 + 2


def test_unfounded_equals_a_loop(spark):
    """Words that stand in the corpus as they are, in another form, or not at all; nulls and neutral words."""
    rows = [(["مدرسة بعيدة", None, "والمدرسة", "تقرير مدرسة"], ["مدرسة كبيرة", None]), (["كتاب"], None), (None, ["كتاب"]), (["الكتب\u00a0كتب", "بكتاب", ""], ["كتب\tكتاب"]), (["x" * 70 + " y"], ["X" * 70])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(text.unfounded(F.col("a"), F.col("b")).alias("u")).collect()
    forms = lambda t: {v for w in text.tokens_of(t) for v in text.word_variants(w)}
    for (own, given), r in zip(rows, got, strict=True):
        bears = text.NEUTRAL.union(*[forms(t) for t in given or []])
        assert r["u"] == [next((w for w in text.tokens_of(t) if bears.isdisjoint(text.word_variants(w))), None) for t in own or []]


def test_findings_are_checked_once(spark, sf):
    """Tokens are sought, in Python, once for each finding and each narrative: the gates read checked findings."""
    from sluice.plans import all_queries

    for name in ("token_grounding", "narrative_check", "run_gates"):
        plan = all_queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        runs = plan.count("ArrowEvalPython")
        assert runs == (2 if name == "narrative_check" else 1), name


def test_claims_are_sought_once(spark):
    """A text's plain digits and what each kind leaves of it stand once in the plan."""
    plan = spark.range(1).select(text.claims(F.col("id").cast("string")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert (plan.count("translate("), plan.count("regexp_extract_all(")) == (2, 5)


def test_far_expectations_are_not_looked_into(spark):
    """Expectations without a term of the finding are filtered out first; those without any term are not."""
    expected = [(1, 0, "a", "penalties", ["غرامة"], "v", "explicit", True, ["k"]), (1, 1, "b", "penalties", ["بعيد"], "v", "explicit", True, ["k"]), (1, 2, "c", "penalties", [], "v", "explicit", True, ["k"])]
    runs, f, x, _, _ = frames(spark, [(1, "penalties", 0, "غرامة يومية", ["k"])], expected)
    found = bench.judged(f, runs, x)
    row = found.first()
    assert ([(c["ord"], c["only"]) for c in row["covers"]], row["nearest"]) == ([(0, True), (2, True)], True)
    assert "exists(" in found._jdf.queryExecution().analyzed().toString()


def test_forbidden_and_derived(spark):
    findings = [(1, "penalties", 0, "المبلغ 500", ["k"]), (1, "unclearItems", 0, "المبلغ 500", ["k"]), (1, "deadlines", 0, "المبلغ 7", ["k"])]
    runs, f, x, e, a = frames(spark, findings, [], [(1, 0, "k", "المبلغ 7")], [(1, 0, "fa-1", ["المبلغ"], ["deadlines"]), (1, 1, "fa-2", ["500"], None)])
    assert {(r["category"], r["assertion_id"]) for r in bench.forbidden_assertions(f, runs, a).collect()} == {("penalties", "fa-2"), ("deadlines", "fa-1")}
    assert {(r["category"], r["value"]) for r in bench.numeric_grounding(f, e).collect()} == {("penalties", "500"), ("unclearItems", "500")}
    free = spark.createDataFrame([(1, True)], "case_id int, allow_derived boolean")
    assert bench.numeric_grounding(f, e, runs, free).count() == 0


def test_narrative_does_not_launder(spark):
    """A statement that its evidence does not bear out is no support for the summary that repeats it."""
    findings = [(i, "penalties", 0, "مدينة جدة", ["k"]) for i in (1, 2)] + [(i, "penalties", 0, "نص مؤسس", ["k"]) for i in (3, 4, 5, 6)]
    shown = [(i, 0, "k", "نص مؤسس المبلغ ريال" + (" مدينة جدة" if i == 2 else "")) for i in range(1, 7)]
    runs, f, x, e, a = frames(spark, findings, [], shown, [(1, 0, "fa", ["المبلغ", "ريال"], None)])
    told = {1: ("مدينة جدة", None), 2: ("مدينة جدة", []), 3: ("نص. المبلغ 500 ريال", []), 4: ("هل المبلغ ريال؟", ["المبلغ ريال!"]), 5: ("نص مؤسس", ["نص\nالمبلغ غير محدد ريال"]), 6: ("تقرير مبدئي للمراجعة فقط", [])}
    reports_ = spark.createDataFrame([(i, s, w) for i, (s, w) in told.items()], "run_id int, summary string, warnings array<string>")
    unfounded = f.join(bench.token_grounding(f, e, runs, x), ["run_id", "category", "pos"], "left")
    got = {r["run_id"]: (r["issue"], r["issues"]) for r in bench.narrative_check(reports_, bench.narrative_corpus(e, unfounded), runs, a).collect()}
    assert got == {1: ("token:مدينه", 1), 3: ("number:500", 1), 4: ("assertion:fa", 1), 5: ("token:محدد", 1)}


def test_gates_stop_at_the_first_failing_tier(spark):
    findings = [(i, "penalties", 0, "غرامة يومية" if i != 2 else "غرامة جدة", ["k"]) for i in range(4)]
    runs, f, x, e, a = frames(spark, findings, [(1, 0, "e", "penalties", ["غرامة"], "غرامة", "explicit", True, ["k"])], [(i, 0, "k", "غرامة يومية") for i in range(4)])
    runs = runs.withColumns({"model": F.when(F.col("run_id") == 3, " ").otherwise("m"), "telemetry": F.when(F.col("run_id") == 3, '{"evalCount":"1"}')})
    one_ = lambda row, schema: spark.createDataFrame([row], schema)
    null = {c: F.lit(None).cast("string") for c in ("sheet_name", "cell_range", "section")}
    b = bench.Benchmark(
        runs=runs, cases=one_((1, 1, "sum", "cat", False), "case_id int, document_id int, fixture_sha256 string, catalog_sha256 string, allow_derived boolean"), documents=one_((1, "sum", "pdf"), "document_id int, checksum string, document_type string"),
        candidates=one_((1, 1, "k"), "case_id int, document_id int, candidate_id string"), fingerprints=one_((1, "cat"), "case_id int, catalog_sha256 string"),
        chunks=one_((1, "c", "نص غرامة  يومية"), "document_id int, chunk_id string, text string").withColumn("sources", F.array(F.struct(F.lit(1).alias("page_number"), *[v.alias(n) for n, v in null.items()]))),
        expectations=x, assertions=a, reports=runs.select("run_id", F.lit("غرامة يومية").alias("summary"), F.array().cast("array<string>").alias("warnings"), F.lit("partial").alias("evidence_sufficiency"), F.lit("low").alias("confidence"), F.array(F.lit("k")).alias("sufficiency_ids"), F.when(F.col("run_id") == 1, F.array(F.lit("more"))).otherwise(F.array()).alias("extra_fields")),
        findings=f.withColumns({"severity": F.lit("info"), "confidence": F.lit("low")}), evidence=e.withColumns({"document_id": F.lit(1), "source_type": F.lit("pdf"), "page_number": F.lit(1), "chunk_id": F.lit("c")} | null),
    )
    gates = bench.run_gates(b).collect()
    assert sorted((r["run_id"], r["gate"], r["detail"]) for r in gates if not r["passed"]) == [(1, "extra-fields", "more"), (2, "tokens", "penalties:0:جده"), (3, "model", None), (3, "telemetry", '{"evalCount":"1"}')]
    assert {i: sum(r["run_id"] == i for r in gates) for i in range(4)} == {0: 16, 1: 11, 2: 16, 3: 6}
    assert {r["run_id"]: (r["verdict"], r["score"]) for r in bench.evaluate(b).collect()} == {0: ("PASS", 100.0), 1: ("SAFE_REJECTION", None), 2: ("SAFETY_FAILURE", None), 3: ("INVALID_BENCHMARK_INPUT", None)}


def test_grounding_by_place(spark):
    rows = [(1, "pdf", 2, None, None, None), (2, "pdf", 3, None, None, None), (3, "xlsx", None, "ورقة", "A1:B2", None), (4, "xlsx", None, "ورقة", "A1:B3", None), (5, "xlsx", None, "ورقة", None, None), (6, "docx", None, None, None, "قسم"), (7, "docx", None, None, None, "آخر"), (8, "pdf", 0, None, None, None)]
    e = spark.createDataFrame([(i, 0, "ev", i, kind, "سطر  أول", "c", p, s, c, n) for i, kind, p, s, c, n in rows], "run_id int, pos int, evidence_id string, document_id int, source_type string, excerpt string, chunk_id string, page_number int, sheet_name string, cell_range string, section string")
    d = e.select("run_id", "document_id", F.col("source_type").alias("document_type"))
    places = F.array(*[F.struct(F.lit(p).cast("int").alias("page_number"), F.lit(s).cast("string").alias("sheet_name"), F.lit(c).cast("string").alias("cell_range"), F.lit(n).cast("string").alias("section")) for p, s, c, n in ((2, None, None, None), (None, "ورقة", "A1:B2", None), (None, None, None, "قسم"))])
    chunks = e.select("document_id", "chunk_id", F.lit("قبل سطر أول بعد").alias("text"), places.alias("sources"))
    assert {r["run_id"]: r["first_reason"] for r in evidence.grounding_check(e, d, chunks).collect()} == {1: None, 2: "place", 3: None, 4: "place", 5: "location", 6: None, 7: "place", 8: "location"}


def test_report_contract(spark):
    reports_ = spark.createDataFrame([(1, "s", [], "partial", "low", ["k"]), (2, " ", None, "x", None, None), (3, "s", [], "sufficient", "low", []), (4, "s", [], "insufficient", "low", []), (5, "s", [], "partial", "low", ["q"])], "run_id int, summary string, warnings array<string>, evidence_sufficiency string, confidence string, sufficiency_ids array<string>")
    f = spark.createDataFrame([(1, "penalties", "s", "info", "low", ["k"]), (2, "", None, "big", "x", [])], "run_id int, category string, statement string, severity string, confidence string, evidence_ids array<string>")
    e = spark.createDataFrame([(1, "k", 1, "pdf", "x", "c", 1, None, None, None), (2, "", None, "", "x" * 401, None, None, None, None, None), (5, "k", 1, "pdf", "x", "c", None, None, None, "s")], "run_id int, evidence_id string, document_id int, source_type string, excerpt string, chunk_id string, page_number int, sheet_name string, cell_range string, section string")
    got = {r["run_id"]: r["codes"] for r in evidence.report_audit(reports_, f, e).collect()}
    every = "summary,sufficiency,confidence,warnings,finding-category,finding-statement,finding-severity,finding-confidence,finding-evidence-ids,evidence-id,evidence-document,evidence-type,evidence-location,evidence-excerpt,evidence-chunk,sufficiency-ids"
    assert got == {1: "", 2: every, 3: "no-evidence,sufficiency-without-ids", 4: "", 5: "sufficiency-dangling"}


def test_manifest_entries_and_truths(spark):
    good = {"caseId": "m0a-clear", "fixtureId": "TEST-M0A-001", "documentId": "d", "title": "t", "fixtureFile": "f", "fixtureSha256": "a" * 64, "catalogSha256": "b" * 64, "pageCount": 2, "specFile": "s", "groundTruthFile": "g"}
    entries = [good, good | {"caseId": "x"}, good, good | {"caseId": "m0a-b", "pageCount": "2", "more": 1}, {k: v for k, v in good.items() if k != "title"} | {"caseId": "m0a-c", "catalogSha256": "c" * 64}, []]
    df = spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(entries)], "manifest_id int, pos int, entry string")
    prints = spark.createDataFrame([("d", "b" * 64)], "document_id string, catalog_sha256 string")
    assert [r["codes"] for r in bench.manifest_case_audit(df, prints).orderBy("pos").collect()] == ["", "case-id", "repeated-case", "unknown-field,pages", "missing-field,title,fingerprint", "not-an-object"]


def test_download_manifest_digest(spark):
    """The digest of the manifest's JSON, worked out by hand."""
    files = spark.createDataFrame([("T1", 0, " b.pdf", None), ("T1", 1, "أ.zip", 5), ("T1", 2, "b.pdf", 9), ("T1", 3, " ", 1), ("T2", 0, "x.exe", 1), ("T2", 1, "a.pdf", (100 << 20) + 1), ("T3", 0, "a.7z", 100 << 20), ("T4", 0, "", 1)], "reference string, pos int, display_name string, size_bytes long")
    known = spark.createDataFrame([("T1", "b.pdf", "restricted"), ("T1", "أ.zip", "unknown"), ("T2", "a.pdf", "metadata-only"), ("T3", "a.7z", "sold")], "reference string, display_name string, availability string")
    got = {r["reference"]: (r["n_files"], r["verdict"], r["failing_file"], r["manifest_hash"]) for r in merge.manifest_audit(files, known).collect()}
    digest = hashlib.sha256('{"tenderReference":"T1","files":[["b.pdf",null],["أ.zip",5]]}'.encode()).hexdigest()
    assert got["T1"] == (2, "ok", None, digest) and [got[t][:3] for t in ("T2", "T3", "T4")] == [(2, "file-size", "a.pdf"), (1, "availability", "a.7z"), (0, "no-files", None)]


def test_intake_profiles(spark, tmp_path):
    for name, raw in {"a.PDF": b"%PDF-1", "b.zip": b"PK\x05\x06", "c.xlsx": b"PK\x03\x04x", "d.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "e.7z": b"7z", "g.txt": b"x"}.items():
        (tmp_path / name).write_bytes(raw)
    files = intake.binary_files(spark, str(tmp_path), limit=6)
    verdicts = lambda profile, df: {r["name"]: r["verdict"] for r in intake.file_intake_audit(df, profile).collect()}
    assert verdicts(intake.QUARANTINE, files.where("name <> 'd.doc'")) == {"a.PDF": "accepted", "b.zip": "accepted", "c.xlsx": "accepted", "e.7z": "signature", "g.txt": "extension"}
    assert verdicts(intake.ANALYSIS, files) == {"a.PDF": "accepted", "b.zip": "extension", "c.xlsx": "accepted", "d.doc": "extension", "e.7z": "extension", "g.txt": "extension"}
    none = spark.createDataFrame([(1, "f.pdf", bytearray(b"")), (2, "g.txt", None)], "file_id int, name string, content binary")
    assert verdicts(intake.QUARANTINE, none) == {"f.pdf": "empty", "g.txt": "empty"} and verdicts(intake.ANALYSIS, none) == {"f.pdf": "empty", "g.txt": "extension"}
    mimes = spark.createDataFrame([(i, "x.zip", bytearray(b"PK"), m) for i, m in enumerate(["application/x-zip-compressed; a=b", " APPLICATION/ZIP", "application/pdf", "application/octet-stream", None])], "file_id int, name string, content binary, mime string")
    assert [r["verdict"] for r in intake.file_intake_audit(mimes).orderBy("file_id").collect()] == ["accepted", "accepted", "mime", "accepted", "accepted"]
    large = intake.file_intake_audit(intake.binary_files(spark, str(tmp_path), limit=3), intake.Profile(intake.QUARANTINE.kinds, 3, False)).where("name = 'a.PDF'").first()
    assert (large["verdict"], large["size_bytes"], large["sha256"]) == ("too-large", 6, None)


def test_reads_that_differ_in_the_time_remaining_are_one_version(spark):
    page = lambda left, group, label="الوقت المتبقي": ("r", left, {"timeRemaining": str(left), "b": "1", "a": group}, [("s", f"النوع\nعام\n{label}\n{left} يوم\nآخر\n5")])
    df = spark.createDataFrame([page(9, "x"), page(7, "x", "الوقت المتبقى"), page(8, "x"), page(3, "y"), page(2, "x")], "reference string, inspected_at int, fields map<string,string>, sections array<struct<title:string,text:string>>")
    df = df.withColumns({"attachments": F.lit(None).cast("array<string>"), "page_title": F.lit(""), "source_url": F.lit(None).cast("string")})
    got = sorted((r["version"], r["inspected_at"], r["reads"]) for r in merge.detail_history(df).collect())
    assert got == [(1, 2, 3), (2, 3, 1), (3, 7, 1)]
    now = merge.detail_current(df).first()
    assert (now["inspected_at"], now["fields"]["a"]) == (9, "x")


def test_export_quotes_every_cell(spark, tmp_path):
    df = spark.createDataFrame([("1", 'قال "نعم"', None)], "reference string, title string, notes string")
    for c in intake.CSV_COLUMNS:
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    intake.board_csv_export(df.coalesce(1), str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("part-*")).read_text()
    assert '"قال ""نعم"""' in body and body.count('"لا توجد ملاحظات"') == 1


def test_repeated_envelopes_change_nothing(spark, tmp_path):
    schema = "sync_id string, reference string, pos long, title string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1", "r", 0, "a"), ("3", "r", 0, "b")], schema).coalesce(1).write.parquet(source)
    first = envelopes.run_available(spark, source, schema, out)
    assert sorted(r["status"] for r in first.collect()) == ["changed", "new"]
    spark.createDataFrame([("3", "r", 0, "c"), ("4", "r", 0, "b")], schema).coalesce(1).write.mode("append").parquet(source)
    again = envelopes.run_available(spark, source, schema, out)
    assert sorted(r["status"] for r in again.collect()) == ["changed", "duplicate", "new", "unchanged"]
    # a late envelope that was never seen counts as arriving now
    spark.createDataFrame([("2", "r", 0, "late")], schema).coalesce(1).write.mode("append").parquet(source)
    late = [r for r in envelopes.run_available(spark, source, schema, out).collect() if r["sync_id"] == "2"]
    assert [(r["status"], r["changed_fields"], r["previous"]["title"], r["first_seen"], r["last_seen"]) for r in late] == [("changed", "title", "b", "1", "2")]


def test_repeats_are_known_across_references(spark, tmp_path):
    """A second delivery of an envelope is a repeat even for references that the first did not hold;
    a stream started anew goes on from its state, and its history counts each envelope once."""
    schema = "sync_id string, reference string, pos long, title string, dry_run boolean, delivery string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    put(("1", "a", 0, "x", False, "d1"), ("1", "b", 1, "x", False, "d1"), ("1", "a", 0, "z", False, "d2"), ("2", "c", 0, "x", True, "d3"))
    first = {(r["sync_id"], r["reference"], r["status"], r["dry_run"]) for r in envelopes.run_available(spark, source, schema, out).collect()}
    assert first == {("1", "a", "new", False), ("1", "a", "duplicate", False), ("1", "b", "new", False), ("2", "c", "unchanged", True)}
    put(("1", "c", 0, "x", False, "d4"), ("2", "c", 0, "y", False, "d5"), ("1", "b", 0, "late part", False, "d1"))
    again = {(r["sync_id"], r["reference"], r["status"], r["dry_run"]) for r in envelopes.run_available(spark, source, schema, out).collect()} - first
    assert again == {("1", "c", "duplicate", False), ("2", "c", "new", False), ("1", "b", "changed", False)}
    assert sorted(tuple(r) for r in envelopes.stream_history(spark, out).collect()) == [("1", 2, 1, 0, 3), ("2", 1, 0, 0, 1)]


def test_declared_and_dry_envelopes(spark):
    items = spark.createDataFrame([("1", "a", 0, "x"), ("1", "b", 1, "x"), ("1", "c", 2, "x"), ("2", "a", 0, "y"), ("3", "a", 0, "z"), ("3", "d", 1, "z")], "sync_id string, reference string, pos long, title string")
    side = spark.createDataFrame([("1", False), ("2", True), ("3", False)], "sync_id string, dry_run boolean")
    declared = spark.createDataFrame([("1", "a", "new"), ("1", "a", "changed"), ("1", "b", "changed"), ("3", "d", "changed")], "sync_id string, reference string, kind string")
    diff = envelopes.envelope_diff(items, side, declared)
    assert {r["status"] for r in envelopes.envelope_diff(items, side).where("sync_id = '1'").collect()} == {"unchanged"}
    got = {(r["sync_id"], r["reference"]): (r["status"], r["changed_fields"]) for r in diff.collect()}
    assert got == {("1", "a"): ("new", ""), ("1", "b"): ("changed", "declared"), ("1", "c"): ("unchanged", ""), ("2", "a"): ("unchanged", ""), ("3", "a"): ("changed", "title"), ("3", "d"): ("new", "")}
    history = {r["sync_id"]: (r["added"], r["changed"], r["new_references"], r["changed_references"]) for r in envelopes.envelope_history(diff).collect()}
    assert history == {"1": (1, 1, ["a"], ["b"]), "3": (1, 1, ["d"], ["a"])}


def test_references_are_rewritten(spark):
    e = spark.createDataFrame([("job-1", 1, "ev-7"), ("job-1", 2, "ev-3"), ("job-2", 1, "ev-1"), ("job-2", 2, "ev-1")], "job_id string, pos int, evidence_id string")
    f = spark.createDataFrame([("job-1", 0, ["ev-3", "ev-9", "ev-7"]), ("job-1", 1, []), ("job-2", 0, ["ev-1"])], "job_id string, pos int, evidence_ids array<string>")
    got = {(r["job_id"], r["pos"]): r["evidence_ids"] for r in evidence.rekeyed_references(f, evidence.evidence_rekey(e)).collect()}
    assert got == {("job-1", 0): ["ev-job1-2", "ev-9", "ev-job1-1"], ("job-1", 1): []}


def test_requested_tenders_only(spark):
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "reference string, published_at string")
    none = spark.createDataFrame([], "reference string, display_name string, availability string")
    empty = lambda c: spark.createDataFrame([], f"reference string, {c} string")
    assert [r["reference"] for r in board.tender_board(t, empty("u"), empty("d"), none, t.where("reference = '2'")).collect()] == ["2"]


def test_smart_search_words(spark):
    df = spark.createDataFrame([(1, "مشاريع مكة المكرمة مجاني هذا الأسبوع"), (2, "000000000005 أي شيء")], "search_id int, text string")
    a, b = board.parse_searches(df).orderBy("search_id").collect()
    assert (a["regions"], a["fee_chip"], a["days"], a["needle"]) == (["مكة المكرمة"], "0", 7, "مشاريع")
    assert b["reference"] == "000000000005"


def test_searches_equal_a_loop(spark):
    """Every chip alone and together, short words, equal searches, several regions."""
    texts = ["طرق", "طرق مجاني", "مجاني", "هذا الشهر", "الرياض", "القصيم الرياض مدفوعة", "مكة المكرمة", "ab", "b", "ab مكة", "nothing at all", "000000000003", "", "طرق", "أعمال عامة", "zz yy هذا الأسبوع"]
    searches = spark.createDataFrame(list(enumerate(texts)), "search_id int, text string")
    words = ["طرق", "مياه", "ab", "b c", "yy", "أعمال عامة"]
    rows = [(f"{i:012d}", words[i % 6] + (" zz" if i % 5 == 0 else ""), words[(i // 2) % 6], words[(i // 3) % 6] if i % 7 else None, ["منطقة الرياض", "مكة المكرمة", "القصيم، الرياض", None][i % 4], float(i % 3) if i % 11 else None, f"2025-01-{1 + i % 28:02d} 09:59" if i % 6 else "") for i in range(90)]
    tenders = spark.createDataFrame(rows, "reference string, title string, agency string, activity string, region string, fee double, deadline string")
    got = {(r["search_id"], r["place"]): (r["reference"], r["n_hits"]) for r in board.saved_search_match(searches, tenders, "2025-01-05 00:00:00", top=3).collect()}
    want = {}
    for p in board.parse_searches(searches).collect():
        hits = []
        for ref, title, agency, activity, region, fee, deadline in rows:
            hay, other = " ".join(x for x in (activity, title) if x is not None), f"{title} {agency}"
            days = int(deadline[8:10]) if deadline else 0
            fine = (not p["regions"] or any(x in (region or "") for x in p["regions"])) and all(w in hay for w in p["specialties"]) and p["needle"] in other
            fine = fine and (p["fee_chip"] is None or fee is not None and (fee == 0 if p["fee_chip"] == "0" else fee > 0)) and (p["days"] is None or 5 <= days <= 4 + p["days"])
            if (ref == p["reference"]) if p["reference"] else fine:
                hits.append(ref)
        want |= {(p["search_id"], k): (h, len(hits)) for k, h in enumerate(hits[:3], 1)}
    assert got == want and len({i for i, _ in want}) > 12


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "region string")
    assert reports.region_stats(empty).count() == 0 and reports.region_share(empty).count() == 0
