"""What a query moves must not grow faster than its tables."""

from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import benchmarking as bench
from sluice.operators import board
from sluice.operators import evidence as ev
from sluice.plans import benchmark_queries as queries


def test_saved_searches_are_sent_to_the_tenders(spark):
    """Few searches go to each tender; the pieces of all tenders are not shuffled to meet them."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "200k")
    try:
        searches = spark.createDataFrame([(1, "صيانة"), (2, "000000000007"), (3, "مدفوعة تطوير")], "search_id int, text string")
        one = F.when(F.col("id") % 3 == 0, "صيانة طرق").otherwise("تطوير")
        tenders = spark.range(60_000).select(F.lpad(F.col("id").cast("string"), 12, "0").alias("reference"), one.alias("title"), F.lit("x").alias("agency"), F.lit(None).cast("string").alias("activity"), F.lit("الرياض").alias("region"), (F.col("id") % 2).cast("double").alias("fee"), F.lit("").alias("deadline"))
        out = board.saved_search_match(searches, tenders, "2025-01-05 00:00:00", top=2)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        met = [line for line in plan.splitlines() if "Join [key#" in line]
        assert met and all("BroadcastHashJoin" in line for line in met)
        assert {(r["search_id"], r["place"]): (r["reference"], r["n_hits"]) for r in out.collect()} == {
            (1, 1): ("0" * 12, 20_000), (1, 2): ("000000000003", 20_000), (2, 1): ("000000000007", 1), (3, 1): ("000000000001", 20_000), (3, 2): ("000000000005", 20_000),
        }
    finally:
        spark.conf.set(name, before)


def test_catalogs_come_of_one_sorted_stream(spark):
    """Documents, chunks and blocks are shuffled together once; no message goes to Python for each document."""
    documents = spark.createDataFrame([(1, "c", "pdf"), (2, "c", "pdf")], "document_id long, checksum string, document_type string")
    line = "عبارة من عبارات المستند رقم "
    blocks = spark.range(200).selectExpr("id % 2 + 1 AS document_id", "id AS ord", "'b' || id AS block_id", "'paragraph' AS kind", f"'{line}' || id AS text", "NULL AS table_id", "1 AS page_number")
    chunks = ev.doc_chunk(blocks)
    found = ev.candidate_catalog(documents, blocks, chunks)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "CoGroup" not in plan and "Join" not in plan
    rows = sorted((r["document_id"], r["idx"], r["excerpt"]) for r in found.collect())
    assert rows == [(d, i, f"{line}{2 * i + d - 1}") for d in (1, 2) for i in range(48)]
    assert {(r["generated"], r["excluded"]) for r in ev.catalog_summary(documents, blocks, chunks).collect()} == {(100, 52)}


def test_quoted_statements_do_not_go_to_python(spark):
    """A statement that its evidence quotes, whatever its blanks, is neither asked for its tokens nor kept; its forbidden assertion is."""
    runs = spark.createDataFrame([(1, 1)], "run_id int, case_id int")
    f = spark.createDataFrame([(1, "penalties", 0, "غرامة  يومية", ["k"]), (1, "penalties", 1, "غرامة مكة", ["k"])], "run_id int, category string, pos int, statement string, evidence_ids array<string>")
    e = spark.createDataFrame([(1, 0, "k", "نص غرامة يومية هنا")], "run_id int, pos int, evidence_id string, excerpt string")
    x = spark.createDataFrame([], "case_id int, ord int, expected_id string, category string, critical_terms array<string>, expected_value string, availability string, required boolean, candidate_ids array<string>")
    a = spark.createDataFrame([(1, 0, "fa", ["يومية"], None)], "case_id int, ord int, assertion_id string, terms array<string>, categories array<string>")
    cases = spark.createDataFrame([(1, False)], "case_id int, allow_derived boolean")
    b = bench.Benchmark(runs=runs, cases=cases, documents=None, candidates=None, fingerprints=None, chunks=None, expectations=x, assertions=a, reports=None, findings=f, evidence=e)
    got = {r["pos"]: (r["statement"], r["forbidden"], r["unfounded"]) for r in bench.checked(b).collect()}
    assert got == {0: (None, "fa", None), 1: ("غرامة مكة", None, "مكه")}


def test_what_is_gathered_for_scores_is_short(spark):
    """Scores and matches gather no values or ids of expectations, and read no more of findings than they judge by."""
    f = spark.createDataFrame([(1, 1, "penalties", 0, "x", ["k"], "info")], "run_id int, case_id int, category string, pos int, statement string, evidence_ids array<string>, severity string")
    x = spark.createDataFrame([(1, 0, "e", "penalties", ["x"], "v", "explicit", True, ["k"])], "case_id int, ord int, expected_id string, category string, critical_terms array<string>, expected_value string, availability string, required boolean, candidate_ids array<string>")
    runs = spark.createDataFrame([(1, 1)], "run_id int, case_id int")
    plan = bench.expectation_match(f, runs, x)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(n in plan.split("LogicalRDD")[0] for n in ("expected_id", "expected_value", "severity"))
    assert [tuple(r) for r in bench.expectation_match(f, runs, x).collect()] == [(1, "penalties", 0, 0)]


def test_ascii_words_are_not_folded(monkeypatch):
    """Of ASCII words only capitals change; the tokens are those of the fold."""
    seen = []
    monkeypatch.setattr(text, "fold_word", lambda w: seen.append(w) or w)
    assert text.tokens_of("(Monday); 1,234.5 is Test-M0A-12 offline.") == ["monday", "1234.5", "offline"]
    assert not seen


def test_single_blanks_are_left(spark):
    """Blanks of any kind become one; runs that begin with a blank or another sign, at the ends too."""
    rows = [" a  b\tc \n d  e ", "a b", "\n", None, "　x  "]
    got = [r["s"] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.squash(F.col("t")).alias("s")).collect()]
    assert got == ["a b c d e", "a b", "", "", "x"]


def _moved_once(df) -> None:
    """A query deals its documents out once; nothing else is shuffled, joined, kept or stored."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Repartition") + plan.count("Exchange") == 1 and "parquet" in plan
    assert not any(n in plan for n in ("Join", "InMemoryTableScan", "HashAggregate", "SortAggregate", "Window"))
    assert plan.count("FileScan") == 1


def test_verdicts_move_documents_once(spark, sf):
    """What run_verdict has on disk are its documents, once: sixteen gates and the scores are worked out in a run's row."""
    _moved_once(queries.run_verdict(spark, sf))


def test_gates_move_documents_once(spark, sf):
    """The same of run_gates: its runs' sixteen gates are rows of a dossier's row."""
    _moved_once(queries.run_gates(spark, sf))


def test_leaderboard_moves_documents_once(spark, sf):
    """model_leaderboard moves documents, and then counts per model; it joins and keeps nothing."""
    plan = queries.model_leaderboard(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and not any(n in plan for n in ("Join", "InMemoryTableScan"))


def test_dossiers_are_the_tables(spark, sf):
    """Verdicts of dossiers laid out from whole documents are those of the tables, gathered by run."""
    laid = {tuple(r) for r in queries.run_verdict(spark, sf).select("run_id", "verdict", "score").collect()}
    assert laid == {tuple(r) for r in bench.evaluate(queries._benchmark(spark, sf)).select("run_id", "verdict", "score").collect()}


def test_runs_without_rows(spark):
    """A run without case, report, findings or evidence has its verdict, from the gates that look at what is missing."""
    texts = lambda n: f"{n} array<string>"
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    sources = "sources array<struct<page_number:int,sheet_name:string,cell_range:string,section:string>>"
    b = bench.Benchmark(
        runs=table([(1, 1, "m", None), (2, 9, "m", None), (3, None, "m", None)], "run_id int, case_id int, model string, telemetry string"), cases=table([(1, 1, "sum", "cat", None)], "case_id int, document_id int, fixture_sha256 string, catalog_sha256 string, allow_derived boolean"),
        documents=table([(1, "sum", "pdf")], "document_id int, checksum string, document_type string"), candidates=table([(1, 1, "k")], "case_id int, document_id int, candidate_id string"), fingerprints=table([(1, "cat")], "case_id int, catalog_sha256 string"),
        chunks=table([], f"document_id int, chunk_id string, text string, {sources}"), expectations=table([(1, 0, "e", "penalties", ["x"], "x", "explicit", True, ["k"])], f"case_id int, ord int, expected_id string, category string, {texts('critical_terms')}, expected_value string, availability string, required boolean, {texts('candidate_ids')}"),
        assertions=table([], f"case_id int, ord int, assertion_id string, {texts('terms')}, {texts('categories')}"), reports=table([], f"run_id int, summary string, {texts('warnings')}, evidence_sufficiency string, confidence string, {texts('sufficiency_ids')}, {texts('extra_fields')}"),
        findings=table([], f"run_id int, category string, pos int, statement string, severity string, confidence string, {texts('evidence_ids')}"), evidence=table([], "run_id int, pos int, evidence_id string, document_id int, source_type string, page_number int, sheet_name string, cell_range string, section string, excerpt string, chunk_id string"),
    )
    assert {r["run_id"]: (r["verdict"], r["score"]) for r in bench.evaluate(b).collect()} == {1: ("PASS", 30.0), 2: ("INVALID_BENCHMARK_INPUT", None), 3: ("INVALID_BENCHMARK_INPUT", None)}
    failed = {(r["run_id"], r["gate"]) for r in bench.run_gates(b).where("not passed").collect()}
    assert failed == {(i, g) for i in (2, 3) for g in ("fixture", "catalog", "fingerprint", "ground-truth")}
