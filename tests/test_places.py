"""Chunks, candidates and their grounding over pages, sheets with cells, and sections."""

import hashlib
import json
import random

import pytest

from sluice.operators import evidence as ev
from sluice.plans import all_queries
from sluice.plans import evidence_queries as plans

BLOCKS = "document_id long, ord int, block_id string, kind string, text string, table_id string, page_number int, sheet_name string, cell_range string, section string"


def place(r):
    """What a chunk keeps of a block's place."""
    if r["page_number"] is not None:
        return (r["page_number"], None, None, None)
    return (None, r["sheet_name"], r["cell_range"], None) if (r["sheet_name"] or "").strip() else (None, None, None, r["section"])


@pytest.fixture(scope="module")
def parts(spark, sf):
    files, blocks, chunks = plans._parts(spark, sf)
    return files, blocks, chunks.cache()


def test_chunks_of_whole_documents(parts):
    """Every chunk is the lines of its pieces with their places; all pieces come, in order."""
    _, blocks, chunks = parts
    of = {}
    for r in blocks.collect():
        of.setdefault(r["document_id"], {})[r["block_id"]] = r
    rows = {}
    for c in sorted(chunks.collect(), key=lambda c: (c["document_id"], c["ordinal"])):
        rows.setdefault(c["document_id"], []).append(c)
    assert set(rows) == set(of)
    tables = cut = several = 0
    for doc, found in rows.items():
        pieces = {}
        for b in sorted(of[doc].values(), key=lambda b: b["ord"]):
            lines = ev.cut_text(b["text"] or "", ev.MAX_CHARS)
            pieces |= {f"{b['block_id']}#p{i}" if len(lines) > 1 else b["block_id"]: (b, t) for i, t in enumerate(lines, 1)}
        seen = {}
        for n, c in enumerate(found, 1):
            own = [pieces[i] for i in c["block_ids"]]
            assert c["ordinal"] == n and c["char_count"] == len(c["text"]) <= ev.MAX_CHARS
            assert c["text"] == "\n".join(t for _, t in own)
            assert [tuple(s) for s in c["sources"]] == list(dict.fromkeys(place(b) for b, _ in own))
            assert c["table_ids"] == list(dict.fromkeys(b["table_id"] for b, _ in own if b["table_id"]))
            seen |= dict.fromkeys(i for i in c["block_ids"] if i not in seen)
            tables, cut, several = tables + bool(c["table_ids"]), cut + any("#" in i for i in c["block_ids"]), several + any("\n" in t for _, t in own)
        assert list(seen) == list(pieces)
    assert tables and several


def test_catalog_of_whole_documents(spark, parts):
    """The catalogs are what plain loops make of blocks and chunks, cut at the first that is too much."""
    files, blocks, chunks = parts
    types = {f["document_id"]: f for f in files.collect()}
    texts, first = {}, {}
    for c in sorted(chunks.collect(), key=lambda c: (c["document_id"], c["ordinal"])):
        texts[c["chunk_id"]] = " ".join(c["text"].split())
        for i in c["block_ids"]:
            first.setdefault((c["document_id"], i), c["chunk_id"])
    entries = {}
    for doc, i in first:
        entries.setdefault((doc, i.split("#p")[0]), []).append(i)
    want, counts, made = [], {}, {}
    for b in sorted(blocks.collect(), key=lambda b: (b["document_id"], b["ord"])):
        doc = b["document_id"]
        where = f"page:{b['page_number']}" if b["page_number"] is not None else f"sheet:{b['sheet_name']}!{b['cell_range']}" if b["sheet_name"] is not None else f"section:{b['section']}"
        for i in sorted(entries[doc, b["block_id"]], key=lambda i: int(i.partition("#p")[2] or 0)):
            chunk = first[doc, i]
            for start, end, excerpt in ev.segments(b["text"] or ""):
                if excerpt in texts[chunk]:
                    key = "|".join([types[doc]["checksum"], str(doc), i, chunk, where, str(start), str(end), excerpt])
                    made.setdefault(doc, []).append((hashlib.sha256(key.encode()).hexdigest()[:24], b, excerpt, chunk, i, start, end))
    for doc, found in made.items():
        total = kept = 0
        for digest, b, excerpt, chunk, i, start, end in found:
            if kept == ev.MAX_CANDIDATES or total + len(excerpt) > ev.MAX_TOTAL:
                break
            want.append((doc, kept, f"cand-{digest}", types[doc]["document_type"], b["page_number"], b["sheet_name"], b["cell_range"], b["section"], excerpt, chunk, i, start, end))
            kept, total = kept + 1, total + len(excerpt)
        counts[doc] = (len(found), len(found) - kept, total)
    got = ev.candidate_catalog(files, blocks, chunks)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[3] for w in want} == {"pdf", "xlsx", "docx"} and any(n[1] for n in counts.values())
    assert {r[0]: tuple(r)[1:] for r in ev.catalog_summary(files, blocks, chunks).collect()} == {d: counts.get(d, (0, 0, 0)) for d in types}
    lines = {}
    for d, n, c, t, page, sheet, cells, section, excerpt, chunk, block, start, end in want:
        values = {"index": n, "candidateId": c, "documentId": str(d), "sourceType": t, "excerpt": excerpt, "chunkId": chunk, "blockId": block, "startOffset": start, "endOffset": end, "pageNumber": page, "sheetName": sheet, "cellRange": cells, "section": section}
        lines.setdefault(d, []).append(json.dumps(values, ensure_ascii=False, separators=(",", ":")))
    digests = {r["document_id"]: r["catalog_sha256"] for r in ev.catalog_fingerprint(got).collect()}
    assert digests == {d: hashlib.sha256("\n".join(x).encode()).hexdigest() for d, x in lines.items()}


def test_candidates_are_grounded(spark, sf):
    rows = all_queries()["catalog_grounding"](spark, sf).collect()
    assert rows and all(r["grounded"] for r in rows)


def test_tables_over_several_chunks(spark):
    """A sheet's table that fills several chunks brings its header again; every row has its own cells."""
    rng = random.Random(3)
    rows = [(1, n, f"r{n}", "table-row", f"صف {n} " + "بند " * rng.randint(20, 40), "sheet-1", None, "الكميات", f"A{n + 1}:C{n + 1}", None) for n in range(60)]
    found = ev.doc_chunk(spark.createDataFrame(rows, BLOCKS)).orderBy("ordinal").collect()
    assert len(found) > 3 and all(c["table_ids"] == ["sheet-1"] for c in found)
    for c in found:
        assert {(s["sheet_name"], s["cell_range"]) for s in c["sources"]} == {("الكميات", rows[int(b[1:])][8]) for b in c["block_ids"]}


def test_places_are_told_apart(spark):
    """Equal texts in two cells or sections are two candidates, each with its own id; evidence in a
    cell that its chunk lacks is not grounded; a block without a place gives none."""
    rows = [
        (1, 0, "a", "table-row", "نص الخلية الأولى", "t", None, "ورقة", "A1:B1", None), (1, 1, "b", "table-row", "نص الخلية الأولى", "t", None, "ورقة", "A2:B2", None),
        (2, 0, "a", "paragraph", "فقرة من النص الطويل", None, None, None, None, "أول"), (2, 1, "b", "paragraph", "فقرة من النص الطويل", None, None, None, None, "ثان"), (2, 2, "c", "paragraph", "فقرة بلا أي موضع", None, None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, BLOCKS)
    files = spark.createDataFrame([(1, None, "xlsx"), (2, "sum", "docx"), (3, "none", "pdf")], "document_id long, checksum string, document_type string")
    chunks = ev.doc_chunk(blocks)
    got = ev.candidate_catalog(files, blocks, chunks).orderBy("document_id", "idx").collect()
    assert [(r["document_id"], r["block_id"], r["sheet_name"], r["cell_range"], r["section"]) for r in got] == [(1, "a", "ورقة", "A1:B1", None), (1, "b", "ورقة", "A2:B2", None), (2, "a", None, None, "أول"), (2, "b", None, None, "ثان")]
    key = f"|1|b|{got[1]['chunk_id']}|sheet:ورقة!A2:B2|0|16|نص الخلية الأولى"
    assert got[1]["candidate_id"] == "cand-" + hashlib.sha256(key.encode()).hexdigest()[:24]
    assert {tuple(r) for r in ev.catalog_summary(files, blocks, chunks).collect()} == {(1, 2, 0, 32), (2, 2, 0, 38), (3, 0, 0, 0)}
    shown = spark.createDataFrame([(1, 0, 1, "xlsx", got[0]["chunk_id"], None, "ورقة", "A1:B1", None, "نص الخلية الأولى"), (2, 0, 1, "xlsx", got[0]["chunk_id"], None, "ورقة", "A9:B9", None, "نص الخلية الأولى"), (3, 0, 2, "docx", got[2]["chunk_id"], None, None, None, "ثالث", "فقرة من النص الطويل")],
        "run_id long, pos int, document_id long, source_type string, chunk_id string, page_number int, sheet_name string, cell_range string, section string, excerpt string")
    own = spark.createDataFrame([(1, 1, "xlsx"), (2, 1, "xlsx"), (3, 2, "docx")], "run_id long, document_id long, document_type string")
    assert {r["run_id"]: r["first_reason"] for r in ev.grounding_check(shown, own, chunks).collect()} == {1: None, 2: "place", 3: "place"}


def test_fingerprint_of_broken_catalogs(spark):
    fine = (1, 0, "cand-a", "pdf", 1, "x", "k", "b", 0, 1)
    rows = [fine, (2, *fine[1:3], None, *fine[4:]), (3, *fine[1:8], -1, 1), (4, *fine[1:4], None, *fine[5:])]
    table = spark.createDataFrame(rows, "document_id long, idx int, candidate_id string, source_type string, page_number int, excerpt string, chunk_id string, block_id string, start_offset int, end_offset int")
    got = {r["document_id"]: r["catalog_sha256"] for r in ev.catalog_fingerprint(table).collect()}
    assert got[1] and got[4] and got[1] != got[4] and got[2] is None and got[3] is None
