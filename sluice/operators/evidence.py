"""The document-evidence pipeline: chunks, candidates, findings, reports, grounding and merging."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, chain
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text
from ..sources.storage import stored

MAX_CHARS, OVERLAP = 1200, 120
#: The places that a block or a piece of evidence can have, a page, a sheet with its cells, or a section.
PLACES = ("page_number", "sheet_name", "cell_range", "section")
_SOURCE = pa.struct([(c, pa.int32() if c == "page_number" else pa.string()) for c in PLACES])
PLACE = "struct<page_number:int,sheet_name:string,cell_range:string,section:string>"
CHUNKS = f"document_id long, ordinal int, chunk_id string, text string, char_count int, block_ids array<string>, sources array<{PLACE}>, table_ids array<string>"


def with_places(table: DataFrame) -> DataFrame:
    """table with all PLACES, null where it has no such column."""
    kinds = {"page_number": "int"}
    return table.withColumns({c: (F.col(c) if c in table.columns else F.lit(None)).cast(kinds.get(c, "string")) for c in PLACES})


def _source() -> Column:
    """What a chunk keeps of a block's place: its page, else its sheet and cells, else its section."""
    paged, on_sheet = F.col("page_number").isNotNull(), F.trim(F.coalesce("sheet_name", F.lit(""))) != ""
    own = {"page_number": F.col("page_number"), "sheet_name": F.when(~paged & on_sheet, F.col("sheet_name")), "cell_range": F.when(~paged & on_sheet, F.col("cell_range")), "section": F.when(~paged & ~on_sheet, F.col("section"))}
    return F.struct(*[c.alias(n) for n, c in own.items()])


def _reach(ends: list[int], at: int, limit: int) -> int:
    """How far a run from item `at` goes within the limit, blanks between items counted; ends are the
    running sums of sizes, each raised by one."""
    return bisect_right(ends, ends[at] + limit + 1) - 1


def cut_text(value: str, limit: int) -> list[str]:
    """A text in lines of at most `limit` characters, broken at white space; a longer word is cut."""
    if len(value) <= limit:
        return [value]
    atoms = [w[i : i + limit] for w in value.split() for i in range(0, len(w), limit)]
    ends, at, lines = [0, *accumulate(len(w) + 1 for w in atoms)], 0, []
    while at < len(atoms):
        to = max(at + 1, _reach(ends, at, limit))
        lines.append(" ".join(atoms[at:to]))
        at = to
    return lines


def pack(sizes: list[int], heading: list[bool], table: list[str | None], limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[list[int]]:
    """Greedy chunks of one document's pieces, as lists of their numbers. What a chunk carries over to
    the next: a heading at its end, which leaves it, or else its last small pieces; and the header of
    a table that goes on, where it fits. How far a chunk reaches is looked up in running sums."""
    ends = [0, *accumulate(n + 1 for n in sizes)]
    header: dict[str, int] = {}
    for k, t in enumerate(table):
        if t:
            header.setdefault(t, k)
    chunks: list[list[int]] = []
    carry: list[int] = []
    at = 0
    while at < len(sizes):
        taken = sum(sizes[k] + 1 for k in carry)
        to = max(at if carry else at + 1, _reach(ends, at, limit - taken))
        chunk = [*carry, *range(at, to)]
        at = to
        if at == len(sizes):
            return [*chunks, chunk]
        fits = lambda ks: sum(sizes[k] + 1 for k in ks) + sizes[at] <= limit  # noqa: B023, E731
        if heading[chunk[-1]]:
            own, carry = chunk[:-1], chunk[-1:]
            chunks += [own] * bool(own)
            if not fits(carry):
                chunks.append(carry)
                carry = []
        else:
            chunks.append(chunk)
            small = bisect_right(list(accumulate(sizes[k] for k in reversed(chunk))), overlap)
            carry = chunk[max(1, len(chunk) - small) :]
        first = header.get(table[at]) if table[at] else None
        if first is not None and first != at and all(table[k] != table[at] for k in carry) and fits([*carry, first]):
            carry = [*carry, first]
    return chunks


def _chunks_of(doc: int, blocks: list[tuple], limit: int, overlap: int) -> list[tuple]:
    """Rows of CHUNKS for one document's ordered blocks (block_id, kind, text, source, table_id)."""
    pieces = [(f"{b}#p{i}" if len(cut) > 1 else b, kind, t, source, table) for b, kind, value, source, table in blocks for cut in [cut_text(value, limit)] for i, t in enumerate(cut, 1)]
    found = pack([len(p[2]) for p in pieces], [p[1] == "heading" for p in pieces], [p[4] for p in pieces], limit, overlap)
    rows = []
    for n, own in enumerate(([pieces[k] for k in chunk] for chunk in found), 1):
        ids, body = [p[0] for p in own], "\n".join(p[2] for p in own)
        key = hashlib.sha256(f"{doc}{n}{','.join(ids)}".encode()).hexdigest()[:16]
        sources = {tuple(p[3].values()): p[3] for p in own}
        rows.append((doc, n, f"chk-{key}", body, len(body), ids, list(sources.values()), list(dict.fromkeys(p[4] for p in own if p[4]))))
    return rows


def doc_chunk(blocks: DataFrame, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of every document (document_id, ord, block_id, kind, text, table_id and any of PLACES);
    sources are the distinct places of a chunk's blocks. Blocks come sorted by document, so a task streams through whole documents one after another and
    holds one at a time."""
    limit = max(40, limit)
    overlap = max(0, min(overlap, limit - 1))
    schema = pa.schema([("document_id", pa.int64()), ("ordinal", pa.int32()), ("chunk_id", pa.string()), ("text", pa.string()), ("char_count", pa.int32()), ("block_ids", pa.list_(pa.string())), ("sources", pa.list_(_SOURCE)), ("table_ids", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held = None, []
        for batch in batches:
            out = []
            for d, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != doc and held:
                    out += _chunks_of(doc, held, limit, overlap)
                    held = []
                doc = d
                held.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)
        if held:
            out = _chunks_of(doc, held, limit, overlap)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    own = with_places(blocks).select(F.col("document_id").cast("long").alias("document_id"), "ord", "block_id", "kind", F.coalesce("text", F.lit("")).alias("text"), _source().alias("source"), "table_id")
    return own.repartition("document_id").sortWithinPartitions("document_id", "ord").drop("ord").mapInArrow(run, CHUNKS)


MAX_CANDIDATES, MAX_TOTAL, MAX_EXCERPT, MIN_EXCERPT = 48, 6000, 400, 8
_SENTENCE = re.compile(r"(?<=[.!؟?؛…])\s+")
#: A piece of at most MAX_EXCERPT characters: all that is left, or up to the last blank of the second half, or a hard cut.
_CUT = re.compile(rf" ?(.{{1,{MAX_EXCERPT}}}$|.{{{MAX_EXCERPT // 2},{MAX_EXCERPT - 1}}}(?= )|.{{{MAX_EXCERPT}}})", re.DOTALL)


def segments(value: str) -> list[tuple[int, int, str]]:
    """(start, end, excerpt) in the block's text with single blanks: lines, else sentences, else cuts
    at blanks; repeats dropped; short ones joined to a neighbour or dropped."""
    flat = " ".join(value.split())
    lines = (" ".join(x.split()) for x in re.split(r"\r?\n", value))
    parts = chain.from_iterable([x] if len(x) <= MAX_EXCERPT else _SENTENCE.split(x) for x in lines)
    # where each piece lies, looked for after the one before it
    found, at = [], 0
    for piece in dict.fromkeys(chain.from_iterable(map(_CUT.findall, parts))):
        if (start := flat.find(piece, at)) >= 0:
            at = start + len(piece)
            found.append((start, at))
    short = lambda s: s[1] - s[0] < MIN_EXCERPT
    joins = lambda s, t: t[1] - s[0] <= MAX_EXCERPT
    spans: list[tuple[int, int]] = []
    for own in found:
        if spans and short(spans[-1]) and joins(spans[-1], own):
            own = (spans.pop()[0], own[1])
        spans.append(own)
    if len(spans) > 1 and short(spans[-1]) and joins(spans[-2], spans[-1]):
        spans[-2:] = [(spans[-2][0], spans[-1][1])]
    return [(s, e, flat[s:e]) for s, e in spans if MIN_EXCERPT <= e - s <= MAX_EXCERPT]


_FOUND = pa.schema([("document_id", pa.int64()), ("idx", pa.int32()), ("running", pa.int64()), ("source", _SOURCE), ("block_id", pa.string()), ("chunk_id", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("excerpt", pa.string()), ("checksum", pa.string()), ("source_type", pa.string())])
_FOUND_SQL = f"document_id long, idx int, running long, source {PLACE}, block_id string, chunk_id string, start_offset int, end_offset int, excerpt string, checksum string, source_type string"


def _entry(name: str) -> tuple[str, int]:
    """The block that an entry of a chunk names, and which part of it."""
    block, _, part = name.rpartition("#p")
    return (block, int(part)) if block and part.isdigit() else (name, 0)


def _candidates_of(doc: int, file: tuple, chunks: list[tuple], blocks: Iterator[tuple], every: bool) -> Iterator[tuple]:
    """The candidates of one document (checksum, type) in order, from its chunks (chunk_id, text,
    block_ids) and blocks (block_id, text, source); without `every` none after the catalog is full."""
    holders: dict[str, dict[int, tuple]] = {}
    for chunk, body, names in chunks:
        for name in names or []:
            block, part = _entry(name)
            holders.setdefault(block, {}).setdefault(part, (name, chunk, body or ""))
    n = total = 0
    for block, value, source in blocks:
        held = sorted(holders.get(block, {}).items())
        spans = segments(value or "") if held and (every or (n < MAX_CANDIDATES and total <= MAX_TOTAL)) else []
        for _, (name, chunk, body) in held if spans else []:
            for start, end, excerpt in spans:
                if excerpt in body:
                    total += len(excerpt)
                    yield doc, n, total, source, name, chunk, start, end, excerpt, *file
                    n += 1


def _candidates(documents: DataFrame, blocks: DataFrame, chunks: DataFrame, every: bool = False) -> DataFrame:
    """Candidates of each document in order, each with its number and the characters up to it: all,
    or without `every` at least those that _fits keeps. A document's row, its chunks and its blocks come
    one after another in one sorted stream, as in doc_chunk; a task holds one document's at a time."""
    placed = F.col("page_number").isNotNull() | F.col("sheet_name").isNotNull() | F.col("section").isNotNull()
    kind = F.col("document_type") if "document_type" in documents.columns else F.lit("pdf")
    columns = {"at": "long", "name": "string", "text": "string", "source": PLACE, "block_ids": "array<string>"}

    def side(table: DataFrame, number: int, **own: Column | str) -> DataFrame:
        given = {c: own.get(c, F.lit(None)) for c in columns}
        return table.select(F.col("document_id").cast("long").alias("document_id"), F.lit(number).alias("side"), *[(F.col(x) if isinstance(x, str) else x).cast(columns[c]).alias(c) for c, x in given.items()])

    files = side(documents, 0, name="checksum", text=kind)
    held = side(chunks, 1, at="ordinal", name="chunk_id", text=text.squash(F.col("text")), block_ids="block_ids")
    own = side(with_places(blocks).where(placed), 2, at="ord", name="block_id", text="text", source=F.struct(*PLACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(doc: int, held: list[list[tuple]]) -> Iterator[tuple]:
            return _candidates_of(doc, held[0][-1][:2], held[1], held[2], every) if all(held) else iter(())

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FOUND), _FOUND, strict=True)], schema=_FOUND)

        doc, held = None, [[], [], []]
        for batch in batches:
            rows = []
            for d, s, _, name, value, source, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != doc:
                    rows += found(doc, held)
                    doc, held = d, [[], [], []]
                held[s].append((name, value, source if s == 2 else ids))
            yield table(rows)
        yield table(list(found(doc, held)))

    stream = files.unionByName(held).unionByName(own).where("document_id is not null").repartition("document_id").sortWithinPartitions("document_id", "side", "at")
    found = stream.mapInArrow(run, _FOUND_SQL).select("*", "source.*")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sheet = F.concat(F.lit("sheet:"), "sheet_name", F.lit("!"), text_of("cell_range"))
    place = F.coalesce(F.concat(F.lit("page:"), "page_number"), sheet, F.concat(F.lit("section:"), text_of("section")))
    key = F.concat_ws("|", text_of("checksum"), text_of("document_id"), "block_id", text_of("chunk_id"), place, "start_offset", "end_offset", "excerpt")
    return found.withColumn("candidate_id", F.concat(F.lit("cand-"), F.substring(F.sha2(key, 256), 1, 24)))


def _fits() -> Column:
    """Whether a catalog has room for a candidate: as running sums only grow, for a prefix."""
    return (F.col("idx") < MAX_CANDIDATES) & (F.col("running") <= MAX_TOTAL)


def candidate_catalog(documents: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Literal excerpts of each document in block order, one per segment and chunk that holds it, each
    with its block's place; blocks without a place give none. Cut to a prefix of at most 48 candidates
    and 6000 characters. documents: document_id, checksum, document_type (pdf, if there is none);
    blocks: document_id, ord, block_id, text and any of PLACES."""
    return _candidates(documents, blocks, chunks).where(_fits()).select("document_id", "idx", "candidate_id", "source_type", *PLACES, "excerpt", "chunk_id", "block_id", "start_offset", "end_offset")


def catalog_summary(documents: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document how many candidates it gives, how many of them its catalog has no room for, and
    the characters of those kept. Documents without candidates count none."""
    per = _candidates(documents, blocks, chunks, every=True).groupBy("document_id").agg(F.count("*").alias("generated"), F.count_if(~_fits()).alias("excluded"), F.max(F.when(_fits(), F.col("running"))).alias("excerpt_chars"))
    return documents.select("document_id").join(per, "document_id", "left").na.fill(0, ["generated", "excluded", "excerpt_chars"])


def catalog_fingerprint(candidates: DataFrame) -> DataFrame:
    """SHA-256 of each catalog's canonical lines in index order: thirteen fields, missing places
    written as null. Null for a catalog in which another field is missing or a number is negative."""
    names = {"index": "idx", "candidateId": "candidate_id", "documentId": "document_key", "sourceType": "source_type", "excerpt": "excerpt", "chunkId": "chunk_id", "blockId": "block_id", "startOffset": "start_offset", "endOffset": "end_offset", "pageNumber": "page_number", "sheetName": "sheet_name", "cellRange": "cell_range", "section": "section"}
    whole = F.lit(True)
    for c in names.values():
        if c in ("idx", "start_offset", "end_offset"):
            whole = whole & F.coalesce(F.col(c) >= 0, F.lit(False))
        elif c not in PLACES:
            whole = whole & F.col(c).isNotNull()
    whole = whole & F.coalesce(F.col("page_number") >= 0, F.lit(True))
    line = F.when(whole, F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()]), {"ignoreNullFields": "false"}))
    lined = with_places(candidates).withColumn("document_key", F.col("document_id").cast("string")).select("document_id", F.struct("idx", line.alias("line")).alias("l"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n"), 256)
    return lined.groupBy("document_id").agg(F.when(F.bool_and(F.col("l.line").isNotNull()), digest).alias("catalog_sha256"), F.count("*").alias("candidates"))


#: Category, label and pattern of the rule-based findings, in order.
RULES = (
    ("bidBonds", "الضمان الابتدائي", r"الضمان الابتدائي[:：]?\s*([^\n.]+)"),
    ("guarantees", "الضمان النهائي", r"الضمان النهائي[:：]?\s*([^\n.]+)"),
    ("penalties", "الغرامات", r"غرامة[^:\n]*[:：]?\s*([^\n.]+)"),
    ("deadlines", "المواعيد", r"(?:آخر موعد|مدة العقد|الموعد)[^\n:]*[:：]?\s*([^\n.]+)"),
    ("eligibilityRequirements", "شروط الأهلية", r"شروط الأهلية[:：]?\s*([^\n.]+)"),
    ("requiredExperience", "الخبرة المطلوبة", r"الخبرة المطلوبة[:：]?\s*([^\n.]+)"),
    ("scopeOfWork", "نطاق العمل", r"نطاق العمل[:：]?\s*([^\n.]+)"),
    ("unclearItems", "بند غير واضح", r"غير واضح[:：]?\s*([^\n.]+)"),
    ("questionsForAuthority", "", r"سؤال للجهة[:：]?\s*([^\n؟?]+[؟?]?)"),
)
#: A block with one of these is a risk as a whole: found by a search, as a pattern around it is matched recursively and ends the stack on long blocks.
RISK = ("contractualRisks", r"غرامة تأخير|فسخ|إنهاء العقد")


def rule_findings(blocks: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, chunks: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """One finding with its literal evidence per block and rule that fits, numbered per document.

    chunks (document_id, ordinal, chunk_id, block_ids) ties each piece of evidence to the first chunk
    that holds its block or a part of it; blocks in no chunk then give no findings. tables
    (document_id, table_ord, table_id, location, rows; an array of rows, the header first) adds a
    summary of each table whose first block is in a chunk, and its quantities where the header names
    such; both share one evidence. Evidence is numbered by block and rule, tables after the text."""
    hit = lambda i, c, label, found: F.struct(F.lit(i).alias("rule"), F.lit(c).alias("category"), F.lit(label).alias("label"), found.alias("hit"))
    risk = F.when(F.col("text").rlike(RISK[1]), F.col("text")).otherwise("")
    hits = F.array(*[hit(i, c, label, F.regexp_extract("text", p, 1)) for i, (c, label, p) in enumerate(rules)], hit(len(rules), RISK[0], "", risk))
    found = blocks.select("document_id", "ord", "block_id", "text", F.explode(F.filter(hits, lambda h: h["hit"] != "")).alias("h"))
    statement = F.when(F.col("h.label") == "", F.substring(F.trim("h.hit"), 1, 160)).otherwise(F.concat(F.col("h.label"), F.lit(": "), F.trim("h.hit")))
    severity = F.when(F.col("h.category").isin("unclearItems", RISK[0]), "medium").otherwise("info")
    rows = found.select("document_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("h.rule").alias("rule"), "block_id", F.col("h.category").alias("category"), statement.alias("statement"), severity.alias("severity"), F.substring("text", 1, 200).alias("excerpt"))
    if tables is not None:
        head = blocks.where("table_id is not null").groupBy("document_id", "table_id").agg(F.min_by(F.struct("block_id", "text"), "ord").alias("b"))
        t = tables.where(F.size("rows") > 0).join(head, ["document_id", "table_id"])
        names = F.array_join(F.col("rows")[0], " | ")
        summary = F.concat(F.format_string("جدول (%s): %d صفًا — الأعمدة: ", "location", F.size("rows")), names)
        body = F.array_join(F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1))), lambda r: F.array_join(r, " = ")), "؛ ")
        two = F.array(F.struct(F.lit(0).alias("rule"), F.lit("boqSummary").alias("category"), summary.alias("statement")), F.when((F.size("rows") > 1) & names.rlike("الكمية|القيمة"), F.struct(F.lit(1).alias("rule"), F.lit("criticalQuantities").alias("category"), F.concat("location", F.lit(": "), F.substring(body, 1, 300)).alias("statement"))))
        told = t.select("document_id", F.col("table_ord").cast("long").alias("ord"), "b", F.explode(F.filter(two, lambda x: x.isNotNull())).alias("f"))
        rows = rows.unionByName(told.select("document_id", F.lit(1).alias("part"), "ord", F.col("f.rule").alias("rule"), F.col("b.block_id").alias("block_id"), F.col("f.category").alias("category"), F.col("f.statement").alias("statement"), F.lit("info").alias("severity"), F.substring("b.text", 1, 200).alias("excerpt")))
    if chunks is not None:
        of_block = chunks.select("document_id", "ordinal", "chunk_id", F.explode("block_ids").alias("b")).select("document_id", F.regexp_replace("b", "#.*$", "").alias("block_id"), "ordinal", "chunk_id")
        rows = rows.join(of_block.groupBy("document_id", "block_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id")), ["document_id", "block_id"])
    # a table's two findings share their evidence: they count as one
    n = F.dense_rank().over(W.partitionBy("document_id").orderBy("part", "ord", F.when(F.col("part") == 0, F.col("rule"))))
    return rows.select("document_id", F.concat(F.lit("ev-"), n.cast("string")).alias("evidence_id"), "block_id", "category", "statement", "severity", "excerpt", *(["chunk_id"] if chunks is not None else []))


def rule_report(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Per document what its rule findings amount to: with evidence partial and medium, on the first
    piece; without, insufficient and low."""
    per = findings.groupBy("document_id").agg(F.count_distinct("evidence_id").alias("n_evidence"), F.count("*").alias("n_findings"))
    j = documents.select("document_id").join(per, "document_id", "left")
    some = F.col("n_evidence").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("document_id", zero("n_evidence"), zero("n_findings"), F.when(some, "partial").otherwise("insufficient").alias("evidence_sufficiency"), F.when(some, "medium").otherwise("low").alias("confidence"), F.when(some, "ev-1").alias("sufficiency_id"))


# --- selections and reports -----------------------------------------------------------------------

# The categories in their order, and the values of three scales.
CATEGORIES = ("scopeOfWork", "eligibilityRequirements", "requiredExperience", "bidBonds", "guarantees", "penalties", "deadlines", "boqSummary", "criticalQuantities", "unclearItems", "questionsForAuthority", "contractualRisks")
SEVERITIES, CONFIDENCES, SUFFICIENCIES = ("info", "low", "medium", "high", "critical"), ("low", "medium", "high"), ("sufficient", "partial", "insufficient")


def _codes(*rules: Column) -> Column:
    return F.array_join(F.filter(F.array(*rules), lambda r: r.isNotNull()), ",")


SELECTION_FIELDS = (*CATEGORIES, "evidenceSufficiency", "confidence", "sufficiencyEvidenceIds")
FINDING_FIELDS = ("severity", "confidence", "evidenceIds")
#: Codes of a selection's faults, in the order in which they are listed.
SELECTION_CODES = ("not-an-object", "missing-field", "unknown-field", "not-a-list", "finding-fields", "severity", "confidence", "evidence-ids", "repeated-id", "unknown-id", "sufficiency", "own-confidence", "sufficiency-ids", "sufficiency-repeated-id", "sufficiency-unknown-id", "sufficiency-without-ids")


def _strings(json: Column) -> Column:
    """A JSON array of non-empty strings, else null."""
    found = F.from_json(json, "array<string>")
    quoted = json.rlike(r'^\s*\[\s*("(?:[^"\\\\]|\\\\.)*"\s*(,\s*"(?:[^"\\\\]|\\\\.)*"\s*)*)?\]\s*$')
    return F.when(quoted & F.forall(found, lambda x: F.trim(x) != ""), found)


def parsed_selections(selections: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selections (selection_id, document_id, body, a JSON object), read once and stored: their own
    fields as a map of JSON texts; their lists, a row for each finding in category order (pos null:
    an empty list or none); every id that they name with its candidate's excerpt (null: unknown), those
    of the sufficiency under the category after the last. candidates: document_id, candidate_id, excerpt."""
    tops = stored(selections.select("selection_id", "document_id", F.from_json("body", "map<string,string>").alias("top")).withColumn("own_ids", _strings(F.col("top")["sufficiencyEvidenceIds"])))
    listed = F.array(*[F.struct(F.lit(i).alias("cat_ord"), F.lit(c).alias("category"), F.col("top")[c].alias("json")) for i, c in enumerate(CATEGORIES)])
    lists = tops.where("top is not null").select("selection_id", "document_id", F.explode(listed).alias("c")).select("selection_id", "document_id", "c.*")
    findings = lists.select("selection_id", "document_id", "cat_ord", "category", F.coalesce(F.col("json").startswith("["), F.lit(False)).alias("is_list"), F.posexplode_outer(F.from_json("json", "array<map<string,string>>")).alias("pos", "f"))
    findings = stored(findings.withColumn("ids", _strings(F.col("f")["evidenceIds"])))
    named = findings.select("selection_id", "document_id", "cat_ord", "pos", F.posexplode("ids").alias("at", "candidate_id"))
    named = named.unionByName(tops.select("selection_id", "document_id", F.lit(len(CATEGORIES)).alias("cat_ord"), F.lit(0).alias("pos"), F.posexplode("own_ids").alias("at", "candidate_id")))
    known = candidates.groupBy("document_id", "candidate_id").agg(F.first(F.struct("excerpt")).alias("found"))
    return tops, findings, stored(named.join(known, ["document_id", "candidate_id"], "left"))


def selection_audit(selections: DataFrame, candidates: DataFrame, parsed: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Codes of the rules that each model selection breaks: its fields and no others, twelve lists of
    findings with three fields each, values of the scales, ids that are some, known and unlike, and
    sufficiency with ids where it is claimed. Every rule looks at every finding; a selection that
    lacks fields is not looked into further. candidates: document_id, candidate_id, excerpt."""
    tops, findings, named = parsed or parsed_selections(selections, candidates)
    fields = lambda *names: F.array(*[F.lit(n) for n in names])
    keys = F.coalesce(F.map_keys("top"), F.array().cast("array<string>"))
    own = F.col("cat_ord") == len(CATEGORIES)
    unknown = named.where("found is null").groupBy("selection_id").agg(F.bool_or(~own).alias("unknown"), F.bool_or(own).alias("own_unknown"))
    there, f = F.col("pos").isNotNull(), F.col("f")
    wrong = lambda c: F.coalesce(F.bool_or(there & F.coalesce(c, F.lit(True))), F.lit(False))
    per = findings.groupBy("selection_id").agg(
        F.bool_or(~F.col("is_list")).alias("no_list"),
        wrong(f.isNull() | (F.size(F.array_except(F.map_keys(f), fields(*FINDING_FIELDS))) > 0) | (F.size(F.array_except(fields(*FINDING_FIELDS), F.map_keys(f))) > 0)).alias("shape"),
        wrong(~f["severity"].isin(*SEVERITIES)).alias("severity"),
        wrong(~f["confidence"].isin(*CONFIDENCES)).alias("confidence"),
        wrong(F.coalesce(F.size("ids") == 0, F.lit(True))).alias("ids"),
        wrong(F.coalesce(F.size(F.array_distinct("ids")) < F.size("ids"), F.lit(False))).alias("repeated"),
    )
    j = tops.join(per, "selection_id", "left").join(unknown, "selection_id", "left")
    top = lambda c: F.col("top")[c]
    missing = F.size(F.array_except(fields(*SELECTION_FIELDS), keys)) > 0
    claims = F.coalesce(top("evidenceSufficiency").isin("sufficient", "partial"), F.lit(False))
    rules = (
        F.col("top").isNull(),
        missing,
        F.size(F.array_except(keys, fields(*SELECTION_FIELDS))) > 0,
        F.col("no_list"),
        F.col("shape"),
        F.col("severity"),
        F.col("confidence"),
        F.col("ids"),
        F.col("repeated"),
        F.col("unknown"),
        ~F.coalesce(top("evidenceSufficiency").isin(*SUFFICIENCIES), F.lit(False)),
        ~F.coalesce(top("confidence").isin(*CONFIDENCES), F.lit(False)),
        F.col("own_ids").isNull(),
        F.coalesce(F.size(F.array_distinct("own_ids")) < F.size("own_ids"), F.lit(False)),
        F.col("own_unknown"),
        claims & F.coalesce(F.size("own_ids") == 0, F.lit(False)),
    )
    found = _codes(*[F.when(F.coalesce(r, F.lit(False)), c) for r, c in zip(rules, SELECTION_CODES, strict=True)])
    return j.select("selection_id", F.when(F.col("top").isNull(), "not-an-object").when(missing, "missing-field").otherwise(found).alias("codes"))


def selection_materialize(selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """The report of each selection: findings whose statements are their candidates' excerpts in the
    order selected, a summary of the distinct statements in order, and the candidates used, by first
    use, the sufficiency's last. A selection that breaks a rule is `invalid`, one without findings
    `no-findings`; neither gets a report. candidates: document_id, candidate_id, excerpt."""
    parsed = tops, findings, named = parsed_selections(selections, candidates)
    audited = selection_audit(selections, candidates, parsed)
    own = F.col("cat_ord") == len(CATEGORIES)
    known = named.where("found is not null").withColumn("excerpt", F.col("found.excerpt"))
    # one gathering by selection: a report is bounded by the candidates of its document
    told = known.where(~own).groupBy("selection_id", "cat_ord", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.nullif("excerpt", F.lit("")).alias("e")))), lambda x: x["e"]), "؛ ").alias("statement"))
    made = findings.where("pos is not null").join(told, ["selection_id", "cat_ord", "pos"])
    entry = F.struct("cat_ord", "pos", "category", "statement", F.col("f")["severity"].alias("severity"), F.col("f")["confidence"].alias("confidence"), F.col("ids").alias("evidence_ids"))
    rows = made.groupBy("selection_id").agg(F.array_sort(F.collect_list(entry)).alias("findings"))
    use = F.struct("cat_ord", "pos", "at", "candidate_id", "excerpt")
    uses = known.groupBy("selection_id").agg(F.array_sort(F.collect_list(use)).alias("uses"))
    ids = F.transform("uses", lambda x: x["candidate_id"])
    evidence = F.transform(F.filter("uses", lambda x, i: F.array_position(ids, x["candidate_id"]) == i + 1), lambda x: F.struct(x["candidate_id"].alias("candidate_id"), x["excerpt"].alias("excerpt")))
    j = tops.join(audited, "selection_id").join(rows, "selection_id", "left").join(uses.select("selection_id", evidence.alias("evidence")), "selection_id", "left")
    status = F.when(F.col("codes") != "", "invalid").when(F.col("findings").isNull(), "no-findings").otherwise("ok")
    kept = lambda c: F.when(status == "ok", c)
    return j.select(
        "selection_id",
        status.alias("status"),
        kept(F.array_join(F.array_distinct(F.transform("findings", lambda f: f["statement"])), "؛ ")).alias("summary"),
        kept(F.transform("findings", lambda f: f.dropFields("cat_ord", "pos"))).alias("findings"),
        kept(F.col("evidence")).alias("evidence"),
        kept(F.col("top")["evidenceSufficiency"]).alias("evidence_sufficiency"),
        kept(F.col("top")["confidence"]).alias("confidence"),
        kept(F.col("own_ids")).alias("sufficiency_ids"),
    )


#: Fixed value: what an excerpt holds at most.
EXCERPT = 400


def _fields_broken() -> tuple[dict[str, Callable], dict[str, Callable]]:
    """Rules that a finding and a piece of evidence break, each of a function from a field to its column."""
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    outside = lambda c, values: ~F.coalesce(c.isin(*values), F.lit(False))
    of_finding = {
        "category": lambda at: blank(at("category")), "statement": lambda at: blank(at("statement")), "severity": lambda at: outside(at("severity"), SEVERITIES), "confidence": lambda at: outside(at("confidence"), CONFIDENCES),
        "evidence-ids": lambda at: _no_ids(at("evidence_ids")) | F.coalesce(F.size(at("evidence_ids")) == 0, F.lit(True)),
    }
    of_evidence = {
        "id": lambda at: blank(at("evidence_id")), "document": lambda at: blank(at("document_id")), "type": lambda at: blank(at("source_type")), "location": lambda at: ~reduce(or_, [at(c).isNotNull() for c in PLACES]),
        "excerpt": lambda at: blank(at("excerpt")) | (F.length(at("excerpt")) > EXCERPT), "chunk": lambda at: blank(at("chunk_id")),
    }
    return of_finding, of_evidence


def _no_ids(ids: Column) -> Column:
    return F.coalesce(F.exists(ids, lambda i: F.trim(F.coalesce(i, F.lit(""))) == ""), F.lit(True))


def _report_codes(at: Callable, broken: dict[str, Column], some: Column, dangling: Column, own_dangling: Column) -> Column:
    """Codes of a report from its own fields and what is broken below it."""
    outside = lambda c, values: ~F.coalesce(c.isin(*values), F.lit(False))
    claims = F.coalesce(at("evidence_sufficiency").isin("sufficient", "partial"), F.lit(False))
    rules = {
        "summary": F.trim(F.coalesce(at("summary"), F.lit(""))) == "", "sufficiency": outside(at("evidence_sufficiency"), SUFFICIENCIES), "confidence": outside(at("confidence"), CONFIDENCES), "warnings": at("warnings").isNull(), **broken,
        "sufficiency-ids": _no_ids(at("sufficiency_ids")), "dangling": dangling, "sufficiency-dangling": own_dangling, "no-evidence": ~some & ~at("evidence_sufficiency").eqNullSafe("insufficient"), "sufficiency-without-ids": claims & F.coalesce(F.size(at("sufficiency_ids")) == 0, F.lit(True)),
    }
    return _codes(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()])


def report_audit(reports: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Codes of the rules that each report breaks: its own fields, its findings' and its evidence's, ids
    that no evidence has, sufficiency without evidence or ids. reports: run_id, summary, warnings (an
    array), evidence_sufficiency, confidence, sufficiency_ids (an array); findings: run_id, category,
    statement, severity, confidence, evidence_ids; evidence: run_id, evidence_id, document_id,
    source_type, excerpt, chunk_id and PLACES. A null stands for a field that is missing or no list."""
    asked = findings.select("run_id", F.lit("f").alias("kind"), F.explode("evidence_ids").alias("evidence_id"))
    asked = asked.unionByName(reports.select("run_id", F.lit("s").alias("kind"), F.explode("sufficiency_ids").alias("evidence_id"))).where(F.trim(F.coalesce("evidence_id", F.lit(""))) != "")
    loose = asked.join(evidence.select("run_id", "evidence_id").distinct(), ["run_id", "evidence_id"], "left_anti")
    loose = loose.groupBy("run_id").agg(F.bool_or(F.col("kind") == "f").alias("dangling"), F.bool_or(F.col("kind") == "s").alias("sufficiency-dangling"))
    of_finding, of_evidence = _fields_broken()
    f = findings.groupBy("run_id").agg(*[F.bool_or(c(F.col)).alias(f"finding-{n}") for n, c in of_finding.items()])
    e = evidence.groupBy("run_id").agg(F.lit(True).alias("some"), *[F.bool_or(c(F.col)).alias(f"evidence-{n}") for n, c in of_evidence.items()])
    r = reports.join(f, "run_id", "left").join(e, "run_id", "left").join(loose, "run_id", "left")
    broken = {n: F.col(f"`{n}`") for n in [*[f"finding-{n}" for n in of_finding], *[f"evidence-{n}" for n in of_evidence]]}
    return r.select("run_id", _report_codes(F.col, broken, F.col("some").isNotNull(), F.col("dangling"), F.col("`sufficiency-dangling`")).alias("codes"))


def report_codes(report: Column, findings: Column, evidence: Column, known: Column) -> Column:
    """report_audit of one report, a struct, with its findings and its evidence, arrays of structs, and
    the ids of its evidence."""
    of_finding, of_evidence = _fields_broken()
    loose = lambda ids: F.exists(ids, lambda i: (F.trim(F.coalesce(i, F.lit(""))) != "") & ~F.coalesce(F.array_contains(known, i), F.lit(False)))
    some = lambda rows, rule: F.exists(rows, lambda x: rule(x.getField))
    broken = {f"finding-{n}": some(findings, rule) for n, rule in of_finding.items()} | {f"evidence-{n}": some(evidence, rule) for n, rule in of_evidence.items()}
    return _report_codes(report.getField, broken, F.size(evidence) > 0, F.exists(findings, lambda x: F.coalesce(loose(x["evidence_ids"]), F.lit(False))), loose(report["sufficiency_ids"]))


def evidence_rekey(evidence: DataFrame) -> DataFrame:
    """New evidence ids `ev-<last 12 letters and digits of the job>-<n>` in order; reports with a
    repeated id are marked rejected."""
    job = F.right(F.regexp_replace("job_id", "[^A-Za-z0-9]", ""), F.lit(12))
    n = F.row_number().over(W.partitionBy("job_id").orderBy("pos"))
    same = F.count("*").over(W.partitionBy("job_id", "evidence_id"))
    marked = evidence.withColumns({"new_id": F.concat(F.lit("ev-"), job, F.lit("-"), n.cast("string")), "same": same})
    return marked.withColumn("rejected", F.max("same").over(W.partitionBy("job_id")) > 1).drop("same")


def rekeyed_references(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """findings (job_id, pos, evidence_ids, ...) with the new ids of evidence_rekey in their places;
    ids that no evidence of the job has stay as they are. A report's sufficiency ids are rewritten
    alike, as a row of their own. Rejected jobs have no findings."""
    new = evidence.where("not rejected").select("job_id", F.col("evidence_id").alias("id"), "new_id")
    rejected = evidence.where("rejected").select("job_id").distinct()
    fine = findings.join(rejected, "job_id", "left_anti")
    one = fine.select("job_id", "pos", F.posexplode("evidence_ids").alias("at", "id")).join(new, ["job_id", "id"], "left")
    per = one.groupBy("job_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new_id", "id").alias("id")))), lambda x: x["id"]).alias("new_ids"))
    return fine.join(per, ["job_id", "pos"], "left").withColumn("evidence_ids", F.coalesce("new_ids", "evidence_ids")).drop("new_ids")


def grounding_reason(at: Callable, own_document: Column, own_type: Column, chunk_text: Column, sources: Column) -> Column:
    """Why a piece of evidence, a function from its fields to columns, is not grounded in the chunk that
    it names, whose text is squashed; null if it is."""
    given = lambda name: F.trim(F.coalesce(at(name), F.lit(""))) != ""
    lacks = (
        F.when(own_type == "pdf", ~F.coalesce(at("page_number") >= 1, F.lit(False)))
        .when(own_type == "xlsx", ~(given("sheet_name") & given("cell_range")))
        .when(own_type == "docx", ~given("section"))
        .otherwise(False)
    )

    def meets(source: Column) -> Column:
        cells = at("cell_range").isNull() | source["cell_range"].eqNullSafe(at("cell_range"))
        sheet = F.when(at("sheet_name").isNotNull(), source["sheet_name"].eqNullSafe(at("sheet_name")) & cells)
        return F.when(at("page_number").isNotNull(), source["page_number"].eqNullSafe(at("page_number"))).otherwise(F.coalesce(sheet, at("section").isNotNull() & source["section"].eqNullSafe(at("section"))))

    return (
        F.when(~at("document_id").eqNullSafe(own_document), "document")
        .when(~at("source_type").eqNullSafe(own_type), "type")
        .when(lacks, "location")
        .when(chunk_text.isNull(), "chunk")
        .when(~F.coalesce(F.exists(sources, meets), F.lit(False)), "place")
        .when(~chunk_text.contains(text.squash(at("excerpt"))), "excerpt")
    )


def grounded(evidence: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence with the `reason` for which it is not grounded, or null. Tables as in grounding_check."""
    d = documents.select("run_id", F.col("document_id").alias("own_document"), F.col("document_type").alias("own_type"))
    c = chunks.select("document_id", "chunk_id", "sources", text.squash(F.col("text")).alias("chunk_text"))
    joined = evidence.join(d, "run_id", "left").join(c, ["document_id", "chunk_id"], "left")
    return joined.select(*evidence.columns, grounding_reason(F.col, *[F.col(n) for n in ("own_document", "own_type", "chunk_text", "sources")]).alias("reason"))


def grounding_check(evidence: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Verdict per report and the first reason: another document or type; a place that the type lacks
    (a page of a pdf, a sheet and its cells of an xlsx, a section of a docx); an unknown chunk, a place
    that is none of the chunk's sources, an excerpt that is not literally in its text. documents:
    run_id, document_id, document_type; chunks: document_id, chunk_id, text, sources (an array of
    structs of PLACES)."""
    found = grounded(evidence, documents, chunks)
    return found.groupBy("run_id").agg((F.count("reason") == 0).alias("grounded"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("first_reason"), F.count("reason").alias("failures"))


#: Fixed value: the order in which stored reports list their categories.
STORED_ORDER = ("scopeOfWork", "boqSummary", "criticalQuantities", "eligibilityRequirements", "requiredExperience", "deadlines", "bidBonds", "guarantees", "penalties", "contractualRisks", "unclearItems", "questionsForAuthority")


def report_flatten(reports: DataFrame) -> dict[str, DataFrame]:
    """The rows that a stored report becomes. reports: report_id, findings (a map from category to an
    array of statement, severity, confidence, evidence_ids), evidence (an array of evidence_id,
    document_id, source_type, page_number, excerpt, chunk_id), run (provider, model, status,
    duration_ms, prompt_version, schema_version, error_code), finished_at.

    findings: numbered category by category in order; evidence: in order; jobs: completed, with the
    report's sizes; runs: one model run per report."""
    listed = F.array(*[F.struct(F.lit(i).alias("cat_ord"), F.lit(c).alias("category"), F.try_element_at("findings", F.lit(c)).alias("rows")) for i, c in enumerate(STORED_ORDER)])
    per = reports.select("report_id", F.explode(listed).alias("c")).select("report_id", "c.cat_ord", "c.category", F.posexplode("c.rows").alias("pos", "f"))
    numbered = per.withColumn("finding_no", F.row_number().over(W.partitionBy("report_id").orderBy("cat_ord", "pos")))
    sizes = F.aggregate(F.map_values("findings"), F.lit(0), lambda n, x: n + F.size(x))
    return {
        "findings": numbered.select("report_id", "finding_no", "category", "f.statement", "f.severity", "f.confidence", "f.evidence_ids"),
        "evidence": reports.select("report_id", F.posexplode("evidence").alias("pos", "e")).select("report_id", "pos", "e.*"),
        "jobs": reports.select("report_id", F.lit("completed").alias("status"), "finished_at", sizes.cast("long").alias("n_findings"), F.size("evidence").cast("long").alias("n_evidence")),
        "runs": reports.select("report_id", "run.*"),
    }


def model_run_outcomes(runs: DataFrame) -> DataFrame:
    """Model runs by provider and model, an empty model for none: how many, failures, durations."""
    ms = F.coalesce(F.col("duration_ms").cast("long"), F.lit(0))
    return runs.groupBy("provider", F.coalesce("model", F.lit("")).alias("model")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(ms), 4).alias("mean_ms"), F.max(ms).alias("max_ms"))


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """Jobs by status and error code, with their durations."""
    ms = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return jobs.groupBy("status", "error_code").agg(F.count("*").alias("jobs"), F.round(F.avg(ms), 4).alias("mean_ms"), F.max(ms).alias("max_ms"))


def coverage_balance(files: DataFrame, dominant: float = 0.8) -> DataFrame:
    """Balance of evidence over a tender's files; of a repeated file name the last count stands."""
    last = files.groupBy("tender", "file_name").agg(F.max_by(F.coalesce("evidence_count", F.lit(0)), "pos").alias("n"))
    per = last.groupBy("tender").agg(F.count("*").alias("files"), F.sum("n").alias("evidence"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("zero"))
    ratio = F.when(F.col("evidence") > 0, F.col("most") / F.col("evidence")).otherwise(0.0)
    out = per.withColumns({"ratio": ratio, "dominant": (F.col("evidence") > 0) & (ratio >= dominant), "many_zero": F.col("zero") >= 2})
    warning = F.when(F.col("dominant") | F.col("many_zero"), F.format_string("التغطية غير متوازنة: %d من %d ملفات لم تساهم بأدلة", "zero", "files"))
    return out.select("tender", "files", "evidence", "zero", F.round("ratio", 4).alias("ratio"), (F.col("dominant") | F.col("many_zero")).alias("unbalanced"), warning.alias("warning"))


_SUFFICIENCY = lambda c: F.when(F.col(c) == "sufficient", 2).when(F.col(c) == "partial", 1).otherwise(0)
_CONFIDENCE = lambda c: F.when(F.col(c) == "high", 3).when(F.col(c) == "medium", 2).when(F.col(c) == "low", 1).otherwise(0)


def multidoc_merge(files: DataFrame) -> DataFrame:
    """A tender's files as one result: the strongest sufficiency, among those the highest confidence;
    the sufficiency ids in the order first named, each with the first file that names it; the files
    with their results and the failed ones in order; distinct evidence. Unbalanced coverage, to which a
    failed file adds nothing, forces `low`. files: tender, pos, file_name, size_bytes, error, message,
    evidence_sufficiency, confidence, evidence_count, sufficiency_ids (an array)."""
    fine = F.col("error").isNull()
    ranked = files.withColumns({"s": F.when(fine, _SUFFICIENCY("evidence_sufficiency")), "c": F.when(fine, _CONFIDENCE("confidence"))})
    own, failed = F.struct("pos", "file_name", "size_bytes", "evidence_sufficiency", "confidence", "evidence_count", "error"), F.struct("pos", "file_name", F.col("error").alias("code"), "message")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.dropFields("pos"))
    per = ranked.groupBy("tender").agg(F.max(F.struct("s", "c")).alias("m"), F.sum(F.coalesce("evidence_count", F.lit(0))).alias("total_evidence"), in_order(own).alias("files"), in_order(F.when(~fine, failed)).alias("errors"))
    ids = files.where(fine).select("tender", "pos", "file_name", F.posexplode("sufficiency_ids").alias("at", "evidence_id"))
    first = ids.groupBy("tender", "evidence_id").agg(F.min(F.struct("pos", "at", "file_name")).alias("use"))
    named = first.groupBy("tender").agg(F.transform(F.array_sort(F.collect_list(F.struct("use.pos", "use.at", "evidence_id", "use.file_name"))), lambda x: x.dropFields("pos", "at")).alias("sufficiency_ids"))
    joined = per.join(named, "tender", "left").join(coverage_balance(files).select("tender", "unbalanced", "warning"), "tender")
    s, c = F.coalesce("m.s", F.lit(0)), F.greatest(F.coalesce("m.c", F.lit(1)), F.lit(1))
    return joined.select(
        "tender",
        F.element_at(F.array(*[F.lit(x) for x in ("insufficient", "partial", "sufficient")]), s + 1).alias("evidence_sufficiency"),
        F.when(F.col("unbalanced"), "low").otherwise(F.element_at(F.array(*[F.lit(x) for x in CONFIDENCES]), c)).alias("confidence"),
        F.coalesce("sufficiency_ids", F.array().cast(named.schema["sufficiency_ids"].dataType)).alias("sufficiency_ids"),
        "files",
        "errors",
        "total_evidence",
        "warning",
    )


def multidoc_evidence(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each file of a tender that did not fail, from the last result under its name.
    evidence: tender, pos (of the file), at, evidence_id, page_number, excerpt."""
    last = files.where("error is null").groupBy("tender", "file_name").agg(F.max("pos").alias("pos"))
    return evidence.join(last, ["tender", "pos"]).select("tender", "file_name", "at", "evidence_id", "page_number", "excerpt")
