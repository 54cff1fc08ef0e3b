"""Sources, sinks and schemas: cards, files, envelopes, exports, evolution, audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fees

ITEM_FIELDS = ("reference", "title", "agency", "region", "deadline", "published_at", "platform_status", "activity", "portal_url")
ENVELOPE = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("sync_id", T.StringType()),
        T.StructField("occurred_at", T.StringType()),
        T.StructField("dry_run", T.BooleanType()),
        T.StructField("declared_added", T.ArrayType(T.StringType())),
        T.StructField("declared_changed", T.ArrayType(T.StringType())),
        T.StructField("items", T.ArrayType(T.StructType([*[T.StructField(c, T.StringType()) for c in ITEM_FIELDS], T.StructField("fee", T.StringType())]))),
    ]
)
KNOWN_SOURCE = "tender-portal-sync"


def card_extract(pages: DataFrame) -> DataFrame:
    """Cards of listing pages: reference, title, agency, fee evidence and dates. Cards start at a
    "card" element; those without a 12-digit reference are dropped."""
    cards = pages.select("page_id", "region_id", F.posexplode(F.split("html", r'<div class="card')).alias("pos", "card")).where("pos > 0")
    plain = F.regexp_replace(F.regexp_replace("card", r"(?i)<(?:br|/p|/div|/h\d|/li)[^>]*>", "\n"), r"<[^>]+>", "")
    headings = F.transform(F.regexp_extract_all("card", F.lit(r"(?is)<h5[^>]*>(.*?)</h5>"), 1), lambda h: F.trim(F.regexp_replace(h, r"<[^>]+>", "")))
    read = cards.withColumns({"plain": plain, "headings": F.filter(headings, lambda h: h != ""), "dates": F.regexp_extract_all(plain, F.lit(r"\b(20\d{2}-\d{2}-\d{2})\b"), 1)})
    first = F.trim(F.regexp_extract("plain", r"قيمة (?:وثائق المنافسة|الكراسة)[ \t]*[:：]?[ \t]*([^\n]*)", 1))
    second = F.trim(F.regexp_extract("plain", r"قيمة (?:وثائق المنافسة|الكراسة)[ \t]*[:：]?[ \t]*[^\n]*\n([^\n]*)", 1))
    out = read.select(
        "page_id",
        "region_id",
        "pos",
        F.regexp_extract("plain", r"الرقم المرجعي\s*\n?\s*(\d{12})", 1).alias("reference"),
        F.coalesce(F.get("headings", F.lit(0)), F.lit("")).alias("title"),
        F.coalesce(F.get("headings", F.lit(1)), F.lit("")).alias("agency"),
        F.coalesce(F.nullif(first, F.lit("")), second).alias("fee_text"),
        F.coalesce(F.get("dates", F.lit(0)), F.lit("")).alias("published_at"),
        F.coalesce(F.concat(F.get("dates", F.lit(1)), F.lit(" 09:59")), F.lit("")).alias("deadline"),
    ).where("reference <> ''")
    value = fees.fee_value(F.col("fee_text"))
    return out.withColumns({"fee": value, "fee_verification": F.when(value.isNotNull(), "card-observed").otherwise("unknown")})


OCTETS = "application/octet-stream"
_OLE, _ZIP, _OFFICE = ("D0CF11E0A1B11AE1",), ("504B",), "application/vnd.openxmlformats-officedocument."


@dataclass(frozen=True)
class Profile:
    """What files may be: by extension the first bytes, as hex, of which one must fit, and the MIME
    types (none: not looked at); the largest size; whether the extension is looked at first."""

    kinds: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]
    limit: int
    extension_first: bool


#: Files kept apart after a download, and files that are analysed.
QUARANTINE = Profile(
    {
        "pdf": (("255044462D",), ("application/pdf",)), "zip": (_ZIP, ("application/zip", "application/x-zip-compressed")),
        "7z": (("377ABCAF271C",), ("application/x-7z-compressed",)), "rar": (("526172211A07",), ("application/vnd.rar", "application/x-rar-compressed")),
        "doc": (_OLE, ("application/msword",)), "xls": (_OLE, ("application/vnd.ms-excel",)), "ppt": (_OLE, ("application/vnd.ms-powerpoint",)),
        "docx": (_ZIP, (_OFFICE + "wordprocessingml.document",)), "xlsx": (_ZIP, (_OFFICE + "spreadsheetml.sheet",)), "pptx": (_ZIP, (_OFFICE + "presentationml.presentation",)),
    },
    100 * 1024 * 1024,
    False,
)
ANALYSIS = Profile({"pdf": (("255044462D",), ()), "xlsx": (("504B0304",), ()), "docx": (("504B0304",), ())}, 30 * 1024 * 1024, True)


def binary_files(spark: SparkSession, path: str, limit: int = QUARANTINE.limit) -> DataFrame:
    """(file_id, name, size_bytes, content) of the files below a path; larger ones are not loaded, and
    Spark does not list empty ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    small, large = found.where(F.col("length") <= limit), found.where(F.col("length") > limit)
    return small.select(F.col("path").alias("file_id"), name.alias("name"), F.col("length").alias("size_bytes"), "content").unionByName(large.select(F.col("path").alias("file_id"), name.alias("name"), F.col("length").alias("size_bytes"), F.lit(None).cast("binary").alias("content")))


def file_intake_audit(files: DataFrame, profile: Profile = QUARANTINE) -> DataFrame:
    """Verdict of each file, the first rule of the profile that it breaks: empty, too large, extension,
    first bytes, MIME type (without its parameters; octets and none go with everything); and the
    SHA-256 of its content. files: file_id, name, content, with mime and size_bytes or without."""
    table = lambda k: F.create_map(*[x for e, of in profile.kinds.items() for x in (F.lit(e), F.array(*[F.lit(v) for v in of[k]]).cast("array<string>"))])
    trimmed = F.trim("name")
    ext = F.lower(F.regexp_extract(trimmed, r"[^/\\]\.([^./\\]+)$" if profile.extension_first else r"\.([^.]+)$", 1))
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.length("content").cast("long")
    size = F.coalesce(size, F.lit(0))
    head = F.hex(F.substring("content", 1, 16))
    signed = F.coalesce(F.exists(F.try_element_at(table(0), ext), lambda s: head.startswith(s)), F.lit(False))
    known = ext.isin(*profile.kinds)
    verdict = F.when(~known, "extension") if profile.extension_first else F.when(size == 0, "empty")
    verdict = verdict.when(size == 0, "empty").when(size > profile.limit, "too-large").when(~known, "extension").when(~signed, "signature")
    if "mime" in files.columns:
        stated = F.lower(F.trim(F.split_part(F.coalesce("mime", F.lit("")), F.lit(";"), F.lit(1))))
        types = F.try_element_at(table(1), ext)
        verdict = verdict.when(~stated.isin("", OCTETS) & (F.size(types) > 0) & ~F.array_contains(types, stated), "mime")
    return files.select("file_id", "name", size.alias("size_bytes"), F.sha2("content", 256).alias("sha256"), verdict.otherwise("accepted").alias("verdict"))


def envelope_parse(raw: DataFrame, source: str = KNOWN_SOURCE) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of JSON envelopes (envelope_id, body) of one known source: fields trimmed, unreadable fees 0,
    items without a reference dropped, the last duplicate kept at the place of the first."""
    parsed = raw.withColumn("e", F.from_json("body", ENVELOPE))
    fine = F.coalesce((F.col("e.schema_version") == 1) & (F.col("e.source") == source) & F.col("e.items").isNotNull() & F.col("e.sync_id").isNotNull(), F.lit(False))
    items = parsed.where(fine).select("envelope_id", F.col("e.sync_id").alias("sync_id"), F.coalesce("e.dry_run", F.lit(False)).alias("dry_run"), F.posexplode("e.items").alias("pos", "i"))
    fields = F.struct(*[F.trim(F.coalesce(F.col(f"i.{c}"), F.lit(""))).alias(c) for c in ITEM_FIELDS], F.coalesce(F.col("i.fee").try_cast("double"), F.lit(0.0)).alias("fee"))
    once = items.withColumn("f", fields).where("f.reference <> ''").groupBy("envelope_id", "sync_id", "dry_run", F.col("f.reference").alias("r")).agg(F.min("pos").alias("pos"), F.max_by("f", "pos").alias("f"))
    return once.select("envelope_id", "sync_id", "dry_run", "pos", "f.*"), parsed.where(~fine).select("envelope_id")


CSV_COLUMNS = ("reference", "title", "agency", "region", "fee", "deadline", "status", "score", "activity", "files", "notes")


def board_csv(tenders: DataFrame) -> DataFrame:
    """The board's export columns, with the defaults for missing files and notes."""
    defaults = {"files": "بانتظار الملفات", "notes": "لا توجد ملاحظات"}
    return tenders.select(*[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(defaults[c])).alias(c) if c in defaults else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS])


def board_csv_export(tenders: DataFrame, path: str) -> None:
    """Write the export with every cell quoted and quotes doubled."""
    board_csv(tenders).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, run_column: str | None = None) -> None:
    """One state table; with a run column only that run's partitions are replaced."""
    writer = df.write.mode("overwrite")
    if run_column:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(run_column)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A state table by its fixed schema; columns that older files lack are null."""
    return spark.read.schema(schema).parquet(path)


def schema_evolve(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Both generations of rows; columns that the old ones lack get their defaults."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def snapshot_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Verdict per file of a manifest (path, sha256) against what is there."""
    both = expected.select("path", F.col("sha256").alias("e")).join(actual.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    verdict = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unregistered").when(F.col("a") != F.col("e"), "checksum").otherwise("ok")
    return both.select("path", verdict.alias("verdict"))


def count_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Verdict per table (name, rows): missing, unregistered, row count, ok."""
    both = expected.select("name", F.col("rows").alias("e")).join(actual.select("name", F.col("rows").alias("a")), "name", "full_outer")
    return both.select("name", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unregistered").when(F.col("a") != F.col("e"), "row-count").otherwise("ok").alias("verdict"))
