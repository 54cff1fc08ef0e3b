"""Detail pages and text corpora: fields, attachment names, repair, match keys, quality gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text

#: A field and the labels that name it on a detail page.
FIELDS = (
    ("title", "اسم المنافسة|اسم المناقصة"),
    ("tenderNumber", "رقم المنافسة|رقم المناقصة"),
    ("reference", "الرقم المرجعي|رقم المرجع"),
    ("tenderType", "نوع المنافسة|أسلوب المنافسة"),
    ("platformStatus", "حالة المنافسة|مرحلة المنافسة"),
    ("agency", "الجهة الحكومي[ةه]|الجهة المالكة|اسم الجهة"),
    ("classification", "مجال التصنيف"),
    ("activity", "النشاط الأساسي|نشاط المنافسة"),
    ("subActivity", "النشاط الفرعي|التصنيف الفرعي"),
    ("location", "مكان التنفيذ|موقع التنفيذ|منطقة التنفيذ"),
    ("contractDuration", "مدة العقد|مدة التنفيذ|مدة المشروع"),
    ("bookletFee", "قيمة وثائق المنافسة|قيمة الكراسة"),
    ("insuranceRequired", "هل التأمين من متطلبات المنافسة"),
    ("offerStatus", "حالة العرض"),
    ("timeRemaining", "الوقت المتبق[ىي]"),
    ("guarantee", "مطلوب ضمان الإبتدائي|الضمان الابتدائي|قيمة الضمان الابتدائي|نسبة الضمان الابتدائي"),
    ("guaranteeAddress", "عنوان الضمان الإبتدائ[يى]|عنوان الضمان الابتدائ[يى]"),
    ("finalGuarantee", "الضمان النهائي"),
    ("publishedAt", "تاريخ النشر|تاريخ نشر المنافسة"),
    ("deadline", "آخر موعد لتقديم العروض|تاريخ ووقت انتهاء تقديم العروض"),
    ("openingAt", "تاريخ ووقت فتح العروض|موعد فتح العروض"),
    ("questionsDeadline", "آخر موعد ل[إا]ستلام [إا]ل?استفسارات|آخر موعد لاستقبال الاستفسارات|موعد استلام الاستفسارات"),
    ("expectedAwardAt", "التاريخ المتوقع للترسية"),
    ("workStartAt", "تاريخ بدء الأعمال\\s*/\\s*الخدمات"),
    ("questionsStartAt", "بداية إرسال الأسئلة و الاستفسارات"),
    ("maxAnswerDuration", "اقصى مدة للاجابة على الاستفسارات"),
    ("openingPlace", "مكان فتح العرض"),
    ("offerMethod", "طريقة تقديم العروض|آلية تقديم العروض"),
    ("description", "وصف المنافسة|الغرض من المنافسة|نطاق العمل"),
    ("quantitySummary", "جدول الكميات|جداول الكميات"),
)


def clean_detail(value: Column) -> Column:
    """No carriage returns, single blanks, at most one empty line in a row, trimmed."""
    plain = F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("")), r"[\t ]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def _spellings(pattern: str) -> list[str]:
    """The texts that a label pattern fits: its classes, optional letters and optional blanks spelt out."""
    found = [""]
    for part in re.findall(r"\[[^]]+\]\??|\\s\*|.\??", pattern):
        choices = ["", " "] if part == r"\s*" else list(part.rstrip("?").strip("[]"))
        choices += [""] * (part.endswith("?") and part != r"\s*")
        found = [f + c for f in found for c in choices]
    return found


#: Every spelling of every label, with its field.
LABELS = {text_: name for name, pattern in reversed(FIELDS) for alternative in pattern.split("|") for text_ in _spellings(alternative)}


def field_of(label: Column) -> Column:
    """The field that a label names, null for other lines."""
    plain = F.trim(F.regexp_replace(clean_detail(label), "[：:]+$", ""))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), plain)


def detail_field_extract(sections: DataFrame) -> DataFrame:
    """(reference, field, value): `label: value` lines, or a label and the first of the next three
    lines that is neither a label nor the section's name; the first hit by section and line wins.
    Each line goes on alone with the three after it, so that its label is sought in compiled code and
    only lines that have one are looked at further; only hits are shuffled."""
    colon = r"^(.{2,80}?)[：:]\s*(.+)$"
    bare = lambda c: F.trim(F.regexp_replace(c, "[：:]+$", ""))
    ends = r"(?U)^\s+|\s+$"
    plain = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), r"[\t ]+", " "), ends, "")
    # a break takes the blanks and empty lines around it along; outer, so that nothing is split beforehand to see whether there are lines
    lines = sections.select("reference", "section_ord", "name", F.split(plain, r"(?U)\s*\n\s*").alias("lines"))
    each = lines.select("reference", "section_ord", "name", F.posexplode_outer("lines").alias("line", "said"), "lines")
    each = each.select("reference", "section_ord", "name", "line", "said", F.slice("lines", F.col("line") + 2, 3).alias("after"), F.when(F.col("said").rlike("[：:]"), F.regexp_extract("said", colon, 1)).otherwise("").alias("label"))
    key = F.when(F.col("label") == "", bare(F.col("said"))).otherwise(bare(F.regexp_replace("label", ends, "")))
    # a join on a fixed small table: sought in a map, the key would be worked out for the test and again for the result
    fields = sections.sparkSession.createDataFrame(list(LABELS.items()), "key string, field string")
    hits = each.withColumn("key", key).join(F.broadcast(fields), "key")
    names = F.array(*[F.lit(x) for x in LABELS])

    def tells(y: Column) -> Column:
        """Whether a line is a value: it brings one along, or names no field and is not the section's name."""
        return (~F.array_contains(names, bare(y)) | y.rlike(colon)) & (y != F.col("name"))

    value = F.when(F.col("label") == "", F.get(F.filter("after", tells), F.lit(0))).otherwise(F.regexp_extract("said", colon, 2))
    valued = hits.select("reference", "field", value.alias("value"), F.struct("section_ord", "line").alias("at"))
    return valued.groupBy("reference", "field").agg(F.min_by(F.when(F.col("value") != "", F.col("value")), F.when(F.col("value") != "", F.col("at"))).alias("value")).where("value is not null")


# Words of buttons, extensions and words of file names.
ACTIONS = r"(?i)^(?:تحميل الملف|ملفات داعمة|المرفق)$|شراء|انضمام"
EXTENSIONS = r"(?i)\.(?:pdf|xlsx?|docx?|pptx?|zip|rar|7z)\b"
KEYWORDS = r"(?i)كراسة|جدول.*كم|كميات|الغرامات|الجزاءات|معايير.*(?:العروض|التقييم)|المحتوى المحلي|نموذج|ملحق"
#: Kinds of attachments, the first pattern that fits wins.
KINDS = (
    ("boq", "(?i)جدول.*كم|كميات|boq"),
    ("penalties", "(?i)غرام|جزاء|penalt"),
    ("localContent", "(?i)محتوى.*محلي|تفضيل.*سعري|local content"),
    ("evaluation", "(?i)معايير.*(?:العروض|التقييم|التأهيل)|evaluation"),
    ("booklet", "(?i)شرط|مواصف|كراسة|booklet"),
)


def is_visible_name(name: Column) -> Column:
    return (F.length(name) > 0) & (F.length(name) <= 220) & ~name.rlike(ACTIONS) & (name.rlike(EXTENSIONS) | name.rlike(KEYWORDS))


def kind_of(name: Column) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for kind, pattern in KINDS:
        found = found.when(name.rlike(pattern), kind)
    return found.otherwise("supporting")


def attachment_names(candidates: DataFrame) -> DataFrame:
    """Visible file names of candidate labels: the text, else the decoded address; without regard to
    case the first spelling wins; with their kind."""
    shown = clean_detail(F.col("text"))
    decoded = clean_detail(F.coalesce(F.try_url_decode(F.replace(F.coalesce("file_name", F.lit("")), F.lit("+"), F.lit("%2B"))), F.col("file_name")))
    # each cleaned once, in a projection of its own
    cleaned = candidates.select("reference", "pos", shown.alias("shown"), decoded.alias("decoded"))
    chosen = F.when(is_visible_name(F.col("shown")), F.col("shown")).when(is_visible_name(F.col("decoded")), F.col("decoded"))
    named = cleaned.select("reference", "pos", chosen.alias("display_name"))
    # nulls go after the aggregate: before it the test would be pushed below the cleaning and repeat it
    once = named.groupBy("reference", F.lower("display_name").alias("k")).agg(F.min_by("display_name", "pos").alias("display_name")).where("display_name is not null")
    return once.select("reference", "display_name", kind_of(F.col("display_name")).alias("kind"))


#: Fixed value: the reason of a partial read.
INCOMPLETE = "قراءة ناقصة: قُرئ %d من %d أقسام متوقعة رغم ظهور تبويبات التفاصيل؛ الوسم partial وليس complete."


def detail_completeness(sections: DataFrame, tabs: DataFrame) -> DataFrame:
    """Expected and read sections per reference, the reason where some are missing, and whether a
    retry is due. Without visible tabs anything read is complete, and nothing is expected."""
    read = sections.where("name <> '' and text <> ''").groupBy("reference").agg(F.count("*").alias("sections_read"))
    both = tabs.join(read, "reference", "left").withColumn("sections_read", F.coalesce("sections_read", F.lit(0)))
    expected = F.greatest(F.lit(0), F.coalesce("tab_count", F.lit(0)))
    complete = F.when(expected == 0, F.col("sections_read") > 0).otherwise(F.col("sections_read") >= expected)
    return both.select("reference", expected.alias("expected"), "sections_read", F.when(complete, "complete").otherwise("partial").alias("status"), F.when(~complete & (expected > 0), F.format_string(INCOMPLETE, "sections_read", expected)).alias("reason"), (~complete).alias("retry"))


def cleaned_text(value: Column) -> Column:
    """Extraction noise removed, white space collapsed, lines of mostly Arabic letters turned round."""
    t = F.regexp_replace(F.coalesce(value, F.lit("")), r"\bar-SA\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\bPage\s+\d+\s+of\s+\d+\b", " "), "[•▪◦·]+", " ")
    t = F.trim(F.regexp_replace(t, r"\s{2,}", " "))

    def line(x: Column) -> Column:
        own = F.trim(x)
        arabic = F.length(F.regexp_replace(own, "[^؀-ۿ]", ""))
        solid = F.length(F.regexp_replace(own, r"\s", ""))
        return F.when(arabic > 0.7 * solid, F.regexp_replace(F.reverse(own), r"\s{2,}", " ")).otherwise(own)

    return F.array_join(F.filter(F.transform(F.split(t, "\n"), line), lambda x: x != ""), "\n")


def text_cleanup(documents: DataFrame) -> DataFrame:
    """Documents with their repaired text."""
    return documents.withColumn("cleaned", cleaned_text(F.col("text")))


def visual_order_fixed(value: Column) -> Column:
    """Lines whose words and, in purely Arabic words, letters stand in visual order: words turned
    round, letters of Arabic words too, lam-alef pairs put right."""

    def word(x: Column) -> Column:
        return F.when(x.rlike("^[؀-ۿ]+$"), F.regexp_replace(F.reverse(x), "ال(?=[أإآ])", "لا")).otherwise(x)

    line = lambda x: F.array_join(F.transform(F.reverse(F.split(F.trim(x), r"\s+")), word), " ")
    return F.array_join(F.transform(F.split(F.coalesce(value, F.lit("")), "\n"), line), "\n")


def text_cleanup_report(documents: DataFrame) -> DataFrame:
    """Changed documents and removed characters per source."""
    cleaned = text_cleanup(documents)
    return cleaned.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(~F.col("text").eqNullSafe(F.col("cleaned"))).alias("changed"), F.sum(F.length(F.coalesce("text", F.lit(""))) - F.length("cleaned")).alias("removed_chars"))


PROFILES = {"classifier": text.fold_classifier, "board": text.fold_board, "claim": lambda c: text.fold_claim(text.nfc(c)), "attachment": text.fold_attachment}


def match_keys(documents: DataFrame, profiles: tuple[str, ...] = tuple(PROFILES)) -> DataFrame:
    """Match keys of a corpus under several profiles, with their surface forms. The texts are split and
    counted once, per surface, so that a very common token is one row per task before it is shuffled;
    each distinct surface is then folded by every profile."""
    tokens = documents.select(F.explode(F.split("text", r"\s+")).alias("surface")).where("surface <> ''")
    surfaces = tokens.groupBy("surface").agg(F.count("*").alias("n"))
    # a projection of its own: the Arrow fold is worked out before rows are multiplied
    folded = surfaces.select("surface", "n", *[PROFILES[p](F.col("surface")).alias(p) for p in profiles])
    keyed = folded.select("surface", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.col(p).alias("key")) for p in profiles])).alias("k")).select("surface", "n", "k.*")
    return keyed.groupBy("profile", "key").agg(F.sum("n").alias("n"), F.count("*").alias("n_surfaces"), F.max_by("surface", F.struct("n", "surface")).alias("commonest"))


def match_key_build(documents: DataFrame, profile: str = "classifier") -> DataFrame:
    """match_keys under one profile."""
    return match_keys(documents, (profile,)).drop("profile")


def block_quality_gate(blocks: DataFrame) -> DataFrame:
    """Shares of tiny and of punctuation-only blocks per document, and the gates they trip."""
    own = F.trim(F.coalesce("text", F.lit("")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    per = blocks.groupBy("document_id").agg(F.count("*").alias("blocks"), share(F.length(own) <= 2).alias("fragmented"), share(own.rlike("^[.,،:؛;\\-–—]+$")).alias("punctuation"))
    return per.select("document_id", "blocks", "fragmented", "punctuation", (F.col("fragmented") > 0.9).alias("is_fragmented"), (F.col("punctuation") > 0.15).alias("arabic_lost"), ((F.col("fragmented") > 0.9) | (F.col("punctuation") > 0.15)).alias("needs_alternate"))


def extraction_choice(attempts: DataFrame, gates: DataFrame) -> DataFrame:
    """The first acceptable attempt of each document, else the first one, flagged."""
    joined = attempts.join(gates.select(F.col("document_id").alias("attempt_id"), "needs_alternate"), "attempt_id", "left")
    usable = ~F.coalesce("needs_alternate", F.lit(True))
    best = joined.groupBy("document_id").agg(F.min_by(F.struct("attempt_id", "attempt_ord", usable.alias("usable")), F.struct((~usable).alias("bad"), "attempt_ord")).alias("b"), F.count("*").alias("attempts"))
    return best.select("document_id", "b.attempt_id", "b.attempt_ord", (~F.col("b.usable")).alias("flagged"), "attempts")
