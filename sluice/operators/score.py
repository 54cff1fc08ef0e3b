"""Rule scores: classification, suitability, crowding, assessments and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fees, text

#: The rulebook's specialties in order, with their keywords.
RULEBOOK = (
    ("buildings", "إنشاء|انشاء|مبنى|مبني|مبان|تشييد|قاعة|مدرسة|مستشفى|مركز صحي|مقر|مجمع|برج|فيلا|سكن|مسجد|جامع|إضافة|توسعة"),
    ("roads", "طريق|طرقات|شارع|شوارع|جسر|جسور|نفق|تقاطع|مدخل مروري|رصف|تبليط|أسفلت|اعمال مرورية|أعمال مرورية"),
    ("infrastructure-water", "مياه|صرف صحي|شبكة مياه|خطوط رئيسية|خزان|محطة ضخ|معالجة|تصريف|سيول|تصريف سيول|امطار|أمطار"),
    ("electromechanical", "كهروميكانيكي|تكييف|تنظيم هواء|ميكانيكا|كهرباء|لوحات كهربائية|مولدات|مصاعد|سلالم متحركة|حريق|إنذار حريق|انذار حريق|مكافحة حريق"),
    ("power-energy", "محطة كهرباء|شبكة كهرباء|خطوط نقل|طاقة شمسية|خلايا شمسية|إنارة|انارة|إنارة طرق|عمود إنارة|محولات"),
    ("landscaping", "لاندسكيب|تشجير|حدائق|منتزه|حديقة|زراعة|نخيل|أشجار|نظام ري|شبكة ري"),
    ("maintenance-operation", "صيانة|تشغيل وصيانة|نظافة|خدمات نظافة|إدامة|ادامة|صيانة دورية|صيانة عامة|عقود تشغيل"),
    ("demolition-site-prep", "هدم|إزالة|ازالة|تسوية|ردم|حفر|أعمال ترابية|اعمال ترابية|تسوير مواقع|تجهيز موقع"),
    ("it-telecom", "شبكات|اتصالات|فايبر|fiber|ألياف|الياف ضوئية|مراقبة|كاميرات|أنظمة أمنية|انظمة امنية|مراكز بيانات|برمجة|تقنية معلومات"),
    ("furniture-fitout", "تجهيز|فرش|أثاث|اثاث|مكاتب|ستائر|أرضيات|ارضيات|ديكور|تشطيبات|دهانات|جبس"),
    ("general-works", "أعمال عامة|اعمال عامة|مشروع متعدد|أعمال متنوعة|اعمال متنوعة|منافسة عامة"),
)
FALLBACK, TITLE_WEIGHT, FIELD_WEIGHT, LEAST_CONFIDENCE = "general-works", 3, 1, 0.5


def specialty_classify(tenders: DataFrame, rulebook: tuple[tuple[str, str], ...] = RULEBOOK) -> DataFrame:
    """The specialty with the most keyword points; rulebook order breaks ties; below the least
    confidence the fallback. The rulebook is a literal of the plan, so one pass without a join."""
    title = text.fold_classifier(F.col("title"))
    fields = text.fold_classifier(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("agency", "activity", "tender_type") if c in tenders.columns]))
    folded = tenders.withColumns({"_t": title, "_f": fields})

    def points(keywords: str) -> Column:
        """Plain sums; a keyword is folded once, when the plan is built."""
        own = [text.fold_word_classifier(k) for k in keywords.split("|")]
        return sum((F.when(F.col("_t").contains(k), TITLE_WEIGHT).when(F.col("_f").contains(k), FIELD_WEIGHT).otherwise(0) for k in own), F.lit(0))

    # Every specialty's points are a column of their own, used several times and so worked out once. A
    # rank orders by points and then by the rulebook; its remainder names the specialty.
    n, base = len(rulebook), 1 << len(rulebook).bit_length()
    scored = folded.select("reference", *[points(words).alias(f"_{i}") for i, (_, words) in enumerate(rulebook)])
    ranks = [F.when(F.col(f"_{i}") > 0, F.col(f"_{i}") * base + (base - 1 - i)).otherwise(0) for i in range(n)]
    ranked = scored.select("reference", sum((F.col(f"_{i}") for i in range(n)), F.lit(0)).alias("_total"), *[r.alias(f"_r{i}") for i, r in enumerate(ranks)])
    best = ranked.withColumn("_first", F.greatest(*[F.col(f"_r{i}") for i in range(n)]))
    best = best.withColumn("_second", F.greatest(*[F.when(F.col(f"_r{i}") < F.col("_first"), F.col(f"_r{i}")).otherwise(0) for i in range(n)]))
    code = lambda rank: F.when(rank > 0, F.element_at(F.array(*[F.lit(c) for c, _ in rulebook]), (base - rank % base).cast("int")))
    first, second = F.col("_first"), F.col("_second")
    raw = F.when(first > 0, F.floor(first / base) / F.col("_total")).otherwise(0.0)
    return best.select(
        "reference",
        F.when(raw >= LEAST_CONFIDENCE, code(first)).otherwise(FALLBACK).alias("specialty_code"),
        (F.floor(raw * 100 + 0.5) / 100).alias("confidence"),
        code(second).alias("runner_up"),
        F.when((first > 0) & (raw < LEAST_CONFIDENCE), code(first)).alias("demoted"),
    )


def classification_store(stored: DataFrame, classes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Stored classes replaced by the new ones of tenders in the snapshot."""
    new = classes.join(snapshot.select("reference").distinct(), "reference", "left_semi").select(stored.columns)
    return stored.join(new, "reference", "left_anti").unionByName(new)


def classification_counts(classes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """How many classes of tenders with a reference are stored, and how many skipped for want of their
    tender in the snapshot."""
    known = snapshot.select("reference").distinct().withColumn("known", F.lit(True))
    j = classes.where(F.coalesce("reference", F.lit("")) != "").join(known, "reference", "left")
    return j.agg(F.count("known").alias("classified"), F.count_if(F.col("known").isNull()).alias("skipped"))


def days_left(deadline: Column, now: str) -> Column:
    """Whole days to a text deadline, rounded up; null without a readable one."""
    at = F.try_to_timestamp(deadline, F.lit("yyyy-MM-dd HH:mm"))
    return F.ceil((F.unix_seconds(at) - F.unix_seconds(F.lit(now).cast("timestamp"))) / 86400.0)


def suitability_score(now: str) -> Column:
    days = F.when(F.coalesce(F.col("deadline"), F.lit("")) == "", F.lit(10)).otherwise(days_left(F.col("deadline"), now))
    score = F.lit(60) + F.when(F.col("fee") >= 500, 6).otherwise(0) + F.when(F.col("title").rlike("صيانة|ترميم|تأهيل|إنشاء|إصلاح|تطوير"), 8).otherwise(0) - F.when(days <= 2, 8).otherwise(0)
    return F.greatest(F.lit(25), F.least(F.lit(90), score)).cast("long")


def crowding_rules(now: str) -> list[tuple[Column, int, str]]:
    """(condition, points, factor); of the fee rules and of the guarantee rules the first that holds."""
    fee, guarantee, days = F.col("fee"), F.coalesce("guarantee", F.lit("")), days_left(F.col("deadline"), now)
    free = fees.is_verified_free(fee, F.col("fee_verification"))
    none = guarantee.contains("لا يوجد")
    return [
        (F.col("tender_type") == "شراء مباشر", -12, "direct"),
        (F.col("tender_type") == "منافسة عامة", 8, "public"),
        (free, 10, "free"),
        (~free & (fee == 0), 0, "fee-unverified"),
        (~free & (fee >= 500), -7, "fee-high"),
        (~free & (fee != 0) & (fee < 500), 3, "fee-low"),
        (none, 8, "no-guarantee"),
        (~none & guarantee.contains("ضمان"), -8, "guarantee"),
        (F.col("n_attachments") >= 7, -6, "many-files"),
        (F.col("region").contains("الرياض") | F.col("region").contains("مكة") | F.col("region").contains("الشرقية"), 5, "big-region"),
        (F.col("region") == "غير محددة", -4, "no-region"),
        (days <= 5, -9, "short"),
        (days >= 18, 5, "long"),
    ]


def crowding_score(now: str) -> Column:
    points = reduce(lambda a, r: a + F.when(r[0], r[1]).otherwise(0), crowding_rules(now), F.lit(52))
    return F.greatest(F.lit(10), F.least(F.lit(90), points)).cast("long")


def crowding_signal(tenders: DataFrame, now: str) -> DataFrame:
    """Score, level, factors and confidence of the expected competition."""
    factors = F.array_join(F.filter(F.array(*[F.when(c, name) for c, _, name in crowding_rules(now)]), lambda x: x.isNotNull()), ",")
    known = sum((F.coalesce(F.col(c) != "", F.lit(False)).cast("int") for c in ("tender_type", "guarantee", "region", "deadline")), F.lit(0))
    scored = tenders.select("reference", crowding_score(now).alias("crowding"), factors.alias("factors"), F.when(known >= 4, "متوسطة").otherwise("منخفضة").alias("confidence"))
    return scored.withColumn("level", F.when(F.col("crowding") <= 38, "منخفض").when(F.col("crowding") <= 62, "متوسط").otherwise("مرتفع"))


def assessment_decision(reviews: DataFrame) -> DataFrame:
    """Missing files, risks and the preliminary decision of a review."""
    present = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda *rules: F.array_join(F.filter(F.array(*rules), lambda x: x.isNotNull()), ",")
    missing = some(*[F.when(~present(c), c) for c in ("booklet", "boq", "conditions")])
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    no_scope, no_class, no_guarantee = is_("scope_fit", "غير مطابق"), is_("classification", "غير مطابق"), is_("guarantee_state", "غير متاح")
    risks = some(F.when(no_scope, "scope"), F.when(no_class, "classification"), F.when(no_guarantee, "guarantee"), F.when(is_("special_terms", "توجد ملاحظة حرجة"), "terms"))
    excluded = no_scope | no_class | no_guarantee
    ready = (missing == "") & is_("scope_fit", "مطابق") & is_("classification", "مطابق") & ~F.coalesce(F.col("guarantee_state").isin("غير معروف", "غير متاح"), F.lit(True)) & is_("special_terms", "تمت المراجعة")
    return reviews.select("reference", missing.alias("missing"), risks.alias("risks"), F.when(excluded, "استبعاد مبدئي").when(ready, "مناسب مبدئيًا").otherwise("مطلوب استكمال").alias("decision"))


def fee_label() -> Column:
    state = F.col("fee_verification")
    return F.when(F.col("fee") == 0, F.when(state == "detail-verified", "مجانية مؤكدة").otherwise("السعر غير متحقق")).when(state == "detail-verified", "مؤكد من التفاصيل").when(state == "card-observed", "من القائمة").otherwise("غير مؤكد")


def fee_evidence_mix(tenders: DataFrame) -> DataFrame:
    """Tenders by region and evidence label."""
    return tenders.groupBy("region", fee_label().alias("label")).agg(F.count("*").alias("n"))


def priority_topk(tenders: DataFrame, now: str, k: int = 3) -> DataFrame:
    """The k quietest tenders, the better score first, with their rank."""
    top = tenders.select("reference", crowding_score(now).alias("crowding"), "score").orderBy("crowding", F.col("score").desc(), "reference").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy("crowding", F.col("score").desc(), "reference")))
