"""The tender board: projection, search, filters, sorting and nested assembly."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fees, text
from ..sources.storage import stored

ACTIVE = "المنافسات النشطة (تقديم العروض)"
PLACEHOLDER_DEADLINE = "أدخل الموعد"
DETAIL_FIELDS = ("title", "agency", "region", "deadline", "published_at", "activity", "tender_type")


def tender_projection(tenders: DataFrame, details: DataFrame) -> DataFrame:
    """Captured detail values over stored ones (an empty text falls through), and defaults."""
    fields = F.from_json("payload", ", ".join(f"{c} STRING" for c in DETAIL_FIELDS))
    joined = tenders.join(details.select("reference", fields.alias("d")), "reference", "left")
    value = {c: F.coalesce(F.nullif(F.col(f"d.{c}"), F.lit("")), F.nullif(F.col(c), F.lit(""))) for c in DETAIL_FIELDS}
    out = {**value, "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("جديدة")), "score": F.coalesce("score", F.lit(60)), "deadline": F.coalesce(value["deadline"], F.lit(PLACEHOLDER_DEADLINE))}
    return joined.select("reference", *[e.alias(c) for c, e in out.items()], "fee", "fee_verification")


def tender_filter(
    tenders: DataFrame,
    query: str = "",
    reference: str = "",
    agency: str = "",
    regions: tuple[str, ...] = (),
    platform_status: str | None = None,
    activity: str | None = None,
    tender_type: str | None = None,
    published_after: str | None = None,
    deadline_from: str | None = None,
    deadline_to: str | None = None,
    fee_mode: str = "all",
    fee_min: float | None = None,
    fee_max: float | None = None,
) -> DataFrame:
    """Conjunction of the board's filters; missing values pass most of them, as does the placeholder
    deadline. fee_mode: all, free (verified), exact (fee_min), range."""
    fold = text.fold_board
    needle = lambda value: fold(F.lit(value))
    rules: list[Column] = []
    if query:
        rules.append(fold(F.concat_ws(" ", "title", "agency", "reference", "region", "status")).contains(needle(query)))
    if reference:
        rules.append(fold(F.col("reference")).contains(needle(reference)))
    if agency:
        rules.append(fold(F.col("agency")).contains(needle(agency)))
    if regions:
        wanted = F.array(*[fold(text.region_needle(F.lit(r))) for r in regions])
        rules.append(F.exists(wanted, lambda r: fold(F.col("region")).contains(r)))
    if platform_status:
        rules.append(F.coalesce("platform_status", F.lit(ACTIVE)) == platform_status)
    for column, value in (("activity", activity), ("tender_type", tender_type)):
        if value:
            rules.append(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(value)) == value)
    if published_after:
        rules.append(F.coalesce(F.col("published_at") >= published_after, F.lit(True)))
    day, open_end = F.substring("deadline", 1, 10), F.col("deadline") == PLACEHOLDER_DEADLINE
    if deadline_from:
        rules.append(open_end | (day >= deadline_from))
    if deadline_to:
        rules.append(open_end | (day <= deadline_to))
    if fee_mode == "free":
        rules.append(fees.is_verified_free(F.col("fee"), F.col("fee_verification")))
    elif fee_mode == "exact":
        rules.append(F.col("fee") == (fee_min or 0))
    elif fee_mode == "range":
        rules += [F.col("fee") >= fee_min] * (fee_min is not None) + [F.col("fee") <= fee_max] * (fee_max is not None)
    for rule in rules:
        tenders = tenders.where(rule)
    return tenders


SORTS = {
    "crowding": (F.col, ("crowding", True), ("score", False)),
    "fee-asc": (F.col, ("fee", True)),
    "fee-desc": (F.col, ("fee", False)),
    "deadline": (F.col, ("deadline", True)),
    "score": (F.col, ("score", False)),
}


def tender_sort(tenders: DataFrame, mode: str) -> DataFrame:
    """The board's orders, the reference as the last key."""
    keys = SORTS[mode][1:]
    return tenders.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys], "reference")


def tender_board(tenders: DataFrame, states: DataFrame, details: DataFrame, attachments: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Tenders with user state, details and their attachments, newest first."""
    if requested is not None:
        tenders = tenders.join(requested.select("reference"), "reference", "left_semi")
    files = attachments.groupBy("reference").agg(F.array_sort(F.collect_list(F.struct("display_name", "availability"))).alias("files"))
    joined = tenders.join(states, "reference", "left").join(details, "reference", "left").join(files, "reference", "left")
    return joined.withColumn("files", F.coalesce("files", F.array().cast("array<struct<display_name:string,availability:string>>"))).orderBy(F.col("published_at").desc(), "reference")


def job_bundle(jobs: DataFrame, documents: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """A job with its document, its findings and its model runs in order."""
    f = findings.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("pos", "statement"))).alias("findings"))
    r = runs.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("pos", "provider"))).alias("runs"))
    return jobs.join(documents, "document_id", "left").join(f, "job_id", "left").join(r, "job_id", "left")


def catalog_tree(activities: DataFrame, subs: DataFrame) -> DataFrame:
    """Activities with their sub-activities nested by name."""
    nested = subs.groupBy("activity").agg(F.array_sort(F.collect_list("sub_activity")).alias("subs"))
    return activities.join(nested, "activity", "left").withColumn("subs", F.coalesce("subs", F.array().cast("array<string>")))


# --- saved searches and profiles -----------------------------------------------------------------

# Words that a search text may hold.
REGION_WORDS = ("القصيم", "الرياض", "مكة المكرمة", "مكة", "المدينة المنورة", "المدينة", "الشرقية", "عسير", "تبوك", "حائل", "الحدود الشمالية", "الحدود", "جازان", "نجران", "الباحة", "الجوف")
SPECIALTY_WORDS = ("مباني", "طرق", "صيانة", "كهروميكانيكا", "ميكانيكا", "كهرباء", "مياه", "طاقة", "لاندسكيب", "حدائق", "هدم", "تقنية", "اتصالات", "تشطيبات", "أثاث", "أعمال عامة", "عامة")
FREE_WORDS, PAID_WORDS = "مجاني|مجانًا|مجانا|بدون رسوم|صفر", "مدفوعة|مدفوع"
DEADLINE_WORDS = (("هذا الأسبوع|هذا الاسبوع", 7), ("اليوم|غدًا|غدا", 1), ("هذا الشهر", 30))


def parse_searches(searches: DataFrame) -> DataFrame:
    """Search text -> reference, regions, specialties, fee, days and the text that is left. Words
    are taken out one after another, so that a longer name hides the shorter inside it."""
    rest = F.concat(F.lit(" "), F.trim("text"), F.lit(" "))
    out = searches.withColumn("reference", F.nullif(F.regexp_extract(rest, r"\b(\d{12})\b", 1), F.lit(""))).withColumn("rest", rest)
    out = out.withColumns({"regions": F.array().cast("array<string>"), "specialties": F.array().cast("array<string>")})
    for column, words, spaced in (("regions", REGION_WORDS, True), ("specialties", SPECIALTY_WORDS, False)):
        for word in words:
            needle = f" {word} " if spaced else word
            hit = F.col("rest").contains(needle)
            out = out.select(*[c for c in out.columns if c not in (column, "rest")], F.when(hit, F.array_append(column, F.lit(word))).otherwise(F.col(column)).alias(column), F.when(hit, F.regexp_replace("rest", f"^(.*?){needle}", "$1 ")).otherwise(F.col("rest")).alias("rest"))
    fee = F.when(F.col("rest").rlike(FREE_WORDS), "0").when(F.col("rest").rlike(PAID_WORDS), "paid")
    out = out.withColumn("fee_chip", fee).withColumn("rest", F.when(F.col("fee_chip") == "0", F.regexp_replace("rest", FREE_WORDS, " ")).when(F.col("fee_chip") == "paid", F.regexp_replace("rest", PAID_WORDS, " ")).otherwise(F.col("rest")))
    days, cleaned = F.lit(None).cast("int"), F.col("rest")
    for pattern, n in reversed(DEADLINE_WORDS):
        days = F.when(F.col("rest").rlike(pattern), n).otherwise(days)
        cleaned = F.when(F.col("rest").rlike(pattern), F.regexp_replace("rest", pattern, " ")).otherwise(cleaned)
    return out.withColumn("days", days).withColumn("needle", text.squash(cleaned)).drop("rest")


#: Letters of the pieces under which texts and searches meet.
GRAM = 3
_CHIPS = ("wanted", "regions", "specialties", "fee_chip", "days", "needle")


def _grams(c: Column, size: Column | int) -> Column:
    """The distinct substrings of a size; none of a shorter text."""
    n = F.length(c) - size + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(size) if isinstance(size, int) else size)))


def _first_hits(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's hits (chip_id, reference): for each search how many, and the first `top` references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        firsts: dict[int, list[str]] = {}
        for batch in batches:
            for chip, own in batch.to_pandas().groupby("chip_id")["reference"]:
                counts[chip] = counts.get(chip, 0) + len(own)
                firsts[chip] = heapq.nsmallest(top, [*firsts.get(chip, ()), *own])
        yield pa.RecordBatch.from_pydict({"chip_id": pa.array(counts, pa.int64()), "n": pa.array(counts.values(), pa.int64()), "firsts": pa.array(firsts.values(), pa.list_(pa.string()))})

    return run


def saved_search_match(searches: DataFrame, tenders: DataFrame, now: str, top: int = 8) -> DataFrame:
    """For each saved search the number of tenders that satisfy all its chips, and the top ones by
    reference. Searches with equal chips are one. Each stands under one key: its reference; else, of
    the three-letter pieces of the words that it requires (shorter words whole), the one that fewest
    tenders hold; else its regions, else its fee. Tenders are cut into pieces once and meet the searches
    by key, so only they are verified; hits are counted, and the first kept, inside each task."""
    parsed = parse_searches(searches).withColumnRenamed("reference", "wanted")
    chips = stored(parsed.select("search_id", *_CHIPS, F.xxhash64(*_CHIPS).alias("chip_id")))
    asked = chips.select("chip_id", *_CHIPS).distinct()
    hay = F.concat_ws(" ", "activity", "title", "agency")
    # pieces of the words that a search requires
    terms = F.filter(F.array_append("specialties", F.col("needle")), lambda t: t != "")
    pieces = asked.where("wanted is null").select("chip_id", F.explode(terms).alias("term")).withColumn("size", F.least(F.length("term"), F.lit(GRAM)))
    # stored, so that Spark knows how few they are before it would shuffle all pieces of all tenders
    pieces = stored(pieces.select("chip_id", "size", F.explode(_grams(F.col("term"), F.col("size"))).alias("key")))
    sizes = [r["size"] for r in pieces.select("size").distinct().collect()]  # at most GRAM
    held = F.flatten(F.array(*[_grams(hay, n) for n in sizes])) if sizes else F.array().cast("array<string>")
    uses = tenders.select(F.explode(held).alias("key")).join(pieces.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("uses"))
    rarest = pieces.join(uses, "key", "left").groupBy("chip_id").agg(F.min_by("key", F.struct(F.coalesce("uses", F.lit(0)), "key")).alias("rarest"))
    j = asked.join(rarest, "chip_id", "left")
    only_fee = F.coalesce(F.concat(F.lit("fee "), "fee_chip"), F.lit("any"))
    keys = F.when(F.col("wanted").isNotNull(), F.array(F.concat(F.lit("="), "wanted"))).when(F.col("rarest").isNotNull(), F.array(F.concat(F.lit("+"), "rarest"))).when(F.size("regions") > 0, F.transform("regions", lambda r: F.concat(F.lit("@"), r))).otherwise(F.array(only_fee))
    keyed = stored(j.withColumn("key", F.explode(keys)))
    named = F.filter(F.array(*[F.lit(w) for w in REGION_WORDS]), lambda w: F.col("region").contains(w))
    fee_keys = F.when(F.col("fee") == 0, F.array(F.lit("fee 0"))).when(F.col("fee") > 0, F.array(F.lit("fee paid"))).otherwise(F.array().cast("array<string>"))
    own = F.concat(F.array(F.concat(F.lit("="), "reference"), F.lit("any")), fee_keys, F.transform(F.coalesce(named, F.array().cast("array<string>")), lambda w: F.concat(F.lit("@"), w)), F.transform(held, lambda g: F.concat(F.lit("+"), g)))
    offered = tenders.select("reference", "title", "agency", "activity", "region", "fee", "deadline", F.explode(own).alias("key"))
    met = offered.join(keyed, "key")
    day = F.try_to_timestamp(F.col("deadline"), F.lit("yyyy-MM-dd HH:mm"))
    until = F.lit(now).cast("timestamp") + F.make_dt_interval(F.col("days"))
    words = F.concat_ws(" ", "activity", "title")
    rules = (
        # a tender of several of the regions counts under the first of them
        (F.size("regions") == 0) | F.when(F.col("key").startswith("@"), F.concat(F.lit("@"), F.get(F.filter("regions", lambda r: F.col("region").contains(r)), F.lit(0))) == F.col("key")).otherwise(F.exists("regions", lambda r: F.col("region").contains(r))),
        F.forall("specialties", lambda w: words.contains(w)),
        F.col("fee_chip").isNull() | ((F.col("fee_chip") == "0") & (F.col("fee") == 0)) | ((F.col("fee_chip") == "paid") & (F.col("fee") > 0)),
        F.col("days").isNull() | F.coalesce((day >= F.lit(now).cast("timestamp")) & (day <= until), F.lit(False)),
        (F.col("needle") == "") | F.concat_ws(" ", "title", "agency").contains(F.col("needle")),
    )
    hits = met.where(F.col("wanted").isNotNull() | (rules[0] & rules[1] & rules[2] & rules[3] & rules[4])).select("chip_id", "reference")
    per = hits.mapInArrow(_first_hits(top), "chip_id long, n long, firsts array<string>")
    ranked = per.groupBy("chip_id").agg(F.sum("n").alias("n_hits"), F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, top).alias("firsts"))
    return chips.select("search_id", "chip_id").join(ranked, "chip_id").select("search_id", F.posexplode("firsts").alias("place", "reference"), "n_hits").withColumn("place", F.col("place") + 1)


def profile_resolve(profiles: DataFrame, activities: DataFrame, subs: DataFrame) -> DataFrame:
    """Names and portal values of a profile's activity and sub-activities, what blocks its sync."""
    names = profiles.select("profile_id", F.explode_outer("sub_ids").alias("sub_id")).join(subs, "sub_id", "left").groupBy("profile_id").agg(F.array_sort(F.collect_list("sub_name")).alias("sub_names"))
    joined = profiles.join(activities, "activity_id", "left").join(names, "profile_id", "left")
    rules = F.array(
        F.when(F.col("activity_id").isNull() | F.col("activity_name").isNull(), "no-activity"),
        F.when(F.col("activity_name").isNotNull() & F.col("portal_value").isNull(), "no-portal-value"),
        F.when(F.size("sub_ids") > 0, "sub-activities"),
        F.when(F.coalesce(F.col("platform_status"), F.lit("")) != ACTIVE, "status"),
    )
    blockers = F.filter(rules, lambda r: r.isNotNull())
    return joined.withColumn("blockers", blockers).withColumn("sync_ready", F.size("blockers") == 0)


def profile_audit(profiles: DataFrame, activities: DataFrame, subs: DataFrame) -> DataFrame:
    """Codes of the rules that a submitted profile breaks, its clamped target and valid regions."""
    known = activities.select("activity_id", F.lit(True).alias("known")).distinct()
    alien = profiles.select("profile_id", "activity_id", F.explode("sub_ids").alias("sub_id")).join(subs.select("sub_id", F.col("activity_id").alias("owner")), "sub_id", "left").groupBy("profile_id").agg(F.max(F.coalesce(F.col("owner") != F.col("activity_id"), F.lit(True))).alias("alien"))
    names = profiles.groupBy("name").agg(F.count("*").alias("same_name"))
    enabled = profiles.where("enabled").agg(F.count("*").alias("n_enabled"))
    joined = profiles.join(known, "activity_id", "left").join(alien, "profile_id", "left").join(names, "name", "left").crossJoin(F.broadcast(enabled))
    rules = F.array(
        F.when(~F.length(F.trim("name")).between(1, 120), "name"),
        F.when(F.col("known").isNull(), "activity"),
        F.when(F.col("alien"), "sub-activity"),
        F.when(F.col("fee_min") < 0, "fee-min"),
        F.when(F.col("fee_max") < F.col("fee_min"), "fee-max"),
        F.when(F.col("same_name") > 1, "duplicate-name"),
        F.when(F.col("enabled") & (F.col("n_enabled") > 1), "several-enabled"),
    )
    valid = F.filter("regions", lambda r: r.cast("int").between(1, 13))
    return joined.select("profile_id", F.array_join(F.filter(rules, lambda r: r.isNotNull()), ",").alias("codes"), F.greatest(F.lit(1), F.least(F.lit(100), "target")).alias("target"), F.array_join(valid, ",").alias("regions"))


def scan_scope_expand(profiles: DataFrame, regions: DataFrame, buckets: DataFrame) -> DataFrame:
    """Enabled profiles as region x fee bucket scan scopes with a canonical key. Regions and buckets
    are fixed lists of 13 and 2."""
    low, high = F.coalesce("fee_min", F.lit(0.0)), F.coalesce("fee_max", F.lit(600.0))
    own = profiles.where("enabled").withColumns({"fee_min": low, "fee_max": high, "target": F.greatest(F.lit(1), F.least(F.lit(100), "target"))})
    scoped = own.join(F.broadcast(regions), F.expr("size(regions) = 0 or array_contains(regions, region_id)"))
    scoped = scoped.join(F.broadcast(buckets), F.expr("(bucket_id = 'free' and fee_min <= 0) or (bucket_id <> 'free' and fee_max > 0)"))
    key = F.concat_ws("|", F.concat(F.lit("activity:"), "activity_id"), F.concat(F.lit("region:"), "region_id"), F.concat(F.lit("fee:"), F.col("fee_min").cast("long").cast("string"), F.lit("-"), F.col("fee_max").cast("long").cast("string")))
    return scoped.select("profile_id", "region_id", "bucket_id", "target", key.alias("scope_key"))


def allowlist_gate(requests: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Requests of allowlisted tenders whose manifest has exactly one file."""
    return requests.join(allowlist.select("reference").distinct(), "reference", "left_semi").where(F.size("files") == 1)
