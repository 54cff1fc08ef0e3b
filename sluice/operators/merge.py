"""Incremental snapshots: observations, merges, differences and the ledgers beside them.

Order is data: first and last are always decided by an explicit sequence column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fees

MANY_REGIONS = "متعدد المناطق: "
NO_REGION = "غير محددة"
COMPARED = ("title", "agency", "fee", "region", "deadline", "published_at")
LOGGED = ("title", "agency", "fee", "region", "deadline", "published_at", "platform_status", "activity", "fee_verification")


def observation_upsert(observations: DataFrame) -> DataFrame:
    """The latest observation of each run, reference and region."""
    rest = [c for c in observations.columns if c not in ("sync_run_id", "reference", "region_id")]
    latest = observations.groupBy("sync_run_id", "reference", "region_id").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return latest.select("sync_run_id", "reference", "region_id", "r.*")


def region_cap(observations: DataFrame, target: int = 100, fee_min: float = 0, fee_max: float = 600) -> DataFrame:
    """The first `target` cards of each run and region, free bucket first, then pages; only then the
    paid cards outside the fee range go, having taken their place in the cap."""
    bucket = F.when(F.col("fee_bucket") == "free", 0).otherwise(1)
    order = W.partitionBy("sync_run_id", "region_id").orderBy(bucket, "page_number", "reference", "seq")
    capped = observations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= target)
    return capped.where((F.col("fee_bucket") == "free") | F.col("fee").between(fee_min, fee_max))


def appearance_merge(observations: DataFrame, keys: tuple[str, ...] = ("sync_run_id", "reference")) -> DataFrame:
    """One row per key: attributes of the first appearance, the fee with the best evidence (the
    latest among equals), the regions in the order first seen."""
    rank = fees.evidence_rank(F.col("fee_verification"))
    per_region = observations.groupBy(*keys, "region_name").agg(
        F.min("seq").alias("first_seen"),
        F.min_by(F.struct("title", "agency"), "seq").alias("attributes"),
        F.max(F.when(F.col("fee").isNotNull(), F.struct(rank.alias("rank"), F.col("seq"), F.col("fee"), F.col("fee_verification")))).alias("best"),
    )
    merged = per_region.groupBy(*keys).agg(F.min_by("attributes", "first_seen").alias("attributes"), F.max("best").alias("best"), F.array_sort(F.collect_list(F.struct("first_seen", "region_name"))).alias("regions"))
    names = F.transform("regions", lambda r: r["region_name"])
    label = F.when(F.size(names) > 1, F.concat(F.lit(MANY_REGIONS), F.array_join(names, "، "))).otherwise(names[0])
    return merged.select(*keys, "attributes.*", F.col("best.fee").alias("fee"), F.coalesce("best.fee_verification", F.lit("unknown")).alias("fee_verification"), label.alias("region"), F.size(names).cast("long").alias("n_regions"))


def fee_evidence(texts: DataFrame) -> DataFrame:
    """Card and detail evidence of a fee text and the address it was read from."""
    value = fees.fee_value(F.col("fee_text"))
    trusted = fees.is_trusted_detail_url(F.col("source_url"))
    return texts.withColumns({"fee": value, "fee_verification": F.when(value.isNotNull(), "card-observed").otherwise("unknown"), "trusted": trusted, "detail_fee": F.when(trusted, value)})


def _merged_fee(in_fee: Column, in_state: Column, prev_fee: Column, prev_state: Column, known_before: Column) -> Column:
    state_before = F.when(prev_state.isin(*fees.RANKS), prev_state).otherwise("unknown")
    fee_before = F.when(prev_fee >= 0, prev_fee).otherwise(0.0)
    better = F.coalesce((in_state != "unknown") & (in_fee >= 0) & (fees.evidence_rank(in_state) >= fees.evidence_rank(state_before)), F.lit(False))
    new = F.when(F.coalesce(in_state, F.lit("unknown")) == "unknown", F.struct(F.lit(0.0).alias("fee"), F.lit("unknown").alias("state"))).otherwise(F.struct(F.coalesce(in_fee, F.lit(0.0)).alias("fee"), in_state.alias("state")))
    return F.when(~known_before, new).when(better, F.struct(in_fee.alias("fee"), in_state.alias("state"))).otherwise(F.struct(fee_before.alias("fee"), state_before.alias("state")))


def fee_evidence_merge(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming fee where it is known and its evidence is at least as good, else the previous one."""
    prev = previous.select("reference", F.col("fee").alias("p_fee"), F.col("fee_verification").alias("p_state"), F.lit(True).alias("known"))
    joined = incoming.join(prev, "reference", "left")
    merged = _merged_fee(F.col("fee"), F.col("fee_verification"), F.col("p_fee"), F.col("p_state"), F.coalesce("known", F.lit(False)))
    return joined.withColumn("m", merged).select(*[c for c in incoming.columns if c not in ("fee", "fee_verification")], F.col("m.fee").alias("fee"), F.col("m.state").alias("fee_verification"))


def new_tenders(previous: DataFrame, incoming: DataFrame, baseline: DataFrame) -> DataFrame:
    """Incoming rows whose reference neither the snapshot nor the baseline knows."""
    return incoming.join(previous.select("reference").union(baseline.select("reference")), "reference", "left_anti")


def changed_tenders(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that were known under a title and differ in one of the compared fields."""
    prev = previous.where(F.col("title") != "").select("reference", *[F.col(c).alias(f"p_{c}") for c in COMPARED])
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return incoming.join(prev, "reference").where(~same).select(incoming.columns)


def change_log(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per logged field that changed, with both values as text."""
    prev = previous.select("reference", *[F.col(c).cast("string").alias(f"p_{c}") for c in LOGGED])
    both = incoming.select("reference", *[F.col(c).cast("string").alias(c) for c in LOGGED]).join(prev, "reference")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"p_{c}").alias("old_value"), F.col(c).alias("new_value")) for c in LOGGED]))
    return both.select("reference", fields.alias("f")).select("reference", "f.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


#: The columns of a snapshot that a run overwrites.
SNAPSHOT_COLUMNS = (
    "title", "agency", "fee", "region", "deadline", "published_at", "platform_status", "activity", "sub_activity", "tender_type", "etimad_url", "tender_number", "contract_duration", "guarantee", "location", "quantity_summary", "attachment_names",
    "fee_verification", "fee_raw_text", "source_hash",
)


def snapshot_upsert(previous: DataFrame, incoming: DataFrame, now: str, complete_activity: str | None = None) -> DataFrame:
    """The next snapshot: incoming rows overwrite the value columns, those of SNAPSHOT_COLUMNS that both
    tables have; first_seen stays, and so does what only details give (fee_verified_at). Rows not seen
    stay; after a run over the complete scope of an activity its unseen rows become inactive."""
    values = [c for c in SNAPSHOT_COLUMNS if c in incoming.columns and c in previous.columns]
    kept = [c for c in ("fee_verified_at",) if c in previous.columns]
    n, p = incoming.select("reference", *[F.col(c).alias(f"n_{c}") for c in values], F.lit(True).alias("seen")), previous
    joined = p.join(n, "reference", "full_outer")
    seen = F.coalesce("seen", F.lit(False))
    pick = {c: F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c)) for c in values}
    pick["region"] = F.when(seen, F.coalesce(F.nullif(F.col("n_region"), F.lit("")), F.lit(NO_REGION))).otherwise(F.col("region"))
    gone = ~seen & F.coalesce(F.col("activity") == complete_activity, F.lit(False)) if complete_activity is not None else F.lit(False)
    active = F.when(seen, True).when(gone, False).otherwise(F.col("active"))
    return joined.select("reference", *[e.alias(c) for c, e in pick.items()], *kept, active.alias("active"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(seen, F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"))


def snapshot_deactivate(previous: DataFrame, incoming: DataFrame, activity: str, complete_scope: bool) -> DataFrame:
    """The snapshot with `active` off for the activity's rows that a complete run did not see."""
    if not complete_scope:
        return previous
    seen = incoming.select("reference").distinct().withColumn("seen", F.lit(True))
    gone = F.coalesce(F.col("activity") == activity, F.lit(False)) & F.col("seen").isNull()
    return previous.join(seen, "reference", "left").withColumn("active", F.col("active") & ~gone).select(previous.columns)


def user_state_init(states: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing states and a default one for every reference without."""
    fresh = incoming.select("reference").distinct().join(states, "reference", "left_anti")
    return states.select("reference", "status", "documents", "score").unionByName(fresh.select("reference", F.lit("جديدة").alias("status"), F.lit("بانتظار الكراسة").alias("documents"), F.lit(60).alias("score")))


def attachment_merge(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Known attachments hidden for every tender that was read, the listed ones visible again;
    unknown availability becomes metadata-only."""
    read = listed.select("reference").distinct().withColumn("read", F.lit(True))
    new = listed.select("reference", "display_name", F.col("kind").alias("n_kind"), F.lit(True).alias("listed"))
    both = known.join(new, ["reference", "display_name"], "full_outer").join(read, "reference", "left")
    listed_now = F.coalesce("listed", F.lit(False))
    available = F.when(listed_now, F.when(F.coalesce("availability", F.lit("unknown")) == "unknown", "metadata-only").otherwise(F.col("availability"))).otherwise(F.col("availability"))
    visible = F.when(listed_now, True).when(F.coalesce("read", F.lit(False)), False).otherwise(F.col("visible"))
    return both.select("reference", "display_name", F.coalesce("n_kind", "kind").alias("kind"), available.alias("availability"), visible.alias("visible"))


def availability_demote(attachments: DataFrame, tenders: DataFrame) -> DataFrame:
    """Free attachments of tenders with a verified positive fee become restricted."""
    paid = tenders.where((F.col("fee") > 0) & (F.col("fee_verification") == "detail-verified")).select("reference").distinct().withColumn("paid", F.lit(True))
    demoted = F.when((F.col("availability") == "free-available") & F.col("paid"), "restricted").otherwise(F.col("availability"))
    return attachments.join(paid, "reference", "left").withColumn("availability", demoted).select(attachments.columns)


#: What a detail page may fill in, the statuses of a page that was read, the name of
#: the field that changes at every read and the line that states it.
DETAIL_COLUMNS = ("tender_number", "tender_type", "sub_activity", "contract_duration", "guarantee", "location", "quantity_summary")
READABLE = ("complete", "partial")
VOLATILE_FIELD, VOLATILE_TEXT, MASKED = "timeRemaining", r"(?U)(الوقت المتبق[ىي]\s*\n)[^\n]+", "$1[قيمة متغيرة]"


def detail_patch(tenders: DataFrame, details: DataFrame) -> DataFrame:
    """Tenders with the non-empty values of their details over their own (those of DETAIL_COLUMNS that
    both tables have). Where the page was read and its fee text from a trusted address states one
    amount, the fee, its text and the time of the read replace the tender's, as detail-verified.
    details: reference, status (null: complete), inspected_at, source_url, booklet_fee and columns."""
    values = [c for c in DETAIL_COLUMNS if c in details.columns and c in tenders.columns]
    fee = F.when(F.coalesce("status", F.lit("complete")).isin(*READABLE) & fees.is_trusted_detail_url(F.col("source_url")), fees.fee_value(F.col("booklet_fee")))
    new = details.select("reference", *[F.col(c).alias(f"d_{c}") for c in values], fee.alias("d_fee"), F.col("booklet_fee").alias("d_text"), F.col("inspected_at").alias("d_at"))
    known = F.col("d_fee").isNotNull()
    patch = {c: F.coalesce(F.nullif(F.col(f"d_{c}"), F.lit("")), F.col(c)) for c in values}
    patch |= {c: F.when(known, v).otherwise(F.col(c)) for c, v in (("fee", F.col("d_fee")), ("fee_verification", F.lit("detail-verified")), ("fee_raw_text", F.col("d_text")), ("fee_verified_at", F.col("d_at"))) if c in tenders.columns}
    return tenders.join(new, "reference", "left").withColumns(patch).select(tenders.columns)


def _payload() -> Column:
    """A detail page as JSON whose order does not vary, without what changes at every read: the fields
    sorted by name, the time remaining dropped from them and masked in the sections' texts. In a text
    the value stands on the line after its label."""
    fields = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: k != VOLATILE_FIELD))))
    sections = F.transform(F.coalesce("sections", F.array().cast("array<struct<title:string,text:string>>")), lambda x: F.struct(x["title"].alias("title"), F.regexp_replace(x["text"], VOLATILE_TEXT, MASKED).alias("text")))
    names = F.coalesce("attachments", F.array().cast("array<string>"))
    return F.to_json(F.struct(fields.alias("fields"), sections.alias("sections"), names.alias("attachments"), F.coalesce("page_title", F.lit("")).alias("pageTitle"), F.coalesce("source_url", F.lit("")).alias("sourceUrl")))


def detail_history(details: DataFrame) -> DataFrame:
    """First occurrence of each distinct content of a reference, numbered. details: reference,
    inspected_at, fields (a map), sections (an array of title and text), attachments (names),
    page_title, source_url."""
    hashed = details.withColumn("payload", _payload()).withColumn("content_hash", F.sha2("payload", 256))
    first = hashed.groupBy("reference", "content_hash").agg(F.min("inspected_at").alias("inspected_at"), F.count("*").alias("reads"), F.min("payload").alias("payload"))
    return first.withColumn("version", F.row_number().over(W.partitionBy("reference").orderBy("inspected_at", "content_hash")))


def detail_current(details: DataFrame) -> DataFrame:
    """The last read of each reference, with the hash of its content."""
    rest = [c for c in details.columns if c != "reference"]
    last = details.withColumn("content_hash", F.sha2(_payload(), 256)).withColumn("row", F.struct(*rest, "content_hash")).groupBy("reference").agg(F.max_by("row", F.struct("inspected_at", "content_hash")).alias("row"))
    return last.select("reference", "row.*")


def catalog_upsert(catalog: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Activities with ids from their names; a known portal value stays, last_seen is renewed."""
    own_id = F.concat(F.lit("act-"), F.substring(F.sha2("name_ar", 256), 1, 12))
    new = seen.groupBy("name_ar").agg(F.min("portal_value").alias("n_value")).withColumn("seen", F.lit(True))
    both = catalog.join(new, "name_ar", "full_outer")
    return both.select(own_id.alias("activity_id"), "name_ar", F.coalesce("portal_value", "n_value").alias("portal_value"), F.when(F.col("seen"), F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"))


def sub_catalog_upsert(catalog: DataFrame, subs: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Sub-activities of known activities: ids from the activity's and the own name, known ones kept
    with a new last_seen, names under an unknown activity left out. catalog: name_ar; subs and seen:
    activity, sub_activity, subs with last_seen."""
    own_id = F.concat(F.lit("sub-"), F.substring(F.sha2(F.concat_ws(":", "activity", "sub_activity"), 256), 1, 12))
    known = seen.join(catalog.select(F.col("name_ar").alias("activity")).distinct(), "activity", "left_semi").select("activity", "sub_activity").distinct().withColumn("seen", F.lit(True))
    both = subs.join(known, ["activity", "sub_activity"], "full_outer")
    return both.select(own_id.alias("sub_id"), "activity", "sub_activity", F.when(F.col("seen"), F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"))


def approval_ledger(requests: DataFrame, approvals: DataFrame, at: str) -> DataFrame:
    """State of each request's approval at a time: the first rule that applies. An approval without a
    scope, an expiry or a time of request is an old one and counts as revoked. approvals: approval_id,
    approved_scope, requested_at, expires_at, revoked, consumed."""
    t = F.lit(at).cast("timestamp_ntz")
    joined = requests.join(approvals.withColumn("_found", F.lit(True)), "approval_id", "left")
    whole = (F.coalesce("approved_scope", F.lit("")) != "") & F.col("expires_at").isNotNull() & F.col("requested_at").isNotNull()
    verdict = (
        F.when(F.col("_found").isNull(), "not-found")
        .when(F.col("revoked"), "revoked")
        .when(F.col("consumed"), "consumed")
        .when(F.col("expires_at") <= t, "expired")
        .when(~whole, "revoked")
        .when((F.coalesce("scope", F.lit("")) != "") & (F.col("approved_scope") != F.col("scope")), "scope-mismatch")
        .otherwise("usable")
    )
    return joined.withColumn("verdict", verdict).drop("_found")


#: What may be asked for, and how much of it.
ALLOWED = ("pdf", "xls", "xlsx", "doc", "docx", "ppt", "pptx", "zip", "rar", "7z")
AVAILABILITIES = ("metadata-only", "free-available", "purchased-available", "restricted", "unknown")
MAX_FILES, MAX_FILE, MAX_BATCH = 5, 100 * 1024 * 1024, 300 * 1024 * 1024


def extension(name: Column) -> Column:
    """What follows the last full stop of a trimmed name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.trim(name), r"\.([^.]+)$", 1))


def _quoted(c: Column) -> Column:
    """A text as JSON writes it."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def manifest_audit(files: DataFrame, attachments: DataFrame, extensions: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Verdict of each download request and the first file, by name, that breaks a rule, by its first
    rule: names trimmed, blank ones dropped, of equal ones the first kept; too many files, extension,
    not listed, availability, size; last the batch's size, where all sizes are known. The manifest's
    hash is that of its canonical JSON, [name, size] in order of names. files: reference, pos,
    display_name, size_bytes; attachments: reference, display_name, availability."""
    size = F.when(F.col("size_bytes") < 0, 0).otherwise(F.col("size_bytes"))
    named = files.withColumns({"display_name": F.trim("display_name"), "size_bytes": size})
    once = named.groupBy("reference", "display_name").agg(F.min_by("size_bytes", "pos").alias("size_bytes"))
    known = attachments.groupBy("reference", "display_name").agg(F.max("availability").alias("availability"), F.lit(True).alias("listed"))
    code = (
        F.when(~extension(F.col("display_name")).isin(*extensions), "extension")
        .when(F.col("listed").isNull(), "not-listed")
        .when(~F.coalesce(F.col("availability").isin(*AVAILABILITIES), F.lit(False)), "availability")
        .when(F.col("size_bytes") > MAX_FILE, "file-size")
    )
    given = F.col("display_name") != ""
    rows = once.join(known, ["reference", "display_name"], "left").withColumn("code", code)
    entry = F.struct("display_name", F.concat(F.lit("["), _quoted(F.col("display_name")), F.lit(","), F.coalesce(F.col("size_bytes").cast("string"), F.lit("null")), F.lit("]")).alias("json"))
    per = rows.groupBy("reference").agg(
        F.count_if(given).alias("n_files"), F.sum(F.when(given, F.col("size_bytes"))).alias("total"), F.count(F.when(given, F.col("size_bytes"))).alias("sized"),
        F.min(F.when(given & F.col("code").isNotNull(), F.struct("display_name", "code"))).alias("bad"), F.array_sort(F.collect_list(F.when(given, entry))).alias("entries"),
    )
    verdict = F.when(F.col("n_files") == 0, "no-files").when(F.col("n_files") > MAX_FILES, "count").when(F.col("bad").isNotNull(), F.col("bad.code")).when((F.col("sized") == F.col("n_files")) & (F.col("total") > MAX_BATCH), "batch-size").otherwise("ok")
    json = F.concat(F.lit('{"tenderReference":'), _quoted(F.col("reference")), F.lit(',"files":['), F.array_join(F.transform("entries", lambda x: x["json"]), ","), F.lit("]}"))
    counted = F.col("n_files").between(1, MAX_FILES)
    return per.select("reference", "n_files", verdict.alias("verdict"), F.when(counted, F.col("bad.display_name")).alias("failing_file"), F.sha2(json, 256).alias("manifest_hash"))


def download_queue_build(attachments: DataFrame, per_tender: int = MAX_FILES, auto_approve: bool = False) -> DataFrame:
    """The first per_tender files of each tender in the order listed (pos), all in one state that the
    policy decides: proposed, for a person to approve, or approved at once."""
    place = F.row_number().over(W.partitionBy("reference").orderBy("pos"))
    state = "auto-approved" if auto_approve else "proposed"
    return attachments.withColumn("place", place).where(F.col("place") <= per_tender).withColumn("state", F.lit(state))


def download_queue_summary(queue: DataFrame) -> DataFrame:
    """How many rows a queue has, in all and by state."""
    of = lambda state: F.count_if(F.col("state") == state)
    return queue.agg(F.count("*").alias("rows_created"), of("proposed").alias("proposed"), of("auto-approved").alias("auto_approved"))
