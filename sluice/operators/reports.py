"""Dashboards and operational reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fees
from . import score

MANY = "متعدد"


def _millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def last_run_summary(runs: DataFrame, regions: DataFrame, now: str, top: int = 6, stale_hours: int = 4) -> DataFrame:
    """The latest complete run, with its busiest regions, its age and whether it is stale."""
    last = runs.where("status = 'complete'").groupBy().agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("r")).select("r.*").where("run_id is not null")
    ranked = regions.join(F.broadcast(last.select("run_id")), "run_id").withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy(F.col("checked_count").desc(), "region_id"))).where(F.col("place") <= top)
    lists = ranked.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "region_id", "checked_count"))), lambda x: F.concat(x["region_id"], F.lit("="), x["checked_count"].cast("string"))), ",").alias("top_regions"))
    age = F.unix_millis(F.lit(now).cast("timestamp")) - _millis("finished_at")
    seconds = F.round((_millis("finished_at") - _millis("started_at")) / 1000).cast("long")
    minutes, rest = F.floor(seconds / 60), seconds % 60
    label = F.when(minutes == 0, F.format_string("%d ثانية", rest)).when(rest == 0, F.format_string("%d دقيقة", minutes)).otherwise(F.format_string("%d دقيقة و%d ثانية", minutes, rest))
    return last.join(lists, "run_id", "left").select("run_id", (_millis("finished_at") - _millis("started_at")).alias("duration_ms"), label.alias("duration_label"), "checked_count", "new_count", "changed_count", ((F.col("status") == "complete") & (F.col("regions_completed") == F.col("regions_targeted"))).alias("complete"), age.alias("age_ms"), (age > stale_hours * 3_600_000).alias("stale"), "top_regions")


def region_stats(tenders: DataFrame) -> DataFrame:
    """Tenders per region, with the totals of single- and multi-region ones on every row."""
    counts = tenders.groupBy("region").agg(F.count("*").alias("n"))
    multi = F.col("region").startswith(MANY)
    totals = counts.agg(F.count_if(multi).alias("multi_groups"), F.coalesce(F.sum(F.when(multi, F.col("n"))), F.lit(0)).alias("multi_tenders"), F.sum("n").alias("total"))
    return counts.withColumn("is_multi", multi).crossJoin(F.broadcast(totals)).orderBy(F.col("n").desc(), "region")


def region_share(tenders: DataFrame) -> DataFrame:
    """Rounded percent per region and the percent before it in descending order."""
    counts = tenders.groupBy("region").agg(F.count("*").alias("n"))
    total = F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.col("n").desc(), "region").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.select("region", "n", F.floor(F.col("n") * 100.0 / total + 0.5).alias("percent"), (F.floor(before * 10000.0 / total + 0.5) / 100).alias("offset"))


def storage_overview(files: DataFrame) -> DataFrame:
    """Stored files, their count and size, by kind."""
    stored = files.where(F.col("local_path").isNotNull() & (F.col("local_path") != ""))
    return stored.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("stored_at").alias("newest"))


def storage_listing(files: DataFrame) -> DataFrame:
    """Stored files, newest first."""
    stored = files.where(F.col("local_path").isNotNull() & (F.col("local_path") != ""))
    return stored.orderBy(F.col("stored_at").desc(), "file_id")


def retention_preview(files: DataFrame, now: str, days: int) -> DataFrame:
    """Files with the mark of those stored strictly more than `days` (1..365) before now: their path,
    size and hash are cleared in the next snapshot."""
    kept = max(1, min(365, days))
    old = F.coalesce((F.col("stored_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(kept))) & F.col("local_path").isNotNull(), F.lit(False))
    clear = lambda c: F.when(~old, F.col(c)).alias(c)
    return files.select("file_id", clear("local_path"), clear("size_bytes"), F.when(old, "purged-old").otherwise("stored").alias("state"), F.when(old, F.col("size_bytes")).otherwise(0).alias("freed_bytes"))


def details_stats(details: DataFrame, history: DataFrame) -> DataFrame:
    """Reads, complete and failed ones per reference, and the versions kept."""
    reads = details.groupBy("reference").agg(F.count("*").alias("inspected"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"))
    return reads.join(history.groupBy("reference").agg(F.count("*").alias("versions")), "reference", "left").withColumn("versions", F.coalesce("versions", F.lit(0)))


def run_progress(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """The latest run's regions in numeric order."""
    last = runs.agg(F.max_by(F.struct("run_id", F.col("status").alias("run_status")), F.struct("started_at", "run_id")).alias("r")).select("r.*")
    return regions.join(F.broadcast(last), "run_id").select("run_id", "run_status", "region_id", "status", "checked_count").orderBy(F.col("region_id").cast("int"))


def resumable_run(runs: DataFrame) -> DataFrame:
    """The newest unfinished run that started after the last complete one."""
    last = runs.where("status = 'complete'").agg(F.max("started_at").alias("last_complete"))
    return runs.where("status in ('partial', 'running')").crossJoin(F.broadcast(last)).where(F.col("last_complete").isNull() | (F.col("started_at") > F.col("last_complete"))).orderBy(F.col("started_at").desc(), "run_id").limit(1).drop("last_complete")


def region_rollup(checkpoints: DataFrame) -> DataFrame:
    """Cards checked per run and region, whether the cursor has left the region, and how many regions
    of the run it has left."""
    per = checkpoints.groupBy("sync_run_id", "region_id").agg(F.max("page_number").alias("pages"), F.count("*").alias("checked"), F.max_by("fee_bucket", F.struct("page_number", "reference", "seq")).alias("last_bucket"))
    furthest = W.partitionBy("sync_run_id").orderBy(F.col("region_id").cast("int").desc())
    done = F.count("*").over(W.partitionBy("sync_run_id")) - 1
    return per.withColumns({"status": F.when(F.row_number().over(furthest) == 1, "running").otherwise("complete"), "regions_completed": done})


def board_kpis(tenders: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """Counts over the board beside the latest run."""
    kpis = tenders.agg(
        F.count_if(F.col("status") == "مناسبة").alias("suitable"),
        F.count_if(F.col("n_attachments") >= 3).alias("files_complete"),
        F.count_if(fees.is_verified_free(F.col("fee"), F.col("fee_verification"))).alias("verified_free"),
        F.count_if(score.crowding_score(now) <= 38).alias("quiet"),
    )
    head = runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return kpis.crossJoin(head)


def recent_activity(activity: DataFrame, n: int = 50) -> DataFrame:
    """The newest n (at most 50) activities."""
    return activity.orderBy(F.col("created_at").desc(), F.col("activity_id").desc()).limit(min(50, n))


def nightly_summary(activity: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest detail of each role beside the counts of the latest run."""
    latest = activity.groupBy().pivot("role", ["classifier", "courier"]).agg(F.max_by("detail", F.struct("created_at", "activity_id")))
    head = runs.agg(F.max_by(F.struct("run_id", "checked_count", "new_count", "changed_count"), F.struct("started_at", "run_id")).alias("r")).select("r.*")
    return latest.crossJoin(head)


def queue_list(queue: DataFrame, state: str, most: int = 500) -> DataFrame:
    """Newest rows of a state, at most 500."""
    return queue.where(F.col("state") == state).orderBy(F.col("created_at").desc(), "queue_id").limit(min(500, most))


def queue_transition(queue: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows with their new state; a null size or time keeps what was known."""
    new = updates.select("queue_id", F.col("state").alias("n_state"), F.col("size_bytes").alias("n_size"))
    return queue.join(new, "queue_id", "left").withColumns({"state": F.coalesce("n_state", "state"), "size_bytes": F.coalesce("n_size", "size_bytes")}).select(queue.columns)
