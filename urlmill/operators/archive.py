"""The scan archive: counters folded from an append-only log, replay, approvals, and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import effective_verdict, tally
from .intel import latest

VERDICTS = ("malicious", "safe", "potentially_unsafe", "unknown")


def fold(log: DataFrame, key: str = "site_id") -> DataFrame:
    """One summary row per key of a log (scan_ref, scanned_at, verdict, score, stage): partial aggregates only, no in-place updates."""
    last = F.max_by(F.struct("verdict", "score", "scan_ref"), F.struct("scanned_at", "scan_ref")).alias("l")
    counts = [F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in VERDICTS]
    out = log.groupBy(key).agg(F.count(F.lit(1)).alias("scan_count"), *counts, F.min("scanned_at").alias("first_scanned_at"), F.max("scanned_at").alias("last_scanned_at"), F.bool_or(F.col("verdict") == "malicious").alias("ever_malicious"), last)
    out = out.select(*[c for c in out.columns if c != "l"], F.col("l.verdict").alias("last_verdict"), F.col("l.score").alias("last_score"), F.col("l.scan_ref").alias("last_scan_ref"))
    return out.withColumn("effective_verdict", effective_verdict(F.col("ever_malicious"), F.col("last_verdict")))


def prior_message(s: DataFrame) -> Column:
    """What a caller is told about earlier scans."""
    # The sentences callers see.
    words = F.create_map(*[F.lit(x) for v in VERDICTS for x in (v, {"unknown": "inconclusive"}.get(v, v.replace("_", " ")))])
    counts = tally({{"unknown": "inconclusive"}.get(v, v.replace("_", " ")): F.col(f"{v}_count") for v in VERDICTS})
    first = F.concat(F.lit("This address was already scanned "), F.col("scan_count").cast("string"), F.lit("x, most recently on "), F.date_format("last_scanned_at", "yyyy-MM-dd HH:mm"), F.lit(" UTC, and was rated "), words[F.col("effective_verdict")], F.lit("."))
    sticky = F.when(F.col("ever_malicious") & (F.col("last_verdict") == "safe"), "An earlier scan found it malicious, so it stays potentially unsafe even though the latest scan was clean.")
    return F.concat_ws(" ", first, F.when(counts != "", F.concat(F.lit("Across those scans: "), counts, F.lit("."))), sticky, F.lit("Rescan to check it again."))


def reusable(df: DataFrame, raw: str = "raw_response_json") -> Column:
    """Whether a stored row may be replayed: complete and valid JSON, else the plain columns."""
    from ..functions.guards import is_file_link

    j = F.from_json(F.col(raw), "classification string, error_code string, page struct<status string, final_url string>")
    whole = j["classification"].isNotNull() & (j["classification"] != "unavailable") & (F.coalesce(j["error_code"], F.lit("")) == "") & (F.coalesce(j["page"]["status"], F.lit("")) != "unavailable") & ~F.coalesce(is_file_link(j["page"]["final_url"]), F.lit(False))
    plain = F.col("last_classification").isin("benign", "phishing", "malware") & (F.col("last_verdict") != "unknown") & (F.col("last_decision_stage") != "error")
    return F.coalesce(F.when(F.coalesce(F.col(raw), F.lit("")) != "", whole).otherwise(plain), F.lit(False))


def latest_scan(sites: DataFrame, log: DataFrame, key: str = "site_id") -> DataFrame:
    """sites with their newest scan that was not served from the archive."""
    fresh = log.where("not served_from_history").groupBy(key).agg(F.max_by(F.struct("scan_ref", "verdict", "score"), F.struct("scanned_at", "scan_ref")).alias("fresh"))
    return sites.join(fresh, key, "left")


def host_approvals(sites: DataFrame) -> DataFrame:
    """The newest approval of each exact host."""
    return sites.where("approved_at is not null").groupBy("host").agg(F.max_by(F.struct("approved_at", "approved_by", "url"), F.struct("approved_at", "url")).alias("approval"))


def apply_reviews(sites: DataFrame, decisions: DataFrame) -> DataFrame:
    """sites (url, host) with approval after a log of decisions (seq, url, host, decision, reviewer, at).

    Approving sets the address; rejecting clears every address of the host. The last decision per address after the host's last rejection holds.
    """
    cleared = decisions.where("decision = 'reject'").groupBy("host").agg(F.max("seq").alias("_cleared"))
    approved = latest(decisions.where("decision = 'approve'"), "url", "seq").select("url", F.col("seq").alias("_seq"), F.col("at").alias("_at"), F.col("reviewer").alias("_by"))
    both = sites.join(approved, "url", "left").join(cleared, "host", "left")
    holds = F.col("_seq") > F.coalesce("_cleared", F.lit(-1))
    return both.withColumn("approved_at", F.when(holds, F.col("_at"))).withColumn("approved_by", F.when(holds, F.col("_by"))).drop("_seq", "_at", "_by", "_cleared")


def review_outcome(reports: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviewed, missing) of a batch of report ids."""
    return ids.join(reports, "report_id", "left_semi"), ids.join(reports, "report_id", "left_anti")


def review_queue(reports: DataFrame, sites: DataFrame, status: str = "new", limit: int = 50) -> DataFrame:
    """One row per address from the newest limit * 10 reports (report_id, url, client, reason, review_status, created_at).

    The cut comes before the grouping and the status filter after it, as reviewers see it; a busy address can hide older ones.
    """
    newest = reports.orderBy(F.desc("created_at"), F.desc("report_id")).limit(max(limit, 1) * 10)
    approvals = host_approvals(sites).select("host", F.col("approval.approved_at").alias("host_approved_at"))
    joined = newest.join(sites.select("url", "host", "effective_verdict"), "url", "left").join(approvals, "host", "left")
    rows = F.sort_array(F.collect_list(F.struct("created_at", "report_id", "client", "review_status")), asc=False)
    g = joined.groupBy("url").agg(rows.alias("r"), F.max("host").alias("host"), F.max("effective_verdict").alias("effective_verdict"), F.max("host_approved_at").alias("approved_at"))
    state = F.when(F.exists("r", lambda x: x.review_status == "new"), "new").when(F.col("approved_at").isNotNull(), "approved").otherwise("rejected")
    g = g.select("url", "host", "effective_verdict", F.transform("r", lambda x: x.report_id).alias("report_ids"), F.size("r").cast("long").alias("report_count"),
                 F.size(F.array_distinct(F.filter(F.transform("r", lambda x: x.client), lambda c: F.coalesce(c, F.lit("")) != ""))).cast("long").alias("clients"), F.col("r")[0]["created_at"].alias("last_reported_at"), F.element_at("r", -1)["created_at"].alias("first_reported_at"), state.alias("status"))
    if status in ("new", "approved", "rejected"):
        g = g.where(F.col("status") == status)
    return g.orderBy(F.desc("last_reported_at"), "url").limit(limit)


def with_scan(reports: DataFrame, log: DataFrame) -> DataFrame:
    """reports (scan_ref) with the verdict and score of the scan they were made on; nulls where it is not kept. Repeated refs: the newest scan."""
    scan = log.groupBy(F.col("scan_ref").alias("_ref")).agg(F.max_by(F.struct("verdict", "score"), F.struct("scanned_at", "verdict")).alias("scan"))
    return reports.join(scan, F.col("scan_ref") == F.col("_ref"), "left").drop("_ref")
