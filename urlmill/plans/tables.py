"""Queries over documents, labels and events: profiling, sampling, evaluation, archive and time-bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import archive, corpus, evaluation, intel, profile, state
from .common import rounded, table

VERDICT = "CASE event_type WHEN 'error' THEN 'malicious' WHEN 'purchase' THEN 'safe' WHEN 'click' THEN 'potentially_unsafe' WHEN 'view' THEN 'safe' ELSE 'unknown' END"


def _labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


def _scored(spark, sf) -> DataFrame:
    """doc_id, label, score, n_chars: quality against a made-up score in steps of 0.01."""
    return _labelled(spark, sf).select("doc_id", F.col("quality").alias("label"), (F.pmod(F.col("n_chars") * 7 + F.col("quality") * 23, F.lit(100)) / F.lit(100.0)).alias("score"), "n_chars", "lang")


_S = "s AS (SELECT doc_id, quality AS label, ((n_chars * 7 + quality * 23) % 100) / 100.0::DOUBLE AS score, n_chars, lang FROM documents JOIN labels USING (doc_id))"
_B = f"{_S}, b AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score), c AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM b)"


def _log(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("site_id"), F.format_string("%012d", "event_id").alias("scan_ref"), F.col("ts").alias("scanned_at"), F.expr(VERDICT).alias("verdict"), F.round(F.col("value") / 500, 4).alias("score"), (F.col("event_id") % 4 == 0).alias("served_from_history"))


_LOG = f"g AS (SELECT user_id AS site_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS scan_ref, ts AS scanned_at, {VERDICT} AS verdict, round(value / 500, 4) AS score, event_id % 4 = 0 AS sfh FROM events)"
_FOLD = f"""{_LOG}, f AS (SELECT site_id, count(*) AS scan_count, count(*) FILTER (verdict = 'malicious') AS malicious_count, count(*) FILTER (verdict = 'safe') AS safe_count, count(*) FILTER (verdict = 'potentially_unsafe') AS potentially_unsafe_count,
  count(*) FILTER (verdict = 'unknown') AS unknown_count, min(scanned_at) AS first_scanned_at, max(scanned_at) AS last_scanned_at, bool_or(verdict = 'malicious') AS ever_malicious FROM g GROUP BY 1),
l AS (SELECT site_id, verdict AS last_verdict, score AS last_score, scan_ref AS last_scan_ref FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY scanned_at DESC, scan_ref DESC) AS n FROM g) WHERE n = 1),
z AS (SELECT *, CASE WHEN ever_malicious AND last_verdict = 'safe' THEN 'potentially_unsafe' ELSE last_verdict END AS effective_verdict FROM f JOIN l USING (site_id))"""


def archive_fold(spark, sf):
    return archive.fold(_log(spark, sf)).drop("first_scanned_at", "last_scanned_at")


SQL_FOLD = f"WITH {_FOLD} SELECT * EXCLUDE (first_scanned_at, last_scanned_at) FROM z"


def prior_message(spark, sf):
    f = archive.fold(_log(spark, sf))
    return f.select("site_id", archive.prior_message(f).alias("message"))


SQL_PRIOR = f"""WITH {_FOLD} SELECT site_id, 'This address was already scanned ' || scan_count || 'x, most recently on ' || strftime(last_scanned_at, '%Y-%m-%d %H:%M') || ' UTC, and was rated ' || CASE effective_verdict WHEN 'unknown' THEN 'inconclusive' ELSE replace(effective_verdict, '_', ' ') END || '.'
  || CASE WHEN scan_count > 0 THEN ' Across those scans: ' || array_to_string(list_filter([CASE WHEN malicious_count > 0 THEN malicious_count || 'x malicious' END, CASE WHEN safe_count > 0 THEN safe_count || 'x safe' END,
    CASE WHEN potentially_unsafe_count > 0 THEN potentially_unsafe_count || 'x potentially unsafe' END, CASE WHEN unknown_count > 0 THEN unknown_count || 'x inconclusive' END], lambda x: x IS NOT NULL), ', ') || '.' ELSE '' END
  || CASE WHEN ever_malicious AND last_verdict = 'safe' THEN ' An earlier scan found it malicious, so it stays potentially unsafe even though the latest scan was clean.' ELSE '' END || ' Rescan to check it again.' AS message FROM z"""


def latest_scan(spark, sf):
    log = _log(spark, sf)
    return archive.latest_scan(log.select("site_id").distinct(), log).select("site_id", "fresh.scan_ref", "fresh.verdict", "fresh.score")


SQL_LATEST = f"WITH {_LOG} SELECT site_id, scan_ref, verdict, score FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY scanned_at DESC, scan_ref DESC) AS n FROM g WHERE NOT sfh) WHERE n = 1"


def _sites(spark, sf) -> DataFrame:
    f = archive.fold(_log(spark, sf))
    return f.select(F.concat(F.lit("u"), F.col("site_id").cast("string")).alias("url"), F.concat(F.lit("h"), (F.col("site_id") % 40).cast("string")).alias("host"), "effective_verdict",
                    F.when(F.col("site_id") % 9 == 0, F.col("last_scanned_at")).alias("approved_at"), F.lit("admin").alias("approved_by"))


def _reports(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("report_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("client"), F.when(F.col("event_id") % 5 == 0, "new").otherwise("done").alias("review_status"), F.col("ts").alias("created_at"))


def report_queue(spark, sf):
    q = archive.review_queue(_reports(spark, sf), _sites(spark, sf), "new", 50)
    return q.select("url", "host", "effective_verdict", "report_count", "clients", F.element_at("report_ids", 1).alias("newest_report"), "status")


SQL_QUEUE = f"""WITH {_FOLD}, st AS (SELECT 'u' || site_id AS url, 'h' || (site_id % 40) AS host, effective_verdict, CASE WHEN site_id % 9 = 0 THEN last_scanned_at END AS approved_at FROM z),
r AS (SELECT event_id AS report_id, 'u' || user_id AS url, 'c' || (event_id % 3) AS client, CASE WHEN event_id % 5 = 0 THEN 'new' ELSE 'done' END AS rs, ts AS created_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500),
q AS (SELECT r.url, max(st.host) AS host, max(effective_verdict) AS effective_verdict, count(*) AS report_count, count(DISTINCT client) AS clients, arg_max(report_id, created_at) AS newest_report, max(created_at) AS last_at, bool_or(rs = 'new') AS has_new FROM r LEFT JOIN st ON st.url = r.url GROUP BY r.url)
SELECT url, host, effective_verdict, report_count, clients, newest_report, 'new' AS status FROM q WHERE has_new ORDER BY last_at DESC, url LIMIT 50"""


def host_approvals(spark, sf):
    return archive.host_approvals(_sites(spark, sf)).select("host", "approval.url")


SQL_APPROVALS = f"WITH {_FOLD}, st AS (SELECT 'u' || site_id AS url, 'h' || (site_id % 40) AS host, last_scanned_at AS approved_at FROM z WHERE site_id % 9 = 0) SELECT host, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY approved_at DESC, url DESC) AS n FROM st) WHERE n = 1"


def _seconds(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"))


def ttl_cache_hits(spark, sf):
    return state.ttl_cache(_seconds(spark, sf), 86_400, "user_id")


def dual_ttl_cache(spark, sf):
    return state.ttl_cache(_seconds(spark, sf), F.when(F.col("event_type") == "error", 864_000).otherwise(90_000), "user_id", strict=False)


def _ttl_sql(ttl: str, op: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS "at", {ttl} AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000000), {ttl}) AS n FROM events),
r AS (SELECT user_id, n, e."at" AS w, ttl AS l, 0 AS hit FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.n, CASE WHEN e."at" - r.w {op} r.l THEN r.w ELSE e."at" END, CASE WHEN e."at" - r.w {op} r.l THEN r.l ELSE e.ttl END, CASE WHEN e."at" - r.w {op} r.l THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, count(*) AS lookups, CAST(sum(hit) AS BIGINT) AS hits, CAST(count(*) - sum(hit) AS BIGINT) AS loads FROM r GROUP BY 1"""


def failures_in_window(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return state.failures_in_window(e, 86_400, "user_id", "ts").select("event_id", "in_window")


SQL_FAILURES = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events WHERE event_type = 'error'"


def rate_limit_fold(spark, sf):
    e = _seconds(spark, sf).where("event_type in ('error', 'purchase')").select("user_id", "at", (F.col("event_type") == "purchase").alias("ok"))
    return state.rate_limit(e, 5, 864_000, "user_id", "at")


SQL_RATE_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, event_type = 'purchase' AS good FROM events WHERE event_type IN ('error', 'purchase')),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, good) AS n FROM e),
f AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS w, 0::BIGINT AS refused, 0::BIGINT AS failures FROM o WHERE n = 1 UNION ALL
  SELECT user_id, n, CASE WHEN len(r) >= 5 THEN r WHEN good THEN [] ELSE list_append(r, t) END, refused + CASE WHEN len(r) >= 5 THEN 1 ELSE 0 END, failures + CASE WHEN len(r) < 5 AND NOT good THEN 1 ELSE 0 END
  FROM (SELECT f.user_id, o.n, o.t, o.good, f.refused, f.failures, list_filter(f.w, lambda x: o.t - x < 864000) AS r FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)),
m AS (SELECT user_id, max(n) AS n FROM o GROUP BY 1)
SELECT f.user_id, f.n AS attempts, f.refused, f.failures FROM f JOIN m USING (user_id, n)"""


def progress_latest(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.when(F.col("value") > 50, "complete").otherwise("running").alias("status"))
    return state.progress(e)


SQL_PROGRESS = """WITH g AS (SELECT user_id AS scan_id, event_type AS stage, arg_max(CASE WHEN value > 50 THEN 'complete' ELSE 'running' END, event_id) AS status, min(event_id) AS first_seq FROM events GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY first_seq) AS INT) AS position FROM g"""


def newest_entries(spark, sf):
    return state.newest(table(spark, sf, "events").select("event_id", "ts", "user_id"), 200, "ts", "event_id").select("event_id", "user_id")


SQL_NEWEST = "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 200"


def profile_missing(spark, sf):
    return profile.missing(table(spark, sf, "documents"))


SQL_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS missing FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars"))


def profile_duplicates(spark, sf):
    return profile.duplicates(table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256")), "sha256")


SQL_DUPLICATES = "SELECT count(*) AS rows, count(DISTINCT text) AS distinct_rows, count(*) - count(DISTINCT text) AS duplicates FROM documents"


def label_conflicts(spark, sf):
    d = _labelled(spark, sf).select(F.left(F.sha2("text", 256), F.lit(1)).alias("key"), "quality")
    return profile.label_conflicts(d, "key", "quality").select("key", "rows")


SQL_CONFLICTS = "SELECT left(sha256(text), 1) AS key, count(*) AS rows FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) = 2"


def nearest_rank_quantiles(spark, sf):
    return profile.quantiles(table(spark, sf, "documents"), "n_chars", "lang")


SQL_QUANTILES = """WITH o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), p AS (SELECT unnest([0.0, 0.5, 0.9, 0.95, 0.99, 1.0]::DOUBLE[]) AS p)
SELECT lang, p, n_chars AS value FROM o JOIN p ON i = round_even((n - 1) * p, 0)"""


def pearson_vector(spark, sf):
    d = _labelled(spark, sf).select("quality", F.col("n_chars").alias("chars"), F.length("lang").alias("lang_length"), F.length("source").alias("source_length"), "toxic")
    c = profile.correlations(d, "quality", "chars", "lang_length", "source_length", "toxic")
    return c.select("column", "n", rounded("mean", 6).alias("mean"), rounded("r", 6).alias("r"))


SQL_PEARSON = "WITH d AS (SELECT quality, n_chars AS chars, length(lang) AS lang_length, length(source) AS source_length, toxic FROM documents JOIN labels USING (doc_id)) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, CASE WHEN stddev_pop({c}) > 0 THEN round(corr({c}, quality), 6) END AS r FROM d" for c in ("chars", "lang_length", "source_length", "toxic")
)


def pattern_by_class(spark, sf):
    t = F.col("text")
    return profile.pattern_table(_labelled(spark, sf), "quality", {"has_digit": t.rlike("[0-9]"), "has_line_break": t.contains("\n"), "long": F.col("n_chars") > 1000})


SQL_PATTERN = "WITH d AS (SELECT quality, regexp_matches(text, '[0-9]') AS has_digit, contains(text, chr(10)) AS has_line_break, n_chars > 1000 AS long FROM documents JOIN labels USING (doc_id)) " + " UNION ALL ".join(
    f"SELECT '{k}' AS pattern, quality, count(*) FILTER ({k}) AS n, round(100.0::DOUBLE * count(*) FILTER ({k}) / count(*), 3) AS percent FROM d GROUP BY quality" for k in ("has_digit", "has_line_break", "long")
)


def top_k_per_class(spark, sf):
    return profile.top_k(_labelled(spark, sf), 5, "source", "quality")


SQL_TOPK = "SELECT quality, source, n, CAST(rank AS INT) AS rank FROM (SELECT quality, source, count(*) AS n, row_number() OVER (PARTITION BY quality ORDER BY count(*) DESC, source) AS rank FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) WHERE rank <= 5"


def dedup_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return profile.dedup_first(d, "sha256", "doc_id")


SQL_DEDUP_FIRST = "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents GROUP BY 2"


def dedup_last_no_conflict(spark, sf):
    d = _labelled(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256"), "quality")
    return profile.dedup_last_no_conflict(d, "sha256", "doc_id", "quality")


SQL_DEDUP_LAST = "SELECT max(doc_id) AS doc_id, sha256(text) AS sha256, min(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 2 HAVING min(quality) = max(quality)"


def length_histogram(spark, sf):
    d = table(spark, sf, "documents").where("n_chars > 0")
    return profile.histogram(d, F.log10("n_chars"), 0.0, 5.0, 40)


SQL_HISTOGRAM = "SELECT CASE WHEN log10(n_chars) >= 5 THEN 41::BIGINT ELSE CAST(floor(log10(n_chars) / 5.0::DOUBLE * 40) AS BIGINT) + 1 END AS bin, count(*) AS n FROM documents WHERE n_chars > 0 GROUP BY 1"


def pivot_counts(spark, sf):
    return _labelled(spark, sf).groupBy("lang").pivot("quality", [0, 1]).count().na.fill(0).toDF("lang", "bad", "good")


SQL_PIVOT = "SELECT lang, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1"


def describe_by(spark, sf):
    d = profile.describe_by(table(spark, sf, "documents"), "n_chars", "lang")
    return d.select("lang", "n", F.round("mean", 6).alias("mean"), "median", "max")


SQL_DESCRIBE = "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, max(n_chars) AS max FROM documents GROUP BY 1"


def rolling_mean(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("v"))
    return profile.rolling_mean(d, "v", "day", 7).select("day", F.round("rolling", 6).alias("rolling"))


SQL_ROLLING = "SELECT day, round(avg(v) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, avg(value) AS v FROM events GROUP BY 1)"


def balanced_sample(spark, sf):
    return corpus.sample(_labelled(spark, sf).select("doc_id", "quality"), 25, "bal", "doc_id", "quality")


SQL_BALANCED = "SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('bal|' || doc_id), doc_id) AS n FROM labels JOIN documents USING (doc_id)) WHERE n <= 25"


def fold_assignment(spark, sf):
    return corpus.hash_split(table(spark, sf, "documents").select("doc_id", "source"), "source", "fold").select("doc_id", "fold")


SQL_FOLDS = "SELECT doc_id, CAST(CAST('0x' || substr(sha256('fold|' || source), 1, 8) AS BIGINT) % 10 AS INT) AS fold FROM documents"


def seen_hash_anti(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("group"), F.sha2("text", 256).alias("sha256"))
    return corpus.without_known(d.where("doc_id >= 200"), d.where("doc_id < 200 and group in ('src1', 'src2')")).select("doc_id")


SQL_ANTI = "SELECT doc_id FROM documents WHERE doc_id >= 200 AND source NOT IN ('src1', 'src2') AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 200 AND source IN ('src1', 'src2'))"


def confusion_at(spark, sf):
    return _rounded(evaluation.confusion(_scored(spark, sf), 0.5, "lang"))


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*[F.round(c, 6).alias(c) if t == "double" and c != "threshold" else F.col(c) for c, t in d.dtypes])


def _confusion_sql(by: str, source: str, t: str) -> str:
    return f"""c AS (SELECT {by}, count(*) AS n, count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label = 0) AS fp, count(*) FILTER (score < {t} AND label = 0) AS tn, count(*) FILTER (score < {t} AND label = 1) AS fn FROM {source} GROUP BY 1)
SELECT {by}, n, tp, fp, tn, fn, round((tp + tn) / n::DOUBLE, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1, round(CASE WHEN fp + tn = 0 THEN NULL ELSE fp / (fp + tn)::DOUBLE END, 6) AS fpr FROM c"""


SQL_CONFUSION = f"WITH {_S}, {_confusion_sql('lang', 's', '0.5::DOUBLE')}"


def threshold_sweep(spark, sf):
    return _rounded(evaluation.sweep(_scored(spark, sf)))


SQL_SWEEP = f"WITH {_S}, x AS (SELECT s.*, t AS threshold FROM s, (SELECT unnest(list_transform(range(0, 19), lambda i: round(0.05::DOUBLE + i * 0.05::DOUBLE, 2))) AS t)), {_confusion_sql('threshold', 'x', 'threshold')}"


def best_f1_threshold(spark, sf):
    return _rounded(evaluation.best_f1(_scored(spark, sf)))


SQL_BEST_F1 = f"WITH sw AS ({SQL_SWEEP}) SELECT CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS threshold, f1 FROM sw ORDER BY f1 DESC, threshold LIMIT 1"


def fpr_threshold(spark, sf):
    return _rounded(evaluation.threshold_at_fpr(_scored(spark, sf), 0.2))


SQL_FPR = f"""WITH {_B}, k AS (SELECT score, FALSE AS above, tp, fp, tp / ap::DOUBLE AS recall, fp / an::DOUBLE AS fpr FROM c UNION ALL SELECT max(score), TRUE, 0, 0, 0, 0 FROM c)
SELECT round(score, 6) AS score, above, round(recall, 6) AS recall, round(fpr, 6) AS fpr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM k WHERE fpr <= 0.2::DOUBLE ORDER BY k.recall DESC, k.fpr, above DESC, k.score DESC LIMIT 1"""


def two_cutoffs(spark, sf):
    return _rounded(evaluation.two_cutoffs(_scored(spark, sf), 0.2, 0.9))


SQL_CUTOFFS = f"""WITH {_B}, k AS (SELECT score, tp / ap::DOUBLE AS caught, fp / an::DOUBLE AS flagged FROM c), bl AS (SELECT score FROM k WHERE flagged <= 0.2::DOUBLE ORDER BY caught DESC, flagged, score DESC LIMIT 1), wa AS (SELECT score FROM k WHERE caught >= 0.9::DOUBLE ORDER BY flagged, caught DESC, score DESC LIMIT 1)
SELECT round(least(wa.score, bl.score), 6) AS warn_from, round(bl.score, 6) AS block_from FROM bl, wa"""


def roc_auc(spark, sf):
    return _rounded(evaluation.roc_auc(_scored(spark, sf)))


SQL_AUC = f"WITH {_B} SELECT round(sum(p * ((an - fp) + n / 2.0::DOUBLE)) / max(ap * an), 6) AS auc FROM c"


def length_baseline_auc(spark, sf):
    return _rounded(evaluation.roc_auc(_scored(spark, sf).withColumn("score", -F.col("n_chars").cast("double"))))


SQL_LENGTH_AUC = f"""WITH {_S}, r AS (SELECT label, rank() OVER (ORDER BY -n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM s)
SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r"""


def avg_precision(spark, sf):
    return _rounded(evaluation.average_precision(_scored(spark, sf)))


SQL_AP = f"WITH {_B} SELECT round(sum(p / ap::DOUBLE * (tp / (tp + fp)::DOUBLE)), 6) AS average_precision FROM c"


def logloss_brier(spark, sf):
    return _rounded(evaluation.losses(_scored(spark, sf)))


SQL_LOSSES = f"WITH {_S} SELECT round(avg(-CASE WHEN label = 1 THEN ln(greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, score))) ELSE ln(1 - greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, score))) END), 6) AS log_loss, round(avg(pow(score - label, 2)), 6) AS brier FROM s"


def f1_argmax(spark, sf):
    return _rounded(evaluation.best_f1_cut(_scored(spark, sf)))


SQL_F1_CUT = f"WITH {_B} SELECT round(score, 6) AS score, round(2.0::DOUBLE * tp / (tp + fp + ap), 6) AS f1 FROM c ORDER BY 2.0::DOUBLE * tp / (tp + fp + ap) DESC, c.score DESC LIMIT 1"


def slice_metrics(spark, sf):
    d = _scored(spark, sf)
    return _rounded(evaluation.slices(d, {"short": F.col("n_chars") <= 2000, "long": F.col("n_chars") > 2000, "english": F.col("lang") == "en"}, 0.5))


SQL_SLICES = f"WITH {_S}, x AS (SELECT *, 'short' AS slice FROM s WHERE n_chars <= 2000 UNION ALL SELECT *, 'long' FROM s WHERE n_chars > 2000 UNION ALL SELECT *, 'english' FROM s WHERE lang = 'en'), {_confusion_sql('slice', 'x', '0.5::DOUBLE')}"


def calibration_bins(spark, sf):
    return _rounded(evaluation.calibration(_scored(spark, sf), "doc_id"))


SQL_CALIBRATION = f"WITH {_S} SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positives FROM (SELECT *, ntile(10) OVER (ORDER BY score, doc_id) AS bin FROM s) GROUP BY 1"


def temperature_grid(spark, sf):
    d = _scored(spark, sf).select("label", ((F.col("score") - 0.5) * 8).alias("logit"))
    return evaluation.temperature(d)


SQL_TEMPERATURE = f"""WITH {_S}, t AS (SELECT unnest(list_distinct(list_concat(list_transform(range(0, 91), lambda i: round(0.5::DOUBLE + i * 0.05::DOUBLE, 4)), [1.0::DOUBLE]))) AS t),
x AS (SELECT t, avg(ln(1 + exp(-(score - 0.5::DOUBLE) * 8 / t * CASE WHEN label = 1 THEN 1 ELSE -1 END))) AS nll FROM s, t GROUP BY t)
SELECT CASE WHEN nll < (SELECT nll FROM x WHERE t = 1) THEN t ELSE 1.0 END AS temperature FROM x ORDER BY nll, t LIMIT 1"""


def early_stop(spark, sf):
    d = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg("value"), 4).alias("loss"))
    return evaluation.early_stop(d, 5).select("epoch", "best", "stale", "stopped")


SQL_EARLY = """WITH d AS (SELECT CAST(day(ts) AS INT) AS epoch, round(avg(value), 4) AS loss FROM events GROUP BY 1), b AS (SELECT *, min(loss) OVER (ORDER BY epoch) AS best, min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
s AS (SELECT *, epoch - max(CASE WHEN before IS NULL OR loss < before THEN epoch END) OVER (ORDER BY epoch) AS stale FROM b)
SELECT epoch, best, stale, bool_or(stale >= 5) OVER (ORDER BY epoch) AS stopped FROM s"""


def error_audit(spark, sf):
    return evaluation.errors(_scored(spark, sf).withColumnRenamed("doc_id", "id"), 0.5).select("id", "kind", F.col("rank").cast("long").alias("rank"))


SQL_ERRORS = f"""WITH {_S}, e AS (SELECT *, CASE WHEN label = 0 AND score >= 0.5::DOUBLE THEN 'fp' WHEN label = 1 AND score < 0.5::DOUBLE THEN 'fn' END AS kind FROM s)
SELECT id, kind, rank FROM (SELECT doc_id AS id, kind, row_number() OVER (PARTITION BY kind ORDER BY abs(score - 0.5::DOUBLE) DESC, doc_id) AS rank FROM e WHERE kind IS NOT NULL) WHERE rank <= 10"""


def latest_per_user(spark, sf):
    return intel.latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


SQL_LATEST_USER = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def manifest_difference(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return corpus.manifest_difference(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 <> 1"))


SQL_MANIFEST = "WITH a AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE doc_id % 3 <> 1) SELECT count(*) FILTER (b.s IS NULL) AS only_a, count(*) FILTER (a.s IS NULL) AS only_b, count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS \"both\" FROM a FULL JOIN b ON a.s = b.s"

_ALL = {
    archive_fold: SQL_FOLD, prior_message: SQL_PRIOR, latest_scan: SQL_LATEST, report_queue: SQL_QUEUE, host_approvals: SQL_APPROVALS, ttl_cache_hits: _ttl_sql("86400", "<="), dual_ttl_cache: _ttl_sql("CASE WHEN event_type = 'error' THEN 864000 ELSE 90000 END", "<"),
    failures_in_window: SQL_FAILURES, rate_limit_fold: SQL_RATE_LIMIT, progress_latest: SQL_PROGRESS, newest_entries: SQL_NEWEST, profile_missing: SQL_MISSING, profile_duplicates: SQL_DUPLICATES, label_conflicts: SQL_CONFLICTS, nearest_rank_quantiles: SQL_QUANTILES,
    pearson_vector: SQL_PEARSON, pattern_by_class: SQL_PATTERN, top_k_per_class: SQL_TOPK, dedup_first: SQL_DEDUP_FIRST, dedup_last_no_conflict: SQL_DEDUP_LAST, length_histogram: SQL_HISTOGRAM, pivot_counts: SQL_PIVOT, describe_by: SQL_DESCRIBE, rolling_mean: SQL_ROLLING,
    balanced_sample: SQL_BALANCED, fold_assignment: SQL_FOLDS, seen_hash_anti: SQL_ANTI, confusion_at: SQL_CONFUSION, threshold_sweep: SQL_SWEEP, best_f1_threshold: SQL_BEST_F1, fpr_threshold: SQL_FPR, two_cutoffs: SQL_CUTOFFS, roc_auc: SQL_AUC,
    length_baseline_auc: SQL_LENGTH_AUC, avg_precision: SQL_AP, logloss_brier: SQL_LOSSES, f1_argmax: SQL_F1_CUT, slice_metrics: SQL_SLICES, calibration_bins: SQL_CALIBRATION, temperature_grid: SQL_TEMPERATURE, early_stop: SQL_EARLY, error_audit: SQL_ERRORS,
    latest_per_user: SQL_LATEST_USER, manifest_difference: SQL_MANIFEST,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: s for f, s in _ALL.items() if s}
