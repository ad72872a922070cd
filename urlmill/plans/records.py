"""Queries over source inspection, folds, cuts, stores and parsers of records, with SQL that states each rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, guards, pages, partial_json
from ..operators import corpus, evaluation, folds, inspect, lookup, state
from ..sources import blobs
from .checks import _AT
from .common import parts_sql, table
from .tables import _S, _log, _rounded, _scored, _seconds
from .urls import SQL_TRAIN_REJECT, all_urls


def source_inspection(spark, sf):
    """Page and literal URLs, every third one twice, with labels of all kinds."""
    d = all_urls(spark, sf).withColumn("url", F.explode(F.when(F.col("page_id") % 3 == 0, F.array("url", F.concat(F.lit(" "), "url"))).otherwise(F.array("url"))))
    i = F.pmod("page_id", F.lit(7))
    label = F.when(i == 0, "maybe").when(i == 1, " 1 ").when(i == 2, "").when(i != 3, F.pmod("page_id", F.lit(2)).cast("string"))
    return inspect.inspect_source(d.select("url", label.alias("label")), "url", "label")


_HEAD = SQL_TRAIN_REJECT.rsplit("SELECT page_id", 1)[0].rstrip()
SQL_INSPECTION = f"""{_HEAD},
k AS (SELECT *, (page_id % 7 + 7) % 7 AS i FROM src), l AS (SELECT page_id, url, CASE WHEN i = 0 THEN 'maybe' WHEN i = 1 THEN ' 1 ' WHEN i = 2 THEN '' WHEN i <> 3 THEN CAST((page_id % 2 + 2) % 2 AS VARCHAR) END AS label FROM k),
a AS (SELECT * FROM l UNION ALL SELECT page_id, ' ' || url, label FROM l WHERE page_id % 3 = 0), b AS (SELECT a.*, trim(coalesce(label, '')) AS y FROM a),
c AS (SELECT b.page_id, CAST(y AS INT) AS y, e.t, e.reason, contains(e.authority, '@') AS cred, CASE WHEN reason IS NULL THEN e.scheme || '://' || CASE WHEN contains(hh, ':') THEN '[' || hh || ']' ELSE hh END || CASE WHEN port_text = '' OR TRY_CAST(port_text AS INT) = 0 OR (e.scheme = 'http' AND TRY_CAST(port_text AS INT) = 80) OR (e.scheme = 'https' AND TRY_CAST(port_text AS INT) = 443) THEN '' ELSE ':' || CAST(port_text AS INT) END
  || CASE WHEN e.path = '' THEN '/' ELSE e.path END || CASE WHEN e.query <> '' THEN '?' || e.query ELSE '' END || CASE WHEN e.fragment <> '' THEN '#' || e.fragment ELSE '' END END AS v FROM b JOIN e USING (page_id) WHERE y IN ('0', '1')),
n AS (SELECT v, count(*) AS k, count(DISTINCT y) AS m FROM c WHERE v IS NOT NULL GROUP BY 1)
SELECT 'rows' AS measure, '' AS value, count(*) AS rows FROM b UNION ALL SELECT 'labelled', '', count(*) FROM c UNION ALL SELECT 'valid', '', count(v) FROM c UNION ALL SELECT 'changed', '', count(*) FILTER (v <> t) FROM c UNION ALL SELECT 'credentials_stripped', '', count(*) FILTER (v IS NOT NULL AND cred) FROM c
UNION ALL SELECT 'normalized_urls', '', count(*) FROM n UNION ALL SELECT 'normalized_repeats', '', CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM n UNION ALL SELECT 'conflicts', '', count(*) FILTER (m = 2) FROM n UNION ALL SELECT 'conflict_rows', '', CAST(coalesce(sum(k) FILTER (m = 2), 0) AS BIGINT) FROM n
UNION ALL SELECT 'exact_urls', '', count(DISTINCT t) FROM c UNION ALL SELECT 'exact_repeats', '', count(*) - count(DISTINCT t) FROM c UNION ALL SELECT 'label', CAST(y AS VARCHAR), count(*) FROM c GROUP BY y
UNION ALL SELECT 'invalid_label', CASE WHEN y = '' THEN '<empty>' ELSE y END, count(*) FROM b WHERE y NOT IN ('0', '1') GROUP BY y UNION ALL SELECT * FROM (SELECT 'missing', 'label', count(*) FILTER (coalesce(label, '') = '') AS n FROM b UNION ALL SELECT 'missing', 'url', count(*) FILTER (coalesce(url, '') = '') FROM b) WHERE n > 0
UNION ALL SELECT 'rejected', reason, count(*) FROM c WHERE reason IS NOT NULL GROUP BY reason"""


def _visits(spark, sf):
    """Events as rows of users, which are groups; a purchase is label 1."""
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("host"), (F.col("event_type") == "purchase").cast("int").alias("label_id"))


def stratified_folds(spark, sf):
    return folds.group_folds(_visits(spark, sf), "host", "label_id", "fold", 10)


def _fold_sql(rows: str, seed: str, parts: int) -> str:
    return f"""SELECT host, n AS rows, CAST((row_number() OVER (ORDER BY length(bin(n)) DESC, 10 * p // n, sha256('{seed}|' || host), host) - 1) % {parts} AS INT) AS fold
  FROM (SELECT host, count(*) AS n, CAST(sum(label_id) AS BIGINT) AS p FROM {rows} GROUP BY 1)"""


_V = "v AS (SELECT event_id, user_id AS host, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label_id FROM events)"
SQL_FOLDS = f"WITH {_V} {_fold_sql('v', 'fold', 10)}"


def three_way_split(spark, sf):
    d = folds.three_way(_visits(spark, sf), "host", "label_id", "ways")
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("host").alias("hosts"), F.sum("event_id").alias("ids"), F.round(F.avg("label_id"), 6).alias("positives"))


SQL_THREE_WAY = f"""WITH {_V}, o AS ({_fold_sql("v", "ways", 10)}), r AS (SELECT * FROM v WHERE host IN (SELECT host FROM o WHERE fold > 0)), i AS ({_fold_sql("r", "ways|inner", 9)}),
s AS (SELECT v.*, CASE WHEN o.fold = 0 THEN 'test' WHEN i.fold = 0 THEN 'validation' ELSE 'train' END AS split FROM v JOIN o USING (host) LEFT JOIN i USING (host))
SELECT split, count(*) AS rows, count(DISTINCT host) AS hosts, CAST(sum(event_id) AS BIGINT) AS ids, round(avg(label_id), 6) AS positives FROM s GROUP BY 1"""


def host_isolation(spark, sf):
    """Hosts of test rows against those of two other splits, and a share of whole hosts."""
    d = _visits(spark, sf)
    unseen, seen = folds.unseen_and_seen(d.where("event_id % 4 = 0"), "host", d.where("event_id % 4 = 1 and label_id = 1"), d.where("event_id % 4 = 2 and label_id = 1"))
    calibration, final = folds.by_share(d, "host", 0.4, "share")
    parts = {"unseen": unseen, "seen": seen, "calibration": calibration, "final": final}
    counted = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("rows"), F.countDistinct("host").alias("hosts")) for n, p in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


SQL_ISOLATION = f"""WITH {_V}, k AS (SELECT DISTINCT host FROM v WHERE event_id % 4 IN (1, 2) AND label_id = 1), t AS (SELECT CASE WHEN host IN (SELECT host FROM k) THEN 'seen' ELSE 'unseen' END AS part, host FROM v WHERE event_id % 4 = 0),
f AS (SELECT CASE WHEN CAST('0x' || sha256('share|' || host)[1:8] AS BIGINT) % 1000 < 400 THEN 'calibration' ELSE 'final' END AS part, host FROM v), a AS (SELECT * FROM t UNION ALL SELECT * FROM f)
SELECT p.part, count(host) AS rows, count(DISTINCT host) AS hosts FROM (VALUES ('seen'), ('unseen'), ('calibration'), ('final')) p(part) LEFT JOIN a USING (part) GROUP BY 1"""


def split_report(spark, sf):
    d = _visits(spark, sf).select("label_id", "host", F.when(F.col("host") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("event_id") % 3).alias("shard"))
    return corpus.split_report(d, 100).withColumn("shards", F.array_join(F.col("shards").cast("array<string>"), ","))


SQL_SPLIT_REPORT = f"""WITH {_V} SELECT CASE WHEN host % 5 = 0 THEN 'test' ELSE 'train' END AS split, label_id, count(*) AS actual, count(DISTINCT host) AS hosts, array_to_string(list_sort(list(DISTINCT event_id % 3)), ',') AS shards, CAST(100 AS BIGINT) AS target, count(*) < 100 AS short FROM v GROUP BY 1, 2"""


def group_values(spark, sf):
    """The hash of a user, worked out once per user, and the rows and labels of the user's record."""
    d = folds.mapped(_visits(spark, sf).withColumn("host", F.col("host").cast("string")), "host", "group", lambda h: F.sha2(h, 256))
    return folds.record_lookup(d, "group", "label_id").select("event_id", F.left("group", F.lit(12)).alias("group"), "key_rows", "label_mask")


SQL_GROUP_VALUES = f"""WITH {_V} SELECT event_id, sha256(CAST(host AS VARCHAR))[1:12] AS "group", count(*) OVER (PARTITION BY host) AS key_rows, CAST(CASE WHEN min(label_id) OVER (PARTITION BY host) = 0 THEN 1 ELSE 0 END + CASE WHEN max(label_id) OVER (PARTITION BY host) = 1 THEN 2 ELSE 0 END AS INT) AS label_mask FROM v"""


def host_groups(spark, sf):
    d = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.lit("")).when(F.col("page_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("h"), F.col("page_id") % 9)).alias("host"), F.sha2("html", 256).alias("sha"))
    return d.select("page_id", corpus.host_group(F.col("host"), F.col("sha")).alias("group"))


SQL_HOST_GROUPS = """SELECT page_id, CASE WHEN page_id % 4 > 1 THEN 'host:h' || page_id % 9 ELSE 'hash:' || sha256(html) END AS "group" FROM pages"""


def curve_thresholds(spark, sf):
    """Cuts for several budgets, the first of which none keeps to."""
    s = _scored(spark, sf)
    out = [evaluation.threshold_on_curve(s, t).withColumn("target", F.lit(t)) for t in (-0.1, 0.02, 0.3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


SQL_CURVE = f"""WITH {_S}, t AS (SELECT unnest([-0.1, 0.02, 0.3])::DOUBLE AS target), r AS (SELECT score, (SELECT sum(label) FROM s b WHERE b.score >= a.score) AS tp, (SELECT count(*) FROM s b WHERE b.score >= a.score AND label = 0) / (SELECT count(*) FROM s WHERE label = 0)::DOUBLE AS fpr FROM (SELECT DISTINCT score FROM s) a),
m AS (SELECT target, score, row_number() OVER (PARTITION BY target ORDER BY tp DESC, score DESC) AS n FROM r JOIN t ON fpr <= target)
SELECT target, coalesce(score, 1.0::DOUBLE) AS threshold, score IS NULL AS fell_back FROM t LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (target)"""


def balanced_accuracies(spark, sf):
    return _rounded(evaluation.balanced_accuracy(_scored(spark, sf), 0.5, "lang"))


SQL_BALANCED = f"WITH {_S} SELECT lang, round((coalesce(avg(CASE WHEN score >= 0.5::DOUBLE THEN 1 ELSE 0 END) FILTER (label = 1), 0) + coalesce(avg(CASE WHEN score < 0.5::DOUBLE THEN 1 ELSE 0 END) FILTER (label = 0), 0)) / 2, 6) AS balanced_accuracy FROM s GROUP BY 1"


def control_gap(spark, sf):
    h = _scored(spark, sf).select((F.col("doc_id") % 2 == 0).alias("shuffled"), F.col("doc_id").alias("epoch"), F.when(F.col("doc_id") % 2 == 0, F.col("score") / 2).otherwise(F.col("score")).alias("f1"))
    return _rounded(evaluation.control_gap(h))


SQL_GAP = f"WITH {_S}, m AS (SELECT max(score) FILTER (doc_id % 2 <> 0) AS r, max(score / 2) FILTER (doc_id % 2 = 0) AS c FROM s) SELECT round(r, 6) AS real_best, round(c, 6) AS control_best, round(r - c, 6) AS gap, r - c > 0.15::DOUBLE AS valid FROM m"


def newest_blobs(spark, sf):
    """Pages as blobs of 50 keys, the newest by number; every other one starts as a screenshot does."""
    content = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit(b"\xff\xd8\xff")).otherwise(F.lit(b"\x89PN")), F.col("html").cast("binary"))
    d = table(spark, sf, "pages").select((F.col("page_id") % 50).alias("key"), F.col("page_id").alias("at"), content.alias("content"))
    return blobs.newest(d).select("key", "at", F.octet_length("content").cast("long").alias("size"), guards.is_screenshot(F.col("content")).alias("shown"))


SQL_BLOBS = """WITH m AS (SELECT page_id % 50 AS key, max(page_id) AS last FROM pages GROUP BY 1) SELECT key, page_id AS "at", strlen(html) + 3 AS size, page_id % 2 = 0 AND strlen(html) + 3 <= 600000 AS shown FROM m JOIN pages ON page_id = last"""


def two_level_cache(spark, sf):
    """Clicks look up what views wrote: the shared store keeps those of even users for an hour, the local one all for a day."""
    e = _seconds(spark, sf)
    entries = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("key"), F.col("at").alias("fetched_at")).agg(F.max("event_id").alias("payload"))
    shared, local = state.written_through(entries, F.col("key") % 2 == 0, 3_600, 86_400)
    asked = e.where("event_type = 'click'").select("event_id", F.col("user_id").alias("key"), "at")
    return state.cache_two_level(asked, shared, local).select("event_id", "payload", "level")


SQL_TWO_LEVEL = f"""WITH e AS (SELECT event_id, user_id, event_type, {_AT} AS t FROM events), v AS (SELECT user_id, t, max(event_id) AS p FROM e WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'),
j AS (SELECT c.event_id, arg_max(v.p, v.t) AS p, arg_max(v.p, v.t) FILTER (v.user_id % 2 = 0 AND c.t < v.t + 3600) AS s FROM c LEFT JOIN v ON v.user_id = c.user_id AND v.t <= c.t AND c.t < v.t + 86400 GROUP BY 1)
SELECT event_id, coalesce(s, p) AS payload, CASE WHEN s IS NOT NULL THEN 'shared' WHEN p IS NOT NULL THEN 'local' END AS level FROM j"""


def live_entries(spark, sf):
    e = _seconds(spark, sf).select(F.col("at").alias("fetched_at"), (F.col("at") + F.col("event_id") % 30 * 86_400).alias("expires_at"))
    return state.alive(e, 1_705_276_800)


SQL_LIVE = f"WITH e AS (SELECT {_AT} AS t, event_id FROM events) SELECT count(*) AS entries, count(*) FILTER (t <= 1705276800 AND t + event_id % 30 * 86400 > 1705276800) AS alive FROM e"


def client_cache(spark, sf):
    """Users are browsers that hold three hosts for ten days; a view writes, an error fails, others look up."""
    e = _seconds(spark, sf).groupBy(F.col("user_id").alias("client"), "at").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
    d = e.select("client", "at", F.concat(F.lit("h"), F.col("event_id") % 5).alias("host"), F.when(F.col("event_type").isin("view", "error"), "result").otherwise("lookup").alias("kind"), (F.col("event_type") == "view").alias("keep"))
    return state.bounded_cache(d, 864_000, 3)


SQL_CLIENT_CACHE = f"""WITH RECURSIVE a AS (SELECT user_id, {_AT} AS t, event_id, event_type FROM events), g AS (SELECT user_id, t, max(event_id) AS event_id, arg_max(event_type, event_id) AS k FROM a GROUP BY 1, 2),
o AS (SELECT user_id, t, 'h' || event_id % 5 AS host, k, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM g),
f AS (SELECT user_id, 0::BIGINT AS n, []::STRUCT(w BIGINT, host VARCHAR)[] AS e, 0::BIGINT AS hits FROM o WHERE n = 1 UNION ALL
 SELECT f.user_id, o.n, CASE WHEN o.k = 'view' THEN list_reverse(list_reverse(list_sort(list_append(list_filter(f.e, lambda x: x.host <> o.host), {{'w': o.t, 'host': o.host}})))[1:3]) WHEN o.k = 'error' THEN list_filter(f.e, lambda x: x.host <> o.host)
  WHEN len(list_filter(f.e, lambda x: x.host = o.host AND o.t - x.w < 864000)) > 0 THEN f.e ELSE list_filter(f.e, lambda x: x.host <> o.host) END,
  f.hits + CASE WHEN o.k NOT IN ('view', 'error') AND len(list_filter(f.e, lambda x: x.host = o.host AND o.t - x.w < 864000)) > 0 THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT f.user_id AS client, (SELECT count(*) FROM g WHERE g.user_id = f.user_id AND k NOT IN ('view', 'error')) AS lookups, arg_max(hits, f.n) AS hits, CAST(len(arg_max(e, f.n)) AS BIGINT) AS held FROM f GROUP BY 1"""


def event_frames(spark, sf):
    """Conversations as event streams that arrive in pieces of seven characters."""
    frame = F.concat(F.lit("event: "), "role", F.lit("\ndata: "), F.col("turn").cast("string"), F.lit("\ndata: of "), F.col("conv_id").cast("string"), F.lit("\n\n"))
    c = table(spark, sf, "conversations").where("conv_id is not null and turn is not null and role is not null").select("conv_id", "turn", "role").distinct()
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", frame.alias("f")))), lambda x: x.f), "").alias("t"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length("t") / 7).cast("int")), lambda i: F.substring(F.col("t"), (i * 7 + 1).cast("int"), F.lit(7)))
    chunks = whole.select(F.col("conv_id").alias("stream_id"), F.posexplode(cut).alias("seq", "text"))
    return state.sse_frames(chunks).select("stream_id", "n", "event", "data", "complete")


SQL_FRAMES = """WITH c AS (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL), l AS (SELECT conv_id, sum(length('event: ' || role || chr(10) || 'data: ' || turn || chr(10) || 'data: of ' || conv_id) + 2) AS n FROM c GROUP BY 1)
SELECT conv_id AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS n, role AS event, turn || chr(10) || 'of ' || conv_id AS data, l.n <= 128000 AS complete FROM c JOIN l USING (conv_id)"""


def training_logs(spark, sf):
    """Each user's events as the lines of a training log."""
    i = F.col("event_id")
    line = F.when(i % 3 == 0, F.concat(F.lit("phase=training epoch="), (i % 4).cast("string"), F.lit(" step="), (i % 50 + 1).cast("string"), F.lit("/100 loss=0."), (i % 90 + 10).cast("string"))).when(i % 3 == 1, F.concat(F.lit("validation F1: 0."), (i % 80 + 10).cast("string"))).otherwise("saving")
    log = table(spark, sf, "events").select(F.col("user_id").alias("run"), i.alias("line_no"), line.alias("line"))
    s = state.training_state(log).withColumns({"epochs": F.lit(4), "epoch_minutes": F.lit(2.0), "finished": F.col("run") % 10 == 0})
    both = state.remaining(s).join(state.epoch_scores(log), "run", "left")
    return _rounded(both.select("run", "phase", "epoch", "step", "loss", "done", "eta_minutes", F.array_join(F.transform("f1", lambda x: F.round(x * 100).cast("int").cast("string")), ",").alias("f1")))


SQL_LOGS = """WITH g AS (SELECT user_id AS run, max(event_id) FILTER (event_id % 3 = 0) AS i, string_agg(event_id % 80 + 10, ',' ORDER BY event_id) FILTER (event_id % 3 = 1) AS f1 FROM events GROUP BY 1)
SELECT run, CASE WHEN i IS NOT NULL THEN 'training' END AS phase, CAST(i % 4 AS INT) AS epoch, i % 50 + 1 AS step, (i % 90 + 10) / 100.0::DOUBLE AS loss, round((i % 50 + 1) / 100.0::DOUBLE, 6) AS done,
  CASE WHEN run % 10 <> 0 THEN round(((4 - i % 4) * 100 - (i % 50 + 1)) / ((i % 50 + 1) / 2.0::DOUBLE), 6) END AS eta_minutes, f1 FROM g"""


def cut_answers(spark, sf):
    """Turns as JSON answers that are cut off after some of their characters, within escapes too: the text is the summary, then the role and the text are reasons."""
    quoted = lambda c: F.concat(F.lit('"'), *[_escaped(c)], F.lit('"'))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.concat(F.lit('{"summary":'), quoted("text"), F.lit(',"reasons":['), quoted("role"), F.lit(","), quoted("text"), F.lit("]}"))
    n = F.pmod(F.col("conv_id") * 389 + F.coalesce("turn", F.lit(0)) * 97, F.length("whole") + 1)
    a = partial_json.partial_answer(F.left("whole", n.cast("int")))
    return c.withColumn("whole", whole).select("conv_id", "turn", a.alias("a")).select("conv_id", "turn", "a.summary", F.array_join("a.reasons", "|").alias("reasons"), F.size("a.advice").cast("long").alias("advice"))


def _escaped(c):
    """Text as in JSON: é as an escape of six characters, to be cut within."""
    out = F.col(c)
    for plain, held in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("e", "\\u0065")):
        out = F.replace(out, F.lit(plain), F.lit(held))
    return out


# Counts, for each character, where its escaped form ends.
SQL_ANSWERS_CUT = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
l AS (SELECT *, list_transform(string_split(t, ''), lambda x: CASE WHEN x = 'e' THEN 6 WHEN x IN ('"', chr(92), chr(10), chr(13), chr(9)) THEN 2 ELSE length(x) END) AS tl, list_transform(string_split(r, ''), lambda x: CASE WHEN x = 'e' THEN 6 ELSE length(x) END) AS rl FROM c),
s AS (SELECT *, coalesce(list_sum(tl), 0)::BIGINT AS nt, coalesce(list_sum(rl), 0)::BIGINT AS nr FROM l),
n AS (SELECT *, (conv_id * 389 + coalesce(turn, 0) * 97) % (33 + 2 * nt + nr) AS n FROM s),
p AS (SELECT *, n - 12 AS a, n - 26 - nt AS b, n - 29 - nt - nr AS d FROM n),
k AS (SELECT *, len(list_filter(list_transform(range(1, len(tl) + 1), lambda i: list_sum(tl[1:i])), lambda x: x <= a)) AS ka, len(list_filter(list_transform(range(1, len(rl) + 1), lambda i: list_sum(rl[1:i])), lambda x: x <= b)) AS kb,
  len(list_filter(list_transform(range(1, len(tl) + 1), lambda i: list_sum(tl[1:i])), lambda x: x <= d)) AS kd FROM p)
SELECT conv_id, turn, CASE WHEN n = 0 THEN NULL WHEN a < 0 THEN '' ELSE left(left(t, ka), 1600) END AS summary,
  CASE WHEN n = 0 THEN NULL WHEN b < 0 THEN '' WHEN d < 0 THEN left(r, kb) ELSE left(r, kb) || '|' || left(left(t, kd), 800) END AS reasons, CASE WHEN n > 0 THEN 0::BIGINT END AS advice FROM k"""


def registrations(spark, sf):
    """Registration records of page numbers."""
    i = F.col("page_id").cast("string")
    vcard = F.concat(F.lit('["vcard",[["version",{},"text","4.0"],["fn",{},"text","Registrar '), i, F.lit('"]]]'))
    who = F.concat(F.lit('{"entities":[{"roles":["abuse"],"vcardArray":[]},{"roles":["registrar"],"vcardArray":'), vcard, F.lit("}]"))
    event = F.when(F.col("page_id") % 3 > 0, F.lit(',"events":[{"eventAction":"registration","eventDate":"2020-02-03T04:05:06Z"},{"eventAction":"expiration","eventDate":"later"}]')).otherwise("")
    servers = F.array_join(F.transform(F.sequence(F.lit(0), F.col("page_id") % 20), lambda n: F.concat(F.lit('{"ldhName":"NS'), n.cast("string"), F.lit('.X.TEST"}'))), ",")
    r = pages.registration(F.concat(who, event, F.lit(',"nameservers":['), servers, F.lit("]}")))
    return table(spark, sf, "pages").select("page_id", r["registrar"].alias("registrar"), F.unix_timestamp(r["created"]).alias("created"), r["expires"].isNull().alias("open_end"), F.array_join(r["nameservers"], " ").alias("servers"))


SQL_REGISTRATIONS = """SELECT page_id, 'Registrar ' || page_id AS registrar, CASE WHEN page_id % 3 > 0 THEN 1580702706 END::BIGINT AS created, TRUE AS open_end, array_to_string(list_transform(range(0, least(page_id % 20 + 1, 12)), lambda n: 'ns' || n || '.x.test'), ' ') AS servers FROM pages"""


def request_bounds(spark, sf):
    i = F.col("page_id")
    ids = F.when(i % 5 == 0, F.array().cast("array<long>")).when(i % 5 == 1, F.array(i, F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), i % 300 + 1))
    url = F.repeat(F.lit("u"), (i % 50 * 100).cast("int"))
    reason = F.when(i % 3 > 0, F.repeat(F.lit("r"), (i % 11 * 125).cast("int")))
    shortcut = display.infer_shortcut(F.when(i % 2 == 0, "skipped").otherwise("ok"), F.when(i % 7 == 0, "kept"), F.when(i % 3 == 0, F.array(F.lit("Host is on the Tranco top-domain ranking"))).otherwise(F.array(F.lit("x"))))
    return table(spark, sf, "pages").select("page_id", guards.request_in_bounds(url, reason).alias("request"), guards.ids_in_bounds(ids).alias("batch"), shortcut.alias("shortcut"))


SQL_BOUNDS = """SELECT page_id, page_id % 50 BETWEEN 1 AND 40 AND (page_id % 3 = 0 OR page_id % 11 <= 8) AS request, page_id % 5 > 1 AND page_id % 300 < 200 AS batch,
  CASE WHEN page_id % 7 = 0 THEN 'kept' WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN 'tranco' END AS shortcut FROM pages"""


def manifest_audit(spark, sf):
    """Keys of records that a manifest does not list exactly once, and the reverse."""
    e = table(spark, sf, "events")
    return lookup.incomplete(e.where("event_type <> 'error'").select((F.col("event_id") % 500).alias("sha256")), e.where("event_id < 400").select(F.col("event_id").alias("sha256")))


SQL_AUDIT = """WITH a AS (SELECT event_id % 500 AS sha256, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1), b AS (SELECT event_id AS sha256, count(*) AS n FROM events WHERE event_id < 400 GROUP BY 1)
SELECT sha256, coalesce(a.n, 0) AS records, coalesce(b.n, 0) AS listed FROM a FULL JOIN b USING (sha256) WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1"""


def best_run(spark, sf):
    d = _log(spark, sf).select("scan_ref", (F.col("score") > 0.1).cast("double").alias("recall_at_fpr"), F.round("score", 1).alias("operating_fpr"), F.col("score").alias("loss"), F.col("scan_ref").cast("long").alias("id"))
    return lookup.best_checkpoint(d.select((F.col("loss") + F.col("id") / 1e9).alias("loss"), "recall_at_fpr", "operating_fpr", "id")).select("id")


SQL_BEST_RUN = """SELECT event_id AS id FROM (SELECT event_id, round(value / 500, 4) AS s FROM events) ORDER BY CASE WHEN s > 0.1::DOUBLE THEN 1 ELSE 0 END DESC, round(s, 1), s + event_id / 1e9 LIMIT 1"""

_ALL = {
    source_inspection: SQL_INSPECTION, stratified_folds: SQL_FOLDS, three_way_split: SQL_THREE_WAY, host_isolation: SQL_ISOLATION, split_report: SQL_SPLIT_REPORT, group_values: SQL_GROUP_VALUES, host_groups: SQL_HOST_GROUPS,
    curve_thresholds: SQL_CURVE, balanced_accuracies: SQL_BALANCED, control_gap: SQL_GAP, newest_blobs: SQL_BLOBS, two_level_cache: SQL_TWO_LEVEL, live_entries: SQL_LIVE, client_cache: SQL_CLIENT_CACHE,
    event_frames: SQL_FRAMES, training_logs: SQL_LOGS, cut_answers: SQL_ANSWERS_CUT, registrations: SQL_REGISTRATIONS, request_bounds: SQL_BOUNDS, manifest_audit: SQL_AUDIT, best_run: SQL_BEST_RUN,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: s for f, s in _ALL.items()}
