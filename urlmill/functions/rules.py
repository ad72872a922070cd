"""Lexical risk rules as data, risk bands, verdicts and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import count_of, entropy, labels, parse, port_of, registered_domain, unquote

# Fixed values of the rule set.
TOKENS = "login verify secure update account password wallet signin sign-in confirm billing invoice unlock limited suspend paypal banking credential".split()
RISKY_TLDS = "xyz top tk ml ga cf gq click link zip review country support rest work cam cfd sbs icu cyou".split()
BRANDS = "paypal|apple|google|microsoft|amazon|facebook|instagram|whatsapp|bank"
BRAND_TLDS = "com net org gov edu co".split()
WELL_KNOWN = (
    "google.com youtube.com youtu.be gstatic.com googleusercontent.com googlevideo.com wikipedia.org github.com microsoft.com live.com office.com apple.com icloud.com cloudflare.com "
    "amazon.com amazonaws.com facebook.com instagram.com whatsapp.com twitter.com x.com linkedin.com reddit.com bing.com duckduckgo.com yahoo.com mozilla.org stackoverflow.com netflix.com openai.com cloud.google.com"
).split()
FAKE_TLD = r"(?i)-(com|net|org|co|info|gov|edu)$"
HTTP_PENALTY = 0.1


def is_well_known(host: Column) -> Column:
    return registered_domain(host).isin(*WELL_KNOWN) | F.regexp_replace(F.lower(host), r"\.+$", "").isin(*WELL_KNOWN)


def popular_key(host: Column) -> Column:
    """A host as popularity lists have it: without a leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^www\.", "")


def rules(url: Column, p: str = "_p") -> list[tuple[Column, Column, Column]]:
    """(condition, points, signal) in order. The struct column p holds host, names, tld, hay, known, port."""
    f = lambda k: F.col(f"{p}.{k}")
    host, names, tld, known = f("host"), f("names"), f("tld"), f("known")
    fake = F.get(F.filter(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), lambda x: x.rlike(FAKE_TLD) & (F.lower(F.regexp_extract(x, FAKE_TLD, 1)) != tld)), 0)
    end = F.regexp_extract(fake, FAKE_TLD, 1)
    hits = F.filter(F.array(*[F.lit(t) for t in TOKENS]), lambda t: f("hay").contains(t))
    size, n = F.length(url), F.size(names)
    authority = F.regexp_extract(F.regexp_extract(url, "://([^/]*)", 1), "^(.*)$", 1)
    text = F.lit
    # Points and signals of the rules.
    return [
        (host.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), F.lit(35), text("Host is a bare IP literal with no associated domain name")),
        (authority.contains("@"), F.lit(25), text("URL contains a credential-like '@' in the host section")),
        (host.rlike(r"(^|\.)xn--"), F.lit(20), text("Hostname uses punycode, which can hide lookalike characters")),
        (n >= 5, F.lit(18), text("Hostname contains unusual nesting / many subdomain labels")),
        (n == 4, F.lit(10), text("Hostname has more subdomain labels than a typical site")),
        (count_of(host, "-") >= 3, F.lit(12), text("Hostname contains many hyphens, a common phishing pattern")),
        (fake.isNotNull(), F.lit(40), F.concat(text("Hostname label '"), fake, text("' ends in '-"), end, text("', mimicking a ."), end, text(" address while the real domain is ."), tld)),
        ((F.size(hits) > 0) & ~known, F.least(F.lit(40), 12 * F.size(hits)), F.concat(text("Login or verification terms appear in the URL ("), F.array_join(F.slice(hits, 1, 4), ", "), text(")"))),
        ((size > 120) & ~known, F.lit(15), text("URL is significantly longer than a typical website address")),
        (size.between(76, 120) & ~known, F.lit(8), text("URL is longer than usual")),
        (tld.isin(*RISKY_TLDS), F.lit(15), F.concat(text("Top-level domain ."), tld, text(" is frequently abused in phishing kits"))),
        (F.coalesce(f("port"), F.lit(0)) > 0, F.lit(10), F.concat(text("URL uses a non-standard port ("), f("port").cast("string"), text(")"))),
        ((count_of(url, "%") >= 4) & ~known, F.lit(10), text("URL contains heavy percent-encoding that can hide the path")),
        ((F.length(host) >= 18) & (entropy(F.replace(host, F.lit("."), F.lit(""))) >= 3.8), F.lit(10), text("Hostname character distribution looks unusually random")),
        (host.rlike(BRANDS) & ~tld.isin(*BRAND_TLDS), F.lit(18), text("Brand-like token appears on an unrelated registered domain")),
    ]


def lexical_risk(df: DataFrame, column: str = "url", into: str = "heuristic") -> DataFrame:
    """Adds struct(label, confidence, risk_score, signals) of a normalised URL."""
    u = parse(F.col(column))
    names = labels(u["host"])
    odd = F.when(~port_of(u).isin(80, 443), port_of(u))
    p = F.struct(
        u["host"].alias("host"), names.alias("names"), F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("")).alias("tld"),
        F.lower(F.concat_ws(" ", u["host"], unquote(u["path"]), unquote(u["query"]))).alias("hay"), is_well_known(u["host"]).alias("known"), odd.alias("port"),
    )
    found = rules(F.col(column))
    hit = F.array_compact(F.array(*[F.when(c, F.struct(pts.cast("int").alias("points"), s.alias("signal"))) for c, pts, s in found]))
    scored = df.withColumn("_p", p).withColumn("_hit", hit)
    scored = scored.withColumn("_r", F.least(F.lit(100), F.aggregate("_hit", F.lit(0), lambda s, x: s + x.points)))
    r = F.col("_r")
    label = F.when(r >= 55, "phishing").when(r >= 35, "suspicious").otherwise("benign")
    half = F.floor(r / 2).cast("int")
    confidence = F.when(r >= 55, F.least(F.lit(100), 55 + half)).when(r >= 35, F.least(F.lit(100), 45 + half)).otherwise(100 - F.floor(r * F.lit(1.2)).cast("int"))
    signals = F.when((F.size("_hit") == 0), F.array(F.lit("No strong lexical phishing or malware patterns in the URL string"))).otherwise(F.transform("_hit", lambda x: x.signal))
    return scored.withColumn(into, F.struct(label.alias("label"), confidence.alias("confidence"), r.alias("risk_score"), signals.alias("signals"))).drop("_p", "_hit", "_r")


def risk_level(score: Column) -> Column:
    """Band of a score; null outside 0..1 and for NaN."""
    ok = score.isNotNull() & ~F.isnan(score.cast("double")) & score.between(0, 1)
    return F.when(ok, F.when(score >= 0.8, "High Risk").when(score >= 0.6, "MALICIOUS").when(score >= 0.4, "POTENTIALLY UNSAFE").otherwise("SAFE"))


def with_http_penalty(score: Column, scheme: Column) -> Column:
    return F.when((scheme == "http") & score.isNotNull(), F.least(F.lit(1.0), F.round(score + F.lit(HTTP_PENALTY), 4))).otherwise(score)


def verdict_for(classification: Column, page_score: Column) -> Column:
    return (
        F.when(classification == "malware", "malicious").when(classification == "unavailable", "unknown")
        .when(page_score.isNull(), F.when(classification == "phishing", "malicious").otherwise("safe"))
        .when(page_score > 0.6, "malicious").when(page_score >= 0.4, "potentially_unsafe").otherwise("safe")
    )


def effective_verdict(ever_malicious: Column, last: Column) -> Column:
    return F.when(ever_malicious & (last == "safe"), "potentially_unsafe").otherwise(last)


def page_label(score: Column) -> Column:
    """struct(label, confidence) of a page score."""
    bad = score >= 0.6
    return F.struct(F.when(bad, "phishing").otherwise("benign").alias("label"), F.rint(F.when(bad, score).otherwise(1 - score) * 100).cast("int").alias("confidence"))


def probability_band(p: Column, review: float, block: float) -> Column:
    return F.when(p >= block, "phishing").when(p >= review, "review").otherwise("not_flagged")


def is_high_risk(classification: Column, verdict: Column, score: Column) -> Column:
    return (classification != "unavailable") & (classification.isin("malware", "phishing") | (F.coalesce(verdict, F.lit("")) == "malicious") | (F.coalesce(score, F.lit(0.0)) >= 0.6))


def tally(counts: dict[str, Column]) -> Column:
    """'2x malicious, 1x safe' of the counts that are not zero."""
    return F.concat_ws(", ", *[F.when(c > 0, F.concat(c.cast("string"), F.lit(f"x {w}"))) for w, c in counts.items()])
