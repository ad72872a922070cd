"""Texts and small structures that clients show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import is_high_risk
from .urls import identity


def page_reasoning(score: Column, signals: Column) -> Column:
    """What a page score rests on; signals is the struct of page signals."""
    # The sentences readers see.
    n = lambda k: signals[k].cast("string")
    form = (
        F.when(signals["password_inputs"] > 0, F.concat(F.lit("It asks for a password in "), n("password_inputs"), F.lit(" field(s) across "), n("forms"), F.lit(" form(s).")))
        .when(signals["forms"] > 0, F.concat(F.lit("It carries "), n("forms"), F.lit(" form(s) but no password field.")))
        .otherwise("It carries no form at all.")
    )
    frames = F.when(signals["iframes"] > 0, F.concat(n("iframes"), F.lit(" iframe(s) are embedded.")))
    return F.concat_ws(" ", F.concat(F.lit("The fetched page scored "), F.format_string("%.2f", score), F.lit(" on the markup classifier.")), form, frames)


def shown_state(classification: Column, verdict: Column, score: Column) -> Column:
    """The state a result is shown in: stop, caution, or its own class."""
    mixed = (F.coalesce(verdict, F.lit("")) == "potentially_unsafe") | (F.coalesce(score, F.lit(0.0)) >= 0.4)
    return F.when(classification.isin("unavailable", "malware"), classification).when(is_high_risk(classification, verdict, score), "phishing").when(mixed, "caution").otherwise(classification)


def badge(classification: Column, verdict: Column, score: Column) -> Column:
    """The word on the toolbar."""
    plain = F.when(classification == "malware", "STOP").when(classification == "phishing", "RISK").when(classification == "benign", "OK").when(classification == "unavailable", "?").when(classification == "allowed", "SKIP").when(classification == "checking", "..").otherwise("")
    bad = is_high_risk(classification, verdict, score)
    return F.when(bad, "STOP").when((classification == "benign") & (shown_state(classification, verdict, score) != "benign"), "!").otherwise(plain)


def destination(url: Column, final_url: Column, inspected: Column) -> Column:
    """struct(final_url, page_inspected, address_changed, host_changed); unknown where the page was not inspected."""
    final = F.when(inspected, final_url)
    a, b = identity(url), identity(final)
    return F.struct(final.alias("final_url"), inspected.alias("page_inspected"), F.when(final.isNotNull(), a != b).alias("address_changed"), F.when(final.isNotNull(), a["host"] != b["host"]).alias("host_changed"))


def facts(columns: dict[str, Column]) -> Column:
    """Named facts as JSON text, in the given order, nulls left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def infer_shortcut(page_status: Column, stored: Column, signals: Column) -> Column:
    """The stored shortcut, else the one that an old row's signals name."""
    old = F.when(F.array_contains(signals, "Host is on the Tranco top-domain ranking"), "tranco").when(F.array_contains(signals, "Host is on the well-known domain list"), "well_known")
    return F.coalesce(stored, F.when(page_status == "skipped", old))


def health(feed_key: Column, cache: Column, page: Column, db_enabled: Column, history: Column) -> Column:
    return F.when(feed_key & cache & page & (~db_enabled | history), "ok").otherwise("degraded")
