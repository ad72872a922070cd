"""Registrable domains by public suffixes, host groups, slugs, client-side host lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import is_file_link
from .urls import bad_port, is_ip_host, let, parse, port_of

# Public suffixes of more than one label (a short list; pass the lines of a full one for more), and suffixes under which private parties offer names.
SUFFIXES = "co.uk org.uk ac.uk gov.uk co.jp ne.jp or.jp co.kr co.in co.id co.nz co.za co.th com.au net.au org.au com.br com.mx com.sg com.my com.ph com.vn com.cn com.tr com.ar com.hk com.tw".split()
PRIVATE = "github.io gitlab.io blogspot.com herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com workers.dev azurewebsites.net cloudfront.net s3.amazonaws.com".split()
# Hosts that the client opens without asking.
TRUSTED = (
    "google.com google.co.id google.co.uk google.ca google.com.au google.de google.fr google.es google.it google.nl google.pl google.co.jp google.co.kr google.com.sg google.com.my google.com.ph google.co.th google.com.vn google.com.br "
    "google.com.mx google.co.in bing.com duckduckgo.com search.yahoo.com ecosia.org startpage.com search.brave.com baidu.com yandex.com mail.google.com calendar.google.com meet.google.com outlook.office.com outlook.live.com "
    "youtube.com m.youtube.com music.youtube.com en.wikipedia.org id.wikipedia.org wikipedia.org"
).split()
BROWSER = r"^(chrome|chrome-extension|about|devtools|edge):"


def public_domain(host: Column, suffixes: tuple | list = tuple(SUFFIXES)) -> Column:
    """The longest public suffix of a host and one label more; null for IP addresses and for hosts that are suffixes themselves."""
    many = F.array(*[F.lit(s) for s in suffixes])

    def own(names: Column) -> Column:
        n = F.size(names)
        tail = lambda k: F.array_join(F.slice(names, -k, k), ".")
        long = F.greatest(*[F.when((n >= k) & F.array_contains(many, F.when(n >= k, tail(k)).otherwise("")), k).otherwise(1) for k in (2, 3)])
        return F.when(n > long, F.when(long == 3, F.when(n >= 4, tail(4))).when(long == 2, F.when(n >= 3, tail(3))).when(n >= 2, tail(2)))

    clean = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(~is_ip_host(clean) & ~clean.contains(":"), let(F.split(clean, r"\."), own))


def group_domain(host: Column, suffixes: tuple | list = (*SUFFIXES, *PRIVATE)) -> Column:
    """The group of a host in leakage-free splits: its registrable domain with private suffixes counted, else the host itself."""
    return F.coalesce(public_domain(host, suffixes), F.regexp_replace(F.lower(host), r"\.+$", ""))


def netloc(url: Column) -> Column:
    """Host and port as written, in lower case."""
    return F.lower(parse(url)["authority"])


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]+", "_")


def is_trusted(url: Column) -> Column:
    """Whether an http(s) URL's host, less one leading www., is on the client's list."""
    return let(parse(url), lambda u: u["scheme"].isin("http", "https") & F.regexp_replace(F.regexp_replace(u["host"], r"\.$", ""), r"^www\.", "").isin(*TRUSTED))


def is_ignored(url: Column, scanner: str) -> Column:
    """Whether the client leaves a URL alone: browser pages, other schemes, the scanner's own origin (https or http), local development ports."""
    own = F.lit(scanner.split("://", 1)[-1].lower())

    def one(u: Column) -> Column:
        local = u["host"].isin("localhost", "127.0.0.1") & u["port_text"].isin("8000", "5173")
        return url.rlike(BROWSER) | ~u["scheme"].isin("http", "https") | (u["host"] == "") | bad_port(u) | (F.regexp_extract(F.lower(u["authority"]), "([^@]*)$", 1) == own) | local

    return F.coalesce(let(parse(url), one), F.lit(True)) | (url == "")


def is_default_port(url: Column) -> Column:
    return let(parse(url), lambda u: F.coalesce(port_of(u), F.lit(0)).isin(0, 80, 443))


def result_reusable(classification: Column, verdict: Column, stage: Column, error_code: Column, page_status: Column, url: Column, final_url: Column) -> Column:
    """Whether a client may keep a result: completed, without error, and of pages, not files."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return (
        text(classification).isin("benign", "phishing", "malware") & ~is_file_link(text(url)) & ~is_file_link(text(final_url)) & (text(error_code) == "")
        & (text(page_status) != "unavailable") & (text(stage) != "error") & (text(verdict) != "unknown")
    )
