"""URL parsing and normalisation as column expressions. Failures are values: struct(ok, value, error_code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: scheme, authority, path, query, fragment (RFC 3986, appendix B)
PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
MAX_URL = 4096
#: A character that stands between parts inside `parse`
CUT = "\x01"
IP_HOST = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[[0-9a-fA-F:]+\]$"


def strip(text: Column) -> Column:
    """text without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def count_of(text: Column, piece: str) -> Column:
    """How often a piece of one character stands in text."""
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value computed once however often use repeats it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse(url: Column) -> Column:
    """struct(scheme, authority, path, query, fragment, userinfo, host, port_text); host in lower case and without brackets."""
    parts = F.split(F.regexp_replace(F.replace(url, F.lit(CUT), F.lit("")), PATTERN, CUT.join(f"${i}" for i in range(1, 6))), CUT)
    return let(parts, lambda p: let(F.regexp_extract(F.get(p, 1), r"([^@]*)$", 1), lambda rest: _parsed(p, rest)))


def _parsed(p: Column, rest: Column) -> Column:
    """p: the five parts; rest: the authority without user info."""
    bracket = rest.startswith("[")
    host = F.when(bracket, F.regexp_extract(rest, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(rest, r"^([^:]*)", 1))
    port = F.when(bracket, F.regexp_extract(rest, r"\]:(.*)$", 1)).otherwise(F.regexp_extract(rest, r"^[^:]*:(.*)$", 1))
    return F.struct(
        F.lower(F.get(p, 0)).alias("scheme"), F.get(p, 1).alias("authority"), F.get(p, 2).alias("path"), F.get(p, 3).alias("query"), F.get(p, 4).alias("fragment"),
        F.regexp_extract(F.get(p, 1), r"^(.*)@", 1).alias("userinfo"), F.lower(host).alias("host"), port.alias("port_text"),
    )


def port_of(u: Column) -> Column:
    """The port as an integer; null if there is none or it is no number up to 65535."""
    text = u["port_text"]
    return F.when(text.rlike("^[0-9]{1,9}$"), F.when(text.cast("int") <= 65535, text.cast("int")))


def bad_port(u: Column) -> Column:
    return (u["port_text"] != "") & port_of(u).isNull()


def unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    tail = F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.concat(scheme, F.lit("://"), netloc, path, tail)


def is_ip_host(host: Column) -> Column:
    return host.rlike(IP_HOST)


def labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def registered_domain(host: Column) -> Column:
    """The last two labels of a host; an IP address is its own."""
    h = F.regexp_replace(F.lower(host), r"\.+$", "")
    n = labels(h)
    return F.when(is_ip_host(h) | (F.size(n) <= 2), h).otherwise(F.array_join(F.slice(n, -2, 2), "."))


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves '+' and malformed escapes as they are."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters of text, in bits; 0 for empty text."""
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p)), F.lit(0.0))


def _netloc(u: Column, host: Column) -> Column:
    default = ((u["scheme"] == "http") & (port_of(u) == 80)) | ((u["scheme"] == "https") & (port_of(u) == 443))
    port = port_of(u)
    return F.when(port.isNull() | (port == 0) | default, host).otherwise(F.concat(host, F.lit(":"), port.cast("string")))


def valid_ascii_host(host: Column) -> Column:
    """Whether an ASCII host is made of IDNA-2008 labels: letters, digits and inner hyphens, 1 to 63 long, 253 in all."""
    label = r"(?!-)(?!..--)[a-z0-9-]{1,63}(?<!-)|xn--[a-z0-9-]{1,59}(?<!-)"
    return host.rlike(rf"^(?:{label})(?:\.(?:{label}))*$") & (F.length(host) <= 253)


def normalize(df: DataFrame, column: str = "url", into: str = "normalized") -> DataFrame:
    """Adds struct(ok, value, error_code): the serving form of a URL.

    Trimmed, https by default, host in its ASCII form, no default port, no user info, no doubled or last slash in the path; query and
    fragment stay. Codes: invalid_url, input_too_large, unsupported_scheme. Hosts beyond ASCII are encoded by a
    vectorised UDF (`encode_hosts`).
    """
    text = strip(F.coalesce(F.col(column), F.lit("")))
    clean = F.translate(text, "\t\r\n", "")
    first = df.withColumn("_t", text).withColumn("_c", F.when(F.regexp_extract(clean, PATTERN, 1) == "", F.concat(F.lit("https://"), clean)).otherwise(clean))
    parsed = first.withColumn("_u", parse(F.col("_c"))).withColumn("_h", F.regexp_replace(F.col("_u.host"), r"\.+$", ""))
    parsed = encode_hosts(parsed, "_h")
    u, host = F.col("_u"), F.col("_h")
    path = F.regexp_replace(F.when(u["path"] == "", "/").otherwise(u["path"]), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    code = (
        F.when(F.col("_t") == "", "invalid_url")
        .when(F.length("_t") > MAX_URL, "input_too_large")
        .when(~u["scheme"].isin("http", "https"), "unsupported_scheme")
        .when((u["host"] == "") | host.isNull(), "invalid_url")
        .when(~valid_ascii_host(host) | bad_port(u), "invalid_url")
    )
    value = unsplit(u["scheme"], _netloc(u, host), path, u["query"], u["fragment"])
    out = F.struct(code.isNull().alias("ok"), F.when(code.isNull(), value).alias("value"), code.alias("error_code"))
    return parsed.withColumn(into, out).drop("_t", "_c", "_u", "_h")


def encode_hosts(df: DataFrame, column: str) -> DataFrame:
    """Replaces hosts beyond ASCII by their ASCII form (null if they have none). Spark runs a Python UDF on every row of its batch, so
    the others pass as nulls, which cost next to nothing; one scan does for all."""
    odd = F.col(column).rlike(r"[^\x00-\x7F]")
    return df.withColumn(column, F.when(odd, ascii_host(F.when(odd, F.col(column)))).otherwise(F.col(column)))


def _encode(host: str | None) -> str | None:
    if host is None or host.isascii():
        return host
    try:
        import idna

        return idna.encode(host).decode()
    except ImportError:
        pass
    except UnicodeError:
        return None
    try:
        return host.encode("idna").decode()
    except UnicodeError:
        return None


@F.pandas_udf(T.StringType())
def ascii_host(hosts):  # noqa: ANN001, ANN201
    """IDNA form of hosts: the 2008 rules where the idna package is there, the standard library's otherwise."""
    return hosts.map(_encode)


def train_normalize(df: DataFrame, column: str = "url", into: str = "normalized", limit: int = 4096) -> DataFrame:
    """Adds struct(ok, value, reason, host, path, query, fragment, is_ip, has_userinfo, has_non_ascii, at_count): the training form.

    No default scheme, control characters refused, slashes of the path kept.
    """
    raw = strip(F.coalesce(F.col(column), F.lit("")))
    first = df.withColumn("_t", raw).withColumn("_u", parse(F.col("_t")))
    first = encode_hosts(first.withColumn("_h", F.regexp_replace(F.col("_u.host"), r"\.+$", "")), "_h")
    u, host, t = F.col("_u"), F.col("_h"), F.col("_t")
    v4 = host.rlike(r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    is_ip = v4 | host.contains(":")
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    path = F.when(u["path"] == "", "/").otherwise(u["path"])
    value = unsplit(u["scheme"], _netloc(u, shown), path, u["query"], u["fragment"])
    long_label = F.exists(F.split(host, r"\."), lambda x: (F.length(x) > 63) | (x == ""))
    reason = (
        F.when(t == "", "empty_url")
        .when(F.length(t) > limit, "url_too_long")
        .when(t.rlike(r"[\x00-\x1F\x7F]"), "control_character")
        .when(~u["scheme"].isin("http", "https"), "unsupported_scheme")
        .when(u["host"] == "", "missing_hostname")
        .when(host.isNull() | (host == "") | host.rlike(r"\s"), "invalid_hostname")
        .when(~is_ip & long_label, "invalid_hostname")
        .when(bad_port(u), "invalid_port")
        .when(F.length(value) > limit, "url_too_long")
    )
    ok = reason.isNull()
    out = F.struct(
        ok.alias("ok"), F.when(ok, value).alias("value"), reason.alias("reason"), host.alias("host"), path.alias("path"), u["query"].alias("query"), u["fragment"].alias("fragment"),
        is_ip.alias("is_ip"), u["authority"].contains("@").alias("has_userinfo"), t.rlike(r"[^\x00-\x7F]").alias("has_non_ascii"), count_of(t, "@").alias("at_count"),
    )
    return first.withColumn(into, out).drop("_t", "_u", "_h")


def redact(url: Column) -> Column:
    """URL without user info, query and fragment, for logs."""
    u = parse(url)
    port = port_of(u)
    netloc = F.when(port.isNull() | (port == 0), u["host"]).otherwise(F.concat(u["host"], F.lit(":"), port.cast("string")))
    return F.concat(u["scheme"], F.lit("://"), netloc, F.when(u["path"] == "", "/").otherwise(u["path"]))


def allow_key(url: Column) -> Column:
    """The exact address without user info and fragment; null unless http(s)."""
    u = parse(url)
    path = F.when(u["path"] == "", "/").otherwise(u["path"])
    return F.when(u["scheme"].isin("http", "https") & (u["host"] != ""), unsplit(u["scheme"], _netloc(u, u["host"]), path, u["query"], F.lit("")))


def cache_key(url: Column) -> Column:
    """The exact host name of an http(s) URL."""
    u = parse(url)
    return F.when(u["scheme"].isin("http", "https") & (u["host"] != ""), u["host"])


def identity(url: Column) -> Column:
    """What makes two addresses the same: scheme, host, effective port, path, query, fragment."""
    u = parse(url)
    port = F.coalesce(port_of(u), F.when(u["scheme"] == "https", 443).otherwise(80))
    return F.struct(u["scheme"].alias("scheme"), u["host"].alias("host"), port.alias("port"), F.when(u["path"] == "", "/").otherwise(u["path"]).alias("path"), u["query"].alias("query"), u["fragment"].alias("fragment"))


# Hosts that shorten links, and endings of files that are no pages.
SHORTENERS = ("bit.ly", "t.co", "goo.gl", "tinyurl.com", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rebrand.ly", "shorturl.at")
EXECUTABLES = (".exe", ".scr", ".msi", ".bat", ".cmd", ".ps1", ".jar", ".apk", ".dll", ".vbs")
ARCHIVES = (".zip", ".rar", ".7z", ".iso")


def peel(url: Column) -> Column:
    """The strips of an address in order: array of struct(key, label, value, note). Notes observe, they do not judge."""
    u = parse(url)
    host, names, none = u["host"], F.split(u["host"], r"\."), F.lit(None).cast("string")
    ip = host.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")
    cut = ~ip & (F.size(names) > 2)
    below = F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 2, F.lit(0))), ".")
    # Keys, labels and notes of the strips.
    host_note = (
        F.when(host == "", none).when(ip, "Bare IP address, no domain name").when(host.rlike(r"(^|\.)xn--"), "Punycode — may render as another script")
        .when(host.isin(*SHORTENERS), "Known link shortener, destination hidden")
        .when(F.size(names) >= 5, F.concat(F.lit("Full host has "), F.size(names).cast("string"), F.lit(" labels")))
        .when(F.length(host) > 40, F.concat(F.lit("Full host is "), F.length(host).cast("string"), F.lit(" characters")))
    )
    ending = F.lower(F.regexp_extract(F.regexp_extract(u["path"], r"([^/]*)$", 1), r"(\.[^.]*)$", 1))
    path_note = F.when(ending.isin(*EXECUTABLES), F.concat(F.lit("Ends in "), ending, F.lit(" — an executable, not a page"))).when(ending.isin(*ARCHIVES), F.concat(F.lit("Ends in "), ending, F.lit(" — an archive")))
    port = port_of(u)
    odd = port.isNotNull() & ~(((u["scheme"] == "http") & (port == 80)) | ((u["scheme"] == "https") & (port == 443)))
    n = F.size(F.filter(F.split(u["query"], "&"), lambda p: p != ""))
    user, secret = F.regexp_extract(u["userinfo"], "^([^:]*)", 1), F.regexp_extract(u["userinfo"], "^[^:]*:(.*)$", 1)
    strip_of = lambda on, key, label, value, note: F.when(on, F.struct(F.lit(key).alias("key"), (label if isinstance(label, Column) else F.lit(label)).alias("label"), value.alias("value"), note.alias("note")))
    return F.array_compact(F.array(
        strip_of(u["scheme"] != "", "scheme", "Scheme", F.concat(u["scheme"], F.lit("://")), F.when(u["scheme"] == "http", "Unencrypted")),
        strip_of(u["userinfo"] != "", "userinfo", "Credentials", F.when(secret != "", F.concat(user, F.lit(":••••@"))).otherwise(F.concat(user, F.lit("@"))), F.lit("Credentials in the address — often used to disguise the real host")),
        strip_of(cut, "subdomain", "Subdomain", F.concat(below, F.lit(".")), F.when(below == "www", "Conventional prefix").otherwise("Anyone who owns the domain controls this — a brand name here proves nothing")),
        strip_of(F.lit(True), "host", F.when(ip, "Host (IP address)").when(cut, "Registrable domain").otherwise("Host"), F.when(cut, F.array_join(F.slice(names, -2, 2), ".")).otherwise(host), host_note),
        strip_of(odd, "port", "Port", F.concat(F.lit(":"), port.cast("string")), F.lit("Non-standard port")),
        strip_of(~u["path"].isin("", "/"), "path", "Path", u["path"], path_note),
        strip_of(u["query"] != "", "query", "Query", F.concat(F.lit("?"), u["query"]), F.concat(n.cast("string"), F.when(n == 1, " parameter").otherwise(" parameters"))),
        strip_of(u["fragment"] != "", "fragment", "Fragment", F.concat(F.lit("#"), u["fragment"]), F.lit("Never sent to the server")),
    ))
