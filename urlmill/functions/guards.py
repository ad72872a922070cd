"""Guards: which addresses and responses may be scanned at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import bad_port, let, parse, port_of, strip, unquote

# Endings of files that are no pages.
FILE_EXTENSIONS = (
    "exe msi msp msix msixbundle appx appxbundle com scr dll sys bat cmd ps1 vbs vbe wsf sh jar apk aab ipa dmg pkg deb rpm zip rar 7z tar gz tgz bz2 xz zst iso img cab "
    "pdf doc docx docm xls xlsx xlsm ppt pptx pptm odt ods odp rtf epub jpg jpeg png gif webp avif bmp tif tiff ico svg heic mp3 wav ogg flac aac m4a mp4 m4v webm mov avi mkv mpeg mpg "
    "woff woff2 ttf otf eot css js mjs cjs map wasm json xml csv tsv txt log yaml yml sql bin torrent"
).split()
HTML_TYPES = ("text/html", "application/xhtml+xml")
PORTS = (80, 443, 8080, 8443)
MAX_LENGTH = 2048
#: IPv4 ranges with the reason given for them, first match first.
RANGES_V4 = (
    ("0.0.0.0", 32, "unspecified address"), ("127.0.0.0", 8, "loopback address"), ("169.254.0.0", 16, "link-local address"), ("224.0.0.0", 4, "multicast address"),
    ("0.0.0.0", 8, "private address"), ("10.0.0.0", 8, "private address"), ("172.16.0.0", 12, "private address"), ("192.168.0.0", 16, "private address"),
    ("192.0.0.9", 32, "non-routable range 192.0.0.0/24"), ("192.0.0.10", 32, "non-routable range 192.0.0.0/24"), ("192.0.0.0", 24, "private address"), ("192.0.2.0", 24, "private address"),
    ("198.18.0.0", 15, "private address"), ("198.51.100.0", 24, "private address"), ("203.0.113.0", 24, "private address"), ("240.0.0.0", 4, "private address"), ("100.64.0.0", 10, "non-routable range 100.64.0.0/10"),
)


def is_file_link(url: Column) -> Column:
    """Whether the last path segment, decoded, without a last slash and parameters, has a file ending."""
    name = F.lower(F.regexp_extract(F.regexp_extract(F.regexp_replace(unquote(parse(url)["path"]), "/+$", ""), r"([^/]*)$", 1), "^([^;]*)", 1))
    return name.contains(".") & F.regexp_extract(name, r"([^.]*)$", 1).isin(*FILE_EXTENSIONS)


def headers_refused(headers: Column) -> Column:
    """Whether a response (map of headers) is an attachment or no HTML."""
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    first = lambda name: F.lower(F.trim(F.regexp_extract(F.coalesce(F.try_element_at(low, F.lit(name)), F.lit("")), "^([^;]*)", 1)))
    return (first("content-disposition") == "attachment") | ~first("content-type").isin(*HTML_TYPES)


def v4_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none."""
    p = F.split(ip, r"\.")
    octet = lambda i: F.get(p, i).try_cast("long")
    fine = ip.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") & (F.greatest(*[octet(i) for i in range(4)]) <= 255)
    return F.when(fine, octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3))


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def v4_reason(number: Column) -> Column:
    """Why an IPv4 number is no public host; '' if it is one."""
    return let(number, _range_reason)


def _range_reason(number: Column) -> Column:
    out = None
    for base, bits, reason in RANGES_V4:
        low = _number(base)
        inside = number.between(low, low + (1 << (32 - bits)) - 1)
        out = F.when(inside, reason) if out is None else out.when(inside, reason)
    return F.when(number.isNotNull(), out.otherwise(""))


def classify_ip_v4(ip: Column) -> Column:
    n = v4_number(ip)
    return F.when(n.isNull(), "unparseable IP address").otherwise(v4_reason(n))


@F.pandas_udf(T.StringType())
def classify_ip(ips):  # noqa: ANN001, ANN201
    """Why an IPv4 or IPv6 literal (one pair of brackets allowed) is no public host; '' if it is one."""
    import ipaddress

    extra = [ipaddress.ip_network(n) for n in ("100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "::/128", "2001:db8::/32")]
    flags = ("unspecified", "loopback", "link_local", "multicast", "private", "reserved")

    def one(ip: str | None) -> str:
        try:
            a = ipaddress.IPv6Address(ip[1:-1]) if ip and ip[0] == "[" and ip[-1] == "]" else ipaddress.ip_address(ip)
        except ValueError:
            return "unparseable IP address"
        a = getattr(a, "ipv4_mapped", None) or a
        held = next((f for f in flags if getattr(a, f"is_{f}")), None)
        if held:
            return f"{held.replace('_', '-')} address"
        return next((f"non-routable range {n}" for n in extra if a.version == n.version and a in n), "")

    return ips.map(one)


def legacy_ipv4(host: Column) -> Column:
    """The number of a host as inet_aton reads it (parts in decimal, octal or hex; the last one fills the rest); null if it reads none."""
    return let(F.transform(F.split(host, r"\."), _part), _joined)


def _part(p: Column) -> Column:
    """A part of a legacy address as a number; null if it is none."""
    text = F.when(p.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(p, 3, 8), 16, 10)).when(p.rlike("^0[0-7]{0,11}$"), F.conv(p, 8, 10)).when(p.rlike("^[1-9][0-9]{0,9}$"), p)
    return text.try_cast("long")


def _joined(nums: Column) -> Column:
    n, last = F.size(nums), F.try_element_at(nums, F.lit(-1))
    room = F.try_element_at(F.array(*[F.lit(1 << b).cast("long") for b in (32, 24, 16, 8)]), n)
    heads = F.slice(nums, 1, n - 1)
    fine = F.forall(nums, lambda x: x.isNotNull()) & n.between(1, 4) & F.forall(heads, lambda x: x <= 255) & (last < room)
    return F.when(fine, F.aggregate(heads, F.lit(0).cast("long"), lambda s, x: s * 256 + x) * room + last)


def static_refusal(url: Column) -> Column:
    """The first reason, decidable without DNS, why a URL must not be fetched; '' if there is none. IPv6 literals are judged by `classify_ip`."""
    return let(parse(strip(url)), lambda u: _static(url, u))


def _static(url: Column, u: Column) -> Column:
    port = F.coalesce(F.nullif(port_of(u), F.lit(0)), F.when(u["scheme"] == "https", 443).otherwise(80))
    host = u["host"]
    # Reasons that callers see.
    why4, why_old = F.coalesce(v4_reason(v4_number(host)), F.lit("")), F.coalesce(v4_reason(legacy_ipv4(host)), F.lit(""))
    return (
        F.when(url.isNull() | (url == "") | (F.length(url) > MAX_LENGTH), "URL must be 1-2048 characters")
        .when(~u["scheme"].isin("http", "https"), "only http and https URLs are supported")
        .when(F.replace(u["userinfo"], F.lit(":"), F.lit("")) != "", "URLs with embedded credentials are not accepted")
        .when(host == "", "URL has no host")
        .when(bad_port(u), "invalid port")
        .when(~port.isin(*PORTS), F.concat(F.lit("port "), port.cast("string"), F.lit(" is not allowed")))
        .when(why4 != "", F.concat(F.lit("target resolves to a "), why4))
        .when(why_old != "", F.concat(F.lit("target resolves to a "), why_old))
        .otherwise("")
    )


def all_public(host: Column, ip: Column) -> tuple[Column, Column]:
    """Grouping key and aggregate for a resolution table (host, ip): a host passes only if every answer is public."""
    return host, F.bool_and(classify_ip_v4(ip) == "").alias("all_public")


def request_in_bounds(url: Column, reason: Column | None = None) -> Column:
    fine = F.length(url).between(1, 4096)
    return fine if reason is None else fine & (F.coalesce(F.length(reason), F.lit(0)) <= 1000)


def ids_in_bounds(ids: Column) -> Column:
    """Whether a batch names 1 to 200 ids, none of them null."""
    return F.coalesce(F.size(ids).between(1, 200) & ~F.exists(ids, lambda i: i.isNull()), F.lit(False))


def is_screenshot(blob: Column) -> Column:
    """JPEG magic bytes and at most 600,000 bytes."""
    return F.startswith(blob, F.lit(b"\xff\xd8\xff")) & (F.octet_length(blob) <= 600_000)


def status_ok(status: Column) -> Column:
    """Whether an HTTP status is one of success; a missing one is not."""
    return F.coalesce(status.between(200, 299), F.lit(False))
