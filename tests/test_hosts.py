"""Address ranges against the standard library, public suffix rules against a plain reading of the list, cut-off JSON against a parser that goes character by character."""

import ipaddress
import json
import random

from pyspark.sql import functions as F

from urlmill.functions import guards, partial_json
from urlmill.functions.addresses import address_bits
from urlmill.operators import networks, suffixes
from urlmill.plans.hosts import RULES

# ---- addresses


def brute_reason(ip):
    try:
        a = ipaddress.IPv6Address(ip[1:-1]) if ip and ip[0] == "[" and ip[-1] == "]" else ipaddress.ip_address(ip)
    except ValueError:
        return "unparseable IP address"
    a = getattr(a, "ipv4_mapped", None) or a
    for flag in ("unspecified", "loopback", "link_local", "multicast", "private", "reserved"):
        if getattr(a, f"is_{flag}"):
            return f"{flag.replace('_', '-')} address"
    return next((f"non-routable range {n}" for n in networks.NETWORKS["extra"].split() if a.version == ipaddress.ip_network(n).version and a in ipaddress.ip_network(n)), "")


def literals():
    """Both ends of every network and their neighbours, random addresses in several spellings, and literals that are none."""
    r, out = random.Random(1), []
    for names in networks.NETWORKS.values():
        for n in map(ipaddress.ip_network, names.split()):
            kind, top = (ipaddress.IPv4Address, 1 << 32) if n.version == 4 else (ipaddress.IPv6Address, 1 << 128)
            ends = {int(n[0]) - 1, int(n[0]), int(n[0]) + 1, int(n[-1]) - 1, int(n[-1]), int(n[-1]) + 1, r.randrange(int(n[0]), int(n[-1]) + 1)}
            out += [kind(x) for x in ends if 0 <= x < top]
    out += [ipaddress.IPv4Address(r.getrandbits(32)) for _ in range(50)] + [ipaddress.IPv6Address(r.getrandbits(128) & ~(((1 << 64) - 1) << r.randrange(0, 100))) for _ in range(150)]
    texts = [str(a) for a in out] + [a.exploded.upper() for a in out if a.version == 6] + [f"[{a}]" for a in out[::3]] + [f"::ffff:{a}" for a in out if a.version == 4] + [f"64:ff9b::{a}" for a in out[::5] if a.version == 4]
    odd = "|::|:|:::|::1::|1:2:3:4:5:6:7:8|1:2:3:4:5:6:7::|1:2:3:4:5:6:7:8::|::2:3:4:5:6:7:8|1::2:3:4:5:6:7:8|1:2:3:4:5:6:7|12345::|g::|1.2.3|1.2.3.4.5|01.2.3.4|256.1.1.1|::1.2.3.4|1.2.3.4::|::1.2.3|1::1.2.3.4:5|[1.2.3.4]|[::1|::1]|[[::1]]|[]|fe80::1%eth0|fe80::1%|%|fe80::1%a%b| ::1|1:2:3:4:5:6:1.2.3.4|1:2:3:4:5:6:7:1.2.3.4|::ffff:1.2.3.4%x|é"
    return [*texts, *odd.split("|")]


def test_networks_equal_the_standard_library(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(literals())] + [(-1, None), (-2, "10.0.0.1"), (-3, "10.0.0.1")], "i long, ip string")
    got = networks.classify(d, "ip").collect()
    assert len(got) == d.count() and not [(r.ip, r.reason, brute_reason(r.ip)) for r in got if r.reason != brute_reason(r.ip)]
    # The expression form for IPv4 agrees.
    v4 = [r for r in d.select("ip", guards.classify_ip_v4(F.col("ip")).alias("w")).collect() if r.ip and ":" not in r.ip and "[" not in r.ip and "%" not in r.ip]
    assert all(r.w == brute_reason(r.ip) for r in v4)


def test_other_tables_and_bits(spark):
    d = spark.createDataFrame([("8.8.4.4",), ("2a00::1",)], "ip string")
    mine = networks.networks(spark, {"private": "8.8.0.0/16", "extra": "2a00::/12"})
    assert {r.ip: r.reason for r in networks.classify(d, "ip", mine).collect()} == {"8.8.4.4": "private address", "2a00::1": "non-routable range 2a00::/12"}
    got = d.select(address_bits(F.col("ip")).alias("a")).select("a.*").collect()
    assert [(r.version, int(r.bits, 2)) for r in got] == [(4, int(ipaddress.ip_address("8.8.4.4"))), (6, int(ipaddress.ip_address("2a00::1")))]
    assert networks.classify(d.limit(0), "ip").count() == 0


# ---- suffixes


def brute_suffix(host, private):
    rules, inside = {}, False
    for line in RULES.split("\n"):
        inside = (inside or "BEGIN" in line) and "END" not in line
        if line.strip() and not line.startswith("//") and (private or not inside):
            rules[tuple(line.split()[0].split("."))] = 1
    labels, found = host.lower().rstrip(".").split("."), 0
    for k in range(1, len(labels) + 1):
        tail = tuple(labels[-k:])
        if ("!" + tail[0], *tail[1:]) in rules:
            found = k - 1
            break
        if tail in rules or ("*", *tail[1:]) in rules and k > 1:
            found = k
    return (".".join(labels[-found:]), ".".join(labels[-found - 1 :]) if len(labels) > found else None) if found else (None, None)


def test_suffix_rules(spark, tmp_path):
    (tmp_path / "list.dat").write_text(RULES, encoding="utf-8")
    rules = suffixes.read_rules(spark, str(tmp_path / "list.dat"))
    assert {(r.name, r.kind) for r in rules.where("private").collect()} == {("github.io", "plain"), ("compute.example.net", "wild")}
    r, names = random.Random(3), ["a", "b", "com", "uk", "co", "jp", "kawasaki", "city", "kobe", "ck", "www", "io", "github", "net", "example", "compute", "org", "nowhere"]
    hosts = sorted({".".join(r.choice(names) for _ in range(r.randint(1, 5))) for _ in range(600)} | {"A.B.CO.UK.", "city.kawasaki.jp", "x.city.kawasaki.jp", "y.x.kawasaki.jp", "www.ck", "q.www.ck", "q.other.ck", "u.github.io", "z.y.compute.example.net"})
    d = spark.createDataFrame([(h,) for h in hosts] + [("10.1.2.3",), ("::1",), ("",), (None,), ("com",)], "h string")
    for private in (False, True):
        got = {x.h: (x.suffix, x.domain) for x in suffixes.suffixes(d, "h", rules, private).collect()}
        assert {h: got.get(h, (None, None)) for h in hosts} == {h: brute_suffix(h, private) for h in hosts}
    one = {x.h: x.domain for x in suffixes.registrable(d, "h", rules).collect()}
    assert one["A.B.CO.UK."] == "b.co.uk" and one["10.1.2.3"] is None and one["com"] is None and one["city.kawasaki.jp"] == "city.kawasaki.jp" and one["q.www.ck"] == "www.ck" and one["q.other.ck"] == "q.other.ck"
    group = {x.h: x.group for x in suffixes.split_group(d, "h", rules).collect()}
    assert group["10.1.2.3"] == "10.1.2.3" and group["com"] == "com" and group["u.github.io"] == "u.github.io" and group["z.y.compute.example.net"] == "z.y.compute.example.net" and group[None] == ""


# ---- cut-off JSON


class Cut(Exception):
    """The text ended."""


def brute_partial(text):
    """A parser by recursive descent that returns what it has when the text ends: open strings as they are, other incomplete values not at all."""
    at = 0

    def peek():
        if at >= len(text):
            raise Cut
        return text[at]

    def space():
        nonlocal at
        while peek() in " \t\r\n":
            at += 1

    def string(into):
        nonlocal at
        at += 1
        while peek() != '"':
            if text[at] == "\\":
                size = 6 if text[at + 1 : at + 2] == "u" else 2
                if at + size > len(text):
                    raise Cut
                piece = json.loads(f'"{text[at : at + size]}"')
                if "\ud800" <= piece <= "\udbff":
                    if at + 12 > len(text):
                        raise Cut
                    piece, size = json.loads(f'"{text[at : at + 12]}"'), 12
                into.append(piece)
                at += size
            else:
                into.append(text[at])
                at += 1
        at += 1

    def value(put):
        nonlocal at
        space()
        c = peek()
        if c == '"':
            got = []
            try:
                string(got)
            finally:
                put("".join(got))
        elif c == "[":
            at += 1
            out = []
            put(out)
            space()
            while peek() != "]":
                value(out.append)
                space()
                if peek() == ",":
                    at += 1
                    space()
            at += 1
        elif c == "{":
            at += 1
            out = {}
            put(out)
            space()
            while peek() != "}":
                key = []
                string(key)
                space()
                at += 1
                value(lambda v, k="".join(key): out.__setitem__(k, v))
                space()
                if peek() == ",":
                    at += 1
                    space()
            at += 1
        else:
            end = at
            while end < len(text) and text[end] not in ",]} \n":
                end += 1
            if end == len(text):
                raise Cut
            put(json.loads(text[at:end]))
            at = end

    held = []
    try:
        value(held.append)
    except Cut:
        pass
    return held[0] if held else None


def test_every_prefix_of_answers(spark):
    r, rows = random.Random(9), []
    piece = lambda: "".join(r.choice(['"', "\\", "/", "\n", "é", "漢", "😀", "a", " ", "}", "]", ",", ":", "\x01"]) for _ in range(r.randint(0, 9)))
    for _ in range(40):
        o = {k: v for k, v in (("summary", r.choice([piece(), 5, None, piece()])), ("other", {"x": [1.5e3, True, {"summary": piece()}], "y": {}}), ("reasons", [r.choice([piece(), 7, None, ["z"]]) for _ in range(r.randint(0, 8))]), ("advice", r.choice([[piece()] * 7, "no list", []]))) if r.random() < 0.9}
        text = json.dumps(o, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        for n in range(len(text) + 1):
            want = brute_partial(text[:n])
            got = partial_json.closed(text[:n])
            assert (None if got is None else json.loads(got)) == want, (text[:n], got, want)
        rows.append((text[: r.randint(1, len(text))],))
    got = spark.createDataFrame(rows, "t string").select(partial_json.partial_answer("t").alias("p")).collect()
    for (text,), x in zip(rows, got):
        v = brute_partial(text)
        assert x.p.summary == (v.get("summary", "") if isinstance(v.get("summary", ""), str) else "")
        assert x.p.reasons == [s for s in (v.get("reasons") or []) if isinstance(s, str)][:6]


def test_bounds_and_texts_that_are_no_answers():
    long = json.dumps({"summary": "s" * 2000, "reasons": ["r" * 900] * 9, "advice": ["a"] * 9})
    got = partial_json.answer(long)
    assert (len(got["summary"]), [len(x) for x in got["reasons"]], len(got["advice"])) == (1600, [800] * 6, 5)
    for bad in (None, "", " ", "nope", "[1", '"x', "{,", '{"a" "b"', '{"a": x', '{"summary":"x"} y', '{"a":"\\q', '{"a": 1]', '{"summary": "\\ud83d"}', "{" * 5000, '{"a":' * 5000):
        assert partial_json.answer(bad) is None or bad.startswith('{"a":' * 2), bad
    assert partial_json.answer("{") == {"summary": "", "reasons": [], "advice": []}
