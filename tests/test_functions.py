"""Literal cases of URL functions, guards, rules and policy."""

import random

import pytest
from pyspark.sql import functions as F

from urlmill.functions import guards, pages, rules, urls
from urlmill.operators import policy


def one(spark, kind, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_risk_bands(spark):
    got = one(spark, "double", [0.0, 0.39, 0.4, 0.59, 0.6, 0.79, 0.8, 1.0, -0.01, 1.01, float("nan"), None], rules.risk_level)
    assert got == ["SAFE", "SAFE", "POTENTIALLY UNSAFE", "POTENTIALLY UNSAFE", "MALICIOUS", "MALICIOUS", "High Risk", "High Risk", None, None, None, None]


def test_http_penalty(spark):
    assert one(spark, "double", [0.0, 0.3, 0.55, 0.95, 1.0, None], lambda x: rules.with_http_penalty(x, F.lit("http"))) == [0.1, 0.4, 0.65, 1.0, 1.0, None]
    assert one(spark, "double", [0.3, 1.0], lambda x: rules.with_http_penalty(x, F.lit("https"))) == [0.3, 1.0]


def names(count=400, seed=8):
    """URLs whose last segment is a file by the rule (True) or not (False): each step of the rule, taken or not, for every ending."""
    r = random.Random(seed)
    letter = lambda c: f"%{ord(c):02{r.choice('xX')}}" if r.random() < 0.2 else r.choice([c, c.upper()])
    for i in range(count):
        ending, stem = guards.FILE_EXTENSIONS[i % len(guards.FILE_EXTENSIONS)], "".join(r.choice("kmqz-_.~") for _ in range(r.randint(1, 6)))
        file = stem + r.choice([".", "%2e", "%2E"]) + "".join(map(letter, ending))
        path = "/".join([r.choice(["", "f", "f.g", "%20"]) for _ in range(r.randint(0, 3))] + [""])
        after = r.choice(["", ";", ";k=1", ";k=a.b"]) + r.choice(["", "/", "//"]) + r.choice(["", "?", "?k=1"]) + r.choice(["", "#", "#k"])
        yield f"https://h{i}.urlmill.test/{path}{file}{after}", True
        other = [f"urlmill.{ending}", f"urlmill.test/{path}{file}/{stem}k", f"urlmill.test/{path}?{file}", f"urlmill.test/{path}#{file}", f"urlmill.test/{path}{stem}k.{ending}k", f"urlmill.test/{path}k{ending}", f"urlmill.test/{path}k;{file}"]
        yield f"https://{other[i % len(other)]}", False


def test_file_links(spark):
    cases = list(names())
    assert one(spark, "string", [u for u, _ in cases], guards.is_file_link) == [w for _, w in cases]


def test_headers(spark):
    bad = [{"content-type": "application/pdf"}, {"content-type": "image/png"}, {}, {"Content-Type": "text/html", "Content-Disposition": "Attachment; filename=x"}]
    good = [{"Content-Type": "text/html; charset=utf-8"}, {"content-type": "Application/XHTML+XML"}]
    assert one(spark, "map<string,string>", bad + good, guards.headers_refused) == [True] * 4 + [False] * 2


def legacy(ip):
    """An address in the forms that old resolvers read: one number, octal, hex, and fewer parts."""
    a, b, c, d = map(int, ip.split("."))
    return [str(a << 24 | b << 16 | c << 8 | d), f"0{a:o}.{b}.{c}.{d}", f"{a:#x}.{b}.{c}.{d}", f"{a}.{b << 16 | c << 8 | d}", f"{a}.{b}.{c << 8 | d}"]


INNER = [base for base, *_ in guards.RANGES_V4]
BLOCKED = ["gopher://urlmill.test/", "data:text/plain,x", "http://", "https://me:pw@urlmill.test/", "https://urlmill.test:3306/", "https://urlmill.test:1/", "https://urlmill.test/" + "b" * guards.MAX_LENGTH, "", None]
BLOCKED += [f"http://{ip}/" for ip in INNER] + [f"http://{ip}/x" for ip in legacy("127.9.8.7") + legacy("10.20.30.40")]


def test_static_guard(spark):
    got = one(spark, "string", BLOCKED + ["https://urlmill.test/", "http://9.9.9.9/", "http://urlmill.test:8443/x"], guards.static_refusal)
    assert all(got[: len(BLOCKED)]) and got[len(BLOCKED) :] == ["", "", ""]


def test_ip_classes(spark):
    ips = ["::", "[fd12:3456::9]", "fe81::2", "ff02::5", "::ffff:10.1.2.3", "172.31.255.255"]
    fine = ["9.9.9.9", "172.32.0.0", "2a00:1450:4001:81b::9", "[2620:fe::fe]"]
    odd = ["[2620:fe::9", "fe81::2]", "[[ff02::5]]", "[2620:fe::9]:8443", "[ ]", "[9.9.9.9]", "[host]"]
    got = one(spark, "string", ips + fine + odd, guards.classify_ip)
    assert all(got[: len(ips)]) and got[len(ips) : len(ips) + len(fine)] == [""] * 4 and set(got[-len(odd) :]) == {"unparseable IP address"}


def test_normalize(spark):
    cases = {"HTTP://Example.ORG:80//a//b/?q=1#f": "http://example.org/a/b?q=1#f", "example.org": "https://example.org/", "https://user:pw@example.org:8443/x/": "https://example.org:8443/x", "https://bücher.example/": "https://xn--bcher-kva.example/"}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.normalized.value for r in urls.normalize(df).collect()} == cases
    bad = {None: "invalid_url", " ": "invalid_url", "ftp://x.org": "unsupported_scheme", "host:8080/p": "unsupported_scheme", "https://": "invalid_url", "https://a_b.org": "invalid_url", "x" * 5000: "input_too_large", "https://x.org:70000": "invalid_url"}
    df = spark.createDataFrame([(k,) for k in bad], "url string")
    assert {r.url: r.normalized.error_code for r in urls.normalize(df).collect()} == bad


def test_train_normalize(spark):
    bad = {"": "empty_url", "not-a-url": "unsupported_scheme", "ftp://files.example/a.zip": "unsupported_scheme", "https://": "missing_hostname", None: "empty_url", "http://a\x01b.org": "control_character", "http://x.org:x": "invalid_port"}
    df = spark.createDataFrame([(k,) for k in bad], "url string")
    assert {r.url: r.normalized.reason for r in urls.train_normalize(df).collect()} == bad


def test_lexical_risk(spark):
    df = spark.createDataFrame([(u,) for u in ("https://lamps-com.ru/", "https://lamps-com.ru/login/verify", "https://mozilla.org/login", "https://qxvt.com/", "http://172.20.0.9/")], "url string")
    got = [(r.heuristic.label, r.heuristic.confidence, r.heuristic.risk_score) for r in rules.lexical_risk(df).collect()]
    assert got[:4] == [("suspicious", 65, 40), ("phishing", 87, 64), ("benign", 100, 0), ("benign", 100, 0)] and got[4][2] == 45


def test_address_identity(spark):
    rows = [("https://example.org/", "https://accounts.example.net/sign-in"), ("https://example.org/", "https://example.org/login"), ("https://example.org/", "http://example.org/"), ("https://example.org/", "https://EXAMPLE.org:443")]
    df = spark.createDataFrame(rows, "a string, b string").select((urls.identity(F.col("a")) != urls.identity(F.col("b"))).alias("c"), (urls.cache_key(F.col("a")) != urls.cache_key(F.col("b"))).alias("h"))
    assert [(r.c, r.h) for r in df.collect()] == [(True, True), (True, False), (True, False), (False, False)]


def test_page_signals_and_nodes(spark):
    html = "<html><body><script>var a='<form>'</script><form><INPUT TYPE='PASSWORD'><input></form><a href=x>go <b>now</b></a><iframe></iframe></body></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: tuple(r.s) for r in df.select("page_id", pages.signals(F.col("html")).alias("s")).collect()}
    assert got == {1: (1, 1, 2, 1, 1), 2: (0,) * 5, 3: (0,) * 5}
    nodes = pages.text_nodes(df).collect()
    assert [(n.text, n.xpath) for n in nodes] == [("go", "/html[1]/body[1]/a[1]"), ("now", "/html[1]/body[1]/a[1]/b[1]")]


def test_rdap(spark):
    rec = '{"entities":[{"roles":["registrar"],"vcardArray":"[\\"vcard\\",[[\\"fn\\",{},\\"text\\",\\"Reg Inc\\"]]]"}],"events":[{"eventAction":"expiration","eventDate":"garbage"},{"eventAction":"registration","eventDate":"2020-01-02T03:04:05Z"}],"nameservers":[{"ldhName":"NS1.X.ORG"}]}'
    r = spark.createDataFrame([(rec,)], "r string").select(pages.registration(F.col("r")).alias("x")).first().x
    assert r.registrar == "Reg Inc" and r.expires is None and r.created is not None and r.nameservers == ["ns1.x.org"]


BASE = {"error": None, "archive_ok": True, "rescan": False, "inspect_page": False, "approved": False, "feed_ok": True, "listed": False, "known": False, "page_ok": True, "page_score": 0.1, "password_inputs": 0, "scheme": "https", "label": "benign", "confidence": 100, "points": 0}
CASES = [
    ({"page_score": 0.99, "password_inputs": 1}, ("phishing", 99, 0.99, "page", "malicious")),
    ({"page_score": 0.99}, ("benign", 50, 0.99, "page", "malicious")),
    ({"label": "suspicious", "page_score": 0.99}, ("phishing", 99, 0.99, "page", "malicious")),
    ({"label": "phishing", "confidence": 87, "points": 64}, ("phishing", 87, 0.64, "page", "safe")),
    ({"known": True}, ("benign", 100, 0.0, "heuristic", "safe")),
    ({"listed": True}, ("malware", 97, 1.0, "urlhaus", "malicious")),
    ({"feed_ok": False}, ("unavailable", 0, None, "error", "unknown")),
    ({"page_ok": False}, ("unavailable", 0, None, "error", "unknown")),
    ({"page_score": 0.55, "scheme": "http"}, ("benign", 45, 0.65, "page", "potentially_unsafe")),
    ({"approved": True}, ("benign", 100, 0.0, "approved", "safe")),
    ({"approved": True, "listed": True}, ("malware", 97, 1.0, "urlhaus", "malicious")),
    ({"approved": True, "feed_ok": False}, ("unavailable", 0, None, "error", "unknown")),
    ({"archive_ok": False}, ("unavailable", 0, None, "error", "unknown")),
]


def test_policy(spark):
    rows = [(i, *{**BASE, **c}.values()) for i, (c, _) in enumerate(CASES)]
    schema = "i int, error string, archive_ok boolean, rescan boolean, inspect_page boolean, approved boolean, feed_ok boolean, listed boolean, known boolean, page_ok boolean, page_score double, password_inputs int, scheme string, label string, confidence int, points int"
    df = spark.createDataFrame(rows, schema).withColumn("heuristic", F.struct("label", "confidence", F.col("points").alias("risk_score"))).withColumn("prior", F.lit(None).cast("struct<classification:string,confidence:int,score:double,verdict:string,reusable:boolean>"))
    got = [(r.classification, r.confidence, r.risk_score, r.decision_stage, r.verdict) for r in policy.decide(df).orderBy("i").collect()]
    assert got == [w for _, w in CASES]


@pytest.mark.parametrize("total,wanted,want", [(10, 4, [0, 3, 6, 9]), (3, 5, [0, 1, 2]), (1, 1, [0])])
def test_shards(total, wanted, want):
    from urlmill.operators.corpus import shard_indices

    assert shard_indices(total, wanted) == want
