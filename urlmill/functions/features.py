"""Lexical features of normalised URLs: one projection, declared as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import count_of, entropy, labels


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(part / whole, 6)


def feature_columns(n: str = "normalized") -> dict[str, Column]:
    """name -> expression over the struct that train_normalize adds."""
    f = lambda k: F.col(f"{n}.{k}")
    url, host, path = f("value"), f("host"), f("path")
    own = F.when(f("is_ip"), F.array().cast("array<string>")).otherwise(labels(host))
    letters, digits = F.length(F.regexp_replace(url, r"[^\p{L}]", "")), F.length(F.regexp_replace(url, r"[^\p{Nd}]", ""))
    size = F.length(url)
    out = {
        "url": url, "url_length": size, "hostname_length": F.length(host), "path_length": F.length(path), "query_length": F.length(f("query")), "fragment_length": F.length(f("fragment")),
        "path_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")), "host_label_count": F.size(own), "host_dot_count": count_of(host, "."), "host_hyphen_count": count_of(host, "-"),
        "max_host_label_length": F.coalesce(F.array_max(F.transform(own, F.length)), F.length(host)), "tld_length": F.coalesce(F.length(F.try_element_at(own, F.lit(-1))), F.lit(0)),
        "is_ip": f("is_ip").cast("int"), "has_userinfo": f("has_userinfo").cast("int"), "has_punycode": F.exists(own, lambda x: x.startswith("xn--")).cast("int"), "has_non_ascii": f("has_non_ascii").cast("int"),
        "letter_count": letters, "letter_ratio": _ratio(letters, size), "digit_count": digits, "digit_ratio": _ratio(digits, size), "special_count": size - letters - digits, "special_ratio": _ratio(size - letters - digits, size),
        "dot_count": count_of(url, "."), "hyphen_count": count_of(url, "-"), "underscore_count": count_of(url, "_"), "slash_count": count_of(url, "/"), "at_count": f("at_count"), "percent_count": count_of(url, "%"),
        "percent_encoded_count": F.regexp_count(url, F.lit("%[0-9A-Fa-f]{2}")), "equals_count": count_of(url, "="), "question_count": count_of(url, "?"), "ampersand_count": count_of(url, "&"),
        "url_entropy": F.round(entropy(url), 6), "hostname_entropy": F.round(entropy(host), 6),
    }
    return out


def features(df: DataFrame, *keep: str, n: str = "normalized") -> DataFrame:
    """The columns `keep` and all features of the rows whose URL is valid."""
    return df.where(F.col(f"{n}.ok")).select(*keep, *[c.alias(k) for k, c in feature_columns(n).items()])


def pattern_flags(url: Column) -> dict[str, Column]:
    """Patterns of the source: https, www, a path beyond the root, a query."""
    from .urls import parse

    u = parse(url)
    return {"https": u["scheme"] == "https", "www": u["host"].startswith("www."), "non_root_path": ~u["path"].isin("", "/"), "has_query": u["query"] != ""}
