"""URL functions, by RFC 3986 parts and not by a parser, as URLs in a corpus are often ill-formed."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"

#: Domains by kind. A domain counts as listed if it ends with an entry; see ``strict`` below.
DOMAINS = {
    "blocked": ["facebook.com", "instagram.com", "pinterest.com", "quora.com", "tiktok.com", "twitter.com", "x.com"],
    "tier1": ["developer.mozilla.org", "docs.python.org", "docs.rs", "kubernetes.io", "learn.microsoft.com", "nodejs.org", "postgresql.org", "pytorch.org", "react.dev", "spark.apache.org"],
    "tier2": ["arxiv.org", "github.com", "gitlab.com", "ietf.org", "stackoverflow.com", "w3.org", "wikipedia.org"],
}
_PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "::1/128", "fc00::/7", "fe80::/10")]


def part(url: Column, k: int) -> Column:
    """Scheme (1), network location (2), path (3) or query (4)."""
    return F.regexp_extract(url, _PARTS, k)


def netloc(url: Column) -> Column:
    return F.lower(part(url, 2))


def normalize_url(url: Column) -> Column:
    """Scheme and network location in lower case, no fragment, no slash at the path's end; an empty path is ``/``.

    Parameters behind a semicolon in the last segment stay behind the trimmed path.
    """
    scheme, net, raw, query = F.lower(part(url, 1)), netloc(url), part(url, 3), part(url, 4)
    tail = F.regexp_extract(raw, r";([^/]*)$", 0)
    base = F.regexp_replace(F.substring(raw, F.lit(1), F.length(raw) - F.length(tail)), "/+$", "")
    hierarchical = scheme.isin("", "http", "https", "ftp", "file")
    path = F.when(base == "", "/").otherwise(base)
    path = F.when((net != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    params = F.when(F.length(tail) > 1, tail).otherwise("")
    rest = F.concat(path, F.when(hierarchical, params).otherwise(tail), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(net != "", F.concat(F.lit("//"), net)).otherwise(""), rest)


def listed(url: Column, domains: list[str], strict: bool = False) -> Column:
    """Whether the network location ends with a listed domain; with ``strict``, only as a whole label sequence of the host."""
    net = netloc(url)
    if strict:
        host = F.regexp_replace(F.regexp_replace(net, "^.*@", ""), r":\d*$", "")
        return F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return F.exists(F.array(*map(F.lit, domains)), lambda d: F.endswith(net, d))


def is_blacklisted(url: Column, domains: list[str] | None = None, strict: bool = False) -> Column:
    return listed(url, DOMAINS["blocked"] if domains is None else domains, strict)


def source_tier(url: Column, strict: bool = False) -> Column:
    """1 for documentation, 2 for well-kept sources, else 3."""
    return F.when(listed(url, DOMAINS["tier1"], strict), 1).when(listed(url, DOMAINS["tier2"], strict), 2).otherwise(3)


def tier_score(tier: Column) -> Column:
    return F.when(tier == 1, 1.0).when(tier == 2, 0.7).otherwise(0.4)


def is_valid_href(href: Column) -> Column:
    """Not a fragment, script or mail link."""
    return ~(href.startswith("#") | href.startswith("javascript:") | href.startswith("mailto:"))


def public_literal(url: str | None, strict: bool = False) -> bool:
    """Whether an http(s) URL's host is no literal private address. Names are not resolved, so this is no protection
    against requests to internal hosts; it screens what a URL says. ``strict`` also refuses all that is not global."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:
        return False
    if parts.scheme.lower() not in ("http", "https") or not host or host == "localhost":
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return True
    if strict:
        mapped = getattr(ip, "ipv4_mapped", None)
        return (mapped or ip).is_global
    return not any(ip in net for net in _PRIVATE if net.version == ip.version)


@F.pandas_udf(BooleanType())
def is_public_literal(url: pd.Series) -> pd.Series:
    return url.map(public_literal)


@F.pandas_udf(BooleanType())
def is_public_strict(url: pd.Series) -> pd.Series:
    return url.map(lambda u: public_literal(u, strict=True))


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """The absolute URL of a reference; null where it can't be parsed."""

    def one(b: str, h: str) -> str | None:
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)
