"""URL columns: normalisation, parts, filters, page numbers."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import parse_qs, unquote, urlencode, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow_udf

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"

# URL patterns that a crawl leaves out, and where a URL holds a page number.
EXCLUDED = (
    r".*\.(pdf|zip|tar|gz|exe|dmg|pkg|deb|rpm)$",
    r".*\.(jpg|jpeg|png|gif|svg|ico|webp|bmp)$",
    r".*\.(mp3|mp4|avi|mov|wmv|flv|webm)$",
    r".*\?.*utm_",
    r".*/login.*",
    r".*/logout.*",
    r".*/signin.*",
    r".*/signout.*",
)
PAGE_NUMBERS = (r"[?&]page=(\d+)", r"[?&]p=(\d+)", r"/page/(\d+)", r"/p/(\d+)", r"-page-(\d+)", r"_page_(\d+)")


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 network location, 3 path, 4 query; empty if there is none."""
    return F.regexp_extract(url, PARTS, n)


def domain(url: Column) -> Column:
    """The network location in lower case."""
    return F.lower(part(url, 2))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no trailing slash, sorted query parts, no fragment."""
    scheme, host = F.lower(part(url, 1)), domain(url)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(part(url, 3), "/+$", "")
    query = F.array_join(F.array_sort(F.split(part(url, 4), "&")), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme == "", url).otherwise(whole)


@arrow_udf("string")
def state_url(urls: pd.Series) -> pd.Series:
    """The normalisation of visit states: percent-decoded path, one value for each query key, ports kept, no parameters or fragment."""

    def one(url: str | None) -> str | None:
        if url is None:
            return None
        p = urlparse(url)
        first = {k: v[0] for k, v in sorted(parse_qs(p.query).items())}
        return urlunparse((p.scheme.lower(), p.netloc.lower(), unquote(p.path).rstrip("/") or "/", "", urlencode(first), ""))

    return urls.map(one)


def _reasons(url: Column, domains: Sequence[str], excluded: Sequence[str], included: Sequence[str], external: bool) -> list[tuple[Column, Column]]:
    """Failing conditions in the order they are tried, with what to say."""
    scheme, host = F.lower(part(url, 1)), domain(url)
    rules = [(~scheme.isin("http", "https"), F.concat(F.lit("Invalid scheme: "), scheme)), (host == "", F.lit("No host in URL"))]
    if domains and not external:
        known = F.lit(False)
        for d in domains:
            known = known | (host == d.lower()) | host.endswith("." + d.lower())
        rules.append((~known, F.concat(F.lit("External domain: "), host)))
    rules += [(url.rlike("(?i)" + p), F.lit(f"Matched exclude pattern: {p}")) for p in excluded]
    if included:
        found = F.lit(False)
        for p in included:
            found = found | url.rlike("(?i)" + p)
        rules.append((~found, F.lit("No include pattern matched")))
    return rules


def rejection_reason(url: Column, domains: Sequence[str] = (), excluded: Sequence[str] = EXCLUDED, included: Sequence[str] = (), external: bool = False) -> Column:
    """The first rule that a URL breaks, null if it is allowed."""
    out = F.lit(None).cast("string")
    for bad, say in reversed(_reasons(url, domains, excluded, included, external)):
        out = F.when(bad, say).otherwise(out)
    return out


def is_allowed(url: Column, domains: Sequence[str] = (), excluded: Sequence[str] = EXCLUDED, included: Sequence[str] = (), external: bool = False) -> Column:
    return F.coalesce(url.isNotNull() & rejection_reason(url, domains, excluded, included, external).isNull(), F.lit(False))


def page_number(url: Column) -> Column:
    """The page number in a URL by the first pattern that finds one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in PAGE_NUMBERS]).cast("int")


def with_page_number(url: Column, number: Column) -> Column:
    """The URL with another page number, put where page_number() reads it; null where there is none."""
    out = F.lit(None).cast("string")
    for p in reversed(PAGE_NUMBERS):
        head = p.replace(r"(\d+)", "")
        lead = head.replace("[?&]", "([?&])") if head.startswith("[") else f"({head})"
        put = F.regexp_replace(url, lead + r"\d+", F.concat(F.lit("$1" + head.removeprefix("[?&]") if head.startswith("[") else "$1"), number.cast("string")))
        out = F.when(url.rlike(p), put).otherwise(out)
    return out


def pagination_urls(url: Column, most: int) -> Column:
    """The URLs of the next `most` pages."""
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: with_page_number(url, page_number(url) + i))
