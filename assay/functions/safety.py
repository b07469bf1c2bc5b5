"""Safety predicates on texts and links."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType


def url_host(url: Column) -> Column:
    """Lower-case host of a URL; NULL if it cannot be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_reserved_name(host: Column) -> Column:
    """Documentation domains and their subdomains, localhost, and the local top-level names."""
    return (host == "localhost") | host.rlike(r"\.(localhost|local)$") | host.rlike(r"(^|\.)example\.(com|org|net|edu)$")


@F.pandas_udf(BooleanType())
def _is_private_address(host: pd.Series) -> pd.Series:
    def private(h):
        try:
            a = ipaddress.ip_address((h or "").strip("[]"))
        except ValueError:
            return False
        return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved

    return host.map(private)


def is_reserved_host(host: Column) -> Column:
    """Reserved names and private, loopback, link-local or reserved addresses; only literal addresses reach Python."""
    literal = host.rlike(r"^\[|^[0-9.]+$|:")
    return F.coalesce(is_reserved_name(host) | F.when(literal, _is_private_address(host)).otherwise(False), F.lit(False))


def real_year_cves(text: Column) -> Column:
    """Sorted distinct CVE ids, in any case, whose year is not the placeholder 2099."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(CVE-\d{4}-\d{4,})"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.substring(x, 5, 4) != "2099")))


# How a web address begins (control characters may stand in it), what ends one in prose, and marks behind one.
URL_START = r"h[\t\r\n]*t[\t\r\n]*t[\t\r\n]*p(?:[\t\r\n]*s)?[\t\r\n]*:[\t\r\n]*/[\t\r\n]*/"
URL_STOPS = "<>()`\"'"
URL_TRAILING = ".,;!?\"'*_~"
_START = re.compile(URL_START, re.I)
_PIECE = re.compile(
    rf"(?P<control>[\t\r\n]+)|(?P<space>\s)|(?P<stop>[{re.escape(URL_STOPS)}])|(?P<open>\[)|(?P<close>\])|(?P<end>[/?#])|(?P<plain>[^\s\[\]/?#{re.escape(URL_STOPS)}]+)"
)
_WRAP = re.compile(rf"[{re.escape(URL_TRAILING + URL_STOPS)}\]]+")
_BREAK = re.compile(r"\r\n?|\n")


def _joined(text: str, begin: int, end: int) -> bool:
    """Whether control characters between ``begin`` and ``end`` belong to an address: less than a blank line, and text right behind them."""
    return len(_BREAK.findall(text, begin, end)) < 2 and end < len(text) and not text[end].isspace()


def url_tokens(text: str) -> list[tuple[str, str]]:
    """(address, its authority) of the web addresses in a text, which never overlap.

    Everything up to the last @ before the first of ``/ ? #`` is user information, white space included.  Quotes and brackets
    end an address only where prose goes on behind them.
    """
    out, at = [], 0
    while start := _START.search(text, at):
        first = re.compile(r"[/?#]").search(text, start.end())
        last_at = text.rfind("@", start.end(), first.start() if first else len(text))
        end = scan = max(last_at, start.end())
        depth, host = 0, True
        while piece := _PIECE.match(text, scan):
            kind, past = piece.lastgroup, piece.end()
            if kind == "space" or (kind == "control" and not (host and _joined(text, scan, past))):
                break
            if kind == "stop":
                if not host:
                    break
                past = _WRAP.match(text, scan).end()
                behind = re.compile(r"[\t\r\n]*").match(text, past).end()
                if past >= len(text) or (text[past].isspace() and not (behind > past and _joined(text, past, behind))):
                    break
            elif kind == "open":
                depth += 1
            elif kind == "close":
                if not depth:
                    break
                depth -= 1
            elif kind == "end" and not depth:
                host = False
            end = scan = past
        token = text[start.start() : end].rstrip(URL_TRAILING)
        out.append((token, _authority(token, start.end() - start.start())))
        at = max(scan, start.end())
    return out


def _authority(token: str, begin: int) -> str:
    depth = 0
    for k in range(begin, len(token)):
        c = token[k]
        if not depth and c in "/?#":
            return token[begin:k]
        depth += (c == "[") - (c == "]" and depth > 0)
    return token[begin:]


def _is_unsafe(token: str, authority: str) -> bool:
    if set(authority) & set("\\\t\r\n" + URL_STOPS):
        return True
    try:
        host = (urlsplit(token).hostname or "").lower().rstrip(".")
    except ValueError:
        return True
    if host == "localhost" or re.search(r"\.(localhost|local)$|(^|\.)example\.(com|org|net|edu)$", host):
        return False
    try:
        a = ipaddress.ip_address(host)
    except ValueError:
        return True
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved)


@F.pandas_udf(ArrayType(StringType()))
def _unsafe(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted({token for token, authority in url_tokens(t) if token and _is_unsafe(token, authority)}))


def unsafe_urls(text: Column) -> Column:
    """Sorted distinct web addresses whose host is not reserved, or which cannot be read; only texts with an address reach Python, from their first one on."""
    begun = F.coalesce(text.rlike(f"(?i){URL_START}"), F.lit(False))
    # nothing before the first address matters, and it stays in the JVM
    behind = F.regexp_replace(text, rf"(?is)\A.*?(?={URL_START})", "")
    return F.when(begun, _unsafe(F.when(begun, behind).otherwise(""))).otherwise(F.array().cast("array<string>"))


def violations(text: Column) -> Column:
    """Everything in a text that must not be published, as (rule, found) in order: CVE ids first, then addresses."""
    cves = F.transform(F.coalesce(real_year_cves(text), F.array().cast("array<string>")), lambda x: F.struct(F.lit("real_year_cve").alias("rule"), x.alias("found")))
    urls = F.transform(unsafe_urls(text), lambda x: F.struct(F.lit("unsafe_url").alias("rule"), x.alias("found")))
    return F.concat(cves, urls)
