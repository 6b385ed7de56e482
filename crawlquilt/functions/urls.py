"""URL functions as column expressions; those whose rules aren't regular are Arrow UDFs."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlquilt.functions import STRING, record

# Query parameters that only track visits.
TRACKING = ["gclid", "fbclid", "yclid", "msclkid", "mc_eid", "mc_cid", "igshid", "_ga", "gbraid", "wbraid", "dclid", "ttclid"]
TRACKING_PREFIX = "utm_"

# Public suffixes of two parts.
TWO_PART_SUFFIXES = [
    "com.vn", "net.vn", "org.vn", "edu.vn", "gov.vn", "biz.vn", "info.vn", "name.vn",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "com.br", "com.cn", "com.tw", "co.kr",
    "com.sg", "com.my", "co.th", "co.id", "com.hk", "co.nz", "com.mx", "co.in",
]

#: scheme, user and host with port, path, query, fragment.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(F.trim(_col(url)), _PARTS, group)


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column | str) -> Column:
    """Host with port, lower-cased, without user."""
    return F.lower(F.regexp_replace(part(url, 2), "^.*@", ""))


def host(url: Column | str) -> Column:
    """Host without port, lower-cased; empty if there is none."""
    return F.regexp_replace(authority(url), ":[0-9]*$", "")


def path(url: Column | str) -> Column:
    return part(url, 3)


def without_default_port(url: Column | str) -> Column:
    a = authority(url)
    s = scheme(url)
    plain = ((s == "http") & a.endswith(":80")) | ((s == "https") & a.endswith(":443")) | a.endswith(":")
    return F.when(plain, F.regexp_replace(a, ":[0-9]*$", "")).otherwise(a)


def _kept_params(query: Column) -> Column:
    """Query parameters that don't track, by name, those of a name in their order."""
    name = lambda x: F.substring_index(x, "=", 1)
    lower = lambda x: F.lower(name(x))
    tracks = lambda x: lower(x).isin(TRACKING) | lower(x).startswith(TRACKING_PREFIX)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~tracks(x))
    keyed = F.transform(kept, lambda x, i: F.struct(name(x).alias("n"), i.alias("i"), F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))).alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), "&")


def frontier_key(url: Column | str, ignore_query: bool = False) -> Column:
    """The identity of a url in a crawl: scheme and host in lower case, no default port,
    fragment or tracking parameters, parameters by name. A url that can't be read is
    its own key, marked so that it never equals another's."""
    u = F.trim(_col(url))
    bare = F.concat(scheme(u), F.lit("://"), without_default_port(u), F.when(path(u) == "", "/").otherwise(path(u)))
    params = _kept_params(part(u, 4))
    key = bare if ignore_query else F.when(params == "", bare).otherwise(F.concat(bare, F.lit("?"), params))
    return F.when(host(u) == "", F.concat(F.lit("\x00"), u)).otherwise(key)


def redirect_key(url: Column | str) -> Column:
    """Identity of a url within a redirect chain: only letter case of scheme and host and the fragment are ignored."""
    u = F.trim(_col(url))
    known = part(u, 1) != ""
    query = F.when(u.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), part(u, 4))).otherwise("")
    return F.when(known, F.concat(scheme(u), F.lit("://"), F.lower(part(u, 2)), path(u), query)).otherwise(u)


def evidence_url(url: Column | str) -> Column:
    """The identity of a url in evidence: case of scheme and host, default port and
    empty path are normal; the query stays as it is, the fragment goes."""
    u = F.trim(_col(url))
    query = F.when(u.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), part(u, 4))).otherwise("")
    return F.concat(scheme(u), F.lit("://"), without_default_port(u), F.when(path(u) == "", "/").otherwise(path(u)), query)


def has_fragment(url: Column | str) -> Column:
    return _col(url).contains("#")


def registrable_host(h: Column) -> Column:
    """The host without ``www.``."""
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def root_domain(h: Column) -> Column:
    """The last two labels of a host, three if those two are a public suffix."""
    plain = F.regexp_replace(h, r"\.$", "")
    last2 = F.substring_index(plain, ".", -2)
    return F.when(last2.isin(TWO_PART_SUFFIXES) & (F.size(F.split(plain, r"\.")) >= 3), F.substring_index(plain, ".", -3)).otherwise(last2)


def same_site(seed_host: Column, other: Column, subdomains: bool = False) -> Column:
    a, b = registrable_host(seed_host), registrable_host(other)
    return (a == b) | (root_domain(a) == root_domain(b)) if subdomains else a == b


def url_extension(url: Column | str) -> Column:
    """Lower-case extension of the last path segment, without the dot; empty if none."""
    return F.lower(F.regexp_extract(path(url), r"\.([^./]*)$", 1))


def normalize_input(typed: Column | str) -> Column:
    """A typed line as an http(s) url, or null if it has another scheme or is blank."""
    t = F.trim(_col(typed))
    return (
        F.when(t == "", F.lit(None))
        .when(t.rlike("(?i)^https?://[^/?#]"), t)
        .when(t.startswith("//"), F.concat(F.lit("https:"), t))
        .when(t.rlike("(?i)^[a-z][a-z0-9+.-]*:") & ~t.rlike(r"^[^/:]+:[0-9]+([/?#]|$)"), F.lit(None))
        .otherwise(F.concat(F.lit("https://"), t))
    )


@F.pandas_udf(STRING)
def resolve_link(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` against ``base`` without its fragment; null unless it is http(s)."""

    def one(b: str | None, h: str | None) -> str | None:
        h = (h or "").strip()
        if not h or h.startswith("#"):
            return None
        try:
            whole = urljoin(b or "", h).partition("#")[0]
            split = urlsplit(whole)
            _ = split.port
        except ValueError:
            return None
        return whole if split.scheme.lower() in ("http", "https") and split.hostname else None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def _malformed(u: str) -> bool:
    """Whether a trimmed reference holds white space, or a host or port that can't be one."""
    try:
        split = urlsplit(u)
        _ = split.port
    except ValueError:
        return True
    return any(c.isspace() for c in u) or any(c in split.netloc for c in "<>\\^`{|}\"") or (split.netloc.endswith(":") and not split.hostname)


def _web(u: str) -> bool:
    """Whether ``u`` is a whole http(s) url."""
    if _malformed(u):
        return False
    split = urlsplit(u)
    return split.scheme.lower() in ("http", "https") and bool(split.hostname)


def _lacks_host(u: str) -> bool:
    return (bool(urlsplit(u).scheme) or u.startswith("//")) and not urlsplit(u).hostname


def _declared(page: str, base: str, bases: int, raw: str) -> tuple[str, str | None, str | None]:
    def because(status: str, reason: str) -> tuple[str, None, str]:
        return status, None, f"{status}:{reason}"

    if not raw:
        return because("parser_error", "empty_href")
    if _malformed(raw):
        return because("parser_error", "malformed_url")
    kind = urlsplit(raw).scheme.lower()
    if kind not in ("", "http", "https"):
        return because("resolution_error", "unsupported_scheme")
    if _lacks_host(raw):
        return because("resolution_error", "missing_host")
    against = page
    if not kind:
        if bases > 1 or not _web(page):
            return because("insufficient_evidence", "missing_base_context")
        if base and not base.startswith("#"):
            if _malformed(base):
                return because("insufficient_evidence", "ambiguous_base_fallback")
            if (of := urlsplit(base).scheme.lower()) not in ("", "http", "https"):
                flat = of == "blob" or not base[len(of) + 1 :].startswith("/")
                return because("resolution_error", "non_hierarchical_base" if flat else "unsupported_scheme")
            against = urljoin(page, base)
            if _lacks_host(base) or not _web(against):
                return because("insufficient_evidence", "ambiguous_base_fallback")
    whole = (raw if kind else urljoin(against, raw)).partition("#")[0]
    return ("valid", whole, None) if _web(whole) else because("resolution_error", "missing_host")


@F.pandas_udf(record(status=STRING, resolved=STRING, error=STRING))
def _classified(page: pd.Series, base: pd.Series, raw: pd.Series, bases: pd.Series) -> pd.DataFrame:
    text = lambda x: x.strip() if isinstance(x, str) else ""
    rows = [_declared(text(p), text(b), 0 if pd.isna(n) else int(n), text(r)) for p, b, r, n in zip(page, base, raw, bases, strict=True)]
    return pd.DataFrame(rows, columns=["status", "resolved", "error"])


def classify_canonical(page: Column | str, base: Column | str, raw: Column | str, bases: Column | None = None) -> Column:
    """Whether a declared canonical can be resolved, as (status, resolved, error): valid,
    parser_error, resolution_error or insufficient_evidence (relative, and the base that
    holds for it isn't known). ``bases`` is the number of base elements; null counts as
    none, and a blank or null page or base as one that isn't there. The error names
    status and reason."""
    return _classified(page, base, raw, F.lit(1) if bases is None else bases)


def dedupe(rows, url: str = "url", order: str = "seq"):
    """The first row of each url, letter case of scheme and host aside, in their order."""
    u = F.trim(F.col(url))
    key = F.when(part(u, 1) != "", F.concat(scheme(u), F.lit("://"), F.lower(part(u, 2)), F.regexp_replace(u, r"^[^:]*://[^/?#]*", ""))).otherwise(u)
    return rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("x")).select("x.*")
