"""String, robots and JSON functions as column expressions; the sequential ones are Arrow UDFs."""

from __future__ import annotations

import json
import re
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlquilt.functions import STRING, STRINGS, record


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: Column | str) -> Column:
    """White space runs of any script as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def norm(c: Column | str) -> Column:
    return F.lower(squash(c))


def truncate(c: Column | str, n: int = 100) -> Column:
    return F.left(_col(c), F.lit(n))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(r"[\p{L}\p{N}_]+"))


def robots_has_token(directives: Column | str, want: str) -> Column:
    """Whether a comma-separated directive list holds a token, agent prefixes aside."""

    def token(x: Column) -> Column:
        t = F.trim(F.lower(x))
        head = F.substring_index(t, ":", 1)
        return F.when(t.contains(":") & ~head.contains("_"), F.trim(F.regexp_replace(t, "^[^:]*:", ""))).otherwise(t)

    return F.coalesce(F.exists(F.split(_col(directives), ","), lambda x: token(x) == want), F.lit(False))


def rel_flags(rel: Column | str) -> Column:
    """Bits of nofollow, ugc and sponsored in a rel attribute."""
    tokens = F.split(F.lower(_col(rel)), r"\s+")
    bit = lambda word, n: F.when(F.array_contains(tokens, word), n).otherwise(0)
    return F.coalesce(bit("nofollow", 2) + bit("ugc", 4) + bit("sponsored", 8), F.lit(0))


def valid_lang_code(code: Column | str) -> Column:
    """x-default, or a language of 2 or 3 letters with up to two regions or scripts."""
    c = F.lower(F.trim(_col(code)))
    return F.coalesce(c.rlike(r"^(x-default|[a-z]{2,3}(-([a-z]{2}|[0-9]{2}|[0-9]{3}|[a-z]{4})){0,2})$"), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A regular expression for a pattern in which ``*`` stands for anything."""
    return "".join(".*" if c == "*" else re.escape(c) for c in pattern)


def excluded(url_path: Column, query: Column, patterns: list[str]) -> Column:
    """Whether a path matches a pattern whole; where a pattern has a ``?`` or ``&``, also
    the path with its query, and the query alone for those like ``?x=*``. Blank patterns and
    those after ``#`` count for nothing, an empty path is ``/``, a null one is not excluded."""
    kept = [p for x in patterns if (p := x.strip()) and not p.startswith("#")]
    if not kept:
        return F.lit(False)
    whole = "(?s)^(?:" + "|".join(glob_regex(p) for p in kept) + r")\z"
    place = F.when(url_path == "", "/").otherwise(url_path)
    hit = place.rlike(whole)
    if any(c in p for p in kept for c in "?&"):
        asked = F.concat(F.lit("?"), F.coalesce(query, F.lit("")))
        alone = [re.escape(p[:-1]) for p in kept if p.startswith("?") and p.find("*") == len(p) - 1]
        hit = hit | ((asked != "?") & (F.concat(place, asked).rlike(whole) | (asked.rlike("^(?:" + "|".join(alone) + ")") if alone else F.lit(False))))
    return F.coalesce(hit, F.lit(False))


def robots_pattern_regex(pattern: str) -> str:
    """A robots.txt path: ``*`` stands for anything, a final ``$`` ends it, else it is a prefix."""
    end = pattern.endswith("$")
    return "^" + glob_regex(pattern[:-1] if end else pattern) + ("$" if end else "")


def content_fingerprint(title: Column, meta: Column, h1: Column, words: Column) -> Column:
    return F.sha2(F.concat_ws("|", title, meta, F.array_join(h1, ","), words.cast("string")), 256)


def csv_guard(c: Column) -> Column:
    """Cells that a spreadsheet would take for a formula, with a quote before them."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def xml_name(name: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_.-]", "_", name) or "_"
    return clean if re.match(r"[A-Za-z_]", clean) else "_" + clean


def search_tokens(search: str) -> list[str]:
    """Search words: every one must be the prefix of a word of the page."""
    return [t for t in re.split(r"[ \t/\-_?&=]+", search.strip()) if t]


# Fetch errors in the words of the evidence.
FETCH_ERRORS = {"dns-not-found": "DNS_ERROR", "timeout": "TIMEOUT", "connection-refused": "CONNECTION_ERROR", "connection-error": "CONNECTION_ERROR", "ssl-error": "TLS_ERROR"}


def normalize_fetch_error(error: Column) -> Column:
    """The evidence's word for a fetch error; empty for one that it has none for."""
    pairs = [x for kv in FETCH_ERRORS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), error), F.lit(""))


@F.pandas_udf(record(status=STRING, error=STRING))
def parse_json_ld(raw: pd.Series) -> pd.DataFrame:
    """Strict JSON: one value and nothing after it. EMPTY_INPUT, PARSE_SUCCESS or PARSE_ERROR."""

    def refuse(x: str):
        raise ValueError(f"invalid literal {x}")

    def one(x: str | None) -> tuple[str, str | None]:
        text = (x or "").lstrip("﻿").strip()
        if not text:
            return "EMPTY_INPUT", None
        try:
            json.loads(text, parse_constant=refuse)
        except (ValueError, RecursionError) as e:
            return "PARSE_ERROR", str(e)[:200]
        return "PARSE_SUCCESS", None

    return pd.DataFrame([one(x) for x in raw], columns=["status", "error"])


# Robots directives.
PLAIN_DIRECTIVES = ["all", "none", "index", "noindex", "follow", "nofollow", "noarchive", "nosnippet", "noimageindex", "notranslate", "indexifembedded"]
VALUED_DIRECTIVES = ["max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"]
_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def directive_tokens(content: str) -> list[str]:
    """A directive list at its commas; the comma in a date of unavailable_after doesn't part."""
    out: list[str] = []
    for piece in content.split(","):
        last = out[-1].lower() if out else ""
        if last.startswith("unavailable_after:") and last.partition(":")[2].strip() in _DAYS:
            out[-1] += "," + piece
        else:
            out.append(piece.strip())
    return [t for t in out if t]


def judge_directive(token: str) -> str:
    """valid, unsupported or parse_error."""
    t = token.lower()
    if t in PLAIN_DIRECTIVES:
        return "valid"
    name, colon, value = (x.strip() for x in t.partition(":"))
    if name not in VALUED_DIRECTIVES:
        return "parse_error" if ";" in t or (" " in t and not colon) else "unsupported"
    if not colon or not value:
        return "parse_error"
    if name in ("max-snippet", "max-video-preview"):
        return "valid" if re.fullmatch(r"-1|[0-9]+", value) else "parse_error"
    if name == "max-image-preview":
        return "valid" if value in ("none", "standard", "large") else "parse_error"
    return "valid" if _is_date(token.partition(":")[2].strip()) else "parse_error"


def _is_date(value: str) -> bool:
    """Dates as in mail headers or ISO 8601, and a few that authors write."""
    try:
        return parsedate_to_datetime(value) is not None
    except (TypeError, ValueError):
        return bool(pd.notna(pd.to_datetime(value, errors="coerce", utc=True)))


@F.pandas_udf(record(tokens=STRINGS, unsupported=STRINGS, errors=STRINGS))
def parse_directives(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        by: dict[str, list[str]] = {"valid": [], "unsupported": [], "parse_error": []}
        for t in directive_tokens(c or ""):
            by[judge_directive(t)].append(t.lower())
        rows.append((by["valid"], by["unsupported"], by["parse_error"]))
    return pd.DataFrame(rows, columns=["tokens", "unsupported", "errors"])


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, a double; to format it is the reader's business."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)
