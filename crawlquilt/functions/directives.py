"""Robots directives of pages and headers, by the agent that they are for.

A header is read from left to right, so this is an Arrow UDF: which agent a part belongs
to depends on the parts before it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from crawlquilt.functions import STRING, STRINGS, record
from crawlquilt.functions.text import PLAIN_DIRECTIVES, VALUED_DIRECTIVES, directive_tokens, judge_directive

# Agents whose directives count, and other crawlers that are known.
SUPPORTED_AGENTS = ["googlebot", "oai-searchbot", "gptbot"]
OTHER_AGENTS = ["bingbot", "slurp", "duckduckbot", "baiduspider", "yandexbot", "yandex", "applebot", "googlebot-news", "googlebot-image", "googlebot-video", "adsbot-google", "mediapartners-google", "facebookexternalhit", "twitterbot", "linkedinbot", "ccbot", "claudebot", "perplexitybot", "amazonbot", "bytespider"]
ANY = "*"

BUNDLE = ArrayType(record(agent=STRING, tokens=STRINGS, errors=STRINGS, unknown_scope=STRING))


def _judged(tokens: list[str]) -> tuple[list[str], list[str]]:
    errors = []
    for t in tokens:
        verdict = judge_directive(t)
        if verdict == "unsupported":
            errors.append(f"unsupported_directive:{t.lower()}")
        elif verdict == "parse_error":
            errors.append(f"parse_error:{t.lower()}")
    return [t.lower() for t in tokens], errors


def meta_bundle(name: str, content: str | None) -> tuple | None:
    """The directives of a robots meta element; None if it is blank, an error if it has no content."""
    agent = ANY if name.lower() == "robots" else name.lower()
    if content is None:
        return agent, [], ["parse_error:missing_content"], "false"
    tokens = directive_tokens(content)
    if not tokens:
        return None
    found, errors = _judged(tokens)
    return agent, [t for t in found if judge_directive(t) == "valid"], errors, "false"


def header_bundles(header: str, joined: bool) -> list[tuple]:
    """The directives of an X-Robots-Tag header, one bundle for each part of it.

    An agent's name stands before a colon. In a header of its own it holds until the
    next; where several headers were joined, what follows without a name could be any
    header's, so its scope is unknown."""
    out, agent, named = [], ANY, False
    for part in directive_tokens(header):
        head, colon, rest = (x.strip() for x in part.partition(":"))
        name = head.lower()
        unclear = ""
        if not colon or name in VALUED_DIRECTIVES or name in PLAIN_DIRECTIVES:
            target, tokens = agent, [part]
            if colon and name in PLAIN_DIRECTIVES and not joined:
                target = agent = ANY
            if joined:
                target, unclear = ANY, "ambiguous:joined_header_continuation" if named else ""
        elif name in SUPPORTED_AGENTS or name in OTHER_AGENTS:
            if not joined and named and agent not in (ANY, name):
                unclear = "ambiguous:multiple_agent_prefixes"
            target, tokens, agent, named = name, [rest] if rest else [], name, True
            if not rest:
                out.append((target, [], ["parse_error:missing_directive_after_prefix"], "false"))
                continue
        else:
            target, tokens, named = ANY, [rest or head], True
            unclear = "ambiguous:unverified_agent_prefix" if name.replace("-", "").isalnum() and "bot" in name else "ambiguous:unrecognized_colon_pair"
        found, errors = _judged(tokens)
        if unclear and not errors:
            errors = [unclear]
        out.append((target, found, errors, "true" if unclear else "false"))
    return out


@F.pandas_udf(BUNDLE)
def directive_bundles(names: pd.Series, contents: pd.Series, headers: pd.Series) -> pd.Series:
    """Bundles of a page: of its meta elements, in their order, then of its headers. A
    single header is its own; several are each their own."""
    rows = []
    for n, c, h in zip(names, contents, headers, strict=True):
        found = [b for x, y in zip([] if n is None else n, [] if c is None else c, strict=True) if (b := meta_bundle(x or "", y))]
        for header in [] if h is None else h:
            found += header_bundles(header or "", False)
        rows.append([dict(zip(("agent", "tokens", "errors", "unknown_scope"), b, strict=True)) for b in found])
    return pd.Series(rows)
