"""robots.txt and sitemaps as sources: bodies in, rows out."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquilt.functions import STRING, record
from crawlquilt.functions.text import robots_pattern_regex

MOST_BYTES = 64 << 20
# Where sitemaps are looked for besides those that robots.txt names.
COMMON_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.xml.gz"]


def robots_groups(body: str) -> list[tuple[list[str], list[tuple[str, str]], str]]:
    """(agents, (allow or disallow, path) rules, crawl delay) of each group."""
    groups: list[tuple[list[str], list[tuple[str, str]], str]] = []
    agents: list[str] = []
    rules: list[tuple[str, str]] = []
    delay, said = "", False
    for line in body.splitlines():
        field, colon, value = (x.strip() for x in line.partition("#")[0].partition(":"))
        field = field.lower()
        if not colon:
            continue
        if field == "user-agent":
            if said:
                groups.append((agents, rules, delay))
                agents, rules, delay, said = [], [], "", False
            agents.append(value.lower())
        elif field in ("allow", "disallow") and agents:
            said = True
            if value:
                rules.append((field, value))
        elif field == "crawl-delay" and agents:
            said, delay = True, value
    if agents:
        groups.append((agents, rules, delay))
    return groups


def matched_rule(body: str, agent: str, path: str) -> tuple[bool, str]:
    """Whether an agent may fetch a path, and by which rule. Groups of the longest agent
    name that the agent begins with count, ``*`` only if none does; the longest rule wins, and
    allow wins a tie."""
    name = agent.lower()
    groups = robots_groups(body)
    fits = [a for agents, *_ in groups for a in agents if a != "*" and a and name.startswith(a)]
    chosen = max(fits, key=len) if fits else "*"
    rules = [r for agents, found, _ in groups if chosen in agents for r in found]
    best = None
    for kind, pattern in rules:
        if re.search(robots_pattern_regex(pattern), path):
            key = (len(pattern), kind == "allow")
            if best is None or key > best[0]:
                best = (key, f"{kind}: {pattern}")
    return (best is None or best[0][1], best[1] if best else "")


@F.pandas_udf(record(allowed=STRING, rule=STRING))
def robots_decision(status: pd.Series, body: pd.Series, agent: pd.Series, path: pd.Series) -> pd.DataFrame:
    """allowed: true, false or unknown. A 2xx body is read, 4xx allows all, else unknown."""
    rows = []
    for s, b, a, p in zip(status, body, agent, path, strict=True):
        if pd.isna(s) or not (200 <= s < 300 or 400 <= s < 500):
            rows.append(("unknown", ""))
        elif s >= 400:
            rows.append(("true", ""))
        else:
            ok, rule = matched_rule(b or "", a or "", p or "/")
            rows.append(("true" if ok else "false", rule))
    return pd.DataFrame(rows, columns=["allowed", "rule"])


def sitemap_lines(body: Column) -> Column:
    """The sitemaps that a robots.txt names."""
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*([^\r\n#]+)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def crawl_delay(body: Column) -> Column:
    return F.regexp_extract(body, r"(?im)^[ \t]*crawl-delay[ \t]*:[ \t]*([0-9.]+)", 1).try_cast("double")


def gunzipped(data: bytes, most: int) -> bytes:
    """The first ``most`` bytes that gzip members unpack to; no more are ever unpacked."""
    out = b""
    while data and len(out) < most:
        member = zlib.decompressobj(wbits=31)
        out += member.decompress(data, most - len(out))
        if not member.eof and len(out) < most:
            raise EOFError("gzip data ended early")
        data = member.unused_data.lstrip(b"\x00")
    return out


def parse_sitemap(data: bytes | None) -> tuple[str, str, str, list[dict]]:
    """(doc_type, parse_status, parse_error, entries) of a sitemap, gzip or not."""
    if data is None:
        return "unknown", "unavailable", "", []
    try:
        if data[:2] == b"\x1f\x8b":
            data = gunzipped(data, MOST_BYTES)
        data = data[:MOST_BYTES]
        if not data.strip():
            return "unknown", "empty_input", "", []
        root = ElementTree.fromstring(data)
    except (ElementTree.ParseError, EOFError, ValueError, zlib.error) as e:
        return "unknown", "xml_error", str(e)[:200], []
    name = lambda e: e.tag.rpartition("}")[2].lower()
    kind = name(root)
    if kind not in ("urlset", "sitemapindex"):
        return "unknown", "unsupported_structure", f"root element {kind}", []
    entries = []
    for e in root:
        if name(e) in ("url", "sitemap"):
            values = {name(c): (c.text or "").strip() for c in e}
            entries.append({k: values.get(k, "") for k in ("loc", "lastmod", "changefreq", "priority")})
    return kind, "parsed", "", entries


def sitemaps(bodies: DataFrame) -> DataFrame:
    """url, doc_type, parse_status, parse_error, entries of (url, body as binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(u, *parse_sitemap(None if b is None else bytes(b))) for u, b in zip(df["url"], df["body"], strict=True)]
            yield pd.DataFrame(rows, columns=["url", "doc_type", "parse_status", "parse_error", "entries"])

    return bodies.select("url", "body").mapInPandas(run, "url string, doc_type string, parse_status string, parse_error string, entries array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>")


def sitemap_entries(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("doc_type") == "urlset").select(F.col("url").alias("sitemap"), F.posexplode("entries").alias("seq", "e")).select("sitemap", "seq", "e.*")
