"""HTML as a source: one pass over the tokens of a page gives its document columns.

The parser is the standard library's; batches come and go as Arrow. All caps are part
of the result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How many of each thing a document keeps.
MOST = {"titles": 5, "meta_descs": 5, "h1s": 10, "h2s": 10, "h3s": 10, "canonicals": 5, "anchors": 5000, "images": 500, "css": 200, "js": 200, "json_ld": 20, "microdata": 40}
ANCHOR_TEXT = 100
SCRIPT_TEXT = 256 << 10
# Labels of links to a next page.
NEXT_LABELS = ("next page", "go to next page")
# Attributes that say where a control leads.
TARGETS = ("data-href", "data-url", "data-route", "data-target", "data-link")
# Crawlers that a robots meta element may be for.
AGENTS = {
    "googlebot", "googlebot-news", "googlebot-image", "googlebot-video", "adsbot-google", "adsbot-google-mobile", "mediapartners-google", "apis-google", "google-extended",
    "bingbot", "adidxbot", "msnbot", "oai-searchbot", "oaisearchbot", "gptbot", "chatgpt-user", "claudebot", "anthropic-ai", "perplexitybot", "applebot", "applebot-extended",
    "slurp", "duckduckbot", "baiduspider", "yandex", "facebookexternalhit", "meta-externalagent", "twitterbot", "linkedinbot", "bytespider", "ccbot",
}
SILENT = ("script", "style", "noscript", "template")

_WORD = re.compile(r"[^\W]+", re.UNICODE)
_SPACE = re.compile(r"\s+")
#: A path or url in quotes, in the code of a control.
_IN_CODE = re.compile(r"""['"](/[^'"\s]*|https?://[^'"\s]+)['"]""")
# What analytics scripts are known by.
DETECTORS = {"ga4_id": r"G-[A-Z0-9]{6,}", "gtm_id": r"GTM-[A-Z0-9]{4,}"}
TOOLS = {"google_analytics": ["google-analytics.com", "googletagmanager.com/gtag"], "facebook_pixel": ["connect.facebook.net", "fbq("], "hotjar": ["static.hotjar.com", "hjid"], "mixpanel": ["cdn.mxpnl.com", "mixpanel.init"]}

DOCUMENT = """
titles array<string>, meta_descs array<string>, h1s array<string>, h2s array<string>, h3s array<string>,
canonicals array<string>, raw_canonicals array<string>, canonical_count int, robots_meta array<struct<name:string,content:string>>, meta_robots string,
meta_tags map<string,string>, og_tags map<string,string>, twitter_tags map<string,string>, meta_refresh string, charset string, lang string, viewport string,
hreflang array<struct<lang:string,url:string>>, next_url string, prev_url string, next_tag string, next_conflict boolean, paged boolean, base_href string, base_count int,
anchors array<struct<href:string,text:string,rel:string,placement:int,flags:int>>, images array<struct<src:string,alt:string>>, css array<string>, js array<string>,
json_ld array<string>, microdata array<string>, word_count int, main_text_words int, text_ratio double, data_nosnippet_count int, analytics map<string,string>,
nav_candidates array<struct<tag:string,target:string>>
"""


def squash(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class Extractor(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=False)
        self.url, self.base, self.base_count = url, None, 0
        self.stack: list[tuple[str, str]] = []
        self.lists: dict[str, list] = {k: [] for k in MOST}
        self.raw_canonicals: list[str] = []
        self.canonical_count = 0
        self.robots: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.og: dict[str, str] = {}
        self.twitter: dict[str, str] = {}
        self.refresh = self.charset = self.lang = self.viewport = ""
        self.hreflang: list[tuple[str, str]] = []
        self.next = self.prev = self.next_tag = self.next_href = ""
        self.next_conflict = self.paged = False
        self.words = self.main_words = self.nosnippet = self.text_bytes = self.all_bytes = 0
        self.scripts: list[str] = []
        self.script_size = 0
        self.nav: list[tuple[str, str]] = []
        self.open: list[dict] = []  # elements whose text is gathered

    def where(self) -> int:
        """0 body, 1 nav, 2 footer, 3 header, by the elements around."""
        if any(p == "footer" for _, p in self.stack):
            return 2
        for _, p in reversed(self.stack):
            if p in ("nav", "header"):
                return 1 if p == "nav" else 3
        return 0

    @staticmethod
    def place(tag: str, a: dict[str, str]) -> str:
        hints = f"{a.get('class', '')} {a.get('id', '')}".lower()
        for name, tags, words in (("footer", ("footer",), ("footer",)), ("nav", ("nav", "menu"), ("nav", "menu")), ("header", ("header",), ("header",))):
            if tag in tags or any(w in hints for w in words):
                return name
        return ""

    def keep(self, kind: str, value) -> None:
        if len(self.lists[kind]) < MOST[kind]:
            self.lists[kind].append(value)

    def resolve(self, href: str) -> str:
        href = href.strip()
        if not href or href.startswith("#"):
            return ""
        try:
            whole = urljoin(urljoin(self.url, self.base or ""), href).partition("#")[0]
            parts = urlsplit(whole)
            return whole if parts.scheme in ("http", "https") and parts.hostname else ""
        except ValueError:
            return ""

    def silent(self) -> bool:
        return any(t in SILENT for t, _ in self.stack)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.all_bytes += len((self.get_starttag_text() or "").encode("utf-8", "replace"))
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        getattr(self, f"on_{tag}", lambda a: None)(a)
        if "data-nosnippet" in a and not self.silent():
            self.nosnippet += 1
        if "itemscope" in a:
            self.keep("microdata", a.get("itemtype", ""))
        if tag in ("title", "h1", "h2", "h3"):
            self.open.append({"tag": tag, "kind": f"{tag}s", "text": []})
        if tag in ("a", "button", "span", "div", "li"):
            self.paginate(tag, a)
            if self.where() in (1, 3) and (target := self.leads_to(tag, a)):
                self.nav.append((tag, self.resolve(target)))
        if tag not in ("meta", "link", "img", "br", "hr", "input", "base", "source", "area", "col", "embed", "wbr"):
            self.stack.append((tag, self.place(tag, a)))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def paginate(self, tag: str, a: dict[str, str]) -> None:
        """The element that leads to the next page: the first link, else the first control."""
        rel, href = a.get("rel", "").lower().split(), a.get("href", "").strip()
        self.paged |= "prev" in rel or "previous" in rel
        if "next" not in rel and "data-next-page" not in a and squash(a.get("aria-label", "")).lower() not in NEXT_LABELS:
            return
        self.paged = True
        if tag == "a":
            self.next = self.next or self.resolve(href)
            self.next_conflict |= self.next_tag == "a" and "" not in (href, self.next_href) and href != self.next_href
        if not self.next_tag or (tag == "a" and self.next_tag != "a"):
            self.next_tag, self.next_href = tag, href

    @staticmethod
    def leads_to(tag: str, a: dict[str, str]) -> str:
        """Where a control leads that isn't a link a crawler follows; empty if nowhere."""
        href = a.get("href", "").strip()
        script = href.lower().startswith("javascript:")
        if tag == "a" and href and not script and not href.startswith("#"):
            return ""
        said = next((v for k in TARGETS if (v := a.get(k, "").strip())), "")
        for code in (href if script else "", a.get("onclick", "")):
            if not said and (m := _IN_CODE.search(code)):
                said = m[1]
        return "" if said.startswith("#") else said

    def on_html(self, a: dict[str, str]) -> None:
        self.lang = self.lang or a.get("lang", "").strip()

    def on_base(self, a: dict[str, str]) -> None:
        if "href" in a:
            self.base_count += 1
            if self.base is None:
                self.base = a["href"].strip()

    def on_meta(self, a: dict[str, str]) -> None:
        content = a.get("content", "").strip()
        if "charset" in a:
            self.charset = self.charset or a["charset"].strip()
        name, equiv, prop = (a.get(k, "").strip().lower() for k in ("name", "http-equiv", "property"))
        if equiv == "refresh":
            self.refresh = self.refresh or content
        elif equiv == "content-language":
            self.lang = self.lang or content
        elif equiv == "content-type" and "charset=" in content.lower():
            self.charset = self.charset or content.lower().partition("charset=")[2]
        if prop.startswith("og:"):
            self.og.setdefault(prop, content)
        if name.startswith("twitter:") or prop.startswith("twitter:"):
            self.twitter.setdefault(name or prop, content)
        if name == "description" and content:
            self.keep("meta_descs", squash(content))
        if name == "robots" or name in AGENTS or name.startswith(("googlebot-", "googlebot_")):
            self.robots.append((name, content))
        if name == "viewport":
            self.viewport = self.viewport or content
        if name:
            self.meta.setdefault(name, content)

    def on_link(self, a: dict[str, str]) -> None:
        rel, href = a.get("rel", "").lower().split(), a.get("href", "").strip()
        if "canonical" in rel:
            self.canonical_count += 1
            if len(self.raw_canonicals) < MOST["canonicals"]:
                self.raw_canonicals.append(href)
            if href and (u := self.resolve(href)):
                self.keep("canonicals", u)
        if "stylesheet" in rel and (u := self.resolve(href)):
            self.keep("css", u)
        if "next" in rel:
            self.next = self.next or self.resolve(href)
        if "prev" in rel:
            self.prev = self.prev or self.resolve(href)
        if "alternate" in rel and a.get("hreflang"):
            self.hreflang.append((a["hreflang"].strip(), self.resolve(href)))

    def on_a(self, a: dict[str, str]) -> None:
        self.open.append({"tag": "a", "kind": "anchors", "text": [], "href": self.resolve(a.get("href", "")), "rel": a.get("rel", ""), "place": self.where(), "alt": ""})

    def on_img(self, a: dict[str, str]) -> None:
        src = next((v for k in ("src", "data-src", "data-lazy-src", "data-original") if (v := a.get(k, "").strip()) and not v.startswith("data:")), "")
        src = src or a.get("srcset", "").split(",")[0].strip().split(" ")[0]
        alt = squash(a.get("alt", ""))
        for e in self.open:
            if e["tag"] == "a" and not e["alt"]:
                e["alt"] = alt
        if src and (u := self.resolve(src)):
            self.keep("images", (u, alt))

    def on_script(self, a: dict[str, str]) -> None:
        if a.get("src") and (u := self.resolve(a["src"])):
            self.keep("js", u)
            self.scripts.append(a["src"])
        self.open.append({"tag": "script", "kind": "json_ld" if "ld+json" in a.get("type", "").lower() else "script", "text": []})

    def handle_endtag(self, tag: str) -> None:
        self.all_bytes += len(tag) + 3
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                self.close_one(self.open.pop(k))
                break

    def close_one(self, e: dict) -> None:
        text = squash("".join(e["text"]))
        if e["kind"] == "anchors":
            if e["href"]:
                rel = e["rel"].lower().split()
                flags = (2 if "nofollow" in rel else 0) + (4 if "ugc" in rel else 0) + (8 if "sponsored" in rel else 0)
                self.keep("anchors", (e["href"], unescape(text or e["alt"])[:ANCHOR_TEXT], e["rel"], e["place"], flags))
        elif e["kind"] == "json_ld":
            self.keep("json_ld", "".join(e["text"]))
        elif e["kind"] == "script":
            if self.script_size < SCRIPT_TEXT:
                self.scripts.append("".join(e["text"])[: SCRIPT_TEXT - self.script_size])
                self.script_size += len(self.scripts[-1])
        elif text:
            self.keep(e["kind"], unescape(text))

    def handle_data(self, data: str) -> None:
        size = len(data.encode("utf-8", "replace"))
        self.all_bytes += size
        for e in self.open:
            e["text"].append(data)
        if not self.silent():
            n = len(_WORD.findall(data))
            self.words += n
            self.text_bytes += size
            tags = [t for t, _ in self.stack]
            if "title" not in tags and "button" not in tags and self.where() == 0:
                self.main_words += n

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")

    def handle_comment(self, data: str) -> None:
        self.all_bytes += len(data.encode("utf-8", "replace")) + 7

    def document(self) -> dict:
        while self.open:
            self.close_one(self.open.pop())
        code = "\n".join(self.scripts)
        found = {k: m.group() for k, p in DETECTORS.items() if (m := re.search(p, code))}
        found |= {k: "true" for k, words in TOOLS.items() if any(w in code for w in words)}
        robots = [c for n, c in self.robots if n in ("robots", "googlebot") and c]
        return {
            **{k: self.lists[k] for k in ("titles", "meta_descs", "h1s", "h2s", "h3s", "canonicals", "css", "js", "json_ld", "microdata")},
            "raw_canonicals": self.raw_canonicals, "canonical_count": self.canonical_count, "robots_meta": [{"name": n, "content": c} for n, c in self.robots], "meta_robots": ", ".join(robots),
            "meta_tags": self.meta, "og_tags": self.og, "twitter_tags": self.twitter, "meta_refresh": self.refresh, "charset": self.charset, "lang": self.lang, "viewport": self.viewport,
            "hreflang": [{"lang": k, "url": u} for k, u in self.hreflang], "next_url": self.next, "prev_url": self.prev, "next_tag": self.next_tag, "next_conflict": self.next_conflict, "paged": self.paged, "base_href": self.base or "", "base_count": self.base_count,
            "anchors": [dict(zip(("href", "text", "rel", "placement", "flags"), x, strict=True)) for x in self.lists["anchors"]], "images": [{"src": s, "alt": t} for s, t in self.lists["images"]],
            "word_count": self.words, "main_text_words": self.main_words, "text_ratio": self.text_bytes / self.all_bytes if self.all_bytes else 0.0, "data_nosnippet_count": self.nosnippet, "analytics": found,
            "nav_candidates": [{"tag": t, "target": u} for t, u in self.nav],
        }


def extract(html: str | None, url: str) -> dict:
    parser = Extractor(url or "")
    parser.feed(html or "")
    parser.close()
    return parser.document()


def documents(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` (with ``url``) and the document columns of its HTML, which is dropped."""
    kept = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html) + "," + DOCUMENT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = pd.DataFrame([extract(h, u) for h, u in zip(df[html], df["url"], strict=True)])
            yield pd.concat([df[kept].reset_index(drop=True), found], axis=1)

    return pages.mapInPandas(run, schema)


def facts(docs: DataFrame) -> DataFrame:
    """The columns that grids and rules read, from document columns."""
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return docs.withColumns({
        "title": first("titles"), "title_count": F.size("titles"), "meta_desc": first("meta_descs"), "meta_count": F.size("meta_descs"), "h1": first("h1s"), "h1_count": F.size("h1s"),
        "h2": first("h2s"), "h2_count": F.size("h2s"), "canonical": first("canonicals"), "images_count": F.size("images"), "image_alts": F.transform("images", lambda i: i["alt"]),
        "images_noalt": F.size(F.filter("images", lambda i: F.trim(i["alt"]) == "")), "has_og": F.size(F.map_keys("og_tags")) > 0, "has_twitter": F.size(F.map_keys("twitter_tags")) > 0,
        "has_structured_data": (F.size("json_ld") > 0) | (F.size("microdata") > 0),
    }).withColumns({"title_len": F.char_length("title"), "meta_desc_len": F.char_length("meta_desc"), "h1_len": F.char_length("h1")})


def kind_of(content_type, url):
    """The kind of a resource by its content type, else by its extension."""
    from crawlquilt.functions.urls import url_extension

    mt, ext = F.lower(F.trim(F.substring_index(content_type, ";", 1))), url_extension(url)
    return (
        F.when(mt.isin("text/html", "application/xhtml+xml"), "html").when(mt.startswith("image/"), "image").when(mt == "text/css", "css").when(mt == "application/pdf", "pdf")
        .when(mt.startswith("font/") | mt.isin("application/font-woff", "application/vnd.ms-fontobject", "application/x-font-ttf"), "font").when(mt.startswith("video/") | mt.startswith("audio/"), "media")
        .when(mt.isin("application/javascript", "text/javascript", "application/x-javascript", "module"), "js").when(ext.isin("html", "htm", "php", "asp", "aspx", "jsp", "shtml", ""), "html")
        .when(ext == "css", "css").when(ext.isin("js", "mjs", "cjs"), "js").when(ext == "pdf", "pdf").when(ext.isin("jpg", "jpeg", "png", "gif", "webp", "svg", "avif", "bmp", "ico", "tif", "tiff"), "image")
        .when(ext.isin("woff", "woff2", "ttf", "otf", "eot"), "font").when(ext.isin("mp4", "webm", "mp3", "wav", "ogg", "mov", "avi", "m4a", "m4v"), "media").otherwise("other")
    )


def compare_renders(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """run_id, url_id and, for title, canonicals, robots, h1s and anchors, whether
    rendering changed them; both sides have document columns."""
    keys = ["run_id", "url_id"]
    fields = ["titles", "canonicals", "meta_robots", "h1s"]
    side = lambda df, s: df.select(*keys, *(F.col(f).alias(f"{s}_{f}") for f in fields), F.array_distinct(F.transform("anchors", lambda a: a["href"])).alias(f"{s}_links"))
    both = side(raw, "raw").join(side(rendered, "rendered"), keys)
    differ = [(~F.col(f"raw_{f}").eqNullSafe(F.col(f"rendered_{f}"))).alias(f"{f}_changed") for f in fields]
    links = [F.size(F.array_except("rendered_links", "raw_links")).alias("links_added"), F.size(F.array_except("raw_links", "rendered_links")).alias("links_removed")]
    return both.select(*keys, *differ, *links)
