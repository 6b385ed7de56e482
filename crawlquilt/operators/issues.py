"""The per-page issue engine: every rule is a column, one explode makes the rows.

A page needs url, kind, is_internal, status, error_type, robots_state, and what the
rules below read; columns that a crawl doesn't have count as healthy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquilt import schema as S
from crawlquilt.functions.text import excluded, robots_has_token
from crawlquilt.functions.urls import frontier_key, part, path

# The limits of reports.
TITLE_MAX, TITLE_MIN, META_MAX, META_MIN, H1_MAX, THIN_WORDS, ALT_MAX = 60, 30, 160, 120, 70, 300, 100
SLOW_MS, MODERATE_MS, LARGE_BYTES, MODERATE_BYTES, LOW_TEXT_RATIO = 3000, 1000, 3 << 20, 1 << 20, 0.10

# Errors that are issues of the same name.
FETCH_ISSUES = ["dns-not-found", "connection-refused", "timeout", "ssl-error", "connection-error"]
#: Errors that are no issue.
SILENT_ERRORS = ["file-too-large", "cancelled"]
# Paths and queries whose pages get no issues by default.
DEFAULT_EXCLUSIONS = [
    "/wp-admin/*", "/wp-content/plugins/*", "/wp-content/themes/*", "/wp-content/uploads/*", "/wp-includes/*", "/wp-login.php", "/wp-cron.php", "/xmlrpc.php", "/wp-json/*",
    "/wp-activate.php", "/wp-signup.php", "/wp-trackback.php",
    "/login*", "/signin*", "/sign-in*", "/log-in*", "/auth/*", "/authenticate/*", "/register*", "/signup*", "/sign-up*", "/registration/*", "/logout*", "/signout*", "/sign-out*",
    "/log-out*", "/forgot-password*", "/reset-password*", "/password-reset*", "/recover-password*", "/change-password*", "/account/password/*", "/user/password/*", "/activate/*",
    "/verification/*", "/verify/*", "/confirm/*",
    "/admin/*", "/administrator/*", "/_admin/*", "/backend/*", "/dashboard/*", "/cpanel/*", "/phpmyadmin/*", "/pma/*", "/webmail/*", "/plesk/*", "/control-panel/*", "/manage/*", "/manager/*",
    "/checkout/*", "/cart/*", "/basket/*", "/payment/*", "/billing/*", "/order/*", "/orders/*", "/purchase/*",
    "/account/*", "/profile/*", "/settings/*", "/preferences/*", "/my-account/*", "/user/*", "/member/*", "/members/*",
    "/cgi-bin/*", "/cgi/*", "/fcgi-bin/*",
    "/.git/*", "/.svn/*", "/.hg/*", "/.bzr/*", "/.cvs/*", "/.env", "/.env.*", "/.htaccess", "/.htpasswd", "/web.config", "/app.config", "/composer.json", "/package.json",
    "/node_modules/*", "/vendor/*", "/bower_components/*", "/jspm_packages/*", "/includes/*", "/lib/*", "/libs/*", "/src/*", "/dist/*", "/build/*", "/builds/*", "/_next/*", "/.next/*",
    "/out/*", "/_nuxt/*", "/.nuxt/*",
    "/test/*", "/tests/*", "/spec/*", "/specs/*", "/__tests__/*", "/debug/*", "/dev/*", "/development/*", "/staging/*",
    "/api/internal/*", "/api/admin/*", "/api/private/*",
    "/private/*", "/system/*", "/core/*", "/internal/*", "/tmp/*", "/temp/*", "/cache/*", "/logs/*", "/log/*", "/backup/*", "/backups/*", "/old/*", "/archive/*", "/archives/*",
    "/config/*", "/configs/*", "/configuration/*",
    "/upload/*", "/uploads/*", "/uploader/*", "/file-upload/*",
    "/search*", "*/search/*", "?s=*", "?search=*", "*/filter/*", "?filter=*", "*/sort/*", "?sort=*",
    "/print/*", "?print=*", "/preview/*", "?preview=*", "/embed/*", "?embed=*", "/amp/*", "/amp",
    "/feed/*", "/feeds/*", "/rss/*", "*.rss", "/atom/*", "*.atom",
    "*.json", "*.xml", "*.yaml", "*.yml", "*.toml", "*.ini", "*.conf", "*.log", "*.txt", "*.csv", "*.sql", "*.db", "*.bak", "*.backup", "*.old", "*.orig", "*.tmp", "*.swp", "*.map",
    "*.min.js", "*.min.css",
]


def indexability(url: Column) -> Column:
    """Why a page isn't indexable, the first reason that holds; empty if it is."""
    noindex = robots_has_token("meta_robots", "noindex") | robots_has_token("x_robots", "noindex")
    klass = F.expr("status div 100")
    other = (F.col("canonical") != "") & (frontier_key("canonical") != frontier_key(url))
    return (
        F.when(F.col("robots_state") == "blocked", "blocked-by-robots")
        .when(noindex, "noindex")
        .when(klass == 3, "redirected")
        .when(klass != 2, "non-200")
        .when(other, "canonicalised")
        .otherwise("")
    )


def evaluate(pages: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """run_id, url_id, code, category, severity, detail and pos: its place among the issues
    of its page, most severe first."""
    have = set(pages.columns)

    def col(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    empty = lambda name: col(name, "-") == ""
    n = lambda name: col(name, 1)
    text = lambda name: F.char_length(col(name, ""))
    status, error = F.col("status"), F.col("error_type")
    failed = error.isin(FETCH_ISSUES)
    silent = error.isin(SILENT_ERRORS)
    dead = failed | silent | (status == 0)
    answered = ~dead
    page = answered & (F.col("kind") == "html") & F.col("is_internal") & (F.expr("status div 100") == 2)
    title, meta = text("title"), text("meta_desc")
    noindex = robots_has_token(col("meta_robots", ""), "noindex") | robots_has_token(col("x_robots", ""), "noindex")
    nofollow = robots_has_token(col("meta_robots", ""), "nofollow") | robots_has_token(col("x_robots", ""), "nofollow")
    ms, size, ratio = n("response_ms"), n("size_bytes"), col("text_ratio", 1.0)
    alts = F.col("image_alts") if "image_alts" in have else F.lit(None).cast("array<string>")
    no_alt = F.coalesce(F.exists(alts, lambda a: F.trim(a) == ""), F.lit(False)) | (col("images_noalt", 0) > 0)
    canonical = (col("canonical", "") != "") & (frontier_key(col("canonical", "")) != frontier_key("url"))

    rules: list[tuple[str, Column, Column | None]] = [(code, error == code, None) for code in FETCH_ISSUES if code != "connection-error"]
    rules += [
        ("connection-error", (error == "connection-error") | ((status == 0) & (error == "")), None),
        ("server-error", answered & (status >= 500), status.cast("string")),
        ("client-error", answered & (status >= 400) & (status < 500) & (status != 429), status.cast("string")),
        ("redirect", answered & (status >= 300) & (status < 400), col("redirect_to", "")),
        ("redirect-chain", answered & (col("redirect_hops", 0) > 1), None),
        ("title-missing", page & (title == 0), None),
        ("title-long", page & (title > TITLE_MAX), None),
        ("title-short", page & (title > 0) & (title < TITLE_MIN), None),
        ("title-multiple", page & (n("title_count") > 1), None),
        ("title-same-as-h1", page & (title > 0) & (F.lower(col("title", "")) == F.lower(col("h1", ""))), None),
        ("meta-missing", page & (meta == 0), None),
        ("meta-long", page & (meta > META_MAX), None),
        ("meta-short", page & (meta > 0) & (meta < META_MIN), None),
        ("meta-multiple", page & (n("meta_count") > 1), None),
        ("h1-missing", page & (n("h1_count") == 0), None),
        ("h1-multiple", page & (n("h1_count") > 1), None),
        ("h1-long", page & (text("h1") > H1_MAX), None),
        ("h2-missing", page & (n("h2_count") == 0), None),
        ("thin-content", page & (col("word_count", THIN_WORDS) < THIN_WORDS), None),
        ("low-text-ratio", page & (ratio > 0) & (ratio < LOW_TEXT_RATIO), None),
        ("canonical-missing", page & (n("canonical_count") == 0), None),
        ("canonical-multiple", page & (n("canonical_count") > 1), None),
        ("canonical-other", page & canonical, col("canonical", "")),
        ("meta-refresh", page & (col("meta_refresh", "") != ""), None),
        ("viewport-missing", page & empty("viewport"), None),
        ("lang-missing", page & empty("lang"), None),
        ("images-no-alt", page & no_alt, None),
        ("image-alt-long", page & F.coalesce(F.exists(alts, lambda a: F.char_length(a) > ALT_MAX), F.lit(False)), None),
        ("og-missing", page & ~col("has_og", True), None),
        ("twitter-missing", page & ~col("has_twitter", True), None),
        ("no-structured-data", page & ~col("has_structured_data", True), None),
        ("slow-response", page & (ms > SLOW_MS), None),
        ("moderate-response", page & (ms > MODERATE_MS) & (ms <= SLOW_MS), None),
        ("large-page", page & (size > LARGE_BYTES), None),
        ("moderate-page", page & (size > MODERATE_BYTES) & (size <= LARGE_BYTES), None),
        ("noindex", page & noindex, None),
        ("nofollow", page & nofollow, None),
        ("robots-blocked", answered & (F.col("robots_state") == "blocked"), None),
        ("robots-unknown", page & (F.col("robots_state") == "unknown"), None),
        ("bot-blocked", col("bot_blocked", False), None),
    ]
    found = F.array(*(
        F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(-S.SEVERITY[code]).alias("order"), F.lit(S.POSITION[code]).alias("pos"), F.lit(code).alias("code"), F.lit(S.CATEGORY[code]).alias("category"), F.lit(S.SEVERITY[code]).alias("severity"), (F.lit("") if detail is None else detail).alias("detail")))
        for code, when, detail in rules
    ))
    kept = F.array_sort(F.filter(found, lambda x: x.isNotNull()))
    rows = pages
    if exclusions:
        rows = rows.where(~excluded(path("url"), part("url", 4), exclusions))
    return rows.select("run_id", "url_id", F.posexplode(kept).alias("pos", "x")).select("run_id", "url_id", "x.code", "x.category", "x.severity", "x.detail", "pos")


def counts(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """run_id, url_id, issue_count, issue_max_sev of every page; 0 without issues."""
    found = issues.groupBy("run_id", "url_id").agg(F.count("*").alias("issue_count"), F.max("severity").alias("issue_max_sev"))
    return pages.select("run_id", "url_id").join(found, ["run_id", "url_id"], "left").na.fill(0, ["issue_count", "issue_max_sev"])


def tallies(issues: DataFrame) -> DataFrame:
    """Rows by severity in a run: critical, warning, notice, and all."""
    at = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("run_id").agg(at(S.CRITICAL).alias("critical"), at(S.WARNING).alias("warning"), at(S.NOTICE).alias("notice"), F.count("*").alias("total"))


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(c, k, s, i) for i, (c, k, s) in enumerate(S.ISSUES)], "code string, category string, severity int, position int")
