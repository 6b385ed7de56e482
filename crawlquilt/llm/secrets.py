"""Secret scans whose false positives a random forest removes.

Candidates are long runs of key characters that hold a digit, and what is assigned after
a word such as password or key. A random forest, trained from labelled findings, judges each by its length, the transitions between its
character classes, how much of it dictionary words cover, the path of its document
and the neighbouring words. Only DataFrame expressions and the forest of Spark's own
library run: texts never leave the JVM, and only candidates are shuffled, for their places.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlquilt.llm.common import table, text_key

#: Runs of 16 key characters or more with a digit. It is tried at the start of a run
#: only, and neither part goes back, so it takes linear time on any text.
CANDIDATE = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+"
#: What stands after a word for secrets and ``=`` or ``:``, 8 characters or more without white
#: space and quotes, less closing punctuation. A value that holds a run as above is left to it. At most 256
#: characters are read, so that a start costs no more than that in any text.
ASSIGNED = (
    r"""(?<=[=:>][ \t"'`]{0,4})(?<=(?i:passw(?:or)?d|passwd|passwort|passphrase|pwd|secret|token|key|auth|credentials?)["'\]]{0,2}[ \t]{0,3}[=:]{1,2}>?[ \t]{0,3}["'`]?)"""
    rf"""(?![\s"'`=:>])(?![^\s"'`]{{0,256}}{CANDIDATE})(?:[^\s"'`]{{7,255}}[^\s"'`.,;:)\]}}>])"""
)
EITHER = f"{CANDIDATE}|{ASSIGNED}"
#: Characters before and after a candidate in which neighbouring words are looked for.
NEAR = 48
LEAST_SCORE = 0.5

#: Words of identifiers and prose whose share of a candidate speaks against a secret.
DICTIONARY = ["access", "account", "address", "admin", "api", "archive", "asset", "auth", "backup", "base", "build", "cache", "cell", "change", "client", "code", "commit", "component", "config", "connection", "content", "context", "count", "create", "data", "date", "default", "demo", "device", "document", "download", "element", "email", "endpoint", "entry", "error", "event", "example", "export", "field", "file", "filter", "format", "frame", "function", "group", "handler", "hash", "header", "here", "home", "host", "icon", "image", "import", "index", "info", "input", "insert", "item", "key", "label", "language", "layout", "library", "list", "local", "login", "main", "manager", "map", "member", "message", "method", "model", "module", "name", "network", "node", "number", "object", "option", "order", "output", "package", "page", "param", "password", "path", "placeholder", "plugin", "port", "process", "product", "project", "property", "public", "query", "record", "release", "report", "request", "resource", "response", "result", "route", "sample", "schema", "script", "search", "secret", "section", "select", "server", "service", "session", "setting", "source", "static", "status", "storage", "string", "style", "system", "table", "target", "task", "template", "test", "text", "the", "time", "title", "token", "type", "update", "upload", "user", "utils", "value", "version", "video", "view", "web", "window", "with", "work", "your"]

_FOR = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|auth|credential|private[_-]?key|access[_-]?key|bearer)\W{0,6}$"
_AGAINST = r"(?i)(commit|sha1|sha256|md5|checksum|digest|etag|uuid|guid|card|phone|isbn|version|revision|integrity|boundary|build|order|ref|id)\W{0,4}$"
_PREFIX = "^(AKIA|ASIA|ghp_|gho_|ghs_|xoxb-|xoxp-|sk_live_|rk_live_|glpat-|AIza|eyJ)"
#: References, calls, templates and masks instead of a value.
_CODE = r"^[$%<{(\[]|[A-Za-z_]\w*[.(][A-Za-z_]|\(|^(.)\1+$|://"
_TEST_PATH = "(?i)(test|example|sample|demo|fixture|mock|doc)"


def features(c: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The features of a candidate, all numbers."""
    n = F.greatest(F.length(c), F.lit(1))

    def share(of: str) -> Column:
        return F.length(F.regexp_replace(c, f"[^{of}]", "")) / n

    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9"), "[^a-zA-Z0-9]+", "-")
    by_length = sorted(DICTIONARY, key=lambda w: (-len(w), w))
    left = F.regexp_replace(F.lower(c), "|".join(by_length), "")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return {
        "f_length": F.log2(n),
        "f_transitions": (F.length(classes) - 1) / n,
        "f_digits": share("0-9"),
        "f_upper": share("A-Z"),
        "f_lower": share("a-z"),
        "f_signs": share("_/+-"),
        "f_slashes": share("/"),
        "f_others": F.length(F.regexp_replace(c, "[A-Za-z0-9_/+-]", "")) / n,
        "f_code": flag(c.rlike(_CODE)),
        "f_vowels": share("aeiouAEIOU"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "f_hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "f_prefix": flag(c.rlike(_PREFIX)),
        "f_dictionary": (n - F.length(left)) / n,
        "f_test_path": flag(path.rlike(_TEST_PATH)),
        "f_for": flag(before.rlike(_FOR)),
        "f_against": flag(before.rlike(_AGAINST)),
        "f_assigned": flag(before.rlike("[=:]\\s*[\"']?$")),
        "f_quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "f_in_url": flag(before.rlike("(?i)(https?:|www\\.)\\S*$")),
        "f_example": flag(F.concat(before, c, after).rlike("(?i)example|placeholder|changeme|dummy|xxxx|your[_-]")),
    }


def labelled_findings(n: int = 120) -> list[tuple[str, str, str, str, int]]:
    """(before, candidate, after, path, label): ``n`` findings of each kind, made by rule.

    The kinds are what scanners report: keys, tokens and passwords that are secrets,
    and the numbers, digests of public things, names and paths that are not."""
    rows = []
    b32, b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def draw(kind: str, i: int) -> int:
        return int.from_bytes(hashlib.sha512(f"{kind} {i}".encode()).digest(), "big")

    def chars(x: int, alphabet: str, size: int) -> str:
        out = ""
        for _ in range(size):
            x, k = divmod(x, len(alphabet))
            out += alphabet[k]
        return out

    letters = b62[:52]
    prose = ["the rest of the page ", "as it was said before ", "und dann war da noch ", "et puis il y avait ", "que se encuentra en ", ""]
    for i in range(n):
        x = draw("any", i)
        path = ["src/app/main.py", "src3", "web/page.html", "notes.txt", "src11", "conf/settings.yaml"][i % 6]
        p, q = prose[i % 6], [" and more", ".", " der Rest", ""][i % 4]
        names = [DICTIONARY[(x >> (8 * k)) % len(DICTIONARY)] for k in range(6)]
        made = [names[0].title() + names[1] + str(100 + x % 900), (names[2] + str(x % 10**6)).rjust(9, "q"), names[3].title().replace("a", "4").replace("o", "0").replace("e", "3") + chars(x, "0123456789!", 5)]
        spoken = "".join(chars(draw(f"sound {k}", i), "bdfglmnprst", 1) + chars(draw(f"vowel {k}", i), "aeiou", 1) + ["", "n", "r", "s"][(i + k) % 4] for k in range(4 + i % 3))
        rows += [
            (p, "AKIA" + chars(draw("key", i), b32, 16), q, path, 1),
            (p + ["token = \"", "auth_token: ", "Bearer "][i % 3], chars(draw("token", i), "0123456789abcdef", [40, 32, 64][i % 3]), "\"" + q if i % 3 == 0 else q, path, 1),
            (p + ["password=", "passwd: ", "pwd=\""][i % 3], chars(draw("password", i), "0123456789abcdef" if i % 2 else b62, 16 + i % 9) + "7", q, path, 1),
            (p + ["secret_key = '", "api_key=", "client secret: "][i % 3], chars(draw("secret", i), b62, 24 + i % 20) + "4", q, path, 1),
            (p, "ghp_" + chars(draw("forge", i), b62, 35) + "1", q, path, 1),
            (p + "key=", "sk_live_" + chars(draw("pay", i), b62, 24) + "9", q, path, 1),
            (p + ["card ", "", "tel. ", "no. "][i % 4], chars(draw("digits", i), "0123456789", 16 + i % 4), q, path, 0),
            (p + ["id=", "uuid ", "/item/", ""][i % 4], str(uuid.UUID(int=draw("uuid", i) % 2**128)), q, path, 0),
            (p + ["commit ", "sha1: ", "revision ", "etag=\""][i % 4], chars(draw("commit", i), "0123456789abcdef", 40), q, path, 0),
            (p + ["integrity sha256 ", "md5 ", "checksum: ", "digest="][i % 4], chars(draw("sum", i), "0123456789abcdef", [64, 32, 40, 64][i % 4]), q, path, 0),
            (p, "".join(w if k == 0 else w.title() for k, w in enumerate(names[:4])) + str(i), q, path, 0),
            (p, "_".join(names[:3]) + f"_{i}", q, path, 0),
            (p, "/" + "/".join(names[:4]) + f"/{names[4]}{i}", q, path, 0),
            (p + "https://example.org/", "-".join(names[:4]) + f"-{2000 + i % 30}", q, path, 0),
            (p, f"20{i % 30:02d}-{1 + i % 12:02d}-{1 + i % 28:02d}-{i % 24:02d}-{i % 60:02d}-00", q, path, 0),
            (p + "password=", ["your_password_here_1", "changeme-12345678", "example-password-123", "xxxxxxxxxxxxxxxx1"][i % 4], q, path, 0),
            (p + "token = \"", ["placeholder_token_00", "your-api-token-0000", "dummy_token_12345678", "0000000000000000000"][i % 4], "\"" + q, ["tests/test_auth.py", "docs/example.md"][i % 2], 0),
            (p, (names[0] + names[1] + names[2] + names[3])[:30] + str(10 + i), q, path, 0),
            (p + ["password=", "pwd=\"", "passwd: ", "db_password = '"][i % 4], chars(draw("short", i), b62, 7 + i % 8) + "5", q, path, 1),
            (p + ["password=", "pwd=\"", "token: ", "secret = '"][i % 4], made[i % 3], q, path, 1),
            (p + ["api_key=", "secret: ", "auth_token=\"", "key = '"][i % 4], chars(draw("letters", i), letters, 12 + i % 16), q, path, 1),
            (p + ["password=", "pwd: ", "secret=\"", "passwd = '"][i % 4], chars(draw("signs", i), b62 + "!#$%&*@^?!#$%&*@^?", 8 + i % 9) + "!", q, path, 1),
            (p + ["password: ", "the key: ", "token: ", "secret: "][i % 4], spoken, q, path, 0),
            (p + ["password = ", "token=", "key: ", "secret = "][i % 4], [f"{names[0]}.{names[1]}", f"{names[0]}_{names[1]}", f"get_{names[2]}(", f"${{{names[3].upper()}}}", f"<{names[0]}>", "*" * (8 + i % 5), f"{names[0]}{names[1].title()}"][i % 7], q, path, 0),
            (p + ["password=", "api_key=\"", "token: ", "secret: '"][i % 4], ["changeme", "your_password", "placeholder", "xxxxxxxx", "password", "example-key", "your-token-here", "undefined"][i % 8], q, path, 0),
        ]
    return rows


def default_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_findings(), "before string, candidate string, after string, path string, label int")


def train(findings: DataFrame, trees: int = 40, depth: int = 10, seed: int = 5) -> PipelineModel:
    """The forest, from findings (before, candidate, after, path, label 0 or 1). Rows
    with a null candidate or label are left out, other nulls count as empty. Findings
    are labelled by hand, so they fit on any machine; the trees are bounded."""
    f = features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit("")))
    rows = findings.where("candidate IS NOT NULL AND label IS NOT NULL").select(F.col("label").cast("double").alias("label"), *(x.alias(k) for k, x in f.items()))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(f), outputCol="features"), forest]).fit(rows)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, text_hash, start, candidate, before, after, path of every candidate; the
    start counts characters from 0. Splitting a text at its candidates gives what stands
    between them, and so each one's place and neighbours."""
    where = F.col(path) if path in docs.columns else F.lit("")
    rows = docs.select("doc_id", F.coalesce(where.cast("string"), F.lit("")).alias("path"), "text").where(F.col("text").rlike(EITHER))
    rows = rows.select("doc_id", "path", text_key(F.col("text")).alias("text_hash"), F.regexp_extract_all("text", F.lit(EITHER), F.lit(0)).alias("found"), F.split("text", EITHER, -1).alias("between"))
    gap = lambda i: F.get("between", i)
    ends = F.transform("found", lambda x, i: F.struct(x.alias("candidate"), F.right(gap(i), F.lit(NEAR)).alias("before"), F.left(gap(i + 1), F.lit(NEAR)).alias("after"), F.length(gap(i)).alias("gap")))
    rows = rows.select("doc_id", "path", "text_hash", ends.alias("at"))
    # The lengths of what stands before, summed over the candidates of a row. The row's
    # number is that of a scan, so a task that runs again gives the same.
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "path", "text_hash", F.posexplode("at").alias("k", "x"))
    before = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("x.gap") + F.length("x.candidate")).over(before), F.lit(0))
    return each.select("doc_id", "text_hash", (passed + F.col("x.gap")).cast("long").alias("start"), "x.candidate", "x.before", "x.after", "path")


def scan(docs: DataFrame, model: PipelineModel, path: str = "source", least_score: float = LEAST_SCORE) -> DataFrame:
    """The candidates with score (0 to 1) and is_secret.

    A null or empty text has no candidates; a null path, or none, counts as empty. Rows
    that share a doc_id or have none are scanned each for itself, and repeated rows
    give their findings again. Whole texts are read; an empty table gives no rows, and
    columns other than doc_id, text and the path are not read."""
    found = candidates(docs, path)
    f = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    scored = model.transform(found.select("*", *(x.alias(k) for k, x in f.items())))
    score = vector_to_array("probability")[1]
    return scored.select(*found.columns, score.alias("score"), (score >= least_score).alias("is_secret"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(default_findings(spark)))
    return found.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
