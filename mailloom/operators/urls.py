"""Links: extraction, decomposition, risk rules and the running cap, over arrays of one row or over exploded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.functions.domains import bind, present, registrable

# Lists of the link rules.
WHITELIST = ["enron.com", "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "microsoft.com", "apple.com", "google.com"]
TRUSTED_CONTENT = [
    "linkedin.com", "facebook.com", "instagram.com", "twitter.com", "pinterest.com", "github.com", "gitlab.com", "figma.com",
    "dropbox.com", "box.com", "salesforce.com", "zendesk.com", "notion.so", "medium.com", "slack.com",
]
RISKY_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".click", ".country"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "ow.ly", "buff.ly", "rebrand.ly", "goo.gl", "rb.gy"]
PRIMARY = ["login", "signin", "password", "credential"]
SECONDARY = ["verify", "secure", "update", "auth", "token", "reset", "confirm"]
URL_CAP, EACH_CAP, TOTAL_CAP = 6, 4, 8
#: White space of any kind ends a link.
_END = r"[^\s\p{Z}\x0b\x1c-\x1f\x85]+"
LINK = rf"https?://{_END}|www\.{_END}"


def extract(body: Column) -> Column:
    """array<string> of the links in a text, in order, trailing punctuation kept."""
    return F.regexp_extract_all(body, F.lit(LINK), F.lit(0))


def decompose(url: Column) -> Column:
    """struct<scheme, host, path, query>; the host without user, port and brackets, in lower case; parameters of
    the last path segment left out. A link without scheme has no host. A malformed host gives NULL."""
    full = url.rlike("^https?://")
    netloc = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
    bare = F.regexp_extract(netloc, "([^@]*)$", 1)
    host = F.lower(F.regexp_extract(bare, r"^(\[[^\]]*\]|[^:]*)", 1))
    path = F.when(full, F.regexp_extract(url, "^https?://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(url, "^([^?#]*)", 1))
    parts = F.struct(
        F.when(full, F.regexp_extract(url, "^(https?)", 1)).otherwise("").alias("scheme"),
        F.when(full, F.translate(host, "[]", "")).otherwise("").alias("host"),
        F.regexp_replace(path, ";[^/]*$", "").alias("path"),
        F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )
    return F.when(F.contains(netloc, F.lit("[")) == F.contains(netloc, F.lit("]")), parts)


def high_risk_tld(host: Column) -> Column:
    return F.coalesce(host.rlike("(" + "|".join(t.replace(".", r"\.") for t in RISKY_TLDS) + ")$"), F.lit(False))


def shortener(host: Column) -> Column:
    return F.coalesce(host.isin(SHORTENERS), F.lit(False))


def credential_score(path: Column, query: Column) -> Column:
    """0 without a primary term; else 1, and 1 more for a second primary and for any secondary term."""
    text = F.lower(F.concat_ws(" ", present(path), present(query)))

    def count(text: Column, words: list[str]) -> Column:
        return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))

    hits = F.struct(count(text, PRIMARY).alias("p"), count(text, SECONDARY).alias("s"))
    return bind(hits, lambda h: F.when(h["p"] == 0, 0).otherwise(1 + F.least(h["p"] - 1, F.lit(1)) + F.least(h["s"], F.lit(1))))


def looks_like_harvest(path: Column, query: Column) -> Column:
    """Whether path and query have the terms of credential forms."""
    return credential_score(path, query) > 0


def domain_risk(host: Column, sender_host: Column) -> Column:
    """2 for an odd structure, 1 for a domain that is not the sender's, 0 for trusted or own ones, no host, or no sender."""
    def judge(x: Column) -> Column:
        h, base, own = x["h"], x["base"], x["own"]
        odd = h.rlike(r"[0-9]{3,}") | h.rlike("-.*-") | h.startswith("xn--") | h.rlike(r"\..*\..*\.")
        return F.when(h.isNull() | base.isin(WHITELIST + TRUSTED_CONTENT), 0).when((base == own) | h.endswith(own), 0).when(odd, 2).when(own.isNotNull(), 1).otherwise(0)

    return bind(F.struct(present(host).alias("h"), registrable(host).alias("base"), registrable(sender_host).alias("own")), judge)


def finding(host: Column, path: Column, query: Column, sender_host: Column) -> Column:
    """struct<score, reasons> of one link; score 0 means nothing found."""
    def judge(x: Column) -> Column:
        d, t, s, c = x["d"], x["t"], x["s"], x["c"]
        reasons = F.array_compact(
            F.array(
                F.when(d == 2, "Unfamiliar domain structure").when(d == 1, "Domain differs from sender"),
                F.when(t, "High-risk TLD"),
                F.when(s, "URL shortener"),
                F.when(c > 0, "Credential-related terms in URL"),
            )
        )
        return F.struct(F.least(d + F.when(t, 2).otherwise(0) + F.when(s, 2).otherwise(0) + c, F.lit(URL_CAP)).cast("int").alias("score"), reasons.alias("reasons"))

    points = F.struct(domain_risk(host, sender_host).alias("d"), high_risk_tld(host).alias("t"), shortener(host).alias("s"), credential_score(path, query).alias("c"))
    return bind(points, judge)


def findings(body: Column, sender_host: Column) -> Column:
    """array<struct<url, score, reasons, applied>> of the risky links of a text in order: the first of each
    (scheme, host, path, query) counts, and applied follows the running cap. No shuffle, no explode.

    Equal links are told by sorting, so the cost is that of sorting the links of the text; every step is bound
    once. A risky link takes at least one point off the cap, so only the first TOTAL_CAP of them can be ahead
    of one that still gets points."""
    split = F.transform(extract(body), lambda u, i: F.struct(decompose(u).alias("p"), i.alias("pos"), u.alias("url")))

    def first(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["p"] != x["p"], F.lit(True)))

    def judged(x: Column) -> Column:
        p = x["p"]
        return F.struct(x["url"].alias("url"), finding(p["host"], p["path"], p["query"], sender_host).alias("f"))

    def capped(risky: Column, raw: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(raw, F.lit(1), F.least(i, F.lit(TOTAL_CAP))), F.lit(0), lambda a, x: F.least(a + x, F.lit(TOTAL_CAP)))
        one = lambda x, i: F.struct(x["url"].alias("url"), x["f"]["score"].alias("score"), x["f"]["reasons"].alias("reasons"), F.least(F.get(raw, i), TOTAL_CAP - before(i)).cast("int").alias("applied"))
        return F.transform(risky, one)

    by_parts = F.sort_array(F.filter(split, lambda x: x["p"].isNotNull()))
    in_order = F.sort_array(F.transform(bind(by_parts, first), lambda x: F.struct(x["pos"].alias("pos"), x["url"].alias("url"), x["p"].alias("p"))))
    risky = F.filter(F.transform(in_order, judged), lambda x: x["f"]["score"] > 0)
    return bind(risky, lambda r: bind(F.transform(r, lambda x: F.least(x["f"]["score"], F.lit(EACH_CAP))), lambda raw: capped(r, raw)))


def first_of_each(urls: DataFrame) -> DataFrame:
    """Exploded form: of equal (scheme, host, path, query) of a message the row with the smallest pos; of
    exact copies of it, one. Keys hold one message's links, so no key grows with the data."""
    keys = [F.coalesce(F.col(c), F.lit("")) for c in ("scheme", "host", "path", "query_str")]
    w = Window.partitionBy("email_id", *keys).orderBy("pos", "url")
    return urls.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def running_cap(rows: DataFrame) -> DataFrame:
    """Exploded form of the cap: rows (email_id, pos, url, score) with score > 0 get `applied`."""
    w = Window.partitionBy("email_id").orderBy("pos", "url").rowsBetween(Window.unboundedPreceding, -1)
    raw = F.least("score", F.lit(EACH_CAP))
    before = F.least(F.lit(TOTAL_CAP), F.coalesce(F.sum(raw).over(w), F.lit(0)))
    return rows.where("score > 0").withColumn("applied", F.least(raw, TOTAL_CAP - before).cast("int"))
