"""Identity and routing rules on senders, as Column expressions over one message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.domains import bind, present, registrable

# Free mail providers, and brands known without a table (name, domain).
FREEMAIL = ["gmail.com", "yahoo.com", "hotmail.com"]
BRANDS = [
    ("paypal", "paypal.com"), ("ebay", "ebay.com"), ("amazon", "amazon.com"), ("apple", "apple.com"), ("microsoft", "microsoft.com"),
    ("bank of america", "bankofamerica.com"), ("chase bank", "chase.com"),
]
#: Largest brand table that is turned into an array of every row's expression.
MAX_BRANDS = 2000
HOPS, LONG_HEADER = 5, 1000
# The spaces of Unicode (category Zs).
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def differs(domain: Column, sender: Column) -> Column:
    """The domain where both are present and unequal, else NULL."""
    return F.when(domain != sender, domain)


def message_id_mismatch(message_id: Column, sender: Column) -> Column:
    """The registrable domain of a Message-ID where it is not the sender's, else NULL."""
    return differs(registrable(present(F.regexp_extract(message_id, r"(?U)@([\w.-]+)", 1))), sender)


def received_anomaly(received: Column) -> Column:
    """Why the Received headers are odd, or NULL: too many, else overlong ones."""
    n = F.size(received)
    long = F.size(F.filter(received, lambda r: F.length(r) > LONG_HEADER))
    return F.when(n > HOPS, F.format_string("%d headers (>5)", n)).when(long > 0, F.format_string("%d header(s) with length >1000", long))


def normalise_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def brand_mentions(text: Column, brands: Sequence[str]) -> Column:
    """The brands, sorted, that the text names as a substring or as a run of words within edit distance 1.

    An expression over one row: no join. The brands are one array literal, so the plan does not grow with them; the
    distance is asked only of runs of about the same length and cut off at 1. NULL text names none."""
    if len(brands) > MAX_BRANDS:
        raise ValueError(f"more than {MAX_BRANDS} brands; join them instead")
    norm = F.coalesce(normalise_words(text), F.lit(""))
    plain = {b: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in b.lower()).split()) for b in sorted(set(brands))}
    lengths = sorted({p.count(" ") + 1 for p in plain.values() if p})
    if not lengths:
        return F.array().cast("array<string>")

    def runs(words: Column, n: int) -> Column:
        """The runs of n words, each run once however often it occurs."""
        if n == 1:
            return F.array_distinct(words)
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))

    def close(w: Column, p: Column) -> Column:
        return (F.abs(F.length(w) - F.length(p)) <= 1) & F.levenshtein(w, p, 1).between(0, 1)

    def named(x: Column) -> Column:
        def of_length(n: int) -> Column:
            known = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(p).alias("p")) for b, p in plain.items() if p and p.count(" ") + 1 == n])
            return F.filter(known, lambda k: F.contains(x["norm"], k["p"]) | F.exists(x[f"r{n}"], lambda w: close(w, k["p"])))

        return F.array_sort(F.transform(F.concat(*map(of_length, lengths)), lambda k: k["b"]))

    return bind(bind(norm, lambda t: F.struct(t.alias("norm"), *[runs(F.split(t, " "), n).alias(f"r{n}") for n in lengths])), named)


def brand_lists(lines: DataFrame | None, spark) -> tuple[DataFrame, DataFrame]:
    """Names (ord, name) and domains (ord, domain), each once, at its first place, in the order of ord.

    lines: (ord, value) with `name | domain, domain` or `name`; # comments and blank lines count for nothing,
    and so do empty names and domains. The fallback brands come behind all lines."""
    known = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(BRANDS)], "ord bigint, name string, domain string")
    names = known.select(F.lit(1).alias("part"), "ord", F.lit(0).alias("place"), "name")
    hosts = known.select(F.lit(1).alias("part"), "ord", F.lit(0).alias("place"), "domain")
    if lines is not None:
        v = lines.select(F.col("ord").cast("bigint"), F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
        parts = F.split("v", r"\|", 2)
        names = v.select(F.lit(0).alias("part"), "ord", F.lit(0).alias("place"), present(F.lower(F.trim(F.get(parts, F.lit(0))))).alias("name")).unionByName(names)
        each = v.select("ord", F.posexplode(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ",")).alias("place", "d"))
        hosts = each.select(F.lit(0).alias("part"), "ord", "place", present(F.lower(F.trim("d"))).alias("domain")).unionByName(hosts)

    def first(rows: DataFrame, what: str) -> DataFrame:
        at = rows.where(F.col(what).isNotNull()).groupBy(what).agg(F.min(F.struct("part", "ord", "place")).alias("ord"))
        return at.select("ord", what)

    return first(names, "name"), first(hosts, "domain")


def fuzzy_domains(hosts: DataFrame, known: Sequence[str], distance: int = 1, by_bytes: bool = False) -> DataFrame:
    """(host, matches): the known domains that a host equals, lies under, or is within the edit distance of.

    hosts: (host). Distinct hosts only are compared, each with the bounded list in its own row. The distance is one of
    characters; by_bytes: one of UTF-8 bytes, as DuckDB's levenshtein has it, where a letter beyond ASCII is several edits."""
    if len(known) > MAX_BRANDS:
        raise ValueError(f"more than {MAX_BRANDS} domains")
    clean = sorted({k.strip().lower().strip(".") for k in known if k})
    h = F.trim(F.lower(F.trim("host", F.lit(SPACES))), F.lit("."))
    # in Latin-1 every byte is one character
    units = F.decode(F.encode(h, "UTF-8"), "ISO-8859-1") if by_bytes else h

    def one(k: str):
        near = F.levenshtein(units, F.lit(k.encode().decode("latin-1") if by_bytes else k), distance).between(0, distance)
        return F.when((h == k) | h.endswith("." + k) | ((F.abs(F.length(h) - len(k)) <= distance) & near), F.lit(k))

    matches = F.array_compact(F.array(*[one(k) for k in clean]))
    return hosts.select("host").where(F.col("host") != "").distinct().select("host", matches.alias("matches")).where(F.size("matches") > 0)
