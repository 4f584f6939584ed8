"""Lexical and position rules: phrases in subject and body, and where they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern, weight, label of each rule, in the order of the rules.
LEXICON = [
    (r"\burgent\b", 2, "urgent language"),
    (r"verify (your|the)?", 2, "verification request"),
    (r"\bpassword\b", 2, "password request"),
    (r"\blogin\b", 1, "login prompt"),
    (r"click (here|below)", 1, "click directive"),
    (r"confirm (account|details)", 2, "account confirmation"),
    (r"update (account|billing)", 1, "update request"),
]
CAP = 4
EARLY = 400
POINTS = {"subject": 3, "early_body": 2, "body": 1}


def joined(subject: Column, body: Column) -> Column:
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def phrase_hits(text: Column, lexicon=LEXICON) -> Column:
    """array<struct<phrase, label, weight>> of the first match of each rule, in rule order."""
    hits = [F.struct(F.regexp_extract(text, f"(?iU){p}", 0).alias("phrase"), F.lit(label).alias("label"), F.lit(w).alias("weight")) for p, w, label in lexicon]
    return F.filter(F.array(*hits), lambda h: h["phrase"] != "")


def lexical_points(hits: Column) -> Column:
    """Sum of the weights, capped."""
    return F.least(F.aggregate(hits, F.lit(0), lambda a, h: a + h["weight"]), F.lit(CAP))


def positions(hits: Column, subject: Column, body: Column) -> Column:
    """array<struct<keyword, location, points, offset>>: the first place of each phrase, subject before early
    body before body. A phrase that crosses their borders has none. Offsets count from 0."""
    s, b = F.lower(F.coalesce(subject, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    early, late = F.substring(b, 1, EARLY), F.substring(b, EARLY + 1, 2**30)

    def place(h: Column) -> Column:
        k = F.lower(h["phrase"])
        hit = lambda loc, at: F.struct(h["phrase"].alias("keyword"), F.lit(loc).alias("location"), F.lit(POINTS[loc]).alias("points"), at.cast("int").alias("offset"))
        return (
            F.when(F.instr(s, k) > 0, hit("subject", F.instr(s, k) - 1))
            .when(F.instr(early, k) > 0, hit("early_body", F.instr(early, k) - 1))
            .when(F.instr(late, k) > 0, hit("body", F.instr(late, k) - 1 + EARLY))
        )

    return F.filter(F.transform(hits, place), lambda h: h.isNotNull())


def position_points(places: Column) -> Column:
    return F.aggregate(places, F.lit(0), lambda a, h: a + h["points"])
