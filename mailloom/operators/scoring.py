"""The composite score of a message and its explanations, one row in, one row out, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions import domains, packed
from mailloom.operators import attachments, confusables, identity, reasons, urls, wording

HIGH, MEDIUM = 10, 5
WHITELIST_POINTS = 4


def label_of(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def signals(
    emails: DataFrame,
    brands: Sequence[str] = tuple(n for n, _ in identity.BRANDS),
    freemail: Sequence[str] = tuple(identity.FREEMAIL),
    lexicon=wording.LEXICON,
    reference_domains: Sequence[str] = tuple(d for _, d in identity.BRANDS),
    joined_attachments: bool = False,
    compat_wiring: bool = False,
) -> DataFrame:
    """emails with one column per signal. Needs from_addr, reply_to, return_path, message_id, subject, body,
    attachments (packed string) and received; keeps every column. NULL and '' are absent. With joined_attachments the packed string counts as one name.
    With compat_wiring the reply-to, return-path and Received rules see nothing and attachments are joined, as
    if a parser did not hand these headers on."""
    if compat_wiring:
        emails = emails.withColumns({"reply_to": F.lit(None).cast("string"), "return_path": F.lit(None).cast("string"), "received": F.array().cast("array<string>")})
    joined_attachments = joined_attachments or compat_wiring
    e = emails.withColumns({"_from": domains.address_of(F.col("from_addr")), "_reply": domains.address_of(F.col("reply_to")), "_return": domains.address_of(F.col("return_path"))})
    e = e.withColumns({"from_host": domains.host_of(F.col("_from"))})
    e = e.withColumns({"from_dom": domains.registrable(F.col("from_host")), "reply_dom": domains.registrable(domains.host_of(F.col("_reply"))), "return_dom": domains.registrable(domains.host_of(F.col("_return")))})
    text = wording.joined(F.col("subject"), F.col("body"))
    e = e.withColumns(
        {
            "reply_mismatch": identity.differs(F.col("reply_dom"), F.col("from_dom")),
            "return_mismatch": identity.differs(F.col("return_dom"), F.col("from_dom")),
            "confusable": confusables.host_reason(F.col("from_host"), reference_domains),
            "brands": F.when(F.col("from_dom").isin(list(freemail)), identity.brand_mentions(text, brands)),
            "received_reason": identity.received_anomaly(F.coalesce("received", F.array().cast("array<string>"))),
            "msgid_mismatch": identity.message_id_mismatch(F.col("message_id"), F.col("from_dom")),
            "phrases": wording.phrase_hits(text, lexicon),
            "links": urls.findings(F.coalesce("body", F.lit("")), F.col("from_host")),
            "files": F.coalesce(F.array(F.col("attachments")) if joined_attachments else packed.files(F.col("attachments")), F.array().cast("array<string>")),
        }
    )
    e = e.withColumns({"lexical": wording.lexical_points(F.col("phrases")), "places": wording.positions(F.col("phrases"), F.col("subject"), F.col("body"))})
    return e.drop("_from", "_reply", "_return")


def score(emails: DataFrame, whitelist: Sequence[str] = tuple(urls.WHITELIST), **options) -> DataFrame:
    """emails with score, label, reasons (structs), explanations (their lines), matched_keywords and suspicious_urls.

    The order of the explanations is identity, routing, lexical, position, links, attachments, whitelist.
    The whitelist takes 4 points off, not below 0, where there are any."""
    e = signals(emails, **options)
    lex, c = F.col("lexical"), F.col
    none = F.array().cast(reasons.SHAPE)
    one = lambda cond, *r: F.when(cond, F.array(reasons.reason(*r))).otherwise(none)
    each = lambda items, of: F.transform(items, of)
    location = lambda h: F.when(h["location"] == "early_body", "early body").otherwise(h["location"])
    bad, odd = attachments.dangerous(c("files")), attachments.odd_archives(c("files"))
    applied = F.filter("links", lambda x: x["applied"] > 0)

    def of_file(x: Column) -> Column:
        one_bad, one_odd = (F.size(f(F.array(x))) > 0 for f in (attachments.dangerous, attachments.odd_archives))
        return F.array_compact(F.array(F.when(one_bad, reasons.reason("attachment", 4, x)), F.when(one_odd, reasons.reason("archive", 2, x))))

    found = F.concat(
        one(c("reply_mismatch").isNotNull(), "reply_to", 3, c("reply_mismatch")),
        one(c("return_mismatch").isNotNull(), "return_path", 2, c("return_mismatch")),
        one(c("confusable").isNotNull(), "confusable", 3, c("confusable"), c("from_host")),
        one(F.size("brands") > 0, "freemail", 2, c("from_dom"), F.array_join("brands", ", ")),
        one(c("received_reason").isNotNull(), "received", 2, c("received_reason")),
        one(c("msgid_mismatch").isNotNull(), "message_id", 1, c("msgid_mismatch")),
        one(lex > 0, "phrases", lex, F.array_join(F.transform("phrases", lambda h: h["label"]), ", ")),
        each("places", lambda h: reasons.reason("place", h["points"], h["keyword"], location(h))),
        each(applied, lambda x: reasons.reason("link", x["applied"], x["url"], F.array_join(x["reasons"], "; "))),
        F.flatten(each("files", of_file)),
    )
    total = (
        F.when(c("reply_mismatch").isNotNull(), 3).otherwise(0)
        + F.when(c("return_mismatch").isNotNull(), 2).otherwise(0)
        + F.when(c("confusable").isNotNull(), 3).otherwise(0)
        + F.when(F.size("brands") > 0, 2).otherwise(0)
        + F.when(c("received_reason").isNotNull(), 2).otherwise(0)
        + F.when(c("msgid_mismatch").isNotNull(), 1).otherwise(0)
        + lex
        + wording.position_points(c("places"))
        + F.aggregate(applied, F.lit(0), lambda a, x: a + x["applied"])
        + 4 * F.size(bad)
        + 2 * F.size(odd)
    )
    e = e.withColumns({"_raw": total, "_found": found})
    floor = c("from_dom").isin(list(whitelist)) & (c("_raw") > 0)
    e = e.withColumn("reasons", F.when(floor, F.concat("_found", F.array(reasons.reason("whitelist", -WHITELIST_POINTS, c("from_dom"))))).otherwise(c("_found")))
    e = e.withColumns(
        {
            "score": F.when(floor, F.greatest(F.lit(0), c("_raw") - WHITELIST_POINTS)).otherwise(c("_raw")).cast("int"),
            "explanations": F.transform("reasons", reasons.line),
            "matched_keywords": F.transform("phrases", lambda h: h["phrase"]),
            "suspicious_urls": F.transform("links", lambda x: F.struct(x["url"], x["reasons"], x["score"])),
        }
    )
    return e.withColumn("label", label_of(c("score"))).drop("_raw", "_found")
