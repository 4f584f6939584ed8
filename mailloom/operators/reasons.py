"""Reasons of a score as structs: what was found, its points and its parts; and their one-line text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.domains import bind

SHAPE = "array<struct<kind:string,points:int,parts:array<string>>>"
# The text of each kind of reason, {0} and {1} standing for its parts, in the order of the rules.
TEXTS = {
    "reply_to": "Reply-to domain differs from From domain ({0})",
    "return_path": "Return-path domain differs from From domain ({0})",
    "confusable": "From domain contains IDN or confusable characters ({0} in {1})",
    "freemail": "Free email provider ({0}) with brand mention ({1})",
    "received": "Anomalous Received headers ({0})",
    "message_id": "Message-ID domain mismatch ({0})",
    "phrases": "Matched phishing language ({0})",
    "place": "Keyword '{0}' in {1}",
    "link": "Suspicious URL {0} ({1})",
    "attachment": "Dangerous attachment extension in {0}",
    "archive": "Suspicious archive attachment {0}",
    "whitelist": "{0} in whitelist",
}
# What a line of each kind holds at least, however it goes on.
SIGNS = {
    "reply_to": "Reply-to domain differs", "return_path": "Return-path domain differs", "confusable": "From domain contains IDN", "freemail": "Free email provider",
    "received": "Anomalous Received headers", "message_id": "Message-ID domain mismatch", "phrases": "Matched phishing ", "place": "Keyword '", "link": "Suspicious URL",
    "attachment": "Dangerous attachment extension", "archive": "Suspicious archive attachment", "whitelist": "in whitelist",
}
# Kinds whose text says "points" even for one.
PLURAL = ("phrases", "place", "link")
#: Kind of a reason that is none of these; its only part is its text.
OTHER = "other"


def pieces(template: str) -> list[str | int]:
    """A template as literal strings and the numbers of its parts, in order."""
    return [int(x) if i % 2 else x for i, x in enumerate(re.split(r"\{(\d)\}", template))]


def _format(template: str) -> str:
    return "".join(f"%{x + 1}$s" if isinstance(x, int) else x.replace("%", "%%") for x in pieces(template))


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def reason(kind: str, points: Column | int, *parts: Column) -> Column:
    """One reason; points below 0 are taken off."""
    n = F.lit(points) if isinstance(points, int) else points
    return F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("points"), F.array(*parts).cast("array<string>").alias("parts"))


def by_kind(r: Column, texts: dict[str, str], otherwise: Column, defaults: dict[str, list[str]] | None = None) -> Column:
    """texts[kind] with the parts of the reason; a missing or empty part is the default of the kind, or ''."""
    def part(i: int) -> Column:
        own, known = F.get(r["parts"], F.lit(i)), {k: v[i] for k, v in (defaults or {}).items() if i < len(v)}
        spare = [F.try_element_at(_table(known), r["kind"])] if known else []
        return F.coalesce(F.when(own != "", own), *spare, F.lit(""))

    return F.coalesce(F.printf(F.try_element_at(_table({k: _format(t) for k, t in texts.items()}), r["kind"]), part(0), part(1)), otherwise)


def line(r: Column) -> Column:
    """The reason as one line: "+N points: text"."""
    n = r["points"]
    word = F.when((n == 1) & ~r["kind"].isin(*PLURAL), " point: ").otherwise(" points: ")
    return F.concat(F.when(n > 0, "+").otherwise(""), n.cast("string"), word, by_kind(r, TEXTS, F.get(r["parts"], F.lit(0))))


def parsed(text: Column) -> Column:
    """A line as a reason again. Kinds are told by SIGNS, in their order, and parts by TEXTS; a line of no kind is
    OTHER. A line without points has 0."""
    head = r"(?is)^\s*(?:([+-]\d+)\s+points?:)?\s*(.*?)\s*$"

    def told(x: Column) -> Column:
        out = None
        for kind, template in TEXTS.items():
            literal = [p for p in pieces(template) if isinstance(p, str)]
            shape = "(?s)^" + "(.*?)".join(map(re.escape, literal)) + "$"
            parts = [F.regexp_extract(x["text"], shape, i + 1) for i in range(len(literal) - 1)]
            one = reason(kind, x["points"], *parts)
            here = F.contains(x["text"], F.lit(SIGNS[kind]))
            out = F.when(here, one) if out is None else out.when(here, one)
        return out.otherwise(reason(OTHER, x["points"], x["text"]))

    points = F.coalesce(F.regexp_extract(text, head, 1).try_cast("int"), F.lit(0))
    return bind(F.struct(points.alias("points"), F.regexp_extract(text, head, 2).alias("text")), told)
