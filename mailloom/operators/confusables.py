"""Confusable and internationalised hosts."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.functions.domains import bind

# Zero-width code points.
ZERO_WIDTH = [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF]
# Code points that look like an ASCII character; of one listed twice the later entry counts.
LOOKALIKES = {
    "-": [0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212],
    "0": [0x07C0, 0x1D7CE], "1": [0x07C1, 0x1D7CF], "2": [0x07C2, 0x1D7D0], "3": [0x07C3, 0x1D7D1], "4": [0x07C4, 0x1D7D2, 0x13CE],
    "5": [0x07C5, 0x1D7D3, 0x01BD], "6": [0x07C6, 0x1D7D4], "7": [0x07C7, 0x1D7D5], "8": [0x07C8, 0x1D7D6], "9": [0x07C9, 0x1D7D7],
    "a": [0x0250, 0x0430, 0x03B1, 0x2C65, 0x1D00], "c": [0x0441, 0x03F2, 0x217D], "d": [0x0501, 0x217E, 0x00F0, 0x0111], "e": [0x0435, 0x03B5, 0x212E],
    "g": [0x0261], "h": [0x04BB, 0x0570], "i": [0x0131, 0x0456, 0x2170], "j": [0x0458], "k": [0x03BA, 0x043A], "l": [0x019A, 0x04C0, 0x217C, 0x0142],
    "m": [0x217F, 0x043C], "n": [0x043D, 0x0578], "o": [0x043E, 0x03BF, 0x2C9F], "p": [0x0440, 0x03C1, 0x1D29], "q": [0x051B],
    "r": [0x0433, 0x1D26], "s": [0x0455], "t": [0x0442, 0x1D1B], "u": [0x0446, 0x03C5, 0x057D, 0x1D1C], "v": [0x0475, 0x03BD, 0x1D20],
    "w": [0x0461, 0x051D, 0x1D21], "x": [0x0445, 0x03C7], "y": [0x0443, 0x04AF, 0x03C5], "z": [0x1D22, 0x0240],
    "ss": [0x00DF], "ae": [0x00E6], "th": [0x00FE], "ij": [0x0133], "oe": [0x0153],
}


class _Ascii(dict):
    """For str.translate: what each character looks like in ASCII; nothing for accents and what looks like nothing."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        self[o] = look = c if c.isascii() else unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        return look


_ASCII = _Ascii({o: text for text, points in LOOKALIKES.items() for o in points} | dict.fromkeys(ZERO_WIDTH, ""))


def contains_zero_width(text: Column) -> Column:
    return F.coalesce(text.rlike("[" + "".join(f"\\x{{{o:04X}}}" for o in ZERO_WIDTH) + "]"), F.lit(False))


def normalise(text: str) -> str:
    """Compatibility form without zero-width characters, case folded."""
    return unicodedata.normalize("NFKC", text).translate(dict.fromkeys(ZERO_WIDTH)).casefold()


def skeleton(text: str | None) -> str:
    """The ASCII string that a text looks like; what looks like nothing is left out."""
    return unicodedata.normalize("NFKD", normalise(text)).translate(_ASCII) if text else ""


@F.pandas_udf(T.StructType([T.StructField("look", T.StringType()), T.StructField("plain", T.StringType())]))
def _looks(s: pd.Series) -> pd.DataFrame:
    """Skeleton, and the ASCII characters of the normalised text; once per distinct value of a batch."""
    known = {h: (skeleton(h), "".join(c for c in normalise(h) if c.isascii())) for h in s.dropna().unique()}
    return pd.DataFrame([known.get(h, (None, None)) for h in s], columns=["look", "plain"])


def host_reason(host: Column, references: Sequence[str] = ()) -> Column:
    """Why a host is suspicious: punycode, zero-width characters, the skeleton of another known domain, or
    characters beyond ASCII; NULL where it is not.

    A plain ASCII host is its own skeleton; Python sees only the others. Of references that look alike the first that
    is not the host itself is named."""
    known: dict[str, list[str]] = {}
    for r in dict.fromkeys((r or "").strip().casefold() for r in references):
        if skeleton(r):
            known.setdefault(skeleton(r), []).append(r)
    d = F.lower(F.trim(host, F.lit(" \t\r\n")))
    beyond = d.rlike(r"[^\x00-\x7f]")
    looks = _looks(F.when(beyond, d))

    def judge(x: Column) -> Column:
        table = F.create_map(*[y for k, v in known.items() for y in (F.lit(k), F.array(*map(F.lit, v)))]) if known else None
        match = F.get(F.filter(F.try_element_at(table, x["look"]), lambda r: r != x["d"]), F.lit(0)) if known else F.lit(None).cast("string")
        return (
            F.when(F.contains(x["d"], F.lit("xn--")), "punycode label")
            .when(contains_zero_width(x["d"]), "zero-width characters")
            .when(match.isNotNull(), F.concat(F.lit("confusable match for "), match))
            .when(x["beyond"] & (x["look"] != "") & (x["look"] != x["plain"]), F.concat(F.lit("confusable skeleton "), x["look"]))
            .when(x["beyond"], "non-ascii characters")
        )

    seen = F.struct(d.alias("d"), beyond.alias("beyond"), F.when(beyond, looks["look"]).otherwise(d).alias("look"), looks["plain"].alias("plain"))
    return F.when(d != "", bind(seen, judge))
