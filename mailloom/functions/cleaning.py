"""Clean bodies: HTML to text, and hidden or exotic characters."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters dropped beside the format category, and spaces beside the space.
DROPPED = [0x034F, 0x200B, 0x200C, 0x200D, 0xFEFF, 0x2060, 0x00AD]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Characters(dict):
    """For str.translate: format characters are dropped, white space but the newline is a space; settled once per character."""

    def __missing__(self, o: int) -> str | None:
        c = chr(o)
        if c == "\n":
            self[o] = c
        elif unicodedata.category(c) == "Cf":
            self[o] = None
        else:
            self[o] = " " if c.isspace() else c
        return self[o]


_CHARACTERS = _Characters(dict.fromkeys(DROPPED))


def plain_characters(text: str | None) -> str:
    """Compatibility form without format characters, white space but newlines as spaces. NULL gives ''."""
    return unicodedata.normalize("NFKC", text).translate(_CHARACTERS) if text else ""


def clean_characters(text: str | None) -> str:
    """plain_characters() with single spaces, none at the ends of lines, no two blank lines in a row and none at the ends."""
    lines = (" ".join(x.split()) for x in plain_characters(text).split("\n"))
    out: list[str] = []
    for line in lines:
        if line or out and out[-1]:
            out.append(line)
    return "\n".join(out).rstrip("\n")


class _Text(HTMLParser):
    """Collects text outside of scripts, styles and elements styled display:none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            style = next((v or "" for k, v in attrs if k == "style"), "")
            self.open.append((tag, tag in ("script", "style") or "display:none" in style))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.parts.append(data)


def html_text(markup: str | None) -> str:
    """The visible text of a page, one text node a line, blank lines dropped; '' for NULL."""
    if not markup:
        return ""
    parser = _Text()
    try:
        parser.feed(markup)
        parser.close()
    except Exception:  # noqa: BLE001 - whatever cannot be parsed comes back as it is
        return markup.strip()
    return "\n".join(line for part in parser.parts for line in (x.strip() for x in part.strip().split("\n")) if line)


@F.pandas_udf(T.StringType())
def _plain(s: pd.Series) -> pd.Series:
    return s.map(plain_characters)


@F.pandas_udf(T.StringType())
def _visible(s: pd.Series) -> pd.Series:
    return s.map(html_text)


def clean_text(text: Column) -> Column:
    """clean_characters as a Column: Python sees only values beyond ASCII and only for their characters; spaces and
    lines are the JVM's business."""
    other = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    plain = F.when(other.isNull(), F.regexp_replace(text, "[\\x09\\x0b-\\x0d\\x1c-\\x1f]", " ")).otherwise(_plain(other))
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, " {2,}", " "), " *\\n *", "\n"), "\\n{3,}", "\n\n")
    return F.coalesce(F.trim(spaced, F.lit(" \n")), F.lit(""))


def visible_text(markup: Column) -> Column:
    return _visible(markup)
