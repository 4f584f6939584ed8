r"""Split fields that pack several values into one string (problem 2).

Method: the value is split at quote characters; odd pieces are literals, even pieces
are split at delimiters, and SQL array functions put the pieces together again with
ordinals. All of it is built-in expressions over one row, without a shuffle, and every
step is linear in the length of the value.

Characters from the private-use area stand for what must survive the splitting: U+E000 item
break, U+E001 an escaped quote, U+E002/U+E003 the ends of a literal. Where a value holds one of
them or U+E004 itself, it is escaped by U+E004 and a letter first and put back in the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK, QUOTE, OPEN, CLOSE, ESCAPE = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
DELIMITERS = r"[;,|\n\r\t]"
#: An extension, as the end of a file name: a dot and letters or digits, one of them a letter.
EXTENSION = r"\.(?=[0-9]*+[A-Za-z])[A-Za-z0-9]++"
ADDRESS = rf"([^\s<>()\[\],;|:\"{BREAK}{QUOTE}{OPEN}{CLOSE}]+@[^\s<>()\[\],;|:\"@{BREAK}{QUOTE}{OPEN}{CLOSE}]+)"
#: Header defaults that stand for "none".
ABSENT = ("No Recipients", "No Sender")


def _escaped(value: Column) -> Column:
    for i, c in enumerate(ESCAPE + BREAK + QUOTE + OPEN + CLOSE):
        value = F.replace(value, F.lit(c), F.lit(ESCAPE + chr(97 + i)))
    return value


def _unescaped(item: Column) -> Column:
    out = item
    for i, c in reversed(list(enumerate(ESCAPE + BREAK + QUOTE + OPEN + CLOSE))):
        out = F.replace(out, F.lit(ESCAPE + chr(97 + i)), F.lit(c))
    return F.when(F.contains(item, F.lit(ESCAPE)), out).otherwise(item)


def _pieces(value: Column) -> Column:
    """The value split at its quote characters, single quotes around whole items included."""
    v = F.when(value.rlike(f"[{BREAK}-{ESCAPE}]"), _escaped(value)).otherwise(value)
    v = F.regexp_replace(v, r'\\"', QUOTE)
    # a doubled quote is an escaped one inside a literal, but stands for itself between delimiters
    v = F.regexp_replace(v, rf'(?<![;,|\n\r\t\[ ])""(?!\s*(?:{DELIMITERS}|$))|(?<=[\p{{L}}\p{{N}} ])""(?=\.)|(?<= )""(?=[\p{{L}}\p{{N}}])', QUOTE)
    # 'name' standing between delimiters is quoted too; an apostrophe within a word is not
    v = F.regexp_replace(v, r"(?<=^|[;,|\n\r\t\[]|[;,|] )'([^'\"\n]*)'(?=\s*(?:$|[;,|\n\r\t<\]]))", '"$1"')
    return F.split(v, '"', -1)


def _join(pieces: Column, outside) -> Column:
    """One string again: literals between OPEN and CLOSE, and outside(piece) for the rest.

    The last piece of a value with an odd number of quotes has an open literal; it is read as outside."""
    n = F.size(pieces)
    one = lambda p, i: F.when((i % 2 == 1) & (i + 1 < n), F.concat(F.lit(OPEN), p, F.lit(CLOSE))).otherwise(outside(p))
    return F.array_join(F.transform(pieces, one), "")


def _strip(items: Column, clean) -> Column:
    return F.filter(F.transform(items, clean), lambda x: x != "")


def addresses(value: Column) -> Column:
    """array<string> of the bare addresses in the value, in order, as written.

    Names, brackets, comments and group names are left out; items without an @ (empty
    places) are dropped; repeated addresses stay. NULL gives NULL, '' an empty array.
    """
    def outside(p: Column) -> Column:
        # a slash parts addresses behind a host, where none can belong to it
        return F.regexp_replace(F.regexp_replace(p, r"(@[^\s<>()\[\],;:|/@]+>?)\s*/", f"$1{BREAK}"), DELIMITERS, BREAK)

    whole = _join(_pieces(value), outside)
    whole = F.regexp_replace(whole, r"\([^()]*\)", " ")

    def found(x: Column) -> Column:
        plain = F.regexp_extract_all(F.regexp_replace(x, f"{OPEN}[^{CLOSE}]*{CLOSE}", " "), F.lit(ADDRESS), 1)
        # an address within a literal counts only where the item has none outside (lists of quoted addresses)
        return F.when(F.size(plain) > 0, plain).otherwise(F.slice(F.regexp_extract_all(x, F.lit(ADDRESS), 1), 1, 1))

    items = F.flatten(F.transform(F.split(whole, BREAK, -1), lambda x: F.coalesce(found(x), F.array().cast("array<string>"))))
    return F.transform(items, _unescaped)


def files(value: Column) -> Column:
    """array<string> of the file names in the value, in order, inner quotes unescaped.

    A delimiter outside quotes ends a name only behind an extension, so that names may
    contain delimiters. Empty places are dropped, repeated names stay. NULL gives NULL.
    """
    def outside(p: Column) -> Column:
        p = F.regexp_replace(p, rf"(?i)({EXTENSION})\s*(?:(?:{DELIMITERS}|/)\s*)+", f"$1{BREAK}")
        return F.regexp_replace(p, rf"^\s*(?:{DELIMITERS}\s*)+|^\s*\[|\]\s*$", BREAK)

    whole = _join(_pieces(value), outside)
    # a literal is a whole item of its own unless it carries no extension
    whole = F.regexp_replace(whole, rf"(?i)({EXTENSION}){CLOSE}", f"$1{CLOSE}{BREAK}")
    return _strip(F.split(whole, BREAK, -1), lambda x: _unescaped(F.translate(F.trim(F.translate(x, OPEN + CLOSE, "")), QUOTE, '"')))


def unpack(emails: DataFrame, at_least: int = 1) -> DataFrame:
    """(email_id, field, pos, item): one row per value in to_addr, cc and attachments.

    pos counts from 1. Only fields that hold at_least items give rows. NULL, empty and
    default headers give none; repeated rows of the input give repeated rows; further
    columns are ignored. A narrow map: no shuffle at any size.
    """
    named = [F.struct(F.lit(f).alias("field"), F.when(F.col(f).isin(*ABSENT), F.lit(None)).otherwise(parse(F.col(f))).alias("items")) for f, parse in (("to_addr", addresses), ("cc", addresses), ("attachments", files))]
    rows = emails.select("email_id", F.explode(F.array(*named)).alias("f")).where(F.size("f.items") >= at_least)
    return rows.select("email_id", "f.field", F.posexplode("f.items").alias("pos", "item")).withColumn("pos", (F.col("pos") + 1).cast("int"))
