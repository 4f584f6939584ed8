"""Domains and addresses as Column expressions. NULL and '' are both "absent" and give NULL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Two-label public suffixes under which three labels make a registrable domain.
SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "gov.au", "com.au", "co.jp", "com.br", "com.mx"]
#: Header defaults that stand for "absent".
ABSENT = ["No Sender", "No Recipients", "No Subject", "No Date"]

ADDRESS = r"([^\s<>()\[\],;:\"]+@[^\s<>()\[\],;:\"@]+)"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used; keeps nested expressions small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(c: Column) -> Column:
    """The value, or NULL where it is ''."""
    return bind(c, lambda x: F.when(x != "", x))


_REGISTRABLE = rf"(^[0-9.]+$|(?:(?<=\.)|^)[^.]+\.(?:{'|'.join(x.replace('.', chr(92) + '.') for x in SUFFIXES)})$|(?:(?<=\.)|^)[^.]+\.[^.]+$|^[^.]+$)"


def strip_port(domain: Column) -> Column:
    """Lower case, without white space around, brackets of an IPv6 literal, port and outer dots."""
    s = F.lower(F.trim(domain, F.lit(" \t\r\n")))
    return present(F.regexp_replace(s, r"(?s)^\[(.*)\]$|^\.*([^:]*?)\.*(?::.*)?$", "$1$2"))


def registrable(domain: Column) -> Column:
    """The registrable part: the last two labels, three under a known suffix; addresses of digits as they are."""
    return present(F.regexp_extract(strip_port(domain), _REGISTRABLE, 1))


def address_of(header: Column) -> Column:
    """The bare address of a header: the one in angle brackets, else the first one; NULL where there is none."""
    angle = F.regexp_extract(header, r"<\s*([^<>@\s]+@[^<>@\s]+?)\s*>", 1)
    return bind(angle, lambda x: F.when(x != "", x).otherwise(present(F.regexp_extract(header, ADDRESS, 1))))


def host_of(address: Column) -> Column:
    """The host of an address, behind its first @, normalised; NULL without an @."""
    return strip_port(present(F.regexp_extract(address, "(?s)^[^@]*@(.*)$", 1)))


@F.pandas_udf(T.StringType())
def parse_address(header: pd.Series) -> pd.Series:
    """The address by the strict rules of RFC 2822 headers (lists and malformed values give NULL)."""
    from email.utils import parseaddr

    return header.map(lambda h: (parseaddr(h)[1] or None) if h else None)


def first_address(header: Column) -> Column:
    """The first address of a header that lists several; NULL where there is none."""

    @F.pandas_udf("string")
    def first(s: pd.Series) -> pd.Series:
        from email.utils import getaddresses

        return s.map(lambda h: next((a for _, a in getaddresses([h]) if a), None) if h else None)

    return first(header)
