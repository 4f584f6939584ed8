"""Normalise date headers in many notations to one UTC instant (problem 6).

The parser is an ordered cascade of anchored patterns. Each pattern rewrites the
value to one canonical, bar-separated form (year|month|day|hour|minute|second|
fraction|am-pm|zone); the canonical parts are then checked strictly. Everything is
built-in Catalyst expressions, so the operator is a narrow map without a shuffle.

Policy for local times (values that state no zone): the zone of the message's
gateway applies; a repeated hour means its earlier instant; a skipped hour is read
with the offset valid before the change. A stated numeric offset wins over a zone
name, a bracketed region or a comment; a region alone is the zone, and local times in
it are read by the same policy. A weekday is never checked. Dates with dots are day
first, dates with slashes as the gateway says, dates that begin with the year year
first. Zone names that nobody can place (single letters but Z, unknown abbreviations
and regions) give nothing instead of a guess.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and abbreviations, in order January to December.
MONTHS = [
    "jan january januar janv janvier ene enero janeiro jän янв января",
    "feb february februar févr fév février febrero fev fevereiro фев февраля",
    "mar march mär märz mrz mars marzo março мар марта",
    "apr april avr avril abr abril апр апреля",
    "may mai mayo maio мая",
    "jun june juni juin junio junho июн июня",
    "jul july juli juil juillet julio julho июл июля",
    "aug august août aou ago agosto авг августа",
    "sep sept september septembre septiembre set setembro сен сентября",
    "oct october okt oktober octobre octubre out outubro окт октября",
    "nov november novembre noviembre novembro ноя ноября",
    "dec december dez dezember déc décembre dic diciembre dezembro дек декабря",
]
# Zone abbreviations and their offsets in minutes.
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "aest": 600, "aedt": 660, "brt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "art": -180, "clt": -240, "cot": -300, "pet": -300,
    "sast": 120, "cat": 120, "eat": 180, "wat": 60, "trt": 180, "gst": 240, "pkt": 300, "npt": 345, "ict": 420, "wib": 420,
    "hkt": 480, "sgt": 480, "pht": 480, "awst": 480, "kst": 540, "acst": 570, "acdt": 630, "nzst": 720, "nzdt": 780,
}

_W = r"[\p{L}]+\.?"
_OFF = r"(?:(?:gmt|utc)(?=[+-]))?[+-]\d{1,2}(?::?\d{2})?"
_REGION = r"[a-z_]+(?:/[a-z0-9_+-]+)+"
_ZONE = rf"(?:({_OFF}|[a-z]{{1,5}}(?![a-z_/])|\[?{_REGION}\]?)(?:\[[^\]]*\]| [a-z_]+(?:/[a-z_]+)*)?)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: (pattern, canonical form); the order is the order of the cascade.
CASCADE = [
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:t|,? ){_TIME} ?{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8||$9"),
    (rf"^(?:{_W},? ?)?(\d{{1,2}}) ({_W}) (\d{{4}}|\d{{2}}) {_TIME} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(?:{_W},? ?)?(\d{{1,2}})-({_W})-(\d{{4}}|\d{{2}}) (\d{{1,2}})[.:](\d{{2}})(?:[.:](\d{{2}}))? ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|||$7"),
    (rf"^{_W},? ({_W}) (\d{{1,2}}) {_TIME} (?:([a-z]{{1,5}}|{_OFF}) )?(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?(z|[+-]\d{4})?$", "$1|$2|$3|$4|$5|$6|||$7"),
    (rf"^(?:{_W},? ?)?(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_TIME} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(?:{_W},? )?({_W}) (\d{{1,2}}),? (\d{{4}}),? {_TIME} ?([ap]m)? ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:{_W},? )?(\d{{1,2}})\.? ({_W}) (\d{{4}}|\d{{2}}),? {_TIME} ?([ap]m)? ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    # the time before the date, the zone behind either
    (rf"^{_TIME} ?([ap]m)?(?: ({_OFF}|utc|gmt))?,? (?:{_W},? )?(\d{{1,2}})\.? ({_W}) (\d{{4}})$", "$9|$8|$7|$1|$2|$3|$4|$5|$6"),
    (rf"^{_TIME} ?([ap]m)?,? (\d{{4}})-(\d{{2}})-(\d{{2}}) ?{_ZONE}$", "$6|$7|$8|$1|$2|$3|$4|$5|$9"),
]
_SLASH = rf"^(?:{_W},? )?(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_TIME} ?([ap]m)? ?{_ZONE}$"
_EPOCH = r"^(\d{10})(?:\.(\d{1,6}))?$"


def _numbers(values: dict[str, int]) -> Column:
    """The values as a map of strings, written as one literal."""
    return F.str_to_map(F.lit(" ".join(f"{k}={v}" for k, v in values.items())), F.lit(" "), F.lit("="))


def _month(name: Column) -> Column:
    table = _numbers({n: i for i, names in enumerate(MONTHS, 1) for n in names.split()})
    return F.try_element_at(table, F.regexp_replace(name, r"\.$", "")).try_cast("int")


def _region(value: Column) -> Column:
    """The region that a value names as its zone, in the spelling of the zone database; NULL where there is none such."""
    name = F.regexp_extract(value, rf"(?i)({_REGION})\]?\s*(?:\(.*)?$", 1)
    words = F.transform(F.split(F.translate(name, "_", " "), "/"), lambda x: F.initcap(x))
    spelt = F.when(name == F.lower(name), F.translate(F.array_join(words, "/"), " ", "_")).otherwise(name)
    known = " ".join(sorted(z for z in zoneinfo.available_timezones() if "/" in z))
    return F.when(F.contains(F.lit(f" {known} "), F.concat(F.lit(" "), spelt, F.lit(" "))), spelt)


def utc_micros(value: Column, tz_name: Column, day_first: Column) -> Column:
    """Microseconds since 1970-01-01 UTC, or NULL where no possible instant is stated.

    NULL, empty and free text give NULL; impossible dates or times give NULL; a NULL
    tz_name means UTC and a NULL day_first means month first. Longer fractions than
    six digits are cut.
    """
    s = F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))
    # comments nest; each round takes out the innermost ones, so as many rounds as there are brackets are enough
    opened = F.length(s) - F.length(F.replace(s, F.lit("("), F.lit("")))
    bare = F.aggregate(F.sequence(F.lit(1), opened), s, lambda t, _: F.when(F.contains(t, F.lit("(")), F.regexp_replace(t, r" ?\([^()]*\)", "")).otherwise(t))
    s = F.trim(F.when(opened > 0, bare).otherwise(s))

    def canonical(s: Column) -> Column:
        out = None
        for pattern, form in CASCADE:
            c = F.regexp_replace(s, pattern, form)
            out = F.when(s.rlike(pattern), c) if out is None else out.when(s.rlike(pattern), c)
        day, month = F.when(day_first, F.lit("$3|$2|$1")).otherwise(F.lit("$3|$1|$2")), F.lit("|$4|$5|$6|$7|$8|$9")
        return out.when(s.rlike(_SLASH), F.regexp_replace(s, F.lit(_SLASH), F.concat(day, month)))

    def instant(a: Column) -> Column:
        part = lambda i: F.get(a, F.lit(i))
        num = lambda c: c.try_cast("int")
        year, mon, hour = num(part(0)), part(1), num(part(3))
        year = F.when(F.length(part(0)) <= 2, year + F.when(year < 50, 2000).otherwise(1900)).otherwise(year)
        month = F.when(mon.rlike(r"^\d+$"), num(mon)).otherwise(_month(mon))
        half = part(7)
        good = F.when(half == "", hour <= 23).otherwise((hour >= 1) & (hour <= 12))
        hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
        second = F.when(part(5) == "", F.lit(0)).otherwise(num(part(5)))
        micro = num(F.substring(F.rpad(part(6), 6, "0"), 1, 6))
        micro = F.when(part(6) == "", F.lit(0)).otherwise(micro)
        zone = part(8)
        named = F.try_element_at(_numbers(ZONES), zone).try_cast("int")
        signed = F.regexp_extract(zone, r"([+-])(\d.*)$", 2)
        # hours alone, or hours and two digits of minutes
        digits = F.translate(F.when(F.length(signed) <= 2, F.concat(signed, F.lit("00"))).otherwise(signed), ":", "")
        oh, om = num(F.substring(F.lpad(digits, 4, "0"), 1, 2)), num(F.substring(F.lpad(digits, 4, "0"), 3, 2))
        numeric = F.when((oh <= 18) & (om <= 59), F.when(F.contains(zone, F.lit("-")), -1).otherwise(1) * (oh * 60 + om))
        offset = F.when(zone.rlike(r"^(?:gmt|utc)?[+-]"), numeric).otherwise(named)
        made = lambda tz: F.unix_micros(F.try_make_timestamp(year, month, num(part(2)), hour, num(part(4)), second.cast("decimal(16,6)"), tz))
        us = (
            F.when(zone == "", made(F.coalesce(tz_name, F.lit("UTC"))))
            .when(F.contains(zone, F.lit("/")), made(_region(value)))
            .otherwise(made(F.lit("UTC")) - offset.cast("bigint") * 60_000_000)
        )
        return F.when(good & (second <= 59), us + micro)

    def whole(s: Column) -> Column:
        epoch = F.regexp_extract(s, _EPOCH, 1).try_cast("bigint") * 1_000_000 + F.coalesce(F.rpad(F.regexp_extract(s, _EPOCH, 2), 6, "0").try_cast("bigint"), F.lit(0))
        return (
            F.when(s.rlike(_EPOCH), epoch)
            .when(s.rlike(r"^\d{13}$"), s.try_cast("bigint") * 1000)
            .when(s.rlike(r"^\d{16}$"), s.try_cast("bigint"))
            .otherwise(F.get(F.transform(F.array(F.split(canonical(s), r"\|", -1)), instant), F.lit(0)))
        )

    # transform() over a one-element array binds each step once, so that no pattern runs again for every part
    return F.get(F.transform(F.array(s), whole), F.lit(0))


def normalise_dates(emails: DataFrame, gateways: DataFrame) -> DataFrame:
    """(email_id, utc_us) of every message whose date_hdr states an instant.

    emails needs email_id, date_hdr and gateway, gateways needs gateway, tz_name and
    day_first; other columns are ignored, so clashing names do no harm. A gateway that
    is NULL or unknown means UTC and month first. Should gateways list a name twice, the
    smallest zone counts, so that no message is doubled. Empty tables give an empty result.
    gateways stays a plain join side: Catalyst broadcasts it only below its own size limit.
    """
    g = gateways.groupBy(F.col("gateway").alias("_g")).agg(F.min("tz_name").alias("_tz"), F.min("day_first").alias("_df"))
    e = emails.select("email_id", F.col("date_hdr").alias("_d"), F.col("gateway").alias("_eg")).where(F.col("_d").isNotNull())
    us = utc_micros(F.col("_d"), F.col("_tz"), F.coalesce(F.col("_df"), F.lit(False)))
    return e.join(g, F.col("_eg") == F.col("_g"), "left").select("email_id", us.alias("utc_us")).where(F.col("utc_us").isNotNull())
