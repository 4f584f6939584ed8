from datetime import UTC, datetime

from mailloom.functions.timestamps import normalise_dates


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000) if len(a) < 7 else int(datetime(*a[:6], tzinfo=UTC).timestamp()) * 1_000_000 + a[6]


CASES = [
    ("Mon, 18 Sep 2023 08:24:35 +0200", "de", us(2023, 9, 18, 6, 24, 35)),
    ("Mo, 18 Okt 2023 08:24 GMT", "de", us(2023, 10, 18, 8, 24)),
    ("Mon,20  Mar 2023  21:57:53+0100", "us", us(2023, 3, 20, 20, 57, 53)),
    (" wed, 10 MAY 2023\t20:17:10 +0100 (a (nested) comment) ", "us", us(2023, 5, 10, 19, 17, 10)),
    ("31-Oct-2024 17.58.12 -0000", "us", us(2024, 10, 31, 17, 58, 12)),
    ("2 févr. 2023 07:47", "de", us(2023, 2, 2, 6, 47)),
    ("1 août 2021 23:31", "utc", us(2021, 8, 1, 23, 31)),
    ("5 Jan 72 10:00 +0000", "utc", us(1972, 1, 5, 10, 0)),
    ("2022-11-02T00:25:36-04:00[America/New_York]", "de", us(2022, 11, 2, 4, 25, 36)),
    ("2022-12-14 03:36:03 -0500 Europe/Berlin", "de", us(2022, 12, 14, 8, 36, 3)),
    ("2021-12-08T06:16:26,974-07:00", "de", us(2021, 12, 8, 13, 16, 26, 974000)),
    ("20230316T153615Z", "de", us(2023, 3, 16, 15, 36, 15)),
    ("02/04/2023 2:03:07 AM", "us", us(2023, 2, 4, 7, 3, 7)),
    ("02/04/2023 12:03", "de", us(2023, 4, 2, 10, 3)),
    ("March 24, 2023 12:49 PM", "utc", us(2023, 3, 24, 12, 49)),
    ("March 24, 2023 12:49 AM", "utc", us(2023, 3, 24, 0, 49)),
    ("Sat Jun 26 03:28:01 CEST 2021", "us", us(2021, 6, 26, 1, 28, 1)),
    ("29.10.2023 02:30:00", "de", us(2023, 10, 29, 0, 30)),  # repeated hour: the earlier instant
    ("26.03.2023 02:30:00", "de", us(2023, 3, 26, 1, 30)),  # skipped hour: offset before the change
    ("1679996295518", "de", us(2023, 3, 28, 9, 38, 15, 518000)),
    ("1730799367.2", "de", us(2024, 11, 5, 9, 36, 7, 200000)),
    ("2023-01-01 10:00:00", None, us(2023, 1, 1, 10, 0)),
    ("2023-01-01 10:00:00", "unknown", us(2023, 1, 1, 10, 0)),
    ("2024-05-06T10:00+02", "us", us(2024, 5, 6, 8, 0)),
    ("2024-05-06 10:00 Europe/Berlin", "us", us(2024, 5, 6, 8, 0)),
    ("2024-05-06 10:00 [america/new_york]", "de", us(2024, 5, 6, 14, 0)),
    ("2024-05-06 10:00 Europe/Nowhere", "de", None),
    ("06.05.24 10:00", "us", us(2024, 5, 6, 14, 0)),
    ("2024/05/06 10:00:00", "utc", us(2024, 5, 6, 10, 0)),
    ("2024.5.6, 10:00:00.5 UTC+5:30", "utc", us(2024, 5, 6, 4, 30, 0, 500000)),
    ("10:00 6 May 2024", "utc", us(2024, 5, 6, 10, 0)),
    ("10:00:01 AM -0300, Mon, 6 May 2024", "utc", us(2024, 5, 6, 13, 0, 1)),
    ("Mon, 6 May 2024 10:00 HKT", "utc", us(2024, 5, 6, 2, 0)),
    ("6 May 2024 10:00 AKST (a (b (c (d (e)))))", "utc", us(2024, 5, 6, 19, 0)),
    ("6 May 2024 3:00 pm GMT+2", "utc", us(2024, 5, 6, 13, 0)),
    ("29.10.2023 02:30 Europe/Berlin", "us", us(2023, 10, 29, 0, 30)),
    ("2023-01-01 10:00 X", "utc", None),
] + [(x, "de", None) for x in ("No Date", "", None, "31 Jun 2023 07:45:10 +0200", "2023-13-45T25:61:00Z", "12:00", "13/13/2023 10:00", "0000-00-00 00:00:00", "2023-01-01 24:00:00", "x" * 100_000, "2023-01-01T10:00:00 FOOZ", "13:00 PM")]


def test_cascade(spark):
    e = spark.createDataFrame([(i, d, g, "clash") for i, (d, g, _) in enumerate(CASES)], "email_id bigint, date_hdr string, gateway string, tz_name string")
    g = spark.createDataFrame([("de", "Europe/Berlin", True, 1), ("us", "America/New_York", False, 1), ("utc", "UTC", True, 1), (None, "Asia/Tokyo", True, 1)], "gateway string, tz_name string, day_first boolean, email_id int")
    got = {r["email_id"]: r["utc_us"] for r in normalise_dates(e, g).collect()}
    for i, (d, _, want) in enumerate(CASES):
        assert got.get(i) == want, (d, got.get(i), want)


def test_empty_repeats_and_doubled_gateways(spark):
    e = spark.createDataFrame([(1, "2023-01-01 10:00:00", "g")] * 2, "email_id bigint, date_hdr string, gateway string")
    g = spark.createDataFrame([("g", "UTC", True), ("g", "UTC", False)], "gateway string, tz_name string, day_first boolean")
    assert normalise_dates(e, g).count() == 2
    assert normalise_dates(e.where("false"), g).count() == 0
    assert normalise_dates(e, g.where("false")).count() == 2
