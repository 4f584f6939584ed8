import re

from hypothesis import given, settings
from hypothesis import strategies as st

from mailloom.functions.packed import unpack

SCHEMA = "email_id bigint, to_addr string, cc string, attachments string, field string, item string, pos string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, "x", "y", "z") for i, r in enumerate(rows)], SCHEMA)  # clashing extra columns
    out: dict = {}
    for r in unpack(df, **kw).orderBy("email_id", "field", "pos").collect():
        out.setdefault((r["email_id"], r["field"]), []).append(r["item"])
        assert r["pos"] == len(out[r["email_id"], r["field"]])
    return out


def test_addresses(spark):
    cases = [
        ("a@x.org, <b@y.org>; C D <c@z.org>\te@f.org | g@h.org", ["a@x.org", "b@y.org", "c@z.org", "e@f.org", "g@h.org"]),
        ('"Doe; Jane, X | Y" <j@x.org>,, "Q \\"Q\\" R" <q@x.org>,', ["j@x.org", "q@x.org"]),
        ("Doe, Jane <j@x.org>; k@x.org (K, the one)", ["j@x.org", "k@x.org"]),
        ('["a@x.org", "B <b@x.org>"]', ["a@x.org", "b@x.org"]),
        ("Team: a@x.org, b@x.org;", ["a@x.org", "b@x.org"]),
        ("'Jo' <a@x.org>\nA@X.ORG\na@x.org", ["a@x.org", "A@X.ORG", "a@x.org"]),
        ("a@x.org b@x.org", ["a@x.org", "b@x.org"]),
        ("a@x.org/b@y.org / <c/d@z.org>", ["a@x.org", "b@y.org", "c/d@z.org"]),
        ("a\ue000\ue004b@x.org, c@x.org", ["a\ue000\ue004b@x.org", "c@x.org"]),
        ("No Recipients", None), ("", None), (None, None), (" ; ,, ", None),
    ]
    got = run(spark, [(c, c, None) for c, _ in cases])
    for i, (_, want) in enumerate(cases):
        assert got.get((i, "to_addr")) == want and got.get((i, "cc")) == want


def test_files(spark):
    cases = [
        ('"a; b, c.pdf"; d, e.txt|f.7z', ["a; b, c.pdf", "d, e.txt", "f.7z"]),
        ('"x \\"y\\".csv", "x ""z"".csv"', ['x "y".csv', 'x "z".csv']),
        ("'p; q.doc';r.tar.zip;;r.tar.zip;", ["p; q.doc", "r.tar.zip", "r.tar.zip"]),
        ('["a b.html", "c; \\"d\\".eml"]', ["a b.html", 'c; "d".eml']),
        ("report v1.2, final.pdf\nb.png\t", ["report v1.2, final.pdf", "b.png"]),
        ("x.parquet; y.pdf", ["x.parquet", "y.pdf"]),
        ("a.pdf/b.docx", ["a.pdf", "b.docx"]),
        ("a\ue002b.pdf; c\ue001.txt", ["a\ue002b.pdf", "c\ue001.txt"]),
        ("", None), (None, None),
    ]
    got = run(spark, [(None, None, c) for c, _ in cases])
    for i, (_, want) in enumerate(cases):
        assert got.get((i, "attachments")) == want, cases[i]


def test_at_least_two_repeats_empty_and_long(spark):
    long = ", ".join(f"u{i}@x.org" for i in range(5000))
    got = run(spark, [("a@x.org", "a@x.org,b@x.org", "a.txt"), (long, None, None)], at_least=2)
    assert set(got) == {(0, "cc"), (1, "to_addr")} and len(got[1, "to_addr"]) == 5000
    df = spark.createDataFrame([(1, "a@x.org,b@x.org", None, None)] * 2, "email_id bigint, to_addr string, cc string, attachments string")
    assert unpack(df).count() == 4
    assert unpack(df.where("false")).count() == 0


NAME = st.from_regex(r"[A-Za-z][A-Za-z0-9 _;,|-]{0,12}[A-Za-z0-9]\.(pdf|txt|7z)", fullmatch=True)


def test_quoted_names_round_trip(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.lists(NAME, min_size=1, max_size=5), min_size=1, max_size=12))
    def check(lists):
        packed = ["; ".join('"' + n + '"' for n in names) for names in lists]
        got = run(spark, [(None, None, p) for p in packed])
        for i, names in enumerate(lists):
            assert got[i, "attachments"] == names

    check()


def test_addresses_against_brute_force(spark, sf):
    from mailloom.plans.storage import read

    e = read(spark, sf, "parse_eml")
    got = {(r["email_id"], r["field"]): r["n"] for r in unpack(e).where("field <> 'attachments'").groupBy("email_id", "field").count().withColumnRenamed("count", "n").collect()}
    for r in e.collect():
        for f in ("to_addr", "cc"):
            n = len(re.findall(r"[^\s<>(),;:|\"\[\]]+@[^\s<>(),;:|\"\[\]@]+", r[f] or ""))
            assert got.get((r["email_id"], f), 0) == n
