from pyspark.sql import functions as F

from mailloom.functions import cleaning, domains
from mailloom.operators import attachments, confusables, explain, highlight, identity, reasons, report, reviewer, scoring, urls, wording


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_domains(spark):
    assert column(spark, [" A.B.co.uk:80 ", "[::1]", "x.y.com.", "10.0.0.1", "com", "", None, "co.uk", "a.b.c.d.org"], domains.registrable) == ["b.co.uk", "::1", "y.com", "10.0.0.1", "com", None, None, "co.uk", "d.org"]
    assert column(spark, ["J <j@X.org>", "x@y.org (c)", "No Sender", None, '"a@b.c" <d@e.f>'], domains.address_of) == ["j@X.org", "x@y.org", None, None, "d@e.f"]
    assert column(spark, ["a@B.c@d", "none", None], domains.host_of) == ["b.c@d", None, None]
    assert column(spark, ["J <j@x.org>", "a@b.com, c@d.com", None], domains.parse_address) == ["j@x.org", None, None]


def test_received(spark):
    got = column(spark, [["x"] * 5, ["x"] * 6, ["x" * 1001, "y" * 1000], [], None], identity.received_anomaly, "array<string>")
    assert got == [None, "6 headers (>5)", "1 header(s) with length >1000", None, None]


def test_brands(spark):
    got = column(spark, ["Your PayPa1 bill", "bank-of america!", "chase bonk", "nothing", None, "pay pal"], lambda c: identity.brand_mentions(c, [n for n, _ in identity.BRANDS]), "string")
    assert got == [["paypal"], ["bank of america"], ["chase bank"], [], [], []]


def test_fuzzy_domains_count_characters_or_bytes(spark):
    hosts = ["acme.org", "acmee.org", "x.acme.org", "\xa0acme.org", "аcme.org", "ac\u200bme.org", "bücher.de", "bucher.de", "bècher.de", "", None, "far.org"]
    df = spark.createDataFrame([(h,) for h in hosts * 2], "host string")
    plain = {h: [m] for h, m in zip(hosts, ["acme.org"] * 4 + [None] * 2 + ["bücher.de"] * 3) if m}
    got = lambda **how: {r["host"]: r["matches"] for r in identity.fuzzy_domains(df, ["Acme.org", " bücher.de."], **how).collect()}
    assert got() == plain | {"аcme.org": ["acme.org"], "ac\u200bme.org": ["acme.org"]}
    # u for the two bytes of ü is two edits; è shares the first byte of ü, so it is one
    assert got(by_bytes=True) == {h: m for h, m in plain.items() if h != "bucher.de"}


def test_fuzzy_domain_match_equals_sql_on_letters_beyond_ascii(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    hosts = ["acme.org", "аcme.org", "ac\u2060me.org", "acm.org", "x.acme.org", "bucher.de", "bècher.de", "\u3000acme.org", "", None]
    spark.createDataFrame([(h,) for h in hosts], "host string").write.parquet(f"{tmp_path}/email_urls.parquet")
    cols = ["from_addr", "reply_to", "return_path", "subject", "body"]
    spark.createDataFrame([(1, "a@acme.оrg", "b@acmé.org", None, None, None), (2, None, "b@ACME.org", None, "", "")], f"email_id bigint, {', '.join(c + ' string' for c in cols)}").write.parquet(f"{tmp_path}/parse_eml.parquet")
    spark.createDataFrame([(1, "Acme", "acme.org"), (2, "Buch", "bücher.de")], "ord bigint, brand_name string, brand_domain string").write.parquet(f"{tmp_path}/known_brands.parquet")
    con = duckdb.connect()
    for t in ("email_urls", "parse_eml", "known_brands"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["fuzzy_domain_match"]).fetchall()
    got = [(r["host"], r["matches"]) for r in entry.queries()["fuzzy_domain_match"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and ("bècher.de", "bücher.de") in want and "аcme.org" not in dict(want)


def test_brand_lists(spark):
    lines = spark.createDataFrame([(0, "# c"), (1, "Acme | acme.com, ACME.org"), (2, " PayPal | pp.com"), (3, "Solo"), (4, "acme | acme.com"), (5, ""), (6, " | lone.org")], "ord int, value string")
    names, hosts = identity.brand_lists(lines, spark)
    assert [r["name"] for r in names.orderBy("ord").collect()] == ["acme", "paypal", "solo"] + [n for n, _ in identity.BRANDS if n != "paypal"]
    assert [r["domain"] for r in hosts.orderBy("ord").collect()] == ["acme.com", "acme.org", "pp.com", "lone.org"] + [x for _, x in identity.BRANDS]
    assert [x.count() for x in identity.brand_lists(None, spark)] == [7, 7]


def test_wording(spark):
    df = spark.createDataFrame([("URGENT", "x" * 399 + " password verify the login"), ("", ""), (None, None), ("urg", "ent")], "s string, b string")
    hits = wording.phrase_hits(wording.joined(F.col("s"), F.col("b")))
    rows = df.select(wording.lexical_points(hits).alias("p"), wording.positions(hits, F.col("s"), F.col("b")).alias("w")).collect()
    assert rows[0]["p"] == 4 and [(w["location"], w["points"]) for w in rows[0]["w"]] == [("subject", 3), ("body", 1), ("body", 1), ("body", 1)]
    assert [r["p"] for r in rows[1:]] == [0, 0, 0]


def test_decompose(spark):
    got = column(spark, ["https://u:p@A.com:8/x;y?q=1#f", "http://[::1]/a", "www.x.org/login?a", "http://[x", "http://a_b.com"], urls.decompose)
    assert [tuple(g) if g else None for g in got] == [("https", "a.com", "/x", "q=1"), ("http", "::1", "/a", ""), ("", "", "www.x.org/login", "a"), None, ("http", "a_b.com", "", "")]


def test_running_cap_in_both_forms(spark):
    body = "http://secure.top/login?verify=1 http://b.xyz/password/login?auth=1 http://bit.ly/a http://1234.x.org/ http://bit.ly/a http://github.com/ www.a.b/login"
    df = spark.createDataFrame([(1, body)], "email_id bigint, body string")
    links = df.select(urls.findings(F.col("body"), F.lit("me.org")).alias("l")).first()["l"]
    assert [(x["score"], x["applied"]) for x in links] == [(5, 4), (6, 4), (3, 0), (2, 0), (1, 0)]
    p = df.select("email_id", F.posexplode(urls.extract(F.col("body"))).alias("pos", "url")).withColumn("p", urls.decompose(F.col("url"))).select("email_id", "pos", "url", "p.scheme", "p.host", "p.path", F.col("p.query").alias("query_str"))
    q = urls.first_of_each(p).withColumn("f", urls.finding(F.col("host"), F.col("path"), F.col("query_str"), F.lit("me.org"))).withColumn("score", F.col("f.score"))
    assert [r["applied"] for r in urls.running_cap(q).orderBy("pos").collect()] == [4, 4, 0, 0, 0]


def test_many_links_in_one_message(spark):
    import time

    body = " ".join(f"http://h{i % 1500}.top/login?a={i % 1500}" for i in range(2000))
    df = spark.createDataFrame([(1, body)], "email_id bigint, body string").select(urls.findings(F.col("body"), F.lit("me.org")).alias("l"))
    df.collect()
    began = time.perf_counter()
    links = df.first()["l"]
    assert len(links) == 1500 and [x["applied"] for x in links[:4]] == [4, 4, 0, 0] and links[7]["url"].startswith("http://h7.")
    assert time.perf_counter() - began < 2


def test_attachments(spark):
    rows = column(spark, [["a.EXE", "b.txt", "c" * 97 + ".zip", "c" * 96 + ".zip"], []], lambda c: F.struct(F.size(attachments.dangerous(c)), F.size(attachments.odd_archives(c))), "array<string>")
    assert [tuple(r) for r in rows] == [(1, 1), (0, 0)]


def test_confusables(spark):
    assert confusables.skeleton("раураl.com") == "paypal.com" and confusables.skeleton("straße") == "strasse"
    refs = ["paypal.com", None, "zоё.com"]
    hosts = ["раураl.com", "xn--a.com", "a​.com", "PayPal.com", "ünï.com", "plain.com", None, "", "zoe.com", "日本.com", "ð-đ-ł.org"]
    want = ["confusable match for paypal.com", "punycode label", "zero-width characters", None, "confusable skeleton uni.com", None, None, None, "confusable match for zоё.com", "non-ascii characters", "confusable skeleton d-d-l.org"]
    assert column(spark, hosts, lambda c: confusables.host_reason(c, refs)) == want
    assert column(spark, ["раураl.com", "plain.com"], confusables.host_reason) == ["confusable skeleton paypal.com", None]
    assert column(spark, ["a​b", "ab", None], confusables.contains_zero_width) == [True, False, False]


EMAIL = "email_id bigint, from_addr string, reply_to string, return_path string, message_id string, subject string, body string, attachments string, received array<string>, score int"


def test_score_equals_its_explanations(spark):
    rows = [
        (1, "A <a@gmail.com>", "b@evil.org", "c@other.org", "x@third.org", "Urgent", "PayPal: verify your password http://bit.ly/login", 'x.exe; "y.txt"', ["r"] * 6, 0),
        (2, None, None, None, None, None, None, None, None, None), (3, "", "", "", "", "", "", "", [], 1), (4, "a@pаypal.com", None, None, None, "hi", "lunch " * 20_000, "", ["r"], 1),
    ]
    got = {r["email_id"]: r for r in scoring.score(spark.createDataFrame(rows, EMAIL)).collect()}
    assert [got[i]["label"] for i in (1, 2, 3, 4)] == ["HIGH", "LOW", "LOW", "LOW"] and got[2]["score"] == got[3]["score"] == 0 and got[4]["score"] == 3
    for r in got.values():
        total = sum(int(x.split()[0]) for x in r["explanations"])
        assert r["score"] == max(0, total)
    assert got[1]["explanations"][-1] == "-4 points: gmail.com in whitelist" and got[1]["matched_keywords"][0] == "Urgent"
    assert scoring.score(spark.createDataFrame([], EMAIL)).count() == 0


def test_labels_at_the_borders(spark):
    assert column(spark, [4, 5, 9, 10], scoring.label_of, "int") == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]
    assert column(spark, [-1, 0, 1, 2, 30], report.percent, "int") == [0, 0, 100, 20, 100]
    assert column(spark, ["a" * 500, "a" * 501, None], report.preview) == ["a" * 500, "a" * 500 + "...", None]


def test_explanations(spark):
    got = column(spark, ["+3 points: Reply-to domain differs from From domain (x.org)", "+1 point: odd thing.", "-4 points: a.com in whitelist", "+2 points: Keyword 'login' in early body"], lambda c: explain.humanise(reasons.parsed(c)))
    assert got[0] == "3-point" + "s indicator: The reply-to address routes responses to x.org, which differs from the visible sender domain. Attackers often redirect replies to capture sensitive information. Action: Confirm the request using a known-good channel before replying."
    assert got[1] == "1-point indicator: Indicator: odd thing. Action: Verify the message with the sender via a trusted channel before taking action."
    assert got[2].startswith("4-points mitigation: The sender domain a.com is on") and "The early body includes the phishing trigger word 'login'" in got[3]


def test_lines_and_reasons_round_trip(spark):
    lines = [
        "+3 points: Reply-to domain differs from From domain (x.org)", "+2 points: Return-path domain differs from From domain (x.org)", "+3 points: From domain contains IDN or confusable characters (punycode label in xn--a.org)",
        "+2 points: Free email provider (gmail.com) with brand mention (a, b)", "+2 points: Anomalous Received headers (1 header(s) with length >1000)", "+1 point: Message-ID domain mismatch (x.org)",
        "+1 points: Matched phishing language (login prompt)", "+1 points: Keyword 'log in' in early body", "+4 points: Suspicious URL http://a/(b) (High-risk TLD; URL shortener)", "+4 points: Dangerous attachment extension in a in b.exe",
        "+2 points: Suspicious archive attachment x.zip", "-4 points: a.com in whitelist", "+1 point: something else", "no points at all",
    ]
    assert column(spark, lines[:-1], lambda c: reasons.line(reasons.parsed(c))) == lines[:-1]
    got = column(spark, lines, reasons.parsed)
    assert [g["kind"] for g in got] == [*reasons.TEXTS, "other", "other"] and got[-1]["points"] == 0 and got[8]["parts"] == ["http://a/(b)", "High-risk TLD; URL shortener"]
    odd = column(spark, ["+3 points: Reply-to domain differs", "Suspicious URL", None], lambda c: explain.humanise(reasons.parsed(c)))
    assert "routes responses to an unknown domain, which" in odd[0] and odd[1].startswith("The link a linked site looks risky (suspicious characteristics). Action:")


def test_explanation_list(spark):
    df = spark.createDataFrame([("HIGH", 12, ["+4 points: Dangerous attachment extension in a.exe"], ["login", "login", "x"], [("http://a",)], ["a.exe", "b"]), ("LOW", 0, [], [], [], [])], "label string, score int, r array<string>, k array<string>, u array<struct<url:string>>, f array<string>")
    found = F.transform("r", reasons.parsed)
    high, low = (r["x"] for r in df.select(explain.explanations(F.col("label"), F.col("score"), found, F.col("k"), F.col("u"), F.col("f")).alias("x")).collect())
    assert high[0].endswith("Flagged keywords: login, x.") and high[-1].startswith("Action checklist: Delete the attachment") and high[-1].endswith("; ....")
    assert low == ["Low phishing risk: composite score 0. No immediate red flags were detected, but stay vigilant.", explain.NOTHING_LOW]


def test_highlight():
    assert highlight.marked("Login <b> http://a?x&y", ["login"], [("http://a?x&y", ["R"])]) == '<mark title="Matched phishing keyword">Login</mark> &lt;b&gt; <mark title="R">http://a?x&amp;y</mark>'


def test_highlighted_rows(spark):
    kind = "email_id bigint, body string, matched_keywords array<string>, suspicious_urls array<struct<url:string,reasons:array<string>,score:int>>, marked string"
    df = spark.createDataFrame([(1, "a <Login>", ["login"], [("http://x", ["A", "B"], 2)], "c"), (2, None, ["x"], [], "c"), (3, "see http://x", None, [("http://x", None, 1)], "c")], kind)
    got = {r["email_id"]: r["marked"] for r in highlight.highlighted(df, "email_id").collect()}
    assert got == {1: 'a &lt;<mark title="Matched phishing keyword">Login</mark>&gt;', 2: None, 3: 'see <mark title="Suspicious link">http://x</mark>'}
    assert highlight.highlighted(df.where("false"), "email_id").count() == 0


def test_cleaning(spark):
    values = ["a​b  c \n\n\n\n d\t", "plain  x \n\n\n y ", None, "", "ﬁ x"]
    assert column(spark, values, cleaning.clean_text) == [cleaning.clean_characters(v) for v in values] == ["ab c\n\nd", "plain x\n\ny", "", "", "fi x"]
    assert cleaning.html_text("<p>a<script>x</script></p><div style='display:none'>h</div><br>b &amp; c") == "a\nb & c"


def test_reviewer(spark):
    raws = ['{"probability": "80", "indicators": ["x"], "reasoning": "r"}', "", "not json", '{"probability": null}', None]
    got = column(spark, raws, reviewer.parse_reply)
    assert [bool(g["error"]) for g in got[:4]] == [False, False, True, False] and got[0]["reply"]["probability"] == "80"
    df = spark.createDataFrame([("80", ["x"], "r"), ("50", None, None), ("odd", [], "")], "p string, i array<string>, r string")
    v = [tuple(r["v"]) for r in df.select(reviewer.verdict(F.col("p"), F.col("i"), F.col("r")).alias("v")).collect()]
    assert v == [("phishing", 0.8, ["Suspicious indicator: x", "LLM reasoning: r"]), ("safe", 0.5, []), ("safe", 0.0, [])]
    assert column(spark, [None, "", "gpt-4o-mini", "other"], reviewer.model_or_default) == ["gpt-5-nano", "gpt-5-nano", "gpt-4o-mini", None]


def test_get_or_create_asks_each_digest_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def provider(prompts):
        asked.add(len(prompts))
        return ["{}"] * len(prompts)

    req = spark.createDataFrame([(1, "m", "a", "p"), (2, "m", "a", "p"), (3, "m", "b", "q"), (4, "m", "c", "q")], "id int, model string, digest string, prompt string")
    cache = spark.createDataFrame([("m", "b", "2024-01-01 00:00:00", "new"), ("m", "b", "2023-12-31 23:59:00", "old"), ("m", "c", "2023-12-31 23:00:00", "stale")], "model string, digest string, ts string, payload string").withColumn("ts", F.to_timestamp("ts"))
    rows = {r["id"]: r for r in reviewer.get_or_create(req, cache, F.lit("2024-01-01 00:02:00").cast("timestamp"), provider).collect()}
    assert [rows[i]["cached"] for i in (1, 2, 3, 4)] == [False, False, True, False] and rows[3]["payload"] == "new" and asked.value == 2


def test_batches_keep_their_order_and_fail_as_a_whole(spark):
    def provider(prompts):
        if any("boom" in p for p in prompts):
            raise ValueError("no")
        return ['{"probability": 80}' if "bad" in p else "odd" if "odd" in p else "{}" for p in prompts]

    item = lambda body, model=None: (("a@x.org", "s", body, None), model)
    rows = [(1, [item("x"), item("bad"), item("x", "gpt-4o-mini")]), (2, [item("x"), item("boom")]), (3, [item("x", "other")]), (4, []), (5, None), (6, [item("odd")])]
    df = spark.createDataFrame(rows, "batch_id int, items array<struct<parsed:struct<from_addr:string,subject:string,body:string,attachments:string>,model:string>>")
    cache = spark.createDataFrame([], "model string, digest string, ts timestamp, payload string")
    got = {r["batch_id"]: r for r in reviewer.review_batches(df, cache, F.current_timestamp(), provider=provider).collect()}
    assert [tuple(x) for x in got[1]["results"]] == [(0, "gpt-5-nano", "safe", 0.0), (1, "gpt-5-nano", "phishing", 0.8), (2, "gpt-4o-mini", "safe", 0.0)] and got[1]["error"] is None
    assert got[2]["results"] is None and "no" in got[2]["error"] and got[3]["error"] == "model not allowed: other" and "parse" in got[6]["error"] and set(got) == {1, 2, 3, 6}


def test_compatible_wiring(spark):
    row = (1, "a@x.org", "b@y.org", "c@z.org", None, "", "", "a.exe; b.txt", ["r"] * 9, 0)
    df = spark.createDataFrame([row], EMAIL)
    assert scoring.score(df).first()["score"] == 3 + 2 + 2 + 4
    assert scoring.score(df, compat_wiring=True).first()["score"] == 0
    assert column(spark, ["/login", "/x", None], lambda c: urls.looks_like_harvest(c, F.lit(""))) == [True, False, False]
