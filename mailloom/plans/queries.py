"""Queries of the core operators, by name; their SQL is in mailloom.plans.oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import cleaning, domains, packed, timestamps
from mailloom.operators import attachments, confusables, explain, highlight, identity, learning, report, reviewer, scoring, urls, wording
from mailloom.plans.oracles import ORACLES as ORACLES
from mailloom.plans.storage import cut, read, spread
from mailloom.sources import messages
from mailloom.streaming import scored

#: In this project's data no sender uses a well-known free mail provider; these domains stand for them.
FREEMAIL = ["co.example", "havurship-desk.test", "ildonpay.invalid", "maribank.example", "ulmamart-desk.test"]
WHITELIST = ["co.example", "holuvor-office.example"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _emails(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "parse_eml")


def _brands(spark: SparkSession, d: str) -> tuple[list[str], list[str]]:
    """Names and domains of the brand table, whose size is checked before it is collected."""
    rows = read(spark, d, "known_brands").orderBy("ord").limit(identity.MAX_BRANDS + 1).collect()
    if len(rows) > identity.MAX_BRANDS:
        raise ValueError("the brand table is too large for an array of every row")
    return [r["brand_name"].lower() for r in rows if r["brand_name"]], [r["brand_domain"].lower() for r in rows if r["brand_domain"]]


@query
def p2_found(spark, d):
    return packed.unpack(spread(_emails(spark, d).select("email_id", "to_addr", "cc", "attachments")), at_least=2).distinct()


@query
def p2_items(spark, d):
    return packed.unpack(spread(_emails(spark, d).select("email_id", "to_addr", "cc", "attachments")))


@query
def p2_address_items(spark, d):
    return packed.unpack(spread(_emails(spark, d).select("email_id", "to_addr", "cc").withColumn("attachments", F.lit(None).cast("string"))))


@query
def p6_found(spark, d):
    return timestamps.normalise_dates(_emails(spark, d), read(spark, d, "gateways"))


@query
def sender_domains(spark, d):
    e = _emails(spark, d).select("email_id", domains.host_of(domains.address_of(F.col("from_addr"))).alias("host"))
    return e.select("email_id", "host", domains.registrable(F.col("host")).alias("domain")).where("host is not null")


@query
def strict_addresses(spark, d):
    e = _emails(spark, d)
    return e.select("email_id", domains.parse_address(F.col("from_addr")).alias("strict"), domains.first_address(F.col("to_addr")).alias("first_to"))


def _mismatch(spark, d, column):
    host = lambda c: domains.registrable(domains.host_of(domains.address_of(F.col(c))))
    e = _emails(spark, d).select("email_id", identity.differs(host(column), host("from_addr")).alias("domain"))
    return e.where("domain is not null")


@query
def replyto_mismatch(spark, d):
    return _mismatch(spark, d, "reply_to")


@query
def returnpath_mismatch(spark, d):
    return _mismatch(spark, d, "return_path")


@query
def msgid_domain_mismatch(spark, d):
    own = domains.registrable(domains.host_of(domains.address_of(F.col("from_addr"))))
    return _emails(spark, d).select("email_id", identity.message_id_mismatch(F.col("message_id"), own).alias("domain")).where("domain is not null")


@query
def received_anomaly(spark, d):
    return _emails(spark, d).select("email_id", identity.received_anomaly(F.col("received")).alias("reason")).where("reason is not null")


@query
def freemail_brand_mention(spark, d):
    own = domains.registrable(domains.host_of(domains.address_of(F.col("from_addr"))))
    e = _emails(spark, d).where(own.isin(FREEMAIL))
    text = wording.joined(F.col("subject"), F.col("body"))
    found = e.select("email_id", identity.brand_mentions(text, _brands(spark, d)[0]).alias("b")).where(F.size("b") > 0)
    return found.select("email_id", F.array_join("b", ", ").alias("brands"))


@query
def fuzzy_domain_match(spark, d):
    """Hosts of links, senders and reply addresses beside the domains of the brand table; edits are bytes, as in the SQL."""
    e = _emails(spark, d)
    hosts = [read(spark, d, "email_urls").select("host")] + [e.select(domains.host_of(domains.address_of(F.col(c))).alias("host")) for c in ("from_addr", "reply_to")]
    found = identity.fuzzy_domains(functools.reduce(lambda a, b: a.unionByName(b), hosts), _brands(spark, d)[1], by_bytes=True)
    return found.select("host", F.array_join("matches", ", ").alias("matches"))


@query
def brand_list(spark, d):
    """A file of lines in which brands that share the first letter have one line, so that lines have several domains."""
    b = read(spark, d, "known_brands")
    lines = b.groupBy(F.substring(F.lower("brand_name"), 1, 1)).agg(F.min("ord").alias("ord"), F.concat_ws(" | ", F.min_by("brand_name", "ord"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "brand_domain"))), lambda x: x["brand_domain"]), ", ")).alias("value"))
    names, hosts = identity.brand_lists(lines, spark)
    return names.select(F.lit("name").alias("kind"), F.col("name").alias("value")).unionByName(hosts.select(F.lit("domain").alias("kind"), F.col("domain").alias("value")))


@query
def confusable_senders(spark, d):
    host = domains.host_of(domains.address_of(F.col("from_addr")))
    e = _emails(spark, d).select("email_id", host.alias("host"))
    return e.select("email_id", "host", confusables.host_reason(F.col("host"), _brands(spark, d)[1]).alias("reason")).where("reason is not null")


@query
def lexical_score(spark, d):
    e = _emails(spark, d).select("email_id", wording.phrase_hits(wording.joined(F.col("subject"), F.col("body"))).alias("h")).where(F.size("h") > 0)
    return e.select("email_id", wording.lexical_points(F.col("h")).cast("int").alias("points"), F.array_join(F.transform("h", lambda x: x["label"]), ", ").alias("labels"))


@query
def keyword_position_points(spark, d):
    h = wording.phrase_hits(wording.joined(F.col("subject"), F.col("body")))
    e = _emails(spark, d).select("email_id", wording.position_points(wording.positions(h, F.col("subject"), F.col("body"))).cast("int").alias("points"))
    return e.where("points > 0")


@query
def url_extract(spark, d):
    e = _emails(spark, d).select("email_id", F.posexplode(urls.extract(F.col("body"))).alias("pos", "url"))
    p = urls.decompose(F.col("url"))
    return e.withColumn("p", p).select("email_id", "pos", "url", "p.scheme", "p.host", "p.path", "p.query").where("scheme is not null")


def _first_urls(spark, d):
    return urls.first_of_each(read(spark, d, "email_urls"))


@query
def url_dedup(spark, d):
    return _first_urls(spark, d).select("email_id", "pos", "url")


def _judged(spark, d):
    own = _emails(spark, d).select("email_id", domains.host_of(domains.address_of(F.col("from_addr"))).alias("own"))
    both = _first_urls(spark, d).join(own, "email_id", "left")
    f = urls.finding(F.col("host"), F.col("path"), F.col("query_str"), F.col("own"))
    return both.withColumn("f", f).withColumns({"score": F.col("f.score"), "reasons": F.array_join("f.reasons", "; ")})


@query
def url_risk(spark, d):
    return _judged(spark, d).where("score > 0").select("email_id", "pos", "score", "reasons")


@query
def url_tld_shortener_risk(spark, d):
    u = _first_urls(spark, d)
    return u.select("email_id", "pos", urls.high_risk_tld(F.col("host")).alias("risky_tld"), urls.shortener(F.col("host")).alias("shortener"))


@query
def url_credential_score(spark, d):
    return _first_urls(spark, d).select("email_id", "pos", urls.credential_score(F.col("path"), F.col("query_str")).cast("int").alias("points")).where("points > 0")


@query
def url_harvest(spark, d):
    return _first_urls(spark, d).where(urls.looks_like_harvest(F.col("path"), F.col("query_str"))).select("email_id", "pos")


@query
def zero_width_bodies(spark, d):
    return _emails(spark, d).where(confusables.contains_zero_width(F.col("body"))).select("email_id")


@query
def url_domain_risk(spark, d):
    return _judged(spark, d).select("email_id", "pos", urls.domain_risk(F.col("host"), F.col("own")).cast("int").alias("points")).where("points > 0")


@query
def url_running_cap(spark, d):
    return urls.running_cap(_judged(spark, d)).select("email_id", "pos", "score", "applied")


@query
def host_profile(spark, d):
    u = read(spark, d, "email_urls").where("host <> ''").select("host", domains.registrable(F.col("host")).alias("domain"))
    # counted per host first, so that a hot domain meets its final aggregation as few rows
    h = u.groupBy("domain", "host").agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("domain").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("hosts"))


@query
def registrable_domain_topk(spark, d):
    return host_profile(spark, d).orderBy(F.desc("links"), "domain").limit(10)


@query
def attachment_risk(spark, d):
    files = F.coalesce(packed.files(F.col("attachments")), F.array().cast("array<string>"))
    e = _emails(spark, d).select("email_id", files.alias("f"))
    return e.select("email_id", F.size(attachments.dangerous(F.col("f"))).alias("dangerous"), F.size(attachments.odd_archives(F.col("f"))).alias("odd_archives")).where("dangerous + odd_archives > 0")


@query
def attachment_joined_risk(spark, d):
    e = _emails(spark, d).select("email_id", F.array("attachments").alias("f")).where(F.col("attachments") != "")
    return e.select("email_id", F.size(attachments.dangerous(F.col("f"))).alias("dangerous"), F.size(attachments.odd_archives(F.col("f"))).alias("odd_archives")).where("dangerous + odd_archives > 0")


def _scored(spark, d, **options):
    names, known = _brands(spark, d)
    e = _emails(spark, d).select("email_id", "file", "from_addr", "reply_to", "return_path", "message_id", "subject", "body", "attachments", "received")
    return scoring.score(spread(e), whitelist=WHITELIST, freemail=FREEMAIL, brands=names, reference_domains=known, **options)


@query
def email_score(spark, d):
    return _scored(spark, d, joined_attachments=True).select("email_id", "score", "label")


@query
def email_score_defaults(spark, d):
    """With the lists that the library ships."""
    e = _emails(spark, d).select("email_id", "file", "from_addr", "reply_to", "return_path", "message_id", "subject", "body", "attachments", "received")
    return scoring.score(spread(e), joined_attachments=True).select("email_id", "score", "label")


@query
def score_label_counts(spark, d):
    return email_score(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.max("score").alias("highest"))


@query
def whitelist_floor(spark, d):
    s = _scored(spark, d, joined_attachments=True).where(F.col("from_dom").isin(WHITELIST))
    return s.select("email_id", "from_dom", "score")


@query
def email_explanations(spark, d):
    return _scored(spark, d, joined_attachments=True).select("email_id", "score", F.array_join("explanations", "\n").alias("explanations"))


@query
def readable_explanations(spark, d):
    s = _scored(spark, d, joined_attachments=True)
    told = explain.explanations(F.col("label"), F.col("score"), F.col("reasons"), F.col("matched_keywords"), F.col("suspicious_urls"), F.col("files"))
    return s.select("email_id", "label", F.array_join(told, "\n").alias("told"))


@query
def explain_summary(spark, d):
    s = _scored(spark, d, joined_attachments=True)
    return s.select("email_id", explain.summary(F.col("label"), F.col("score"), F.col("matched_keywords")).alias("summary"))


@query
def separate_attachment_points(spark, d):
    """What reading attachments as separate names adds to the score and its reasons."""
    points = lambda c: F.aggregate(F.filter(c, lambda r: r["kind"].isin("attachment", "archive")), F.lit(0), lambda a, r: a + r["points"])
    return _scored(spark, d).select("email_id", points("reasons").cast("int").alias("points")).where("points > 0")


@query
def highlight_body(spark, d):
    s = _scored(spark, d).where(F.size("matched_keywords") + F.size("suspicious_urls") > 0)
    return highlight.highlighted(s, "email_id")


@query
def score_percent(spark, d):
    return email_score(spark, d).select("email_id", report.percent(F.col("score")).alias("percent"))


@query
def summary_report(spark, d):
    return report.summary(_scored(spark, d, joined_attachments=True))


@query
def body_preview(spark, d):
    return _emails(spark, d).select("email_id", report.preview(F.col("body")).alias("preview")).where("preview is not null")


@query
def input_signature(spark, d):
    """Of the inputs of each message: the message file and its attachments, by name and size."""
    e = _emails(spark, d).where("file is not null")
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    names, sizes = F.array(F.col("file"), F.coalesce("attachments", F.lit(""))), F.array(size("body"), size("attachments"))
    return e.select("email_id", report.signature(names, sizes).alias("signature"))


@query
def document_rollup(spark, d):
    return report.rollup(read(spark, d, "documents"), "source", "lang")


@query
def clean_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", cleaning.clean_text(cleaning.visible_text(F.col("text"))).alias("text"))


@query
def clean_bodies(spark, d):
    return _emails(spark, d).select("email_id", cleaning.clean_text(F.col("body")).alias("body"))


def _raw_mail(spark, d):
    """Every message written as raw mail: encoded headers, a text part, an HTML part and an attachment."""
    e = _emails(spark, d).where("body is not null")
    address = lambda c: domains.address_of(F.col(c))
    header = lambda name, v: F.when(v.isNull() | (v == ""), "").otherwise(F.concat(F.lit(f"{name}: "), v, F.lit("\r\n")))
    word = lambda c: F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(c, "utf-8")), F.lit("?="))
    lines = lambda b: F.concat(F.translate(b, "\r\n", ""), F.lit("\r\n"))
    # a parser takes quotes off a name, so none are written
    name = F.replace(F.url_encode(F.translate("attachments", '"\\', "__")), F.lit("+"), F.lit("%20"))
    raw = F.concat(
        F.coalesce(F.array_join(F.transform("received", lambda r: F.concat(F.lit("Received: "), r, F.lit("\r\n"))), ""), F.lit("")),
        header("From", address("from_addr")), header("Reply-To", address("reply_to")), header("Return-Path", address("return_path")), header("Message-ID", F.col("message_id")),
        header("Subject", F.when(F.trim("subject") != "", word(F.col("subject")))),
        F.lit("MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=a3f1\r\n\r\n--a3f1\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
        lines(F.base64(F.encode("body", "utf-8"))),
        F.lit("--a3f1\r\nContent-Type: text/html\r\n\r\n<html><style>p {}</style><p>End of &lt;part&gt;</p></html>\r\n"),
        F.when(F.col("attachments") != "", F.concat(F.lit("--a3f1\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename*=utf-8''"), name, F.lit("\r\n\r\nx\r\n"))).otherwise(""),
        F.lit("--a3f1--\r\n"),
    )
    return e.select("email_id", messages.parse(F.encode(raw, "utf-8")).alias("p"))


@query
def mime_round_trip(spark, d):
    """Messages written as raw mail and parsed again."""
    p = F.col("p")
    return _raw_mail(spark, d).select("email_id", p["from_addr"].alias("from_addr"), p["subject"].alias("subject"), p["body"].alias("body"), F.array_join(p["attachments"], "; ").alias("attachments"), p["body_type"].alias("body_type"), F.size(p["received"]).alias("hops"), p["parse_error"].alias("parse_error"))


@query
def raw_mail_scores(spark, d):
    """From raw mail to scores: parsed messages through the rules."""
    names, known = _brands(spark, d)
    e = _raw_mail(spark, d).select("email_id", "p.*").withColumn("attachments", F.array_join("attachments", "; "))
    s = scoring.score(e, whitelist=WHITELIST, freemail=FREEMAIL, brands=names, reference_domains=known, joined_attachments=True)
    return s.select("email_id", "score", "label")


@query
def digest_dedup(spark, d):
    """Messages that are the same to the reviewer, whatever file they came in."""
    e = _emails(spark, d).select(reviewer.digest("from_addr", "subject", "body", "attachments").alias("digest"))
    return e.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query
def llm_prompt(spark, d):
    e = _emails(spark, d).select("email_id", reviewer.prompt(F.col("from_addr"), F.col("subject"), F.col("body"), F.col("attachments")).alias("p"))
    return e.select("email_id", F.length("p").alias("chars"), F.sha2("p", 256).alias("digest"))


@query
def llm_response_parse(spark, d):
    r = read(spark, d, "llm_replies")
    raw = F.to_json(F.struct("probability", "indicators", "reasoning"))
    p = r.select("reply_id", reviewer.parse_reply(raw).alias("p"))
    v = p.select("reply_id", reviewer.verdict(F.col("p.reply.probability"), F.col("p.reply.indicators"), F.col("p.reply.reasoning")).alias("v"))
    return v.select("reply_id", "v.label", "v.score", F.array_join("v.explanations", "\n").alias("told"))


@query
def llm_cache_hit_miss(spark, d):
    r = read(spark, d, "llm_replies").dropDuplicates(["reply_id"])
    out = reviewer.cache_hits(r.select(F.col("reply_id").alias("request_id"), "model", "digest", "requested_at"), r.select("model", "digest", "replied_at"), ttl=3600)
    return out.select("request_id", "hit")


#: The time at which cached replies are asked for, and how old they may be then, so that there are hits and misses.
ASKED_AT, CACHE_DAYS = "2024-06-30", 180


def _cache(spark, d):
    r = read(spark, d, "llm_replies").where("replied_at is not null")
    return r.groupBy("model", "digest", F.col("replied_at").alias("ts")).agg(F.to_json(F.struct(F.max("probability").alias("probability"))).alias("payload"))


@query
def llm_get_or_create(spark, d):
    """Every message that was ever sent to review, asked for again: cached where a reply is young enough, else new."""
    asked = read(spark, d, "llm_replies").select("email_id", "model", "digest").distinct()
    e = _emails(spark, d).select("email_id", reviewer.prompt(F.col("from_addr"), F.col("subject"), F.col("body"), F.col("attachments")).alias("prompt"))
    out = reviewer.get_or_create(asked.join(e, "email_id"), _cache(spark, d), F.lit(ASKED_AT).cast("timestamp"), ttl=CACHE_DAYS * 86_400)
    return out.select("email_id", "model", "digest", "cached", F.get_json_object("payload", "$.probability").cast("int").alias("probability"))


@query
def llm_review_batches(spark, d):
    """Messages in batches of five, every third without a model of its own."""
    e = _emails(spark, d).where("parse_error is null")
    model = F.when(F.col("email_id") % 3 > 0, F.get(F.array(*map(F.lit, reviewer.MODELS)), (F.col("email_id") % 2).cast("int")))
    item = F.struct(F.struct("from_addr", "subject", "body", "attachments").alias("parsed"), model.alias("model"))
    batches = e.groupBy(F.floor(F.col("email_id") / 5).alias("batch_id")).agg(F.sort_array(F.collect_list(F.struct("email_id", item.alias("i")))).alias("x"))
    none = _cache(spark, d).where("false")
    out = reviewer.review_batches(batches.select("batch_id", F.col("x.i").alias("items")), none, F.current_timestamp(), reviewer.MODELS[2])
    return out.where("error is null").select("batch_id", F.explode("results").alias("r")).select("batch_id", "r.pos", "r.model", "r.label", F.round("r.score", 4).alias("score"))


@query
def stratified_split(spark, d):
    return learning.split(learning.clean_labels(read(spark, d, "training")), "training_id").select("training_id", "label", "is_test")


@query
def stratified_split_counts(spark, d):
    return stratified_split(spark, d).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query
def downsampled_ham(spark, d):
    rows = learning.clean_labels(read(spark, d, "training"))
    return learning.at_most(rows, "training_id", F.col("label") == "ham").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("training_id").alias("ids"))


@query
def tfidf_document_frequency(spark, d):
    return learning.document_frequency(read(spark, d, "documents"))


@query
def class_weights(spark, d):
    return learning.class_weights(learning.clean_labels(read(spark, d, "training")))


@query
def classification_report(spark, d):
    rows = learning.clean_labels(read(spark, d, "training")).withColumn("guess", F.when(F.lower("text").contains("account"), "spam").otherwise("ham"))
    return learning.report(rows, "label", "guess")


def _train_predict(name):
    def run(spark, d):
        rows = cut(learning.split(learning.clean_labels(read(spark, d, "training")), "training_id").select("training_id", "text", "label", "y", "is_test"))
        if not rows.limit(1).count():
            return spark.createDataFrame([], "training_id bigint, verdict string, percent double, shown string")
        model = learning.REGISTRY[name][1](rows.where("not is_test"))
        return learning.predict(model, rows.where("is_test").select("training_id", "text")).select("training_id", "verdict", "percent", "shown")

    run.__name__ = f"train_predict_{name}"
    return query(run)


for _name in learning.REGISTRY:
    _train_predict(_name)


@query
def model_report(spark, d):
    """Precision, recall and F1 of a classifier on the part that it has not seen."""
    rows = cut(learning.split(learning.clean_labels(read(spark, d, "training")), "training_id").select("text", "label", "y", "is_test"))
    if not rows.limit(1).count():
        return spark.createDataFrame([], "label string, support bigint, precision double, recall double, f1 double, accuracy double")
    told = learning.predict(learning.complement_bayes(rows.where("not is_test")), rows.where("is_test").select("text", "label"))
    return learning.report(told.withColumn("guess", F.when(F.col("verdict") == "Phishing", "spam").otherwise("ham")), "label", "guess")


@query
def ml_with_rules(spark, d):
    rows = cut(learning.split(learning.clean_labels(read(spark, d, "training")), "training_id").select("email_id", "text", "label", "y", "is_test"))
    if not rows.limit(1).count():
        return spark.createDataFrame([], "email_id bigint, verdict string, rules_label string, rules_score int, agree boolean")
    model = learning.complement_bayes(rows.where("not is_test"))
    told = learning.predict(model, rows.where("is_test").select("email_id", "text"))
    both = learning.with_rules(told, _scored(spark, d, joined_attachments=True), "email_id")
    return both.select("email_id", "verdict", "rules_label", "rules_score", "agree")


@query
def event_window_counts(spark, d):
    return scored.window_counts(read(spark, d, "events"), "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def event_sessions(spark, d):
    s = scored.sessions(read(spark, d, "events"), "ts", "user_id")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))
