from pyspark.sql import functions as F

from mailloom.plans.storage import read
from mailloom.sources import messages
from mailloom.streaming import scored

RAW = (
    b"Received: by a\r\nReceived: by b\r\nFrom: =?utf-8?q?J=C3=B6?= <j@x.org>\r\nTo: a@y.org\r\nSubject: =?utf-8?b?R3LDvMOfZQ==?=\r\nMessage-ID: <1@x.org>\r\nMIME-Version: 1.0\r\n"
    b"Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nhello\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>bye<style>x</style></p>\r\n"
    b"--B\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nxx\r\n--B--\r\n"
)


def test_parse_message():
    m = messages.parse_message(RAW)
    assert m["subject"] == "Grüße" and m["message_id"] == "1@x.org" and m["reply_to"] == m["return_path"] == "j@x.org" and m["attachments"] == ["a.pdf"]
    assert m["body"].split() == ["hello", "bye"] and len(m["received"]) == 2 and m["parse_error"] is None
    raw8 = "From: Jö <j@bücher.example>\r\nSubject: Grüße\r\n an alle\r\n\r\nx".encode()
    m = messages.parse_message(raw8)
    assert m["subject"] == "Grüße an alle" and "bücher.example" in m["from_addr"] and m["parse_error"] is None
    empty = messages.parse_message(b"")
    assert empty["subject"] == "No Subject" and empty["from_addr"] == "No Sender" and messages.parse_message(None)["body"] == ""


def test_read_eml_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(RAW)
    (tmp_path / "in/b.EML").write_bytes(b"From: x\r\n\r\n\xff\xfe body")
    (tmp_path / "in/c.txt").write_bytes(b"no")
    batch = messages.read_eml(spark, str(tmp_path / "in"))
    assert batch.count() == 2 and batch.where("subject = 'Grüße'").count() == 1
    q = messages.stream_eml(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("mail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("mail").count() == 2


def test_corpus_and_paste(spark, tmp_path):
    for d in ("ham", "spam"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "1").write_bytes(b"H: x\r\n\r\nbody \xff" + d.encode())
    (tmp_path / "ham" / "2").write_bytes(b"no header")
    got = sorted((r["label"], r["text"]) for r in messages.read_corpus(spark, str(tmp_path)).collect())
    assert got == [("ham", "body ham"), ("ham", "no header"), ("spam", "body spam")]
    assert messages.pasted(spark, ["hi"]).first()["body"] == "hi"
    assert messages.read_brand_file(spark, str(tmp_path / "none.txt")) is None
    messages.write(messages.pasted(spark, ["hi"]), str(tmp_path / "out"), "json")
    assert messages.read_dump(spark, str(tmp_path / "out")).count() == 1


def test_stream_counts_equal_batch_on_closed_windows(spark, sf, tmp_path):
    events = read(spark, sf, "events")
    src = tmp_path / "src"
    events.orderBy("ts").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    q = scored.window_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    key = lambda df: {(r["window_start"], r["event_type"]): (r["n"], round(r["total"], 4)) for r in df.collect()}
    closed, batch = key(spark.table("counts")), key(scored.window_counts(events, "ts", "event_type"))
    assert closed and all(batch[k] == v for k, v in closed.items())


def test_requests_within_the_cache_time_pass_once(spark, tmp_path):
    rows = spark.createDataFrame([("m", "a", "2024-01-01 00:00:00"), ("m", "a", "2024-01-01 00:01:00"), ("m", "b", "2024-01-01 00:01:00")], "model string, digest string, t string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src"))
    q = scored.first_requests(stream, "t").writeStream.format("memory").queryName("req").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("req").count() == 2
