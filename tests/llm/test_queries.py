import pytest

import __spark_entry__ as entry

#: What the rows of the llm queries without SQL must satisfy on the smallest tables.
WANTED = {
    "p1_found": "field in ('subject', 'body')", "p1_restored": "field in ('subject', 'body') and restored is not null", "p4_found": "line_no > 0", "p4_own_text": "own = trim(own)",
    "p5_found": "field in ('from_addr', 'body')", "p5_one_form": "email_id is not null", "p8_mixture": "copy_no > 0", "p8_shares": "share between 0 and 1 and rate <= max_repeats and tokens >= 0",
    "p9_found": "doc_id is not null", "p9_scores": "sentence_share between 0 and 1 and stuffed_share between 0 and 1 and regularity between 0 and 1.0001",
}


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if n[0] == "p" and n[1].isdigit()))
def test_query_without_sql(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.count() > 0 and df.where(f"not coalesce({WANTED[name]}, false)").count() == 0


def test_found_agrees_with_its_operator(spark, sf):
    q = entry.queries()
    found, restored = (q[n](spark, sf).select("email_id", "field") for n in ("p1_found", "p1_restored"))
    assert found.exceptAll(restored).count() == 0 == restored.exceptAll(found).count() and found.distinct().count() == found.count()
    looks = q["p5_found"](spark, sf)
    assert looks.join(found, ["email_id", "field"]).count() == 0
    scores = q["p9_scores"](spark, sf)
    assert {r[0] for r in q["p9_found"](spark, sf).collect()} == {r["doc_id"] for r in scores.where("stuffed").collect()}
    lines, own = q["p4_found"](spark, sf).groupBy("email_id").count(), q["p4_own_text"](spark, sf)
    body = spark.read.parquet(f"{sf}/parse_eml.parquet").select("email_id", "body")
    whole = own.join(body, "email_id").join(lines, "email_id", "left_anti").where("own <> trim(coalesce(body, ''))")
    assert own.count() == body.count() and whole.where(r"own <> regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '')").count() == 0


def test_restoring_what_was_garbled_on_purpose(spark, sf):
    """Clean lines of documents in several wrong encodings come back as they were."""
    from mailloom.llm import encodings

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = encodings.train(docs)
    lines = sorted({x.strip() for r in docs.select("text").collect() if r["text"] for x in r["text"].split("\n") if not x.isascii() and 30 < len(x) < 300})
    right = total = 0
    for written, read in (("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"), ("cp1252", "cp850"), ("utf-8", "cp1256")):
        for x in lines[:120]:
            try:
                bad = x.encode(written).decode(read)
            except UnicodeError:
                continue
            if bad != x:
                total, right = total + 1, right + (model.restore(bad)[0] == x)
    assert total > 150 and right >= 0.85 * total, (right, total)
    assert sum(model.restore(x)[1] for x in lines) <= 0.02 * len(lines)
