import pytest
from pyspark.sql import functions as F

from mailloom.llm.mixing import TOKENIZER, mix, shares, sized, token_count

DOC, TARGET = "doc_id bigint, source string, text string, copy_no string, rate int", "source string, target_share double, max_repeats int, doc_id int"
pytestmark = pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no vocabulary here")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "big", "alpha beta gamma delta", "", 0) for i in range(1500)] + [(9000 + i, "small", "one two", "", 0) for i in range(100)] + [(9500 + i, "tiny", "one", "", 0) for i in range(5)]
    return spark.createDataFrame([*rows, (1, None, "x", "", 0), (2, "other", "x", "", 0), (9600, "small", None, "", 0), (9601, "small", "", "", 0)], DOC)


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 0.8, 1, 0), ("small", 0.1, 9, 0), ("tiny", 0.1, 3, 0), ("absent", 0.0, 2, 0)], TARGET)


def test_token_counts_against_another_library(spark):
    texts = ["Hello world", "naïve Grüße 12345  x\n\n y", "", None, "don't   stop", "日本語 emoji 🙂"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.orderBy("i").select(token_count(F.col("t")).alias("n")).collect()]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    assert got == [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]


def test_rates_caps_and_shares(docs, targets):
    size = {r["source"]: r["n"] for r in sized(docs, targets).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(size.values())
    got = {r["source"]: r for r in shares(docs, targets).collect()}
    assert got["absent"]["n_docs"] == 0 and got["absent"]["rate"] == 0 and got["absent"]["tokens"] == 0
    assert got["tiny"]["rate"] == 3 and got["small"]["rate"] == pytest.approx(min(9, 0.1 * total / size["small"]))
    mixture = mix(docs, targets)
    n = {r["source"]: r["count"] for r in mixture.groupBy("source").count().collect()}
    assert set(n) == {"big", "small", "tiny"} and n == {k: r["n_emitted"] for k, r in got.items() if r["n_emitted"]}
    assert n["tiny"] == 15 and abs(got["big"]["tokens"] - 0.8 * total) < 0.05 * total and sum(r["share"] for r in got.values()) == pytest.approx(1)
    assert mixture.groupBy("doc_id").agg(F.max("copy_no").alias("m"), F.count("*").alias("c")).where("m <> c or m > 9").count() == 0
    assert set(mixture.columns) == set(docs.columns)


def test_same_draw_each_time(docs, targets):
    a, b = ({(r["doc_id"], r["copy_no"]) for r in mix(docs.repartition(k), targets).select("doc_id", "copy_no").collect()} for k in (1, 7))
    assert a == b
    assert {(r["doc_id"], r["copy_no"]) for r in mix(docs, targets, seed=1).select("doc_id", "copy_no").collect()} != a


def test_empty_tables(docs, targets):
    assert mix(docs.where("false"), targets).count() == 0 and mix(docs, targets.where("false")).count() == 0
    assert shares(docs.where("false"), targets).where("tokens = 0 and share is null").count() == 4
