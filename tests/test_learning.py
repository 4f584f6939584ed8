import pytest
from pyspark.sql import functions as F

from mailloom.operators import learning


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, ("verify account password now number " if i % 3 == 0 else "lunch meeting notes agenda number ") + str(i % 7), ("SPAM" if i % 3 == 0 else "ham") if i % 20 else None) for i in range(240)]
    return learning.clean_labels(spark.createDataFrame(data, "id bigint, text string, label string")).cache()


@pytest.mark.parametrize("name", list(learning.REGISTRY))
def test_models_learn(spark, rows, name, tmp_path):
    model = learning.load_or_train(name, str(tmp_path), rows)
    out = learning.predict(learning.load_or_train(name, str(tmp_path), rows), rows)
    good = out.where(F.col("verdict") == F.when(F.col("y") == 1, "Phishing").otherwise("Legitimate")).count()
    assert good >= 0.95 * rows.count() and model.stages
    assert out.where("percent < 50 or percent > 100 or shown is null").count() == 0


def test_unknown_model(rows):
    with pytest.raises(ValueError):
        learning.load_or_train("svm", "/nowhere", rows)


def test_split_and_thinning(spark, rows):
    s = learning.split(rows, "id")
    own = {r["label"]: (r["n"], r["t"]) for r in s.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert all(t == int(n * 0.2 + 0.5) for n, t in own.values()) and s.count() == rows.count()
    ids = sorted(r["id"] for r in s.where("is_test and label = 'ham'").collect())
    import hashlib

    first = sorted((r["id"] for r in rows.where("label = 'ham'").collect()), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert ids == sorted(first[: len(ids)])
    for most in (0, 1, 40, 10_000):
        thin = learning.at_most(rows, "id", F.col("y") == 0, most)
        assert thin.where("y = 0").count() == min(most, rows.where("y = 0").count()) and thin.where("y = 1").count() == rows.where("y = 1").count()
    odd = spark.createDataFrame([(None, "a", None), (None, "a", None), (1, None, "x"), (1, None, "x")], "id bigint, label string, _n string").select("id", "label")
    assert learning.split(odd, "id", 0.5).where("is_test").count() == 2 and learning.split(odd.where("false"), "id").count() == 0


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    got = {r["label"]: r for r in learning.report(df, "t", "p").collect()}
    assert got["a"]["precision"] == 1 and got["a"]["recall"] == 0.5 and got["b"]["precision"] == pytest.approx(1 / 3) and got["c"]["f1"] == 0 and got["a"]["accuracy"] == 0.5


def test_rules_beside_predictions(spark):
    p = spark.createDataFrame([(1, "Phishing", 90.0), (2, "Legitimate", 80.0), (3, "Phishing", 60.0)], "id int, verdict string, percent double")
    s = spark.createDataFrame([(1, "HIGH", 12, ["x"]), (2, "MEDIUM", 6, [])], "id int, label string, score int, explanations array<string>")
    assert [r["agree"] for r in learning.with_rules(p, s, "id").orderBy("id").collect()] == [True, False, None]


def test_jobs(spark, rows, tmp_path):
    from mailloom.plans import jobs

    assert jobs.train_all(spark, rows, str(tmp_path / "m")).where("accuracy > 0.9").count() >= 8
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(b"From: a@x.org\r\nSubject: Urgent\r\n\r\nverify your password")
    jobs.score_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["label"] == "HIGH"
