import random

import pytest

from mailloom.llm.stuffing import SENTENCES, STUFFED, features, score_pages, stuffed_pages

DOC = "doc_id bigint, text string, stuffed string, words string"
PROSE = "We talked to the people of the town and they think that the house by the river is not for sale. If you want to know more about it, please write to us before the end of the week."


def pages():
    r = random.Random(4)
    kw = ["cheap", "phone", "insurance", "loan", "best", "deal", "buy"]
    cities = [f"{a}{b}" for a in ("Ber", "Lon", "Pra", "Vil", "Tor") for b in ("lin", "don", "gue", "nius", "onto")]
    spam = [
        " ".join(r.choice(kw) for _ in range(200)),
        "Top loan. " * 3 + " ".join(r.choice(kw).title() + r.choice(["", ".", "!"]) for _ in range(150)),
        PROSE.split(".")[0] + ".\n" + " ".join(r.choice(kw) for _ in range(250)),
        "\n".join(f"- phone deal https://a{i}.example/x" for i in range(30)),
        "\n".join(f'<a href="http://x.example/{i}">cheap loan</a>' for i in range(30)),
        " ".join(f"#{r.choice(kw)}{r.choice(kw)}" for _ in range(60)),
        ", ".join(f"cheap phone {r.choice(cities)}" for _ in range(80)),
        "\n".join(f"phone {r.choice(cities)} | size: {i} | in stock | color: red" for i in range(25)),
    ]
    log = "\n".join(f"{10 + i}:0{i % 10} relay accepted #{r.randint(1000, 9999)} host=a{i} ip=192.0.2.{i}" for i in range(14))
    order = "\n".join(f"{i + 1} x phone {r.choice(cities)}  €{r.randint(100, 999)}" for i in range(10))
    ham = [PROSE * 3, PROSE + "\n" + log, "Dear all,\n" + PROSE + "\n" + order, PROSE + " See https://a.example/x and https://b.example/y #news", "word", log]
    return spam, ham


def test_kinds(spark):
    spam, ham = pages()
    rows = [(i, t) for i, t in enumerate(spam)] + [(100 + i, t) for i, t in enumerate(ham)] + [(200, None), (201, ""), (202, " \n "), (None, spam[0])]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], DOC)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in stuffed_pages(df).collect()) == [(False, i) for i in range(len(spam))] + [(True, None)]
    assert score_pages(df).count() == len(rows) and score_pages(df.where("doc_id >= 200")).where("words > 0").count() == 0
    assert stuffed_pages(df.where("false")).count() == 0 and stuffed_pages(df.union(df)).count() == len(spam) + 1


def test_batches_do_not_matter():
    spam, ham = pages()
    texts = spam + ham + [None, ""]
    together, alone = features(texts), [features([t]).iloc[0].tolist() for t in texts]
    assert [[round(x, 9) for x in r] for r in together.values.tolist()] == [[round(x, 9) for x in r] for r in alone]


def test_recurrence_and_regularity_by_hand():
    x = features(["a b a b a b", "one two three four five six", "a " * 40]).to_dict("records")
    assert x[0]["regularity"] == 1 and x[1]["recurrence"] == 0 and x[1]["regularity"] == 0
    assert x[2]["words"] == 40


def test_very_long_text():
    assert features(["loan phone " * 100_000]).stuffed_share[0] > 0.99


NOUNS = [a + b for a in ("lamp", "chair", "table", "shelf", "carpet", "mirror", "drawer", "pillow") for b in ("wood", "steel", "glass", "stone", "linen")]


def case(text):
    x = features([text]).iloc[0]
    return x.sentence_share < SENTENCES and x.stuffed_share >= STUFFED


@pytest.mark.parametrize("gap", [" ", "\n"])
@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("times", [3, 40])
def test_long_blocks_that_recur(gap, shuffled, times):
    rng = random.Random(5)
    text = gap.join(" ".join(rng.sample(NOUNS, len(NOUNS)) if shuffled else NOUNS) for _ in range(times))
    assert case(text)
    assert shuffled or features([text]).regularity[0] > 0.9


def test_longest_lag_among_other_documents():
    long = [f"w{k}" for k in range(700)]
    texts = ["The house is at the end of the road and you can see it from here.", None, " ".join(long * 2), "", " ".join(NOUNS * 2), " ".join(long)]
    x = features(texts)
    assert list(x.regularity > 0.9) == [False, False, True, False, True, False]
    assert list(x.stuffed_share >= STUFFED) == [False, False, True, False, True, False]


def test_one_keyword_a_line():
    assert case("\n".join(NOUNS)) and case("\n".join(f"cheap {n}" for n in NOUNS))
    letter = "Dear Ann,\n\nthe report is with you and we will see how it goes from there, so please wait until they call.\n\nKind regards\nBob\nSales desk\nRoom 4\n"
    assert not case(letter) and not case("\n".join(f"{k}. Ask the desk for a new token and wait until it is there" for k in range(9)))


def test_counted_lines_of_recurring_keywords():
    words = ["cheap", "loan", "best", "deal", "phone", "insurance"]
    for count in ("{}.", "{})", "{}x"):
        assert case("\n".join(f"{count.format(k)} {' '.join(words[(k + j) % 6] for j in range(4))}" for k in range(1, 13)))
    assert not case("\n".join(f"{k}x {NOUNS[k]} {NOUNS[-k]} €{k}99" for k in range(1, 13)))
    assert not case("\n".join(f"{k}. Ask the desk of Room {k} for a new token and wait" for k in range(1, 13)))
    assert not case("\n".join(f"{8 + k}:00 server status good" for k in range(12)))
