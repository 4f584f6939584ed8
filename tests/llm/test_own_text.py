import numpy as np
import pytest

from mailloom.llm.boosting import Trees
from mailloom.llm.own_text import blocks_of, label, not_own_lines, own_text

SCHEMA = "email_id bigint, from_addr string, body string, subject string, own string"
BODIES = [
    ("Hi Bo,\nthe list is done, please have a look at it.\n\nBest regards,\nAnn Lee\nOffice Manager\nTel. 555 0101\n\nOn 3 May 2024 10:00, Bo <bo@x.org> wrote:\n> can you send it\n> today?", [4, 5, 6, 7, 9, 10, 11]),
    ("See below.\n\n---------- Forwarded message ----------\nFrom: Bo <bo@x.org>\nSent: Monday\nTo: Ann\nSubject: x\n\nOld text that goes on for a while.", [3, 4, 5, 6, 7, 9]),
    ("Am 3.5.24 um 10:00 schrieb Bo:\n> eins\n> zwei\n\nDas passt für mich sehr gut.\n\n-- \nAnn", [1, 2, 3, 7, 8]),
    ("[EXTERNAL] This message came from outside Acme.\n\nThe meeting moves to noon because the room is taken.\n\nThis message is confidential and meant only for Bo.", [1, 5]),
    ("Best regards were also sent by Bo from Paris, who works on it.\nFrom: the warehouse in Rome, to: the store in Bonn, that is the whole trip.\n> 50 percent of the boxes are still there, that is too many.", []),
    ("We meet at noon in the big room.\n\n_______________________________________________\nNews announce list, archive no. 5\nTo leave: https://x.org/leave", [3, 4, 5]),
    ("I will be there at noon with all papers.\n\nSent from my Orvix tablet", [3]),
    ("Bo Doe\n<bo@x.org>\nwrote on 2023-11-08 8:55:\n> The text of before\n> goes here\n\nThat is fine with me, thanks to all of you.", [1, 2, 3, 4, 5]),
    ("", []), (None, []), ("\n \r\n", []),
]


@pytest.mark.parametrize(("body", "want"), [b for b in BODIES if b[0]])
def test_labels(body, want):
    blocks = blocks_of(body)
    y = label(blocks) if blocks else []
    assert [n for b, v in zip(blocks, y) if v for n in b.lines] == want


def test_operator(spark):
    rows = [(100 * k + i, f"p{k % 7}@x.org", b, "", "") for k in range(40) for i, (b, _) in enumerate(BODIES)]
    df = spark.createDataFrame([*rows, (99_999, None, "line\n" * 30_000 + "\nCheers\nBo", "", "")], SCHEMA).repartition(3)
    got: dict = {}
    for r in not_own_lines(df).collect():
        got.setdefault(r["email_id"], []).append(r["line_no"])
    for k in range(40):
        for i, (_, want) in enumerate(BODIES):
            assert sorted(got.get(100 * k + i, [])) == want, BODIES[i]
    assert sorted(got[99_999]) == [30_002, 30_003]
    own = {r["email_id"]: r["own"] for r in own_text(df).collect()}
    assert own[0] == "Hi Bo,\nthe list is done, please have a look at it." and own[2] == "Das passt für mich sehr gut." and own[9] == ""


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a@x.org", BODIES[0][0], "", "")] * 2, SCHEMA)
    assert not_own_lines(df).where("line_no is null").count() == 0
    assert not_own_lines(df.where("false")).count() == 0 and own_text(df.where("false")).count() == 0


def test_trees_learn_what_they_have_not_seen():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(int)
    t = Trees.train(x[:3000], y[:3000])
    assert ((t.probability(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert t.importance()[[0, 3]].sum() > 0
    assert Trees.train(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert Trees.train(np.ones((5, 2)), np.ones(5)).probability(np.ones((1, 2)))[0] > 0.9
