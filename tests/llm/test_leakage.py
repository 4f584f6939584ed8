import random

from mailloom.llm import leakage
from mailloom.llm.leakage import Items, find_leaks, remove_leaked, words

DOC, ITEM = "doc_id bigint, text string, item_id string, words string", "item_id bigint, text string, doc_id string"


def brute(docs, items, least):
    out = {}
    for d, x in docs:
        for i, y in items:
            a, b = words(x), words(y)
            best = 0
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[d, i] = best
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "x_y", "don't"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(r.randint(3, 25))) for i in range(8)] + [(90, None), (91, "")]
    docs = [(i, text(r.randint(0, 40))) for i in range(30)] + [(100, None), (101, "")]
    for i in range(8):
        words_ = items[i][1].split()
        docs.append((200 + i, text(5) + " " + " ".join(words_[: len(words_) * 2 // 3]).upper() + " " + text(4)))
    return docs, items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = corpus(seed)
        want = brute([d for d in docs if d[1]], [i for i in items if i[1]], 4)
        d = spark.createDataFrame([(*x, "c", "c") for x in docs], DOC)
        i = spark.createDataFrame([(*x, "c") for x in items], ITEM)
        for block in (10**6, 60):  # one block of items, and several
            got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(d, i, 4, block).collect()}
            assert {k: r["words"] for k, r in got.items()} == want
        text = dict(docs)
        for (a, b), r in got.items():
            at = words(text[a])[r["doc_pos"] : r["doc_pos"] + r["words"]]
            assert at == words(dict(items)[b])[r["item_pos"] : r["item_pos"] + r["words"]]


def test_shards_do_not_matter():
    import pyarrow as pa

    docs, items = corpus(9)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    enc = Items([i for i in items if i[1]], 4)
    runs = [sorted(tuple(r.values()) for b in leakage.search(iter([batch]), enc, n) for r in b.to_pylist()) for n in (1, 50, 10**6)]
    assert runs[0] == runs[1] == runs[2] != []


def test_hot_item_empty_tables_and_repeats(spark):
    passage = " ".join(f"t{i}" for i in range(20))
    d = spark.createDataFrame([(i, passage, "", "") for i in range(300)] + [(5, passage, "", ""), (None, passage, "", ""), (1000, "x " * 50_000 + passage, "", "")], DOC)
    i = spark.createDataFrame([(1, passage, ""), (1, passage, ""), (2, passage, "")], ITEM)
    got = find_leaks(d, i)
    assert got.count() == 2 * 302 and got.where("words = 20").count() == 2 * 302
    assert find_leaks(d.where("false"), i).count() == 0 and find_leaks(d, i.where("false")).count() == 0
    left = remove_leaked(d, i)
    assert left.columns == d.columns and left.count() == 1  # only the one without an id
    assert remove_leaked(d, i.where("false")).count() == 303
