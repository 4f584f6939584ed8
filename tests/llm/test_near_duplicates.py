import random

import numpy as np
import pytest

from mailloom.llm import near_duplicates as nd
from mailloom.llm import tables

EMAIL = "email_id bigint, subject string, body string, id string, text string, links int"


def corpus(seed=1, groups=30, singles=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    boiler = " ".join(r.choice(words) for _ in range(12))
    rows, n = [], 0
    for g in range(groups + singles):
        base = [r.choice(words) for _ in range(r.randint(45, 120))]
        for _ in range(r.randint(2, 5) if g < groups else 1):
            w = list(base)
            for _ in range(r.randint(0, 9) if rows else 0):
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
            rows.append((n, w[0], " ".join(w[1:]).upper() + "\n" + boiler))
            n += 1
    rows += [(n + i, rows[0][1], rows[0][2].replace(" ", " \t")) for i in range(3)]  # copies, other white space
    return [*rows, (n + 10, None, None), (n + 11, "", ""), (n + 12, "few", "words only")]


def sets(rows, k, least):
    out = {}
    for i, s, b in rows:
        w = ((s or "") + " " + (b or "")).lower().split()
        if w and len(w) >= least:
            out[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))}
    return out


@pytest.mark.parametrize(("k", "similarity", "least"), [(3, 0.6, 40), (5, 0.8, 0)])
def test_against_brute_force(spark, k, similarity, least):
    rows = corpus()
    s = sets(rows, k, least)
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= similarity * len(s[a] | s[b])}
    df = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], EMAIL).repartition(5)
    got = {tuple(r) for r in nd.similar_pairs(df, k, similarity, least).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 20
    counts = {r["email_id"]: r for r in nd.link_counts(df, k, similarity, least).collect()}
    assert set(counts) == set(s)
    key = {i: " ".join(((a or "") + " " + (b or "")).lower().split()) for i, a, b in rows}
    same = lambda i: [j for j in s if key[j] == key[i]]
    assert all(counts[i]["copies"] == len(same(i)) and counts[i]["class_id"] == min(same(i)) for i in s) and len(same(0)) >= 4


def test_many_copies_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(i, "s", text, "", "", 0) for i in range(60)], EMAIL)
    assert nd.similar_pairs(df, 3, 0.6, 40).count() == 60 * 59 // 2
    assert nd.link_counts(df, 3, 0.6, 40).where("copies = 60 and links = 0 and class_id = 0").count() == 60
    assert nd.similar_pairs(df.where("false")).count() == 0 and nd.link_counts(df.where("false")).count() == 0


def test_hot_group_of_edited_texts_is_whole(spark):
    base = [f"x{i}" for i in range(80)]
    rows = [(i, f"t{i}", " ".join(base[:40] + [f"e{i}"] + base[40:]), "", "", 0) for i in range(70)]
    df = spark.createDataFrame(rows, EMAIL)
    assert nd.similar_pairs(df, 3, 0.6, 40).count() == 70 * 69 // 2


def test_allocation_is_optimal():
    """Against the plain dynamic programme: least cost of thresholds whose t + 1 sum up to what is needed."""
    r = np.random.default_rng(3)
    for _ in range(80):
        m = int(r.integers(1, 9))
        size = r.integers(1, 5, m)
        cost = np.concatenate([np.sort(r.integers(0, 30, x)) for x in size]).astype(float)
        look = r.integers(1, 30, m).astype(float)
        need = int(r.integers(max(1, size.sum() - 20), size.sum() + 1))
        t = nd.allocate(cost, look, size, np.array([m]), np.array([need]))
        assert (t >= -1).all() and (t < size).all() and (t + 1).sum() >= need
        begin = np.cumsum(size) - size
        price = lambda w, x: 0.0 if x < 0 else look[w] * nd.LOOK + cost[begin[w] + x]  # noqa: E731, B023
        best = {0: 0.0}
        for w in range(m):
            new: dict = {}
            for u, c in best.items():
                for x in range(-1, size[w]):
                    v = min(u + x + 1, need)
                    new[v] = min(new.get(v, np.inf), c + price(w, x))
            best = new
        assert sum(price(w, x) for w, x in enumerate(t)) == pytest.approx(best[need])


def test_grouping_changes_the_choice():
    """The same runs with the same costs, grouped in another way, are probed otherwise."""
    cost, need = np.array([5.0, 5.0, 9.0, 9.0]), np.array([2])
    paired = nd.allocate(cost, np.ones(2), np.array([2, 2]), np.array([2]), need)
    single = nd.allocate(cost, np.ones(4), np.ones(4, int), np.array([4]), need)
    other = nd.allocate(np.array([5.0, 9.0, 5.0, 9.0]), np.ones(2), np.array([2, 2]), np.array([2]), need)
    assert paired.tolist() == [1, -1] and single.tolist() == [0, 0, -1, -1] and sorted(other.tolist()) == [-1, 1]


@pytest.mark.parametrize("hot", [1 << 13, 3])
def test_no_similar_pair_is_lost(monkeypatch, hot):
    """Of two similar texts one probes a partition that the other is indexed under, whatever the counts say and
    however many keys a partition is dealt out to."""
    monkeypatch.setattr(nd, "HOT", hot)
    r = random.Random(hot)
    tested = 0
    for k, similarity in ((3, 0.6), (5, 0.8), (1, 0.7)):
        for _ in range(150):
            base = [f"w{r.randrange(60)}" for _ in range(r.randint(3, 150))]
            edited = list(base)
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(edited))
                edited[at : at + r.randint(0, 2)] = [f"w{r.randrange(90)}"] * r.randint(0, 2)
                edited = edited or ["x"]
            x, y = ({tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} for w in (base, edited))
            if base == edited or len(x & y) < similarity * len(x | y):
                continue
            tested += 1
            table = np.random.default_rng(r.randrange(1 << 30)).choice([13, 16, 24, 40, 90], 1 << 14).astype(np.uint8)
            h, n = nd.hashed_words([" ".join(base), " ".join(edited)])
            text, key, packed = nd.index_rows(h, n, k, 1 - similarity + 1e-9, table)
            rows = [(int(t), int(q), int(p)) for t, q, p in zip(text, key, packed)]
            index = [(t, q, p) for t, q, p in rows if not p >> 56 & 1]
            mask = (1 << 32) - 1
            assert any(
                t != u and q == v and (p >> 57 == nd.ANY or ((p & mask) & ~(o & mask)).bit_count() < p >> 57) for t, q, p in rows if p >> 57 for u, v, o in index
            ), (k, base, edited)
    assert tested > 100


def test_chunks_are_cut_alike_wherever_they_stand():
    h, n = nd.hashed_words(["a b c d e f g h i j k l", "z y a b c d e f g h i j k l", None, ""])
    keys, count = nd.chunk_keys(h, n)
    assert count[2] == count[3] == 0 and len(set(keys[: count[0]]) & set(keys[count[0] :])) >= count[0] - 2


@pytest.mark.parametrize("length", [40, 60])
def test_short_texts_near_the_bound_are_whole(spark, length):
    """Scattered edits of single words, so that most chunks of either text occur in it alone."""
    r = random.Random(length)
    rows = []
    for g in range(400):
        base = [f"g{g}x{i}" for i in range(length)]
        edited = list(base)
        for p in r.sample(range(length), length // 13 + g % 2):
            edited[p] = f"g{g}y{p}"
        rows += [(2 * g, base[0], " ".join(base[1:])), (2 * g + 1, edited[0], " ".join(edited[1:]))]
    s = sets(rows, 3, 40)
    want = {(2 * g, 2 * g + 1) for g in range(400) if len(s[2 * g] & s[2 * g + 1]) >= 0.6 * len(s[2 * g] | s[2 * g + 1])}
    df = spark.createDataFrame([(*x, "c", "c", 1) for x in rows], EMAIL)
    assert {tuple(x) for x in nd.similar_pairs(df, 3, 0.6, 40).collect()} == want and len(want) > 50


def test_sketches_bound_the_distance():
    r = np.random.default_rng(6)
    for _ in range(300):
        common, a, b = r.integers(1, 60), r.integers(0, 20), r.integers(0, 20)
        x = r.integers(0, 2**63, common + a + b, dtype=np.uint64)
        pair = [np.sort(x[: common + a]), np.sort(np.concatenate((x[:common], x[common + a :])))]
        u, v = nd.sketches(np.concatenate(pair), np.array([len(p) for p in pair]))
        assert sum(int(z).bit_count() for z in (u ^ v).view(np.uint64)) <= a + b


def test_counts_are_never_too_low(spark):
    df = spark.createDataFrame([(f"a b c d{i}",) for i in range(300)], "text string").repartition(3)
    keys = lambda it: (nd.hashed_words(b.column(0).to_pylist())[0] for b in it)
    table = tables.level_table(df, keys, 14)
    h, _ = nd.hashed_words(["a b d7 never"])
    got = tables.counts_of(table[tables.cells(h, 14)])
    assert (np.round(got[:2]) >= 285).all() and (got[:2] < 330).all() and got[2] >= 0.99 and tables.counts_of(tables.levels(np.array([0, 1]))).tolist() == [0, 1]
    assert not tables.level_table(df.where("false"), keys, 14).any()


def test_two_hot_texts_and_nulls(spark):
    """Two texts that are similar make up all rows, in many copies each."""
    base = " ".join(f"x{i}" for i in range(60))
    rows = [(i, "s", base + (" y" if i % 2 else ""), "", "", 0) for i in range(40)] + [(None, "s", base, "", "", 0), (99, None, None, "", "", 0)]
    df = spark.createDataFrame(rows, EMAIL)
    assert nd.similar_pairs(df, 3, 0.6, 40).count() == 40 * 39 // 2
    assert {tuple(r) for r in nd.link_counts(df, 3, 0.6, 40).select("class_id", "copies", "links").distinct().collect()} == {(0, 20, 1), (1, 20, 1)}
