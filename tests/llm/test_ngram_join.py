import random
import re

import numpy as np
import pytest
from tasklode.llm import ngram_join
from tasklode.llm.common import clashes
from tasklode.llm.components import components
from tests.llm.shared import AWKWARD, DOCS, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(rnd, count, passage):
    rows = []
    while len(rows) < count:
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 13, 30, 60, 120, 400]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                at = rnd.randrange(len(base))
                base[at : at + rnd.randint(0, 1)] = [f"W{rnd.randint(0, 5000)}"]
                base = base or ["w"]
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 3, 60)])
def test_groups_against_brute_force(spark, seed, n, percent):
    rnd = random.Random(seed)
    texts = near_copies(rnd, 700, [f"p{i}" for i in range(50)])
    rows = [(i if rnd.random() > 0.03 else None, t) for i, t in enumerate(texts)] + AWKWARD
    rows += [rows[k] for k in rnd.sample(range(700), 20)]
    out = ngram_join.link_groups(docs(spark, rows), n, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows, n, percent)


def test_near_copies_just_above_and_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_ROUNDS", 1)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(1 + i % 4):
            own[rnd.randrange(150)] = f"x{rnd.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    rows += [(200, " ".join(base[:100])), (201, "other words here and there")]
    out = ngram_join.link_groups(docs(spark, rows).repartition(3), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows, 4, 85)


@pytest.mark.parametrize(("seed", "n", "percent"), [(4, 4, 85), (5, 5, 80), (6, 3, 60)])
def test_the_last_join_alone_finds_all_links(spark, monkeypatch, seed, n, percent):
    monkeypatch.setattr(ngram_join, "MOST_ROUNDS", 0)
    rnd = random.Random(seed)
    rows = list(enumerate(near_copies(rnd, 500, [f"p{i}" for i in range(50)])))
    out = ngram_join.link_groups(docs(spark, rows), n, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows, n, percent)


@pytest.fixture
def held(monkeypatch):
    """How many pairs each step holds against each other."""
    counts, linked = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, *more: (counts.append(pairs.count()), linked(pairs, *more))[1])
    return counts


def of_template(count, own, at="x"):
    """Texts of 1,200 words, with words of their own at the same places."""
    return [" ".join(f"{at}{own}_{i}_{k}" if k % 48 == 7 and k // 48 < own else f"t{k}" for k in range(1200)) for i in range(count)]


def test_near_misses_of_a_template_make_no_pairs(spark, held):
    rows = list(enumerate(of_template(120, 25)))
    out = ngram_join.link_groups(docs(spark, rows), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows, 4, 85)
    assert len({r.component_id for r in out}) == 120
    assert held[-1] == 0 and sum(held) <= 120


def test_near_misses_beside_a_group_that_links(spark, monkeypatch):
    rows = list(enumerate(of_template(40, 24) + of_template(40, 25) + of_template(30, 8, "y")))
    rounds = []
    sharing = ngram_join._sharing
    monkeypatch.setattr(ngram_join, "_sharing", lambda early, percent: (rounds.append(sharing(early, percent).count()), sharing(early, percent))[1])
    out = ngram_join.link_groups(docs(spark, rows), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows, 4, 85)
    assert rounds == [0]


def test_one_of_each_with_clashing_columns_ties_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, 1, "a"), (1, text, 2, "b"), (1, text, 3, "c"), (None, text, 4, "d"), (None, None, 5, "e"), (7, "", 6, "f"), (None, "alone here", 7, "g"), (9, text.upper(), 8, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 long, none string").selectExpr("*", "1 AS one", "2 AS __cls", "3 AS cls", "4 AS id", "5 AS _id", "6 AS root", "7 AS key")
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    found = sorted(r.none for r in out.collect())
    assert found in (["b", "e", "f", "g"], ["c", "e", "f", "g"])


def test_classes_with_one_first_number_take_the_second(spark):
    found = clashes(spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "one long, other long"), "one", "other")
    assert found == [1]
    texts = [b"a b c d e", b"f g h i j k"]
    free = ngram_join.Sets(texts, 4, 85, [])
    held = ngram_join.Sets(texts, 4, 85, [int(free.one.view(np.int64)[0])])
    assert held.cls.tolist() == [free.other[0], free.one[1]]


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_linked_sets_agree_on_enough_blocks(percent):
    rnd = np.random.default_rng(percent)
    for _ in range(400):
        size = int(rnd.integers(2, 900))
        base = np.sort(rnd.integers(0, 1 << 63, size, np.uint64))
        drop = int(rnd.integers(0, ngram_join.most_differ(size, size, percent) + 1))
        out = rnd.integers(0, drop + 1)
        other = np.sort(np.concatenate((base[rnd.permutation(size)[out:]], rnd.integers(0, 1 << 63, drop - out, np.uint64))))
        shared = len(np.intersect1d(base, other))
        if 100 * shared < percent * (len(base) + len(other) - shared) or len(base) == shared == len(other):
            continue
        sizes = np.array([len(base), len(other)])
        keys, text, band, spare = ngram_join.block_keys(np.repeat([0, 1], sizes), np.concatenate((base, other)), sizes, percent)
        own = [{(b, k): z for k, t, b, z in zip(keys, text, band, spare, strict=True) if t == i} for i in (0, 1)]
        low = max(set(band[text == 0]) & set(band[text == 1]))
        both = {k: z for k, z in own[0].items() if k in own[1] and k[0] == low}
        assert len(both) > max(both.values())


def test_no_order_of_words_cancels():
    texts = [b" ".join(w) for w in ([b"x", b"y", b"y", b"x"], [b"y", b"x", b"x", b"y"], [b"x", b"x", b"y", b"y"], [b"y", b"y", b"x", b"x"], [b"x", b"y", b"x", b"y"])]
    owners, values, sizes = ngram_join.shingle_sets(texts, 4)
    assert len(set(values.tolist())) == len(texts) == sizes.sum()


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(40)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)] + [(500, 500), (5, 4)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert out == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("links", "tables"), [([(i, 0) for i in range(1, 40)], 2), ([(i, 50) for i in range(40)], 4)])
def test_settled_components_take_no_further_round(spark, monkeypatch, links, tables):
    names, written = [], components.__globals__["written"]
    monkeypatch.setitem(components.__globals__, "written", lambda df, name: (names.append(name), written(df, name))[1])
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(out) == len({x for e in links for x in e}) and {r.root for r in out} == {0}
    assert len(names) == tables


def test_rounds_join_components_not_their_classes(spark, monkeypatch):
    given = []
    monkeypatch.setattr(ngram_join, "components", lambda links: (given.append({x for r in links.collect() for x in r}), components(links))[1])
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        own = [f"w{k}" for k in range(150)]
        for _ in range(1 + i % 4):
            own[rnd.randrange(150)] = f"x{rnd.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    out = ngram_join.link_groups(docs(spark, rows), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute(rows, 4, 85)
    # a component that was joined to another doesn't come again
    assert len(given) > 1 and sum(len(x) for x in given[1:]) < len(given[0])


def test_empty(spark):
    assert ngram_join.link_groups(spark.createDataFrame([], DOCS)).count() == 0
