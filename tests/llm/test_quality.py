import random
import re

from tasklode.llm import quality
from tests.llm.shared import AWKWARD, DOCS, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    windows = {}
    for i in range(n - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    longest = 0
    while n and longest < n and len({tuple(w[i : i + longest + 1]) for i in range(n - longest)}) < n - longest:
        longest += 1
    failed = n < 10 or 100 * len(repeated) > 20 * n
    kept = not failed and not (longest >= 30 and longest * 100 > 10 * n)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), longest, failed, kept


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [r for r in AWKWARD if not r[1] or len(r[1]) < 20_000]
    for i in range(120):
        w = rnd.choices(["a", "bb", "é", "x#y", "<z>", "a\n", "\n"], k=rnd.randint(0, 80)) if i % 2 else [f"w{rnd.randint(0, 900)}" for _ in range(rnd.randint(5, 400))]
        if i % 4 == 0 and len(w) > 40:
            w += w[3 : 3 + rnd.randint(5, 40)]
        rows.append((100 + i, rnd.choice([" ", "  ", "\t"]).join(w)))
    out = quality.assess(docs(spark, rows)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(key, out)) == sorted(key((d, *brute(t))) for d, t in rows)


def test_one_word_over_and_over(spark):
    row = quality.assess(docs(spark, [(1, "abc " * 30_000)])).first()
    assert (row.n_repeat_words, row.longest_repeat, row.kept) == (30_000, 29_999, False)


def test_empty(spark):
    assert quality.assess(spark.createDataFrame([], DOCS)).count() == 0
