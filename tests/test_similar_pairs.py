"""similar_pairs against brute force."""

import random
from difflib import SequenceMatcher

from linkloom.operators.quality import similar_pairs


def brute(rows, t=0.9):
    first = {}
    for i, x in sorted((i, x) for i, x in rows if i is not None and x):
        first.setdefault(x, i)
    seen, out = set(), []
    for i, x in sorted((i, x) for i, x in rows if i is not None and x):
        if x in seen:
            out.append((first[x], i, 1.0))
        seen.add(x)
    texts = sorted((i, x) for x, i in first.items())
    for k, (i, x) in enumerate(texts):
        for j, y in texts[k + 1 :]:
            m = max(len(x), len(y))
            if abs(len(x) - len(y)) <= max(6, int(m * 0.15)) and (r := SequenceMatcher(None, x, y).ratio()) >= t:
                out.append((i, j, r))
    return sorted(out)


def found(spark, rows):
    got = similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    return sorted((x["a"], x["b"], x["ratio"]) for x in got)


def edited(r, text, n, letters):
    x = list(text)
    for _ in range(n):
        at = r.randrange(len(x))
        x[at : at + r.randint(0, 1)] = r.choice(letters) * r.randint(0, 1)
    return "".join(x)


def test_texts_of_every_length_as_brute_force(spark):
    r, rows = random.Random(7), []
    letters = "eeeeeeetttttaaaaooooiiinnnsshhrrdlucmwfgypbvkxjqz      "
    for n in (3, 6, 9, 14, 30, 45, 60, 62, 75, 120, 199, 200, 230, 300, 800, 2500):
        for _ in range(3):
            base = "".join(r.choice(letters) for _ in range(n))
            rows += [base, base, *[edited(r, base, int(n * e), letters) for e in (0.005, 0.02, 0.05, 0.1, 0.15, 0.2)]]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute(rows)
    assert sum(len(dict(rows)[a]) > 200 for a, b, _ in want) > 20 and sum(len(dict(rows)[a]) < 60 for a, b, _ in want) > 20
    assert found(spark, rows) == want


def test_copies_are_one_row_each_and_short_texts_take_part(spark):
    long = "some words that go on " * 30
    rows = [(1, "ok"), (2, "ok"), (3, long), (4, long), (5, long), (6, None), (7, ""), (None, long), (8, "abcdefgh"), (9, "abcdXefgh"), (10, "x"), (11, "y")]
    assert [(a, b) for a, b, _ in found(spark, rows)] == [(1, 2), (3, 4), (3, 5), (8, 9)]
