import random

import pytest
from conftest import rows

from catalog_audit.operators import similar


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_within_edits_equals_all_pairs(frame, most):
    rnd = random.Random(most)
    names = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 7))) for _ in range(30)} | {"é", "net revenue", "net revenues", "total revenue"}
    for _ in range(40):
        n = list("monthly active customers")
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(n))
            n[at:at + rnd.randrange(2)] = rnd.choice(["", "x", "ab"])
        names.add("".join(n))
    got = rows(similar.within_edits(frame("name string", [(n,) for n in sorted(names)]), most))
    want = [(a, b, edits(a, b)) for a in names for b in names if a < b and edits(a, b) <= most]
    assert got == sorted(want, key=repr)
    assert similar.within_edits(frame("name string", []), most).count() == 0


def test_alike_words_equals_all_pairs(frame):
    rnd = random.Random(3)
    words = ["revenue", "margin", "gross", "churn", "rate", "active", "customer", "order", "value", "total"]
    names = sorted({" ".join(rnd.sample(words, rnd.randrange(1, 6))) for _ in range(60)} | {"", "of the"})
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in similar.alike_words(frame("name string", [(n,) for n in names]), 0.5).collect()}
    sets = {n: set(n.split()) for n in names if n and n != "of the"}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert got == want


def test_names_are_normalised_and_counted(frame):
    df = frame("name string", [("Net  Revenue (12)",), ("net revenue 7",), ("É-Total",), ("42",), (None,)])
    assert rows(similar.distinct_names(df, "name")) == [("net revenue", 2), ("é total", 1)]
