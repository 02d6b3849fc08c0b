"""How many leaks at the very limit of length and edits the search finds."""

import random

import pytest

from marlstone.llm import leaks


@pytest.mark.parametrize("length,edits", [(30, 3), (32, 4)])
def test_recall_at_the_limit(length, edits):
    rng, items, docs = random.Random(length), [], []
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    for i in range(600):
        part = [name() for _ in range(length)]
        items.append((i, " ".join(part)))
        for at in sorted(rng.sample(range(length), edits), reverse=True):
            part[at : at + rng.choice([0, 1, 1])] = [name()] if rng.random() < 0.7 else []
        docs.append(" ".join([name() for _ in range(rng.randrange(40, 80))] + part + [name() for _ in range(60)]))
    got = leaks.Search(items, leaks.Plan(), leaks.FURNITURE).pairs(docs)
    assert all(a == b for a, b in got)
    assert len(got) >= 0.98 * len(docs)
