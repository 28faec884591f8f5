"""The suffix tree's scores against one that keeps a dictionary for each context."""

import random

import pytest

from quillon.llm import pst
from tests.llm import brute


def corpus(seed):
    """Sentences whose next word depends on one, two, three or four before it."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    rows = []
    for i in range(140):
        out = [r.choice(words) for _ in range(4)]
        for _ in range(r.choice([0, 5, 60, 120])):
            k = (words.index(out[-1]) + 3 * words.index(out[-3]) + (5 * words.index(out[-4]) if out[-1] in "w1 w2 w3" else 0)) % 9
            out.append(words[k] if r.random() < 0.8 else r.choice(words))
        out += [f"rare{r.randrange(400)}"] * (i % 3 == 0) + ["a set phrase of some words"] * (i % 4 == 0)
        rows.append((i, " ".join(out) if i % 11 else r.choice(["", None, " \n"])))
    return [*rows, (500, "W1 w1 Unseen words\there"), (-3, "one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_are_those_of_the_definition(spark, seed):
    rows = corpus(seed)
    expected, lengths = brute.suffix_tree(rows, pst.P_SYMBOL, pst.P_CONTEXT, pst.P_PAIR, pst.DIVERGENCE)
    assert lengths[3] > 10 and max(lengths) >= 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.score for r in pst.score_documents(docs).collect()}
    assert found.keys() == expected.keys()
    for i, s in expected.items():
        assert found[i] == pytest.approx(s, rel=1e-9, abs=1e-9), i


def test_longer_contexts_tell_more(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pst.fit(docs)
    assert len(model.tree.levels) >= 3 and len(model.tree.parent) == len(model.tree.other)
    short = model.tree._replace(levels=model.tree.levels[:1])
    whole = sum(r.score for r in pst.score(docs, model).collect())
    assert whole > sum(r.score for r in pst.score(docs, model._replace(tree=short)).collect())
