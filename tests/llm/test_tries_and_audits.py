"""Prefix tries, filter audits and the byte classifier against brute force, over nulls, blanks, ties, repeats, long and empty tables."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import classifier, filter_audit, prefix_trie
from tests.llm import brute

TURNS = "conv_id long, turn long, role string, text string, k1 long, n long, depth int"


def conversations(seed=3):
    r = random.Random(seed)
    rows = []
    for c in [*range(-25, 130), 1000, 2**40]:
        base = c // 9
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            said = r.choice(["", "a b", "a  b c", None, f"turn {base}", "Été x"]) if r.random() < 0.3 else f"shared {base % 4} {t}"
            rows.append((c, None if r.random() < 0.05 else t, r.choice([None, "user", "assistant"]) if r.random() < 0.1 else "user", said))
    rows += [(None, 0, "user", "shared 1 0"), (None, 1, "user", "of nobody")]
    rows += [(500, t, "user", f"long {t}") for t in range(400)] + [(501, t, "user", f"long {t}") for t in range(350)]
    return rows + rows[:5] + [(77, 1, "user", "tie b"), (77, 1, "user", "tie a")]


def shown(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("share, light", [(20, 1000), (20, 5), (None, 1000), (None, 3)])
def test_trie(spark, share, light, monkeypatch):
    rows = conversations()
    monkeypatch.setattr(prefix_trie.math, "isqrt", lambda n: 0)  # so that small tables have heavy nodes
    turns = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], TURNS).repartition(3)
    out = prefix_trie.prefix_trie(turns, share, light)
    assert shown(out) == collections.Counter(brute.trie(rows, share).values())


def test_trie_of_nothing_and_of_one(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(nothing, 20).collect() == []
    one = [(7, 3, "user", "x y"), (7, 1, None, None)]
    assert shown(prefix_trie.prefix_trie(spark.createDataFrame([(*x, 1, 2, 3) for x in one], TURNS), 20)) == collections.Counter(brute.trie(one, 20).values())


def test_louds_is_the_forest():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 400):
        parent = np.array([r.integers(-1, k) for k in range(n)], np.int64)
        shuffled = r.permutation(n)  # parents after their children too
        parent = np.where(parent[np.argsort(shuffled)] < 0, -1, shuffled[parent[np.argsort(shuffled)]]) if n else parent
        labels = r.integers(0, 9, n)
        trie = prefix_trie.Louds.build(parent, labels)
        assert sorted(trie.order.tolist()) == list(range(n)) and len(trie.bits) == 2 * n + 1
        up = trie.parents()
        assert [(-1 if u < 0 else trie.order[u]) for u in up] == [parent[i] for i in trie.order]
        assert trie.degrees().tolist() == [int((parent == i).sum()) for i in trie.order]
        assert (np.diff(up) >= 0).all()
        values = r.integers(0, 100, (n, 2))
        total = trie.rolled_up(values)
        for place in range(n):
            under = [place]
            for q in range(place + 1, n):
                if up[q] in under:
                    under.append(q)
            assert total[place].tolist() == values[under].sum(axis=0).tolist()


DOCS = "doc_id long, text string, lang string, source string, same string, mask int, part string, n long"


def documents():
    r = random.Random(2)
    texts = [None, "", " ", "One", "a " * 500, "B" * 50, "x # y", "|", "é" * 99 + "A", "word " * 20 + "Z" * 4]
    texts += [" ".join(r.choice(["alpha", "Beta", "gamma", "#", "delta", "e"]) + str(r.randint(0, 300)) for _ in range(r.choice([20, 199, 200, 260]))) for _ in range(30)]
    rows = [(i, t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, t, r.choice(["en", "fr"])) for i, t in enumerate(texts[::2])] + [(None, texts[12], "en"), (None, texts[12], None), (3, "One", "en"), (5, "B" * 50, "en")]
    return rows


def test_audit(spark):
    rows = documents()
    labels = [(i, r % 2 if r % 5 else None, r % 3 == 0) for i, r in zip([*range(0, 40, 2), 3, 3, 100, 104, 104, None], range(99), strict=False)]
    docs = spark.createDataFrame([(*x, "s", "k", 9, "p", 1) for x in rows], DOCS).repartition(3)
    table = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    masked = filter_audit.masks(docs)
    bits = lambda m: {f for k, f in enumerate("ABCDE") if m >> k & 1}
    expected = brute.filter_masks([r[:2] for r in rows])
    assert sorted((str(r.doc_id), sorted(bits(r.mask))) for r in masked.collect()) == sorted((str(r[0]), sorted(m)) for r, m in zip(rows, expected, strict=True))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t and i is not None}
    parts = collections.defaultdict(list)
    for (i, _, lang), m in zip(rows, expected, strict=True):
        parts[lang or ""].append((m, i in good, i in toxic))
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(masked, table).collect()}
    assert found == {(p, *k): v for p, x in parts.items() for k, v in brute.filter_audit(x).items()}


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.masks(docs), labels).collect() == []
    one = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert filter_audit.audit(filter_audit.masks(one), labels).count() == 600


def plain_probability(data, net):
    """The network as it is defined, one place after the other."""
    data = np.frombuffer(data, np.uint8)
    per, segments = classifier.SEGMENT // classifier.STRIDE, max(1, -(-len(data) // classifier.SEGMENT))
    padded = np.concatenate((data, np.zeros(segments * classifier.SEGMENT - len(data) + classifier.WIDTH, np.uint8)))
    rows = np.stack([net.embedding[padded[p : p + classifier.WIDTH]].ravel() for p in range(0, segments * classifier.SEGMENT, classifier.STRIDE)])
    seen = (rows.astype(np.float64) @ net.filters + net.filter_bias).reshape(segments, per, -1).max(axis=1)
    chunks = [seen[k : k + 2].max(axis=0) for k in range(max(1, segments - 1))]
    best = np.max([np.maximum(np.maximum(c, 0) @ net.hidden + net.hidden_bias, 0) for c in chunks], axis=0)
    return 1 / (1 + np.exp(-(best @ net.out + net.out_bias[0])))


def test_network_is_the_definition_for_texts_of_any_length():
    r = np.random.default_rng(0)
    net = classifier.Network.random(3)
    texts = [r.integers(1, 256, n, np.uint8).tobytes() for n in (0, 1, 9, 127, 128, 129, 255, 256, 257, 300, 1000, 1024, 1034, 5000, 20_000)]
    expected = [plain_probability(t, net) for t in texts]
    for block in (256, 300, 1024, 4096, classifier.BLOCK):  # long texts are cut, short ones share a block
        assert classifier.probabilities(texts, net, block) == pytest.approx(expected, abs=1e-5)


def test_gradients_are_slopes():
    r = np.random.default_rng(1)
    net = classifier.Network.random(5)
    net.embedding, net.filters, net.hidden = (a.astype(np.float64) for a in (net.embedding, net.filters, net.hidden))
    net.filter_bias, net.hidden_bias = net.filter_bias + 0.3, net.hidden_bias + 0.3  # away from the kinks
    pieces = [(r.integers(1, 99, n, np.uint8), False) for n in (40, 300, 700, 128)]
    doc, labels = np.array([0, 1, 1, 2]), np.array([0, 1, 0])
    _, slopes = classifier.gradients(pieces, doc, labels, net)
    for k, a in enumerate(net.arrays()):
        at = np.unravel_index(np.abs(slopes[k]).argmax(), a.shape)
        was, losses = a[at], []
        for moved in (1e-3, -1e-3):
            a[at] = was + moved
            losses.append(classifier.gradients(pieces, doc, labels, net)[0])
            a[at] = was
        assert slopes[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.05)


def test_classifier_ranks_what_it_has_not_seen(spark, sf):
    larger = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    out = classifier.classify(docs.join(labels.select("doc_id"), "doc_id"), labels, rows=400).join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    rank = out.score.rank()
    good, bad = (out.quality == 1).sum(), (out.quality == 0).sum()
    assert (rank[out.quality == 1].sum() - good * (good + 1) / 2) / (good * bad) > 0.97
    assert (out.score[out.quality == 1] >= 0.3).mean() > 0.98 and (out.score[out.quality == 0] < 0.3).mean() > 0.8


def test_classifier_of_odd_rows(spark):
    schema = "doc_id long, text string, score double, label int, predicted string"
    rows = [(i, t, 0.5, 1, "x") for i, t in enumerate(["good words here. " * 9, None, "", "!! " * 90, "y" * 300_000])] + [(None, "nobody's", None, None, None), (1, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 0), (2, 1), (1, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    out = classifier.classify(docs, labels).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert {r.doc_id: r.held_out for r in out}[3] == (brute.zlib.crc32(b"3") % 5 == 0)
    assert classifier.classify(docs.where("false"), labels).collect() == []
    assert {r.score for r in classifier.classify(docs, labels.where("false")).collect()} == {0.5}


def test_sample_is_bounded_and_leaves_held_out_labels_alone(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    texts, y, share = classifier.sample(docs, labels, 10)
    assert collections.Counter(y.tolist()) == {0: 10, 1: 10} and 0.5 < share < 1
    turned = labels.withColumn("quality", F.when(classifier.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again, same, _ = classifier.sample(docs, turned, 10)
    assert texts == again and y.tolist() == same.tolist()


def test_a_long_conversation_is_formatted_in_time_by_its_length(spark):
    import time

    from quillon.llm import chat

    took = []
    for n in (2_000, 16_000):
        turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said <"), F.col("id").cast("string")).alias("text"))
        began = time.perf_counter()
        row = chat.digest(chat.format_conversations(turns)).first()
        took.append(time.perf_counter() - began)
        expected = brute.conversation([(i, "user" if i % 2 == 0 else "assistant", f"said <{i}") for i in range(n)])
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == expected
    assert took[1] < 20 * max(took[0], 0.5)
