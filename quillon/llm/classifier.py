"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

Bytes are embedded; filters of WIDTH bytes slide over the whole text; their responses are max-pooled over overlapping chunks of two segments;
a hidden layer looks at each chunk; its units are max-pooled over the document and combined into one probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a segment (a chunk is two, so chunks overlap by half), of a filter, and between two places of a filter.
SEGMENT, WIDTH, STRIDE = 128, 10, 2
EMBEDDED, FILTERS, HIDDEN = 8, 32, 24
#: Bytes that are scored at once: the bound of a task's memory, whatever a text's length.
BLOCK = 1 << 19
#: The fit's sample: at most so many rows of each label, those of least hash, and of each text the whole or, if it has more, so many chunks evenly spread.
SAMPLE_ROWS, SAMPLE_CHUNKS = 1500, 48
EPOCHS, BATCH, RATE = 14, 24, 0.004
THRESHOLD = 0.3


@dataclass
class Network:
    embedding: np.ndarray  # 256 x EMBEDDED
    filters: np.ndarray  # WIDTH * EMBEDDED x FILTERS
    filter_bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray

    @staticmethod
    def random(seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / math.sqrt(max(1, shape[0]))).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        return Network(r.standard_normal((256, EMBEDDED)).astype(np.float32), draw(WIDTH * EMBEDDED, FILTERS), zero(FILTERS), draw(FILTERS, HIDDEN), zero(HIDDEN), draw(HIDDEN), zero(1))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def laid_out(pieces: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' bytes one after the other, each filled up with zeros to whole segments and one more, which is no place of its own; and the
    number of own segments of each. A piece of m segments may bring WIDTH bytes of what follows it: they stand in the last segment."""
    own = np.array([max(1, -(-(len(p) - (WIDTH if over else 0)) // SEGMENT)) for p, over in pieces], np.int64)
    flat = np.zeros((own.sum() + len(own)) * SEGMENT, np.uint8)
    at = 0
    for (piece, _), m in zip(pieces, own, strict=True):
        flat[at : at + len(piece)] = piece
        at += (m + 1) * SEGMENT
    return flat, own


def convolved(flat: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """The windows (places x WIDTH * EMBEDDED) and the filters' responses before pooling (places x FILTERS), SEGMENT / STRIDE places a segment."""
    embedded = net.embedding[np.concatenate((flat, np.zeros(WIDTH, np.uint8)))]
    n = len(flat) // STRIDE
    windows = np.lib.stride_tricks.as_strided(embedded, (n, WIDTH * EMBEDDED), (STRIDE * EMBEDDED * embedded.itemsize, embedded.itemsize))
    windows = np.ascontiguousarray(windows)
    return windows, windows @ net.filters + net.filter_bias


def chunk_ends(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the chunks of all pieces: the first and the second segment in the layout (the same one in a piece of one segment), and the piece."""
    chunks = np.maximum(own - 1, 1)
    piece = np.repeat(np.arange(len(own)), chunks)
    begin = np.concatenate(([0], np.cumsum(own + 1)[:-1]))
    first = begin[piece] + np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return first, first + (own[piece] > 1), piece


def chunk_states(pieces: list[tuple[np.ndarray, bool]], net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's hidden units, and its piece."""
    flat, own = laid_out(pieces)
    _, responses = convolved(flat, net)
    by_segment = responses.reshape(-1, SEGMENT // STRIDE, FILTERS).max(axis=1)
    first, second, piece = chunk_ends(own)
    pooled = np.maximum(np.maximum(by_segment[first], by_segment[second]), 0)
    return np.maximum(pooled @ net.hidden + net.hidden_bias, 0), piece


def pieces_of(data: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, bool]]:
    """A text's bytes cut so that its chunks are those of the whole text: pieces overlap by a segment and see WIDTH bytes ahead."""
    step = max(2, most // SEGMENT) * SEGMENT
    at = 0
    while len(data) - at > step + SEGMENT:
        yield data[at : at + step + SEGMENT + WIDTH], True
        at += step
    yield data[at:], False


def probabilities(texts: list[bytes], net: Network, block: int = BLOCK) -> np.ndarray:
    """The probability of each text, all of its bytes read, block bytes at a time."""
    best = np.zeros((len(texts), HIDDEN), np.float32)
    held: list[tuple[np.ndarray, bool]] = []
    of: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            states, piece = chunk_states(held, net)
            np.maximum.at(best, np.array(of)[piece], states)
        held.clear()
        of.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece in pieces_of(np.frombuffer(text, np.uint8), block):
            if size + len(piece[0]) > block:
                flush()
            held.append(piece)
            of.append(i)
            size += len(piece[0]) + 2 * SEGMENT
    flush()
    return _sigmoid(best @ net.out + net.out_bias[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def gradients(pieces: list[tuple[np.ndarray, bool]], doc: np.ndarray, labels: np.ndarray, net: Network) -> tuple[float, list[np.ndarray]]:
    """The mean log loss of documents made of pieces (doc: the document of each), and its gradient for each array of the network."""
    flat, own = laid_out(pieces)
    windows, responses = convolved(flat, net)
    per = SEGMENT // STRIDE
    shaped = responses.reshape(-1, per, FILTERS)
    spot = shaped.argmax(axis=1)
    by_segment = np.take_along_axis(shaped, spot[:, None], 1)[:, 0]
    first, second, piece = chunk_ends(own)
    late = by_segment[second] > by_segment[first]
    pooled = np.maximum(np.where(late, by_segment[second], by_segment[first]), 0)
    states = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
    of, n = doc[piece], len(labels)
    best = np.zeros((n, HIDDEN), states.dtype)
    np.maximum.at(best, of, states)
    p = _sigmoid(best @ net.out + net.out_bias[0])
    loss = -np.mean(np.where(labels == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12)))
    d_out = ((p - labels) / n).astype(np.float32)
    d_best = d_out[:, None] * net.out
    # what was pooled gets the gradient: one chunk for each document and unit
    won = (states == best[of]) & (states > 0)
    order = np.where(won, np.arange(len(of))[:, None], len(of))
    least = np.full((n, HIDDEN), len(of))
    np.minimum.at(least, of, order)
    d_states = np.where(order == least[of], d_best[of], 0) * won
    d_pooled = (d_states @ net.hidden.T) * (pooled > 0)
    segment = np.where(late, second[:, None], first[:, None])
    d_segment = np.zeros_like(by_segment)
    np.add.at(d_segment, (segment, np.arange(FILTERS)[None]), d_pooled)
    live, unit = np.nonzero(d_segment)
    place, amount = live * per + spot[live, unit], d_segment[live, unit]
    d_filters = np.zeros_like(net.filters)
    d_windows = amount[:, None] * net.filters[:, unit].T
    for f in range(FILTERS):
        mine = unit == f
        d_filters[:, f] = amount[mine] @ windows[place[mine]]
    at = np.concatenate((flat, np.zeros(WIDTH, np.uint8)))[place[:, None] * STRIDE + np.arange(WIDTH)]
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, at.ravel(), d_windows.reshape(-1, EMBEDDED))
    return float(loss), [d_embedding, d_filters, d_segment.sum(axis=0), pooled.T @ d_states, d_states.sum(axis=0), best.T @ d_out, d_out.sum(keepdims=True)]


def trained(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network fitted to texts by Adam over shuffled batches; of long texts SAMPLE_CHUNKS evenly spread chunks are taken. Same input, same network."""
    net, r = Network.random(seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    steps = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            pieces, doc = [], []
            for j, i in enumerate(batch):
                for piece in _spread(np.frombuffer(texts[i], np.uint8)):
                    pieces.append(piece)
                    doc.append(j)
            _, slopes = gradients(pieces, np.array(doc), labels[batch], net)
            steps += 1
            rate = RATE * (1 - epoch / epochs) * math.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for a, g, (m, v) in zip(net.arrays(), slopes, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                a -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def _spread(data: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    chunks = max(1, -(-len(data) // SEGMENT) - 1)
    if chunks <= SAMPLE_CHUNKS:
        return [(data, False)]
    starts = np.linspace(0, chunks - 1, SAMPLE_CHUNKS // 4).astype(int) * SEGMENT  # four chunks in a row at each place
    return [(data[a : a + 5 * SEGMENT + WIDTH], a + 5 * SEGMENT + WIDTH <= len(data)) for a in starts]


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], np.ndarray, float]:
    """The fit's texts and labels (at most rows of each label), and the share of label 1 among all labelled documents that may be learnt from.

    Ids are chosen by their hash among those that have a text and a label (the largest, if several) and are not held out; then only these rows'
    texts are read. Rows that repeat an id give one text, the least.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~is_held_out(F.col("doc_id")))
    known = one.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    ids = {r.doc_id: r.quality for r in chosen}
    asked = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(asked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # 2 * rows ids
    found = sorted((r.doc_id, r.text) for r in got.collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    return [t.encode() for _, t in found], np.array([ids[i] for i, _ in found], np.int64), share


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """A network fitted to the sample, its bias moved from the sample's share of label 1 to that of all labelled documents.

    Without labelled rows, or with one label only, every text gets the share of label 1 (one half where nothing is known).
    """
    texts, y, share = sample(docs, labels, rows)
    if len(set(y.tolist())) < 2:
        net = Network.random()
        net.out[:] = 0
        net.out_bias[:] = math.log(share / (1 - share))
        return net
    net = trained(texts, y)
    net.out_bias += math.log(share / (1 - share)) - math.log(y.sum() / (len(y) - y.sum()))
    return net


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score, for every row of docs: the probability of label 1 by the whole text (null: empty). No other column is read for it."""
    text = F.coalesce("text", F.lit("")).cast("binary").alias("__text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*(F.col(f"`{c}`") for c in keep), text).mapInArrow(_scored(net), f"{schema}, score double")


def _scored(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = np.concatenate([probabilities(texts.slice(a, 500).to_pylist(), net) for a in range(0, len(texts), 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; learns from labels of rows that are not held out (crc32(doc_id) mod 5 is 0).

    Null texts are empty and get a score like any other, repeated rows get equal scores, a null doc_id counts as the empty string. An empty
    table gives no rows.
    """
    return score(docs, fit(docs, labels, rows)).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
