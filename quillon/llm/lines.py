"""Fuzzy line dedup: lines that share a rare pair of words, edit similarity, one occurrence kept of each connected group."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import combinations
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import materialize, row_hash
from quillon.llm.components import components
from quillon.llm.shingles import majority_bits, texts_of
from quillon.llm.simhash import BITS, bucket_edges, differing

#: Lines of fewer words (blank ones) are never removed.
LEAST_WORDS = 1
#: A character of a script without spaces (Thai, Lao, Myanmar, Khmer, kana, Chinese) in UTF-8: each is a word.
UNSPACED = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xaf][\x80-\xbf]{2}")
_WIDE = bytes((0xE0, 0xE1, *range(0xE3, 0xEA), 0xF0))  # what these begin with
#: Differing SimHash bits up to which two lines are compared, and the edit similarity at which they are linked.
DISTANCE, SIMILARITY = 3, 0.8
#: Lines of a bucket on the mean, beyond which keys take more blocks.
MEAN_BUCKET = 256
#: Rows up to which the table of decisions (24 bytes a row) is broadcast.
BROADCAST_ROWS = 1_000_000
#: Lines of one bucket verified in one task; larger buckets are divided by a further pigeonhole.
HOT_BUCKET = 5_000
_CACHE_WORDS = 300_000
#: Words of the lines whose keys are made at once: their arrays stay in the processor's cache, and a worker holds little.
CHUNK_WORDS = 30_000
#: Words of a line up to which its rarest pairs of words are keys, as many as an exact bound asks for. Longer lines take SAMPLES pairs by least
#: hash (with the next one, if more than COMMON lines have it): where edits lie apart, lines of similarity 0.8 have 0.43 of their pairs in common
#: and miss each other in 3 % of cases (0.57^6) or some more; of similarity 0.9, in 0.1 %. The exact bound would need a key for every two words.
SHORT, SAMPLES, COMMON = 20, 6, 200
#: Keys of all documents are counted by slot; slots with a RANKEDth of all or more, RANKED at most, get a rank in the broadcast table, so that a
#: line's rare keys are taken first. Any order gives the same links; the better it is, the smaller are the buckets. Keys of one slot share a rank:
#: what others add to a key's count is a tenth (RANKED / SLOTS) of the least that is ranked on the mean, whatever the size of the corpus.
RANKED, SLOTS, SLOT_PARTS = 400_000, 1 << 22, 64
#: Estimated lines of a key beyond which lines meet under it and a second key.
OFTEN = 2_000
#: Lines of one bucket compared in one task; larger buckets are compared block against block.
BLOCK = 10_000
_MANY, _SKETCH = (1 << 16) - 1, (1 << 48) - 1
#: Steps of a rank, which is a logarithm, for a factor of 2.
_STEP = 200
#: Numbers that pairs' hashes are combined with.
_MIX = np.random.default_rng(11).integers(0, 1 << 64, SAMPLES, np.uint64)


class _Digests(dict):
    """Words' digests, as they come up."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > _CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_digest(word, 42)
        return out


#: ASCII white space but the line feed becomes a space.
_BLANKS = bytes(32 if c in b"\t\r\x0b\x0c" else c for c in range(256))


def plain_lines(text: bytes | None) -> list[tuple[int, bytes]]:
    """(line number, line) of the lines that have LEAST_WORDS words or more, in lower case (A-Z) and with single spaces: by passes over the whole text."""
    if not text:
        return []
    lowered = text.lower().translate(_BLANKS)
    if not lowered.isascii() and len(lowered.translate(None, _WIDE)) < len(lowered):
        lowered = UNSPACED.sub(rb" \g<0> ", lowered)
    while b"  " in lowered:
        lowered = lowered.replace(b"  ", b" ")
    return [(k, line) for k, padded in enumerate(lowered.split(b"\n")) if (line := padded.strip(b" ")) and (LEAST_WORDS < 2 or line.count(b" ") + 1 >= LEAST_WORDS)]


def normal_lines(text: bytes | None) -> list[tuple[int, list[bytes]]]:
    """(line number, words) of plain_lines."""
    return [(k, line.split(b" ")) for k, line in plain_lines(text)]


def line_hash(words: list[bytes]) -> int:
    return _hash_of(b" ".join(words))


def _hash_of(line: bytes) -> int:
    value = xxhash.xxh64_intdigest(line, 7)
    return value - (1 << 64) if value >> 63 else value


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text; rows alike in id and text have one key and are one document here."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64("doc_id", row_hash(text)).alias("key"), text.alias("text"))


def line_table(docs: DataFrame, with_fp: bool = True) -> DataFrame:
    """(doc_id, key, line, hash, fp): every line of enough words of docs (doc_id, key, text); fp is 0 unless with_fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Digests()

        def out(batch: pa.RecordBatch, rows: list[int], lines: list[int], hashes: list[int], digests: list[bytes]) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            fp = majority_bits(digests).view(np.int64) if with_fp else np.zeros(len(rows), np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(lines, pa.int32()), pa.array(hashes, pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "key", "line", "hash", "fp"])

        for batch in batches:
            rows, lines, hashes, digests, held = [], [], [], [], 0
            for r, text in enumerate(texts_of(batch)):
                for k, line in plain_lines(text):
                    rows.append(r)
                    lines.append(k)
                    hashes.append(_hash_of(line))
                    if with_fp:
                        digests.append(b"".join(map(cache.__getitem__, set(line.split(b" ")))))  # each word once, or frequent ones decide alone
                held += len(text or b"") // 6
                if held > 500_000:
                    yield out(batch, rows, lines, hashes, digests)
                    rows, lines, hashes, digests, held = [], [], [], [], 0
            if rows:
                yield out(batch, rows, lines, hashes, digests)

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("key", T.LongType()), ("line", T.IntegerType()), ("hash", T.LongType()), ("fp", T.LongType())))])
    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


def block_masks(distance: int, n: int) -> list[int]:
    """Masks of block combinations: of two numbers that differ in distance bits or fewer, at least one mask's bits agree.

    The more lines there are, the more blocks a key takes together (so that buckets stay small) and the more keys there are.
    """
    chosen = next((c for c in (1, 2, 3) if n / 2 ** (BITS * c / (distance + c)) <= MEAN_BUCKET), 3)
    blocks = distance + chosen
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, chosen)]


def _block_keys(fps: np.ndarray, mask: int, number: int) -> np.ndarray:
    """A bucket's key: the masked bits, mixed with the mask's number."""
    x = (fps.view(np.uint64) & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def keyed_fingerprints(fps: DataFrame, masks: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for k, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(_block_keys(values, mask, k)), pa.array(values)], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Levenshtein distance of two sequences by bit-parallel columns; most + 1 once it must be more."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    begin, end = 0, len(a)
    while begin < end and a[begin] == b[begin]:
        begin += 1
    while end > begin and a[end - 1] == b[end - len(a) - 1]:
        end -= 1
    a, b = a[begin:end], b[begin : len(b) - (len(a) - end)]
    m = len(a)
    if not m:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j, c in enumerate(b):
        match = where.get(c, 0)
        d0 = (((match & up) + up) ^ up) | match | down
        right, left = down | (full & ~(d0 | up)), up & d0
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1) | 1
        left <<= 1
        up, down = (left | (full & ~(d0 | right))) & full, right & d0 & full
        if score - (len(b) - j - 1) > most:
            return most + 1
    return score


class _Words:
    """A line's words for comparisons with several others."""

    def __init__(self, line: str) -> None:
        self.words = line.split(" ")

    @cached_property
    def counted(self) -> set[str | tuple[str, int]]:
        """The words as a set that has a word's repeats with their numbers."""
        out: set[str | tuple[str, int]] = set(self.words)
        if len(out) < len(self.words):
            out.update([(w, k) for w, n in Counter(self.words).items() if n > 1 for k in range(1, n)])
        return out

    def similar(self, other: _Words, similarity: float) -> bool:
        less, more = (self, other) if len(self.words) <= len(other.words) else (other, self)
        a, b = less.words, more.words
        most = int((1 - similarity) * len(b) + 1e-9)
        if len(b) - len(a) > most:
            return False
        if len(a) == len(b) and sum(map(ne, a, b)) <= most:
            return True
        if len(more.counted - less.counted) > most:  # so many words have no partner
            return False
        return edit_distance(a, b, most) <= most


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether at most 1 - similarity of the longer line's words must be changed to turn one line into the other."""
    return _Words(a).similar(_Words(b), similarity)


def _verified_forest(hashes: np.ndarray, fps: np.ndarray, lines: list[str], distance: int, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect what verified links connect: a breadth-first search over the lines not reached yet."""
    out, rest = [], np.arange(len(hashes))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = differing(fps[rest], fps[at]) <= distance
            for k in np.flatnonzero(near):
                near[k] = similar(lines[rest[k]], lines[at], similarity)
            found = rest[near]
            out += [(int(hashes[x]), int(hashes[at])) for x in found]
            queue += list(found)
            rest = rest[~near]
    return out


def verified_edges(members: DataFrame, masks: list[int], distance: int, similarity: float) -> DataFrame:
    """(a, b): links of hashes, from members (hash, fp, words): the lines that share a bucket, verified by edit similarity."""
    keys = members.select("hash", "fp", "words", F.explode(F.array(*(F.xxhash64(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)), F.lit(k)) for k, m in enumerate(masks)))).alias("key"))
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    width = BITS // (distance + 1)
    pieces = F.array(*(F.xxhash64("key", F.lit(j), F.shiftrightunsigned("fp", j * width).bitwiseAND(F.lit((1 << width) - 1) if j < distance else F.lit(-1))) for j in range(distance + 1)))
    again = keys.join(hot.where(F.col("n") > 1), "key").select(F.explode(F.when(F.col("n") > HOT_BUCKET, pieces).otherwise(F.array("key"))).alias("key"), "hash", "fp", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashes, fps, lines = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            edges = _verified_forest(np.array(hashes, np.int64), np.array(fps, np.int64), lines, distance, similarity) if len(hashes) > 1 else []
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, h, fp, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    yield from flush()
                    last, hashes, fps, lines = key, [], [], []
                hashes.append(h)
                fps.append(fp)
                lines.append(words)
        yield from flush()

    return again.repartition("key").sortWithinPartitions("key").select("key", "hash", "fp", "words").mapInArrow(run, "a long, b long").distinct()


@lru_cache(1 << 16)
def lost(n: int, similarity: float, width: int) -> int:
    """The most runs of width words (1 or 2) of a line of n words that are not in a line linked to it: an edit breaks width, an added word one less."""
    most = lambda m: int((1 - similarity) * m + 1e-9)
    longest = min(int(n / similarity + 1e-9), n + int(1 / (1 - similarity + 1e-9)) + 1)  # past one more edit, longer lines lose less
    return max(width * most(n), *(width * most(m) - (m - n) for m in range(n, longest + 1)))


#: Numbers of the words' hashes: a polynomial of the bytes modulo 2^64. Powers for the bytes of a chunk and their inverses are made once.
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.full(2 * n, np.uint64(x)))).cumprod(dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(lines: bytes) -> np.ndarray:
    """The hash of each word of bytes in which single spaces part the words: all of them in some passes over the bytes."""
    data = np.frombuffer(lines, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    powers, inverses = _powers_to(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.multiply(data, powers[:-1], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    ends = np.concatenate((np.flatnonzero(data == 32), [len(data)]))
    starts = np.concatenate(([0], ends[:-1] + 1))
    out = (sums[ends] - sums[starts]) * inverses[starts]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


class _Chunk:
    """Distinct lines of four words or more (shorter ones have no link but to their equals), whose keys are made all at once."""

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.hashes: list[int] = []
        self.sizes: list[int] = []
        self.lines: list[bytes] = []
        self.held = 0

    def add(self, h: int, line: bytes, n: int) -> None:
        """A line of n words in single spaces."""
        if n >= 4:
            self.hashes.append(h)
            self.sizes.append(n)
            self.lines.append(line)
            self.held += n

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of all pairs of neighbouring words."""
        n = self.n = np.array(self.sizes, np.int64)
        h = self.words = word_hashes(b" ".join(self.lines))
        owner = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(owner[:-1] == owner[1:])
        left, right = h[at], h[at + 1]
        return owner[at], (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(7)) ^ right

    def slots(self) -> np.ndarray:
        """The slot of each pair, once for each time that a line has it."""
        return (self._pairs()[1] & np.uint64(SLOTS - 1)).astype(np.int64)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys and their numbers of lines."""
        line, key = self._pairs()
        once = np.unique(key ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        return np.unique(key[once], return_counts=True)

    def buckets(self, ranks: np.ndarray, block: int, often: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, bucket): the buckets in which lines meet."""
        line, key = self._pairs()
        rank = ranks[(key & np.uint64(SLOTS - 1)).astype(np.int64)]
        short = self.n[line] <= SHORT
        one, two = self._rarest(line[short], key[short], rank[short], block, often), self._samples(line, key, ranks)
        return np.concatenate((one[0], two[0])), np.concatenate((one[1], two[1]))

    def _samples(self, line: np.ndarray, key: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For lines of more than SHORT words or with a partner of more: the pair of least hash under each of SAMPLES hashes; if it is one that
        many lines have, together with the next."""
        long = self.n[line] >= self.similarity * SHORT
        line, key = line[long], key[long]
        if not len(line):
            return line, key.view(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(line)])))
        out = []
        for m in _MIX:
            mixed = key ^ m
            least = np.minimum.reduceat(mixed, starts)
            one = least ^ m
            common = np.flatnonzero(np.exp2(ranks[(one & np.uint64(SLOTS - 1)).astype(np.int64)] / _STEP) - 1 > COMMON)
            if len(common):
                n = sizes[common]
                begin = np.cumsum(n) - n
                rest = mixed[np.repeat(starts[common] - begin, n) + np.arange(n.sum())]
                rest[rest == np.repeat(least[common], n)] = 0xFFFFFFFFFFFFFFFF
                one[common] = (one[common] ^ np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(rest, begin)
            out.append(one)
        return np.tile(line[starts], SAMPLES), np.concatenate(out).view(np.int64)

    def _rarest(self, line: np.ndarray, key: np.ndarray, rank: np.ndarray, block: int, often: int) -> tuple[np.ndarray, np.ndarray]:
        """Each line's buckets, of which it surely shares one with every line linked to it.

        At most lost of a line's different keys are missing in a linked line. So among the first lost + 1 in an order of all keys stands the first
        one that both have, for either line; and if two or more are shared, the second one stands among the first lost + 2. Under a key of
        many lines they meet by that key and a later one; a line that is sure to share only one takes both ways. What is left under a key of very
        many lines becomes pairs of blocks of lines, so that any two of them still meet.
        """
        order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32)))
        line, key, rank = line[order], key[order], rank[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        line, key, rank = line[once], key[once], rank[once]
        starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))[: len(line)]
        sizes = np.diff(np.concatenate((starts, [len(line)])))
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        limit = np.array([lost(n, self.similarity, 2) for n in range(SHORT + 1)])[self.n[line]]
        at = np.flatnonzero(np.arange(len(line)) - start <= limit)
        count = np.exp2(rank[at] / _STEP) - 1
        hot = count > often
        # under a second key
        first = at[hot]
        more = start[first] + np.minimum(size[first] - 1, limit[first] + 1) - first
        one = np.repeat(first, more)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(more) - more, more)
        both = (key[one] ^ np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15) ^ key[two]
        # under the key alone, in blocks if many lines have it
        single = ~hot | (size[at] - limit[at] < 2)
        at, count = at[single], count[single]
        reps = np.maximum(1, -(-count // block)).astype(np.int64)
        other = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        at, blocks = np.repeat(at, reps), np.repeat(reps, reps)
        own = (np.array(self.hashes, np.int64)[line[at]] >> 8) % blocks
        pair = (np.minimum(own, other) * blocks + np.maximum(own, other)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return np.concatenate((line[at], line[one])), np.concatenate((key[at] ^ pair, both)).view(np.int64)

    def sketches(self) -> list[np.ndarray]:
        """low, middle, high of each line: its number of words in 16 bits, and 176 bits, each the parity of the words that fall on it, of which a
        changed word changes two at most."""
        starts = np.concatenate(([0], np.cumsum(self.n)[:-1]))
        bit = (self.words >> np.uint64(48)) % np.uint64(176)
        lane, mark = bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))
        out = [np.bitwise_xor.reduceat(np.where(lane == k, mark, np.uint64(0)), starts) for k in (0, 1, 2)]
        out[2] |= np.minimum(self.n, _MANY).astype(np.uint64) << np.uint64(48)
        return [x.view(np.int64) for x in out]


def _near(one: list[np.ndarray], other: list[np.ndarray] | list[np.int64], similarity: float) -> np.ndarray:
    """Whether lines of these sketches (low, middle, high) can be similar."""
    n, m = (one[2] >> 48) & _MANY, (other[2] >> 48) & _MANY
    longer = np.maximum(n, m)
    most = np.where(longer == _MANY, 1 << 30, ((1 - similarity) * longer + 1e-9).astype(np.int64))
    bits = differing(one[0], other[0]).astype(np.int64) + differing(one[1], other[1]) + differing(one[2] & _SKETCH, other[2] & _SKETCH)
    return (np.abs(n - m) <= most) & (bits <= 2 * most)


def _chunks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[_Chunk]:
    """The texts' lines in chunks; a line that was seen shortly before isn't looked at again."""
    seen: set[int] = set()
    for batch in batches:
        chunk = _Chunk(similarity)
        for text in texts_of(batch):
            for _, line in plain_lines(text):
                if (h := _hash_of(line)) not in seen:
                    if len(seen) > 2 * _CACHE_WORDS:
                        seen.clear()
                    seen.add(h)
                    chunk.add(h, line, line.count(b" ") + 1)
                    if chunk.held > CHUNK_WORDS:
                        yield chunk
                        chunk = _Chunk(similarity)
        if chunk.held:
            yield chunk


def rank_table(docs: DataFrame, similarity: float) -> np.ndarray:
    """The rank of each slot of keys: a logarithm of how many pairs of words of docs (text) fall on it, for slots of many; 0 is rare.

    A task counts the slots of all its lines in one array and passes it on in SLOT_PARTS parts, a byte of the counts at a time; the sums stay a table,
    of which the driver gets the total and the ranked slots, RANKED at most, whatever the corpus.
    """
    width = SLOTS // SLOT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(SLOTS, np.uint32), [], 0
        for chunk in _chunks(batches, similarity):
            held.append(chunk.slots())
            n += len(held[-1])
            if n > SLOTS // 4:
                total += np.bincount(np.concatenate(held), minlength=SLOTS).astype(np.uint32)
                held, n = [], 0
        for slots in held:
            np.add.at(total, slots, np.uint32(1))
        for byte in range(4):
            some = ((total >> np.uint32(8 * byte)) & np.uint32(255)).astype(np.uint8)
            parts = np.flatnonzero(some.reshape(SLOT_PARTS, width).any(axis=1))
            if len(parts):
                values = pa.array([some[k * width : (k + 1) * width].tobytes() for k in parts.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), byte, np.int32)), values], names=["part", "byte", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # SLOT_PARTS at most
        for batch in batches:
            for part, byte, counts in zip(batch.column("part").to_pylist(), batch.column("byte").to_pylist(), batch.column("counts"), strict=True):
                if part not in sums:
                    sums[part] = np.zeros(width, np.uint64)
                sums[part] += np.frombuffer(counts.as_buffer(), np.uint8).astype(np.uint64) << np.uint64(8 * byte)
        for part, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([n.tobytes()], pa.binary())], names=["part", "total", "counts"])

    counted = materialize(docs.select("text").mapInArrow(count, "part int, byte int, counts binary").repartition("part").mapInArrow(add, "part int, total long, counts binary"), "slots")
    least = max(2, -(-(counted.agg(F.sum("total")).first()[0] or 0) // RANKED))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                n = np.frombuffer(counts.as_buffer(), np.uint64)
                slots = np.flatnonzero(n >= least)
                ranks = np.minimum(4095, _STEP * np.log2(n[slots].astype(np.float64) + 1)).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array((part * width + slots).astype(np.int32)), pa.array(ranks)], names=["slot", "rank"])

    ranked = counted.select("part", "counts").mapInArrow(often, "slot int, rank short").toArrow()
    out = np.zeros(SLOTS, np.uint16)
    out[ranked["slot"].to_numpy()] = ranked["rank"].to_numpy()
    return out


def rare_keys(docs: DataFrame, similarity: float) -> DataFrame:
    """(key, hash, low, middle, high): the lines of docs (key, text) in buckets, of which linked lines share one: short ones surely, long ones as SAMPLES says."""
    known = docs.sparkSession.sparkContext.broadcast(rank_table(docs, similarity))
    block, often = BLOCK, OFTEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, similarity):
            line, key = chunk.buckets(known.value, block, often)
            columns = (c[line] for c in (np.array(chunk.hashes, np.int64), *chunk.sketches()))
            yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, columns)], names=["key", "hash", "low", "middle", "high"])

    return docs.select("text").mapInArrow(run, "key long, hash long, low long, middle long, high long")


def live_keys(keyed: DataFrame, similarity: float) -> DataFrame:
    """(bucket, hub, hash, low, middle, high): the rows of keyed that can have a link within their bucket, which is named by all of its such lines (near
    copies share most keys, and buckets of the same lines are one), with its least hash, or their own if they can't have a link with that line."""

    def marks(key: np.ndarray, sketch: list[np.ndarray]) -> np.ndarray:
        alive = np.zeros(len(key), bool)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        size_of = np.repeat(sizes, sizes)
        for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
            a = np.flatnonzero((key[:-d] == key[d:]) & (size_of[d:] <= 64))
            if not len(a):
                break
            near = a[_near([x[a] for x in sketch], [x[a + d] for x in sketch], similarity)]
            alive[near] = alive[near + d] = True
        for s, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
            part = slice(s, s + size)
            lanes, mine = [x[part] for x in sketch], alive[part]
            first = _near(lanes, [x[0] for x in lanes], similarity)  # copies of one line are through after this
            mine |= first & (first.sum() > 1)
            for rest in np.array_split(np.flatnonzero(~mine), -(-size // 64)):
                near = _near(lanes, [x[rest][:, None] for x in lanes], similarity)
                near[np.arange(len(rest)), rest] = False
                mine[rest] |= near.any(axis=1)
                mine |= near.any(axis=0)
        return alive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def flush(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(columns[0]) < 2:
                return
            key = columns[0]
            shared = np.concatenate(([False], key[1:] == key[:-1]))
            shared[:-1] |= shared[1:]
            columns = [c[shared] for c in columns]
            order = np.lexsort((columns[1], columns[0]))  # by key they are already; Spark sorts by one number, without comparing rows
            key, h = (c[order] for c in columns[:2])
            order = order[np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))[: len(key)]]
            key, *rest = columns = [c[order] for c in columns]
            if not len(key):
                return
            alive = marks(key, rest[1:])
            if alive.any():
                key, h, *sketch = (c[alive] for c in columns)
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                mixed = (h.view(np.uint64) ^ (h.view(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                members = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts).view(np.int64)
                sizes = np.diff(np.concatenate((starts, [len(key)])))
                first = np.repeat(starts, sizes)
                hub = np.where(_near(sketch, [x[first] for x in sketch], similarity), h[first], h)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(members, sizes), hub, h, *sketch)], names=["bucket", "hub", "hash", "low", "middle", "high"])

        for batch in batches:
            held = [np.concatenate((c, x.to_numpy())) for c, x in zip(held, batch.columns, strict=True)]
            if len(held[0]) > 400_000:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
                yield from flush([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        yield from flush(held)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "bucket long, hub long, hash long, low long, middle long, high long").dropDuplicates(["bucket", "hash"])


def similar_stars(live: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the lines that are similar to the hub of a bucket of theirs. A row a pair, so no group of near copies meets in one task."""
    pairs = live.where("hash <> hub").select("hash", "hub").distinct()
    both = pairs.join(texts, "hash").join(texts.select(F.col("hash").alias("hub"), F.col("words").alias("other")), "hub").select("hash", "hub", "words", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lru_cache(256)(_Words)  # a hub's rows often come together
        for batch in batches:
            one, other = (batch.column(c).to_pylist() for c in ("words", "other"))
            near = pa.array([_Words(x).similar(words(y), similarity) for x, y in zip(one, other, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("hash").filter(near), batch.column("hub").filter(near)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def similar_rest(live: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): roots of the stars' components (hash, root) that links between lines of a bucket join, as many as join them."""
    rooted = live.join(roots, "hash", "left").withColumn("root", F.coalesce("root", "hash"))
    parts = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    rows = rooted.join(parts, "bucket").join(texts, "hash").select("bucket", "root", "low", "middle", "high", "words").repartition("bucket").sortWithinPartitions("bucket", "root")

    def links(roots_: list[int], sketch: list[np.ndarray], lines: list[str]) -> list[tuple[int, int]]:
        out, root = [], np.unique(np.array(roots_, np.int64), return_inverse=True)[1]
        words: dict[int, _Words] = {}
        n = len(roots_)
        step = max(1, 500_000 // n)
        for begin in range(0, n - 1, step):
            mine = slice(begin, min(begin + step, n))
            near = _near([x[mine, None] for x in sketch], [x[None, begin:] for x in sketch], similarity)
            near &= root[mine, None] != root[None, begin:]
            for row in np.flatnonzero(near.any(axis=1)).tolist():
                i = begin + row
                for j in (i + 1 + np.flatnonzero(near[row, row + 1 :] & (root[i + 1 :] != root[i]))).tolist():
                    if root[j] == root[i]:
                        continue
                    for k in (i, j):
                        if k not in words:
                            words[k] = _Words(lines[k])
                    if words[i].similar(words[j], similarity):
                        out.append((roots_[j], roots_[i]))
                        root[root == root[j]] = root[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                root, *sketch, words = zip(*held, strict=True)
                edges = links(list(root), [np.array(c, np.int64) for c in sketch], list(words))
                if edges:
                    a, b = zip(*edges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last:
                    yield from flush()
                    last, held = bucket, []
                held.append(row)
        yield from flush()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _texts_of_lines(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(hash, words) of the members (hash, key, line), from the documents that hold their first occurrence."""
    wanted = members.groupBy("key").agg(F.collect_list(F.col("line")).alias("wanted"))  # bounded by a text's lines
    # few documents hold members: their keys are broadcast, and no text is dealt anew; beyond the bound the join deals both sides
    few = members.count() <= BROADCAST_ROWS
    held = docs.join(F.broadcast(wanted) if few else wanted, "key").select("wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, lines = [], []
            for wanted, text in zip(batch.column("wanted").to_pylist(), texts_of(batch), strict=True):
                numbers = set(wanted)
                for k, line in plain_lines(text):
                    if k in numbers:
                        hashes.append(_hash_of(line))
                        lines.append(line.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(lines, pa.string())], names=["hash", "words"])

    return held.mapInArrow(run, "hash long, words string").dropDuplicates(["hash"])


def decisions(docs: DataFrame, distance: int | None = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """(hash, keep_key, keep_line) for the lines that occur more than once: the one occurrence to keep, the first by doc_id and line."""
    first = F.min(F.struct("doc_id", "line", "key")).alias("first")
    unique = materialize(line_table(docs, with_fp=distance is not None).groupBy("hash").agg(first, F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "lines")
    place = (F.col("first.key").alias("key"), F.col("first.line").alias("line"))
    if distance is None:
        if similarity < SIMILARITY:
            raise ValueError(f"a shared key is certain from a similarity of {SIMILARITY}")
        live = materialize(live_keys(rare_keys(docs, similarity), similarity), "live")
        members = materialize(unique.join(live.select("hash").distinct(), "hash", "left_semi").select("hash", *place), "members")
        texts = materialize(_texts_of_lines(docs, members), "line-texts")
        stars = materialize(similar_stars(live, texts, similarity), "line-stars")
        roots = components(stars)
        tops = components(similar_rest(live, roots.select(F.col("a").alias("hash"), F.col("b").alias("root")), texts, similarity))
        top = tops.select(F.col("a").alias("b"), F.col("b").alias("top"))
        over = roots.join(top, "b", "left").select("a", F.coalesce("top", "b").alias("b"))
        roots = over.unionByName(tops.join(roots.select("a"), "a", "left_anti"))
    else:
        by_fp = unique.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
        masks = block_masks(distance, unique.count())
        blocks = materialize(bucket_edges(keyed_fingerprints(by_fp, masks), distance), "blocks")
        near = by_fp.where("n > 1").select("fp").unionByName(blocks.select(F.col("a").alias("fp"))).unionByName(blocks.select(F.col("b").alias("fp"))).distinct()
        members = materialize(unique.join(near, "fp", "left_semi").select("hash", "fp", *place), "members")
        with_words = members.join(_texts_of_lines(docs, members), "hash").select("hash", "fp", "words")
        roots = components(verified_edges(with_words, masks, distance, similarity))
    grouped = roots.select(F.col("a").alias("hash"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("hash"), F.col("b").alias("root")).distinct())
    in_groups = unique.join(grouped, "hash").select("hash", "root", "first")
    heads = in_groups.groupBy("root").agg(F.min("first").alias("first"))
    fuzzy = in_groups.select("hash", "root").join(heads, "root").select("hash", "first")
    exact = unique.where("n > 1").join(grouped, "hash", "left_anti").select("hash", "first")
    return materialize(exact.unionByName(fuzzy).select("hash", F.col("first.key").alias("keep_key"), F.col("first.line").alias("keep_line")), "decisions")


def _removed(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs (key, text) without the lines to remove, with __cut, their numbers, and __lines, how many lines there were: by a
    broadcast of the decisions where they are few, else by joins."""
    n = table.count()
    spark = docs.sparkSession
    if n <= BROADCAST_ROWS:
        rows = table.toArrow().sort_by("hash")
        known = spark.sparkContext.broadcast(tuple(rows[c].to_numpy().astype(np.int64) for c in ("hash", "keep_key", "keep_line")))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, keys, keep = known.value
            place = docs_names.index("text")
            for batch in batches:
                own = batch.column("key").to_numpy()
                row, line, value = [], [], []
                texts = texts_of(batch)
                for r, text in enumerate(texts):
                    for k, plain in plain_lines(text):
                        row.append(r)
                        line.append(k)
                        value.append(_hash_of(plain))
                out: list[list[int]] = [[] for _ in texts]
                left = batch.column("text")
                if row and len(hashes):
                    value, rows_, lines_ = np.array(value, np.int64), np.array(row), np.array(line)
                    at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
                    gone = (hashes[at] == value) & ~((keys[at] == own[rows_]) & (keep[at] == lines_))
                    for r, k in zip(rows_[gone].tolist(), lines_[gone].tolist(), strict=True):
                        out[r].append(k)
                    if gone.any():
                        cleaned = list(texts)
                        for r, numbers in enumerate(out):
                            if numbers:
                                parts = texts[r].split(b"\n")
                                for k in reversed(numbers):
                                    parts[k] = None
                                cleaned[r] = b"\n".join(p for p in parts if p is not None)
                        kind = batch.schema.field("text").type
                        left = pa.array(cleaned, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).view(kind)
                count = pa.array([0 if t is None else t.count(b"\n") + 1 for t in texts], pa.int32())
                columns = [left if k == place else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int32())), count], names=[*batch.schema.names, "__cut", "__lines"])

        docs_names = docs.columns
        return docs.mapInArrow(cut, T.StructType([*docs.schema, T.StructField("__cut", T.ArrayType(T.IntegerType())), T.StructField("__lines", T.IntegerType())]))
    occurrences = line_table(docs.select("doc_id", "key", "text"), with_fp=False).select("key", "line", "hash")
    gone = occurrences.join(table, "hash").where((F.col("key") != F.col("keep_key")) | (F.col("line") != F.col("keep_line")))
    lists = gone.groupBy("key").agg(F.array_sort(F.collect_set("line")).alias("__cut"))
    joined = docs.join(lists, "key", "left").withColumn("__cut", F.coalesce("__cut", F.array().cast("array<int>")))
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__cut", i)), "\n")
    return joined.withColumn("__lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("text", F.when(F.size("__cut") > 0, left).otherwise(F.col("text")))


def dedup_lines(docs: DataFrame, distance: int | None = DISTANCE, similarity: float = SIMILARITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, text (without removed lines), n_lines and removed (their numbers from 0), for every row of docs (doc_id, text).

    Lines are compared in lower case (A-Z) with white space collapsed. Those of LEAST_WORDS words or more link if the edit similarity
    (by words) is at least similarity and, unless distance is None, their SimHash differs in at most distance bits; of a connected group the occurrence first by doc_id (nulls first) and
    line stays. Characters of scripts without spaces are words; blank lines stay. Null text has no lines and stays null; rows alike in doc_id and text are one document and lose the same
    lines; a document may be left with empty text; an empty table gives no rows.
    """
    keyed = _keyed(docs)
    table = decisions(keyed, distance, similarity)
    text = F.col("text").cast("string")
    rest = [c for c in keep if c not in ("doc_id", "text")]
    source = docs.select("doc_id", F.xxhash64("doc_id", row_hash(text)).alias("key"), text.alias("text"), *rest)
    return _removed(source, table).select(*keep, "text", F.col("__lines").alias("n_lines"), F.col("__cut").alias("removed"))
