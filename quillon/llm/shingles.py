"""Word shingles and SimHash fingerprints over Arrow batches, vectorised in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are turned into shingles at once.
CHUNK_BYTES = 4_000_000
_LANES = np.zeros(256, np.uint64)
for _bit in range(8):  # a byte of the sum counts each bit; read big-endian, the most significant bit comes first
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def shingle_digests(text: bytes | None, width: int, seed: int) -> bytes:
    """The big-endian XXH64 digests of a text's shingles, repeats included: words of the text in lower case (A-Z), joined by a space.

    Of fewer words than width the whole sequence is the only shingle; of none there is none.
    """
    words = text.lower().split() if text else []
    n, digest = len(words), xxhash.xxh64_digest
    if not n:
        return b""
    if n <= width:
        return digest(b" ".join(words), seed)
    if width == 1:
        return b"".join([digest(w, seed) for w in words])
    joined = b" ".join(words)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    return b"".join([digest(joined[s:e], seed) for s, e in zip(starts[: n - width + 1].tolist(), (starts[width:] - 1).tolist(), strict=True)])


def majority_bits(digests: list[bytes]) -> np.ndarray:
    """For each run of 8-byte digests the 64-bit number whose bits are set in over half of them; 0 for an empty run."""
    counts = np.fromiter((len(d) // 8 for d in digests), np.int64, len(digests))
    out = np.zeros(len(digests), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    n = counts[full]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    pieces = -(-n // 255)  # lanes hold counts up to 255
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(pieces)[:-1])), pieces)
    sums = np.add.reduceat(_LANES[rows], first[owner] + 255 * nth, axis=0)
    lanes = sums.astype(">u8").view(np.uint8).reshape(len(owner), 64).astype(np.int64)
    totals = np.add.reduceat(lanes, np.concatenate(([0], np.cumsum(pieces)[:-1])), axis=0)
    bits = np.packbits(2 * totals > n[:, None], axis=1)
    out[full] = bits.view(">u8").reshape(-1).astype(np.uint64)
    return out


def fingerprints(texts: Iterable[bytes | None], width: int, seed: int) -> np.ndarray:
    """SimHash of every text, chunk by chunk."""
    out, chunk, held = [], [], 0
    for text in texts:
        chunk.append(shingle_digests(text, width, seed))
        held += len(chunk[-1])
        if held > CHUNK_BYTES:
            out.append(majority_bits(chunk))
            chunk, held = [], 0
    out.append(majority_bits(chunk))
    return np.concatenate(out)


def fingerprint_batches(width: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the columns besides text, then fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [name for name in batch.schema.names if name != "text"]
            fp = fingerprints(texts_of(batch), width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), pa.array(fp)], names=[*rest, "fp"])

    return run
