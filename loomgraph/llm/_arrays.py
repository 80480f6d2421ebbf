"""Array arithmetic on batches of texts, used inside Arrow tasks.

A batch of texts is one flat byte array with offsets; words, shingles and
signatures are computed for the whole batch at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Odd multipliers that keep the order of the parts of a hashed sequence.
_PARTS = np.array([(0xD6E8FEB86659FD93 * (2 * k + 3) ** 5) % (1 << 64) | 1 for k in range(16)], dtype=U)

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and non-null flags of a text column; null texts have no bytes."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    texts = pc.fill_null(column, "").cast(pa.large_string())
    n, first = len(texts), texts.offset
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[first : first + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, from which short spans are hashed.

    Modulo 2**64 there are known pairs of long texts with one hash (from about
    a thousand bytes on); spans of any length are for ``byte_hash``.
    """
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the ``width`` places from each one on, as span_hash gives them; the last ones, cut off, are of no use."""
    out = np.zeros(len(sums), dtype=U)
    if len(sums) > width:
        _, down = _powers(len(sums))
        n = len(sums) - width
        out[:n] = mix((sums[width:] - sums[:n]) * down[:n] + U(width * 0xA24BAED4963EE407 % (1 << 64)))
    return out


#: Bytes up to which a span is hashed together with all others, eight at a time.
LONG = 256
_CHAIN = U(0x9E6C63D0876A9A63)


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded, strides=(1,))


def _cut(block: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Blocks of which only the first ``left`` bytes count."""
    bits = (np.minimum(left, 8) * 8).astype(U)
    return np.where(bits == U(64), block, block & ((U(1) << (bits & U(63))) - U(1)))


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), each block of eight bytes mixed into what was before.

    Spans of up to seven bytes have different hashes if they differ.  Spans
    longer than LONG go through a digest of the standard library.
    """
    start, n = np.asarray(start, np.int64), np.asarray(end, np.int64) - np.asarray(start, np.int64)
    at = blocks(data)
    base = mix(np.array([seed], dtype=U) + _CHAIN)[0]
    out = np.zeros(len(n), dtype=U)
    short = n <= 7
    place = start[short]
    out[short] = mix((_cut(at[place], n[short]) | (n[short].astype(U) << U(56))) ^ base)
    row = np.flatnonzero(~short & (n <= LONG))
    place, left = start[row], n[row]
    total = mix(left.astype(U) ^ base) * _CHAIN
    while len(row):
        total = mix((total ^ _cut(at[place], left)) * _CHAIN + base)
        done = left <= 8
        out[row[done]] = total[done] ^ U(0xA5A5A5A5A5A5A5A5)
        row, place, left, total = row[~done], place[~done] + 8, left[~done] - 8, total[~done]
    for k in np.flatnonzero(n > LONG).tolist():
        digest = hashlib.blake2b(data[start[k] : start[k] + n[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def same_spans(data: np.ndarray, one: np.ndarray, other: np.ndarray, n: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``n`` bytes from ``one`` on in ``data`` are those from ``other`` on in ``there`` (or in ``data``)."""
    far = data if there is None else there
    here, away = blocks(data), blocks(far)
    out = np.ones(len(n), dtype=bool)
    asked = (n > 0) if there is not None else (n > 0) & (one != other)
    for k in np.flatnonzero((n > LONG) & asked).tolist():
        out[k] = np.array_equal(data[one[k] : one[k] + n[k]], far[other[k] : other[k] + n[k]])
    row = np.flatnonzero((n <= LONG) & asked)
    x, y, left = one[row], other[row], n[row]
    while len(row):
        differ = _cut(here[x], left) != _cut(away[y], left)
        out[row[differ]] = False
        more = ~differ & (left > 8)
        row, x, y, left = row[more], x[more] + 8, y[more] + 8, left[more] - 8
    return out


def spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of kept bytes that do not cross an offset."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = offsets[(offsets > 0) & (offsets < len(keep))]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    first[edges] = keep[edges]
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    last[edges - 1] = keep[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owner(offsets: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Index of the text in which each byte position lies."""
    return np.searchsorted(offsets, position, side="right") - 1


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of ``x``, in order and once; numpy's own way hashes them and takes much longer."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def in_both(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sets."""
    both = np.sort(np.concatenate([x, y]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def word_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words.

    Texts with fewer words have one shingle, their whole sequence; texts with
    no word have none.
    """
    data, offsets, _ = flat(column)
    data = LOWER[data]
    start, end = spans(~BLANK[data], offsets)
    n = len(offsets) - 1
    bounds = np.searchsorted(start, offsets)
    words = byte_hash(data, start, end)
    count = np.diff(bounds)
    padded = np.concatenate([words, np.zeros(width, dtype=U)])
    total = np.zeros(len(words), dtype=U)
    for k in range(width):
        total += padded[k : k + len(words)] * _PARTS[k]
    total = mix(total)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first, own = bounds[:-1][short], count[short]
        whole = own.astype(U) * U(0xC2B2AE3D27D4EB4F)
        for k in range(width - 1):
            has = own > k
            whole[has] += words[first[has] + k] * _PARTS[k]
        total[first] = mix(whole)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    return [distinct(total[b : b + m]) if m else total[:0] for b, m in zip(bounds[:n].tolist(), shingles.tolist(), strict=True)]


def bin_minima(hashes: np.ndarray, group: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation sketch: least hash in each of 2**bits bins, and which bins are filled.

    ``hashes`` ascend within each group.
    """
    k = 1 << bits
    slot = group * k + (hashes >> U(64 - bits)).astype(np.int64)
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    sketch, filled = np.zeros(n * k, dtype=U), np.zeros(n * k, dtype=bool)
    sketch[slot[first]], filled[slot[first]] = hashes[first], True
    return sketch.reshape(n, k), filled.reshape(n, k)


def bin_minima_of(hashes: np.ndarray, group: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As bin_minima, for hashes in any order."""
    most = np.iinfo(U).max
    sketch = np.full(n << bits, most, dtype=U)
    np.minimum.at(sketch, (group << bits) | (hashes >> U(64 - bits)).astype(np.int64), hashes)
    sketch = sketch.reshape(n, 1 << bits)
    return sketch, sketch != most


def densify(sketch: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification: an empty bin tries bins in an order drawn by its own
    number alone, until one is filled, and takes that one's value."""
    n, k = sketch.shape
    out = sketch.copy()
    row, col = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    attempt = 1
    while len(row):
        source = (mix(col.astype(U) * U(0x632BE59BD9B4E019) + U(attempt)) % U(k)).astype(np.int64)
        hit = filled[row, source]
        out[row[hit], col[hit]] = sketch[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return out


def band_hashes(sketch: np.ndarray, rows: int) -> np.ndarray:
    """Per text one hash for each band of ``rows`` bins; what does not fill a band is left."""
    n, k = sketch.shape
    bands = k // rows
    cut = sketch[:, : bands * rows].reshape(n, bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x9FB21C651E98DF25), (n, bands)).copy()
    for r in range(rows):
        total += mix(cut[:, :, r]) * _PARTS[r]
    return mix(total)


def list_array(values: np.ndarray, width: int, empty: np.ndarray) -> pa.Array:
    """Rows of ``width`` long values; rows flagged empty have none."""
    lengths = np.where(empty, 0, width)
    offsets = np.zeros(len(empty) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[~empty].reshape(-1).astype(np.int64)))
