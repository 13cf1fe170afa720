"""SimHash fingerprints of 128 bits over the distinct words of a text, computed on Arrow buffers without a loop over texts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS = 128
#: Of a word's hash as many bits count; the number of the segment stands above them.
HASH_BITS = 36
_P = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: The eight bits of a byte, one to each byte of a word.
_LANES = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], dtype=np.uint64)
#: Units of a run up to which it is hashed with all others.
LONG_RUN = 512


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(units: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes or code points: eight bytes at a time go through the finaliser, so no two positions can cancel out.

    Runs of over LONG_RUN units are left to blake2b, one by one; they are rare.
    """
    per = 8 // units.itemsize
    padded = np.concatenate((units, np.zeros(per, units.dtype)))
    eight = np.ndarray((len(units) + 1,), np.uint64, padded, strides=(units.itemsize,))
    h = np.full(len(start), (seed * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1), np.uint64)
    at = np.flatnonzero(length <= LONG_RUN) if len(length) and length.max() > LONG_RUN else np.arange(len(start))
    done = 0
    while len(at):
        left = length[at] - done
        shift = (np.maximum(per - left, 0) * (8 * units.itemsize)).astype(np.uint64)
        x = eight[start[at] + done]
        # What lies behind the run is shifted out; a run of no units has nothing.
        x = np.where(left > 0, (x << shift) >> shift, np.uint64(0))
        h[at] = mix(h[at] ^ x, done)
        at = at[left > per]
        done += per
    for k in np.flatnonzero(length > LONG_RUN):
        run = units[start[k] : start[k] + length[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(run, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return mix(h + length.astype(np.uint64), 3)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of the lower-cased texts, nulls as empty."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8) if low.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of letters and digits), and the first word of each segment of offsets, with the count at the end."""
    is_word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | edge[1:-1]
    stops = is_word.copy()
    stops[:-1] &= ~is_word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word, and the first word of each segment of offsets, with the count at the end."""
    start, end, first = _words(data, offsets)
    return start, run_hashes(data, start, end - start), first


def normalised(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    """The words of each segment with one space between."""
    start, end, first = _words(data, offsets)
    length = end - start
    # Every word but the first of its segment has a space before it.
    space = np.ones(len(start), np.int64)
    space[first[:-1][np.diff(first) > 0]] = 0
    before = np.cumsum(space)
    out = np.full(int(length.sum()) + int(space.sum()), 32, np.uint8)
    out[np.arange(int(length.sum())) + np.repeat(before, length)] = data[_WORD[data]]
    ends = np.concatenate(([0], np.cumsum(length + space)))[first]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out.tobytes())).cast(pa.string())


def characters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many characters normalised() gives each segment."""
    count = np.concatenate(([0], np.cumsum(_WORD[data] & ((data & 0xC0) != 0x80))))
    n = np.diff(_words(data, offsets)[2])
    return np.diff(count[offsets]) + np.maximum(n - 1, 0)


def sequence_hash(h: np.ndarray, first: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of the words of each segment in order: the sum of the words' hashes, each finalised with its place."""
    count = np.diff(first)
    place = (np.arange(len(h)) - np.repeat(first[:-1], count)).astype(np.uint64)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ (place * _P), seed), out=c[1:])
    return mix(c[first[1:]] - c[first[:-1]] + count.astype(np.uint64), seed + 1)


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """segments x 2 words of 64 bits: for each bit the majority over the distinct words of the segment; no words give 0."""
    n = len(first) - 1
    seg = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    shift = np.uint64(HASH_BITS)
    # Sorting the segment number above the hash brings repeated words of a segment together.
    packed = np.sort((seg << shift) | (h >> (np.uint64(64) - shift)))
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    seg, h = (packed >> shift).astype(np.int64), packed & ((np.uint64(1) << shift) - np.uint64(1))
    count = np.bincount(seg, minlength=n)
    begin = np.concatenate(([0], np.cumsum(count)))
    # A byte counts to 255, so long segments are summed in runs of that many words.
    runs = -(-count // 255)
    owner = np.repeat(np.arange(n), runs)
    at = begin[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(runs)))[:-1], runs))
    out = np.zeros((n, 2), np.uint64)
    if not len(at):
        return out
    whole = np.flatnonzero(runs)
    run_first = np.concatenate(([0], np.cumsum(runs)))[whole]
    half = (count + 1) // 2
    for k in range(2):
        bits = mix(h, k + 1).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = np.add.reduceat(_LANES[bits[:, byte]], at).view(np.uint8).reshape(-1, 8)
            total = np.add.reduceat(lanes.astype(np.int32), run_first, axis=0)
            # Ties between the counts of 0 and 1 fall to 1.
            out[whole, k] |= (np.packbits(total >= half[whole][:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64)) << np.uint64(8 * byte)
    return out


def of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (texts x 2) and word counts."""
    data, offsets = buffers(texts)
    _, h, first = words(data, offsets)
    return fingerprints(h, first), np.diff(first)


def chunks(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Slices of a batch whose text is about limit bytes, or one row."""
    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def survives(depth: int, reach: int, bits: int = BITS) -> float:
    """The chance that depth random bits out of bits are all the same for a pair that differs in reach of them."""
    return math.prod((bits - reach - i) / (bits - i) for i in range(depth)) if depth <= bits - reach else 0.0


def tries(depth: int, reach: int, target: float, bits: int = BITS) -> int:
    """How many prefixes of depth bits it takes so that a pair that differs in reach of the bits shares one with chance target."""
    chance = survives(depth, reach, bits)
    return 1 if chance >= 1 else math.ceil(math.log(1 - target) / math.log(1 - chance))


def bits_of(fp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint at the given places, as one number."""
    out = np.zeros(len(fp), np.uint64)
    for p in places:
        out = (out << np.uint64(1)) | ((fp[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1))
    return out
