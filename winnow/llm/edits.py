"""Whether two texts are within an edit distance, for many pairs at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of the tables of one batch of pairs.
CELLS = 1 << 20
#: Words of 64 bits that the band of a pair may take where columns are computed for all pairs at once.
BAND = 3
#: Edits up to which furthest-reaching points are tried for pairs of a wider band, before their bits are computed pair by pair.
NEAR = 32
#: Pairs of one batch of bands, and words of its table of characters.
PAIRS, TABLE = 4096, 1 << 22
#: Pairs times the square of the distance, for each word and character, from which bands are faster.
FEW = 600


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, 16 bits wide if they fit, with the start and length of each."""
    texts = texts.cast(pa.large_string())
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]] if len(texts) else b""
    code = np.frombuffer(bytes(data).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return code.astype(np.uint16) if code.max(initial=0) < 1 << 16 else code, np.cumsum(length) - length, length


class _Runs:
    """How far two places of the code points agree, a word of 64 bits at a time."""

    def __init__(self, code: np.ndarray):
        self.per, self.width = 8 // code.itemsize, np.uint64(8 * code.itemsize)
        self.padded = np.concatenate((code, np.zeros(self.per, code.dtype)))
        self.word = np.ndarray((len(code) + 1,), np.uint64, self.padded, strides=(code.itemsize,))

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), most.dtype)
        at = np.flatnonzero(most > 0)
        a, b, left = a[at], b[at], most[at]
        while len(at):
            w = self.word[a] ^ self.word[b]
            # The units below the lowest bit that differs agree.
            n = np.minimum((np.bitwise_count((w & (~w + np.uint64(1))) - np.uint64(1)) // self.width).astype(most.dtype), left)
            out[at] += n
            on = (n == self.per) & (left > n)
            at, a, b, left = at[on], a[on] + self.per, b[on] + self.per, left[on] - self.per
        return out


def _batch(runs: _Runs, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Furthest-reaching points: with each further edit, how far each diagonal gets. The work grows with the square of the distance, not with the lengths."""
    k = int(most.max())
    out = np.zeros(len(a), bool)
    live = np.arange(len(a))
    # reach[:, k + 1 + d]: characters of a used up on diagonal d (place in b less place in a); -2 is nowhere.
    a, la, b, lb, most = (v.astype(np.int32 if len(runs.padded) < 2**31 else np.int64) for v in (a, la, b, lb, most))
    reach = np.full((len(a), 2 * k + 3), -2, la.dtype)
    for e in range(k + 1):
        lo, hi = k + 1 - e, k + 2 + e
        d = np.arange(-e, e + 1, dtype=la.dtype)[None, :]
        if e == 0:
            x = np.zeros((len(live), 1), la.dtype)
        else:
            # An edit drops a character of a, replaces one, or adds one of b.
            x = np.maximum(np.maximum(reach[:, lo + 1 : hi + 1] + 1, reach[:, lo:hi] + 1), reach[:, lo - 1 : hi - 1])
        x = np.minimum(np.minimum(x, la[live][:, None]), lb[live][:, None] - d)
        # A diagonal counts only while the edits that are left can lead from it to the end.
        good = (x >= 0) & (x + d >= 0) & (np.abs(d - (lb - la)[live][:, None]) <= (most[live] - e)[:, None])
        cell = np.flatnonzero(good)
        own = live[cell // x.shape[1]]
        at = x.reshape(-1)[cell]
        y = at + (cell % x.shape[1]).astype(la.dtype) - e
        x = np.where(good, x, -2)
        x.reshape(-1)[cell] = at + runs.forward(a[own] + at, b[own] + y, np.minimum(la[own] - at, lb[own] - y))
        reach[:, lo:hi] = x
        end = lb[live] - la[live]
        there = np.abs(end) <= e
        done = np.zeros(len(live), bool)
        done[there] = x[np.flatnonzero(there), end[there] + e] >= la[live][there]
        out[live[done]] = True
        on = ~done & (most[live] > e)
        if not on.any():
            break
        live, reach = live[on], reach[on]
    return out


def _numbered(code: np.ndarray) -> tuple[int, np.ndarray]:
    """How many code points there are, and the code points as numbers from 0 on."""
    if code.itemsize > 2:
        kinds, ids = np.unique(code, return_inverse=True)
        return len(kinds), ids
    there = np.zeros(1 << 16, bool)
    there[code] = True
    return int(there.sum()), (np.cumsum(there) - 1)[code]


def _banded(ids: np.ndarray, kinds: int, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
    """The band of most diagonals to either side, as bits of vertical differences, a column of all pairs at a time (Myers; Hyyro's band).

    ids: code points as numbers under kinds. a is the longer one of each pair and longer than most; 2 * most + 1 bits fit into words. The work
    grows with the length, and hardly with the distance.
    """
    order = np.argsort(-lb, kind="stable")
    a, la, b, lb, most = (v[order] for v in (a, la, b, lb, most))
    n, bits, one = len(a), 64 * words, np.uint64(1)
    every = lambda length: (np.repeat(np.arange(n), length), np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length))
    # Place of a's characters among the bits: the band of column i begins at bit i for every pair.
    p, k = every(la)
    bit = k + bits - 1 - most[p]
    table = np.zeros(((int(bit.max()) + bits) // 64 + 2, kinds * n), np.uint64)
    np.add.at(table.reshape(-1), ((bit >> 6) * kinds + ids[a[p] + k]) * n + p, one << (bit & 63).astype(np.uint64))
    p, k = every(lb)
    column = np.zeros((int(lb[0]), n), np.int64)
    column[k, p] = ids[b[p] + k].astype(np.int64) * n + p
    # The rows from 0 to most are in the band at first.
    grid = np.arange(bits).reshape(words, 64)[:, :, None] >= bits - 1 - most
    vp = list(np.packbits(grid, axis=1, bitorder="little").transpose(0, 2, 1).copy().view(np.uint64)[:, :, 0])
    vn = [np.zeros(n, np.uint64) for _ in range(words)]
    score = most.astype(np.int64)
    # Up to there the score follows the last diagonal, and from there the last row.
    turn = la - most
    first_turn = np.minimum.accumulate(turn)
    count = np.searchsorted(-lb, -np.arange(int(lb[0])), "left")
    m = n
    for i in range(int(lb[0])):
        if count[i] < m:
            m = int(count[i])
            vp, vn = [v[:m] for v in vp], [v[:m] for v in vn]
        at, word, low = column[i, :m], i >> 6, np.uint64(i & 63)
        part = [table[word + w].take(at) for w in range(words + (i & 63 > 0))]
        x = [(part[w] >> low) | (part[w + 1] << (np.uint64(64) - low)) for w in range(words)] if i & 63 else part
        d0, hp, hn, carry = [], [], [], None
        for w in range(words):
            t = x[w] & vp[w]
            s = t + vp[w]
            if words > 1:
                over = s < t
                if carry is not None:
                    s += carry
                    over |= s < carry
                carry = over.astype(np.uint64)
            d0.append((s ^ vp[w]) | x[w] | vn[w])
            hp.append(vn[w] | ~(d0[w] | vp[w]))
            hn.append(d0[w] & vp[w])
        step = 1 - (d0[-1] >> np.uint64(63)).astype(np.int64)
        if i >= first_turn[m - 1]:
            place = bits - 2 - (i - turn[:m])
            row, own = np.flatnonzero(place <= bits - 2), place >> 6
            for w in range(words):
                r = row[own[row] == w]
                to = (place[r] & 63).astype(np.uint64)
                step[r] = ((hp[w][r] >> to) & one).astype(np.int64) - ((hn[w][r] >> to) & one).astype(np.int64)
        score[:m] += step
        for w in range(words):
            down = d0[w] >> one
            if w + 1 < words:
                down |= d0[w + 1] << np.uint64(63)
            vp[w] = hn[w] | ~(down | hp[w])
            vn[w] = down & hp[w]
    out = np.empty(n, bool)
    out[order] = score <= most
    return out


def _alone(a: list[int], b: list[int], most: int) -> bool:
    """_banded() of one pair, whose band is one long integer."""
    bits = 2 * most + 1
    full, last = (1 << bits) - 1, bits - 1
    places = {c: bytearray((len(a) + bits) // 8 + 1) for c in set(a)}
    for k, c in enumerate(a):
        at = k + bits - 1 - most
        places[c][at >> 3] |= 1 << (at & 7)
    table = {c: int.from_bytes(v, "little") for c, v in places.items()}
    vp, vn, score, turn = full ^ ((1 << (bits - 1 - most)) - 1), 0, most, len(a) - most
    # As the last row ends the score falls by one a column at most.
    over = 2 * most + len(b) - len(a)
    for i, c in enumerate(b):
        x = (table.get(c, 0) >> i) & full
        d0 = ((((x & vp) + vp) & full) ^ vp) | x | vn
        hp, hn = vn | (full ^ (d0 | vp)), d0 & vp
        if i < turn:
            score += not d0 >> last
            if score > over:
                return False
        else:
            to = bits - 2 - (i - turn)
            score += (hp >> to & 1) - (hn >> to & 1)
        down = d0 >> 1
        vp, vn = hn | (full ^ (down | hp)), down & hp
    return score <= most


def gathered(batches, least: int = 1 << 23):
    """The batches, small ones put together to some least bytes, as within() is faster on many pairs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def within(x: pa.Array, y: pa.Array, most: np.ndarray) -> np.ndarray:
    """For each pair of texts, whether their Levenshtein distance in characters is at most most."""
    out = np.zeros(len(x), bool)
    if not len(x):
        return out
    code, start, length = _codes(pa.concat_arrays([x.cast(pa.large_string()), y.cast(pa.large_string())]))
    n = len(x)
    a, b, la, lb = start[:n].copy(), start[n:].copy(), length[:n].copy(), length[n:].copy()
    runs = _Runs(code)
    # What both begin with costs nothing, and neither does what both end with.
    front = runs.forward(a, b, np.minimum(la, lb))
    a, b, la, lb = a + front, b + front, la - front, lb - front
    back = _Runs(code[::-1].copy())
    flip = len(code)
    tail = back.forward(flip - a - la, flip - b - lb, np.minimum(la, lb))
    la, lb = la - tail, lb - tail
    most = np.asarray(most, np.int64)
    out[np.maximum(la, lb) <= most] = True
    rest = np.flatnonzero(~out & (np.abs(la - lb) <= most) & (np.minimum(la, lb) > 0))
    swap = la < lb
    a, b, la, lb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, lb, la), np.where(swap, la, lb)
    words = (2 * most + 1 + 63) // 64
    kinds, ids = _numbered(code)
    narrow = rest[words[rest] <= BAND]
    narrow = narrow[np.lexsort((la[narrow], words[narrow]))]
    lo, few = 0, []
    while lo < len(narrow):
        w, longest = int(words[narrow[lo]]), la[narrow[lo : lo + PAIRS]]
        fit = np.searchsorted(((longest + 128 * w) // 64 + 2) * np.arange(1, len(longest) + 1) * kinds, TABLE, "right")
        hi = min(lo + max(1, int(fit)), lo + int(np.searchsorted(words[narrow[lo : lo + PAIRS]], w, "right")))
        p = narrow[lo:hi]
        # A column costs some calls however few pairs it has.
        if len(p) * int(most[p[-1]]) ** 2 >= FEW * w * int(la[p[-1]]):
            out[p] = _banded(ids, kinds, a[p], la[p], b[p], lb[p], most[p], w)
        else:
            few.append(p)
        lo = hi
    wide = rest[words[rest] > BAND]
    near = np.minimum(most, np.where(words > BAND, NEAR, most))
    rest = np.concatenate([wide, *few])
    rest = rest[np.argsort(near[rest], kind="stable")]
    lo = 0
    while lo < len(rest):
        widths = 2 * near[rest[lo:]] + 3
        hi = lo + max(1, int(np.searchsorted(np.arange(1, len(widths) + 1) * widths, CELLS, "right")))
        p = rest[lo:hi]
        out[p] = _batch(runs, a[p], la[p], b[p], lb[p], near[p])
        lo = hi
    for k in wide[~out[wide]]:
        out[k] = _alone(code[a[k] : a[k] + la[k]].tolist(), code[b[k] : b[k] + lb[k]].tolist(), int(most[k]))
    return out
