"""Word shingles and BagMinHash signatures, vectorised over many texts at once.

A text is the multiset of its runs of SHINGLE words (lower case, letters, digits and underscores; a
text with fewer words is one run). Register i of a signature is the first point of a Poisson process
over the multiset's units of weight; two signatures agree in a register with the weighted Jaccard
similarity as probability. Weight is cut into octaves, [0,1), [1,2), [2,4), [4,8) ..., each with one
process of its width as rate; a point's place within its octave is that many of its further bits, for
widths are powers of two, and counts only where it is below the weight. So an element of weight w needs about log(w)
processes, and equal elements of different weight share all points below the smaller weight.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

SHINGLE = 5
GAP, ODD = re.compile(r"\W+"), re.compile(r"[^\w\x00-\x7f]")
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
MASK = (1 << 64) - 1
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that scatters them."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * BASE)
ORDER = mix(np.arange(1, SHINGLE + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
_inverse = pow(int(BASE), -1, 1 << 64)
_powers: list[np.ndarray] = []


#: Of each byte, whether it is in no word: of ASCII all but letters, digits and the underscore.
BETWEEN = np.array([i < 128 and not (chr(i).isalnum() or i == 95) for i in range(256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (BASE, U(_inverse))]
    return _powers[0][:n], _powers[1][:n]


def lowered(text: str) -> bytes:
    """Lower case; characters beyond ASCII that are in no word become blanks."""
    low = text.lower()
    return (GAP.sub(" ", low) if ODD.search(low) else low).encode()


def word_hashes(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a lowered text."""
    b = np.frombuffer(plain, np.uint8)
    if not len(b):
        return np.empty(0, U), np.empty(0, np.int64)
    gap = np.concatenate([[True], BETWEEN[b], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    first, last = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[b] * up[:-1])])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(U)), first


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle hashes of all texts, one after the other, how many each has, and a key of each's words."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held, size, who = [], 0, []

    def flush() -> None:
        nonlocal held, size, who
        if held:
            h, first = word_hashes(b"\n".join(held))
            starts = np.cumsum([0] + [len(x) + 1 for x in held])
            at = np.searchsorted(first, starts)
            for k, a, b in zip(who, at[:-1], at[1:]):
                hashes.append((k, h[a:b]))
            held, size, who = [], 0, []

    for k, text in enumerate(texts):
        raw = lowered(text)
        while len(raw) > SEGMENT:  # at a gap, if there is one
            cut = raw.rfind(b" ", 0, SEGMENT)
            cut = cut if cut > 0 else (raw.find(b" ") if b" " in raw else len(raw))
            flush()
            held, who = [raw[:cut]], [k]
            flush()
            raw = raw[cut + 1 :]
        held.append(raw)
        who.append(k)
        size += len(raw) + 1
        if size > SEGMENT:
            flush()
    flush()
    if not hashes:
        return np.empty(0, U), counts, [_key(np.empty(0, U))] * len(texts)
    words = np.concatenate([h for _, h in hashes])
    n = np.bincount([k for k, _ in hashes], weights=[len(h) for _, h in hashes], minlength=len(texts)).astype(np.int64)
    out = np.zeros(len(words), U)
    for j in range(SHINGLE):
        out[: len(words) - j] += words[j:] * ORDER[j]
    ends = np.cumsum(n)
    where = np.arange(len(words))
    room = np.repeat(ends, n) - where  # words from here to the text's end
    short = n < SHINGLE
    keep = room >= SHINGLE
    for k in np.flatnonzero(short & (n > 0)):
        at = ends[k] - n[k]
        with np.errstate(over="ignore"):
            out[at] = (words[at : ends[k]] * ORDER[: n[k]]).sum() + U(n[k])
        keep[at] = True
    keys = [_key(words[b - c : b]) for b, c in zip(ends, n)]
    return mix(out[keep]), np.where(short, np.minimum(n, 1), n - SHINGLE + 1), keys


def _key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def multisets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element, weight and owner of the multisets."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), o[at]


def signatures(hashes: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """len(counts) x m registers of 32 bits; a text without shingles has zeros."""
    out = np.full(len(counts) * m, np.inf)
    element, weight, owner = multisets(hashes, counts)
    seeds, widths, tops, owners = [], [], [], []
    octave, low = 0, 0  # octave covers [low, low + width)
    while len(element):
        width = max(1, low)
        seeds.append(mix(element + U((octave + 1) * int(BASE) & MASK)))
        widths.append(np.full(len(element), width))
        tops.append(weight - low)  # a point counts below it
        owners.append(owner)
        octave, low = octave + 1, low + width
        more = weight > low
        element, weight, owner = element[more], weight[more], owner[more]
    seed, width, top, own = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (seeds, widths, tops, owners))
    time, nth = np.zeros(len(seed)), np.zeros(len(seed), U)
    point = np.zeros(len(seed), U)
    bound = m * (np.log(m) + 2.0) / np.maximum(counts, 1)

    def advance(k: np.ndarray) -> None:
        nth[k] += U(1)
        p = mix(seed[k] + nth[k] * BASE)
        point[k] = p
        time[k] += -np.log(((p >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) / width[k]

    live = np.arange(len(seed))
    if len(live):
        advance(live)
    while len(live):
        due = live[time[live] <= bound[own[live]]]
        while len(due):
            p = mix(point[due] ^ MIX2)
            place = (p >> U(32)).astype(np.int64) % width[due]
            hit = place < top[due]
            np.minimum.at(out, (own[due] * m + (p & U(0xFFFFFFFF)).astype(np.int64) % m)[hit], time[due][hit])
            advance(due)
            due = due[time[due] <= bound[own[due]]]
        open_ = np.isinf(out.reshape(len(counts), m)).any(axis=1)
        live = live[open_[own[live]]]
        bound[open_] *= 1.5
    out[np.isinf(out)] = 0.0
    return (mix(out.view(U)) >> U(32)).astype(np.uint32).reshape(len(counts), m)


def bands(registers: np.ndarray, n: int, rows: int) -> np.ndarray:
    """n bucket keys of rows registers each."""
    part = registers[:, : n * rows].reshape(len(registers), n, rows).astype(U)
    key = np.tile(np.arange(1, n + 1, dtype=U) * BASE, (len(registers), 1))
    for j in range(rows):
        key = mix(key ^ part[:, :, j] * ORDER[j % SHINGLE])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets (sorted elements, weights); 1 of two empty ones."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 1.0


def multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles([text])[0], return_counts=True)
