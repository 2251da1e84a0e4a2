"""Word shingles as sorted arrays of 64-bit hashes, made with numpy over many texts at once.

Words are runs of bytes other than space and \\t..\\r after lowering A-Z. A text with fewer words than a shingle has one shingle, the
whole sequence; a text without words has none. A word's hash chains its bytes, eight at a time, through a mixing bijection (words beyond ``CHAINED``
bytes: blake2b), so words that differ by a rule, as letter patterns do, collide no likelier than by chance, 2**-64 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
CHAINED = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin (one more entry than texts)."""
    joined = b" " + b" ".join(raws).lower() + b" "
    data = np.frombuffer(joined + bytes(8), np.uint8)
    ends_of_texts = np.cumsum([len(x) + 1 for x in raws], dtype=np.int64)
    space = _SPACE[data[:-8]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    loads = np.ndarray(len(joined), "<u8", data, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _MULTIPLIERS[7] + U(1))
    live = np.flatnonzero(left <= CHAINED)
    at, left = starts[live], left[live]
    while len(live):
        h[live] = mix(h[live] ^ (loads[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(ends - starts > CHAINED).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h, np.concatenate([[0], np.searchsorted(starts, ends_of_texts, "left")])


def shingle_sets(raws: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    if words > len(_MULTIPLIERS) - 1:
        raise ValueError("too many words to a shingle")
    h, at = word_hashes(raws)
    n = len(h)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        rolled += h[k : k + len(rolled)] * _MULTIPLIERS[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _MULTIPLIERS[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
