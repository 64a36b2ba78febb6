"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view("<u8").ravel()


_LONG = 256


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: its eight-byte parts go through mix one after another.

    No sum or polynomial of the bytes is involved, so texts built to collide in one do not collide here. Spans of over
    256 bytes are hashed with BLAKE2b.
    """
    size = end - start
    out = mix(size.astype(np.uint64) + U(0xD6E8FEB86659FD93))
    short = np.flatnonzero((size <= _LONG) & (size > 0))
    order = short[np.argsort(-size[short], kind="stable")]
    left = size[order]
    for at in range(0, int(left[0]) if len(order) else 0, 8):
        live = order[: np.searchsorted(-left, -at, "left")]  # those of more than `at` bytes
        from_ = start[live] + at
        part = _gathered(data, from_)
        cut = np.minimum(size[live] - at, 8)
        keep = np.where(cut == 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (np.minimum(cut, 7) * 8).astype(np.uint64)) - U(1))
        out[live] = mix((out[live] ^ (part & keep)) * U(_P) + U(0xA0761D6478BD642F))
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _gathered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each given place; data must go on for eight bytes."""
    whole = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))
    return np.ascontiguousarray(whole[at]).view("<u8").ravel()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) of all texts, and the text it is from."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n" * 9, np.uint8)]
    first = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    start, end = edge[::2], edge[1::2]
    return span_hashes(data, start, end), np.searchsorted(first, start, "right") - 1


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words of each text (with fewer words, the whole sequence as one), sorted, end to end;
    and how many each text has."""
    word, doc = word_hashes([t or "" for t in texts])
    n = len(texts)
    per = np.bincount(doc, minlength=n)
    at = np.cumsum(per) - per
    m = max(0, len(word) - k + 1)
    same = doc[:m] == doc[k - 1 :] if m else np.zeros(0, bool)
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h = mix(h * U(_P) + word[j : j + m])
    own, h = doc[:m][same], h[same]
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        extra = []
        for d in short:
            x = np.array([per[d]], np.uint64)
            for w in word[at[d] : at[d] + per[d]]:
                x = mix(x * U(_P) + w)
            extra.append(x[0])
        own, h = np.concatenate([own, short]), np.concatenate([h, np.array(extra, np.uint64)])
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, bool)
    own, h = own[fresh], h[fresh]
    return h, np.bincount(own, minlength=n)
