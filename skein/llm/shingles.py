"""Word shingles of whole texts, hashed or exact, for many documents at once in numpy.

Words are runs of anything but the white space \\x20 and \\x09-\\x0D, with A-Z in lower case. A document's set holds its
distinct n-word shingles; with fewer words, the whole sequence as one; without words it is empty. Hashes are 64 bits of
keyed BLAKE2b of each word, mixed over the words of a shingle; codes are numbers that stand for a shingle's very words,
good for the texts they were made of together.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_KEY = b"skein word shingles"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _ODD[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _ODD[1]
    return x ^ (x >> np.uint64(31))


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the place of every word in order among them, and the index of each document's first word."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat = lists.flatten()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # none before and after white space
    if not real.all():
        at = np.concatenate([[0], np.cumsum(real)])[at]
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each document's first word (one more entry at the end)."""
    known, codes, at = word_codes(texts)
    own = b"".join([blake2b(w.encode(), digest_size=8, key=_KEY).digest() for w in known.to_pylist()])
    return np.frombuffer(own, "<u8").astype(np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64), at


def exact_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document as codes, ascending, and where each document's begin (one more entry at the end).

    Two codes are equal if and only if the words are: each step numbers the pairs of what the last step numbered and the
    next word.
    """
    known, w, at = word_codes(texts)
    count = np.diff(at)
    roll = w
    for k in range(1, n):
        roll = np.unique(roll[: max(len(w) - k, 0)] * max(len(known), 1) + w[k:], return_inverse=True)[1]
    short: dict[tuple, int] = {}
    parts = []
    for d in range(len(count)):
        if count[d] >= n:
            parts.append(np.unique(roll[at[d] : at[d + 1] - n + 1]))
        elif count[d]:
            parts.append(np.array([-1 - short.setdefault(tuple(w[at[d] : at[d + 1]].tolist()), len(short))], np.int64))
        else:
            parts.append(np.zeros(0, np.int64))
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each document, and where each document's begin (one more entry at the end)."""
    h, at = words(texts)
    count = np.diff(at)
    docs = len(count)
    sizes = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], np.uint64)
    if len(h) >= n:
        last = len(h) - n + 1
        roll = np.zeros(last, np.uint64)
        for k in range(n):
            roll += _ODD[k % len(_ODD)] * (h[k : k + last] ^ np.uint64(k + 1))
        roll = mix(roll)
    for d in range(docs):
        a, b, w = bounds[d], bounds[d + 1], at[d]
        if count[d] >= n:
            out[a:b] = roll[w : w + b - a]
            out[a:b].sort()
        elif b > a:
            whole = np.array([count[d]], np.uint64)
            for x in h[w : at[d + 1]]:
                whole = mix(whole * _ODD[4] + x)
            out[a] = whole[0]
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[bounds]
