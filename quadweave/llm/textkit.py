"""Vectorised word hashing over batches of texts (numpy, no per-word Python).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after folding
A-Z to a-z.  A word's hash is a polynomial in an odd base modulo 2**64 over
random byte values, finalised by an avalanche step, so equal words have equal
hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C13 | 1
_U = np.uint64
_WHITE = b" \t\n\v\f\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (a bijection); overwrites its argument."""
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
    values[65:91] = values[97:123]
    white = np.zeros(256, bool)
    white[list(_WHITE)] = True
    values[white] = 0
    with np.errstate(over="ignore"):
        power = np.full(CHUNK + 2, _BASE, _U)
        power[0] = 1
        power = np.cumprod(power)
        inverse = np.full(CHUNK + 2, pow(_BASE, -1, 1 << 64), _U)
        inverse[0] = 1
        inverse = np.cumprod(inverse)
    return values, white, power, inverse


_TABLES: list = []


def _chunk(buffer: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of at most CHUNK bytes.

    With ``prefixes``, a row of hashes per word: the word's, then those of its
    first so many bytes, 0 where it has no more.
    """
    if not _TABLES:
        _TABLES.extend(_tables())
    values, white, power, inverse = _TABLES
    raw = np.frombuffer(buffer, np.uint8)
    edge = np.ones(len(raw) + 2, bool)
    edge[1:-1] = white[raw]
    change = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = change[::2], change[1::2]
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(values[raw] * power[: len(raw)], out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    hashes += (ends - starts).astype(_U) * _U(0x8EBC6AF09C88C6E3)
    hashes = mix(hashes)
    if not prefixes:
        return hashes, starts, ends
    rows = np.zeros((len(starts), 1 + len(prefixes)), _U)
    rows[:, 0] = hashes
    for k, size in enumerate(prefixes, 1):
        longer = np.flatnonzero(ends - starts > size)
        at = starts[longer]
        rows[longer, k] = mix((total[at + size] - total[at]) * inverse[at] + _U(size * 0x632BE59BD9B4E019 % (1 << 64)))
    return rows, starts, ends


def _long_word(word: bytes) -> int:
    """The same hash for one word longer than CHUNK, block by block."""
    if not _TABLES:
        _TABLES.extend(_tables())
    values, _, power, _ = _TABLES
    total, scale = 0, 1
    for lo in range(0, len(word), CHUNK):
        part = np.frombuffer(word[lo : lo + CHUNK], np.uint8)
        total += scale * int((values[part] * power[: len(part)]).sum(dtype=_U))
        scale = scale * pow(_BASE, CHUNK, 1 << 64) % (1 << 64)
    total += len(word) * 0x8EBC6AF09C88C6E3
    return int(mix(np.array([total % (1 << 64)], _U))[0])


def _pieces(text: bytes) -> Iterable[bytes]:
    """Parts of at most CHUNK bytes that end at white space, or one whole longer word."""
    lo = 0
    while len(text) - lo > CHUNK:
        cut = max(text.rfind(c, lo, lo + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if cut <= lo:
            after = [p for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (p := text.find(c, lo + 1)) > 0]
            cut = min(after, default=len(text))
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def hashed_words(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and offsets of each text's words (n + 1).

    Empty texts have no words.  Memory is a few times the words' 8 bytes.  With
    ``prefixes``, rows as ``_chunk`` gives them.
    """
    shape = (0, 1 + len(prefixes)) if prefixes else (0,)
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(texts):
            if len(texts[i]) >= CHUNK:
                for part in _pieces(texts[i]):
                    if len(part) > CHUNK:
                        head = part.lstrip(_WHITE)
                        if len(head) <= CHUNK:
                            words = _chunk(head, prefixes)[0]
                        elif prefixes:
                            words = _chunk(head[:CHUNK], prefixes)[0]
                            words[0, 0] = _long_word(head)
                        else:
                            words = np.array([_long_word(head)], _U)
                    else:
                        words = _chunk(part, prefixes)[0]
                    found.append(words)
                    counts[i + 1] += len(words)
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and size + len(texts[j]) + 1 <= CHUNK:
                size += len(texts[j]) + 1
                j += 1
            j = max(j, i + 1)
            joined = b" ".join(texts[i:j])
            hashes, starts, _ = _chunk(joined, prefixes)
            bounds = np.cumsum([len(t) + 1 for t in texts[i:j]])
            at = np.searchsorted(starts, bounds)
            counts[i + 1 : j + 1] = np.diff(at, prepend=0)
            found.append(hashes)
            i = j
    return (np.concatenate(found) if found else np.zeros(shape, _U)), np.cumsum(counts)


def as_bytes(values: Iterable[str | None]) -> list[bytes]:
    """UTF-8 bytes of each value; null becomes empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]
