"""Array code over the bytes of an Arrow string column.

Words are found and hashed with NumPy on the UTF-8 bytes of a whole batch, in
blocks of bounded size, so that no Python object is made per word.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Ranges of more bytes are hashed one by one.
LONG = 512
#: The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_S33, _S32 = np.uint64(33), np.uint64(32)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: the six ASCII white spaces.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII digits and lower-case letters, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, modulo 2**64, up to ``n``."""
    size = max(BLOCK, 1 << int(n).bit_length())
    if size not in _TABLES:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        made = []
        for base in (_BASE, inverse):
            steps = np.full(size + 1, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _TABLES.clear()
        _TABLES[size] = tuple(made)
    return _TABLES[size]


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any byte range follows; see :func:`range_hash`."""
    power, inverse = powers(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    return sums, inverse


def byte_hash(part: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: features, and candidates for equal words.

    Eight bytes at a time enter a state that is mixed after each, so there is
    no arithmetic between the bytes of a range that structured texts could
    cancel; ranges of over LONG bytes take BLAKE2. With a seed that is known,
    equal hashes can be made; what must be the same text is compared by bytes
    or by :func:`byte_digest`.
    """
    size = end - start
    eight = eights(part)
    h = mix(size.astype(np.uint64) * _BASE + np.uint64(seed))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    done = 0
    while len(live):
        block = eight[start[live] + done] & _FIRST[np.minimum(size[live] - done, 8)]
        h[live] = mix((h[live] ^ block) * _BASE + np.uint64(seed))
        done += 8
        live = live[size[live] > done]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(part[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def byte_digest(part: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of byte ranges, in two halves, by which texts count as equal.

    The halves feed each other with each eight bytes, and both begin with
    ``key``, drawn for each run, so equal digests can't be made beforehand.
    Ranges of over LONG bytes take BLAKE2.
    """
    size = end - start
    held = eights(part)
    seed, other = np.uint64(key), mix(np.array([key], np.uint64) + _M1)[0]
    h = mix(size.astype(np.uint64) * _BASE + seed)
    g = mix(h ^ other)
    live, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        block = held[start[live] + done] & _FIRST[np.minimum(size[live] - done, 8)]
        one = mix((h[live] ^ block) * _BASE + g[live])
        g[live] = mix((g[live] + (block << _S32 | block >> _S32)) * _M2 ^ one)
        h[live] = one
        done += 8
        live = live[size[live] > done]
    named = key.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG):
        both = hashlib.blake2b(part[start[i] : end[i]].tobytes(), digest_size=16, key=named).digest()
        h[i], g[i] = (int.from_bytes(x, "little") for x in (both[:8], both[8:]))
    return h, g


def new_key() -> int:
    """A key for one run's digests."""
    return secrets.randbits(63)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end."""
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def same_bytes(x: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray, y_start: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """Whether each range of bytes is equal to another; ``x`` and ``y`` are the :func:`eights` of what holds them."""
    size = end - start
    same = size == y_end - y_start
    live, done = np.flatnonzero(same & (size > 0)), 0
    while len(live):
        mask = _FIRST[np.minimum(size[live] - done, 8)]
        good = (x[start[live] + done] ^ y[y_start[live] + done]) & mask == 0
        same[live[~good]] = False
        done += 8
        live = live[good & (size[live] > done)]
    return same


def range_hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of any ranges from prefix sums; texts can be made that collide, so equal ones are only candidates."""
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def blocks(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that cut neither a word nor, where one fits, a text."""
    at, total = 0, len(buf)
    while at < total:
        end = min(total, at + size)
        if end < total:
            k = int(np.searchsorted(offsets, end, side="right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                gaps = np.flatnonzero(~inside[buf[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    stop = int(offsets[k + 1])
                    more = np.flatnonzero(~inside[buf[end:stop]])
                    end = end + int(more[0]) if len(more) else stop
        yield at, end
        at = end


def ranges(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block with words: where ``part`` begins in ``buf``, the words' starts and ends in ``part``, and ``part``."""
    for at, end in blocks(buf, offsets, inside if not lower else inside[LOWER]):
        part = LOWER[buf[at:end]] if lower else buf[at:end]
        is_in = inside[part]
        first = np.zeros(end - at + 1, dtype=bool)
        cuts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, side="right")] - at
        first[cuts] = True
        starts = is_in.copy()
        starts[1:] &= ~is_in[:-1] | first[1:-1]
        ends = is_in
        ends[:-1] &= ~is_in[1:] | first[1:-1] if len(ends) > 1 else True
        start, stop = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        if len(start):
            yield at, start, stop, part


def words(
    buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: word hashes, the texts' numbers, starts and ends in ``part``, and ``part``."""
    for at, start, stop, part in ranges(buf, offsets, inside, lower):
        yield byte_hash(part, start, stop), np.searchsorted(offsets, start + at, side="right") - 1, start, stop, part


class Words:
    """All words of some texts, A-Z lower-cased: hashes, where each text's words begin, and the bytes of each.

    With a ``key`` there are second hashes, which nobody who doesn't know it can make equal.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, key: int | None = None):
        held = [(byte_hash(part, a, b), byte_hash(part, a, b, key) if key is not None else None, a + at, b + at) for at, a, b, part in ranges(buf, offsets, inside)]
        joined = lambda k, kind: np.concatenate([h[k] for h in held]) if held else np.zeros(0, kind)
        self.hashes, self.start, self.end = joined(0, np.uint64), joined(2, np.int64), joined(3, np.int64)
        self.second = joined(1, np.uint64) if key is not None else None
        self.begin = np.searchsorted(self.start, offsets)
        self.begin[-1] = len(self.start)
        self.buf, self._eights = buf, None

    @property
    def eights(self) -> np.ndarray:
        if self._eights is None:
            self._eights = eights(LOWER[self.buf])
        return self._eights

    def ids(self) -> np.ndarray:
        """Numbers of the words: those of two words are equal if, and only if, their bytes are."""
        _, first, ids = np.unique(self.hashes, return_index=True, return_inverse=True)
        like = first[ids]
        if same_bytes(self.eights, self.start, self.end, self.eights, self.start[like], self.end[like]).all():
            return ids
        low, seen = LOWER[self.buf].tobytes(), {}
        return np.array([seen.setdefault(low[a:b], len(seen)) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)])


class Terms:
    """Finds some terms among words: by hash, then byte by byte."""

    def __init__(self, terms: list[bytes]):
        sizes = np.array([len(t) for t in terms], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])[: len(terms)].astype(np.int64)
        self.end = self.start + sizes
        held = np.frombuffer(b"".join(terms), np.uint8)
        self.eights, self.own = eights(held), byte_hash(held, self.start, self.end)
        self.order = np.argsort(self.own, kind="stable")
        self.hashes = self.own[self.order]
        self.alike = int(np.unique(self.hashes, return_counts=True)[1].max()) if terms else 0

    def find(self, h: np.ndarray, held: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1; ``held`` are the :func:`eights` of the bytes that hold the words."""
        out = np.full(len(h), -1)
        at = np.searchsorted(self.hashes, h)
        for k in range(self.alike):
            place = np.minimum(at + k, len(self.hashes) - 1)
            some = np.flatnonzero((self.hashes[place] == h) & (at + k < len(self.hashes)) & (out < 0))
            term = self.order[place[some]]
            same = same_bytes(held, start[some], end[some], self.eights, self.start[term], self.end[term])
            out[some[same]] = term[same]
        return out


def all_words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin."""
    n = len(offsets) - 1
    hashes, counts = [], np.zeros(n, dtype=np.int64)
    for h, doc, *_ in words(buf, offsets, inside, lower):
        hashes.append(h)
        counts += np.bincount(doc, minlength=n)
    begin = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(counts, out=begin[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), begin


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``size`` bytes each."""
    _, offsets = column_bytes(column)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end
