"""Suffix-array dedup: every byte is found that a string of ``length`` bytes covers which also starts anywhere else.

1. Equal texts become one text with a multiplicity. Texts are stored bucketed by their 128-bit key, so later joins with
   them move no text.
2. Of the hashes of all GRAM-byte strings in a stretch of ``length`` bytes, the least ones are its anchors; equal stretches
   have equal anchors at equal places. Only anchors whose fingerprint stands at two places or more can lie in repeated strings.
3. All places of a fingerprint share a home: the cell (CELLS) in which the least of its places stands. Neighbouring
   anchors of one text with one home are one segment, so a stretch is compared once, not once for each of its anchors. All
   segments of a home go to one block. A block's suffixes are sorted and its Burrows-Wheeler transform read off;
   breadth-first backward extension of intervals then derives the common prefixes of neighbouring suffixes in increasing
   order and stops at ``length``: whatever has got no value by then agrees in that many bytes. A run counts as repeated if
   it holds two different places, or one of a text with a multiplicity.
4. A home's size is bounded, for a fingerprint of too many places goes another way to the same blocks: its windows are
   collapsed first (equal ones become one with a multiplicity); the starts of their strings are cut into ranges, and windows
   are blocked by the core that all strings of a range hold. There the core is one symbol, and only what stands around it is
   sorted and extended. A core with more around it than a block takes has its range cut finer (RANGES) until equal strings
   are collapsed to one with a multiplicity. So a passage in a third of all documents fills no block and no task.

Defined edge cases: null and empty texts have no bytes and keep none; texts shorter than ``length`` keep all; repeated rows
repeat each other and lose whatever is long enough; an empty table gives an empty table; further columns are passed on
whatever their names, but for those that the result adds, whose old values go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITS, Scratch, bits_of, passing, written

GRAM = 100
#: Bytes of a home's cell by the most places of a fingerprint that may be in it. More places than any: the fingerprint is hot.
CELLS = ((128, 4096), (1024, 512))
#: Bytes around a core, of all its kinds of windows, that go to one block.
AROUND = 1 << 20
#: Bytes of a block, at least unless there are no more.
BLOCK = 1 << 19
#: Starts in a range of the hot windows' strings, cut finer step by step.
RANGES = (101, 17, 1)
#: Texts are hashed in parts of so many bytes; longer ones in overlapping parts.
PART = 1 << 15
#: Windows that a worker remembers having sent.
REMEMBERED = 200_000
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(77).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base to the 0 .. n - 1, modulo 2 to the 64."""
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base % (1 << 64), np.uint64))))


_UP, _DOWN = _powers(_BASE, PART + 4096), _powers(pow(_BASE, -1, 1 << 64), PART + 4096)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes from each place on; only of places with as many bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[:n], out=sums[1:])
    return _stirred((sums[gram:] - sums[: n + 1 - gram]) * _DOWN[: n + 1 - gram])


def _sliding(x: np.ndarray, width: int, f, ahead: bool) -> np.ndarray:
    """f over x[i : i + width], or over x[i - width + 1 : i + 1]; shorter at the ends."""
    out, other, n = x.copy(), np.empty_like(x), 1
    while n < width and n < len(x):
        by = min(n, width - n)
        if ahead:
            f(out[:-by], out[by:], out=other[:-by])
            other[-by:] = out[-by:]
        else:
            f(out[by:], out[:-by], out=other[by:])
            other[:by] = out[:by]
        out, other = other, out
        n += by
    return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of texts data[start:end], none longer than PART, and their fingerprints."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data, GRAM)
    short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # never 0; what is equal here is an anchor too
    width = length - GRAM + 1
    least = _sliding(short, width, np.minimum, True)
    valid = np.zeros(len(h) + 1, np.int32)
    long_enough = ends - starts >= length
    np.add.at(valid, starts[long_enough], 1)
    np.add.at(valid, ends[long_enough] - length + 1, -1)
    least[np.cumsum(valid)[:-1] == 0] = 0
    at = np.flatnonzero(_sliding(least, width, np.maximum, False) == short)
    return at, h[at].view(np.int64)


def parts(offsets: np.ndarray, length: int):
    """(first row, row's first place, starts, ends) of the parts of a buffer with these row offsets.

    Whole rows are joined up to PART bytes. A longer row comes in parts that overlap, so that each string is in one.
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        size = offsets[row + 1] - offsets[row]
        if size > PART:
            for at in range(0, size - length + 1, PART - length + 1):
                s = offsets[row] + at
                yield row, at, np.array([s]), np.array([min(offsets[row + 1], s + PART)])
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, "right")) - 1)
        yield row, 0, offsets[row:last], offsets[row + 1 : last + 1]
        row = last


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and its rows' offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(fp, a, b, pos, m) of all anchors."""

    def each(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column("bytes"))
            own = [batch.column(c).to_numpy() for c in ("a", "b", "m")]
            for first, ahead, starts, ends in parts(offsets, length):
                at, fps = anchors(data[starts[0] : ends[-1]], starts - starts[0], ends - starts[0], length)
                row = np.searchsorted(ends - starts[0], at, "right")
                pos = at - (starts[row] - starts[0]) + ahead
                a, b, m = (x[first + row] for x in own)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fps, a, b, pos.astype(np.int32), m)], names=["fp", "a", "b", "pos", "m"])

    return texts.select("a", "b", "m", "bytes").mapInArrow(each, "fp long, a long, b long, pos int, m long")


def segments(at: np.ndarray, home: np.ndarray, size: int, length: int) -> list[tuple[int, int, int]]:
    """(home, start, end): neighbouring anchors of one home whose windows touch, in a text of size bytes; at ascends."""
    if not len(at):
        return []
    lo, hi = np.maximum(at - (length - GRAM), 0), np.minimum(at + length, size)
    new = np.flatnonzero(np.concatenate(([True], (home[1:] != home[:-1]) | (lo[1:] > hi[:-1]))))
    return list(zip(home[new].tolist(), lo[new].tolist(), hi[np.append(new[1:], len(at)) - 1].tolist(), strict=True))


PIECES = "kind int, key long, wh long, a long, b long, at int, before int, m long, bytes binary"


def piece_rows(told: DataFrame, length: int) -> DataFrame:
    """Rows of three kinds for texts with their shared places (a, b, m, bytes, places).

    0: a segment of home ``key``, from ``at`` on. 1: a window of the hot fingerprint ``key``, told by the hash ``wh``, as
    often as tasks have one. 2: a place of such a window, whose anchor is ``at``.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def each(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            weight = 0
            held = batch.column("places")
            flat, cuts = held.flatten(), held.offsets.to_numpy() - held.offsets[0].as_py()
            pos, key, hot = flat.field("pos").to_numpy(), flat.field("key").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False)
            for k, (a, b, m, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "m")), batch.column("bytes"), strict=True)):
                mine = slice(cuts[k], cuts[k + 1])
                by = np.argsort(pos[mine], kind="stable")
                p, q, h = pos[mine][by].astype(np.int64), key[mine][by], hot[mine][by]
                raw = text.as_buffer().to_pybytes()
                for home, s, e in segments(p[~h], q[~h], len(raw), length):
                    out.append((0, home, 0, a, b, s, 0, m, raw[s:e]))
                    weight += e - s
                for at, fp in zip(p[h].tolist(), q[h].tolist(), strict=True):
                    s = max(0, at - (length - GRAM))
                    window = raw[s : at + length]
                    wh = xxhash.xxh3_64_intdigest(window, seed=at - s) - (1 << 63)
                    out.append((2, fp, wh, a, b, at, at - s, m, None))
                    if (fp, wh) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add((fp, wh))
                        out.append((1, fp, wh, a, b, at, at - s, m, window))
                        weight += len(window)
                if weight > 1 << 22 or len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, weight = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return told.select("a", "b", "m", "bytes", "places").mapInArrow(each, PIECES)


def _sorted_order(symbols: np.ndarray, depth: int, early: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes by at least their first depth symbols (all from 0 on), by prefix doubling; ties beyond stay in any order.

    Also, for some number of symbols that is early at most (or a first key's), which suffixes in order begin a new string.
    Keys are packed with the suffix, so that a plain sort gives the order.
    """
    n = len(symbols)
    bits = max(1, int(n).bit_length())
    each = max(1, int(symbols.max() + 1).bit_length())
    span = max(1, min((63 - bits) // each, early))
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= each
        key[: n - k] |= symbols[k:] + 1
    key <<= bits
    key |= np.arange(n)
    key.sort()
    order = key & ((1 << bits) - 1)
    key >>= bits
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    heads, at_span = new, span
    tied = ~(new & np.append(new[1:], True))
    fits = 3 * bits <= 63
    while span < depth and tied.any():
        slots = np.flatnonzero(tied)
        at = order[slots]
        after = at + span
        second = np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        if fits:
            pair = ((rank[at] << bits | second) << bits) | at
            pair.sort()
            at = pair & ((1 << bits) - 1)
            pair >>= bits
        else:
            by = np.lexsort((second, rank[at]))
            at, pair = at[by], rank[at][by] * (n + 2) + second[by]
        order[slots] = at
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = slots[new][np.cumsum(new) - 1] + 1
        new_at = slots[new]
        if 2 * span <= early:
            heads = heads.copy()
            heads[new_at] = True
            at_span = 2 * span
        tied = np.zeros(n, bool)
        tied[slots[~(new & np.append(new[1:], True))]] = True
        span *= 2
    return order, heads, at_span


def agreeing(symbols: np.ndarray, length: int, early: int = 1, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and for each rank whether that suffix and the one before agree in length symbols or more.

    Intervals of suffixes that begin with one string are extended backwards by all symbols before them, the shortest strings
    first. An interval's right border gets its value when it is first met; met again, the interval isn't followed. The
    first intervals are those of strings of early symbols at most, which the sort passes by: values below are all the same here.
    Suffixes are sorted by their first depth symbols, length at least, and come in any order beyond; without depth, wholly.
    """
    symbols = np.append(symbols.astype(np.int64) + 1, 0)  # an end that is like no other symbol
    n = len(symbols)
    order, heads, start = _sorted_order(symbols, n if depth is None else depth, min(early, length))
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    back = np.where(order > 0, symbols[order - 1], 0)  # the Burrows-Wheeler transform
    step = np.where(order > 0, inverse[order - 1], -1)
    bits, each = int(n).bit_length(), int(symbols.max() + 1).bit_length()
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo = np.flatnonzero(heads)
    hi = np.append(lo[1:], n)
    unset[hi] = False
    for _ in range(start, length):
        if not len(lo):
            break
        size = hi - lo
        one = size == 1
        single = step[lo[one]]
        single = single[single >= 0]
        left, right = [single], [single + 1]
        if not one.all():
            l, s = lo[~one], size[~one]
            first = np.cumsum(s) - s
            owner = np.repeat(np.arange(len(l)), s)
            at = np.arange(len(owner)) + np.repeat(l - first, s)
            to = step[at]
            if 2 * bits + each <= 63:
                key = ((owner << each | back[at]) << bits) | (to + (to < 0))
                key = key[to >= 0]
                key.sort()
                to = key & ((1 << bits) - 1)
                key >>= bits
            else:
                key = owner * (1 << each) + back[at]
                keep = np.flatnonzero(to >= 0)
                keep = keep[np.lexsort((to[keep], key[keep]))]
                key, to = key[keep], to[keep]
            if len(key):
                cut_at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                begin = to[cut_at]
                left.append(begin)
                right.append(begin + np.diff(np.append(cut_at, len(key))))
        lo, hi = np.concatenate(left), np.concatenate(right)
        new = unset[hi]
        lo, hi = lo[new], hi[new]
        unset[hi] = False
    unset[1] = False
    return order[1:], unset[1:n]


def repeated_spans(windows: list[tuple], length: int, wide: int | None = None) -> list[list[tuple[int, int]]]:
    """windows: (text's key, first place in the text, multiplicity, bytes[, core, cut]). The covered spans of each, counted from its first byte.

    With wide, what stands around a core: ``cut`` bytes before it, the others behind. All strings that start in the core's range
    hold the core, so it counts as one symbol, and a string is wide symbols long.
    """
    sizes = np.array([len(w[3]) + (wide is not None) for w in windows])
    first = np.cumsum(sizes + 1) - sizes - 1
    n = int(sizes.sum()) + len(windows)
    joined = np.zeros(n, np.int64)  # 0 separates
    window = np.repeat(np.arange(len(windows)), sizes + 1)
    inner = np.arange(n) - first[window]
    own_bytes = inner < sizes[window]
    if wide is not None:
        cores = first + np.array([w[5] for w in windows])
        own_bytes[cores] = False
    raw = np.frombuffer(b"".join(w[3] for w in windows), np.uint8)
    present = np.zeros(256, bool)
    present[raw] = True
    codes = np.cumsum(present)  # few bits for each symbol, in the bytes' order
    joined[own_bytes] = codes[raw]
    if wide is not None:
        number = {c: k for k, c in enumerate(dict.fromkeys(w[4] for w in windows))}
        joined[cores] = codes[-1] + 1 + np.array([number[w[4]] for w in windows])
    span = wide or length
    order, same = agreeing(joined, span, GRAM, span)
    own = {i: k for k, i in enumerate(dict.fromkeys(w[0] for w in windows))}
    place = np.array([(own[w[0]] << 36) + w[1] for w in windows], np.int64)[window] + inner
    heads = np.flatnonzero(~same)
    sorted_place = place[order]
    several = np.array([w[2] > 1 for w in windows])[window[order]]
    repeated = np.minimum.reduceat(sorted_place, heads) != np.maximum.reduceat(sorted_place, heads)
    repeated |= np.logical_or.reduceat(several, heads)
    hit = np.zeros(n, bool)
    hit[order] = np.repeat(repeated, np.diff(np.append(heads, n)))
    hit &= inner + span <= sizes[window]  # whole strings of one window
    out: list[list[tuple[int, int]]] = [[] for _ in windows]
    at = np.flatnonzero(hit)
    if len(at):
        new = np.concatenate(([True], (at[1:] > at[:-1] + length) | (window[at[1:]] != window[at[:-1]])))
        for a, b in zip(at[new].tolist(), at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)].tolist(), strict=True):
            k = int(window[a])
            out[k].append((int(a - first[k]), int(b - first[k]) + length))
    return out


def block_spans(pieces: DataFrame, length: int, wide: int | None = None) -> DataFrame:
    """(a, b, at, group, sub, s, e) of the repeated spans, counted from a piece's first byte, of rows (group, sub, a, b, at, m, bytes, cut).

    All pieces of a group go to one block; blocks hold whole groups up to a bounded size. ``at`` is the place of the first
    byte. With wide, groups are cores and pieces what stands around them, ``cut`` bytes before.
    """

    def done(block: list[tuple]) -> pa.RecordBatch:
        kinds: dict[tuple, list] = {}  # equal pieces are sorted once, with their places' number as multiplicity
        for w in block:
            key = w[6:] if wide is None else (w[6], w[0], w[7])
            if (own := kinds.get(key)) is None:
                kinds[key] = [w[2:5], w[5]]
            elif own[0] != w[2:5]:
                own[1] += w[5]
        found = repeated_spans([(place[:2], place[2], m, *key) for key, (place, m) in kinds.items()], length, wide)
        spans_of = dict(zip(kinds, found, strict=True))
        rows = [(w[2], w[3], w[4], w[0], w[1], s, e) for w in block for s, e in spans_of[w[6:] if wide is None else (w[6], w[0], w[7])]]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, types, strict=True)], names=["a", "b", "at", "group", "sub", "s", "e"])

    def each(batches):
        block: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for w in zip(*(batch.column(c).to_pylist() for c in ("group", "sub", "a", "b", "at", "m", "bytes", "cut")), strict=True):
                if size >= BLOCK and w[0] != last:
                    yield done(block)
                    block, size = [], 0
                block.append(w)
                size += len(w[6])
                last = w[0]
        if block:
            yield done(block)

    rows = pieces.select("group", "sub", "a", "b", "at", "m", "bytes", "cut")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as equal pieces take few bytes but much time
    return rows.repartition(spread, "group").sortWithinPartitions("group").mapInArrow(each, "a long, b long, at int, group long, sub long, s int, e int")


def _matrix(befores: list[int], texts: list[bytes], reach: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of the windows, aligned at their anchors in column reach, and each window's end column."""
    data = np.zeros((len(texts), reach + length), np.uint8)
    for k, (b, t) in enumerate(zip(befores, texts, strict=True)):
        data[k, reach - b : reach - b + len(t)] = np.frombuffer(t, np.uint8)
    out = np.zeros((reach + length + 1, len(texts)), np.uint64)
    for k in range(reach + length):
        out[k + 1] = out[k] * np.uint64(_BASE) + _TABLE[data[:, k]]
    return out, np.array([reach - b + len(t) for b, t in zip(befores, texts, strict=True)])


def _between(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of columns a to b of each window."""
    rows = np.arange(prefix.shape[1])
    return _stirred(prefix[b, rows] - prefix[a, rows] * _UP[b - a]).view(np.int64)


def _mixed(*parts_: np.ndarray) -> np.ndarray:
    """One hash of several."""
    out = np.zeros(len(parts_[0]), np.uint64)
    for p in parts_:
        out = (out ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def range_rows(windows: DataFrame, length: int, wide: int) -> DataFrame:
    """(fp, wh, c, u, v, core, sub, s, e) for the ranges u to v, wide each, of string starts lo to hi of each window.

    Starts count from the anchor. ``core`` is a hash of what all strings of the range hold, with the range and the
    fingerprint; ``sub`` of what any of the window's own strings in it covers, from s to e.
    """
    reach = length - GRAM

    def each(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                before = part.column("before").to_numpy().astype(np.int64)
                prefix, end = _matrix(before.tolist(), part.column("bytes").to_pylist(), reach, length)
                lo, hi = part.column("lo").to_numpy().astype(np.int64), part.column("hi").to_numpy().astype(np.int64)
                for step in range(-(-int((hi - lo).max() + 1) // wide)):
                    u = lo + step * wide
                    v = u + wide - 1
                    s, e = np.maximum(u, -before), np.minimum(v + length, end - reach)
                    ok = (u <= hi) & (e - s >= length)
                    if not ok.any():
                        continue
                    safe = lambda x: np.where(ok, x, 0) + reach  # noqa: B023, E731
                    core, sub = _between(prefix, safe(v), np.maximum(safe(u + length), safe(v))), _between(prefix, safe(s), safe(e))
                    core = _mixed(core, part.column("fp").to_numpy(), u * 4096 + v)
                    sub = _mixed(sub, core, s * 4096 + e)
                    at = np.flatnonzero(ok)
                    own = part.take(pa.array(at))
                    u, v, s, e = (pa.array(x[at].astype(np.int32)) for x in (u, v, s, e))
                    yield pa.RecordBatch.from_arrays([own.column("fp"), own.column("wh"), own.column("c"), u, v, pa.array(core[at]), pa.array(sub[at]), s, e], names=["fp", "wh", "c", "u", "v", "core", "sub", "s", "e"])

    return windows.mapInArrow(each, "fp long, wh long, c long, u int, v int, core long, sub long, s int, e int")


def window_spans(windows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(fp, wh, s, e): spans, counted from the anchor, of windows (fp, wh, c, a, b, at, before, bytes); c says how often each occurs.

    A core that occurs once holds no repeated string. Of the others, one window for each kind of surroundings goes to the
    core's block, with its count and only what stands around the core. Cores of so many kinds that their surroundings
    exceed a block are cut into finer ranges, in the end single starts, of which there is one kind. There one window stands
    for its equals, so what has equals is marked as repeated.
    """
    spread = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = windows.select("fp", "wh", "c", "before", "bytes").withColumn("lo", F.lit(GRAM - length)).withColumn("hi", F.lit(0))
    found = None
    for wide in RANGES:
        rows = scratch.written(range_rows(todo, length, wide))
        subs = scratch.written(rows.groupBy("core", "sub").agg(F.sum("c").alias("n"), F.min(F.struct("fp", "wh", "u", "v", "s", "e")).alias("one")))
        cores = scratch.written(subs.groupBy("core").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1").drop("total"))
        left = scratch.written(subs.join(cores, "core").select("core", "sub", "kinds", "n", "one.*"))
        few = F.col("kinds") <= max(1, AROUND // (2 * wide))
        marks = left.filter(~few & (F.col("n") > 1)).select("core", "sub", F.lit(0).alias("from"), (F.col("e") - F.col("s")).alias("to"))
        own = left.filter(few).join(windows.drop("c"), ["fp", "wh"])
        part = lambda a, b: F.substring(F.col("bytes"), a + F.col("before") + 1, b - a)
        around = F.concat(part(F.col("s"), F.col("v")), part(F.col("u") + length, F.col("e")))
        cuts = own.select(F.col("core").alias("group"), "sub", "a", "b", (F.col("at") + F.col("s")).alias("at"), F.col("n").alias("m"), around.alias("bytes"), (F.col("v") - F.col("s")).alias("cut"))
        marks = marks.unionByName(block_spans(cuts, length, wide).select(F.col("group").alias("core"), "sub", F.col("s").alias("from"), F.col("e").alias("to")))
        here = rows.join(scratch.written(marks), ["core", "sub"]).select("fp", "wh", (F.col("s") + F.col("from")).alias("s"), (F.col("s") + F.col("to")).alias("e"))
        found = here if found is None else found.unionByName(here)
        many = left.filter(~few & (F.col("kinds") > 1))
        if wide == 1 or not many.limit(1).count():
            break
        todo = many.join(windows.select("fp", "wh", "before", "bytes"), ["fp", "wh"])
        todo = todo.select("fp", "wh", F.col("n").alias("c"), "before", "bytes", F.col("u").alias("lo"), F.col("v").alias("hi")).repartition(spread)
    return found


def spans(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(a, b, spans) of distinct texts (a, b, m, bytes), m of each: covered spans, maybe overlapping, unordered."""
    rows = scratch.written(anchor_rows(texts, length))
    fps = rows.groupBy("fp").agg(F.sum("m").alias("c"), F.count("*").alias("places"), F.min(F.struct("a", "b", "pos")).alias("home")).filter("c > 1")
    hot = F.col("places") > max(most for most, _ in CELLS)
    size = None
    for most, cell in sorted(CELLS, reverse=True):
        size = F.lit(cell) if size is None else F.when(F.col("places") <= most, cell).otherwise(size)
    cell = F.xxhash64("home.a", "home.b", size, F.floor(F.col("home.pos") / size))
    fps = scratch.written(fps.select("fp", hot.alias("hot"), F.when(hot, F.col("fp")).otherwise(cell).alias("key")))
    places = rows.join(fps, "fp").groupBy("a", "b").agg(F.collect_list(F.struct("pos", "key", "hot")).alias("places"))
    pieces = scratch.written(piece_rows(texts.join(places, ["a", "b"]), length), "kind")
    whole = pieces.filter("kind = 0").select(F.col("key").alias("group"), F.col("wh").alias("sub"), "a", "b", "at", "m", "bytes", F.lit(0).alias("cut"))
    found = block_spans(whole, length).select("a", "b", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e"))
    if fps.filter("hot").limit(1).count():
        spots = pieces.filter("kind = 2").select(F.col("key").alias("fp"), "wh", "a", "b", F.col("at"), "m")
        counted = spots.groupBy("fp", "wh").agg(F.sum("m").alias("c"))
        sent = pieces.filter("kind = 1").select(F.col("key").alias("fp"), "wh", "a", "b", "at", "before", "bytes").dropDuplicates(["fp", "wh"])
        windows = scratch.written(sent.join(counted, ["fp", "wh"]))
        # all strings of a window hold its anchor, so what they cover is one span, and a place meets one row
        held = scratch.written(window_spans(windows, length, scratch).groupBy("fp", "wh").agg(F.min("s").alias("s"), F.max("e").alias("e")))
        spots = spots.join(held, ["fp", "wh"])
        found = found.unionByName(spots.select("a", "b", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e")))
    return found.groupBy("a", "b").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Disjoint maximal spans within n bytes."""
    out: list[list[int]] = []
    for s, e in sorted((max(0, s), min(n, e)) for s, e in spans):
        if e <= s:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut_texts(held: DataFrame, keep_text: bool) -> DataFrame:
    """(a, b, n_removed, n_spans, kept_sha256, kept_text) of texts (a, b, bytes, spans)."""

    def each(batches):
        for batch in batches:
            out = []
            for a, b, text, spans in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "bytes", "spans")), strict=True):
                gone = merged([(x["s"], x["e"]) for x in spans], len(text))
                kept, at = [], 0
                for s, e in gone:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((a, b, sum(e - s for s, e in gone), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep_text else None))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, types, strict=True)], names=["a", "b", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return held.select("a", "b", "bytes", "spans").mapInArrow(each, "a long, b long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def deduplicated(docs: DataFrame, text: str = "text", length: int = 400, keep_text: bool = False) -> DataFrame:
    """The rows without their text, with n_bytes, n_removed, n_spans, kept_sha256; with keep_text the remaining text too.

    Where a removed run cuts a character, the remaining bytes are no UTF-8 there; the kept text drops the torn bytes, the
    digest is of all remaining bytes.
    """
    scratch = Scratch(docs.sparkSession)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    names = docs.columns
    own = [(f"c{i}", c) for i, c in enumerate(names) if c != text and c not in added]
    rows = docs.toDF(*(f"c{i}" for i in range(len(names)))).select(*(c for c, _ in own), F.col(f"c{names.index(text)}").cast("binary").alias("bytes"))
    rows = rows.select("*", F.xxhash64("bytes").alias("a"), F.xxhash64(F.lit(7), "bytes").alias("b"), F.octet_length("bytes").alias("n"))
    texts = rows.filter(F.col("n") >= length).groupBy("a", "b").agg(F.first("bytes").alias("bytes"), F.count("*").alias("m"))
    texts = scratch.bucketed(texts, "a", "b")
    found = written(cut_texts(texts.join(spans(texts, length, scratch), ["a", "b"]), keep_text))
    scratch.drop()
    if keep_text:  # a bitmap of fixed size tells rows that need no join, so their texts aren't shuffled
        bits = bits_of(found.select("a"))
        known = rows.withColumn("bit", F.pmod("a", F.lit(BITS)))
        kinds = known.drop("bit").schema
        plain = known.mapInArrow(passing(bits, False), kinds).withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in found.columns if c not in ("a", "b")})
        rows = plain.unionByName(known.mapInArrow(passing(bits, True), kinds).join(found, ["a", "b"], "left"))
    else:
        rows = rows.select(*(c for c, _ in own), "a", "b", "n", F.sha2(F.coalesce("bytes", F.lit(b"")), 256).alias("whole")).join(found.drop("kept_text"), ["a", "b"], "left")
    digest = F.sha2(F.coalesce("bytes", F.lit(b"")), 256) if keep_text else F.col("whole")
    out = [F.coalesce("n", F.lit(0)).cast("long").alias("n_bytes"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", digest).alias("kept_sha256")]
    if keep_text:
        out.append(F.coalesce("kept_text", F.col("bytes").cast("string")).alias("kept_text"))
    return rows.select(*(F.col(c).alias(name) for c, name in own), *out)
