"""Removal of repeated passages through a sparse suffix array sorted deep-shallow.

A byte goes if a string of WIDTH bytes that covers it also starts earlier. Sorting every suffix would shuffle hundreds of
bytes for each byte of text, so only suffixes at anchors are sorted: an anchor is a place whose GRAM-byte hash is the
least of some WIDTH-byte string, and a string belongs to the first such place in it. Equal strings have equal anchors at equal
offsets, so no repeated string is missed.

0. Of equal texts only the first takes part: every string of the others starts earlier in it, so they go as a whole. Here, and
   only here, texts count as equal if their SHA-256 and length are.
1. Each task finds the anchors of its texts and sends (hash, row, place) by hash; hashes that occur once are dropped.
2. The anchors left go back to their texts, which give the bytes around them, and on by hash.
3. In a bucket of hashes, anchors with all bytes equal become one, so copies cost nothing. The right-hand suffixes of the
   others, and the left-hand ones reversed, are sorted deep-shallow: multikey quicksort by 8-byte words to SHALLOW words,
   then a blind trie for each run that still ties. Longest common prefixes of neighbours give, for every offset, the
   classes of equal right and left parts; a string is repeated if an earlier anchor has the same pair of classes.
4. The repeated ranges go to the texts, which are masked and hashed.

In steps 1 to 3 hashes only choose what is compared, and equalities are decided on bytes. Rows between the steps are packed numpy
arrays, one per (batch, bucket), so Spark's row counts are counts of packs; there is a bucket for each shuffle partition and
for each BUCKET_BYTES of text, and a group stays a few MB.

Very frequent grams don't meet in one group: the most frequent ones, estimated on a sample of rows, skip step 1's
counting; equal surroundings collapse before they are sent; and the strings of a gram that occurs more than HOT times are dealt
in pieces of 10 offsets (of 1 from 50 HOT on) by a hash of the bytes that all strings of a piece share.

Memory of a task: a group's texts, and for one stretch of CHUNK bytes at a time its hashes and surroundings. A text of any length
is read in such stretches. A run of one byte, in which every place is an anchor, has one string an anchor and one surrounding
in all, so it costs no more memory than prose (tests/llm/test_memory.py).

Defined results: null text is empty; a null identifier comes after all others, equal identifiers in the order in which
their rows are read; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, checkpointed, fixed_partitions, inner, located, told

WIDTH = 100
GRAM = 24
SHALLOW = 4
BUCKET_BYTES = 4 << 20
CHUNK = 1 << 18
FLUSH = 200_000
SLICE = 20_000
HOT = 2000
SAMPLED = 16
MOST_HOT = 10_000
NO_ID = np.iinfo(np.int64).max
PACKED = "bucket int, payload binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

ANCHOR = np.dtype([("hash", "<u8"), ("row", "<i8"), ("at", "<u4"), ("piece", "u1")])
PLACE = np.dtype([("row", "<i8"), ("at", "<u4"), ("hash", "<u8"), ("piece", "u1")])
AROUND = np.dtype([("hash", "<u8"), ("id", "<i8"), ("row", "<i8"), ("at", "<u4"), ("least", "u1"), ("most", "u1"), ("left", "u1", (WIDTH,)), ("right", "u1", (WIDTH,))])
RANGE = np.dtype([("row", "<i8"), ("start", "<u4"), ("end", "<u4")])


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; never 0."""
    v = t.astype(np.uint64)
    for k in (1, 2, 4):
        v = v[:-k] | (v[k:] << np.uint64(8 * k))
    n = len(t) - GRAM + 1
    h = v[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += v[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += v[16 : 16 + n] * np.uint64(0x165667B19E3779F9)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h | np.uint64(1)


def sliding(v: np.ndarray, width: int, best) -> np.ndarray:
    """best over v[i : i + width] for each i."""
    done = 1
    while 2 * done <= width:
        v = best(v[:-done], v[done:])
        done *= 2
    return best(v[: len(v) - (width - done)], v[width - done :]) if done < width else v


def window_minima(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, least hash of the string from each place on or 0 where none starts); texts are concatenated in t and end at ends."""
    h = gram_hashes(t)
    least = sliding(h, WIDTH - GRAM + 1, np.minimum)
    for e in ends:
        least[max(0, e - WIDTH + 1) : e] = 0
    return h, least


def anchors(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of a string."""
    span = WIDTH - GRAM
    padded = np.concatenate([np.zeros(span, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)])
    return np.flatnonzero(sliding(padded, span + 1, np.maximum) == h)


def by_bucket(rows: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows, one for each bucket."""
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    parts = [x.tobytes() for x in np.split(rows, at[1:])]
    for k in range(0, len(parts), 64):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at[k : k + 64]], pa.int32()), pa.array(parts[k : k + 64], pa.binary())], schema=PACKED_ARROW)


def unpack(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table.column("payload"))])


def as_table(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema)


def hash_bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Anchors have the least hashes around, so the hash is mixed once more before its upper half is divided."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def row_bucket(row: np.ndarray, n: int) -> np.ndarray:
    """As bucket_of_row."""
    return (((row & ((1 << 33) - 1)) + (row >> 33) * 7919) % n).astype(np.int32)


def bucket_of_row(row: str, n: int):
    c = F.col(row)
    return ((c.bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright(c, 33) * 7919) % n).cast("int")


def cut(text: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, begin, end): stretches of a text of at most CHUNK bytes with what must be read around them, so memory doesn't grow with a text."""
    for begin in range(0, len(text), CHUNK):
        end = min(len(text), begin + CHUNK)
        yield max(0, begin - WIDTH), min(len(text), end + WIDTH), begin, end


class Finder:
    """Collects texts and finds their anchors, CHUNK bytes at a time."""

    def __init__(self):
        self.parts, self.size, self.held, self.count = [], 0, [], 0

    def add(self, row: int, text: bytes) -> None:
        for lo, hi, begin, end in cut(text):
            if hi - lo >= WIDTH:
                self.parts.append((row, lo, begin, end, text[lo:hi]))
                self.size += hi - lo
            if self.size >= CHUNK:
                self.search()

    def search(self) -> None:
        if not self.parts:
            return
        t = np.frombuffer(b"".join(x[-1] for x in self.parts), np.uint8)
        ends = np.cumsum([len(x[-1]) for x in self.parts])
        at = anchors(*(h := window_minima(t, ends)))
        which = np.searchsorted(ends, at, side="right")
        row, lo, begin, end = np.array([x[:4] for x in self.parts], np.int64)[which].T
        place = at - np.r_[0, ends][which] + lo
        own = (begin <= place) & (place < end)
        out = np.zeros(int(own.sum()), ANCHOR)
        out["hash"], out["row"], out["at"] = h[0][at][own], row[own], place[own]
        self.held.append(out)
        self.count += len(out)
        self.parts, self.size = [], 0

    def take(self, least: int) -> np.ndarray | None:
        """What was found, if it is at least so much."""
        if self.count < least or not self.held:
            return None
        out = np.concatenate(self.held)
        self.held, self.count = [], 0
        return out


def find_anchors(docs: pa.Table, table: pa.Table, n: int, hot: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts of a bucket of rows -> ANCHOR by hash; rows that the RANGEs cover as a whole are left out. Anchors of hot grams (ascending) needn't be
    counted by hash: they have their piece at once and go by row, so they don't meet in one group."""
    skip = set(unpack(table, RANGE)["row"].tolist())
    f = Finder()

    def sent(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = hash_bucket(found["hash"], n)
        if len(hot):
            k = np.minimum(np.searchsorted(hot, found["hash"]), len(hot) - 1)
            known = hot[k] == found["hash"]
            found["piece"][known] = sizes[k[known]]
            bucket[known] = row_bucket(found["row"][known], n)
        return by_bucket(found, bucket)

    for row, text in zip(docs.column("row").to_pylist(), docs.column("text"), strict=True):
        raw = text.as_buffer()
        if raw is None or raw.size < WIDTH or row in skip:
            continue
        f.add(row, raw.to_pybytes())
        if (found := f.take(FLUSH)) is not None:
            yield from sent(found)
    f.search()
    if (found := f.take(0)) is not None:
        yield from sent(found)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (hash as a signed long, n) of the anchors' grams that stand several times among some FLUSH anchors."""
    f = Finder()

    def counted(found: np.ndarray) -> pa.RecordBatch:
        h, times = np.unique(found["hash"], return_counts=True)
        often = times >= 4
        return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["hash", "n"])

    for batch in batches:
        for text in batch.column(0):
            if (raw := text.as_buffer()) is not None and raw.size >= WIDTH:
                f.add(0, raw.to_pybytes())
                if (found := f.take(FLUSH)) is not None:
                    yield counted(found)
    f.search()
    if (found := f.take(0)) is not None:
        yield counted(found)


def piece_of(times: np.ndarray) -> np.ndarray:
    return np.where(times <= HOT, WIDTH, np.where(times <= 50 * HOT, 10, 1)).astype(np.uint8)


def hot_grams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, piece sizes) of at most MOST_HOT grams that stand most often, estimated from one row in SAMPLED. They only decide how
    anchors are dealt: a gram that is missed makes a larger group and changes no result."""
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(count_grams, "hash long, n long")
    found = some.groupBy("hash").agg((F.sum("n") * SAMPLED).alias("n")).filter(F.col("n") > 10 * HOT).orderBy(F.desc("n"), "hash").limit(MOST_HOT).collect()
    h, n = np.array([r["hash"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], piece_of(n[order])


def repeated(table: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
    """ANCHOR of a bucket of hashes -> PLACE of those whose hash occurs twice, by row, with the offsets of a piece."""
    a = unpack(table, ANCHOR)
    known, a = a[a["piece"] > 0], a[a["piece"] == 0]
    a = a[np.argsort(a["hash"], kind="stable")]
    starts = np.flatnonzero(np.r_[True, a["hash"][1:] != a["hash"][:-1]]) if len(a) else np.zeros(0, np.int64)
    times = np.diff(np.r_[starts, len(a)])
    times = np.repeat(times, times)
    a, times = a[times > 1], times[times > 1]
    a["piece"] = piece_of(times)
    a = np.concatenate([a, known])
    out = np.zeros(len(a), PLACE)
    for c in PLACE.names:
        out[c] = a[c]
    yield from by_bucket(out, row_bucket(out["row"], n))


def owned(t: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """PLACEs p of one text t -> slices (p, least, most): each string of WIDTH bytes belongs to the first of the places with its least
    hash, and an anchor's strings start least to most bytes before it; anchors without any are left out. So a slice has at most CHUNK strings
    in all, also where one byte repeats and every place is an anchor."""
    p = p[np.lexsort((p["at"], p["hash"]))]
    before = np.full(len(p), WIDTH, np.int64)
    before[1:] = np.where(p["hash"][1:] == p["hash"][:-1], p["at"][1:].astype(np.int64) - p["at"][:-1], WIDTH)
    order = np.argsort(p["at"], kind="stable")
    p, before = p[order], before[order]
    offsets = np.arange(WIDTH - GRAM + 1)
    a = 0
    while a < len(p):
        b = min(np.searchsorted(p["at"], int(p["at"][a]) + CHUNK // 2), a + SLICE)
        at = p["at"][a:b].astype(np.int64)
        lo = max(0, int(at[0]) - WIDTH)
        h, least = window_minima(t[lo : int(at[-1]) + 2 * WIDTH], np.array([min(len(t), int(at[-1]) + 2 * WIDTH) - lo]))
        low = np.concatenate([np.zeros(WIDTH, np.uint64), least, np.zeros(2 * WIDTH, np.uint64)])
        owns = (low[(at - lo)[:, None] - offsets + WIDTH] == h[at - lo][:, None]) & (offsets < before[a:b][:, None])
        some = owns.any(1)
        owns = owns[some]
        yield p[a:b][some], owns.argmax(1), WIDTH - GRAM - owns[:, ::-1].argmax(1)
        a = b


def surroundings(docs: pa.Table, table: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
    """PLACE of a bucket of rows and their texts -> AROUND by hash."""
    p = unpack(table, PLACE)
    p = p[np.argsort(p["row"], kind="stable")]
    firsts = np.searchsorted(p["row"], np.array(docs.column("row").to_pylist(), np.int64)) if docs.num_rows else []
    held, count = [], 0
    reach = np.arange(WIDTH)
    for k, (row, key, text) in enumerate(zip(docs.column("row").to_pylist(), docs.column("id").to_pylist(), docs.column("text"), strict=True)):
        a = firsts[k]
        b = np.searchsorted(p["row"], row, side="right")
        if a == b:
            continue
        t = np.frombuffer(text.as_buffer(), np.uint8)
        padded = np.concatenate([np.zeros(WIDTH, np.uint8), t, np.zeros(WIDTH, np.uint8)])
        for part, least, most in owned(t, p[a:b]):
            at = part["at"].astype(np.int64)
            out = np.zeros(len(part), AROUND)
            out["hash"], out["id"], out["row"], out["at"], out["least"], out["most"] = part["hash"], NO_ID if key is None else key, row, at, least, most
            out["left"], out["right"] = padded[at[:, None] + WIDTH - 1 - reach], padded[at[:, None] + WIDTH + reach]
            for size in np.unique(part["piece"]):
                held.append(pieces(out[part["piece"] == size], int(size)))
                count += len(held[-1])
            if count >= FLUSH // 4:
                yield from without_copies(np.concatenate(held), n)
                held, count = [], 0
    if held:
        yield from without_copies(np.concatenate(held), n)


def pieces(a: np.ndarray, size: int) -> np.ndarray:
    """AROUND cut into pieces of size offsets, and cleared of the bytes that the strings of a piece don't reach."""
    reach = np.arange(WIDTH)
    if size < WIDTH:
        low, high = a["least"].astype(np.int64) // size, a["most"].astype(np.int64) // size
        times = high - low + 1
        which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        a = np.repeat(a, times)
        shared = np.concatenate([np.where(reach < (which * size)[:, None], a["left"], 0), np.where(reach < (WIDTH + 1 - size - which * size)[:, None], a["right"], 0)], axis=1)
        factor = np.random.default_rng(11).integers(1, 2**63, 2 * WIDTH, dtype=np.uint64) | np.uint64(1)
        mix = a["hash"] + which.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(2 * WIDTH):
            mix += shared[:, k].astype(np.uint64) * factor[k]
        mix ^= mix >> np.uint64(32)
        mix *= np.uint64(0x94D049BB133111EB)
        a["hash"] = (mix ^ (mix >> np.uint64(29))) | np.uint64(1)
        a["least"], a["most"] = np.maximum(a["least"], which * size), np.minimum(a["most"], which * size + size - 1)
    a["left"][reach >= a["most"][:, None]] = 0
    a["right"][reach >= WIDTH - a["least"][:, None].astype(np.int64)] = 0
    return a


def without_copies(a: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Packed AROUND by hash. Those that equal an earlier one here are known to be repeated; their ranges, merged by row, go along with
    hash 0, the start as at and the end as id, to any bucket."""
    a = in_order(a)
    copy = first_equal(a) != np.arange(len(a))
    known = merged(ranges(a[copy], a["least"][copy], a["most"][copy]))
    done = np.zeros(len(known), AROUND)
    done["row"], done["at"], done["id"] = known["row"], known["start"], known["end"]
    a = a[~copy]
    yield from by_bucket(np.concatenate([a, done]), np.concatenate([hash_bucket(a["hash"], n), row_bucket(done["row"], n)]))


def merged(r: np.ndarray) -> np.ndarray:
    """RANGE with those of a row that touch made one."""
    if not len(r):
        return r
    r = r[np.lexsort((r["start"], r["row"]))]
    new = r["row"][1:] != r["row"][:-1]
    group = np.cumsum(np.r_[0, new])
    reach = np.maximum.accumulate(r["end"].astype(np.int64) + (group << 32)) - (group << 32)
    starts = np.r_[True, new | (r["start"][1:] > reach[:-1])]
    out = r[starts]
    out["end"] = np.maximum.reduceat(r["end"], np.flatnonzero(starts))
    return out


def in_order(a: np.ndarray) -> np.ndarray:
    return a[np.lexsort((a["least"], a["at"], a["row"], a["id"], a["hash"]))]


def blind_trie(strings: list[bytes]) -> list[int]:
    """Indices of the strings in sorted order, equal ones in the order given. Inner nodes hold a depth and the byte there; a string
    walks down by those bytes alone to some leaf, is compared with that leaf once, and is put in where they part."""
    width = len(strings[0])
    root: list = [width, [0], None]  # [depth, leaves, children]
    for i, s in enumerate(strings[1:], 1):
        node, path = root, []
        while node[2] is not None:
            path.append(node)
            node = node[2].get(s[node[0]]) or next(iter(node[2].values()))
        path.append(node)
        other = strings[node[1][0]]
        x = int.from_bytes(s) ^ int.from_bytes(other)
        if x == 0:
            node[1].append(i)
            continue
        d = width - (x.bit_length() + 7) // 8
        for node in path:
            if node[0] >= d:
                break
        if node[0] == d:
            node[2][s[d]] = [width, [i], None]
            continue
        below = [node[0], node[1], node[2]]
        node[0], node[1], node[2] = d, None, {other[d]: below, s[d]: [width, [i], None]}
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node[2] is None:
            out += node[1]
        else:
            todo += [node[2][c] for c in sorted(node[2], reverse=True)]
    return out


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows of words (m x depth, unsigned) within ascending groups, stable, and (begins, ends) of the runs in it that tie in all words.

    All segments of a round are cut at once: each takes the median of three of its words at its own depth as pivot, and falls into those below,
    equal and above; the equal part goes on with the next word. Segments of one row, or past the last word, are done.
    """
    m, depths = words.shape
    order = np.argsort(group, kind="stable")
    active = np.arange(m)
    start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if m else np.zeros(0, np.int64)
    size, depth = np.diff(np.r_[start, m]), np.zeros(len(start), np.int64)
    begins, ends = [], []
    while True:
        tied = (size > 1) & (depth == depths)
        begins.append(active[start[tied]])
        ends.append(active[start[tied]] + size[tied])
        going = (size > 1) & (depth < depths)
        active = active[np.repeat(going, size)]
        size, depth = size[going], depth[going]
        if not len(size):
            break
        start = np.cumsum(size) - size
        which = np.repeat(np.arange(len(size)), size)
        w = words[order[active], depth[which]]
        a, b, c = w[start], w[start + size // 2], w[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[which]
        side = (w >= pivot).astype(np.int64) + (w > pivot)
        sizes, place = np.zeros((len(size), 3), np.int64), np.zeros(len(w), np.int64)
        for k in range(3):
            mine = side == k
            ahead = np.cumsum(mine)
            sizes[:, k] = np.add.reduceat(mine, start)
            place[mine] = (ahead - 1 - (ahead[start] - mine[start])[which])[mine]
        first = start[:, None] + np.cumsum(sizes, axis=1) - sizes
        place += first[which, side]
        moved = np.empty(len(w), np.int64)
        moved[place] = order[active]
        order[active] = moved
        some = sizes.ravel() > 0
        start, size = first.ravel()[some], sizes.ravel()[some]
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()[some]
    begins, ends = np.concatenate(begins), np.concatenate(ends)
    by = np.argsort(begins)
    return order, begins[by], ends[by]


def deep_shallow(group: np.ndarray, text: np.ndarray, skip: int = 0) -> np.ndarray:
    """Order of the rows of text (bytes) within ascending groups, stable; the first skip bytes of a group's rows are equal. Multikey quicksort by words
    of 8 bytes to SHALLOW words, then a blind trie for each run that still ties."""
    words = np.ascontiguousarray(text[:, skip : skip + 8 * SHALLOW]).view(">u8").astype(np.uint64)
    order, begins, ends = multikey_quicksort(group, words)
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        rest = [text[i, skip + 8 * SHALLOW :].tobytes() for i in order[a:b]]
        if rest.count(rest[0]) < len(rest):
            order[a:b] = order[a:b][blind_trie(rest)]
    return order


def common_prefixes(group: np.ndarray, text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order has in common with the one before, -1 where a group begins."""
    g, s = group[order], text[order]
    differ = s[1:] != s[:-1]
    n = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    return np.r_[-1, np.where(g[1:] == g[:-1], n, -1)]


def first_equal(a: np.ndarray) -> np.ndarray:
    """For each AROUND in order of (hash, place in the corpus), the index of the first that equals it but for its place."""
    m = len(a)
    raw = a.view(np.uint8).reshape(m, AROUND.itemsize)[:, 28:]
    factor = np.random.default_rng(7).integers(1, 2**63, 26, dtype=np.uint64) | np.uint64(1)
    mix = a["hash"].copy()
    for at in range(0, m, 8192):
        words = np.zeros((len(raw[at : at + 8192]), 26 * 8), np.uint8)
        words[:, : raw.shape[1]] = raw[at : at + 8192]
        part = mix[at : at + 8192]
        for k in range(26):
            part = (part ^ (words.view(np.uint64)[:, k] * factor[k])) * np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(32)
        mix[at : at + 8192] = part
    order = np.argsort(mix, kind="stable")
    start = np.r_[True, mix[order][1:] != mix[order][:-1]][:m]
    first = np.empty(m, np.int64)
    first[order] = order[np.maximum.accumulate(np.where(start, np.arange(m), 0))]
    for at in range(0, m, 8192):
        own = np.arange(at, min(m, at + 8192))
        equal = (raw[own] == raw[first[own]]).all(1) & (a["hash"][own] == a["hash"][first[own]])
        first[own[~equal]] = own[~equal]
    return first


def covered(table: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
    """AROUND of a bucket of hashes -> RANGE of repeated bytes, by row."""
    a = unpack(table, AROUND)
    if not len(a):
        return
    done = a["hash"] == 0
    known = np.zeros(int(done.sum()), RANGE)
    known["row"], known["start"], known["end"] = a["row"][done], a["at"][done], a["id"][done]
    out = [known]
    a = in_order(a[~done])
    first = first_equal(a)
    own = np.arange(len(a))
    copies = a[first != own]
    out.append(ranges(copies, copies["least"], copies["most"]))
    reps = a[first == own]
    new = np.r_[True, reps["hash"][1:] != reps["hash"][:-1]][: len(reps)]
    alone = new & np.r_[new[1:], True][: len(reps)]
    reps = reps[~alone]
    m = len(reps)
    if m:
        group = np.cumsum(np.r_[True, reps["hash"][1:] != reps["hash"][:-1]])
        sides = []
        for side, skip in (("right", GRAM), ("left", 0)):
            order = deep_shallow(group, reps[side], skip)
            sides.append((order, common_prefixes(group, reps[side], order)))
        hit = np.zeros((m, WIDTH - GRAM + 1), bool)
        for o in range(WIDTH - GRAM + 1):
            mine = (reps["least"] <= o) & (o <= reps["most"])
            if mine.sum() < 2:
                continue
            key = np.zeros(m, np.int64)
            for (order, lcp), depth in zip(sides, (WIDTH - o, o), strict=True):
                part = np.empty(m, np.int64)
                part[order] = np.cumsum(lcp < depth)
                key = key * (m + 1) + part
            at = np.flatnonzero(mine)
            at = at[np.argsort(key[at], kind="stable")]
            hit[at[1:][key[at[1:]] == key[at[:-1]]], o] = True
        step = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)
        out.append(ranges(reps[who], low, high - 1))
    found = merged(np.concatenate(out))
    yield from by_bucket(found, row_bucket(found["row"], n))


def ranges(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bytes of the strings that start high to low bytes before the anchors."""
    out = np.zeros(len(a), RANGE)
    out["row"], out["start"], out["end"] = a["row"], a["at"].astype(np.int64) - high, a["at"].astype(np.int64) - low + WIDTH
    return out


def masked(docs: pa.Table, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """RANGE of a bucket of rows and their texts -> what is left of each text."""
    r = merged(unpack(table, RANGE))
    for k in range(0, docs.num_rows, 512):
        part, rows = docs.slice(k, 512), []
        for row, text in zip(part.column("row").to_pylist(), part.column("text"), strict=True):
            t = memoryview(text.as_buffer() or b"")
            a, b = np.searchsorted(r["row"], row), np.searchsorted(r["row"], row, side="right")
            starts, ends = r["start"][a:b].tolist(), r["end"][a:b].tolist()
            kept = b"".join(t[x:y] for x, y in zip([0, *ends], [*starts, len(t)], strict=True))
            rows.append((len(t), len(t) - len(kept), b - a, kept))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(part.column("id").chunks) if part.num_rows else pa.array([], pa.int64()), *(pa.array([int(x[i]) for x in rows], pa.int64()) for i in range(3)), pa.array([x[3] for x in rows], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def digested(docs: pa.Table, table: pa.Table) -> Iterator[pa.RecordBatch]:
    for b in masked(docs, table):
        sha = pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in b.column("kept")], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], sha], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def whole_copies(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row, end) of the rows (row, id, text) of at least WIDTH bytes whose text an earlier row has as well. Rows of a text that very many rows share stay
    where they are (common.told)."""
    own = rows.select("row", F.coalesce("id", F.lit(NO_ID)).alias("id"), F.octet_length("text").alias("end"), F.sha2("text", 256).alias("sha")).filter(F.col("end") >= WIDTH)
    own = checkpointed(own)
    first = checkpointed(own.groupBy("sha", "end").agg(F.min(F.struct("id", "row"))["row"].alias("first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1"))
    return checkpointed(told(own, first, ["sha", "end"], hot_rows).filter("row <> first").select("row", "end"))


def pack_copies(t: pa.Table) -> pa.Table:
    out = np.zeros(t.num_rows, RANGE)
    out["row"], out["end"] = t.column("row").to_numpy(), t.column("end").to_numpy()
    return pa.table({"bucket": t.column("bucket").slice(0, 1), "payload": pa.array([out.tobytes()], pa.binary())}, schema=PACKED_ARROW)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of df: identifier, n_bytes, n_removed, n_spans and kept (the bytes left, as binary) or, with digest, kept_sha256."""
    rows = located(df).select(inner(id_col).cast("long").alias("id"), F.coalesce(inner(text_col), F.lit("")).cast("binary").alias("text"), F.col("__at").alias("row"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(fixed_partitions(df), -(-total // BUCKET_BYTES))
    texts = rows.select("row", "id", "text", bucket_of_row("row", n).alias("bucket")).groupBy("bucket")
    copies = whole_copies(rows).select(bucket_of_row("row", n).alias("bucket"), "row", "end").groupBy("bucket").applyInArrow(pack_copies, PACKED)
    hot, sizes = hot_grams(rows)
    found = texts.cogroup(copies.groupBy("bucket")).applyInArrow(lambda a, b: as_table(find_anchors(a, b, n, hot, sizes), PACKED_ARROW), PACKED)
    places = found.groupBy("bucket").applyInArrow(lambda t: as_table(repeated(t, n), PACKED_ARROW), PACKED)
    around = texts.cogroup(places.groupBy("bucket")).applyInArrow(lambda a, b: as_table(surroundings(a, b, n), PACKED_ARROW), PACKED)
    gone = around.groupBy("bucket").applyInArrow(lambda t: as_table(covered(t, n), PACKED_ARROW), PACKED)
    last, kind = (digested, pa.field("kept_sha256", pa.string())) if digest else (masked, pa.field("kept", pa.binary()))
    schema = pa.schema([*((c, pa.int64()) for c in ("id", "n_bytes", "n_removed", "n_spans")), kind])
    out = texts.cogroup(gone.union(copies).groupBy("bucket")).applyInArrow(lambda a, b: as_table(last(a, b), schema), f"id long, n_bytes long, n_removed long, n_spans long, {kind.name} {kind.type}")
    return out.withColumnRenamed("id", id_col)
