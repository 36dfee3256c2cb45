"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text gets a space mark before it, spaces become marks, and it is cut before each mark that follows another character. No piece of
the vocabulary has a mark behind another character (checked on reading the model), so no merge crosses a cut and each word
has the tokens that it has in the whole text.

The distinct words of a batch are encoded together. Their characters stand in one flat array of symbols, beside the rank of
the piece that each symbol makes with the next one (none at the end of a word). A round finds the least rank of each word by a
segmented minimum, merges the places that have it, from the left and without overlaps, in all words at once, compacts
the arrays and looks up only the pairs that changed. A word without a pair left is finished and leaves the arrays.

The library merges one pair at a time, the best score first and of equal ones the leftmost. Merging all places of a word's best piece
at once gives the same, if the merged piece can't be part of a piece with as good a score: else that one would come before the next
place. Pieces are examined for this when the model is read (`hasty`); those that can, as well as pieces whose scores tie
(runs of spaces), merge at the leftmost place only. A word of more than LONG symbols that comes to such a piece is finished by
an ordered agenda of single merges, so a run of a million spaces takes a heap and not a million rounds.

Characters without a piece fall back to bytes. Decoding concatenates pieces, turns byte pieces to characters (a byte that is not part of
a valid one to U+FFFD), marks to spaces, and drops the mark before the text.

The vocabulary is read by the driver and broadcast: its size is fixed.

Models that normalise texts, remove spaces, or have user-defined, unused or no byte pieces are refused by an error.

Defined results: null text is empty and gives no tokens; the strings of control or byte pieces in a text are ordinary text; texts of any
length are encoded whole, by one task, which holds their symbols; repeated rows each give their row; an empty table gives
an empty result; null identifiers are kept; other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
LONG = 256
#: Texts are encoded together up to about so many characters; a longer one is cut between words, or is one word.
TOGETHER = 1 << 21
ROWS = 1024
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
CUT = re.compile(f"(?<=[^{MARK}]){MARK}")
NONE = np.iinfo(np.int32).max
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def read_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """(pieces, scores, kinds) of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if train.model_type != train.BPE or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is needed")
    kinds = [p.type for p in model.pieces]
    if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces aren't supported")
    return [p.piece for p in model.pieces], [p.score for p in model.pieces], kinds


class Vocabulary:
    """Pieces, the pairs that make them, and ranks: places in the order of scores, the best first."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        self.pieces, self.kinds = pieces, np.array(kinds, np.int8)
        self.id = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a space mark behind another character")
        self.byte = np.zeros(256, np.int64)
        self.byte_of = {i: int(p[1:-1], 16) for i, p in enumerate(pieces) if kinds[i] == BYTE}
        if len(self.byte_of) != 256:
            raise ValueError("byte pieces are missing")
        for i, b in self.byte_of.items():
            self.byte[b] = i
        # a symbol is the number of a piece, or len(pieces) for a character without one
        own = np.unique(-np.array(scores, np.float32)[list(self.id.values())])
        self.rank = np.full(len(pieces) + 1, NONE, np.int32)
        for i in self.id.values():
            self.rank[i] = np.searchsorted(own, -np.float32(scores[i]))
        pairs, self.hasty = {}, np.zeros(len(pieces) + 1, bool)
        tied = np.bincount(self.rank[list(self.id.values())], minlength=len(own)) > 1
        for p, i in self.id.items():
            self.hasty[i] |= tied[self.rank[i]]
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * len(pieces) + b] = i
                for part in (a, b):  # a better piece could grow from the part before the part's next place is merged
                    if part is not None and self.rank[i] <= self.rank[part]:
                        self.hasty[part] = True
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.pair = pairs
        most = max((ord(p) for p in self.id if len(p) == 1), default=0)
        self.character = np.full(most + 2, len(pieces), np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.character[ord(p)] = i

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        return self.character[np.minimum(codes, len(self.character) - 1)]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, len(pieces) for none."""
        none = len(self.pieces)
        key = np.where((a == none) | (b == none), -1, a.astype(np.int64) * none + b)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.made[at], np.int32(none)) if len(self.keys) else np.full(len(a), none, np.int32)


def leftmost(hit: np.ndarray) -> np.ndarray:
    """Which of the places, in ascending order, where a pair begins merge: every other one of neighbouring places, from the left."""
    new = np.ones(len(hit), bool)
    new[1:] = np.diff(hit) > 1
    if new.all():
        return new
    start = hit[np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))]
    return (hit - start) % 2 == 0


def agenda(v: Vocabulary, symbols: list[int]) -> list[tuple[int, int]]:
    """(place, symbol) of what is left of one word's symbols after single merges in the order of (rank, place)."""
    n, none = len(symbols), len(v.pieces)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    waiting: list[tuple[int, int, int, int, int]] = []

    def add(i: int, j: int) -> None:
        if symbols[i] != none and symbols[j] != none and (p := v.pair.get(symbols[i] * none + symbols[j])) is not None:
            heapq.heappush(waiting, (int(v.rank[p]), i, symbols[i], symbols[j], p))

    for i in range(n - 1):
        add(i, i + 1)
    while waiting:
        _, i, a, b, p = heapq.heappop(waiting)
        if not live[i] or symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
            continue
        symbols[i], live[j], after[i] = p, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            add(i, after[i])
        if before[i] >= 0:
            add(before[i], i)
    return [(i, symbols[i]) for i in range(n) if live[i]]


def merge_rounds(v: Vocabulary, words: list[str], long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of words (each begins with a mark), one word after the other, and where each word's end; all words at once."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    text = "".join(words)
    sym = v.symbols(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    place = np.arange(len(sym), dtype=np.int32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    done_at, done_sym = [], []
    made = np.full(len(sym), len(v.pieces), np.int32)
    inside = np.flatnonzero(word[1:] == word[:-1])
    made[inside] = v.merged(sym[inside], sym[inside + 1])
    while len(sym):
        rank = v.rank[made]
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[start, len(sym)])
        least = np.minimum.reduceat(rank, start)
        over = least == NONE
        if over.any():  # finished words leave
            out = np.repeat(over, size)
            done_at.append(place[out])
            done_sym.append(sym[out])
            stay = ~out
            sym, place, word, made, rank = sym[stay], place[stay], word[stay], made[stay], rank[stay]
            start, size, least = None, size[~over], least[~over]
            start = np.cumsum(size) - size
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        which = np.repeat(np.arange(len(size)), size)[hit]
        first = np.r_[True, which[1:] != which[:-1]]  # of each word
        hasty = v.hasty[made[hit]]
        if hasty.any():
            slow = np.zeros(len(size), bool)
            slow[which[hasty]] = True
            tall = slow & (size > long)
            if tall.any():  # such a word goes to the agenda as a whole
                for w in np.flatnonzero(tall).tolist():
                    left = agenda(v, sym[start[w] : start[w] + size[w]].tolist())
                    done_at.append(place[start[w] + np.array([i for i, _ in left])])
                    done_sym.append(np.array([s for _, s in left], np.int32))
                stay = ~np.repeat(tall, size)
                sym, place, word, made = sym[stay], place[stay], word[stay], made[stay]
                continue
            keep = first & slow[which]
            fast = np.flatnonzero(~slow[which])
            keep[fast[leftmost(hit[fast])]] = True
            hit = hit[keep]
        else:
            hit = hit[leftmost(hit)]
        sym[hit] = made[hit]
        stay = np.ones(len(sym), bool)
        stay[hit + 1] = False
        moved = np.cumsum(stay) - 1
        sym, place, word, made = sym[stay], place[stay], word[stay], made[stay]
        hit = moved[hit]
        for changed in (hit, hit[hit > 0] - 1):  # a merged symbol's pairs with its neighbours
            made[changed] = len(v.pieces)
            changed = changed[changed + 1 < len(sym)]
            changed = changed[word[changed] == word[changed + 1]]
            made[changed] = v.merged(sym[changed], sym[changed + 1])
    at, symbols = np.concatenate([np.zeros(0, np.int32), *done_at]), np.concatenate([np.zeros(0, np.int32), *done_sym])
    order = np.argsort(at, kind="stable")
    at, symbols = at[order], symbols[order]
    ends = np.searchsorted(at, np.cumsum([len(w) for w in words]))
    unknown = np.flatnonzero(symbols == len(v.pieces))
    if not len(unknown):
        return symbols, ends
    raw = [v.byte[list(text[i].encode("utf-8"))] for i in at[unknown].tolist()]
    times = np.ones(len(symbols), np.int64)
    times[unknown] = [len(r) for r in raw]
    begins = np.cumsum(times) - times
    out = np.repeat(symbols, times)
    for k, r in zip(begins[unknown].tolist(), raw, strict=True):
        out[k : k + len(r)] = r
    return out, (begins + times)[ends - 1]


class Codec:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], long: int = LONG):
        self.v, self.long = Vocabulary(pieces, scores, kinds), long
        self.digits = list(map(str, range(len(pieces))))
        #: None for bytes, so that joining fails where there are any.
        self.surface = [None if k == BYTE else p.replace(MARK, " ") if k == NORMAL else "" if k == CONTROL else " ⁇ " for p, k in zip(pieces, kinds, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Identifiers of each text."""
        out, some, n = [], [], 0
        for t in texts:
            if len(t) > TOGETHER:
                out += self._together(some)
                some, n = [], 0
                out.append(np.concatenate([self._words([s])[0] for s in stretches(MARK + t.replace(" ", MARK))]))
                continue
            some.append(t)
            n += len(t)
            if n > TOGETHER:
                out += self._together(some)
                some, n = [], 0
        return out + self._together(some)

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        return self._words([MARK + t.replace(" ", MARK) if t else "" for t in texts])

    def _words(self, marked: list[str]) -> list[np.ndarray]:
        """Identifiers of texts with their marks: those of their distinct words, gathered."""
        split = list(map(WORDS.findall, marked))
        words = pa.array(list(itertools.chain.from_iterable(split)), pa.string()).dictionary_encode()
        ids, ends = merge_rounds(self.v, words.dictionary.to_pylist(), self.long)
        at = words.indices.to_numpy()
        size = np.diff(ends, prepend=0)
        begin, times = (ends - size)[at], size[at]
        to = np.cumsum(times)
        found = ids[np.repeat(begin - to + times, times) + np.arange(to[-1] if len(to) else 0)]
        return np.split(found, np.r_[0, to][np.cumsum([len(ws) for ws in split])][:-1]) if split else []

    def decode(self, ids: list[int]) -> str:
        """Text of identifiers."""
        surface = self.surface
        try:
            text = "".join(map(surface.__getitem__, ids))
        except TypeError:  # there are bytes
            parts, run = [], bytearray()
            for i in ids:
                if surface[i] is None:
                    run.append(self.v.byte_of[i])
                    continue
                parts.append(characters(bytes(run)))
                run.clear()
                parts.append(surface[i])
            text = "".join([*parts, characters(bytes(run))])
        first = next((k for k, i in enumerate(ids) if self.v.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.v.kinds[ids[first]] == NORMAL and text.startswith(" ") else text


def stretches(marked: str) -> Iterator[str]:
    """A text with its marks, cut between words once a stretch has TOGETHER characters."""
    a = 0
    while a < len(marked):
        m = CUT.search(marked, a + TOGETHER)
        b = m.start() if m else len(marked)
        yield marked[a:b]
        a = b


def characters(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that isn't part of a valid character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            k += n
        return "".join(out)


@functools.lru_cache(maxsize=2)
def codec(pieces: tuple, scores: tuple, kinds: tuple, long: int) -> Codec:
    return Codec(list(pieces), list(scores), list(kinds), long)


def _run(df: DataFrame, value_col: str, path: str, make, schema: str, id_col: str, long: int = LONG) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(tuple(map(tuple, read_model(path))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for batch in batches:
            c = c or codec(*shared.value, long)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield make(c, part.column(0), part.column(1).to_pylist())

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(value_col).alias("value")).mapInArrow(each, schema).withColumnRenamed("doc_id", id_col)


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row per row of df: identifier, ids (array of int)."""

    def make(c: Codec, keys, texts):
        return pa.RecordBatch.from_arrays([keys, pa.array(c.encode([t or "" for t in texts]), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _run(df, text_col, path, make, "doc_id long, ids array<int>", id_col, long)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of df: identifier, text. Null ids give an empty text."""

    def make(c: Codec, keys, rows):
        return pa.RecordBatch.from_arrays([keys, pa.array([c.decode(x or []) for x in rows], pa.string())], names=["doc_id", "text"])

    return _run(df, ids_col, path, make, "doc_id long, text string", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row per row of df: identifier, n_tokens, ids_sha256, decoded_sha256; encoding and decoding in one pass over the texts."""

    def make(c: Codec, keys, texts):
        n, ids_sha, text_sha = [], [], []
        for found in c.encode([t or "" for t in texts]):
            ids = found.tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(df, text_col, path, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, long)
