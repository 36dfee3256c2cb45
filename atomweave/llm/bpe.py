r"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut into halves until a piece has at most LEAF characters; leaves are encoded alone and neighbours are joined up
the tree. A join keeps both token lists but for a window around the cut, which is encoded again and doubled until the tokens
outside it are stable:
* The window begins and ends at points, where a white-space character follows another kind of character (or at the ends of
  the two pieces). A match of the pre-tokeniser's pattern takes white space only at its beginning, or is white space as a
  whole, so no match crosses a point, whatever stands on the other side; and a match depends on nothing to the left of its
  beginning. That is the proof: tokens beyond two points are those of the whole text.
* The window's first and last tokens must be the ones that the halves have there, or the window must reach an end of
  its half. Otherwise it grows, as it does where no point is in reach.
Ordinary prose needs one window of some dozen characters a join. A text without white space has no points: there each
join encodes its whole pieces again, so the text costs its length times the depth of the tree.
Decoding concatenates bytes up the same tree.

The join is associative, so the result doesn't depend on the shape of the tree. Ranks are read by the driver (any file
system path) and broadcast: a vocabulary has a fixed size below 2 MB.

Defined results: null text is empty and gives no tokens; lone special-token strings are ordinary text; a text of any length is
encoded whole, by one task, which holds its token ids; repeated rows each give their row; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 256
WINDOW = 16
#: A point where white space follows another kind of character.
POINT = regex.compile(r"(?<=\S)(?=\s)")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Codec:
    def __init__(self, raw: bytes, pattern: str, leaf: int = LEAF):
        import tiktoken

        ranks = ranks_of(raw)
        self.leaf_encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for i, b in self.token.items()}
        self.leaf = max(1, leaf)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.leaf_encode(text[a:b])
        cut = (a + b) // 2
        return self.join(text, a, cut, b, self._encode(text, a, cut), self._encode(text, cut, b))

    def join(self, text: str, a: int, cut: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[a:b] from those of text[a:cut] and text[cut:b]."""
        size = WINDOW
        while True:
            lo, hi = self._first_point(text, a, cut, size), self._last_point(text, cut, b, size)
            if lo is not None and hi is not None:
                window = self.leaf_encode(text[lo:hi])
                n_left, n_right = self._count(reversed(left), text[lo:cut]), self._count(right, text[cut:hi])
                if (lo == a or window[0] == left[len(left) - n_left]) and (hi == b or window[-1] == right[n_right - 1]):
                    break
            size *= 2
        out = left[: len(left) - n_left]
        out += window
        out += right[n_right:]
        return out

    def _first_point(self, text: str, a: int, cut: int, size: int) -> int | None:
        """The first point within size characters before cut, a if these reach it."""
        if cut - size <= a:
            return a
        m = POINT.search(text, cut - size, cut + 1)
        return m.start() if m and m.start() < cut else None

    def _last_point(self, text: str, cut: int, b: int, size: int) -> int | None:
        """The last point within size characters after cut, b if these reach it."""
        if cut + size >= b:
            return b
        at = None
        for m in POINT.finditer(text, cut + 1, cut + size + 1):
            at = m.start()
        return at

    def _count(self, ids: Iterable[int], piece: str) -> int:
        """How many of the ids the piece has."""
        left, n = len(piece.encode("utf-8", "surrogatepass")), 0
        if left:
            for n, i in enumerate(ids, 1):
                left -= self.length[i]
                if left <= 0:
                    break
        if left:
            raise AssertionError("a token crosses a point")
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


@functools.lru_cache(maxsize=2)
def codec(raw: bytes, pattern: str, leaf: int) -> Codec:
    return Codec(raw, pattern, leaf)


def _run(df: DataFrame, text_col: str, path: str, pattern: str, leaf: int, make, schema: str, id_col: str) -> DataFrame:
    raw = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value, pattern, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield make(c, part.column(0), part.column(1).to_pylist())

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema).withColumnRenamed("doc_id", id_col)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of df: identifier, ids (array of int)."""

    def make(c, keys, texts):
        return pa.RecordBatch.from_arrays([keys, pa.array([c.encode(t or "") for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _run(df, text_col, path, pattern, leaf, make, "doc_id long, ids array<int>", id_col)


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of df: identifier, bytes (binary). Null ids give no bytes."""

    def make(c, keys, rows):
        return pa.RecordBatch.from_arrays([keys, pa.array([c.decode(x or []) for x in rows], pa.binary())], names=["doc_id", "bytes"])

    return _run(df, ids_col, path, pattern, LEAF, make, "doc_id long, bytes binary", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of df: identifier, n_tokens, ids_sha256, decoded_sha256; encoding and decoding in one pass over the texts."""

    def make(c, keys, texts):
        n, ids_sha, text_sha = [], [], []
        for t in texts:
            ids = c.encode(t or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(df, text_col, path, pattern, leaf, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col)
