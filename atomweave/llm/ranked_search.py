r"""Ranked lexical search over a forward index with block-max pruning.

The index. Documents are read in segments of some hundred; within a segment they are ordered by length and cut into ranges
of BLOCK documents. A segment is one row of the index: its distinct terms, how many of its documents hold each, for every block the
greatest impact of each of its terms, and the postings of every document (term, impact). The impact of a term in a document is the part of
its score that doesn't depend on the query, so it is final once N and L are known; a first pass counts these. Building shuffles nothing.

A search takes queries in chunks of bounded size, in four steps over the index:
1. Document frequencies of the chunk's terms, summed in the tasks before they are shuffled.
2. A block's bound for a query is the sum of weight times greatest impact over the query's terms. Bounds need no postings, so only the maxima are
   read; each task keeps the FIRST best blocks of each query, and the best of all tasks remain.
3. These blocks are scored. The k-th best score of a query is its threshold: no document below it can be in the result.
4. All segments: blocks are taken in the order of their bounds and scored from the forward index for the queries whose bound reaches their
   threshold, which rises as better documents are found; once no bound does, the rest of the segment is skipped. Blocks whose bound equals the
   threshold are scored, as an equal score may win by its identifier.
A task holds k results a query; they are merged by a ranked window. Nothing is dropped: a skipped pair of block and query provably has
no result. `search_report` counts what is skipped.

Sums are in doubles where they stay below 2^53 and so are exact, in 64-bit integers otherwise.

Defined results: null or termless texts are in no result and don't count for N; a null query, or one without terms, has no rows; rows that
repeat an identifier are documents of their own, a null identifier comes after all others; each row of the queries is a query of its own, also
if identifiers repeat; texts of any length are counted whole (a segment of one document); an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, removed, text_of, written

K = 20
BLOCK = 8
FIRST = 16
SEGMENT_DOCS = 512
SEGMENT_BYTES = 1 << 20
#: A chunk of queries ends at so many queries, so many bytes of text, or so many (query, term) cells.
CHUNK_QUERIES, CHUNK_BYTES, CHUNK_CELLS = 256, 1 << 22, 1 << 22
#: Row groups of the index, whose size is looked at after every row: rows are a MB or so, and a reader decodes a whole group.
ROW_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

#: The same terms as characters (for Spark) and as UTF-8 bytes: digits, letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SEGMENT = "segment long, terms array<string>, df binary, block_terms binary, block_maxima binary, block_ends binary, ids array<long>, doc_terms binary, doc_impacts binary, doc_ends binary"
FOUND = "query int, doc_id long, score long"


def terms_of(text: str) -> list[bytes]:
    """Terms in order, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(SEPARATED).split()


def length_part(n: int, n_docs: int, total: int) -> int:
    """m of a document of n terms."""
    return 100 - 25 + (25 * n * n_docs) // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def raw(values, kind: str) -> bytes:
    return np.asarray(values, kind).tobytes()


def segment(docs: list[tuple[int, int | None, Counter]], n_docs: int, total: int, number: int, block: int) -> list:
    """Values of a SEGMENT row from (length, identifier, terms) of documents."""
    docs.sort(key=lambda d: d[0])
    sizes = np.array([len(d[2]) for d in docs], np.int64)
    terms = pa.array([t for d in docs for t in d[2]], pa.binary()).dictionary_encode()
    term = terms.indices.to_numpy().astype(np.int64)
    tf = np.array([x for d in docs for x in d[2].values()], np.int64)
    own = impact(tf, np.repeat(np.array([length_part(d[0], n_docs, total) for d in docs], np.int64), sizes))
    width = len(terms.dictionary)
    key = np.repeat(np.arange(len(docs)) // block, sizes) * width + term
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
    which = key[order][start]
    ends = np.searchsorted(which // width, np.arange(-(-len(docs) // block)), side="right")
    return [number, terms.dictionary.cast(pa.string()).to_pylist(), raw(np.bincount(term, minlength=width), "<i4"), raw(which % width, "<i4"), raw(np.maximum.reduceat(own[order], start), "<i4"), raw(ends, "<i4"),
            [d[1] for d in docs], raw(term, "<i4"), raw(own, "<i4"), raw(np.cumsum(sizes), "<i8")]


@dataclass
class Index:
    """segments: SEGMENT rows in the shared folder at path; n_docs: N; total: L; block: documents a block."""

    segments: DataFrame
    path: str
    n_docs: int
    total: int
    block: int


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, segment_docs: int = SEGMENT_DOCS) -> Index:
    """The forward index of all documents, over all their terms."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [len(terms_of(t.as_py() or "")) for batch in batches for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["n", "total"])

    whole = texts.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n_docs, total = whole[0] or 0, whole[1] or 0
    arrow = pa.schema([("segment", pa.int64()), ("terms", pa.list_(pa.string())), *((c, pa.binary()) for c in ("df", "block_terms", "block_maxima", "block_ends")), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("doc_terms", "doc_impacts", "doc_ends"))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(segment(held, n_docs, total, number, block), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms_of(text.as_py() or "")
                if not words:
                    continue
                held.append((len(words), key.as_py(), Counter(words)))
                size += len(words) * 8
                if len(held) >= segment_docs or size >= SEGMENT_BYTES:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    segments = texts.mapInArrow(each, SEGMENT)
    return Index(*written(segments, "forward-index", **ROW_GROUPS), n_docs, total, block)


class Queries:
    """A chunk of queries: their terms as columns of weights."""

    def __init__(self, counts: list[Counter]):
        self.counts = counts
        self.terms = sorted({t for c in counts for t in c})
        self.values = pa.array([t.decode("utf-8", "surrogatepass") for t in self.terms], pa.string())
        self.weights: np.ndarray | None = None

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        """Weights from the document frequency of each term, by its place."""
        place = {t: k for k, t in enumerate(self.terms)}
        w = [weight(df.get(k, 0), n_docs) for k in range(len(self.terms))]
        most = max((sum(n * w[place[t]] for t, n in c.items()) for c in self.counts), default=0)
        self.weights = np.zeros((len(self.terms), len(self.counts)), np.float64 if most * 1_000_000 < 2**53 else np.int64)
        for q, c in enumerate(self.counts):
            for t, n in c.items():
                self.weights[place[t], q] = n * w[place[t]]


class Segment:
    """A row of the index, seen by a chunk of queries: only its terms that they hold."""

    def __init__(self, q: Queries, row: dict):
        self.q, self.row = q, row
        found = pc.index_in(row["terms"].values, value_set=q.values)
        at = found.fill_null(-1).to_numpy(zero_copy_only=False)
        here = np.flatnonzero(at >= 0)
        self.at, self.place = at[here], np.full(len(at), -1)  # of the segment's term: its row in weights, or -1
        self.place[here] = np.arange(len(here))
        self.here = here
        self.weights = None if q.weights is None else q.weights[self.at]

    def array(self, name: str, kind: str = "<i4") -> np.ndarray:
        return np.frombuffer(self.row[name].as_buffer(), kind)

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        return self.at, self.array("df")[self.here]

    def rows(self, terms: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Matrix of rows (blocks or documents) by the terms that are here."""
        own = self.place[terms]
        some = own >= 0
        which = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[some]
        out = np.zeros((len(ends), len(self.here)), self.weights.dtype)
        out[which, own[some]] = values[some]
        return out

    def bounds(self) -> np.ndarray:
        """Blocks by queries."""
        return self.rows(self.array("block_terms"), self.array("block_maxima"), self.array("block_ends")) @ self.weights

    def scores(self, block: int, width: int, queries: np.ndarray) -> tuple[int, np.ndarray]:
        """(first document, documents by queries) of a block."""
        ends = self.array("doc_ends", "<i8")
        a, b = block * width, min((block + 1) * width, len(ends))
        lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
        term, value = self.array("doc_terms")[lo:hi], self.array("doc_impacts")[lo:hi]
        own = self.place[term]
        used = np.unique(own[own >= 0])
        narrow = np.full(len(self.here) + 1, -1)
        narrow[used] = np.arange(len(used))
        own = narrow[own]  # -1 stays -1
        some = own >= 0
        m = np.zeros((b - a, len(used)), self.weights.dtype)
        m[np.repeat(np.arange(b - a), np.diff(ends[a:b], prepend=lo))[some], own[some]] = value[some]
        return a, m @ self.weights[np.ix_(used, queries)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}


class Best:
    """The k best (score, identifier) of each query, equal scores by ascending identifier, null last."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.least, self.k, self.heaps = np.maximum(thresholds, 1), k, [[] for _ in thresholds]

    def offer(self, query: int, doc: int | None, score: int) -> None:
        heap, entry = self.heaps[query], (score, doc is not None, -(doc or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[query] = max(self.least[query], heap[0][0])

    def batch(self) -> pa.RecordBatch:
        got = [(q, -i if known else None, s) for q, h in enumerate(self.heaps) for s, known, i in h]
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=["query", "doc_id", "score"])


def score_segment(s: Segment, width: int, best: Best, bounds: np.ndarray) -> tuple[int, int]:
    """Offers the documents of blocks whose bound (blocks by queries) reaches the threshold; (blocks scored, pairs of block and query scored)."""
    ids, n_blocks, n_pairs = None, 0, 0
    for block in np.argsort(-(bounds - best.least).max(1), kind="stable").tolist():
        queries = np.flatnonzero(bounds[block] >= best.least)
        if not len(queries):
            continue  # thresholds only rise; a later block may still reach another query's
        if ids is None:
            ids = s.row["ids"].as_py()
        first, scores = s.scores(block, width, queries)
        n_blocks, n_pairs = n_blocks + 1, n_pairs + len(queries)
        for d, q in zip(*(x.tolist() for x in np.nonzero(scores >= best.least[queries])), strict=True):
            best.offer(int(queries[q]), ids[first + d], int(scores[d, q]))
    return n_blocks, n_pairs


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def thresholds(index: Index, q: Queries, k: int, first: int = FIRST) -> np.ndarray:
    """Weights q by the index's document frequencies, and gives each query the k-th best score within its first best blocks (0 if these have fewer documents)."""
    sc, width = index.segments.sparkSession.sparkContext, index.block
    shared = sc.broadcast(q)  # at most CHUNK_CELLS weights

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.terms), np.int64)
        for row in rows_of(batches):
            at, n = Segment(shared.value, row).frequencies()
            total[at] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "n"])

    df = index.segments.select("terms", "df").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the chunk's terms
    q.weigh({r.term: r.n for r in df}, index.n_docs)
    shared = sc.broadcast(q)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [[] for _ in shared.value.counts]
        for row in rows_of(batches):
            b = Segment(shared.value, row).bounds()
            least = np.array([h[0][0] if len(h) == first else 0 for h in heaps])
            for block, query in zip(*(x.tolist() for x in np.nonzero(b > least)), strict=True):
                entry, h = (int(b[block, query]), row["segment"].as_py(), block), heaps[query]
                if len(h) < first:
                    heapq.heappush(h, entry)
                elif entry > h[0]:
                    heapq.heapreplace(h, entry)
        got = [(k, *e) for k, h in enumerate(heaps) for e in h]
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32()))], names=["query", "bound", "segment", "block"])

    order = Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "block")
    chosen = index.segments.select("segment", "terms", "block_terms", "block_maxima", "block_ends").mapInArrow(bound, "query int, bound long, segment long, block int")
    chosen = chosen.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= first).select("query", "segment", "block").collect()  # FIRST a query
    by_segment: dict[int, dict[int, list[int]]] = {}
    for r in chosen:
        by_segment.setdefault(r.segment, {}).setdefault(r.block, []).append(r.query)
    wanted = sc.broadcast(by_segment)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(np.zeros(len(shared.value.counts), np.int64), k)
        for row in rows_of(batches):
            s = Segment(shared.value, row)
            for block, queries in wanted.value[row["segment"].as_py()].items():
                _, scores = s.scores(block, width, np.array(queries))
                for d, at in zip(*(x.tolist() for x in np.nonzero(scores > 0)), strict=True):
                    best.offer(queries[at], 0, int(scores[d, at]))
        yield best.batch()

    some = index.segments.filter(F.col("segment").isin(list(by_segment)))  # at most FIRST a query
    kth = _ranked(some.select("segment", "terms", "doc_terms", "doc_impacts", "doc_ends").mapInArrow(score, FOUND), k).filter(F.col("rank") == k).collect()
    out = np.zeros(len(q.counts), np.int64)
    for r in kth:
        out[r["query"]] = r["score"]
    return out


def chunks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, Queries]]:
    """Queries with terms, in chunks: (identifiers, Queries). They pass through the driver a chunk at a time."""
    ids, counts, size, terms = [], [], 0, set()
    for r in queries.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).toLocalIterator():
        c = Counter(terms_of(r["text"]))
        if not c:
            continue
        if counts and (len(counts) == CHUNK_QUERIES or size + len(r["text"]) > CHUNK_BYTES or len(terms | c.keys()) * (len(counts) + 1) > CHUNK_CELLS):
            yield ids, Queries(counts)
            ids, counts, size, terms = [], [], 0, set()
        ids.append(r["id"])
        counts.append(c)
        terms |= c.keys()
        size += len(r["text"])
    if counts:
        yield ids, Queries(counts)


def search(index: Index, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query with a score above 0: identifier of the query, rank (from 1), doc_id, score."""
    width = index.block
    spark, kind = index.segments.sparkSession, queries.schema[id_col].dataType
    out = spark.createDataFrame([], "rank int, doc_id long, score long").withColumn(id_col, F.lit(None).cast(kind)).select(id_col, "rank", "doc_id", "score")
    for ids, q in chunks(queries, id_col, text_col) if index.n_docs else ():
        shared = spark.sparkContext.broadcast((thresholds(index, q, k), q))

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            least, q = shared.value
            best = Best(least, k)
            for row in rows_of(batches):
                s = Segment(q, row)
                score_segment(s, width, best, s.bounds())
            yield best.batch()

        names = spark.createDataFrame(list(enumerate(ids)), f"query int, `{id_col}` {kind.simpleString()}")  # CHUNK_QUERIES rows at most
        ranked = _ranked(index.segments.drop("df").mapInArrow(each, FOUND), k)
        out = out.unionByName(checkpointed(ranked.join(F.broadcast(names), "query").select(id_col, "rank", "doc_id", "score")))
    return out


def search_report(index: Index, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row a chunk of queries: blocks, blocks scored, pairs of block and query, pairs whose bound is above 0, pairs scored."""
    out, width = None, index.block
    for _, q in chunks(queries, id_col, text_col):
        shared = index.segments.sparkSession.sparkContext.broadcast((thresholds(index, q, k), q))

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            least, q = shared.value
            best, sums = Best(least, k), np.zeros(5, np.int64)
            for row in rows_of(batches):
                s = Segment(q, row)
                b = s.bounds()
                done = score_segment(s, width, best, b)
                sums += [len(b), done[0], b.size, (b > 0).sum(), done[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums.tolist()], names=names)

        names = ["blocks", "blocks_scored", "pairs", "pairs_above_0", "pairs_scored"]
        one = index.segments.drop("df").mapInArrow(each, ", ".join(f"{n} long" for n in names)).agg(*[F.sum(n).alias(n) for n in names])
        out = one if out is None else out.union(one)
    return out


def rank(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Index docs (doc_id, text), search queries (item_id, text), and delete the index."""
    index = build(docs)
    found = search(index, queries, k)
    removed(docs.sparkSession, index.path)
    return found
