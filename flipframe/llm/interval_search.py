"""Ranked lexical search by best-first document intervals over range-maximum tables.

The documents are cut into segments of bounded size, each in id order, with one posting list per
term (places of the documents in the segment and term counts).  In a segment every posting list
gets a sparse table of range maxima over its impacts.  A query starts with the interval of all
documents; an interval's bound is the sum over its terms of the list's maximum impact inside the
interval, two table lookups each.  The intervals of highest bound are taken first and split at the
document with the greatest single impact, whose exact score is computed on the way; what remains left and right gets
bounds of its own.  Intervals whose bound can't reach the k-th best score found so far are
dropped, so the search ends with exactly the best k documents.

A task keeps each query's k best scores over all segments that it has seen, and so starts later
segments with a threshold.  Only posting lists of terms that occur in a query are kept, by a bitmap
of term hashes of fixed size (false positives are removed by a join), so nothing that is sent to the tasks
grows with the data.

Rows with null text, or none but separators, count for nothing.  Documents that repeat an id are ranked as
documents of their own; queries that repeat an id are answered one by one.  Equal scores go by
ascending id (null first).  An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flipframe.llm.common import ascii_words, ready, written
from flipframe.session import shuffle_partitions

SEGMENT_TERMS = 1 << 21  # term occurrences of a segment; a longer document is a segment of its own
SEGMENT_DOCS = 1 << 15
BITMAP = 1 << 24  # bits of the query-term bitmap (2 MB)
TAKE = 64  # intervals split at a time
QUERY_BLOCK = 512  # queries that visit a segment together


def _bits(words: list[bytes]) -> np.ndarray:
    """Place of each term in the bitmap, as Spark's xxhash64 gives it."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)) & np.uint64(BITMAP - 1)


def _query_terms(queries: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """One row per query: q (its number), block (``block`` queries of a partition), id and its
    distinct terms; queries without terms go."""
    spec = T.StructType([T.StructField("item", queries.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(ascii_words(t.as_py().encode()))) if t.is_valid else [] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[w.decode() for w in ws] for ws in terms], pa.list_(pa.string()))], names=["item", "terms"]
            )

    src = queries.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    # the upper bits of q are the partition, the lower 33 the place in it
    return src.mapInArrow(run, spec).where(F.size("terms") > 0).withColumn("q", F.monotonically_increasing_id()).withColumn("block", F.expr(f"q div {block}"))


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Bitmap of the term hashes, gathered as at most BITMAP / 64 words."""
    at = F.xxhash64("term").bitwiseAND(F.lit(BITMAP - 1))
    words = terms.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
    out = np.zeros(BITMAP // 64, np.int64)
    for r in words.collect():
        out[r.w] = r.m
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


class _Segment:
    """Documents gathered by a task until the segment is full."""

    def __init__(self):
        self.vocab: defaultdict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.docs, self.ids, self.size = [], [], 0

    def add(self, ident, words: list[bytes]) -> None:
        self.docs.append(np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words)))
        self.ids.append(ident)
        self.size += len(words)

    def rows(self, name: int, id_type: pa.DataType, wanted: np.ndarray | None) -> pa.RecordBatch:
        """One row of document ids and lengths (null term), then one per term."""
        ids = pa.array(self.ids, id_type)
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        docs = [self.docs[k] for k in order]
        lengths = np.array([len(d) for d in docs], np.int64)
        terms = list(self.vocab)
        keep = np.ones(len(terms), bool) if wanted is None else wanted[_bits(terms)]
        number = np.cumsum(keep) - 1
        term = np.concatenate(docs)
        place = np.repeat(np.arange(len(docs), dtype=np.int64), lengths)
        sel = keep[term]
        key, count = np.unique((number[term[sel]] << 32) | place[sel], return_counts=True)
        n = int(keep.sum())
        cut = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << 32)
        size = np.diff(cut)

        def blobs(values: np.ndarray, head: bytes) -> pa.Array:
            ends = np.concatenate([[0, len(head)], len(head) + 4 * cut[1:]]).astype(np.int64)
            return pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), n + 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(head + values.astype("<i4").tobytes())]
            ).cast(pa.binary())

        id_list = pa.ListArray.from_arrays(pa.array([0, len(docs)] + [len(docs)] * n, pa.int32()), ids.take(pa.array(order)))
        names = [None, *[w.decode() for w, k in zip(terms, keep) if k]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, name)), pa.array(names, pa.string()), pa.array(np.concatenate([[len(docs)], size])),
                pa.array(np.concatenate([[lengths.sum()], np.add.reduceat(np.append(count, 0), cut[:-1]) if n else []]).astype(np.int64)),
                blobs(key & 0xFFFFFFFF, b""), blobs(count, lengths.astype("<i4").tobytes()), id_list,
            ],
            names=["segment", "term", "df", "cf", "places", "counts", "ids"],
        )


def posting_segments(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray | None = None,
                     segment_terms: int = SEGMENT_TERMS, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The index: for each segment one row (term null; df: documents; cf: their terms; counts: their
    lengths; ids) and one row per term (df, cf, and as 32-bit integers the places of its documents
    and its counts there).

    ``wanted`` is a bitmap of term hashes that limits the terms.  One narrow pass.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    spec = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
        T.StructField("cf", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)),
    ])
    sent = None if wanted is None else spark.sparkContext.broadcast(np.packbits(wanted))  # BITMAP bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        bits = None if sent is None else np.unpackbits(sent.value).astype(bool)
        kind = to_arrow_type(id_type)
        first = TaskContext.get().partitionId() << 32
        made, seg = 0, _Segment()
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = ascii_words(text.as_buffer().to_pybytes() if text.is_valid else None)
                if not words:
                    continue
                if seg.size and (seg.size + len(words) > segment_terms or len(seg.docs) >= segment_docs):
                    yield seg.rows(first + made, kind, bits)
                    made, seg = made + 1, _Segment()
                seg.add(ident, words)
        if seg.size:
            yield seg.rows(first + made, kind, bits)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, spec)


class RangeMaxima:
    """Sparse tables of range maxima over joined posting lists.

    ``lists`` holds the places of all lists, one after the other; ``value`` the impact of each
    posting.  Level j answers ranges of 2**j postings; a range lies inside one list, so tables may
    run across list borders.
    """

    def __init__(self, value: np.ndarray, longest: int):
        self.value = value
        self.levels = [np.arange(len(value), dtype=np.int32)]
        half = 1
        while 2 * half <= longest:
            prev = self.levels[-1]
            a, b = prev[:-half], prev[half:]
            self.levels.append(np.where(value[a] >= value[b], a, b))
            half *= 2
        size = len(value)
        self.table = np.zeros((len(self.levels), size), np.int32)
        for j, level in enumerate(self.levels):
            self.table[j, : len(level)] = level
        self.log = np.zeros(longest + 2, np.int8)
        for k in range(2, longest + 2):
            self.log[k] = self.log[k >> 1] + 1

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Position of the maximum of each non-empty range [a, b)."""
        j = self.log[b - a]
        x, y = self.table[j, a], self.table[j, b - (1 << j.astype(np.int64))]
        return np.where(self.value[x] >= self.value[y], x, y)


def best_documents(maxima: RangeMaxima, key: np.ndarray, span: int, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray,
                   n_docs: int, k: int, floor: int = 1, take: int = TAKE) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the ``k`` best documents of a segment with a score of at least
    ``floor``, best first, equal scores by place; and the number of documents scored.

    ``key`` is list number * ``span`` + place for all postings; ``starts``, ``ends`` and
    ``weights`` describe the query's lists, ``starts`` in ascending order.
    """
    base = key[starts] // span * span
    lo, hi = np.array([0]), np.array([n_docs])
    a, b = starts[None], ends[None]
    found_s, found_d = np.empty(0, np.int64), np.empty(0, np.int64)

    def bounds(a, b):
        full = b > a
        at = maxima.best(np.where(full, a, 0), np.where(full, b, 1))
        impact = np.where(full, maxima.value[at] * weights, 0)
        return impact.sum(axis=1), impact, at

    bound, impact, at = bounds(a, b)
    # the document with the greatest single impact splits the interval
    pivot = key[at[np.arange(len(at)), impact.argmax(axis=1)]] % span
    scored, kth = 0, None
    while True:
        need = floor if kth is None else max(floor, kth[0])
        # an interval that can only tie helps if its places precede the k-th best document's
        live = (bound >= need) if kth is None else (bound > kth[0]) | ((bound == kth[0]) & (lo < kth[1]))
        live &= bound >= need
        if not live.all():
            lo, hi, a, b, bound, pivot = (x[live] for x in (lo, hi, a, b, bound, pivot))
        if not len(lo):
            break
        if len(lo) > take:
            top = np.argpartition(-bound, take)[:take]
            rest = np.ones(len(lo), bool)
            rest[top] = False
            now = tuple(x[top] for x in (lo, hi, a, b, pivot))
            lo, hi, a, b, bound, pivot = (x[rest] for x in (lo, hi, a, b, bound, pivot))
        else:
            now = (lo, hi, a, b, pivot)
            lo, hi, a, b, bound, pivot = (x[:0] for x in (lo, hi, a, b, bound, pivot))
        l, h, x, y, d = now
        cut = np.searchsorted(key, base[None] + d[:, None])
        cut = np.clip(cut, x, y)
        has = (cut < y) & (key[np.minimum(cut, len(key) - 1)] == base[None] + d[:, None])
        score = np.where(has, maxima.value[np.minimum(cut, len(key) - 1)] * weights, 0).sum(axis=1)
        scored += len(score)
        found_s, found_d = np.concatenate([found_s, score]), np.concatenate([found_d, d])
        if len(found_s) >= k:
            order = np.lexsort((found_d, -found_s))[:k]
            found_s, found_d = found_s[order], found_d[order]
            kth = (int(found_s[-1]), int(found_d[-1]))
        cl, ch = np.concatenate([l, d + 1]), np.concatenate([d, h])
        ca, cb = np.concatenate([x, cut + has]), np.concatenate([cut, y])
        some = ch > cl
        cl, ch, ca, cb = cl[some], ch[some], ca[some], cb[some]
        if len(cl):
            cbound, impact, at = bounds(ca, cb)
            cp = key[at[np.arange(len(at)), impact.argmax(axis=1)]] % span
            lo, hi, a, b = np.concatenate([lo, cl]), np.concatenate([hi, ch]), np.concatenate([a, ca]), np.concatenate([b, cb])
            bound, pivot = np.concatenate([bound, cbound]), np.concatenate([pivot, cp])
    order = np.lexsort((found_d, -found_s))
    order = order[found_s[order] >= floor][:k]
    return found_d[order], found_s[order], scored


def _impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of postings without their term's weight, in integers."""
    m = 100 - 90 + 90 * lengths * n_docs // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def _search(k: int, n_docs: int, n_terms: int, id_type):
    """Search of a task's stream: for each (segment, block) a row of documents, then queries, then
    posting lists (kinds 0, 1 and 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind_type = to_arrow_type(id_type)
        seen: dict[int, np.ndarray] = {}  # the k best scores of each query so far, ascending

        def answer(part) -> pa.RecordBatch | None:
            ids, lengths, queries, lists = part
            if ids is None or not lists or not queries:
                return None
            number = {t: j for j, (t, *_rest) in enumerate(lists)}
            weight = np.array([w for _, w, _, _ in lists], np.int64)
            places = [np.frombuffer(p, "<i4") for _, _, p, _ in lists]
            size = np.array([len(p) for p in places])
            end = np.cumsum(size)
            start = end - size
            place = np.concatenate(places).astype(np.int64)
            count = np.concatenate([np.frombuffer(c, "<i4") for *_x, c in lists]).astype(np.int64)
            maxima = RangeMaxima(_impacts(count, lengths[place], n_docs, n_terms), int(size.max()))
            span = len(lengths)
            key = np.repeat(np.arange(len(lists), dtype=np.int64), size) * span + place
            out_q, out_d, out_s = [], [], []
            for q, terms in queries:
                own = np.array(sorted(number[t] for t in terms if t in number), np.int64)
                if not len(own):
                    continue
                best = seen.get(q, np.empty(0, np.int64))
                floor = int(best[0]) if len(best) == k else 1
                d, s, _ = best_documents(maxima, key, span, start[own], end[own], weight[own], span, k, max(1, floor))
                if len(d):
                    seen[q] = np.sort(np.concatenate([best, s]))[-k:]
                    out_q.append(np.full(len(d), q))
                    out_d.append(d)
                    out_s.append(s)
            if not out_q:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_q)), ids.take(pa.array(np.concatenate(out_d))).cast(kind_type), pa.array(np.concatenate(out_s))],
                names=["q", "doc_id", "score"],
            )

        def fresh():
            return [None, None, [], []]

        now, part = None, fresh()
        for batch in batches:
            col = {n: batch.column(j) for j, n in enumerate(batch.schema.names)}
            seg, blk, kinds = (col[c].to_pylist() for c in ("segment", "block", "kind"))
            for r in range(batch.num_rows):
                if (seg[r], blk[r]) != now:
                    done = answer(part)
                    if done is not None:
                        yield done
                    now, part = (seg[r], blk[r]), fresh()
                if kinds[r] == 0:
                    part[0] = col["ids"][r].values
                    part[1] = np.frombuffer(col["counts"][r].as_py(), "<i4").astype(np.int64)
                elif kinds[r] == 1:
                    part[2].append((col["q"][r].as_py(), col["terms"][r].as_py()))
                else:
                    part[3].append((col["term"][r].as_py(), col["weight"][r].as_py(), col["places"][r].as_py(), col["counts"][r].as_py()))
        done = answer(part)
        if done is not None:
            yield done

    return run


def ranked_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                     query_id: str = "item_id", query_text: str = "text", query_block: int = QUERY_BLOCK,
                     segment_terms: int = SEGMENT_TERMS, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The ``k`` best documents of each query: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    ready(spark)
    asked, _ = written(spark, _query_terms(queries, query_id, query_text, query_block), "search-queries")
    pairs = asked.select("block", F.explode("terms").alias("term")).distinct()
    pairs, _ = written(spark, pairs, "search-terms")
    index, _ = written(
        spark, posting_segments(docs, id_col, text_col, _bitmap(pairs.select("term").distinct()), segment_terms, segment_docs), "search-index"
    )
    heads = index.where(F.col("term").isNull())
    total = heads.agg(F.sum("df"), F.sum("cf")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    lists = index.where(F.col("term").isNotNull()).join(pairs.select("term").distinct(), "term", "left_semi")
    seen = lists.groupBy("term").agg(F.sum("df").alias("n"))
    # both in double precision; the fraction exceeds 1, so no weight is negative
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("n") + 1))).cast("long")
    weights = pairs.join(seen.select("term", weight.alias("weight")), "term")
    none = lambda t: F.lit(None).cast(t)
    id_type = docs.schema[id_col].dataType
    blocks = asked.select("block").distinct()
    at = heads.select("segment").crossJoin(F.broadcast(blocks))  # the query set visits every segment, in blocks
    stream = (
        at.join(heads.select("segment", "counts", "ids"), "segment")
        .select("segment", "block", F.lit(0).alias("kind"), none("string").alias("term"), none("long").alias("weight"), none("binary").alias("places"),
                "counts", "ids", none("long").alias("q"), none("array<string>").alias("terms"))
        .unionByName(at.join(asked, "block").select("segment", "block", F.lit(1).alias("kind"), "q", "terms"), allowMissingColumns=True)
        .unionByName(lists.join(weights, "term").select("segment", "block", F.lit(2).alias("kind"), "term", "weight", "places", "counts"), allowMissingColumns=True)
    )
    spread = stream.repartition(shuffle_partitions(spark), "segment", "block").sortWithinPartitions("block", "segment", "kind")
    spec = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    found, _ = written(spark, spread.mapInArrow(_search(k, int(n_docs), int(n_terms), id_type), spec), "search-found")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("doc_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(asked.select("q", "item"), "q").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
