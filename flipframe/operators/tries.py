"""Counts of every gram of a corpus, brought together as compressed tries.

A gram is numbered from its end: its last two words, then one more word to the left at each level.  A task
counts a lot of tokens at a time with NumPy and sends each part of the word pairs one blob: per level one word and the number of children of each entry, packed by zstd.
All grams that end in a pair meet in its part, so this one exchange serves every order above pairs, at less than a
third of the bytes of the grams as strings.  The words themselves are compared, never hashes; a hash of a pair only
chooses its part.

Words that are likely to be frequent are listed once for all tasks, and a blob holds only its other words.  The list
comes from a share of the texts; what it holds changes the bytes of the blobs, never a count.

A part whose grams are too many for the memory is unpacked a slice of its third words at a time, so only
its packed blobs must fit, however frequent a pair is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipframe.functions.text import word_tokens
from flipframe.session import scratch_table, ship_package, shuffle_partitions, shuffles_dropped, spread

LOT_TOKENS = 1 << 20  # tokens counted together before they are sent; one longer text is a lot of its own
SLICE_GRAMS = 1 << 19  # grams unpacked together
LISTED, LISTED_FROM = 1 << 16, 16  # frequent words that are listed, and one of how many texts they are counted in
OUT_ROWS = 1 << 16


def _starts(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens)])


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(lengths of the texts, their tokens) of up to ``LOT_TOKENS`` at a time."""
    lens, toks, held = [], [], 0
    for batch in batches:
        col = batch.column("t")
        n = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        at, flat, lo = _starts(n), col.flatten(), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + LOT_TOKENS - held, side="right")) - 1)
            lens.append(n[lo:hi])
            toks.append(flat.slice(at[lo], at[hi] - at[lo]))
            held += int(at[hi] - at[lo])
            lo = hi
            if held >= LOT_TOKENS or lo < len(n):
                yield np.concatenate(lens), pa.chunked_array(toks).combine_chunks()
                lens, toks, held = [], [], 0
    if lens:
        yield np.concatenate(lens), pa.chunked_array(toks).combine_chunks()


def _merge(pairs: np.ndarray, above: list, c: np.ndarray, words: int, part=None):
    """Equal grams made one: the pairs in order, per level (word, parent) in order of the parents, and the counts.

    ``above`` has (word, parent) per level, parent being a place in the level below."""
    pairs, rank = np.unique(pairs, return_inverse=True)
    if part is not None:  # pairs of one part lie together
        order = np.argsort(part(pairs), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs, rank = pairs[order], place[rank]
    out = []
    for word, parent in above:
        key, rank = np.unique((rank if parent is None else rank[parent]) * words + word, return_inverse=True)
        out.append((key % words, key // words))
    return pairs, out, np.bincount(rank, c, len(out[-1][0])).astype(np.int64)


def _pack(words: pa.Array, arrays: list[np.ndarray]) -> bytes:
    """Sizes, words and arrays; the bytes of equal weight of an array lie together, as most of them are zero."""
    text = b" ".join(words.cast(pa.binary()).to_pylist())
    ints = b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    packed = [pa.compress(x, codec="zstd", asbytes=True) for x in (text, ints)]
    return np.array([len(arrays), len(text), len(packed[0]), *map(len, arrays)], "<i8").tobytes() + b"".join(packed)


def _sizes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8", 3 + int.from_bytes(blob[:8], "little"))


def _words(blob: bytes) -> pa.Array:
    n = _sizes(blob)
    text = pa.decompress(blob[8 * len(n) : 8 * len(n) + n[2]], decompressed_size=int(n[1]), codec="zstd", asbytes=True)
    return pc.split_pattern(pa.array([text.decode()] if text else [], pa.string()), " ").flatten()


def _arrays(blob: bytes) -> list[np.ndarray]:
    n = _sizes(blob)
    at = 4 * _starts(n[3:])
    ints = pa.decompress(blob[8 * len(n) + n[2] :], decompressed_size=int(at[-1]), codec="zstd", asbytes=True)
    return [np.frombuffer(ints, np.uint8, hi - lo, lo).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int32) for lo, hi in zip(at[:-1], at[1:])]


def _blobs(lens: np.ndarray, tokens: pa.Array, order: int, parts: int, listed: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """(part, grams, blob) of a lot; ``listed`` begins with the start and the end token."""
    coded, lists = tokens.dictionary_encode(), len(listed)
    codes, at = coded.indices.to_numpy(zero_copy_only=False), pc.index_in(coded.dictionary, value_set=listed)
    # other words: frequent ones first, as small numbers pack well, and those of one count in order, as alike ones do
    seen = np.bincount(codes, minlength=len(coded.dictionary))
    other = pc.sort_indices(coded.dictionary).to_numpy()
    other = other[at.is_null().to_numpy(zero_copy_only=False)[other]]
    other = other[np.argsort(-seen[other], kind="stable")]
    code = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code[other] = np.arange(lists, lists + len(other))
    rare = coded.dictionary.take(pa.array(other))
    words = lists + len(rare)
    padded = np.zeros(int(lens.sum()) + len(lens) * order, np.int32)
    begin = _starts(lens + order)[:-1]
    padded[np.arange(len(tokens)) + np.repeat(np.arange(len(lens)) * order + order - 1, lens)] = code[codes]
    padded[begin + order - 1 + lens] = 1
    ends = np.ones(len(padded), bool)
    for k in range(order - 1):
        ends[begin + k] = False
    last = np.flatnonzero(ends)
    mark = np.array([zlib.crc32(w) for x in (listed, rare) for w in x.cast(pa.binary()).to_pylist()], np.int64)
    part = lambda key: (mark[key // words] * 31 + mark[key % words]) % 1000003 % parts
    pairs, levels, c = _merge(padded[last - 1].astype(np.int64) * words + padded[last], [(padded[last - k], None) for k in range(2, order)], np.ones(len(last)), words, part)
    own = part(pairs)
    bounds = [np.searchsorted(own, np.arange(parts + 1))]
    for _, parent in levels:
        bounds.append(np.searchsorted(parent, bounds[-1]))
    for p in np.unique(own).tolist():
        cuts = [slice(b[p], b[p + 1]) for b in bounds]
        named = [pairs[cuts[0]] // words, pairs[cuts[0]] % words, *[w[at] for (w, _), at in zip(levels, cuts[1:])]]
        children = [np.bincount(parent[at] - below.start, minlength=below.stop - below.start) for (_, parent), at, below in zip(levels, cuts[1:], cuts)]
        used = np.zeros(words, bool)
        for x in named:
            used[x] = True
        code = np.concatenate([np.arange(lists), lists - 1 + np.cumsum(used[lists:])])
        first, *others = [code[x] for x in named]
        yield p, len(named[-1]), _pack(rare.filter(pa.array(used[lists:])), [np.diff(first, prepend=0), *others, *children, c[cuts[-1]]])


def _unpacked(blobs: list[bytes], codes: Iterator[np.ndarray], words: int, order: int, k: int, of: int):
    """The tries of a part one after the other, without the entries of other slices than ``k``."""
    pairs, above, cs, offsets = [], [[] for _ in range(order - 2)], [], [0] * (order - 1)
    for blob, code in zip(blobs, codes):
        a = _arrays(blob)
        pairs.append(code[np.cumsum(a[0])].astype(np.int64) * words + code[a[1]])
        place = np.arange(len(a[0]), dtype=np.int32)  # of an entry among those kept, or -1
        kept = len(place)
        for level in range(order - 2):
            word, parent = code[a[2 + level]], np.repeat(place, a[order + level])
            here = parent >= 0 if level or of == 1 else word % of == k
            above[level].append((word[here], parent[here] + np.int32(offsets[level])))
            offsets[level] += kept
            place, kept = np.where(here, np.cumsum(here, dtype=np.int32) - 1, np.int32(-1)), int(here.sum())
        cs.append(a[-1][place >= 0])
    return np.concatenate(pairs), [tuple(np.concatenate(x) for x in zip(*rows)) for rows in above], np.concatenate(cs)


def _counted(blobs: list[bytes], grams: int, order: int, listed: pa.Array) -> Iterator[pa.RecordBatch]:
    """The pairs of a part."""
    rare = [_words(b) for b in blobs]
    coded = pa.chunked_array(rare, pa.string()).combine_chunks().dictionary_encode()
    names = pa.concat_arrays([listed, coded.dictionary])
    words, lists = len(names), np.arange(len(listed), dtype=np.int32)
    at, other = _starts(np.array([len(x) for x in rare])), coded.indices.to_numpy(zero_copy_only=False) + np.int32(len(lists))
    del rare, coded
    codes = lambda: (np.concatenate([lists, other[lo:hi]]) for lo, hi in zip(at[:-1], at[1:]))  # noqa: E731  by blob
    of, found, tally = 1 + grams // SLICE_GRAMS, [], np.zeros((order - 2, 2), np.int64)
    for k in range(of):
        pairs, levels, c = _merge(*_unpacked(blobs, codes(), words, order, k, of), words)
        for level in range(order - 3, -1, -1):  # of order level + 3
            tally[level] += [(c == 1).sum(), (c == 2).sum()]
            c = np.bincount(levels[level][1], minlength=len(levels[level - 1][0] if level else pairs))
        found.append((pairs[c > 0], c[c > 0]))
        del pairs, levels, c
        pa.default_memory_pool().release_unused()
    pairs, rank = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    c = np.bincount(rank, np.concatenate([c for _, c in found])).astype(np.int64)
    for lo in range(0, len(pairs), OUT_ROWS):
        some = pairs[lo : lo + OUT_ROWS]
        gram = pc.binary_join_element_wise(names.take(pa.array(some // words)), names.take(pa.array(some % words)), " ")
        tallies = [np.where(np.arange(lo, lo + len(some)) == 0, tally[level][n], 0) for level in range(order - 3, -1, -1) for n in range(2)]
        yield pa.RecordBatch.from_arrays([gram, *map(pa.array, [c[lo : lo + OUT_ROWS], *tallies])], names=["gram", "c", *tallied(order)])


def tallied(order: int) -> list[str]:
    return [f"{name}{k}" for k in range(order, 2, -1) for name in ("one", "two")]


def _frequent(texts: DataFrame, words: Column) -> list[str]:
    """The words that occur at least as often, and twice, as the smallest count for which they are no more than ``LISTED``."""
    counts = texts.select(F.explode(words).alias("w")).groupBy("w").count().where(F.col("count") > 1)
    with shuffles_dropped(texts.sparkSession):
        counts = scratch_table(counts, "frequent-words")
    least, n = 0, 0
    for r in sorted(counts.groupBy(F.least("count", F.lit(LISTED)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        n += r.n
        if n > LISTED:
            break
        least = r.c
    found = counts.where(F.col("count") >= least).collect() if least else []
    return [r.w for r in sorted(found, key=lambda r: (-r["count"], r.w))]


def tail_pairs(texts: DataFrame, text_col: str, order: int, start: str, end: str) -> DataFrame:
    """(gram, c, one.., two..): every word pair that ends a gram of ``order`` tokens (above 2) with the number of
    distinct three-word grams that end in it, and per order above 2 how many grams count once and twice; these
    are sums of a task, on the first of its rows.

    A gram below ``order`` counts the distinct grams one longer that end in it.  Null texts are left out."""
    spark = texts.sparkSession
    ship_package(spark)
    parts = shuffle_partitions(spark)
    rows = spread(texts.select(text_col)).where(F.col(text_col).isNotNull())
    words = word_tokens(text_col)
    listed = spark.sparkContext.broadcast([start, end, *_frequent(rows.where(F.pmod(F.xxhash64(text_col), F.lit(LISTED_FROM)) == 0), words)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(listed.value, pa.string())
        for lens, tokens in _lots(batches):
            for p, n, blob in _blobs(lens, tokens, order, parts, names):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["part", "n", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, n = [], 0
        for batch in batches:
            blobs += batch.column("blob").to_pylist()
            n += pc.sum(batch.column("n")).as_py() or 0
        if blobs:
            yield from _counted(blobs, n, order, pa.array(listed.value, pa.string()))

    dealt = rows.select(words.alias("t")).mapInArrow(pack, "part int, n long, blob binary").repartitionById(parts, "part")
    return dealt.mapInArrow(count, "gram string, c long, " + ", ".join(f"{x} long" for x in tallied(order)))
