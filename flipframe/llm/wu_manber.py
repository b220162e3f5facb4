"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark texts.  A shift table over blocks of three
words tells how far the search may jump: a block that ends no window prefix lets it skip most of
a window's length.  Where the shift is 0, the block selects a bucket of windows (split by their
first word) and a direct comparison of all words confirms each occurrence.

Words: ``common.ascii_words``.  A window is ``width`` consecutive words of one item; an item of
fewer words, but at least one, is one window.  Null or wordless items and documents have none.
Repeated items count once per item_id; repeated documents are judged one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipframe.llm.common import ascii_words, free_name, ready, scan_texts, written
from flipframe.operators.positions import in_ranges, running_totals

WIDTH = 10
#: UTF-8 bytes of benchmark text that one broadcast carries, beside its last item; a larger benchmark is
#: searched for in several blocks, one narrow pass each.
BLOCK_BYTES = 2 << 20


class WuManber:
    """Occurrences of equal-length word patterns in a word list."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], block: int = 3):
        self.m = len(next(iter(patterns)))
        self.b = min(block, self.m)
        self.default = self.m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.b, self.m + 1):
                key = p[end - self.b : end]
                self.shift[key] = min(self.shift.get(key, self.default), self.m - end)
            self.buckets[p[-self.b :]][p[0]].append((list(p), tuple(items)))

    def find(self, words: list[bytes]):
        """Yield (start, items) for every place where a pattern occurs."""
        m, b, default, n = self.m, self.b, self.default, len(words)
        shift, buckets = self.shift.get, self.buckets
        i = m
        while i <= n:
            key = tuple(words[i - b : i])
            s = shift(key, default)
            if s:
                i += s
                continue
            at = i - m
            for pattern, items in buckets[key].get(words[at], ()):
                if words[at:i] == pattern:
                    yield at, items
            i += 1


def windows(items: Sequence[tuple[str, bytes | None]], width: int) -> list[WuManber]:
    """One searcher per window length: ``width``, and the shorter lengths of short items."""
    by_len: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = ascii_words(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            by_len[k][tuple(w[i : i + k])].add(item)
    return [WuManber(p) for _, p in sorted(by_len.items())]


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def search(words: list[bytes], searchers: Sequence[WuManber]) -> tuple[list[dict[str, int]], list[str]]:
    """Disjoint covered spans of words, in order, and the item ids that occur."""
    found, items = [], set()
    for s in searchers:
        for at, who in s.find(words):
            items.update(who)
            if found and at <= found[-1][1] and at >= found[-1][0]:
                found[-1][1] = max(found[-1][1], at + s.m)
            else:
                found.append([at, at + s.m])
    spans: list[dict[str, int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], b)
        else:
            spans.append({"start": a, "end": b})
    return spans, sorted(items)


_BUILT: dict[str, list[WuManber]] = {}  # one entry: the block this Python worker last searched for


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in groups that begin at most ``block_bytes`` apart on their byte line, largest items
    first: total / ``block_bytes`` + 1 groups at most, each of ``block_bytes`` and its last item.  One
    group at a time is on the driver.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text")
    ).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        groups = [items]
    else:
        order = [F.desc("size"), "item", "text"]
        sized = in_ranges(items.withColumn("size", F.octet_length("text").cast("long")), order)
        placed = running_totals(sized, order, F.col("size"), "begin").withColumn("block", F.expr(f"begin div {block_bytes}"))
        placed, _ = written(benchmark.sparkSession, placed, "benchmark-blocks")
        numbers = sorted(r.block for r in placed.select("block").distinct().collect())
        groups = [placed.where(F.col("block") == b) for b in numbers]
    for g in groups:
        yield [(r.item, bytes(r.text)) for r in g.select("item", "text").collect()]


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text",
                 keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """Add a struct column (n_words, spans, items) to every document in narrow passes.

    The spans are the covered word ranges, disjoint and in order; items are sorted as strings.
    """
    spark = docs.sparkSession
    ready(spark)
    keep = list(docs.columns) if keep is None else keep
    df, parts = docs, []
    for items in _blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(items)  # at most block_bytes, see _blocks

        def make(sent=sent, name=uuid4().hex):
            def scan(texts):
                if name not in _BUILT:
                    _BUILT.clear()
                    _BUILT[name] = windows(sent.value, width)
                got = {"n_words": [], "spans": [], "items": []}
                for t in texts:
                    words = ascii_words(t)
                    spans, ids = search(words, _BUILT[name])
                    got["n_words"].append(len(words))
                    got["spans"].append(spans)
                    got["items"].append(ids)
                return got

            return scan

        df, s = scan_texts(df, text_col, make, RESULT, [*dict.fromkeys([*keep, text_col]), *parts], "window_scan")
        parts.append(s)
    out = free_name([*keep, *parts], "windows")
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{s}.spans") for s in parts])))
    merged = F.aggregate(
        spans, F.array().cast(RESULT["spans"].dataType),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    ) if len(parts) > 1 else spans
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{s}.items") for s in parts]))))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"), merged.alias("spans"), items.alias("items")).alias(out)), out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence), n_items,
    items_sha256 (of the comma-joined ids), contaminated."""
    found, w = find_windows(docs.select("doc_id", "text"), benchmark, width, keep=["doc_id"])
    hit = F.aggregate(F.col(f"{w}.spans"), F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    items = F.col(f"{w}.items")
    return found.select(
        "doc_id", F.col(f"{w}.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents in which no window occurs, with their own columns."""
    found, w = find_windows(docs, benchmark, width)
    return found.where(F.size(F.col(f"{w}.spans")) == 0).drop(w)
