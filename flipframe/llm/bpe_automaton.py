"""Byte-level BPE with a memory-mapped lexicon automaton.

The corpus' most frequent words and their token ids are compiled into a minimal acyclic
automaton: equal suffixes share states, and every arc carries an additive output, so the sum
along a word's path is its number, which locates its ids in one pool.  Executors map the file and
walk it byte by byte.  Words outside the lexicon are merged exactly by rank.  Either way a word
gets the ids that the tokenizer's merge list gives it, so the lexicon only changes the speed.

The tokenizer is a ``tokenizers`` JSON file of a byte-level BPE (no normaliser, byte-level
pre-tokenisation with its standard pattern); its special tokens are cut out of the text first.
Null and empty texts have no tokens.  Equal texts get equal ids; long texts are streamed whole.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flipframe.llm.common import put, ready, scan_texts, written
from flipframe.session import scratch_path

#: Most words compiled into the lexicon.  The counts behind the choice cover all texts.
LEXICON_WORDS = 65_536

#: Fixed value: the standard byte-level pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern for text of Latin-1 characters only, with the letter, number and white space
#: classes spelled out, which the standard library's engine matches at twice the speed.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PATTERN = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

_NO_PAIR = 1 << 62
#: Matrix widths for words merged together, and the most words of a matrix.
_WIDTHS, _ROWS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 64), 1 << 12
_LONG = 1 << 20  # characters from which a text's words are taken in portions
_PORTION = 1 << 16


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PairTable:
    """Vectorised lookup of merges: an open-addressing hash table over pair numbers."""

    def __init__(self, first: dict[int, int]):
        self._bits = max(4, (4 * len(first)).bit_length())
        size = 1 << self._bits
        self._key, self._value = np.full(size, -1, np.int64), np.full(size, _NO_PAIR, np.int64)
        keys = np.fromiter(first.keys(), np.int64, len(first))
        for key, value, slot in zip(keys.tolist(), first.values(), self._slot(keys).tolist()):
            while self._key[slot] >= 0:
                slot = (slot + 1) % size
            self._key[slot], self._value[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and new id of each pair; ``_NO_PAIR`` where there is none or an id is negative."""
        none = (a < 0) | (b < 0)
        key = np.where(none, 0, (a << 24) | b)
        slot = self._slot(key)
        met = self._key[slot]
        out = np.where(met == key, self._value[slot], _NO_PAIR)
        todo = np.flatnonzero((met != key) & (met >= 0))
        key, slot = key.ravel()[todo], slot.ravel()[todo]
        flat = out.ravel()
        while len(todo):
            slot = (slot + 1) & (len(self._key) - 1)
            met = self._key[slot]
            hit = met == key
            flat[todo[hit]] = self._value[slot[hit]]
            on = ~hit & (met >= 0)
            todo, key, slot = todo[on], key[on], slot[on]
        out = flat.reshape(out.shape)
        out[none] = _NO_PAIR
        return out


class Bpe:
    """Exact merges, words and decoding of a byte-level BPE file."""

    def __init__(self, spec: dict):
        import regex

        model, added = spec["model"], spec.get("added_tokens") or []
        if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE without normaliser is needed")
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.vocab: dict[str, int] = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in self.vocab.items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [self.vocab[alphabet[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (r, self.vocab[a + b]))
        # pairs and what they merge to as one number each: the smallest rank is the pair to merge
        self._first = {(a << 24) | b: (r << 24) | new for (a, b), (r, new) in self.rank.items()}
        self._pairs = PairTable(self._first)
        self._byte_ids = np.array(self.byte_id, np.int64)
        self._words, self._latin_words = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the lowest-ranked pair merges first, the leftmost of equals."""
        return self._merge_short(word) if len(word) < 64 else self._merge_long(word)

    def _merge_short(self, word: bytes) -> tuple[int, ...]:
        """Merges in a list of pair ranks, searched anew for each merge."""
        of, get = self.byte_id, self._first.get
        ids = [of[b] for b in word]
        ranks = [get((a << 24) | b, _NO_PAIR) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NO_PAIR:
            i = ranks.index(best)
            ids[i] = new = best & 0xFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1] << 24) | new, _NO_PAIR)
            if i < len(ranks):
                ranks[i] = get((new << 24) | ids[i + 1], _NO_PAIR)
        return tuple(ids)

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """Merges in a linked list with a heap, n log n for a word of any length."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        rank = self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*r, i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            r, new, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or rank.get((ids[i], ids[j])) != (r, new):
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if x := rank.get((new, ids[k])):
                    heapq.heappush(heap, (*x, i))
            if (h := left[i]) >= 0 and (x := rank.get((ids[h], new))):
                heapq.heappush(heap, (*x, h))
        return tuple(x for x in ids if x >= 0)

    def merge_many(self, words: Sequence[bytes]) -> list[bytes]:
        """The packed ids of many words: all words of about one length merge their best pair
        together, round by round, as rows of a matrix."""
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w)
            by_width.setdefault(next((k for k in _WIDTHS if n <= k), 0), []).append(i)
        for width, at in by_width.items():
            for k in range(0, len(at), _ROWS):
                some = at[k : k + _ROWS]
                chosen = [words[i] for i in some]
                merged = self._merge_matrix(chosen, width) if width else [pack(self._merge_long(w)) for w in chosen]
                for i, ids in zip(some, merged):
                    out[i] = ids
        return out

    def _merge_matrix(self, words: Sequence[bytes], width: int) -> list[bytes]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        n, cols = len(words), np.arange(width)
        ids = np.full((n, width + 1), -1, np.int64)  # a last column of no ids
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), length)
        ids[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = self._byte_ids[flat]
        rank = np.full((n, width + 1), _NO_PAIR, np.int64)  # of the pair that starts in a column
        rank[:, :width] = self._pairs.get(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        while len(live):
            best = rank[live].min(axis=1)
            live, best = live[best < _NO_PAIR], best[best < _NO_PAIR]
            if not len(live):
                break
            r, a = rank[live], ids[live]
            pos = r.argmin(axis=1)  # the leftmost of equals
            k, new = np.arange(len(live)), best & 0xFFFFFF
            later = cols[None, :] >= pos[:, None]
            r[:, :width] = np.where(later, r[:, 1:], r[:, :width])
            later[k, pos] = False
            a[:, :width] = np.where(later, a[:, 1:], a[:, :width])
            a[k, pos] = new
            r[k, pos] = self._pairs.get(new, a[k, pos + 1])
            left = np.flatnonzero(pos)
            r[left, pos[left] - 1] = self._pairs.get(a[left, pos[left] - 1], new[left])
            rank[live], ids[live] = r, a
        packed, row_bytes = ids.astype("<i4").tobytes(), 4 * (width + 1)
        ends = (np.arange(n) * row_bytes + 4 * (ids >= 0).sum(axis=1)).tolist()
        return [packed[k * row_bytes : end] for k, end in enumerate(ends)]

    def sections(self, text: str) -> Iterator[str | int]:
        """Plain stretches of text and special ids, in order."""
        parts = self._cut.split(text) if self._cut else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.special[part]
            elif part:
                yield part

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a plain stretch, in portions."""
        try:
            text.encode("latin-1")
            pattern = self._latin_words
        except UnicodeEncodeError:
            pattern = self._words
        if len(text) < _LONG:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while portion := list(islice(found, _PORTION)):
            yield portion


class Lexicon:
    """Read side of the compiled automaton: arcs by state, number outputs, id pool.

    File: eight 32-bit counts (states, arcs, words, ids, 4 spare), then the 32-bit arrays first
    arc of each state (+1), arc targets, arc outputs, first id of each word (+1), ids, and the
    byte arrays arc labels and final flags.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self._map)
        states, arcs, words, ids = struct.unpack_from("<4i", view)
        at = 32

        def ints(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("i")

        self.first, self.target, self.add = ints(states + 1), ints(arcs), ints(arcs)
        self.offset = ints(words + 1)
        self.packed = view[at : at + 4 * ids]
        at += 4 * ids
        self.label, self.final = view[at : at + arcs], view[at + arcs : at + arcs + states]

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as packed 32-bit integers."""
        first, label, state, number = self.first, self.label, 0, 0
        for b in word:
            end = first[state + 1]
            k = bisect_left(label, b, first[state], end)
            if k == end or label[k] != b:
                return None
            number += self.add[k]
            state = self.target[k]
        if not self.final[state]:
            return None
        return bytes(self.packed[4 * self.offset[number] : 4 * self.offset[number + 1]])


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file of a minimal acyclic automaton over distinct words with their ids.

    Words are added in byte order; once a word leaves a branch, that branch's states are replaced
    by equal ones already registered (same finality and arcs).
    """
    entries = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}

    def settle(path: list[tuple[int, int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, b, child = path.pop()
            key = (final[child], tuple(arcs[child].items()))
            arcs[parent][b] = register.setdefault(key, child)

    path: list[tuple[int, int, int]] = []
    before = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        settle(path, same)
        state = path[-1][2] if path else 0
        for b in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[state][b] = child = len(arcs) - 1
            path.append((state, b, child))
            state = child
        final[state] = True
        before = word
    settle(path, 0)
    number = {0: 0}
    order = [0]
    for s in order:  # reachable states only, root first
        for t in arcs[s].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}

    def words_below(top: int) -> None:
        todo = [top]
        while todo:
            s = todo[-1]
            missing = [t for t in arcs[s].values() if t not in below]
            if missing:
                todo += missing
            else:
                below[todo.pop()] = final[s] + sum(below[t] for t in arcs[s].values())

    words_below(0)
    first, target, add, label = [0], [], [], bytearray()
    for s in order:
        skipped = int(final[s])
        for b, t in sorted(arcs[s].items()):
            label.append(b)
            target.append(number[t])
            add.append(skipped)
            skipped += below[t]
        first.append(len(target))
    offset, pool = [0], []
    for _, ids in entries:
        pool += ids
        offset.append(len(pool))
    ints = [*first, *target, *add, *offset, *pool]
    head = struct.pack("<8i", len(order), len(target), len(entries), len(pool), 0, 0, 0, 0)
    return head + struct.pack(f"<{len(ints)}i", *ints) + bytes(label) + bytes(final[s] for s in order)


class TokenPool:
    """One byte string for every id, and their concatenation over an array of ids."""

    def __init__(self, of: dict[int, bytes]):
        size = max(of, default=-1) + 1
        pieces = [of.get(i, b"") for i in range(size)]
        self._bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._length = np.fromiter(map(len, pieces), np.int64, size)
        self._start = np.cumsum(self._length) - self._length

    def join(self, ids: np.ndarray) -> bytes:
        length = self._length[ids]
        end = np.cumsum(length)
        at = np.repeat(self._start[ids] - (end - length), length)
        at += np.arange(len(at))
        return self._bytes[at].tobytes()


class Encoder:
    """Text to ids through the lexicon, with exact merges for other words.

    Words met are remembered with their ids (packed 32-bit integers).
    """

    #: Words remembered before all are forgotten, some 80 MB.
    REMEMBERED = 3 << 17

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self._known: dict[str, bytes] = {}
        self._bytes = TokenPool(bpe.bytes_of)
        self._decimals = TokenPool({i: b"%d," % i for i in bpe.bytes_of})

    def _learn(self, words: Sequence[str]) -> None:
        """Remember words, by the lexicon or else merged together."""
        raws = [w.encode() for w in words]
        ids = list(map(self.lexicon.get, raws))
        unseen = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(unseen, self.bpe.merge_many([raws[k] for k in unseen])):
            ids[k] = x
        self._known.update(zip(words, ids))

    def _packed(self, word_lists: Sequence[list[str]]) -> list[bytes]:
        """The ids of each list's words; what is unknown to all lists is learnt at once."""
        if len(self._known) > self.REMEMBERED:
            self._known.clear()
        get, missing = self._known.get, set()
        found = [list(map(get, words)) for words in word_lists]
        for words, ids in zip(word_lists, found):
            if None in ids:
                missing.update([w for w, x in zip(words, ids) if x is None])
        if missing:
            self._learn(list(missing))
        return [b"".join(map(get, words) if None in ids else ids) for words, ids in zip(word_lists, found)]

    def _portions(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a long text, portion by portion."""
        for part in self.bpe.sections(text):
            if isinstance(part, int):
                yield np.array([part], "<i4")
                continue
            for words in self.bpe.words(part):
                yield np.frombuffer(self._packed([words])[0], "<i4")

    def _together(self, texts: Sequence[str]) -> Iterator[list[np.ndarray]]:
        """The ids of short texts, whose words are all split first, so that unknown ones are merged
        together."""
        parts = [list(self.bpe.sections(t)) for t in texts]
        known = iter(self._packed([words for ps in parts for p in ps if isinstance(p, str) for words in self.bpe.words(p)]))
        for ps in parts:
            yield [np.frombuffer(pack([p]) if isinstance(p, int) else next(known), "<i4") for p in ps]

    def encode_many(self, texts: Sequence[str]) -> Iterator[Iterable[np.ndarray]]:
        """For each text, in order, its ids in pieces that end between words."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size := size + len(texts[end])) < _LONG:
                end += 1
            if end == at:
                yield self._portions(texts[at])
                at += 1
            else:
                yield from self._together(texts[at:end])
                at = end

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.concatenate([np.empty(0, "<i4"), *next(iter(self.encode_many([text])))])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        return self._bytes.join(ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self._decimals.join(ids)[:-1]


def pack(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = 1 << 18) -> DataFrame:
    """(word, n) over all texts; every task adds up its words before the shuffle."""
    spec = _spec(tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = Bpe(sent.value), Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return got

        for batch in batches:
            for k in range(batch.num_rows):
                for part in bpe.sections(batch.column(0)[k].as_py() or ""):
                    if isinstance(part, str):
                        for words in bpe.words(part):
                            seen.update(words)
                if len(seen) > most:
                    yield out()
        if seen:
            yield out()

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(count, schema)
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _spec(tokenizer: str) -> dict:
    """The tokenizer file, whose size (some MB) doesn't depend on the data."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    Bpe(spec)  # refuses files of another kind on the driver
    return spec


def share_lexicon(spark: SparkSession, docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the most frequent words of all texts and give the file to every executor; returns
    its name for ``SparkFiles.get``.

    Taken are all words that occur at least as often as the smallest count for which they are no
    more than ``words``: the driver receives those words and nothing else.
    """
    counts, _ = written(spark, word_counts(docs, tokenizer, text_col), "word-counts")
    # distinct counts: at most about sqrt(2 * number of words) rows
    as_often = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = counts.groupBy("n").agg(F.count("*").alias("words")).select("n", as_often.alias("as_often"))
    least = hist.where(F.col("as_often") <= words).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= least).select("word").collect() if least is not None else []
    bpe = Bpe.load(tokenizer)
    data = compile_lexicon([(r.word.encode(), bpe.merge(r.word.encode())) for r in top])
    path = scratch_path(spark, "lexicon")
    put(spark, path, data)
    spark.sparkContext.addFile(path)  # executors that join later fetch it too
    return path.rsplit("/", 1)[1]


_CODERS: dict[str, Encoder] = {}  # one entry: the lexicon this Python worker last encoded with

_HASHES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
_WITH_IDS = T.StructType([*_HASHES.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode_texts(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256 (of the UTF-8 text decoded from the ids) and, ``with_ids``, the ids."""
    spark = docs.sparkSession
    ready(spark)
    src = docs.select(id_col, text_col)
    lexicon = share_lexicon(spark, src, tokenizer, words, text_col)
    sent = spark.sparkContext.broadcast(_spec(tokenizer))
    result = _WITH_IDS if with_ids else _HASHES

    def make():
        if lexicon not in _CODERS:  # a Python worker keeps its words from task to task
            _CODERS.clear()
            _CODERS[lexicon] = Encoder(Bpe(sent.value), Lexicon(SparkFiles.get(lexicon)))
        coder = _CODERS[lexicon]

        def one(pieces: Iterable[np.ndarray]):
            # a word is whole characters, so every piece decodes by itself
            n, ids_sha, text_sha, kept = 0, sha256(), sha256(), []
            for ids in pieces:
                if len(ids):
                    ids_sha.update((b"," if n else b"") + coder.decimals(ids))
                    n += len(ids)
                    text_sha.update(coder.decode(ids).decode("utf-8", "replace").encode())
                    kept.append(ids)
            return n, ids_sha.hexdigest(), text_sha.hexdigest(), np.concatenate([np.empty(0, "<i4"), *kept]) if with_ids else None

        def scan(texts):
            got = list(zip(*map(one, coder.encode_many([(t or b"").decode("utf-8", "replace") for t in texts])))) or [(), (), (), ()]
            return {f.name: list(g) for f, g in zip(result.fields, got)}

        return scan

    got, s = scan_texts(src, text_col, make, result, [id_col], "bpe_scan")
    return got.select(id_col, *[F.col(f"{s}.{f.name}").alias(f.name) for f in result.fields])
