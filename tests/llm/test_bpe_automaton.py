import hashlib
import struct

import pytest
from helpers import AWKWARD, docs_of, sf
from tokenizers import Tokenizer

import corpus_pipeline
from flipframe.llm import bpe_automaton as B

PATH = corpus_pipeline.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def want(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    decoded = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


HARD = [
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "don't  we'LL 've\n\n\t x", "1234567 8,9", "  lead", "trail   ", "\u00a0\u2003x", "é́ ñ 한국어 العربية",
    "\U0001f468\u200d\U0001f469\u200d\U0001f467", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x01\x7f", "ǅ ǆ ½ ² ٣", "word\r\nword",
]


def test_equals_the_library(spark, library):
    texts = AWKWARD + HARD
    rows = B.encode_texts(docs_of(spark, texts), PATH, words=50, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(library, texts[r.doc_id])
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    assert B.encode_texts(docs_of(spark, []), PATH).count() == 0


def test_documents_equal_the_library(spark, library):
    d = sf(spark, "documents")
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in B.encode_texts(d, PATH).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(library, texts[r.doc_id])


def test_portions_of_long_texts(monkeypatch, library):
    monkeypatch.setattr(B, "_LONG", 10)
    monkeypatch.setattr(B, "_PORTION", 3)
    bpe = B.Bpe.load(PATH)
    for text in HARD + ["漢字 " * 50]:
        words = [w for part in bpe.sections(text) if isinstance(part, str) for ws in bpe.words(part) for w in ws]
        assert [i for w in words for i in bpe.merge(w.encode())] == [i for i in library.encode(text, add_special_tokens=False).ids if i != 50256]


def test_lexicon_holds_exactly_its_words(tmp_path):
    ids = {w.encode(): tuple(range(k, k + k % 4 + 1)) for k, w in enumerate("the then there here he her hers a an and band hand é ez".split())}
    path = tmp_path / "lex"
    words = {w: B.pack(x) for w, x in ids.items()}
    path.write_bytes(B.compile_lexicon(ids.items()))
    lex = B.Lexicon(str(path))
    assert {w: lex.get(w) for w in words} == words
    assert all(lex.get(x) is None for x in (b"", b"t", b"thenn", b"ban", b"zz", "è".encode()))
    path.write_bytes(B.compile_lexicon([]))
    assert B.Lexicon(str(path)).get(b"a") is None


def test_lexicon_shares_suffixes(tmp_path):
    words = [(a + b).encode() for a in ("walk", "talk", "jump") for b in ("", "s", "ed", "ing")]
    path = tmp_path / "lex"
    path.write_bytes(B.compile_lexicon([(w, (1,)) for w in words]))
    assert len(B.Lexicon(str(path)).final) < 20  # 44 states in a trie


def test_word_counts_cover_all_texts(spark):
    d = docs_of(spark, ["a b a", "b b", None])
    got = {r.word: r.n for r in B.word_counts(d, PATH).collect()}
    assert got == {"a": 1, " b": 2, " a": 1, "b": 1}


def test_words_merged_together_equal_the_library(library):
    import random

    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeinorst huéß") for _ in range(n)) for n in [*range(0, 30), 63, 64, 65, 200] for _ in range(20)]
    bpe = B.Bpe.load(PATH)
    got = bpe.merge_many([w.encode() for w in words])
    assert got == [B.pack(bpe.merge(w.encode())) for w in words]
    assert bpe.merge_many([]) == []
    for w, x in zip(words, got):
        if w and " " not in w:
            assert list(struct.unpack(f"<{len(x) // 4}i", x)) == library.encode(w, add_special_tokens=False).ids
