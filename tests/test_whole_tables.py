import __spark_entry__ as E
import pytest

from flipframe.functions.text import word_tokens

DOCS = [
    (k, lang, source, text)
    for k, (lang, source, text) in enumerate([
        ("en", "web", "a cat sat on the mat"), ("en", "web", "the dog ran off with all of the shoes"), ("fr", "news", "one two three"),
        ("de", "book", "red green blue red green"), ("en", "news", "a cat sat on the mat"), ("fr", "book", "x y"),
    ])
]
LABELS = ["entailment", "neutral", "contradiction"]


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(0, "one two three"), (5, "seen nowhere else")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(f"w{(c + t * k) % 4}" for k in range(3 + (c + t) % 4))) for c in range(6) for t in range(7)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path), {(c, t): x for c, t, _, x in turns}


def test_nli_suite_scores_every_document_row(spark, tables):
    path, _ = tables
    got = {r.metric: r.value for r in E.queries()["eval_suite_nli_documents"](spark, path).collect()}
    first_hyp, first_prem = {}, {}
    for k, lang, source, text in DOCS:
        first_hyp.setdefault(text, f"{lang}:{source}")
        first_prem.setdefault(f"{lang}:{source}", text)
    # (seed side, other side, gold text, counter label)
    rows = [(first_hyp[t], t, f"revised {s}", (k + 1) % 3) for k, _, s, t in DOCS] + [(first_hyp["one two three"], "one two three", "revised benchmark", 0)]
    rows += [(first_prem[f"{x}:{s}"], f"{x}:{s}", f"revised: {t}", (k + 2) % 3) for k, x, s, t in DOCS]
    texts = sorted({x for r in rows for x in r[:3]})
    tok = {r.text: r.tok for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", word_tokens("text").alias("tok")).collect()}
    from flipframe.plans.catalog_metrics import _LABEL_MAP

    hits, dist = [], []
    for seed, other, _, label in rows:
        w = seed.split(" ")
        for i in (1, 2, 3):
            k = i % len(w)
            made = w[k:] + w[:k]
            made = [x for t in made for x in (tok[t] if t in tok and len(w) == 1 else [t])]
            hits.append((len(made) + len(tok[other])) % 3 == _LABEL_MAP[LABELS[label]])
            dist.append(lev(tok[seed], made) / len(tok[seed]))
    assert got["label_flip"] == pytest.approx(sum(hits) / len(hits), abs=2e-6)
    assert got["lev_mean"] == pytest.approx(sum(dist) / len(dist), abs=2e-6)
    assert got["avg_len_counter"] == pytest.approx(sum(len(tok[r[2]]) for r in rows) / len(rows), abs=2e-6)
    assert {"zss_mean", "sent_bleu_mean", "self_bleu_mean"} <= set(got)


def test_token_distance_of_every_candidate(spark, tables):
    path, text = tables
    want = {}
    for c in range(6):
        for t in (0, 2):  # later exchanges have fewer than three candidates
            for i in range(3):
                a, b = text[c, t].split(), text[c, t + 2 + i].split()
                want[c * (1 << 20) + t, i] = (lev(a, b), round(lev(a, b) / len(a), 6))
    got = {(r.paired_id, r.idx): (r.distance, r.normalised) for r in E.queries()["token_edit_distance_candidates"](spark, path).collect()}
    assert got == want
