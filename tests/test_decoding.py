import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flipframe.operators import decoding as DE

WORDS = re.compile(r"\w+|[^\w\s]")
TEXTS = [(0, "the cat sat on the mat . the cat ran"), (0, "a cat sat on a hat ."), (0, "the dog ran on the mat ."), (1, "good good day !"), (1, None), (1, ""),
         (1, "the day was good and the night was good and long")]
PROMPTS = [(1, 0, "the cat was here before"), (2, 0, "unknown word"), (3, 1, ""), (4, 1, None), (5, 1, "the"), (6, 0, "dog"), (7, 2, "the cat of no class")]


def model(s):
    counts = defaultdict(Counter)
    for label, t in TEXTS:
        if t is not None:
            toks = [DE.START, *WORDS.findall(t), DE.END]
            for a, b in zip(toks, toks[1:]):
                counts[label, a][b] += 1
    table = {}
    for key, c in counts.items():
        top = sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[: s.top_k]
        p = [n ** (1 / s.temperature) for _, n in top]
        table[key] = (sum(c.values()), [(t, n, w) for k, ((t, n), w) in enumerate(zip(top, p)) if sum(p[:k]) < s.top_p * sum(p)])
    return table


def start(table, label, text):
    t = WORDS.findall(text or "")
    seed = t[:2]
    prev = seed[-1] if seed else DE.START
    return seed, (prev if (label, prev) in table else DE.START), min(2 * len(t), 1024)


def allowed(succ, seed, tokens, s):
    h, n = seed + tokens, s.no_repeat_ngram
    grams = {tuple(h[i : i + n]) for i in range(len(h) - n + 1)} if n else set()
    return [e for e in succ if not (e[0] == DE.END and len(tokens) < s.min_length) and (not n or tuple(h[len(h) - n + 1 :] + [e[0]]) not in grams)]


def half_up(x):
    return math.copysign(math.floor(abs(x) + 0.5), x)


def brute_beam(s, width):
    table, out = model(s), []
    for i, label, text in PROMPTS:
        seed, prev, budget = start(table, label, text)
        front = [(0, 0, [], prev, budget <= 0)]
        while not all(f[4] for f in front):
            new = [f for f in front if f[4]]
            for score, n, tokens, prev, done in front:
                if done:
                    continue
                total, succ = table.get((label, prev), (1, []))
                ok = allowed(succ, seed, tokens, s)
                if not ok:
                    new.append((score, n, tokens, prev, True))
                for t, c, _ in ok:
                    w = half_up(math.log(c / total) * DE.MICRO)
                    w = int(half_up(w * s.penalty) if t in seed + tokens else w)
                    if t == DE.END:
                        new.append((score + w, n + 1, tokens, prev, True))
                    else:
                        new.append((score + w, n + 1, [*tokens, t], t, len(tokens) + 1 >= budget))
            front = sorted(new, key=lambda f: (-(f[0] / max(1, f[1])), f[2]))[:width]
        for k in range(s.n):
            out.append((i, k, " ".join(seed + front[k][2]), front[k][0]) if k < len(front) else (i, k, None, None))
    return sorted(out)


def brute_sample(s):
    table, out = model(s), []
    for i, label, text in PROMPTS:
        for k in range(s.n):
            seed, prev, budget = start(table, label, text)
            tokens, step = [], 1
            while len(tokens) < budget:
                total, succ = table.get((label, prev), (1, []))
                ok = allowed(succ, seed, tokens, s)
                if not ok:
                    break
                p = [w if s.penalty == 1 else (c / total) ** ((s.penalty if t in seed + tokens else 1.0) / s.temperature) for t, c, w in ok]
                u = int(hashlib.md5(f"{s.seed}:{i}:{k}:{step}".encode()).hexdigest()[:8], 16) / 2**32
                t = next(e[0] for j, e in enumerate(ok) if sum(p[: j + 1]) > u * sum(p))
                if t == DE.END:
                    break
                tokens, prev, step = [*tokens, t], t, step + 1
            out.append((i, k, " ".join(seed + tokens)))
    return sorted(out)


def frames(spark, s):
    texts = spark.createDataFrame(TEXTS, "label int, text string")
    prompts = spark.createDataFrame(PROMPTS, "id long, label int, example string")
    return DE.seeded_prompts(prompts, "id", "example", "label"), DE.next_tokens(texts, "text", ["label"], s)


@pytest.mark.parametrize("s", [DE.Decoding(n=3, beams=3, min_length=2, no_repeat_ngram=2, penalty=1.3, top_k=4, top_p=0.9), DE.Decoding(n=1, beams=1, top_k=2)])
def test_beams_equal_brute_force(spark, s):
    prompts, table = frames(spark, s)
    got = DE.beam_search(prompts, table, s, ["label"])
    assert sorted(map(tuple, got.collect())) == brute_beam(s, max(s.beams, s.n))


@pytest.mark.parametrize("s", [DE.Decoding(n=4, min_length=1, temperature=0.7, penalty=1.2, no_repeat_ngram=3, top_k=3), DE.Decoding(n=2, top_p=0.6, seed="x")])
def test_samples_equal_brute_force(spark, s):
    prompts, table = frames(spark, s)
    got = DE.sample(prompts, table, s, ["label"])
    assert sorted(map(tuple, got.collect())) == brute_sample(s)
    assert DE.sample(prompts.where(F.lit(False)), table, s, ["label"], max_steps=2).count() == 0
