"""Queries over trained models: classifier epochs, their sweep, originals against augmented sets, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipframe.operators import candidates as C
from flipframe.operators import decoding as DE
from flipframe.operators import epochs as E
from flipframe.operators import kneser as KN
from flipframe.operators import metrics as M
from flipframe.plans import tables as TB
from flipframe.plans.catalog_io import W, tokens_sql
from flipframe.plans.catalog_metrics import _CAT_TRAIN, _SPLIT_SQL, _train_val_test
from flipframe.plans.registry import query

_EPOCHS = E.Settings(rate=0.1, decay=0.01, max_epochs=5, patience=2)
_SWEEP = [E.Settings(rate=r, decay=0.01, max_epochs=3, patience=2) for r in (0.02, 0.2)]


def _features_sql(src: str, id_col: str, tag: str) -> list[str]:
    """CTEs {tag}d (id, label) and {tag}f (id, feature, x)."""
    return [
        f"{tag}d AS MATERIALIZED (SELECT {id_col} AS id, labels AS label, text FROM {src})",
        f"{tag}b AS MATERIALIZED (SELECT id, feature, 1 + ln(count(*)) AS x FROM (SELECT id, unnest({tokens_sql('text')}) AS feature FROM {tag}d) t GROUP BY ALL)",
        f"{tag}f AS MATERIALIZED (SELECT id, feature, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {tag}b UNION ALL SELECT id, '' AS feature, 1.0 AS x FROM {tag}d)",
    ]


def _scores_sql(tag: str, weights: str, out: str) -> str:
    return (f"{out} AS MATERIALIZED (SELECT d.id, d.label AS y, c.label, coalesce(s, 0.0) AS s FROM {tag}d d CROSS JOIN (SELECT DISTINCT label FROM trd) c LEFT JOIN "
            f"(SELECT f.id, w.label, sum(f.x * w.w) AS s FROM {tag}f f JOIN {weights} w ON f.feature = w.feature GROUP BY ALL) k ON k.id = d.id AND k.label = c.label)")


def _train_sql(s: E.Settings, tag: str) -> list[str]:
    """CTEs of full-batch training on trd/trf with accuracy on vad/vaf: {tag}_e (epoch, loss, accuracy, best) and {tag}_w
    (the best epoch's weights)."""
    out = [f"{tag}w0 AS (SELECT '' AS feature, 0 AS label, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v WHERE false)"]
    for k in range(1, s.max_epochs + 1):
        out.append(_scores_sql("tr", f"{tag}w{k - 1}", f"{tag}s{k}"))
        out.append(f"{tag}p{k} AS MATERIALIZED (SELECT id, y, label, exp(s - t) / sum(exp(s - t)) OVER (PARTITION BY id) AS p FROM (SELECT *, max(s) OVER (PARTITION BY id) AS t FROM {tag}s{k}) q)")
        out.append(f"{tag}g{k} AS MATERIALIZED (SELECT f.feature, p.label, sum(f.x * (p.p - CAST(p.y = p.label AS DOUBLE))) / (SELECT count(*) FROM trd) AS g "
                   f"FROM trf f JOIN {tag}p{k} p ON f.id = p.id GROUP BY ALL)")
        out.append(f"{tag}m{k} AS MATERIALIZED (SELECT g.feature, g.label, coalesce(w.w, 0.0) AS w, {E.BETA1} * coalesce(w.m, 0.0) + {1 - E.BETA1!r} * g AS m, "
                   f"{E.BETA2} * coalesce(w.v, 0.0) + {1 - E.BETA2!r} * g * g AS v FROM {tag}g{k} g LEFT JOIN {tag}w{k - 1} w ON w.feature = g.feature AND w.label = g.label)")
        out.append(f"{tag}w{k} AS MATERIALIZED (SELECT feature, label, w - {s.rate!r}::DOUBLE * ((m / {1 - E.BETA1**k!r}::DOUBLE) / (sqrt(v / {1 - E.BETA2**k!r}::DOUBLE) + {s.epsilon!r}::DOUBLE) "
                   f"+ {s.decay!r}::DOUBLE * w) AS w, m, v FROM {tag}m{k})")
        out.append(_scores_sql("va", f"{tag}w{k}", f"{tag}v{k}"))
    per = " UNION ALL ".join(
        f"SELECT {k} AS epoch, (SELECT avg(-ln(p)) FROM {tag}p{k} WHERE y = label) AS loss, (SELECT avg(CAST(pred = y AS DOUBLE)) FROM "
        f"(SELECT id, y, arg_max(label, (s, -label)) AS pred FROM {tag}v{k} GROUP BY id, y) q) AS accuracy" for k in range(1, s.max_epochs + 1))
    out.append(f"{tag}all AS MATERIALIZED ({per})")
    out.append(f"{tag}run AS MATERIALIZED (SELECT *, first_value(epoch) OVER (ORDER BY accuracy DESC, epoch) AS overall, "
               f"(SELECT arg_max(b.epoch, (b.accuracy, -b.epoch)) FROM {tag}all b WHERE b.epoch <= a.epoch) AS top FROM {tag}all a)")
    out.append(f"{tag}kept AS MATERIALIZED (SELECT * FROM {tag}run WHERE epoch <= coalesce((SELECT min(epoch) FROM {tag}run WHERE epoch - top >= {s.patience}), {s.max_epochs}))")
    out.append(f"{tag}_e AS MATERIALIZED (SELECT CAST(epoch AS BIGINT) AS epoch, loss, accuracy, epoch = (SELECT arg_max(epoch, (accuracy, -epoch)) FROM {tag}kept) AS best FROM {tag}kept)")
    rows = " UNION ALL ".join(f"SELECT {k} AS epoch, feature, label, w FROM {tag}w{k}" for k in range(1, s.max_epochs + 1))
    out.append(f"{tag}_w AS MATERIALIZED (SELECT feature, label, w FROM ({rows}) q WHERE epoch = (SELECT epoch FROM {tag}_e WHERE best))")
    return out


def _predict_sql(tag: str, out: str) -> list[str]:
    return [_scores_sql("te", f"{tag}_w", f"{out}s"), f"{out} AS (SELECT id, y, arg_max(label, (s, -label)) AS pred FROM {out}s GROUP BY id, y)"]


_SETS = [*_SPLIT_SQL, *_features_sql("tr", "doc_id", "tr"), *_features_sql("va", "doc_id", "va"), *_features_sql("te", "doc_id", "te")]


def _sets(spark, d):
    return [E.document_features(part, "doc_id") for part in _train_val_test(spark, d)]


@query("train_epochs", sql=W(*_SETS, *_train_sql(_EPOCHS, "a"), body="SELECT epoch, loss, accuracy, best FROM a_e"), doubles=["loss", "accuracy"])
def train_epochs(spark, d):
    """M4: every epoch of a classifier's training, its validation accuracy, the best epoch marked."""
    train, val, _ = _sets(spark, d)
    _, epochs, _ = E.train(train, val, _EPOCHS)
    return spark.createDataFrame([(e["epoch"], e["loss"], e["accuracy"], e["best"]) for e in epochs], "epoch long, loss double, accuracy double, best boolean")


@query("train_classifier_epochs", sql=W(*_SETS, *_train_sql(_EPOCHS, "a"), *_predict_sql("a", "pp"), body="""SELECT (SELECT epoch FROM a_e WHERE best) AS epoch,
  avg(CAST(pred = y AS DOUBLE)) AS accuracy,
  coalesce(sum(CAST(pred = 1 AND y = 1 AS INT)) / nullif(sum(CAST(pred = 1 AS INT)), 0), 0.0) AS precision,
  coalesce(sum(CAST(pred = 1 AND y = 1 AS INT)) / nullif(sum(CAST(y = 1 AS INT)), 0), 0.0) AS recall,
  coalesce(2.0 * sum(CAST(pred = 1 AND y = 1 AS INT)) / nullif(sum(CAST(pred = 1 AS INT)) + sum(CAST(y = 1 AS INT)), 0), 0.0) AS f1 FROM pp"""),
       doubles=["accuracy", "precision", "recall", "f1"])
def train_classifier_epochs(spark, d):
    """M4: test metrics of the weights of the best epoch."""
    train, val, test = _sets(spark, d)
    weights, epochs, labels = E.train(train, val, _EPOCHS)
    p = E.predict(weights, labels, test).join(test.select("id", "label"), "id")
    best = next(e["epoch"] for e in epochs if e["best"])
    return M.binary_prf(p, "label", "pred").select(F.lit(best).cast("long").alias("epoch"), "accuracy", "precision", "recall", "f1")


@query("sweep_classifier_epochs", sql=W(*_SETS, *[c for k, s in enumerate(_SWEEP) for c in _train_sql(s, "ab"[k])], "al AS (" + " UNION ALL ".join(
    f"SELECT CAST({k} AS BIGINT) AS setting, {s.rate!r}::DOUBLE AS rate, epoch, accuracy FROM {'ab'[k]}_e WHERE best" for k, s in enumerate(_SWEEP)) + ")",
    body="SELECT setting, rate, epoch, accuracy, setting = (SELECT arg_max(setting, (accuracy, -setting)) FROM al) AS best FROM al"), doubles=["rate", "accuracy"])
def sweep_classifier_epochs(spark, d):
    """M5: one training per setting, its best epoch and accuracy, the best setting marked (of equals the first)."""
    train, val, _ = _sets(spark, d)
    rows = []
    for k, s in enumerate(_SWEEP):
        top = next(e for e in E.train(train, val, s)[1] if e["best"])
        rows.append((k, s.rate, top["epoch"], top["accuracy"]))
    best = max(rows, key=lambda r: (r[3], -r[0]))[0]
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "setting long, rate double, epoch long, accuracy double, best boolean")


_CAT = _SWEEP[1]
_CAT_SETS = [*_SPLIT_SQL, TB.PAIRS_SQL(), _CAT_TRAIN, "ct_id AS (SELECT 'o' || CAST(doc_id AS VARCHAR) AS id, text, labels FROM tr WHERE text IS NOT NULL "
             "UNION ALL SELECT 'c' || CAST(c.paired_id AS VARCHAR), c.generated, p.label_counter FROM cands c JOIN pairs p ON c.paired_id = p.paired_id "
             "WHERE c.idx = 0 AND c.generated IS NOT NULL)",
             *_features_sql("ct_id", "id", "tr"), *_features_sql("va", "doc_id", "va"), *_features_sql("te", "doc_id", "te")]


@query("cat_train_epochs", sql=W(*_CAT_SETS, *_train_sql(_CAT, "a"), *_predict_sql("a", "pp"), body="""SELECT (SELECT epoch FROM a_e WHERE best) AS epoch,
  (SELECT accuracy FROM a_e WHERE best) AS val_accuracy, avg(CAST(pred = y AS DOUBLE)) AS test_accuracy FROM pp"""),
       doubles=["val_accuracy", "test_accuracy"])
def cat_train_epochs(spark, d):
    """M7: the classifier trained on originals and counterfactuals together, best epoch, test accuracy."""
    train, val, test = _train_val_test(spark, d)
    pairs, cands = TB.conversation_pairs(spark, d)
    gen = cands.filter(F.col("idx") == 0).join(pairs.select("paired_id", "label_counter"), "paired_id")
    made = gen.select(F.concat(F.lit("c"), F.col("paired_id").cast("string")).alias("id"), F.col("generated").alias("text"), F.col("label_counter").cast("int").alias("labels"))
    both = train.select(F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("id"), "text", F.col("labels").cast("int").alias("labels")).unionByName(made)
    both = C.drop_any_null(both)
    weights, epochs, labels = E.train(E.document_features(both, "id"), E.document_features(val, "doc_id"), _CAT)
    feats = E.document_features(test, "doc_id")
    p = E.predict(weights, labels, feats).join(feats.select("id", "label"), "id")
    top = next(e for e in epochs if e["best"])
    return p.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("test_accuracy")).select(
        F.lit(top["epoch"]).cast("long").alias("epoch"), F.lit(top["accuracy"]).alias("val_accuracy"), "test_accuracy")


# --- M3: decoding ---------------------------------------------------------------------------------

_BEAM = DE.Decoding(n=2, beams=2, min_length=3, no_repeat_ngram=2, penalty=1.2, top_k=8, top_p=0.9)
_DRAW = DE.Decoding(n=2, min_length=3, no_repeat_ngram=2, top_k=8, top_p=0.9, seed="draw")
_LONGEST = 6  # generated tokens of a query's text


def _next_sql(s: DE.Decoding) -> list[str]:
    """CTEs of the next-token table ``nx`` over the counterfactuals of each class, and the prompts ``pm``."""
    return [
        TB.PAIRS_SQL(),
        f"tk AS (SELECT label_counter AS label, list_concat(['<s>'], {tokens_sql('counterfactual')}, ['</s>']) AS t FROM pairs WHERE counterfactual IS NOT NULL)",
        "pq AS (SELECT label, t[i] AS prev, t[i + 1] AS token FROM (SELECT label, t, unnest(range(1, len(t))) AS i FROM tk) z)",
        "sc AS (SELECT label, prev, token, CAST(count(*) AS BIGINT) AS c FROM pq GROUP BY ALL)",
        "tt AS (SELECT label, prev, sum(c) AS total FROM sc GROUP BY ALL)",
        f"tp AS (SELECT *, row_number() OVER (PARTITION BY label, prev ORDER BY c DESC, token) AS nth FROM sc QUALIFY nth <= {s.top_k})",
        "hd AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY label, prev ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, "
        "sum(c) OVER (PARTITION BY label, prev) AS al FROM tp)",
        f"nx AS MATERIALIZED (SELECT h.label, h.prev, CAST(t.total AS DOUBLE) AS total, list(struct_pack(token := token, c := c) ORDER BY nth) AS succ "
        f"FROM hd h JOIN tt t ON t.label = h.label AND t.prev = h.prev WHERE bf < {s.top_p}::DOUBLE * al GROUP BY h.label, h.prev, t.total)",
        f"pb AS (SELECT paired_id AS id, label_counter AS label, {tokens_sql("coalesce(example, '')")} AS t FROM pairs)",
        f"pc AS (SELECT id, label, t[1:2] AS seed, least(2 * len(t), {_LONGEST}) AS budget, CASE WHEN len(t) > 0 THEN t[1:2][-1] ELSE '<s>' END AS lt FROM pb)",
        "pm AS MATERIALIZED (SELECT p.id, p.label, p.seed, p.budget, CASE WHEN n.prev IS NULL THEN '<s>' ELSE p.lt END AS prev FROM pc p LEFT JOIN nx n ON n.label = p.label AND n.prev = p.lt)",
    ]


def _allowed_sql(s: DE.Decoding) -> str:
    n = s.no_repeat_ngram
    hist = "list_concat(seed, tokens)"
    return (f"list_filter(succ, lambda e: NOT (e.token = '</s>' AND len(tokens) < {s.min_length}) AND NOT (len({hist}) >= {n} AND "
            f"len(list_filter(range(1, len({hist}) - {n} + 2), lambda i: {hist}[i:i + {n - 1}] = list_append({hist}[len({hist}) - {n} + 2:len({hist})], e.token))) > 0))")


def _beam_sql(s: DE.Decoding) -> list[str]:
    out = ["f0 AS MATERIALIZED (SELECT id, label, seed, budget, prev, CAST([] AS VARCHAR[]) AS tokens, 0::BIGINT AS score, 0 AS scored, budget <= 0 AS done FROM pm)"]
    for k in range(1, _LONGEST + 1):
        out.append(f"o{k} AS (SELECT f.*, total, {_allowed_sql(s)} AS ok FROM f{k - 1} f LEFT JOIN nx n ON n.label = f.label AND n.prev = f.prev WHERE NOT done)")
        out.append(f"e{k} AS (SELECT * EXCLUDE (ok), unnest(CASE WHEN coalesce(len(ok), 0) > 0 THEN ok ELSE [NULL] END) AS e FROM o{k})")
        out.append(f"g{k} AS (SELECT *, e.token AS tok, CAST(coalesce(round(ln(e.c / total) * {DE.MICRO}), 0) AS BIGINT) AS w0 FROM e{k})")
        out.append(f"h{k} AS (SELECT *, CASE WHEN list_contains(list_concat(seed, tokens), tok) THEN CAST(round(w0 * {s.penalty}::DOUBLE) AS BIGINT) ELSE w0 END AS w, "
                   f"tok IS NULL OR tok = '</s>' AS ends FROM g{k})")
        out.append(f"m{k} AS (SELECT id, label, seed, budget, CASE WHEN ends THEN prev ELSE tok END AS prev, CASE WHEN ends THEN tokens ELSE list_append(tokens, tok) END AS tokens, "
                   f"score + w AS score, scored + CAST(tok IS NOT NULL AS INT) AS scored, ends OR len(tokens) + 1 >= budget AS done FROM h{k} "
                   f"UNION ALL SELECT * FROM f{k - 1} WHERE done)")
        out.append(f"f{k} AS MATERIALIZED (SELECT * FROM m{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score::DOUBLE / greatest(scored, 1) DESC, tokens) <= {max(s.beams, s.n)})")
    return out


@query("generate_beam", sql=W(*_next_sql(_BEAM), *_beam_sql(_BEAM), body=f"""SELECT p.id AS paired_id, CAST(i.idx AS BIGINT) AS idx, array_to_string(list_concat(b.seed, b.tokens), ' ') AS generated,
  b.score FROM pm p CROSS JOIN range(0, {_BEAM.n}) i(idx) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score::DOUBLE / greatest(scored, 1) DESC, tokens) - 1 AS idx
  FROM f{_LONGEST}) b ON b.id = p.id AND b.idx = i.idx"""))
def generate_beam(spark, d):
    """M3: beam search over a next-token table of each class's counterfactuals, from the example's first words."""
    pairs, _ = TB.conversation_pairs(spark, d)
    table = DE.next_tokens(pairs.select(F.col("label_counter").alias("label"), "counterfactual"), "counterfactual", ["label"], _BEAM)
    prompts = DE.seeded_prompts(pairs, "paired_id", "example", "label_counter", longest=_LONGEST)
    return DE.beam_search(prompts, table, _BEAM, ["label"], max_steps=_LONGEST).withColumnRenamed("id", "paired_id")


def _draw_sql(s: DE.Decoding) -> list[str]:
    out = [f"f0 AS (SELECT p.*, i.idx, CAST([] AS VARCHAR[]) AS tokens, budget <= 0 AS done FROM pm p CROSS JOIN range(0, {s.n}) i(idx))"]
    for k in range(1, _LONGEST + 1):
        u = f"CAST(('0x' || substr(md5(concat_ws(':', '{s.seed}', CAST(id AS VARCHAR), CAST(idx AS VARCHAR), '{k}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
        out.append(f"o{k} AS MATERIALIZED (SELECT f.*, {_allowed_sql(s)} AS ok, {u} AS u FROM f{k - 1} f LEFT JOIN nx n ON n.label = f.label AND n.prev = f.prev)")
        out.append(f"g{k} AS (SELECT *, list_transform(ok, lambda e: e.c) AS cs FROM o{k})")
        out.append(f"h{k} AS (SELECT *, CASE WHEN NOT done THEN ok[list_filter(range(1, len(cs) + 1), lambda i: list_sum(cs[1:i]) > u * CAST(list_sum(cs) AS DOUBLE))[1]].token END AS tok FROM g{k})")
        out.append(f"f{k} AS MATERIALIZED (SELECT id, label, seed, budget, CASE WHEN ends THEN prev ELSE tok END AS prev, idx, CASE WHEN ends THEN tokens ELSE list_append(tokens, tok) END AS tokens, "
                   f"done OR ends OR len(tokens) + 1 >= budget AS done FROM (SELECT *, tok IS NULL OR tok = '</s>' AS ends FROM h{k}) z)")
    return out


@query("generate_sampled", sql=W(*_next_sql(_DRAW), *_draw_sql(_DRAW), body=f"""SELECT id AS paired_id, CAST(idx AS BIGINT) AS idx,
  array_to_string(list_concat(seed, tokens), ' ') AS generated FROM f{_LONGEST}"""))
def generate_sampled(spark, d):
    """M3: seeded top-k and top-p sampling over the same kind of table."""
    pairs, _ = TB.conversation_pairs(spark, d)
    table = DE.next_tokens(pairs.select(F.col("label_counter").alias("label"), "counterfactual"), "counterfactual", ["label"], _DRAW)
    prompts = DE.seeded_prompts(pairs, "paired_id", "example", "label_counter", longest=_LONGEST)
    return DE.sample(prompts, table, _DRAW, ["label"], max_steps=_LONGEST).withColumnRenamed("id", "paired_id")


# --- C4 / A18: back-off language model ------------------------------------------------------------

_ORDER = 4


def _grams_sql(src: str, cols: str) -> str:
    pads = "[" + ", ".join(["'<s>'"] * (_ORDER - 1)) + "]"
    return (f"SELECT {cols}array_to_string(t[i:i + {_ORDER - 1}], ' ') AS gram FROM (SELECT {cols}t, unnest(range(1, len(t) - {_ORDER - 2})) AS i FROM "
            f"(SELECT {cols}list_concat({pads}, {tokens_sql('text')}, ['</s>']) AS t FROM {src} WHERE text IS NOT NULL) a) b")


def _kn_sql() -> list[str]:
    tail = lambda k: f"array_to_string(list_slice(string_split(gram, ' '), -{k}, -1), ' ')"
    head = "array_to_string(string_split(gram, ' ')[1:-2], ' ')"
    out = [f"k{_ORDER} AS MATERIALIZED (SELECT gram, count(*) AS c FROM ({_grams_sql('documents', '')}) q GROUP BY gram)"]
    out += [f"k{k} AS MATERIALIZED (SELECT {tail(k)} AS gram, count(*) AS c FROM k{k + 1} GROUP BY 1)" for k in range(_ORDER - 1, 0, -1)]
    out.append(f"h0 AS MATERIALIZED (SELECT item_id, gram, count(*) AS n FROM ({_grams_sql('benchmark', 'item_id, ')}) q GROUP BY ALL)")
    out.append("r0 AS (SELECT DISTINCT gram, 0.0::DOUBLE AS p FROM h0)")
    for k in range(1, _ORDER + 1):
        out.append(f"x{k} AS MATERIALIZED (SELECT {head} AS ctx, sum(c) AS total, count(*) AS types FROM k{k} GROUP BY 1)")
        out.append(f"d{k} AS MATERIALIZED (SELECT CASE WHEN count_if(c = 1) > 0 THEN count_if(c = 1) / (count_if(c = 1) + 2 * count_if(c = 2)) ELSE {KN.DISCOUNT} END AS d FROM k{k})")
        below = "1 / (types + 1)" if k == 1 else "p"
        mixed = f"greatest(coalesce(c, 0) - d, 0) / total + d * types / total * {below}"
        out.append(f"r{k} AS MATERIALIZED (SELECT r.gram, CASE WHEN total IS NULL THEN p ELSE {mixed} END AS p FROM (SELECT *, {tail(k)} AS g, "
                   f"array_to_string(list_slice(string_split(gram, ' '), -{k}, -2), ' ') AS ctx FROM r{k - 1}) r "
                   f"CROSS JOIN d{k} LEFT JOIN k{k} ON k{k}.gram = r.g LEFT JOIN x{k} ON x{k}.ctx = r.ctx)")
    return out


@query("kneser_ney_perplexity", sql=W(*_kn_sql(), body=f"""SELECT item_id, CAST(sum(n) AS BIGINT) AS n_tokens, exp(sum(n * -ln(p)) / sum(n)) AS perplexity
  FROM h0 JOIN r{_ORDER} USING (gram) GROUP BY item_id"""), doubles=["perplexity"])
def kneser_ney_perplexity(spark, d):
    """Held-out perplexity of every benchmark item under an interpolated Kneser-Ney model of order 4."""
    model = KN.train(TB.table(spark, d, "documents").select("text"), order=_ORDER)
    losses = KN.token_losses(model, TB.table(spark, d, "benchmark").select("item_id", "text"), "item_id")
    return losses.groupBy("item_id").agg(F.sum("n").alias("n_tokens"), F.exp(M.weighted_mean("nll", "n")).alias("perplexity"))
