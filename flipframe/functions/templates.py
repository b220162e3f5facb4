"""Prompt templates as ordered literal substitutions (a fold of ``replace`` expressions).

The substitutions run in a fixed order and replace every occurrence, so a placeholder that
appears inside user text after an earlier substitution is replaced as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipframe.functions.util import as_col

# --- fixed values -------------------------------------------------------------------------
SPECIAL_TOKENS = {
    "bos_token": "<|BOS|>",
    "eos_token": "<|EOS|>",
    "unk_token": "<|UNK|>",
    "pad_token": "<|PAD|>",
    "sep_token": "<|SEP|>",
}
LABEL_WORDS = {0: "Negative", 1: "Positive"}
SENTIMENT_TEMPLATES = {
    "1": "<bos_token><label_ex> review:<sep><example_text><sep><label_counter> review:<sep><counter_text><eos_token>",
    "2": "<bos_token>The movie is <label_ex>.<sep><example_text><sep>The movie is <label_counter>.<sep> <counter_text><eos_token>",
    "3": "bos_token><label_ex> review:<sep>\n<example_text><sep><label_counter> review:<sep>\n<counter_text><eos_token>",
}
SENTIMENT_GENERATION_PROMPTS = {
    "1": "<bos_token><label_ex> review:<sep><example_text><sep><label_counter> review:<sep>",
    "2": "<bos_token>The movie is <label_ex>.<sep><example_text><sep>The movie is <label_counter>.<sep>",
    "3": "bos_token><label_ex> review:<sep>\n<example_text><sep><label_counter> review:<sep>\n",
}
NLI_TEMPLATE = ("<bos_token>Label: <original_label>\n<sep>P: <P>\n<sep>H: <H>\n<sep>"
                "Counterfactual Label: <counter_label>\n<sep><TC>: <counter_text><eos_token>")
NLI_GENERATION_PROMPT = ("<bos_token>Label: <original_label>\n<sep>P: <P>\n<sep>H: <H>\n<sep>"
                         "Counterfactual Label: <counter_label>\n<sep><TC>: ")
# Template "3" lacks the "<" of its first placeholder, so that token is never substituted.
# Generation length budget: twice the prompt tokens, at most 1024; minimum output length 5.
LENGTH_BUDGET_FACTOR = 2
LENGTH_BUDGET_MAX = 1024
MIN_OUTPUT_LENGTH = 5
# ------------------------------------------------------------------------------------------


def label_word(label, words: dict[int, str] = LABEL_WORDS) -> Column:
    """int label -> label word via a literal map (no join, no UDF)."""
    m = F.create_map(*[x for k, v in sorted(words.items()) for x in (F.lit(k), F.lit(v))])
    return m[as_col(label)]


def _special_token_steps(spec_tokens):
    if spec_tokens is None or spec_tokens == "None":
        return []
    return [("<sep>", F.lit(spec_tokens["sep_token"])),
            ("<bos_token>", F.lit(spec_tokens["bos_token"])),
            ("<eos_token>", F.lit(spec_tokens["eos_token"]))]


def _fold(template: str, steps) -> Column:
    out = F.lit(template)
    for placeholder, value in steps:
        out = F.replace(out, F.lit(placeholder), value)
    return out


def seed_word(example, i: int) -> Column:
    """i-th space-separated word of the seed, '' when the seed is shorter."""
    return F.coalesce(F.get(F.split(as_col(example), " ", -1), i), F.lit(""))


def wrap_sentiment(template: str, example="example", label_ex="label_ex", label_counter="label_counter",
                   counterfactual="counterfactual", spec_tokens=SPECIAL_TOKENS,
                   label_words: dict[int, str] = LABEL_WORDS) -> Column:
    steps = [("<label_ex>", label_word(label_ex, label_words)),
             ("<example_text>", as_col(example)),
             ("<label_counter>", label_word(label_counter, label_words))]
    if "<counter_text>" in template:
        steps.append(("<counter_text>", as_col(counterfactual)))
    steps += _special_token_steps(spec_tokens)
    steps += [(f"<{i}>", seed_word(example, i)) for i in range(3)]
    return _fold(template, steps)


def nli_counter_text(task="task", counter_prem="counter_prem", counter_hyp="counter_hyp") -> Column:
    return F.when(as_col(task) == "RP", as_col(counter_prem)).otherwise(as_col(counter_hyp))


def wrap_nli(template: str = NLI_TEMPLATE, spec_tokens=SPECIAL_TOKENS) -> Column:
    steps = [("<original_label>", F.col("original_label")),
             ("<P>", F.col("original_prem")),
             ("<H>", F.col("original_hyp")),
             ("<counter_label>", F.col("counter_label")),
             ("<TC>", F.col("task")),
             ("<counter_text>", nli_counter_text())]
    steps += _special_token_steps(spec_tokens)
    return _fold(template, steps)


def length_budget(prompt_tokens) -> Column:
    """Per-row maximum generation length from the prompt's token count."""
    n = as_col(prompt_tokens)
    return F.least(n * LENGTH_BUDGET_FACTOR, F.lit(LENGTH_BUDGET_MAX)).cast("long")


def prefix_with_seed_words(candidate, example, indexes: list[int]) -> Column:
    """Prepend the chosen seed words (by position) to a candidate text, space separated."""
    words = F.split(as_col(example), " ", -1)
    parts = [F.get(words, int(i)) for i in indexes]
    return F.concat_ws(" ", *parts, as_col(candidate))


def parse_index_list(text: str) -> list[int]:
    """'[0, 2]' or '0,2' -> [0, 2] without evaluating code."""
    body = text.strip().strip("[]()")
    return [int(x) for x in body.split(",") if x.strip()]
