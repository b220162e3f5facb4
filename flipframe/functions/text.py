"""Column expressions over text: tokeniser, sizes, HTML strip, truncation, padding.

All functions return ``Column`` objects built from built-in Spark expressions so they stay
inside whole-stage codegen; none of them needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flipframe.functions.util import as_col

# --- fixed values -------------------------------------------------------------------------
# Word tokeniser: a run of letters/digits/underscore, or one other non-space character.
# The same pattern is valid in Java regex (Spark) and RE2 (DuckDB oracle).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Markup removed before tag stripping: comments and script/style bodies (their text is not page text).
HTML_BLOCK_PATTERN = r"(?is)<(?:!--.*?--|script[^>]*>.*?</script|style[^>]*>.*?</style)>"
HTML_TAG_PATTERN = r"<[^>]*>"
# Scoring length rule: texts longer than 512 characters are cut to their first 511.
SCORE_MAX_CHARS = 512
SCORE_CUT_CHARS = 511
# Values that pandas' CSV reader turns into NaN by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]
# ------------------------------------------------------------------------------------------


def word_tokens(text) -> Column:
    """ARRAY<STRING> of word tokens (not lower-cased)."""
    return F.regexp_extract_all(as_col(text), F.lit(TOKEN_PATTERN), 0)


def line_tokens(text) -> Column:
    """The word tokens of each line, an array per line; null for a null text."""
    return F.transform(F.split(as_col(text), "\n", -1), word_tokens)


def token_count(text) -> Column:
    return F.size(word_tokens(text)).cast("long")


def space_word_count(text) -> Column:
    """``len(text.split(" "))``: consecutive spaces give empty words that count."""
    return F.size(F.split(as_col(text), " ", -1)).cast("long")


def char_count(text) -> Column:
    return F.length(as_col(text)).cast("long")


def _entity_table() -> tuple[dict[str, str], list[str]]:
    """HTML character references by name (with the final ``;``) from the standard library's table,
    and the old names that also count without it, longest first."""
    from html.entities import html5

    named = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return named, sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)


def _from_code_point(code: Column) -> Column:
    """The character of a numeric reference: 0x80-0x9F read as Windows-1252, as browsers do; U+FFFD
    for zero, surrogates and numbers beyond Unicode."""
    bad = code.isNull() | (code == 0) | ((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF)
    c1 = F.array(*[F.lit(ord(bytes([b]).decode("cp1252", "ignore") or chr(b))) for b in range(0x80, 0xA0)])
    code = F.when((code >= 0x80) & (code <= 0x9F), F.get(c1, (code - 0x80).cast("int"))).otherwise(code)
    return F.when(bad, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))


def decode_entities(text) -> Column:
    """All named and numeric character references decoded in one pass (``&amp;lt;`` gives ``&lt;``).

    A text that holds only the few names that pages are full of has them replaced one after the
    other, ``&amp;`` last, so that no replacement makes a new reference.  Any other text is split
    at ``&``; each later piece that starts with a reference has it replaced.
    """
    named, bare = _entity_table()
    # one string literal that folds to a map: thousands of literals would slow every plan down
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in named.items())), F.lit("\x01"), F.lit("\x02"))
    bare_map = F.str_to_map(F.lit("\x01".join(f"{k}\x02{named[k]}" for k in bare)), F.lit("\x01"), F.lit("\x02"))
    bare_pattern = "^(" + "|".join(bare) + ")"
    common = ("lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "amp")
    rare = "&(?!(?:" + "|".join(common) + ");)[#A-Za-z]"

    def full(p: Column) -> Column:
        number = F.regexp_extract(p, "^(#[xX][0-9a-fA-F]+|#[0-9]+);?", 1)
        name = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*);", 1)
        old = F.regexp_extract(p, bare_pattern, 1)
        digits = F.regexp_extract(number, "^#[xX]?0*(.*)$", 1)
        code = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(
            F.when(F.rlike(number, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(F.when(digits == "", "0").otherwise(digits)).cast("long"))
        skip = F.length(number) + F.when(F.substring(p, F.length(number) + 1, F.lit(1)) == ";", 1).otherwise(0)
        value = F.when(name != "", table[name])
        return (F.when(number != "", F.concat(_from_code_point(code), F.substring(p, skip + 1, F.length(p))))
                .when(value.isNotNull(), F.concat(value, F.substring(p, F.length(name) + 2, F.length(p))))
                .when(old != "", F.concat(bare_map[old], F.substring(p, F.length(old) + 1, F.length(p))))
                .otherwise(F.concat(F.lit("&"), p)))

    c = as_col(text)
    simple = c
    for k in common:
        simple = F.replace(simple, F.lit(f"&{k};"), F.lit(named[k]))
    parts = F.split(c, "&", -1)
    decoded = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), full), ""))
    return F.when(~F.contains(c, F.lit("&")), c).when(F.rlike(c, F.lit(rare)), decoded).otherwise(simple)


def strip_html(html) -> Column:
    """Visible text of an HTML fragment: drop comments/script/style, drop tags, decode entities."""
    c = as_col(html)
    bare = F.regexp_replace(F.regexp_replace(c, HTML_BLOCK_PATTERN, ""), HTML_TAG_PATTERN, "")
    return decode_entities(F.when(F.contains(c, F.lit("<")), bare).otherwise(c))


def truncate_for_scoring(text) -> Column:
    c = as_col(text)
    return F.when(F.length(c) > SCORE_MAX_CHARS, F.substring(c, 1, SCORE_CUT_CHARS)).otherwise(c)


def between_markers(text, start: str, end: str) -> Column:
    """Text between two literal markers (first occurrence); empty when absent."""
    import re

    pattern = "(?s)" + re.escape(start) + "(.*?)" + re.escape(end)
    return F.regexp_extract(as_col(text), pattern, 1)


def null_tokens_to_null(c, tokens=NA_TOKENS) -> Column:
    """What pandas' reader would call missing becomes a real null."""
    c = as_col(c)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def null_to_none(c) -> Column:
    """Missing text becomes the literal string ``"None"`` (the prompt code's convention)."""
    return F.coalesce(as_col(c), F.lit("None"))


def pad_ids(ids, length: int, pad_id: int = 0) -> tuple[Column, Column, Column]:
    """Truncate/pad an id array to ``length``; returns (input_ids, attention_mask, labels).

    ``labels`` is a copy of ``input_ids`` including the pad positions.
    """
    ids = as_col(ids)
    n = F.size(ids)
    pad_n = F.greatest(F.lit(length) - n, F.lit(0))
    input_ids = F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad_id), pad_n))
    mask = F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(length))), F.array_repeat(F.lit(0), pad_n))
    return input_ids, mask, input_ids
