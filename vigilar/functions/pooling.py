"""Post-processing of token-level or sentence-level embeddings, and text preparation for a model.

Models themselves are supplied by the caller (see ``predict_batch_udf`` in pyspark.ml);
these are the array expressions around them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token budget of a text, cap of the token counter, and the wrapping template.
DOC_MAX_TOKENS = 400
MAX_TOKENS = 512
PREFIX, SUFFIX = "[INST] ", " [/INST]"

_ROUNDS = 96  # each round keeps at most 400/512 of the words, so this covers 2**34 words


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mean_rows(rows: Column, n: Column) -> Column:
    """Element-wise mean of an ``ARRAY<ARRAY<DOUBLE>>``; NULL if it is empty."""
    width = F.size(F.get(rows, F.lit(0)))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(rows, zero, lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b))
    return F.when(n > 0, F.transform(total, lambda v: v / n))


def masked_mean_pool(states, mask) -> Column:
    """Mean of the token states whose mask is 1."""
    kept = F.filter(F.arrays_zip(_col(states).alias("s"), _col(mask).alias("m")), lambda z: z["m"] == 1)
    rows = F.transform(kept, lambda z: z["s"].cast("array<double>"))
    return _mean_rows(rows, F.size(rows))


def first_token_pool(states) -> Column:
    """State of the first token."""
    return F.get(_col(states), F.lit(0)).cast("array<double>")


def suffix_mean_pool(states, n_suffix) -> Column:
    """Mean of the last ``n_suffix`` token states (mask sums work: the padding is on the left)."""
    n = _col(n_suffix).cast("int")
    rows = F.slice(_col(states).cast("array<array<double>>"), -n, n)
    return F.when(n > 0, _mean_rows(rows, F.size(rows)))


def l2_normalize(vector) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    v = _col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def kept_words(n_words, budget: int = DOC_MAX_TOKENS, cap: int = MAX_TOKENS) -> Column:
    """Words left after repeatedly dropping trailing words until the budget holds.

    Each round keeps ``int(words * budget / tokens)`` words, the token count itself being
    capped, so the result depends on the rounds. Tokens are blank-separated words here.
    """
    def step(n, _):
        tokens = F.least(n, F.lit(cap))
        cut = F.floor(n * (F.lit(float(budget)) / tokens.cast("double"))).cast("long")
        return F.when(tokens > budget, cut).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), _col(n_words).cast("long"), step)


def truncate_words(text, budget: int = DOC_MAX_TOKENS, cap: int = MAX_TOKENS) -> Column:
    """Text cut to the budget; texts within it are returned unchanged."""
    t = _col(text)
    parts = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.size(parts)
    cut = F.array_join(F.slice(parts, 1, kept_words(n, budget, cap).cast("int")), " ")
    return F.when(F.least(n, F.lit(cap)) > budget, cut).otherwise(t)


def wrap_template(text, prefix: str = PREFIX, suffix: str = SUFFIX) -> Column:
    """Right-trim the text and put it into the template; ``STRUCT<full, pooled>``."""
    body = F.concat(F.regexp_replace(_col(text), r"\s+$", ""), F.lit(suffix))
    return F.struct(F.concat(F.lit(prefix), body).alias("full"), body.alias("pooled"))
