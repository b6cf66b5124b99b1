"""Quality rules by weak supervision.

Ten rules look at a text and each votes low (-1), good (+1) or abstains (0). Nobody says which
rules are right: expectation-maximisation over how often each combination of votes occurs
estimates, for either class, how often a rule that votes votes good, and with that the posterior
probability that a document is good. An abstention is no evidence: short texts, on which many
rules abstain, are judged by those that vote. A document goes where that probability is below ``keep_at``.

The combinations are at most 3**10 however many documents there are, so the driver's part is of
fixed size; counting them is one map-side combined aggregation and applying them is an expression.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialise, trim

RULES = ("symbols", "shouting", "upper_case", "repeats", "length", "endings", "same_lines", "variety", "function_words", "cells")
KEEP_AT = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*~^<>{}[]\\@_=+")] = True
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it on with as was be by le la les de des du et un une en est que qui dans pour sur au der die das und ist von zu den "
    "ein eine mit im auf nicht el los las y del se por con una para al lo su es".split()
)


def _vote(value: float, low: bool, good: bool) -> int:
    return -1 if low else 1 if good else 0


def votes_of(text: str) -> tuple[int, ...]:
    """The ten votes on one text, in the order of ``RULES``. All of the text is looked at. The rules
    on length and function words, which count words between spaces and words of four languages,
    vote low only on texts that are written in Latin letters for the most part."""
    words = text.split()
    n = len(words)
    if n == 0:
        return (0, 0, 0, 0, -1, -1, 0, 0, -1, 0)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    foreign = counts[128:].sum() * 2 > counts.sum()
    symbols = counts[_SYMBOL].sum() / n
    bangs = (counts[33] + counts[63]) / n
    upper, lower = counts[_UPPER].sum(), counts[_LOWER].sum()
    upper_share = upper / max(1, upper + lower)
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x]
    ended = sum(x.rstrip()[-1:] in (".", "!", "?", '"', ")", "…", "。") for x in lines) / max(1, len(lines))
    same = 1 - len(set(lines)) / max(1, len(lines))
    variety = len(set(zip(words, words[1:]))) / n
    known = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    cells = counts[124] / n
    return (
        _vote(symbols, symbols > 0.3, symbols < 0.03),
        _vote(bangs, bangs > 0.15, bangs < 0.03),
        _vote(upper_share, upper + lower >= 20 and upper_share > 0.3, upper_share < 0.12),
        _vote(repeats, repeats > 0.2, repeats < 0.05),
        _vote(n, n < 4 and not foreign, n >= 20),
        _vote(ended, ended < 0.3, ended > 0.8),
        _vote(same, len(lines) > 4 and same > 0.3, len(lines) > 1 and same < 0.05),
        _vote(variety, n >= 20 and variety < 0.35, n >= 20 and variety > 0.7),
        _vote(known, known < 0.03 and n >= 20 and not foreign, known > 0.15),
        _vote(cells, cells > 0.2, cells < 0.02),
    )


def encode_votes(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def decode_votes(code: int) -> tuple[int, ...]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return tuple(reversed(out))


@F.pandas_udf(T.IntegerType())
def _codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: encode_votes(votes_of(t)) if t is not None else -1).astype("int32")
    trim()


def vote_code(text: Column) -> Column:
    """All votes on a text as one integer in base 3; -1 where the text is null."""
    return _codes(text)


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote combinations. Returns the share of good documents and,
    by class (low, good), rule and vote, the probability of the vote (1 for abstentions). Starts from the low
    votes - the more of them, the likelier a document is low, and with none it is good - so that the
    second class is the good one; each probability is smoothed by one vote."""
    if len(codes) == 0:
        return 0.5, np.ones((2, len(RULES), 3))
    votes = np.array([decode_votes(int(c)) for c in codes])
    weight = counts.astype(float)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = 1 / (1 + np.exp(-(votes.clip(-1, 0).sum(1) * 3.0 + 3.5)))
    prior, table = 0.5, np.ones((2, len(RULES), 3))
    for _ in range(rounds):
        r = np.stack([1 - good, good]) * weight
        prior = float((r[1].sum() + 1) / (weight.sum() + 2))
        table = np.einsum("cp,prv->crv", r, onehot) + 1.0
        table[:, :, 1] = 0
        table /= table.sum(2, keepdims=True)
        table[:, :, 1] = 1
        logs = np.einsum("crv,prv->cp", np.log(table), onehot) + np.log([1 - prior, prior])[:, None]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return prior, table


def posterior(code: Column, prior: float, table: np.ndarray) -> Column:
    """The posterior as an expression over the code: a look-up of each rule's log-odds."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for k in range(len(RULES)):
        weights = [float(np.log(table[1, k, v] / table[0, k, v])) for v in range(3)]
        digit = F.pmod(F.floor(code / F.lit(3 ** (len(RULES) - 1 - k))), F.lit(3)).cast("int")
        odds = odds + F.when(digit == 0, F.lit(weights[0])).when(digit == 1, F.lit(weights[1])).otherwise(F.lit(weights[2]))
    return F.when(code < 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-odds)))


def _fit_on(coded: DataFrame, code: str) -> tuple[float, np.ndarray]:
    # 3**10 rows at most; nulls are sorted out here, as a filter would be pushed below and vote again
    rows = sorted(r for r in coded.groupBy(code).count().collect() if r[0] >= 0)
    return fit(np.array([r[0] for r in rows], dtype=int), np.array([r[1] for r in rows], dtype=float))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """A row for every row of ``docs``: doc_id, votes (an array in the order of ``RULES``),
    p_quality and keep.

    A null text has no votes, p_quality 0 and keep false; an empty or blank one gets the votes of
    the rules on length, line ends and function words. Repeated rows count as often as they occur
    and all come back. An empty table gives an empty result. Other columns of ``docs`` are not
    looked at and don't come back."""
    bound_batches(docs)
    coded = materialise(docs.select(F.col(id_col).alias("doc_id"), vote_code(F.col(text_col)).alias("code")), "votes")
    prior, table = _fit_on(coded, "code")
    votes = F.array(*[(F.pmod(F.floor(F.col("code") / F.lit(3 ** (len(RULES) - 1 - k))), F.lit(3)) - 1).cast("int") for k in range(len(RULES))])
    p = posterior(F.col("code"), prior, table)
    return coded.select("doc_id", F.when(F.col("code") >= 0, votes).alias("votes"), F.round(p, 6).alias("p_quality"), (p >= F.lit(keep_at)).alias("keep"))


def keep_good(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``keep_at``, with all their columns.
    The votes are made twice, once to count and once to decide: that is two scans and no shuffle
    of texts. Null texts go."""
    bound_batches(docs)
    code = vote_code(F.col(text_col))
    prior, table = _fit_on(docs.select(code.alias("code")), "code")
    return docs.filter(posterior(code, prior, table) >= F.lit(keep_at))
