"""Quality by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns of all
documents estimates how often each rule casts each vote on good and on bad documents; the posterior
probability of a good document replaces the demand that all rules pass.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rillbook.llm.common import packed, stored, unpacked

GOOD, BAD, ABSTAIN = 1, -1, 0

FEATURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_distinct bigint, n_upper bigint, n_cased bigint, n_shouts bigint, n_bars bigint, n_echoes bigint"
)
_NAMES = [f.split()[0] for f in FEATURES.split(", ")]

#: Separators of words and the characters that count as symbols.
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Case of the characters of the basic plane: 1 upper, 2 lower.
_CASE = np.array([chr(c).isupper() + 2 * chr(c).islower() for c in range(0xFFFF)] + [0], np.uint8)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of five which occurs at least twice, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        key = (key ^ codes[i : i + n]) * _MIX
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    # Equal hashes only suggest a repeat; the words decide.
    at = np.flatnonzero(maybe).tolist()
    seen = Counter(tuple(words[i : i + WINDOW]) for i in at)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + WINDOW])] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def text_features(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    full = Counter(x for x in lines if x.strip(_SPACES))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    _, upper, lower = np.bincount(_CASE[np.minimum(points, 0xFFFF)], minlength=3)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        sum(full.values()) - len(full),
        _repeated(words),
        sum(full.values()),
        len(set(words)),
        int(upper),
        int(upper + lower),
        text.count("!"),
        text.count("|"),
        sum(map(eq, words, words[1:])),
    )


def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_features(t) for t in texts], columns=_NAMES, dtype="int64")


@dataclass(frozen=True)
class Rule:
    name: str
    bad: str
    good: str


#: The distinct words of a text grow at least with the root of its length: few are fewer than the root of this many times
#: its words. Up to 3000 words a fifth of the words is the lower limit.
GROWTH = 120

#: SQL conditions over the features; where neither holds, or both do, the rule abstains. Kinds of junk exclude
#: each other, so the absence of one kind is no vote for a document: its rule only votes bad.
RULES = (
    Rule("length", "n_words < 10", "n_words >= 50"),
    Rule("word_length", "word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 7 * n_words"),
    Rule("variety", f"n_words >= 50 AND 10 * n_distinct < 2 * n_words AND n_distinct * n_distinct < {GROWTH} * n_words", "10 * n_distinct >= 5 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "false"),
    Rule("lines", "n_lines >= 3 AND 10 * n_dup_lines > 5 * n_lines", "false"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "false"),
    Rule("echoes", "4 * n_echoes > n_words", "false"),
    Rule("capitals", "n_cased >= 50 AND 10 * n_upper > 4 * n_cased", "false"),
    Rule("shouting", "10 * n_shouts > n_words", "false"),
    Rule("tables", "10 * n_bars > n_words", "false"),
)


def base_failed(q: str = "q") -> Column:
    """The hard limits: under ten words, or over a fifth of the words in repeated windows."""
    words, repeated = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    return (words < 10) | (100 * repeated > 20 * words)


def votes(rules=RULES, q: str = "q") -> list[Column]:
    """One column of -1, 0 or 1 per rule."""
    def on(condition: str) -> Column:
        expr = condition
        for name in sorted(_NAMES, key=len, reverse=True):
            expr = expr.replace(name, f"{q}.{name}")
        return F.expr(expr)

    return [
        F.when(on(r.bad) & ~on(r.good), BAD).when(on(r.good) & ~on(r.bad), GOOD).otherwise(ABSTAIN).cast("int").alias(f"v_{r.name}")
        for r in rules
    ]


#: P(bad vote), P(abstains), P(good vote) on bad and on good documents before any data is seen, for rules
#: that vote both ways and for rules that only vote bad.
PRIOR_BOTH = np.array([[0.2, 0.2, 0.6], [0.002, 0.098, 0.9]])
PRIOR_BAD_ONLY = np.array([[0.2, 0.799, 0.001], [0.002, 0.997, 0.001]])
PRIOR_GOOD = 0.9


@dataclass
class LabelModel:
    """Share of good documents, and P(vote | class) of each rule as ``table[rule, class, vote + 1]``."""

    prior: float
    table: np.ndarray

    def weights(self) -> np.ndarray:
        """Log odds that a bad vote, an abstention and a good vote of each rule add."""
        return np.log(self.table[:, 1]) - np.log(self.table[:, 0])


def fit(patterns: np.ndarray, counts: np.ndarray, rules=RULES, rounds: int = 500, trust: float = 0.05) -> LabelModel:
    """Expectation-maximisation for rules that are independent given the class.

    The priors count as much as ``trust`` times the documents: they tell the classes apart at the start
    and keep every vote possible. Without documents they are the answer.
    """
    before = np.stack([PRIOR_BAD_ONLY if r.good == "false" else PRIOR_BOTH for r in rules])
    model, n = LabelModel(PRIOR_GOOD, before), float(counts.sum())
    if not n:
        return model
    cast = np.stack([patterns == v for v in (BAD, ABSTAIN, GOOD)], -1)
    last = np.zeros(len(counts))
    for _ in range(rounds):
        logit = np.log(model.prior / (1 - model.prior)) + np.einsum("prv,rv->p", cast, model.weights())
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        weight = np.stack([counts * (1 - good), counts * good])
        # Each class gets its share of the prior documents.
        held = trust * n * np.array([1 - PRIOR_GOOD, PRIOR_GOOD])
        table = np.einsum("cp,prv->rcv", weight, cast) + held[None, :, None] * before
        table /= table.sum(-1, keepdims=True)
        model = LabelModel(float((weight[1].sum() + held[1]) / (n + held.sum())), table)
        if np.abs(good - last).max() < 1e-9:
            break
        last = good
    return model


def posterior(model: LabelModel, names: list[str]) -> Column:
    logit = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for name, w in zip(names, model.weights()):
        logit = logit + F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col(name) + 2)
    return 1 / (1 + F.exp(-logit))


def judged(docs: DataFrame, rules=RULES, cut: float = 0.5) -> tuple[DataFrame, LabelModel]:
    """(row, q, the votes, base_failed, p_good, kept) per document, and the fitted model.

    The texts are read by Python once; the result is stored and serves both the fit and the verdicts.
    The fit sees the counts of all vote patterns, at most 3 to the number of rules. Null texts have no
    words and fail. An empty table gives an empty result.
    """
    rows = packed(docs).select("row", F.pandas_udf(_features, FEATURES)(F.col("row.text")).alias("q"))
    table = stored(rows.select("row", "q", *votes(rules)), "quality")
    names = [f"v_{r.name}" for r in rules]
    seen = table.groupBy(*names).count().collect()
    seen.sort(key=tuple)
    patterns = np.array([r[:-1] for r in seen], dtype=int).reshape(len(seen), len(names))
    model = fit(patterns, np.array([r[-1] for r in seen], dtype=float), rules)
    out = table.withColumns({"base_failed": base_failed(), "p_good": posterior(model, names)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= cut)), model


def quality_report(docs: DataFrame, rules=RULES, cut: float = 0.5) -> DataFrame:
    """Counts, hard limits, posterior and verdict of every document."""
    table, _ = judged(docs.select("doc_id", "text"), rules, cut)
    return table.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.col(f"q.{n}").alias(n) for n in _NAMES[:5]],
        "base_failed", "kept", "p_good",
    )


def good_documents(docs: DataFrame, rules=RULES, cut: float = 0.5) -> DataFrame:
    """The rows that stay, with all their columns."""
    table, _ = judged(docs, rules, cut)
    return unpacked(table.filter("kept"))
