"""Quality rules as a short-circuit cascade: cost and selectivity of each rule are estimated on a sample of rows, and
rules run in the order of rejections per second. A text stops at the first rule that rejects it; the verdict is the same
in any order, so the estimate only moves work."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import extended, leaving_nothing

#: Rows on which costs are estimated. Only the order of rules depends on them.
SAMPLE = 200
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


class Text:
    """A text's measures, each taken once and only if a rule or the output asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_upper(self) -> int:
        raw = np.frombuffer(self.text.encode("utf-8", "surrogatepass"), np.uint8)
        return int(((raw >= 65) & (raw <= 90)).sum())

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in five-word windows that occur twice or more."""
        n = len(self.words)
        if n < 6:
            return 0
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in self.words), np.int64, n)
        pair = w[:-1] * len(ids) + w[1:]  # exact: texts have far fewer than 2**31 distinct words
        pair = np.unique(pair, return_inverse=True)[1]
        four = np.unique(pair[:-2] * (pair.max() + 1) + pair[2:], return_inverse=True)[1]
        five = np.unique(four[:-1] * len(ids) + w[4:], return_inverse=True)[1]
        again = np.bincount(five)[five] > 1
        covered = np.zeros(n, bool)
        for k in range(5):
            covered[k : k + len(again)] |= again
        return int(covered.sum())


Rule = Callable[[Text], bool]

#: Each says whether it rejects. The first two are the base rules.
RULES: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 100 * t.n_symbols > 50 * t.n_words,
    "repeated_lines": lambda t: 100 * t.n_dup_lines > 30 * len(t.lines),
    "long_words": lambda t: t.word_chars > 20 * t.n_words,
    "capitals": lambda t: 100 * t.n_upper > 50 * t.word_chars,
}


def rule_order(docs: DataFrame, rules: dict[str, Rule] = RULES, sample: int = SAMPLE) -> list[str]:
    """Names of rules by rejections per second on a sample of at most `sample` rows, those with the least hashes."""
    ids = docs.select(F.col("doc_id").alias("__id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").limit(sample).toPandas()
    rate = {}
    for name, rule in rules.items():
        texts = [Text(t if isinstance(t, str) else None) for t in few["text"]]
        began = time.perf_counter()
        hits = sum(map(rule, texts))
        rate[name] = (hits + 0.5) / (time.perf_counter() - began + 1e-9)
    return sorted(rules, key=lambda name: -rate[name])


def judged(docs: DataFrame, order: list[str] | None = None, rules: dict[str, Rule] = RULES) -> DataFrame:
    """docs with rejected_by: the first rule of the cascade that rejects the text, null for those kept.

    Null and empty texts have no words and go. Rows are judged one by one, so ties and repeats need no rule. An empty
    table gives an empty one. A column named rejected_by is replaced. Whether a text is kept does not depend on the order;
    which of several rules that reject it comes first does, and an order that is not given is measured in seconds, so it may
    differ between runs.
    """
    docs = docs.drop("rejected_by")
    order = order or rule_order(docs, rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = (Text(t if isinstance(t, str) else None) for t in batch["text"])
            yield batch.assign(rejected_by=pd.Series([next((name for name in order if rules[name](t)), None) for t in texts], dtype=object, index=batch.index))

    return docs.mapInPandas(leaving_nothing(run), extended(docs, rejected_by="string"))


def measured(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the base measures, base_failed and kept. Null and empty texts measure 0 and fail. Repeated rows
    and null ids give a row each; an empty table gives an empty one; other columns are not read. The base measures are asked
    for, so the cascade's order saves only the rules behind them; it never changes the verdict."""
    order = rule_order(docs)
    rest = [x for x in order if x not in ("few_words", "repeated_words")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                t = Text(text if isinstance(text, str) else None)
                failed = RULES["few_words"](t) or RULES["repeated_words"](t)
                kept = not failed and not any(RULES[name](t) for name in rest)
                rows.append((doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(leaving_nothing(run), schema)
