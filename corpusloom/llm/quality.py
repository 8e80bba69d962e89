"""Quality rules as a short-circuit cascade.

Each rule's cost and rejections are estimated on a bounded sample of texts as the cascade meets them: those that pass the base
rules, with the measures that are reported for every text already taken. The cascade asks the rule with the most rejections per
second of cost first, then the best on what that one lets pass, and so on, and stops at the first rule that rejects. The
verdict, that no rule rejects, doesn't depend on the order.
"""

from __future__ import annotations

import copy
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


class Text:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

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
        """Lines that have a word."""
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of five words that occurs twice or more in the text."""
        windows = list(zip(*(self.words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times, inside, upto = Counter(windows), 0, 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                inside += i + WINDOW - max(i, upto)
                upto = i + WINDOW
        return inside

    def measured(self) -> tuple[int, int, int, int, int]:
        """The measures that are reported for every text, whatever the rules."""
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words

    @cached_property
    def letter_share(self) -> float:
        """Share of the words' bytes that are letters or beyond ASCII; 1 without words."""
        joined = b"".join(self.words)
        return len(joined.translate(None, NO_LETTERS)) / len(joined) if joined else 1.0

    @cached_property
    def top_word(self) -> int:
        return max(Counter(w for w in self.words if len(w) > 3).values(), default=0)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


BASE = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)
RULES = (
    Rule("many_symbols", lambda t: t.n_symbols > 0.15 * t.n_words),
    Rule("repeated_lines", lambda t: t.n_dup_lines > max(2.0, 0.3 * len(t.lines))),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("few_letters", lambda t: t.letter_share < 0.6),
    Rule("one_word", lambda t: t.n_words >= 20 and t.top_word > 0.25 * t.n_words),
    Rule("bullets", lambda t: sum(x.lstrip(SPACES)[:1] in "•*-" for x in t.lines) > 0.9 * len(t.lines) > 2.7),
    Rule("ellipses", lambda t: sum(x.rstrip(SPACES).endswith(("...", "…")) for x in t.lines) > 0.3 * len(t.lines) > 0.9),
)


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float  # for each text that is asked
    rejected: float  # share of the texts that reach the rule


def order_rules(texts: Sequence[str | None], rules: Sequence[Rule], base: Sequence[Rule] = BASE,
                clock: Callable[[], float] = time.perf_counter) -> list[Estimate]:
    """The rules by rejections per second on the texts that the rules before let pass; ties by name. No texts: as given.

    Texts that a ``base`` rule rejects never reach the cascade and are not asked. Each rule meets texts whose reported measures
    have been taken, as in :func:`judge`, and pays for what it computes beyond them.
    """
    left, rest, out = [Text(t) for t in texts], list(rules), []
    for t in left:
        t.measured()
    left = [t for t in left if first_rejection(t, base) is None]
    while rest:
        tried = []
        for rule in rest:
            fresh = [copy.copy(t) for t in left]  # so that a rule's own measures are not there for the next
            began = clock()
            verdicts = [rule.rejects(t) for t in fresh]
            cost = (clock() - began) / max(1, len(left)) + 1e-9
            tried.append((-(sum(verdicts) / max(1, len(left))) / cost, cost, rule.name, rule, verdicts))
        _, cost, name, best, verdicts = min(tried, key=lambda x: x[:3]) if left else tried[0]
        out.append(Estimate(name, cost, sum(verdicts) / max(1, len(left))))
        left = [t for t, rejected in zip(left, verdicts, strict=True) if not rejected]
        rest.remove(best)
    return out


def first_rejection(text: Text, cascade: Sequence[Rule]) -> str | None:
    return next((rule.name for rule in cascade if rule.rejects(text)), None)


def fit_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_docs: int = 400, text: str = "text", key: str = "doc_id") -> list[Rule]:
    """The rules in the order that a sample of at most ``sample_docs`` texts, read to the driver, calls for.

    Rows are picked by a hash of id and text, so that copies are picked one by one; null texts are not asked.
    """
    share, spread = min(1.0, sample_docs / max(1, docs.count())), 1 << 40
    place = F.pmod(F.xxhash64(key, text), F.lit(spread))
    picked = docs.where(F.col(text).isNotNull()).select(text, place.alias("_place")).where(F.col("_place") < int(share * spread))
    sample = picked.orderBy("_place").limit(sample_docs)
    of = {r.name: r for r in rules}
    return [of[e.rule] for e in order_rules([r[0] for r in sample.collect()], rules)]


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(cascade: Sequence[Rule], text: str = "text") -> Column:
    """A struct of the measures, whether a base rule rejects, and whether the text is kept.

    A null text counts as empty: it has no words and fails. The cascade is asked only about texts that pass the base rules,
    and reuses what they have measured.
    """
    cascade = list(cascade)

    @F.pandas_udf(MEASURES)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = []
            for value in series:
                t = Text(value)
                measures = t.measured()
                failed = first_rejection(t, BASE) is not None
                rows.append((*measures, failed, not failed and first_rejection(t, cascade) is None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return judged(F.col(text))
