"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols (insult, threat, target, negation, reporting, other) by a weighted lexicon. Three transducers
over these symbols (negation scope, reported speech, attack) are composed into one machine, which reads a clause and adds up
the weights of what it matches, so that a negated or quoted insult counts less and a threat counts only with a target of its own language.
Insults, whole words or stems, their weights and the weight of a threat with a target are learned from labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LETTERS, exact_words, rough_words

CLAUSES = re.compile(r"[.!?;:\n]+")
MEMORY = 600_000
STEMS = (6, 5, 4)  # lengths of stems, tried from the longest

# Closed classes of four languages. Targets are those that can be addressed by a threat of the same language; everyday words with
# other meanings there, such as German ihr (her) or French ton (tone), are none.
TARGETS_OF = {"en": frozenset("you your yours u ur".split()), "de": frozenset("du dich dir dein deine euch".split()),
              "fr": frozenset("tu te toi vous votre".split()), "es": frozenset("te tú ti usted ustedes vosotros".split())}
TARGETS = frozenset().union(*TARGETS_OF.values())
NEGATIONS = frozenset("not no never nobody isn aren wasn don doesn nicht kein keine nie pas jamais aucun nunca jamás".split())
REPORTING = frozenset("said says say called calls wrote writes claimed quoted reported sagte nannte schrieb dit disait appelé dijo llamó escribió".split())
THREATS_OF = {"en": frozenset("kill hurt destroy punch stab shoot".split()), "de": frozenset("töten umbringen verletzen schlagen".split()),
              "fr": frozenset("tuer tuerai frapper détruire".split()), "es": frozenset("matar herir golpear destruir".split())}
THREATS = frozenset().union(*THREATS_OF.values())
THREAT_WEIGHT = 4.0  # of a model made by hand; learn() finds the weight that the labels support


@dataclass
class Transducer:
    """Deterministic and weighted: ``arcs[state, symbol] = (next state, output symbol, factor)``; other symbols pass as they are."""

    arcs: dict[tuple, tuple] = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (self.rest(state), symbol, 1.0))

    def rest(self, state):
        return self.arcs.get((state, None), (state, None, 1.0))[0]


def compose(first: Transducer, second: Transducer, symbols: Iterable[str]) -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``; factors multiply."""
    symbols = list(symbols)
    out = Transducer(start=(first.start, second.start))
    todo, seen = [out.start], {out.start}
    while todo:
        a, b = state = todo.pop()
        for symbol in symbols:
            a2, middle, x = first.step(a, symbol)
            b2, last, y = second.step(b, middle)
            out.arcs[state, symbol] = ((a2, b2), last, x * y)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return out


INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = SYMBOLS = "ITGNRO"


def negation_scope(words: int = 3, factor: float = 0.35) -> Transducer:
    """A negation discounts insults and threats among the next few words."""
    arcs = {}
    for left in range(words + 1):
        arcs[left, NEGATION] = (words, NEGATION, 1.0)
        arcs[left, None] = (max(0, left - 1), None, 1.0)
        if left:
            for symbol in (INSULT, THREAT):
                arcs[left, symbol] = (left - 1, symbol, factor)
    return Transducer(arcs)


def reported_speech(factor: float = 0.6) -> Transducer:
    """After a verb of saying the rest of the clause is somebody else's."""
    arcs = {(0, REPORT): (1, REPORT, 1.0)}
    for symbol in (INSULT, THREAT):
        arcs[1, symbol] = (1, symbol, factor)
    return Transducer(arcs)


def attack(direct: float = 1.25) -> Transducer:
    """An insult counts alone, more after a target; a threat counts only together with a target."""
    arcs = {(0, TARGET): (1, TARGET, 1.0), (0, THREAT): (2, "held", 1.0), (2, TARGET): (1, "release", 1.0),
            (1, INSULT): (1, INSULT, direct), (2, THREAT): (2, "held", 1.0)}
    return Transducer(arcs)


GRAMMAR = compose(compose(negation_scope(), reported_speech(), SYMBOLS), attack(), SYMBOLS)


@dataclass
class Model:
    """Weights of insult words and stems, and the log odds of a text without a match."""

    words: dict[str, float]
    stems: dict[str, float]
    bias: float
    threat: float = THREAT_WEIGHT  # of a threat with its target
    memory: dict[bytes, bool] = field(default_factory=dict, repr=False)  # whether rough words that a worker has seen mark a text

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def clause(self, words: list[str], insults: dict[str, float]) -> float:
        """The weight that the composed machine gives one clause."""
        state, total, held = GRAMMAR.start, 0.0, 0.0
        spoken = [of for language, of in TARGETS_OF.items() if not THREATS_OF[language].isdisjoint(words)]
        targets = frozenset().union(*spoken) if spoken else TARGETS
        for word in words:
            if word in insults:
                symbol, weight = INSULT, insults[word]
            elif word in THREATS:
                symbol, weight = THREAT, self.threat
            else:
                symbol = TARGET if word in targets else NEGATION if word in NEGATIONS else REPORT if word in REPORTING else OTHER
                weight = 0.0
            state, said, factor = GRAMMAR.step(state, symbol)
            if said == "held":
                held += weight * factor
            elif said == "release":
                total, held = total + held, 0.0
            elif weight:
                total += weight * factor
        return total

    def score(self, text: str | None) -> float:
        """Only texts with an insult or a threat are read clause by clause."""
        evidence, memory = 0.0, self.memory
        if len(memory) > MEMORY:
            memory.clear()
        if text:
            marked = False
            for word in set(rough_words(text)):
                hit = memory.get(word)
                if hit is None:
                    hit = memory[word] = any(self.threat > 0 and w in THREATS or self.weight(w) > 0 for w in exact_words(word))
                marked |= hit
            if marked:
                for part in CLAUSES.split(text.lower()):
                    words = LETTERS.findall(part)
                    insults = {w: x for w in words if (x := self.weight(w)) > 0}
                    if insults or self.threat > 0 and not THREATS.isdisjoint(words):
                        evidence += self.clause(words, insults)
        return 1 / (1 + math.exp(-min(60.0, self.bias + evidence)))


def _significance(a: int, b: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of finding a pattern in a of n1 toxic and b of n0 clean texts; 0 if it marks clean ones."""
    if a * n0 <= b * n1:
        return 0.0
    both = (a + b) / (n1 + n0)
    term = lambda k, e: k * math.log(k / e) if k else 0.0
    return 2 * (term(a, n1 * both) + term(b, n0 * both) + term(n1 - a, n1 * (1 - both)) + term(n0 - b, n0 * (1 - both)))


THREATENED = (-1, "")
_THREAT_ONLY = Model({}, {}, 0.0, threat=1.0)


def threatens(text: str) -> bool:
    """Whether some clause has a threat with its target that is neither negated nor reported."""
    clauses = (LETTERS.findall(part) for part in CLAUSES.split(text.lower()))
    return any(not THREATS.isdisjoint(words) and _THREAT_ONLY.clause(words, {}) >= 1 for words in clauses)


def patterns(text: str) -> set[tuple[int, str]]:
    """The words (0, word) and stems (length, stem) of a text, and ``THREATENED`` if it has a threat with its target."""
    words = {w for rough in set(rough_words(text)) for w in exact_words(rough) if len(w) > 2}
    found = {(0, w) for w in words} | {(n, w[:n]) for n in STEMS for w in words if len(w) >= n}
    return found | {THREATENED} if not THREATS.isdisjoint(words) and threatens(text) else found


def learn(rows: list[tuple[str, int]], least: float = 18.0, precise: float = 0.8) -> Model:
    """Pick words and stems greedily by significance, counting only toxic texts that no earlier pick explains.

    A pick needs a share of ``precise`` toxic texts and a significance of ``least`` on the unexplained ones, so that words that
    merely occur beside insults, as in copies of one text, are left out. Ties go to the whole word, then the longer stem.
    A threat with its target is one pattern among them, without weight unless it is picked. Texts that repeat count once, and so do most near copies: those with the same least hash of a three-word run.
    """
    once: dict[tuple[int, int], str] = {}
    for text, toxic in rows:
        words = text.encode("utf-8", "surrogatepass").split()
        mark = min(map(zlib.crc32, map(b" ".join, zip(words, words[1:], words[2:], strict=False))), default=zlib.crc32(b" ".join(words)))
        once[mark, toxic] = max(text, once.get((mark, toxic), ""))
    texts = sorted((mark, toxic, text) for (mark, toxic), text in once.items())
    n1 = sum(toxic for _, toxic, _ in texts)
    n0 = len(texts) - n1
    if not n1 or not n0:
        return Model({}, {}, -2.0 if not n1 else 2.0, threat=0.0)
    inside = [patterns(text) for _, toxic, text in texts if toxic]
    a = Counter(p for found in inside for p in found)
    a = {p: n for p, n in a.items() if n >= 3}
    b: Counter = Counter()
    for _, toxic, text in texts:
        if not toxic:
            b.update(p for p in patterns(text) if p in a)
    strength = {p: s for p, n in a.items() if n >= precise * (n + b[p]) and (s := _significance(n, b[p], n1, n0)) >= least}
    order = sorted(strength, key=lambda p: (-strength[p], p[0] != 0, -p[0], p[1]))
    left, words, stems, threat = set(range(n1)), {}, {}, 0.0
    holds: dict[tuple[int, str], set[int]] = {p: set() for p in order}
    for i, found in enumerate(inside):
        for p in found & strength.keys():
            holds[p].add(i)
    for p in order:
        fresh = len(holds[p] & left)
        if _significance(fresh, b[p], max(1, len(left)), n0) >= least and fresh >= 3:
            left -= holds[p]
            weight = math.log((a[p] + 0.5) / (n1 + 1)) - math.log((b[p] + 0.5) / (n0 + 1))
            if p == THREATENED:
                threat = weight
            else:
                (words if p[0] == 0 else stems)[p[1]] = weight
    return Model(words, stems, min(-1.0, math.log(n1 / n0)), threat)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 8_000) -> Model:
    """Learn from at most about ``train_docs`` labelled documents, picked by a hash of the id: that many texts reach the driver.

    Rows with a null id, text or label teach nothing; a document with several labels is toxic if one says so.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marked.count()
    spread = 1_000_000
    sample = marked.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(spread)) < int(spread * min(1.0, train_docs / max(1, n))))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    return learn([(r["text"], int(r["toxic"] > 0)) for r in rows.collect()])


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score, 0 to 1, of every whole text; null and empty texts get that of a text without a match.

    The model, bounded by its training sample, goes to the executors as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([shared.value.score(value) for value in series], dtype="float64")

    return scored(F.col(text))
