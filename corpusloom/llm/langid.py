"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the sum
over all ways to cut it into pieces, which the forward algorithm adds up; a text's is the product over its words. The
probabilities are fitted by expectation maximisation: expected piece counts over all cuts of the training words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import exact_words, rough_words

UNDETERMINED = "und"
START = "▁"  # the vocabulary's mark of a word's first piece
RUN = 48  # a longer run of letters is scored as consecutive runs of so many
MEMORY = 600_000  # rough words whose scores a worker keeps
CHARS_AT_ONCE = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def public_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces of letters of a public vocabulary file; by default the installed one."""
    import sentencepiece

    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p.removeprefix(START).isalpha() and p == p.lower()})


def _codes(words: Sequence[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _hashes(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For lengths 1, 2, ...: hashes of the substrings of that length, by the place where they begin."""
    mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    value = np.zeros_like(mixed)
    for k in range(min(longest, codes.shape[1])):
        value = value[:, :codes.shape[1] - k] * _BASE + mixed[:, k:]
        yield value


@dataclass
class Pieces:
    """Looks up the pieces of words by 64-bit hashes of their characters.

    Ids count from 2; id 1 is any character that is no piece, and 0 stands for no piece.
    """

    hashes: np.ndarray
    ids: np.ndarray
    longest: int
    names: list[str]

    @classmethod
    def of(cls, pieces: Sequence[str]) -> Pieces:
        keys = np.array([list(_hashes(_codes([p]), len(p)))[-1][0, 0] for p in pieces], np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], (order + 2).astype(np.int32), max(map(len, pieces), default=1), list(pieces))

    @property
    def size(self) -> int:
        return len(self.names) + 2

    def lattice(self, words: Sequence[str]) -> np.ndarray:
        """Ids of the pieces that end at each place, by length, of marked words of one length."""
        codes = _codes(words)
        out = np.zeros((*codes.shape, min(codes.shape[1], self.longest)), np.int32)
        if len(self.names):
            for k, value in enumerate(_hashes(codes, self.longest)):
                at = np.searchsorted(self.hashes, value)
                at[at == len(self.hashes)] = 0
                out[:, k:, k] = np.where(self.hashes[at] == value, self.ids[at], 0)
        out[:, :, 0][out[:, :, 0] == 0] = 1
        return out


def forward(lattice: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Sums over cuts: alpha[word, place, language], with alpha[:, n] the words' probabilities."""
    words, n, most = lattice.shape
    alpha = np.zeros((words, n + 1, chance.shape[1]))
    alpha[:, 0] = 1
    for i in range(n):
        for k in range(min(most, i + 1)):
            alpha[:, i + 1] += alpha[:, i - k] * chance[lattice[:, i, k]]
    return alpha


def expected_counts(lattice: np.ndarray, chance: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over all cuts, of words that occur ``counts[word, language]`` times."""
    words, n, most = lattice.shape
    alpha = forward(lattice, chance)
    beta = np.zeros_like(alpha)
    beta[:, n] = 1
    for i in range(n - 1, -1, -1):
        for k in range(min(most, n - i)):
            beta[:, i] += beta[:, i + k + 1] * chance[lattice[:, i + k, k]]
    weight = counts / np.maximum(alpha[:, n], 1e-300)
    out = np.zeros_like(chance)
    for i in range(n):
        for k in range(min(most, i + 1)):
            ids = lattice[:, i, k]
            share = alpha[:, i - k] * chance[ids] * beta[:, i + 1] * weight
            for language in range(chance.shape[1]):
                out[:, language] += np.bincount(ids, share[:, language], minlength=len(chance))
    out[0] = 0
    return out


def marked_runs(word: str) -> list[str]:
    marked = START + word
    return [marked[i:i + RUN] for i in range(0, len(marked), RUN)]


@dataclass
class Model:
    """Fitted piece probabilities by language."""

    languages: list[str]
    pieces: Pieces
    chance: np.ndarray
    known: dict[bytes, int] = field(default_factory=dict, repr=False)  # rough words seen by this worker, with their rows in
    scores: np.ndarray | None = field(default=None, repr=False)  # their scores
    lettered: np.ndarray | None = field(default=None, repr=False)  # and whether they hold a letter

    @classmethod
    def fit(cls, languages: Sequence[str], pieces: Sequence[str], words: dict[str, np.ndarray], rounds: int = 3, smooth: float = 0.05) -> Model:
        """``words``: occurrences per language of each training word."""
        index = Pieces.of(pieces)
        chance = np.full((index.size, len(languages)), 1.0 / index.size)
        chance[0] = 0
        runs: dict[str, np.ndarray] = {}
        for word, counts in words.items():
            for run in marked_runs(word):
                runs[run] = runs.get(run, 0) + counts
        groups: dict[int, list[str]] = {}
        for run in sorted(runs):
            groups.setdefault(len(run), []).append(run)
        lattices = [(index.lattice(g), np.array([runs[r] for r in g], float)) for g in groups.values()]
        for _ in range(rounds if lattices else 0):
            chance = sum(expected_counts(lattice, chance, counts) for lattice, counts in lattices) + smooth
            chance[0] = 0
            chance /= chance.sum(0)
        return cls(list(languages), index, chance)

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        groups: dict[int, list[tuple[int, str]]] = {}
        for at, word in enumerate(words):
            for run in marked_runs(word):
                groups.setdefault(len(run), []).append((at, run))
        for group in groups.values():
            for start in range(0, len(group), 20_000):
                at, runs = zip(*group[start:start + 20_000], strict=True)
                scores = np.log(np.maximum(forward(self.pieces.lattice(runs), self.chance)[:, -1], 1e-300))
                np.add.at(out, np.array(at), scores)
        return out

    def predict(self, texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            picked, sure = [], []
            for chunk in _chunks(series):
                counts = [Counter(rough_words(t)) if t else Counter() for t in chunk]
                self._remember(counts)
                known, scores, lettered = self.known, self.scores, self.lettered
                for c in counts:
                    at = np.fromiter(map(known.__getitem__, c), np.int64, len(c))
                    if not self.languages or not lettered[at].any():
                        picked.append(UNDETERMINED)
                        sure.append(0.0)
                        continue
                    total = np.fromiter(c.values(), np.float64, len(c)) @ scores[at]
                    odds = np.exp(total - total.max())
                    best = int(total.argmax())
                    picked.append(self.languages[best])
                    sure.append(float(odds[best] / odds.sum()))
            yield pd.DataFrame({"lang_pred": picked, "score": sure})

    def _remember(self, counts: Sequence[Counter]) -> None:
        if self.scores is None or len(self.known) > MEMORY:
            self.known, self.scores, self.lettered = {}, np.zeros((0, len(self.languages))), np.zeros(0, bool)
        new = list({w for c in counts for w in c if w not in self.known})
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            more, letters = self._rough_scores(new)
            self.scores, self.lettered = np.concatenate([self.scores, more]), np.concatenate([self.lettered, letters])

    def _rough_scores(self, rough: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rough words, summed over the words in them, and whether there are any."""
        inside = [exact_words(w) for w in rough]
        flat = [w for words in inside for w in words]
        owner = np.repeat(np.arange(len(rough)), [len(words) for words in inside])
        out = np.zeros((len(rough), len(self.languages)))
        np.add.at(out, owner, self.word_scores(flat))
        return out, np.bincount(owner, minlength=len(rough)) > 0


def _chunks(series: pd.Series) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in series:
        part.append(text)
        size += len(text or "")
        if size >= CHARS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(examples: DataFrame, pieces: Sequence[str], docs_per_language: int = 1_500, words_per_language: int = 15_000) -> Model:
    """Fit on rows of (doc_id, text, lang); null languages and null texts teach nothing, no rows give a model that predicts nothing.

    Two bounds keep the fit small: about ``docs_per_language`` documents of each language, picked by a hash of the id, and the
    ``words_per_language`` commonest words of these.
    """
    examples = examples.where("lang IS NOT NULL AND text IS NOT NULL")
    per = {r["lang"]: r["n"] for r in examples.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return Model.fit([], pieces, {})
    spread = 1_000_000
    part = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(per.items()) for x in (k, int(spread * min(1.0, docs_per_language / n)))]), F.col("lang"))
    sample = examples.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(spread)) < part)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    leading = counted.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= words_per_language)
    languages = sorted(per)
    of = {k: i for i, k in enumerate(languages)}
    table: dict[str, np.ndarray] = {}
    for row in leading.select("lang", "word", "n").collect():
        table.setdefault(row["word"], np.zeros(len(languages)))[of[row["lang"]]] = row["n"]
    return Model.fit(languages, pieces, table)


def identify(docs: DataFrame, model: Model, text: Column | str = "text") -> Column:
    """A struct of ``lang_pred`` and ``score``: the likeliest language and its posterior under equal priors.

    ``und`` and 0 for a null text or one without a letter. Whole texts are read, in pieces of about a million characters at a
    time; the model, whose size the vocabulary bounds, goes to the executors as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from shared.value.predict(texts)

    return predicted(F.col(text) if isinstance(text, str) else text)
