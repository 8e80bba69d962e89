import math
import random
from functools import lru_cache

import numpy as np
import pytest

from corpusloom.llm import langid, toxicity

DOCS = "doc_id LONG, text STRING, lang STRING, lang_pred STRING, score STRING"
PIECES = ["▁a", "a", "b", "ab", "▁ab", "ba", "bab", "c"]


def model():
    return langid.Model.fit(["x", "y"], PIECES, {"abab": np.array([5.0, 1.0]), "bc": np.array([1.0, 7.0]), "aab": np.array([2.0, 2.0])})


def test_forward_sums_all_segmentations():
    m = model()
    ids = {name: k + 2 for k, name in enumerate(m.pieces.names)}

    def summed(text, language):
        @lru_cache
        def rest(i):
            if i == len(text):
                return 1.0
            total = 0.0
            for j in range(i + 1, len(text) + 1):
                piece = ids.get(text[i:j], 1 if j == i + 1 else 0)
                if piece:
                    total += m.chance[piece, language] * rest(j)
            return total
        return rest(0)

    for word in ("abab", "b", "zzab", "aabbabc"):
        scores = m.word_scores([word])[0]
        assert scores == pytest.approx([math.log(summed("▁" + word, k)) for k in range(2)])


def test_fit_raises_the_likelihood():
    words = {"abab": np.array([5.0]), "bc": np.array([3.0])}
    value = lambda m: sum(m.word_scores([w])[0][0] * c[0] for w, c in words.items())
    fitted = [value(langid.Model.fit(["x"], PIECES, words, rounds=r, smooth=1e-9)) for r in (1, 2, 4)]
    assert fitted == sorted(fitted)


def test_identify_on_odd_texts(spark):
    rng = random.Random(1)
    make = {"en": ["the", "and", "thing"], "de": ["der", "und", "schön"]}
    train = [(i, " ".join(rng.choices(make[k], k=30)), k, "", "") for i, k in enumerate(["en", "de"] * 20)]
    train += [(90, None, "en", "", ""), (91, "the", None, "", "")]
    fitted = langid.train(spark.createDataFrame(train, DOCS), langid.public_pieces(), docs_per_language=15)
    texts = [None, "", " 12 ½ ++ _", "Der schöne!", "the thing", "x" * 5000 + " the and thing", "der\n" * 50_000]
    docs = spark.createDataFrame([(i, t, None, "no", "no") for i, t in enumerate(texts)], DOCS)
    got = [r["p"] for r in docs.select("doc_id", langid.identify(docs, fitted).alias("p")).orderBy("doc_id").collect()]
    assert [p["lang_pred"] for p in got[:5]] == ["und", "und", "und", "de", "en"] and got[6]["lang_pred"] == "de"
    assert all(0 <= p["score"] <= 1 for p in got) and got[0]["score"] == 0
    assert docs.limit(0).select(langid.identify(docs, fitted)).count() == 0
    untaught = langid.train(docs, langid.public_pieces())
    assert {r[0]["lang_pred"] for r in docs.select(langid.identify(docs, untaught)).collect()} == {"und"}


TOXIC = toxicity.Model({"idiot": 6.0}, {"vequ": 6.0}, -2.0)


def test_grammar_weighs_clauses():
    score = lambda text: TOXIC.clause(text.split(), {"idiot": 6.0})
    assert score("what an idiot") == 6.0
    assert score("you idiot") == pytest.approx(7.5)
    assert score("not an idiot") == pytest.approx(6 * 0.35)
    assert score("not one two three four idiot") == 6.0
    assert score("he said idiot") == pytest.approx(6 * 0.6)
    assert score("they said you are no idiot") == pytest.approx(6 * 0.6 * 0.35 * 1.25)
    assert score("kill time") == 0 and score("kill you") == toxicity.THREAT_WEIGHT
    assert score("you are not one to kill") == pytest.approx(toxicity.THREAT_WEIGHT * 0.35)


def test_composition_multiplies():
    a = toxicity.Transducer({(0, "x"): (1, "y", 0.5)})
    b = toxicity.Transducer({(0, "y"): (0, "z", 0.5)})
    machine = toxicity.compose(a, b, "xw")
    assert machine.step((0, 0), "x") == ((1, 0), "z", 0.25) and machine.step((0, 0), "w") == ((0, 0), "w", 1.0)


def texts(rng, n, insult=None, stem=None):
    for _ in range(n):
        words = ["".join(rng.choices("aeioustrn", k=rng.randint(2, 7))) for _ in range(60)]
        if insult:
            words[rng.randrange(60)] = rng.choice([insult, stem + "".join(rng.choices("aeiou", k=3))])
        yield " ".join(words)


def test_learns_words_and_stems_not_copies(spark):
    rng = random.Random(4)
    clean, toxic = list(texts(rng, 500)), list(texts(rng, 80, "moron", "vequ"))
    copies = [toxic[0].replace("a", "a") + " tail" + "x" * k for k in range(40)]
    fitted = toxicity.learn([(t, 0) for t in clean] + [(t, 1) for t in toxic + copies])
    assert "moron" in fitted.words and any(s.startswith("vequ") for s in fitted.stems)
    fresh_clean, fresh_toxic = list(texts(rng, 200)), list(texts(rng, 100, "moron", "vequ"))
    assert sum(fitted.score(t) >= 0.5 for t in fresh_toxic) >= 98 and sum(fitted.score(t) >= 0.5 for t in fresh_clean) <= 1
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate([None, "", toxic[0] * 200, clean[0], clean[0]])], DOCS)
    got = [r[0] for r in docs.select(toxicity.toxicity(docs, fitted)).collect()]
    assert got[0] == got[1] < 0.5 < got[2] and got[3] == got[4] and docs.limit(0).select(toxicity.toxicity(docs, fitted)).count() == 0


def test_threats_weigh_what_labels_support():
    rng = random.Random(5)
    clean, toxic = list(texts(rng, 500)), list(texts(rng, 80, "moron", "vequ"))
    plain = ["this may hurt your eyes", "you can kill the process", "il ne faut pas détruire les forêts du pays", "détruire les forêts du pays"]
    labelled = [(t, 0) for t in clean] + [(t, 1) for t in toxic]
    fitted = toxicity.learn(labelled)
    assert fitted.threat == 0 and "moron" in fitted.words and all(fitted.score(t) < 0.5 for t in plain)
    threats = [f"{t}. {rng.choice(['i will kill', 'we hurt', 'ich werde töten', 'matar'])} " for t in texts(rng, 80)]
    threats = [t + ("dich" if "töten" in t else "usted" if "matar" in t else "you") for t in threats]
    taught = toxicity.learn([*labelled, *((t, 1) for t in threats), *((f"{t}. détruire les forêts du pays", 0) for t in texts(rng, 40))])
    assert taught.threat > 2 and all(taught.score(t) >= 0.5 for t in threats) and taught.score(plain[-1]) < 0.5
    unsupported = toxicity.learn([*labelled, *((t, i % 2) for i, t in enumerate(threats))])
    assert unsupported.threat == 0


def test_targets_are_of_the_language_of_the_threat():
    score = lambda text: TOXIC.clause(text.split(), {})
    for text in ("détruire les forêts du pays", "sie wollen ihr nicht schlagen", "the kill ratio of ti devices", "hurt du", "matar el you"):
        assert score(text) == 0, text
    for text in ("ich werde dich töten", "te voy a matar", "vous frapper", "punch you"):
        assert score(text) == toxicity.THREAT_WEIGHT, text


def test_train_takes_odd_labels(spark):
    docs = spark.createDataFrame([(1, "so bad", "", "", ""), (None, "x", "", "", ""), (2, None, "", "", "")], DOCS)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (1, 0), (1, 1)], "doc_id LONG, toxic INT")
    assert toxicity.train(docs, labels).words == {}
    assert toxicity.train(docs.limit(0), labels.limit(0)).score("x") < 0.5
