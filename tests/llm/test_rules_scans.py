import random
import re

import pytest

from corpusloom.llm import licenses, quality

DOCS = "doc_id LONG, text STRING, n_words STRING, kept STRING, labels STRING"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], DOCS)


WORDS = ["MIT", "license", "License,", "apache", "APACHE", "general", "public", "the", "x1", "é-mit", "Gnu", "foo"]


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "...", "MITK license", "mit_license", "Mit\nLicense mit license", "İmit license", "word " * 100_000 + "MIT License"]
    docs = docs_of(spark, texts)
    got = docs.select("doc_id", licenses.scan("text").alias("f")).orderBy("doc_id").collect()
    assert [tuple(r["f"])[:5] for r in got] == [base_of(t) for t in texts]
    assert all(set(filter(None, r["f"]["base_labels"].split(","))) <= set(filter(None, r["f"]["labels"].split(","))) and 0 <= r["f"]["score"] <= 1 for r in got)
    assert docs.limit(0).select(licenses.scan("text")).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", {"mit"}),
    ("licensed under the terms of the MIT license", {"mit"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
    ("Available under a CC BY 4.0", {"cc-by"}),
    ("Released over the MIT License", set()),
    ("Licensed under CC NC-BY 4.0", set()),
    ("Released under this MIT License", set()),
])
def test_templates_need_their_mandatory_words(text, labels):
    words = licenses.words_of("Before that. " + text + " And after.")
    found = licenses.Scanner().template_places(words, set(words))
    assert {m.label for m in found} == labels
    assert all(m.first >= 2 and m.end <= len(words) - 2 for m in found)


MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without
   specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = BSD_3[:BSD_3.index("3. ")] + BSD_3[BSD_3.index("THIS"):]
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "")
GPL_NOTICE = """Thing is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. Thing is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details. You should have received a copy of the GNU General Public License."""


@pytest.mark.parametrize("text, label, changed, to", [
    (MIT, "mit", "THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED"),
    (MIT, "mit", "sublicense, and/or\nsell copies", "and not sell copies"),
    (MIT, "mit", "WITHOUT WARRANTY", "WITH WARRANTY"),
    (BSD_3, "bsd", "3. Neither", "3. All advertising must name the University. 4. Neither"),
    (BSD_2, "bsd", "the distribution.", "the distribution. 3. No commercial use is allowed."),
    (BSD_2, "bsd", "POSSIBILITY", "CERTAINTY"),
    (ISC, "isc", "appear in all copies", "appear in all free copies"),
    (ZERO_BSD, "0bsd", "TORTIOUS", "HARMLESS"),
    (GPL_NOTICE, "gpl", "WITHOUT ANY WARRANTY", "with some warranty"),
    (licenses.license_texts.APACHE_2, "apache", "no-charge, royalty-free", "royalty-bearing"),
    (licenses.license_texts.GPL_3, "gpl", "BE LIABLE TO YOU", "BE KIND TO YOU"),
])
def test_licences_are_matched_to_their_end(text, label, changed, to):
    assert changed in text
    for body, labels in ((text, {label}), (text.replace(changed, to), set())):
        words = licenses.words_of(f"Before that. {body} And after.")
        found = licenses.Scanner().template_places(words, set(words))
        assert {m.label for m in found} == labels
        assert all(m.end == len(words) - 2 for m in found)


def test_automaton_against_expanded_template():
    template = "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d <<var;words=1-2;match=[0-9]+>> e"
    automaton = licenses.Automaton(template)
    accepted = {f"{head} d {number} e" for head in ("a", "a b", "a b c") for number in ("1", "1 2")}
    rng = random.Random(1)
    for _ in range(4000):
        text = " ".join(rng.choices("a b c d e 1 2".split(), k=rng.randint(3, 7))).replace("2", "2")
        words = licenses.words_of(text)
        want = re.fullmatch(r"a (b (c )?)?d [12] ([12] )?e", text) is not None
        assert (automaton.longest_from(words, 0) == len(words)) == want
    assert all(automaton.longest_from(licenses.words_of(t), 0) is not None for t in accepted) and automaton.mandatory == {b"a", b"d", b"e"}


def measures_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_measures_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["one", "two", "three", "\n", "four\n", "same line here\n", "#x", "a\x0bb", "é é", "|", "\r\n"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", " \n\t", "a b c d e f " * 30, "w " * 9]
    docs = docs_of(spark, texts)
    got = docs.select("doc_id", quality.judge(quality.fit_cascade(docs)).alias("m")).orderBy("doc_id").collect()
    assert [tuple(r["m"])[:6] for r in got] == [measures_of(t) for t in texts]
    kept = [quality.first_rejection(quality.Text(t), [*quality.BASE, *quality.RULES]) is None for t in texts]
    assert [r["m"]["kept"] for r in got] == kept
    assert docs.limit(0).select(quality.judge(quality.fit_cascade(docs.limit(0)))).count() == 0


def test_sample_is_bounded_and_takes_copies_one_by_one(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(quality, "order_rules", lambda texts, rules: asked.append(list(texts)) or [quality.Estimate(r.name, 1.0, 0.0) for r in rules])
    docs = docs_of(spark, [None] * 300 + ["copied text"] * 400 + [f"text {i}" for i in range(300)])
    quality.fit_cascade(docs, sample_docs=100)
    quality.fit_cascade(docs.where("text = 'copied text'"), sample_docs=100)
    mixed, copies = asked
    assert None not in mixed and 20 < len(mixed) <= 100 and 10 < mixed.count("copied text") < 70 and 60 < len(copies) <= 100


def test_plain_prose_is_kept():
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)) + " " + "x" * 50_000
    rules = [*quality.BASE, *(r for r in quality.RULES if r.name != "word_length")]
    assert quality.first_rejection(quality.Text(prose), rules) is None
    assert quality.first_rejection(quality.Text(prose[:1000]), quality.RULES) is None
    assert quality.first_rejection(quality.Text(prose[:1000].replace(" ", "### ")), quality.RULES) == "many_symbols"


def test_order_counts_what_a_rule_pays_beyond_the_reported_measures(monkeypatch):
    spent = [0.0]

    def costly(name, cost):
        plain = quality.Text.__dict__[name].func

        def measure(self):
            spent[0] += cost
            return plain(self)

        prop = quality.cached_property(measure)
        prop.__set_name__(quality.Text, name)
        monkeypatch.setattr(quality.Text, name, prop)

    for name, cost in (("n_symbols", 50.0), ("n_dup_lines", 50.0), ("letter_share", 3.0), ("top_word", 1.0)):
        costly(name, cost)

    def clock():
        spent[0] += 0.1
        return spent[0]

    prose = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(20)]
    texts = prose + [p.replace(" ", "# ") for p in prose[:8]] + ["short text"] * 30 + ["say it again " * 20] * 30
    estimates = quality.order_rules(texts, quality.RULES, clock=clock)
    first = estimates[0]
    assert first.rule == "many_symbols" and first.rejected == 8 / 28 and first.seconds < 0.01  # its measure is there already, and junk is not asked
    seconds = {e.rule: e.seconds for e in estimates}
    assert seconds["repeated_lines"] < 0.02 and seconds["few_letters"] > 2.9 and 0.9 < seconds["one_word"] < 1.2


def test_order_is_by_rejections_per_cost():
    def slow(_):
        sum(range(20_000))
        return True

    rules = [quality.Rule("never", lambda t: False), quality.Rule("slow", slow), quality.Rule("some", lambda t: len(t.text) % 2 == 0)]
    order = [e.rule for e in quality.order_rules(["x" * i for i in range(40)], rules, base=())]
    assert order[0] == "some" and order.index("slow") == 1
    assert quality.order_rules([], rules)[0].rule == "never"
    asked = []
    cascade = [quality.Rule("first", lambda t: True), quality.Rule("second", lambda t: asked.append(1) or False)]
    assert quality.first_rejection(quality.Text("x"), cascade) == "first" and not asked
