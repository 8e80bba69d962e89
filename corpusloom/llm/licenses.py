"""License scans by template-markup matching.

A template is a text with marked regions: ``<<beginOptional>>`` ... ``<<endOptional>>`` may be left out, and
``<<var;words=1-3;match=REGEX>>`` stands for so many words of that form. Templates are compiled to automata over words; a
place is accepted if the mandatory words follow each other exactly. Licences are templates to the end of their last mandatory
sentence, so that an altered body is refused; what follows after that end, such as a further clause, is not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.llm import license_texts

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over code points is this over UTF-8, once A-Z are lowered.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
# The phrases of the contract and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_NAME = "<<var;words=1-16;match=.+>>"
_ITEM = "<<var;words=0-1;match=[0-9a-c]|i{1,3}>>"  # how an item of a list is numbered
_GPL = "GNU <<beginOptional>><<var;words=1-1;match=lesser|affero|library>><<endOptional>> General Public License"
_BSD_OPENING = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                f"conditions are met: {_ITEM} Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                f"following disclaimer. {_ITEM} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                "the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_NO_NAMES = f"{_ITEM} Neither the name of {_NAME} may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (f"THIS SOFTWARE IS PROVIDED BY {_NAME} \"AS IS\" AND ANY <<var;words=1-1;match=express|expressed>> OR IMPLIED WARRANTIES, INCLUDING, BUT "
                   "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
                   f"{_NAME} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
                   "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
                   "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
                   "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")
_ISC_GRANT = ("Permission to use, copy, modify, <<beginOptional>>and<<endOptional>><<beginOptional>>/or<<endOptional>> distribute this software for any "
              "purpose with or without fee is hereby granted")
_ISC_DISCLAIMER = (f"THE SOFTWARE IS PROVIDED \"AS IS\" AND {_NAME} <<var;words=1-1;match=disclaims?>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
                   f"ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {_NAME} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
                   "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
                   "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE")

# Short notices, which name a licence, and licences and long notices to the end of their mandatory wording.
TEMPLATES = (
    ("mit", "<<var;words=1-1;match=released|licensed|distributed|available>> under <<beginOptional>>the terms of<<endOptional>> "
            "<<beginOptional>>the<<endOptional>> MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files <<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
            "notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the "
            "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
            f"OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<var;words=1-2;match=noninfringement|non|infringement>>. IN NO EVENT SHALL {_NAME} BE "
            "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("apache", "Licensed under the Apache License<<beginOptional>>, Version <<var;words=1-2;match=[0-9]+>><<endOptional>>"
               "<<beginOptional>> (the \"License\")<<endOptional>><<beginOptional>>; you may not use this file except in compliance "
               "with the License<<endOptional>>"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
               "obtain a copy of the License at <<var;words=1-1;match=https?>>://www.apache.org/licenses/LICENSE-2.0<<beginOptional>>.html<<endOptional>> "
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
               "permissions and limitations under the License"),
    ("apache", license_texts.APACHE_2),
    ("gpl", "<<var;words=1-3;match=.+>> licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> "
            "<<beginOptional>><<var;words=1-1;match=lesser|affero|library>><<endOptional>> General Public License"
            "<<beginOptional>>, version <<var;words=1-2;match=[0-9]+>><<endOptional>>"),
    ("gpl", f"is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the {_GPL} as published by the "
            "Free Software Foundation; <<beginOptional>>either<<endOptional>> version <<var;words=1-2;match=[0-9]+>> of the License<<beginOptional>>, or "
            f"(at your option) any later version<<endOptional>>. {_NAME} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_GPL} for more details"
            f"<<beginOptional>>. You should have received a copy of the {_GPL}<<endOptional>>"),
    ("gpl", license_texts.GPL_2),
    ("gpl", license_texts.GPL_3),
    ("gpl", license_texts.LGPL_21),
    ("cc-by-nc", "<<var;words=1-1;match=licensed|released|available>> under <<beginOptional>>a<<endOptional>> "
                 "<<beginOptional>>the<<endOptional>> CC BY-NC<<beginOptional>>-<<var;words=1-1;match=sa|nd>><<endOptional>>"
                 "<<beginOptional>> <<var;words=1-2;match=[0-9]+>><<endOptional>>"),
    ("cc-by", "<<var;words=1-1;match=licensed|released|available>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
              "CC BY<<beginOptional>>-SA<<endOptional>> <<var;words=1-2;match=[0-9]+>>"),
    ("bsd", _BSD_OPENING + _BSD_DISCLAIMER),
    ("bsd", _BSD_OPENING + _BSD_NO_NAMES + _BSD_DISCLAIMER),
    ("isc", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    ("0bsd", f"{_ISC_GRANT}. {_ISC_DISCLAIMER}"),
)


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Step:
    """Takes one word: a fixed one, or any that matches ``form``."""

    word: bytes | None = None
    form: re.Pattern | None = None

    def takes(self, word: bytes) -> bool:
        return self.word == word if self.form is None else self.form.fullmatch(word) is not None


class Automaton:
    """A template as states joined by steps and by moves that take no word."""

    MARK = re.compile(r"<<(beginOptional|endOptional|var[^>]*)>>")

    def __init__(self, template: str):
        self.steps: list[list[tuple[Step, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.mandatory: set[bytes] = set()
        here, opened, last = 0, [], 0
        for mark in [*self.MARK.finditer(template), None]:
            for word in words_of(template[last:mark.start() if mark else len(template)]):
                here = self._then(here, Step(word))
                if not opened:
                    self.mandatory.add(word)
            if mark is None:
                break
            last = mark.end()
            if mark[1] == "beginOptional":
                opened.append(here)
            elif mark[1] == "endOptional":
                self.free[opened.pop()].append(here)
            else:
                asked = dict(x.split("=", 1) for x in mark[1].split(";")[1:])
                least, most = map(int, asked["words"].split("-"))
                step = Step(form=re.compile(asked["match"].encode()))
                before = []
                for k in range(most):
                    if k >= least:
                        before.append(here)
                    here = self._then(here, step)
                for state in before:
                    self.free[state].append(here)
        self.end = here
        self.first = self._closure({0})

    def _then(self, state: int, step: Step) -> int:
        self.steps.append([])
        self.free.append([])
        self.steps[state].append((step, len(self.steps) - 1))
        return len(self.steps) - 1

    def _closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for state in self.free[todo.pop()]:
                if state not in out:
                    out.add(state)
                    todo.append(state)
        return out

    def longest_from(self, words: Sequence[bytes], start: int) -> int | None:
        """The end of the longest acceptance that begins at ``start``."""
        states, found, at = self.first, None, start
        while states and at < len(words):
            states = self._closure({to for s in states for step, to in self.steps[s] if step.takes(words[at])})
            at += 1
            if self.end in states:
                found = at
        return found


@dataclass(frozen=True)
class Match:
    label: str
    first: int  # word
    end: int


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        self.automata = [(label, Automaton(text)) for label, text in templates]
        self.phrases = [(words_of(phrase), label) for phrase, label in phrases]

    def phrase_places(self, words: Sequence[bytes], present: set[bytes]) -> list[Match]:
        """Every place where a phrase's words stand consecutively."""
        out = []
        for phrase, label in self.phrases:
            if present.issuperset(phrase):
                at = -1
                while (at := _index(words, phrase[0], at + 1)) >= 0:
                    if words[at:at + len(phrase)] == phrase:
                        out.append(Match(label, at, at + len(phrase)))
        return out

    def template_places(self, words: Sequence[bytes], present: set[bytes]) -> list[Match]:
        """Longest acceptances of each template, from left to right, without overlaps of the same template."""
        out = []
        for label, automaton in self.automata:
            if present.issuperset(automaton.mandatory):
                at = 0
                while at < len(words):
                    end = automaton.longest_from(words, at)
                    if end is not None:
                        out.append(Match(label, at, end))
                    at = at + 1 if end is None else end
        return out


def _index(words: Sequence[bytes], word: bytes, start: int) -> int:
    try:
        return words.index(word, start)
    except ValueError:
        return -1


FINDINGS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
            "matches array<struct<label: string, first: long, end: long>>")


def scan(text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> Column:
    """A struct of counts, labels and the matched templates of every whole text.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` come from the phrases; ``labels`` adds the labels of accepted
    templates. The score is 1 if a template is accepted, 0.5 if only a phrase occurs, else 0. Null counts as empty; without
    labels the strings are empty.
    """
    templates = tuple(templates)

    @F.pandas_udf(FINDINGS)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for series in texts:
            rows = []
            for value in series:
                words = words_of(value)
                present = set(words)
                base = scanner.phrase_places(words, present)
                more = scanner.template_places(words, present)
                starts = [m.first for m in base]
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted({m.label for m in base})), ",".join(sorted({m.label for m in [*base, *more]})),
                             1.0 if more else 0.5 if base else 0.0, [{"label": m.label, "first": m.first, "end": m.end} for m in more]))
            frame = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return scanned(F.col(text))
