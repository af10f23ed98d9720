"""License scans by template matching.

A template is license text with markup: ``<<optional>> ... <<end>>`` may be missing (nested, if need be),
``<<any N>>`` stands for up to N words of any kind. It compiles to an automaton over tokens. A text is
accepted where its words run through the automaton: mandatory wording must match word for word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import small_batches

# Phrases that every scan looks for, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Wording of public licenses and of the notices that point to them, with markup.
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_CLAUSE = (
    "<<optional>>3<<end>> neither the name of <<any 12>> nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    "this software is provided by <<any 8>> as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 10>> be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
    "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of "
    "the possibility of such damage"
)
_GNU_NOTICE = "<<optional>>licensed<<end>> <<optional>>under the<<end>> <<optional>>terms of the<<end>> gnu {name} <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version {version}"
_CC_VERSION = "<<optional>>4 0<<end>> <<optional>>3 0<<end>> <<optional>>international<<end>> <<optional>>unported<<end>> <<optional>>public<<end>> license"

TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "<<optional>>the software<<end>> to deal in the software without restriction including without limitation the rights to use copy "
            "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
            "furnished to do so subject to the following conditions the above copyright notice and this permission notice "
            "<<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
            "merchantability fitness for a particular purpose and noninfringement in no event shall <<any 10>> be liable for any claim "
            "damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
            "software or the use or other dealings in the software"),
    ("mit", "<<optional>>this <<any 3>> is<<end>> <<optional>>released<<end>> <<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any 8>> "
            "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
            "event shall <<any 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
            "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
            "connection with the use or performance of this software"),
    ("bsd-2", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("bsd-3", f"{_BSD_CONDITIONS} {_BSD_CLAUSE} {_BSD_DISCLAIMER}"),
    ("apache-2", "licensed under the apache license version 2 0 <<optional>>the license you may not use this file except in compliance with "
                 "the license<<end>>"),
    ("gpl-2", _GNU_NOTICE.format(name="general public license", version="2")),
    ("gpl-3", _GNU_NOTICE.format(name="general public license", version="3")),
    ("lgpl-2", _GNU_NOTICE.format(name="library general public license", version="2")),
    ("lgpl-2-1", _GNU_NOTICE.format(name="lesser general public license", version="2 1")),
    ("lgpl-3", _GNU_NOTICE.format(name="lesser general public license", version="3")),
    ("agpl-3", _GNU_NOTICE.format(name="affero general public license", version="3")),
    ("mpl-2", "<<optional>>this source code form is<<end>> subject to the terms of the mozilla public license <<optional>>v<<end>> "
              "<<optional>>version<<end>> 2 0 <<optional>>if a copy of the mpl was not distributed with this file you can obtain one at<<end>>"),
    ("epl-1", "eclipse public license <<optional>>v<<end>> <<optional>>version<<end>> 1 0"),
    ("epl-2", "eclipse public license <<optional>>v<<end>> <<optional>>version<<end>> 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "<<optional>>licensed under<<end>> <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by nc <<any 1>> <<optional>>4 0<<end>>"),
    ("cc-by", f"creative commons attribution {_CC_VERSION}"),
    ("cc-by-sa", f"creative commons attribution sharealike {_CC_VERSION}"),
    ("cc-by-nd", f"creative commons attribution noderivatives {_CC_VERSION}"),
    ("cc-by-nc", f"creative commons attribution noncommercial {_CC_VERSION}"),
    ("cc-by-nc-sa", f"creative commons attribution noncommercial sharealike {_CC_VERSION}"),
    ("cc-by-nc-nd", f"creative commons attribution noncommercial noderivatives {_CC_VERSION}"),
    ("all-rights-reserved", "copyright <<any 8>> all rights reserved"),
]

#: Bytes of words; what stands between words is everything else below 128.
_BETWEEN = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


class Automaton:
    """States 0..n with edges on words, edges on any word, and empty edges; the last state accepts."""

    def __init__(self, markup: str):
        self.on_word: dict[int, dict[bytes, int]] = defaultdict(dict)
        self.on_any: dict[int, int] = {}
        self.empty: dict[int, list[int]] = defaultdict(list)
        self.mandatory: set[bytes] = set()
        at, opened, n, runs = 0, [], 0, [[]]
        for token in re.findall(r"<<[^>]*>>|[^\s<>]+", markup.lower()):
            if token.startswith("<<"):
                runs.append([])
            if token == "<<optional>>":
                n += 1
                self.empty[at].append(n)
                opened.append(at)
                at = n
            elif token == "<<end>>":
                n += 1
                self.empty[at].append(n)
                self.empty[opened.pop()].append(n)
                at = n
            elif token.startswith("<<any"):
                steps = [at]
                for _ in range(int(token[5:-2])):
                    n += 1
                    self.on_any[at] = n
                    at = n
                    steps.append(at)
                n += 1
                for s in steps:
                    self.empty[s].append(n)
                at = n
            else:
                n += 1
                self.on_word[at][token.encode()] = n
                at = n
                if not opened:
                    self.mandatory.add(token.encode())
                    runs[-1].append(token.encode())
        if opened:
            raise ValueError("a region is not closed")
        self.end = at
        first = self.closure({0})
        if self.end in first or any(s in self.on_any for s in first):
            raise ValueError("a template starts with a mandatory or optional word")
        self.first = {w for s in first for w in self.on_word.get(s, {})}
        # The longest mandatory word says soonest that a text can't match; short words are looked for in a row.
        self.anchor = max(self.mandatory, key=lambda w: (len(w), w))
        run = max(runs, key=len)
        self.run = None if len(self.anchor) > 4 else re.compile((_BETWEEN + b"+").join(map(re.escape, run)))

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accept(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from ``start``; -1 if there is none."""
        states, best = self.closure({0}), -1
        for i in range(start, len(words)):
            word = words[i]
            after = {self.on_any[s] for s in states if s in self.on_any}
            after |= {self.on_word[s][word] for s in states if word in self.on_word.get(s, ())}
            if not after:
                break
            states = self.closure(after)
            if self.end in states:
                best = i + 1
        return best


@dataclass
class Scanner:
    """Automata of base phrases and of templates, and a search for texts that can match any of them."""

    phrases: list[tuple[str, str]]
    templates: list[tuple[str, str]]

    def __post_init__(self):
        self.automata = [(label, True, Automaton(p)) for p, label in self.phrases] + [(label, False, Automaton(t)) for label, t in self.templates]
        self.anchors = sorted({a.anchor for _, _, a in self.automata if not a.run})
        self.runs = [a.run for _, _, a in self.automata if a.run]

    def may_match(self, raw: bytes) -> bool:
        """Whether a lower-cased text holds what some automaton can't do without."""
        return any(a in raw for a in self.anchors) or any(r.search(raw) for r in self.runs)

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, bool, int, int]]]:
        """Number of words, and (label, is a base phrase, start, end) of each accepted run, words from 0."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if not raw:
            return 0, []
        inside = _IS_WORD[np.frombuffer(raw, dtype=np.uint8)]
        n = int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum())
        if not self.may_match(raw):
            return n, []
        words = _WORD.findall(raw)
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            places[w].append(i)
        found = []
        for label, base, automaton in self.automata:
            if all(w in places for w in automaton.mandatory):
                for start in sorted(i for w in automaton.first for i in places.get(w, ())):
                    end = automaton.accept(words, start)
                    if end > start:
                        found.append((label, base, start, end))
        return n, found


SPANS = "array<struct<label: string, base: boolean, start: bigint, end: bigint>>"


def scan(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, phrases=PHRASES, templates=TEMPLATES
) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with ``n_words`` and ``spans``: every accepted run, in words from 0.

    A run is the longest from its start; runs of several templates may overlap. A null text has no
    words and no spans. Texts of any length are scanned whole. Repeated rows repeat; columns named
    n_words or spans are replaced; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "spans")]
    span = T.StructType().add("label", T.StringType()).add("base", T.BooleanType()).add("start", T.LongType()).add("end", T.LongType())
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_words", T.LongType()).add("spans", T.ArrayType(span))
    arrow = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            got = [scanner.scan(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            spans = [[{"label": a, "base": b, "start": s, "end": e} for a, b, s, e in found] for _, found in got]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([n for n, _ in got], pa.int64()), pa.array(spans, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "spans"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(run, schema)


def summary(scanned: DataFrame) -> DataFrame:
    """Adds n_base, first_word, last_word, base_labels, labels and score to rows of ``scan``.

    ``score`` is 1 - 0.5 ** (words of the longest run / 4): 0 without a run, near 1 for whole licenses.
    """
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    longest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"] - s["start"])), F.lit(0))
    return scanned.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "base_labels": names(base),
            "labels": names(F.col("spans")),
            "score": 1 - F.pow(F.lit(0.5), longest / 4),
        }
    )
