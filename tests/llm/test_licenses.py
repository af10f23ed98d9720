import itertools
import re

import pytest

from hazegrid.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_markup_accepts_what_its_expansions_say():
    automaton = licenses.Automaton("<<optional>>please<<end>> copy <<any 2>> freely <<optional>>or <<optional>>even<<end>> sell<<end>> now")
    alphabet = ["please", "copy", "freely", "or", "even", "sell", "now", "x"]
    pattern = re.compile(r"(?:please )?copy (?:\w+ ){0,2}freely (?:or (?:even )?sell )?now ")
    for n in range(1, 6):
        for run in itertools.product(alphabet, repeat=n):
            text = "".join(w + " " for w in run)
            want = pattern.match(text)
            assert (automaton.accept([w.encode() for w in run], 0) >= 0) == bool(want), run


@pytest.mark.parametrize("bad", ["<<any 2>> a", "<<optional>>a<<end>>", "<<optional>>a b"])
def test_templates_that_say_nothing_are_refused(bad):
    with pytest.raises(ValueError):
        licenses.Automaton(bad)


MIT = licenses.TEMPLATES[0][1].replace("<<optional>>", "").replace("<<end>>", "")
ROWS = [
    (1, "Released under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0. And again: Licensed under the Apache License, Version 2.0"),
    (3, "Licensed under CC BY-NC 4.0."),
    (4, None),
    (5, ""),
    (6, "license " * 30000),
    (7, MIT.capitalize() + ". THE END"),
    (8, MIT.replace("substantial", "partial")),
    (9, "under the mit licenses, été under the MIT\nLICENSE"),
    (None, "cc by nc"),
    (9, "under the mit licenses, été under the MIT\nLICENSE"),
    (10, "Copyright (c) 2020 Some Body. All rights reserved. vicc bync"),
]


def test_rows_against_plain_search(make):
    got = licenses.summary(licenses.scan(make(ROWS))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = words(r.text)
        places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r.n_words == len(w) and r.n_base == len(places)
        assert r.first_word == (places[0][0] if places else None) and r.last_word == (places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[7].labels == "mit" and by[7].score > 0.99
    assert by[8].labels == ""  # a mandatory word differs
    assert by[10].labels == "all-rights-reserved" and by[10].n_base == 0
    assert licenses.scan(make([])).count() == 0


def labels_of(text):
    return {label for label, base, *_ in licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES).scan(text)[1] if not base}


def written(markup, optional, region):
    """The text a template stands for, with or without its optional regions, and with ``region`` in replaceable ones."""
    text = re.sub(r"<<any \d+>>", region, markup)
    while "<<optional>>" in text:
        text = re.sub(r"<<optional>>((?:(?!<<optional>>).)*?)<<end>>", r"\1" if optional else "", text)
    return text


@pytest.mark.parametrize(("label", "markup"), licenses.TEMPLATES)
def test_every_template_with_its_regions_and_with_one_word_changed(label, markup):
    automaton = licenses.Automaton(markup)
    for optional, region in itertools.product((True, False), ("", "ACME", "the people of ACME")):
        fill = region if f"<<any {len(region.split())}>>" in markup or re.findall(r"<<any (\d+)>>", markup) and min(map(int, re.findall(r"<<any (\d+)>>", markup))) >= len(region.split()) else ""
        text = written(markup, optional, fill)
        assert label in labels_of(f"Before it. {text.upper()}; after it."), text
    short = written(markup, False, "").split()
    for i in range(len(short)):
        changed = [w.encode() for w in short[:i] + ["otherword"] + short[i + 1 :]]
        # A replaceable region may take a word in, but no mandatory word may be missing.
        assert all(automaton.accept(changed, at) < 0 for at in range(len(changed))), (label, short[i])


@pytest.mark.parametrize(
    ("notice", "label"),
    [
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of", "lgpl-2-1"),
        ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lgpl-3"),
        ("under the terms of the GNU General Public License version 2 as published", "gpl-2"),
        ("the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of", "agpl-3"),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("under the terms of the Eclipse Public License v. 2.0 which is available at", "epl-2"),
        ("subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed", "mpl-2"),
    ],
)
def test_well_known_notices(notice, label):
    assert labels_of(notice) == {label}


def test_added_names_are_replaced(spark):
    docs = spark.createDataFrame([("x", "under the mit license", 5)], "spans string, text string, n_words int")
    got = licenses.scan(docs).collect()
    assert got[0].n_words == 4 and {s.label for s in got[0].spans} == {"mit"}
