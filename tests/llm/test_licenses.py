"""License scans: brute force over runs, phrases and planted templates."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import licenses
from inkwell.llm.automaton import SuffixAutomaton
from inkwell.llm.licenses import Scan, Scanner, words_of

SMALL = st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(SMALL, st.lists(st.integers(0, 4), max_size=30))
def test_statistics_by_brute_force(sequences, tokens):
    found = SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for i, (state, length) in enumerate(found.statistics(tokens)):
        want = max((n for n in range(i + 2) if not n or tuple(tokens[i + 1 - n : i + 1]) in runs))
        assert length == want
        if length:
            run = tokens[i + 1 - length : i + 1]
            ends = [(k, e) for k, s in enumerate(sequences) for e in range(len(s)) if e + 1 >= length and s[e + 1 - length : e + 1] == run]
            assert list(found.ends[state]) == ends


def plain_base(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


PIECES = ["cc", "by", "CC-BY", "General", "public", "license", "All", "rights", "reserved", ".", "\n", "É", "é", "x1", "_", "the GNU", "licensed under", "İ", "K"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25), st.sampled_from(["", " ", "-"]))
def test_phrases_by_brute_force(pieces, between):
    text = between.join(pieces)
    assert licenses.scanner(Scan()).of(text)[:5] == plain_base(text)


def by_brute_force(text, scan):
    """Runs of a text that no longer run holds, straight from the templates' words."""
    words, templates = words_of(text), [words_of(t) for _, t in (*scan.templates, *scan.phrases)]
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    stats = [max(n for n in range(i + 2) if not n or tuple(words[i + 1 - n : i + 1]) in runs) for i in range(len(words))]
    return [(i, n) for i, n in enumerate(stats) if n >= scan.least and (i + 1 == len(words) or stats[i + 1] != n + 1)]


def planted(seed):
    rng = np.random.default_rng(seed)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50, n))
    parts, labels = [noise(20)], set()
    for label, text in (licenses.TEMPLATES[i] for i in rng.choice(len(licenses.TEMPLATES), 3, replace=False)):
        words = text.split()
        if len(words) > 30:  # a changed word now and then
            for k in rng.choice(len(words) // 12, 2, replace=False):
                words[12 * k + 6] = "changed"
        parts += [" ".join(words), noise(rng.integers(12, 40))]
        labels.add(label)
    return "\n".join(parts), labels


def test_planted_templates():
    scanner = Scanner(Scan())
    for seed in range(40):
        text, labels = planted(seed)
        runs, _ = scanner.matches(words_of(text))
        assert [r[:2] for r in runs] == by_brute_force(text, scanner.scan)
        n, *_, found, score, spans = scanner.of(text)
        assert labels <= set(found.split(","))
        assert set(found.split(",")) - labels <= {"cc-by", "gpl", "reserved", "apache-2.0", "gpl-2.0", "gpl-3.0"}
        assert 0.8 <= score <= 1 and all(0 <= s["first_word"] <= s["last_word"] < n for s in spans)


def test_lines_and_near_misses():
    of = Scanner(Scan()).of
    assert of("Licensed under the Apache License, Version 2.0.")[5:7] == ("apache-2.0", 1.0)
    assert of("Licensed under CC BY-NC 4.0.")[4:7] == ("cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert of("This work is licensed under the GNU General Public License, version 3.")[5] == "gpl,gpl-3.0"
    assert of("it is licensed under the sun")[5] == "" and of("it is licensed under the sun")[6] < 0.8
    assert of("free of charge to any person")[5] == ""
    assert of("Permission is hereby granted")[5] == ""


def test_repeated_template_and_very_long_text():
    mit = licenses.TEMPLATES[2][1]
    n, *_, labels, score, spans = Scanner(Scan()).of(f"{mit}\n" * 300 + "word " * 200_000)
    assert (labels, score, len(spans)) == ("mit", 1.0, 300) and n == 300 * len(words_of(mit)) + 200_000
    assert spans[1]["first_word"] == len(words_of(mit))


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "cc by cc by"), (3, "cc by cc by"), (None, "All rights reserved. CC BY"), (5, " \n"), (6, "ALL RIGHTS\x00RESERVED")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, labels int, spans string").repartition(3)
    got = [tuple(r)[:6] for r in licenses.scan_licenses(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_base(t)) for i, t in rows), key=repr)
    assert not licenses.scan_licenses(spark.createDataFrame([], "doc_id string, text string")).collect()


def test_empty_template_is_an_error():
    with pytest.raises(ValueError):
        Scanner(Scan(phrases=(("x", "..."),)))
