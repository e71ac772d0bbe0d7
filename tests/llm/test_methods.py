"""Whole methods against brute force: labelling by the cut, windows of the mix, recall of candidates, components of vectors."""

import itertools
import os
import random
import re
import textwrap
from fractions import Fraction

import numpy as np
import pytest

from arborq.llm import html_text, licenses, mixing, near_dedup, toxicity, vectors


def page(r):
    """A small page of div soup and some markup."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))

    def block():
        text = " ".join(word() for _ in range(r.choice([1, 2, 5, 15, 40]))) + r.choice(["", "."])
        return f"<p>{text}</p>" if r.random() < 0.6 else f'<p><a href="/x">{text}</a></p>'

    box = lambda tag, inner: f"<{tag}>{inner}</{tag.split()[0]}>"
    return "".join(box(r.choice(["div", "div", "div", "article", "nav", 'div class="ad"', "section"]), "".join(block() for _ in range(r.randrange(1, 4)))) for _ in range(r.randrange(1, 4)))


def test_labels_are_the_cheapest_of_all_labellings():
    r = random.Random(12)
    flipped = 0
    for _ in range(60):
        blocks, _ = html_text.blocks_of(page(r))
        pull, edges = html_text.graph_of(blocks)
        if len(pull) > 13:
            continue

        def cost(side, pull=pull, edges=edges):
            return sum(max(-p, 0) if x else max(p, 0) for p, x in zip(pull, side, strict=True)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])

        found = html_text.minimum_cut(pull, edges)
        assert cost(found) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=len(pull)))))
        flipped += sum((p > 0) != x for p, x in zip(pull[: len(blocks)], found, strict=False))
    assert flipped  # company overrules looks in some blocks


def test_company_settles_what_looks_leave_open():
    long = "A long paragraph of the text, with a good many words in it and a period at its end."
    soup = f"<div><div><p>{long}</p><p>Short one</p><p>{long}</p><p>{long}</p></div><div><p><a href=a>one</a></p><p>Two words</p><p><a href=b>three</a></p></div></div>"
    assert html_text.main_text(soup) == "\n".join([long, "Short one", long, long])
    bare = {text: html_text.leaning(text, box, share) > 0 for text, box, share in html_text.blocks_of(soup)[0]}
    assert not bare["Short one"] and not bare["Two words"]


def test_every_block_lies_in_its_window():
    r = random.Random(1)
    for trial in range(40):
        names = [f"s{i}" for i in range(r.randrange(1, 12))]
        weights = {s: Fraction(r.choice([r.random(), r.random() ** 6, r.randrange(1, 9), 1e-5])) for s in names}
        if trial % 5 == 0:
            weights[names[0]] = Fraction(0)
        counts = {s: r.randrange(1, 300) for s in names}
        rows = [x for plan in mixing.ideals(weights, counts) for x in plan.served()]
        assert [x[3] for x in rows] == list(range(sum(counts.values()))) and all(x[4] <= x[3] < x[5] for x in rows)
        assert {(x[0], x[1]) for x in rows} == {(s, k) for s in names for k in range(counts[s])}
        served = {s for s in names if weights[s] > 0}
        got, ideal = dict.fromkeys(served, 0), dict.fromkeys(served, 0.0)
        for x in rows[: sum(counts[s] for s in served)]:
            left = 1.0
            while left > 1e-9:  # the ideal goes on, source by source running out
                busy = [s for s in served if ideal[s] < counts[s] - 1e-9]
                total = float(sum(weights[s] for s in busy))
                step = min([left, *((counts[s] - ideal[s]) * total / float(weights[s]) for s in busy)])
                for s in busy:
                    ideal[s] += float(weights[s]) / total * step
                left -= step
            got[x[0]] += 1
            assert all(abs(got[s] - ideal[s]) < 1 + 1e-6 for s in served)


def copies_of(r, n, share, count):
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    for _ in range(count):
        a = [word() for _ in range(n)]
        b = list(a)
        for i in r.sample(range(n), int(n * share)):
            b[i] = word()
        yield a, b


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.19])
def test_recall_of_scattered_edits(share):
    r = random.Random(3)
    met = [bool((near_dedup.sketch(near_dedup.labelled_kmers(near_dedup.hashes_of(a))) == near_dedup.sketch(near_dedup.labelled_kmers(near_dedup.hashes_of(b)))).any()) for a, b in copies_of(r, 300, share, 150)]
    assert sum(met) >= 0.9 * len(met) - 3


def test_near_dedup_links_copies_behind_a_quoted_passage(spark):
    """A passage in 300 texts makes large buckets; copies of these texts' own parts are still found, the texts stay apart."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(140)]
    rows = []
    for i in range(300):
        own = [word() for _ in range(80)]
        rows.append((10 * i, " ".join(passage + own)))
        if i % 10 == 0:
            rows.append((10 * i + 1, " ".join(w if r.random() > 0.08 else word() for w in passage + own)))
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * i] == 10 * i for i in range(300))
    assert sum(got[i] == i - 1 for i in got if i % 10) >= 28


def test_long_texts_align_whole():
    r = random.Random(4)
    (a, b), *_ = copies_of(r, 60_000, 0.01, 1)
    assert near_dedup.edits(a, b, 12_000) <= 600 and near_dedup.alike(near_dedup.Words(" ".join(a)), near_dedup.Words(" ".join(b)))
    assert not near_dedup.alike(near_dedup.Words(" ".join(a)), near_dedup.Words(" ".join(b[:40_000])))


@pytest.mark.parametrize("d", [64, 256, 1024])
@pytest.mark.parametrize("rows", [2_000, 10**7])
def test_recall_of_vectors_at_the_threshold(d, rows):
    r = np.random.default_rng(1)
    x = vectors._unit(r.normal(size=(400, d)) + 0.5 * r.normal(size=(1, d)))
    away = r.normal(size=x.shape)
    away = vectors._unit(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * away
    m = vectors.fit_quantiser(x, rows)
    a, b = m.codes(x), m.codes(y)
    met = (np.bitwise_count(m.substrings(a) ^ m.substrings(b)) <= m.probe).any(1) & ((a != b).sum(1) <= m.radius)
    assert met.mean() >= 0.9


@pytest.mark.parametrize("probe", [0, 1, 2])
def test_vectors_match_brute_force(spark, monkeypatch, probe):
    """Links and components equal those of all pairs, at each radius of look-up; one label holds most rows."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 24))
    x = np.vstack([centres[i % 30] + 0.15 * r.normal(size=24) for i in range(240)])
    labels = [0 if i % 5 else i % 3 for i in range(240)]
    fit = vectors.fit_quantiser

    def fixed(sample, rows=0, threshold=vectors.THRESHOLD, seed=7):
        m = fit(sample, rows, threshold, seed)
        return vectors.Quantiser(m.mean, m.rotation, 6, 4, probe, 24)

    monkeypatch.setattr(vectors, "fit_quantiser", fixed)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], labels[i]) for i in range(240)], "vec_id long, embedding array<double>, label int")
    got = {q["vec_id"]: q for q in vectors.near_duplicates(df, block=32).collect()}
    u = vectors._unit(x)
    near = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    component = list(range(240))
    while True:
        lower = [min([component[i], *(component[j] for j in np.flatnonzero(near[i]))]) for i in range(240)]
        if lower == component:
            break
        component = lower
    links = sum(q["n_links"] for q in got.values())
    assert near.sum() > 500 and 0.97 * near.sum() <= links <= near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in got)
    if links == near.sum():
        assert all(got[i]["component_id"] == component[i] for i in got)
    assert all(component[got[i]["component_id"]] == component[i] for i in got)


ISC = """Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.
"""


def test_licences_as_their_stewards_write_them(spark):
    wrap = lambda text: "\n\n".join(textwrap.fill(part, 70) for part in text.split("\n\n"))
    bsd, mit = dict((n, t) for n, t in licenses.LICENSES if "Redistributions" in t and "*" not in t and not t.startswith("BSD"))["BSD-3-Clause"], licenses.LICENSES[0][1]
    rows = [
        (1, ISC), (2, "Copyright (c) 1998, Someone\nAll rights reserved.\n\n" + wrap(bsd)), (3, "Some words before.\n\n" + wrap(mit) + "\n\nAnd after.\n\nAgain."),
        (4, "* " + wrap(licenses._ZLIB).replace("\n", "\n* ")), (5, wrap(licenses._UNLICENSE)), (6, "copyright notice and all that"),
    ]
    common = "/usr/share/common-licenses/"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {100 + i: f for i, f in enumerate(files) if os.path.exists(common + f)}
    for i, f in there.items():
        with open(common + f) as text:
            rows.append((i, text.read()))
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.digest_table(spark)).collect()}
    assert found[1]["licenses"] == ["ISC"] and found[1]["whole"] and found[2]["licenses"] == ["BSD-3-Clause"] and found[2]["whole"]
    assert found[3]["licenses"] == ["MIT"] and not found[3]["whole"] and found[3]["n_units"] == 1
    assert found[4]["licenses"] == ["Zlib"] and found[5]["licenses"] == ["Unlicense"] and not found[6]["licenses"]
    assert all(found[i]["licenses"] == [files[f]] and found[i]["whole"] for i, f in there.items())


def test_lexicon_matches_a_naive_scan():
    r = random.Random(2)
    letters = "abcd e"
    model = toxicity.ToxicityModel({"ab": 1.0, "abc": 2.0, "d": 0.5}, {"bc": 1.5, "dd": 3.0}, ("ab d", "c d"), (0.0, 1.0, 1.0))
    automaton = model.automaton()
    for _ in range(500):
        text = "".join(r.choice(letters) for _ in range(r.randrange(30)))
        spared = [(m.start(), m.start() + len(p)) for p in model.exceptions for m in re.finditer(rf"(?={re.escape(p)})", text)
                  if (m.start() == 0 or not text[m.start() - 1].isalnum()) and not text[m.start() + len(p) : m.start() + len(p) + 1].isalnum()]
        total = 0.0
        for i in range(len(text)):
            if i and text[i - 1].isalnum():
                continue
            hits = [(w, i + len(p)) for p, w in model.words.items() if text.startswith(p, i) and not text[i + len(p) : i + len(p) + 1].isalnum()]
            hits += [(w, i + len(p)) for p, w in model.stems.items() if text.startswith(p, i)]
            if hits:
                w, end = max(hits, key=lambda h: h[0])
                if not any(a <= i and end <= b for a, b in spared):
                    total += w
        assert toxicity.matched(text, automaton) == pytest.approx(total)
