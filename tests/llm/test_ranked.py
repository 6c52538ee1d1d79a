"""Ranked search against scores written out, and what its blocks skip."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftlog.llm import ranked
from siftlog.llm.ranked import SearchParams

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score string, rank string, terms string"
ITEMS = "item_id long, text string, row string"


def terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(small)


def brute(docs, items, k=10):
    """Every document scored for every item; rows are documents."""
    lists = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, length, df = len(lists), sum(x[2] for x in lists), Counter(t for x in lists for t in x[1])
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in sorted(set((i, t) for i, t in items if t is not None), key=str):
        scores = []
        for doc_id, tf, size in lists:
            m = 25 + 75 * size * n // length
            if (s := sum(weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)) > 0:
                scores.append((-s, doc_id is not None, doc_id or 0))
        out += [(item, r + 1, doc_id if there else None, -s) for r, (s, there, doc_id) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def table():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "éA", "naïve", "日本", "x1", "X1"]
    common = ["the", "of", "and"]
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(vocabulary[: r.choice((20, 400, 406))]) for _ in range(n))
    items = [(i, prose(r.randint(1, 30))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "?!"), (33, "nobody-has-this"), (34, "the of and"), (35, "the the the w3"), items[4], (40, items[4][1]), (None, items[5][1])]
    docs = [(i, prose(r.randint(1, 200))) for i in range(500)]
    docs += [(600 + i, docs[7][1]) for i in range(40)]  # copies of one text, more than a result holds
    docs += [(700 + i, items[i % 20][1] + " " + prose(r.randint(0, 60))) for i in range(60)]
    docs += [(900, None), (901, ""), (902, "--- ..."), (903, prose(30_000)), (904, "THE.OF,and"), (None, items[2][1]), (5, items[3][1]), docs[3], docs[3]]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark):
    docs, items = table()
    return spark.createDataFrame([(*d, "s", "r", "t") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, "x") for i in items], ITEMS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_results_are_those_of_scoring_all(frames):
    assert rows(ranked.search(*frames)) == brute(*table())


@pytest.mark.parametrize("params", [SearchParams(k=3, block_docs=1, seed_postings=1), SearchParams(k=50, block_docs=1000, seed_postings=100_000)])
def test_results_do_not_depend_on_blocks_and_seeds(frames, params):
    assert rows(ranked.search(*frames, params)) == brute(*table(), params.k)


def test_items_in_blocks_give_the_same(frames):
    assert rows(ranked.search(*frames, SearchParams(block_chars=300))) == brute(*table())


def test_bounds_hold_and_blocks_are_skipped(frames, monkeypatch):
    seen = []
    make, find = ranked._blocks, ranked._candidates
    monkeypatch.setattr(ranked, "_blocks", lambda impacts, *a: seen.append((impacts, make(impacts, *a))) or seen[-1][1])
    monkeypatch.setattr(ranked, "_candidates", lambda *a: seen.append(a) or find(*a))
    ranked.search(*frames).collect()
    impacts, blocks = seen[0]
    _, _, items, needed, bars, shifts = seen[1]
    top = {(b["list"], b["cell"], b["term"]): b["top"] for b in blocks.collect()}
    documents = [(d["key"], dict(zip(d["terms"], d["impacts"], strict=True))) for d in impacts.collect()]
    open_, all_ = 0, 0
    for i, lists in enumerate(needed):
        of = dict(zip(items.terms[i].tolist(), items.times[i].tolist(), strict=True))
        for t in lists.tolist():
            for key, own in documents:
                if t in own:
                    bound = sum(n * top.get((t, key >> int(shifts[t]), x), 0) for x, n in of.items())
                    score = sum(n * own.get(x, 0) for x, n in of.items())
                    assert score <= bound
                    open_, all_ = open_ + (bound >= bars[i]), all_ + 1
        reached = [own for _, own in documents if sum(n * own.get(x, 0) for x, n in of.items()) >= bars[i]]
        assert all(any(t in own for t in lists.tolist()) for own in reached)
    assert 0 < open_ < all_


def test_weights_fall_to_zero():
    assert ranked.weight(1000, 1000) == 0 and ranked.weight(1000, 0) == 0
    assert ranked.weight(10, 1) == math.floor(1000 * math.log(22 / 3))


def test_terms_are_cut_as_the_pattern_says():
    r = random.Random(6)
    for _ in range(500):
        t = "".join(chr(r.choice((r.randint(0, 0x7F), r.randint(0x80, 0x3FF), 0x2003, 0x1F600, 0x85, 0xA0))) for _ in range(40))
        assert [w.decode() for w in ranked.terms_of(t.encode())] == terms(t)
    assert np.array_equal(ranked.Items.of([(1, b"b a b")]).times[0], [2, 1])


def test_empty_tables(spark, frames):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    for docs, items in ((no_docs, frames[1]), (frames[0], no_items), (no_docs, no_items), (frames[0], spark.createDataFrame([(1, None, "")], ITEMS)), (spark.createDataFrame([(1, "...", "", "", "")], DOCS), frames[1])):
        found = ranked.search(docs, items)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
