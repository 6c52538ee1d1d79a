"""Cases that earlier versions got wrong: copies of template items, articles under misleading names, repeated identifiers."""

from __future__ import annotations

import html as entities
import math
import random

import numpy as np
import pytest
from test_operators import prose

from siftlog.llm import decontaminate, html_text, minhash


@pytest.mark.parametrize("size", [10, 100, 2000])
def test_copies_of_template_items_are_found_wherever_they_are_filled_in(spark, size):
    words = 12
    bench, want, docs = [], [], []
    for place in range(words):
        template = prose(7000 + place, words).split()
        for i in range(size):
            template[place] = f"fill{place}x{i}"
            bench.append((place * size + i, " ".join(template)))
        for n, i in enumerate((size - 3, size - 1)):
            doc = place * 2 + n
            docs.append((doc, prose(8000 + doc, 60) + " " + bench[place * size + i][1] + " " + prose(9000 + doc, 60)))
            want.append((doc, place * size + i))
    docs += [(1000 + i, prose(9500 + i, 150)) for i in range(20)]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {k: got.get(k) for k in want} == dict.fromkeys(want, 1.0)
    assert {d for d, _ in got} == {d for d, _ in want}


def test_short_items_still_need_two_seeds(spark):
    bench = [(i, prose(500 + i, 5)) for i in range(30)]
    docs = [(i, prose(600 + i, 40) + " " + " ".join(bench[i][1].split()[:3]) + " " + prose(700 + i, 40)) for i in range(30)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert found.collect() == []


BODY = "".join(f"<p>{f'A sentence about rivers and old stone bridges, number {i}, told at some length. ' * 3}</p>" for i in range(6))
TEXT = "\n".join(f"{f'A sentence about rivers and old stone bridges, number {i}, told at some length. ' * 3}".strip() for i in range(6))
NAMES = [
    ("article", "post tag-social"),
    ("article", "post tag-newsletter"),
    ("div", "main-content right-sidebar"),
    ("main", "sidebar-right"),
    ("div", "widget Blog"),
    ("div", "post-body notice"),
    ("div", "left-menu layout"),
    ("div", "modal-content"),
]


@pytest.mark.parametrize(("tag", "name"), NAMES)
def test_names_do_not_overrule_the_text(tag, name):
    page = f'<html><body><nav><a href="/">Home</a> <a href="/x">News</a></nav><{tag} class="{name}"><h1>Title</h1>{BODY}</{tag}><div class="comments"><p>{"I disagree with all of this. " * 200}</p></div><div class="sidebar"><p>Buy our things now, they are cheap.</p></div><div class="cookie-notice">We use them.</div><footer>bottom</footer></body></html>'
    assert html_text.main_text(page) == f"Title\n{TEXT}"


def test_marked_parts_still_go():
    for name in ("sidebar", "newsletter-signup", "related-posts", "share-buttons", "cookie-notice", "comments", "widget"):
        page = f'<body><div><h1>Title</h1>{BODY}</div><div class="{name}"><article><p>{"Something else altogether, at length. " * 12}</p></article></div></body>'
        page = page.replace("<article>", "<div>").replace("</article>", "</div>") if name in ("newsletter-signup", "widget") else page.replace(f"<div><h1>Title</h1>{BODY}</div>", f"<article><h1>Title</h1>{BODY}</article>")
        assert html_text.main_text(page) == f"Title\n{TEXT}", name


def test_densities_and_sums_are_those_of_the_formula():
    r = random.Random(12)

    def grow(depth):
        if depth == 0 or r.random() < 0.3:
            return " ".join(r.choice(("stone", "bridge", "tom & ann", "a<b")) for _ in range(r.randint(0, 12)))
        return [(r.choice(("div", "section", "p", "span", "a", "ul", "em")) if depth < 5 else "div", grow(depth - 1)) for _ in range(r.randint(1, 4))]

    def text(tree):
        if isinstance(tree, str):
            return entities.escape(tree)
        return "".join(f"<{t}>{text(inner)}</{t}>" for t, inner in tree if t)

    def count(node):
        """chars, tags, link chars, link tags; by definition, over all descendants."""
        out = [0, 0, 0, 0]
        for c in node.children:
            if isinstance(c, str):
                n = len(" ".join(c.split()))
                linked, up = False, node
                while up is not None:
                    linked, up = linked or up.tag == "a", up.parent
                out[0], out[2] = out[0] + n, out[2] + n * linked
            else:
                inner = count(c)
                out = [a + b for a, b in zip(out, inner, strict=True)]
                out[1], out[3] = out[1] + 1, out[3] + (c.tag == "a")
        return out

    for _ in range(200):
        root = html_text.parse(f"<body>{text(grow(6))}</body>")
        nodes = html_text.measure(root)
        whole = count(root)
        for node in nodes:
            c, t, lc, lt = count(node)
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == (c, t, lc, lt)
            if not c:
                assert node.density == 0
                continue
            base = c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e
            ratio = c / max(lc, 1) * max(t, 1) / max(lt, 1)
            assert node.density == pytest.approx(c / max(t, 1) * max(math.log(ratio), 0) / max(math.log(math.log(base)), 1) if ratio > 0 else 0)
        top = html_text.article(root)
        assert sum(html_text._parts(root, top)) == max(sum(html_text._parts(root, n)) for n in nodes)


def test_keep_one_goes_by_identifier_and_text(spark):
    a, b, c = (prose(i, 60) for i in (1, 2, 3))
    near = c.split()
    near[30] = "other"
    rows = [(3, a), (5, a), (5, b), (8, c), (8, " ".join(near)), (9, c), (None, b), (11, None), (11, None)]
    kept = [tuple(r) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in kept if x[0] in (3, 5)) == [(3, a), (5, b)]
    assert len([x for x in kept if x[0] in (8, 9)]) == 1 and [x[0] for x in kept].count(11) == 2 and len(kept) == 5


def test_letters_of_all_planes_are_symbols():
    from siftlog.llm import toxicity

    plain = toxicity.grams("bad word")
    assert list(toxicity.grams("𝐛𝐚𝐝 𝐰𝐨𝐫𝐝")) == list(toxicity.grams("𝖇𝖆𝖉 word")) == list(plain) == list(toxicity.grams("BÁD wörd"))
    assert len(toxicity.grams("𐐀𐐁𐐂")) == 4 and len(toxicity.grams("😀😀")) == 0
    assert list(toxicity.grams("a😀b")) == list(toxicity.grams("a b"))


def test_counts_do_not_saturate():
    import numpy as np

    from siftlog.llm import toxicity

    ordinary, toxic = (np.zeros(toxicity.GRAMS, np.float32) for _ in range(2))
    ordinary[5], ordinary[6], toxic[5] = 6e9, 3e9, 4e9
    ratio = toxicity.log_ratio(ordinary, toxic)
    assert ratio[5] == pytest.approx(math.log(1 / (2 / 3)), abs=1e-2)


def test_new_words_start_no_threads_of_the_tokenizer(monkeypatch):
    from siftlog.llm import sstable

    encoder = sstable.WordEncoder(sstable.default_tokenizer())
    texts = ["Straße, it's 12.5% of b$$ b$$? É! a, a. ,", "x", ""]
    want = [np.array(e.ids, encoder.type).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]

    class Single:
        encode = staticmethod(encoder.tokenizer.encode)

    monkeypatch.setattr(encoder, "tokenizer", Single)  # it has no batches
    assert not encoder.whole and encoder.encode(texts) == want


def test_paths_of_words_are_counted_along_the_tree_of_pieces():
    import itertools

    from siftlog.llm import pieces

    p = pieces.Pieces.get(pieces.default_model())
    assert not hasattr(p, "steps")  # no slice of a word is looked up for each of its characters
    for word in (" the", " undoing", "aaaa", " x\u0416\U0001f600z", " zqzq"):
        best: list = []
        for cuts in itertools.product((False, True), repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends)]
            score = [p.score.get(x, p.unknown if len(x) == 1 else None) for x in parts]
            if None not in score:
                best.append((sum(score), ends))
        top = [ends for s, ends in best if s == max(s for s, _ in best)]
        found = p._paths(word)
        if len(top) == 1:
            assert found == p._pieces(word, top[0])
        elif found is not None:
            assert sorted(found) == sorted((ends, p._pieces(word, ends)) for ends in top)
    for at, cuts in ((0, [1, 5]), (65_530, [2, 9]), (10**6, [3])):
        assert pieces.tie_sum(at, cuts) == sum(pieces.tie(at + c) for c in cuts)


def test_quality_writes_no_second_copy_of_the_documents(spark, tmp_path):
    from pathlib import Path

    from siftlog.llm import common, quality

    rows = [(i, prose(i, 300), "en") for i in range(60)] + [(100, "too short", "en")]
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    good = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    good.write.parquet(str(tmp_path / "good"))
    assert [p.name for p in shared.iterdir() if p not in before and not p.name.startswith("word-counts-")] == []
    assert {r["doc_id"] for r in good.collect()} == set(range(60))
    # The filter stays above the counts: each is computed once.
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("monotonically_increasing_id()") and plan.count("Filter") == 1


def test_keep_one_deals_documents_out_once(spark):
    text = prose(1, 60)
    rows = [(3, text), (3, text), (4, text), (None, None), (None, None), (6, None), (7, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = minhash.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, text), (None, None), (None, None), (6, None), (7, "")], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    window, join = plan.index("row_number()"), plan.index("LeftSemi")
    assert window < join and "Exchange" not in plan[window:join]


def test_shuffle_files_go_with_the_query_that_stages(spark):
    import time
    from pathlib import Path

    from siftlog.llm import common

    def files() -> set[Path]:
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(common.CLEANUP)
    df = spark.range(1000).repartition(3, "id")  # held, so that no collection of garbage removes its files
    out = common.staged(df, "numbers")
    assert spark.conf.get(common.CLEANUP) == setting
    end = time.time() + 10
    while time.time() < end and files() - before:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 1000
