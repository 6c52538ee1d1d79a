"""The pipeline against what its stages must do, by brute force on planted rows."""

from __future__ import annotations

import numpy as np
from test_operators import brute_quality, prose

import corpus_pipeline
from siftlog.llm import pieces, pii


def planted():
    good = [(i, prose(i, 150)) for i in range(40)]
    edited = good[3][1].split()
    edited[75] = "other"
    bench = prose(900, 35)
    bad = " ".join(f"{w}&&&%%%" for w in prose(50, 150).split())
    rows = [
        *good,
        (100, good[2][1]),  # an exact copy
        (101, " ".join(edited)),  # a near copy
        (102, "too short"),
        (103, "again and again we say the same words " * 30),
        (104, bad),
        (105, prose(60, 80) + " " + bench + " " + prose(61, 80)),  # a leak
        (106, prose(62, 100) + " write to someone@example.com or +1 (415) 555-0100 today " + prose(63, 60)),
        (107, None),
        (108, prose(64, 40_000)),  # very long
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], [(0, bench), (1, prose(901, 30))]


def test_stages(spark, tmp_path):
    rows, items = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    texts = {r[0]: r[1] for r in rows}
    failed = {i for i, t in texts.items() if brute_quality(t)[5]}
    assert {102, 103, 107} <= failed
    assert set(seen["quality"]) == set(texts) - failed - {104}
    assert set(seen["near_duplicates"]) == set(seen["quality"]) - {100, 101}
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - {105}
    masked = {i: r["text"] for i, r in seen["personal_data"].items()}
    assert masked == {i: pii.masked(texts[i]) for i in seen["decontamination"]}
    assert "[EMAIL]" in masked[106] and "[PHONE]" in masked[106] and masked[5] == texts[5]
    p = pieces.Pieces(pieces.default_model())
    assert {i: p.decode(bytes(r["ids"])) for i, r in seen["encoding"].items()} == masked
    assert all(r["n_tokens"] == len(np.frombuffer(bytes(r["ids"]), pieces.TYPE)) for r in seen["encoding"].values())
    got = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: bytes(r["ids"]) for i, r in seen["encoding"].items()}
