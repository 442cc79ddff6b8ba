"""The pipeline's stages, one after another, against brute force on a small fixture."""

import re

import corpus_pipeline
from test_text_operators import BASE, jaccard_brute, near, words

BAD = ["zounds", "fiend", "knave"]


def tables(spark, path):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        text = words(40)
        if toxic:
            text = " ".join(w if k % 6 else BAD[k % 3] for k, w in enumerate(text.split()))
        rows.append((i, text, "en", "s", len(text), "clash"))
        labels.append((i, 1, int(toxic)))
    passage = words(80)
    extra = [BASE, BASE, near(BASE, 1), None, "", passage + " " + words(30), words(30) + " " + passage, "mail ann@x.org now " + words(20), words(20) + " ip 1.2.3.4"]
    rows += [(1000 + i, t, "en", None, 0, "") for i, t in enumerate(extra)]
    rows += [(1001, BASE, None, None, None, None), (None, "no id " + words(20), "en", "s", 1, "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_id string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            path = f"{tmp_path}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            kept[name] = [tuple(r) for r in docs.collect()]
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    clean = kept["toxicity"]
    wrong = [r[0] for r in clean if r[0] is not None and r[0] < 300 and r[0] % 5 == 0]
    assert len(wrong) <= 3 and {r[0] for r in rows} - {r[0] for r in clean} <= set(range(0, 300, 5))
    component = jaccard_brute({r[0]: r[1] for r in clean if r[0] is not None})
    assert sorted({r[0] for r in kept["jaccard"] if r[0] is not None}) == sorted(i for i, (_, c) in component.items() if c == i)
    seen = set()
    got = {r[0]: r[1] for r in kept["suffixes"] if r[0] is not None}
    for doc, t in sorted((r[0], r[1]) for r in kept["jaccard"] if r[0] is not None):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        left = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        assert got.get(doc, "") == left
    assert any(r[0] is None for r in kept["suffixes"])
    for doc, t, *_ in kept["pii"]:
        assert not re.search(r"ann@x|1\.2\.3\.4", t)
        if "org" not in (text.get(doc) or "") and "1.2.3" not in (text.get(doc) or ""):
            assert t == (got.get(doc) if doc is not None else [r[1] for r in kept["suffixes"] if r[0] is None][0])
    pieces = docs.collect()
    assert sum(r["length"] for r in pieces) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] for r in pieces}.values())
    assert {r["doc_id"] for r in pieces} == {r[0] for r in kept["pii"]}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in whole if r["doc_id"] is not None) == sorted(tuple(r)[:5] for r in pieces if r["doc_id"] is not None)


def test_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_tables_go_with_their_stage(spark, tmp_path):
    """After the stages toxicity and jaccard only the table that the latter's result reads is left."""
    from pathlib import Path

    from tessera.llm import common

    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(common.scratch_dir(spark).removeprefix("file://")) / "tables"
    before = set(folder.glob("*"))
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert set(folder.glob("*")) == before
    left = corpus_pipeline.jaccard(spark, docs, str(tmp_path))
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - before] == ["gone"]
    assert 0 < kept.count() < docs.count() and 0 < left.count() < docs.count()
