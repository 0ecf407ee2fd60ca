"""Stages against brute force on a small corpus: what each keeps, and the columns between them."""

import random

import corpus_pipeline
from llm.conftest import frame, sentence
from llm.test_simhash import expected


def test_stages_on_planted_documents(lspark, tmp_path):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = sentence(rnd, 60)
        rows.append((i, " ".join(w + "###" for w in text.split()) if bad else text, "en", f"s{i % 2}", 1))
        labels.append((i, int(not bad), 0))
    passage = sentence(rnd, 30)
    rows += [(400, sentence(rnd, 60) + " " + passage, "en", "s0", 1), (401, rows[1][1], "en", "s1", 1),
             (402, rows[1][1], "en", "s0", 1), (403, "too short", "en", "s0", 1), (404, None, None, None, None)]
    frame(lspark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    lspark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lspark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = lspark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(lspark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = lspark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in docs.collect()}
        if name != "tokenise":
            assert docs.columns == columns
        if name == "near_dedup":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            assert left[name] == {c for _, _, c in expected(texts)}
    good = {i for i in range(300) if i % 4}
    assert left["quality_rules"] == set(range(300)) | {400, 401, 402}
    assert left["quality_classifier"] == good | {400, 401, 402}
    assert left["near_dedup"] == good | {400}
    assert left["decontamination"] == left["tokenise"] == good
    out = corpus_pipeline.run(lspark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == good
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_edge_rows_and_empty_tables(lspark, tmp_path):
    """Every stage: NULLs, blank and long texts, repeated rows, clashing columns, an empty table."""
    from llm.conftest import edge_rows

    lspark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lspark.createDataFrame([(1, None), (2, ""), (3, "the quick brown fox and the lazy dog")],
                           "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = edge_rows()
    for docs in (frame(lspark, rows, clash=True), frame(lspark, rows, clash=True).limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(lspark, docs, str(tmp_path))
            if name != "tokenise":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            kept = out.count()
            # without labels the classifier keeps all; no row holds a benchmark passage; all are tokenised
            assert kept <= n if name in ("quality_rules", "near_dedup") else kept == n, name
            assert bool(kept) == bool(n)


def test_repeated_passage_is_gone_from_the_output(lspark, tmp_path):
    """Lines above the limit leave the kept documents and never reach the tokens."""
    rnd = random.Random(31)
    passage = sentence(rnd, 20)
    texts = [sentence(rnd, 60) for _ in range(40)]
    rows = [(i, t + "\n" + passage, "en", "s0", len(t) + 1 + len(passage)) for i, t in enumerate(texts)]
    rows.append((100, "NULL source and no passage " + sentence(rnd, 60), "en", None, 7))
    for name, data in (("with", rows), ("without", [(r[0], r[1].split("\n")[0], *r[2:]) for r in rows])):
        frame(lspark, data).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        lspark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        lspark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs = lspark.read.parquet(f"{tmp_path}/with/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.quality_rules(lspark, docs, f"{tmp_path}/with").collect()}
    assert {i: out[i].text for i in range(40)} == dict(enumerate(texts))
    assert all(out[i].n_chars == len(texts[i]) for i in range(40)) and out[100].n_chars == 7
    tokens = [corpus_pipeline.run(lspark, f"{tmp_path}/{name}") for name in ("with", "without")]
    assert tokens[0].exceptAll(tokens[1]).isEmpty() and tokens[0].count() == 41
