"""Held-out accuracy, independence from labels of held-out rows, exact sums, edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
from llm.conftest import edge_rows, frame, sentence

from tracefuse.llm import quality_net as q

LABEL = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = sentence(rnd, 40)
        if bad:
            text = " ".join(w + rnd.choice(["###", "$$$", "!!"]) for w in text.split()) if i % 2 else text.replace(" ", " | ")
        docs.append((i, text, "en", "s", 1))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_accuracy_and_calibration(lspark):
    docs, labels = corpus()
    truth = {d: y for d, y, _ in labels}
    got = q.score_documents(frame(lspark, docs, clash=True), lspark.createDataFrame(labels, LABEL)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    # labels of held-out rows change nothing, nor does the number of partitions
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y, t) for d, y, t in labels]
    again = q.score_documents(frame(lspark, docs).repartition(7), lspark.createDataFrame(flipped, LABEL)).collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in got)


def test_context_sums_against_brute_force(lspark):
    rows = edge_rows()
    index = q.index_vectors().astype(np.int64)
    want, count = np.zeros((q.BUCKETS, q.DIMS), np.int64), np.zeros(q.BUCKETS, np.int64)
    for r in rows:
        ids, _ = q.token_buckets([r[1] or ""])
        for i, b in enumerate(ids):
            count[b] += 1
            for j in range(max(0, i - q.REACH), min(len(ids), i + q.REACH + 1)):
                if j != i:
                    want[b] += index[ids[j]]
    got = q.context_sums(frame(lspark, rows)).toPandas().set_index("bucket").sort_index()
    used = np.flatnonzero(count)
    assert got.index.tolist() == used.tolist() and (got["n"].to_numpy() == count[used]).all()
    assert (got[[f"v{i}" for i in range(q.DIMS)]].to_numpy() == want[used]).all()


def test_tokens_do_not_depend_on_the_batch():
    texts = ["", "A bc, DE!! 12", "\U0001f600 中文x", "\n\n", "é É ß", "a" * 300]
    ids, sizes = q.token_buckets(texts)
    assert ids.tolist() == [i for t in texts for i in q.token_buckets([t])[0].tolist()]
    assert sizes.sum() == len(ids) and sizes[0] == sizes[3] == 0
    vectors = np.random.default_rng(1).normal(size=(q.BUCKETS, q.DIMS)).astype(np.float32)
    rows = q.pool_texts(pa.array(texts), vectors)
    assert np.allclose(rows[1], q.pool_texts(pa.array(texts[1:2]), vectors)[0]) and not rows[0].any()


def test_edges(lspark):
    rows = edge_rows()
    none = lspark.createDataFrame([], LABEL)
    one = lspark.createDataFrame([(6, 1, 0), (9, 1, 0), (None, 0, 0), (10, None, 0)], LABEL)
    for labels, score in ((none, 0.5), (one, 1.0)):
        for clash in (False, True):
            df = frame(lspark, rows, clash)
            got = q.score_documents(df, labels).collect()
            assert len(got) == len(rows) and {r.score for r in got} <= {score, 0.5}
            assert q.keep_good(df, labels).count() == len(rows) and q.keep_good(df, labels).columns == df.columns
    docs, labels = corpus()
    mixed = frame(lspark, docs + [(1000, None, None, None, None), (1001, "", None, None, None), (None, "x", None, None, None)])
    got = {r.doc_id: r for r in q.score_documents(mixed, lspark.createDataFrame(labels, LABEL)).collect()}
    assert len(got) == 403 and got[1000].score == got[1001].score
    empty = frame(lspark, []).limit(0)
    assert q.score_documents(empty, lspark.createDataFrame(labels, LABEL)).count() == 0
