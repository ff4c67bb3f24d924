"""The classifier's fit and features against plain ones; the pipeline on odd and empty tables, its packing against the library's ids."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tidewake.llm import quality_classifier as qc
from tidewake.llm._shared import stored
from tidewake.llm.queries import WORD_MODEL, table


def test_fit_is_logistic_loss_of_differences(spark):
    """Plain gradient descent over the same pairs comes to the same weights; the cut lies at label 0's share."""
    docs = table(spark, DATA.replace("0.001", "0.01"), "documents").join(table(spark, DATA.replace("0.001", "0.01"), "labels"), "doc_id").orderBy("doc_id").collect()
    x, y = qc.features([r.text for r in docs]), np.array([r.quality for r in docs])
    model = qc.fit(x, y)
    z = np.clip((x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1), -8, 8)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(y == 1), qc.PAIRS)] - z[draw.choice(np.flatnonzero(y == 0), qc.PAIRS)]
    w = np.zeros(x.shape[1])
    step = 1 / (np.linalg.eigvalsh(d.T @ d / len(d))[-1] / 4 + 1e-3)
    speed = w.copy()
    for k in range(20_000):
        ahead = w + k / (k + 3) * (w - speed)
        new = ahead - step * (-(d * (1 / (1 + np.exp(np.clip(d @ ahead, -30, 30))))[:, None]).mean(0) + 1e-3 * ahead)
        speed, w = w, new
        if np.abs(w - speed).max() < 1e-8:
            break
    assert np.abs(model.weights - w).max() < 1e-3 * np.abs(w).max()
    score = model.score(x)
    assert abs((score >= 0.7).mean() - (y == 1).mean()) < 0.02 and (score[y == 1].mean() > score[y == 0].mean())


def test_features_counted_anew():
    texts = ["One two two three.\nOne two two three.\nBUY NOW!! # | x", "", None, "ein Wort", "a " * 5000]
    got = {name: qc.features(texts)[:, k] for k, name in enumerate(qc.NAMES)}
    for k, t in enumerate(texts):
        words, lines = (t or "").split(), [x for x in (t or "").split("\n") if x]
        if not words:
            assert not any(got[n][k] for n in ("word_length", "log_words", "distinct", "line_repeats"))
            continue
        assert abs(got["log_words"][k] - np.log1p(len(words))) < 1e-12 and abs(got["distinct"][k] - len(set(words)) / len(words)) < 1e-12
        assert abs(got["adjacent_repeats"][k] - sum(a == b for a, b in zip(words, words[1:])) / len(words)) < 1e-12
        assert abs(got["line_repeats"][k] - (1 - len(set(lines)) / len(lines))) < 1e-12 and abs(got["upper_words"][k] - sum(w.isupper() for w in words) / len(words)) < 1e-12


def written(spark, path, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumn("ids", F.lit("clash")).withColumn("score", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


PARA = " ".join(f"word{i} of a passage that is long enough to stay" for i in range(12)) + "."
ODD = [(None, "no id " + PARA, "en", "a", 9), (1, None, "en", "a", None), (2, "", None, None, 0), (3, PARA, "en", "a", 1), (3, PARA, "en", "a", 1), (4, PARA + " And a few words more here.", "de", None, 1), (5, "x" * 50_000, "en", "b", 1), (6, "The old harbour town slept under a thin cover of fog. " * 5000, "en", "b", 1)]


@pytest.mark.parametrize("labels", [[], [(3, 1, 0), (4, 0, 0), (None, 1, 0), (1, 0, None)]])
def test_pipeline_on_odd_tables(spark, tmp_path, labels):
    import corpus_pipeline as pipeline

    pieces = pipeline.run(spark, written(spark, tmp_path / "odd", ODD, labels)).collect()
    assert all(p.length > 0 and 0 <= p.offset < 4096 for p in pieces)
    assert pipeline.run(spark, written(spark, tmp_path / "none", [], labels)).count() == 0


def test_packed_ids_are_the_library_s(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, DATA, "documents").select(*pipeline.COLUMNS)
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = stored(stage(spark, docs, DATA), f"stage-{k}")
    library = Tokenizer.from_file(WORD_MODEL)
    ids = {r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    pieces = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    at, windows = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at.get(p.doc_id, 0) and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        at[p.doc_id] = p.start + p.length
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert at == {k: len(v) for k, v in ids.items()}
    for k, parts in windows.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 4096 or k == max(windows))
