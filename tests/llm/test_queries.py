"""Query functions without SQL, over whole small tables, against plain versions."""

import math

import plain
import pytest

from plumbline.llm import quality, queries


@pytest.fixture
def texts(spark, sf):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def plain_quality(text, model):
    """The score by a loop over blocks, each compressed by a compressor of its own."""
    import zstandard

    if model.dictionaries is None:
        return 1 / (1 + math.exp(-model.weights[0]))
    sizes = []
    for content in model.dictionaries:
        total = 0
        for i in range(0, len(text), 512):
            tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False) for _ in "ab"]
            total += len(tools[0].compress(text[i : i + 512])) - len(tools[1].compress(b""))
        sizes.append(total)
    bad, good = sizes
    a, b, c = model.weights
    z = a + b * (bad - good) / max(1, bad + good) + c * 64 / (64 + len(text))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_quality_scores_are_those_of_a_plain_loop(spark, sf, texts, monkeypatch):
    models, labelled = [], []
    fit = quality.fit_quality

    def recorded(docs, labels):
        labelled.extend(r["doc_id"] for r in labels.collect())
        models.append(fit(docs, labels))
        return models[-1]

    monkeypatch.setattr(quality, "fit_quality", recorded)
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, sf).collect()}
    assert len(got) == len(texts) and labelled and all(plain.fold(i, 4) != 2 for i in labelled)
    for doc_id, text in texts[:60]:
        r = got[doc_id]
        assert r["score"] == pytest.approx(plain_quality(text, models[0]), abs=1e-12)
    for doc_id, r in got.items():
        assert r["held_out"] == (plain.fold(doc_id, 4) == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1


def test_token_count_query_is_the_library(spark, sf, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    want = sorted((i, len(t), n, n > 4096) for i, t in texts for n in [len(model.encode(t.decode()))])
    assert sorted(map(tuple, queries.op6_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want
