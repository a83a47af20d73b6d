"""The pipeline against its stages by hand, and the registration of all queries."""

import base64
import hashlib
import os

import cases
import corpus_pipeline
import plain
import pytest
from pyspark.sql import functions as F
from test_text_operators import plain_contamination

from plumbline.llm import quality
from plumbline.llm.common import only
from plumbline.llm.queries import ORACLES, QUERIES
from plumbline.session import shared_dir


NO_ID = 10**9


def stored_tables(spark):
    folder = f"{shared_dir(spark)}/plumbline"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.fixture
def folder(spark, tmp_path):
    junk = [(i, " ".join(w.upper() + "!!" for w in cases.prose(i, 60).split())) for i in range(500, 560)]
    fine = [(i, cases.prose(i, 60)) for i in range(600, 700)]
    near = [(800 + i, fine[i][1] + " tail") for i in range(10)]
    leaked = [(900 + i, cases.prose(2000 + i, 30) + " " + cases.prose(1, 40)) for i in range(5)]
    rows = cases.awkward() + junk + fine + near + leaked + [(950, fine[0][1].replace(" ", "\n"))]
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0) for i, _ in junk[:40]] + [(i, 1) for i, _ in fine[:60]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, cases.prose(1, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_run_is_its_stages_by_hand(spark, folder):
    import public_tokenizers
    import tiktoken

    path, rows = folder
    model = quality.fit_quality(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    tools = quality.compressors(model.dictionaries)
    # rows without an id come after all others
    texts = [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    left = [(i, t) for i, t in texts if model.score(*quality.compressed_sizes(t, tools), len(t)) >= corpus_pipeline.LEAST_QUALITY]
    assert not {i for i, _ in left} & set(range(500, 560)) and set(range(600, 700)) <= {i for i, _ in left}
    keep = {g[0] for g in plain.exact_groups(left) if g[3]}
    left = sorted({(i, t) for i, t in left if i in keep})
    keep = {g[0] for g in plain.near_groups(left, corpus_pipeline.NEAR_PERCENT) if g[3]}
    left = [(i, t) for i, t in left if i in keep]
    hit = plain_contamination([(i, t.decode()) for i, t in left], [(1, cases.prose(1, 40))])
    left = [(i, t) for i, t in left if i in {h[0] for h in hit if not h[2]}]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in left:
        ids = library.encode_ordinary(t.decode())
        want.append((None if i == NO_ID else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()))
    before = stored_tables(spark)
    assert cases.sorted_rows(corpus_pipeline.run(spark, path)) == sorted(want, key=repr)
    assert NO_ID in {i for i, _ in left} and None in {w[0] for w in want}
    assert [name.rsplit("-", 1)[0] for name in sorted(stored_tables(spark) - before)] == ["llm-pipeline"]


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS score", "2 AS kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_texts_under_one_id_are_judged_apart(spark, folder):
    path, _ = folder
    a, b, c = (cases.prose(i, 60) for i in (3001, 3002, 3003))
    leaked = cases.prose(3004, 30) + " " + cases.prose(1, 40)
    rows = [(1, a), (2, a.replace(" ", "\n")), (2, b), (2, c), (3, c + " tail"), (4, c + " end"), (4, leaked), (4, cases.prose(3005, 60)), (None, b)]
    docs = cases.documents(spark, rows, extra=("row", "number"))
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.decontamination_stage):
        docs = stage(spark, docs, path)
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted([(1, a), (2, b), (2, c), (4, cases.prose(3005, 60))])  # the row without id is a copy of one with an id
    clean = corpus_pipeline.decontamination_stage(spark, cases.documents(spark, [(None, a), (None, leaked)]), path)
    assert [r["text"] for r in clean.collect()] == [a]


def test_rows_of_files_are_known_by_file_and_place(spark, folder, tmp_path):
    path, _ = folder
    a, b = cases.prose(3001, 60), cases.prose(3002, 60)
    rows = [(5, a), (5, a), (4, b), (None, b), (None, "x y"), (3, a + " tail"), (2, None), (1, "")] * 3
    docs = cases.documents(spark, rows, extra=("number", "file", "place"))
    docs.write.parquet(f"{tmp_path}/some files.parquet")
    read = spark.read.parquet(f"{tmp_path}/some files.parquet")
    assert corpus_pipeline._reread(read) and not corpus_pipeline._reread(docs) and not corpus_pipeline._reread(read.filter("doc_id > 0"))
    numbered, texts, number = corpus_pipeline._numbered(read)
    assert numbered.select(number).distinct().count() == len(rows) == texts.count()
    assert sorted(map(tuple, numbered.select("text", number).collect()), key=repr) == sorted(map(tuple, texts.select("text", "doc_id").collect()), key=repr)
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.decontamination_stage):
        assert stage(spark, read, path).columns == docs.columns
        assert cases.sorted_rows(stage(spark, read, path)) == cases.sorted_rows(stage(spark, docs, path))


def test_numbering_rows_of_files_moves_no_texts(spark, folder):
    path, _ = folder
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the table is larger than what Spark would send by itself
    try:
        rows, texts, _ = corpus_pipeline._numbered(spark.read.parquet(f"{path}/documents.parquet"))
        for df in (rows, texts):
            assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_picks_rows_by_number_without_moving_them(spark):
    numbers = [0, 1, 63, 64, 65, 127, 5 << 40, (5 << 40) + 63, (1 << 62) + 7]
    rows = spark.createDataFrame([(n + d, f"t{n}{d}") for n in numbers for d in (0, 0, 2)], "n long, text string")
    wanted = spark.createDataFrame([(n,) for n in numbers * 2], "doc_id long")
    got = only(rows, "n", wanted, "words")
    assert got.columns == rows.columns
    assert sorted(got.collect()) == sorted(r for r in rows.collect() if r["n"] in numbers)
    assert only(rows, "n", wanted.limit(0), "words").count() == 0
    many = spark.range(200_000).select(F.col("id").alias("n"), F.lit("text").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100_000)  # numbers would not fit, their words do
    try:
        picked = only(many, "n", spark.range(0, 200_000, 3), "words")
        assert picked.count() == 66_667 and "hashpartitioning" not in picked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf, name):
    from oracle import compare, duck

    ok, message = compare(spark, duck(sf), name, QUERIES[name], ORACLES[name], sf)
    assert ok, message
