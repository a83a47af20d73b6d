"""What decontamination holds at a time: shards of the stored index, entries of lists, blocks of items."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from plumbline.llm import decontaminate as D


def test_a_row_group_holds_a_few_shards(spark):
    """Writer and reader hold a row group, which was all shards of a file up to 100."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, "1")  # a shard for each text
    try:
        index = D.build_index(spark.range(0, 9, 1, 1).selectExpr("id AS doc_id", "concat('words of ', id) AS text"))
    finally:
        spark.conf.unset(rows)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    assert index.count() == 9
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= D.GROUP_SHARDS


def test_common_words_are_looked_up_a_bounded_number_at_a_time(monkeypatch):
    """Windows of words that fill the text: their lists used to be taken for 4096 windows at once."""
    text = "a b a a c b " * 200
    [row] = [r for b in D._index(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})])) for r in b.to_pylist()]
    terms = row["terms"]
    shard, own = D.Shard(row, terms), D.words(text.encode())
    windows = np.array([(x, y, z) for x in range(3) for y in range(3) for z in range(3)], np.int64)
    taken, lists = [], D.Shard.lists
    monkeypatch.setattr(D, "ENTRIES", 500)
    monkeypatch.setattr(D.Shard, "lists", lambda self, some: taken.append(int(self.df[some].sum())) or lists(self, some))
    got = sorted(zip(*(x.tolist() for x in shard.phrases(windows)), strict=True))
    assert got == sorted((w, i) for w, t in enumerate(windows) for i in range(len(own) - 2) if own[i : i + 3] == [terms[k] for k in t])
    assert max(taken) < 500 + len(own)


def test_hits_of_a_block_are_stored(spark):
    """The search runs when it is asked for, in batches of its own size, and leaves nothing sent behind."""
    index = D.build_index(spark.createDataFrame([(1, "one two three four"), (2, "two three")], "doc_id long, text string").coalesce(1))
    items = spark.createDataFrame([("x", "two three"), ("y", "three four"), ("z", "four")], "item_id string, text string")
    hits = D.phrase_hits(spark, index, items, block_words=1)
    assert "MapInArrow" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["place"], r["items"], [tuple(s) for s in r["spans"]]) for r in hits.collect()) == [(0, ["x"], [(1, 3)]), (0, ["y"], [(2, 4)]), (0, ["z"], [(3, 4)]), (1, ["x"], [(0, 2)])]
