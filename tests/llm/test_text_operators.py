"""Operators that judge one text at a time, against the libraries or a plain version."""

import base64
import hashlib
import re

import cases
import plain
import pytest
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, decontaminate, lm_score, pii, quality, queries, token_counts, url_rules


def text_of(t):
    return t or ""


def test_byte_bpe_is_the_library_and_round_trips(spark, none):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = cases.documents(spark, extra=("ids", "decoded"))
    got = byte_bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN).collect()
    want = sorted(((i, library.encode_ordinary(text_of(t))) for i, t in cases.awkward()), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == want
    texts = sorted(((i, text_of(t).encode()) for i, t in cases.awkward()), key=repr)
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in got), key=repr) == texts
    assert byte_bpe.encode_and_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_merge_like_matrix_rows():
    import public_tokenizers

    bpe = byte_bpe.ByteBpe.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for piece in (b"thethertheione" * 30, "économiquement".encode() * 20, b"a" * 900, bytes(range(1, 255)) * 2):
        assert bpe.merge_long(piece) == bpe.merge_rows([piece])[0]


def test_token_counts_are_the_library(spark, none):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = cases.awkward() + [(20, " a  b▁c \n\n\td  "), (21, "▁"), (22, "   "), (23, "<s> </s> <unk> ▁▁x")]
    want = sorted(((i, len(text_of(t).encode()), len(model.encode(text_of(t)))) for i, t in rows), key=repr)
    docs = cases.documents(spark, rows, extra=("n_tokens", "word"))
    for entries in (0, 5, 1000):
        assert cases.sorted_rows(token_counts.token_counts(docs, path, entries)) == want
    assert token_counts.token_counts(none, path).count() == 0


def test_quality_learns_what_labels_mark(spark, docs, none):
    rows = [(i, cases.prose(i, 80) if i % 2 else " ".join(w.upper() + "!!" for w in cases.prose(i, 80).split())) for i in range(400)]
    texts = cases.documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    model = quality.fit_quality(texts, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score_text(texts, model).collect()}
    assert sum((scored[i] >= 0.5) == (i % 2 == 1) for i in range(300, 400)) >= 98
    every = quality.score_text(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(every) == len(cases.awkward()) and all(0 <= r["score"] <= 1 for r in every)
    constant = quality.fit_quality(texts, labels.filter("quality = 1"))
    assert constant.dictionaries is None and quality.score_text(docs, constant).count() == len(cases.awkward())
    assert quality.score_text(none, model).count() == 0
    assert quality.fit_quality(none, labels).dictionaries is None


@pytest.mark.parametrize("order", [2, 4])
def test_lm_scores_are_those_of_a_plain_trie(spark, order):
    rows = [(i, cases.prose(i, 40)) for i in range(100, 120)] + [r for r in cases.awkward() if r[0] is not None and r[0] not in (11, 12)]
    held = F.col("doc_id") % 5 == 2
    got = lm_score.lm_scores(cases.documents(spark, rows, extra=("score", "word")), held, order, table=10).collect()
    texts = [(i, text_of(t).encode()) for i, t in rows]
    train = [t for i, t in texts if i % 5 != 2]
    want = sorted(
        (i, *w[:3], round(w[3], 6), round(s, 2))
        for (i, _), w, s in zip(texts, plain.word_scores(train, [t for _, t in texts]), plain.ppm_scores(train, [t for _, t in texts], order), strict=True)
    )
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 2)) for r in got) == want


def test_lm_scores_prune_evenly_and_take_empty_tables(spark, docs, none):
    small = lm_score.lm_scores(docs, F.lit(False), 3, nodes=200).collect()
    assert len(small) == len(cases.awkward()) and all(r["score"] < 0 for r in small)
    untrained = lm_score.lm_scores(docs, F.lit(True), 3).filter("doc_id = 4").first()
    assert untrained["n_known"] == 0 and untrained["train_tokens"] == 0
    assert abs(untrained["score"] + 5 * 2.409933) < 1e-3
    assert lm_score.lm_scores(none, F.lit(False), 3).count() == 0


def test_lm_scores_use_every_node_whatever_is_broadcast(spark):
    rows = [(i, cases.prose(i, 40)) for i in range(100, 120)] + [r for r in cases.awkward() if r[0] is not None and r[0] not in (11, 12)]
    texts = [(i, text_of(t).encode()) for i, t in rows]
    train = [t for i, t in texts if i % 5 != 2]
    want = sorted((i, round(s, 2)) for (i, _), s in zip(texts, plain.ppm_scores(train, [t for _, t in texts], 3), strict=True))
    for nodes in (0, 200):
        got = lm_score.lm_scores(cases.documents(spark, rows), F.col("doc_id") % 5 == 2, 3, nodes=nodes).collect()
        assert sorted((r["doc_id"], round(r["score"], 2)) for r in got) == want


PII_TEXT = [
    "", "a@b.c", "x@y z@q.r.", "@@a@b.c.d@e.f", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.4", "4111111111111111 4111 1111 1111 1111 12", "4111111111111112",
    "+1 (988) 555-2485 +12 +1234567890123456 + 1 ++4930901820", "é@b.c ü 10.0.0.1 ☎ +4930901820", "1" * 3000 + "." + "2" * 30, "a" * 3000 + "@", "é\n+1 212\n555",
]


def test_pii_base_spans_are_the_patterns(spark, none):
    rows = cases.awkward() + [(100 + i, t) for i, t in enumerate(PII_TEXT)]
    got = pii.find_pii(cases.documents(spark, rows, extra=("spans",))).collect()
    want = sorted(((i, plain.base_spans(text_of(t))) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], [tuple(s) for s in r["base"]]) for r in got), key=repr) == want
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)
    assert pii.find_pii(none).count() == 0


def test_pii_field_adds_other_spellings_and_leaves_prose_alone(spark):
    planted = {
        1: ("the name (at) host (dot) org is", "name (at) host (dot) org"), 2: ("call me at (303) 555-0188 now", "(303) 555-0188"),
        3: ("seen at 10[.]9[.]8[.]7 today", "10[.]9[.]8[.]7"), 4: ("pay 4012.8888.8888.1881, please", "4012.8888.8888.1881"),
    }
    clean = {10 + i: (cases.prose(i, 300), None) for i in range(10)} | {30: ("on 2023-01-02 at 12:45 for $1,250.00 by 3.5%", None)}
    rows = [(i, t) for i, (t, _) in {**planted, **clean}.items()]
    found = {r["doc_id"]: [t[s["start"] : s["end"]] for s in r["spans"]] for r in pii.find_pii(cases.documents(spark, rows)).collect() for t in [dict(rows)[r["doc_id"]]]}
    assert found == {i: [want] if want else [] for i, (_, want) in {**planted, **clean}.items()}


def test_pii_rows_are_cut_without_effect():
    labeller = pii.Labeller(pii.train())
    tokens = (cases.prose(3, 124) + " ring (303) 555-0188 or 0049 30 901820 soon " + cases.prose(4, 200)).split()
    (cut,) = labeller.labels([tokens])
    numbers = [labeller.edge, *labeller.numbers(tokens), labeller.edge]
    whole = labeller.scores[numbers[1:-1], 0] + labeller.scores[numbers[:-2], 1] + labeller.scores[numbers[2:], 2]
    assert cut.tolist() == labeller.crf.decode(whole[None])[0].tolist() and cut.any()


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text_of(text)))


def plain_contamination(rows, items, size=10):
    out = []
    for i, t in rows:
        own, hit, names = words_of(t), set(), set()
        for item, text in items:
            w = words_of(text)
            n = min(size, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(item)
        out.append((i, len(own), len(hit), sorted(str(n) for n in names if n is not None) + [n for n in names if n is None]))
    return sorted(out, key=repr)


def test_contamination_is_a_plain_scan(spark, docs, none):
    items = [(1, cases.prose(1, 40)), (2, "Two words"), (10, cases.prose(1, 40)), (3, None), (4, ""), (None, "word"), (None, "Two words"), (5, cases.prose(5, 30)), (5, "absent phrase"), (6, "aba aba aba")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS spans")
    want = plain_contamination(cases.awkward(), items)
    for block in (5, 10_000):
        found = decontaminate.contamination(docs, table, block_words=block)
        got = found.select("doc_id", "n_words", decontaminate.hit_words("spans").alias("n"), "items").collect()
        assert sorted(((r[0], r[1], r[2], list(r[3])) for r in got), key=repr) == want
    assert decontaminate.contamination(none, table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).filter("size(spans) > 0").count() == 0


def test_contamination_query_is_its_sql_with_items_without_id(spark, tmp_path):
    import duckdb

    docs = [(1, "a word here"), (2, "nothing"), (3, "two words and a word"), (4, None), (5, "only two words"), (6, "other things")]
    items = [(None, "word"), (None, "nothing"), (3, "two words"), (3, "word and"), (None, None), (4, "..."), (None, "word")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op3_decontaminate(spark, str(tmp_path))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(decontaminate.SQL).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in found.collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 2), 4: (0, 0), 5: (2, 1), 6: (0, 0)}


def test_near_hits_find_all_terms_within_a_distance(spark):
    rows = [(1, "alpha x beta y y gamma"), (2, "alpha x x x x x x beta gamma"), (3, "gamma beta"), (4, "beta gamma alpha"), (5, None)]
    index = decontaminate.build_index(cases.documents(spark, rows).coalesce(1))
    names = index.selectExpr("shard", "posexplode(doc_ids) AS (place, doc_id)")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    near = decontaminate.near_hits(spark, index, items, 5).join(names, ["shard", "place"])
    assert {r["doc_id"] for r in near.collect()} == {1, 4}


def test_url_rules(spark):
    urls = {
        1: ("http://a.Example.com/en/x?q", "a.example.com", "/en/x", "example.com/en/", "block"),
        2: ("https://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        4: ("https://example.com", "example.com", "", None, "allow"),
        5: ("x://y.net/es/1#f", "y.net", "/es/1", "net/es/", "block"),
        6: ("y.net/es/1", "", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("http://play.casino.org/a", "play.casino.org", "/a", None, "block"),
        9: ("http://x.org/login/", "x.org", "/login/", None, "block"),
        10: ("http://x.org?u=http://y.net/fr/", "x.org", "", None, "allow"),
        11: ("http://x.org/cart/checkout", "x.org", "/cart/checkout", None, "block"),
        12: ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    }
    pages = spark.createDataFrame([(i, u[0]) for i, u in urls.items()] + [(1, urls[1][0])], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    want = sorted([(i, *u[1:]) for i, u in urls.items()] + [(1, *urls[1][1:])], key=repr)
    assert cases.sorted_rows(url_rules.url_verdicts(pages)) == want
    assert url_rules.url_verdicts(pages.limit(0)).count() == 0
    open_path = url_rules.ListRule("block", "org", "/lo")
    assert cases.sorted_rows(url_rules.url_verdicts(pages.filter("page_id = 9"), [open_path]))[0][3:] == ("org/lo", "block")


def test_every_url_rule_is_found_by_a_token(spark):
    assert url_rules.rule_index(url_rules.LIST_RULES + url_rules.PATTERN_RULES, {})[1] == []
    urls = {
        "http://x.org/login": "block", "http://x.org/signin.html": "block", "http://x.org/login2": "allow", "http://ads.x.org/": "block", "http://a.track.org": "block",
        "http://loads.org/": "allow", "http://x.org/a.exe": "block", "http://x.org/a.zip": "block", "http://x.org/exe": "allow", "http://x.org/a.zip/b": "allow", "http://x.org/a.EXE": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r["verdict"] for r in url_rules.url_verdicts(pages).orderBy("page_id").collect()] == list(urls.values())


def test_digests_of_the_empty_text(spark):
    row = queries.bpe_digests(cases.documents(spark, [(1, None)])).first()
    assert (row["n_tokens"], row["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
