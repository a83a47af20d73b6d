"""Alignment and pair counts against a version that cuts, links and counts token by token."""

import hashlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import alignment, queries

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


def libraries():
    """Functions from a text to (id, bytes) of its tokens, by the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = {}

    def bytes_of(token):
        if token not in shown:
            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            table = {chr(b): b for b in plain}
            table.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
            shown[token] = bytes(table[c] for c in token)
        return shown[token]

    def a(text):
        return [(i, bytes_of(one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]

    def b(text):
        out = []
        for i in two.encode(text):
            p = two.id_to_piece(i)
            out.append((i, bytes([int(p[3:-1], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    return a, b


def plain(rows):
    one, two = libraries()
    done, held, links_of = [], Counter(), []
    for _, text in rows:
        a, b = (one(text), two(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(t) for _, t in x]).tolist() for x in (a, b)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(([t for t, _ in a[i : to[0]]], [t for t, _ in b[j : to[1]]]))
            i, j = to
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        links_of.append(links)
        done.append((len(a), len(b), groups))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups), links in zip(rows, done, links_of, strict=True):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        total = sum(n * held[p] for p, n in links.items())
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = [
    (20, "a\xa0 b  \xa0c"), (21, "a \n\n b\t c\x1c !\x1c! \x1fx"), (22, "<|endoftext|> <s> </s> <unk>"), (23, "  lead"), (24, "tail  \n"), (25, "\n"), (26, "x\r\n\r\ny   z"), (27, "a▁b"),
    (28, "​​q don't we'll  I'm"), (29, "１２ ٣٤ 中文 ，好"), (30, "abcabcabdab" * 90), (31, "ab" * 30_000), (32, " "), (33, "é﻿")
]


def test_counts_are_those_of_a_plain_alignment(spark, none, monkeypatch):
    rows = cases.awkward() + ODD
    want = plain(rows)
    docs = cases.documents(spark, rows, extra=("row", "pairs", "n_a", "pair"))
    for entries in (1_000_000, 300, 0):
        assert cases.sorted_rows(alignment.link_counts(docs, A, B, entries)) == want
    assert alignment.link_counts(none, A, B).count() == 0


def test_query_on_the_given_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert cases.sorted_rows(queries.op13_alignment(spark, sf)) == plain(rows)


def test_groups_are_what_the_digest_covers(spark, docs):
    digests = {}
    for r in alignment.aligned_groups(docs, A, B).collect():
        cuts = list(zip([0, *r["cut_a"]], r["cut_a"], [0, *r["cut_b"]], r["cut_b"], strict=False))
        text = ";".join(",".join(map(str, r["ids_a"][i:j])) + "|" + ",".join(map(str, r["ids_b"][k:m])) for i, j, k, m in cuts)
        digests.setdefault(r["doc_id"], set()).add(hashlib.sha256(text.encode()).hexdigest() if cuts else "")
    got = defaultdict(set)
    for r in alignment.link_counts(docs, A, B).collect():
        got[r["doc_id"]].add(r["groups_sha256"])
    assert digests == dict(got)


def test_small_caches_and_reduced_groups_change_nothing(monkeypatch):
    aligner = alignment.Aligner(A, B)
    texts = [t for _, t in cases.awkward() + ODD]
    found = aligner.align(texts)
    pairs = [x.tolist() for x in aligner.pairs(found)]
    monkeypatch.setattr(alignment, "CACHE", 3)
    monkeypatch.setattr(alignment, "REDUCE", 1)
    for i, text in enumerate(texts):
        own = aligner.align([text])
        assert own.n_a[0] == found.n_a[i] and aligner.digests(own) == [aligner.digests(found)[i]]
    assert [x.tolist() for x in aligner.pairs(found)] == pairs


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1), st.sets(st.integers(0, 200), min_size=1), st.integers(-5, 300))
def test_galloping_finds_what_both_lists_hold(short, long, start):
    short, long = np.array(sorted(short)), np.array(sorted(long))
    got = alignment.gallop(short, long, np.full(len(short), start))
    assert got.tolist() == [long.tolist().index(v) if v in long else -1 for v in short]


@pytest.mark.parametrize("entries,least", [(0, 8), (1, 4), (3, 2), (5, 2), (6, 1), (100, 1)])
def test_frequent_pairs_stay_within_their_bound(spark, entries, least):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([5, 3, 2, 1, 1, 1])], "pair long, n long")
    assert alignment.frequent_from(counts, entries) == least
