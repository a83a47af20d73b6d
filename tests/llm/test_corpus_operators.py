"""Operators that compare texts with one another, against plain versions."""

import glob
import hashlib
import os
import random

import cases
import plain
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bwt, components, exact_dedup, near_dedup, substring_dedup
from plumbline.session import shared_dir


def utf8(rows):
    return [(i, (t or "").encode()) for i, t in rows]


def test_exact_dedup_is_equality_of_normalised_texts(spark, none):
    docs = cases.documents(spark, extra=("keys", "row", "kept"))
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr) == plain.exact_groups(utf8(cases.awkward()))
    assert {r["doc_id"]: r["text_sha256"] for r in got}[5] == hashlib.sha256(b"Two words").hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_tells_clashing_keys_apart(spark):
    weak = exact_dedup.exact_dedup(cases.documents(spark), key=lambda chunk: len(chunk) % 3).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in weak), key=repr) == plain.exact_groups(utf8(cases.awkward()))


def test_exact_dedup_moves_only_texts_with_a_clashing_key(spark, monkeypatch):
    """Two of three hundred texts share a key: they and their copies are moved, nothing else."""
    rows = [(i, f"text number {i % 300}") for i in range(600)] + [(1000, None), (1001, "  text  number 7")]
    twin = {b"text number 7": 5, b"text number 8": 5}
    counts = []
    told_apart = exact_dedup._told_apart

    def counted(moved, clashes, key):
        counts.append((moved.count(), clashes.count()))
        return told_apart(moved, clashes, key)

    monkeypatch.setattr(exact_dedup, "_told_apart", counted)
    got = exact_dedup.exact_dedup(cases.documents(spark, rows), key=lambda chunk: twin.get(chunk, exact_dedup.chunk_key(chunk))).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr) == plain.exact_groups(utf8(rows))
    assert counts == [(4, 1)]  # doc_id 7, 307, 8 and 308; 1001 begins with a blank and is another text


def test_chunks_are_found_again_after_an_insertion():
    text = cases.prose(9, 20_000).encode()
    assert b"".join(exact_dedup.chunks(text)) == text
    moved = exact_dedup.chunks(b"some words more " + text)
    assert len(set(exact_dedup.chunks(text)) & set(moved)) >= len(moved) - 2
    assert max(map(len, exact_dedup.chunks(b"a" * 300_000))) <= exact_dedup.MOST


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    want = {}
    for a, b in edges:
        want.setdefault(a, {a})
        want.setdefault(b, {b})
        joined = want[a] | want[b]
        for x in joined:
            want[x] = joined
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["comp"] for r in components.components(df).collect()}
    assert got == {x: min(c) for x, c in want.items() if x != min(c)}
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_is_all_pairs(spark, percent):
    rng = random.Random(3)
    rows = cases.awkward()
    for group in range(4):
        base = cases.prose(50 + group, 80 + 60 * group).split()
        for copy in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, 4 + group)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
            rows.append((1000 + 100 * group + copy, " ".join(words)))
    docs = cases.documents(spark, rows, extra=("bands", "node", "comp"))
    assert cases.sorted_rows(near_dedup.near_dedup(docs, percent)) == plain.near_groups(utf8(rows), percent)


def test_near_dedup_of_chained_copies_and_empty_tables(spark, none):
    words = cases.prose(77, 200).split()
    chain = [(i, " ".join([f"c{k}" for k in range(i)] + words[i:])) for i in range(0, 60, 2)]
    assert cases.sorted_rows(near_dedup.near_dedup(cases.documents(spark, chain), 80)) == plain.near_groups(utf8(chain), 80)
    assert near_dedup.near_dedup(none, 80).count() == 0


def test_near_dedup_links_classes_that_begin_with_a_null_id(spark):
    text, other = cases.prose(88, 200), cases.prose(89, 200)
    rows = [(None, text), (None, other), (3, text), (2, text + " tail"), (4, other + " one"), (5, "one two " + other + " one")]
    docs = cases.documents(spark, rows).coalesce(1).orderBy(F.col("doc_id").asc_nulls_first())
    got = cases.sorted_rows(near_dedup.near_dedup(docs, 85))
    assert got == plain.near_groups(utf8(rows), 85)
    assert {i: c for i, _, c, _ in got if i} == {2: 2, 3: 2, 4: 4, 5: 4}


def test_prefix_pairs_leaves_out_sets_of_one_family_that_are_not_alike(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(120)]
    families = [[x if rng.random() < 0.85 else rng.getrandbits(63) for x in base] for _ in range(60)]
    near = [[*families[i][5:], i + 1] for i in range(10)]
    sets = dict(enumerate(families + near + [[1], [2, 3], base[:7]]))
    rest = spark.createDataFrame([(i, i, s) for i, s in sets.items()], "node long, comp long, shingles array<long>")
    for percent in (60, 80, 95):
        found = {frozenset(p) for p in near_dedup.prefix_pairs(rest, percent).select("a", "b").collect()}
        alike = {
            frozenset((a, b)) for a in sets for b in range(a) if 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})
        }
        assert alike <= found
        if percent == 80:
            assert len(alike) >= 10 and len(found) <= 2 * len(alike)  # 60 sets of one family give 1770 pairs


def test_half_bands_reach_the_wanted_recall():
    for similarity in (0.8, 0.85, 0.9):
        r = near_dedup.half_bands(similarity)
        p = similarity**near_dedup.HALF
        assert 1 - (1 - (1 - p) ** r) ** 2 <= near_dedup.MISS < 1 - (1 - (1 - p) ** (r - 1)) ** 2


def _suffix_groups(strings, depth):
    groups = {}
    for i, s in enumerate(strings):
        for k in range(len(s) - depth + 1):
            groups.setdefault(s[k : k + depth], []).append((i, k))
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_merged_transforms_are_the_transform_of_all(parts):
    rng = random.Random(parts)
    strings = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(60)))
    strings += [b"ab" * 30, "é日".encode() * 5]
    step = -(-len(strings) // parts)
    shards = [strings[i : i + step] for i in range(0, len(strings), step)]
    merged = bwt.merge([bwt.transform(s) for s in shards], 6)
    places = []
    for shard in shards:
        places.append([(i, k) for i, s in enumerate(shard) for k in range(len(s) + 1)])
    order = [(int(s) * step + places[s][p][0], places[s][p][1]) for s, p in zip(merged.shard, merged.suffixes, strict=True)]
    prefix = [strings[i][k : k + 6] for i, k in order]
    assert prefix == sorted(prefix, key=lambda p: p + b"" if len(p) == 6 else p)
    found = {}
    for place, block in zip(order, merged.block.tolist(), strict=True):
        found.setdefault(block, []).append(place)
    assert sorted(sorted(g) for g in found.values() if len(g) > 1) == _suffix_groups(strings, 6)
    for (i, k), (j, m), common in zip(order, order[1:], merged.common.tolist()[1:], strict=False):
        a, b = strings[i][k:], strings[j][m:]
        same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common == min(6, same) // 2 * 2


def substring_rows(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(set(utf8(rows)), key=lambda r: (r[0] is None, r[0])):
        gone = [False] * len(text)
        for i in range(len(text) - length + 1):
            if text[i : i + length] in seen:
                gone[i : i + length] = [True] * length
            seen.add(text[i : i + length])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(text), sum(gone), runs, bytes(b for b, g in zip(text, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [20_000, 1])
@pytest.mark.parametrize(("length", "gram"), [(100, 40), (20, 8)])
def test_substring_dedup_is_a_scan_over_all_strings(spark, length, gram, crowd):
    rng = random.Random(length)
    passages = [cases.prose(900 + i, 30) for i in range(6)]
    rows = cases.awkward()
    for i in range(40, 70):
        rows.append((i, " ".join(rng.choice([rng.choice(passages), cases.prose(rng.randrange(10**6), 12)]) for _ in range(5))))
    rows.append((71, rows[-1][1]))
    docs = cases.documents(spark, rows, extra=("spans", "doc"))
    got = substring_dedup.substring_dedup(docs, length, gram, crowd).select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]), F.size("removed"), "kept"
    )
    found = sorted({(*r[:4], bytes(r[4])) for r in got.collect()}, key=repr)
    assert found == substring_rows(rows, length)
    assert got.count() == len(rows)


def test_substring_dedup_leaves_no_files_of_its_steps(spark, monkeypatch):
    """Once the spans are known, only they are stored: no pieces, no shuffle files. Each piece that is compared moves once."""

    def files():
        folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        return {path for d in folders for path in glob.glob(f"{d}/*/shuffle_*")}, set(os.listdir(f"{shared_dir(spark)}/plumbline"))

    moved = {}
    keep = substring_dedup.keep

    def watched(df, label):
        moved[label] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        return keep(df, label)

    monkeypatch.setattr(substring_dedup, "keep", watched)
    passage = cases.prose(900, 60)
    rows = [(i, f"{cases.prose(i, 40)} {passage} {cases.prose(100 + i, 40)}") for i in range(12)] + [(12, passage), (13, None), (None, passage)]
    docs = cases.documents(spark, rows + rows)
    keep(docs, "any")  # the folder is there
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles, tables = files()
        got = substring_dedup.substring_dedup(docs)
        shuffled, stored = (after - before for after, before in zip(files(), (shuffles, tables), strict=True))
        assert not shuffled and [name.rsplit("-", 1)[0] for name in stored] == ["llm-spans"]
        assert moved["held"] == 2
        kept = [(r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted(kept, key=repr) == sorted([(d, n, k) for d, n, _, _, k in substring_rows(rows, 100)] * 2, key=repr)


def test_substring_dedup_of_empty_tables(spark, none):
    assert substring_dedup.substring_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(cases.documents(spark, [(1, None)])).first()["n_bytes"] == 0
