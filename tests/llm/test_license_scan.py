"""License scans against a version that tries every block with every template."""

import random
import re

import cases
import pytest

from plumbline.llm import license_scan, queries


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(rows, parts, phrases, percent):
    out = []
    for doc_id, text in rows:
        own = words_of(text)
        places, blocks = set(), set()
        for label, phrase in phrases:
            p = words_of(phrase)
            places |= {(label, i, i + len(p)) for i in range(len(own) - len(p) + 1) if p and own[i : i + len(p)] == p}
        for label, template in parts:
            t = words_of(template)
            h = 1
            while h < len(t):
                h *= 2
            for lo in range(0, len(own), h) if t and label is not None else ():
                common = len(set(t) & set(own[lo : lo + 2 * h]))
                if 100 * common >= percent * len(set(t)):
                    blocks.add((label, lo, min(lo + 2 * h, len(own)), common, len(set(t))))
        out.append((doc_id, len(own), sorted(places), sorted(blocks)))
    return sorted(out, key=repr)


def scanned(df):
    return sorted(((r[0], r[1], sorted(map(tuple, r[2])), sorted(set(map(tuple, r[3])))) for r in df.collect()), key=repr)


PARTS = [("a", "The house of a river entre thing"), ("a", "the HOUSE of a river, entre thing"), ("b", "river house"), ("b", "word"), ("c", None), (None, "thing"), ("d", " ".join(cases.prose(1, 40).split()[5:30]))]


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_blocks_and_places_are_those_of_a_plain_scan(spark, none, percent):
    rows = cases.awkward() + [(i, cases.prose(i, 90)) for i in range(30, 60)] + [(61, "Aba. " * 30 + "the house of a river entre the thing"), (62, "aba " * 3000 + "river x house")]
    phrases = [("p", "aba aba"), ("q", "the thing"), ("p", "two words"), ("r", ""), ("q", "house of")]
    docs = cases.documents(spark, rows, extra=("label", "places", "n_words", "row"))
    got = scanned(license_scan.scan(docs, PARTS, phrases, percent))
    assert got == plain(rows, PARTS, phrases, percent)
    assert any(r[3] for r in got) and any(r[2] for r in got)
    assert license_scan.scan(none, PARTS, phrases, percent).count() == 0


def test_random_sets(spark):
    rng = random.Random(4)
    names = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(names, [2.0**-k for k in range(12)], k=rng.randrange(1, 60)))) for i in range(120)]
    parts = [(f"t{i % 9}", " ".join(rng.sample(names, rng.randrange(1, 11)) + rng.choices(names, k=rng.randrange(3)))) for i in range(25)]
    phrases = [("p", " ".join(rng.choices(names[:5], k=k))) for k in (1, 2, 2, 3)]
    got = scanned(license_scan.scan(cases.documents(spark, rows), parts, phrases, 80))
    assert got == plain(rows, parts, phrases, 80)


def test_query_on_the_given_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = []
    for doc_id, n, places, blocks in plain(rows, license_scan.TEMPLATES, license_scan.PHRASES, license_scan.PERCENT):
        starts = [lo for _, lo, _ in places]
        labels = sorted({p[0] for p in places} | {b[0] for b in blocks})
        score = 1.0 if places else max((b[3] / b[4] for b in blocks), default=0.0)
        want.append((doc_id, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[0] for p in places})), ",".join(labels), score))
    got = cases.sorted_rows(queries.op12_license_scan(spark, sf))
    assert got == sorted(want, key=repr)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = (cases.prose(8, 4000) + " under the MIT-License ").encode()
    index = license_scan.LicenseIndex([], license_scan.templates([("mit", "under the mit license")], 100), [b"license", b"mit", b"under", b"the"])
    whole = index.ranks(text)
    monkeypatch.setattr(license_scan, "PIECE", 100)
    assert index.ranks(text).tolist() == whole.tolist() and len(whole) == len(license_scan.words(text))
    assert index.places(whole) == [("mit", len(whole) - 4, len(whole))]


def test_license_variants_and_clean_prose(spark):
    rows = [
        (1, "Licensed under the GNU General Public License, version 3."), (2, "permission is hereby granted, FREE of charge, to any person obtaining a copy of this software and documentation files to deal in the software without restriction"),
        (3, "Er ging mit der Gruppe in die Stadt, mit License oder ohne."), (4, "The general said the public has a license to fish."), (5, "Released under the MIT License."), (6, "a driving license, the new one, under the seat"),
    ]
    got = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in license_scan.license_labels(cases.documents(spark, rows)).collect()}
    assert got == {1: ("", "gpl"), 2: ("", "mit"), 3: ("", ""), 4: ("", ""), 5: ("mit", "mit"), 6: ("", "")}


def test_templates_beyond_the_bound_are_refused(spark, docs, monkeypatch):
    monkeypatch.setattr(license_scan, "MOST", 5)
    with pytest.raises(ValueError, match="broadcast"):
        license_scan.build_index(docs)
