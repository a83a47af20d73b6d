"""Transforms and their merge in rounds of two and of four symbols, against sorted suffixes."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bwt

STRINGS = st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)) | st.sampled_from([b"a", b"ab" * 30, b"x" * 50]), min_size=1, max_size=8)


def suffixes(strings):
    """(suffix, string, text position) of all suffixes, ends included, in order."""
    out, at = [], 0
    for i, x in enumerate(strings):
        out += [(x[k:], i, at + k) for k in range(len(x) + 1)]
        at += len(x) + 1
    return sorted(out, key=lambda s: (tuple(b + 1 for b in s[0]) + (0,), s[1]))


@settings(max_examples=150, deadline=None)
@given(STRINGS)
def test_transform_sorts_all_suffixes(strings):
    assert bwt.transform(strings).suffixes.tolist() == [at for _, _, at in suffixes(strings)]


@settings(max_examples=150, deadline=None)
@given(STRINGS, STRINGS, st.sampled_from([4, 8, 40]))
def test_rounds_of_four_symbols_merge_as_rounds_of_two(one, two, depth):
    parts = [bwt.transform(one), bwt.transform(two)]
    slow, fast = bwt.merge(parts, depth), bwt.merge(parts, depth, 4)
    for name in ("shard", "suffixes", "block"):
        assert np.array_equal(getattr(slow, name), getattr(fast, name))
    assert np.array_equal(slow.common // 4 * 4, fast.common)


def test_many_kinds_of_fours_are_merged_by_twos():
    rng = np.random.default_rng(3)
    parts = [bwt.transform([bytes(rng.integers(0, 250, 90_000, dtype=np.uint8))]) for _ in range(2)]
    assert np.array_equal(bwt.merge(parts, 8).shard, bwt.merge(parts, 8, 4).shard)
    with pytest.raises(ValueError):
        bwt.merge(parts, 6, 4)
