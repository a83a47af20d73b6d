"""Burrows-Wheeler transforms of string collections and their merge, on numpy arrays.

A shard's transform comes from its suffix array. Transforms of several shards
are merged without looking at suffixes again: the interleave says for each place
of the merged order which shard its suffix is from. One refinement moves every
place by two or four transform symbols (a stable counting sort), which turns an order
by the first h symbols into one by h + 2 or h + 4. Places that were told apart stay apart,
so the blocks of places with equal prefixes, and with them the common prefix
of neighbours, come out of the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Transform:
    """For each suffix in order the two symbols before it (0 ends a string, else byte + 1) and its text position.

    ``last``: the last symbol of each string.
    """

    pairs: np.ndarray
    suffixes: np.ndarray
    last: np.ndarray


def transform(strings: list[bytes]) -> Transform:
    """The transform of UTF-8 strings that are not empty, each followed by an end of its own; ends sort before all bytes, in list order."""
    text = np.frombuffer(b"".join(x + b"\xff" for x in strings), np.uint8) + np.uint8(1)
    n, ends = len(text), np.flatnonzero(text == 0)
    # The first eight symbols as one number; what follows an end counts as 0, so a number holds an end if its last symbol is one.
    head, step = text.astype(np.uint64), 1
    while step < 8:
        after = np.zeros(n, np.uint64)
        after[: max(0, n - step)] = head[step:]
        after[head & np.uint64(255) == 0] = 0
        head = head << np.uint64(8 * step) | after
        step *= 2
    order = np.argsort(head)
    sorted_head = head[order]
    edge = np.concatenate([[True], sorted_head[1:] != sorted_head[:-1]])
    # Suffixes that reach an end differ in it, and ends are ordered by place.
    ended = np.flatnonzero(sorted_head & np.uint64(255) == 0)
    order[ended] = order[ended][np.lexsort((order[ended], sorted_head[ended]))]
    edge[ended] = True
    # A suffix has the place where its block begins; only suffixes of larger blocks are compared further, by the places of what follows.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    while True:
        left = np.flatnonzero(~(edge & np.append(edge[1:], True)))
        if not len(left):
            break
        own = order[left]
        key = rank[own] * n + rank[own + step]
        moved = np.argsort(key)
        key, order[left] = key[moved], own[moved]
        edge[left[1:][key[1:] != key[:-1]]] = True
        # Places of a block follow each other, and so do those of its parts.
        rank[order[left]] = left[np.maximum.accumulate(np.where(edge[left], np.arange(len(left)), 0))]
        step *= 2
    text = text.astype(np.uint16)
    before, second = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    before[1:], second[2:] = text[:-1], text[:-2]
    # A string is read in a circle: before its first symbol comes its end, and before that its last symbol.
    second[np.concatenate([[0], ends[:-1] + 1])] = text[ends - 1]
    return Transform((second << 8 | before)[order], order, text[ends - 1])


@dataclass(frozen=True)
class Merged:
    """The merged order: shard and text position of each suffix, block of equal prefixes, common prefix with the one before, in whole rounds of ``merge``."""

    shard: np.ndarray
    suffixes: np.ndarray
    block: np.ndarray
    common: np.ndarray


def _quads(part: Transform) -> np.ndarray:
    """For each text position the four symbols before it, read in a circle; 0 for what follows an end."""
    pairs = np.empty(len(part.pairs), np.uint32)
    pairs[part.suffixes] = part.pairs
    starts = np.flatnonzero(pairs & 255 == 0)
    sizes = np.diff(starts, append=len(pairs))
    before = np.arange(len(pairs)) - 2
    before[starts] += sizes
    before[starts + 1] += sizes
    far = pairs[before]
    far[far < 256] = 0
    near = np.where(far & 255 == 0, np.uint32(0), np.where(pairs < 256, np.uint32(0), pairs))
    return far << np.uint32(16) | near


def merge(parts: list[Transform], depth: int, step: int = 2) -> Merged:
    """Refines the interleave of the shards until suffixes are ordered by their first ``depth`` symbols, a multiple of ``step``.

    A round takes two or four symbols (``step``); where shards hold too many different fours for a counting sort, two.
    """
    if depth % step:
        raise ValueError(f"suffixes are compared {step} symbols at a time")
    n = sum(len(p.pairs) for p in parts)
    names = np.arange(len(parts), dtype=np.uint8)
    shard = np.repeat(names, [len(p.pairs) for p in parts])
    # Sorted symbols are the same in every round. Those that hold an end stand for suffixes of fewer symbols than a step:
    # each is a block of its own, and they keep the order of the shards and their strings.
    if step == 2:
        moves = [p.pairs for p in parts]
        ordered = np.sort(np.concatenate(moves), kind="stable")
        short = np.flatnonzero((ordered & 255 == 0) | (ordered < 256))
        owner = np.repeat(names, [len(p.last) for p in parts])
        fixed = np.concatenate([owner, owner[np.argsort(np.concatenate([p.last for p in parts]), kind="stable")]])
    else:
        quads = np.concatenate([_quads(p) for p in parts])
        kinds, numbers = np.unique(quads, return_inverse=True)
        if len(kinds) > 1 << 16:
            return merge(parts, depth)
        numbers = numbers.astype(np.uint16)
        ended = np.flatnonzero(quads & 255 == 0)
        fixed = shard[ended][np.argsort(numbers[ended], kind="stable")]
        cuts = np.cumsum([len(p.pairs) for p in parts])[:-1]
        moves = [own[p.suffixes] for own, p in zip(np.split(numbers, cuts), parts, strict=True)]
        ordered = np.sort(numbers, kind="stable")
        short = np.flatnonzero(kinds[ordered] & 255 == 0)
    apart = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    apart[short] = True
    block, edge, pairs = np.zeros(n, np.int32), apart.copy(), np.empty(n, np.uint16)
    common = np.full(n, depth, np.int16)
    count = 0
    for h in range(0, depth, step):
        for s, own in enumerate(moves):
            pairs[np.flatnonzero(shard == s)] = own
        moved = np.argsort(pairs, kind="stable")
        shard = shard[moved]
        shard[short] = fixed
        block = block[moved]
        np.not_equal(block[1:], block[:-1], out=edge[1:])
        edge |= apart
        common[edge & (common == depth)] = h
        block = np.cumsum(edge, dtype=np.int32)
        if block[-1] == count:
            break
        count = int(block[-1])
    suffixes = np.empty(n, np.int64)
    for s, part in enumerate(parts):
        suffixes[np.flatnonzero(shard == s)] = part.suffixes
    return Merged(shard, suffixes, block, common)
