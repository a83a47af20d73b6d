"""String normalisation used when clauses of logged queries are compared."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of identifiers in contract documents.
URN_PATTERN = r"^urn:[a-z0-9]+:([a-zA-Z0-9_-]+):([a-zA-Z0-9_-]+)$"
SLUG_PATTERN = r"^[a-zA-Z0-9_]+$"
SEMVER_PATTERN = r"^[0-9]+\.[0-9]+\.[0-9]+$"


_OPERATOR = re.compile(r"\s*(<=|>=|<>|!=|=|<|>)\s*")
_BLANKS = re.compile(r"\s+")
_RANGE = re.compile(r"\b(between \S+) and\b")
_MARKS = re.compile(r"[()]| or | and ")
_QUOTED = re.compile("\x01(\\d+)\x01")


def _operands(text: str, word: str) -> list[str]:
    """The text cut at ``word`` outside parentheses."""
    out, depth, start = [], 0, 0
    for mark in _MARKS.finditer(text):
        if mark.group() in "()":
            depth += 1 if mark.group() == "(" else -1
        elif mark.group() == word and depth == 0:
            out.append(text[start : mark.start()])
            start = mark.end()
    return [*out, text[start:]]


def _encloses(text: str) -> bool:
    """Whether the first and the last sign are one pair of parentheses."""
    if not (text.startswith("(") and text.endswith(")")):
        return False
    depth = 0
    for i, sign in enumerate(text):
        depth += (sign == "(") - (sign == ")")
        if depth == 0:
            return i == len(text) - 1
    return False


def _tree(text: str) -> str | tuple[str, list]:
    """A comparison, or AND or OR with its operands; an operand of the same kind joins its parent's list."""
    text = text.strip()
    while _encloses(text):
        text = text[1:-1].strip()
    for word in (" or ", " and "):
        operands = _operands(text, word)
        if len(operands) > 1:
            below = [_tree(o) for o in operands]
            return word, [x for t in below for x in (t[1] if isinstance(t, tuple) and t[0] == word else [t])]
    return text


def _written(tree: str | tuple[str, list], quoted: list[str], inside: bool = False) -> str:
    if isinstance(tree, str):
        return _QUOTED.sub(lambda m: f"'{quoted[int(m.group(1))]}'", tree.replace("\x02", "and"))
    text = tree[0].join(sorted({_written(t, quoted, tree[0] == " and ") for t in tree[1]}))
    return f"({text})" if inside else text


def normalise_predicate_text(text: str) -> str:
    """Canonical text of one predicate.

    Blanks, enclosing parentheses of any depth, the order of AND and OR operands at any
    depth and the case of identifiers and keywords do not matter.  Quoted values are
    set aside first and come back as they were.
    """
    pieces = text.split("'")
    bare = "".join(p.lower() if i % 2 == 0 else f"\x01{i}\x01" for i, p in enumerate(pieces))
    bare = _BLANKS.sub(" ", _OPERATOR.sub(r" \1 ", bare))
    bare = re.sub(r"\( ", "(", re.sub(r" \)", ")", bare))
    bare = re.sub(r"(?<=\))(and|or)\b", r" \1", re.sub(r"\b(and|or)(?=\()", r"\1 ", bare))
    return _written(_tree(_RANGE.sub("\\1 \x02", bare)), pieces)


def _each_once(texts: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def canonical(text):
        if text is not None and text not in known:
            known[text] = normalise_predicate_text(text)
        return None if text is None else known[text]

    return texts.map(lambda row: None if row is None else [canonical(x) for x in row])


def normalise_predicates(conjuncts: Column) -> Column:
    """Canonical texts of an array of conjuncts; each distinct text of a batch is worked out once."""

    @F.pandas_udf("array<string>")
    def canonical(texts: pd.Series) -> pd.Series:
        return _each_once(texts)

    return canonical(conjuncts)


def canonical_choices(conjuncts: Column) -> Column:
    """Canonical conjuncts of a log that brings each conjunct as an array of its OR operands."""
    return canonical_conjuncts(F.transform(conjuncts, lambda choices: F.array_join(F.transform(choices, lambda c: F.concat(F.lit("("), c, F.lit(")"))), " or ")))


def normalise_dimension(column: Column) -> Column:
    """Lower-cased grouping expression without blanks and quotes."""
    return F.translate(F.lower(column), " '\"", "")


def canonical_conjuncts(conjuncts: Column) -> Column:
    """Order-free form of an AND list: normalised, de-duplicated and sorted."""
    return F.array_sort(F.array_distinct(normalise_predicates(conjuncts)))


def text_hash(column: Column) -> Column:
    """sha256 of the trimmed text, as used for redaction and artifact keys."""
    return F.sha2(F.trim(column), 256)
