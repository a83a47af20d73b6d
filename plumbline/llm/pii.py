"""Personal data: exact patterns, and a conditional random field for other ways of writing it.

The base patterns (email, ip, card, phone) are exact. The field labels tokens (runs
between blanks) by the shapes of a token and its neighbours. It is trained
once, on the driver, from a small labelled table made of the values and
sentences below, and its weights are sent to the workers. Decoding runs over
all tokens: each text is cut into rows of ROW tokens with MARGIN tokens of context on
either side, and Viterbi goes through many rows at once. A span that it finds is
added if it passes its kind's check (digits, Luhn, number ranges) and touches
no base span; base spans are never changed.

Positions are code points, end exclusive. Null is the empty text. Texts are
judged one by one, so repeated rows give repeated results; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import slices, strings
from plumbline.llm.crf import SIDES, Crf

KINDS = ("email", "ip", "card", "phone")
ROW, MARGIN, CACHE = 128, 16, 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BLANKS = re.compile(r"([\x20\x09-\x0D]+)")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def is_ip(text: str) -> bool:
    parts = re.findall("[0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def _emails(text: str):
    """Matches of the email pattern, found from the at-signs: its first part ends there and reaches as far left as it can."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' valid matches, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, valid in (("ip", _IP, is_ip), ("card", _CARD, is_card), ("phone", _PHONE, is_phone)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return out


#: Cue words that are a type of their own.
CUES = frozenset("at (at) [at] dot (dot) [dot] tel tel. tel: phone phone: call mobile mobile: fax fax: card card: visa ip ip: host email email: mail mail: contact".split())
EDGE = "<edge>"
_PUNCTUATION = ".,;:!?\"'"


def token_type(token: str) -> str:
    """The cue word itself, or the shape: letters as x, digits as their number, signs inside as they are; empty beside a text's outer blanks."""
    if not token:
        return EDGE
    low = token.lower().rstrip(",;!?") if len(token) < 12 else ""
    if low in CUES:
        return low
    if token.isalpha():
        return "x"
    token = token.strip(_PUNCTUATION) or token
    if len(token) > 80:
        return "long" + ("d" if _DIGIT.search(token) else "") + ("@" if "@" in token else "")
    out, i, n = [], 0, len(token)
    while i < n:
        c, j = token[i], i + 1
        if c.isdigit():
            while j < n and token[j].isdigit():
                j += 1
            out.append(f"d{j - i}" if j - i <= 4 else "d5-12" if j - i <= 12 else "d13-19" if j - i <= 19 else "d20")
        elif c.isalpha():
            while j < n and token[j].isalpha():
                j += 1
            out.append("x")
        else:
            out.append(c)
        i = j
    return "".join(out)


def type_features(kind: str) -> list[str]:
    """What weights are learnt for: the whole type, the type without lengths, and what signs it holds."""
    if kind in CUES or kind in (EDGE, "x"):
        return ["type=" + kind]
    bare = re.sub(r"d[0-9-]+", "d", kind)
    out = ["type=" + kind, "bare=" + bare, "trimmed=" + kind.strip(_PUNCTUATION + "()[]"), "first=" + kind[0], "other"]
    out += ["has=" + c for c in "@+()[]-./" if c in kind]
    if "d" in kind and "x" not in kind:
        out.append("numeric")
    if "x" in kind:
        out.append("letters")
    return out


def _labelled_table() -> list[tuple[str, str, str, str]]:
    """(kind, before, value, after): every value of a kind in five of the sentences, and numbers that are not personal data."""
    values = {
        "email": ("ana.lee@mail.example.org", "bo_12@example.com", "k.42@mail8.example.com", "ana (at) example (dot) org", "bo [at] mail [dot] com", "kim at example dot com", "li[at]example[dot]net", "ana@example (dot) org"),
        "ip": ("10.20.30.40", "192.168.1.254", "8.8.4.4", "10[.]20[.]30[.]40", "172.16.0[.]9", "192 . 168 . 1 . 7", "10(.)0(.)0(.)1"),
        "card": ("4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "4111.1111.1111.1111", "5500/0000/0000/0004", "4111_1111_1111_1111", "340000000000009", "3400 000000 00009"),
        "phone": ("+1 (212) 555-0147", "+44 20 7946 0958", "+4930901820", "(212) 555-0147", "212-555-0147", "212.555.0147", "0049 30 901820", "020 7946 0958", "(030) 901 82 01"),
        "": ("2024-05-17", "17.05.2024", "12:30", "3.14", "1,250", "v2.0.1", "42", "1999", "50%", "$300", "(1984)", "[12]", "#7", "10-12", "978-3-16-148410-0", "12345", "A4", "x86", "100.000", "No.5", "***", "|", "it's", "well-known", "the end.", "of the", "12 34", "123456789012345678901234"),
    }
    sentences = (
        ("write to", "if needed"), ("", "is what she gave us"), ("the old one was", ""), ("please note", ", and nothing more"), ("reach me at", "today or"), ("contact:", "."),
        ("phone:", "mornings only"), ("call", "after noon"), ("card:", "expires soon"), ("ip:", "was seen"), ("email:", "thanks"), ("la de que en", "por el del"), ("der die und", "ist von"), ("le des une", "dans la"),
    )
    rows = []
    for kind, all_of in values.items():
        for i, value in enumerate(all_of):
            rows += [(kind, before, value, after) for before, after in (sentences[(i + 3 * j) % len(sentences)] for j in range(5))]
    return rows + [("", a, b, a) for a in ("meet at noon", "a dot on the map", "at the house", "call it a day", "the card game", "mail came late") for b in ("and then", "at last", "so")]


LABELS = 1 + 2 * len(KINDS)


def train() -> Crf:
    """The field from the labelled table; label 0 is outside, then for each kind its first and its further tokens."""
    rows = []
    for kind, before, value, after in _labelled_table():
        parts = [p.split() for p in (before, value, after)]
        first = 1 + 2 * KINDS.index(kind) if kind else 0
        inner = [first] + [first + 1] * (len(parts[1]) - 1) if kind else [0] * len(parts[1])
        rows.append(([token_type(t) for p in parts for t in p], [0] * len(parts[0]) + inner + [0] * len(parts[2])))
    return Crf.fit(rows, type_features, LABELS, EDGE)


class Labeller:
    """Labels of all tokens of many texts; scores of types met before are kept."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.types: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.scores = np.zeros((1024, SIDES, crf.labels), np.float32)
        self.edge = self._type(EDGE)

    def _type(self, kind: str) -> int:
        place = self.types.get(kind)
        if place is None:
            place = self.types[kind] = len(self.types)
            if place == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[place] = self.crf.type_scores(kind)
        return place

    def numbers(self, tokens: list[str]) -> list[int]:
        words = self.words
        for w in tokens:
            if w not in words:
                words[w] = self._type(token_type(w))
        return [words[w] for w in tokens]

    def tidy(self) -> None:
        if len(self.words) > CACHE or len(self.types) > CACHE:
            self.words.clear()
            self.types.clear()
            self.edge = self._type(EDGE)

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """A label for each token of each text."""
        numbers = [np.array(self.numbers(t), np.int32) for t in texts]
        rows = [-(-len(x) // ROW) for x in numbers]
        flat = np.full(sum(rows) * ROW + 2 * (MARGIN + 1) * len(texts) + 2, self.edge, np.int32)
        starts, at = [], 0
        for x, r in zip(numbers, rows, strict=True):
            at += MARGIN + 1
            flat[at : at + len(x)] = x
            starts.append(at + np.arange(r) * ROW)
            at += r * ROW + MARGIN + 1
        first = np.concatenate(starts) if starts else np.zeros(0, int)
        out = np.zeros(len(flat), np.int8)
        for lo in range(0, len(first), 4096):
            some = first[lo : lo + 4096, None]
            window = some + np.arange(-MARGIN, ROW + MARGIN)
            scores = self.scores[flat[window], 0] + self.scores[flat[window - 1], 1] + self.scores[flat[window + 1], 2]
            out[some + np.arange(ROW)] = self.crf.decode(scores)[:, MARGIN : MARGIN + ROW]
        return [out[s[0] : s[0] + len(x)] if len(x) else np.zeros(0, np.int8) for s, x in zip(starts, numbers, strict=True)]


def _valid(kind: str, text: str) -> bool:
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text, re.I) and re.search(r"\.|\bdot\b", text, re.I))
    return {"ip": is_ip, "card": is_card, "phone": is_phone}[kind](text)


def added_spans(text: str, starts: np.ndarray, tokens: list[str], labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The field's spans on one line, without signs around them, that are valid and touch no base span."""
    out, i, tagged = [], 0, np.flatnonzero(labels)
    while i < len(tagged):
        lo = hi = int(tagged[i])
        kind = (int(labels[lo]) - 1) // 2
        while i + 1 < len(tagged) and tagged[i + 1] == hi + 1 and labels[hi + 1] == 2 * kind + 2 and "\n" not in text[starts[hi] : starts[hi + 1]]:
            hi, i = hi + 1, i + 1
        i += 1
        start, end = int(starts[lo]), int(starts[hi]) + len(tokens[hi])
        while end > start and text[end - 1] in _PUNCTUATION + "-":
            end -= 1
        while start < end and text[start] in _PUNCTUATION:
            start += 1
        name = KINDS[kind]
        if _valid(name, text[start:end]) and all(end <= a or b <= start for _, a, b in base):
            out.append((name, start, end))
    return out


def all_spans(text: str, base: list, added: list) -> list[tuple[str, int, int]]:
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans (kind, start, end) of every row of ``docs`` (doc_id, text); base: those of the exact patterns."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        labeller = Labeller(shared.value)
        for batch in slices(batches, limit=1 << 20):
            texts = strings(batch)
            cut = [_BLANKS.split(t) for t in texts]
            labels = labeller.labels([c[::2] for c in cut])
            base, spans = [], []
            for text, parts, own in zip(texts, cut, labels, strict=True):
                exact = base_spans(text)
                added = []
                if own.any():
                    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1][::2]
                    added = added_spans(text, starts, parts[::2], own, exact)
                base.append(_rows(exact))
                spans.append(_rows(all_spans(text, exact, added)))
            labeller.tidy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _SPANS), pa.array(spans, _SPANS)], names=["doc_id", "base", "spans"])

    struct = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {struct}, spans {struct}")


def _rows(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]
