"""URL filters: pattern rules found through their rarest literal token.

A list rule (host and path) fits its host and all subdomains if the url's path
starts with the rule's; of several the longest decides. Urls that no list rule
fits are judged by pattern rules: a regular expression with literal tokens that
every match contains as whole tokens. All rules are regular expressions over
host + path. Each rule is filed under the one of its tokens that is rarest in
the urls (counted over all of them); a url fetches candidates by its own tokens
and only those run their expression. Rules without a whole literal token are
tried on every url.

The rules are a stated list of at most MAX_RULES; more raise an error. A null
url, or one without ``://``, has empty host and path, so no rule fits it and
it is allowed. Rows are judged one by one: repeated rows give repeated results, other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER

#: Bound of what is sent to every worker.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class ListRule:
    """``host`` and ``path`` as written in a block list, such as example.com and /en/."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}(?=/|\Z){re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that end inside the rule; the last one of an open path may go on in the url."""
        whole = self.name if not re.search(r"[A-Za-z0-9]\Z", self.path) else self.name[: len(re.sub(r"[A-Za-z0-9]+\Z", "", self.name))]
        return tokens(whole)


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over host + path and literal tokens that each match holds as whole tokens."""

    action: str
    pattern: str
    literals: tuple[str, ...] = ()

    @property
    def tokens(self) -> list[str]:
        return [t.lower() for t in self.literals]


LIST_RULES = (
    ListRule("allow", "com", "/"),
    ListRule("block", "example.com", "/en/"),
    ListRule("allow", "www.example.com", "/en/"),
    ListRule("block", "net", "/es/"),
    ListRule("block", "net", "/fr/"),
)

#: For urls that no list rule fits: login and shop pages, trackers, file downloads.
PATTERN_RULES = (
    PatternRule("block", r"(?:^|[./_-])casino(?:[./_-]|$)", ("casino",)),
    PatternRule("block", r"/login(?:[/._-]|$)", ("login",)),
    PatternRule("block", r"/signin(?:[/._-]|$)", ("signin",)),
    PatternRule("block", r"(?:^|\.)ads\.", ("ads",)),
    PatternRule("block", r"(?:^|\.)track\.", ("track",)),
    PatternRule("block", r"/cart/checkout(?:/|$)", ("cart", "checkout")),
    PatternRule("block", r"\.exe$", ("exe",)),
    PatternRule("block", r"\.zip$", ("zip",)),
)


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """How often each of the rules' tokens stands in the urls (host, path); at most one row for each token."""
    words = F.explode(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+")).alias("token")
    found = urls.select(words).filter(F.col("token").isin(list(wanted))).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def rule_index(rules: Sequence, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """token -> places of the rules filed under it; places of rules that have none."""
    by_token, always = {}, []
    for place, rule in enumerate(rules):
        if own := rule.tokens:
            by_token.setdefault(min(own, key=lambda t: (counts.get(t, 0), t)), []).append(place)
        else:
            always.append(place)
    return by_token, always


def _judge(rules: tuple, index: dict, always: list[int]):
    def run(batches):
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            names, verdicts = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                url, best, own = host + path, None, None
                for place in {p for t in tokens(url) for p in index.get(t, ())}.union(always):
                    rule = rules[place]
                    if isinstance(rule, ListRule):
                        if (best is None or (len(rule.name), rule.name) > (len(best.name), best.name)) and compiled[place].search(url):
                            best = rule
                    elif (own is None or rule.action == "block") and compiled[place].search(url):
                        own = rule.action
                names.append(best.name if best else None)
                verdicts.append(best.action if best else own or "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def url_verdicts(pages: DataFrame, rules: Sequence[ListRule | PatternRule] = LIST_RULES + PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most are sent to every worker")
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    wanted = sorted({t for r in rules for t in r.tokens})
    index, always = rule_index(rules, token_counts(parts, wanted))
    return parts.mapInArrow(_judge(tuple(rules), index, always), "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), r AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
    END AS rule
    FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '(^|[./_-])casino([./_-]|$)|/(login|signin)([/._-]|$)|(^|\.)(ads|track)\.|/cart/checkout(/|$)|\.(exe|zip)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
