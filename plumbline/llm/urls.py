"""Judging urls: domain rules first, then a weighted vocabulary counted with an Aho-Corasick automaton.

A term counts where no ASCII letter or digit touches it. Each distinct term adds its weight once; a url is blocked
when the sum reaches 1. A strict term weighs 1, so one is enough; a soft one weighs less, so it takes several.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; a null url holds no
term. Only A-Z are lower-cased. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import LOWER, UPPER, pick, type_of

STRICT = ("casino", "escort", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "dating", "discount", "free", "loan", "pills", "replica", "sexy", "winner")
VOCABULARY = {**dict.fromkeys(STRICT, 1.0), **dict.fromkeys(SOFT, 0.5)}
#: ``(verdict, host, path)``
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_FOLD = str.maketrans(UPPER, LOWER)
_WORD = frozenset("0123456789" + LOWER)


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def hits(url: str | None, vocabulary: Mapping[str, float] = VOCABULARY) -> dict[str, int]:
    """How often each term stands in the url."""
    text = (url or "").translate(_FOLD)
    counts: dict[str, int] = {}
    if not vocabulary:
        return counts
    for last, term in _automaton(tuple(vocabulary)).iter(text):
        before, after = last - len(term), last + 1
        if (before < 0 or text[before] not in _WORD) and (after == len(text) or text[after] not in _WORD):
            counts[term] = counts.get(term, 0) + 1
    return counts


def split_url(url: str | None) -> tuple[str, str]:
    """``(host, path)``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    return (rest.translate(_FOLD), "") if slash < 0 else (rest[:slash].translate(_FOLD), rest[slash:])


def rule_for(host: str, path: str, by_host: Mapping[str, list]) -> tuple[str, str] | None:
    """``(rule, verdict)`` of the longest rule that fits: each parent domain of the host is looked up."""
    best = None
    name = host
    while name:
        for verdict, start in by_host.get(name, ()):
            if path.startswith(start) and (best is None or len(name + start) > len(best[0])):
                best = (name + start, verdict)
        name = name.partition(".")[2]
    return best


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Mapping[str, float] = VOCABULARY,
           key: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, strict_hits, soft_hits, weight)``, without a shuffle.

    The hits count distinct terms. Rules and vocabulary are parameters of the job and travel with it.
    """
    pages = pick(pages, key, url)
    vocabulary = dict(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host: dict[str, list] = {}
        for verdict, host, path in rules:
            by_host.setdefault(host, []).append((verdict, path))
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                host, path = split_url(value)
                found = [vocabulary[t] for t in hits(value, vocabulary)]
                rule, verdict = rule_for(host, path, by_host) or (None, "block" if sum(found) >= 1 else "allow")
                rows.append((host, path, rule, verdict, sum(x >= 1 for x in found), sum(x < 1 for x in found), float(sum(found))))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]],
                names=[key, "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"])

    return pages.mapInArrow(run, f"{key} {type_of(pages, key)}, host string, path string, rule string, verdict string, "
                                 "strict_hits int, soft_hits int, weight double")


def kept(pages: DataFrame, **options) -> DataFrame:
    """The ids of the pages that are not blocked."""
    return judged(pages, **options).filter(F.col("verdict") == "allow").drop("host", "path")
