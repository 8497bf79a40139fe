"""Pages of repeated keywords, link lists, tags, products or menu entries.

For every token the gap to its previous occurrence is taken; content words
that come back within LAG tokens, often enough in the text, are marked, as
are links where there are many of them. Gaps of any length make the text's
positional autocorrelation: where one lag (or its neighbours) holds for many
positions outside sentences, the repetition is unnaturally regular, and all
positions it covers are marked, however long the repeated block. Long runs of short list
items, hardly any of them said twice and without function words, are marked
as lists of nouns. Inside sentences with function words
only recurrence within the sentence counts, so that refrains stay text. Marks
are smoothed over a window of neighbours into regions; a page is stuffed if
regions hold more than SHARE of its characters (stuffed pages measure 0.4 and more, text 0.1 and less).

Every document is judged by itself, in one pass without a shuffle. Defined
results: null, empty or token-less text is never stuffed and has share 0;
copies are judged alike; texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest gap that counts as recurrence, neighbours on either side, and the share of marks that makes a region.
LAG, HALF, DENSE = 30, 10, 0.4
#: Occurrences a recurring word needs, links a list needs, tokens a page needs, share of characters.
LEAST_COUNT, LEAST_LINKS, LEAST_TOKENS, SHARE = 3, 6, 10, 0.3
#: A line with at least this share of function words is a sentence.
SENTENCE = 0.2
#: Positions, and their share of those outside sentences, for which one lag (give or take one) must hold to be regular.
REGULAR, REGULAR_SHARE = 12, 0.2
#: Items a list of nouns needs in a row, words an item may have, share of different items.
LEAST_ITEMS, ITEM_WORDS, DIFFERENT = 15, 4, 0.8

#: Frequent function words of the documents' languages.
FUNCTION_WORDS = frozenset("""
the a an and of to in on at for with by from as is are was were be it its this that these my his her their our your not no or but
if than then so when while though until because without into over through under around before after once very which who what how
there all some any each other just only also can will would could should has have had do does did been being more most first
o as os um uma de do da dos das em na nos nas por para com sem e ou que se não como mas ao à aos até ele ela seu sua este esta esse
essa isso pelo pela mais já foi ser são quando embora porque enquanto antes depois entre sobre todo toda todos
el la los las un unos del en con y lo pero al su sus ese ya fue son cuando aunque mientras después hasta
le les une des du au aux par pour avec sans et qui ne pas comme il elle sa ses ce cette ces plus est été quand bien pendant avant
après sur dans d l s n c j qu
""".split())  # fmt: skip

#: Lines of records: log entries, track lists, discographies, credits. They repeat by nature and are never marked.
_LOG = re.compile(r"^\W*\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_TRACK = re.compile(r"\d{1,2}:\d\d\)?\s*$")
_DISCOGRAPHY = re.compile(r"^\s*\d{4}\s+\S.*\s\S+$")
_CREDIT = re.compile(r"^[^:]{3,50}:\s\S[^:.,;|]{2,30}$")
_PRICE = re.compile(r"\d[.,]\d\d ?(?:EUR|USD|GBP|BRL|€|\$|£)")
_TOKEN = re.compile(r"https?://\S+|#\w+|\w[\w'’-]*(?:\.\w[\w-]*)+(?=[\s·,;)|]|$)|\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n")
_NUMBERED = re.compile(r"^\W*(?:\d{1,3}|[A-H]\d{0,2})\s*[.):\-–]?\s")
_ITEM_END = re.compile(r"[,;|·•>/★✓*]+|\s[–—-]\s|\s\.\s")


def _is_record(line: str) -> bool:
    if _LOG.match(line) or _TRACK.search(line):
        return True
    if _PRICE.search(line) or "//" in line:
        return False
    return bool(_DISCOGRAPHY.match(line) or _CREDIT.match(line))


def _is_link(token: str) -> bool:
    return token.startswith(("http", "#")) or "." in token and not token[0].isdigit()


def _list_items(line: str) -> list[str] | None:
    """Items of a line that may belong to a list of nouns: short, without function words, not names or numbers; None for other lines."""
    items = [x.strip() for x in _ITEM_END.split(line) if x.strip()]
    for item in items:
        of = _TOKEN.findall(item)
        if not of or len(of) > ITEM_WORDS or item[-1] in ".!?:" or any(t.lower() in FUNCTION_WORDS for t in of) or any(c.isdigit() for c in item):
            return None
        if len(of) > 1 and all(t[0].isupper() for t in of):
            return None
    return items


def _noun_lists(lines: list[str]) -> set[int]:
    """The lines that make long runs of different short items."""
    out: set[int] = set()
    run: list[int] = []
    held: list[str] = []

    def close() -> None:
        if len(held) >= LEAST_ITEMS and len({x.lower() for x in held}) >= DIFFERENT * len(held):
            out.update(run)
        run.clear()
        held.clear()

    for i, line in enumerate(lines):
        if not line.strip():
            continue
        items = None if _is_record(line.strip()) or _NUMBERED.match(line) else _list_items(line)
        if items is None:
            close()
        else:
            run.append(i)
            held += items
    close()
    return out


def measure(text: str | None) -> tuple[float, float, int]:
    """Share of characters in regions, strongest positional autocorrelation, links."""
    tokens: list[str] = []
    record, sentence, in_link_line, listed = [], [], [], []
    twice: set[str] = set()
    lines = (text or "").split("\n")
    of_nouns = _noun_lists(lines)
    for number, line in enumerate(lines):
        is_record = _is_record(line.strip())
        for part in _SENTENCE_END.split(line):
            found = [m.lower() for m in _TOKEN.findall(part)]
            if not found:
                continue
            functional = len(found) > 5 and sum(t in FUNCTION_WORDS for t in found) >= SENTENCE * len(found)
            twice |= {t for t, k in Counter(found).items() if k > 1}
            linked = len(found) <= 12 and any(t.startswith("http") for t in found)
            tokens += found
            record += [is_record] * len(found)
            sentence += [functional] * len(found)
            in_link_line += [linked] * len(found)
            listed += [number in of_nouns] * len(found)
    n = len(tokens)
    if n < LEAST_TOKENS:
        return 0.0, 0.0, 0
    links = [_is_link(t) for t in tokens]
    many = sum(links) >= LEAST_LINKS
    counts, last, marks = Counter(tokens), {}, [0] * n
    lags: Counter[int] = Counter()
    free = 0
    back: list[tuple[int, int]] = []
    for i, t in enumerate(tokens):
        if record[i]:
            continue
        if listed[i] or many and (links[i] or in_link_line[i]):
            marks[i] = 1
        if t in FUNCTION_WORDS:
            continue
        free += not sentence[i]
        j = last.get(t)
        last[t] = i
        if j is None:
            continue
        if not sentence[i] and not sentence[j]:
            lags[i - j] += 1
            back.append((i, j))
        if i - j <= LAG and counts[t] >= LEAST_COUNT and (t in twice or not sentence[i] or not sentence[j]):
            marks[i] = marks[j] = 1
    near = {lag: k + lags[lag - 1] + lags[lag + 1] for lag, k in list(lags.items())}
    regular = {lag for lag, k in near.items() if k >= max(REGULAR, REGULAR_SHARE * free)}
    for i, j in back:
        if i - j in regular and (counts[tokens[i]] >= LEAST_COUNT or i - j > LAG):
            marks[i] = marks[j] = 1
    sums, inside, whole = [0, *accumulate(marks)], 0, 0
    for i, t in enumerate(tokens):
        low, high = max(0, i - HALF), min(n, i + HALF + 1)
        whole += len(t)
        if not record[i] and sums[high] - sums[low] >= DENSE * (high - low):
            inside += len(t)
    return inside / whole, max(near.values(), default=0) / n, sum(links)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [measure(t) for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"],
            "listed_share": [f[0] for f in found],
            "autocorrelation": [f[1] for f in found],
            "links": [f[2] for f in found],
        })


def judge_pages(documents: DataFrame) -> DataFrame:
    """doc_id, listed_share, autocorrelation, links, stuffed: one row per document."""
    kinds = "doc_id bigint, listed_share double, autocorrelation double, links bigint"
    return documents.select("doc_id", "text").mapInPandas(_judge, kinds).withColumn("stuffed", F.col("listed_share") > SHARE)
