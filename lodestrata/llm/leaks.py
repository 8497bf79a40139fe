"""Held-out items inside a training corpus, found by spaced seeds.

Words are folded (case, accents, punctuation, markup) and hashed. Items and
documents are cut into windows under fixed masks that look at some positions
and ignore the others, so that a changed word doesn't hide a passage; each
window under each mask is one seed hash. Documents are read once: a bitmap of
the items' seeds, of BITS bits whatever their number, keeps from their windows those that may
meet an item, which are joined with the items' seeds. Around each meeting the diagonal of item and document
is extended over single substitutions and kept where it spans enough words and
its matches weigh enough: phrases that many items share weigh little.

Seeds that many items and documents have are dealt over several tasks. Items
never go to the driver or to a task as a whole; a copied document costs its own scan and no more.

Defined results: null or empty text on either side yields no pair; an item
shorter than LEAST_WORDS can't leak; equal items leak each under its own id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

#: Words a passage spans at least, the least score (words known to one item weigh 1), bits of the bitmaps, meetings of one seed that one task makes.
LEAST_WORDS, LEAST_SCORE, BITS, DEALT = 14, 4.5, 1 << 27, 1_000_000
#: Cost of a substitution in weights of the word, and how far an extension may fall below its best.
SUBSTITUTION, DROP = 1.5, 3.0
#: The masks: positions of a window that are looked at.
MASKS = (
    (0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 7), (0, 1, 2, 5, 6, 8), (0, 2, 4, 5, 7, 8),
    (0, 1, 4, 5, 7, 8), (0, 3, 4, 5, 7, 9),
)

_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-z]{2,8};|\]\([^)\s]*\)")
_MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_WORD = re.compile(r"[^\W_]+")
_PARTED = re.compile(r"([^\W_]+)-[ \t]*\r?\n\s*([^\W_]+)")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> list[str]:
    """The words of a text without case, accents, punctuation and markup."""
    bare = _MARKS.sub("", unicodedata.normalize("NFKD", _MARKUP.sub(" ", text or "")))
    return _WORD.findall(bare.casefold())


def note_of(text: str | None) -> str:
    """The note of an item: what stands between its first and its last blank line."""
    parts = re.split(r"\n\s*\n", (text or "").strip())
    return "\n".join(parts[1:-1]) if len(parts) > 2 else ""


def _hash_words(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Hashes of words; `known` keeps those worked out before, as long as it is small."""
    if len(known) > 1_000_000:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def seeds_of(words: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All seeds of a text, mask by mask, and the places at which their windows begin; only windows whose looked-at words are all known."""
    hashes, places = [], []
    for k, mask in enumerate(MASKS):
        n = len(words) - mask[-1]
        if n <= 0:
            continue
        at = np.arange(n, dtype=np.int64)
        if known is not None:
            of = known[mask[0] : mask[0] + n].copy()
            for m in mask[1:]:
                of &= known[m : m + n]
            at = np.flatnonzero(of)
        h = np.full(len(at), k + 1, np.uint64)
        for m in mask:
            h = (h ^ words[at + m]) * _PRIME
            h ^= h >> np.uint64(29)
        hashes.append(h)
        places.append(at)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _bitmap(hashes: DataFrame, column: str):
    """The places of hashes among BITS bits, as one array sent to all tasks: 16 MB at most, whatever the number of hashes."""
    place = F.pmod(column, F.lit(BITS))
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    whole = np.zeros(BITS // 8 + 4096, np.uint8)
    for r in parts.toLocalIterator():
        # Buckets count from 1 but for place 0, which has bucket 0 like all that aren't above it.
        at = max(0, (r["bucket"] - 1)) * 4096
        whole[at : at + 4096] |= np.frombuffer(bytes(r["bits"]).ljust(4096, b"\0"), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    # Spark's bitmaps count from 1; 0 shares the place of 1.
    place = np.maximum(np.mod(_signed(hashes), BITS) - 1, 0)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def passage(same: list[bool], weights: list[float]) -> tuple[int, float]:
    """The longest passage on one diagonal, from first to last match, and its score.

    A match adds the word's weight, a substitution takes SUBSTITUTION times the
    weight; so phrases that many items share, filled with other names, end at
    the names.
    """
    best, score, peak, first = (0, 0.0), 0.0, 0.0, -1
    for i, (equal, weight) in enumerate(zip(same, weights)):
        if equal:
            if first < 0:
                first, score, peak = i, 0.0, 0.0
            score += weight
            if score >= peak:
                peak = score
                best = max(best, (i - first + 1, score))
        elif first >= 0:
            score -= SUBSTITUTION * weight
            if score < 0 or score < peak - DROP:
                first = -1
    return best


def _index(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, words: hashes of the words of every note long enough to leak."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = [(i, w) for i, t in zip(batch[item_id], batch[text]) if len(w := fold(note_of(t))) >= LEAST_WORDS]
            yield pd.DataFrame([(i, _signed(_hash_words(w, known)).tolist()) for i, w in rows], columns=["item_id", "words"])

    return items.select(item_id, text).where(f"{text} is not null").mapInPandas(read, "item_id bigint, words array<bigint>")


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for i, d, shifts, item, weights, words in zip(batch["item_id"], batch["doc_id"], batch["shifts"], batch["words"], batch["weights"], batch["doc_words"]):
            best = (0, 0.0)
            for shift in shifts:
                start, end = max(0, -shift), min(len(item), len(words) - shift)
                if end - start >= LEAST_WORDS - 2:
                    same = np.asarray(item[start:end]) == np.asarray(words[start + shift : end + shift])
                    best = max(best, passage(same.tolist(), list(weights[start:end])))
                    if best[0] >= LEAST_WORDS and best[1] >= LEAST_SCORE:
                        out.append((i, d))
                        break
        yield pd.DataFrame(out, columns=["item_id", "doc_id"], dtype="int64")


def find_leaks(items: DataFrame, documents: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, doc_id: every pair where the document holds a passage of the item's note."""
    index = cut_lineage(_index(items, item_id, text))
    placed = index.select("item_id", F.posexplode("words").alias("place", "word"))
    # A word weighs the more the fewer items hold it.
    held = placed.select("item_id", "word").distinct().groupBy("word").agg(F.count("*").alias("n"))
    total = index.count()
    weight = F.log1p(F.lit(float(total)) / F.col("n")) / F.log1p(F.lit(float(max(total, 1))))
    weighed = placed.join(held, "word").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", weight.alias("w")))).alias("w"))
    # Half of a hash is enough where places are compared one to one.
    short = F.transform("words", lambda w: w.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    weighed = index.join(weighed, "item_id").select("item_id", short.alias("words"), F.transform("w.w", lambda w: w.cast("float")).alias("weights"))

    @F.pandas_udf("array<struct<seed:bigint,place:int>>")
    def cut(words: pd.Series) -> pd.Series:
        return pd.Series([list(zip(_signed(h).tolist(), p.tolist())) for h, p in (seeds_of(np.asarray(w, np.int64).view(np.uint64)) for w in words)], dtype=object)

    seeds = cut_lineage(index.select("item_id", F.inline(cut("words"))))
    of_seeds, of_words = _bitmap(seeds, "seed"), _bitmap(held, "word")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}

        def whole(m: re.Match) -> str:
            """A word parted by a hyphen at a line's end is joined where the items know the whole word."""
            joined = fold(m[1] + m[2])
            return m[1] + m[2] if len(joined) == 1 and _held(of_words.value, _hash_words(joined, known))[0] else m[0]

        for batch in batches:
            rows = []
            for d, t in zip(batch[doc_id], batch[text]):
                words = _hash_words(fold(_PARTED.sub(whole, t) if "-" in t else t), known)
                known_words = _held(of_words.value, words)
                if np.count_nonzero(known_words) < LEAST_WORDS // 2:
                    continue
                h, at = seeds_of(words, known_words)
                hit = _held(of_seeds.value, h)
                if hit.any():
                    rows.append((d, (words & np.uint64(0x7FFFFFFF)).astype(np.int32).tolist(), _signed(h[hit]).tolist(), at[hit].tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_words", "seeds", "at"])

    kind = "doc_id bigint, doc_words array<int>, seeds array<bigint>, at array<int>"
    found = documents.select(doc_id, text).where(f"{text} <> ''").mapInPandas(scan, kind)
    # Documents under one id are told apart.
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    hits = found.select("row", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), "at")))
    met = hits.groupBy("seed").agg(F.count("*").alias("n_hits")).join(seeds.groupBy("seed").agg(F.count("*").alias("n_items")), "seed")
    # Only seeds with more meetings than one task is to make are dealt out; few, so that their join is a small one.
    parts = cut_lineage(met.select("seed", F.ceil(F.col("n_hits") * F.col("n_items") / F.lit(DEALT)).cast("int").alias("parts")).where("parts > 1"))
    left = hits.join(parts, "seed", "left").withColumn("part", F.pmod(F.hash("row", "at"), F.coalesce("parts", F.lit(1))))
    right = seeds.join(parts, "seed", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    diagonals = left.drop("parts").join(right.drop("parts"), ["seed", "part"]).select("item_id", "row", (F.col("at") - F.col("place")).alias("shift"))
    asked = diagonals.groupBy("item_id", "row").agg(F.collect_set("shift").alias("shifts"))
    asked = asked.join(found.select("row", "doc_id", "doc_words"), "row").join(weighed, "item_id")
    return spread(asked, "row", "item_id").select("item_id", "doc_id", "shifts", "words", "weights", "doc_words").mapInPandas(_verify, "item_id bigint, doc_id bigint").distinct()
