"""Texts read in a wrong encoding: finding them and restoring what they said.

Every text is cut into tokens; the distinct tokens (not the rows) are scanned
by an automaton of garbled sequences, which yields for each pair of encodings
the token with only the matched spans replaced. A reading is accepted when it
is structurally clean and either its sequences are several characters long or
the corpus itself writes that token far more often. Odd signs within a word
lend weight to a reading and prove nothing by themselves. Tokens that are damaged
beyond every pair (replacement characters, lost bytes) are reported without a
restoration.

Defined results: a null or empty text yields no row; a text without
characters beyond ASCII is never garbled; repeated rows are reported each
under its own key; an empty table yields an empty result. Texts of any length
are read whole. Further columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, spread
from . import garble_tables as tables

#: Where a token ends: ASCII separators and wide spaces. No-break spaces stay, being the second half of many sequences.
SPLIT = r"[ /\\._\-()\[\],:+&#\"!?' -  　]+"
#: A reading with one-character sequences must be so many times as frequent as what is written, plus LEX_LEAST.
LEX_RATIO, LEX_LEAST = 5, 2
#: Passes over a token: text may have been garbled more than once. Rows of one token that one task joins.
PASSES, SALTED = 3, 50_000

_AFTER = set("½⅓¼¾²³¹ºª°™®©″′")
_INSIDE_FREE = set("’·")


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    name = unicodedata.name(unicodedata.normalize("NFKC", c)[:1], "?").split(" ")[0].split("-")[0]
    if name in ("HIRAGANA", "KATAKANA", "IDEOGRAPHIC"):
        return "CJK"
    return name


def damage(token: str) -> tuple[int, bool]:
    """How much of the token can't be plain writing, and whether scripts are mixed in it."""
    score, scripts, last = 0, set(), len(token) - 1
    for i, c in enumerate(token):
        before, after = token[i - 1] if i else "", token[i + 1] if i < last else ""
        code, kind = ord(c), unicodedata.category(c)
        if code < 128:
            if c.isalpha():
                scripts.add("LATIN")
                if c.isupper() and before.islower() and ord(before) > 127:
                    score += 1
            continue
        if c == "�" or 0x7F <= code < 0xA0:
            score += 3
        elif 0xFF61 <= code <= 0xFF9F:
            score += 2
        elif kind[0] == "M" or kind in ("Cf", "Zs") or 0xFF01 <= code <= 0xFF60:
            scripts.add("LATIN") if 0xFF21 <= code <= 0xFF5A and c.isalpha() else None
        elif kind[0] == "L" and c not in "ºªⁿ":
            scripts.add(_script(c))
            if kind == "Lm" and c in "ˆˇ" or c == "ƒ":
                score += 2
            elif kind == "Lu" and before.islower():
                score += 1
        elif c in _AFTER:
            score += after.isalpha()
        elif c in "£€¥":
            score += not after.isdigit()
        elif c in "¿¡«“‘":
            score += before.isalnum()
        elif c in "»”…":
            score += after.isalnum()
        elif c in "–—":
            score += before.isalnum() or after.isalnum()
        elif c not in _INSIDE_FREE:
            score += 2
    return score, len(scripts - {"?"}) > 1


def _readings(token: str) -> dict[str, tuple[tuple[str, str], int, int]]:
    """restored token -> (pair, matches, characters matched)"""
    found = defaultdict(list)
    for end, (n, origins) in tables.automaton().iter(token):
        for pair, c in origins.items():
            found[pair].append((end - n + 1, end + 1, c))
    out: dict[str, tuple[tuple[str, str], int, int]] = {}
    # Readings with a lost byte come last: what a whole pair says as well is its own.
    for pair, hits in sorted(found.items(), key=lambda f: "-" in f[0][0]):
        lost = "-" in pair[0]
        hits = hits + found.get(("utf_8", pair[1]), []) if lost else hits
        hits.sort(key=lambda h: (h[0], -h[1]))
        at, parts, n, width = 0, [], 0, 0
        for start, end, c in hits:
            if start >= at:
                parts += (token[at:start], c)
                at, n, width = end, n + 1, width + end - start
        restored = "".join([*parts, token[at:]])
        if restored not in out or width > out[restored][2] and not lost:
            out[restored] = (pair, n, width)
    for restored, written, read, width, plausible in tables.east_readings(token):
        if restored not in out or width > out[restored][2]:
            # Counted as sequences of one character where it isn't plausible: then the corpus must know the restored token.
            out[restored] = ((written, read), width // (3 if written == "utf_8" else 2) if plausible else width, width)
    for read in tables.READ_WIDE:
        # A two-byte reader swallows the character that follows; only the whole token can be turned back.
        try:
            restored = token.encode(read).decode("utf_8")
        except UnicodeError:
            continue
        if restored != token:
            out.setdefault(restored, (("utf_8", read), 1, 2))
    return out


def readings(token: str) -> list[tuple[str, str, bool]]:
    """All clean readings of a token as (restored, pair, surely): surely where sequences of several characters agree."""
    seen: dict[str, tuple[str, str, bool]] = {}
    level = {token: ("", 1)}
    for depth in range(PASSES):
        below: dict[str, tuple[str, int]] = {}
        for text, (path, _) in level.items():
            if text.isascii():
                continue
            for restored, (pair, n, width) in _readings(text).items():
                if restored == token or restored in seen or depth and pair[0] != "utf_8":
                    continue
                name = f"{path} {pair[0].split('-')[0]}>{pair[1]}".strip()
                score, mixed = damage(restored)
                wide = width >= 2 * n and (pair[0] == "utf_8" or n > 1)
                if not score and not mixed:
                    seen[restored] = (restored, name, wide or len(name.split()) > 1)
                elif pair[0] == "utf_8" and width >= 2 * n:
                    below[restored] = (name, score)
        level = below
        if not level:
            break
    return list(seen.values())


_READING = "token string, plain string, damage int, proven boolean, restored string, restored_plain string, pair string, surely boolean"


def _read_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for token in batch["token"]:
            own = [(token, token.lower(), damage(token)[0], bool(tables.proofs().search(token)))]
            rows += [(*own[0], r, r.lower(), pair, surely) for r, pair, surely in readings(token)] or [(*own[0], None, None, None, False)]
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _READING.split(", ")])


def tokens_of(texts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per key and distinct token with characters beyond ASCII."""
    has = F.col(text).rlike(r"[^\x00-\x7f]")
    cut = F.filter(F.array_distinct(F.split(F.col(text), SPLIT)), lambda t: t.rlike(r"[^\x00-\x7f]"))
    return texts.where(has).select(*keys, F.explode(cut).alias("token"))


def garbled_tokens(counts: DataFrame) -> DataFrame:
    """token, restored (null where beyond repair), pair: of the distinct tokens (token, n), those that came out wrong."""
    lexicon = counts.groupBy(F.lower("token").alias("plain")).agg(F.sum("n").alias("n"))
    read = spread(counts.select("token"), "token").mapInPandas(_read_tokens, _READING)
    wanted = lexicon.withColumnRenamed("plain", "restored_plain").withColumnRenamed("n", "n_restored")
    judged = read.join(wanted, "restored_plain", "left").join(lexicon.withColumnRenamed("n", "n_own"), "plain", "left")
    return judged.groupBy("token").agg(*_verdict()).where("garbled").select("token", "restored", "pair")


def _verdict() -> list[Column]:
    known, own = F.coalesce("n_restored", F.lit(0)), F.coalesce("n_own", F.lit(0))
    is_mark = ~F.col("restored").rlike(r"\p{L}")
    longer = (F.length("token") > 1) | is_mark
    by_lexicon = (known >= LEX_RATIO * own + LEX_LEAST) & longer
    damaged = (F.col("damage") > 0) & (known > 0)
    # A closing quotation mark is part of a sequence only where none opens the token.
    quoted = F.col("token").rlike("^[«“„].*[»”“]$")
    by_form = F.col("surely") & ((known > 0) | (F.col("damage") > 0) | (own <= 2) & F.col("pair").startswith("utf_8") & ~F.col("pair").contains(" ") & ~quoted)
    accepted = F.col("restored").isNotNull() & (by_lexicon | damaged | by_form)
    rank = F.when(accepted, F.struct(known.alias("k"), F.col("surely").alias("s"), F.col("restored").alias("r"), F.col("pair").alias("p")))
    best = F.max(rank)
    return [
        (best.isNotNull() | F.max("proven")).alias("garbled"),
        best["r"].alias("restored"),
        best["p"].alias("pair"),
    ]


def find_garbled(texts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """The keys of every text in which a character came out wrong, with `restored` and whether it is `whole`.

    The few garbled tokens meet the many rows in a join salted by row, in as
    many parts as the commonest token needs at SALTED rows each, so that
    one token standing in a third of all rows doesn't fall to one task.
    """
    tokens = tokens_of(texts, text, keys)
    counts = cut_lineage(tokens.groupBy("token").agg(F.count("*").alias("n")))
    salts = 1 + (counts.agg(F.max("n")).first()[0] or 0) // SALTED
    wrong = garbled_tokens(counts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = tokens.withColumn("salt", F.pmod(F.hash(*keys), F.lit(salts)))
    return salted.join(wrong, ["token", "salt"]).drop("salt")


def restore(texts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """keys, text, restored (matched spans replaced, all else untouched), whole (nothing was beyond repair)."""
    hits = find_garbled(texts, text, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.length("token")).alias("l"), "token", "restored"))).alias("swaps")
    )
    swapped = F.aggregate("swaps", F.col(text), lambda acc, s: F.replace(acc, s["token"], F.coalesce(s["restored"], s["token"])))
    joined = texts.select(*keys, text).join(hits, list(keys))
    return joined.select(*keys, text, swapped.alias("restored"), (~F.exists("swaps", lambda s: s["restored"].isNull())).alias("whole"))
