"""Text that looks plain and yet holds other characters, brought to one form.

Quick-check properties tell for nearly every text that nothing is to be done:
the text is NFC and holds no character of the suspicious classes. Only in the
others are the unstable segments isolated: from a character whose quick check
isn't Yes back to the boundary before it (the last starter that composes with
nothing before) and on to the next one, so that vowels and finals that are starters themselves
(Hangul, Bengali, Tamil) stay with what they compose with. Each is brought to its
canonical form and spliced back; the rest of the text is not touched. Within
a word, letters of another script that look like letters of the word's own
script are replaced by these.

Defined results: null stays null and is never reported, empty text is plain,
repeated rows are reported each under its own key. Words genuinely of another
script, typographic quotes, dashes, dots, primes, fractions, superscripts and
ordinals are plain. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look alike, first the Latin letter, then those of other scripts.
_ALIKE = """
A А Α Ꭺ|B В Β Ᏼ|C С Ϲ Ꮯ|D Ꭰ|E Е Ε Ꭼ|G Ԍ Ꮐ|H Н Η Ꮋ|I І Ι Ӏ|J Ј Ꭻ|K К Κ Ꮶ|L Ꮮ|M М Μ Ꮇ|N Ν|O О Ο Օ|P Р Ρ Ꮲ|Q Ԛ|S Ѕ Տ Ꮪ|T Т Τ Ꭲ|
U Ս|V Ѵ Ꮩ|W Ԝ Ꮃ|X Х Χ|Y Ү Υ|Z Ζ Ꮓ|a а α ɑ|b Ь|c с ϲ|d ԁ|e е ҽ|g ɡ ց|h һ հ|i і ι|j ј ϳ|k к κ|l ӏ|m м|n ո п|o о ο օ|p р ρ|q ԛ զ|r г|
s ѕ|t т τ|u υ ս|v ν ѵ|w ԝ ѡ|x х χ|y у γ|Ï Ї Ϊ|ï ї ϊ|É Έ|ó ό|ö ӧ|ë ё|Ë Ё|Ö Ӧ|Ä Ӓ|ä ӓ|æ ӕ|Æ Ӕ|ð ԁ|Ð Ꭰ
"""
_TO_LATIN: dict[str, str] = {}
_FROM_LATIN: dict[tuple[str, str], str] = {}


def script_of(c: str) -> str:
    """Of a letter, the word its Unicode name begins with; kana and ideographs go together."""
    if unicodedata.category(c)[0] != "L" or c in "ºª":
        return ""
    name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    return "EAST" if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") else name


for _group in "".join(_ALIKE.split("\n")).split("|"):
    _latin, *_others = _group.split(" ")
    for _c in _others:
        _TO_LATIN.setdefault(_c, _latin)
        if script_of(_c) != "LATIN":
            _FROM_LATIN.setdefault((script_of(_c), _latin), _c)

#: Characters that show nothing.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\U000e0000-\U000e0fff]")
_SPACE = re.compile("[   -     　\t\r\n]")
#: What may be unstable: marks and anything with a compatibility form of its width, font or ligature.
_WORD = re.compile(r"[^\W\d_]+(?:[^\W\d_]|[̀-ͯ])*")
_REPLACED_KINDS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
def _compatible(c: str) -> bool:
    """Whether the character is one of width, font or ligature only."""
    kind = unicodedata.decomposition(c)
    if kind.startswith(_REPLACED_KINDS):
        return c != "™"
    return kind.startswith("<compat>") and unicodedata.category(c) in ("Ll", "Lu", "Lo") and c not in "ŀĿŉ"


def _suspicious() -> str:
    """Anything but the Latin letters and signs that no rule above can change."""
    kept = [c for c in map(chr, [*range(0xA1, 0xAD), *range(0xAE, 0x2B0)]) if c not in _TO_LATIN and not _compatible(c) and unicodedata.is_normalized("NFC", c)]
    return rf"[^\x20-\x7e{''.join(kept)}–—‘’‚“”„…′″⅓⅔⅛™€]"


#: Suspicious to the JVM.
SUSPICIOUS = _suspicious()
_SUSPICIOUS = re.compile(SUSPICIOUS)


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters whose quick check says Maybe though they are starters: they may compose with a starter before them."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of Hangul syllables
    for c in map(chr, _beyond_ideographs()):
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<" and " " in parts and unicodedata.is_normalized("NFC", c):
            out.add(chr(int(parts.split(" ")[1], 16)))
    return frozenset(c for c in out if not unicodedata.combining(c))


def _beyond_ideographs() -> Iterator[int]:
    """All code points but the large blocks of ideographs, syllables and private ones, which are stable starters."""
    yield from (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1FFFF), *range(0x2F800, 0x2FA20))


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern:
    """Characters with which a text may not be in its canonical form: marks, joining starters, No and width, font or ligature forms."""
    ranges: list[list[int]] = []
    for code in _beyond_ideographs():
        c = chr(code)
        if unicodedata.combining(c) or c in _joining() or _compatible(c) or not unicodedata.is_normalized("NFC", c):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


def _is_boundary(c: str) -> bool:
    return not unicodedata.combining(c) and c not in _joining() and not _compatible(c)


def _segments(text: str) -> Iterator[tuple[int, int, str]]:
    """The unstable segments: start, end, canonical form."""
    end = 0
    for m in _unstable().finditer(text):
        if m.start() < end:
            continue
        start, end = m.start(), m.start() + 1
        while start > 0 and not _is_boundary(text[start]):
            start -= 1
        while end < len(text) and not _is_boundary(text[end]):
            end += 1
        piece = text[start:end]
        canonical = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) if _compatible(c) else c for c in piece))
        if canonical != piece:
            yield start, end, canonical


def _own_script(word: str, context: Counter) -> str | None:
    """The script a word of mixed or borrowed letters is meant in."""
    scripts = Counter(s for s in map(script_of, word) if s)
    bound = Counter(script_of(c) for c in word if script_of(c) and c not in _TO_LATIN and (script_of(c) != "LATIN" or not any((s, c) in _FROM_LATIN for s in scripts)))
    if not scripts:
        return None
    if len(scripts) == 1:
        (only,) = scripts
        if only == "LATIN":
            # Phonetic letters that pass for plain ones, but for words that are phonetic writing.
            phonetic = [c for c in word if "ɐ" <= c <= "ʯ"]
            return only if phonetic and all(c in _TO_LATIN for c in phonetic) else None
        alike = only in ("CYRILLIC", "GREEK") and not bound
        return "LATIN" if alike and context["LATIN"] and not context[only] else None
    if bound:
        return bound.most_common(1)[0][0]
    return (scripts & context).most_common(1)[0][0] if scripts & context else scripts.most_common(1)[0][0]


def _one_script(text: str) -> str:
    words = list(_WORD.finditer(text))
    if all(w[0].isascii() for w in words):
        return text
    out, at = [], 0
    bound = [Counter(s for s in (script_of(c) for c in w[0] if c not in _TO_LATIN) if s) for w in words]
    for k, w in enumerate(words):
        if w[0].isascii() and len(words) == 1:
            continue
        context = sum((b for i, b in enumerate(bound) if i != k), Counter())
        own = _own_script(w[0], context)
        if own == "LATIN":
            new = "".join(_TO_LATIN.get(c, c) if script_of(c) != "LATIN" or c in "ɑɡ" else c for c in w[0])
        elif own:
            new = "".join(_FROM_LATIN.get((own, c), c) if script_of(c) == "LATIN" else c for c in w[0])
        else:
            continue
        out += (text[at : w.start()], new)
        at = w.end()
    return "".join([*out, text[at:]])


def plain_form(text: str) -> str:
    """The plain writing of what the text shows."""
    if not _SUSPICIOUS.search(text):
        return text
    shown = _SPACE.sub(" ", _INVISIBLE.sub("", text))
    parts, at = [], 0
    for start, end, canonical in _segments(shown):
        parts += (shown[at:start], canonical)
        at = end
    return _one_script("".join([*parts, shown[at:]]))


def to_plain(texts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """keys, text, plain: every text that isn't its own plain form."""
    fields = texts.select(*keys, text)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.schema) + ", plain string"

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["plain"] = [plain_form(t) for t in batch[text]]
            yield batch[batch["plain"] != batch[text]]

    return fields.where(F.col(text).rlike(SUSPICIOUS)).mapInPandas(rewrite, kinds)
