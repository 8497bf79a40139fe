"""One way of writing a title's capitals: joining words small, all others and the ends of every part large. Only case moves."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that join others, by language.
JOINING = {
    "pt": frozenset(
        "a à às ao aos o os as e ou nem de do dos da das d' em no nos na nas num numa nuns numas por pelo pela pelos pelas para pra pro pras pros com sem".split()
    ),
    "en": frozenset("a an the and or nor but of in on at to by for from with".split()),
    "es": frozenset("de del la las el los y e o u en con por para a al sin".split()),
}

_PART = re.compile(r"([:;/(\[–—]|\s-\s)")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_])|[̀-ͯ])*")


def language_of(text: str) -> str | None:
    """The language whose joining words stand in the text more often than those of any other."""
    words = [w.lower() for w in _WORD.findall(text)]
    votes = sorted(((sum(w in joining for w in words), name) for name, joining in JOINING.items()), reverse=True)
    return votes[0][1] if votes[0][0] > votes[1][0] else None


def is_shouted(text: str) -> bool:
    cased = [c for c in text if c.isupper() or c.islower()]
    return len(cased) > 1 and all(c.isupper() for c in cased)


def title_case(text: str, language: str | None = None) -> str:
    """The text with its capitals put in order. A word with inner capitals stays, unless the whole text is shouted."""
    whole, shouted, out = language or language_of(text), is_shouted(text), []
    for part in _PART.split(text):
        joining = JOINING.get(language or language_of(part) or whole or "", frozenset())
        spots = list(_WORD.finditer(part))
        at = 0
        for i, m in enumerate(spots):
            word = m[0]
            small = word.lower() in joining and 0 < i < len(spots) - 1
            inner = word[1:] != word[1:].lower() and not shouted
            if small or not inner:
                word = word.lower() if small else word[0].upper() + word[1:].lower()
            out += (part[at : m.start()], word)
            at = m.end()
        out.append(part[at:])
    return "".join(out)


def titles(text: Column | str) -> Column:
    """title_case of a column; null stays null."""

    def run(series: pd.Series) -> pd.Series:
        return series.map(title_case, na_action="ignore")

    return F.pandas_udf(run, "string")(text)
