"""Garbled character sequences for pairs of encodings.

A text written in encoding R and read in encoding W shows, for every
character c, the sequence c.encode(R).decode(W). For the alphabets below and
their marks this module builds all such sequences from the codecs themselves
and puts them into one Aho-Corasick automaton. Sequences of which one byte
got lost on the way (controls that a reader left out) stand in it too.

East Asian characters come in tables of many thousands, whose sequences are
the products of a few classes of characters: those a reader shows for lead
bytes and for trail bytes. For each pair these classes make one compiled
pattern, itself an automaton, that matches the sequences of the whole table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

# Alphabets whose letters can come out wrong, and typographic marks.
LATIN_MARKED = (
    "áàâãäåæçéèêëíìîïñóòôõöøœúùûüýÿßðþ"
    "ąćęłńóśźż"
    "ěščřžýáíéůúďťň"
    "ğışöüçİ"
    "őűăâîșțžđ"
)
GREEK = "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋ"
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ"
MARKS = "–—‘’‚“”„…«»¿¡ºª°½¼¾²³¹£€§·×″′⅓™©®"

# Encodings a text may have been written in, and read in.
WRITTEN_SINGLE = (
    "cp1252", "mac_roman", "cp437", "cp850", "cp852", "cp1250", "iso8859_2", "cp1254", "mac_latin2",
    "cp1253", "iso8859_7", "cp737", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic",
)
READ_AS = (
    "latin_1", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "cp1253",
    "cp1254", "iso8859_2", "cp852",
)
READ_WIDE = ("cp932", "gbk", "cp949")


def lenient_decode(raw: bytes, enc: str) -> str | None:
    """Decode as readers do: bytes that an encoding leaves open pass as C1 controls."""
    out = []
    for b in raw:
        one = bytes((b,))
        try:
            out.append(one.decode(enc))
        except UnicodeDecodeError:
            if not 0x80 <= b <= 0x9F:
                return None
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=None)
def _reverse(enc: str) -> dict[str, int]:
    back: dict[str, int] = {}
    for b in range(256):
        c = lenient_decode(bytes((b,)), enc)
        if c is not None:
            back.setdefault(c, b)
    return back


def lenient_encode(text: str, enc: str) -> bytes | None:
    """Inverse of lenient_decode; None where a character isn't in the encoding."""
    if enc in READ_WIDE:
        try:
            return text.encode(enc)
        except UnicodeEncodeError:
            return None
    back = _reverse(enc)
    try:
        return bytes(back[c] for c in text)
    except KeyError:
        return None


def _letters() -> list[str]:
    seen = dict.fromkeys(LATIN_MARKED + GREEK + CYRILLIC)
    for c in list(seen):
        if len(c.upper()) == 1:
            seen.setdefault(c.upper())
    return [*seen, *dict.fromkeys(MARKS)]


def _upper_half() -> list[str]:
    """What a text already read as Latin-1 or Windows-1252 can hold: needed for texts garbled twice."""
    return list(dict.fromkeys([chr(c) for c in range(0x80, 0x100)] + [lenient_decode(bytes((b,)), "cp1252") for b in range(0x80, 0xA0)]))


#: Lead and trail bytes of the East Asian encodings, and of the three-byte sequences of UTF-8 from U+2E80 to U+D7FF.
_EAST = {
    "cp932": ([*range(0x81, 0xA0), *range(0xE0, 0xFD)], [*range(0x40, 0x7F), *range(0x80, 0xFD)]),
    "euc_jp": ([0xA1, *range(0xA4, 0xF5)], [*range(0xA1, 0xFF)]),
    "cp949": ([*range(0x81, 0xFE)], [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x81, 0xFF)]),
    "gbk": ([*range(0x81, 0xFE)], [*range(0x40, 0x7F), *range(0x80, 0xFF)]),
}


def _class_of(codes: list[int], read: str) -> str:
    """A class of the characters that a reader shows for some bytes; empty where it shows none."""
    shown = [c for b in codes if (c := lenient_decode(bytes((b,)), read)) is not None]
    return "[" + "".join(map(re.escape, shown)) + "]" if shown else ""


@lru_cache(maxsize=1)
def east_patterns() -> list[tuple[str, str, re.Pattern]]:
    """(written, read, pattern of the sequences of at least two characters, or of one in UTF-8)"""
    out = []
    for read in READ_AS:
        lead, trail = _class_of([*range(0xE2, 0xEE)], read), _class_of([*range(0x80, 0xC0)], read)
        if lead and trail:
            out.append(("utf_8", read, re.compile(f"(?:{lead}{trail}{trail})+")))
    for read in READ_AS:
        for written, (leads, trails) in _EAST.items():
            lead, trail = _class_of(leads, read), _class_of(trails, read)
            if lead and trail:
                out.append((written, read, re.compile(f"(?:{lead}{trail}){{2,}}")))
    return out


#: What a reading of two-byte sequences must consist of: the common part of each table, in one script.
_COMMON = {
    "cp932": (re.compile(r"[\u3005-\u30FF\u4E00-\u9FFF]+"), "euc_jp", 0xA4, 0xCF), "euc_jp": (re.compile(r"[\u3005-\u30FF\u4E00-\u9FFF]+"), "euc_jp", 0xA4, 0xCF),
    "cp949": (re.compile(r"[\uAC00-\uD7A3]+"), "euc_kr", 0xB0, 0xC8), "gbk": (re.compile(r"[\u4E00-\u9FFF]+"), "gb2312", 0xB0, 0xD7),
}
_EAST_LETTERS = re.compile(r"[\u3000-\u303F\u3041-\u3096\u30A1-\u30FC\u3400-\u9FFF\uAC00-\uD7A3\uFF66-\uFF9D]+")
#: First bytes of UTF-8 as Latin-1 shows them, two of them with at most a sign between: such a token isn't of two-byte sequences.
_UTF_8 = re.compile("[\xc2-\xc5\xce-\xd1][^\\w\\s]?[\xc2-\xc5\xce-\xd1]|[\xe3-\xe9][^a-zA-Z\\s]{0,2}[\xe3-\xe9]")


def _common(said: str, written: str) -> bool:
    letters, table, low, high = _COMMON[written]
    try:
        return bool(letters.fullmatch(said)) and all(low <= c.encode(table)[0] <= high for c in said if c not in "々ー")
    except UnicodeEncodeError:
        return False


def east_readings(token: str) -> Iterator[tuple[str, str, str, int, bool]]:
    """(restored, written, read, characters matched, plausible) of a token that holds sequences of East Asian characters; only they are replaced.

    Nearly any two letters beyond ASCII are a sequence of some two-byte table,
    so such a reading is plausible by itself only if it takes up all that
    isn't ASCII, says common characters of one script and none of UTF-8 does.
    """
    beyond, is_utf_8 = sum(not c.isascii() for c in token), bool(_UTF_8.search(token))
    for written, read, pattern in east_patterns():
        if not pattern.search(token):
            continue
        said_all: list[str] = []

        def back(m: re.Match) -> str:
            raw = lenient_encode(m[0], read)
            try:
                said = raw.decode(written) if raw else ""
            except UnicodeDecodeError:
                return m[0]
            if not _EAST_LETTERS.fullmatch(said):
                return m[0]
            said_all.append(said)
            return said

        restored = pattern.sub(back, token)
        if not said_all:
            continue
        whole = restored.isascii() or sum(not c.isascii() for c in restored) == len("".join(said_all))
        if written == "utf_8":
            is_utf_8 |= whole
            yield restored, written, read, 3 * len("".join(said_all)), True
        else:
            yield restored, written, read, 2 * len("".join(said_all)), whole and not is_utf_8 and beyond > 2 and all(_common(x, written) for x in said_all)


def is_letter_like(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


@lru_cache(maxsize=1)
def sequences() -> dict[str, dict[tuple[str, str], str]]:
    """garbled sequence -> {(written, read): original character}"""
    table: dict[str, dict[tuple[str, str], str]] = {}

    def put(c: str, written: str, read: str) -> None:
        try:
            raw = c.encode(written)
        except UnicodeEncodeError:
            return
        g = lenient_decode(raw, read)
        if g is not None and g != c and not g.isascii():
            table.setdefault(g, {}).setdefault((written, read), c)

    for c in _upper_half():
        for read in READ_AS[:2]:
            put(c, "utf_8", read)
    for c in _letters():
        for read in READ_AS:
            put(c, "utf_8", read)
            for written in WRITTEN_SINGLE:
                if written != read:
                    put(c, written, read)
    # One byte of two got lost: of a reader's controls nothing is left.
    for c in map(chr, range(0xC0, 0x180)):
        raw = c.encode()
        if raw[1] < 0xA0 and c.isalpha():
            for read in READ_AS[:2]:
                if (lenient_decode(raw[1:], read) or "")[:1] in map(chr, range(0x80, 0xA0)):
                    table.setdefault(lenient_decode(raw[:1], read), {}).setdefault((f"utf_8-{c}", read), c)
    return table


@lru_cache(maxsize=1)
def proofs() -> re.Pattern:
    """What no text holds unless a byte came out wrong.

    The replacement character, as such or itself read wrong; C1 controls;
    signs of old code pages within words; a capital with a mark behind a small
    letter; first halves of two-byte sequences beside a sign, each other, or,
    for quotation marks, a capital.
    """
    shown = {lenient_decode("\ufffd".encode(), read) for read in READ_AS} - {None}
    marked = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isupper())
    small = "a-z" + "".join(c for c in map(chr, range(0xDF, 0x250)) if c.islower())
    letter = f"{small}A-Z{marked}"
    return re.compile("|".join([
        "\ufffd", "[\x80-\x9f]", f"(?<=[{small}])[{marked}]", "[ƒˆˇ]", f"[¤¦¬¨¯¸\u2500-\u259f](?=[{letter}])|(?<=[{letter}])[¤¦¬¨¯¸\u2500-\u259f]", f"(?<=[{letter}])[†‡‰](?=[{letter}])",
        "[ÂÃÄÅÐÑÎÏ][\xa1-\xaa\xac\xae-\xb3\xb5-\xba\xbc-\xbf]", "[ÐÑÎÏ][^\\w\\s]?[ÐÑÎÏ]", "ã[^\\w\\s]{0,2}[ãåæçèé]|[åæèé][^\\w\\s]{0,2}ã", "â(?=[A-Z])", *map(re.escape, sorted(shown)),
    ]))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for g, origins in sequences().items():
        a.add_word(g, (len(g), origins))
    a.make_automaton()
    return a
