"""Characters that look the same: what is plain, and how a token is written plainly."""

from __future__ import annotations

import re
import unicodedata

# Cyrillic and Greek letters whose shape is that of a Latin letter.
CYRILLIC = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅҺԌԚԜӀ"
CYRILLIC_AS_LATIN = "aeopcyxijshdqwlABEKMHOPCTYXIJSHGQWI"
GREEK = "ανοιρυκτχγεϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
GREEK_AS_LATIN = "avoipuktxyecjABEZHIKMNOPTYXCJ"
# Compatibility shapes of letters and digits (ranges of code points, ends included).
SHAPES = ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9D), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x1D400, 0x1D7FF), (0x1E030, 0x1E06D), (0x2102, 0x2102), (0x210A, 0x2113), (0x2115, 0x2115), (0x2119, 0x211D), (0x2124, 0x2124), (0x2128, 0x2128), (0x212A, 0x2131), (0x2133, 0x2134), (0x2139, 0x2139), (0x213C, 0x213F), (0x2145, 0x2149), (0x2160, 0x217F), (0x2460, 0x2473), (0x24B6, 0x24EA), (0x1F110, 0x1F12B), (0x1F130, 0x1F149), (0x1FBF0, 0x1FBF9), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC), (0x17F, 0x17F), (0x133, 0x133), (0x132, 0x132))
# Characters without width, and spaces that are not the ordinary space.
WIDTHLESS = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFE0E, 0xFE0F, 0xFEFF)))
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
IDEOGRAPHIC_SPACE, ZERO_WIDTH_SPACE, JOINERS = 0x3000, 0x200B, (0x200C, 0x200D)
DIRECTIONS = (0x61C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A))
FILLERS = (0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E)
_SELECTORS = chr(0xFE0E) + chr(0xFE0F)

_LATIN_OF = {"Cyrl": dict(zip(CYRILLIC, CYRILLIC_AS_LATIN, strict=True)), "Grek": dict(zip(GREEK, GREEK_AS_LATIN, strict=True))}
_OF_LATIN = {script: {b: a for a, b in table.items()} for script, table in _LATIN_OF.items()}
_SKELETON = {ord(a): b for table in _LATIN_OF.values() for a, b in table.items()}
# Small letters that look like no Latin letter share the target of their capital, so that case does not matter.
_SKELETON |= {ord(a.lower()): b.lower() for table in _LATIN_OF.values() for a, b in table.items() if ord(a.lower()) not in _SKELETON}
_DROP = dict.fromkeys(map(ord, WIDTHLESS))


def _ranges(pairs) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in pairs)


def _class(*pairs) -> re.Pattern:
    return re.compile(f"[{_ranges(pairs)}]")


_SHAPED = re.compile(f"[{_ranges(SHAPES)}]")
_BARE = re.compile(f"[{WIDTHLESS}]")
_SPACED = re.compile(f"[{SPACES}]")
_WORD = re.compile(r"[^\W\d_]+")
_JOINING = _class((0x600, 0x8FF), (0x900, 0xDFF), (0xF00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1800, 0x18AF), (0x1B00, 0x1BFF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0x10A00, 0x11FFF))
_RTL = _class((0x590, 0x8FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFC))
_UNSPACED = _class((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF))
_CJK = _class((0x2E80, 0x312F), (0x3130, 0x318F), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
_CLUSTER = re.compile(r"[^\W\d_]" + f"[{_ranges(((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFF9E, 0xFF9F)))}]+")


def script(letter: str) -> str:
    code = ord(letter)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "Latn"
    if 0x400 <= code < 0x530 or 0x1C80 <= code < 0x1C90 or 0x2DE0 <= code < 0x2E00 or 0xA640 <= code < 0xA6A0:
        return "Cyrl"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "Grek"
    return "Zyyy"


def _pictured(ch: str) -> bool:
    return bool(ch) and (unicodedata.category(ch) in ("So", "Sk") or ord(ch) >= 0x1F000)


def _as(letter: str, own: str, target: str) -> str | None:
    """``letter`` of alphabet ``own`` as the letter of ``target`` that it looks like, or None."""
    if own in (target, "Zyyy"):
        return letter
    latin = letter if own == "Latn" else _LATIN_OF[own].get(letter)
    return latin if latin is None or target == "Latn" else _OF_LATIN[target].get(latin)


def _one_script(word: re.Match) -> str:
    """The word with look-alike letters of another alphabet replaced. Its alphabet is the one in which fewest letters have no
    counterpart, then the one with most letters, then Latin; letters without a counterpart stay."""
    w = word.group()
    scripts = [script(c) for c in w]
    met = set(scripts) - {"Zyyy"}
    if len(met) < 2:
        return w
    target = min(met, key=lambda t: (sum(_as(c, s, t) is None for c, s in zip(w, scripts, strict=True)), -scripts.count(t), t != "Latn"))
    return "".join(_as(c, s, target) or c for c, s in zip(w, scripts, strict=True))


def plain(token: str) -> str:
    """``token`` in plain characters; unchanged if it is plain.

    Plain: ordinary spaces (an ideographic space beside East Asian text stays), no characters without width but
    the joiners and marks that a script or an emoji needs, one accented letter instead of letter and mark where
    it exists, ordinary shapes of letters and digits, and one alphabet within a word. Words wholly in their own
    script, punctuation, quotes and dashes stay as they are.
    """
    if token.isascii():
        return token
    s = token
    if _SPACED.search(s):
        t = s
        s = _SPACED.sub(lambda m: m.group() if ord(m.group()) == IDEOGRAPHIC_SPACE and _CJK.search(t[max(0, m.start() - 1) : m.start()] + t[m.end() : m.end() + 1]) else " ", s)
    if _BARE.search(s):
        rtl, t = bool(_RTL.search(s)), s

        def needed(m: re.Match) -> str:
            c, before, after = m.group(), t[m.start() - 1 : m.start()] if m.start() else "", t[m.end() : m.end() + 1]
            code, kind = ord(c), unicodedata.category(before) if before else ""
            keep = (
                (code in JOINERS and before and _JOINING.match(before))
                or (code == JOINERS[1] and (_pictured(before) or before in _SELECTORS) and before and _pictured(after))
                or (c in _SELECTORS and before and (before in "0123456789#*" or kind in ("So", "Sk", "Sm", "Po", "Pd")))
                or (code in DIRECTIONS and rtl)
                or (code == ZERO_WIDTH_SPACE and ((before and _UNSPACED.match(before)) or (after and _UNSPACED.match(after))))
                or code in FILLERS
            )
            return c if keep else ""

        s = _BARE.sub(needed, s)
    if _SHAPED.search(s):
        s = _SHAPED.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    s = _CLUSTER.sub(lambda m: n if len(n := unicodedata.normalize("NFC", m.group())) < len(m.group()) else m.group(), s)
    return _WORD.sub(_one_script, s)


def fold(text: str) -> str:
    """A caseless skeleton for comparing: two texts that read the same have the same one. Context-free, so it
    also maps whole words of another alphabet; it is for matching, never for output."""
    if text.isascii():
        return text.lower()
    s = unicodedata.normalize("NFKC", text.translate(_DROP))
    return unicodedata.normalize("NFC", s.translate(_SKELETON).casefold().translate(_SKELETON))


#: Java regex of texts that may hold a character that is not plain: a superset, so that the rest never leaves the JVM.
SUSPECT = "[\\p{M}\\p{Cf}\\x{115F}\\x{1160}" + SPACES + _ranges(SHAPES) + "]|\\p{IsLatin}[\\p{IsCyrillic}\\p{IsGreek}]|[\\p{IsCyrillic}\\p{IsGreek}]\\p{IsLatin}|\\p{IsCyrillic}\\p{IsGreek}|\\p{IsGreek}\\p{IsCyrillic}"
#: Inside of a Java character class: what a collation may leave out of account.
IGNORED = "\\p{Cf}\\p{Cc}\\x{34F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{2065}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FFA0}\\x{FFF0}-\\x{FFF8}\\x{E0000}-\\x{E0FFF}"
