"""Guess the charset of bytes that name none and are no UTF-8.

Every candidate that can decode the bytes is judged by what it makes of them: letters that are
frequent in the script it writes count for it, pairs of letters that no text of that script has
(a capital after a small letter, two scripts in one word, rare ideographs) count against it.
"""

from __future__ import annotations

import re

#: Candidates in the order in which ties are decided. Fixed values.
CANDIDATES = (
    "utf-8", "iso-2022-jp", "windows-1251", "koi8-r", "iso-8859-5", "shift_jis", "euc-jp", "gb18030", "big5", "euc-kr",
    "windows-1253", "windows-1252",
)
#: Frequent letters of the scripts that differ only by their letters' numbers. Fixed values.
_FREQUENT = {"cyrillic": "оеаинтсрвлкмдпуяыьг", "greek": "αοιετσνηυρπκμλςόίέάή", "latin": "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿßÁÀÂÄÅÉÈÊËÍÎÏÑÓÔÖØÚÙÛÜ’“”–—…€°«»¿¡"}
_SCRIPT = {
    "windows-1251": "cyrillic", "koi8-r": "cyrillic", "iso-8859-5": "cyrillic", "windows-1253": "greek", "windows-1252": "latin",
}
_JAPANESE = re.compile("[぀-ヿ　-。ー]")
_HANGUL = re.compile("[가-힣]")
_IDEOGRAPH = re.compile("[一-鿿]")
_ODD = re.compile("(?<=[a-zà-ÿа-яα-ω])[A-ZÀ-ÞА-ЯΑ-Ω]|(?<=[a-z])[Ͱ-ӿ]|[｡-ﾟ]|[\x80-\x9f]")
#: Bytes looked at.
LOOKED_AT = 1 << 16


def _common(text: str, charset: str) -> int:
    """Ideographs of a national standard's first level, which holds those in daily use."""
    level = {"gb18030": ("gb2312", 0xB0, 0xD7), "big5": ("big5", 0xA4, 0xC6), "euc-jp": ("euc-jp", 0xB0, 0xCF), "shift_jis": ("shift_jis", 0x88, 0x97), "euc-kr": ("euc-kr", 0xB0, 0xC8)}[charset]
    name, first, last = level
    found = 0
    for c in text:
        coded = c.encode(name, "ignore")
        found += len(coded) == 2 and first <= coded[0] <= last
    return found


def _judged(text: str, charset: str) -> float:
    """Share of the characters beyond ASCII that speak for the charset, less those against it."""
    beyond = [c for c in text if ord(c) > 127]
    if not beyond:
        return 0.0
    against = 2.0 * len(_ODD.findall(text))
    joined = "".join(beyond)
    if charset in _SCRIPT:
        frequent = _FREQUENT[_SCRIPT[charset]]
        if charset == "windows-1252":
            # Texts of Latin letters have few of these; a run of them is another charset's word.
            against += 2.0 * sum(len(x) - 2 for x in re.findall("[\x80-ɏ]{3,}", text))
        return (sum(c in frequent for c in joined.lower() if charset != "windows-1252") + sum(c in frequent for c in joined if charset == "windows-1252") - against) / len(beyond)
    if charset in ("shift_jis", "euc-jp", "iso-2022-jp"):
        kana, common = len(_JAPANESE.findall(joined)), 0 if charset == "iso-2022-jp" else _common(joined, charset)
        # Japanese text has kana; ideographs alone speak for Chinese.
        return (1.2 * kana + (common if kana else 0.3 * common) - against) / len(beyond)
    if charset == "euc-kr":
        return (1.1 * len(_HANGUL.findall(joined)) - against - len(_IDEOGRAPH.findall(joined)) * 0.5) / len(beyond)
    return (_common(joined, charset) + 0.5 * len(re.findall("[　-〟！-～]", joined)) - 2.0 * len(_JAPANESE.findall(joined.translate({0x3000: None, 0x3001: None, 0x3002: None}))) - against) / len(beyond)


def detected(raw: bytes) -> str:
    """The charset that reads ``raw`` best; ``latin-1``, which accepts every byte, where none is convincing."""
    sample = raw[:LOOKED_AT]
    if b"\x1b$" in raw:
        return "iso-2022-jp"
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    best, name = 0.0, "latin-1"
    for charset in CANDIDATES[2:]:
        try:
            raw.decode(charset)
            text = sample.decode(charset, "ignore")
        except UnicodeDecodeError:
            continue
        judged = _judged(text, charset)
        if judged > best + 1e-9:
            best, name = judged, charset
    return name
