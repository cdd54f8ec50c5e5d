"""Words of a text with its writing taken away: case, accents, punctuation, markup, escapes, look-alikes."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts, and special Latin letters, that look like a Latin letter.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ᴢ": "z", "г": "r", "п": "n", "ц": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴀ": "a", "ᴄ": "c", "ᴇ": "e", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d",
}

_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_CONTINUED = "".join(re.escape(c) for c in _CP1252) + "\x80-\xbf"
_BROKEN = re.compile(f"[\xc2-\xf4][{_CONTINUED}]{{1,3}}")
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|((?:%[0-9a-fA-F]{2})+)")
_SPACE_ESCAPE = re.compile(r"\\[nrtfv]")
_TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]{0,300}>|<!--.*?-->", re.S)
_LINE_MARK = re.compile(r"(?m)^(?:\s*(?:>|#+(?=\s)|[-*+•·‣](?=\s)|\d{1,3}[.)](?=\s)|Re:|\|)\s*)+|^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?\S* (?:\[\w+\] )?(?:\w+: )?")
_BROKEN_LINE = re.compile(r"(?<=[^\W\d_])[-‐‑\xad]\r?\n\s*(?=[^\W\d_])")
_MARKS = re.compile(r"[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f]+")
_INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e007f]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’‘ʼ`´′＇](?=\w)")
_CJK = r"\u2e80-\u2fff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_IS_CJK = re.compile(f"[{_CJK}]")
_TRANSLATE = str.maketrans(LOOK_ALIKES)


def _repair(match: re.Match) -> str:
    try:
        return bytes(_CP1252.get(c, ord(c) if ord(c) < 256 else -1) for c in match[0]).decode("utf-8")
    except ValueError:
        return match[0]


def _unescape(match: re.Match) -> str:
    if match[3]:
        return bytes.fromhex(match[3].replace("%", "")).decode("utf-8", "replace")
    return chr(int(match[1] or match[2], 16))


def plain(text: str) -> str:
    """The text in lower case, without markup, escapes, accents, invisible and look-alike characters."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text or "%" in text:
        text = _SPACE_ESCAPE.sub(" ", _UNICODE_ESCAPE.sub(_unescape, text))
    if not text.isascii():
        text = _BROKEN.sub(_repair, text)
        text = _INVISIBLE.sub("", _BROKEN_LINE.sub("", text))
        text = unicodedata.normalize("NFKC", text)
    else:
        text = _BROKEN_LINE.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _LINE_MARK.sub(" ", text)
    if text.isascii():
        return _APOSTROPHE.sub("", text.lower())
    text = _MARKS.sub("", unicodedata.normalize("NFD", text.casefold())).translate(_TRANSLATE)
    return _APOSTROPHE.sub("", text)


def words(text: str | None) -> list[str]:
    """Words of a text in order; each character of Chinese or Japanese is a word. Null and blank texts have none."""
    return _WORD.findall(plain(text)) if text else []


def mostly_cjk(tokens: list[str]) -> bool:
    return sum(1 for t in tokens if _IS_CJK.match(t)) * 2 > len(tokens)
