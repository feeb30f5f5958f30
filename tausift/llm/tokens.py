"""Word tokens of mixed-script text, alike for texts that differ only in writing and layout."""

from __future__ import annotations

import re
import unicodedata

_DROPPED = re.compile("[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\xad*_`]+")
_DIGIT = re.compile("[०-९]")
_DIGITS = {0x0966 + k: 0x30 + k for k in range(10)}
_CJK = "぀-ヿ㐀-鿿豈-﫿々〇。、・「」"
_SPACED = re.compile(rf"(?<=[{_CJK}])\s+(?=[{_CJK}\d])|(?<=\d)\s+(?=[{_CJK}])|(?<=\d)　(?=\d)")
_TAG = re.compile(r"</?[a-zA-Z][^>\n]*>")
_TOKEN = re.compile(r"\d+|[ァ-ヺー]+|[぀-ゟ㐀-鿿豈-﫿々〇]|[가-힣]+|(?:[^\W\d_]|[̀-ͯऀ-ॣॱ-ॿ])+")


_UNSEEN = re.compile("[\u200b-\u200f\u2060\ufeff\xad]+")


def visible(text: str) -> str:
    """text without invisible characters."""
    return _UNSEEN.sub("", text)


def normal(text: str) -> str:
    """text in NFKC and lower case, without invisible characters, emphasis marks, inline tags and blanks between characters
    of scripts that have none between words; digits are ASCII."""
    if not text.isascii():
        text = _SPACED.sub("", text)
    text = _DROPPED.sub("", unicodedata.normalize("NFKC", text).lower())
    if _DIGIT.search(text):
        text = text.translate(_DIGITS)
    return _TAG.sub("", text) if "<" in text else text


def tokens(text: str) -> list[str]:
    """Numbers, katakana runs, single kana and ideographs, and words of other scripts with their marks."""
    return _TOKEN.findall(normal(text))
