"""Texts as runs of words: markup, escapes and invisible characters out, whatever form a text is stored in."""

from __future__ import annotations

import html
import re

import numpy as np

#: Characters that are not seen, and escape letters that stand for white space.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufe0f\ufeff"
_UNSEEN = re.compile(f"[{INVISIBLE}]+")
_CODED = re.compile(r"(?<!\\)\\+(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2}))")
_COLOUR = re.compile("\x1b\\[[0-9;]*[A-Za-z]")
#: A tag with anything short behind its name, or with attributes of any length; a mark of less in a sentence is neither.
_TAG = re.compile(r"""</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]{0,400}|(?:\s+[\w:@.-]+\s*=\s*(?:\\*"[^"<>]*"|\\*'[^'<>]*'|[^\s<>"']+))++\s*)?/?>|<![A-Za-z][^<>]*>""")
_SPACE_ESCAPE = re.compile(r"(?<!\\)\\+[nrtfv]")
_ENTITY = re.compile(r"&(?:amp;)*(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")


def readable(text: str) -> str:
    """The text as a reader sees it, as far as words go; lower case. Cheap where a text has none of it."""
    if "\\" in text:
        text = _CODED.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)), text)
        text = _SPACE_ESCAPE.sub(" ", text)
    if "\x1b" in text:
        text = _COLOUR.sub("", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(html.unescape(m.group())), text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    return text.lower()


#: For bytes: letters and digits stay, other ASCII becomes a blank; bytes of other characters stay for now.
_BLANKED = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: Marks and blanks outside ASCII, in the ranges where they are found.
_MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2000-\u206f\u2190-\u2bff\u3000-\u3004\u3008-\u3020\uff00-\uff0f\uff1a-\uff20]+")


def words_line(text: str | None) -> np.ndarray:
    """The words of a text, in lower case and parted by single blanks, as UTF-8 bytes that begin and end with a blank."""
    text = readable(text or "")
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(_BLANKED) + b" ", np.uint8)
    blank = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return raw[keep]
