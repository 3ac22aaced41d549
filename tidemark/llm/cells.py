"""Text cells of notebooks in the forms in which they are stored."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

_JSON_CELL = re.compile(r'\{"cell_type": "(\w+)"')
#: What a cell of a form begins with: before a cell of JSON nothing but JSON, before HTML comments.
_JSON_HEAD = re.compile(r'(?:[\s\[\],:}\d]|\{(?!"cell_type)|"[^"\n]*"|true|false|null)*+\{"cell_type": "')
_HTML_HEAD = re.compile(r"\s*+(?:<!--(?:(?!-->).)*+-->\s*+|<\?[^<>]*+>\s*+)*+<(?:!doctype|html)\b", re.I | re.S)
_JSON_STRING = re.compile(r'"((?:[^"\\]++|\\.)*+)"', re.S)
_HTML_CELL = re.compile(r'<div class="nb-(text|code|output)"[^<>]*>(.*?)(?=<div class="nb-|\Z)', re.S)
HTML_TAG = re.compile(r"(?<!<)</?(?:html|head|title|body|div|p|pre|span|h[0-9]+|b|i|em|strong|br|hr|a|ul|ol|li|meta|link|table|tr|td|th|code)\b[^<>]*>|<!doctype[^<>]*>", re.I)
_PERCENT = re.compile(r"^(#|//|--) %%(.*)$", re.M)
_COMMENT = re.compile(r"^(?:#|//|--) ?", re.M)
_BLOCK = re.compile(r"(?:\r?\n){2,}")
_FENCE = re.compile(r"^```.*?(?:^```[ \t]*$|\Z)", re.M | re.S)
_INDENTED = re.compile(r"(?:^(?: {4}|\t).*\n?)+", re.M)


def _decoded(raw: str) -> str:
    try:
        return json.loads(f'"{raw}"', strict=False)
    except ValueError:
        return raw.replace("\\n", "\n").replace('\\"', '"')


def _source(cell: str) -> str:
    at = cell.find('"source"')
    return "".join(_decoded(m) for m in _JSON_STRING.findall(cell, at + 8)) if at >= 0 else ""


def plain(cell: str) -> str:
    """What a text cell says, without the markup of its form."""
    if _JSON_HEAD.match(cell):
        return _source(cell)
    if 'class="nb-' in cell or _HTML_HEAD.match(cell):
        return html.unescape(HTML_TAG.sub("\n", cell))
    if _PERCENT.match(cell):
        return _COMMENT.sub("", _PERCENT.sub("", cell))
    return cell


def text_cells(text: str, types: list | None, starts: list | None) -> Iterator[str]:
    """The text cells of a document, plain. Where the list of cells is lost or doesn't fit, they are found by the document's form."""
    if types is not None and starts is not None and len(types) == len(starts) and types:
        for i, kind in enumerate(types):
            if kind == "text" and starts[i] is not None:
                after = starts[i + 1] if i + 1 < len(starts) and starts[i + 1] is not None else len(text)
                yield plain(text[starts[i] : after])
        return
    if _JSON_CELL.search(text):
        found = list(_JSON_CELL.finditer(text))
        for m, after in zip(found, [*[x.start() for x in found[1:]], len(text)]):
            if m.group(1) == "markdown":
                yield _source(text[m.start() : after])
    elif 'class="nb-' in text:
        for m in _HTML_CELL.finditer(text):
            if m.group(1) == "text":
                yield html.unescape(HTML_TAG.sub("\n", m.group(2)))
    elif _PERCENT.search(text):
        found = list(_PERCENT.finditer(text))
        for m, after in zip(found, [*[x.start() for x in found[1:]], len(text)]):
            if "markdown" in m.group(2):
                body = text[m.end() : after]
                yield _COMMENT.sub("", re.split(r"(?m)^(?:#|//|--) Out\[", body, maxsplit=1)[0])
    elif re.search(r"(?m)^In \[[0-9 *]*\]:", text):
        # In and Out head blocks up to an empty line; what neither heads is text, unless an output goes on after one
        told, shown = [], False
        for block in _BLOCK.split(text):
            if re.match(r"(?:In |Out)\[", block.strip()):
                shown = block.strip().startswith("Out")
            elif not (shown and re.match(r"[ \t{\[<]", block)):
                told.append(block)
                shown = False
                continue
            if told:
                yield "\n\n".join(told)
                told = []
        if told:
            yield "\n\n".join(told)
    else:
        yield plain(_INDENTED.sub("", _FENCE.sub("", text)) if "```" in text else text)
