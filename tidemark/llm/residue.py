"""Template residue and error pages in place of content, by a multi-pattern automaton and its coverage.

One automaton holds the phrases of all slots (``phrases``). What it finds in a line says which slots the line fills; slots form frames
(an error, a notice that scripts are needed, a prompt, filler, an outline without text). A line is residue if it fills a frame and what
the automaton covers is most of its content: words without content, numbers, paths and names with underscores don't count.
Marks that can open a field to be filled in are phrases too; where the automaton meets one, a pattern looks at the field's form.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.cells import HTML_TAG, text_cells
from tidemark.llm.phrases import QUIET, automaton
from tidemark.workers import equip

#: The forms of fields in usual template languages, looked at where the automaton meets their first mark.
_FIELD = re.compile(
    r"\{\{\s*[A-Za-z_][\w.]*(?:\s*\|[^{}\n]*)?\s*\}\}|\{%\s*[\w.]+\s*%\}|[$#]\{\s*[A-Za-z_][\w.]*\s*\}|<%=?\s*[\w.]+\s*%>|<<\s*[A-Za-z_]\w*\s*>>|\[\[\s*[A-Za-z_]\w*\s*\]\]|@@\w+@@|%%\w+%%|\*\|\w+\|\*"
    r"|__[A-Z][A-Z0-9_]*?__|(?<![\w\\^_{$#])\{[A-Za-z_]\w+\}(?!\})|(?:\[[A-Z][A-Z_]{2,}\](?:\s*-\s*)?){2,}|:\s*_{4,}|:\s*\.{6,}\s*$|<(?:[Yy]our|[Ii]nsert|[Ee]nter|[Kk]urze|[Ii]hr|[Vv]otre|[Ss]u|[Ss]eu) [^<>\n]+>",
    re.M,
)
_ASIDE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\$\$.*?(?:\$\$|\n|\Z)|(?<!\$)\$(?=[^\s$])[^$\n{]+(?<=\S)\$(?!\d)|\"[^\"\n]*\"|“[^“”\n]*”|«[^«»\n]*»|「[^「」\n]*」|„[^„“”\n]*[“”]", re.S)
_SPECIFIC = re.compile(r"\S*[\d_/]\S*|[^\w\s]")
_UNIT = re.compile(r"(?<=[.!?。])\s+|\n+|(?<=[.!?。])(?=[一-鿿])")
_STATUS = re.compile(r"(?<![\d.,])[45]\d\d(?![\d.,]\d|\d)")
_FILE = re.compile(r"\w\.[a-z][a-z0-9]{1,7}(?![\w(])")
#: Share of a line's content that must be covered; of one that tells what befell a thing, in no fixed words; of one that only has an order and a
#: blank; and of its words that must be filler.
COVERED, TOLD, CLOSE, FILLED = 0.6, 0.75, 0.95, 0.6
#: So many words of filler, and so many repetitions, at least.
LATIN_WORDS, REPEATED = 6, 5
_CODE = re.compile(r"\w\(|\s[-+*/%]?=\s|\w\[")
#: Slots without which no frame is formed.
TELLING = {"reason", "fate", "word", "status", "script", "order", "own", "gap", "filler", "latin", "outline"}


def lower(text: str) -> str:
    """In lower case, every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def hits(low: str) -> list[tuple[int, int, frozenset]]:
    """Phrases in a text in lower case, as begin, end and slots: whole words only, where the script parts words."""
    out = []
    for end, (size, slots) in automaton().iter(low):
        a, b = end - size + 1, end + 1
        x, y = low[a], low[end]
        if a and x.isalpha() and x < "⺀" and low[a - 1].isalpha() and low[a - 1] < "⺀":
            continue
        if b < len(low) and y.isalpha() and y < "⺀" and low[b].isalpha() and low[b] < "⺀":
            continue
        out.append((a, b, slots))
    return out


def frame(line: str, found: list[tuple[int, int, frozenset]]) -> str:
    """The kind of residue whose frame the slots of a line form, or "". An error told behind a "when", or a line of code, is none."""
    slots = {x for _, _, s in found for x in s}
    if "script" in slots and "need" in slots:
        return "scripts"
    case = min((a for a, _, s in found if "case" in s), default=len(line))
    told = {x for a, _, s in found if a < case for x in s}
    if not _CODE.search(line):
        if "reason" in told:
            return "error"
        if "fate" in told and ("thing" in slots or "own" in slots or _FILE.search(line)):
            return "fate"
        if slots & {"word", "status"} and "case" not in slots and _STATUS.search(line):
            return "error"
    if "gap" in slots:
        return "prompt"
    if "blank" in slots and ("order" in slots and ("spot" in slots or "own" in slots) or "own" in slots and "spot" in slots):
        return "prompt"
    if "order" in slots and "blank" in slots:
        return "order"
    return ""


def covered(line: str, found: list[tuple[int, int, frozenset]]) -> float:
    """Share of a line's content that phrases cover; ``found`` are the phrases with places in the line."""
    marks = bytearray(len(line))
    for quiet in (True, False):
        for a, b, slots in found:
            if (slots <= QUIET) is quiet:
                marks[a:b] = (b"\3" if quiet else b"\1") * (b - a)
    for m in _SPECIFIC.finditer(line):
        marks[m.start() : m.end()] = b"\2" * (m.end() - m.start())
    content = [m for m, c in zip(marks, line) if m < 2 and not c.isspace()]
    return sum(content) / len(content) if content else float(1 in marks or any(not s <= QUIET for _, _, s in found))


def _filler(line: str, found: list) -> bool:
    """Latin filler words in any order, or one filler word again and again."""
    latin = [(a, b) for a, b, s in found if "latin" in s]
    letters = sum(c.isalpha() for c in line)
    if len(latin) >= LATIN_WORDS and sum(b - a for a, b in latin) >= FILLED * letters:
        return True
    again: dict[str, list] = {}
    for a, b, s in found:
        if "filler" in s:
            again.setdefault(line[a:b], []).append((a, b))
    return any(len(places) >= (REPEATED if p < "⺀" else REPEATED - 1) and sum(b - a - p.count(" ") for a, b in places) >= 0.8 * letters for p, places in again.items())


def residue_in(cell: str) -> tuple[str, int]:
    """The kind of the first residue in a text cell (``placeholder``, ``filler``, ``prompt``, ``error``, ``scripts``), or "", and the number of characters that residue takes of it."""
    cell = _ASIDE.sub(" ", HTML_TAG.sub("\n", cell) if "<" in cell else cell)
    low = lower(cell)
    found = hits(low)
    kinds: list[tuple[int, str, int]] = []
    for a, _, slots in found:
        if "mark" in slots and (m := _FIELD.match(cell, a)):
            kinds.append((a, "placeholder", m.end() - a))
    telling = sorted({a for a, _, slots in found if not slots.isdisjoint(TELLING)})
    if telling:
        cuts = [0, *(m.end() for m in _UNIT.finditer(cell)), len(cell) + 1]
        found.sort(key=lambda h: h[:2])
        starts = [h[0] for h in found]
        outline = []
        for n in sorted({bisect_right(cuts, a) - 1 for a in telling}):
            begin, line = cuts[n], low[cuts[n] : cuts[n + 1]]
            mine = [(a - begin, b - begin, s) for a, b, s in found[bisect_right(starts, begin - 1) : bisect_right(starts, begin + len(line) - 1)] if b <= begin + len(line)]
            slots = {x for _, _, s in mine for x in s}
            kind = frame(line, mine)
            if "outline" in slots and any(c.isdigit() for c in line) and all("outline" in s for _, _, s in mine if not s <= QUIET) and covered(line, mine) == 1:
                outline.append((begin, {line[a:b] for a, b, s in mine if "outline" in s}))
            if ("latin" in slots or "filler" in slots) and _filler(line, mine):
                kind = "filler"
            elif kind == "order":
                first = min(a for a, _, s in mine if not s <= QUIET)
                kind = "prompt" if any("order" in s for a, _, s in mine if a == first) and covered(line, mine) >= CLOSE else ""
            elif kind == "fate":
                kind = "error" if covered(line, mine) >= TOLD else ""
            elif kind and covered(line, mine) < COVERED:
                kind = ""
            if kind:
                kinds.append((begin, kind, len(line.strip())))
        if len(outline) > 1 and len(set().union(*(words for _, words in outline))) > 1:
            kinds.append((outline[0][0], "prompt", sum(len(w) for _, words in outline for w in words)))
    return (min(kinds)[1], sum(k[2] for k in kinds)) if kinds else ("", 0)


def residue(text: str | None, types: list | None, starts: list | None) -> tuple[int, int, str, float]:
    """Number of text cells, of those with residue, the kind of the first, and the share of the text cells' characters that is residue, of one document.

    A text without any cell of its own is looked at as a whole.
    """
    if not text:
        return 0, 0, "", 0.0
    cells = list(text_cells(text, types, starts))
    if not cells and types is None:
        cells = [text]
    found = [residue_in(c) for c in cells]
    hit = [k for k, _ in found if k]
    size = sum(len(c.strip()) for c in cells)
    return len(cells), len(hit), hit[0] if hit else "", min(1.0, sum(n for _, n in found) / size) if size else 0.0


_COLUMNS = ("cells", pa.int32()), ("residue_cells", pa.int32()), ("kind", pa.string()), ("coverage", pa.float64())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [residue(t.as_py(), k.as_py(), s.as_py()) for t, k, s in zip(batch.column(1), batch.column(2), batch.column(3))]
        columns = [pa.array([f[i] if name != "kind" else f[i] or None for f in found], kind) for i, (name, kind) in enumerate(_COLUMNS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *(name for name, _ in _COLUMNS)])


def scan_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", types: str = "cell_types", starts: str = "cell_starts") -> DataFrame:
    """One row per document: its id, ``cells``, ``residue_cells``, ``kind`` (NULL: no residue, a NULL or empty text included) and ``coverage``.

    ``coverage`` is the share of the characters of its text cells that is residue; a corpus that keeps documents with a little of it filters by that.
    Whole texts are read; rows are neither shuffled nor kept. What stands in code or output cells, in
    quotation marks or code marks, or in a formula isn't looked at, and a phrase inside a sentence about it
    covers too little of that sentence to count.
    """
    equip(documents.sparkSession)
    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(doc_id, text, types, starts).mapInArrow(_scan, f"id {kind}, cells int, residue_cells int, kind string, coverage double")
    return rows.withColumnRenamed("id", doc_id)
