"""Evaluation passages inside training texts: a q-gram filter over diagonal bands, then banded alignment.

Both sides are brought to one line of lower-case words. A stretch of 16 words with at most one word in five
changed keeps a known number of its character q-grams, all close to one diagonal. Diagonals are counted in words: the
number of the word in which a q-gram begins, in the text less in the passage. So a word added, dropped or replaced shifts
the diagonal by one at most, however long it is. For every document and item the shared q-grams are counted in
overlapping bands of diagonals, the bands that reach the bound are kept, and around the diagonals of their q-grams the
words are aligned to see whether the stretch is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.normal import words_line
from tidemark.workers import equip

Q = 8
LEAST_WORDS, EDITS_IN = 16, 5
#: A stretch can be cut into parts of 16 to 31 words of which one has at most one word in five edited, so six edits at most, and four
#: equal words in a row among them. So some q-gram of that part lies on a diagonal from which the part strays by six words at most.
MOST_WORDS, REACH = 2 * LEAST_WORDS - 1, 6
#: Width of a band in words. Bands overlap by half, so the seven neighbouring diagonals of a part lie in one of them.
BAND = 2 * (REACH + 1)
#: Blocks of passages that are searched in one scan of the documents.
BLOCKS = 16
SLICE = 1 << 20
#: Bytes of a text whose q-grams are made at once.
PIECE = 1 << 22
_HASH = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def qgrams(line: np.ndarray) -> np.ndarray:
    """The q-gram at each byte of a line, as one 64-bit number."""
    n = len(line) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for shift in range(min(Q, n)):
        count = (n - shift + Q - 1) // Q
        out[shift::Q] = np.frombuffer(line[shift : shift + count * Q].tobytes(), np.uint64)
    return out


def least_shared(words: list[bytes]) -> int:
    """Q-grams that any part of 16 to 31 words shares with a copy of it that has one word in five changed, at least.

    A changed word takes with it the q-grams that touch it: its length plus q. Neighbouring changed words take less between
    them, an added word fewer than q; q-grams that occur twice count twice on both sides. Four equal words in a row keep one.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    least = None
    for n in range(LEAST_WORDS, min(MOST_WORDS, len(sizes)) + 1):
        part = -np.sort(-np.lib.stride_tricks.sliding_window_view(sizes, n), axis=1)
        edits = n // EDITS_IN
        shared = int((part.sum(axis=1) - part[:, :edits].sum(axis=1)).min()) + n + 1 - Q + 1 - edits * Q
        least = shared if least is None else min(least, shared)
    return max(1, least or 1)


@dataclass
class Passages:
    """An index over the passages of a block of items."""

    ids: list
    words: list[list[bytes]]
    grams: np.ndarray  # distinct q-grams, sorted
    start: np.ndarray  # per distinct q-gram, where its places begin; one more at the end
    item: np.ndarray  # per place
    word: np.ndarray  # per place, the number of the word in which it lies
    least: np.ndarray  # per item
    filter: np.ndarray  # bit table of hashed q-grams
    vocabulary: dict[bytes, int]
    coded: list[np.ndarray]  # per item, its words as numbers

    @classmethod
    def of(cls, rows: list[tuple]) -> Passages:
        lines = [words_line(p) for _, p in rows]
        words = [x.tobytes().split() for x in lines]
        per = [qgrams(x) for x in lines]
        gram = np.concatenate(per) if per else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(per)), [len(g) for g in per])
        word = np.concatenate([word_numbers(x)[: len(g)] for x, g in zip(lines, per)]) if per else np.empty(0, np.int32)
        order = np.argsort(gram, kind="stable")
        grams, start = np.unique(gram[order], return_index=True)
        table = np.zeros(1 << _BITS, bool)
        table[_hashed(grams)] = True
        vocabulary: dict[bytes, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for ws in words]
        least = np.array([least_shared(w) for w in words], np.int64)
        return cls([i for i, _ in rows], words, grams, np.append(start, len(gram)), item[order].astype(np.int32), word[order].astype(np.int32), least, table, vocabulary, coded)


def word_numbers(line: np.ndarray) -> np.ndarray:
    """Number of the word that a byte of a line belongs to; a blank belongs to the word after it."""
    return np.cumsum(line == 32, dtype=np.int32) - 1


def _hashed(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((grams * _HASH) >> np.uint64(64 - _BITS)).astype(np.int64)


def candidates(line: np.ndarray, index: Passages) -> dict[int, np.ndarray]:
    """Per item whose q-grams a line shares in sufficient number within a band: the diagonals on which they lie."""
    hits = [_known(line[a : a + PIECE + Q - 1], a, index) for a in range(0, len(line), PIECE)]
    at, found = (np.concatenate(x) for x in zip(*hits))
    if len(at) < max(1, index.least.min()):
        return {}
    at = word_numbers(line)[at]
    many = index.start[found + 1] - index.start[found]
    # in slices of places, so that a text that repeats a much shared phrase can't fill the memory with them
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(many) // SLICE)) + 1).tolist(), len(at)]
    slices = [(at[a:b], found[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
    parts = [_counted(*_places(*x, index)) for x in slices]
    key, count = parts[0] if len(parts) == 1 else _combined(*(np.concatenate(x) for x in zip(*parts)))
    enough = key[count >= index.least[key >> 40]]
    if len(enough) == 0:
        return {}
    out: dict[int, list[np.ndarray]] = {}
    for x in slices:
        item, diagonal = _places(*x, index)
        here = _within(_bands(item, diagonal, 0), enough) | _within(_bands(item, diagonal, 1), enough)
        kept = np.unique(item[here] << 40 | (diagonal[here] + (1 << 36)))
        for i in np.unique(kept >> 40).tolist():
            out.setdefault(i, []).append((kept[kept >> 40 == i] & ((1 << 40) - 1)) - (1 << 36))
    return {i: np.unique(np.concatenate(ds)) for i, ds in sorted(out.items())}


def _known(piece: np.ndarray, start: int, index: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Places of a piece's q-grams that some item has, and their numbers in the index."""
    grams = qgrams(piece)
    at = np.flatnonzero(index.filter[_hashed(grams)])
    found = np.searchsorted(index.grams, grams[at])
    found[found == len(index.grams)] = 0
    real = index.grams[found] == grams[at]
    return at[real] + start, found[real]


def _within(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    at = np.searchsorted(some, keys)
    at[at == len(some)] = 0
    return some[at] == keys


def _places(word: np.ndarray, found: np.ndarray, index: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Item and diagonal of each q-gram of the text with each of its places in the items; ``word`` is where it lies in the text."""
    many = index.start[found + 1] - index.start[found]
    where = np.repeat(word, many)
    within = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
    hit = np.repeat(index.start[found], many) + within
    return index.item[hit].astype(np.int64), where.astype(np.int64) - index.word[hit]


def _bands(item: np.ndarray, diagonal: np.ndarray, which: int) -> np.ndarray:
    """Item and band of each diagonal; every diagonal lies in two bands, which overlap by half."""
    return (item << 40) | ((diagonal + (1 << 36) + which * (BAND // 2)) // BAND * 2 + which)


def _counted(item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of shared q-grams per item and band."""
    key, count = np.unique(np.concatenate([_bands(item, diagonal, 0), _bands(item, diagonal, 1)]), return_counts=True)
    return key, count


def _combined(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(key, return_inverse=True)
    return key, np.bincount(back, weights=count).astype(np.int64)


def stretch_on(p: np.ndarray, t: np.ndarray, diagonals: np.ndarray) -> bool:
    """Whether 16 or more consecutive words of p recur in t, near one of the diagonals, with at most one in five edited.

    p and t are words as numbers, -1 for words that no item has. First, for all diagonals at once: the words
    of p that meet their like anywhere in the band must be enough. What is left is aligned.
    """
    n, m = len(p), len(t)
    if n < LEAST_WORDS:
        return False
    padded = np.full(m + 2 * (n + REACH) + 1, -2, np.int64)
    padded[n + REACH : n + REACH + m] = t
    chunk = max(1, (1 << 21) // (n * (2 * REACH + 1)))
    for c in range(0, len(diagonals), chunk):
        part = diagonals[c : c + chunk]
        part = part[(part > -n) & (part < m)]
        met = np.zeros((len(part), n), bool)
        for lane in range(-REACH, REACH + 1):
            met |= padded[(part + lane + n + REACH)[:, None] + np.arange(n)] == p
        total = np.concatenate([np.zeros((len(part), 1), np.int64), np.cumsum(np.where(met, 1, 1 - EDITS_IN), axis=1)], axis=1)
        lowest = np.minimum.accumulate(total[:, : n + 1 - LEAST_WORDS], axis=1)
        for d in part[(total[:, LEAST_WORDS:] >= lowest).any(axis=1)]:
            if _aligned_on(p, padded, m, int(d)):
                return True
    return False


def _aligned_on(p: np.ndarray, padded: np.ndarray, m: int, middle: int) -> bool:
    """Banded alignment around one diagonal.

    For every first word of a stretch and every lane of the band the best value of "words - 5 * edits" is carried
    forward word by word; a stretch is there when the value isn't negative after 16 words or more. It begins and
    ends with words that recur. Replaced and dropped words count among its words, added ones don't.
    """
    n, never = len(p), -(10**6)
    lanes = np.arange(middle - REACH, middle + REACH + 1)
    score = np.full((n, len(lanes)), never, np.int64)
    given = EDITS_IN * np.arange(len(lanes))
    for i in range(n):
        hit = padded[(i + lanes + n + REACH).clip(0, len(padded) - 1)] == p[i]
        inside = (i + lanes >= 0) & (i + lanes < m)
        score[i] = np.where(hit, 0, never)
        live = score[: i + 1]
        met = np.where(hit, live + 1, never)
        if i + 1 >= LEAST_WORDS and (met[: i + 2 - LEAST_WORDS] >= 0).any():
            return True
        step = np.maximum(met, np.where(inside, live + 1 - EDITS_IN, never))  # the word met, or replaced
        step[:, :-1] = np.maximum(step[:, :-1], live[:, 1:] + 1 - EDITS_IN)  # dropped: the next word meets this place
        step = np.maximum.accumulate(step + given, axis=1) - given  # added, as many in a row as the band holds
        step[step < (1 - EDITS_IN) * n] = never
        score[: i + 1] = step
    return False


def leaked_items(text: str | None, *blocks: Passages) -> list:
    """Ids of the items whose passage the text holds, wholly or partly."""
    if not text or not any(b.ids for b in blocks):
        return []
    line, words, out = words_line(text), None, []
    for index in blocks:
        found = candidates(line, index) if index.ids else {}
        if found:
            words = words or line.tobytes().split()
            coded = np.array([index.vocabulary.get(w, -1) for w in words], np.int64)
            out += [index.ids[i] for i, diagonals in found.items() if stretch_on(index.coded[i], coded, diagonals)]
    return out


def _searcher(blocks: list, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = [b.value for b in blocks]
        for batch in batches:
            docs, items = [], []
            for d, text in zip(batch.column(0), batch.column(1)):
                for i in leaked_items(text.as_py(), *passages):
                    docs.append(d.as_py())
                    items.append(i)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(items, item_type)], names=["doc", "item"])

    return run


def _blocks(items: DataFrame, item_id: str, passage: str, characters: int) -> Iterator[list[tuple]]:
    """Items with an id and a passage, in blocks whose passages have about as many characters."""
    block, size = [], 0
    for row in items.select(item_id, passage).toLocalIterator():
        if row[0] is not None and row[1]:
            block.append((row[0], row[1]))
            size += len(row[1])
            if size >= characters:
                yield block
                block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", block_characters: int = 2_000_000, blocks_a_scan: int = BLOCKS) -> DataFrame:
    """Pairs of a document and an item whose passage (16 words of it or more) the document's text holds.

    Whole texts are searched; documents are neither shuffled nor compared with each other. The items are the
    stated query set. They are indexed in blocks of about ``block_characters`` of their passages, and a block's index,
    some 16 bytes a character, is what is broadcast: it has a bound whatever the number of items. One scan searches ``blocks_a_scan``
    blocks, each text brought to words once for all of them, so passages of 32 million characters take one scan of the corpus.
    NULL or short passages and NULL texts match nothing; a repeated document or item gives its pairs once per row.
    """
    doc_kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType
    spark = documents.sparkSession
    equip(spark)
    texts = documents.select(doc_id, text)
    blocks = [spark.sparkContext.broadcast(Passages.of(b)) for b in _blocks(items, item_id, passage, block_characters)]
    out = texts.filter("false").select(doc_id, F.lit(None).cast(item_kind).alias(item_id))
    for a in range(0, len(blocks), blocks_a_scan):
        part = texts.mapInArrow(_searcher(blocks[a : a + blocks_a_scan], to_arrow_type(item_kind)), f"`{doc_id}` {doc_kind}, `{item_id}` {item_kind.simpleString()}")
        out = part if a == 0 else out.unionByName(part)
    return out
