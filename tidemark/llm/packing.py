"""Filling containers of fixed capacity by multiway differencing.

Documents are packed in blocks, each block within one task as its rows stream by: nothing is shuffled, and a
task holds one block of sizes at a time. A block's documents are divided into k windows of nearly equal
fill by the differencing method of Karmarkar and Karp. A window that still exceeds the capacity is differenced anew together
with one that has room, now completely: difference or sum of the two largest, until a division is found that both fit.
k starts at a lower bound of the windows needed and rises for as long as some window exceeds the capacity.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.workers import equip

#: Fixed value: the project's tokens.
TOKEN = r"[A-Za-z0-9_]{1,8}|[^A-Za-z0-9_ \t\r\n]"
BLOCK = 1024
#: Steps of a complete differencing of two windows.
TRIES = 256


def token_count(text: Column) -> Column:
    """Number of tokens of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """k windows (total, indices of ``sizes``) of nearly equal total; empty ones are left out.

    A partial division is a descending list of window totals, windows beyond its end being empty. The two
    with the widest spread are merged, largest windows of one with the smallest of the other, so that their
    imbalances oppose each other.
    """
    heap = [(-s, i, [(-s, i, (i, None))]) for i, s in enumerate(sizes)]  # totals negative: ascending is largest first
    heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heappop(heap)
        _, _, b = heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        if len(a) + len(b) <= k:
            if len(b) == 1:
                insort(a, b[0])
            else:
                a = sorted(a + b)
        else:
            free = k - len(b)  # windows of a that meet empty ones of b
            met = [(x[0] + y[0], min(x[1], y[1]), (x[2], y[2])) for x, y in zip(a[free:], reversed(b))]
            a = sorted(a[:free] + met + list(reversed(b))[len(a) - free :])
        spread = a[0][0] - (a[-1][0] if len(a) == k else 0)
        heappush(heap, (spread, tie, a))
        tie += 1
    return [(-total, _members(tree)) for total, _, tree in heap[0][2]] if heap else []


def _members(tree: tuple) -> list[int]:
    """Indices in a tree whose leaves are (index, None)."""
    out, stack = [], [tree]
    while stack:
        left, right = stack.pop()
        if right is None:
            out.append(left)
        else:
            stack += [left, right]
    return out


def windows_needed(sizes: list[int], capacity: int) -> int:
    """A lower bound: by total, and for each size a by the items too large to meet one of size a or more.

    Items above ``capacity - a`` stand alone; those above half stand apart from each other; what they leave
    must take the items from a to half.
    """
    ordered = sorted(sizes, reverse=True)
    half = [s for s in ordered if 2 * s > capacity]
    best = max(-(-sum(sizes) // capacity), len(half))
    small = [s for s in ordered if 2 * s <= capacity]
    held = 0
    j, room, fitting = len(half), 0, 0
    i = len(half) - 1  # grow the set of large items that leave at least a
    for s in small:
        held += s
        while i >= 0 and half[i] <= capacity - s:
            room += capacity - half[i]
            fitting += 1
            i -= 1
        best = max(best, j + max(0, -(-(held - room) // capacity)))
    return best


def parted(sizes: list[int], least: int, most: int) -> list[bool] | None:
    """A division of ``sizes`` in two of which one has a total from ``least`` to ``most``: for each size whether it is in that one.

    Complete differencing: of the two largest the difference goes on (they part) or the sum (they stay together), in that order, and
    what can't end well is cut off. None if there is no such division, or none within ``TRIES`` steps.
    """
    total = sum(sizes)
    low, high = 2 * least - total, 2 * most - total  # where the difference must lie, or its negative
    a0, b0 = (low, high) if low >= 0 else (0, high)
    a1, b1 = (-high if high < 0 else 0, -low)
    stack = [(total, sorted([(s, i, None, None) for i, s in enumerate(sizes)]))]  # size, index or sign, and the two it was made of
    for _ in range(TRIES):
        if not stack:
            return None
        whole, nodes = stack.pop()
        a = nodes[-1]
        if len(nodes) == 1:
            d = a[0]
            if a0 <= d <= b0 or a1 <= d <= b1:
                sides = _sides(a, len(sizes))
                first = sum([s for s, x in zip(sizes, sides) if x])
                return sides if least <= first <= most else [not x for x in sides]
            continue
        b = nodes[-2]
        x, y = a[0], b[0]
        # what is left can end with any difference from the largest less the others (or none) up to all of them
        less, more = whole - 2 * y, whole
        nearest = 2 * (x - y) - less
        far = 2 * (x + y) - more
        if far <= b0 and more >= a0 or far <= b1 and more >= a1:
            rest = nodes[:-2]
            rest.append((x + y, -2, a, b))
            stack.append((more, rest))
        if nearest <= b0 and less >= a0 or nearest <= b1 and less >= a1:
            rest = nodes[:-2]
            insort(rest, (x - y, -1, a, b), key=_size)
            stack.append((less, rest))
    return None


def _size(node: tuple) -> int:
    return node[0]


def _sides(node: tuple, n: int) -> list[bool]:
    out, stack = [False] * n, [(node, True)]
    while stack:
        (_, i, a, b), first = stack.pop()
        if i >= 0:
            out[i] = first
        else:
            stack += [(a, first), (b, first if i == -2 else not first)]
    return out


def filled(windows: list[tuple[int, list[int]]], sizes: list[int], capacity: int, slack: int) -> tuple[list[list[int]], list[int]]:
    """Windows that are full to within ``slack``, and the items of the others.

    Each window that isn't full is differenced anew with another, such that one of the two becomes full; what is left of them is a window
    that goes on looking.
    """
    full, open_ = [], []
    for w in windows:
        (full if capacity - slack <= w[0] <= capacity else open_).append(w)
    open_.sort()
    left: list[int] = []
    while open_:
        total, items = open_.pop()
        for n, (_, more) in enumerate(open_):
            both = items + more
            sides = parted([sizes[i] for i in both], capacity - slack, capacity)
            if sides:
                del open_[n]
                full.append((0, [i for i, s in zip(both, sides) if s]))
                rest = [i for i, s in zip(both, sides) if not s]
                total = sum(sizes[i] for i in rest)
                if capacity - slack <= total <= capacity:
                    full.append((total, rest))
                elif rest:
                    insort(open_, (total, rest))
                break
        else:
            left += items
    return [items for _, items in full], left


def fitted(windows: list[tuple[int, list[int]]], sizes: list[int], capacity: int) -> list[list[int]] | None:
    """Windows of which none exceeds the capacity: each that does is differenced anew with one that has room; None if some finds none."""
    over = sorted(w for w in windows if w[0] > capacity)
    free = sorted(w for w in windows if w[0] <= capacity)
    while over:
        total, items = over.pop()
        for n, (other, more) in enumerate(free):
            both = items + more
            sides = parted([sizes[i] for i in both], total + other - capacity, capacity) if total + other <= 2 * capacity else None
            if sides:
                del free[n]
                for side in (True, False):
                    part = [i for i, s in zip(both, sides) if s is side]
                    insort(free, (sum(sizes[i] for i in part), part))
                break
        else:
            return None
    return [items for _, items in free]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices, none above ``capacity``; every size must be at most ``capacity``.

    The sizes are divided by differencing into as many windows as the lower bound. If some exceed the capacity, windows are differenced anew
    by twos, those that come out full (to within 1/256) are kept, and the items of the others are divided again from their own
    lower bound. When that fills few windows more, the number of windows of the rest rises until none exceeds the capacity.
    """
    out: list[list[int]] = []
    rest = list(range(len(sizes)))
    few = False
    while rest:
        left = [sizes[i] for i in rest]
        k = max(windows_needed(left, capacity), 1)
        fit = fitted(differencing(left, k), left, capacity)
        while few and fit is None:
            k += 1
            fit = fitted(differencing(left, k), left, capacity)
        if fit is not None:
            return out + [[rest[i] for i in items] for items in fit if items]
        full, others = filled(differencing(left, k), left, capacity, capacity >> 8)
        few = 16 * len(full) < k
        out += [[rest[i] for i in items] for items in full]
        rest = [rest[i] for i in others]
    return out


def _packer(capacity: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        kind, ids, sizes = None, [], []

        def flush() -> pa.RecordBatch:
            nonlocal number
            rows: list[tuple] = []
            rest: list[tuple[int, int, int, int]] = []  # size, index, piece, first token
            for i, n in enumerate(sizes):
                for piece in range(n // capacity):
                    rows.append((number, i, piece, piece * capacity, capacity))
                    number += 1
                if n % capacity or not n:
                    rest.append((n % capacity, i, n // capacity, n - n % capacity))
            windows = pack([r[0] for r in rest], capacity)
            if sorted(j for w in windows for j in w) != list(range(len(rest))) or any(sum(rest[j][0] for j in w) > capacity for w in windows):
                raise RuntimeError("a piece was lost or a container overfilled")
            for window in windows:
                rows += [(number, rest[j][1], rest[j][2], rest[j][3], rest[j][0]) for j in window]
                number += 1
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([ids[r[1]] for r in rows], kind), *[pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]]
            ids.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays(columns, names=["container_id", "id", "piece", "first_token", "tokens"])

        for batch in batches:
            kind = batch.column(0).type
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                sizes.append(n)
                if len(ids) == block:
                    yield flush()
        if ids:
            yield flush()

    return run


def fill_containers(documents: DataFrame, id_column: str, size: Column, capacity: int, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document: ``container_id``, the id, ``piece``, ``first_token``, ``tokens``.

    A document larger than ``capacity`` fills containers of its own with its first tokens, and what remains is
    packed like any document; no other is split. A document without tokens lies in some container with 0 tokens. Rows are taken as they are: a repeated or NULL id is packed each time it occurs. Containers
    hold documents of one block only, so at most a container's worth of room is lost per block to that. It is an error if
    a piece is lost or a container overfilled.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    equip(documents.sparkSession)
    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.select(F.col(id_column).alias("id"), size.alias("tokens"))
    packed = rows.mapInArrow(_packer(capacity, block), f"container_id bigint, id {kind}, piece bigint, first_token bigint, tokens bigint")
    return packed.withColumnRenamed("id", id_column)
