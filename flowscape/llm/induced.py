"""Suffix order of a shard by external induced sorting, with common-prefix values.

The shard's text is an array or a memory-mapped file that ends in its only least character.  Everything that
grows with it lies in files of the task (its own spill, removed with it) once it passes the memory
given; memory holds blocks.

1. Suffixes are of type L or S; the leftmost S suffixes of each run are the stars.  Types and
   stars are found block by block.
2. The stars' substrings are sorted by an external merge sort, some characters a round, only what is
   still equal going on.  The ranks in text order are the reduced string.
3. Where ranks repeat, the reduced string's suffixes are sorted by recursion, or by doubling once it
   fits in memory; their order is the order of the stars.
4. The stars are pushed through a priority queue of (character, arrival): popping all suffixes of
   the least character in order of arrival and pushing each one's predecessor puts the L suffixes in order; the same
   downwards from the greatest character gives the S suffixes.  The queue spills sorted runs.
5. Each tuple carries, beside its place, the length of the prefix it shares with the tuple before it (up
   to ``depth``): a predecessor shares one more than the least value passed since the last
   push to its character.  Neighbouring stars are compared directly; where L and S suffixes of
   one character meet, the shorter run of that character is shared.

``depth`` bounds the comparison: suffixes that agree on so many characters may come in any order.
"""

from __future__ import annotations

import heapq
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Bytes of memory for what is being sorted or moved.
MEMORY = 64 << 20


class Scratch:
    """Arrays of a task: in memory while small, else memory-mapped files that go with it."""

    def __init__(self, memory: int):
        self.memory, self.block = memory, max(64, min(1 << 16, memory // 256))
        self.folder: Path | None = None
        self.files = 0

    def path(self) -> Path:
        self.folder = self.folder or Path(tempfile.mkdtemp(prefix="flowscape-sort-"))
        self.files += 1
        return self.folder / str(self.files)

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory // 16:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class Column:
    """Numbers appended one block after another and read by place."""

    def __init__(self, scratch: Scratch, kind=np.int64):
        self.scratch, self.kind, self.parts, self.held, self.file, self.n = scratch, np.dtype(kind), [], 0, None, 0

    def append(self, block) -> None:
        self.parts.append(np.asarray(block, self.kind))
        self.held += self.parts[-1].nbytes
        self.n += len(block)
        if self.held > self.scratch.memory // 16:
            self.file = self.file or self.scratch.path().open("w+b")
            for part in self.parts:
                part.tofile(self.file)
            self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        if not self.file:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        for part in self.parts:
            part.tofile(self.file)
        self.parts, self.held = [], 0
        self.file.flush()
        return np.memmap(self.file.name, self.kind, "r", shape=(self.n,))


def _upto(columns: list[np.ndarray], pivot: list) -> int:
    """Rows of sorted columns that are not above the pivot."""
    low, high = 0, len(columns[0])
    for column, value in zip(columns[:-1], pivot[:-1], strict=True):
        part = column[low:high]
        low, high = low + int(np.searchsorted(part, value, "left")), low + int(np.searchsorted(part, value, "right"))
    if high == low:
        return low
    return low + int(np.searchsorted(columns[-1][low:high], pivot[-1], "right"))


def sorted_blocks(blocks: Iterator[tuple], keys: int, scratch: Scratch) -> Iterator[tuple]:
    """The rows of blocks (tuples of int64 columns) sorted by their first ``keys`` columns: runs of bounded
    memory are sorted and written, then merged block by block."""
    runs, held, size, width = [], [], 0, 0

    def order(columns: list[np.ndarray]) -> list[np.ndarray]:
        by = np.lexsort(columns[:keys][::-1])
        return [c[by] for c in columns]

    for block in blocks:
        width = len(block)
        held.append(block)
        size += sum(c.nbytes for c in block)
        if size > scratch.memory // 4:
            columns = [Column(scratch) for _ in range(width)]
            for c, values in zip(columns, order([np.concatenate(c) for c in zip(*held, strict=True)]), strict=True):
                c.append(values)
            runs.append([c.array() for c in columns])
            held, size = [], 0
    if held:
        runs.append(order([np.concatenate(c) for c in zip(*held, strict=True)]))
    at = [0] * len(runs)
    each = max(16, scratch.block // max(1, len(runs)))
    while True:
        heads, pivot = [], None
        for run, a in zip(runs, at, strict=True):
            head = [np.asarray(c[a : a + each]) for c in run]
            heads.append(head)
            if a + each < len(run[0]):
                last = [int(c[-1]) for c in head[:keys]]
                pivot = last if pivot is None else min(pivot, last)
        cut = [_upto(h[:keys], pivot) if pivot is not None and len(h[0]) else len(h[0]) for h in heads]
        if not sum(cut):
            return
        yield tuple(order([np.concatenate([h[c][:n] for h, n in zip(heads, cut, strict=True)]) for c in range(width)]))
        at = [a + n for a, n in zip(at, cut, strict=True)]


class Run:
    """Rows of a queue written in order of their characters, which are popped in that order."""

    def __init__(self, chars: np.ndarray, starts: np.ndarray, columns: list[np.ndarray]):
        self.chars, self.starts, self.columns, self.next = chars, starts, columns, 0

    def take(self, char: int) -> tuple[int, int] | None:
        if self.next == len(self.chars) or int(self.chars[self.next]) != char:
            return None
        self.next += 1
        return int(self.starts[self.next - 1]), int(self.starts[self.next])


class Queue:
    """A priority queue of (character, arrival): rows are popped by character, first in, first out.

    Rows lie in memory by character; beyond the memory given all of them are written as one run, sorted by
    character.  Older runs hold older rows."""

    #: Bytes of bookkeeping a piece.
    PIECE = 400

    def __init__(self, scratch: Scratch, down: bool, width: int):
        self.scratch, self.sign, self.width = scratch, -1 if down else 1, width
        self.live: dict[int, list] = {}
        self.held, self.heap, self.known = 0, [], set()
        self.runs: list[Run] = []

    def push(self, chars: np.ndarray, columns: list[np.ndarray]) -> None:
        """Rows in order of arrival."""
        if not len(chars):
            return
        by = np.argsort(chars, kind="stable")
        chars = chars[by]
        edge = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
        columns = [c[by] for c in columns]
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(chars)], strict=True):
            char = int(chars[a])
            # Copies, so that a piece doesn't keep its whole block.
            self.live.setdefault(char, []).append([c[a:b].copy() for c in columns])
            if char not in self.known:
                self.known.add(char)
                heapq.heappush(self.heap, self.sign * char)
        self.held += sum(c.nbytes for c in columns) + self.PIECE * len(edge)
        if self.held > self.scratch.memory // 4:
            self.spill()

    def spill(self) -> None:
        written, chars, starts = [Column(self.scratch) for _ in range(self.width)], sorted(self.live, key=lambda c: self.sign * c), [0]
        for char in chars:
            pieces = self.live.pop(char)
            starts.append(starts[-1] + sum(len(p[0]) for p in pieces))
            for k, column in enumerate(written):
                column.append(np.concatenate([p[k] for p in pieces]))
        self.runs = [r for r in self.runs if r.next < len(r.chars)]
        self.runs.append(Run(np.array(chars), np.array(starts), [c.array() for c in written]))
        self.live, self.held = {}, 0

    def first(self) -> int | None:
        """The next character, if any."""
        return self.sign * self.heap[0] if self.heap else None

    def pop(self, char: int) -> Iterator[list[np.ndarray]]:
        """Blocks of a character's rows; rows of it that are pushed meanwhile follow."""
        while True:
            # What is spilled is older than what is in memory.
            found = next(((run, span) for run in self.runs if (span := run.take(char))), None)
            if found:
                run, (a, b) = found
                for x in range(a, b, self.scratch.block):
                    yield [np.asarray(c[x : min(b, x + self.scratch.block)]) for c in run.columns]
            elif char in self.live:
                pieces = self.live.pop(char)
                rows = [np.concatenate([p[k] for p in pieces]) for k in range(self.width)]
                self.held -= sum(c.nbytes for c in rows) + self.PIECE * len(pieces)
                del pieces
                for x in range(0, len(rows[0]), self.scratch.block):
                    yield [c[x : x + self.scratch.block] for c in rows]
            else:
                break
        self.known.discard(char)
        heapq.heappop(self.heap)  # what was pushed meanwhile comes later


def _types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """1 where a suffix is of type S (smaller than the next one); the last is."""
    kinds, later = scratch.array(len(text), np.uint8), 1
    for a in reversed(range(0, len(text), scratch.block)):
        x = np.asarray(text[a : a + scratch.block]).astype(np.int64)
        y = np.asarray(text[a + 1 : a + scratch.block + 1]).astype(np.int64)
        if len(y) < len(x):
            y = np.append(y, x[-1])  # behind the last: equal, so that ``later`` holds
        place = np.where(x != y, np.arange(len(x)), len(x))
        place = np.minimum.accumulate(place[::-1])[::-1]
        less = np.append(x < y, later)
        kinds[a : a + len(x)] = less[place]
        later = int(kinds[a])
    return kinds


def _stars(kinds: np.ndarray, scratch: Scratch) -> np.ndarray:
    out = Column(scratch)
    for a in range(1, len(kinds), scratch.block):
        own, before = np.asarray(kinds[a : a + scratch.block]), np.asarray(kinds[a - 1 : a - 1 + scratch.block])
        out.append(np.flatnonzero((own == 1) & (before[: len(own)] == 0)) + a)
    return out.array()


def _ranks(text: np.ndarray, kinds: np.ndarray, stars: np.ndarray, depth: int, scratch: Scratch) -> tuple[np.ndarray, bool]:
    """How many stars have a smaller substring, in text order; whether all differ."""
    n, m = len(text), len(stars)
    top = max((int(np.max(text[a : a + scratch.block])) for a in range(0, n, scratch.block)), default=0)
    bits = (2 * top + 2).bit_length()
    per = max(1, 62 // bits)
    rank = scratch.array(m, np.int64)
    left, every, done, differ = None, True, 0, True
    while every or len(left):

        def rows():
            for a in range(0, m if every else len(left), scratch.block):
                own = np.arange(a, min(a + scratch.block, m)) if every else np.asarray(left[a : a + scratch.block])
                start = np.asarray(stars[own])
                end = np.where(own + 1 < m, np.asarray(stars[np.minimum(own + 1, m - 1)]), n - 1)
                key = np.zeros(len(own), np.int64)
                for j in range(done, done + per):
                    at = np.minimum(start + j, n - 1)
                    code = 1 + 2 * np.asarray(text[at]).astype(np.int64) + kinds[at]
                    key = (key << bits) | np.where(start + j <= end, code, 0)
                yield np.asarray(rank[own]), key, own

        again, last, before, base, first, i = Column(scratch), None, None, 0, 0, 0
        for r, k, own in sorted_blocks(rows(), 2, scratch):
            place = np.arange(i, i + len(r))
            # The first row of the old group and of the new one (the same key) a row stands in.
            head = np.concatenate(([before is None or r[0] != before[0]], r[1:] != r[:-1]))
            fresh = head | np.concatenate(([before is None or k[0] != before[1]], k[1:] != k[:-1]))
            base = np.maximum.accumulate(np.where(head, place, base))
            first = np.maximum.accumulate(np.where(fresh, place, first))
            rank[own] = r + first - base
            # Equal to the one before or behind: not told apart yet.
            if last is not None:
                again.append(last[: 1 if last[1] or not fresh[0] else 0])
            same = ~fresh
            with_next = np.append(same[1:], False)
            again.append(own[:-1][(same | with_next)[:-1]])
            last = np.array([own[-1], int(same[-1])])
            before, base, first, i = (r[-1], k[-1]), int(base[-1]), int(first[-1]), i + len(r)
        if last is not None and last[1]:
            again.append(last[:1])
        done, every = done + per, False
        left = again.array()
        if done > depth + 1:
            return rank, differ and not len(left)
        # Those whose substring is at its end stay equal.
        more = Column(scratch)
        for a in range(0, len(left), scratch.block):
            own = np.asarray(left[a : a + scratch.block])
            end = np.where(own + 1 < m, np.asarray(stars[np.minimum(own + 1, m - 1)]), n - 1)
            goes_on = np.asarray(stars[own]) + done <= end
            differ = differ and bool(goes_on.all())
            more.append(own[goes_on])
        left = more.array()
    return rank, differ


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a string in memory by doubling: rank of (own name, name some steps later); only
    what is still equal is ranked again."""
    order = np.argsort(names, kind="stable")
    rank, open_, step = np.empty(len(names), np.int64), order, 1
    rank[order] = np.searchsorted(names[order], names[order])
    while step <= depth and len(open_):
        own = rank[open_]
        later = np.where(open_ + step < len(rank), rank[np.minimum(open_ + step, len(rank) - 1)], -1)
        by = np.lexsort((later, own))
        place, own, later = open_[by], own[by], later[by]
        head = np.concatenate(([True], own[1:] != own[:-1]))
        fresh = head | np.concatenate(([True], later[1:] != later[:-1]))
        at = np.arange(len(by))
        rank[place] = own + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        open_ = place[~fresh | np.append(~fresh[1:], False)]
        step *= 2
    return np.argsort(rank, kind="stable")


def _star_order(text, kinds, stars, depth: int, scratch: Scratch) -> np.ndarray:
    """The stars' places in the order of their suffixes."""
    rank, differ = _ranks(text, kinds, stars, depth, scratch)
    out = Column(scratch)
    if differ:
        blocks = ((np.asarray(rank[a : a + scratch.block]), np.asarray(stars[a : a + scratch.block])) for a in range(0, len(stars), scratch.block))
        for _, place in sorted_blocks(blocks, 1, scratch):
            out.append(place)
    elif len(stars) <= scratch.memory // 64:
        out.append(np.asarray(stars[_doubled(np.asarray(rank), depth)]))
    else:
        # Every star but the last spans two characters at least.
        descending = Column(scratch)
        for own, _ in _descending(rank, depth // 2 + 1, scratch, False):
            descending.append(own)
        order = descending.array()
        for a in range(len(order), 0, -scratch.block):
            own = np.asarray(order[max(0, a - scratch.block) : a])[::-1]
            out.append(np.asarray(stars[own]))
    return out.array()


def _shared(text: np.ndarray, one: np.ndarray, other: np.ndarray, depth: int, each: int) -> np.ndarray:
    """Length of the prefix (up to depth) that the suffixes at two places share, for each pair,
    ``each`` pairs at a time."""
    n, out = len(text), np.zeros(len(one), np.int64)
    for first in range(0, len(one), each):
        open_, at = np.arange(first, min(first + each, len(one))), 0
        while len(open_) and at < depth:
            x, y = one[open_], other[open_]
            width = min(8 if at < 32 else 64, depth - at)
            step = np.arange(at, at + width)
            a, b = x[:, None] + step, y[:, None] + step
            same = (np.asarray(text[np.minimum(a, n - 1)]) == np.asarray(text[np.minimum(b, n - 1)])) & (a < n) & (b < n)
            whole = same.all(axis=1)
            out[open_] += np.where(whole, width, np.argmin(same, axis=1))
            open_, at = open_[whole], at + width
    return out


def _run(text: np.ndarray, place: int, depth: int) -> int:
    """How often the character at a place repeats from there."""
    part = np.asarray(text[place : place + depth])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _least(values: np.ndarray) -> list[np.ndarray]:
    """Tables of the least of 1, 2, 4 ... values from each place on."""
    tables, wide = [values], 1
    while 2 * wide <= len(values):
        last = tables[-1]
        tables.append(np.minimum(last[:-wide], last[wide:]))
        wide *= 2
    return tables


class _Carry:
    """Common-prefix values of the predecessors that a character's suffixes push."""

    def __init__(self, top: int, depth: int):
        self.depth, self.top = depth, top
        self.since = np.zeros(top + 1, np.int64)

    def start(self) -> None:
        """A new character: what was pushed before came from another one and shares no more than its own."""
        self.since[:] = 0

    def push(self, values: np.ndarray, place: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """values: of a block's suffixes, with the one before each; of them those at ``place`` push to ``chars``."""
        out = np.zeros(len(place), np.int64)
        tables = _least(values.astype(np.int32))
        if len(place):
            by = np.argsort(chars, kind="stable")
            at, c = place[by], chars[by].astype(np.int64)
            head = np.concatenate(([True], c[1:] != c[:-1]))
            low = np.where(head, 0, np.concatenate(([0], at[:-1] + 1)))
            got = _range(tables, low, at + 1)
            got = np.where(head, np.minimum(got, self.since[c]), got)
            out[by] = np.minimum(got + 1, self.depth)
        self.since = np.minimum(self.since, int(values.min()))
        if len(place):
            tail = np.append(head[1:], True)
            end, behind = c[tail], at[tail] + 1
            rest = np.full(len(end), self.depth, np.int64)
            some = behind < len(values)
            rest[some] = _range(tables, behind[some], np.full(int(some.sum()), len(values)))
            self.since[end] = rest
        return out


def _range(tables: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range [low, high)."""
    out = np.zeros(len(low), np.int64)
    level = np.frexp((high - low).astype(float))[1] - 1
    for k in np.unique(level).tolist():
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(tables[k][low[of]], tables[k][high[of] - (1 << k)])
    return out


def _descending(text: np.ndarray, depth: int, scratch: Scratch, shared: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (places, prefix shared with the suffix before it in this order), greatest suffix first."""
    n = len(text)
    kinds = _types(text, scratch)
    stars = _star_order(text, kinds, _stars(kinds, scratch), depth, scratch)
    top = max(int(np.max(text[a : a + scratch.block])) for a in range(0, n, scratch.block))
    width = 2 if shared else 1

    def spread(queue: Queue, carry: _Carry | None, own: np.ndarray, values: np.ndarray | None, kind: int, char: int, up: bool) -> None:
        at = np.flatnonzero(own > 0)
        before = own[at] - 1
        keep = np.asarray(kinds[before]) == kind
        c = np.asarray(text[before[keep]])
        # A star's or an L suffix's predecessor of the right type never belongs to a finished character.
        able = c >= char if up else c <= char
        at, before, c = at[keep][able], before[keep][able], c[able]
        queue.push(c, [before] if carry is None else [before, carry.push(values, at, c)])

    # L suffixes, upwards.
    queue, carry = Queue(scratch, False, width), _Carry(top, depth) if shared else None
    kept, kept_shared, s = Column(scratch), Column(scratch, np.int32), 0
    popped, begins = Column(scratch), Column(scratch)  # characters and where their L suffixes begin
    ahead = first_chars = stars[:0]

    def more_stars() -> None:
        nonlocal ahead, first_chars
        ahead = np.asarray(stars[s : s + scratch.block])
        first_chars = np.asarray(text[ahead])

    more_stars()
    while len(ahead) or queue.heap:
        star = int(first_chars[0]) if len(ahead) else None
        char = min(x for x in (star, queue.first()) if x is not None)
        if carry:
            carry.start()
        last, head = None, True
        if queue.first() == char:
            popped.append([char])
            begins.append([kept.n])
            for own, *values in queue.pop(char):
                if shared and head:
                    values[0] = np.append(0, values[0][1:])
                head, last = False, int(own[-1])
                kept.append(own)
                if shared:
                    kept_shared.append(values[0])
                spread(queue, carry, own, values[0] if shared else None, 0, char, True)
        previous = None
        while len(ahead) and first_chars[0] == char:
            end = int(np.searchsorted(first_chars, char, "right"))
            own, ahead, first_chars = ahead[:end], ahead[end:], first_chars[end:]
            values = None
            if shared:
                first = [own[0]] if previous is None else [previous]
                values = _shared(text, np.concatenate((first, own[:-1])), own, depth, max(16, scratch.block // 16))
                if previous is None:
                    values[0] = 0 if last is None else min(_run(text, last, depth), _run(text, int(own[0]), depth))
            previous = int(own[-1])
            # The predecessor of a star is an L suffix of a greater character.
            spread(queue, carry, own, values, 0, char, True)
            s += len(own)
            if not len(ahead):
                more_stars()
    lower, lower_shared = kept.array(), kept_shared.array()

    # S suffixes, downwards; each character's S suffixes come before its L suffixes.
    queue, carry = Queue(scratch, True, width), _Carry(top, depth) if shared else None
    begins.append([kept.n])
    chars, starts = popped.array(), begins.array()
    left = len(chars)
    while left or queue.heap:
        char = max(x for x in (int(chars[left - 1]) if left else None, queue.first()) if x is not None)
        if carry:
            carry.start()
        last, head = None, True
        if queue.first() == char:
            for own, *values in queue.pop(char):
                if shared and head:
                    values[0] = np.append(0, values[0][1:])
                head, last = False, int(own[-1])
                yield own, values[0] if shared else own
                spread(queue, carry, own, values[0] if shared else None, 1, char, False)
        if left and chars[left - 1] == char:
            left -= 1
            begin, end = int(starts[left]), int(starts[left + 1])
            for b in range(end, begin, -scratch.block):
                a = max(begin, b - scratch.block)
                own, values = np.asarray(lower[a:b])[::-1], None
                if shared:
                    # A value was kept with the suffix before, and is wanted with the one behind.
                    values = np.zeros(b - a, np.int64)
                    behind = np.asarray(lower_shared[a + 1 : min(b + 1, end)])[::-1]
                    values[len(values) - len(behind) :] = behind
                    if b == end:
                        values[0] = 0 if last is None else min(_run(text, last, depth), _run(text, int(own[0]), depth))
                yield own, values if shared else own
                spread(queue, carry, own, values, 1, char, False)
    # The end of the text is induced by nothing.
    yield np.array([n - 1]), np.zeros(1, np.int64)


def descending(text: np.ndarray, depth: int = 400, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (places, prefix shared with the one before): the suffixes of text (whole numbers,
    ending in the least), greatest first, exact on the first ``depth`` characters."""
    scratch = Scratch(memory)
    try:
        if len(text) == 1:
            yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        elif len(text):
            yield from _descending(text, depth, scratch)
    finally:
        scratch.close()
