"""Suffix order by external induced sorting, as a second opinion on repeats and to measure the method.

Suffix tuples carry the symbols before them, so that no step needs random access to the text: substrings
between leftmost smaller suffixes are sorted in runs on disk and named, names that repeat are ordered by
recursion, and two passes over disk-backed priority queues induce the larger and the smaller suffixes.
Only the order is made here; common-prefix values would be carried on top of it.
"""

import heapq
import itertools
import pickle
import tempfile

CHUNK = 1000


class Runs:
    """Records in runs on disk, read back in order (sorted) or as written, either way round."""

    def __init__(self, folder, memory, ordered):
        self.folder, self.memory, self.ordered = folder, memory, ordered
        self.rows, self.runs, self.bytes = [], [], 0

    def add(self, row):
        self.rows.append(row)
        if len(self.rows) >= self.memory:
            self.flush()

    def flush(self):
        if self.rows:
            self.runs.append(write(self.folder, sorted(self.rows) if self.ordered else self.rows))
            self.bytes += self.runs[-1][0].tell()
            self.rows = []

    def __iter__(self):
        self.flush()
        found = [read(*run) for run in self.runs]
        return heapq.merge(*found) if self.ordered else itertools.chain(*found)

    def backwards(self):
        self.flush()
        return itertools.chain(*(read(*run, back=True) for run in reversed(self.runs)))


def write(folder, rows):
    file, places = tempfile.TemporaryFile(dir=folder), []
    for at in range(0, len(rows), CHUNK):
        places.append(file.tell())
        pickle.dump(rows[at : at + CHUNK], file, -1)
    return file, places


def read(file, places, back=False):
    for place in reversed(places) if back else places:
        file.seek(place)
        rows = pickle.load(file)
        yield from reversed(rows) if back else rows


class Queue:
    """A priority queue that keeps at most `memory` rows and the heads of its runs in memory."""

    def __init__(self, folder, memory):
        self.folder, self.memory, self.heap, self.heads, self.bytes = folder, memory, [], [], 0

    def push(self, row):
        heapq.heappush(self.heap, row)
        if len(self.heap) > self.memory:
            self.heap.sort()
            run = write(self.folder, self.heap[self.memory // 2 :])
            self.bytes += run[0].tell()
            del self.heap[self.memory // 2 :]
            self._head(read(*run))

    def _head(self, rows):
        row = next(rows, None)
        if row is not None:
            heapq.heappush(self.heads, (row, id(rows), rows))

    def _from_run(self):
        return bool(self.heads) and (not self.heap or self.heads[0][0] < self.heap[0])

    def top(self):
        if self._from_run():
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self):
        if not self._from_run():
            return heapq.heappop(self.heap)
        row, _, rows = heapq.heappop(self.heads)
        self._head(rows)
        return row


def suffix_order(symbols, n, folder, memory=1 << 18, moved=None):
    """Yield the places of the suffixes of n integers from 0 up, in order; symbols gives them from the right.

    What the runs and queues have written is appended to moved, as objects with their bytes.
    """
    moved = [] if moved is None else moved
    parts, seeds = Runs(folder, memory, True), Runs(folder, memory, False)
    at, place, first, chars, codes, k = n, n, -1, [], [], 0
    after, smaller = -1, True
    for c in symbols:
        at -= 1
        c_smaller = c < after or (c == after and smaller)
        if smaller and not c_smaller and at + 1 < n:
            k += 1
            seeds.add((first, place, tuple(chars)))
            parts.add(((*reversed(codes), 2 * first + 1), k))
            place, first, chars, codes = at + 1, after, [], []
        chars.append(c)
        codes.append(2 * c + c_smaller)
        after, smaller = c, c_smaller
    seeds.add((first, place, tuple(chars)))

    named, name, last = Runs(folder, memory, True), -1, None
    for part, j in parts:
        name, last = name + (part != last), part
        named.add((j, name))
    ranks = named
    if name + 1 < k:
        ranks = Runs(folder, memory, True)
        for rank, x in enumerate(suffix_order((name for _, name in named), k, folder, memory, moved)):
            ranks.add((k - x, rank))
    ranked = Runs(folder, memory, True)
    for seed, (_, rank) in zip(seeds, itertools.chain([(0, -1)], ranks)):
        ranked.add((rank, *seed))

    queue, larger, count = Queue(folder, memory), Runs(folder, memory, False), 0
    rows = iter(ranked)
    seed = next(rows, None)
    while seed or queue.top():
        count += 1
        if seed and (queue.top() is None or queue.top()[0] > seed[1]):
            _, _, place, rest = seed
            if rest:
                queue.push((rest[0], count, place - 1, rest[1:]))
            seed = next(rows, None)
            continue
        c, _, place, rest = queue.pop()
        if rest and rest[0] >= c:
            queue.push((rest[0], count, place - 1, rest[1:]))
            rest = ()
        larger.add((c, place, rest))

    down, order = Queue(folder, memory), Runs(folder, memory, False)
    rows = larger.backwards()
    row = next(rows, None)
    while row or down.top():
        count += 1
        if row and (down.top() is None or -down.top()[0] < row[0]):
            _, place, rest = row
            row = next(rows, None)
        else:
            _, _, place, rest = down.pop()
        order.add(place)
        if rest:
            down.push((-rest[0], count, place - 1, rest[1:]))
    moved += [parts, seeds, named, ranked, queue, larger, down, order, *([ranks] if ranks is not named else [])]
    yield from order.backwards()
