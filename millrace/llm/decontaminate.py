"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring tokens; tokens under a 0 are ignored, so a substituted word
leaves the seeds that skip it whole. Seeds of the benchmark and of the documents are joined on their
hashes; around every hit the two texts are compared word by word on the same diagonal, and the best
run (a match counts 1, a substitution -2) is reported when it has enough matching words.

The benchmark side is cut into blocks of bounded size; every block's index goes to the executors and
all documents are read against it, so memory does not follow the benchmark and no text is shuffled.
Hits of a seed are expanded a bounded number at a time and kept as distinct diagonals, so that words
which repeat many times on both sides cost time but no memory.

Tokens are runs of letters, digits and non-ASCII characters, A to Z as lower case; kana and Han
characters are a token each. Defined cases: null or empty texts have no tokens and no leaks; an item
shorter than the longest mask has no seeds of that mask, one shorter than all masks none (it can't be
told from chance); repeated items and documents are reported each; of equally good overlaps of a document and
an item the first is reported; a null id is reported as it is; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import keep_rows, map_texts
from millrace.llm.hashing import ALPHANUMERIC, Words, hash_words, mix

#: The masks. The third skips every fifth token, the others different near ones.
MASKS = ("11111", "1101011", "1111011", "10110111")
#: Matching words that make a leak, or this share of the item where it is shorter.
LEAST_WORDS, LEAST_SHARE = 10, 0.8
SUBSTITUTION = -2
BLOCK_CHARS = 8_000_000
#: Pairs of places that hits are expanded to at a time.
EXPANDED = 4_000_000
SCHEMA = "doc_id long, item_id long, n_matched long, doc_start long, doc_end long, item_start long, item_end long"


def seeds(words: Words, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds and the positions where they begin, within texts only."""
    hashes, places = [], []
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for number, mask in enumerate(masks):
        n = len(words.hashes) - len(mask) + 1
        if n <= 0:
            continue
        found = np.full(n, number + 1, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                found = found * np.uint64(0x9E3779B97F4A7C15) + words.hashes[k : k + n]
        inside = text[:n] == text[len(mask) - 1 :]
        hashes.append(mix(found[inside]))
        places.append(np.flatnonzero(inside))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


@dataclass
class Index:
    """One block of the benchmark: its words, its seeds sorted by hash, and a bitmap of the seeds' upper bits."""

    ids: list
    words: Words
    hashes: np.ndarray
    places: np.ndarray
    bitmap: np.ndarray
    shift: int
    masks: tuple[str, ...]

    @classmethod
    def of(cls, ids: list, texts: list[bytes | None], masks: tuple[str, ...] = MASKS) -> Index:
        words = hash_words(texts, ALPHANUMERIC, single=True)
        hashes, places = seeds(words, masks)
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        bits = max(16, min(26, (64 * max(1, len(hashes))).bit_length()))
        bitmap = np.zeros(1 << bits, bool)
        bitmap[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        return cls(ids, words, hashes, places, bitmap, 64 - bits, masks)

    def _diagonals(self, own: Words, places: np.ndarray, low: np.ndarray, times: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, place in texts less place in items) of all hits, each once."""
        items, shift = len(self.words.first), len(self.words.hashes)
        span = shift + len(own.hashes) + 1
        keys = np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(times) - 1) // EXPANDED)) + 1
        for some in np.split(np.arange(len(places)), cuts):
            n = times[some]
            at = np.repeat(places[some], n)
            theirs = self.places[np.arange(n.sum()) + np.repeat(low[some] - (np.cumsum(n) - n), n)]
            item = np.searchsorted(self.words.first, theirs, "right") - 1
            text = np.searchsorted(own.first, at, "right") - 1
            keys = np.union1d(keys, (text * items + item) * span + (at - theirs + shift))
        pair, diagonal = np.divmod(keys, span)
        return list(zip((pair // items).tolist(), (pair % items).tolist(), (diagonal - shift).tolist(), strict=True))

    def leaks(self, texts: list[bytes | None]) -> list[tuple]:
        """(text, item, matched, doc_start, doc_end, item_start, item_end), one for each text and item."""
        own = hash_words(texts, ALPHANUMERIC, single=True)
        hashes, places = seeds(own, self.masks)
        may = self.bitmap[(hashes >> np.uint64(self.shift)).astype(np.int64)]
        hashes, places = hashes[may], places[may]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        times = high - low
        if not times.sum():
            return []
        hit = times > 0
        diagonals = self._diagonals(own, places[hit], low[hit], times[hit])
        best: dict[tuple[int, int], tuple] = {}
        for t, i, d in diagonals:
            a, b = max(int(self.words.first[i]), int(own.first[t]) - d), min(int(self.words.first[i + 1]), int(own.first[t + 1]) - d)
            same = self.words.hashes[a:b] == own.hashes[a + d : b + d]
            sums = np.concatenate([[0], np.cumsum(np.where(same, 1, SUBSTITUTION))])
            rise = sums - np.minimum.accumulate(sums)
            end = int(np.argmax(rise))
            begin = int(np.flatnonzero(sums[: end + 1] == sums[: end + 1].min())[-1])
            matched = int(same[begin:end].sum())
            size = int(self.words.first[i + 1] - self.words.first[i])
            if matched >= min(LEAST_WORDS, LEAST_SHARE * size):
                start = a + begin
                row = (matched, -(start + d - int(own.first[t])), start + d - int(own.first[t]), a + end + d - int(own.first[t]), start - int(self.words.first[i]), a + end - int(self.words.first[i]))
                best[t, i] = max(best.get((t, i), row), row)
        return [(t, i, row[0], *row[2:]) for (t, i), row in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, masks: tuple[str, ...], block_chars: int) -> Iterator[Broadcast]:
    """The benchmark as indexes of about block_chars characters each, sent to all workers."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = 1 + int(total) // block_chars
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").toArrow()
        index = Index.of(rows["i"].to_pylist(), [None if t is None else t.encode() for t in rows["t"].to_pylist()], masks)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, matching words and the spans (in words) of the best overlap of each pair that leaks."""
    found = None
    for shared in _blocks(benchmark, item_id_col, item_text_col, masks, block_chars):

        def per_slice(ids: list, texts: list[bytes | None], shared=shared) -> dict[str, list]:
            names = ("doc_id", "item_id", "n_matched", "doc_start", "doc_end", "item_start", "item_end")
            leaks = [(ids[t], shared.value.ids[i], *rest) for t, i, *rest in shared.value.leaks(texts)]
            return {name: [x[k] for x in leaks] for k, name in enumerate(names)}

        part = map_texts(docs, id_col, text_col, SCHEMA, per_slice)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns; each row is judged by its own text, whatever its id.

    All blocks of the benchmark are searched in one pass: what one block leaves goes to the next.
    """
    for shared in _blocks(benchmark, item_id_col, item_text_col, masks, block_chars):

        def clean(texts: list[bytes | None], shared=shared) -> list[bool]:
            bad = {t for t, *_ in shared.value.leaks(texts)}
            return [k not in bad for k in range(len(texts))]

        docs = keep_rows(docs, text_col, clean)
    return docs
