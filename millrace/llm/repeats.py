"""Removal of byte strings of a given length that occur twice or more in the corpus.

Every window of `length` bytes has an anchor: the place in it of the gram of `GRAM` bytes with the
smallest hash. Equal windows have the same anchor at the same offset, so windows are compared only
with windows of the same anchor gram:

1. Neighbouring windows of one anchor form a range, a few for each kilobyte of text. Ranges whose
   gram no other range has hold no repeat.
2. Ranges with the same gram and the same bytes throughout repeat each other whole.
3. For the others, one of each kind is compared window by window with the rest of its gram's group,
   in one task. A group too large for that is split by the bytes that half of its windows have in
   common, again and again if need be, down to single windows, where equal keys are equal windows.
4. Repeats are joined back to all ranges of their kind, and their spans to the texts.

This is used in place of sorting all suffixes: see README. Windows, grams and ranges are compared by
64-bit hashes within groups of the same 64-bit gram hash; texts are known by 96 bits of hashes.

Defined cases: a null text is an empty one; texts shorter than the window have no repeats; equal texts
of at least that length are removed whole, as each repeats the other; texts of any length are read
whole, in pieces; repeated rows count as texts of their own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import slices
from millrace.llm.hashing import mix
from millrace.session import materialize

LENGTH, GRAM = 400, 32
#: Rows of a group that are compared in one task.
GROUP_ROWS = 5000
#: Windows of a text that are looked at together.
PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_FACTOR = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of the factor and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            for name, f in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 2**64))):
                table = np.full(size, f, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self.up, self.down


_powers = _Powers()


class Prefix:
    """Hashes of any substring of data, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    out, n = values, 1
    while 2 * n <= width:
        out, n = np.minimum(out[:-n], out[n:]), 2 * n
    return np.minimum(out[: len(values) - width + 1], out[width - n : len(values) - n + 1]) if n < width else out


def ranges_of(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """first window, last window, anchor, hash of the gram, hash of all bytes of the windows, times, extent.

    In periodic text the same range follows itself every few bytes. Such a row stands for all of them:
    times says how many there are, extent how far the last one begins behind the first.
    """
    found = []
    for base in range(0, len(text) - length + 1, PIECE):
        data = np.frombuffer(text[base : base + PIECE + length - 1], np.uint8)
        hashes = Prefix(data)
        at = np.arange(len(data) - gram + 1)
        grams = hashes.of(at, at + gram)
        anchor = (_least((grams & ~_PLACE) | at.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        anchor = anchor[first]
        whole = mix(hashes.of(first, last + length) + (anchor - first).astype(np.uint64))
        found.append((first + base, last + base, anchor + base, grams[anchor].view(np.int64), whole.view(np.int64)))
    first, last, anchor, grams, whole = (np.concatenate(x) for x in zip(*found, strict=True))
    again = (grams[1:] == grams[:-1]) & (whole[1:] == whole[:-1]) & (np.diff(last - first) == 0) & (np.diff(anchor - first) == 0)
    start = np.flatnonzero(np.concatenate([[True], ~again]))
    end = np.concatenate([start[1:], [len(first)]])
    return first[start], last[start], anchor[start], grams[start], whole[start], end - start, first[end - 1] - first[start]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("doc_id").alias("row"), F.xxhash64("text").alias("k1"), (F.crc32(F.col("text").cast("binary")) - F.lit(1 << 31)).cast("int").alias("k2"), "text")


def _ranges(texts: DataFrame, length: int, gram: int, grams_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, owner = [], []
                for k, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    if len(text) >= length:
                        found.append(ranges_of(text, length, gram))
                        owner += [k] * len(found[-1][0])
                if not found:
                    continue
                first, last, anchor, gram_hash, whole, times, extent = (np.concatenate(x) for x in zip(*found, strict=True))
                if grams_only:
                    yield pa.RecordBatch.from_arrays([pa.array(gram_hash), pa.array(times)], names=["g", "times"])
                    continue
                own = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram_hash), pa.array(whole), part.column("row").take(own), part.column("k1").take(own), part.column("k2").take(own), pa.array(first), pa.array((last - first).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), pa.array(times), pa.array(extent)],
                    names=["g", "w", "row", "k1", "k2", "first", "more", "off", "times", "extent"],
                )

    return texts.mapInArrow(run, "g long, times long" if grams_only else "g long, w long, row long, k1 long, k2 int, first long, more int, off int, times long, extent long")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each listed range: key, g, w, low and high (windows), off, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                out += [(x["g"], x["g"], x["w"], 0, x["more"], x["off"], text[x["first"] : x["first"] + x["more"] + length]) for x in wanted]
            yield _rows(out)

    return texts.mapInArrow(run, _UNIT)


_UNIT = "key long, g long, w long, low int, high int, off int, bytes binary"
_UNIT_SCHEMA = pa.schema([("key", pa.int64()), ("g", pa.int64()), ("w", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("off", pa.int32()), ("bytes", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_UNIT_SCHEMA)], schema=_UNIT_SCHEMA)


def _compare(length: int):
    """Finds equal windows in groups of one key; rows come sorted by key and kind."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        kinds = list({(r[0], r[2], r[3]): r for r in rows}.values())
        sizes = np.array([len(r[6]) for r in kinds], np.int64)
        begin = np.cumsum(sizes) - sizes
        hashes = Prefix(np.frombuffer(b"".join(r[6] for r in kinds), np.uint8))
        low, count = np.array([r[3] for r in kinds], np.int64), np.array([r[4] - r[3] + 1 for r in kinds], np.int64)
        owner = np.repeat(np.arange(len(kinds)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]
        at = begin[owner] + place
        key, off = np.array([r[0] for r in kinds], np.int64).view(np.uint64), np.array([r[5] for r in kinds], np.int64)
        h = mix(mix(hashes.of(at, at + length) + key[owner]) + (place - off[owner] + length).astype(np.uint64))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = np.flatnonzero(twice)
        new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)]) if len(hit) else np.zeros(0, bool)
        start = hit[new]
        end = hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])] if len(hit) else hit
        return pa.RecordBatch.from_arrays(
            [pa.array([kinds[k][1] for k in owner[start]], pa.int64()), pa.array([kinds[k][2] for k in owner[start]], pa.int64()), pa.array(place[start].astype(np.int32)), pa.array((place[end] + length).astype(np.int32))],
            names=["g", "w", "from", "to"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += list(zip(*(batch.column(f.name).to_pylist() for f in _UNIT_SCHEMA), strict=True))
            if len(held) >= 2000 and held[0][0] != held[-1][0]:
                cut = next(k for k in range(len(held) - 1, -1, -1) if held[k][0] != held[-1][0]) + 1
                yield solve(held[:cut])
                held = held[cut:]
        if held:
            yield solve(held)

    return run


def _split(length: int, gram: int, size: int):
    """Cuts rows into blocks of `size` windows, at places given by the anchor, keyed by what all windows of a block have in common."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, g, w, low, high, off, data in zip(*(batch.column(f.name).to_pylist() for f in _UNIT_SCHEMA), strict=True):
                hashes = Prefix(np.frombuffer(data, np.uint8))
                for block in range((low - off + reach) // size, (high - off + reach) // size + 1):
                    begin = block * size + off - reach
                    core = hashes.of(np.array([begin + size - 1]), np.array([begin + length]))
                    key = mix(mix(core + np.uint64(g % 2**64)) + np.uint64(block * 1024 + size))
                    out.append((int(key.view(np.int64)[0]), g, w, max(low, begin), min(high, begin + size - 1), off, data))
            yield _rows(out)

    return run


def _sizes(rows: DataFrame) -> DataFrame:
    """Keys that rows of several kinds have, with how many rows; a kind that came twice, with a repeated row, is one."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("w").alias("a"), F.max("w").alias("b")).where("a <> b").select("key", "rows")


def repeated_windows(kinds: DataFrame, mixed: DataFrame, contexts: DataFrame, length: int, gram: int, group_rows: int) -> DataFrame:
    """g, w, from, to: the bytes of each kind of range, counted from its first window, that repeat elsewhere."""
    found = kinds.where("n > 1").select("g", "w", F.lit(0).alias("from"), (F.col("more") + length).alias("to"))
    schema = "g long, w long, from int, to int"

    def compared(rows: DataFrame) -> DataFrame:
        # by a hash: dealt by the key itself, after a join on it, Spark would drop this step and could leave a key in several tasks
        return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key", "w").mapInArrow(_compare(length), schema)

    if (mixed.agg(F.max("c")).first()[0] or 0) <= group_rows:
        return found.unionByName(compared(contexts))
    rows, size = materialize(contexts, "contexts"), 1 << (length - gram).bit_length()  # a block of this size holds all windows of an anchor
    while True:
        sized = rows.join(materialize(_sizes(rows), "sizes"), "key")
        if size == 1:
            return found.unionByName(sized.select("g", "w", F.col("low").alias("from"), (F.col("low") + length).alias("to")))
        found = found.unionByName(compared(sized.where(F.col("rows") <= group_rows).drop("rows")))
        size //= 2
        rows = materialize(sized.where(F.col("rows") > group_rows).select(*[f.name for f in _UNIT_SCHEMA]).mapInArrow(_split(length, gram, size), _UNIT), "blocks")
        if rows.isEmpty():
            return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text of every document.

    text is what is left, to be written in place of the old text. Where a removed string begins or ends
    inside a character, the bytes left of that character count in kept_sha256 but not in text.
    """
    texts = _keyed(docs, id_col, text_col)
    long = texts.where(F.octet_length("text") >= length)
    shared = _ranges(long.select("text"), length, gram, True).groupBy("g").agg(F.sum("times").alias("c")).where("c > 1").select("g")
    ranges = materialize(_ranges(long.select("row", "k1", "k2", "text"), length, gram, False).join(shared, "g"), "ranges")
    kinds = materialize(ranges.groupBy("g", "w").agg(F.sum("times").alias("n"), F.min(F.struct("row", "k1", "k2", "first", "more", "off")).alias("x")).select("g", "w", "n", "x.*"), "kinds")
    # written, as Spark splits a gram that many kinds have only where nothing is aggregated in the task that joins them
    mixed = materialize(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("m")).where("c > 1 and m = 1").select("g", "c"), "mixed")
    wanted = kinds.join(mixed.select("g"), "g").groupBy("row", "k1", "k2").agg(F.collect_list(F.struct("g", "w", "first", "more", "off")).alias("wanted"))
    contexts = _contexts(long.select("row", "k1", "k2", "text").join(wanted, ["row", "k1", "k2"]).select("text", "wanted"), length)
    found = repeated_windows(kinds, mixed, contexts, length, gram, group_rows)
    spans = ranges.join(found, ["g", "w"]).select("k1", "k2", F.struct((F.col("first") + F.col("from")).alias("a"), (F.col("first") + F.col("extent") + F.col("to")).alias("b")).alias("s"))
    spans = materialize(spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("s")).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept, left = [], [], [], []
            for text, cuts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at, total, count = [], 0, 0, 0
                begin = end = None
                for cut in [*(cuts or []), None]:
                    if cut is not None and end is not None and cut["a"] <= end:
                        end = max(end, cut["b"])
                        continue
                    if end is not None:
                        parts.append(text[at:begin])
                        at, total, count = end, total + end - begin, count + 1
                    if cut is not None:
                        begin, end = cut["a"], cut["b"]
                parts.append(text[at:])
                removed.append(total)
                runs.append(count)
                rest = b"".join(parts)
                kept.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode(errors="ignore"))
            sizes = [len(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string()), pa.array(left, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    joined = texts.select("doc_id", "k1", "k2", "text").join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
