"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word n-grams, as 64-bit hashes. Under a global order of the hashes,
two sets that reach the threshold share at least m of the first n - ceil(t n) + m members of each.
The order puts hashes that only one set has first, then rarer ones, then those that were not counted;
most sets end their prefix among hashes of their own and are done. The prefixes of the others are
lengthened by the number of candidates they would bring, and as many more shared members are asked
for before two sets are verified in full.

Sets that share members of their prefixes as they were before they were lengthened form clusters (the
further members are the more frequent ones, and two sets that reach the threshold share one of the others too), and clusters are verified in units of bounded size. In a
unit a breadth-first search compares a set only with sets that are not yet linked, so what a unit returns
grows with its sets and not with their pairs; links are lost to no one, since only the components are
asked for. A cluster of few blocks is compared by every block and every two blocks. A larger one is mostly a chain of texts that share passages: it is clustered anew among sets
of about one size, two neighbouring bands of sizes at a time, since sets of bands further apart can't
reach the threshold. Where that leaves many blocks, first every block is searched alone, together with some
hubs of the whole cluster, so that copies of one text find each other through the hubs whatever block
they are in. Sets of the largest component found so far need no comparison with each other any more; where
few are outside it, only those are then compared with all blocks, so a cluster of copies costs no more
than its size. Else every two blocks make a unit.

Equal sets are one class throughout. Hashes of 64 bits stand for n-grams and for whole sets.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a text with
fewer words than n has one member, the whole sequence; repeated rows are linked like equal texts; a
null id gets the smallest id of its component, which is null where all its ids are; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import map_texts
from millrace.llm.components import components
from millrace.llm.hashing import hash_words, mix
from millrace.session import materialize
from millrace.types import quoted

SHINGLE, PERCENT = 4, 85
#: Hashes below this share of all are counted over the corpus; a fixed share of every set, not of the rows.
COUNTED = 0.25
#: By how much a prefix can grow.
MOST_EXTRA = 8
#: Members that a block of a cluster holds, and about how many sets of a cluster are its hubs.
BLOCK_MEMBERS, HUBS = 1_000_000, 8
#: A cluster of so many blocks at most is compared by every block and every two blocks, which moves a set as often at most.
FEW_BLOCKS = 4
#: Texts of candidates are found by bitmaps of 32,768 bits, so many bits a candidate, and at most so many bitmaps (16 MB), which every task gets.
BITMAP, BITS_A_ROW, MOST_BITMAPS = 32_768, 16, 4096
#: Rows to drop are found likewise, with twice the bits; of the others so many at most may pass the bitmaps, else rows and keys are joined.
MOST_SPARED = 500_000


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = hash_words(texts)
    runs, first = words.shingles(size)
    out = []
    for k in range(len(texts)):
        a, b = words.first[k], words.first[k + 1]
        if 0 < b - a < size:
            whole = np.array([int(b - a)], np.uint64)
            for h in words.hashes[a:b]:
                whole = mix(whole + h)
            out.append(whole)
        else:
            out.append(np.unique(runs[first[k] : first[k + 1]]))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signed_int(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def describe(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """doc_id, tx (Spark's xxhash64 of the text), n (size of the set), cls (hash of the set), low (its counted hashes), extra (further ones that its prefix may need)."""
    bound = np.uint64(int(COUNTED * 2**64))

    def per_slice(ids: list, texts: list[bytes | None]) -> dict[str, list]:
        sets = shingle_sets(texts, size)
        cut = [int(np.searchsorted(s, bound)) for s in sets]
        need = [len(s) - (percent * len(s) + 99) // 100 + 1 + MOST_EXTRA for s in sets]
        return {
            "doc_id": ids,
            "tx": [None if t is None else _signed_int(xxhash.xxh64_intdigest(t, 42)) for t in texts],
            "n": [len(s) for s in sets],
            "cls": [_class_of(s) for s in sets],
            "low": [_signed(s[:c]) for s, c in zip(sets, cut, strict=True)],
            "extra": [_signed(s[c : max(c, k)]) for s, c, k in zip(sets, cut, need, strict=True)],
        }

    return map_texts(docs, id_col, text_col, "doc_id long, tx long, n int, cls long, low array<long>, extra array<long>", per_slice)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """cls, n, asked (shared members asked for), prefix and base (how many of its members are enough to ask for one) of every class that may have a partner."""
    useful = sets.where(f"100 * n >= {percent} * (n + 1)")  # smaller sets don't reach the threshold with a superset of one more member either
    members = useful.select("cls", F.explode(F.concat("low", "extra")).alias("h"))  # moved once: counted and kept where they meet
    by_hash = Window.partitionBy("h")
    met = members.withColumns({"df": F.count(F.lit(1)).over(by_hash), "a": F.min("cls").over(by_hash), "b": F.max("cls").over(by_hash)}).where("a <> b")
    kind = F.when(F.col("h").bitwiseXOR(F.lit(-(2**63))) < int(COUNTED * 2**64) - 2**63, 0).otherwise(1)  # the hash without its sign is below the bound
    sizes = useful.groupBy("cls").agg(F.max("n").alias("n"), F.max(F.size("low")).alias("c"))
    own = met.groupBy("cls").agg(F.collect_set(F.struct(kind.alias("kind"), "df", "h")).alias("m")).join(sizes, "cls")
    alone = F.col("c") - F.size(F.filter("m", lambda x: x["kind"] == 0))
    base = (F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1 - alone).cast("int")
    cost = F.aggregate(F.slice("m", 1, F.greatest(F.col("base"), F.lit(1))), F.lit(0).cast("long"), lambda a, x: a + x["df"])
    wanted = F.least(F.lit(MOST_EXTRA), F.floor(F.log2(1 + cost / F.greatest(F.col("base"), F.lit(1))))).cast("int")
    more = F.greatest(F.lit(0), F.least(wanted, F.size("m") - F.col("base")))
    return (
        own.withColumn("base", base)
        .where("base > 0")
        .withColumn("m", F.array_sort("m"))
        .withColumn("more", more)
        .select("cls", "n", "base", (F.col("more") + 1).alias("asked"), F.transform(F.slice("m", 1, F.col("base") + F.col("more")), lambda x: x["h"]).alias("prefix"))
    )


def _inverted(lists: list[np.ndarray], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists of the given owners, sorted, with whose they are."""
    if not len(owners):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([lists[k] for k in owners])
    whose = np.repeat(owners, [len(lists[k]) for k in owners])
    order = np.argsort(keys, kind="stable")
    return keys[order], whose[order]


class _Unit:
    """The sets of one unit and the search for links among them; in a unit of two sides only links between them."""

    def __init__(self, rows: list[tuple], percent: int):
        self.ids = [r[0] for r in rows]
        self.asked = np.array([r[1] for r in rows], np.int64)
        self.side = np.array([r[2] for r in rows], np.int64)
        self.one_side = self.side.min() == self.side.max()
        self.prefix = [np.asarray(r[3]) for r in rows]
        self.sets = [np.asarray(r[4]) for r in rows]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.percent = percent
        self._index(np.ones(len(rows), bool))

    def _index(self, open_: np.ndarray) -> None:
        self.indexed = np.flatnonzero(open_)
        self.by_prefix, self.by_member = _inverted(self.prefix, self.indexed), None

    def _counts(self, index: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(index[0], keys, "left"), np.searchsorted(index[0], keys, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        return np.bincount(index[1][at], minlength=len(self.ids))

    def partners(self, x: int, open_: np.ndarray) -> np.ndarray:
        """The open sets that reach the threshold with x."""
        count = self._counts(self.by_prefix, self.prefix[x])
        n, sizes = self.sizes[x], self.sizes
        may = np.flatnonzero(count >= np.minimum(self.asked, self.asked[x]))
        fits = open_[may] & (100 * np.minimum(sizes[may], n) >= self.percent * np.maximum(sizes[may], n))
        if not self.one_side:
            fits &= self.side[may] != self.side[x]
        may = may[fits]
        if len(may) > 40:
            if self.by_member is None:
                self.by_member = _inverted(self.sets, self.indexed)
            both = self._counts(self.by_member, self.sets[x])[may]
        else:
            both = np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for y in may], np.int64)
        return may[100 * both >= self.percent * (n + sizes[may] - both)]

    def links(self) -> list[tuple[int, int]]:
        """Every set of a component of this unit with the smallest id in it: as few rows as links, and no long chains for later rounds."""
        open_ = np.ones(len(self.ids), bool)
        left, found = len(self.ids), []
        for start in range(len(self.ids)):
            if not open_[start]:
                continue
            open_[start] = False
            left -= 1
            todo, part = [start], [self.ids[start]]
            while todo and left:
                new = self.partners(todo.pop(), open_)
                open_[new] = False
                left -= len(new)
                todo += new.tolist()
                part += [self.ids[y] for y in new.tolist()]
                if 2 * left < len(self.indexed):  # what is linked need not be found again
                    self._index(open_)
            root = min(part)
            found += [(x, root) for x in part if x != root]
        return found


def _verify(percent: int):
    """A function over partitions whose rows are sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            links = _Unit(rows, percent).links() if len(rows) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([unit[0]] * len(links), pa.int64()), *(pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))], names=["root", "a", "b"])

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("root", "i", "j", "cls", "asked", "side")]
            for k, (root, i, j, cls, asked, side) in enumerate(zip(*plain, strict=True)):
                if (root, i, j) != unit:
                    yield from close()
                    unit, rows = (root, i, j), []
                row = batch.slice(k, 1)
                rows.append((cls, asked, side, *(row.column(c).flatten().to_numpy() for c in ("prefix", "members"))))
        yield from close()

    return run


def _clusters(held: DataFrame) -> DataFrame:
    """cls, band, root of sets that share members within a band; held: cls, band, h."""
    node = F.xxhash64("cls", "band")
    least = held.groupBy("band", "h").agg(F.min(node).alias("m"), F.max(node).alias("x")).where("m <> x").select("band", "h", "m")
    found = components(held.join(least, ["band", "h"]).select(node.alias("a"), F.col("m").alias("b")), "clusters")
    return held.select("cls", "band", node.alias("node")).distinct().join(found, "node").select("cls", "band", "root")


def _in_blocks(rows: DataFrame, block_members: int) -> DataFrame:
    """Rows of clusters with the number of blocks and of sets of their cluster, and their own block."""
    sizes = rows.groupBy("root").agg(F.ceil(F.sum(F.col("n").cast("long")) / block_members).cast("int").alias("blocks"), F.count(F.lit(1)).alias("sets"))
    return rows.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))


def _left_over(cut: DataFrame, links: DataFrame, block_members: int) -> DataFrame:
    """Further units of clusters in blocks: the sets outside the largest component that the links make against each block, or every two blocks, whichever moves less."""
    found = components(links.join(cut.select("root").distinct(), "root", "left_semi"), "blocks")
    rows = cut.join(found.select(F.col("node").alias("cls"), F.col("root").alias("part")), "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    members = F.sum(F.col("n").cast("long"))
    parts = rows.groupBy("root", "part").agg(members.alias("size"))
    sizes = parts.groupBy("root").agg(F.max_by("part", F.struct("size", "part")).alias("largest"), F.max("size").alias("linked"), F.sum("size").alias("all"))
    rows = rows.join(sizes, "root").withColumn("outside", F.col("all") - F.col("linked")).where("outside > 0")
    rows = rows.withColumns({"few": 2 * F.col("outside") * F.col("blocks") < F.col("all") * (F.col("blocks") - 1), "parts": F.ceil(F.col("outside") / block_members).cast("int")})
    rows = materialize(rows, "open")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    few = rows.where("few")
    one = few.where("part <> largest").withColumns({"i": F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"), "j": F.explode(every), "side": F.lit(0)})
    other = few.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "j": F.col("block"), "side": F.lit(1)})
    two = rows.where("not few").withColumn("o", F.explode(F.array_remove(every, F.col("block")))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o"), "side": F.col("block")}).drop("o")
    return one.unionByName(other).unionByName(two)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id reachable by links of at least percent."""
    return _components(docs, id_col, text_col, size, percent, block_members).drop("tx")


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, block_members: int) -> DataFrame:
    """As jaccard_components, with tx, by which rows of one id are told apart."""
    sets = materialize(describe(docs, id_col, text_col, size, percent), "sets")
    may = materialize(prefixes(sets, percent), "prefixes")
    held = may.select("cls", F.lit(0).alias("band"), F.explode(F.slice("prefix", 1, F.col("base"))).alias("h"))
    placed = materialize(_in_blocks(may.join(_clusters(held).drop("band"), "cls"), block_members), "placed")
    many = F.col("blocks") > FEW_BLOCKS
    if not placed.where(many).isEmpty():  # chains of sets of all sizes: cut them by size
        width = math.log(100 / percent) * 1.0001
        band = F.floor(F.log("n") / width).cast("int")
        large = placed.where(many).select(*may.columns, F.explode(F.array(band, band + 1)).alias("band"))
        found = _clusters(large.select("cls", "band", F.explode(F.slice("prefix", 1, F.col("base"))).alias("h")))
        placed = placed.where(~many).unionByName(_in_blocks(large.join(found, ["cls", "band"]).drop("band"), block_members))
    hub = many & (F.col("n") <= block_members // (2 * HUBS)) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.col("sets")) < HUBS)

    classes = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.coalesce(F.min_by("tx", "doc_id"), F.min("tx")).alias("tx"))
    wanted = materialize(placed.withColumn("hub", hub).drop("sets").join(classes.withColumnRenamed("least", "doc_id"), "cls"), "candidates")
    bitmaps = min(MOST_BITMAPS, wanted.count() * BITS_A_ROW // BITMAP + 1)

    def per_slice(ids: list, texts: list[bytes | None]) -> dict[str, list]:
        found = shingle_sets(texts, size)
        return {"cls": [_class_of(s) for s in found], "members": [_signed(s) for s in found]}

    def verified(units: DataFrame) -> DataFrame:
        """root, a, b: links found in units, rows of cls, asked and prefix by root, i, j and side; whole sets are made anew from the texts.

        Only sets are shuffled, not texts; those of the few other texts that pass the bitmaps meet no unit, or that of an equal set.
        """
        texts = _may_hold(docs, units.select("doc_id", "tx"), id_col, text_col, bitmaps)
        full = map_texts(texts, id_col, text_col, "cls long, members array<long>", per_slice).dropDuplicates(["cls"])
        rows = units.join(full, "cls").select("root", "i", "j", "cls", "asked", "side", "prefix", "members")
        return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(percent), "root long, a long, b long")

    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = wanted.where(~many).withColumn("o", F.explode(blocks)).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o"), "side": F.col("block")}).drop("o")
    alone = wanted.where(many).withColumns({"i": F.explode(F.when(F.col("hub"), blocks).otherwise(F.array("block"))), "j": F.lit(0), "side": F.lit(0)})
    links = verified(pairs.unionByName(alone))
    cut = wanted.where(many)
    if not cut.isEmpty():
        links = materialize(links, "links")
        more = _left_over(cut, links, block_members)
        if not more.isEmpty():
            links = links.unionByName(verified(more))
    classes = classes.drop("tx")
    joined = components(links, "linked").join(classes.withColumnRenamed("cls", "node"), "node")
    roots = joined.groupBy("root").agg(F.min("least").alias("component"))
    named = joined.select("node", "root").join(roots, "root").select(F.col("node").alias("cls"), "component")
    ids = classes.join(named, "cls", "left").select("cls", F.coalesce("component", "least").alias("component"))
    rows = sets.select("doc_id", "tx", "n", "cls").join(ids, "cls", "left")
    return rows.select("doc_id", "tx", F.col("n").cast("long").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component")), "doc_id").alias("component_id"))


def _key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The id and the text hash of a row of docs."""
    return docs[quoted(id_col)].cast("long"), F.xxhash64(docs[quoted(text_col)])


def _bitmaps(keys: DataFrame, bitmaps: int) -> DataFrame:
    """_bitmap, _bits: two bits are set for every row of keys (doc_id, tx)."""
    row = F.xxhash64("doc_id", "tx")
    set_bits = keys.select(_place(row, bitmaps).alias("_bitmap"), F.explode(F.array(_bit(row, 16), _bit(row, 40))).alias("_bit"))
    return set_bits.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _place(row: Column, bitmaps: int) -> Column:
    return F.pmod(row, F.lit(bitmaps)).cast("int")


def _bit(row: Column, shift: int) -> Column:
    return F.pmod(F.shiftright(row, shift), F.lit(BITMAP))


def _in_bitmaps(maps: DataFrame, row: Column, bitmaps: int) -> Column:
    """Whether both bits of a row's hash are set, to join with the broadcast maps."""
    both = _place(row, bitmaps) == maps["_bitmap"]
    for bit in (_bit(row, 16), _bit(row, 40)):
        octet = F.conv(F.hex(F.substring(maps["_bits"], F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        both = both & (F.call_function("getbit", octet, (bit % 8).cast("int")) == 1)
    return both


def _may_hold(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, bitmaps: int) -> DataFrame:
    """The id and text of the rows of docs with the id and the text hash of a row of keys, and of a few others: both bits of theirs in a bitmap are set. No row is moved."""
    return _passing(docs, keys, id_col, text_col, bitmaps).select(F.col(quoted(id_col)), F.col(quoted(text_col)))


def _passing(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, bitmaps: int) -> DataFrame:
    maps = _bitmaps(keys, bitmaps)
    return docs.join(F.broadcast(maps), _in_bitmaps(maps, F.xxhash64(*_key(docs, id_col, text_col)), bitmaps), "left_semi")


def _rows_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """The rows of docs with (left_semi) or without (left_anti) the id and the text hash of a row of keys."""
    same = docs[quoted(id_col)].eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs[quoted(text_col)]) == keys["tx"])
    return docs.join(keys, same, how)


def _without(docs: DataFrame, keys: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs without the id and the text hash of a row of keys; rows: doc_id and tx of all rows of docs.

    Both tables are narrow, so the rows that pass the bitmaps of the keys without being keys are known beforehand. They
    go to every task beside the bitmaps, and docs are read once and not moved.
    """
    bitmaps = min(MOST_BITMAPS, keys.count() * 2 * BITS_A_ROW // BITMAP + 1)
    maps = materialize(_bitmaps(keys, bitmaps), "bitmaps")
    own = rows.select("doc_id", F.coalesce("tx", F.xxhash64(F.lit(None).cast("string"))).alias("tx"))
    passing = own.join(F.broadcast(maps), _in_bitmaps(maps, F.xxhash64(own["doc_id"], own["tx"]), bitmaps), "left_semi").distinct()
    spared = materialize(passing.join(keys, passing["doc_id"].eqNullSafe(keys["doc_id"]) & (passing["tx"] == keys["tx"]), "left_anti"), "spared")
    if spared.count() > MOST_SPARED:
        return _rows_of(docs, keys, id_col, text_col, "left_anti")
    key, tx = _key(docs, id_col, text_col)
    found = docs.join(F.broadcast(maps), _in_bitmaps(maps, F.xxhash64(key, tx), bitmaps), "left")
    found = found.join(F.broadcast(spared), key.eqNullSafe(spared["doc_id"]) & (tx == spared["tx"]), "left")
    return found.where(maps["_bitmap"].isNull() | spared["tx"].isNotNull()).select(*(docs[quoted(c)] for c in docs.columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """docs with one row of each group of linked ones, of the smallest id and, where that repeats, the smallest hash of the text.

    Rows without words are linked with nothing and stay, as do groups of which all ids are null.
    """
    rows = materialize(_components(docs, id_col, text_col, size, percent, block_members), "near")
    found = rows.where("n_shingles > 0 and component_id is not null")
    first = found.where("doc_id = component_id")
    several = first.groupBy("component_id").agg(F.count(F.lit(1)).alias("rows"), F.min("tx").alias("tx")).where("rows > 1")
    again = materialize(several.select(F.col("component_id").alias("doc_id"), "tx"), "several")
    gone = found.where("doc_id is null or doc_id <> component_id").select("doc_id", "tx")
    repeats = again.count()
    if not repeats:
        return _without(docs, materialize(gone.distinct(), "gone"), rows, id_col, text_col)
    gone = gone.union(first.join(again.select("doc_id"), "doc_id").select("doc_id", "tx"))  # one row of these comes back
    left = _without(docs, materialize(gone.distinct(), "gone"), rows, id_col, text_col)
    passing = _passing(docs, again, id_col, text_col, min(MOST_BITMAPS, repeats * BITS_A_ROW // BITMAP + 1))
    return left.unionByName(_rows_of(passing, again, id_col, text_col, "left_semi").dropDuplicates([id_col]))
