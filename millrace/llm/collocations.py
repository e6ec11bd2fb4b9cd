"""Collocated phrases of two to four words by top-order marginalisation.

Every word position has one window: the word and its three lead words, padded where a piece ends. Only these longest
windows are counted; a Spark ROLLUP over their columns sums the counts of successively shorter prefixes, which
are the counts of all phrases of one to four words and, at the last level, of all words. No phrase
length has an explosion of its own.

Windows are cut where no frequent phrase can go on, which leaves the counts of frequent ones as they are (a phrase
is at most as frequent as its parts): at words below the least count, found by one count of words, and
after the windows of equal beginnings have met, at pairs and triples below it. Tasks count equal windows before they
are dealt out. Words of the dictionary, those with the highest counts up to a fixed number, go as short
codes; further frequent words, if there are any, are spelled out, so its bound costs bytes and not results. Pairs with a
large share of all windows, found in a sample of positions, are dealt out by their third word too; the sample
decides who works and not what is counted.

A candidate's score is its least over the cuts in two parts, floor(2000000 a / (l + r)), in exact decimals.

Defined cases: a null text has no words; a null group counts as `und`; an empty table has no phrases; repeated rows
count each; ids are not read. A task holds one text and one buffer of windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import slices, texts_of
from millrace.session import discard, materialize

#: Words that are sent to all workers as codes, at most.
DICTIONARY = 1_000_000
#: Windows, and distinct words, that a task counts before it hands them on.
BUFFER, WORDS = 4_000_000, 500_000
#: One in so many positions is looked at for common pairs; common are those with so large a share of them, at most 256 then.
SAMPLED, SHARE = 64, 1 / 256
SALTS = 64

#: Lower case for A to Z; one mark for every character that ends a piece.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else ord(".") if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))
_DIGITS = [chr(c) for c in range(33, 127) if chr(c) not in "=%"]


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words in order, with a lone full stop where a piece ends."""
    return (text or b"").translate(_BYTES).replace(b".", b" . ").split()


def code(n: int) -> str:
    """A short name for a number, from 0."""
    out = ""
    while True:
        n, k = divmod(n, len(_DIGITS))
        out = _DIGITS[k] + out
        if not n:
            return out
        n -= 1


class Dictionary:
    """Codes of frequent words by language. complete: it holds all of them, so that any other word ends a window."""

    def __init__(self, words: list[tuple[str, str]], complete: bool, hot: list[tuple[str, str]]):
        self.words, self.complete, self.hot, self.tables = words, complete, hot, None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def ready(self) -> Dictionary:
        if self.tables is None:
            self.tables, self.pairs, self.langs, self.none = {}, {}, {}, {b".": 0}
            for n, (lang, word) in enumerate(self.words):
                self.tables.setdefault(lang, dict(self.none))[word.encode()] = n + 2
                self.langs.setdefault(lang, code(len(self.langs)))
            self.codes = pa.array([None, None, *map(code, range(len(self.words)))], pa.string())
            for lang, pair in self.hot:
                a, b = (self.tables.get(lang, {}).get(w.encode(), 0) for w in pair.split(" "))
                if a and b:
                    self.pairs.setdefault(lang, []).append(a << 32 | b)
        return self

    def lang_code(self, lang: str) -> str:
        return self.langs.get(lang) or "=" + quote(lang, safe="")

    def reader(self):
        """A function from codes of a language and words to the language and the phrase."""
        names = {c: lang for lang, c in self.ready().langs.items()}
        words = dict(zip(self.codes.to_pylist()[2:], (w for _, w in self.words), strict=True))
        return lambda lang, parts: (unquote(lang[1:]) if lang[0] == "=" else names[lang], " ".join(p[1:] if p[0] == "=" else words[p] for p in parts))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield from zip(part.column("lang").to_pylist(), texts_of(part, "text"), strict=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word and its count in some texts; and sampled pairs, which hold a space."""
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(b".", 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "c"])
        counts.clear()

    for lang, text in _rows(batches):
        found = counts.setdefault(lang, Counter())
        tokens = tokens_of(text)
        found.update(tokens)
        tokens = tokens[len(tokens) % SAMPLED :] if len(tokens) < SAMPLED else tokens
        found.update(a + b" " + b for a, b in zip(tokens[::SAMPLED], tokens[1::SAMPLED], strict=False) if a != b"." and b != b".")
        if sum(map(len, counts.values())) > WORDS:
            yield from out()
    yield from out()


def _windows(shared, buffer: int):
    """key: language, first word and second word, with a salt behind a common pair; rest: third and fourth; c: how often."""

    def flush(known: Dictionary, lang: str, parts: list[np.ndarray], spelled: list[bytes]) -> pa.RecordBatch:
        ids = np.concatenate([*parts, np.zeros(4, np.int64)])
        at = np.flatnonzero(ids[:-4] > 0)
        one, two, three, four = (ids[at + k] for k in range(4))
        one, two = np.where(one > 1, one, 0), np.where(two > 1, two, 0) * (one > 1)
        three = np.where(three > 1, three, 0) * (two > 0)
        four = np.where(four > 1, four, 0) * (three > 0)
        head, tail = one << 32 | two, three << 32 | four
        order = np.lexsort((tail, head))
        head, tail = head[order], tail[order]
        first = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])) if len(head) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([first, [len(head)]]))
        head, tail = head[first], tail[first]
        names = known.codes if not spelled else pa.concat_arrays([known.codes, pa.array([b"=" + w for w in spelled], pa.binary()).cast(pa.string())])
        low = (1 << 32) - 1
        taken = [names.take(pa.array(x)) for x in (head >> 32, head & low, tail >> 32, tail & low)]
        salt = np.where(np.isin(head, known.pairs.get(lang, [])), (tail >> 32) % SALTS, -1)
        salts = pa.array([None, *map(str, range(SALTS))], pa.string()).take(pa.array(salt + 1))
        key = pc.binary_join_element_wise(pa.scalar(known.lang_code(lang)), taken[0], taken[1], salts, " ", null_handling="skip")
        rest = pc.coalesce(pc.binary_join_element_wise(taken[2], taken[3], " "), taken[2])
        return pa.RecordBatch.from_arrays([key, rest, pa.array(counts, pa.int64())], names=["key", "rest", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.ready()
        held: dict[str, list[np.ndarray]] = {}
        spelled: dict[bytes, int] = {}
        size = 0
        for lang, text in _rows(batches):
            table, tokens = known.tables.get(lang, known.none), tokens_of(text)
            # 0: a piece ends; 1: a word that isn't frequent; from 2 on: words with a code, or spelled out
            if known.complete:
                ids = list(map(table.get, tokens, repeat(1)))
            else:
                ids = [table[t] if t in table else spelled.setdefault(t, len(known.words) + 2 + len(spelled)) for t in tokens]
            ids.append(0)
            held.setdefault(lang, []).append(np.array(ids, np.int64))
            size += len(ids)
            if size > buffer:
                for one, parts in held.items():
                    yield flush(known, one, parts, list(spelled))
                held, spelled, size = {}, {}, 0
        for one, parts in held.items():
            yield flush(known, one, parts, list(spelled))

    return run


def _exact(c: Column, digits: int = 19) -> Column:
    return c.cast(f"decimal({digits},0)")


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", group_col: str = "lang", dictionary: int = DICTIONARY, buffer: int = BUFFER) -> DataFrame:
    """lang, phrase, size (words) and f of every phrase of one to four words with f >= least; size 0 has the count of all words."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    words = materialize(own.mapInArrow(_count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | F.contains("word", F.lit(" "))), "words")
    pairs, frequent = words.where(F.contains("word", F.lit(" "))), words.where(~F.contains("word", F.lit(" ")))
    seen = pairs.agg(F.sum("c")).first()[0] or 0
    hot = [(r["lang"], r["word"]) for r in pairs.where(F.col("c") >= SHARE * seen).collect()]  # 1 / SHARE rows at most
    size = frequent.count()
    chosen = frequent.orderBy(F.col("c").desc(), "lang", "word").limit(dictionary).select("lang", "word").toArrow()
    shared = spark.sparkContext.broadcast(Dictionary(list(zip(chosen["lang"].to_pylist(), chosen["word"].to_pylist(), strict=True)), size <= dictionary, hot))
    discard(words)

    # equal windows, and those with the same first two words (three, for common pairs), meet in one partition
    dealt = own.mapInArrow(_windows(shared, buffer), "key string, rest string, c long").repartition(F.col("key")).groupBy("key", "rest").agg(F.sum("c").alias("c"))
    dealt = dealt.withColumn("third", F.substring_index("rest", " ", 1))
    dealt = dealt.withColumn("by_three", F.sum("c").over(Window.partitionBy("key", "third")))
    dealt = dealt.withColumn("by_two", F.sum(F.when(F.col("by_three").isNotNull(), F.col("c"))).over(Window.partitionBy("key")))
    salted = F.substring_index("key", " ", 3) != F.col("key")
    second = salted | (F.col("by_two") >= least)
    third = second & (F.col("by_three") >= least)

    def word(column: str, k: int) -> Column:
        return F.nullif(F.split_part(F.col(column), F.lit(" "), F.lit(k)), F.lit(""))

    cut = dealt.select(word("key", 1).alias("lang"), word("key", 2).alias("w1"), F.when(second, word("key", 3)).alias("w2"), F.when(third, word("rest", 1)).alias("w3"), F.when(third, word("rest", 2)).alias("w4"), "c")
    levels = ("w1", "w2", "w3", "w4")
    summed = cut.rollup("lang", *levels).agg(F.sum("c").alias("f"), F.grouping_id().alias("_g"))
    # at each level the last word must be there, else it is the padding's sum
    size_of = F.coalesce(*[F.when(F.col("_g") == (1 << (4 - k)) - 1, F.lit(k)) for k in range(5)])
    last = F.coalesce(*[F.when(F.col("size") == k, F.col(w).isNotNull()) for k, w in enumerate(levels, 1)], F.lit(True))
    found = summed.withColumn("size", size_of).where(F.col("size").isNotNull() & F.col("lang").isNotNull() & last & ((F.col("size") == 0) | (F.col("f") >= least)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for batch in batches:
            langs, *parts = (batch.column(c).to_pylist() for c in ("lang", *levels))
            made = [read(lang, [p for p in row if p is not None]) for lang, *row in zip(langs, *parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.string()), batch.column("size"), batch.column("f")], names=["lang", "phrase", "size", "f"])

    return found.select("lang", *levels, "size", "f").mapInArrow(spell, "lang string, phrase string, size int, f long")


def collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, inside: tuple[int, int] = (80, 100), text_col: str = "text", group_col: str = "lang",
    dictionary: int = DICTIONARY, buffer: int = BUFFER,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first phrases by score, count and their bytes.

    A phrase goes if a longer candidate around it has inside[0] / inside[1] of its count or more.
    """
    counts = materialize(phrase_counts(docs, least, text_col, group_col, dictionary, buffer), "phrases")
    known = counts.where("size > 0").select("lang", "phrase", "f")
    words = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"), "size")

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("w", start, length), " ")

    cuts = words.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    parts = _exact(F.col("l")) + _exact(F.col("r"))
    cuts = cuts.withColumn("score", F.floor((_exact(F.lit(scale)) * _exact(F.col("a")) - F.pmod(_exact(F.lit(scale)) * _exact(F.col("a")), parts)) / parts).cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    inner = words.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda s: F.array_join(F.slice("w", s, F.col("k")), " "))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    few, many = inside
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact(F.lit(many)) * _exact(F.col("longer")) < _exact(F.lit(few)) * _exact(F.col("a"))))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
