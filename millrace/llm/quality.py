"""Host-level quality rules, in DataFrame operations only.

Per document: word and symbol counts, repeated lines, words inside repeated five-word windows, and a
base verdict. Per host: the share of failing documents, shrunk towards the corpus by a beta prior
that is fitted on the hosts themselves (method of moments), so a host with few documents is judged
mostly by the prior. Host verdicts are joined back to the documents.

Defined cases: null or empty text counts no words and fails the base rule; a null host has no host
verdict; repeated rows count as often as they occur; an empty table gives an empty result; columns
other than the id, text and host are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_POSITION = (1 << 31) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")


def _neighbours_equal(items: Column, key) -> Column:
    """Elements of a sorted array whose key equals that of the element before or after."""
    return F.filter(items, lambda x, k: (key(F.get(items, k - 1)) == key(x)) | (key(F.get(items, k + 1)) == key(x)))


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the array, first occurrence included.

    Each window becomes one long, 33 bits of hash above 31 bits of position, so sorting longs puts
    equal windows side by side; the few windows with an equal neighbour are then compared as text.
    """
    span = range(WINDOW)

    def of_hashes(w: Column, h: Column) -> Column:
        packed = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in span]).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")),
        )
        return _let(F.sort_array(packed), lambda s: of_candidates(w, F.transform(_neighbours_equal(s, lambda x: F.shiftright(x, 31)), lambda x: x.bitwiseAND(F.lit(_POSITION)).cast("int"))))

    def of_candidates(w: Column, candidates: Column) -> Column:
        windows = F.array_sort(F.transform(candidates, lambda p: F.struct(F.concat_ws(" ", F.slice(w, p + 1, WINDOW)).alias("t"), p.alias("p"))))
        return _let(windows, lambda v: _let(F.sort_array(F.transform(_neighbours_equal(v, lambda x: x["t"]), lambda x: x["p"])), covered))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(starts, k + 1) - p), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) >= WINDOW, _let(words, lambda w: _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: of_hashes(w, h)))).otherwise(F.lit(0).cast("long"))


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the counts and base_failed of every document."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: _without(x, WHITE) != "")
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("_t"))
        .withColumn("_w", _words(text))
        .select(
            "doc_id",
            "host",
            F.size("_w").cast("long").alias("n_words"),
            F.char_length(_without(text, WHITE)).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def host_verdicts(stats: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk by the fitted beta prior) and host_failed.

    The prior is two numbers from one aggregate over hosts: with the pooled rate m and the spread v
    of host rates beyond what sampling explains, a + b = m (1 - m) / v - 1, kept within 2 and 1e6.
    """
    hosts = stats.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    row = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n_docs") * rate * rate).alias("q"), F.count(F.lit(1)).alias("h")).first()
    if row is None or not row["n"]:
        m, weight = 0.5, 2.0
    else:
        m = row["f"] / row["n"]
        spread = row["q"] / row["n"] - m * m - m * (1 - m) * row["h"] / row["n"]
        weight = min(1e6, max(2.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6
    shrunk = (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Every document's counts, base verdict, its host's shrunk failure rate and whether it is kept."""
    stats = materialize(document_rules(docs, id_col, text_col, host_col), "quality")
    hosts = host_verdicts(stats, max_rate).select("host", "host_rate", "host_failed")
    return stats.join(hosts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))).alias("kept"),
        F.round("host_rate", 6).alias("host_rate"),
    )
