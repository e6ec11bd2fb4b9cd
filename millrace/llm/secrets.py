"""Secret scan: all rules compiled to one automaton, one pass over the bytes of each text.

Defined cases: a null text is an empty one and has no spans; repeated rows are scanned alike; texts of
any length are scanned whole, in memory of the order of the text; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from millrace.llm.automaton import RuleScanner
from millrace.llm.batches import map_texts

#: Kind, pattern and least length, in the order in which spans of one start are listed.
#: Lengths are checked after matching, as the rules ask; it also spares the automaton the counters of
#: prefixes nested in runs. Runs of hex digits are counted inside it, since any text is full of short ones.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    ("google", r"AIza[A-Za-z0-9_-]+", 39),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    ("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----", 0),
)
BASE = ("assign", "access", "hex")

#: The value of an assignment inside its span; shorter ones are dropped after matching.
_VALUE = re.compile(rb"""(?:[A-Za-z_]+)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
MIN_VALUE = 6


@lru_cache(maxsize=4)
def scanner(rules: tuple = RULES) -> RuleScanner:
    """Built once a process: from the rules alone, so every executor builds the same one."""
    return RuleScanner([pattern for _, pattern, _ in rules])


def _long_enough(match: bytes, rule: tuple) -> bool:
    if rule[0] == "assign":
        return len(_VALUE.fullmatch(match)[1]) >= MIN_VALUE
    return len(match) >= rule[2]


def find_secrets(text: bytes | None, rules: tuple = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points, by start and then by the order of the rules."""
    if not text:
        return []
    found = [x for x in scanner(rules).scan(text) if _long_enough(text[x[0] : x[2]], rules[x[1]])]
    if not found or text.isascii():
        return found
    points = {0: 0}
    before = at = 0
    for p in sorted({p for start, _, end in found for p in (start, end)}):
        at, before = at + len(text[before:p].decode()), p
        points[p] = at
    return [(points[s], k, points[e]) for s, k, e in found]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Per document: the counts of the base kinds, their digest and all spans as kind:start:end."""

    def per_slice(ids: list, texts: list[bytes | None]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for key, text in zip(ids, texts, strict=True):
            spans = [(rules[k][0], f"{rules[k][0]}:{s}:{e}") for s, k, e in find_secrets(text, rules)]
            kinds = [k for k, _ in spans]
            out["doc_id"].append(key)
            for kind in BASE:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["base_sha256"].append(hashlib.sha256(",".join(x for k, x in spans if k in BASE).encode()).hexdigest())
            out["spans"].append(",".join(x for _, x in spans))
        return out

    return map_texts(docs, id_col, text_col, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", per_slice)
