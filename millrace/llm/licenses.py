"""Fuzzy search for short licence notices.

A notice of which up to k characters may be changed is cut into k + 1 pieces; by the pigeonhole
principle one piece stands unchanged in every match, so exact look-ups of the pieces (all notices in
one Aho-Corasick pass) give the places to try. There the regex library's bounded-error matching
verifies the whole notice and reports its span and its edits.

Texts are lower-cased (A to Z) and cut into words; both searches run on the words joined by single
spaces, so punctuation and line breaks don't count as edits. Spans are in words from 0.

Defined cases: a null text is an empty one: no words, no labels, score 0; repeated rows and repeated
notices count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from millrace.llm.batches import map_texts

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices for the fuzzy search and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10
#: Pieces of text whose matches are kept while one text is searched; when there are more, they are searched anew.
KEPT_WINDOWS = 20_000

#: Bytes to themselves in lower case where they belong to a word, and to a space elsewhere.
_WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normalized(text: bytes) -> bytes:
    """The words of a text, lower-cased and joined by single spaces."""
    return b" ".join(text.translate(_WORD_BYTES).split())


class NoticeFinder:
    def __init__(self, notices: tuple = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = [(text, label, len(text) // chars_per_edit) for text, label in notices]
        self.fuzzy = [regex.compile(rf"(?be)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}") for text, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (text, _, k) in enumerate(self.notices):
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((n, a))
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def _matches(self, n: int, part: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) of a notice in a short piece of text; search() gives the best match, so both sides of it are left."""
        out, todo = [], [(0, len(part))]
        while todo:
            a, b = todo.pop()
            if m := self.fuzzy[n].search(part, a, b):
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                todo += [(m.end(), b), (a, m.start())]
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in characters of a normalized text; of overlapping matches that with the fewest edits, then the longest."""
        windows: dict[int, set[tuple[int, int]]] = {}
        found: set[tuple[int, int, int, int]] = set()
        for last, (size, uses) in self.seeds.iter(text):
            for n, offset in uses:
                notice, _, k = self.notices[n]
                begin = last + 1 - size - offset
                if begin >= 0 and text.startswith(notice, begin):  # no second match fits beside an exact one
                    found.add((begin, begin + len(notice), n, 0))
                    continue
                windows.setdefault(n, set()).add((max(0, begin - k), min(begin + len(notice) + k, len(text))))
        for n, runs in windows.items():
            seen: dict[str, list[tuple[int, int, int]]] = {}  # the same words give the same matches, wherever they stand
            for low, high in runs:  # one seed's own place at a time, so a row of notices is no long window
                part = text[low:high]
                if part not in seen:
                    if len(seen) >= KEPT_WINDOWS:
                        seen.clear()
                    seen[part] = self._matches(n, part)
                found.update((low + a, low + b, n, edits) for a, b, edits in seen[part])
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(found, key=lambda x: (x[3], x[0] - x[1], x)):  # kept ones don't overlap, so only the two around x can meet it
            at = bisect.bisect(kept, x)
            if (at == 0 or kept[at - 1][1] <= x[0]) and (at == len(kept) or x[1] <= kept[at][0]):
                kept.insert(at, x)
        return kept


@lru_cache(maxsize=2)
def finder(notices: tuple = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> NoticeFinder:
    return NoticeFinder(notices, chars_per_edit)


def scan(text: bytes | None) -> dict:
    """What one text holds: its words, base places, labels, spans of notices (in words) and score."""
    words = normalized(text or b"")
    padded = b" " + words + b" "
    base = []
    for phrase, label in PHRASES:
        wanted, at = b" " + phrase.encode() + b" ", -1
        while (at := padded.find(wanted, at + 1)) >= 0:
            base.append((padded.count(b" ", 0, at), label))
    notices = []
    plain = words.decode()
    for start, end, n, edits in finder().find(plain):
        inside = plain[start:end]
        start, end = start + len(inside) - len(inside.lstrip()), end - (len(inside) - len(inside.rstrip()))
        notices.append((plain.count(" ", 0, start), plain.count(" ", 0, end) + 1, finder().notices[n][1], edits, 1 - edits / len(finder().notices[n][0])))
    starts = [p for p, _ in base]
    return {
        "n_words": words.count(b" ") + 1 if words else 0,
        "n_base": len(base),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted({x for _, x in base} | {x[2] for x in notices})),
        "score": 1.0 if base else max((x[4] for x in notices), default=0.0),
        "notices": ",".join(f"{label}:{a}:{b}:{edits}" for a, b, label, edits, _ in sorted(notices)),
    }


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, base phrases, labels, score and the notices as label:first word:end word:edits."""

    def per_slice(ids: list, texts: list[bytes | None]) -> dict[str, list]:
        rows = [scan(t) for t in texts]
        return {"doc_id": ids} | {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")}

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"
    return map_texts(docs, id_col, text_col, schema, per_slice)
