"""License scans: exact seeds of short notices, then matching with a bounded number of edits."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slim.llm.common import bound_batches, joined_bytes


@dataclass(frozen=True)
class Notice:
    """A short notice in normal form (words with one space between), how many
    character edits it may have, and the words that an edit must not touch."""

    label: str
    text: str
    edits: int = 3
    core: tuple[str, ...] = ()


# Notices as licences word them, in lower case without punctuation.
NOTICES = (
    Notice("mit", "released under the mit license", 3, ("mit",)),
    Notice("mit", "licensed under the mit license", 3, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    Notice("apache-2", "licensed under the apache license version 2 0", 3, ("2",)),
    Notice("cc-by", "licensed under cc by 4 0", 2, ("cc", "by")),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2, ("cc", "by", "nc")),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2, ("cc", "by", "sa")),
    Notice("gpl-2", "gnu general public license version 2", 3, ("2",)),
    Notice("gpl-3", "gnu general public license version 3", 3, ("3",)),
    Notice("lgpl", "gnu lesser general public license", 3, ("lesser",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 4),
    Notice("mpl-2", "mozilla public license version 2 0", 3, ("2",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 4),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 4),
    Notice("all-rights-reserved", "all rights reserved", 2),
)

SPAN = "struct<label:string, notice:string, found:string, first_word:bigint, n_words:bigint, edits:int>"

# A-Z to lower case; every other ASCII character but digits and a-z parts words.
FOLD = bytes(ord(c.lower()) if c.isalnum() else 32 for c in map(chr, range(128))) + bytes(range(128, 256))


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """Pigeonhole: ``edits + 1`` parts of about equal length. A text within that
    many edits of the notice has one of them unchanged. (offset, part)."""
    n, parts = len(notice.text), notice.edits + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, notice.text[a:z]) for a, z in zip(cuts, cuts[1:])]


class Scanner:
    """All seeds and base phrases in one automaton; one fuzzy pattern per notice."""

    def __init__(self, notices, phrases: dict[str, str]):
        import ahocorasick
        import regex

        self.notices, seeds = notices, {}
        for i, notice in enumerate(notices):
            if len(notice.text) <= notice.edits:
                raise ValueError(f"a notice must be longer than its edits: {notice.text!r}")
            for offset, part in pieces(notice):
                seeds.setdefault(part, []).append((i, offset))
        for phrase, label in phrases.items():
            seeds.setdefault(f" {phrase} ", []).append((label, None))
        self.automaton = ahocorasick.Automaton()
        for part, uses in seeds.items():
            self.automaton.add_word(part, (len(part), uses))
        if seeds:
            self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices]

    def scan(self, words: list[bytes]):
        """(places of base phrases as (word, label), spans as (label, notice, found, first word, words, edits))."""
        text = " " + b" ".join(words).decode("utf-8", "replace") + " "
        places, windows = [], {}
        if len(self.automaton):
            for end, (size, uses) in self.automaton.iter(text):
                start = end - size + 1
                for i, offset in uses:
                    if offset is None:
                        places.append((start, i))
                    else:
                        notice, grown = self.notices[i], windows.setdefault(i, [])
                        a = max(0, start - offset - notice.edits)
                        z = start - offset + len(notice.text) + notice.edits
                        if grown and a <= grown[-1][1]:
                            grown[-1][0], grown[-1][1] = min(a, grown[-1][0]), max(z, grown[-1][1])
                        else:
                            grown.append([a, z])
        spans = []
        for i, grown in windows.items():
            for a, z in merged(grown):
                spans += [(i, *hit) for hit in self.verified(i, text, a, min(z, len(text)))]
        if not places and not spans:
            return [], []
        gaps = [p for p, c in enumerate(text) if c == " "]
        word_at = lambda p: bisect_left(gaps, p + 1) - 1  # noqa: E731  (which word holds character p, or follows it)
        out = []
        for i, start, stop, edits in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
            first, last = word_at(start + (text[start] == " ")), word_at(stop - 1 - (text[stop - 1] == " "))
            found = text[gaps[first] + 1 : gaps[last + 1]]
            if all(c in found.split(" ") for c in self.notices[i].core):
                out.append((self.notices[i].label, self.notices[i].text, found, first, last - first + 1, edits))
        return [(word_at(p + 1), label) for p, label in places], out

    def verified(self, i, text, a, z):
        """Matches of notice ``i`` between two places, without spaces at their ends: (start, stop, edits)."""
        for m in self.patterns[i].finditer(text, a, z):
            if m.group().strip(" "):
                yield m.start(), m.end(), sum(m.fuzzy_counts)


def merged(windows: list[list[int]]) -> list[list[int]]:
    """Windows that meet become one; the pattern runs once over each."""
    out = []
    for a, z in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str], notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """License notices in each whole text, exact phrases and notices with edits.

    A text is lower-cased in A-Z and cut into words of digits, a-z and characters
    beyond ASCII. ``phrases`` (words with one space between: label) are found
    where their words stand consecutively. A notice is found where a stretch of
    the words, joined by spaces, is within its number of character edits: one of
    its ``edits + 1`` pieces is there unchanged, which one automaton over all
    pieces finds in a single pass; around these seeds the regex library's
    bounded-error matching decides and gives the span, from the left and without
    overlaps of one notice. A match must hold the notice's core words unedited.

    Memory is a batch of texts (by bytes); a row needs nothing but itself. Null
    text is empty, empty texts and texts without words have no places; bytes that
    are not UTF-8 count as characters of words. Repeated rows give repeated
    results, null ids are passed on; empty input gives no rows; other columns are
    not read, whatever their names.

    Returns id, n_words, places (array of first_word, label), spans (array of
    label, notice, found, first_word, n_words, edits) and score: 1 with a base
    phrase or an unedited notice, else the best of 1 - edits / (allowed + 1), else 0."""
    phrases, notices = dict(phrases), tuple(notices)
    allowed = {n.text: n.edits + 1 for n in notices}

    def run(batches):
        scanner = Scanner(notices, phrases)
        for batch in batches:
            flat, ends = joined_bytes(batch.column("_text"))
            data, ends = flat.tobytes(), ends.tolist()
            counts, places, spans, scores = [], [], [], []
            for a, z in zip(ends, ends[1:]):
                words = data[a:z].translate(FOLD).split(b" ")
                words = [w for w in words if w]
                base, fuzzy = scanner.scan(words)
                counts.append(len(words))
                places.append([{"first_word": w, "label": x} for w, x in sorted(base)])
                spans.append([dict(zip(("label", "notice", "found", "first_word", "n_words", "edits"), s)) for s in fuzzy])
                scores.append(1.0 if base else max((1 - s[5] / allowed[s[1]] for s in fuzzy), default=0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(counts, pa.int64()), pa.array(places, PLACES), pa.array(spans, SPANS), pa.array(np.array(scores, np.float64))],
                names=["_id", "n_words", "places", "spans", "score"],
            )

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    made = narrow.mapInArrow(run, f"_id {kind}, n_words bigint, places array<struct<first_word:bigint, label:string>>, spans array<{SPAN}>, score double")
    return made.withColumnRenamed("_id", id_col)


PLACES = pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))
SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("notice", pa.string()), ("found", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])
)
