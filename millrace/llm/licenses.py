"""License scans: short notices found with a bounded number of errors.

A text becomes its words in lower case with one blank between them, so that marks and line breaks don't count. A notice
of which a text may miss `k` characters is split into k + 1 pieces: of any place with at most k errors, one piece is
whole (pigeonhole). An automaton of all pieces finds those seeds in one pass over the text; where one stands tells
where the notice would begin, give or take k. Seeds of one place make one window, in which the regex library's
bounded-error matching finds the best fit and its errors. So no notice within its errors is missed, and the texts that
hold no seed cost one pass. Windows seen before are remembered, which makes copies cheap.

Base phrases are places where their words stand one after the other; their labels stay whatever the notices add.

Null texts are empty. Repeated rows give repeated rows. A text is searched whole, and held in memory as a few copies of
itself. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import at_blanks, query, rows_of, table

#: Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices by label, as words.
NOTICES = {
    "agpl": ["gnu affero general public license"],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "spdx license identifier apache 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "licensed under the bsd license",
        "released under the bsd license",
    ],
    "cc-by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike"],
    "cc0": ["to the extent possible under law the author has waived all copyright", "released under cc0 1 0 universal"],
    "epl": ["made available under the terms of the eclipse public license"],
    "gpl": [
        "licensed under the gnu general public license",
        "redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["gnu lesser general public license"],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "released under the mit license",
        "licensed under the mit license",
        "spdx license identifier mit",
    ],
    "mpl": ["subject to the terms of the mozilla public license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
#: One error is let pass for so many characters of a notice.
CHARS_AN_ERROR = 15

_APART = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_PLAIN = bytes.maketrans(_APART, b" " * len(_APART))
_WORD = regex.compile(rb"[0-9a-z\x80-\xff]+")


def plain_words(text: bytes) -> str:
    """Words in lower case (A to Z only), one blank between them and at either end; a blank if there are none."""
    found = b" ".join(filter(None, (b" ".join(part.split()) for part in at_blanks(text.lower().translate(_PLAIN))))).decode()
    return f" {found} " if found else " "


def word_numbers(text: str, places: Iterable[int]) -> dict[int, int]:
    """The number, from 0, of the word that starts behind the blank at each place; the text is read once."""
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += text.count(" ", at, place)
        at = place
        out[place] = n
    return out


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of about one size."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(s, notice[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """Searches blank-separated words, with a blank at either end, for notices."""

    def __init__(self, notices: Mapping[str, Sequence[str]], chars_an_error: int = CHARS_AN_ERROR, remembered: int = 1 << 16):
        import ahocorasick

        self.notices = [(label, f" {x} ") for label, some in sorted(notices.items()) for x in some]
        self.errors = [max(1, (len(x) - 2) // chars_an_error) for _, x in self.notices]
        self.fits = [regex.compile(f"(?b)(?:{regex.escape(x, literal_spaces=True)}){{e<={k}}}") for (_, x), k in zip(self.notices, self.errors, strict=True)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (_, x) in enumerate(self.notices):
            for at, piece in pieces(x, self.errors[n]):
                seeds.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        if seeds:
            self.automaton.make_automaton()
        self.seeds = seeds
        self.best = lru_cache(remembered)(self._best)

    def _best(self, n: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, errors) of the best fit in a window."""
        found = self.fits[n].search(window)
        return found and (found.start(), found.end(), sum(found.fuzzy_counts))

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of the places, by notice and start; of places of a notice that overlap, the one
        with the fewest errors, then the first."""
        begins: dict[int, list[int]] = {}
        if not self.seeds:
            return []
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                begins.setdefault(n, []).append(end + 1 - size - at)
        out = []
        for n in sorted(begins):
            size, k, own = len(self.notices[n][1]), self.errors[n], []
            at = sorted(begins[n])
            first = last = at[0]
            for b in [*at[1:], None]:
                if b is not None and b - first <= 2 * k:
                    last = b
                    continue
                low = max(first - k, 0)
                fit = self.best(n, text[low : last + size + k])
                if fit:
                    own.append((n, low + fit[0], low + fit[1], fit[2]))
                first = last = b
            chosen: list[tuple[int, int, int, int]] = []
            for place in sorted(set(own), key=lambda p: (p[1], p[2])):
                if chosen and place[1] < chosen[-1][2]:
                    if place[3] < chosen[-1][3]:
                        chosen[-1] = place
                else:
                    chosen.append(place)
            out += chosen
        return out


def base_places(text: str, base: Mapping[str, str]) -> list[tuple[int, str]]:
    """(word, label) of every place of a base phrase in words with a blank at either end."""
    out = []
    for phrase, label in base.items():
        whole, at = f" {phrase} ", -1
        while (at := text.find(whole, at + 1)) >= 0:
            out.append((at, label))
    number = word_numbers(text, (at for at, _ in out))
    return [(number[at], label) for at, label in out]


_MATCH = "label string, notice string, errors int, first_word long, n_words long, start long, end long, found string"
_SCAN = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _MATCH.split(', '))}>>"


def _scanned(id_type: pa.DataType, notices: Mapping[str, Sequence[str]], base: Mapping[str, str], chars_an_error: int):
    match = pa.struct([("label", pa.string()), ("notice", pa.string()), ("errors", pa.int32()), *[(n, pa.int64()) for n in ("first_word", "n_words", "start", "end")], ("found", pa.string())])
    schema = pa.schema([("id", id_type), *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.list_(pa.string())), ("matches", pa.list_(match))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices, chars_an_error)
        for batch in rows_of(batches):
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = plain_words(raw or b"")
                n_words = text.count(" ") - 1 if len(text) > 1 else 0
                places = base_places(text, base)
                starts, fits = [p for p, _ in places], []
                for n, s, e, errors in finder(text):
                    fits.append((n, s if text[s] == " " else text.rindex(" ", 0, s), e - 1 if text[e - 1] == " " else e, errors))
                number = word_numbers(text, (at for _, s, e, _ in fits for at in (s, e)))
                wanted = {w for _, s, e, _ in fits for w in (number[s], number[e] - 1)}
                span = {k: m.span() for k, m in zip(range(max(wanted, default=-1) + 1), _WORD.finditer(raw.lower()), strict=False) if k in wanted} if fits else {}
                found = []
                for n, s, e, errors in fits:
                    first, last = number[s], number[e] - 1
                    start, end = span[first][0], span[last][1]
                    label, notice = finder.notices[n]
                    found.append({
                        "label": label, "notice": notice.strip(), "errors": errors, "first_word": first, "n_words": last - first + 1,
                        "start": len(raw[:start].decode()), "end": len(raw[:end].decode()), "found": raw[start:end].decode(),
                    })
                rows.append((key, n_words, len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Mapping[str, Sequence[str]] = NOTICES,
    base: Mapping[str, str] = BASE, chars_an_error: int = CHARS_AN_ERROR,
) -> DataFrame:
    """A row per text: its id, n_words, the base phrases' n_base, first_word, last_word and base_labels, and `matches`:
    label, notice, errors, first_word, n_words, and the place in code points (start, end) of what was found."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").cast("binary").alias("text"))
    out = narrow.mapInArrow(_scanned(to_arrow_type(kind), dict(notices), dict(base), chars_an_error), f"id {kind.simpleString()}, {_SCAN}")
    return out.withColumnRenamed("id", id_col)


@query("op11_license_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    fits = F.transform("matches", lambda m: 1 - m["errors"] / F.length(m["notice"]))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(fits), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"),
    )
