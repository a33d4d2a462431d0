"""Licence scan: one automaton finds tags and notices, a shunting-yard parser evaluates licence expressions.

The automaton runs over the words of a text, joined by single spaces. Phrases with a fixed
label count as base hits. A notice gives the identifier of the licence it belongs to. A tag
is followed by an expression of identifiers with and, or, with and parentheses; it gives
every identifier in it, and its worth counts and as the least, or as the greatest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase and label, as the contract fixes them.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of public licences, and their SPDX identifiers.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu general public license version 2": "gpl-2.0-only",
    "gnu general public license version 3": "gpl-3.0-only",
    "gnu lesser general public license": "lgpl-3.0-only",
    "gnu affero general public license": "agpl-3.0-only",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "creative commons zero": "cc0-1.0",
    "cc0 1 0 universal": "cc0-1.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "spdx license expression", "license expression")
#: How freely a text may be used, by the start of an identifier; the longest start counts.
WORTH = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "0bsd": 1.0, "cc-by-": 0.9, "mpl": 0.6, "epl": 0.6,
    "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "all-rights": 0.0,
}
UNKNOWN = 0.5
#: What counts as an identifier after a tag: a known start, a version in it, or a reference of the writer's own.
_NAMED = re.compile(r"(?:%s)|.*\d|licenseref-" % "|".join(sorted(WORTH)))

#: A-Z to lower case; other ASCII that is neither a digit nor a letter to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[ \t\r\f\v]*(?:([()])|([a-z0-9][a-z0-9.+\-]*))")
#: What may stand between a tag and its expression.
_LEAD = re.compile(r"[ \t:=\"']*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def worth(identifier: str) -> float:
    return WORTH.get(max((p for p in WORTH if identifier.startswith(p)), key=len, default=""), UNKNOWN)


def evaluate(text: str) -> tuple[set[str], float] | None:
    """The identifiers and the worth of the longest expression that text starts with; None if it starts with none. Case doesn't count."""
    return expression(text.lower(), 0)


def expression(text: str, at: int) -> tuple[set[str], float] | None:
    """As ``evaluate``, of what stands at a place of a lower-cased text; only the expression itself is read.

    with binds closest, then and, then or. The right side of with is an exception, not a
    licence, and doesn't lower the worth. A word that is no identifier ends the expression,
    and so does the end of the line.
    """
    postfix, stack, operand = [], [], True
    open_ = 0
    while m := _TOKEN.match(text, at):
        mark, word = m.groups()
        if operand:  # an identifier or an opening bracket
            if mark == ")" or word in _BINDS:
                break
            if mark:
                stack.append("(")
                open_ += 1
            else:
                if not (_NAMED.match(word) or stack and stack[-1] == "with"):
                    break
                postfix.append((word.rstrip(".-"), None))
                operand = False
        elif mark == ")":
            if not open_:
                break
            while stack[-1] != "(":
                postfix.append((None, stack.pop()))
            stack.pop()
            open_ -= 1
        elif word in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                postfix.append((None, stack.pop()))
            stack.append(word)
            operand = True
        else:
            break
        at = m.end()
    while stack:
        if (op := stack.pop()) != "(":
            postfix.append((None, op))
    values: list[tuple[set[str], float]] = []
    for name, op in postfix:
        if op is None:
            values.append(({name}, worth(name)))
        elif len(values) > 1:  # an operator at the end lacks its right side
            (right, r), (left, v) = values.pop(), values.pop()
            if op != "with":  # the smaller set goes into the larger one
                left, right = sorted((left, right), key=len, reverse=True)
                left |= right
                v = max(v, r) if op == "or" else min(v, r)
            values.append((left, v))
    return values[-1] if values else None


def automaton(base: dict[str, str]) -> ahocorasick.Automaton:
    out, kinds = ahocorasick.Automaton(), {}
    for kind, phrases in (("base", base), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            kinds.setdefault(phrase, []).append((kind, label))
    for phrase, meaning in kinds.items():
        out.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, meaning))
    out.make_automaton()
    return out


def scan_text(found: ahocorasick.Automaton, text: bytes) -> tuple:
    words = text.translate(_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    hits = list(found.iter(line))
    if not hits:
        return len(words), 0, None, None, "", "", 1.0
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    base, labels, score, starts, ends, low = set(), set(), 1.0, [], [], ""
    for end, (size, n, meaning) in hits:
        word = int(np.searchsorted(spaces, end - size + 1))
        for kind, label in meaning:
            if kind == "base":
                starts.append(word)
                base.add(label)
                labels.add(label)
                score = min(score, worth(label))
            elif kind == "notice":
                labels.add(label)
                score = min(score, worth(label))
            else:
                if not low:  # once a text, whatever the number of its tags
                    ends, low = [m.end() for m in _WORD.finditer(text.lower())], text.lower().decode("latin-1")
                if got := expression(low, _LEAD.match(low, ends[word + n - 1]).end()):
                    labels |= got[0]
                    score = min(score, got[1])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE) -> DataFrame:
    """One row for each row of docs: (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. n_base
    counts every place of a base phrase, overlapping or not; first_word and last_word are
    the least and greatest word such a place starts at, null if there is none. labels holds
    the base labels, those of notices and the identifiers in tagged expressions. score is
    the least worth of all that was found, 1 where nothing was. Null texts are empty.
    Identifiers and repeated rows pass through; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(base)
        for b in batches:
            rows = [scan_text(found, x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    return out.withColumnRenamed("id", id_col)
