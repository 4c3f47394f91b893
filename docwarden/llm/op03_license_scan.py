"""License scans by matching template markup.

A template is license wording with markup: ``<<beginOptional>>...<<endOptional>>`` may be absent,
``<<var;match="[0-9]+";words="1-3">>`` stands for that many words, each of which the pattern accepts
as a whole. Everything else is mandatory and must be there word for word. Templates are compiled into
one automaton over words. It is started wherever a template can begin; a place is accepted when a
template's end is reached, so all its mandatory wording was read consecutively.

A task finds the words of a block of texts with array operations, looks for the few words that can
begin a template with substring searches, and runs the automaton from these places only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.llm.common import ASCII_LOWER, blocks, documents, inside_table, joined, query, spans, text_bytes

INSIDE = inside_table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
#: After lower-casing A-Z a word is a run of bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and labels of the base scan.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

OPTIONAL = "<<beginOptional>>", "<<endOptional>>"
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        ' <<var;match="\\w+";words="1-2">> and associated documentation files'
    ),
    "apache-2-notice": (
        "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0"
        " <<beginOptional>>the License<<endOptional>>"
    ),
    "gpl": 'GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>',
    "gpl-2": "GNU General Public License <<beginOptional>>, either<<endOptional>> <<beginOptional>>version<<endOptional>> 2",
    "gpl-3": "GNU General Public License <<beginOptional>>, either<<endOptional>> <<beginOptional>>version<<endOptional>> 3",
    "lgpl": "GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Library<<endOptional>> General Public License <<beginOptional>>version<<endOptional>> 2.1",
    "agpl-3": "GNU Affero General Public License <<beginOptional>>version<<endOptional>> 3",
    "mpl-2": "Mozilla Public License <<beginOptional>>, v.<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met"
    ),
    "cc-by": 'CC BY <<var;match="[1-4]";words="1-1">>',
    "cc-by-sa": "CC BY SA",
    "cc-by-nc-version": 'CC BY NC <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> <<var;match="[1-4]";words="1-1">>',
}
MARKUP = re.compile(r"(<<.*?>>)", re.S)


@dataclass
class Automaton:
    """States with moves on a word, moves on a pattern, and silent moves; lazily made deterministic."""

    words: list[dict[bytes, set[int]]] = field(default_factory=list)
    patterns: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    silent: list[set[int]] = field(default_factory=list)
    ends: dict[int, str] = field(default_factory=dict)
    starts: set[int] = field(default_factory=set)
    moves: dict[tuple[frozenset, bytes], frozenset] = field(default_factory=dict)

    def state(self) -> int:
        self.words.append({}), self.patterns.append([]), self.silent.append(set())
        return len(self.words) - 1

    def closure(self, states: set[int]) -> frozenset:
        open_, seen = list(states), set(states)
        while open_:
            for other in self.silent[open_.pop()] - seen:
                seen.add(other), open_.append(other)
        return frozenset(seen)

    def add(self, label: str, template: str) -> None:
        at = self.state()
        self.starts.add(at)
        optional: list[int] = []
        for part in MARKUP.split(template):
            if part == OPTIONAL[0]:
                optional.append(at)
            elif part == OPTIONAL[1]:
                if not optional:
                    raise ValueError(f"{label}: an optional region ends that has not begun")
                self.silent[optional.pop()].add(at)
            elif part.startswith("<<var"):
                given = dict(re.findall(r'(\w+)="(.*?)"', part))
                pattern = re.compile(given.get("match", r"\w+").encode())
                least, most = map(int, given.get("words", "1-1").split("-"))
                for n in range(most):
                    after = self.state()
                    self.patterns[at].append((pattern, after))
                    if n >= least:
                        self.silent[at].add(after)
                    at = after
                if least == 0:
                    raise ValueError(f"{label}: write an optional region around a variable that may be absent")
            elif part.startswith("<<"):
                raise ValueError(f"{label}: unknown markup {part}")
            else:
                for word in WORD.findall(part.encode().translate(ASCII_LOWER)):
                    after = self.state()
                    self.words[at].setdefault(word, set()).add(after)
                    at = after
        if optional:
            raise ValueError(f"{label}: an optional region is not closed")
        self.ends[at] = label

    def first_words(self) -> set[bytes]:
        """Words with which a template can begin; a template that could begin with anything is an error."""
        states = self.closure(self.starts)
        if any(self.patterns[s] for s in states) or any(s in self.ends for s in states):
            raise ValueError("a template must begin with wording")
        return {word for s in states for word in self.words[s]}

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = states, word
        if (known := self.moves.get(key)) is None:
            to = {t for s in states for t in self.words[s].get(word, ())}
            to |= {t for s in states for pattern, t in self.patterns[s] if pattern.fullmatch(word)}
            known = self.closure(to) if to else frozenset()
            if len(self.moves) > 100_000:
                self.moves.clear()
            self.moves[key] = known
        return known

    def matches(self, words: Iterator[bytes]) -> list[tuple[str, int]]:
        """Labels accepted from the first word on, each with the most words it took."""
        states, found = self.closure(self.starts), {}
        for n, word in enumerate(words, 1):
            states = self.step(states, word)
            if not states:
                break
            for s in states:
                if s in self.ends:
                    found[self.ends[s]] = n
        return list(found.items())


def compile_templates(templates: Mapping[str, str]) -> Automaton:
    machine = Automaton()
    for label, template in templates.items():
        machine.add(label, template)
    return machine


def scan_block(machine: Automaton, first: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, str, int]]]]:
    """Number of words of each text, and its matches: (first word, label, words taken)."""
    lowered = [text.translate(ASCII_LOWER) for text in texts]
    data, begins = joined(lowered)
    starts, ends = spans(data, INSIDE)
    edge = np.searchsorted(starts, begins)
    buffer = data.tobytes()
    found: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    for word in first:
        at = buffer.find(word)
        while at >= 0:
            index = int(np.searchsorted(starts, at))
            if index < len(starts) and starts[index] == at and ends[index] == at + len(word):
                row = int(np.searchsorted(begins, at, side="right")) - 1
                last = int(edge[row + 1])
                rest = (buffer[starts[k] : ends[k]] for k in range(index, last))
                found[row] += [(index - int(edge[row]), label, n) for label, n in machine.matches(rest)]
            at = buffer.find(word, at + len(word))
    return np.diff(edge), found


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_matches", pa.int64()),
])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_matches long"


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, base: Mapping[str, str] = BASE) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``n_words`` counts all words; ``n_base``, ``first_word`` and ``last_word`` cover the places of the
    base phrases (words from 0, null without a place); ``base_labels`` and ``labels`` are distinct,
    sorted and comma-joined, empty without a match; ``n_matches`` counts all accepted places and
    templates; ``score`` is the share of the words that lie in accepted places. A null or empty text
    has no words and score 0. Repeated rows are answered each; an empty table gives no rows."""
    named = {f"base {label} {n}": phrase for n, (phrase, label) in enumerate(base.items())}
    base_of = {f"base {label} {n}": label for n, label in enumerate(base.values())}
    everything = {**named, **{f"own {label}": text for label, text in templates.items()}}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_templates(everything)
        first = sorted(machine.first_words())
        for block in blocks(batches, "text"):
            counts, found = scan_block(machine, first, text_bytes(block.column(1)))
            out = []
            for n_words, places in zip(counts.tolist(), found, strict=True):
                in_base = [(at, base_of[label]) for at, label, _ in places if label in base_of]
                labels = {base_of.get(label, label.removeprefix("own ")) for _, label, _ in places}
                covered = set().union(*(range(at, at + n) for at, _, n in places))
                out.append((
                    n_words, len(in_base), min(in_base)[0] if in_base else None, max(in_base)[0] if in_base else None,
                    ",".join(sorted({label for _, label in in_base})), ",".join(sorted(labels)),
                    len(covered) / n_words if n_words else 0.0, len(places),
                ))
            columns = list(zip(*out, strict=True))
            arrays = [block.column(0)] + [pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(work, DDL)


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
