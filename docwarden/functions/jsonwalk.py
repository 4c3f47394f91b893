"""One pass over JSON text, as a built-in expression.

A regular expression cuts the text into units: a value with its key, or the beginning or end of a container. Values
that follow each other in a container form a run, so that the one ``aggregate``, a pushdown machine, takes a step for a
run and not for every token. Its stack holds a frame for every open container, in chunks of ``CHUNK``. Spark copies the
state at every step, so a walk costs steps times the depth and what a pass gathers. The machine is SQL text, which
Spark parses at once, where thousands of column calls would take seconds."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

CHUNK = 64
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SPACE = r"[ \t\n\r]*+"
#: Group 1 is a key's literal, group 2 a scalar, brace or bracket; both are empty for what is neither.
UNITS = rf'(?s)(?:,{_SPACE})?+(?:({_STRING}){_SPACE}:{_SPACE})?+([{{}}\[\]]|{_STRING}|[^ \t\n\r{{}}\[\],:"]++)|[^ \t\n\r]'

Changes = dict[str, str]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for several uses in ``body``. The end of a fold over nothing does so without
    the copy that ``transform`` makes of every result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def decoded(literal: Column) -> Column:
    """Text of a JSON string literal."""
    bare = F.substring(literal, F.lit(2), F.length(literal) - 2)
    read = F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(literal.contains("\\"), F.coalesce(read, bare)).otherwise(bare)


def quoted(text: Column) -> Column:
    """A JSON string literal."""
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    written = let(F.to_json(F.array(text)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(text.rlike(r'["\\\x00-\x1F]'), written).otherwise(plain)


def items(text: Column) -> tuple[Column, Column]:
    """The units of JSON text as two arrays: literals of keys (empty in a list) and scalars, braces and brackets.
    Both are null if the text does not begin with JSON."""
    # Spark's own parser refuses repeated keys and more than 1000 levels. It reads one value and nothing
    # behind it, so up to there the units are JSON; ``walk`` refuses a text that goes on, save after a key.
    parsed = F.when(F.try_parse_json(text).isNotNull() & ~text.rlike(rf"(?s)^{_SPACE}{_STRING}{_SPACE}:"), text)
    return F.regexp_extract_all(parsed, F.lit(UNITS), F.lit(1)), F.regexp_extract_all(parsed, F.lit(UNITS), F.lit(2))


def kind(token: Column) -> Column:
    """A unit's class: the brace or bracket, or ``v`` for a scalar."""
    return F.when(token.isin("{", "}", "[", "]"), token).otherwise("v")


# Where a step begins: at every brace and bracket, and at the first scalar behind one.
_STARTS = "filter(sequence(0, size(us) - 1), i -> i = 0 OR us[i].c <> 'v' OR us[i - 1].c <> 'v')"
_STEPS = "transform(at, (i, n) -> named_struct('i', i, 'size', coalesce(get(at, n + 1), size(us)) - i))"
_STEPS = f"aggregate(cast(array() AS array<int>), {_STARTS}, (at, x) -> at, at -> {_STEPS})"


def _struct(names: dict[str, str], old: str, changes: Changes) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {changes.get(k, f'{old}.{k}')}" for k in names) + ")"


def walk(
    units: Column, frame: dict[str, tuple[str, str]], state: dict[str, tuple[str, str]], *,
    run: Changes, open_: Changes, close: Changes, note_run: Changes, note_open: Changes,
) -> Column:
    """The final state of a walk over ``units``, structs with their ``kind`` as ``c``, as a struct: ``valid``,
    ``root`` (the root's frame) and the state's fields.

    ``frame`` and ``state`` have type and first value of a pass's own fields. A frame also has ``kind`` (``{``,
    ``[``, empty for the root) and ``n`` (values that ended in it). The other arguments are changes in SQL:
    of the frame ``f`` at a ``run`` of ``x.size`` units; of the new frame where a container opens in ``f`` with the unit ``u``; of
    the frame ``g`` in which the frame ``f`` closes; and of the state ``a`` at runs and openings."""
    kinds = {"kind": "string", "n": "int"} | {k: t for k, (t, _) in frame.items()}
    ddl = "struct<" + ",".join(f"{k}:{t}" for k, t in kinds.items()) + ">"
    states = {"b": f"array<array<{ddl}>>", "s": f"array<{ddl}>"} | {k: t for k, (t, _) in state.items()}
    whole = "struct<" + ",".join(f"{k}:{t}" for k, t in states.items()) + ">"
    root = _struct(kinds, "", {"kind": "''", "n": "0", **{k: v for k, (_, v) in frame.items()}})
    zero = f"cast({_struct(states, '', {'b': 'array()', 's': f'array({root})', **{k: v for k, (_, v) in state.items()}})} AS {whole})"

    def moved(**changes: str) -> str:
        return _struct(states, "a", changes)

    under = "slice(a.s, 1, size(a.s) - 1)"
    on_top = lambda changes: f"array_append({under}, {_struct(kinds, 'f', changes)})"
    opened = _struct(kinds, "", {"kind": "u.c", "n": "0", **open_})
    parent = _struct(kinds, "g", {"n": "g.n + 1", **close})
    last_chunk = "get(a.b, size(a.b) - 1)"
    before = f"if(size(a.s) > 1, slice(a.s, 1, size(a.s) - 2), slice({last_chunk}, 1, size({last_chunk}) - 1))"
    closed = moved(b="if(size(a.s) > 1, a.b, slice(a.b, 1, size(a.b) - 1))", s=f"array_append({before}, {parent})")
    full = f"size(a.s) >= {CHUNK}"
    pushed = moved(b=f"if({full}, array_append(a.b, a.s), a.b)", s=f"if({full}, array({opened}), array_append(a.s, {opened}))", **note_open)
    # The state never passes through a cast or another lambda, which would copy all it holds at every
    # step; so frames are spelled out. A second value in the root stays there as one too many.
    step = f"""CASE WHEN f.kind = '' AND f.n > 0 THEN {moved(s=on_top({"n": "2"}))}
        WHEN u.c = 'v' THEN {moved(s=on_top({"n": "f.n + x.size", **run}), **note_run)}
        WHEN u.c IN ('{{', '[') THEN {pushed} ELSE {closed} END"""
    step = re.sub(r"\bg\.", f"if(size(a.s) > 1, element_at(a.s, -2), element_at({last_chunk}, -1)).", step)
    step = re.sub(r"\bu\.", "us[x.i].", re.sub(r"\bf\.", "element_at(a.s, -1).", step))
    step = re.sub(r"\brun\b", "slice(us, x.i + 1, x.size)", step)
    top = "element_at(a.s, -1)"
    out = f"named_struct('valid', {top}.kind = '' AND {top}.n = 1, 'root', {top}{''.join(f', {chr(39)}{k}{chr(39)}, a.{k}' for k in state)})"
    walked = f"us -> if(us IS NULL, NULL, aggregate({_STEPS}, {zero}, (a, x) -> {step}, a -> {out}))"
    return F.call_function("aggregate", F.expr("cast(array() AS array<int>)"), units, F.expr("(us, x) -> us"), F.expr(walked))
