"""Nested JSON: secret scan, sanitising and containment, each in one pass over the text's tokens. The secret
scan knows no depth; the other two go as deep as Spark's JSON parser, 1000 levels, and treat deeper text
as text that is not JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docwarden import vocab
from docwarden.functions import jsonwalk
from docwarden.functions.jsonwalk import Changes, decoded, let, quoted
from docwarden.functions.secrets import has_credential_value, is_sensitive_key, mask_credentials
from docwarden.functions.text import squeezed_key

NESTED_TEXTS = 2
#: JSON inside a text inside JSON is sanitised as JSON so many times over; as plain text below that.

_STRING = r'(?s)"(?:[^"\\]|\\.)*+"(?:\s*+:)?'


def has_secrets(json: Column, family: str = "audit") -> Column:
    """Whether JSON text holds a sensitive key or a credential-shaped value at any level.

    Keys and text values are the only string literals of JSON, so one pass over these sees all of
    them, however deep they are, and also where the text as a whole does not parse."""

    def secret(token: Column) -> Column:
        literal = F.regexp_replace(token, r"\s*:\z", "")
        return F.when(token.endswith(":"), is_sensitive_key(decoded(literal), family)).otherwise(
            has_credential_value(decoded(literal), family)
        )

    return F.coalesce(F.exists(F.regexp_extract_all(json, F.lit(_STRING), F.lit(0)), secret), F.lit(False))


def is_json_object(json: Column) -> Column:
    """Whether text parses as one JSON object; repeated keys do not."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.lit(False))


def sanitize_text(text: Column, *, nested: int = NESTED_TEXTS, keep_listings: bool = False) -> Column:
    """Mask credentials and cut to the text cap; JSON inside the text is sanitised as JSON."""

    def plain(value: Column) -> Column:
        return F.substring(mask_credentials(value), 1, vocab.TEXT_CAP)

    if not nested:
        return let(text, plain)

    def read(value: Column) -> Column:
        trimmed = F.trim(value)
        as_json = F.substring(_sanitized(trimmed, nested - 1, keep_listings), 1, vocab.TEXT_CAP)
        inner = F.when(trimmed.startswith("{") | trimmed.startswith("["), as_json)
        return F.coalesce(inner, plain(value))

    return let(text, read)


def _sanitized(json: Column, nested: int, keep_listings: bool) -> Column:
    """Sanitised JSON with the keys of each object in order, the last of repeated ones; null if the text
    is not JSON. A frame gathers the texts of its members; nothing is gathered where a key is dropped
    or masked, or beyond the cap of a list."""
    dropped = vocab.BODY_KEYS if keep_listings else vocab.BODY_KEYS + vocab.LISTING_KEYS

    def named(key: Column) -> Column:
        return F.when(key != "", sanitize_text(decoded(key), nested=0))

    def ruled(unit: Column) -> Column:
        """A key's name ``k``, what becomes of its value ``r``, and the value or bracket ``t``."""
        fold = lambda key: F.when(key.isin(*dropped), "drop").when(key.isin(*vocab.SECRET_KEYS), "mask").otherwise("")
        rule = F.when(unit["k"].isNotNull(), let(squeezed_key(unit["k"]), fold)).otherwise("")
        return F.struct(unit["k"].alias("k"), rule.alias("r"), unit["t"].alias("t"))

    def shown(unit: Column) -> Column:
        """``q`` is the key as it is written, ``t`` a scalar's text behind it."""
        written = F.when(unit["k"].isNotNull(), F.concat(quoted(unit["k"]), F.lit(":"))).otherwise("")
        text = F.when(unit["t"].startswith('"'), quoted(sanitize_text(decoded(unit["t"]), nested=nested, keep_listings=keep_listings))).otherwise(unit["t"])
        value = F.when(unit["r"] == "mask", f'"{vocab.MASKED}"').otherwise(text)
        class_ = jsonwalk.kind(unit["t"])
        scalar = F.when((class_ == "v") & (unit["r"] != "drop"), F.concat(written, value))
        return F.struct(class_.alias("c"), unit["k"].alias("k"), F.when(class_ != "v", written).alias("q"), unit["r"].alias("r"), scalar.alias("t"))

    keys, tokens = jsonwalk.items(json)
    units = F.arrays_zip(F.transform(keys, named).alias("k"), tokens.alias("t"))
    members = "array<struct<k:string,i:int,t:string>>"
    room = f"if(f.kind = '[', slice(run, 1, greatest({vocab.LIST_CAP} - f.n, 0)), run)"
    kept = f"transform(filter({room}, m -> m.r <> 'drop'), (m, i) -> named_struct('k', m.k, 'i', size(f.m) + i, 't', m.t))"
    hidden = f"f.r <> '' OR (f.kind = '[' AND f.n >= {vocab.LIST_CAP})"
    last = "filter(ms, (m, i) -> coalesce(get(ms, i + 1).k <> m.k, true))"
    joined = f"array_join(transform({last}, m -> m.t), ',')"
    listed = f"aggregate(cast(array() AS array<int>), sort_array(f.m), (ms, x) -> ms, ms -> {joined})"
    closed = f"if(f.kind = '{{', concat('{{', {listed}, '}}'), concat('[', array_join(transform(f.m, m -> m.t), ','), ']'))"
    member = f"named_struct('k', f.k, 'i', size(g.m), 't', concat(f.q, if(f.r = 'mask', '\"{vocab.MASKED}\"', {closed})))"
    made = jsonwalk.walk(
        F.transform(F.transform(units, ruled), shown),
        {"k": ("string", "''"), "q": ("string", "''"), "r": ("string", "''"), "m": (members, "array()")},
        {},
        run={"m": f"if(f.r <> '', f.m, concat(f.m, {kept}))"},
        open_={"k": "u.k", "q": "u.q", "r": f"if({hidden}, 'drop', u.r)", "m": f"cast(array() AS {members})"},
        close={"m": f"if(f.r = 'drop', g.m, array_append(g.m, {member}))"},
        note_run={},
        note_open={},
    )
    return let(made, lambda m: F.when(m["valid"], F.get(m["root"]["m"], F.lit(0))["t"]))


def sanitize_json(json: Column, *, keep_listings: bool = False) -> Column:
    """Bounded diagnostic form of JSON: body keys removed, secret keys masked, credential values
    masked, lists and texts capped, at every depth that parses. ``keep_listings`` keeps ``items`` and ``data``, as for a
    successful response. Text that is not JSON is treated as plain text."""
    return F.coalesce(_sanitized(json, NESTED_TEXTS, keep_listings), sanitize_text(json, nested=0))


def sanitize_map(values: Column, *, keep_listings: bool = False) -> Column:
    """The same for a string map, which stays inside the map type."""
    dropped = vocab.BODY_KEYS if keep_listings else vocab.BODY_KEYS + vocab.LISTING_KEYS
    kept = F.map_filter(values, lambda k, _: ~squeezed_key(k).isin(*dropped))
    return F.transform_values(
        kept,
        lambda k, v: F.when(squeezed_key(k).isin(*vocab.SECRET_KEYS), vocab.MASKED).otherwise(
            sanitize_text(v, keep_listings=keep_listings)
        ),
    )


GATHERED = 256


def json_entries(json: Column) -> Column:
    """A struct with ``valid`` and ``entries`` of JSON text: one (``list``, ``entry``) for every value, where
    ``entry`` is the digest of the value's path and its canonical text (``{`` or ``[`` for a container), and
    ``list`` the outermost list it lies in or is, by its path's digest. Equal numbers have one text,
    and true and false are 1 and 0."""

    def canonical(token: Column) -> Column:
        number = token.try_cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        spelled = F.when(token.rlike(r"^-?[0-9]+\z"), F.when(token == "-0", "0").otherwise(token)).otherwise(
            F.when(whole, F.floor(number).cast("string")).otherwise(number.cast("string"))
        )
        literal = F.when(token.contains("\\"), quoted(decoded(token))).otherwise(token)
        return F.when(token.startswith('"'), literal).when(token == "true", "1").when(token == "false", "0").when(token == "null", token).otherwise(spelled)

    path = "md5(concat(f.p, if(f.kind = '{{', {0}.k, cast({1} AS string))))".format
    inside = f"CASE WHEN f.l <> '' THEN f.l WHEN u.c = '[' THEN {path('u', 'f.n')} ELSE '' END"
    opened = f"array(named_struct('list', {inside}, 'entry', concat({path('u', 'f.n')}, u.c)))"
    listed = f"transform(run, (v, i) -> named_struct('list', f.l, 'entry', concat({path('v', 'f.n + i')}, v.t)))"
    entries = "array<struct<list:string,entry:string>>"

    def read(unit: Column) -> Column:
        key = F.when(unit["k"] != "", canonical(unit["k"])).otherwise("")
        class_ = jsonwalk.kind(unit["t"])
        return F.struct(class_.alias("c"), key.alias("k"), F.when(class_ == "v", canonical(unit["t"])).alias("t"))

    def gathered(new: str) -> Changes:
        return {
            "some": f"if(size(a.some) < {GATHERED}, concat(a.some, {new}), {new})",
            "more": f"if(size(a.some) < {GATHERED}, a.more, array_append(a.more, a.some))",
        }

    keys, tokens = jsonwalk.items(json)
    made = jsonwalk.walk(
        F.transform(F.arrays_zip(keys.alias("k"), tokens.alias("t")), read),
        {"p": ("string", "''"), "l": ("string", "''")},
        {"some": (entries, "array()"), "more": (f"array<{entries}>", "array()")},
        run={},
        open_={"p": path("u", "f.n"), "l": inside},
        close={},
        note_run=gathered(listed),
        note_open=gathered(opened),
    )
    return let(made, lambda m: F.struct(m["valid"].alias("valid"), F.flatten(F.array_append(m["more"], m["some"])).alias("entries")))


def config_contains(actual: Column, expected: Column) -> Column:
    """Whether every field of the expected JSON object has the same value in the actual one, at every
    depth; lists are compared as a whole. Text that does not parse, or repeats a key, contains nothing and
    is in nothing."""

    def once(found: Column) -> Column:
        paths = F.transform(found["entries"], lambda x: F.substring(x["entry"], 1, 32))
        return found["valid"] & (F.size(F.array_distinct(paths)) == F.size(paths))

    def compare(want: Column) -> Column:
        entries = lambda found: F.transform(found, lambda x: x["entry"])
        lists = F.array_distinct(F.transform(F.filter(want["entries"], lambda x: x["list"] != ""), lambda x: x["list"]))

        def beside(have: Column) -> Column:
            asked, held = entries(want["entries"]), entries(have["entries"])
            in_lists = entries(F.filter(have["entries"], lambda x: (x["list"] != "") & F.array_contains(lists, x["list"])))
            return once(want) & once(have) & (F.size(F.array_except(asked, held)) == 0) & (F.size(F.array_except(in_lists, asked)) == 0)

        return let(json_entries(actual.cast("string")), beside)

    return F.coalesce(let(json_entries(expected.cast("string")), compare), F.lit(False))


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with keys in sorted order and nulls kept."""
    fields = [columns[k].alias(k) for k in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
