"""Sensitive keys, placeholders, opaque values and credential shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docwarden import vocab
from docwarden.functions import rewrite
from docwarden.functions.text import SPACE, WORD_START, fold_letters, key_phrase, squeezed_key


def _words(values: tuple[str, ...]) -> str:
    return "(?:" + "|".join(values) + ")"


# --- fixed values: patterns of the preflight family ----------------------------------------
_S = "[" + SPACE + "]"
# The letters a case-insensitive A-Z matches in Unicode text; listed, because the flag is slow.
_ALPHA = r"A-Za-z\x{0130}\x{0131}\x{017F}\x{212A}"
_VALUE_CHARS = "[" + _ALPHA + "0-9._~+/=-]"
_DOUBLE_QUOTED = r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"'
_SINGLE_QUOTED = r"'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+'"
_PLACEHOLDER_BODY = (
    r"<(?:TOKEN|API_KEY|API_TOKEN|YOUR_[A-Z0-9_]+|[A-Z][A-Z0-9_]*(?:_TOKEN|_KEY|_SECRET))>"
    r"|\$\{[A-Z][A-Z0-9_]*\}|YOUR_[A-Z0-9_]+|EXAMPLE_[A-Z0-9_]+|CHANGEME|REDACTED|\[REDACTED\]"
)
_PLACEHOLDER_WORD = r"(?-i:YOUR_[A-Z0-9_]+|EXAMPLE_[A-Z0-9_]+|CHANGEME|REDACTED)"
PLACEHOLDER = r"^(?:" + _PLACEHOLDER_BODY + r")\z"
PLACEHOLDER_ANY_CASE = r"(?iu)" + PLACEHOLDER
KEY_BLOCK_HEADER = (
    r"(?iu)-----BEGIN(?: [A-Z0-9]++)++(?<= PRIVATE KEY| CERTIFICATE)-----"
)
_KEY = "[" + _ALPHA + "][" + _ALPHA + "0-9_.-]*+"
_BARE_VALUE = "[^" + SPACE + r",`}\]#]++"
ASSIGNMENT = (
    r"(?<quote>[\"']?)" + WORD_START + _KEY + r"\k<quote>" + _S + "*+[:=]" + _S + "*+(?:"
    + _DOUBLE_QUOTED + "|" + _SINGLE_QUOTED
    + "|(?i:Bearer)" + _S + r"++(?:(?i:\[REDACTED\])|" + _VALUE_CHARS + "++)"
    + "|<[^>" + SPACE + "]++>"
    + r"|\$\{[^}" + SPACE + r"]++\}"
    + r"|(?i:\[REDACTED\])|" + _BARE_VALUE + ")"
)
# A match of ASSIGNMENT taken apart: 1 head (quotes, key, separator), 2 key, 3 value.
ASSIGNMENT_PARTS = (
    r"^([\"']?(" + _KEY + r")[\"']?" + _S + "*+[:=]" + _S + r"*+)([\s\S]*)\z"
)
AUTHORIZATION_BEARER = (
    "(?iu)(" + WORD_START + "authorization" + _S + "*:" + _S + "*bearer" + _S + "+)"
    "(?!" + _PLACEHOLDER_WORD + "(?!" + _VALUE_CHARS + "))" + _VALUE_CHARS + "+"
)
BARE_BEARER = (
    "(?iu)(" + WORD_START + "bearer" + _S + "+)"
    "(?!" + _PLACEHOLDER_WORD + "(?!" + _VALUE_CHARS + "))" + _VALUE_CHARS + "{16,}"
)
# After an empty line no match can start that would not have started before it; saying so keeps
# long runs of empty lines linear.
OPAQUE_ASSIGNMENT = r"(?md)^(?<!\n\n)" + _S + "*([A-Za-z][A-Za-z0-9_.-]*+)" + _S + "*[:=]" + _S + "*([^" + SPACE + "#]++)"

# Cheap tests that a text can hold a match worth the array work.
ASSIGNMENT_TRIGGER = (  # over lower-case text
    r"(?:pass(?:word|phrase)|secret|credential|authorization"
    r"|(?:api|access|refresh|bearer|private)[^a-z0-9:=" + SPACE + r"]*(?:key|token))"
    r"[a-z0-9_.\x{0131}\x{017F}\x{0307}-]*[\"']?" + _S + "*[:=]"
)
BEARER_TRIGGER = "bearer" + _S
OPAQUE_TRIGGER = "[:=]" + _S + "*[A-Za-z0-9_+/-]{32}"


def may_assign(low: Column) -> Column:
    """Whether lower-case text holds the words of a sensitive key at all."""
    words = F.lit(False)
    for word in vocab.PREFLIGHT_KEY_WORDS:
        words |= low.contains(word)
    for pair in vocab.KEY_PAIRS:
        first, second = pair.split(" ")
        words |= low.contains(first) & low.contains(second)
    return words


def is_placeholder(value: Column, *, any_case: bool = False) -> Column:
    return value.rlike(PLACEHOLDER_ANY_CASE if any_case else PLACEHOLDER)


def unquote(value: Column) -> Column:
    """Drop one pair of equal quotes around a value."""
    return F.regexp_replace(value, r"^([\"'])([\s\S]*)\1\z", "$2")


def is_placeholder_assignment(value: Column) -> Column:
    return is_placeholder(F.regexp_replace(unquote(value), r"[.,;:!?]+\z", ""))


# --- sensitive keys ------------------------------------------------------------------------
def _ends_with(phrase: Column, words: tuple[str, ...]) -> Column:
    return phrase.rlike("(?:^| )" + _words(words) + "$")


def _has_any(phrase: Column, words: tuple[str, ...]) -> Column:
    return phrase.rlike("(?:^| )" + _words(words) + "(?: |$)")


def _preflight_key(key: Column) -> Column:
    phrase = key_phrase(key)
    return ~_ends_with(phrase, vocab.PREFLIGHT_SAFE_LAST_WORDS) & _has_any(
        phrase, vocab.PREFLIGHT_KEY_WORDS + vocab.KEY_PAIRS
    )


def _registry_key(key: Column) -> Column:
    phrase = key_phrase(key)
    compounds = tuple(pair.replace(" ", "") for pair in vocab.KEY_PAIRS)
    sensitive = (
        F.replace(phrase, F.lit(" "), F.lit("")).isin(*compounds)
        | _has_any(phrase, vocab.REGISTRY_KEY_WORDS + vocab.KEY_PAIRS)
        | _ends_with(phrase, ("token",))
    )
    exempt = (
        key.isin(*vocab.REGISTRY_EXEMPT_KEYS)
        | key.rlike(r"^(?:/|[A-Za-z]:[\\/])")
        | _ends_with(phrase, vocab.REGISTRY_SAFE_LAST_WORDS)
    )
    return sensitive & ~exempt


def _audit_key(key: Column) -> Column:
    squeezed = F.regexp_replace(fold_letters(key), "[_\\-." + SPACE + "]+", "")
    return squeezed.isin(
        *vocab.SECRET_KEYS, *vocab.BODY_KEYS, *vocab.LISTING_KEYS
    ) | squeezed.contains("privatekey")


def is_sensitive_key(key: Column, family: str = "preflight") -> Column:
    """Whether a key names a credential. Families: preflight, registry, audit, transport."""
    rules = {
        "preflight": _preflight_key,
        "registry": _registry_key,
        "audit": _audit_key,
        "transport": lambda k: squeezed_key(k).isin(*vocab.SECRET_KEYS),
    }
    return F.coalesce(rules[family](key), F.lit(False))


def is_hash_key(key: Column) -> Column:
    last = F.element_at(
        F.filter(F.split(fold_letters(key), "[_.-]+"), lambda part: part != ""), -1
    )
    return F.coalesce(last.isin(*vocab.HASH_KEY_LAST_WORDS), F.lit(False))


# --- opaque values -------------------------------------------------------------------------
def shannon_entropy(value: Column) -> Column:
    """Bits per character."""
    chars = F.split(value, "")
    total = F.size(chars)
    return F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: acc
        - (F.size(F.filter(chars, lambda x: x == c)) / total)
        * F.log2(F.size(F.filter(chars, lambda x: x == c)) / total),
    )


def char_class_count(value: Column) -> Column:
    """How many of lower-case letters, upper-case letters and digits occur."""
    return (
        value.rlike("[a-z]").cast("int")
        + value.rlike("[A-Z]").cast("int")
        + value.rlike("[0-9]").cast("int")
    )


def is_opaque_value(value: Column) -> Column:
    shaped = value.rlike(r"^[A-Za-z0-9_+/-]{%d,}\z" % vocab.OPAQUE_MIN_LENGTH)
    return F.when(
        shaped & (char_class_count(value) >= vocab.OPAQUE_MIN_CLASSES) & ~is_placeholder(value),
        # Rounded, so that a sum that is 4 bits exactly does not depend on the order of addition.
        F.round(shannon_entropy(value), 12) >= vocab.OPAQUE_MIN_ENTROPY,
    ).otherwise(False)


# --- matches of the preflight patterns -----------------------------------------------------
def assignment_key(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGNMENT_PARTS, 2)


def assignment_value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGNMENT_PARTS, 3)


def is_credential_assignment(match: Column, *, keep_bearer: bool = True) -> Column:
    """Whether a match of ASSIGNMENT assigns a real value to a sensitive key. With ``keep_bearer``
    an authorization key with a bearer value is left to the bearer patterns."""
    key, value = assignment_key(match), assignment_value(match)
    raw = F.lower(unquote(value))
    hit = (
        _preflight_key(key)
        & ~is_placeholder_assignment(value)
        & ~raw.startswith("bearer [redacted]")
    )
    if keep_bearer:
        hit &= ~(_has_any(key_phrase(key), ("authorization",)) & raw.startswith("bearer "))
    return hit


def redacted_assignment(match: Column) -> Column:
    """Replace the value only; quotes, key and separator stay."""
    quote = F.regexp_extract(assignment_value(match), r"^([\"'])[\s\S]*\1\z", 1)
    return F.concat(
        F.regexp_extract(match, ASSIGNMENT_PARTS, 1), quote, F.lit(vocab.REDACTED), quote
    )


def is_opaque_assignment(match: Column) -> Column:
    key = F.regexp_extract(match, OPAQUE_ASSIGNMENT, 1)
    value = F.regexp_extract(match, OPAQUE_ASSIGNMENT, 2)
    return is_opaque_value(value) & ~_preflight_key(key) & ~is_hash_key(key)


# --- credential shapes in metadata, audit events and diagnostics ---------------------------
# --- fixed values: patterns of the registry, audit and transport families ------------------
_PEM_BLOCK = r"-----BEGIN (?<label>(?:[A-Z0-9]+ )*(?:PRIVATE KEY|CERTIFICATE))-----[\s\S]*?-----END \k<label>-----"
_JWT = WORD_START + r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b"
_REGISTRY_VALUES = (
    "(?iu)" + _PEM_BLOCK,
    r"(?iu)[\"']?" + WORD_START + r"(?:api[_. -]?token|api[_. -]?key|private[_. -]?key|access[_. -]?token"
    r"|refresh[_. -]?token|bearer[_. -]?token|password|secret|credential|authorization)\b"
    r"[\"']?" + _S + "*[:=]" + _S + "*['\"]?[^" + SPACE + "]+",
    r"(?iu)" + WORD_START + "bearer" + _S + "+" + _VALUE_CHARS + r"{16,}\b",
    _JWT + "|" + WORD_START + r"(?:ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}"
    r"|xox(?:b|p|a|r|s)-[A-Za-z0-9-]{16,}|AKIA[0-9A-Z]{16})\b",
)
_NAMED_KEY = (
    r"[\"']?" + WORD_START + r"(?:api[_. -]?(?:token|key)|access[_. -]?token|refresh[_. -]?token"
    r"|(?:client|signing|webhook)[_. -]?secret|password|secret|credential)\b[\"']?" + _S + "*[:=]"
)
_NAMED_VALUE = _S + "*(?:" + _DOUBLE_QUOTED + "|" + _SINGLE_QUOTED + "|[^" + SPACE + ",'\"]+)"
CREDENTIAL_VALUE = (
    "(?iu)(?:" + _PEM_BLOCK + "|" + _JWT
    + "|" + WORD_START + r"(?:ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9]{20,}"
    r"|xox(?:b|p|a|r|s)-[A-Za-z0-9-]{16,}|AKIA[0-9A-Z]{16})\b"
    r"|" + WORD_START + "Bearer" + _S + "+" + _VALUE_CHARS + "{16,}|" + _NAMED_KEY + _NAMED_VALUE + ")"
)


# Every alternative of CREDENTIAL_VALUE begins with one of these, or has a separator.
CREDENTIAL_TRIGGER = "(?iu)-----BEGIN|eyJ|ghp_|github_pat_|sk-|xox|AKIA|Bearer|[:=]"


def _is_named_placeholder(match: Column) -> Column:
    assigned = F.regexp_replace(match, r"^[^:=]*[:=]", "")
    bare = F.regexp_replace(F.regexp_replace(assigned, "^[ '\"]+|[ '\"]+\\z", ""), r"[.,;:!?]+\z", "")
    return match.rlike("(?iu)" + _NAMED_KEY) & is_placeholder(bare, any_case=True)


def has_credential_value(value: Column, family: str = "audit") -> Column:
    """Whether text holds a concrete credential. Families: registry, audit (also transport)."""
    if family == "registry":
        hit = F.lit(False)
        for pattern in _REGISTRY_VALUES:
            hit |= value.rlike(pattern)
    else:
        hit = F.when(
            value.rlike(CREDENTIAL_TRIGGER) & value.rlike(CREDENTIAL_VALUE),
            F.exists(rewrite.matches(value, CREDENTIAL_VALUE), lambda m: ~_is_named_placeholder(m)),
        ).otherwise(False)
    return F.coalesce(hit, F.lit(False))


def mask_credentials(value: Column) -> Column:
    """Replace every concrete credential in a text; documentation placeholders stay."""
    # Splitting compiles the long pattern for every text, so only texts with placeholders are split.
    named = F.exists(rewrite.matches(value, CREDENTIAL_VALUE), _is_named_placeholder)
    some = rewrite.rewrite(
        value,
        CREDENTIAL_VALUE,
        lambda m: F.when(_is_named_placeholder(m), m).otherwise(vocab.MASKED),
    )
    return F.when(
        value.rlike(CREDENTIAL_TRIGGER) & value.rlike(CREDENTIAL_VALUE),
        F.when(named, some).otherwise(F.regexp_replace(value, CREDENTIAL_VALUE, vocab.MASKED)),
    ).otherwise(value)
