"""Line templates: the first fields of a line with its variable parts replaced, as a Catalyst expression and in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = 12
OTHER = "__template_other__"
KEEP = 32
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_TRIM = "[](){}<>,;:'\""
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_HEX = "(?:-*[0-9a-fA-F]){8}[0-9a-fA-F-]*"
_NUMBER = "[0-9.,_:/+-]*[0-9][0-9.,_:/+-]*"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _whole(v: Column, pattern: str) -> Column:
    return v.rlike(rf"\A(?:{pattern})\z")


def looks_ipv4(v: Column) -> Column:
    """Four decimal parts up to 255, with any number of leading zeros."""
    return _whole(v, _IP)


def looks_uuid(v: Column) -> Column:
    return _whole(v, _UUID)


def looks_hex(v: Column) -> Column:
    """Hex digits and dashes with at least eight digits."""
    return _whole(v, _HEX)


def looks_number(v: Column) -> Column:
    """Digits and number punctuation, at least half of it digits."""
    return _whole(v, _NUMBER) & (F.length(F.regexp_replace(v, "[^0-9]", "")) * 2 >= F.length(v))


def lower_ascii(v: Column) -> Column:
    return F.translate(v, _UP, _LOW)


def trimmed(v: Column) -> Column:
    """Without brackets, quotes and separators at both ends."""
    marks = "".join("\\" + c for c in _TRIM)
    return F.regexp_replace(v, rf"\A[{marks}]+|[{marks}]+\z", "")


def normalized_value(v: Column) -> Column:
    """IPv4 address, UUID, hex run, number, or the lower-cased first 32 bytes; first rule that fits."""
    start = F.when(F.octet_length(v) <= KEEP, v).otherwise(F.substring(v.cast("binary"), 1, KEEP).cast("string"))
    kinds = ((looks_ipv4, "<IP>"), (looks_uuid, "<UUID>"), (looks_hex, "<HEX>"), (looks_number, "<NUM>"))
    out = F.when(v == "", "<*>")
    for test, name in kinds:
        out = out.when(test(v), name)
    return out.otherwise(lower_ascii(start))


def normalized_field(field: Column) -> Column:
    """A trimmed field, or key=value with the key lower-cased and the value normalised."""
    plain = trimmed(field)
    eq = F.instr(plain, "=")
    key = lower_ascii(F.substring_index(plain, "=", 1))
    pair = F.concat(key, F.lit("="), normalized_value(F.substr(plain, eq + 1)))
    return F.when(plain == "", "<*>").when((eq > 1) & (eq < F.length(plain)), pair).otherwise(normalized_value(plain))


def template_key_column(line: Column, fields: int = FIELDS) -> Column:
    """Template of a line (STRING or UTF-8 BINARY); blank lines give '', null gives null. Entirely built-in functions."""
    # One empty part may come first and the rest of the line comes last: no field beyond the wanted ones is split off.
    parts = F.filter(F.split(line.cast("string"), f"[{_SPACE}]+", fields + 2 if fields > 0 else -1), lambda x: x != "")
    if fields > 0:
        parts = F.slice(parts, 1, fields)
    return F.array_join(F.transform(parts, normalized_field), " ")


def template_key_sql(line: str, fields: int = FIELDS) -> str:
    """The same as SQL text, for functions that SQL defines. line: a SQL expression."""

    def text(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def whole(pattern: str) -> str:
        return f"v RLIKE {text(rf'\A(?:{pattern})\z')}"

    def value(v: str) -> str:
        lower = f"translate(if(octet_length(v) <= {KEEP}, v, CAST(substring(CAST(v AS BINARY), 1, {KEEP}) AS STRING)), '{_UP}', '{_LOW}')"
        number = f"{whole(_NUMBER)} AND length(regexp_replace(v, '[^0-9]', '')) * 2 >= length(v)"
        case = f"CASE WHEN v = '' THEN '<*>' WHEN {whole(_IP)} THEN '<IP>' WHEN {whole(_UUID)} THEN '<UUID>' WHEN {whole(_HEX)} THEN '<HEX>' WHEN {number} THEN '<NUM>' ELSE {lower} END"
        return f"transform(array({v}), v -> {case})[0]"

    marks = "".join("\\" + c for c in _TRIM)
    pair = f"translate(substring_index(t, '=', 1), '{_UP}', '{_LOW}') || '=' || {value("substr(t, instr(t, '=') + 1)")}"
    field = f"CASE WHEN t = '' THEN '<*>' WHEN instr(t, '=') > 1 AND instr(t, '=') < length(t) THEN {pair} ELSE {value('t')} END"
    parts = f"filter(split({line}, {text(f'[{_SPACE}]+')}, {fields + 2 if fields > 0 else -1}), x -> x <> '')"
    if fields > 0:
        parts = f"slice({parts}, 1, {fields})"
    trimmed_ = f"transform({parts}, x -> regexp_replace(x, {text(rf'\A[{marks}]+|[{marks}]+\z')}, ''))"
    return f"array_join(transform({trimmed_}, t -> {field}), ' ')"


def template_key(line: bytes, fields: int = FIELDS) -> bytes:
    """The same in Python, for rows that are already inside a task."""
    parts = [p for p in _PY_SPACE.split(line) if p]
    return b" ".join(map(_field, parts[:fields] if fields > 0 else parts))


_PY_SPACE = re.compile(b"(?:[\\t-\\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)+")
_PY_RULES = [(re.compile(p.encode()), name) for p, name in ((_IP, b"<IP>"), (_UUID, b"<UUID>"), (_HEX, b"<HEX>"))]
_PY_NUMBER = re.compile(_NUMBER.encode())


def _value(v: bytes) -> bytes:
    for rule, name in _PY_RULES:
        if rule.fullmatch(v):
            return name
    if _PY_NUMBER.fullmatch(v) and 2 * sum(48 <= b < 58 for b in v) >= len(v):
        return b"<NUM>"
    return v[:KEEP].lower() or b"<*>"


def _field(field: bytes) -> bytes:
    t = field.strip(_TRIM.encode())
    eq = t.find(b"=")
    if not t:
        return b"<*>"
    return t[: eq + 1].lower() + _value(t[eq + 1 :]) if 0 < eq < len(t) - 1 else _value(t)
