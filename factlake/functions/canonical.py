"""Canonical JSON text and its SHA-256, as Column expressions.

Keys by code point at each depth, no white space, number texts as JSON's grammar tells integers from floating point (a fraction or an exponent
makes a double, printed in its shortest form; integers have any length), control characters escaped in lower case, other characters kept, the
last of repeated keys. Text that is no JSON gives null.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What VARIANT doesn't keep as it is: doubles, negative zero, long integers, escapes by code, and characters whose order differs by code unit.
ODD = r"(?:^|[\[,:\s])-?(?:[0-9]+[.eE]|0\b|[0-9]{18,})|\\u|[\x{D800}-\x{10FFFF}]"
#: A run of JSON strings and other characters, from where the last one ended, and the separator after it.
BEFORE_SEPARATOR = r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:]++)*+)([,:])'


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _text(text: str | None) -> str | None:
    try:
        out = None if text is None else json.dumps(json.loads(text, parse_constant=_no_constant), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return out if out is None or out.isprintable() else out.encode("utf-8", "replace").decode()  # a lone surrogate has no UTF-8 form
    except (ValueError, RecursionError):
        return None


def canonical(json_text: Column) -> Column:
    """JSON text in canonical form; null for text that is no JSON.

    VARIANT gives it for most texts. Those that it would change, or doesn't read (among them ones that repeat a key), are read by Python, Arrow batch by batch.
    """

    @F.pandas_udf("string")
    def odd(texts: pd.Series) -> pd.Series:
        return texts.map(_text, na_action="ignore")

    quick = F.when(~json_text.rlike(ODD), lower_escapes(F.to_json(F.try_parse_json(json_text))))
    return F.coalesce(quick, odd(F.when(quick.isNull(), json_text)))


def lower_escapes(json_text: Column) -> Column:
    """JSON text with control characters' escapes in lower case."""
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        json_text = F.regexp_replace(json_text, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return json_text


# Expressions below stand in every field's errors, so each uses its argument once.


def shown(value: Column) -> Column:
    """A VARIANT as messages show it: JSON with a space after each separator."""
    return F.regexp_replace(F.to_json(value), BEFORE_SEPARATOR, "$1$2 ")


def json_string(text: Column) -> Column:
    """A text (or null) as JSON text."""
    return F.regexp_replace(F.to_json(F.array(text)), r"\A\[|\]\z", "")


def canonical_struct(**columns: Column) -> Column:
    """A flat object as canonical JSON; nulls are kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
