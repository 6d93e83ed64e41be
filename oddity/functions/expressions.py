"""Column-expression builders. All are JVM-side built-ins (no UDF), so they stay
inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K

# pandas ``to_numeric`` accepts plain decimal / exponent text and the infinity
# words; Spark's cast also accepts e.g. "1d", so the text is checked first.
NUMBER_TEXT_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INF_WORDS = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing: one projection over the floating-point columns."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def clean_numeric_text(c: Column) -> Column:
    """Strip whitespace/newlines, currency marks, and rewrite 1.234,56 as 1234.56."""
    s = c.cast("string")
    s = F.regexp_replace(s, r"[\r\n\t]+", "")
    s = F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+", "")
    s = F.regexp_replace(s, K.CURRENCY_PREFIX_RE, "")
    s = F.regexp_replace(s, "(?i)" + K.CURRENCY_SUFFIX_RE, "")
    return F.when(s.rlike(K.TR_NUMBER_RE),
                  F.translate(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(s)


def parse_cleaned_number(cleaned: Column) -> Column:
    """pandas ``to_numeric(errors="coerce")`` on already-cleaned text; failures are null."""
    ok = cleaned.rlike(NUMBER_TEXT_RE) | F.lower(cleaned).isin(*INF_WORDS)
    return F.when(ok, cleaned.try_cast("double"))


def to_number(c: Column) -> Column:
    """T2 value conversion: clean, then parse; unparseable text becomes null."""
    return parse_cleaned_number(clean_numeric_text(c))


# The characters Python's str.split() / str.strip() treat as whitespace, written
# so that both Java and RE2 regular expressions read them the same way.
PY_WHITESPACE = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading and trailing whitespace (Python's definition)."""
    return F.regexp_replace(c, "^" + PY_WHITESPACE + "+|" + PY_WHITESPACE + "+$", "")


def word_count(c: Column) -> Column:
    """``len(str.split())``: whitespace-separated tokens, 0 for blank text."""
    return F.size(F.filter(F.split(c.cast("string"), PY_WHITESPACE + "+"), lambda w: w != F.lit("")))


def name_has_hint(name: str, hints) -> bool:
    n = str(name).lower()
    return any(h in n for h in hints)


def is_id_kind_name(name: str) -> bool:
    return re.search(K.ID_KIND_NAME_RE, str(name).lower()) is not None


def contains_any_token(c: Column, tokens) -> Column:
    """Upper-cased text contains any of ``tokens`` (plain substrings)."""
    up = F.upper(c.cast("string"))
    expr = F.lit(False)
    for t in tokens:
        expr = expr | F.contains(up, F.lit(t))
    return expr
