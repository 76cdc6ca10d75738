"""JSON scalars on raw text (tolerant).

``try_parse_json`` gives NULL for valid texts too: above 20,000,000 characters in one string or
the VARIANT size limit, and for repeated keys unless the session allows them.  So whether a text
is JSON is asked of ``is_json``, whose answer depends on the text only; values of texts that
VARIANT can't hold are read by ``from_json``, the last of repeated keys counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTEBOOK_FIELDS = ("cells", "metadata", "nbformat", "nbformat_minor")


#: Strict JSON, strings of any length that a Spark string can have.
STRICT = "map('maxStringLen', '2147483647', 'allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false', 'mode', 'PERMISSIVE')"


def from_json_sql(raw_sql: str, schema: str) -> str:
    return f"from_json({raw_sql}, '{schema}', {STRICT})"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse(c) -> Column:
    return F.try_parse_json(_c(c))


def is_json_sql(raw_sql: str) -> str:
    """True when the text is one JSON value and nothing else, false otherwise (NULL text too).

    The text is read as an object's value and as an array's: only a single value fits both, as
    what ends the one too early can't stand in the other.  It is skipped, not built.
    """
    fits = [from_json_sql(f"""concat('{head}', {raw_sql}, '{tail}')""", "z int") + ".z = 0"
            for head, tail in (('{"a":', ',"z":0}'), ('{"a":[', '],"z":0}'))]
    return f"coalesce({fits[0]} AND {fits[1]}, false)"


def is_json(name: str) -> Column:
    return F.expr(is_json_sql(_sql_ref(name)))


def is_json_object(name: str) -> Column:
    """Well-formed JSON whose top value is an object and nothing follows it."""
    return F.coalesce(F.col(_sql_ref(name)).rlike("^[ \\t\\r\\n]*\\{"), F.lit(False)) & is_json(name)


def missing_fields(raw, required=NOTEBOOK_FIELDS) -> Column:
    """Required top-level keys absent from a JSON object (sorted array)."""
    keys = F.expr(f"json_object_keys({_sql_ref(raw)})") if isinstance(raw, str) else F.json_object_keys(raw)
    return F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(keys, F.array().cast("array<string>"))))


def _sql_ref(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def json_or_raw(raw) -> Column:
    """Parsed value when the text is JSON that a VARIANT holds, else NULL (the raw text is kept
    next to it; ``is_json`` tells the two cases apart)."""
    return F.try_parse_json(_c(raw))


def bigint_field(name: str, field: str) -> Column:
    """A top-level bigint of a JSON text of any size."""
    large = f"CASE WHEN {is_json_sql(_sql_ref(name))} THEN try_cast({from_json_sql(_sql_ref(name), _sql_ref(field) + ' string')}.{_sql_ref(field)} AS bigint) END"
    v = F.try_parse_json(F.col(_sql_ref(name)))
    return F.when(v.isNotNull(), F.try_variant_get(v, f"$.{field}", "bigint")).otherwise(F.expr(large))
