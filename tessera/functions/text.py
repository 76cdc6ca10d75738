"""String scalars used by the validation and notebook operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's lists for identical verdicts.
# Allowed language names (compared lower-cased, not stripped):
VALID_LANGUAGES = (
    "python", "r", "julia", "javascript", "sql", "scala", "java", "c++", "c#",
    "go", "rust", "swift", "kotlin", "php", "ruby", "perl", "matlab", "octave",
    "sas", "stata", "spss", "unknown",
)
# Canonical-language synonym sets (compared after strip + lower):
PYTHON_SYNONYMS = ("python", "ipython notebook html", "ipython notebook")
R_SYNONYMS = ("r", "rmarkdown", "r notebook html")
# Cell content length limits, in characters:
MIN_CELL_CHARS = 10
MAX_CELL_CHARS = 10000
# Cell kinds kept by the notebook explode step:
CELL_KINDS = ("code", "markdown")
# Characters whose presence marks a markdown cell as formatted:
MARKDOWN_MARKERS = "#*`"
# Tokens read as missing by the CSV loader:
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace, not only spaces."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def canonical_language(c) -> Column:
    """'python' / 'r' / 'other' by synonym sets; null maps to 'other'."""
    norm = F.lower(py_strip(c))
    return (
        F.when(norm.isin(*PYTHON_SYNONYMS), F.lit("python"))
        .when(norm.isin(*R_SYNONYMS), F.lit("r"))
        .otherwise(F.lit("other"))
    )


def invalid_language(c) -> Column:
    """Allow-list miss on the lower-cased name; null counts as invalid."""
    return F.coalesce(~F.lower(_c(c)).isin(*VALID_LANGUAGES), F.lit(True))


def wrap_content(content, kind) -> Column:
    content, kind = _c(content), _c(kind)
    return (
        F.when(kind == "code", F.concat(F.lit("<code>"), content, F.lit("</code>")))
        .when(kind == "markdown", F.concat(F.lit("<markdown>"), content, F.lit("</markdown>")))
        .when(kind == "dataset", F.concat(F.lit("<dataset>"), content, F.lit("</dataset>")))
        .otherwise(content)
    )


def markdown_formatted(c) -> Column:
    return _c(c).rlike("[#*`]")


def na_normalise(c, tokens=NA_TOKENS) -> Column:
    """String column with the loader's missing tokens turned into NULL."""
    return F.when(_c(c).isin(*tokens), F.lit(None).cast("string")).otherwise(_c(c))


def like_literal(query: str) -> str:
    """Pattern for ``ilike`` that behaves as SQLite's LIKE '%q%' (no escape char)."""
    return "%" + query.replace("\\", "\\\\") + "%"
