"""String expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shapes of code-like references (1.2.1, HD 1.1, T4, Group K).
# The look-ahead says how each of the three begins, so that word boundaries are only sought there.
CODE_PATTERN = (
    r"(?U)(?=[A-Z\d])(?:"
    r"\b(?:[A-Z]{1,4}[\s-]?)?\d+(?:\.\d+)+\b"
    r"|\b[A-Z]{1,4}[\s-]?\d+\b"
    r"|\bGroup\s+[A-Z]\b)"
)
WORD_PATTERN = r"[\p{L}\p{N}_]+"
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
# Every character that counts as white space, as text and as a regex class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "               　"
)
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends (looks at the ends only)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def rstrip_colon(c: Column) -> Column:
    return F.regexp_replace(c, r":+$", "")


def collapse(c: Column) -> Column:
    """White-space runs become one space."""
    return F.regexp_replace(c, SPACE + "+", " ")


def norm_line(c: Column) -> Column:
    """Form in which repeated lines are compared."""
    return F.lower(F.btrim(collapse(c)))


def split_lines(c: Column) -> Column:
    """Lines of a text, split at every line-break character."""
    return F.split(c, _LINE_BREAK)


def join_nonempty(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), sep)


def word_tokens(c: Column) -> Column:
    """Lower-case words, duplicates kept."""
    found = F.regexp_extract_all(c, F.lit(WORD_PATTERN), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def code_tokens(c: Column) -> Column:
    """Set of code-like references without white space and hyphens, upper-case."""
    found = F.regexp_extract_all(c, F.lit(CODE_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.upper(F.regexp_replace(t, r"(?U)[\s-]+", ""))))


def index_tokens(c: Column) -> Column:
    """Tokens that enter the lexical index: words and normalised codes."""
    return F.concat(word_tokens(c), F.transform(code_tokens(c), lambda t: F.lower(t)))


def token_counts(tokens: Column) -> Column:
    """Different tokens of a list with how often each stands there (token, tf), counted by sorting the list."""
    bind = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  (else taken anew for each element)

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bind(first, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(s, i).alias("token"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf"))))

    return F.when(F.size(tokens) > 0, bind(F.sort_array(tokens), runs))


def code_overlap(query: Column, text: Column) -> Column:
    """Share of the query's codes found in the text; 0 if either has none."""
    q, d = code_tokens(query), code_tokens(text)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(F.lit(0.0))


def safe_kb_name(c: Column) -> Column:
    """Name usable for a stored knowledge base: at most 63 safe characters."""
    cleaned = F.substring(F.regexp_replace(strip(c), r"[^a-zA-Z0-9_-]", "_"), 1, 63)
    return F.regexp_replace(cleaned, r"^_+|_+$", "")
