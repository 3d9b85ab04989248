"""String rules: fingerprints, URIs, escaping, taxonomy and data-flow annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintharbor.functions.severity import strip


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def fingerprint(file: Column, line: Column, tool: Column, rule_id: Column, title: Column) -> Column:
    """``file:line:tool:rule``; the title stands in only where rule_id is absent, not where it is ''."""
    return F.concat(
        text_or(file, ""), F.lit(":"),
        F.coalesce(line, F.lit(0)).cast("string"), F.lit(":"),
        text_or(tool, ""), F.lit(":"),
        F.coalesce(rule_id, title, F.lit("")),
    )


def as_list(raw: Column) -> Column:
    """A JSON field that holds a list or a scalar, as array<string>; absent gives []."""
    listed = F.from_json(raw, "array<string>")
    return (
        F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>"))
        .when(F.ltrim(raw).startswith("["), F.coalesce(listed, F.array(raw)))
        .otherwise(F.array(raw))
    )


def is_truthy_json(raw: Column) -> Column:
    """Python truthiness of a raw JSON value."""
    compact = F.regexp_replace(raw, r"\s", "")
    return F.coalesce(~compact.isin("", "false", "null", "{}", "[]", "0", "0.0", '""'), F.lit(False))


def with_taxonomy(text: Column, cwe: Column, owasp: Column) -> Column:
    return F.concat(
        text,
        F.when(F.size(cwe) > 0, F.concat(F.lit(" (CWE: "), F.array_join(cwe, ", "), F.lit(")")))
        .otherwise(""),
        F.when(F.size(owasp) > 0, F.concat(F.lit(" [OWASP: "), F.array_join(owasp, ", "), F.lit("]")))
        .otherwise(""),
    )


def with_taint(text: Column, is_taint: Column, source: Column, sink: Column) -> Column:
    """Prefix the data-flow ends; `source` and `sink` are structs (file, line) or NULL.

    The blank that closes each part stays even when the next part is missing.
    """
    def place(end: Column) -> Column:
        return F.concat(text_or(end["file"], ""), F.lit(":"),
                        F.coalesce(end["line"], F.lit(0)).cast("string"))

    prefix = F.concat(
        F.lit("[TAINT ANALYSIS] "),
        F.when(source.isNotNull(), F.concat(F.lit("Source: "), place(source), F.lit(" -> ")))
        .otherwise(""),
        F.when(sink.isNotNull(), F.concat(F.lit("Sink: "), place(sink))).otherwise(""),
    )
    return F.when(is_taint, F.concat(prefix, F.lit(" "), text)).otherwise(text)


def base_name(path: Column) -> Column:
    """Last component; trailing slashes do not count."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def relative_uri(file: Column, root: Column) -> Column:
    """Path below `root`, else the base name, else `unknown`. Relative paths are below `.`."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return (
        F.when(F.coalesce(file, F.lit("unknown")).isin("", "unknown"), "unknown")
        .when((root == ".") & ~file.startswith("/"), F.regexp_replace(file, r"^(\./)+", ""))
        .when(file == root, ".")
        .when(file.startswith(base), F.substr(file, F.length(base) + 1))
        .otherwise(base_name(file))
    )


def one_decimal(x: Column) -> Column:
    """Number with one decimal, rounded by its binary value (0.35 is below the tie, so 0.3)."""
    return F.regexp_replace(F.call_function("format_number", x, F.lit("0.0")), "^-0\\.0$", "0.0")


def html_escape(text: Column) -> Column:
    # The five HTML special characters, ampersand first.
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def is_json(text: Column) -> Column:
    """True for exactly one well-formed JSON value (wrapping it catches trailing text).

    Spark's parser also takes text in single quotes. Outside of double-quoted text a valid document
    has none, so one that is left when those are cut out tells such a report apart. Escapes go
    first: what is left of a quoted text then ends at the next quote, and no pattern has to nest.
    """
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    outside = F.when(text.contains("'"), F.regexp_replace(
        F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")).otherwise("")
    return F.coalesce((F.json_array_length(wrapped) == 1) & ~outside.contains("'"), F.lit(False))


def glob_regex(glob: Column) -> Column:
    """Shell-style pattern to regex text: `*` also crosses `/`, matching is full and case-sensitive.

    Tokens are a closed `[class]` or one character; an unclosed bracket is a literal.
    """
    tokens = F.regexp_extract_all(strip(glob), F.lit(r"(?s)\[!?+.[^\]]*\]|."), F.lit(0))

    def class_item(x: Column) -> Column:
        """A range or one character inside brackets; a reversed range holds nothing."""
        reversed_range = (F.length(x) == 3) & (F.substr(x, F.lit(1), F.lit(1)) > F.substr(x, F.lit(3)))
        return (
            F.when(reversed_range, "").when(x == "-", r"\-")
            .otherwise(F.regexp_replace(x, r"([\\\[\]&^])", r"\\$1")))

    def translate(t: Column) -> Column:
        negated = F.substr(t, F.lit(2), F.lit(1)) == "!"
        body = F.when(negated, F.substr(t, F.lit(3), F.length(t) - 3)).otherwise(
            F.substr(t, F.lit(2), F.length(t) - 2))
        items = F.array_join(F.transform(
            F.regexp_extract_all(body, F.lit(r"(?s).-.|."), F.lit(0)), class_item), "")
        klass = (
            F.when(items != "", F.concat(F.lit("["), F.when(negated, "^").otherwise(""), items, F.lit("]")))
            .when(negated, ".").otherwise("(?!)"))
        return (
            F.when(t == "*", ".*").when(t == "?", ".").when(F.length(t) > 1, klass)
            .otherwise(F.regexp_replace(t, r"([^A-Za-z0-9_/])", r"\\$1"))
        )

    return F.array_join(F.transform(tokens, translate), "")


def any_glob_regex(globs: Column) -> Column:
    """One anchored alternation for a list of globs; NULL when there is none."""
    body = F.array_join(F.transform(globs, glob_regex), "|")
    return F.when(F.size(globs) > 0, F.concat(F.lit(r"(?s)\A(?:"), body, F.lit(r")\z")))
