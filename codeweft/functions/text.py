"""Scalar text functions as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a search token, an identifier piece and a symbol-like word.
SEARCH_TOKEN = r"[A-Za-z_][\p{L}\p{N}_]+|\p{Nd}+"
IDENTIFIER_PIECE = r"[A-Za-z][a-z]*|\p{Nd}+"
SYMBOL_WORD = r"[A-Za-z_][\p{L}\p{N}_.]*"

# File extensions of each language.
LANGUAGE_EXTENSIONS = {
    "python": ["py"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
}

QUOTE_CHARS = 300
SNIPPET_LINES = 80
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def search_tokens(text: Column) -> Column:
    """Lower-cased words of two or more characters, and digit runs."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SEARCH_TOKEN), F.lit(0))


def identifier_pieces(identifier: Column) -> Column:
    spaced = F.translate(F.coalesce(identifier, F.lit("")), "._", "  ")
    return F.transform(F.regexp_extract_all(spaced, F.lit(IDENTIFIER_PIECE), F.lit(0)), F.lower)


def symbol_document(qualified_name: Column, signature: Column, docstring: Column) -> Column:
    """The text a symbol is indexed under: its name, signature, docstring and name pieces, one per line."""
    parts = F.array(
        F.coalesce(qualified_name, F.lit("")),
        F.coalesce(signature, F.lit("")),
        F.coalesce(docstring, F.lit("")),
        F.array_join(identifier_pieces(qualified_name), " "),
    )
    return strip(F.array_join(F.filter(parts, lambda part: part != ""), "\n"))


def index_text(document: Column, chunks: Column) -> Column:
    """Symbol document followed by the first two chunks of its file."""
    head = F.array_join(F.slice(F.coalesce(chunks, F.array().cast("array<string>")), 1, 2), "\n")
    return strip(F.concat_ws("\n", document, head))


def symbol_id(kind: Column, qualified_name: Column, file_path: Column, start_line: Column) -> Column:
    return F.sha1(F.concat_ws("|", kind, qualified_name, file_path, start_line.cast("string")))


def repo_id(path: Column) -> Column:
    return F.concat(F.lit("repo_"), F.substring(F.sha1(path), 1, 16))


def line_label(start: Column, end: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def quote(snippet: Column) -> Column:
    return F.substring(F.coalesce(snippet, F.lit("")), 1, QUOTE_CHARS)


def snippet(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end, at most eighty of them, trimmed."""
    count = F.least(end - start + 1, F.lit(SNIPPET_LINES))
    taken = F.slice(lines, start.cast("int"), F.greatest(count, F.lit(0)).cast("int"))
    return strip(F.array_join(taken, "\n"))


def pieces(text: Column, size: int = 8) -> Column:
    """Consecutive slices of ``size`` characters; none for an empty text. One pass: a slice by number would count characters from the start."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def parent_dir(path: Column) -> Column:
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.lit(".")).otherwise(parent)


def last_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def symbol_hint(message: Column) -> Column:
    """First symbol-like word of a message, else the whole message."""
    trimmed = strip(F.coalesce(message, F.lit("")))
    word = F.regexp_extract(trimmed, SYMBOL_WORD, 0)
    return F.when(word != "", word).otherwise(trimmed)


def path_endpoints(message: Column) -> Column:
    """Struct (from_symbol, to_symbol): English phrase, Chinese phrase, first two words, one word twice, or blanks."""
    text = strip(F.coalesce(message, F.lit("")))
    # The two phrases that name both ends.
    english = rf"(?i)from\s+({SYMBOL_WORD})\s+to\s+({SYMBOL_WORD})"
    chinese = rf"从\s*({SYMBOL_WORD})\s*到\s*({SYMBOL_WORD})"
    words = F.regexp_extract_all(text, F.lit(SYMBOL_WORD), F.lit(0))

    def pair(first: Column, second: Column) -> Column:
        return F.struct(first.alias("from_symbol"), second.alias("to_symbol"))

    return (
        F.when(text.rlike(english), pair(F.regexp_extract(text, english, 1), F.regexp_extract(text, english, 2)))
        .when(text.rlike(chinese), pair(F.regexp_extract(text, chinese, 1), F.regexp_extract(text, chinese, 2)))
        .when(F.size(words) >= 2, pair(F.get(words, 0), F.get(words, 1)))
        .when(F.size(words) == 1, pair(F.get(words, 0), F.get(words, 0)))
        .otherwise(pair(F.lit(""), F.lit("")))
    )


def glob_regex(pattern: str) -> str:
    """Regular expression of one shell pattern; ``*`` crosses directory separators."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            negated = body.startswith("!")
            body = body[1:] if negated else body.replace("^", "\\^")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = close
        else:
            out.append(f"\\{char}" if char in r"\.^$|+(){}[]" else char)
        i += 1
    return rf"(?s)\A(?:{''.join(out)})\z"


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | path.rlike(glob_regex(pattern))
    return found


def language_label(path: Column) -> Column:
    label = None
    for language, extensions in LANGUAGE_EXTENSIONS.items():
        test = F.lower(path).rlike(rf"\.(?:{'|'.join(extensions)})\z")
        label = F.when(test, F.lit(language)) if label is None else label.when(test, F.lit(language))
    return label.otherwise(F.lit("unknown"))


def supported_language(path: Column, enabled: Iterable[str]) -> Column:
    """Language of a path when it is one of ``enabled``, else null. A bare dot-file name has no extension."""
    label = language_label(path)
    named = ~F.substring_index(path, "/", -1).rlike(r"\A\.[^.]*\z")
    return F.when(label.isin(list(enabled)) & named, label)


def module_name(path: Column) -> Column:
    """Dotted module name: slashes become dots, then each known extension is stripped once, in this fixed order."""
    name = F.translate(path, "/", ".")
    for extension in [e for extensions in LANGUAGE_EXTENSIONS.values() for e in extensions]:
        name = F.regexp_replace(name, rf"\.{extension}\z", "")
    return name
