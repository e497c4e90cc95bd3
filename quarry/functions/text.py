r"""Text expressions: everything here is a Column built from Spark's own functions.

White space means Unicode white space throughout, as a string's ``strip`` and
``split`` see it, not only U+0020.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.stopwords import STOP_WORDS

#: Body of a regular expression class; the same for Java and RE2.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters, for functions that take a set.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Tokens: two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Content types of the file kinds that can be ingested.
CONTENT_TYPES = {
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".html": "text/html",
    ".htm": "text/html",
    ".csv": "text/csv",
    ".json": "application/json",
    ".xml": "text/xml",
    ".css": "text/css",
    ".js": "text/javascript",
    ".py": "text/x-python",
    ".tsv": "text/tab-separated-values",
    ".rtf": "application/rtf",
    ".zip": "application/zip",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".svg": "image/svg+xml",
    ".mp3": "audio/mpeg",
    ".mp4": "video/mp4",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".epub": "application/epub+zip",
}


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def word_count(text: Column) -> Column:
    """Number of pieces between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0))).cast("long")


def all_tokens(text: Column) -> Column:
    """Lower-case tokens in order, stop words included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, without stop words."""
    return F.filter(all_tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def plain_markdown(text: Column) -> Column:
    """Without the signs ``#``, ``*``, backtick and ``>``, then without ``"- "``."""
    return F.replace(F.translate(text, "#*`>", ""), F.lit("- "), F.lit(""))


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)\z", 1))


def content_type(name: Column) -> Column:
    """Content type by extension; plain text where unknown."""
    known = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("text/plain"))


def uploadable(name: Column) -> Column:
    return name.rlike(r"(?i)\.(pdf|docx?|txt|md|markdown)$")


def title_from_name(name: Column) -> Column:
    """The name without its last extension, or the whole name where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("")), name)


def preview(text: Column, length: int = 140) -> Column:
    """The beginning, with an ellipsis where the text goes on."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """So many decimals of the value that the double has, halves to even, as C's ``printf`` gives them; null for null.

    ``format_string`` rounds the shortest decimal form, halves up: 0.125 and 0.1234565 come out higher.
    """
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def number(value: Column) -> Column:
    """Two decimals; ``0.00`` for anything that isn't finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, fixed(value, 2)).otherwise("0.00")


def date_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` of an ISO time, or ``Unknown``."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm"), F.lit("Unknown"))


def size_mb(size: Column) -> Column:
    return fixed(size.cast("double") / 1048576, 2)


def percent(share: Column, digits: int = 0) -> Column:
    return fixed(share * 100, digits)


def display_name(title: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(filename, F.lit("")), F.lit("Untitled"))


def default_role_model(running: Column, models: Column) -> Column:
    """The first running model, else the first model, else empty."""
    return F.coalesce(F.get(running, 0), F.get(models, 0), F.lit(""))


def provider_kind(name: Column) -> Column:
    """Which adapter a provider's name stands for."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(low.contains("ollama"), "ollama")
        .when(low.contains("lm") | low.contains("studio"), "lmstudio")
        .otherwise("openai")
    )


def with_defaults(metadata: Column, title: Column, content: Column, now: Column) -> Column:
    """File metadata: given entries win over defaults, but the size is always the content's.

    ``filename`` defaults to the title, ``original_filename`` to the file name,
    ``content_type`` to the guess by name, ``uploaded_at`` to now.
    """
    given = F.coalesce(metadata, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    entry = lambda key, default: F.coalesce(F.try_element_at(given, F.lit(key)), default)
    name = entry("filename", title)
    own = {
        "filename": name,
        "original_filename": entry("original_filename", name),
        "content_type": entry("content_type", content_type(name)),
        "filesize": F.octet_length(content).cast("string"),
        "uploaded_at": entry("uploaded_at", now),
    }
    rest = F.map_filter(given, lambda k, _: ~k.isin(*own))
    return F.map_concat(rest, F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v))))
