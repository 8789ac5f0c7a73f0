"""Text and path helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types that are scanned.
ACCEPTED_EXTENSIONS = [
    ".pdf", ".epub", ".mobi", ".chm", ".htm", ".html",
    ".rst", ".rtf", ".txt", ".doc", ".docx",
]

# Types whose text needs no codec.
PLAIN_EXTENSIONS = [".txt", ".rst"]
HTML_EXTENSIONS = [".htm", ".html"]

# Character references resolved after the tags are gone.
HTML_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&apos;", "'"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"),
    ("&minus;", "\u2212"), ("&hyphen;", "\u2010"), ("&shy;", "\u00ad"), ("&amp;", "&"),
]


def basename(path: Column) -> Column:
    """H6: last element of a path."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """H7: from the last dot of the base name, '' without a dot."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)\z", 1)


def is_supported(path: Column) -> Column:
    """The extension is accepted as written (``.PDF`` is not)."""
    return extension(path).isin(ACCEPTED_EXTENSIONS)


def absolute_path(uri: Column) -> Column:
    """Local URIs as plain absolute paths, others unchanged."""
    return F.regexp_replace(uri, r"^file:(?://)?(?=/)", "")


def truncate_bytes(text: Column, n: int) -> Column:
    """The first ``n`` bytes. A cut code point cannot be part of an ISBN."""
    return F.substring(text.cast("binary"), 1, n).cast("string")


def enough_text(text: Column, n: int) -> Column:
    """At least ``n`` bytes of text; NULL text is never enough."""
    return F.coalesce(F.octet_length(text) >= n, F.lit(False))


def decode_utf8(content: Column) -> Column:
    """File bytes as text; broken sequences become U+FFFD, not a failed job."""
    return F.make_valid_utf8(content.cast("string"))


def _numeric_references(text: Column) -> Column:
    """``&#45;`` and ``&#x2d;`` as characters; a number that is none stays as it is."""
    parts = F.split(text, r"&#(?=(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)")

    def resolved(part, i):
        decimal = F.regexp_extract(part, "^([0-9]+);", 1)
        code = F.when(decimal != "", decimal.try_cast("long")).otherwise(
            F.conv(F.regexp_extract(part, "^[xX]([0-9a-fA-F]+);", 1), 16, 10).try_cast("long")
        )
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, "^[xX]?[0-9a-fA-F]+;", "")
        return (
            F.when(i == 0, part).when(real, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), part))
        )

    return F.when(text.contains("&#"), F.array_join(F.transform(parts, resolved), "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """S3: markup to text. Unclosed comments and scripts run to the end."""
    for pattern in (
        r"(?s)<!--.*?(?:-->|\z)",
        r"(?is)<script\b.*?(?:</script\s*>|\z)",
        r"(?is)<style\b.*?(?:</style\s*>|\z)",
        r"<[^<>]*>",
    ):
        html = F.regexp_replace(html, pattern, " ")
    html = _numeric_references(html)
    for entity, char in HTML_ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html
