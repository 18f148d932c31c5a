"""Text, hashing and front-matter expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.binding import let

# White space as Unicode defines it: separators, and the control characters that count as such.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\v\f\r\x85" or unicodedata.category(c)[0] == "Z")
_WS = r"[\s\x0B\x{85}\p{Z}]"

# Stand-in for the sharp s while upper-casing; U+0001 does not occur in titles or query keys.
_SHIELD = "\u0001"


def trim_ws(col: Column) -> Column:
    """Strip all Unicode white space from both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def trim_ws_sql(x: str) -> str:
    """SQL text of :func:`trim_ws`."""
    return f"btrim({x}, '{WHITE_SPACE}')"


def is_blank(col: Column) -> Column:
    """Null, empty or white space only."""
    return col.isNull() | ~col.rlike(r"[^\s\x0B\x{85}\p{Z}]")


def ordinal_fold(col: Column) -> Column:
    """Sort key for comparison that ignores case one character at a time.

    Spark upper-cases the sharp s to two letters; the comparison wanted here leaves it alone.
    """
    shielded = F.upper(F.replace(col, F.lit("ß"), F.lit(_SHIELD)))
    return F.replace(shielded, F.lit(_SHIELD), F.lit("ß"))


def ordinal_fold_sql(x: str) -> str:
    """SQL text of :func:`ordinal_fold`."""
    return f"replace(upper(replace({x}, 'ß', '{_SHIELD}')), '{_SHIELD}', 'ß')"


def clean_markdown(col: Column) -> Column:
    """Unix line ends, at most one blank line in a row, trimmed; null becomes empty."""
    unix = F.replace(F.coalesce(col, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return trim_ws(let(unix, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)))


def escape_yaml(col: Column) -> Column:
    """Escape for a double-quoted YAML scalar."""
    slashes = F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(slashes, F.lit('"'), F.lit('\\"'))


def content_sha256(col: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text; null hashes like the empty text."""
    return F.sha2(F.coalesce(col, F.lit("")), 256)


def strip_frontmatter(col: Column) -> Column:
    """Text after the second ``---`` line; the trimmed input when there is no closed block."""

    def body(lines: Column) -> Column:
        marks = F.filter(
            F.transform(lines, lambda line, i: F.when(trim_ws(line) == "---", i)),
            lambda i: i.isNotNull(),
        )
        return let(
            marks,
            lambda m: F.when(
                F.size(m) >= 2,
                F.array_join(F.slice(lines, F.get(m, F.lit(1)) + 2, F.size(lines)), "\n"),
            ).otherwise(F.array_join(lines, "\n")),
        )

    opened = col.rlike(rf"\A{_WS}*---")
    return trim_ws(F.when(opened, let(F.split(col, "\n"), body)).otherwise(col))


def iso_instant(ts: Column) -> Column:
    """UTC instant with seven fraction digits and a ``Z``, whatever the session's time zone."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def build_frontmatter(title: Column, url: Column, fetched_at: Column, content_hash: Column, generator: str) -> Column:
    """Provenance block at the head of every page file."""
    return F.concat(
        F.lit('---\ntitle: "'),
        escape_yaml(title),
        F.lit('"\nsource_url: "'),
        escape_yaml(url),
        F.lit('"\nfetched_at: "'),
        iso_instant(fetched_at),
        F.lit('"\ncontent_hash: "'),
        content_hash,
        F.lit('"\ngenerator: "'),
        escape_yaml(F.lit(generator)),
        F.lit('"\n---'),
    )
