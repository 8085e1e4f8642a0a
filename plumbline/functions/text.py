"""Scalar text functions as Spark columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.settings import STOPWORDS

STRINGS = "array<string>"
#: Characters of the pieces and blocks from which character shingles are cut.
PIECE, BLOCK = 32, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.  The optimizer may copy an
    expression into every place that names it, inside a lambda too, where it
    would run for each element; a lambda's own variable cannot be copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: What is no ASCII letter or digit, listed one by one: the JVM looks these up in
#: a bit table, which ranges and properties do not get.
ASCII_GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def lower_each(text: Column) -> Column:
    """Lower case letter by letter: the two that the JVM lower-cases by what
    stands around them, or into two characters, are replaced first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def normalize(text: Column) -> Column:
    """Letters and digits in lower case, every other run one space, trimmed."""
    plain = F.length(text) == F.octet_length(text)
    spaced = F.when(plain, F.lower(F.regexp_replace(text, ASCII_GAP, " "))).otherwise(lower_each(F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", " ")))
    return F.trim(spaced)


def tokenize(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def normalized_stopwords(words: Sequence[str]) -> list[str]:
    """Stopwords as whole single tokens, without repeats."""
    cleaned = [" ".join("".join(c if c.isalnum() else " " for c in w.lower()).split()) for w in words]
    return list(dict.fromkeys(w for w in cleaned if w and " " not in w))


def remove_stopwords(tokens: Column, words: Sequence[str] = STOPWORDS) -> Column:
    """Keeps repeats and order."""
    known = normalized_stopwords(words)  # a longer list becomes a hash set
    return F.filter(tokens, lambda t: ~t.isin(known))


def word_shingles(tokens: Column, width: int) -> Column:
    if width <= 0:
        raise ValueError("shingle width must be positive")

    def body(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - width + 1, F.lit(1)))
        return F.when(F.size(t) >= width, F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(width)), " "))).otherwise(F.array().cast(STRINGS))

    return let(tokens, body)


def char_shingles(text: Column, width: Column | int) -> Column:
    """A place in a string is reached by walking from its start, so a shingle a
    place would cost the square of the text's length.  The shingles are cut from
    pieces of ``PIECE`` characters, and these from blocks of ``BLOCK``, each with
    the ``width - 1`` characters behind it: the walks stay short."""
    both = F.struct(text.alias("t"), (F.lit(width) if isinstance(width, int) else width).alias("w"))

    def cut(x: Column, size: int, more: Column) -> Column:
        """The pieces of ``x`` at every ``size`` places, each ``more`` longer."""
        starts = F.sequence(F.lit(1), F.greatest(F.length(x) - more, F.lit(1)), F.lit(size))
        return F.transform(starts, lambda i: F.substring(x, i, size + more))

    def body(s: Column) -> Column:
        n, w = F.length(s["t"]), s["w"]
        pieces = F.flatten(F.transform(cut(s["t"], BLOCK, w - 1), lambda b: cut(b, PIECE, w - 1)))
        shingles = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - w + 1), lambda i: F.substring(p, i, w))))
        return F.when((n >= w) & (n > 0), shingles).otherwise(F.array().cast(STRINGS))

    return let(both, body)


def set_jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard of two arrays taken as sets."""

    def body(s: Column) -> Column:
        either = F.size(F.array_union(s["a"], s["b"]))
        return F.when(either > 0, F.size(F.array_intersect(s["a"], s["b"])) / either).otherwise(F.lit(both_empty))

    return let(F.struct(a.alias("a"), b.alias("b")), body)


def positions(text: Column, pattern: Column) -> Column:
    """0-based places of all, also overlapping, occurrences; the empty pattern
    stands at 0 only."""
    n, m = F.length(text), F.length(pattern)
    starts = F.sequence(F.lit(0), F.greatest(n - m, F.lit(0)))
    found = F.filter(starts, lambda i: F.substring(text, i + 1, m) == pattern)
    none = F.array().cast("array<int>")
    return F.when(m == 0, F.array(F.lit(0))).when(n < m, none).otherwise(found)


NEWLINE = r"\r\n|\r|\n"


def line_of(content: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset; CR, LF and CRLF are one break each."""
    return F.regexp_count(F.substring(content, F.lit(1), offset), F.lit(NEWLINE)) + 1


def column_of(content: Column, offset: Column) -> Column:
    """1-based column: what stands behind the last break before the offset."""
    before = F.substring(content, F.lit(1), offset)
    return F.length(F.regexp_replace(before, r"(?s)^.*[\r\n]", "")) + 1


def risk(total: Column) -> Column:
    return F.when(total >= 0.75, "CRITICAL").when(total >= 0.55, "HIGH").when(total >= 0.35, "MEDIUM").otherwise("LOW")


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100.0)


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]", "_")


def single_line(x: Column, limit: int = 260) -> Column:
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def csv_quote(x: Column) -> Column:
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
