"""Text utilities as columns: clusters, code points, normalization, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts of these code points alone: each is a token, and NFC leaves them as they are.
SIMPLE = r"\A[\x00-\x0C\x0E-\x{2FF}\x{370}-\x{373}\x{375}-\x{37D}\x{37F}-\x{386}\x{388}-\x{482}\x{48A}-\x{590}\x{1E00}-\x{1EFF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20CF}\x{3000}-\x{3029}\x{3041}-\x{3098}\x{309B}-\x{30FF}\x{4E00}-\x{9FFF}]*+\z"
LINE_END = r"(?>\r\n|[\n\x0B\f\r\x85\x{2028}\x{2029}])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_plain(text: Column | str) -> Column:
    """Whether the text is ASCII without carriage returns, by its lengths alone."""
    c = _col(text)
    return (F.octet_length(c) == F.char_length(c)) & ~F.contains(c, F.lit("\r"))


def is_simple(text: Column | str) -> Column:
    """Whether each code point is surely a token of its own, and the text in NFC; rare scripts count as not simple."""
    c = _col(text)
    return is_plain(c) | c.rlike(SIMPLE)


def grapheme_count(text: Column | str) -> Column:
    """The number of tokens; texts whose every code point is one are only measured."""
    c = _col(text)
    return F.when(is_simple(c), F.char_length(c)).otherwise(F.regexp_count(c, F.lit(r"\X")))


def graphemes(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"(\X)"), F.lit(1))


def utf16_length(text: Column | str) -> Column:
    return (F.octet_length(F.encode(_col(text), "UTF-16BE")) / 2).cast("int")


def first_cluster_length(text: Column | str) -> Column:
    """UTF-16 units of the first token, 0 for empty text."""
    return utf16_length(F.regexp_extract(_col(text), r"\A(\X)", 1))


def floor_to_cluster_start(text: Column | str, at: Column | int) -> Column:
    """The start, in code points, of the token that holds the 0-based place."""
    c, at = _col(text), F.lit(at) if isinstance(at, int) else at
    sizes = F.transform(graphemes(c), lambda g: F.char_length(g))

    def walk(acc: Column, n: Column) -> Column:
        stop = acc["done"] | (acc["at"] + n > at)
        return F.struct(F.when(stop, acc["at"]).otherwise(acc["at"] + n).alias("at"), stop.alias("done"))

    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.lit(False).alias("done")), walk, lambda acc: acc["at"])


def runes(text: Column | str) -> Column:
    """The code points as numbers."""
    return F.transform(F.filter(F.split(_col(text), ""), lambda x: x != ""), lambda x: F.ascii(x))


def rune_count(text: Column | str) -> Column:
    return F.char_length(_col(text))


def single_rune(text: Column | str) -> Column:
    """The code point of a text of one, else null."""
    return F.when(F.char_length(_col(text)) == 1, F.ascii(_col(text)))


# The JVM's own normalizer: (method, compatibility) of each form.
_FORMS = {"NFC": ("compose", False), "NFKC": ("compose", True), "NFD": ("decompose", False), "NFKD": ("decompose", True)}


def normalize(text: Column | str, form: str = "NFC") -> Column:
    """A Unicode normalization form, in the JVM; texts that surely are in it pass by.

    Spark takes a call by reflection for nondeterministic, so the column can be
    projected and filtered by, but not be an argument of an aggregate function.
    """
    c = _col(text)
    method, compatible = _FORMS[form]
    done = is_simple(c) if form == "NFC" else F.octet_length(c) == F.char_length(c)
    return F.when(c.isNull() | done, c).otherwise(F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(compatible)))


def is_normalized(text: Column | str, form: str = "NFC") -> Column:
    return normalize(text, form) == _col(text)


def position(text: Column | str, at: Column | int) -> Column:
    """A struct of char_index (UTF-16), token_index, line, char_column, token_column of a 0-based code point place, clamped."""
    c = _col(text)
    at = F.lit(at) if isinstance(at, int) else at
    prefix = F.left(c, F.greatest(F.lit(0), F.least(at, F.char_length(c))))
    lines = F.split(prefix, LINE_END)
    line_text = F.element_at(lines, -1)
    return F.struct(
        utf16_length(prefix).alias("char_index"), grapheme_count(prefix).alias("token_index"), (F.size(lines) - 1).alias("line"), utf16_length(line_text).alias("char_column"), grapheme_count(line_text).alias("token_column")
    )
