"""Column functions that repair, parse and make values."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of generated ids, without vowels and Y.
ID_LETTERS = "BCDFGHJKLMNPQRSTVWXZ"


@cache
def _folding() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is an ASCII letter and marks, and those letters."""
    found = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in found if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def folded(c: Column) -> Column:
    """Text without accents: composed Latin letters lose their marks, and loose marks go."""
    return F.regexp_replace(F.translate(c, *_folding()), r"[\x{300}-\x{36F}]", "")


def repaired_encoding(c: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1, read again; text that is no such case stays."""
    again = F.try_validate_utf8(F.encode(c, "iso-8859-1").cast("string"))
    return F.when(c.rlike(r"[\x{80}-\x{FF}]") & ~c.rlike(r"[^\x{00}-\x{FF}]"), F.coalesce(again, c)).otherwise(c)


def repaired_array(c: Column, of: str = "string") -> Column:
    """Arrays written with single quotes, None or NaN in place of JSON's words, parsed."""
    # quoted items are taken whole, so an apostrophe inside double quotes, or an escaped one, stays
    items = F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|[^\s,\[\]"\']+'), F.lit(0))
    inner = lambda x: F.replace(F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
    word = lambda x: F.when(x.isin("None", "NaN", "nan", "null"), "null").when(x.startswith("'"), F.concat(F.lit('"'), inner(x), F.lit('"'))).otherwise(x)
    return F.when(c.rlike(r"^\s*\["), F.from_json(F.concat(F.lit("["), F.array_join(F.transform(items, word), ","), F.lit("]")), f"array<{of}>"))


def wide_hex(c: Column) -> Column:
    """A hexadecimal number of up to 38 decimal digits, 0x or not, as a decimal; larger ones are null."""
    digits = F.lpad(F.regexp_replace(F.lower(c), "^0x0*", ""), 42, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.conv(F.substring(digits, i * 7 + 1, F.lit(7)), 16, 10).cast("decimal(38,0)"))
    value = F.aggregate(words, F.lit(0).cast("decimal(38,0)"), lambda a, w: (a * F.lit(1 << 28) + w).try_cast("decimal(38,0)"))
    return F.when(F.length(F.regexp_replace(F.lower(c), "^0x0*", "")) <= 31, value)


def public_id(key: Column, draw: int = 0) -> Column:
    """An id like BCD-123-4567, drawn from the md5 of a key; another draw gives another id."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{draw}")))
    word = lambda at, size, n: F.pmod(F.conv(F.substring(digest, at, size), 16, 10).cast("long"), F.lit(n))
    letters = [F.substring(F.lit(ID_LETTERS), (word(1 + 4 * i, 4, len(ID_LETTERS)) + 1).cast("int"), F.lit(1)) for i in range(3)]
    return F.concat(*letters, F.lit("-"), F.lpad(word(13, 6, 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(word(19, 8, 10_000).cast("string"), 4, "0"))


def commands(c: Column) -> Column:
    """(command, arguments) of each non-empty command in a text, parted by semicolons or line ends."""
    parts = F.filter(F.transform(F.split(c, "[;\n]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.element_at(F.split(p, " +"), 1).alias("command"), F.slice(F.split(p, " +"), F.lit(2), F.size(F.split(p, " +"))).alias("arguments")))


def typed(c: Column) -> Column:
    """(whole, real, flag) that a text stands for: a whole number, another number, or true and false in any spelling."""
    whole = c.try_cast("long")
    whole = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), whole)
    return F.struct(whole.alias("whole"), F.when(whole.isNull(), c.try_cast("double")).alias("real"), F.when(F.lower(F.trim(c)).isin("t", "true", ".true.", "f", "false", ".false."), F.ltrim(F.lower(F.replace(c, F.lit("."), F.lit("")))).startswith("t")).alias("flag"))


def series_value(c: Column) -> Column:
    """A number of a published series, where a dot alone stands for no value."""
    return F.when(F.trim(c) != ".", c.try_cast("double"))
