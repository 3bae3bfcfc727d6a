"""Column functions: keys, names, dates, vectors and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of a chunk start at chunk_key times this.
CHUNK_SIZE = 1_000_000_000
#: Accented letters and what they become.
ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
AVOGADRO = 6.02214076e23


def chunk_key(c: Column, n: int) -> Column:
    """The md5 of c as a number modulo n, folded word by word; exact for n below 2^31."""
    digest, acc = F.md5(c.cast("string")), F.lit(0).cast("long")
    for i in range(4):
        word = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit((1 << 32) % n) + word, F.lit(n))
    return acc.cast("int")


def chunk_of(datastore_id: Column) -> Column:
    return F.floor(datastore_id / CHUNK_SIZE).cast("int")


def chemical_system(c: Column) -> Column:
    """Names parted by minus, sorted."""
    return F.array_join(F.array_sort(F.split(c, "-")), "-")


def subsystems(c: Column) -> Column:
    """All non-empty subsets of the parts of a name, by size, then alphabetically."""
    parts = F.array_sort(F.array_distinct(F.split(c, "-")))
    masks = F.sequence(F.lit(1), (F.lit(1).cast("int") * F.pow(F.lit(2), F.size(parts)) - 1).cast("int"))

    def subset(m: Column) -> Column:
        return F.array_join(F.filter(parts, lambda _, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)).cast("int"), F.lit(2)) == 1), "-")

    return F.transform(F.sort_array(F.transform(masks, lambda m: F.struct(F.bit_count(m).alias("n"), subset(m).alias("s")))), lambda x: x["s"])


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def without_accents(c: Column) -> Column:
    return F.translate(c, ACCENTS, PLAIN)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def matrix_norms(m: Column) -> tuple[Column, Column]:
    """The greatest norm of a row, and the norm of all values."""
    return F.array_max(F.transform(m, norm)), norm(F.flatten(m))


def molar_volume(volume: Column, n: Column) -> Column:
    return volume / n * AVOGADRO * 1e-24


def per_unit(amount: Column, n: Column) -> Column:
    """amount / n where neither is missing or zero."""
    return F.when((amount != 0) & (n != 0), amount / n)


def whole_days(seconds: Column) -> Column:
    """Days, cut towards zero."""
    return (seconds / 86400).cast("long")


def parse_vector(c: Column) -> Column:
    """Numbers of a text like '1 2 3*0.5', where n*x stands for n times x."""
    one = lambda t: F.when(t.contains("*"), F.array_repeat(F.split_part(t, F.lit("*"), F.lit(2)).try_cast("double"), F.coalesce(F.split_part(t, F.lit("*"), F.lit(1)).try_cast("int"), F.lit(0)))).otherwise(F.array(t.try_cast("double")))
    return F.flatten(F.transform(F.split(F.trim(c), r"\s+"), one))


def is_true(c: Column) -> Column:
    """Whether a text starts with t or is a dotted .t, in any case."""
    return F.lower(F.ltrim(F.regexp_replace(c, r"^\s*\.", ""))).startswith("t")


def hex_amount(c: Column, decimals: int) -> Column:
    """A hexadecimal amount of up to 64 bits in whole units."""
    return F.conv(F.regexp_replace(c, "^0x", ""), 16, 10).cast("decimal(38,0)") / F.lit(10**decimals).cast("decimal(38,0)")


def name_part(c: Column, i: int) -> Column:
    """A part of a dotted workflow name: type, application, preset."""
    return F.get(F.split(c, r"\."), F.lit(i - 1))


def table_counts_key(*columns: Column) -> Column:
    """The md5 of several columns joined by blanks."""
    return F.md5(F.concat_ws(" ", *columns))


def atomic_density(volume: Column, n: Column) -> Column:
    """Atoms in a unit of volume; null without volume."""
    return F.when(volume > 0, n / volume)
