"""Near-duplicates by SetSketch registers: mergeable truncated minima, banded, compared by likelihood, then verified."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, arrow_columns, components, discard, restrict, small_batches, staged

SHINGLE = 5
#: A pair of similarity 0.75 agrees in all registers of at least one band but for 2 times in 10^6.
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate and highest register; a sketch of 2-byte registers.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Estimates this many standard errors under the threshold still go to verification.
ERRORS = 4.5
#: Registers in a short sketch: the lowest two bits of each, padded to whole 64-bit words.
FIELDS = -(-REGISTERS // 32) * 32
#: Members of a bucket that are compared with each other at once, and the shingles of their sets; larger buckets are dealt
#: as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Pairs of short sketches that are compared at once.
_AT_ONCE = 1 << 18
_rng = np.random.Generator(np.random.PCG64(2021))
_XOR = _rng.integers(0, 1 << 32, (2, REGISTERS // 2, 1), np.uint32)
_ODD = _rng.integers(0, 1 << 32, (2, REGISTERS // 2, 1), np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0x5555555555555555)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles of words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    cut = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    lens = np.fromiter(map(len, cut), np.int64, len(cut))
    ends = np.cumsum(lens)
    h = np.fromiter(map(words.__getitem__, chain.from_iterable(cut)), np.uint64, int(ends[-1]) if len(cut) else 0)

    def windows(x: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(x) - n + 1, n, np.uint64)
        for j in range(n):
            out = mixed(out * _MIX + x[j : len(x) - n + 1 + j])
        return out

    # windows over all texts at once; those that run from one text into the next are never read
    every = windows(h, size) if len(h) >= size else h
    out = []
    for n, e in zip(lens.tolist(), ends.tolist(), strict=True):
        out.append(np.unique(every[e - n : e - size + 1]) if n >= size else windows(h[e - n : e], n) if n else h[:0])
    return out


def shingle_set(text: str | None, words: Words, size: int = SHINGLE) -> np.ndarray:
    return shingle_sets([text], words, size)[0]


def least_values(elements: np.ndarray) -> np.ndarray:
    """For each register the least of its hash values of the elements: half the registers hash the low 32 bits, half the high ones."""
    least = np.full((2, REGISTERS // 2), np.iinfo(np.uint32).max, np.uint32)
    for half in (0, 1):
        e = (elements >> np.uint64(32 * half)).astype(np.uint32)
        for at in range(0, len(e), 512):
            v = e[None, at : at + 512] ^ _XOR[half]
            v *= _ODD[half]
            np.minimum(least[half], v.min(axis=1), out=least[half])
    return least.ravel()


def truncated(least: np.ndarray) -> np.ndarray:
    """Registers of least values: the values as exponential variables on a truncated log scale."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers: in each, the least of exponential values of the elements on a truncated log scale."""
    return truncated(least_values(elements))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities of sketch pairs (rows of a and b) of known set sizes, where the joint likelihood of the
    counts of greater, lesser and equal registers is highest; found by narrowing, as it has one peak."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        q, r = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(q) + less * np.log(r) + same * np.log(np.maximum(1 - q - r, 1e-12))

    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(x) < likelihood(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def short_sketches(regs: np.ndarray) -> np.ndarray:
    """The lowest two bits of the registers of each row, packed into 64-bit words."""
    bits = np.zeros((len(regs), FIELDS), np.uint64)
    bits[:, :REGISTERS] = regs & 3
    return np.bitwise_or.reduce(bits.reshape(len(regs), -1, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=2)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many registers rows of short sketches agree."""
    x = a ^ b
    return REGISTERS - np.bitwise_count((x | (x >> np.uint64(1))) & _LOW).sum(axis=1, dtype=np.int64)


def least_agreeing(j: float) -> int:
    """Registers of short sketches in which a pair of similarity j agrees, but for ERRORS standard errors: unequal
    registers agree in two bits one time in four."""
    p = j + (1 - j) / 4
    return int(np.floor(REGISTERS * p - ERRORS * np.sqrt(REGISTERS * p * (1 - p))))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each row."""
    rows = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _MIX, rows.shape[:2])
    for k in range(ROWS):
        keys = mixed(keys * _MIX + rows[:, :, k])
    return keys.view(np.int64)


def _sketch():
    words = Words()

    def compute(texts: pa.Array):
        sets = shingle_sets(texts.to_pylist(), words)
        regs = truncated(np.stack([least_values(s) for s in sets])) if sets else np.empty((0, REGISTERS), "<u2")
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary())]

    return compute


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _bands():
    """Keys of the bands of a sketch."""

    def compute(regs: pa.Array):
        keys = band_keys(_matrix(regs, "<u2", REGISTERS))
        return [pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())]

    return compute


def _shortened():
    def compute(regs: pa.Array):
        return [pa.array([r.tobytes() for r in short_sketches(_matrix(regs, "<u2", REGISTERS))], pa.binary())]

    return compute


def _pairs_within(edges: np.ndarray):
    """(later, earlier) row numbers of all pairs in runs of rows that start at edges (the last one ends them), some at a time."""
    starts, sizes = edges[:-1], np.diff(edges)
    for g in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == g]
        later, earlier = np.tril_indices(g, -1)
        for k in range(0, len(later), _AT_ONCE):
            x, y = later[k : k + _AT_ONCE], earlier[k : k + _AT_ONCE]
            step = max(1, _AT_ONCE // len(x))
            for j in range(0, len(at), step):
                yield (at[j : j + step, None] + x).ravel(), (at[j : j + step, None] + y).ravel()


def _by_block(rows: DataFrame, columns: list[str], pick) -> DataFrame:
    """(band, a, b, more) that pick() makes of all rows of some blocks at a time.

    rows (band, chunks, rep, ...): a bucket's rows are dealt to as many chunks; each pair of chunks (p, q) is a block, with
    the row's own chunk as c. A task holds a block at a time, of some 2 * BLOCK rows.
    """
    schema = T.StructType([T.StructField("band", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("more", T.BooleanType())])
    deal = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(F.least(i, F.col("c")).alias("p"), F.greatest(i, F.col("c")).alias("q")))
    blocks = rows.withColumn("c", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).withColumn("d", F.explode(deal)).withColumns({"p": F.col("d.p"), "q": F.col("d.q")})

    def run(batches):
        held = None

        def picked(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            num = {f.name: t.column(f.name).to_numpy() for f in t.schema if pa.types.is_integer(f.type)}
            new = np.ones(t.num_rows, bool)
            new[1:] = np.logical_or.reduce([np.diff(num[c]) != 0 for c in ("band", "p", "q")])
            band, a, b, more = pick(t, num, np.append(np.flatnonzero(new), t.num_rows))
            return pa.RecordBatch.from_arrays([pa.array(band, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.bool_())], names=schema.fieldNames())

        for x in batches:
            t = pa.Table.from_batches([x])
            held = t if held is None else pa.concat_tables([held, t])
            same = np.logical_and.reduce([(k := held.column(c).to_numpy()) == k[-1] for c in ("band", "p", "q")])
            whole = held.num_rows - int(same.sum())  # the last block may go on in the next batch
            if whole:
                yield picked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield picked(held)

    small_batches(rows.sparkSession)
    return blocks.select("band", "p", "q", "c", "rep", *columns).repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", "rep").mapInArrow(run, schema)


def _may_meet(num: dict, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the row pairs (x, y) of a block are of different parts, allowed by their sizes, and this block's to compare."""
    n, m = num["n_shingles"][x], num["n_shingles"][y]
    return (num["part"][x] != num["part"][y]) & ((num["p"][x] == num["q"][x]) | (num["c"][x] != num["c"][y])) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)


def pick_partners(rows: DataFrame, percent: int) -> DataFrame:
    """For each document a of rows (band, chunks, rep, n_shingles, part, bits) the least document b < a of its block that
    its size and short sketch allow; more, if a has others."""
    floor = least_agreeing(percent / 100)

    def pick(t: pa.Table, num: dict, edges: np.ndarray):
        words = _matrix(t.column("bits"), "<u8", FIELDS // 32)
        found = [(np.empty(0, np.int64),) * 2]
        for x, y in _pairs_within(edges):
            ok = _may_meet(num, x, y, percent)
            x, y = x[ok], y[ok]
            ok = agreeing(words[x], words[y]) >= floor
            found.append((x[ok], y[ok]))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else x
        more = np.diff(np.append(first, len(x))) > 1
        x, y = x[first], y[first]
        return num["band"][x], num["rep"][x], num["rep"][y], more

    return _by_block(rows, ["n_shingles", "part", "bits"], pick)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets, as a matrix product over the elements that two sets share."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    values, out = values[counts > 1], np.zeros((len(sets), len(sets)), np.float32)
    at = [np.searchsorted(values, s) for s in sets]
    at = [i[(i < len(values)) & (values[np.minimum(i, len(values) - 1)] == s)] if len(values) else i[:0] for i, s in zip(at, sets, strict=True)]
    for lo in range(0, len(values), 4096):
        has = np.zeros((len(sets), min(4096, len(values) - lo)), np.float32)
        for k, i in enumerate(at):
            has[k, i[slice(*np.searchsorted(i, (lo, lo + 4096)))] - lo] = 1
        out += has @ has.T
    return out


def _forest(linked: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, row) that connect all parts that linked, a symmetric matrix, connects: each row takes its first link to
    another part, those parts become one, and again."""
    part, out = part.copy(), []
    while True:
        away = linked & (part[:, None] != part[None, :])
        rows = np.flatnonzero(away.any(axis=1))
        if not len(rows):
            return out
        for x, y in zip(rows.tolist(), away[rows].argmax(axis=1).tolist(), strict=True):
            if part[x] != part[y]:
                out.append((max(x, y), min(x, y)))
                part[part == max(part[x], part[y])] = min(part[x], part[y])


def pick_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between the parts of rows (band, chunks, rep, n_shingles, part, items): all pairs of a block are compared by
    their full sets, and as many links as connect the parts are given."""

    def pick(t: pa.Table, num: dict, edges: np.ndarray):
        items, got = t.column("items").to_pylist(), [(np.empty(0, np.int64),) * 2]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo < 2 or (num["part"][lo:hi] == num["part"][lo]).all():
                continue
            both = common_counts([np.frombuffer(x, "<u8") for x in items[lo:hi]]).astype(np.int64)
            n = num["n_shingles"][lo:hi]
            y, x = np.meshgrid(np.arange(lo, hi), np.arange(lo, hi))
            linked = _may_meet(num, x, y, percent) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
            got += [np.array(z, np.int64).reshape(-1, 2).T + lo for z in [_forest(linked, num["part"][lo:hi])]]
        x, y = (np.concatenate(z) for z in zip(*got, strict=True))
        a, b = num["rep"][x], num["rep"][y]
        return num["band"][x], np.maximum(a, b), np.minimum(a, b), np.zeros(len(x), bool)

    return _by_block(rows, ["n_shingles", "part", "items"], pick)


def near_pairs(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """Of pairs (a, b), a > b, those whose full shingle sets agree: estimated by sketch first, then compared. Staged."""
    j = percent / 100
    floor = j - ERRORS * float(np.sqrt(j * (1 - j) / REGISTERS))
    side = lambda n: sketches.select(F.col("rep").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("regs").alias(f"r{n}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def guess():
        def compute(na, nb, ra, rb):
            x = [_matrix(r, "<u2", REGISTERS) for r in (ra, rb)]
            return [pa.array(estimate(x[0], x[1], na.to_numpy().astype(float), nb.to_numpy().astype(float)) >= floor)]

        return compute

    likely = staged(arrow_columns(joined, ["na", "nb", "ra", "rb"], [T.StructField("likely", T.BooleanType())], guess, keep=["a", "b"]).where("likely").select("a", "b"), "likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    texts = staged(restrict(docs.select(key, text), key, ids, 2 * likely.count()), "texts")
    both = likely.join(texts.select(F.col(key).alias("a"), F.col(text).alias("ta")), "a").join(texts.select(F.col(key).alias("b"), F.col(text).alias("tb")), "b")

    def verify():
        words, known = Words(), {}

        def compute(b, ta, tb):
            sets, out = shingle_sets(ta.to_pylist(), words), []
            for k, s, y in zip(b.to_pylist(), sets, tb.to_pylist(), strict=True):
                if (k, y) not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[k, y] = shingle_set(y, words)
                r = known[k, y]
                common = len(np.intersect1d(s, r, assume_unique=True))
                out.append(100 * common >= percent * (len(s) + len(r) - common))
            return [pa.array(out, pa.bool_())]

        return compute

    found = staged(arrow_columns(both, ["b", "ta", "tb"], [T.StructField("near", T.BooleanType())], verify, keep=["a", "b"]).where("near").select("a", "b").distinct(), "links")
    discard(likely, texts)
    return found


def _items():
    """The shingle set of a text as sorted 64-bit hashes."""
    words = Words()

    def compute(texts: pa.Array):
        sets = shingle_sets(texts.to_pylist(), words)
        return [pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]

    return compute


def _with_parts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")


def linked_parts(met: DataFrame, sketches: DataFrame, short: DataFrame, docs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """(node, component) of documents that links connect, from bucket members met (band, chunks, rep).

    First every document picks the least partner in each of its blocks; the pairs are verified and what they link becomes
    one part. So copies, however many, cost a pair or a few each. Buckets in which a document had more partners than it
    picked, and that hold more than one part still, go on: there full sets are compared, block by block inside tasks, and
    only links that connect parts come out.
    """
    picked = staged(pick_partners(met.join(short, "rep").withColumn("part", F.col("rep")), percent), "picked")
    pairs = staged(picked.select("a", "b").distinct(), "pairs")
    links = near_pairs(pairs, sketches, docs, percent, key, text)
    labels, open_ = components(links), staged(picked.where("more").select("band").distinct(), "open")
    discard(picked, pairs, links)
    if not open_.take(1):
        return labels
    rows = _with_parts(met.select("band", "rep").join(open_, "band", "left_semi"), labels)
    size = short.select("rep", "n_shingles")
    apart = rows.join(size, "rep").groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("p < q")
    apart = staged(apart.select("band", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("chunks")), "apart")
    left = staged(met.select("band", "rep").join(apart, "band"), "left")
    ids = staged(left.select("rep").distinct(), "ids")
    texts = restrict(docs.select(F.col(key).alias("rep"), text), "rep", ids, ids.count())
    items = arrow_columns(texts, [text], [T.StructField("n_shingles", T.LongType()), T.StructField("items", T.BinaryType())], _items, keep=["rep"])
    links = staged(pick_links(_with_parts(left, labels).join(items, "rep"), percent).select("a", "b").distinct(), "links")
    whole = components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    discard(open_, apart, left, ids, links, labels)
    return whole


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document; keys are integers.

    Documents of equal sets are one class, known by its smallest key. Classes meet in the bands of
    their sketches (see linked_parts), and links are confirmed on full sets.

    Null and empty texts have empty sets and are linked with nothing; a null key is its own
    component and kept; rows that share a key are one document; an empty table gives no rows; other
    columns are ignored.
    """
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(key).cast("long").alias(key), text)
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("regs", T.BinaryType())]
    all_ = staged(arrow_columns(docs, [text], fields, _sketch, keep=[key]), "sketches")
    full = all_.where(F.col("set_key").isNotNull() & F.col(key).isNotNull())
    copies = staged(full.groupBy("set_key").agg(F.min(key).alias("rep"), F.count("*").alias("n")).where("n > 1").select("set_key", "rep"), "copies")
    # a row for each set that stands twice or more; the row count bounds its bytes
    copies = F.broadcast(copies) if copies.count() * 48 <= BROADCAST_BYTES else copies
    sketches = full.join(copies, "set_key", "left").where(F.col("rep").isNull() | (F.col("rep") == F.col(key))).select(F.col(key).alias("rep"), "n_shingles", "regs")

    bands = arrow_columns(sketches, ["regs"], [T.StructField("bands", T.ArrayType(T.LongType()))], _bands, keep=["rep"]).select("rep", F.explode("bands").alias("band"))
    shared = staged(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "shared")
    met = staged(bands.join(F.broadcast(shared) if shared.count() * 24 <= BROADCAST_BYTES else shared, "band"), "met")
    short = staged(arrow_columns(restrict(sketches, "rep", met.select("rep").distinct(), met.count()), ["regs"], [T.StructField("bits", T.BinaryType())], _shortened, keep=["rep", "n_shingles"]), "short")
    discard(shared)
    labels = linked_parts(met, sketches, short, docs, percent, key, text).withColumnRenamed("node", "rep")
    discard(short)
    out = all_.select(key, "n_shingles", "set_key")
    # empty sets are linked with nothing and stay out of the join
    some = out.where("set_key IS NOT NULL").join(copies, "set_key", "left").select(key, "n_shingles", F.coalesce("rep", key).alias("rep"))
    out = some.unionByName(out.where("set_key IS NULL").select(key, "n_shingles", F.col(key).alias("rep")))
    n = labels.count()
    out = out.join(F.broadcast(labels) if n * 32 <= BROADCAST_BYTES else labels, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select(F.col(key).cast(kind).alias(key), "n_shingles", F.col("component_id").cast(kind).alias("component_id"), F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))
