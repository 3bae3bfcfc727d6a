"""Exact removal of repeated byte strings by difference-cover suffix sorting, distributed by content.

Every string of LENGTH bytes belongs to the least hash of the K-byte strings in it, so equal
strings always share that value. Runs of starts with one value are segments; only values that
two segments share are kept, and the segments of a value meet in one task. There the starts are sorted by
the difference-cover algorithm: triples at two of three positions are named, names are sorted the same way until
they cover LENGTH bytes, the remaining starts are merged in, and neighbours are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, arrow_columns, small_batches, staged
from .minhash import mixed

LENGTH = 200
K = 40
#: Segments of one value that a task sorts at most; values with more go through window hashes, split over all tasks.
HOT = 1000
#: So do values with a segment of more bytes than this, as periodic texts have them.
LONG = 1 << 16
#: Bytes of segments that are sorted at once.
BUNDLE = 1 << 18
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_B = np.uint64(0x2545F4914F6CDD1D)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(14, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        p = np.full(size, _B, np.uint64)
        q = np.full(size, _B_INV, np.uint64)
        p[0] = q[0] = 1
        _POWERS[size] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return tuple(x[:n] for x in _POWERS[size])


def rolling(s: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of width bytes."""
    if len(s) < width:
        return np.empty(0, np.uint64)
    up, down = _powers(len(s) + 1)
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(_BYTE[s] * up[: len(s)], out=total[1:])
    return mixed((total[width:] - total[:-width]) * down[: len(s) - width + 1] + np.uint64(salt))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every width consecutive values, by running extremes in blocks."""
    f = np.minimum if least else np.maximum
    n, blocks = len(x), -(-len(x) // width)
    pad = np.full(blocks * width, np.iinfo(np.uint64).max if least else 0, np.uint64)
    pad[:n] = x
    rows = pad.reshape(blocks, width)
    ahead = f.accumulate(rows, axis=1).ravel()
    behind = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of length-byte strings that share their least K-byte hash: value, first, last, and whether
    that K-byte string stands twice in the run's bytes (so that the run can repeat itself)."""
    if len(text) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, bool))
    h = rolling(np.frombuffer(text, np.uint8), K)
    m = _sliding(h, length - K + 1, True)
    edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    first, last = edge, np.append(edge[1:], len(m)) - 1
    values = m[first]
    # positions of the least strings: h equals the least of a string that holds the position
    greatest = _sliding(np.concatenate([np.zeros(length - K, np.uint64), m, np.zeros(length - K, np.uint64)]), length - K + 1, False)
    at = np.flatnonzero(greatest == h)
    order = np.argsort(h[at], kind="stable")
    at, hs = at[order], h[at][order]
    lo = np.searchsorted(hs, values, "left")
    hi = np.searchsorted(hs, values, "right")
    twice = np.zeros(len(values), bool)
    for r in np.flatnonzero(hi - lo > 1):
        p = at[lo[r] : hi[r]]
        twice[r] = np.count_nonzero((p >= first[r]) & (p <= last[r] + length - K)) > 1
    return values.view(np.int64), first.astype(np.int32), last.astype(np.int32), twice


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of rows of keys, most significant first."""
    if len(keys) == 1:
        order = np.argsort(keys[0])
    else:
        order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray, top: int) -> list[np.ndarray]:
    """Keys that order rows (a, b, c) of values up to top: one integer if it fits."""
    if (top + 1) ** 3 < 1 << 62:
        return [(a * (top + 1) + b) * (top + 1) + c]
    return [a * (top + 1) + b, c]


def _below(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of values how many of the others are smaller; both are dense ranks."""
    counts = np.bincount(of, minlength=int(max(of.max(initial=0), values.max(initial=0))) + 1)
    return (np.cumsum(counts) - counts)[values]


def suffix_ranks(s: np.ndarray, covers: int, length: int = LENGTH) -> np.ndarray:
    """Ranks of all suffixes of s by their first length bytes at least, where a symbol covers so many bytes; equal
    prefixes may share a rank. Symbols are positive."""
    n = len(s)
    p = np.zeros(n + 5, np.int64)
    p[:n] = s
    top = int(p.max())
    i = np.arange(n)
    if n < 3 or 3 * covers >= length:
        return _dense(*_packed(p[:n], p[1 : n + 1], p[2 : n + 2], top))
    # name the triples at two of three positions and rank the string of their names
    s1, s2 = i[1::3], i[2::3]
    sample = np.concatenate([s1, s2])
    names = _dense(*_packed(p[sample], p[sample + 1], p[sample + 2], top))
    if names.max() < len(names):
        # a gap between both halves keeps names of one from running into the other
        ranks = suffix_ranks(np.concatenate([names[: len(s1)] + 1, [1], names[len(s1) :] + 1]), 3 * covers, length)
        names = _dense(np.concatenate([ranks[: len(s1)], ranks[len(s1) + 1 :]]))
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names
    # merge the remaining suffixes: by symbol and next rank against the first kind, by two symbols and rank against the second
    rest = i[0::3]
    bound = int(rank.max()) + 1
    out = np.zeros(n, np.int64)
    one, two = np.concatenate([rest, s1]), np.concatenate([rest, s2])
    r1 = _dense(p[one] * bound + rank[one + 1])
    r2 = _dense(*([(p[two] * (top + 1) + p[two + 1]) * bound + rank[two + 2]] if (top + 1) ** 2 * bound < 1 << 62 else [p[two] * (top + 1) + p[two + 1], rank[two + 2]]))
    k = len(rest)
    out[rest] = _below(r1[k:], r1[:k]) + _below(r2[k:], r2[:k]) + _below(r1[:k], r1[:k])
    out[s1] = _below(names, rank[s1]) + _below(r1[:k], r1[k:])
    out[s2] = _below(names, rank[s2]) + _below(r2[:k], r2[k:])
    return out + 1


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, whether the length-byte string at each start stands at another start of any segment too."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum([len(s) for s in segments])
    order = np.argsort(suffix_ranks(text.astype(np.int64) + 1, 1, length))
    valid = np.zeros(len(text), bool)
    for e, s in zip(ends, segments, strict=True):
        valid[e - len(s) : e - length + 1] = True
    order = order[valid[order]]
    # neighbours are compared in words of eight bytes
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(len(text), np.uint64)
    for j in range(8):
        words |= padded[j : j + len(text)].astype(np.uint64) << np.uint64(8 * j)
    x, y = order[:-1], order[1:]
    live = np.arange(len(x))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        live = live[words[x[live] + at] == words[y[live] + at]]
    hit = np.zeros(len(text), bool)
    hit[x[live]] = hit[y[live]] = True
    return [hit[e - len(s) : e - length + 1] for e, s in zip(ends, segments, strict=True)]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged [start, end) of length-byte strings at sorted starts."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length


_RUN = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("occ", T.LongType())]))
_RUN_ARROW = pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("occ", pa.int64())])


def _run_column(length: int):
    """The runs of each text; occ tells the places of runs apart, equal texts have equal ones."""

    def make():
        def compute(texts: pa.Array, keys: pa.Array):
            parts, counts = [], [0]
            for t, key in zip(texts.to_pylist(), keys.to_pylist(), strict=True):
                h, lo, hi, twice = runs_of(t or b"", length)
                seed = np.frombuffer(key[:8], np.uint64)
                occ = mixed(seed + lo.astype(np.uint64))
                extra = np.flatnonzero(twice)  # a run that can repeat itself counts as two
                parts.append((np.append(h, h[extra]), np.append(lo, lo[extra]), np.append(hi, hi[extra]), np.append(occ, ~occ[extra])))
                counts.append(counts[-1] + len(parts[-1][0]))
            cols = [np.concatenate([p[j] for p in parts]) for j in range(4)]
            flat = pa.StructArray.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3].view(np.int64))], fields=list(_RUN_ARROW))
            return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)]

        return compute

    return make


def _with_runs(docs: DataFrame, length: int, keep: list[str]) -> DataFrame:
    return arrow_columns(docs, ["bytes", "text_key"], [T.StructField("runs", _RUN)], _run_column(length), keep=keep)


def _sorted_spans(segments: DataFrame, length: int) -> DataFrame:
    """(text_key, starts, ends) of repeated strings in segments (h, text_key, lo, seg); all segments of an h meet."""
    schema = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def done():
            names = {}
            for _, _, _, seg in held:
                names.setdefault(seg, len(names))
            many = np.bincount([names[x[3]] for x in held], minlength=len(names)) > 1
            hits = repeated_starts(list(names), length)
            keys, starts, ends = [], [], []
            for _, key, lo, seg in held:
                hit = np.arange(len(seg) - length + 1) if many[names[seg]] else np.flatnonzero(hits[names[seg]])
                if len(hit):
                    s, e = _spans(hit + lo, length)
                    keys.append(key)
                    starts.append(s.astype(np.int32))
                    ends.append(e.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=schema.fieldNames())

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] == last:  # a repeated row or a run counted twice
                    continue
                if size >= BUNDLE and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = row[:3]
        if held:
            yield done()

    small_batches(segments.sparkSession)
    return segments.select("h", "text_key", "lo", "seg").repartition("h").sortWithinPartitions("h", "text_key", "lo").mapInArrow(run, schema)


def _hashed_spans(segments: DataFrame, length: int) -> DataFrame:
    """The same for values with very many segments: their strings are named by two hashes and counted."""
    fields = [T.StructField("w", T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])))]

    def make():
        def compute(segs: pa.Array):
            parts, counts = [], [0]
            for s in segs.to_pylist():
                a = np.frombuffer(s, np.uint8)
                parts.append((rolling(a, length, 1), rolling(a, length, 2) ^ mixed(rolling(255 - a, length))))
                counts.append(counts[-1] + len(parts[-1][0]))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([p[j] for p in parts]).view(np.int64)) for j in (0, 1)], names=["x", "y"])
            return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)]

        return compute

    strings = arrow_columns(segments.select("text_key", "lo", "seg").distinct(), ["seg"], fields, make, keep=["text_key", "lo"]).select("text_key", "lo", F.posexplode("w").alias("i", "w")).select("text_key", (F.col("lo") + F.col("i")).alias("start"), "w.x", "w.y")
    many = strings.groupBy("x", "y").agg(F.min(F.xxhash64("text_key", "start")).alias("p"), F.max(F.xxhash64("text_key", "start")).alias("q")).where("p != q").select("x", "y")
    return strings.join(many, ["x", "y"]).groupBy("text_key").agg(F.sort_array(F.collect_set("start")).alias("starts")).select("text_key", "starts", F.transform("starts", lambda s: (s + length).cast("int")).alias("ends"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the kept bytes if with_text.

    A byte goes if a string of length bytes that covers it starts anywhere else as well, in this
    document or another. Equal texts of length bytes or more are removed whole, and one of them is compared
    with the rest. Null and empty texts have no bytes; repeated rows count as copies; an empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(key), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("bytes")).withColumn("text_key", F.unhex(F.md5("bytes")))
    narrow = staged(rows.select(key, F.octet_length("bytes").cast("long").alias("n_bytes"), "text_key", F.sha2("bytes", 256).alias("sha")), "texts")
    classes = staged(narrow.groupBy("text_key").agg(F.count("*").alias("n"), F.min(key).alias("rep")).where("n > 1"), "copies")
    long = rows.where(F.octet_length("bytes") >= length)
    others = narrow.where(f"n_bytes >= {length}").join(classes, "text_key").where(F.col(key) != F.col("rep")).select(key, "text_key").distinct()
    n_others = others.count()
    long = long.join(F.broadcast(others) if n_others * 32 <= BROADCAST_BYTES else others, [key, "text_key"], "left_anti")

    runs = _with_runs(long, length, ["text_key"]).select("text_key", F.explode("runs").alias("r")).select("text_key", "r.*")
    shared = staged(runs.groupBy("h").agg(F.min("occ").alias("p"), F.max("occ").alias("q"), F.count("*").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("most")).where("p != q").select("h", ((F.col("n") > HOT) | (F.col("most") > LONG)).alias("hot")), "shared")
    n_shared = shared.count()
    if n_shared * 16 <= BROADCAST_BYTES:
        found = _with_runs(long, length, ["text_key", "bytes"]).select("text_key", "bytes", F.explode("runs").alias("r")).select("text_key", "bytes", "r.*").join(F.broadcast(shared), "h")
    else:
        mine = runs.join(shared, "h").groupBy("text_key").agg(F.collect_set(F.struct("h", "lo", "hi", "hot")).alias("r"))
        found = long.join(mine, "text_key").select("text_key", "bytes", F.explode("r").alias("r")).select("text_key", "bytes", "r.*")
    segments = staged(found.select("h", "hot", "text_key", "lo", F.expr(f"substring(bytes, lo + 1, hi - lo + {length})").alias("seg")), "segments")
    spans = _sorted_spans(segments.where("NOT hot"), length)
    if segments.where("hot").limit(1).count():
        spans = spans.unionByName(_hashed_spans(segments.where("hot"), length))
    spans = staged(spans.groupBy("text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "spans")

    fields = [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if with_text else [])]

    def make():
        def compute(texts, starts, ends):
            out = []
            for t, s, e in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
                change = np.zeros(len(t) + 1, np.int64)
                np.add.at(change, np.array(s, np.int64), 1)
                np.add.at(change, np.array(e, np.int64), -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                out.append((int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            return [pa.array([o[j] for o in out], kinds[j]) for j in range(len(fields))]

        return compute

    keys, n = spans.select("text_key"), spans.count()
    texts = rows.join(F.broadcast(keys) if n * 32 <= BROADCAST_BYTES else keys, "text_key", "left_semi")
    if with_text:
        cut = arrow_columns(rows.join(spans, "text_key", "left").withColumns({"starts": F.coalesce("starts", F.array().cast("array<int>")), "ends": F.coalesce("ends", F.array().cast("array<int>"))}), ["bytes", "starts", "ends"], fields, make, keep=[key, "text_key"])
        whole = cut.join(classes.select("text_key", "n"), "text_key", "left").withColumn("n_bytes", F.col("n_removed") + F.octet_length("kept"))
        gone = (F.col("n") > 1) & (F.col("n_bytes") >= length)
        return whole.select(key, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    cut = arrow_columns(texts.dropDuplicates(["text_key"]).join(spans, "text_key"), ["bytes", "starts", "ends"], fields, make, keep=["text_key"])
    out = narrow.join(classes.select("text_key", "n"), "text_key", "left").join(cut, "text_key", "left")
    gone = (F.coalesce("n", F.lit(1)) > 1) & (F.col("n_bytes") >= length)
    return out.select(key, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
