"""Benchmark decontamination by multi-pattern search of word windows with block shift tables."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns

WINDOW = 10
#: Bytes of benchmark text that one set of search tables is built from.
BLOCK_BYTES = 8 << 20
#: Words in the blocks of the shift tables.
BLOCK_WORDS = 3
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_tables: dict = {}


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class SearchTables:
    """Shift and suffix tables for the windows of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.suffix: dict[tuple, dict[tuple, list[str]]] = defaultdict(dict)
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.most), length - end)
            self.suffix[p[length - self.block :]][p] = items

    def search(self, words: list[bytes], found) -> None:
        """Calls found(start, items) for every occurrence."""
        n, m, b, most, shift = len(words), self.length, self.block, self.most, self.shift
        end = m
        while end <= n:
            key = tuple(words[end - b : end])
            step = shift.get(key, most)
            if step:
                end += step
                continue
            if items := self.suffix[key].get(tuple(words[end - m : end])):
                found(end - m, items)
            end += 1


def build(patterns: dict[tuple[bytes, ...], list[str]]) -> list[SearchTables]:
    by_length: dict[int, dict] = defaultdict(dict)
    for p, items in patterns.items():
        by_length[len(p)][p] = items
    return [SearchTables(by_length[n], n) for n in sorted(by_length)]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (word positions: start, end, start, end ...) and item_ids.

    A benchmark item gives its windows of consecutive words; an item of fewer words is one window.
    The search runs once over the documents for each block of BLOCK_BYTES of benchmark text, with
    tables of bounded size; documents never move between executors.

    Null or empty texts have no words and no hits; items without words give no window; an item with
    a null id marks words as hit but is not listed; repeated items count once; repeated documents
    each get their row. Input columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    out = docs.select("*", F.array().cast("array<int>").alias("hit_spans"), F.array().cast("array<string>").alias("item_ids")) if not {"hit_spans", "item_ids"} & {c.lower() for c in docs.columns} else docs.withColumns({"hit_spans": F.array().cast("array<int>"), "item_ids": F.array().cast("array<string>")})
    for k in range(blocks):
        patterns: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        for r in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).toLocalIterator():
            for w in set(windows_of(words_of(r.t), window)):
                patterns[w].append(r.i)
        sent = spark.sparkContext.broadcast(dict(patterns))

        def make(sent=sent, name=f"{id(spark)}-{sent._jbroadcast.id() if sent._jbroadcast is not None else k}"):
            if name not in _tables:
                _tables.clear()
                _tables[name] = build(sent.value)
            tables = _tables[name]

            def compute(texts: pa.Array, spans: pa.Array, ids: pa.Array):
                n_words, n_hit, all_spans, all_ids = [], [], [], []
                for t, old, named in zip(texts.to_pylist(), spans.to_pylist(), ids.to_pylist(), strict=True):
                    words = words_of(t)
                    hits: list[tuple[int, int]] = list(zip(old[::2], old[1::2], strict=True))
                    seen = set(named)
                    for x in tables:
                        x.search(words, lambda s, found, m=x.length: (hits.append((s, s + m)), seen.update(found)))
                    hits = _merge(hits)
                    n_words.append(len(words))
                    n_hit.append(sum(e - s for s, e in hits))
                    all_spans.append([p for h in hits for p in h])
                    all_ids.append(sorted(seen - {None}))
                return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_ids, pa.list_(pa.string()))]

            return compute

        out = arrow_columns(out, [text, "hit_spans", "item_ids"], fields, make)
    return out
