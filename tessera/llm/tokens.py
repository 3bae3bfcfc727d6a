"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped; bases from prefix sums."""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

END_ID = 0
#: Bytes of input for each partition of the files.
PART_BYTES = 64 << 20
#: Distinct pieces whose ids a task remembers.
MEMO = 1_000_000
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: White space and a word up to punctuation or white space; white space and other visible characters; white space.
_PIECE = re.compile(r"\s*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s,.;:!?|]|\Z)|\s*\S+|\s+")
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


class PieceEncoder(dict):
    """Ids of texts as bytes, remembered by piece.

    A byte-level BPE splits texts at every change from visible characters to white space, and from
    letters to punctuation, before it merges, and looks at nothing across it. So a text's ids are those of its pieces (white space, then
    visible characters), each encoded by the library once. Texts with the four separators that only
    Python takes for white space, or with the string of an added token, are encoded as a whole. ordinary: strings of
    special tokens in a text are ordinary text; else they get their ids, as the library does by default.
    """

    def __init__(self, path: str, ordinary: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (ordinary and t.special)]
        self.whole = (*_ODD_SPACE, *added)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = kind["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[piece] = ids = self.direct(piece)
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(x in text for x in self.whole):
            return self.direct(text)
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


def encoder(path: str, ordinary: bool = False) -> PieceEncoder:
    """The encoder of this Python worker; its memory serves all tasks that the worker runs."""
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = PieceEncoder(path, ordinary)
    return _encoders[path, ordinary]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text", partitions: int | None = None, ordinary: bool = False) -> list[dict]:
    """Writes the ids of all texts in ascending order of key to the folder out (a URI all executors reach); returns the manifest.

    A partition has three files: .bin, the ids as flat little-endian unsigned integers of 2 or 4
    bytes; .idx, n + 1 offsets of 64 bits; .docs, the keys as an Arrow file. Ranges of keys (rows of one key by a
    hash of the text) are the partitions. A task names its files anew each time and only a finished
    task's names reach the manifest, so a repeated task does no harm. The manifest, a
    row for each partition with its base from prefix sums, is written as manifest.json.

    ordinary: see PieceEncoder. Null keys come first; null and empty texts are the end id alone; an empty table gives an empty
    manifest; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # Spark's estimate of the input's bytes, files on disk for a table
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if not partitions else 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), 1 << 16))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t").drop("h")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("width", T.IntegerType())])

    def write(batches):
        enc, part = encoder(tokenizer, ordinary), TaskContext.get().partitionId()
        name, at, offsets, keys = f"tokens-{part:06d}-{uuid.uuid4().hex[:12]}", 0, [np.zeros(1, "<i8")], None
        store, path = _filesystem(out)
        store.create_dir(path, recursive=True)
        end = np.array([END_ID], enc.dtype).tobytes()
        with store.open_output_stream(f"{path}/{name}.bin") as data:
            with store.open_output_stream(f"{path}/{name}.docs") as sink:
                for b in batches:
                    ids = [enc.encode(t) for t in b.column(1).to_pylist()]
                    sizes = np.fromiter((len(x) // enc.dtype.itemsize + 1 for x in ids), np.int64, len(ids))
                    offsets.append(at + np.cumsum(sizes))
                    at = int(offsets[-1][-1])
                    for x in ids:
                        data.write(x + end)
                    found = pa.record_batch([b.column(0)], names=["key"])
                    keys = keys or pa.ipc.new_file(sink, found.schema)
                    keys.write_batch(found)
                if keys:
                    keys.close()
        with store.open_output_stream(f"{path}/{name}.idx") as sink:
            sink.write(np.concatenate(offsets).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([sum(map(len, offsets)) - 1], pa.int64()), pa.array([at], pa.int64()), pa.array([enc.dtype.itemsize], pa.int32())], names=schema.fieldNames())

    manifest, base = [], 0
    for r in sorted(rows.mapInArrow(write, schema).collect(), key=lambda r: r.part):
        if r.n_docs:
            manifest.append(r.asDict() | {"base": base})
            base += r.n_tokens
    store, path = _filesystem(out)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"version": 1, "end_id": END_ID, "parts": manifest}).encode())
    return manifest


def read_manifest(out: str) -> list[dict]:
    store, path = _filesystem(out)
    with store.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())["parts"]


def _reader(store, path: str, width: int):
    """A function of (first, last) for a range of a file's ids: memory-mapped where the file system is local, else read
    by offset, so that no more than the range is held."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        ids = np.memmap(path, f"<u{width}", "r")
        return lambda first, last: ids[first:last]
    f = store.open_input_file(path)

    def read(first: int, last: int) -> np.ndarray:
        f.seek(first * width)
        return np.frombuffer(f.read((last - first) * width), f"<u{width}")

    return read


def read_tokens(spark: SparkSession, out: str, key_type: T.DataType | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the files; ids stay in the mapped files.

    key_type: the type of the keys written. Repeated keys have a row each; a null key is null; files of an empty table
    give no rows.
    """
    schema = T.StructType([T.StructField("doc_id", key_type or T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    manifest = read_manifest(out)
    if not manifest:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame([(p["name"], p["base"], p["width"]) for p in manifest], "name string, base long, width int").repartition(len(manifest), "name")

    def read(batches):
        store, path = _filesystem(out)
        for b in batches:
            for p in b.to_pylist():
                ids = _reader(store, f"{path}/{p['name']}.bin", p["width"])
                with store.open_input_file(f"{path}/{p['name']}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<i8")
                at = 0
                with store.open_input_file(f"{path}/{p['name']}.docs") as f:
                    keys = pa.ipc.open_file(f)
                    for k in range(keys.num_record_batches):
                        got = keys.get_batch(k).column(0)
                        edges = offsets[at : at + len(got) + 1]
                        some = ids(int(edges[0]), int(edges[-1]))
                        crc = [zlib.crc32(some[s:e].astype("<u4").tobytes()) for s, e in zip(edges[:-1] - edges[0], edges[1:] - edges[0], strict=True)]
                        at += len(got)
                        yield pa.RecordBatch.from_arrays([got, pa.array(p["base"] + edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], names=schema.fieldNames())

    return parts.mapInArrow(read, schema)
