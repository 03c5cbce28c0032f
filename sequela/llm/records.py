"""Token ids in length-delimited binary records with masked checksums and an offset index.

A shard is two files. ``*.rec`` holds one frame per document::

    uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload

and a payload is ``int64 doc_id | uint8 has_id | uint8 bytes per id | uint32 n | n ids``, all
little-endian; ids take two bytes where the vocabulary allows it. ``*.idx`` holds a uint64 offset
and a uint64 frame length per record, so that a reader can fetch records in any order.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequela.llm.text import running_totals
from sequela.sources.stages import new_folder, stage

#: Fixed values of the frame: the checksum is turned right by 15 bits, then this is added.
MASK_DELTA = 0xA282EAD8
END_ID = 0

CACHED_PIECES = 600_000  # in each of two generations; about 100 MB each
JOINED_PIECES = 500  # encoded as one string
TEXTS_AT_ONCE = 4_000  # of which new pieces are gathered
# length and its checksum; a payload before its ids
_HEAD, _DOC = "<QI", "<qBBI"
# white space before a space, or any but space and line feed: such texts are encoded whole
_ODD = "[ \\n] |[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

MANIFEST = "shard long, file string, records long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


class Encoder:
    """Encodes texts to little-endian bytes of ids.

    The vocabulary's splitter never joins a character to white space after it, so a text whose
    white space is single spaces and line feeds can be cut before each space, and its pieces be
    encoded alone, each distinct piece once. New pieces are encoded many at a time, as one string
    that is cut by the lengths of its tokens. Other texts go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the strings of special tokens are ordinary text
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if len(vocab) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        # a byte-level token has a character for each of its bytes
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.begins: dict[str, bytes] = {}  # pieces at the begin of a text
        self.pieces: dict[str, bytes] = {}  # pieces after a space, without it
        self.older: dict[str, bytes] = {}  # pieces of the generation before

    def _whole(self, texts: list[str]) -> list[bytes]:
        batch = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, self.kind).tobytes() for e in batch]

    def _joined(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of pieces after a space, all encoded as one text."""
        text = " " + " ".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        ends = np.cumsum([1 + len(x.encode()) for x in pieces])
        reached = np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(reached, ends)
        if len(reached) == 0 or cuts[-1] >= len(reached) or not np.array_equal(reached[cuts], ends):
            yield from zip(pieces, self._whole([" " + x for x in pieces]))
            return
        data, start = ids.tobytes(), 0
        for piece, stop in zip(pieces, ((cuts + 1) * self.width).tolist()):
            yield piece, data[start:stop]
            start = stop

    def _learn(self, begins: list[str], pieces: list[str]) -> None:
        if len(self.begins) > CACHED_PIECES:
            self.begins.clear()
        if len(self.pieces) > CACHED_PIECES:  # pieces that are still in use come over from the older ones
            self.older, self.pieces = self.pieces, {}
        new = [x for x in dict.fromkeys(begins) if x not in self.begins]
        self.begins.update(zip(new, self._whole(new)))
        new = [x for x in pieces if x not in self.pieces]
        if self.older:
            self.pieces.update({x: self.older[x] for x in new if x in self.older})
            new = [x for x in new if x not in self.pieces]
        # a piece that is empty or ends in white space would meet the next one's space
        alone = [x for x in new if not x or x[-1].isspace()]
        self.pieces.update(zip(alone, self._whole([" " + x for x in alone])))
        rest = [x for x in new if x and not x[-1].isspace()]
        for i in range(0, len(rest), JOINED_PIECES):
            self.pieces.update(self._joined(rest[i : i + JOINED_PIECES]))

    def encode(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Ids of each text, in order; a null text is empty."""
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            some = pc.fill_null(texts[i : i + TEXTS_AT_ONCE], "")
            odd = pc.match_substring_regex(some, _ODD)
            whole = iter(self._whole(some.filter(odd).to_pylist()))
            cut = iter(self._by_pieces(some.filter(pc.invert(odd))))
            for is_odd in odd.to_pylist():
                yield next(whole if is_odd else cut)

    def _by_pieces(self, texts: pa.StringArray) -> list[bytes]:
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values = lists.flatten()
        begins = values.take(pa.array(first[:-1])).to_pylist()
        coded = values.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        self._learn(begins, pieces)
        # distinct pieces, then each text's begin, one after the other
        data = [*map(self.pieces.__getitem__, pieces), *map(self.begins.__getitem__, begins)]
        code = coded.indices.to_numpy(zero_copy_only=False).copy()
        code[first[:-1]] = len(pieces) + np.arange(len(begins))
        taken = pa.array(data, pa.binary()).take(pa.array(code))
        _, offsets, ids = taken.buffers()
        cuts = np.frombuffer(offsets, np.int32, len(code) + 1)[first].tolist()
        ids = memoryview(ids) if ids else memoryview(b"")
        return [bytes(ids[a:b]) for a, b in zip(cuts, cuts[1:])]


def encoder(path: str) -> Encoder:
    """The encoder that a Python worker keeps from task to task.

    Functions reach the workers by value, so the module's own globals end with a task.
    """
    kept = sys.modules.setdefault("_sequela_encoders", ModuleType("_sequela_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack(_DOC, doc_id or 0, doc_id is not None, width, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload))))
    )


def unframe(data: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of one frame; raises ValueError where a checksum differs."""
    length, crc = struct.unpack_from(_HEAD, data)
    payload = data[12 : 12 + length]
    if masked(zlib.crc32(data[:8])) != crc or len(data) != length + 16:
        raise ValueError("a record's length is damaged")
    if masked(zlib.crc32(payload)) != struct.unpack_from("<I", data, 12 + length)[0]:
        raise ValueError("a record's payload is damaged")
    doc_id, has_id, width, n = struct.unpack_from(_DOC, payload)
    ids = np.frombuffer(payload, f"<u{width}", n, struct.calcsize(_DOC))
    return (doc_id if has_id else None), ids


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI; a plain path is of the default file system's kind."""
    if uri.startswith("/"):
        return pa.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), re.sub("^file:(//)?", "", uri)
    return pa.fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; returns the staged manifest.

    Null ids come first, null texts are empty, and rows of one id follow by a hash of their text.
    Shards are ranges of this order, by shard number. A task that runs twice writes files of two
    names; the manifest lists the one that was committed.
    """
    tie = (F.xxhash64("text"), F.monotonically_increasing_id())
    ordered = (
        docs.select("doc_id", "text", tie[0].alias("h"), tie[1].alias("m"))
        .repartitionByRange("doc_id", "h", "m")
        .sortWithinPartitions("doc_id", "h", "m")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        enc, n, total = encoder(tokenizer), 0, 0
        fs, where = opened(folder)
        fs.create_dir(where, recursive=True)
        name = f"part-{shard:06d}-{attempt}"
        end = np.array([END_ID], enc.kind).tobytes()
        with fs.open_output_stream(f"{where}/{name}.rec") as out, fs.open_output_stream(f"{where}/{name}.idx") as index:
            offset = 0
            for batch in batches:
                encoded = enc.encode(batch.column(1))
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                    data = ids + end
                    record = frame(doc_id, data, enc.width)
                    out.write(record)
                    index.write(struct.pack("<QQ", offset, len(record)))
                    offset += len(record)
                    total += len(data) // enc.width
                    n += 1
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "records": [n], "ids": [total]})

    return stage(ordered.mapInArrow(write, MANIFEST).filter("records > 0"), "manifest")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the manifest's shards, read by their indexes; ``start``: ids before, of all shards.

    The reader gets a shard's start with its file name, so no join of the records follows.
    """
    placed = manifest.select("shard", "file").join(running_totals(manifest, [], "shard", "ids"), "shard")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, where = opened(folder)
        for shards in frames:
            for name, start in zip(shards["file"], shards["before"]):
                with fs.open_input_stream(f"{where}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                rows = []
                with fs.open_input_file(f"{where}/{name}.rec") as f:
                    for offset, length in index.tolist():
                        doc_id, ids = unframe(f.read_at(length, offset))
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    shards = max(1, manifest.count())
    return placed.repartition(shards, "shard").mapInPandas(read, READ)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return frame.astype({"doc_id": "Int64"})


def token_records(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the records, read them back, and return doc_id, start, n_tokens, ids_crc32 of each."""
    spark: SparkSession = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    manifest = write_records(docs, folder, tokenizer)
    return read_records(manifest, folder)
