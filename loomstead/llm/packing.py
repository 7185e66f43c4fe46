"""Packing documents into fixed windows of tokens: concatenate and cut.

Two passes over the partitions.  The first encodes each text once and stores
its ids with the count of tokens that precede it in its partition.  The token
totals of the partitions, one number for each task of the first pass, give
every partition's global offset by a prefix sum.  The second pass adds the
offsets and cuts at the multiples of the window; a document that crosses a
boundary has a piece, a boundary record, in each window it touches.  No row is
shuffled, and only the last window can be padded.

A table that is read from files does not come in their order: Spark deals the
largest files first.  With ``by_file`` the parts are the runs of adjoining rows
of a file instead of the partitions, and stand in the order of file name and
row index, so that what was written range-sorted is packed in that order.

Defined results: a null or empty text has the end token alone; special tokens in
a text have their own ids, as the library's defaults give them; texts with very
long runs of one kind of character are encoded by the library; a null doc_id is kept; repeated rows are packed as often as they occur; rows keep the order
of the input; an empty table has no pieces.  Only ``id_col`` and ``text_col``
are read, so that other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: Texts with a run of so many bytes of one kind (white space, digits, letters and all beyond ASCII, symbols) go to the library.
LONG_RUN = 4096
#: Offsets of at most so many parts (16 MB) are broadcast; beyond that they are joined by a shuffle.
BROADCAST_PARTS = 1_000_000


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 1
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def has_long_run(text: str) -> bool:
    """Whether ``LONG_RUN`` bytes of one kind follow each other."""
    if 4 * len(text) < LONG_RUN:
        return False
    kinds = _KIND[np.frombuffer(text.encode(), dtype=np.uint8)]
    ends = np.concatenate([[-1], np.flatnonzero(kinds[1:] != kinds[:-1]), [len(kinds) - 1]])
    return bool((np.diff(ends) >= LONG_RUN).any())


class Encoder:
    """Ids of a tokenizer file of the ``tokenizers`` library, as little-endian bytes.

    For byte-level BPE files whose ids follow the order of their merges, the
    same merges run in ``tiktoken``, which is about seven times as fast; all
    other files, texts that hold an added token of the file, and texts with very
    long runs, which ``tiktoken`` cannot take, are encoded by the ``tokenizers``
    library itself.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.end = np.array([end_id], dtype=self.width).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", []) if x["content"]]
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        import public_tokenizers
        import tiktoken

        model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True):
            return None
        vocab, special = model["vocab"], {x["content"] for x in spec.get("added_tokens", [])}
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        ids = [vocab["".join(x)] for x in merges]
        if ids != sorted(ids) or (ids and ids[0] < 256):
            return None
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.added) or has_long_run(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()
        return array("H" if self.width == "<u2" else "I", self.fast.encode_ordinary(text)).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without the end id."""
        return [self._whole(x) for x in texts]


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", by_file: bool = False) -> DataFrame:
    """First pass: doc_id, part, before (tokens before it in the part), n, ids; with ``by_file`` also file and row (its index in the file).

    ``tokenizer`` is the path of a tokenizer file, at the same place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        width = np.dtype(encode.width).itemsize
        part, last = (part << 32 if by_file else part), None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = [x + encode.end for x in encode([text or "" for text in piece.column(1).to_pylist()])]
                counts = [len(x) // width for x in ids]
                places = zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True) if by_file else [None] * len(ids)
                parts, starts = [], []
                for place, n in zip(places, counts, strict=True):
                    if place is not None:
                        if last is not None and place != (last[0], last[1] + 1):
                            part, before = part + 1, 0
                        last = place
                    parts.append(part)
                    starts.append(before)
                    before += n
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(parts, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), *piece.columns[2:]], names=["doc_id", "part", "before", "n", "ids", *piece.schema.names[2:]])

    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if by_file else []
    kinds = "doc_id long, part long, before long, n long, ids binary" + (", file string, row long" if by_file else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *place).mapInArrow(run, kinds)


def _in_name_order(file: str) -> list[str | int]:
    """Sort key of a file: numbers in its name count as numbers (part-99999 before part-100000)."""
    return [int(x) if i % 2 else x for i, x in enumerate(re.split(r"(\d+)", file))]


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, by_file: bool = False) -> DataFrame:
    """Pieces of all documents: ``PIECES``.

    Sequence s holds the global tokens [s * window, (s + 1) * window).  ``ids``
    has a piece's ids as little-endian unsigned 32-bit integers, null unless
    ``keep_ids``.  ``by_file`` is for whole tables as they are read from Parquet
    files, and keeps the order of files and rows.
    """
    spark = docs.sparkSession
    ship(spark)
    tokens = written(tokenize(docs, tokenizer, end_id, id_col, text_col, by_file), "tokens")
    first = [F.first("file").alias("file"), F.min("row").alias("row")] if by_file else []
    found = tokens.groupBy("part").agg(F.sum("n").alias("total"), *first).collect()  # one row for each task, or run of rows of a file
    if by_file:
        found.sort(key=lambda r: (_in_name_order(r["file"]), r["row"]))
    else:
        found.sort(key=lambda r: r["part"])
    totals = [(r["part"], r["total"]) for r in found]
    ends = list(accumulate(n for _, n in totals))
    offsets = spark.createDataFrame([(p, end - n) for (p, n), end in zip(totals, ends, strict=True)], "part long, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _encoder(tokenizer, end_id).width
        for batch in batches:
            doc, first, count = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for d, g, n, raw in zip(doc, first, count, batch.column(3), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype=width).astype("<u4")
                a = 0
                while a < n:
                    sequence, offset = divmod(g + a, window)
                    b = min(n, a + window - offset)
                    own = ids[a:b].tobytes()
                    rows.append((d, a, b - a, zlib.crc32(own), n, sequence, offset, own if keep_ids else None))
                    a = b
            if rows:
                types = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    if len(totals) <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part").select("doc_id", (F.col("before") + F.col("base")).alias("first"), "n", "ids")
    return placed.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (little-endian 32-bit), n_tokens, n_padded: the windows themselves.

    A window is padded to ``window`` unless its length is a power of two.
    """
    joined = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    n = F.sum("length")
    size = F.when(F.bit_count(n) == 1, n).otherwise(F.lit(window).cast("long"))
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex().upper()), (size - n).cast("int"))
    return pieces.groupBy("sequence_id").agg(F.unhex(F.concat(F.array_join(joined, ""), pad)).alias("ids"), n.alias("n_tokens"), (size - n).alias("n_padded"))
