"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z in lower case, white space to one space, digits to
0) and hashed.  For each host (the source, where documents have no URL) the
distinct documents that hold a line are counted; lines in more documents than
the limit are removed, and documents of which little remains are rejected.

Copies must not count as evidence against each other: a document is counted by
its content, not by its id, and its signs must differ too: two of its
lower-cased three-word windows, those whose first words have the lowest and the highest hash.  Copies of a
page that are edited here and there mostly share their signs and keep their lines;
boilerplate of any number of lines stands in pages of different signs and goes,
unless it is itself the sign at both ends of most of its pages.

The counts are exact over all documents.  Every document sends each of its
distinct lines once; equal lines of one content, and then of one host, are
combined before the shuffles, and the common lines come back to the documents
by a join whose document side can be split.

Defined results: null, empty and blank texts have no words and fail the base
rules; a null source is a host of its own; a null doc_id is kept; repeated rows are
the same content and give repeated results; an empty table gives no rows.
Only the id, text and source columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, written
from ._text import ORDER_BYTES, ORDER_POWERS, SpanHasher, in_steps, lowered, span_hashes, utf8_arrays, window_hashes, word_spans

#: A line is common if more than this many contents of a host hold it ...
MAX_DOCUMENTS = 20
#: ... and signs of the one kind or the other are at least this share of as many.
MIN_SIGNS = 0.5
#: A document is depleted if less than this share of its words remains.
MIN_REMAINING = 0.2

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 11, 12, 13, 32]] = True
_NORMAL = lowered(np.arange(256, dtype=np.uint8))
_NORMAL = np.where((_NORMAL >= 49) & (_NORMAL <= 57), np.uint8(48), _NORMAL)
_EMPTY = np.zeros(0, dtype=np.uint64)


def repeated_words(words: np.ndarray, size: int = 5) -> int:
    """Words covered by windows of ``size`` words that occur twice or more."""
    windows = window_hashes(words, size)
    if len(windows) < 2:
        return 0
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    found = np.flatnonzero(counts[back] > 1)
    if not len(found):
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def word_chars(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
    """Code points in the words; what lies between them is of single bytes."""
    return int(((buf & 0xC0) != 0x80).sum()) - (len(buf) - int((ends - starts).sum()))


def used_lines(buf: np.ndarray, starts: np.ndarray, hashes: SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the lines with a word: their numbers, first words and word counts; and how many equal an earlier one."""
    feeds = np.flatnonzero(buf == 10)
    number = np.searchsorted(feeds, starts)
    first = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])
    used = number[first]
    bounds = np.concatenate([[-1], feeds, [len(buf)]])
    lines = hashes(bounds[used] + 1, bounds[used + 1])
    return used, first, np.diff(np.concatenate([first, [len(starts)]])), len(lines) - len(np.unique(lines))


def normal_lines(normal: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, in_line: np.ndarray) -> np.ndarray:
    """Hashes of the lines of a normalised text: of their words in order."""
    plain = span_hashes(normal, starts, ends)
    place = np.arange(len(starts)) - np.repeat(first, in_line)
    with np.errstate(over="ignore"):
        return np.add.reduceat(plain * (2 * place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), first)


def without_lines(text: str, gone: np.ndarray) -> str:
    """A text without the lines whose normalised hashes are among ``gone``."""
    buf = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = word_spans(buf)
    used, first, in_line, _ = used_lines(buf, starts, SpanHasher(buf))
    cut = set(used[np.isin(normal_lines(_NORMAL[buf], starts, ends, first, in_line), gone)].tolist())
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cut)


def signs_of(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 3) -> tuple[int, int]:
    """Hashes of two windows of ``size`` words of a lower-cased text: those that begin at the first word of the lowest and of the highest number in ``SpanHasher.order``.

    Texts of fewer words have one window, of all their words.
    """
    heads = max(1, len(starts) - size + 1)
    order = SpanHasher(low).order(starts[:heads], ends[:heads])
    at = (int(order.argmin()), int(order.argmax()))
    lowest, highest = (b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + size], ends[i : i + size], strict=True)) for i in at)
    return _hash(lowest), _hash(highest)


def _hash(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)


def measure(buf: np.ndarray | None) -> tuple[int, int, int, int, int, tuple[np.ndarray, np.ndarray], tuple[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; each distinct normalised line's hash and words; and the signs."""
    nothing = (_EMPTY, np.zeros(0, dtype=np.int64)), (0, 0)
    if buf is None or not len(buf):
        return 0, 0, 0, 0, 0, *nothing
    symbols = int(_SYMBOL[buf].sum())
    starts, ends = word_spans(buf)
    n = len(starts)
    if not n:
        return 0, 0, symbols, 0, 0, *nothing
    chars = word_chars(buf, starts, ends)
    hashes = SpanHasher(buf)
    used, first, in_line, duplicates = used_lines(buf, starts, hashes)
    normal = normal_lines(_NORMAL[buf], starts, ends, first, in_line)
    kinds = np.unique(normal)
    total = np.zeros(len(kinds), dtype=np.int64)
    np.add.at(total, np.searchsorted(kinds, normal), in_line)
    return n, chars, symbols, duplicates, repeated_words(hashes(starts, ends)), (kinds, total), signs_of(lowered(buf), starts, ends)


def _content(kinds: np.ndarray, words: np.ndarray, signs: tuple[int, int]) -> int:
    """A document's content for counting: its distinct normalised lines, and its signs."""
    with np.errstate(over="ignore"):
        lines = (kinds * (words.astype(np.uint64) * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64)
        low, high = np.array(signs, dtype=np.int64).view(np.uint64)
        return int(((lines * np.uint64(0x9E3779B97F4A7C15) + low) * np.uint64(0xBF58476D1CE4E5B9) + high).view(np.int64))


_FIGURES = "host string, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, signs array<long>, lines array<struct<line: long, words: long>>"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """One row for each document: its id, or with ``carry`` all its columns as ``doc``; the base figures, host, content, signs, and its distinct lines as (line, words).

    ``row`` numbers the rows; it is stored with them, so that it stays the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "host", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "signs", "lines"]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in in_steps(batch, 1000):
                rows = [measure(raw) for raw in utf8_arrays(part.column(1))]
                lines = [x[5] for x in rows]
                offsets = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum([len(x[0]) for x in lines], out=offsets[1:])
                line, words = (np.concatenate([x[i] for x in lines]) if lines else np.zeros(0, dtype=np.int64) for i in range(2))
                items = pa.StructArray.from_arrays([pa.array(line.view(np.int64)), pa.array(words)], names=["line", "words"])
                figures = [pa.array([x[i] for x in rows], pa.int64()) for i in range(5)]
                content = pa.array([_content(*x[5], x[6]) for x in rows], pa.int64())
                signs = pa.array([x[6] for x in rows], pa.list_(pa.int64()))
                numbers = pa.array(range(row, row + len(rows)), pa.int64())
                row += len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), numbers, *figures, content, signs, pa.ListArray.from_arrays(pa.array(offsets), items)], names=names)

    own = F.struct("*") if carry else F.col(id_col).cast("long")
    kind = docs.schema.simpleString() if carry else "long"
    return docs.select(own.alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host")).mapInArrow(run, f"doc {kind}, {_FIGURES}")


def common_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS, min_signs: float = MIN_SIGNS) -> DataFrame:
    """host, line of the lines above the limits, with n_documents and n_signs."""
    spread = rows.select("host", "content", "signs", F.explode("lines.line").alias("line"))
    # Copies of one content are one row here; what is left of a hot line is counted in parts.
    each = spread.distinct().select("host", "line", F.posexplode("signs").alias("which", "sign"))
    signs = each.groupBy("host", "line", "which", "sign").agg(F.count(F.lit(1)).alias("k"))
    kinds = signs.groupBy("host", "line", "which").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))
    counted = kinds.groupBy("host", "line").agg(F.max("k").alias("n_documents"), F.max("n").alias("n_signs"))
    return counted.where((F.col("n_documents") > max_documents) & (F.col("n_signs") >= min_signs * F.col("n_documents")))


def _judged(docs: DataFrame, max_documents: int, min_signs: float, min_remaining: float, id_col: str, text_col: str, host_col: str, carry: bool) -> DataFrame:
    """The rows of ``measures`` with base_failed, kept, n_removed and the hashes of their common lines."""
    ship(docs.sparkSession)
    rows = written(measures(docs, id_col, text_col, host_col, carry), "lines")
    common = written(common_lines(rows, max_documents, min_signs), "common")
    spread = rows.select("row", "host", F.explode("lines").alias("l")).select("row", F.col("host").alias("h"), F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    found = spread.join(common.select("host", F.col("line").alias("own")), F.col("h").eqNullSafe(F.col("host")) & (F.col("line") == F.col("own")))
    removed = found.groupBy("row").agg(F.sum("words").alias("n_removed"), F.collect_list("line").alias("common"))
    out = rows.drop("lines").join(removed, "row", "left")
    n, lost = F.col("n_words"), F.coalesce(F.col("n_removed"), F.lit(0)).cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)
    return out.withColumn("n_removed", lost).withColumn("base_failed", failed).withColumn("kept", ~failed & (n - lost >= min_remaining * n))


def judge(
    docs: DataFrame,
    max_documents: int = MAX_DOCUMENTS,
    min_signs: float = MIN_SIGNS,
    min_remaining: float = MIN_REMAINING,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, n_removed (words in removed lines) of every document."""
    out = _judged(docs, max_documents, min_signs, min_remaining, id_col, text_col, host_col, carry=False)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def clean(
    docs: DataFrame,
    max_documents: int = MAX_DOCUMENTS,
    min_signs: float = MIN_SIGNS,
    min_remaining: float = MIN_REMAINING,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    chars_col: str | None = "n_chars",
) -> DataFrame:
    """The documents that are kept, in their own columns, with their common lines removed from the text.

    ``chars_col`` is set to the new length of the texts that changed.
    """
    kept = _judged(docs, max_documents, min_signs, min_remaining, id_col, text_col, host_col, carry=True).where("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, common in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(without_lines(text, np.array(common, dtype=np.int64).view(np.uint64)) if common else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "cleaned"])

    both = kept.select("doc", F.col(f"doc.`{text_col}`").alias("text"), "common").mapInArrow(run, f"doc {docs.schema.simpleString()}, cleaned string")
    columns = []
    for c in docs.columns:
        own = F.col(f"doc.`{c}`")
        if c == text_col:
            own = F.col("cleaned")
        elif c == chars_col:
            own = F.when(F.col("cleaned") == F.col(f"doc.`{text_col}`"), own).otherwise(F.length("cleaned")).cast(docs.schema[c].dataType)
        columns.append(own.alias(c))
    return both.select(*columns)


#: DuckDB SQL of ``judge`` over ``documents``, with the limits above.
SQL = r"""
WITH lines AS (
  SELECT d.doc_id, d.source, t.pos, t.line, regexp_extract_all(t.line, '[^\x20\x09-\x0D]+') AS w
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) AS pos) t),
used AS (
  SELECT *, len(w) AS n, array_to_string(list_transform(w, lambda x: regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[1-9]', '0', 'g')), ' ') AS norm
  FROM lines WHERE len(w) > 0),
per_line AS (SELECT doc_id, source, norm, SUM(n) AS n FROM used GROUP BY ALL),
wordy AS (
  SELECT doc_id, string_split(translate(string_agg(array_to_string(w, ' '), ' ' ORDER BY pos), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS w
  FROM used GROUP BY doc_id),
heads AS (
  SELECT doc_id, w, list_transform(w[1:greatest(len(w) - 2, 1)], lambda x: list_sum(list_transform(range(0, least(strlen(x), ORDER_BYTES)),
    lambda i: (CAST('0x' || substr(hex(x), 2 * i + 1, 2) AS BIGINT) + 1)::HUGEINT * [ORDER_POWERS][i + 1]))::HUGEINT % 18446744073709551616::HUGEINT) AS h
  FROM wordy),
signs AS (SELECT doc_id, w[list_position(h, list_min(h)):list_position(h, list_min(h)) + 2] AS low, w[list_position(h, list_max(h)):list_position(h, list_max(h)) + 2] AS high FROM heads),
bodies AS (SELECT doc_id, list_sort(list(norm || ':' || n)) AS body FROM per_line GROUP BY doc_id),
bodied AS (SELECT DISTINCT p.source, p.norm, b.body, s.low, s.high FROM per_line p JOIN bodies b USING (doc_id) JOIN signs s USING (doc_id)),
common AS (
  SELECT source, norm FROM bodied GROUP BY source, norm
  HAVING COUNT(*) > 20 AND greatest(COUNT(DISTINCT low), COUNT(DISTINCT high)) >= 0.5 * COUNT(*)),
removed AS (SELECT p.doc_id, SUM(p.n) AS n FROM per_line p JOIN common c ON p.source IS NOT DISTINCT FROM c.source AND p.norm = c.norm GROUP BY p.doc_id),
toks AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM toks WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1),
covered AS (SELECT doc_id, COUNT(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
dups AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n FROM used GROUP BY doc_id),
base AS (
  SELECT t.doc_id, len(t.w) AS n_words, length(array_to_string(t.w, '')) AS word_chars,
         length(regexp_replace(coalesce(t.text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(r.n, 0) AS n_removed
  FROM toks t LEFT JOIN dups d USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed >= 0.2 * n_words AS kept, n_removed::BIGINT AS n_removed
FROM base
""".replace("ORDER_BYTES", str(ORDER_BYTES)).replace("ORDER_POWERS", ", ".join(f"{x}::HUGEINT" for x in ORDER_POWERS))
