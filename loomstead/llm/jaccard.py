"""N-gram Jaccard join by filters under three global token orders.

A document's set holds its distinct shingles of five lower-cased words.  Two
documents link when the Jaccard similarity of their sets is at least the
threshold, three quarters unless stated.  The join is exact.

1. Sets are hashed; rows with equal sets form a class, one unit of the join.
   A third of all rows may be copies: they are combined before the shuffle.
2. Three global orders.  Each puts its own share of all shingles, chosen by
   hash (``SEGMENTS``), in front, rare ones first; the rest follow by hash.  Two
   linked units share a shingle among the first n - ceil(t n) + 1 of each under
   every order.  The orders are applied one after the other, each to the units
   that the ones before have left: a unit without a shared shingle in its prefix,
   or with too many shingles that no other unit holds, is out.  Counts are
   combined before the shuffle and joined with a large side that can be split.
3. Candidates share a shingle in the prefixes of the first order and a bit in the
   bitmaps of their prefixes under the second and the third, and sizes and places
   allow the overlap.  What one unit holds alone, and the parities of the shared
   shingles in hash cells (a sketch), bound the difference of two sets from below.
   All of it is decided inside the join, before a set is fetched.
4. In each shingle's group the unit with the fewest own shingles, the least
   edited, is the centre: the others are compared with it (a star), and verified
   links are closed to components.  Then only units outside the centre's
   component are compared with the group, under the same conditions, which
   leave hardly a pair that is no link.  So a group of near copies is never
   expanded into its pairs.
5. Components of the verified links; a component's id is the smallest doc_id of
   its rows.

Units are numbered by stored row numbers; doc_id is data and may be any number.

Defined results: null, empty and blank texts have an empty set and link with
nothing, component_id is their own id; texts with fewer than five words have one
shingle, of all their words; a null doc_id takes part, and component_id is null
if no row of the component has an id; rows that share an id are compared each
by its own text; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import forget, ship, tidy, written
from ._text import in_steps, shingle_set, utf8_arrays
from .components import components, extended

#: The orders' fronts: shingles whose hash, divided by ten, leaves a rest in [from, to).  The first must exceed 1 - threshold by a little.
SEGMENTS = ((0, 3), (3, 6), (6, 10))
#: Words of 64 bits in a set's sketch (the parities of its shared shingles by hash cell) and in the bitmap of a prefix.
SKETCH = 8
BITMAP = 2
#: In the verification a centre's set is sent once for about so many pairs.
PAIRS = 256


def prefix_length(n: int, percent: int) -> int:
    """Of ``n`` ordered shingles, so many from the front share one with every set linked to it."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _prefix(percent: int) -> Column:
    return F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)).view(np.int64)))


def _in_segment(tokens: np.ndarray, k: int) -> np.ndarray:
    rest = tokens % np.uint64(10)
    return (rest >= SEGMENTS[k][0]) & (rest < SEGMENTS[k][1])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def shingle_rows(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (of the text), row (a number), n, key (of the set) of every row, and front: the shingles of which the prefix in the first order consists, ``ahead`` of them from the front of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in in_steps(batch, 1000):
                counts, keys, fronts, aheads = [], [], [], []
                for raw in utf8_arrays(part.column(1)):
                    tokens = shingle_set(raw, size)
                    ahead = _in_segment(tokens, 0)
                    front = tokens[ahead]
                    aheads.append(len(front))
                    lack = prefix_length(len(tokens), percent) - len(front)
                    fronts.append(np.concatenate([front, tokens[~ahead][:lack]]) if lack > 0 else front)
                    counts.append(len(tokens))
                    keys.append(_key(tokens))
                numbers = pa.array(np.arange(row, row + len(keys), dtype=np.int64))
                row += len(keys)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), numbers, pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(aheads, pa.int64()), _lists(fronts)],
                    names=["doc_id", "mark", "row", "n", "key", "ahead", "front"],
                )

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, mark long, row long, n long, key binary, ahead long, front array<long>")


# -- orders ----------------------------------------------------------------


def _rest() -> Column:
    """Rest of the unsigned ``token`` divided by ten; 2**64 leaves 6."""
    return F.pmod(F.pmod(F.col("token"), F.lit(10)) + F.when(F.col("token") < 0, 6).otherwise(0), F.lit(10))


def _bits(cell: Column, words: int, name: str, how: str, when: Column | None = None) -> list[Column]:
    """Aggregates of the bits ``cell`` in ``words`` words: parities (bit_xor) or unions (bit_or)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))
    here = lambda i: (F.floor(cell / 64) == i) if when is None else (F.floor(cell / 64) == i) & when
    return [F.call_function(how, F.when(here(i), bit).otherwise(F.lit(0).cast("long"))).alias(f"{name}{i}") for i in range(words)]


def _sketch_words() -> list[Column]:
    return _bits(F.pmod(F.shiftrightunsigned("token", 40), F.lit(64 * SKETCH)), SKETCH, "s", "bit_xor")


def _first_order(classes: DataFrame, percent: int) -> DataFrame:
    """token, unit, n, own, at, back: each unit's shared shingles with their places in the first order; ``own`` of its front shingles no other unit holds."""
    spread = classes.select("unit", "n", "ahead", F.explode("front").alias("token"))
    counts = written(spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    shared = spread.join(counts, "token").withColumn("back", (_rest() >= SEGMENTS[0][1]).cast("int"))
    order = F.when(F.col("back") == 0, F.col("df")).otherwise(F.col("token").bitwiseXOR(F.lit(-(1 << 63))))
    by_unit = Window.partitionBy("unit")
    ranked = shared.withColumn("held", F.sum(1 - F.col("back")).over(by_unit)).withColumn("nth", F.row_number().over(by_unit.orderBy("back", order, "token")))
    # Unshared shingles precede the shared ones at the front; behind it the place is a lower bound, which keeps the overlap's bound valid.
    own = F.col("ahead") - F.col("held")
    return ranked.select("token", "unit", "n", own.alias("own"), (own + F.col("nth")).alias("at"), "back")


def _grouped(prefixes: DataFrame, percent: int, room: Column) -> DataFrame:
    """The rows of ``prefixes`` whose group holds another unit and whose ``room`` allows a link with the smallest set that can be."""
    groups = written(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).where("k > 1").drop("k"), "groups")
    least = F.greatest(F.col("low"), F.ceil(F.lit(percent) * F.col("n") / 100))
    return prefixes.join(groups, "token").where((100 + percent) * room >= percent * (F.col("n") + least)).drop("low")


def _sets(docs: DataFrame, needed: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """unit, n, k1, k2 (shingles at the front of the second and third order), tokens of the ``needed`` units (unit, doc_id, mark, key, members); and the stored table behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in in_steps(batch, 500):
                at, sets = [], []
                for i, (raw, key, unit) in enumerate(zip(utf8_arrays(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    tokens = shingle_set(raw, size)
                    if unit not in seen and _key(tokens) == key:
                        seen.add(unit)
                        at.append(i)
                        sets.append(tokens)
                own = part.select(["unit", "members"]).take(pa.array(at, pa.int64()))
                counts = [pa.array([int(f(x)) for x in sets], pa.int64()) for f in (len, lambda x: _in_segment(x, 1).sum(), lambda x: _in_segment(x, 2).sum())]
                yield pa.RecordBatch.from_arrays([*own.columns, *counts, _lists(sets)], names=["unit", "members", "n", "k1", "k2", "tokens"])

    d = _source(docs, id_col, text_col).withColumnRenamed("mark", "own_mark").withColumnRenamed("doc_id", "own_id")
    found = d.join(needed, (F.col("own_mark") == F.col("mark")) & F.col("own_id").eqNullSafe(F.col("doc_id"))).select("text", "key", "unit", "members")
    sets = written(found.mapInArrow(run, "unit long, members long, n long, k1 long, k2 long, tokens array<long>"), "sets")
    # Only rows that are repeated as they are can be found twice.
    return sets.where("members = 1").unionByName(sets.where("members > 1").dropDuplicates(["unit"])).drop("members"), sets


def _order(sets: DataFrame, which: int, percent: int) -> DataFrame:
    """unit, own (front shingles that no other unit holds), the bitmap of its shared prefix (b0 ...) and the sketch of its shared front (s0 ...) under the second or third order."""
    k, (low, high) = F.col(f"k{which}"), SEGMENTS[which]
    spread = sets.select("unit", "n", k.alias("k"), F.explode("tokens").alias("token")).where((_rest() >= low) & (_rest() < high))
    counts = written(spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    by_unit = Window.partitionBy("unit")
    ranked = spread.join(counts, "token").withColumn("held", F.count(F.lit(1)).over(by_unit)).withColumn("nth", F.row_number().over(by_unit.orderBy("df", "token")))
    inside = F.col("k") - F.col("held") + F.col("nth") <= _prefix(percent)
    bitmap = _bits(F.pmod(F.shiftrightunsigned("token", 20), F.lit(64 * BITMAP)), BITMAP, "b", "bit_or", inside)
    found = ranked.groupBy("unit").agg(F.first("held").alias("held"), *bitmap, *_sketch_words())
    out = sets.select("unit", "n", k.alias("k")).join(found, "unit", "left")
    zero = F.lit(0).cast("long")
    # A front that is shorter than the prefix says nothing: all bits are set.
    words = [F.when(F.col("k") < _prefix(percent), F.lit(-1).cast("long")).otherwise(F.coalesce(f"b{i}", zero)).alias(f"b{i}") for i in range(BITMAP)]
    return out.select("unit", "n", (F.col("k") - F.coalesce("held", zero)).alias("own"), *words, *[F.coalesce(f"s{i}", zero).alias(f"s{i}") for i in range(SKETCH)])


def _some(name: str) -> Column:
    return reduce(Column.__or__, [F.col(f"{name}{i}") != 0 for i in range(BITMAP)])


def _survivors(ranked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """unit, n, own, own1 (of them outside the first order's front), bitmaps c and d, sketch s of the units that all three orders leave."""
    can = F.lit(100) * (F.col("n") - F.col("own")) >= F.lit(percent) * F.col("n")
    first = ranked.groupBy("unit").agg(F.first("own").alias("own0"))
    b = [f"b{i}" for i in range(BITMAP)]
    s = [f"s{i}" for i in range(SKETCH)]
    second = _order(sets, 1, percent).withColumnRenamed("own", "own1").join(first, "unit").withColumn("own", F.col("own0") + F.col("own1"))
    second = written(second.where(can & _some("b")), "second")
    third = _order(sets.join(second.select("unit"), "unit", "left_semi"), 2, percent)
    third = third.select("unit", F.col("own").alias("own2"), *[F.col(x).alias(x.replace("b", "d")) for x in b], *[F.col(x).alias(x.replace("s", "t")) for x in s])
    both = second.select("unit", "n", "own0", "own1", *[F.col(x).alias(x.replace("b", "c")) for x in b], *s).join(third, "unit")
    both = both.withColumn("own", F.col("own0") + F.col("own1") + F.col("own2")).where(can & _some("d"))
    front = ranked.where("back = 0").groupBy("unit").agg(*[c.alias(f"f{i}") for i, c in enumerate(_sketch_words())])
    whole = both.join(front, "unit", "left")
    words = [F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}")).bitwiseXOR(F.coalesce(f"f{i}", F.lit(0).cast("long"))).alias(f"s{i}") for i in range(SKETCH)]
    out = written(whole.select("unit", "n", "own", (F.col("own1") + F.col("own2")).alias("own1"), *[f"{x}{i}" for x in "cd" for i in range(BITMAP)], *words), "survivors")
    forget(second)
    return out


# -- candidates ------------------------------------------------------------


def _fits(percent: int) -> Column:
    """Whether sizes, places, bitmaps and sketches of x and y, who share ``token``, allow a link."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    size = F.lit(100) * F.least("x.n", "y.n") >= F.lit(percent) * F.greatest("x.n", "y.n")
    room = F.lit(100 + percent) * F.least("x.room", "y.room") >= F.lit(percent) * (x("n") + y("n"))
    common = [reduce(Column.__or__, [x(f"{b}{i}").bitwiseAND(y(f"{b}{i}")) != 0 for i in range(BITMAP)]) for b in "cd"]
    differ = reduce(Column.__add__, [F.bit_count(x(f"s{i}").bitwiseXOR(y(f"s{i}"))) for i in range(SKETCH)])
    near = F.lit(100 + percent) * (x("own") + y("own") + differ) <= F.lit(100 - percent) * (x("n") + y("n"))
    return size & room & common[0] & common[1] & near


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link.  A unit may be the ``a`` of very many: its pairs are dealt into parts."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, l_at), (right, r_at) = ((np.asarray(c.flatten()), np.asarray(c.offsets) - c.offsets[0].as_py()) for c in (batch.column(2), batch.column(3)))
            kept = [i for i in range(batch.num_rows) if _links(left[l_at[i] : l_at[i + 1]], right[r_at[i] : r_at[i + 1]], percent)]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    parts = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("parts")), "parts")
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    left = sets.select(F.col("unit").alias("a"), F.col("tokens").alias("left")).join(parts, "a").select("a", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = sets.select(F.col("unit").alias("b"), F.col("tokens").alias("right"))
    both = dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "left", "right")
    found = written(both.mapInArrow(test, "a long, b long"), "verified")
    forget(parts)
    return found


def _across(placed: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of units of different components that share a shingle and fit; a group's main component, that of its centre, is not compared with itself."""
    named = placed.join(labels.select(F.col("node").alias("unit"), "label"), "unit", "left").withColumn("label", F.coalesce("label", "unit"))
    named = written(named, "named")
    groups = named.groupBy("token").agg(F.min_by("label", F.struct("own", "unit")).alias("main"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("token", "main")
    grouped = written(named.join(groups, "token"), "grouped")
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.unit") < F.col("y.unit"))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & once
    pairs = grouped.where("label <> main").alias("x").join(grouped.alias("y"), apart & _fits(percent))
    x_first = (F.col("x.own") < F.col("y.own")) | ((F.col("x.own") == F.col("y.own")) & (F.col("x.unit") < F.col("y.unit")))
    pairs = written(pairs.select(F.when(x_first, F.col("x.unit")).otherwise(F.col("y.unit")).alias("a"), F.when(x_first, F.col("y.unit")).otherwise(F.col("x.unit")).alias("b")).distinct(), "candidates")
    forget(named)
    forget(grouped)
    return pairs


def linked(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, mark, n, key), the component of each class (key, root), and the verified links (a, b) of units, which span the components."""
    if 10 * (100 - percent) >= 100 * SEGMENTS[0][1]:
        raise ValueError("the front of the first order is too short for this threshold")
    spark = docs.sparkSession
    ship(spark)
    rows = written(shingle_rows(docs, percent, size, id_col, text_col), "shingles")
    own = F.struct(F.col("row").alias("unit"), "doc_id", "mark")
    classes = rows.where("n > 0").groupBy("key").agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"), F.first("ahead").alias("ahead"), F.min_by("front", "row").alias("front"))
    classes = written(classes.select("key", "own.*", "members", "n", "ahead", "front"), "classes")
    narrow = written(rows.select("doc_id", "mark", "n", "key"), "rows")
    forget(rows)
    rows = narrow
    ranked = written(_first_order(classes, percent), "ranked")
    units = written(classes.drop("front", "ahead", "n"), "units")
    forget(classes)
    tidy(spark)

    prefixes = written(_grouped(ranked.where(F.col("at") <= _prefix(percent)).select("token", "unit", "n", "at"), percent, F.col("n") - F.col("at") + 1), "prefixes")
    needed = units.join(prefixes.select("unit").distinct(), "unit", "left_semi")
    sets, stored = _sets(docs, needed, size, id_col, text_col)
    info = _survivors(ranked, sets, percent)
    forget(ranked)
    tidy(spark)
    placed = prefixes.drop("n").join(info, "unit").withColumn("room", F.col("n") - F.col("at") + 1 - F.col("own1")).drop("at", "own1")
    placed = written(_grouped(placed, percent, F.col("room")), "placed")
    forget(prefixes)

    columns = [c for c in placed.columns if c not in ("token", "own", "unit")]
    centre = placed.groupBy("token").agg(F.min(F.struct("own", "unit", *columns)).alias("y")).select("token", "y.*")
    star = centre.alias("y").join(placed.alias("x"), (F.col("x.token") == F.col("y.token")) & (F.col("x.unit") != F.col("y.unit")) & _fits(percent))
    tried = written(star.select(F.col("y.unit").alias("a"), F.col("x.unit").alias("b")).distinct(), "candidates")
    links = verify(tried, sets, percent)
    labels = written(components(links), "labels")

    more = _across(placed, labels, percent).join(tried, ["a", "b"], "left_anti")
    more = written(more, "candidates")
    if more.limit(1).count():
        found = verify(more, sets, percent)
        labels = written(extended(labels, found), "labels")
        links = links.unionByName(found)
    for x in (placed, tried, more, info, stored):
        forget(x)
    tidy(spark)
    roots = units.join(labels.withColumnRenamed("node", "unit"), "unit", "left").select("key", "unit", F.coalesce("label", "unit").alias("root"))
    return rows, written(roots, "roots"), links


def join(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and n_verified: links verified for its class, which span the component but are not all of its links."""
    rows, roots, links = linked(docs, percent, size, id_col, text_col)
    # Copies are combined by class first, so that neither a class nor a component is gathered in one task.
    low = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low")).join(roots, "key")
    ids = low.groupBy("root").agg(F.min("low").alias("component_id"))
    degree = links.select(F.col("a").alias("unit")).union(links.select("b")).groupBy("unit").agg(F.count(F.lit(1)).alias("n_verified"))
    named = written(roots.join(ids, "root").join(degree, "unit", "left").select("key", "component_id", F.coalesce("n_verified", F.lit(0)).alias("n_verified")), "named")
    out = rows.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"))


def keep_first(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, in its own columns: the row with the smallest id, a row without an id only where no other is.

    Of rows that agree in id and text one stays; rows without a word are in no
    group and all stay.
    """
    rows, roots, _ = linked(docs, percent, size, id_col, text_col)
    live = rows.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    by_class = live.groupBy("key").agg(least.alias("first")).join(roots, "key")
    first = written(by_class.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark"), "first")
    repeated = live.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    twice = (F.col("f.mark") == F.col("r.mark")) & F.col("f.doc_id").eqNullSafe(F.col("r.doc_id"))
    repeated = written(first.alias("f").join(repeated.alias("r"), twice, "left_semi"), "repeated")

    text = F.col(text_col).cast("string")
    own = (F.xxhash64(text) == F.col("__first_mark")) & F.col(id_col).cast("long").eqNullSafe(F.col("__first_id"))
    names = lambda df: df.toDF("__first_id", "__first_mark")
    wordless = F.coalesce(text, F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    kept = docs.where(~wordless).join(names(first), own, "left_semi")
    # Only rows that occur more than once need a comparison.
    once = kept.join(names(repeated), own, "left_anti")
    twice = kept.join(names(repeated), own, "inner").groupBy("__first_id", "__first_mark").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return once.unionByName(twice).unionByName(docs.where(wordless))


#: DuckDB SQL of ``join`` over ``documents``: all pairs that share a shingle are counted, links closed by recursion.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
    FROM words)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
low AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN low ON low.a = d.doc_id
"""
