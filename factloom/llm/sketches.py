"""Bottom-k sketches of shingle hashes, with DataFrame operations only.

A document's sketch is the K smallest distinct hashes of its shingles of WIDTH
words (of the whole sequence if it has fewer). Sketches of parts merge to the
sketch of their union, and estimate resemblance, containment and the number of
distinct shingles. Hashing a word once and a shingle as the hash of its words'
hashes keeps each document's work in its row.

Defined results: a null text is the empty text; a text without words has the
empty sketch, which is equal to itself (likeness 1) and unlike any other (0);
equal texts have equal sketches; extra columns are not read.

edited() orders the documents by descending doc_id (null last; rows with equal
doc_id by the text's hash) without gathering them. About every CELL_ROWS-th of
the order's keys, drawn by a hash, bounds a cell; a row finds its cell by a
binary search in the bounds, so outliers, wide ranges and repeated ids fill no
cell more than others. Each cell's first row is also sent to the cell before it
as a guest, and the next document is found within the cell. Texts are shuffled
once. There are about MAX_CELLS bounds of 24 bytes at most, whatever the input;
rows that are equal in doc_id and text are one key and meet in one cell, which
is sorted, not held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K, WIDTH = 64, 5
CELL_ROWS, MAX_CELLS, SEED = 256, 1 << 16, 42


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """array<long>: the k smallest distinct shingle hashes, ascending."""
    hashed = F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # the one-element array binds the words' hashes to a lambda variable, so that they are made once
    return F.get(F.transform(F.array(hashed), lambda h: F.slice(F.sort_array(F.array_distinct(shingles(h))), 1, k)), F.lit(0))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union's shingles that both sets have."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both)).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    # the k-th smallest hash's place in the range of longs
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second has."""
    r, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r * (n + m) / (1 + r) / n))


def merge_parts(parts: DataFrame, key: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key, of the union of its parts; no group is gathered before it is cut to k hashes."""
    hashes = parts.select(*key, F.explode(column).alias("_h")).distinct()
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_h"))
    found = hashes.withColumn("_place", place).where(F.col("_place") <= k).groupBy(*key).agg(F.sort_array(F.collect_list("_h")).alias(column))
    empty = F.array().cast("array<bigint>")
    return parts.select(*key).distinct().join(found, key, "left").withColumn(column, F.coalesce(column, empty))


def printed(a: Column) -> Column:
    """The hashes in 16 hexadecimal digits each."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


KEY = ["_null", "_desc", "_h"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the order's key: null last, then descending doc_id (whose complement can't overflow), then the text's hash."""
    known = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    desc = F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long")))
    return known.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("_null"), desc.alias("_desc"), F.xxhash64("text").alias("_h"))


def bounds_of(known: DataFrame, rows: int) -> list[tuple[int, int, int]]:
    """Keys in order, about one for each CELL_ROWS rows, and about MAX_CELLS at most."""
    every = max(CELL_ROWS, -(-rows // MAX_CELLS))
    drawn = F.pmod(F.xxhash64(*KEY, F.lit(SEED)), F.lit(every)) == 0
    return sorted(map(tuple, known.select(*KEY).where(drawn).distinct().collect()))


def cell(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the bounds a row's key has reached, by binary search."""

    def listed(place: int, kind: str) -> Column:  # one literal, folded into an array
        return F.split(F.lit(",".join(str(b[place]) for b in bounds)), ",").cast(f"array<{kind}>")

    null, desc, h = listed(0, "int"), listed(1, "bigint"), listed(2, "bigint")

    def reached(i: Column) -> Column:
        n, d = F.get(null, i), F.get(desc, i)
        equal = (n == F.col("_null")) & ((d < F.col("_desc")) | ((d == F.col("_desc")) & (F.get(h, i) <= F.col("_h"))))
        return F.coalesce((n < F.col("_null")) | equal, F.lit(False))

    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at + step - 1), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch in the order of descending doc_id; after the last comes the first."""
    known = keyed(docs)
    placed = known.withColumn("_cell", cell(bounds_of(known, docs.count())))
    heads = placed.groupBy("_cell").agg(F.min(F.struct(*KEY)).alias("_first"))
    everywhere = Window.orderBy("_cell")  # of one row a cell
    before = F.coalesce(F.lag("_cell").over(everywhere), F.max("_cell").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = materialise(heads.withColumn("_before", before), "sketch-cells")
    is_first = F.col("_first") == F.struct(*KEY)
    at_home = F.struct(F.col("_cell").alias("cell"), F.lit(0).alias("guest"))
    away = F.struct(F.col("_before").alias("cell"), F.lit(1).alias("guest"))
    sent = placed.withColumn("sketch", sketch(F.col("text"))).join(F.broadcast(heads), "_cell")  # about MAX_CELLS short rows at most
    sent = sent.select("doc_id", "text", "_h", "sketch", F.explode(F.when(is_first, F.array(at_home, away)).otherwise(F.array(at_home))).alias("_to"))
    # plain columns and one projection, or each window would deal the texts out again
    sent = sent.select("doc_id", "text", "_h", "sketch", F.col("_to.cell").alias("_in"), F.col("_to.guest").alias("_guest"))
    in_cell = Window.partitionBy("_in").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_h")
    sent = sent.select("doc_id", "text", "sketch", "_guest", F.lead("text").over(in_cell).alias("next_text"), F.lead("sketch").over(in_cell).alias("next_sketch"))
    return sent.where(F.col("_guest") == 0).drop("_guest")


def edited(docs: DataFrame) -> DataFrame:
    """Each document and its text with the last half replaced from the next document, with their sketches.

    doc_id, n_chars, edited, sketch, edited_sketch, next_sketch.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    found = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), text.alias("edited"), "sketch", "next_sketch")
    return found.withColumn("edited_sketch", sketch(F.col("edited")))
