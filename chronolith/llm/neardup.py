"""Problem 3: records that share most of their words, by SetSketch banding, joint estimation and verification.

1. A text becomes the set of its word shingles (hashed with 64 bits). Texts of the same set are one class; the rest
   works on one representative of each class, so copies cost nothing however many there are.
2. Each representative gets a sketch. Bands of registers are hashed; representatives that share a band are candidates
   if their sizes allow the threshold. The banding misses a pair at the threshold with a probability of at most 0.3 %,
   and far less above it. Texts made of the same phrases share a band by chance, and such pairs grow with the square of
   the table; so a row of a band has one bit of every register with it, and only pairs whose bits agree well enough
   (five standard errors) leave the join of a band. Bands are worked off in groups, so that few of these rows exist at
   once; a band of many representatives is cut into parts, and every part meets every other.
3. A band that very many representatives share (a common passage) would make each of them the candidate of all others.
   Its members are joined exactly by a prefix filter instead: two similar sets share one of their rarest shingles.
4. A candidate's similarity is estimated jointly from both sketches, for which only the sketches of candidates are
   moved; what lies five standard errors below the threshold is dropped.
5. The shingles of the pairs that are left are fetched, and the pairs are verified exactly.

All joins of sketches and shingles are told to shuffle: after a checkpoint Spark takes their size from the plan before
it and would broadcast them.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.blocks import SAMPLED, block_pairs, cells, large_blocks
from chronolith.llm.setsketch import REGISTERS, band_keys, bands_for, jaccard, sketch
from chronolith.llm.sizes import small_side
from chronolith.session import cut

PART = 2_000
#: a band shared by more classes is cut into parts of this size
BAND_PART = 4_000
#: a band shared by more classes is left to the prefix filter
HOT_BAND = 50_000
#: bands worked off at once, and classes up to which all are
BANDS, FEW = 16, 50_000
#: one bit of every register, in columns of 64
BITS = [f"bits{i}" for i in range(REGISTERS // 64)]


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, PART):
            batch = whole.slice(begin, PART)
            sets = batch.column("shingles")
            registers = sketch(np.asarray(sets.flatten()), _offsets(sets))
            binary = pa.array([row.tobytes() for row in registers], pa.binary())
            columns = [batch.column("id"), sets.value_lengths().cast(pa.int32()), binary]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "registers"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bits(registers: np.ndarray) -> np.ndarray:
    """The lowest bit of every register, 64 in a column; it is the same for equal registers and else in half the cases."""
    return np.packbits((registers & 1).astype(np.uint8), axis=1).view(np.int64)


def _most_unlike(threshold: float) -> int:
    """Bits that can differ at the threshold, with five standard errors."""
    unlike = (1 - threshold) / 2
    return int(np.ceil(REGISTERS * unlike + 5 * np.sqrt(REGISTERS * unlike * (1 - unlike))))


def _hot_bands(sketched: DataFrame, rows: int, bands: int, part: int) -> DataFrame:
    """``band, _n, _parts`` of the bands with clearly more than ``part`` rows, as ``large_blocks`` has them; rows are picked in Python."""
    every = SAMPLED if part >= 20 * SAMPLED else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _banded(rows, range(bands), bits=False)(batches):
            mixed = (np.asarray(batch.column("band")) ^ np.asarray(batch.column("id"))).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield batch.select(["band"]).filter(pa.array((mixed >> np.uint64(40)) % np.uint64(every) == 0))

    counts = sketched.mapInArrow(run, "band long").groupBy("band").agg((F.count(F.lit(1)) * every).alias("_n")).where(F.col("_n") > part)
    return cut(counts.select("band", "_n", F.ceil(F.col("_n") / part).cast("int").alias("_parts")))


def _banded(rows: int, some: range, bits: bool = True):
    """``id, n, band`` of the bands in ``some``, and with ``bits`` those of the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, PART):
                batch = whole.slice(begin, PART)
                registers = _registers(batch.column("registers"))
                keys = band_keys(registers[:, some.start * rows : some.stop * rows], rows, len(some))
                # the band's number goes into the key
                keys ^= np.arange(some.start, some.stop, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                ids, sizes = (np.repeat(np.asarray(batch.column(c)), len(some)) for c in ("id", "n"))
                columns = [pa.array(ids), pa.array(sizes), pa.array(keys.ravel().view(np.int64))]
                if bits:
                    columns += [pa.array(np.repeat(c, len(some))) for c in _bits(registers).T]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "band", *(BITS if bits else [])])

    return run


def _likely(threshold: float):
    """Pairs with both sketches in; those whose estimate does not rule the threshold out."""
    slack = 5 * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, PART):
                batch = whole.slice(begin, PART)
                sizes = [np.asarray(batch.column(f"n_{side}")) for side in "ab"]
                registers = [_registers(batch.column(f"registers_{side}")) for side in "ab"]
                likely = pa.array(np.flatnonzero(jaccard(*registers, *sizes) >= threshold - slack))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(likely) for c in ("a", "b")], names=["a", "b"])

    return run


def shingle_sets(df: DataFrame, key: str, text: str, words: int, min_words: int) -> DataFrame:
    """``key`` and the distinct hashed word shingles of the texts that have at least ``min_words`` words.

    Words are the maximal runs of a-z and 0-9 in the lower-cased text. Null and shorter texts are left out.
    """
    found = df.select(F.col(key).alias("key"), F.expr(f"regexp_extract_all(lower(`{text}`), '[a-z0-9]+', 0)").alias("w"))
    found = found.where(F.size("w") >= max(min_words, words))
    terms = ", ".join(f"element_at(w, i + {k})" for k in range(words))
    return found.select(
        "key", F.expr(f"array_sort(array_distinct(transform(sequence(1, size(w) - {words - 1}), i -> xxhash64({terms}))))").alias("shingles")
    )


def _may_reach(threshold: float) -> str:
    """Whether two sizes allow the threshold at all."""
    return f"least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)"


def _rare_pairs(sets: DataFrame, threshold: float, part: int) -> DataFrame:
    """``a, b`` of all sets that can reach the threshold: they share one of the rarest shingles of both (prefix filter).

    Of a set of n shingles, ordered by how many sets have them, any n - ceil(threshold * n) + 1 must meet those of a
    similar set, so the rarest ones are taken. Where even these are common, their blocks are worked off part by part.
    """
    loose = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = loose.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"))
    ordered = loose.join(common.where("sets > 1").hint("merge"), "shingle").groupBy("id", "n")
    ordered = ordered.agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("o"))
    # shingles of one set only are the rarest and meet nothing; what is left of the prefix are the first others
    least = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("o"))
    prefix = ordered.where(least > 0).select("id", "n", F.explode(F.slice("o", F.lit(1), least.cast("int"))).alias("s"))
    index = cut(prefix.select("id", "n", F.col("s.shingle").alias("shingle")))
    met = block_pairs(index, "shingle", "id", large_blocks(index, "shingle", "id", part), ("n",))
    return met.where(_may_reach(threshold)).select("a", "b")


def _candidates(sketched: DataFrame, sets: DataFrame, threshold: float, hot_band: int) -> DataFrame:
    """``a, b`` (``a < b``), each once: classes that share a band and may be similar, or are joined exactly where a band is too common."""
    rows, bands = bands_for(threshold)
    part, classes = min(BAND_PART, hot_band), sketched.count()
    carried = ("n", *BITS)
    schema = "id long, n int, band long"
    # no band has more rows than there are classes
    large = _hot_bands(sketched, rows, bands, part) if classes > part else None
    large = None if large is None or large.isEmpty() else large
    hot = None if large is None else cut(large.where(F.col("_n") > hot_band).select("band"))
    hot = None if hot is None or hot.isEmpty() else hot
    unlike = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in BITS)
    alike = f"{_may_reach(threshold)} and {unlike} <= {_most_unlike(threshold)}"
    group = bands if classes <= FEW else BANDS
    found = None
    for begin in range(0, bands, group):
        some = range(begin, min(begin + group, bands))
        banded = sketched.mapInArrow(_banded(rows, some), ", ".join([schema, *(f"{c} long" for c in BITS)]))
        own = banded if large is None else banded.join(small_side(large.select("band")), "band", "left_anti")
        side = {s: own.select("band", F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in carried)) for s in "ab"}
        pairs = side["a"].join(side["b"].hint("merge"), "band").where("a < b").where(alike).select("a", "b")
        if large is not None:
            wide = large if hot is None else large.join(hot.hint("merge"), "band", "left_anti")
            index = banded.join(small_side(wide.select("band")), "band", "left_semi")
            pairs = pairs.unionByName(block_pairs(index, "band", "id", wide, carried).where(alike).select("a", "b"))
        pairs = cut(pairs.distinct())
        found = pairs if found is None else found.unionByName(pairs)
        if group < bands:
            # files of shuffles are removed when the driver collects its garbage
            gc.collect()
            sketched.sparkSession.sparkContext._jvm.System.gc()
    if hot is not None:
        members = sketched.mapInArrow(_banded(rows, range(bands), bits=False), schema).join(small_side(hot), "band", "left_semi").select("id").distinct()
        found = found.unionByName(_rare_pairs(cut(sets.join(members.hint("merge"), "id")), threshold, part))
    return found.distinct()


def _of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``rows`` (by ``id``) that are an end of a pair."""
    ends = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    near = small_side(ends)
    return rows.join(ends.hint("merge") if near is ends else near, "id")


def near_duplicates(
    df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8, min_words: int = 1, hot_band: int = HOT_BAND
) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with the same shingles, and similar pairs of classes.

    Returns ``members`` (``key, class``: every row with a text long enough, once) and ``links`` (``a, b, similarity``
    between classes, ``a < b``, similarity at least ``threshold``). A repeated key counts once per different text;
    null keys are rows like any other; other columns are not read; a table without a text that is long enough gives
    two empty tables. ``hot_band`` only says from where on a band is left to the prefix filter.
    """
    hashed = shingle_sets(df, key, text, words, min_words).withColumns({"c1": F.xxhash64("shingles"), "c2": F.xxhash64(F.lit(1), "shingles")})
    hashed = cut(hashed)
    classes = hashed.groupBy("c1", "c2").agg(F.first("shingles").alias("shingles"))
    # the class id is the first hash; the second one only tells apart what the first one confuses
    sets = cut(classes.select(F.xxhash64("c1", "c2").alias("id"), "shingles"))
    members = cut(hashed.select(F.col("key").alias(key), F.xxhash64("c1", "c2").alias("class")).distinct())
    del hashed, classes
    sketched = cut(sets.mapInArrow(_sketched, "id long, n int, registers binary"))
    met = cut(_candidates(sketched, sets, threshold, hot_band))
    asked = _of(sketched, met)
    side = {s: asked.toDF(*(f"{c}_{s}" for c in sketched.columns)).hint("merge") for s in "ab"}
    met = met.join(side["a"], F.col("a") == F.col("id_a")).join(side["b"], F.col("b") == F.col("id_b"))
    met = met.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(_likely(threshold), "a long, b long")
    likely = cut(met)
    held = _of(sets, likely)
    held = {s: held.toDF(f"id_{s}", f"shingles_{s}").hint("merge") for s in "ab"}
    full = likely.join(held["a"], F.col("a") == F.col("id_a")).join(held["b"], F.col("b") == F.col("id_b"))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = full.select("a", "b", (both / (F.size("shingles_a") + F.size("shingles_b") - both)).alias("similarity"))
    return members, links.where(F.col("similarity") >= threshold)


def named_classes(members: DataFrame, links: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with every class named by its smallest key: ``key, class, copies, links`` and ``class_a, class_b, similarity``.

    ``copies`` counts the keys of the class, ``links`` the other classes it is similar to. Nothing is expanded.
    """
    members, links = cut(members), cut(links)
    names = members.groupBy("class").agg(F.min(key).alias("name"), F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    names = cut(names.join(ends.hint("merge"), "class", "left").fillna(0, ["links"]))
    rows = members.join(names.hint("merge"), "class").select(key, F.col("name").alias("class"), "copies", "links")
    side = {s: names.select(F.col("class").alias(s), F.col("name").alias(f"name_{s}")).hint("merge") for s in "ab"}
    pairs = links.join(side["a"], "a").join(side["b"], "b")
    return rows, pairs.select(F.least("name_a", "name_b").alias("class_a"), F.greatest("name_a", "name_b").alias("class_b"), "similarity")


def expand(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """All similar pairs of rows, ``key_a < key_b``: inside each class and across linked classes.

    Classes of many copies are cut into parts, so no task makes the pairs of a whole class.
    """
    members = cut(members)
    large = large_blocks(members, "class", key)
    inside = block_pairs(members, "class", key, large).toDF("x", "y")
    rows = members.select(F.col(key).alias("y"), F.col("class").alias("b"))
    near = cells(links.select(F.col("a").alias("class"), "b"), members.withColumnRenamed(key, "x"), "class", large, "b", "x")
    across = cells(near.select("b", "x"), rows, "b", large.withColumnRenamed("class", "b"), "x", "y")
    pairs = inside.unionByName(across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    return pairs.select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))
