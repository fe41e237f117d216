"""Problem 10: texts cut off before the writer's end, by a backward character n-gram model.

What a text ends in is its final context. Looking back from it, contexts of growing length are compared with the same
characters elsewhere in the corpus: there they either close something (a sentence or line ends behind them, or another
text ends with them) or something goes on. The closing probability is interpolated from short contexts to long ones,
and its log-odds are held against a threshold found for every language. Texts that end in a stop are asked as well:
where the corpus nearly always goes on behind the same stop (``z. B.``), it closes nothing.

The model is fitted on all texts. Only contexts that some text ends in are of use, so these are marked in a bit table
that grows with their number; what passes by chance is just counted in vain. A longer context is looked up only where
the shorter ones are marked. More contexts than one table is made for take more passes over the texts. Counts are added
up in the tasks before they are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.sizes import attach
from chronolith.session import cut

ORDERS = (3, 5, 8, 12, 16, 24)
#: contexts that are counted in one pass over all texts
SAMPLE = 64_000_000
#: binary logarithms of the least and the largest size of the bit table, and of a block of it that a task fills
LEAST_BITS, MOST_BITS, BLOCK_BITS = 25, 29, 20
#: a closing probability to start from, without and with a final stop, and its weight against counts
PRIOR, STOP_PRIOR, WEIGHT = 0.15, 0.95, 1.0
#: a text that ends in a stop is cut only where going on is this much likelier (log-odds)
STOP_LIMIT = -3.0
CHUNK = 1 << 20
HELD = 1 << 22
BINS = 64
RANGE = 8.0
#: endings at which a language's own threshold counts as much as that of the whole corpus
SHRINK = 50

STOPS = ".!?。！？…"
CLOSERS = "\"')]}»”’」』*_`"
BROKEN = re.compile("\ufffd\\W*$")
SYSTEM = re.compile(r"(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|[\[(<]\s*(?:message |text |content )?(?:truncated|cut off|clipped|snip)[^\])>\n]{0,40}[\])>])$", re.I)
DOTS = re.compile(r"\s*(?:\.{3,}|…)$")
STOPPED = re.compile(rf"[{re.escape(STOPS)}][{re.escape(CLOSERS)}]*$")
#: a stop that can stand inside a number, a version or a path
OPEN_STOP = re.compile(r"(?:(?<![\w.])\d{1,4}\.|(?<!\w)\d+\.\d+\.|/\w+\.)$")
REFERENCE = re.compile(r"(?:^|\n)(?:Refs|See|Fixes|Closes|Resolves|Ref)[: ]+(?:#?[\w-]*\d+)$", re.I)
LINK = re.compile(r"(?:^|\s)https?://[\w.-]+\.\w+/(?:[\w.-]+/)*\d+$")
SIGNATURE = re.compile(r"\n-- ?\n[^\n]{1,80}$")
FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)


def ending(text: str) -> tuple[str, str]:
    """(verdict, the text up to its final context); the verdict is ``cut``, ``whole``, ``open`` or ``stop``.

    ``open`` texts and those that end in a ``stop`` are for the model; ``cut`` ones show it (a broken character, a mark
    of the system, an open code fence), ``whole`` ones end in a form that closes a text.
    """
    body = text.rstrip()
    if BROKEN.search(body[-8:]):
        return "cut", body
    if SYSTEM.search(body[-80:]):
        return "cut", SYSTEM.sub("", body).rstrip()
    if len(FENCE.findall(body)) % 2:
        return "cut", body
    if DOTS.search(body[-12:]):
        core = DOTS.sub("", body).rstrip()
        return ("open" if core else "whole"), core
    tail = body[-120:]
    if tail.endswith(("```", "~~~")) or REFERENCE.search(tail) or LINK.search(tail) or SIGNATURE.search(tail):
        return "whole", body
    if STOPPED.search(tail) and not OPEN_STOP.search(tail):
        return "stop", body
    return "open", body


_FACTORS = np.cumprod(np.full(max(ORDERS), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: contexts up to a final stop are counted apart
_AT_STOP = np.uint64(0x94D049BB133111EB)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every order the 64-bit keys of the contexts that end at each character (meaningless before the order-th)."""
    wide = points.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(wide), np.uint64)
    for k in range(max(ORDERS)):
        if k >= len(wide):
            break
        total[k:] += wide[: len(wide) - k] * _FACTORS[k]
        if k + 1 in ORDERS:
            key = (total ^ np.uint64(k + 1)) * _MIX
            yield k + 1, key ^ (key >> np.uint64(32))


def _final_keys(cores: list[str], stop: list[bool]) -> list[list[int | None]]:
    """Keys of the final contexts of all texts, by order; null where a text is shorter."""
    most = max(ORDERS)
    tails = [core[-most:] for core in cores]
    points = _points("".join(t.rjust(most, "\0") for t in tails)).reshape(len(tails), most).astype(np.uint64) + np.uint64(1)
    lengths = [len(t) for t in tails]
    total, columns = np.zeros(len(tails), np.uint64), []
    for k in range(most):
        total = total + points[:, most - 1 - k] * _FACTORS[k]
        if k + 1 in ORDERS:
            key = (total ^ np.uint64(k + 1)) * _MIX
            key = key ^ (key >> np.uint64(32))
            columns.append(np.where(stop, key ^ _AT_STOP, key).view(np.int64).tolist())
    return [[c[i] if n >= order else None for c, order in zip(columns, ORDERS, strict=True)] for i, n in enumerate(lengths)]


def _ends(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            cores: list[str] = []
            for k, language, text in zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "text")), strict=True):
                if text is None or not text.strip():
                    continue
                verdict, core = ending(text)
                rows.append((k, language, verdict, hash_text(text)))
                cores.append(core if verdict in ("open", "stop") else "")
            finals = [f if r[2] in ("open", "stop") else None for r, f in zip(rows, _final_keys(cores, [r[2] == "stop" for r in rows]), strict=True)] if rows else []
            names = ["key", "lang", "verdict", "text_id"]
            types = [key_type, pa.string(), pa.string(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(finals, pa.list_(pa.int64()))], names=[*names, "finals"])

    return run


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64(text.encode("utf-8", "surrogatepass")).intdigest() - 2**63


def _marked(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the bits of keys are set in a table of bytes."""
    slots = keys & np.uint64(8 * len(table) - 1)
    return (table[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).view(bool)


#: which pass a context is counted in is told by the shortest context in it
_PASS_SHIFT = 40


def _small(points: np.ndarray) -> np.ndarray:
    """Flags of lower-case letters (looked up once a different character)."""
    different, where = np.unique(points, return_inverse=True)
    return np.array([chr(c).islower() if c < 0xD800 or 0xDFFF < c < 0x110000 else False for c in different.tolist()], bool)[where]


_BLANK = np.array([ord(c) for c in " \t\r\n"] + [0], np.uint32)
_STOP = np.array([ord(c) for c in ".!?…"], np.uint32)
_WIDE = np.array([ord(c) for c in "。！？"], np.uint32)
_LINE = np.array([10, 13, 0], np.uint32)


def _closing(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character: whether something ends behind it; whether it is a stop before a blank; whether that closes a sentence.

    A line ends, or a sentence whose stop has a blank or nothing after it. Behind such a stop the sentence is closed
    unless the line goes on with a lower-case letter.
    """
    following, second = np.r_[points[1:], 0].astype(np.uint32), np.r_[points[2:], 0, 0][: len(points)].astype(np.uint32)
    wide, stop, line = np.isin(points, _WIDE), np.isin(points, _STOP), np.isin(following, _LINE)
    final = stop & np.isin(following, _BLANK)
    next_stop = np.isin(following, _STOP) & np.isin(second, _BLANK)
    return wide | line | np.isin(following, _WIDE) | next_stop | final, final, line | ~_small(second)


def _counted(column: str, table, number: int, passes: int):
    """Texts in; (context, closing, going on) out for contexts of a pass whose bit is set, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, ...]:
            keys, closing, going = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[start], np.add.reduceat(closing[order], start), np.add.reduceat(going[order], start)

        def record(keys: np.ndarray, closing: np.ndarray, going: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(closing), pa.array(going)], names=["context", "closing", "going"]
            )

        def scan(texts: list[str]) -> None:
            nonlocal size
            gap = "\0" * max(ORDERS)
            points = _points(gap + gap.join(texts))
            inner = points != 0
            # a text's own end is not evidence for itself
            at = 0
            for text in texts:
                at += len(gap) + len(text)
                core = len(DOTS.sub("", SYSTEM.sub("", text.rstrip())).rstrip())
                inner[at - len(text) + max(core - 1, 0) : at] = False
            closes, final, closes_sentence = _closing(points)
            use, final = np.flatnonzero(inner), np.flatnonzero(inner & final)
            for order, keys in _hashes(points):
                if order == min(ORDERS) and passes > 1:
                    use = use[(keys[use] >> np.uint64(_PASS_SHIFT)) % np.uint64(passes) == number]
                    final = final[((keys[final] ^ _AT_STOP) >> np.uint64(_PASS_SHIFT)) % np.uint64(passes) == number]
                # whoever ends in a context ends in the shorter ones, too
                use = use[_marked(keys[use], bits)]
                final = final[_marked(keys[final] ^ _AT_STOP, bits)]
                for found, closed in ((keys[use], closes[use]), (keys[final] ^ _AT_STOP, closes_sentence[final])):
                    unique, inverse = np.unique(found, return_inverse=True)
                    closing = np.bincount(inverse, closed, len(unique)).astype(np.int64)
                    held.append((unique, closing, np.bincount(inverse, None, len(unique)) - closing))
                    size += len(unique)

        for batch in batches:
            texts: list[str] = []
            length = 0
            for text in batch.column(column).to_pylist():
                if text is None or not text.strip():
                    continue
                texts.append(text)
                length += len(text)
                if length >= CHUNK:
                    scan(texts)
                    texts, length = [], 0
            if texts:
                scan(texts)
            if size >= HELD:
                merged = summed()
                held, size = [merged], len(merged[0])
                if size >= HELD // 2:
                    yield record(*merged)
                    held, size = [], 0
        if held:
            yield record(*summed())

    return run


def _bit_table(contexts: DataFrame, size: int) -> bytes:
    """A bit for every ``context``, in a table of two to the power of ``size`` bits; tasks fill blocks of it."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.asarray(batch.column("slot"))
            for block in np.unique(slots >> BLOCK_BITS).tolist():
                inside = slots[slots >> BLOCK_BITS == block] & ((1 << BLOCK_BITS) - 1)
                bits = blocks.setdefault(block, np.zeros(1 << BLOCK_BITS - 3, np.uint8))
                np.bitwise_or.at(bits, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        for block, bits in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    slots = contexts.select(F.col("context").bitwiseAND(F.lit((1 << size) - 1)).alias("slot"))
    rows = slots.repartition(F.shiftright("slot", BLOCK_BITS)).mapInArrow(fill, "block long, bits binary")
    table = np.zeros(1 << size - 3, np.uint8)
    for row in rows.toLocalIterator():
        table[row["block"] << BLOCK_BITS - 3 : row["block"] + 1 << BLOCK_BITS - 3] = np.frombuffer(row["bits"], np.uint8)
    return table.tobytes()


def _counts(source: DataFrame, exploded: DataFrame) -> DataFrame:
    """``context, closing, going`` of the contexts in ``exploded`` (``first`` is the shortest one), counted in all texts."""
    spark = source.sparkSession
    number = exploded.agg(F.approx_count_distinct("context", 0.02)).first()[0]
    passes = max(-(-number // SAMPLE), 1)
    size = min(max((16 * number // passes).bit_length(), LEAST_BITS), MOST_BITS)
    out = None
    for k in range(passes):
        mine = exploded.where(F.shiftrightunsigned("first", _PASS_SHIFT) % passes == k) if passes > 1 else exploded
        table = spark.sparkContext.broadcast(_bit_table(mine.select("context"), size))
        counted = source.select("text").mapInArrow(_counted("text", table, k, passes), "context long, closing long, going long")
        counts = counted.groupBy("context").agg(F.sum("closing").alias("closing"), F.sum("going").alias("going"))
        if passes > 1:
            # only what is asked for is kept, and one table at a time
            counts = cut(counts.join(mine.select("context").distinct().hint("merge"), "context", "left_semi"))
            table.unpersist()
        out = counts if out is None else out.unionByName(counts)
    return out


def _threshold(bins: np.ndarray) -> float:
    """The log-odds that best part a histogram in two (Otsu), within one unit of even odds."""
    centres = (np.arange(BINS) + 0.5) / BINS * 2 * RANGE - RANGE
    weight = np.cumsum(bins)
    total, mass = weight[-1], np.cumsum(bins * centres)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * weight / total - mass) ** 2 / (weight * (total - weight))
    between[~np.isfinite(between)] = -1
    best = np.flatnonzero(between >= between.max() - 1e-12)
    return float(np.clip((centres[best[0]] + centres[best[-1]]) / 2 + RANGE / BINS, -1.0, 1.0))


def _otsu(rows: DataFrame) -> DataFrame:
    """``language, n, threshold`` from ``language, bin, count``; a language's histogram is one array of ``BINS`` numbers."""
    filled = rows.groupBy("language").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("bins"))
    array = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at("bins", i), F.lit(0)).cast("double"))
    limit = F.udf(lambda bins: _threshold(np.array(bins)), "double")
    return filled.select("language", "n", limit(array).alias("threshold"))


def score_endings(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, verdict, log_odds, truncated`` of every row whose text is not null, empty or blank.

    ``log_odds`` (null where the form of the ending decides) are those of an end against a continuation. Keys may
    repeat; rows are judged one by one. A null language is a language of its own. A language's threshold is drawn
    towards that of all languages the more, the fewer endings it has.
    """
    source = df.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = source.schema["key"].dataType
    schema = f"key {kind.simpleString()}, lang string, verdict string, text_id long, finals array<long>"
    ends = cut(source.mapInArrow(_ends(to_arrow_type(kind)), schema))
    undecided = ends.where("finals is not null")
    # the same ending needs looking up once, however many texts have it; equal texts end alike for one reason only
    endings = undecided.select("finals", F.xxhash64("finals").alias("ending"), (F.col("verdict") == "stop").alias("stop")).dropDuplicates(["ending"])
    first = F.col("finals")[0].alias("first")
    exploded = endings.select("ending", "stop", first, F.posexplode("finals").alias("place", "context")).where("context is not null")
    own = undecided.select("text_id", F.explode("finals").alias("context")).where("context is not null")
    others = own.distinct().groupBy("context").agg((F.count(F.lit(1)) - 1).alias("ends"))
    counts = _counts(source, exploded)
    looked = exploded.join(others.hint("merge"), "context", "left").join(counts.hint("merge"), "context", "left").fillna(0, ["ends", "closing", "going"])
    evidence = looked.groupBy("ending", "stop").agg(
        F.array_sort(F.collect_list(F.struct("place", (F.col("closing") + F.col("ends")).alias("closed"), "going"))).alias("e")
    )
    step = f"(p, x) -> (x.closed + {WEIGHT} * p) / (x.closed + x.going + {WEIGHT})"
    probable = evidence.select("ending", F.expr(f"aggregate(e, cast(if(stop, {STOP_PRIOR}, {PRIOR}) as double), {step})").alias("p"))
    odds = F.ln((F.col("p") + 1e-4) / (1 - F.col("p") + 1e-4))
    scored = undecided.select("key", "lang", "verdict", F.xxhash64("finals").alias("ending"))
    scored = scored.join(probable.select("ending", odds.alias("log_odds")).hint("merge"), "ending", "left")
    scored = cut(scored.select("key", F.coalesce("lang", F.lit("\0")).alias("language"), "verdict", F.coalesce("log_odds", F.lit(0.0)).alias("log_odds")))
    place = F.least(F.greatest(((F.col("log_odds") + RANGE) / (2 * RANGE) * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))
    histogram = cut(scored.where("verdict = 'open'").groupBy("language", place.alias("bin")).count())
    overall = np.zeros(BINS)
    for row in histogram.groupBy("bin").agg(F.sum("count").alias("n")).collect():
        overall[row["bin"]] = row["n"]
    corpus = _threshold(overall) if overall.any() else 0.0
    shrunk = (F.col("n") * F.col("threshold") + SHRINK * corpus) / (F.col("n") + SHRINK)
    limits = cut(_otsu(histogram).select("language", "n", shrunk.alias("threshold")))
    judged = attach(scored.where("verdict = 'open'"), limits, "language", "n", int(overall.sum()))
    judged = judged.select("key", "verdict", "log_odds", (F.col("log_odds") < F.col("threshold")).alias("truncated"))
    stopped = scored.where("verdict = 'stop'").select("key", "verdict", "log_odds", (F.col("log_odds") < STOP_LIMIT).alias("truncated"))
    formal = ends.where("finals is null").select(
        "key", "verdict", F.lit(None).cast("double").alias("log_odds"), (F.col("verdict") == "cut").alias("truncated")
    )
    return formal.unionByName(judged).unionByName(stopped).withColumnRenamed("key", key)
