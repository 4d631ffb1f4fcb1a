"""Order-independent fingerprints of documents that can be updated by paragraph.

Homomorphic multiset hash. A text is cut into paragraphs (lines) and those into short runs of words, at places that a hash of
each word decides, so an edit moves no cut beyond its own run. A word ends after any sign that isn't a letter or digit, and
after each character of scripts that are written without blanks. Each element is hashed to a wide vector, and a text's
fingerprint is the sum of its elements' vectors modulo powers of two. The sum doesn't depend on order, and an element is
inserted or deleted by adding or subtracting its vector (`changed`): no text need be read again.

A vector has two parts. WIDE lanes of 32 bits take a hash of the whole paragraph each, and decide equality. The other lanes, of
16 bits, are sparse: a run adds its hash to one lane of each level it belongs to, so that lanes of similar texts stay
equal. Level 0 holds all runs, each further level a quarter of the last one's. A string has less than 2**31 bytes, and of
so many runs about two are in the last level, so texts of any length have a level whose lanes aren't crowded. The likeness of two fingerprints is the share of equal lanes among those used in either, from the
first level with enough unused lanes on.

Fingerprints are hexadecimal strings, 8 digits a wide lane and 4 a sparse one.

Scale: a fingerprint is made within its row by array functions, no shuffle and no Python. The next document is found by
a window over ranges of ids (a few hundred rows each), joined at their borders; no window spans the table.

Nulls, empty and odd input: a null text is empty; the empty text has no paragraph and the all-zero fingerprint. Rows with a
null id come last in descending order. Rows with the same id follow each other in the order of their texts. Other
columns are never read; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitefit.llm.base import once

#: Wide lanes, levels and sparse lanes of a level, and the used lanes up to which a level isn't crowded.
WIDE, LEVELS, LANES, ROOMY = 8, 16, 32, 24
#: Rows that one range of ids should hold.
RANGE_ROWS = 512
#: Quantiles of the ids that ranges begin at, at most.
QUANTILES = 1024
#: Where a word ends; a run ends after one word in RUN_WORDS, or at a line's end.
WORD_END = r"(?<=[^\p{L}\p{M}\p{N}]|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}])"
RUN_WORDS = 6

_LANE = (1 << 32) - 1
_SHORT = (1 << 16) - 1


def paragraphs(text: Column) -> Column:
    """Lines that aren't empty."""
    return F.filter(F.split(text, "\n"), lambda line: line != "")


def runs(text: Column) -> Column:
    """Runs of words, cut at line ends and where the words say so."""
    words = F.transform(F.split(text, WORD_END), lambda word: F.when(F.pmod(F.xxhash64(word, F.lit(1)), F.lit(RUN_WORDS)) == 0, F.concat(word, F.lit("\n"))).otherwise(word))
    return F.filter(F.transform(F.split(F.array_join(words, ""), "\n"), lambda run: F.trim(run)), lambda run: run != "")


def _line_hashes(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda line: F.xxhash64(line))


def _run_hashes(text: Column) -> Column:
    return F.transform(runs(text), lambda run: F.xxhash64(run))


def _wide(lines: Column) -> Column:
    """Sums of paragraph hashes, 32 bits a lane."""
    zero = F.array(*[F.lit(0).cast("long")] * WIDE)

    def add(lanes: Column, h: Column) -> Column:
        return F.array(*[(lanes[k] + F.xxhash64(h, F.lit(k)).bitwiseAND(F.lit(_LANE))).bitwiseAND(F.lit(_LANE)) for k in range(WIDE)])

    return F.aggregate(lines, zero, add)


def _of_level(hashes: Column, k: int) -> Column:
    """The run hashes of a level, from those of the level before: two more bits from 32 on for each."""
    return F.filter(hashes, lambda h: F.shiftright(h, 30 + 2 * k).bitwiseAND(F.lit(3)) == 0) if k else hashes


def _sparse(levels: list[Column]) -> Column:
    """Sums of the run hashes of each level, 16 bits a lane: bits 0-15 are the value, 16-20 the lane."""
    def lanes(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda lane: F.aggregate(
            hashes, F.lit(0).cast("long"), lambda held, h: F.when(F.shiftright(h, 16).bitwiseAND(F.lit(LANES - 1)) == lane, (held + h.bitwiseAND(F.lit(_SHORT))).bitwiseAND(F.lit(_SHORT))).otherwise(held)))

    none = F.array_repeat(F.lit(0).cast("long"), LANES)
    return F.flatten(F.array(*[F.when(F.size(hashes) == 0, none).otherwise(lanes(hashes)) for hashes in levels])).cast("array<int>")


def with_lanes(df: DataFrame, text: str, wide: str, sparse: str) -> DataFrame:
    """Adds the two parts of the fingerprint of a text column."""
    held = once(df, lines_=_line_hashes(F.col(text)), runs_=_run_hashes(F.col(text)))
    for k in range(LEVELS):
        held = once(held, **{f"level{k}_": _of_level(F.col(f"level{k - 1}_" if k else "runs_"), k)})
    held = once(held, **{wide: _wide(F.col("lines_")), sparse: _sparse([F.col(f"level{k}_") for k in range(LEVELS)])})
    return held.drop("lines_", "runs_", *[f"level{k}_" for k in range(LEVELS)])


def digits(wide: Column, sparse: Column) -> Column:
    """The fingerprint's string."""
    def row(lanes: Column, n: int) -> Column:
        return F.array_join(F.transform(lanes, lambda v: F.lpad(F.lower(F.hex(v)), n, "0")), "")

    return F.concat(row(wide, 8), row(sparse, 4))


def lanes_of(fingerprint: Column) -> tuple[Column, Column]:
    """Both parts of a fingerprint's string."""
    def cut(at: int, n: int, count: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.conv(F.substring(fingerprint, k * n + 1 + at, F.lit(n)), 16, 10).cast("long"))

    return cut(0, 8, WIDE), cut(8 * WIDE, 4, LEVELS * LANES)


def changed(df: DataFrame, fingerprint: str, text: str, sign: int, out: str) -> DataFrame:
    """Adds the fingerprint after the paragraphs of a text column (whole lines) were inserted (sign 1) or deleted (-1)."""
    wide, sparse = lanes_of(F.col(fingerprint))
    held = with_lanes(once(df, wide_=wide, sparse_=sparse), text, "by_wide_", "by_sparse_")

    def moved(lanes: str, by: str, mask: int) -> Column:
        return F.zip_with(lanes, by, lambda a, b: (a + sign * b).bitwiseAND(F.lit(mask)))

    held = held.withColumn(out, digits(moved("wide_", "by_wide_", _LANE), moved("sparse_", "by_sparse_", _SHORT)))
    return held.drop("wide_", "sparse_", "by_wide_", "by_sparse_")


def likeness(wide: Column, sparse: Column, other_wide: Column, other_sparse: Column) -> Column:
    """0 to 1, about the share of runs that both texts have; 1 for equal fingerprints."""
    def level(k: Column) -> Column:
        pair = F.arrays_zip(F.slice(sparse, k * LANES + 1, F.lit(LANES)).alias("a"), F.slice(other_sparse, k * LANES + 1, F.lit(LANES)).alias("b"))
        used = F.filter(pair, lambda p: (p["a"] != 0) | (p["b"] != 0))
        return F.struct(F.size(used).alias("used"), F.size(F.filter(used, lambda p: p["a"] == p["b"])).alias("same"))

    def add(held: Column, k: Column) -> Column:
        return F.transform(F.array(level(k)), lambda x: F.when(held["open"] | (x["used"] <= ROOMY) | (k == LEVELS - 1), F.struct(
            F.lit(True).alias("open"), (held["used"] + x["used"]).alias("used"), (held["same"] + x["same"]).alias("same"))).otherwise(held))[0]

    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("used"), F.lit(0).alias("same"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, add, lambda held: held["same"] / F.greatest(held["used"], F.lit(1)))
    return F.when((wide == other_wide) & (sparse == other_sparse), F.lit(1.0)).otherwise(found)


def range_of(doc_id: Column, points: list[int], pieces: int) -> Column:
    """The range of an id, ascending with it: the interval between two of the ascending points, cut into `pieces` even parts; -1 for null."""
    jump = max(1, int(len(points) ** 0.5))
    coarse, exact = F.array(*[F.lit(p) for p in points[::jump]]), F.array(*[F.lit(p) for p in points])
    block = F.greatest(F.size(F.filter(coarse, lambda p: p <= doc_id)) - 1, F.lit(0)) * jump
    at = F.greatest(block + F.size(F.filter(F.slice(exact, block + 1, F.lit(jump)), lambda p: p <= doc_id)) - 1, F.lit(0))
    # the distance between two 64-bit ids may take 65 bits; what lies outside the points goes to the first or last part
    widths = [max(1, -(-(after - p) // pieces)) for p, after in zip(points, [*points[1:], points[-1] + pieces], strict=True)]
    width = F.get(F.array(*[F.lit(w).cast("decimal(20,0)") if w < 1 << 63 else F.lit(str(w)).cast("decimal(20,0)") for w in widths]), at)
    part = F.floor((doc_id.cast("decimal(20,0)") - F.get(exact, at).cast("decimal(20,0)")) / width)
    part = F.least(F.greatest(part.cast("long"), F.lit(0)), F.lit(pieces - 1))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(at.cast("long") * pieces + part).cast("long")


def with_next(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row that follows by descending doc_id (the first row follows the last). `ids`: the rows' doc_id alone.

    Ids are cut into ranges of about RANGE_ROWS rows: by at most QUANTILES approximate quantiles, and evenly between two of them, so that
    outlying ids stand apart from the rest; rows follow each other within a range, and the last of a range is followed by the first of the
    next range that has rows. The columns hold no nulls.
    """
    c = F.col
    n = ids.count()
    parts = max(1, min(QUANTILES, n // RANGE_ROWS))
    points = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(parts)], 10 * QUANTILES)).first()[0] if n else None
    place = range_of(c("doc_id"), sorted(set(points or [0])), max(1, n // (parts * RANGE_ROWS)))
    order = Window.partitionBy("range_").orderBy(F.desc_nulls_last("doc_id"), "text")
    # plain columns, so that both uses read one exchange which holds each text once
    linked = rows.withColumn("range_", place).withColumns({f"next_{name}": F.lead(name).over(order) for name in columns} | {"follows_": F.lag(F.lit(True)).over(order)})
    firsts = linked.filter("follows_ is null").select("range_", *[c(name).alias(f"first_{name}") for name in columns])

    # the range after each: within blocks of ranges, and from block to block
    ranges = ids.select(place.alias("range_")).distinct().withColumn("block_", F.floor(c("range_") / 4096))
    blocks = ranges.groupBy("block_").agg(F.max("range_").alias("top_"))
    wrap = blocks.agg(F.max("top_")).first()[0]
    blocks = blocks.select("block_", F.lead("top_").over(Window.orderBy(F.desc("block_"))).alias("below_"))  # a row for 4096 ranges
    follow = ranges.withColumn("near_", F.lead("range_").over(Window.partitionBy("block_").orderBy(F.desc("range_")))).join(blocks, "block_")
    follow = follow.select(c("range_").alias("asks_"), F.coalesce(c("near_"), c("below_"), F.lit(wrap)).alias("range_"))
    borders = follow.join(firsts, "range_").drop("range_").withColumnRenamed("asks_", "range_")
    found = linked.join(borders, "range_")
    return found.select(*rows.columns, *[F.coalesce(f"next_{name}", f"first_{name}").alias(f"next_{name}") for name in columns])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the likeness to those and to the next document's.

    A text is edited by putting the first floor(n_chars / 2) code points (or all) of the next document, by descending id, in the
    place of its own last floor(n_chars / 2).
    """
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_lanes(rows, "text", "wide", "sparse"), rows.select("doc_id"), ["text", "wide", "sparse"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = once(rows, n_chars=F.char_length("text"), edited=F.concat(F.substring(c("text"), F.lit(1), F.char_length("text") - half), F.substring(c("next_text"), F.lit(1), half)))
    rows = with_lanes(rows, "edited", "edited_wide", "edited_sparse")
    return rows.select(
        "doc_id", c("n_chars").cast("long").alias("n_chars"), F.sha2(c("edited").cast("binary"), 256).alias("edited_sha256"), digits(c("wide"), c("sparse")).alias("fingerprint"),
        digits(c("edited_wide"), c("edited_sparse")).alias("edited_fingerprint"), likeness(c("wide"), c("sparse"), c("edited_wide"), c("edited_sparse")).alias("near_edited"),
        likeness(c("wide"), c("sparse"), c("next_wide"), c("next_sparse")).alias("near_next"))
