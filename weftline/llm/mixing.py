"""Mixing sources to target weights with a low-discrepancy source schedule.

Every source gets a target in words: the wanted total is shared by weight, no target
exceeds ``max_passes`` times its source, and the excess is shared among the others. The
documents of a source stand in a fixed shuffled order and form one long stream of words,
cut into blocks of ``block`` words; past the end the stream starts again. Slot i of the
schedule maps the i-th point of a low-discrepancy sequence (golden ratio or van der Corput)
through the cumulative weights to a source; the slot's rank within its source is the block
it takes, and slots of a source that has its target are passed over. So the slots say which
blocks are taken and where in the mix they stand. The last block is trimmed, so that each
source gives its target, rounded down.

Points are whole numbers of 40 bits, so they are exact at any number of slots. By the
three-gap theorem, an interval of k/N holds k of the first 1.9 N golden-ratio points, so
2 N slots serve every source.

Prefix sums run level by level, over at most FAN rows in a window, so a source with a third
of all rows is spread over many tasks. Windows over all sources hold one row per source.

Edge cases: null texts have size 0, are kept and give nothing; a null source is a source,
ordered last; null or repeated ids are allowed; equal rows (id, source and text) are placed
once and unfolded, so any number of them may be equal; an empty table gives an empty
result. Other columns of the input are ignored by ``mix_report`` and passed through by
``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm.common import persist, unused

WEIGHTS = (5, 2, 1)
BUCKET_ROWS, FAN = 2_000, 4_096
BITS = 40
#: The golden ratio's fraction in units of 2**-BITS, made odd.
GOLDEN = round((math.sqrt(5) - 1) / 2 * 2**BITS) | 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """(source, source_size, target): water-filling over one row per source.

    Sorted by size over weight, the sources below the water line take their caps, the
    others share the rest by weight. The windows hold one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = per_source.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_passes).alias("cap"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * total_share
    line = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    lines = weighted.withColumn("line", line).withColumn("ratio", F.col("cap") / F.col("weight"))
    # the first source that is not filled to its cap sets the water line for all after it
    water = F.min(F.when(F.col("line") <= F.col("ratio"), F.struct("ratio", "line"))).over(Window.partitionBy())["line"]
    target = F.when(water.isNull() | (water * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(water * F.col("weight"))
    return lines.select("source", "source_size", "weight", target.alias("target"))


def with_base(rows: DataFrame, keys: list[str], at: str, value: str, size: int, fan: int = FAN) -> DataFrame:
    """Add ``base``, the sum of ``value`` over rows of equal keys with smaller ``at``, a whole number below ``size``, to rows that are one for each keys and ``at``."""
    if size <= fan:
        before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("base", F.coalesce(F.sum(value).over(before), F.lit(0).cast("long")))
    up, total = f"{at}_up", f"{value}_up"
    raised = rows.withColumn(up, F.floor(F.col(at) / fan))
    sums = with_base(raised.groupBy(*keys, up).agg(F.sum(value).alias(total)), keys, up, total, -(-size // fan), fan)
    named = sums.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col(up).alias("_up"), F.col("base").alias("_base"))
    same = F.col(up) == F.col("_up")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_{i}"))
    before = Window.partitionBy(*keys, up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("_base") + F.coalesce(F.sum(value).over(before), F.lit(0).cast("long"))
    return raised.join(named, same).withColumn("base", base).drop(up, "_up", "_base", *(f"_{i}" for i in range(len(keys))))


def unfolded(rows: DataFrame, times: str, part: int = FAN) -> DataFrame:
    """Each row ``times`` times over, with its number in ``copy_no``; long runs are unfolded in parts dealt over tasks."""
    number = lambda first, n: F.explode(F.sequence(first, first + n - 1))
    zero = F.lit(0).cast("long")
    few = rows.filter(F.col(times) <= part).withColumn("copy_no", number(zero, F.col(times)))
    parts = rows.filter(F.col(times) > part).withColumn("_first", F.explode(F.sequence(zero, F.col(times) - 1, F.lit(part).cast("long")))).repartition("place", "_first")
    many = parts.withColumn("copy_no", number(F.col("_first"), F.least(F.lit(part).cast("long"), F.col(times) - F.col("_first")))).drop("_first")
    return few.unionByName(many)


def placed(sizes: DataFrame, rows: int) -> DataFrame:
    """Add ``start``, where each row begins in its source's shuffled stream of words.

    The order is that of an md5 over id, source and text; its first hex digits are the bucket.
    """
    digits = max(0, math.ceil(math.log(max(rows / BUCKET_ROWS, 1e-9), 16)))
    bucket = F.conv(F.substring("place", 1, digits), 16, 10).cast("long") if digits else F.lit(0).cast("long")
    once = sizes.groupBy("source", "place", "doc_id", "size", "tie").agg(F.count("*").alias("times")).withColumn("bucket", bucket)
    totals = once.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("times")).alias("bucket_size"))
    bases = with_base(totals, ["source"], "bucket", "bucket_size", 16**digits).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    local = once.withColumn("local", F.coalesce(F.sum(F.col("size") * F.col("times")).over(within), F.lit(0).cast("long")))
    joined = local.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b", "bucket")
    start = F.col("base") + F.col("local") + F.col("copy_no") * F.col("size")
    return unfolded(joined, "times").withColumn("start", start).drop("base", "local", "copy_no", "times")


def golden_points(slot: Column, step: int = GOLDEN) -> Column:
    """(slot + 1) * step modulo 2**BITS, in two halves that stay below 2**63."""
    v, half = slot + 1, 1 << (BITS // 2)
    low, high = v.bitwiseAND(F.lit(half - 1).cast("long")), F.shiftright(v, BITS // 2)
    return F.pmod(low * F.lit(step) + F.pmod(high * F.lit(step), F.lit(half)) * F.lit(half), F.lit(1 << BITS))


def van_der_corput_points(slot: Column) -> Column:
    """The slot's bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), BITS, "0")), 2, 10).cast("long")


#: Points of a slot, and how many times as many slots as blocks give every source its ranks.
SEQUENCES = {"golden": (golden_points, 2), "van_der_corput": (van_der_corput_points, 4)}


def schedule(targets: DataFrame, block: int, sequence: str = "golden") -> DataFrame:
    """(source, slot, rank, begin, end, source_size): what each slot of the mix takes.

    Slot points meet the sources' intervals in an equi-join on a grid of cells, of which
    there are at least four times as many as sources.
    """
    spark, part = targets.sparkSession, 65_536
    point, spare = SEQUENCES[sequence]
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)  # one row per source
    shares = targets.filter("target >= 1").select("source", "source_size", F.floor("target").alias("want"), F.ceil(F.floor("target") / block).alias("slots"))
    shares = persist(shares.withColumn("upto", F.sum("slots").over(upto)))
    known = shares.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("slots"), F.count("*").alias("sources")).first()
    length = spare * known["slots"] + 16
    edge = lambda c: F.floor(c.cast("double") / max(1, known["slots"]) * 2**BITS)
    shift = BITS - max(10, known["sources"].bit_length() + 2)
    bounds = shares.select("source", "source_size", "want", "slots", edge(F.col("upto") - F.col("slots")).alias("low"), edge(F.col("upto")).alias("high"))
    spread = bounds.withColumn("cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
    points = spark.range(length if known["slots"] else 0).select(F.col("id").alias("slot"), point(F.col("id")).alias("point")).withColumn("cell", F.shiftright("point", shift))
    hits = points.join(spread, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    hits = hits.select("source", "source_size", "want", "slots", "slot", F.floor(F.col("slot") / part).alias("part"))
    bases = with_base(hits.groupBy("source", "part").agg(F.count("*").alias("n")), ["source"], "part", "n", -(-length // part))
    bases = bases.select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    local = hits.withColumn("local", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1)
    ranked = local.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("base") + F.col("local"))
    begin = F.col("rank") * block
    return ranked.filter("rank < slots").select("source", "slot", "rank", begin.alias("begin"), F.least(begin + block, F.col("want")).alias("end"), "source_size")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total_share: float = 1.5, max_passes: int = 2, block: int = 1024, sequence: str = "golden") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, slots): placed documents, targets by source and the schedule."""
    whole = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    sizes = persist(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(whole).alias("place"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("tie"),
    ))
    targets = persist(source_targets(sizes, weights, total_share, max_passes))
    return placed(sizes, sizes.count()), targets, schedule(targets, block, sequence)


def taken_passes(rows: DataFrame, targets: DataFrame, slots: DataFrame, block: int, max_passes: int = 2) -> DataFrame:
    """The words that slots take from each document (of words) in each pass, with the first such slot.

    A document meets the blocks that its span covers; slots join them by source and block rank.
    """
    named = targets.select(F.col("source").alias("s"), F.col("source_size").alias("total"), F.floor("target").alias("want"))
    sized = rows.filter("size > 0").join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = sized.withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_passes - 1).cast("long"))))
    spans = passes.withColumn("from", F.col("start") + F.col("pass_no") * F.col("total")).withColumn("to", F.col("from") + F.col("size"))
    last = F.floor((F.least("to", "want") - 1) / block)
    pieces = spans.filter("`from` < want").withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), last)))
    takes = slots.select(F.col("source").alias("s"), F.col("rank").alias("r"), "slot", "begin", "end")
    met = pieces.join(takes, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")))
    words = F.least("to", "end") - F.greatest("from", "begin")
    return met.groupBy("source", "place", "start", "doc_id", "tie", "size", "pass_no").agg(F.sum(words).alias("words"), F.min("slot").alias("slot"))


def mix_report(docs: DataFrame, block: int = 1024, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and first_slot (null if nothing is taken) for every document."""
    rows, targets, slots = mix_plan(docs, block=block, **options)
    rows = persist(rows)
    passes = taken_passes(rows, targets, slots, block, options.get("max_passes", 2))
    got = passes.groupBy("source", "place", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    got = got.select(F.col("source").alias("s"), F.col("place").alias("p"), F.col("start").alias("at"), "taken", "first_slot")
    # a document without words shares its start with the next one, but not its place
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")) & (F.col("start") == F.col("at"))
    taken = rows.join(got, same, "left").drop("s", "p", "at")
    named = targets.select(F.col("source").alias("s"), "source_size", "target")
    out = taken.join(named, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 1024, max_passes: int = 2, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, rounded to whole documents, in the order of the schedule.

    A document is copied once for each pass in which slots take at least half of its words;
    the copy stands where the first of them does. Documents without words come first, once.
    """
    rows, targets, slots = mix_plan(docs, id_col, text_col, source_col, block=block, max_passes=max_passes, **options)
    rows = persist(rows)
    passes = taken_passes(rows, targets, slots, block, max_passes)
    key = ["doc_id", "tie", "source"]
    chosen = F.col("words") * 2 >= F.col("size")
    of_pass = lambda i: F.min(F.when(chosen & (F.col("pass_no") == i), F.col("slot"))).alias(f"slot_{i}")
    copies = passes.groupBy(*key).agg(F.count(F.when(chosen, 1)).alias("copies"), *(of_pass(i) for i in range(max_passes)))
    empty = rows.filter("size = 0").groupBy(*key).agg(F.count("*").alias("rows"))
    whole = rows.filter("size > 0").groupBy(*key).agg(F.count("*").alias("rows"))
    names = [F.col(f"k_{c}").eqNullSafe(F.col(c)) for c in key]
    counted = copies.join(whole.select(*(F.col(c).alias(f"k_{c}") for c in key), "rows"), names)
    # equal rows share their copies: each gets the rounded-up share
    times = F.ceil(F.col("copies") / F.col("rows")).cast("int")
    at = F.slice(F.array_compact(F.array(*(f"slot_{i}" for i in range(max_passes)))), F.lit(1), times)
    marks = counted.filter("copies > 0").select(*key, at.alias("slots")).unionByName(empty.select(*key, F.array(F.lit(-1).cast("long")).alias("slots")))
    tie, slot = unused(docs, "_tie"), unused(docs, "_slot")
    keyed = docs.withColumn(tie, F.coalesce(F.xxhash64(text_col), F.lit(0)))
    cond = F.col(f"_d.{id_col}").eqNullSafe(F.col("_c.doc_id")) & F.col(f"_d.{source_col}").eqNullSafe(F.col("_c.source")) & (F.col(f"_d.{tie}") == F.col("_c.tie"))
    joined = keyed.alias("_d").join(marks.alias("_c"), cond)
    out = joined.select(*(F.col(f"_d.`{c}`") for c in docs.columns), F.explode("_c.slots").alias(slot))
    return out.repartitionByRange(slot).sortWithinPartitions(slot).drop(slot)
