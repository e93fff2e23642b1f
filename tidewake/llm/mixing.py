"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

A source with target t is due t / B blocks of B words.  Sainte-Laguë awards
blocks one by one to the source with the highest quotient t / (2q + 1), q being
its awards so far.  Stopped at the quotient 2B, each source has t / B rounded
half up, so quotas have a closed form; and the award with number q comes at
the part (q + 1/2) B / t of the whole, which gives the quota of every shard.

Each source's rows lie in seeded order on a ring of its words, which is cut into
blocks; even stretches of blocks are its shards.  A shard takes each of its
blocks as often as its quota goes round, and of the rest the blocks from a
seeded one on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import n_words, settled

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
#: A block is a power of two of words, at most MOST_BLOCK and a 64th of the smallest target.
MOST_BLOCK, BLOCKS_LEAST = 1024, 64
#: A source has so many shards, or fewer of so many blocks.
SHARDS, SHARD_BLOCKS = 16, 64
#: Each source's ring is summed up in so many arcs, or in more, of about ARC_ROWS rows of all sources.
ARCS, ARC_ROWS = 1024, 1 << 15
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, weight, target) from sizes(source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn.  Targets
    share ``share`` of all words by weight; none is above MOST_REPEATS times its
    source, and what is over goes to the others by weight.  With sources in the
    order of their limit by weight, those before the first that stays below its
    limit are full.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    given = F.array(*[F.lit(float(w)) for w in weights])
    one = total.withColumn("no", place).withColumn("weight", F.get(given, F.col("no") % len(weights)))
    limit = F.col("source_size") * float(MOST_REPEATS)
    before = Window.orderBy(F.col("limit") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    one = one.withColumn("limit", limit).withColumn("all_words", F.sum("source_size").over(everything) * share).withColumn("all_weight", F.sum("weight").over(everything))
    level = (F.col("all_words") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    two = one.withColumn("full", F.col("limit") <= F.col("weight") * level)
    rest = F.col("all_words") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * rest / open_weight))
    return two.select("no", "source", "source_size", "weight", target.alias("target"))


def quotas(targets: DataFrame, shards: int = SHARDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``targets`` with block, blocks (of the source), quota (blocks to take), shard_starts and shard_quotas.

    Shard k begins with block shard_starts[k]; its quota is what Sainte-Laguë
    awards on the shard's part of the way, at most MOST_REPEATS times its
    blocks.  The shards' quotas add up to the source's.
    """
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy(F.lit(0)))
    fit = F.floor(F.log2(F.coalesce(least, F.lit(1.0)) / BLOCKS_LEAST))
    block = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.pow(F.lit(2.0), fit))).cast("long")
    with_block = targets.withColumn("block", block).withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / F.col("block")), F.lit(1)).cast("long"))
    with_block = with_block.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(shards), F.floor(F.col("blocks") / shard_blocks))).cast("int"))
    due = F.least(F.col("target") / F.col("block"), F.col("blocks") * float(MOST_REPEATS))

    def start(k: Column) -> Column:
        return F.floor(F.col("blocks") * k / F.col("shards")).cast("long")

    def awarded(k: Column) -> Column:
        return F.floor(due * start(k) / F.col("blocks") + 0.5).cast("long")

    of_shards = F.sequence(F.lit(0), F.col("shards") - 1)
    per_shard = F.transform(of_shards, lambda k: awarded(k + 1) - awarded(k))
    return with_block.withColumn("quota", awarded(F.col("shards"))).withColumn("shard_starts", F.transform(of_shards, start)).withColumn("shard_quotas", per_shard)


def _rows(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    size = n_words(F.col(text_col))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"))


def block_times(j: Column, seed: int) -> Column:
    """How often block ``j`` of a source is taken."""
    shards = F.col("shards")
    k = F.floor((j * shards + shards - 1) / F.col("blocks")).cast("int")  # the last shard that begins at j or before
    first, after = F.get("shard_starts", k), F.coalesce(F.get("shard_starts", k + 1), F.col("blocks"))
    n, quota = after - first, F.get("shard_quotas", k)
    place = F.pmod(j - first - F.pmod(F.xxhash64(F.lit(seed), F.col("no"), k), n), n)
    return F.floor(quota / n) + (place < F.pmod(quota, n)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: row, id, size, source_size, target, taken and its pieces.

    ``pieces`` is an array of (pass, first, last): words ``first`` up to but
    not including ``last``, once for every run of blocks taken that covers
    them.  ``taken`` is their total.

    Null text has size 0 and gives no piece; null source is a source of its own,
    null ids are ordered like any id.  Repeated rows are rows of their own with
    places side by side.  Without rows, or without words, all is empty.
    Columns other than id, text and ``source`` are not read.
    """
    rows = settled(_rows(docs, id_col, text_col, seed))
    arcs_of_ring = max(ARCS, rows.count() // ARC_ROWS)
    plan = settled(quotas(source_targets(rows.select("source", "size")))).withColumnRenamed("source", "__source")
    rows = rows.join(plan.select("__source", "no"), F.col("source").eqNullSafe(F.col("__source"))).select("row", "id", "no", "size", "key", F.pmod("key", F.lit(arcs_of_ring)).alias("arc"))
    arcs = rows.groupBy("no", "arc").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("no").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    arcs = arcs.select("no", "arc", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("arc_at"))
    inside = Window.partitionBy("no", "arc").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_arc", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(arcs, ["no", "arc"]).withColumn("at", F.col("arc_at") + F.col("in_arc"))
    placed = placed.join(plan.drop("__source", "weight", "quota"), "no")
    at, b, end = F.col("at"), F.col("block"), F.col("at") + F.col("size")
    covered = F.when(F.col("size") > 0, F.sequence(F.floor(at / b).cast("long"), F.floor((end - 1) / b).cast("long"))).otherwise(F.array().cast("array<long>"))
    placed = placed.withColumn("__blocks", F.transform(covered, lambda j: F.struct(j.alias("j"), block_times(j, seed).alias("times"))))
    pass_type = "array<struct<pass:int,first:bigint,last:bigint>>"

    def pieces(k: int) -> Column:
        """Runs of blocks taken more than k times, within the row."""

        def step(runs: Column, x: Column) -> Column:
            first, last = F.greatest(x["j"] * b, at) - at, F.least((x["j"] + 1) * b, end) - at
            open_run = F.element_at(runs, -1)
            goes_on = (F.size(runs) > 0) & (open_run["last"] == first)
            longer = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(F.lit(k).alias("pass"), open_run["first"].alias("first"), last.cast("long").alias("last"))))
            another = F.concat(runs, F.array(F.struct(F.lit(k).alias("pass"), first.cast("long").alias("first"), last.cast("long").alias("last"))))
            return F.when(x["times"] <= k, runs).when(goes_on, longer.cast(pass_type)).otherwise(another.cast(pass_type))

        return F.aggregate("__blocks", F.array().cast(pass_type), step)

    found = placed.withColumn("pieces", F.concat(*[pieces(k) for k in range(MOST_REPEATS)]))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["last"] - p["first"])
    return found.select("row", "id", "size", "source_size", "target", taken.alias("taken"), "pieces")


WORD_EDGE = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: ``docs``, all columns, with a row for every piece taken.

    A row taken whole is unchanged and stands once or twice; of one that a cut
    falls in, the words taken stay, with the white space between them, and
    ``n_chars``, if there, is counted anew.  A row without words is not in the
    mix.  ``docs`` is read twice and must give its rows in the same
    partitions both times, as a Parquet table does.
    """
    pieces = mix(docs, id_col, text_col, seed).select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.explode("pieces").alias("__piece"))
    wide = docs.withColumn("__row", F.monotonically_increasing_id())
    first, last = F.col("__piece.first"), F.col("__piece.last")
    text = F.col(text_col)
    part = F.array_join(F.slice(F.split(F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")), WORD_EDGE), (first + 1).cast("int"), (last - first).cast("int")), "")
    whole = (first == 0) & (last == F.col("__size"))
    out = wide.join(pieces, "__row").withColumn("__text", F.when(whole, text).otherwise(F.rtrim(part, F.lit(" \t\n\x0b\x0c\r"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn(text_col, F.col("__text")).select(*docs.columns)
