"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i gets the point frac(i * golden ratio), in whole numbers modulo 2**32. The
points are mapped through the cumulative weights to sources, so any stretch of the
schedule has nearly the target mix. The r-th slot of a source holds the r-th block
of its shuffled documents, and starts over when the blocks are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.common import fresh, need, settled, word_count

BLOCK_TOKENS = 16_384
ALPHA, MAX_EPOCHS, SEED = 0.7, 4, 0
#: floor(2**32 / golden ratio), odd: its multiples modulo 2**32 are the points.
GOLDEN = 2_654_435_769
POINTS = 1 << 32
_CHUNK = 1 << 16


def _source(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\u0000"))


def _placed(docs: DataFrame, source: Column, doc_id: str, tokens: Column, block_tokens: int, seed: int, keep: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Rows with their place in their source's shuffled token stream; the sources with their blocks.

    Places are prefix sums in two levels, over the 4096 leading values of the shuffle key and within each, so no task holds a source.
    """
    names = dict(zip(("src", "n", "key", "cell", "start", "before"), fresh(docs, "src", "n", "key", "cell", "start", "before"), strict=True))
    src, n, key, cell, start, before = names.values()
    rows = docs.withColumns({src: source, n: tokens, key: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))}).withColumn(cell, F.substring(key, 1, 3))
    cells = settled(rows.groupBy(src, cell).agg(F.sum(n).alias(n)))
    sums = cells.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(src).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(src, cell, before)
    inner = Window.partitionBy(src, cell).orderBy(F.col(key), F.col(doc_id), F.col(n)).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(*(F.col(f"`{c}`") for c in keep), src, n, key, cell)
    placed = placed.withColumn(start, F.coalesce(F.sum(n).over(inner), F.lit(0))).join(sums, [src, cell]).withColumn(start, F.col(start) + F.col(before))
    sources = cells.groupBy(src).agg(F.sum(n).alias("tokens")).select(F.col(src).alias("src"), "tokens", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"))
    return placed, sources, names


def schedule(sources: DataFrame, weights: dict[str, float] | None, alpha: float, max_epochs: float) -> DataFrame:
    """(slot, src, epoch, block): the shortest schedule in which every block of every weighted source has a slot."""
    spark = sources.sparkSession
    if weights is None:
        most = Window.partitionBy(F.lit(0))
        weighted = sources.withColumn("w", F.col("blocks") * F.least(F.lit(float(max_epochs)), F.pow(F.max("blocks").over(most) / F.col("blocks"), F.lit(1.0 - alpha))))
    else:
        given = spark.createDataFrame([(k if k is not None else "\u0000", float(v)) for k, v in weights.items() if v > 0], "src string, w double")
        weighted = sources.join(given, "src")
    # Sources are few: one row each. Weights become whole numbers of points; the largest source takes up the rounding.
    one = Window.partitionBy(F.lit(0))
    weighted = weighted.select("src", "blocks", F.greatest(F.lit(1), F.floor(F.round(F.col("w") / F.sum("w").over(one), 9) * POINTS)).cast("long").alias("points"))
    weighted = weighted.withColumns({"all": F.sum("points").over(one), "size": F.row_number().over(one.orderBy(F.desc("points"), "src"))})
    weighted = weighted.select("src", "blocks", F.when(F.col("size") == 1, F.col("points") + POINTS - F.col("all")).otherwise(F.col("points")).alias("points"))
    weighted = settled(weighted.withColumn("hi", F.sum("points").over(one.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("points")))
    count, slots = weighted.agg(F.count("*"), F.max(F.ceil((F.col("blocks") + 8) * POINTS / F.col("points")))).first()
    if not count:
        return spark.createDataFrame([], "slot long, src string, epoch long, block long")
    while True:
        ranked = _ranked(weighted, int(slots), count <= 10_000)
        done, last = ranked.filter("rank = blocks - 1").agg(F.count("*"), F.max("slot")).first()
        if done == count:
            return ranked.filter(F.col("slot") <= last).select("slot", "src", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"))
        slots *= 2


def _ranked(weighted: DataFrame, slots: int, small: bool) -> DataFrame:
    """(slot, src, blocks, rank): the source of each slot and how many earlier slots it has, counted in two levels."""
    at = weighted.sparkSession.range(slots).select(F.col("id").alias("slot"), F.expr(f"cast((id + 1) * {GOLDEN} % {POINTS} as long)").alias("u"))
    drawn = at.join(F.broadcast(weighted) if small else weighted, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "src", "blocks")
    drawn = settled(drawn.withColumn("chunk", F.expr(f"slot div {_CHUNK}")))
    chunks = drawn.groupBy("src", "chunk").count()
    chunks = chunks.select("src", "chunk", F.coalesce(F.sum("count").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1).join(chunks, ["src", "chunk"])
    return settled(ranked.select("slot", "src", "blocks", (F.col("rank") + F.col("before")).cast("long").alias("rank")))


def mix_schedule(docs: DataFrame, weights: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(slot, source, epoch, block, doc_id, start, length): which tokens of which documents fill each slot.

    A source's documents are shuffled by the MD5 of seed and id, and their token stream is cut into blocks of
    ``block_tokens``; only its last block can be shorter. ``weights`` are target shares of slots; sources that it lacks
    are left out. Without it a source's weight is its number of blocks times its repeats: (largest / own) ** (1 - alpha),
    at most ``max_epochs``, with sizes in blocks. The schedule ends when every block has had a slot, so no text is lost.

    A null source is a source of its own. Null and empty texts have no tokens: they ride in the block at their place
    with length 0. Ties of the shuffle go by id, null first, then by length; repeated rows each have a place. An empty
    table gives an empty schedule. Very long documents run over as many blocks as they need. Extra columns are not read.
    """
    need(docs, text, doc_id, source)
    # Without the texts the rows are narrow, so their words are counted once, for sums and places alike.
    rows = settled(docs.select(F.col(doc_id).alias("doc_id"), _source(source).alias("s"), word_count(text).alias("n")))
    placed, sources, names = _placed(rows, F.col("s"), "doc_id", F.col("n"), block_tokens, seed, ["doc_id"])
    src, n, start = names["src"], names["n"], names["start"]
    sources = settled(sources)
    slots = schedule(sources, weights, alpha, max_epochs)
    pieces = placed.join(sources.select(F.col("src").alias(src), "blocks"), src).select("doc_id", F.col(src).alias("src"), F.col(n).alias("n"), F.col(start).alias("at"), "blocks")
    first, last = F.least(F.expr(f"at div {block_tokens}"), F.col("blocks") - 1), F.expr(f"case when n = 0 then null else (at + n - 1) div {block_tokens} end")
    pieces = pieces.withColumn("block", F.explode(F.sequence(first, F.coalesce(last, first))))
    lo = F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("at"))
    hi = F.least(F.col("n"), (F.col("block") + 1) * block_tokens - F.col("at"))
    pieces = pieces.select("src", "block", "doc_id", F.least(lo, F.col("n")).alias("start"), F.greatest(F.lit(0), hi - lo).alias("length"))
    out = slots.join(pieces, ["src", "block"])
    return out.select("slot", F.when(F.col("src") != "\u0000", F.col("src")).alias("source"), "epoch", "block", "doc_id", "start", "length")


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs``, each row as often as the block that its text begins in has slots under ``mix_schedule``; every weighted source keeps all its rows.

    Whole documents are taken, so a document that runs over several blocks goes with its first. The columns are those of
    ``docs``; the cases of null, empty, long and repeated rows are those of ``mix_schedule``.
    """
    need(docs, text, doc_id, source)
    placed, sources, names = _placed(docs, _source(source), doc_id, word_count(text), block_tokens, seed, docs.columns)
    sources = settled(sources)
    times = schedule(sources, weights, alpha, max_epochs).groupBy("src", "block").count()
    src, start = names["src"], names["start"]
    blocks, block, count = fresh(docs.select("*", *(F.lit(0).alias(x) for x in names.values())), "blocks", "block", "count")
    placed = placed.join(sources.select(F.col("src").alias(src), F.col("blocks").alias(blocks)), src)
    placed = placed.withColumn(block, F.least(F.expr(f"`{start}` div {block_tokens}"), F.col(blocks) - 1))
    out = placed.join(times.select(F.col("src").alias(src), F.col("block").alias(block), F.col("count").alias(count)), [src, block])
    return out.withColumn(count, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).select(*(F.col(f"`{c}`") for c in docs.columns))
