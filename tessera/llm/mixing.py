"""Temperature mixing of sources under a token budget, in DataFrame functions only.

A source with token share p gets weight p**a / sum(p**a). Lower exponents even the sources out and repeat small ones
more. The exponent is bisected to the greatest one whose weights reach the target entropy (a part of the logarithm of
the number of sources); if some source would then be repeated more often than the limit, it is bisected up to the least
exponent that keeps the limit. Each source gets floor(weight * budget) tokens. They are dealt out in epochs: documents
fall into blocks by a hash, an epoch is a hashed permutation of the blocks with a hashed order inside each, whole epochs
take every document, and the last one takes whole blocks in order up to the budget and documents of the block where it
ends. Only per-source and per-block totals are ever ordered together, never the rows of a source.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and come along in whole epochs
and free of charge; repeated rows of one doc_id are taken or left together; a table without tokens gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.staging import staged

TARGET_ENTROPY, MAX_REPEATS, STEPS = 0.98, 4.0, 40
BLOCK_DOCS, SEED = 256, 17
DEPTH = 5  # halvings of the exponent in one job
SPAN_BITS = 12  # a source's blocks are ordered in 4,096 ranges of the hash


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, as any SQL engine can compute them."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def source_tokens(rows: DataFrame) -> tuple[DataFrame, int]:
    """source, tokens, docs and each source's share of all tokens, and their number."""
    sums = staged(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    total = int(sums.agg(F.sum("tokens")).first()[0] or 0)
    return sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))), total


def _power(exponent: float) -> Column:
    return F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)


def bisected(shares: DataFrame, budget: int, target_entropy: float, max_repeats: float) -> float:
    """The exponent. A job evaluates all midpoints that the next few halvings can meet, over the per-source table."""

    def at(exponents: list[float]) -> dict[float, tuple[float, float]]:
        power = F.when(F.col("share") > 0, F.pow("share", F.col("exponent"))).otherwise(0.0)
        sums = shares.withColumn("exponent", F.explode(F.array(*map(F.lit, exponents)))).groupBy("exponent").agg(
            F.sum(power).alias("z"), F.sum(F.when(power > 0, power * F.ln(power)).otherwise(0.0)).alias("zl"), F.max(F.when(F.col("tokens") > 0, power / F.col("tokens"))).alias("most")
        )
        return {r["exponent"]: (math.log(r["z"]) - r["zl"] / r["z"], r["most"] * budget / r["z"]) for r in sums.collect()}

    def midpoints(low: float, high: float, depth: int) -> list[float]:
        mid = (low + high) / 2
        return [mid, *midpoints(low, mid, depth - 1), *midpoints(mid, high, depth - 1)] if depth else []

    def halved(low: float, high: float, right: Callable[[tuple[float, float]], bool]) -> tuple[float, float]:
        """The interval after STEPS halvings; right tells from the figures at a midpoint whether its right half is next."""
        for first in range(0, STEPS, DEPTH):
            depth = min(DEPTH, STEPS - first)
            found = at(sorted(set(midpoints(low, high, depth))))
            for _ in range(depth):
                mid = (low + high) / 2
                low, high = (mid, high) if right(found[mid]) else (low, mid)
        return low, high

    if shares.filter("tokens > 0").limit(2).count() < 2:
        return 1.0
    goal = target_entropy * math.log(shares.filter("tokens > 0").count())
    exponent, whole = 1.0, at([1.0])[1.0]
    if whole[0] < goal:
        exponent, _ = halved(0.0, 1.0, lambda figures: figures[0] >= goal)
        whole = at([exponent])[exponent]
    if whole[1] > max_repeats:
        _, exponent = halved(exponent, 1.0, lambda figures: figures[1] > max_repeats)
    return exponent


def in_order(blocks: DataFrame) -> DataFrame:
    """blocks with block_rank and through, the tokens up to and with each block, in the hashed order of its source and epoch.

    Blocks fall into ranges of the hash. A range's blocks are ordered by themselves and start from the sums of the ranges
    before it, so that a task orders a range of a source's blocks, or the sums of its ranges, and never all of its blocks.
    """
    name = F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("block").cast("string"))
    keyed = blocks.withColumn("key", hashed(F.col("epoch").cast("string"), name)).withColumn("span", F.shiftright("key", 60 - SPAN_BITS))
    before = Window.partitionBy("source", "epoch").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = keyed.groupBy("source", "epoch", "span").agg(F.count("*").alias("n"), F.sum("in_block").alias("sum")).select(
        F.col("source").alias("s_source"), F.col("epoch").alias("s_epoch"), F.col("span").alias("s_span"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before")
    )
    order = Window.partitionBy("source", "epoch", "span").orderBy("key", "block")
    local = keyed.withColumns({"block_rank": F.row_number().over(order).cast("long"), "through": F.sum("in_block").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    both = local.join(spans, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("epoch") == F.col("s_epoch")) & (F.col("span") == F.col("s_span")))
    return both.withColumns({"block_rank": F.col("block_rank") + F.col("n_before"), "through": F.col("through") + F.col("sum_before")})


def mixture(docs: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per taken document and epoch: doc_id, source, epoch, block, block_rank, doc_rank_key, n_tokens.

    budget is in tokens and is the corpus size if not given. Reading order: epoch, block_rank, doc_rank_key.
    """
    rows = staged(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), token_count(F.col("text")).alias("n_tokens")), "tokens")
    shares, total = source_tokens(rows)
    budget = total if budget is None else budget
    exponent = bisected(shares, budget, target_entropy, max_repeats)

    norm = float(shares.agg(F.sum(_power(exponent))).first()[0] or 1.0)
    plan = shares.filter("tokens > 0").select(
        F.col("source").alias("p_source"), "tokens", F.floor(_power(exponent) / F.lit(norm) * F.lit(budget)).cast("long").alias("own"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long").alias("n_blocks"),
    )
    plan = plan.withColumns({"whole": F.expr("own div tokens"), "rest": F.col("own") % F.col("tokens")})
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", F.pmod(hashed(id_text), F.col("n_blocks")))

    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("epoch", F.explode(F.expr("sequence(0L, whole)")))
    blocks = in_order(blocks)
    left = F.when(F.col("epoch") < F.col("whole"), F.col("in_block")).otherwise(F.col("rest") - F.col("through") + F.col("in_block"))
    blocks = blocks.withColumn("room", left).filter("room > 0 or epoch < whole")
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "epoch", "block_rank", "in_block", "room")

    taken = placed.select("doc_id", "source", "block", "n_tokens").join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    taken = taken.withColumn("doc_rank_key", hashed(F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    inside = Window.partitionBy("source", "block", "epoch").orderBy("doc_rank_key").rangeBetween(Window.unboundedPreceding, 0)
    full, cut = taken.filter("room >= in_block"), taken.filter("room < in_block").withColumn("so_far", F.sum("n_tokens").over(inside)).filter("so_far <= room")
    out = ["doc_id", "source", "epoch", "block", "block_rank", "doc_rank_key", "n_tokens"]
    return full.select(*out).unionByName(cut.select(*out))
