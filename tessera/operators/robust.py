"""Bounded reweighting: how far weights within a factor of gamma can move a mean gain.

The optimum of a ratio of weighted sums is a threshold rule, so that extremes are found exactly by running sums in the
order of gain, over one row per distinct gain. Resamples of groups with many distinct gains never meet their rows: blocks
are summed up by bins of gain, draws combine these sums, and the sign of the weighted distance to a bin's edge tells
which bin holds the optimum. Only bins that hold one for some draw are cut up further, until few gains are left in them.

Rows without weight are ignored. A group with a gain that is not finite has no extremes and no radius: NaN exceeds every
number in comparisons, so it must never get that far. Its mean is minus infinity, its bounds are null, its status is
unavailable, and as member of a family it makes the whole unavailable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.resample import counter_draw
from tessera.operators.scan import running


FINITE = "abs(gain) < double('inf')"  # false for NaN too, which counts as greater


def endless_groups(rows: DataFrame) -> DataFrame:
    """grp of the groups with a gain that is not finite on a row of positive weight."""
    return rows.filter(f"w > 0 and not coalesce({FINITE}, false)").select("grp").distinct()


def _prefixes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct gains with running and total sums per key, of groups whose gains are all finite."""
    rows = rows.filter("w > 0").join(F.broadcast(endless_groups(rows)), "grp", "left_anti")
    cells = rows.groupBy(*keys, "gain").agg(F.sum("w").alias("w")).filter("w > 0")
    x = F.col("w") * F.col("gain")
    if keys == ["grp"]:  # a group may have any number of gains
        sums = cells.groupBy("grp").agg(F.sum(x).alias("sn"), F.sum("w").alias("sw"))
        return running(cells, keys, ["gain"], {"pn": ("sum", x), "pw": ("sum", F.col("w"))}).drop("w").join(sums, "grp")
    order = Window.partitionBy(*keys).orderBy("gain").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return cells.select(*keys, "gain", F.sum(x).over(order).alias("pn"), F.sum("w").over(order).alias("pw"), F.sum(x).over(whole).alias("sn"), F.sum("w").over(whole).alias("sw"))


def _with_endless(found: DataFrame, rows: DataFrame, **values: object) -> DataFrame:
    """found with a row for each group that has none for want of finite gains; values: what its columns say, null where not given."""
    out = endless_groups(rows).select(*[F.col("grp") if c == "grp" else F.lit(values.get(c)).cast(found.schema[c].dataType).alias(c) for c in found.columns])
    return found.unionByName(out)


def extremes(rows: DataFrame, gamma: float) -> DataFrame:
    """grp, gain, w -> per group: mean, least and greatest mean with weights multiplied by factors in [1/gamma, gamma]."""
    return _with_endless(_extremes(_prefixes(rows, ["grp"]), gamma, ["grp"]), rows, mean=float("-inf"))


def _extremes(p: DataFrame, gamma: float, keys: list[str]) -> DataFrame:
    g, i = gamma, 1 / gamma
    shifted = lambda a, b: (a * F.col("pn") + b * (F.col("sn") - F.col("pn"))) / (a * F.col("pw") + b * (F.col("sw") - F.col("pw")))
    return p.groupBy(*keys).agg((F.first("sn") / F.first("sw")).alias("mean"), F.min(shifted(g, i)).alias("least"), F.max(shifted(i, g)).alias("greatest"))


def critical_gamma(rows: DataFrame, limit: float = 100.0) -> DataFrame:
    """Per group: the least gamma at which the worst mean gain is no longer positive, and status.

    finite; not_positive (1: it isn't at once); beyond_limit (null); unavailable (null).
    """
    p = _prefixes(rows, ["grp"])
    # gamma^2 P + (S - P) = 0 for the prefix sum P of the lowest gains
    need = F.when((F.col("pn") < 0) & (F.col("sn") > 0), F.sqrt((F.col("sn") - F.col("pn")) / -F.col("pn")))
    out = p.groupBy("grp").agg(F.first("sn").alias("sn"), F.min(need).alias("gamma"))
    status = F.when(F.col("sn") <= 0, "not_positive").when(F.col("gamma") <= limit, "finite").otherwise("beyond_limit")
    out = out.select("grp", F.when(F.col("sn") <= 0, 1.0).when(F.col("gamma") <= limit, F.col("gamma")).alias("critical_gamma"), status.alias("status"))
    return _with_endless(out, rows, status="unavailable")


#: Distinct gains of a group up to which its resamples hold them all; bins at each step beyond.
DISTINCT, BINS = 4096, 64


def _picks(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """grp, draw, block, times of each resample of blocks."""
    blocks = rows.select("grp", "block").distinct().withColumns({"idx": F.row_number().over(Window.partitionBy("grp").orderBy("block")) - 1, "n_blocks": F.count("*").over(Window.partitionBy("grp"))})
    slots = blocks.select("grp", "n_blocks", F.col("idx").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picks = slots.select("grp", "draw", counter_draw(F.col("n_blocks"), str(seed), F.col("grp"), F.col("draw"), F.col("slot")).alias("idx")).groupBy("grp", "draw", "idx").agg(F.count("*").alias("times"))
    return picks.join(blocks.select("grp", "idx", "block"), ["grp", "idx"]).select("grp", "draw", "block", "times")


def _sound(rows: DataFrame) -> DataFrame:
    """Cells (grp, block, gain, w) of the groups whose gains are all finite."""
    rows = rows.filter("w > 0").join(F.broadcast(endless_groups(rows)), "grp", "left_anti")
    return rows.groupBy("grp", "block", "gain").agg(F.sum("w").alias("w"))


def _few(rows: DataFrame) -> bool:
    """Whether no group has more distinct gains than resamples should hold."""
    return (rows.groupBy("grp").agg(F.approx_count_distinct("gain").alias("n")).agg(F.max("n")).first()[0] or 0) <= DISTINCT


def _drawn_prefixes(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """Running sums of each resample of blocks; they hold for every gamma."""
    cells = _sound(rows)
    chosen = _picks(cells, draws, seed).join(cells, ["grp", "block"]).select("grp", "draw", "gain", (F.col("w") * F.col("times")).alias("w"))
    return _prefixes(chosen, ["grp", "draw"])


def _binned_extremes(rows: DataFrame, draws: int, seed: int, gamma: float) -> DataFrame:
    """grp, draw, least, greatest of each resample, as _extremes of _drawn_prefixes gives them, from sums of bins.

    The greatest mean is the least one of the negated gains, which are searched along (side -1). For the least, gains up
    to a threshold weigh gamma and the rest its inverse; the optimum m is where the weighted distances to it cancel out.
    """
    g, i = gamma, 1 / gamma
    plain = _sound(rows)
    picks = cut(_picks(plain, draws, seed))
    sides = F.explode(F.array(F.lit(1), F.lit(-1)))
    cells = cut(plain.select("grp", "block", sides.alias("side"), "gain", "w").select("grp", "block", "side", (F.col("gain") * F.col("side")).alias("x"), "w", F.lit("").alias("path")))
    totals = cells.groupBy("grp", "block", "side").agg(F.sum(F.col("w") * F.col("x")).alias("bx"), F.sum("w").alias("bw"))
    drawn = picks.join(totals, ["grp", "block"]).groupBy("grp", "draw", "side").agg(F.sum(F.col("times") * F.col("bx")).alias("sn"), F.sum(F.col("times") * F.col("bw")).alias("sw"))
    open_ = cut(drawn.select("*", F.lit("").alias("path"), F.lit(0.0).alias("pn"), F.lit(0.0).alias("pw")))
    at = ["grp", "side", "path"]
    while True:
        hit = open_.select(*at).distinct()
        cells = cells.join(F.broadcast(hit), at, "left_semi")
        if not cells.groupBy(*at).agg(F.countDistinct("x").alias("n")).filter(F.col("n") > DISTINCT).limit(1).count():
            break
        shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
        # over distinct gains: however often one of them occurs, bins get smaller
        edges = cells.select(*at, "x").distinct().groupBy(*at).agg(F.array_sort(F.array_distinct(F.concat(F.percentile_approx("x", shares, 10_000), F.array(F.max("x"))))).alias("edges"))
        cells = cut(cells.join(F.broadcast(edges), at).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("x")))).withColumn("edge", F.get("edges", F.col("bin"))).drop("edges"))
        sums = cells.groupBy(*at, "block", "bin", "edge").agg(F.sum(F.col("w") * F.col("x")).alias("bx"), F.sum("w").alias("bw"))
        by_bin = picks.join(sums, ["grp", "block"]).join(open_.select("grp", "draw", "side", "path"), ["grp", "draw", "side", "path"])
        by_bin = by_bin.groupBy("grp", "draw", "side", "path", "bin", "edge").agg(F.sum(F.col("times") * F.col("bx")).alias("bx"), F.sum(F.col("times") * F.col("bw")).alias("bw"))
        # bins in which a draw has no rows count too: the edge may lie there
        frame = open_.join(sums.select(*at, "bin", "edge").distinct(), at).join(by_bin, ["grp", "draw", "side", "path", "bin", "edge"], "left").na.fill(0.0, ["bx", "bw"])
        upto = Window.partitionBy("grp", "draw", "side").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows
        frame = frame.withColumns({"qn": F.col("pn") + F.sum("bx").over(upto), "qw": F.col("pw") + F.sum("bw").over(upto)})
        gap = g * (F.col("qn") - F.col("edge") * F.col("qw")) + i * (F.col("sn") - F.col("qn") - F.col("edge") * (F.col("sw") - F.col("qw")))
        last = F.max("bin").over(Window.partitionBy("grp", "draw", "side"))
        place = F.row_number().over(Window.partitionBy("grp", "draw", "side").orderBy("bin"))
        found = frame.withColumn("last", last).filter((gap <= 0) | (F.col("bin") == F.col("last"))).withColumn("place", place).filter("place = 1")
        open_ = cut(found.select("grp", "draw", "side", "sn", "sw", F.concat_ws("/", "path", F.col("bin").cast("string")).alias("path"), (F.col("qn") - F.col("bx")).alias("pn"), (F.col("qw") - F.col("bw")).alias("pw")))
        cells = cells.withColumn("path", F.concat_ws("/", "path", F.col("bin").cast("string"))).drop("bin", "edge")
    inner = open_.join(picks, ["grp", "draw"]).join(cells, ["grp", "side", "path", "block"]).groupBy("grp", "draw", "side", "pn", "pw", "sn", "sw", "x").agg(F.sum(F.col("w") * F.col("times")).alias("w"))
    upto = Window.partitionBy("grp", "draw", "side").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # DISTINCT rows at most
    qn, qw = F.col("pn") + F.sum(F.col("w") * F.col("x")).over(upto), F.col("pw") + F.sum("w").over(upto)
    at_cut = (g * qn + i * (F.col("sn") - qn)) / (g * qw + i * (F.col("sw") - qw))
    before = (g * F.col("pn") + i * (F.col("sn") - F.col("pn"))) / (g * F.col("pw") + i * (F.col("sw") - F.col("pw")))
    cuts = inner.select("grp", "draw", "side", at_cut.alias("m")).unionByName(open_.select("grp", "draw", "side", before.alias("m")))
    ends = cuts.groupBy("grp", "draw").agg(F.min(F.when(F.col("side") == 1, F.col("m"))).alias("least"), (-F.min(F.when(F.col("side") == -1, F.col("m")))).alias("greatest"))
    return ends


def joint_extremes(rows: DataFrame, gamma: float, draws: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Block resampling and reweighting together: per group, percentiles of the extreme means over draws.

    rows: grp, block, gain, w. Each draw takes blocks with their multiplicities; a block's rows come with its multiplicity.
    Groups with gains that are not finite have no bounds and no draws.
    """
    return _with_endless(_bounds(_resamples(rows, draws, seed), gamma, alpha), rows, n_draws=0)


def _resamples(rows: DataFrame, draws: int, seed: int) -> Callable[[float], DataFrame]:
    """What gives the extremes of each resample (grp, draw, least, greatest) at a gamma."""
    if not _few(rows):
        return lambda gamma: _binned_extremes(rows, draws, seed, gamma)
    prefixes = _drawn_prefixes(rows, draws, seed).cache()  # groups x draws x a bounded number of gains
    return lambda gamma: _extremes(prefixes, gamma, ["grp", "draw"])


def _bounds(resamples: Callable[[float], DataFrame], gamma: float, alpha: float) -> DataFrame:
    return resamples(gamma).groupBy("grp").agg(F.percentile("least", F.lit(alpha / 2)).alias("lower"), F.percentile("greatest", F.lit(1 - alpha / 2)).alias("upper"), F.count("*").alias("n_draws"))


def joint_status(bounds: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """grp, status of joint bounds: joint_robust_positive, joint_robust_nonpositive, uncertain, unavailable (no bounds)."""
    unknown = F.col("lower").isNull() | F.col("upper").isNull() | F.isnan("lower") | F.isnan("upper")
    status = F.when(unknown, "unavailable").when(F.col("lower") > tolerance, "joint_robust_positive").when(F.col("upper") <= tolerance, "joint_robust_nonpositive").otherwise("uncertain")
    return bounds.select("grp", status.alias("status"))


def _family(statuses: list[str]) -> str:
    if not statuses or "unavailable" in statuses:
        return "unavailable"
    if len(set(statuses)) == 1 and statuses[0] != "uncertain":
        return {"joint_robust_positive": "joint_robust_generalizing", "joint_robust_nonpositive": "joint_robust_non_generalizing"}[statuses[0]]
    return "uncertain" if "uncertain" in statuses else "mixed"


def robustness_radius(rows: DataFrame, draws: int, seed: int, alpha: float = 0.05, limit: float = 10.0, steps: int = 50, min_blocks: int = 8, tolerance: float = 0.0) -> DataFrame:
    """One row: up to which gamma the family keeps the category that it has at gamma 1, positive or not, by bisection.

    category: unavailable (a group without finite gains or with too few blocks), not_certified_at_baseline (neither all
    positive nor all nonpositive), robust_through_search_upper (radius is the limit, a lower bound), finite_radius. target:
    the category kept. radius and break_gamma bracket the change; limiting_groups: those in the way there. All steps use
    the same draws.
    """
    rows = cut(rows.select("grp", "block", "gain", "w"))  # read several times
    live = rows.filter("w > 0")
    resamples = _resamples(rows, draws, seed)
    few = {r[0] for r in live.groupBy(F.col("grp").cast("string").alias("grp")).agg(F.countDistinct("block").alias("n")).filter(F.col("n") < min_blocks).collect()}  # groups
    endless = {r[0] for r in endless_groups(rows).select(F.col("grp").cast("string")).collect()}

    def seen(gamma: float) -> dict[str, str]:
        found = {r[0]: r[1] for r in joint_status(_bounds(resamples, gamma, alpha), tolerance).select(F.col("grp").cast("string"), "status").collect()}  # groups
        return found | dict.fromkeys(few | endless, "unavailable")

    def answer(category: str, target: str | None = None, radius: float | None = None, broken: float | None = None, groups: list[str] | None = None) -> DataFrame:
        row = (category, target, radius, broken, None if radius is None else radius * radius, ",".join(sorted(groups)) if groups else None)
        return rows.sparkSession.createDataFrame([row], "category string, target string, radius double, break_gamma double, weight_ratio double, limiting_groups string")

    base = seen(1.0)
    target = _family(list(base.values()))
    if target == "unavailable":
        return answer("unavailable", groups=[g for g, s in base.items() if s == "unavailable"])
    if target not in ("joint_robust_generalizing", "joint_robust_non_generalizing"):
        return answer("not_certified_at_baseline", groups=[g for g, s in base.items() if s == "uncertain"] or sorted(base))
    at_high = seen(limit)
    if _family(list(at_high.values())) == target:
        return answer("robust_through_search_upper", target, limit)
    low, high = 1.0, limit
    for _ in range(steps):
        mid = (low + high) / 2
        if mid in (low, high):
            break  # neighbouring numbers: nothing lies between
        now = seen(mid)
        if _family(list(now.values())) == target:
            low = mid
        else:
            high, at_high = mid, now
    wanted = set(base.values())
    return answer("finite_radius", target, low, high, [g for g, s in at_high.items() if s not in wanted])
