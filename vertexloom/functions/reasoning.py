"""Awareness tensors (nine agreements of subject, predicate and object in sign, exponent and mantissa) and truth values
(frequency, confidence) as column expressions and edge joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import fixed

# The nine dimensions in order, and the bounds of states and directions.
DIMENSIONS = ("s_sign", "s_exp", "s_mant", "p_sign", "p_exp", "p_mant", "o_sign", "o_exp", "o_mant")
CRYSTALLIZED_ABOVE, TENSIONED_BELOW, ALIGNED_ABOVE, INVERTED_BELOW = 0.5, 0.3, 0.7, 0.3


def agreement(kind: str = "") -> Column:
    """The mean of all dimensions, or of those of one kind: sign, exp or mant."""
    own = [F.col(d) for d in DIMENSIONS if d.endswith(kind)]
    return sum(own[1:], own[0]) / F.lit(float(len(own)))


def awareness_state() -> Column:
    return F.when(agreement() > CRYSTALLIZED_ABOVE, "Crystallized").when(agreement("sign") < TENSIONED_BELOW, "Tensioned").otherwise("Uncertain")


def causal_direction() -> Column:
    return F.when(agreement("sign") > ALIGNED_ABOVE, "Aligned").when(agreement("sign") < INVERTED_BELOW, "Inverted").otherwise("Mixed")


def most_tensioned() -> Column:
    """struct of the least agreement and its name; the first in order if tied."""
    least = F.array_min(F.array(*(F.struct(F.col(d).alias("value"), F.lit(i).alias("place"), F.lit(d).alias("name")) for i, d in enumerate(DIMENSIONS))))
    return F.struct(least["name"].alias("name"), least["value"].alias("value"))


#: Masks: the dimensions that each keeps.
MASKS = {
    "all": DIMENSIONS,
    "causal": tuple(d for d in DIMENSIONS if d.endswith("_sign")),
    "subject": tuple(d for d in DIMENSIONS if d.startswith("s_")),
    "predicate": tuple(d for d in DIMENSIONS if d.startswith("p_")),
    "object": tuple(d for d in DIMENSIONS if d.startswith("o_")),
}


def active_count(mask: str | tuple[str, ...]) -> int:
    """How many dimensions a mask, by its name or its dimensions, keeps."""
    return len(set(MASKS[mask] if isinstance(mask, str) else mask))


def masked(df: DataFrame, *kept: str) -> DataFrame:
    """Zero but for the named dimensions, or those of the masks named."""
    wanted = {d for k in kept for d in MASKS.get(k, (k,))}
    return df.withColumns({d: F.lit(0.0) for d in DIMENSIONS if d not in wanted})


def perspective(df: DataFrame, by: str) -> DataFrame:
    """Per key: the mean of each dimension, how many rows are in each state and in all, the state that most are in (of
    equal ones the first in order), and the dimension whose mean is least."""
    states = ("Crystallized", "Tensioned", "Uncertain")
    counts = df.groupBy(by).agg(*(F.avg(d).alias(d) for d in DIMENSIONS), *(F.count(F.when(awareness_state() == s, 1)).alias(s.lower()) for s in states), F.count(F.lit(1)).alias("total"))
    main = F.array_max(F.array(*(F.struct(F.col(s.lower()).alias("n"), F.lit(-k).alias("place"), F.lit(s).alias("state")) for k, s in enumerate(states))))
    return counts.withColumn("dominant", main["state"]).withColumn("most_tensioned", most_tensioned()["name"])


def resonance(df: DataFrame, least_sign: float | None = None, most_sign: float | None = None, state: str | None = None, direction: str | None = None, mask: str | None = None) -> DataFrame:
    """The rows whose tensors, seen through a mask, fit every bound that is given."""
    seen = masked(df.select("*", *(F.col(d).alias(f"_{d}") for d in DIMENSIONS)), mask) if mask else df
    tests = [agreement("sign") >= least_sign if least_sign is not None else None, agreement("sign") <= most_sign if most_sign is not None else None, awareness_state() == state if state else None, causal_direction() == direction if direction else None]
    for test in tests:
        seen = seen if test is None else seen.where(test)
    return seen.select(*(F.col(f"_{c}").alias(c) if mask and c in DIMENSIONS else F.col(c) for c in df.columns))


def composed(tensors: Column) -> Column:
    """Of a list of structs sign, exp, mant along a path: signs agree where an even number of steps flips (XOR of chances),
    exponents add, mantissas degrade by each other; and the holonomy of a cycle is its sign."""
    start = F.struct(F.lit(1.0).alias("sign"), F.lit(0.0).alias("exp"), F.lit(1.0).alias("mant"))
    step = lambda a, x: F.struct((a["sign"] * x["sign"] + (1 - a["sign"]) * (1 - x["sign"])).alias("sign"), (a["exp"] + x["exp"]).alias("exp"), (a["mant"] * x["mant"]).alias("mant"))
    return F.aggregate(tensors, start, step)


def causal_paths(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, target, hops, sign, exp, mant) along the shortest path from each of sources (id) over edges (src, dst and
    the nine dimensions): each step's kinds are the means of its dimensions. Of edges with one pair of ends the first by
    its dimensions counts."""
    from ..operators.paths import shortest_paths

    means = [agreement(k).alias(k) for k in ("sign", "exp", "mant")]
    steps = edges.select("src", "dst", F.struct(*means).alias("step")).groupBy("src", "dst").agg(F.min("step").alias("step"))
    paths = shortest_paths(edges, sources, most).where("hops > 0")
    each = paths.select("source", "target", "hops", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.col("hops")).alias("src"), F.slice("path", F.lit(2), F.col("hops")).alias("dst"))).alias("k", "edge"))
    held = each.select("source", "target", "hops", "k", "edge.*").join(steps, ["src", "dst"])
    folded = held.groupBy("source", "target", "hops").agg(F.sort_array(F.collect_list(F.struct("k", "step"))).alias("steps"))  # a path's steps
    out = composed(F.transform("steps", lambda s: s["step"]))
    return folded.withColumn("whole", out).select("source", "target", "hops", "whole.sign", "whole.exp", "whole.mant")


def truth(frequency: Column, confidence: Column) -> Column:
    """Both clamped to 0 … 1."""
    return F.struct(*(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias(n) for x, n in ((frequency, "frequency"), (confidence, "confidence"))))


def expectation(frequency: Column, confidence: Column) -> Column:
    return confidence * (frequency - 0.5) + 0.5


#: Edges of a key that meet in one cell; pairs of a task, and tasks at most.
CELL, TASK_PAIRS, MOST_TASKS = 2048, 1 << 22, 8192


def _pairs(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Edges a beside edges b where a's end left is b's end right. Tasks are as many as the pairs ask for, whatever the bytes of
    the edges, and the edges of a hot key are dealt to cells, each the meeting of a part of a's and a part of b's."""
    names = ("id", "src", "dst", "frequency", "confidence")
    counts = [edges.groupBy(F.col(end).alias("_key")).agg(F.count(F.lit(1)).alias(n)) for end, n in ((left, "na"), (right, "nb"))]
    sizes = counts[0].withColumn("nb", F.col("na")) if left == right else counts[0].join(counts[1], "_key")
    parts = [F.ceil(F.col(n) / CELL).cast("int").alias(p) for n, p in (("na", "_as"), ("nb", "_bs"))]
    sizes = fixed(sizes.where("_key is not null").select("*", *parts))
    hot = sizes.where("_as > 1 or _bs > 1")
    pairs, cells = sizes.agg(F.sum(F.when(F.col("_as") + F.col("_bs") == 2, F.col("na") * F.col("nb"))), F.sum(F.when(F.col("_as") + F.col("_bs") > 2, F.col("_as").cast("long") * F.col("_bs")))).first()
    if cells:
        edges = fixed(edges.select(*names))
    a, b = (edges.select(F.col(end).alias("_key"), *(F.col(c).alias(f"{x}_{c}") for c in names)) for x, end in (("a", left), ("b", right)))

    def met(a: DataFrame, b: DataFrame, keys: list[str], tasks: int) -> DataFrame:
        tasks = max(1, min(tasks, MOST_TASKS))
        return a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys).drop(*keys)

    if not cells:
        return met(a, b, ["_key"], -(-(pairs or 0) // TASK_PAIRS))
    cold = met(*(df.join(hot, "_key", "left_anti") for df in (a, b)), ["_key"], -(-(pairs or 0) // TASK_PAIRS))
    own = lambda x, n: F.pmod(F.xxhash64(f"{x}_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hot = hot.select("_key", "_as", "_bs")
    a = a.join(hot, "_key").withColumn("_a", own("a", "_as")).withColumn("_b", every("_bs")).drop("_as", "_bs")
    b = b.join(hot, "_key").withColumn("_b", own("b", "_bs")).withColumn("_a", every("_as")).drop("_as", "_bs")
    return cold.unionByName(met(a, b, ["_key", "_a", "_b"], 2 * cells))


def deduction(edges: DataFrame) -> DataFrame:
    """edges (id, src, dst, frequency, confidence): a→b and b→c give a→c, via b."""
    f = F.col("a_frequency") * F.col("b_frequency")
    c = F.col("a_confidence") * F.col("b_confidence") * f
    return _pairs(edges, "dst", "src").select(F.col("a_src").alias("src"), F.col("a_dst").alias("via"), F.col("b_dst").alias("dst"), f.alias("frequency"), c.alias("confidence"))


def abduction(edges: DataFrame) -> DataFrame:
    """a→b and c→b, another edge, give a→c, via b."""
    c = F.col("a_confidence") * F.col("b_confidence") * F.col("b_frequency")
    return _pairs(edges, "dst", "dst").where("a_id <> b_id").select(F.col("a_src").alias("src"), F.col("a_dst").alias("via"), F.col("b_src").alias("dst"), F.col("a_frequency").alias("frequency"), c.alias("confidence"))


def induction(edges: DataFrame) -> DataFrame:
    """a→b and a→c, another edge, give b→c, via a."""
    c = F.col("a_confidence") * F.col("b_confidence") * F.col("a_frequency")
    return _pairs(edges, "src", "src").where("a_id <> b_id").select(F.col("a_dst").alias("src"), F.col("a_src").alias("via"), F.col("b_dst").alias("dst"), F.col("b_frequency").alias("frequency"), c.alias("confidence"))


def revision(f1: Column, c1: Column, f2: Column, c2: Column) -> Column:
    """Two opinions pooled by their evidence c / (1 - c) (the published formula)."""
    w1, w2 = c1 / (1 - c1), c2 / (1 - c2)
    return truth((w1 * f1 + w2 * f2) / (w1 + w2), (w1 + w2) / (w1 + w2 + 1))
