"""Name similarity of a unit's members from mutual information between terms and names, per ``parent_id``.

The vector of a name holds one value for every term of its parent, also for terms that it lacks. Those
depend only on the term's and the name's counts, so vectors are kept as that background plus a
correction for the terms a name has, and no dense matrix is formed. All pairs of names of a parent are
compared, since two names without a common term can be alike too.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.operators.ranks import numbered
from modsplit_spark.sources.workspace import materialize

MIN_SIM = 0.25
#: Candidates without this much from common terms are found by cells; a cell is 1 / CELLS wide. Both only decide how many pairs are compared.
BY_TERMS, CELLS = 0.1, 32


def pair_counts(occurrences: DataFrame) -> DataFrame:
    """``(parent_id, term, doc, n)``."""
    return occurrences.groupBy("parent_id", "term", "doc").agg(F.count("*").alias("n"))


def term_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("parent_id", "term").agg(F.sum("n").alias("term_count"))


def doc_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("parent_id", "doc").agg(F.sum("n").alias("doc_count"))


def drop_isolated_terms(pairs: DataFrame) -> DataFrame:
    """Pairs whose term occurs more than once in its parent."""
    total = F.sum("n").over(W.partitionBy("parent_id", "term"))
    return pairs.withColumn("_t", total).where("_t > 1").drop("_t")


def total(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("parent_id").agg(F.sum("n").alias("total"))


def vocabulary(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(parent_id, term, term_ix)`` and ``(parent_id, doc, doc_ix)``, numbered from 0 by first appearance.

    ``placed`` has one row for each occurrence, (parent_id, doc, term, at), ``at`` its place among its parent's (no two equal). Isolated
    terms, and documents of them alone, have no number."""
    of_pair = placed.groupBy("parent_id", "term", "doc").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    kept = materialize(drop_isolated_terms(of_pair), "placed")
    return tuple(
        numbered(kept.groupBy("parent_id", c).agg(F.min("at").alias("at")), ["parent_id"], ["at"], f"{c}_ix").select("parent_id", c, F.col(f"{c}_ix").cast("int").alias(f"{c}_ix"))
        for c in ("term", "doc")
    )


def with_counts(pairs: DataFrame) -> DataFrame:
    """Pairs with ``term_count``, ``doc_count`` and ``total``."""
    by = lambda *keys: F.sum("n").over(W.partitionBy("parent_id", *keys))
    return pairs.withColumn("term_count", by("term")).withColumn("doc_count", by("doc")).join(total(pairs), "parent_id")


def marginal_joint_probs(pairs: DataFrame) -> DataFrame:
    """The eight marginal and joint probabilities of each pair that occurs."""
    n, t, d, s = (F.col(c).cast("double") for c in ("n", "term_count", "doc_count", "total"))
    return with_counts(pairs).select(
        "parent_id", "term", "doc", (t / s).alias("p_i_1"), ((s - t) / s).alias("p_i_0"), (d / s).alias("p_j_1"), ((s - d) / s).alias("p_j_0"),
        (n / s).alias("p_ij_11"), ((t - n) / s).alias("p_ij_10"), ((d - n) / s).alias("p_ij_01"), ((s + n - t - d) / s).alias("p_ij_00"),
    )


def mi(n: Column, t: Column, d: Column, s: Column) -> Column:
    """Mutual information of counts n (together), t (term), d (name) out of s; a cell of probability 0, or of a margin of 0, adds 0."""
    n, t, d, s = (c.cast("double") for c in (n, t, d, s))

    def cell(x: Column, a: Column, b: Column) -> Column:
        return F.when((x == 0) | (a == 0) | (b == 0), 0.0).otherwise(x / s * F.log(x * s / (a * b)))

    return cell(n, t, d) + cell(t - n, t, s - d) + cell(d - n, s - t, d) + cell(s + n - t - d, s - t, s - d)


def mutual_information(pairs: DataFrame) -> DataFrame:
    """``(parent_id, term, doc, mi)`` for every term and name of a parent, together or not. The result has as many rows as the
    dense matrix; ``doc_similarity`` does without it."""
    t, d = term_counts(pairs), doc_counts(pairs).join(total(pairs), "parent_id")
    grid = t.join(d, "parent_id").join(pairs, ["parent_id", "term", "doc"], "left")
    return grid.select("parent_id", "term", "doc", mi(F.coalesce("n", F.lit(0)), F.col("term_count"), F.col("doc_count"), F.col("total")).alias("mi"))


class Vectors(NamedTuple):
    """The vectors of all names, as background and corrections.

    ``docs``: (parent_id, doc, doc_count, m, sum, norm), m the number of terms. ``backgrounds``: (parent_id, d_a, d_b, bg_bg), products of the
    backgrounds of names of these counts. ``cross``: (parent_id, doc, d, cross), a name's corrections times the background of count d.
    ``delta``: (parent_id, term, doc, delta), the corrections.
    """

    docs: DataFrame
    backgrounds: DataFrame
    cross: DataFrame
    delta: DataFrame


def vectors(pairs: DataFrame) -> Vectors:
    counted = with_counts(pairs)
    # Background: terms of one count k are alike for a name that lacks them.
    levels = term_counts(pairs).groupBy("parent_id", F.col("term_count").alias("k")).agg(F.count("*").alias("terms"))
    sizes = counted.select("parent_id", F.col("doc_count").alias("d"), F.col("total").alias("s")).distinct()
    zero = F.lit(0)
    background = levels.join(sizes, "parent_id").select("parent_id", "k", "d", "terms", mi(zero, F.col("k"), F.col("d"), F.col("s")).alias("bg"))
    left, right = background.alias("x"), background.alias("y")
    both = left.join(right, (F.col("x.parent_id") == F.col("y.parent_id")) & (F.col("x.k") == F.col("y.k"))).groupBy(F.col("x.parent_id").alias("parent_id"), F.col("x.d").alias("d_a"), F.col("y.d").alias("d_b")).agg(F.sum(F.col("x.terms") * F.col("x.bg") * F.col("y.bg")).alias("bg_bg"))
    sums = background.groupBy("parent_id", F.col("d").alias("doc_count")).agg(F.sum(F.col("terms") * F.col("bg")).alias("bg_sum"), F.sum("terms").alias("m"))
    # Corrections for terms that a name has.
    delta = counted.select("parent_id", "term", "doc", F.col("term_count").alias("k"), "doc_count", (mi(F.col("n"), F.col("term_count"), F.col("doc_count"), F.col("total")) - mi(zero, F.col("term_count"), F.col("doc_count"), F.col("total"))).alias("delta"))
    cross = delta.join(background.select("parent_id", "k", "d", "bg"), ["parent_id", "k"]).groupBy("parent_id", "doc", "d").agg(F.sum(F.col("delta") * F.col("bg")).alias("cross"))
    docs = delta.groupBy("parent_id", "doc", "doc_count").agg(F.sum("delta").alias("delta_sum"), F.sum(F.col("delta") * F.col("delta")).alias("delta_square")).join(sums, ["parent_id", "doc_count"])
    own = docs.join(cross.withColumnRenamed("d", "doc_count"), ["parent_id", "doc", "doc_count"]).join(both.where("d_a = d_b").select("parent_id", F.col("d_a").alias("doc_count"), F.col("bg_bg").alias("own_bg")), ["parent_id", "doc_count"])
    own = own.select("parent_id", "doc", "doc_count", "m", (F.col("bg_sum") + F.col("delta_sum")).alias("sum"), F.sqrt(F.greatest(F.col("own_bg") + 2 * F.col("cross") + F.col("delta_square"), F.lit(0.0))).alias("norm"))
    return Vectors(own, both, cross, delta.select("parent_id", "term", "doc", "delta"))


def _written(v: Vectors) -> Vectors:
    """The frames as tables: each is read several times."""
    return Vectors(*(materialize(frame, f"similarity-{name}") for name, frame in zip(Vectors._fields, v, strict=True)))


def _without_terms(pairs_all: DataFrame, v: Vectors) -> DataFrame:
    """``pairs_all`` (parent_id, doc_a, doc_b, ...) with what their product is but for the terms they share (``dot``), and the product of their lengths."""
    side = lambda x: v.docs.select("parent_id", *[F.col(c).alias(f"{c}_{x}") for c in ("doc", "doc_count", "sum", "norm")], *(["m"] if x == "a" else []))
    product = (
        pairs_all.join(side("a"), ["parent_id", "doc_a"]).join(side("b"), ["parent_id", "doc_b"])
        .join(v.backgrounds.select("parent_id", F.col("d_a").alias("doc_count_a"), F.col("d_b").alias("doc_count_b"), "bg_bg"), ["parent_id", "doc_count_a", "doc_count_b"])
        .join(v.cross.select("parent_id", F.col("doc").alias("doc_a"), F.col("d").alias("doc_count_b"), F.col("cross").alias("cross_a")), ["parent_id", "doc_a", "doc_count_b"])
        .join(v.cross.select("parent_id", F.col("doc").alias("doc_b"), F.col("d").alias("doc_count_a"), F.col("cross").alias("cross_b")), ["parent_id", "doc_b", "doc_count_a"])
    )
    dot = F.col("bg_bg") + F.col("cross_a") + F.col("cross_b") - F.col("sum_a") * F.col("sum_b") / F.col("m")
    return product.withColumn("dot", dot).withColumn("length", F.col("norm_a") * F.col("norm_b"))


def doc_similarity(pairs: DataFrame) -> DataFrame:
    """``(parent_id, doc_a, doc_b, sim, dist)`` for all doc_a <= doc_b of a parent: the centred product of the
    two vectors over the product of their uncentred lengths, 0 if negative or undefined; dist = 1 - sim.

    The result is quadratic in a parent's names; ``similar_pairs`` finds those over a bound without it."""
    v = _written(vectors(pairs))
    a, b = v.delta.alias("a"), v.delta.alias("b")
    shared = a.join(b, (F.col("a.parent_id") == F.col("b.parent_id")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.doc") <= F.col("b.doc"))).groupBy(F.col("a.parent_id").alias("parent_id"), F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b")).agg(F.sum(F.col("a.delta") * F.col("b.delta")).alias("shared"))
    pairs_all = v.docs.select("parent_id", F.col("doc").alias("doc_a")).join(v.docs.select("parent_id", F.col("doc").alias("doc_b")), "parent_id").where("doc_a <= doc_b")
    product = _without_terms(pairs_all, v).join(shared, ["parent_id", "doc_a", "doc_b"], "left")
    sim = F.when(F.col("length") > 0, F.greatest((F.col("dot") + F.coalesce("shared", F.lit(0.0))) / F.col("length"), F.lit(0.0))).otherwise(0.0)
    return product.select("parent_id", "doc_a", "doc_b", sim.alias("sim")).withColumn("dist", 1 - F.col("sim"))


def candidate_pairs(v: Vectors, least: float = MIN_SIM, by_terms: float = BY_TERMS) -> DataFrame:
    """Distinct ``(parent_id, doc_a, doc_b)``, doc_a < doc_b, among which are all pairs of a similarity of ``least`` or more.

    A similarity is a part without the terms that both names have, and the product of their corrections on those, each over the lengths. The
    first is C g_a g_b + y_a g_b + y_b g_a - z_a z_b, with C of the two names' counts and g, y, z of one name and the other's count, none over 1 in
    size. Names are put in cells of close g, y, z, and all pairs of two cells are taken if the cells allow a first part of
    ``least - by_terms``. Any other pair needs more than ``by_terms`` from common terms. Terms of a name, the frequent ones last, are left out from
    the end as long as what is left out can't give that much with any name of its parent; such a pair then has a common term that neither leaves out.
    """
    sizes = v.backgrounds.where("d_a = d_b").select("parent_id", F.col("d_a").alias("d"), F.sqrt("bg_bg").alias("size"))
    some = v.docs.where("norm > 0")
    own = some.join(sizes.withColumnsRenamed({"d": "doc_count", "size": "own_size"}), ["parent_id", "doc_count"])
    each = own.join(v.cross, ["parent_id", "doc"]).join(sizes, ["parent_id", "d"])
    y = F.when(F.col("size") > 0, F.col("cross") / (F.col("norm") * F.col("size"))).otherwise(0.0)
    placed = each.select("parent_id", "doc", "doc_count", "d", (F.col("own_size") / F.col("norm")).alias("g"), y.alias("y"), (F.col("sum") / (F.sqrt("m") * F.col("norm"))).alias("z"))
    placed = placed.withColumn("cell", F.array(*(F.floor(F.col(c) * CELLS) for c in "gyz")))
    spans = [f(c).alias(f"{name}_{c}") for c in "gyz" for name, f in (("least", F.min), ("most", F.max))]
    cells = materialize(placed.groupBy("parent_id", "doc_count", "d", "cell").agg(*spans), "cells")
    turned = cells.select("parent_id", F.col("d").alias("doc_count"), F.col("doc_count").alias("d"), *(F.col(c).alias(f"{c}_b") for c in cells.columns if c not in ("parent_id", "doc_count", "d")))
    angles = v.backgrounds.join(sizes.withColumnsRenamed({"d": "d_a", "size": "_a"}), ["parent_id", "d_a"]).join(sizes.withColumnsRenamed({"d": "d_b", "size": "_b"}), ["parent_id", "d_b"])
    length = F.col("_a") * F.col("_b")
    angles = angles.select("parent_id", F.col("d_a").alias("doc_count"), F.col("d_b").alias("d"), F.when(length > 0, F.col("bg_bg") / length).otherwise(0.0).alias("angle"))

    def most(*factors: tuple[Column, Column]) -> Column:
        """Most of a product of two values between these bounds."""
        (a, b), (x, w) = factors
        return F.greatest(a * x, a * w, b * x, b * w)

    c = lambda name, x="": (F.col(f"least_{name}{x}"), F.col(f"most_{name}{x}"))
    (low, high), (low_b, high_b) = c("g"), c("g", "_b")
    bound = F.greatest(F.col("angle") * low * low_b, F.col("angle") * high * high_b) + most(c("y"), c("g", "_b")) + most(c("y", "_b"), c("g")) + most((-c("z")[1], -c("z")[0]), c("z", "_b"))
    # Each two cells once: a class of counts against a greater one, or cells of one class in order.
    once = (F.col("doc_count") < F.col("d")) | ((F.col("doc_count") == F.col("d")) & (F.col("cell") <= F.col("cell_b")))
    near = cells.join(turned, ["parent_id", "doc_count", "d"]).where(once).join(angles, ["parent_id", "doc_count", "d"]).where(bound >= least - by_terms - 1e-9).select("parent_id", "doc_count", "d", "cell", "cell_b")
    left = placed.select("parent_id", "doc_count", "d", "cell", F.col("doc").alias("_a"))
    right = placed.select("parent_id", F.col("d").alias("doc_count"), F.col("doc_count").alias("d"), F.col("cell").alias("cell_b"), F.col("doc").alias("_b"))
    close = near.join(left, ["parent_id", "doc_count", "d", "cell"]).join(right, ["parent_id", "doc_count", "d", "cell_b"]).where("_a != _b")

    weights = v.delta.join(some.select("parent_id", "doc", "norm"), ["parent_id", "doc"]).select("parent_id", "doc", "term", (F.col("delta") / F.col("norm")).alias("w"))
    longest = weights.groupBy("parent_id", "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("long")).groupBy("parent_id").agg(F.max("long").alias("longest"))
    holders = weights.groupBy("parent_id", "term").agg(F.count("*").alias("names"))
    from_the_end = W.partitionBy("parent_id", "doc").orderBy(F.desc("names"), F.desc("term"))
    tail = F.sqrt(F.sum(F.col("w") * F.col("w")).over(from_the_end))
    led = weights.join(holders, ["parent_id", "term"]).join(longest, "parent_id").withColumn("tail", tail).where(F.col("tail") * F.col("longest") >= by_terms - 1e-9)
    led = materialize(led.select("parent_id", "term", "doc"), "leading-terms")
    sharing = led.withColumnRenamed("doc", "_a").join(led.withColumnRenamed("doc", "_b"), ["parent_id", "term"]).where("_a < _b")
    found = close.select("parent_id", "_a", "_b").unionByName(sharing.select("parent_id", "_a", "_b"))
    return found.select("parent_id", F.least("_a", "_b").alias("doc_a"), F.greatest("_a", "_b").alias("doc_b")).distinct()


def similar_pairs(pairs: DataFrame, least: float = MIN_SIM) -> DataFrame:
    """``(parent_id, doc_a, doc_b, sim)`` of all doc_a <= doc_b whose similarity is ``least`` (over 0) or more, as ``doc_similarity`` has it; only
    candidates are compared, and no parent's names meet in one task."""
    v = _written(vectors(pairs))
    same = v.docs.select("parent_id", F.col("doc").alias("doc_a"), F.col("doc").alias("doc_b"))
    compared = materialize(candidate_pairs(v, least).unionByName(same), "candidates")
    held = v.delta.groupBy("parent_id", "doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "delta"))).alias("terms"))
    side = lambda x: held.select("parent_id", F.col("doc").alias(f"doc_{x}"), F.col("terms").alias(f"terms_{x}"))
    both = _without_terms(compared, v).join(side("a"), ["parent_id", "doc_a"]).join(side("b"), ["parent_id", "doc_b"])
    shared = F.aggregate(F.map_entries("terms_a"), F.lit(0.0), lambda total, x: total + x["value"] * F.coalesce(F.try_element_at("terms_b", x["key"]), F.lit(0.0)))
    sim = F.when(F.col("length") > 0, (F.col("dot") + shared) / F.col("length")).otherwise(0.0)
    return both.select("parent_id", "doc_a", "doc_b", sim.alias("sim")).where(F.col("sim") >= least)


def both_ways(sims: DataFrame) -> DataFrame:
    """Every ordered pair of names."""
    turned = sims.where("doc_a != doc_b").select("parent_id", F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), *[c for c in sims.columns if c not in ("parent_id", "doc_a", "doc_b")])
    return sims.unionByName(turned)


def has_doc(termed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Names whose document is part of the vocabulary."""
    return termed.join(pairs.select("parent_id", "doc").distinct(), ["parent_id", "doc"], "left_semi")


def doc_index(termed: DataFrame, docs: DataFrame) -> DataFrame:
    """Names with ``doc_ix`` of the vocabulary's ``docs``; null where the document is unknown."""
    return termed.join(docs, ["parent_id", "doc"], "left")


def name_sim(requests: DataFrame, sims: DataFrame) -> DataFrame:
    """``requests`` (parent_id, doc_a, doc_b) with ``sim``; 0 if either document is unknown."""
    low, high = F.least("doc_a", "doc_b"), F.greatest("doc_a", "doc_b")
    keyed = requests.withColumn("_a", low).withColumn("_b", high)
    known = sims.select("parent_id", F.col("doc_a").alias("_a"), F.col("doc_b").alias("_b"), "sim")
    return keyed.join(known, ["parent_id", "_a", "_b"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0))).drop("_a", "_b")


def most_similar(sims: DataFrame, n: int, docs: DataFrame | None = None) -> DataFrame:
    """``(parent_id, doc, other, sim, rank)``: of each name the 2nd to n-th most similar (its own row included in the
    ranking), ties by later number in the vocabulary's ``docs`` first, without them by later name."""
    both = both_ways(sims.select("parent_id", "doc_a", "doc_b", "sim"))
    both = both.withColumn("doc_ix", F.col("doc_b")) if docs is None else both.join(docs.withColumnRenamed("doc", "doc_b"), ["parent_id", "doc_b"])
    rank = F.row_number().over(W.partitionBy("parent_id", "doc_a").orderBy(F.desc("sim"), F.desc("doc_ix")))
    ranked = both.withColumn("rank", rank).where((F.col("rank") >= 2) & (F.col("rank") <= n))
    return ranked.select("parent_id", F.col("doc_a").alias("doc"), F.col("doc_b").alias("other"), "sim", (F.col("rank") - 1).alias("rank"))


def entity_sim(sims: DataFrame, least: float = MIN_SIM) -> DataFrame:
    """Similarities with those under ``least`` set to 0."""
    return sims.withColumn("sim", F.when(F.col("sim") < least, 0.0).otherwise(F.col("sim")))
