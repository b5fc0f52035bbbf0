"""Set enrichment: kinase z-scores, ranked-list enrichment, over-representation, correlation, consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundix.functions.special import hypergeometric_upper_p, normal_upper_p, t_two_sided_p
from abundix.functions.text import pathway_label
from abundix.operators.differential import bh_adjust
from abundix.operators.filters import top_rows
from abundix.operators.multivar import packed_features, pair_correlations
from abundix.operators.ordered import cut_ranges, keys_of, prefix_scan
from abundix.operators.permute import SCORE_TIE, multilevel_p, null_set_scores  # noqa: F401 (part of this module's interface)
from abundix.operators.reshape import explode_tokens, sets_to_long
from abundix.session import cut_lineage


# --- gene sets -------------------------------------------------------------------------------------------


def sets_by_prefix(sets: DataFrame, prefix: str, *, term: str = "term", members: str = "members", gene: str = "gene") -> DataFrame:
    """Sets of one database as (term, label, gene), padding dropped."""
    chosen = sets.where(F.col(term).startswith(prefix))
    return sets_to_long(chosen, term, members, gene=gene).withColumn("label", pathway_label(F.col(term)))


# --- kinases ---------------------------------------------------------------------------------------------


def kinase_scores(
    sites: DataFrame,
    substrates: DataFrame,
    *,
    by: str | Sequence[str] | None = "comparison",
    residue: str = "residue",
    gene: str = "gene",
    value: str = "value",
) -> DataFrame:
    """z = (mean of substrates - mean of all) * sqrt(m) / sd of all, per comparison and kinase.

    Compound residues are split, then each (gene, residue) counts once with its mean value.
    """
    keys = keys_of(by)
    single = explode_tokens(sites.select(*keys, gene, residue, value), residue)
    single = single.groupBy(*keys, gene, residue).agg(F.avg(value).alias("__v"))
    overall = single.groupBy(*keys).agg(F.avg("__v").alias("mean_all"), F.stddev_samp("__v").alias("sd_all"))
    scored = (
        single.join(substrates.select("kinase", gene, residue).distinct(), [gene, residue])
        .groupBy(*keys, "kinase")
        .agg(F.count(F.lit(1)).alias("m"), F.avg("__v").alias("mean_s"))
    )
    z = (F.col("mean_s") - F.col("mean_all")) * F.sqrt("m") / F.col("sd_all")
    return scored.join(overall, keys).withColumn("z", F.when(F.col("sd_all") > 0, z))


def kinase_test(scores: DataFrame, by: str | Sequence[str] | None = "comparison") -> DataFrame:
    """One-tailed normal p of z and its adjustment within each comparison."""
    return bh_adjust(scores.withColumn("p", normal_upper_p(F.abs("z"))), by, "p", "fdr")


def kinase_substrates(
    sites: DataFrame,
    substrates: DataFrame,
    tested: DataFrame,
    *,
    by: str | Sequence[str] | None = "comparison",
    residue: str = "residue",
    gene: str = "gene",
    value: str = "value",
) -> DataFrame:
    """The measured substrates behind each tested kinase: gene, residue, source and value beside m, mean, z, p and fdr.

    The rows are the edges (kinase, gene) of a network per condition; with ``tested`` cut to the significant
    kinases they are its significant part.
    """
    keys = keys_of(by)
    single = explode_tokens(sites.select(*keys, gene, residue, value), residue)
    single = single.groupBy(*keys, gene, residue).agg(F.avg(value).alias(value))
    pairs = single.join(substrates.select("kinase", gene, residue, "source").distinct(), [gene, residue])
    return pairs.join(tested.select(*keys, "kinase", "m", "mean_s", "z", "p", "fdr"), [*keys, "kinase"])


def significant_kinases(tested: DataFrame, min_substrates: int = 5, max_fdr: float = 0.05) -> DataFrame:
    return tested.where((F.col("m") >= min_substrates) & (F.col("fdr") < max_fdr))


# --- ranked lists ----------------------------------------------------------------------------------------


def _peak(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Enrichment score from hits (keys, rank, weight, n, h): the running sum moves up only at hits, so its
    extremes lie just after or just before one of them."""
    sums = prefix_scan(
        cut_ranges(hits, keys, "rank"), keys, "rank", {"__w": ("sum", F.col("weight")), "__i": ("sum", F.lit(1))}
    )
    missed = (F.col("rank") - F.col("__i")) / (F.col("n") - F.col("h"))
    after = F.col("__w") / F.col("__w_total") - missed
    before = (F.col("__w") - F.col("weight")) / F.col("__w_total") - missed
    peaks = sums.where((F.col("__w_total") > 0) & (F.col("n") > F.col("h"))).groupBy(*keys, "n", "h").agg(
        F.max(after).alias("__up"), F.min(before).alias("__down")
    )
    score = F.when(F.col("__up") >= -F.col("__down"), F.col("__up")).otherwise(F.col("__down"))
    return peaks.select(*keys, "n", "h", score.alias("es"))


def ranked_set_scores(
    ranked: DataFrame,
    sets: DataFrame,
    *,
    by: str | Sequence[str] | None = "comparison",
    feature: str = "feature",
    value: str = "value",
    min_size: int = 1,
    max_size: int | None = None,
) -> DataFrame:
    """Enrichment score per (by, term). ``ranked`` has rank (1 = top) and ``n`` = length of its list;
    ``sets`` is (term, gene). Only set members travel; there is no term x feature grid."""
    keys = keys_of(by)
    members = sets.select("term", F.col("gene").alias(feature)).distinct()
    hits = ranked.select(*keys, feature, "rank", "n", F.abs(value).alias("weight")).join(members, feature)
    hits = cut_lineage(hits.drop(feature))
    sizes = hits.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("h"))
    sizes = sizes.where(F.col("h") >= min_size)
    if max_size is not None:
        sizes = sizes.where(F.col("h") <= max_size)
    return _peak(hits.join(sizes, [*keys, "term"]), [*keys, "term"])


def normalised_set_scores(
    scores: DataFrame, null_scores: DataFrame, by: str | Sequence[str] | None = "comparison"
) -> DataFrame:
    """NES, p against null scores of the same sign and size, and adjusted p."""
    keys = keys_of(by)
    null = null_scores.select(*keys, "h", F.col("es").alias("__null"))
    joined = scores.join(null, [*keys, "h"], "left")
    same = F.signum("__null") == F.signum("es")
    # scores of small sets are often fractions of n - h, so equal ones must not hang on the last digit
    beyond = same & (F.abs("__null") >= F.abs("es") - SCORE_TIE)
    out = joined.groupBy(*keys, "term", "n", "h", "es").agg(
        F.avg(F.when(same, F.abs("__null"))).alias("__mean"),
        ((1 + F.count_if(beyond)) / (1 + F.count_if(same))).alias("p"),
    )
    out = out.withColumn("nes", F.col("es") / F.col("__mean")).drop("__mean")
    return bh_adjust(out, keys, "p")


# --- over-representation ---------------------------------------------------------------------------------


def overlap_counts(
    chosen: DataFrame, universe: DataFrame, sets: DataFrame, *, by: Sequence[str] = ("cluster",), feature: str = "feature"
) -> DataFrame:
    """k of n chosen and K of N measured features per term, (by, term) rows with k > 0."""
    keys = keys_of(by)
    measured = universe.select(feature).distinct()
    members = sets.select("term", F.col("gene").alias(feature)).distinct().join(measured, feature, "left_semi")
    picked = chosen.select(*keys, feature).distinct().join(measured, feature, "left_semi")
    set_sizes = members.groupBy("term").agg(F.count(F.lit(1)).alias("big_k"))
    pick_sizes = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    overlap = picked.join(members, feature).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("k"))
    big_n = measured.agg(F.count(F.lit(1)).alias("big_n")).scalar()
    return overlap.join(set_sizes, "term").join(pick_sizes, keys).withColumn("big_n", big_n)


def over_representation(counts: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """Hypergeometric upper tail per term and adjusted p within each chosen set."""
    p = hypergeometric_upper_p("k", "n", "big_k", "big_n")
    return bh_adjust(counts.withColumn("p", p), by, "p")


# --- correlation -----------------------------------------------------------------------------------------


def set_correlation(
    df: DataFrame,
    sets: DataFrame,
    *,
    by: str = "cohort",
    feature: str = "feature",
    sample: str = "sample",
    value: str = "value",
    min_members: int = 2,
    min_shared: int = 3,
) -> DataFrame:
    """Correlation over all pairs of set members, beside that over all pairs of measured features of the cohort.

    A pair is correlated over the samples that have both, ``min_shared`` of them at least, so gaps cost single pairs and
    never a member. Members and features are those seen in as many samples. Mean, variance and number of pairs come out.
    """
    rows = cut_lineage(packed_features(df, by=by, feature=feature, sample=sample, value=value, least=min_shared))
    members = sets.select("term", F.col("gene").alias(feature)).distinct()
    inside = pair_correlations(rows.join(members, feature), [by, "term"], feature=feature, least=min_shared)
    outside = pair_correlations(rows, [by], feature=feature, least=min_shared)
    named = lambda part, *names: part.toDF(*names)
    inside = named(inside, by, "term", "n_members", "pairs", "correlation", "var")
    outside = named(outside, by, "n_features", "all_pairs", "background", "background_var")
    scored = inside.where((F.col("n_members") >= min_members) & (F.col("pairs") > 0))
    return scored.join(outside, by)


def set_correlation_test(df: DataFrame, sets: DataFrame, *, by: str = "cohort", **names) -> DataFrame:
    """``set_correlation`` with a Welch p-value of set pairs against background pairs."""
    scored = set_correlation(df, sets, by=by, **names)
    a, b = F.col("var") / F.col("pairs"), F.col("background_var") / F.col("all_pairs")
    t = F.when(a + b > 0, (F.col("correlation") - F.col("background")) / F.sqrt(a + b))
    dof = (a + b) * (a + b) / (a * a / (F.col("pairs") - 1) + b * b / (F.col("all_pairs") - 1))
    tested = scored.withColumn("t", t).withColumn("df", F.when(F.col("t").isNotNull() & (F.col("pairs") > 1), dof))
    return tested.withColumn("p", t_two_sided_p("t", "df"))


# --- results across patients -----------------------------------------------------------------------------


def consensus_terms(
    results: DataFrame,
    *,
    by: str = "patient",
    term: str = "term",
    score: str = "score",
    p: str = "p",
    top: int = 50,
    cutoff: float = 0.05,
) -> DataFrame:
    """Adjust p over all cells, take the ``top`` terms by largest absolute score, keep those with a small p.

    A term that any patient lacks is out, as a missing cell makes its extremes missing.
    """
    adjusted = bh_adjust(results, None, p, "__adj")
    n_ids = adjusted.agg(F.count_distinct(by).alias("n")).scalar()
    terms = adjusted.groupBy(term).agg(
        F.max(F.abs(score)).alias("max_abs_score"), F.min("__adj").alias("min_p_adj"),
        F.count(F.when(F.col(score).isNotNull() & F.col(p).isNotNull(), 1)).alias("__n"),
    )
    complete = terms.where(F.col("__n") == n_ids).drop("__n")
    return top_rows(complete, top, F.col("max_abs_score").desc(), F.col(term)).where(F.col("min_p_adj") < cutoff)


def member_values(
    results: DataFrame, pattern: str, values: DataFrame, *, description: str = "description", members: str = "members",
    feature: str = "feature", separator: str = ";",
) -> DataFrame:
    """Values of all members of the terms whose description matches."""
    listed = results.where(F.col(description).rlike(pattern))
    own = F.col(members) if isinstance(results.schema[members].dataType, T.ArrayType) else F.split(members, separator)
    genes = listed.select(F.explode(own).alias(feature)).distinct()
    return values.join(genes, feature, "left_semi")
