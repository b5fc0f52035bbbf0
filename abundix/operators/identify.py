"""Peptide identifications: error rates, accession maps, protein inference, site mapping."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.operators.network import connected_components
from abundix.operators.ordered import cut_ranges, keys_of, prefix_scan
from abundix.session import cut_lineage

_SOLVED_AT_ONCE = 100_000


def best_score(df: DataFrame, level: str | Sequence[str], score: str = "score", decoy: str = "is_decoy") -> DataFrame:
    """Best score per level entity; an entity is a decoy when its best-scored row is one."""
    keys = keys_of(level)
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(score), (~F.col(decoy)).alias("target"))).alias("__best"))
    return best.select(*keys, F.col(f"__best.{score}").alias(score), (~F.col("__best.target")).alias(decoy))


def target_decoy_q(
    df: DataFrame, by: str | Sequence[str] | None = None, score: str = "score", decoy: str = "is_decoy"
) -> DataFrame:
    """q-value of each row: least decoys/targets over all cut-offs that still keep it.

    Rows are first counted per score, so ties share a cut-off; both running values then go over the
    same ranges of scores.
    """
    keys = keys_of(by)
    df = cut_lineage(df)
    levels = df.groupBy(*keys, score).agg(
        F.count_if(F.col(decoy)).alias("__decoys"), F.count_if(~F.col(decoy)).alias("__targets")
    )
    sums = prefix_scan(
        cut_ranges(levels, keys, score),
        keys,
        score,
        {"__cum_decoys": ("sum", F.col("__decoys")), "__cum_targets": ("sum", F.col("__targets"))},
        descending=True,
    )
    rate = sums.withColumn(
        "__rate",
        F.when(F.col("__cum_targets") > 0, F.col("__cum_decoys") / F.col("__cum_targets")).otherwise(F.lit(float("inf"))),
    )
    q = prefix_scan(rate, keys, score, {"q_value": ("min", F.col("__rate"))})
    return df.join(q.select(*keys, score, "q_value"), [*keys, score])


def filter_by_fdr(df: DataFrame, level: str, max_fdr: float = 0.01, score: str = "score", decoy: str = "is_decoy") -> DataFrame:
    """Rows whose level entity (peptide, accession) passes the target-decoy error rate."""
    passed = target_decoy_q(best_score(df, level, score, decoy), None, score, decoy).where(F.col("q_value") <= max_fdr)
    return df.join(passed.select(level), level, "left_semi")


def parse_fasta_headers(df: DataFrame, header: str = "header") -> DataFrame:
    """(accession, symbol) of headers such as ``sp|ID|NAME text GN=SYM``."""
    parsed = df.select(
        F.regexp_extract(header, r"\|([^|]+)\|", 1).alias("accession"),
        F.regexp_extract(header, r"GN=(\S+)", 1).alias("symbol"),
    )
    return parsed.where((F.col("accession") != "") & (F.col("symbol") != "")).distinct()


def longest_per_symbol(sequences: DataFrame, mapping: DataFrame) -> DataFrame:
    """One sequence per gene symbol: the longest, ties by accession."""
    joined = sequences.join(mapping, "accession")
    best = joined.groupBy("symbol").agg(
        F.min_by(F.struct("accession", "sequence"), F.struct(-F.length("sequence"), F.col("accession"))).alias("__s")
    )
    return best.select("symbol", "__s.accession", "__s.sequence")


def best_site_per_spectrum(df: DataFrame, spectrum: Sequence[str], score: str, site: str) -> DataFrame:
    """Best localisation per spectrum, ties by site name; a map-side minimum, no window."""
    best = df.groupBy(*spectrum).agg(F.min(F.struct((-F.col(score)).alias("__neg"), F.col(site))).alias("__b"))
    return best.select(*spectrum, F.col(f"__b.{site}").alias(site), (-F.col("__b.__neg")).alias(score))


def best_localisation(
    candidates: DataFrame, scores: DataFrame, spectrum: Sequence[str], candidate: Sequence[str], score: str = "score", site: str = "site"
) -> DataFrame:
    """Best-scored candidate site of each spectrum by a table of scores; candidates without a score cannot win."""
    keys = [*spectrum, *candidate]
    best = scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.max(score).alias(score))
    return best_site_per_spectrum(candidates.join(best, keys), spectrum, score, site)


def unique_peptides(df: DataFrame, peptide: str = "peptide", accession: str = "accession") -> DataFrame:
    """Rows whose peptide belongs to one accession only."""
    single = df.groupBy(peptide).agg(F.min(accession).alias("__lo"), F.max(accession).alias("__hi"))
    return df.join(single.where(F.col("__lo") == F.col("__hi")).select(peptide), peptide, "left_semi")


def prefer_prior(df: DataFrame, prior: DataFrame, peptide: str = "peptide", accession: str = "accession") -> DataFrame:
    """Of a peptide's accessions keep those in ``prior``; keep all where none is."""
    marked = df.join(prior.select(accession).distinct().withColumn("__prior", F.lit(1)), accession, "left")
    any_prior = marked.groupBy(peptide).agg(F.max("__prior").alias("__any"))
    kept = marked.join(any_prior, peptide).where(F.col("__prior").isNotNull() | F.col("__any").isNull())
    return kept.select(*df.columns)


def greedy_cover(accessions: Sequence[str], peptides: Sequence[str]) -> list[str]:
    """The accession that covers each pair's peptide, when the one with most uncovered peptides is taken again and again.

    Ties go to the smaller name. The heap is lazy: an entry whose count is out of date goes back with the right one.
    """
    holds: dict[str, list[int]] = {}
    for i, name in enumerate(accessions):
        holds.setdefault(name, []).append(i)
    owner: dict[str, str] = {}
    heap = [(-len(own), name) for name, own in holds.items()]
    heapq.heapify(heap)
    while heap:
        count, name = heapq.heappop(heap)
        left = [i for i in holds[name] if peptides[i] not in owner]
        if not left:
            continue
        if len(left) < -count:
            holds[name] = left
            heapq.heappush(heap, (-len(left), name))
            continue
        for i in left:
            owner[peptides[i]] = name
    return [owner[p] for p in peptides]


def parsimonious_accessions(
    df: DataFrame, peptide: str = "peptide", accession: str = "accession", max_rounds: int = 10_000, most_pairs: int = 1 << 20
) -> DataFrame:
    """Greedy cover: (accession, peptide) pairs such that each peptide goes to the accession chosen first.

    The graph of peptides and accessions falls into connected components that have nothing to do with each other. Each
    component of up to ``most_pairs`` pairs is solved in one task, many of them in a single pass; only larger ones go
    through ``cover_rounds``, with the same outcome.
    """
    pairs = cut_lineage(df.select(peptide, accession).where(F.col(peptide).isNotNull() & F.col(accession).isNotNull()).distinct())
    name, other = F.concat(F.lit("a"), F.col(accession).cast("string")), F.concat(F.lit("p"), F.col(peptide).cast("string"))
    nodes = connected_components(pairs.select(F.lit(0).alias("all"), name.alias("a"), other.alias("b")), "all")
    placed = pairs.withColumn("node", name).join(nodes.select("node", "component"), "node").drop("node")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("__n"))
    placed = cut_lineage(placed.join(sizes, "component"))
    small = placed.where(F.col("__n") <= most_pairs).drop("__n")
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = small.repartition(width, "component").sortWithinPartitions("component")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < _SOLVED_AT_ONCE:
                continue
            # the last component may go on in the next batch
            last = held.column("component")[-1]
            whole = pc.not_equal(held.column("component"), last)
            yield from covered(held.filter(whole))
            held = held.filter(pc.invert(whole))
        if held is not None:
            yield from covered(held)

    def covered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names, parts = table.column(accession).to_pylist(), table.column(peptide).to_pylist()
        mine = pa.array([a == b for a, b in zip(names, greedy_cover(names, parts))], pa.bool_())
        yield from table.filter(mine).select([peptide, accession]).to_batches()

    chosen = dealt.mapInArrow(solve, small.select(peptide, accession).schema)
    large = placed.where(F.col("__n") > most_pairs).select(peptide, accession)
    return chosen if large.isEmpty() else chosen.unionByName(cover_rounds(large, peptide, accession, max_rounds))


def cover_rounds(df: DataFrame, peptide: str = "peptide", accession: str = "accession", max_rounds: int = 10_000) -> DataFrame:
    """The same cover for a graph of any size, round by round.

    One-at-a-time greedy takes the accession with most uncovered peptides, ties by name. An accession that
    beats every rival with which it shares an uncovered peptide is taken before all of them whatever
    happens elsewhere, so each round takes all such accessions at once and the outcome is the same.
    """
    left = cut_lineage(df.select(peptide, accession).distinct())
    chosen = left.limit(0)
    for _ in range(max_rounds):
        if left.isEmpty():
            return chosen
        counts = left.groupBy(accession).agg(F.count(F.lit(1)).alias("__n"))
        winners = left.join(counts, accession).groupBy(peptide).agg(
            F.min(F.struct((-F.col("__n")).alias("__neg"), F.col(accession))).alias("__w")
        )
        winners = winners.select(peptide, F.col(f"__w.{accession}").alias("__winner"), (-F.col("__w.__neg")).alias("__n"))
        wins = winners.groupBy("__winner", "__n").agg(F.count(F.lit(1)).alias("__wins"))
        picked = wins.where(F.col("__n") == F.col("__wins")).select("__winner")
        covered = winners.join(picked, "__winner", "left_semi").select(peptide, "__winner")
        marked = cut_lineage(left.join(covered, peptide, "left"))
        chosen = chosen.unionByName(marked.where(F.col(accession) == F.col("__winner")).select(peptide, accession))
        left = marked.where(F.col("__winner").isNull()).select(peptide, accession)
    raise RuntimeError("greedy cover did not end")


def peptides_per_1000(df: DataFrame, sequences: DataFrame, peptide: str = "peptide", accession: str = "accession") -> DataFrame:
    """Distinct peptides per 1000 residues of the protein."""
    counts = df.groupBy(accession).agg(F.count_distinct(peptide).alias("n_peptides"))
    lengths = sequences.select(accession, F.length("sequence").alias("n_residues"))
    return counts.join(lengths, accession).withColumn(
        "per_1000", F.col("n_peptides") * F.lit(1000.0) / F.nullif(F.col("n_residues"), F.lit(0))
    )


def map_modified_sites(df: DataFrame, sequences: DataFrame, *, gene: str = "gene", peptide: str = "peptide") -> DataFrame:
    """Locate each peptide in its protein and name its starred residues: ``GENE-S12sT15t``.

    ``K.AS*PT*R.V`` has flanks and stars; a star follows its residue. The position of star i in the bare
    peptide is the length of the pieces before it. Peptides that the protein does not contain are dropped.
    """
    core = F.regexp_replace(F.regexp_replace(F.col(peptide), r"^[^.]*\.", ""), r"\.[^.]*$", "")
    located = (
        df.join(sequences.select(gene, "sequence"), gene)
        .withColumn("__core", core)
        .withColumn("__start", F.expr("instr(sequence, replace(__core, '*', ''))"))
        .where(F.col("__start") > 0)
    )
    # All pieces but the last end in a modified residue.
    marks = F.expr(
        """
        aggregate(
          slice(split(__core, '[*]'), 1, size(split(__core, '[*]')) - 1),
          named_struct('at', __start - 1, 'text', ''),
          (acc, piece) -> named_struct(
            'at', acc.at + length(piece),
            'text', concat(acc.text, right(piece, 1), cast(acc.at + length(piece) as string), lower(right(piece, 1)))
          )
        ).text
        """
    )
    named = located.withColumn("site_id", F.concat(F.col(gene), F.lit("-"), marks))
    return named.where(F.col("__core").contains("*")).select(*df.columns, "site_id")
