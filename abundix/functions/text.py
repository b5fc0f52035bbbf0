"""String column expressions for ids, sites, visits and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """First match, NULL where there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only; ``pattern`` must have no group of its own, ``replacement`` is literal."""
    found = F.regexp_extract(text, f"^(?s)(.*?)({pattern})(.*)$", 2)
    head = F.regexp_extract(text, f"^(?s)(.*?)({pattern})(.*)$", 1)
    tail = F.regexp_extract(text, f"^(?s)(.*?)({pattern})(.*)$", 3)
    return F.when(found != "", F.concat(head, F.lit(replacement), tail)).otherwise(text)


def site_residues(site: Column, gene: Column) -> Column:
    """``GENE-S12sT15t`` to ``S12;T15``: literal gene prefix off, ``;`` between residues, lower case marks off."""
    body = F.substr(site, F.length(gene) + F.lit(2))
    separated = F.regexp_replace(body, "([STY])", ";$1")
    return F.regexp_replace(F.regexp_replace(separated, "^;+", ""), "[sty]", "")


def before_last_hyphen(text: Column) -> Column:
    return extract(text, r"^(.*)-[^-]*$", 1)


def syntactic_name(text: Column) -> Column:
    """Column-safe name: other characters become a dot, a leading digit gets an ``X``."""
    dotted = F.regexp_replace(text, "[^A-Za-z0-9._]", ".")
    return F.when(dotted.rlike("^[0-9]"), F.concat(F.lit("X"), dotted)).otherwise(dotted)


def pathway_label(term: Column) -> Column:
    """Database prefix off, underscores to blanks."""
    return F.regexp_replace(F.regexp_replace(term, "^[A-Z]+_", ""), "_", " ")


def plex_name(text: Column) -> Column:
    """``Plex`` + digits, whether the text says ``Plex1`` or ``P1``."""
    digits = extract(text, r"P(?:lex)?([0-9]+)", 1)
    return F.concat(F.lit("Plex"), digits)


def visit_parts(description: Column) -> dict[str, Column]:
    """Phase, cycle and day of a visit such as ``P2 Cycle 1 Day 28``."""
    return {
        "phase": F.trim(extract(description, r"P\S+\s")),
        "cycle": extract(description, r"Cycle ([0-9]+)", 1),
        "day": extract(description, r"Day ([0-9]+)", 1),
    }


def cell_line_parts(name: Column) -> dict[str, Column]:
    """Cell line and replicate of a sample name such as ``HS-5 R2``."""
    return {"cell_line": extract(name, r"HS-[0-9]+"), "replicate": extract(name, r"R[0-9]")}


def significance_mark(p: Column, cutoff: float = 0.05) -> Column:
    return F.when(p < cutoff, "*").otherwise("")
