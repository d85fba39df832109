"""Sequence columns: residues, cleavage, occurrences and modification texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols of modification masses, in order of mass (fixed values).
PTM_CODES = ("*", "@", "^", "&", "#", "%", "!")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(sequence: Column | str, residues: str) -> Column:
    """Does the sequence hold any of the residues."""
    return _col(sequence).rlike(f"[{residues}]")


def count_residues(sequence: Column | str, residues: str) -> Column:
    return F.regexp_count(_col(sequence), F.lit(f"[{residues}]"))


def residue_positions(sequence: Column | str, residues: str) -> Column:
    """1-based positions of the residues."""
    c = _col(sequence)
    places = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.filter(places, lambda i: F.lit(residues).contains(F.substring(c, i, F.lit(1))) & (F.length(c) > 0))


def cleave(sequence: Column | str, enzyme: str = "KR", missed: int = 0) -> Column:
    """Peptides cut after the enzyme's residues, with up to ``missed`` inner cut sites."""
    pieces = F.regexp_extract_all(_col(sequence), F.lit(f"[^{enzyme}]*[{enzyme}]|[^{enzyme}]+"), F.lit(0))
    if not missed:
        return pieces

    def runs(extra: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(pieces) - extra)
        joined = F.transform(starts, lambda i: F.array_join(F.slice(pieces, i, F.lit(extra + 1)), ""))
        return F.when(F.size(pieces) > extra, joined).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(pieces, *[runs(extra) for extra in range(1, missed + 1)]))


def semi_forms(peptide: Column | str) -> Column:
    """The peptide with every form that keeps one of its two ends."""
    c = _col(peptide)
    cuts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    heads = F.transform(cuts, lambda i: F.substring(c, F.lit(1), i))
    tails = F.transform(cuts, lambda i: F.substring(c, i, F.length(c)))
    return F.array_distinct(F.concat(heads, tails))


def overlaps_itself(peptide: Column | str) -> Column:
    """Can two occurrences overlap: some proper prefix is also a suffix."""
    c = _col(peptide)
    inner = F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1)))
    return (F.length(c) > 1) & F.exists(inner, lambda k: F.substring(c, F.lit(1), k) == F.substring(c, F.length(c) - k + 1, k))


def occurrences(sequence: Column | str, peptide: Column | str) -> Column:
    """1-based starts of every occurrence of the peptide, overlapping ones included.

    The sequence is split at the peptide and the piece lengths are added up; only a peptide that
    can overlap itself needs the slower zero-width split. Stop signs and other signs count as letters.
    """
    s, p = _col(sequence), _col(peptide)
    overlapping = overlaps_itself(p)
    quoted = F.concat(F.lit("\\Q"), p, F.lit("\\E"))
    pieces = F.when(overlapping, F.split(s, F.concat(F.lit("(?="), quoted, F.lit(")")), -1)).otherwise(F.split(s, quoted, -1))
    lengths = F.transform(pieces, F.length)
    step = F.when(overlapping, F.lit(0)).otherwise(F.length(p))
    before = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    cuts = F.when(
        F.size(lengths) > 1,
        F.transform(F.sequence(F.lit(1), F.size(lengths) - 1), lambda i: before(i) + (i - 1) * step + 1),
    ).otherwise(F.array().cast("array<int>"))
    at_start = F.when(overlapping & F.startswith(s, p), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.concat(at_start, cuts)


def parse_ptm_spec(text: str) -> tuple[float | None, str | None]:
    """``"+79.96@STY"``, ``"K"`` or ``"79.96"`` as (mass, residues); a missing part matches anything."""
    text = text.strip()
    mass_text, _, residues = text.partition("@") if "@" in text else (text, "", "")
    if "@" not in text and re.fullmatch(r"[A-Za-z]+", text):
        mass_text, residues = "", text
    mass = float(mass_text) if mass_text.strip() else None
    residues = residues.strip().upper() or None
    if residues is not None and not residues.isalpha():
        raise ValueError(f"residues expected in modification {text!r}")
    if mass is None and residues is None:
        raise ValueError("a modification needs a mass or residues")
    return mass, residues


def parse_ptm_specs(text: str) -> list[tuple[float | None, str | None]]:
    """A comma list of modifications."""
    return [parse_ptm_spec(part) for part in text.split(",") if part.strip()]


def ptm_code(mass: Column, masses: Column) -> Column:
    """Symbol of a mass by its rank among the sorted distinct masses; beyond the symbols the rank itself."""
    symbols = F.array(*[F.lit(code) for code in PTM_CODES])
    rank = F.array_position(masses, mass).cast("int")
    return F.coalesce(F.try_element_at(symbols, rank), rank.cast("string"))


def full_sequence(sequence: Column | str, ptms: Column | str) -> Column:
    """Sequence with the mass in brackets after each modified residue."""
    s, marks = _col(sequence), _col(ptms)
    letters = F.filter(F.split(s, ""), lambda x: x != "")
    return F.array_join(
        F.transform(
            letters,
            lambda aa, i: F.concat(
                aa,
                F.array_join(
                    F.transform(
                        F.filter(marks, lambda m: m["pos"] == i + 1),
                        lambda m: F.format_string("[%+.2f]", m["delta_mass"]),
                    ),
                    "",
                ),
            ),
        ),
        "",
    )


def position_text(acc: Column, places: Sequence[Column] | Column) -> Column:
    """``P#K15#K18``: an accession with its distinct sorted residue-position texts."""
    return F.concat_ws("#", acc, F.array_sort(F.array_distinct(places)))
