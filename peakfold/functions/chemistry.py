"""Masses, ions, digestion and windows as expressions; constants are fixed physical values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (CODATA / IUPAC masses).
NEUTRON = 1.0086649158849
PROTON = 1.00727646681290
HYDROGEN = 1.007825032071
CARBON = 12.0
NITROGEN = 14.00307400486
OXYGEN = 15.9949146195616
WATER = OXYGEN + 2 * HYDROGEN
AMMONIA = NITROGEN + 3 * HYDROGEN
CARBON_MONOXIDE = CARBON + OXYGEN

# Monoisotopic residue masses.
RESIDUES = {
    "A": 71.037114, "C": 103.009185, "D": 115.026943, "E": 129.042593, "F": 147.068414, "G": 57.021464, "H": 137.058912, "I": 113.084064, "K": 128.094963, "L": 113.084064,
    "M": 131.040485, "N": 114.042927, "P": 97.052764, "Q": 128.058578, "R": 156.101111, "S": 87.032028, "T": 101.047679, "V": 99.068414, "W": 186.079313, "Y": 163.06332,
}

# H, C, O, N, S atoms of residues (C as carbamidomethyl).
ATOMS = {
    "A": (5, 3, 1, 1, 0), "C": (8, 5, 2, 2, 1), "D": (5, 4, 3, 1, 0), "E": (7, 5, 3, 1, 0), "F": (9, 9, 1, 1, 0), "G": (3, 2, 1, 1, 0), "H": (7, 6, 1, 3, 0), "I": (11, 6, 1, 1, 0), "K": (12, 6, 1, 2, 0), "L": (11, 6, 1, 1, 0),
    "M": (9, 5, 1, 1, 1), "N": (6, 4, 2, 2, 0), "P": (7, 5, 1, 1, 0), "Q": (8, 5, 2, 2, 0), "R": (12, 6, 1, 4, 0), "S": (5, 3, 2, 1, 0), "T": (7, 4, 2, 1, 0), "V": (9, 5, 1, 1, 0), "W": (10, 11, 1, 2, 0), "Y": (9, 9, 2, 1, 0),
}

# Cleavage rules as (residues before the cut, residues after it); "*" is any, "^" negates.
ENZYMES = {
    "trypsin": ("KR", "^P"), "trypsin/p": ("KR", "*"), "glu-c": ("DE", "^P"), "lys-c": ("K", "^P"), "lys-n": ("*", "K"), "arg-c": ("R", "^P"), "asp-n": ("*", "DE"),
    "chymotrypsin": ("FYW", "^P"), "elastase": ("AV", "*"), "thermolysin": ("^DE", "AFILMV"), "pepsin": ("FL", "*"), "cnbr": ("M", "*"), "nonspecific": ("*", "*"), "none": ("", ""),
}

# The fitted spacing of peptide masses and the offsets of window edges between them.
MASS_SPACING = 1.00045475
EDGE_OFFSET = {"peptide": 0.25, "phospho": 0.18}


def _class(residues: str) -> str:
    return "[A-Z]" if residues == "*" else f"[{residues}]" if residues else "(?!)"


def cut_pattern(enzyme: str) -> str:
    """Regular expression of the empty string at a cut."""
    before, after = ENZYMES[enzyme]
    return f"(?<={_class(before)})(?={_class(after)})"


def missed_cleavages(sequence: Column, enzyme: str = "trypsin") -> Column:
    return F.when(F.length(sequence) > 0, F.size(F.split(sequence, cut_pattern(enzyme))) - 1).otherwise(F.lit(0))


def pieces(sequence: Column, enzyme: str = "trypsin") -> Column:
    """Fully cleaved pieces of a sequence, in order."""
    return F.when(F.length(sequence) > 0, F.split(sequence, cut_pattern(enzyme))).otherwise(F.array().cast("array<string>"))


def charged_mass(mass: Column, charge: Column) -> Column:
    return (mass + charge * PROTON) / charge


def neutral_mass(mz: Column, charge: Column) -> Column:
    return (mz - PROTON) * charge


def isotope_mz(mz: Column, charge: Column, isotope: int) -> Column:
    return mz + isotope * NEUTRON / charge


def residue_masses(sequence: Column) -> Column:
    """Mass of each residue of a plain sequence; unknown letters weigh nothing."""
    table = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    return F.transform(F.filter(F.split(sequence, ""), lambda a: a != ""), lambda a: F.coalesce(table[a], F.lit(0.0)))


def sequence_mass(sequence: Column) -> Column:
    return F.aggregate(residue_masses(sequence), F.lit(WATER), lambda s, x: s + x)


def b_ions(masses: Column, charge: int = 1) -> Column:
    """Prefix ions of every length but the whole."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(masses) - 1, F.lit(1))), lambda n: F.aggregate(F.slice(masses, 1, n), F.lit(0.0), lambda s, x: s + x, lambda s: (s + charge * PROTON) / charge))


def y_ions(masses: Column, charge: int = 1) -> Column:
    """Suffix ions of every length but the whole."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(masses) - 1, F.lit(1))), lambda n: F.aggregate(F.slice(masses, F.size(masses) - n + 1, n), F.lit(WATER), lambda s, x: s + x, lambda s: (s + charge * PROTON) / charge))


def ion_mobility(mz: Column, charge: Column) -> Column:
    """Estimated 1/k0; a fixed published regression."""
    sq = mz * mz / charge
    return F.lit(-1.660) - 0.3798 * F.log1p(mz) - 2.389e-4 * mz + 0.3957 * F.log1p(sq) + 4.157e-7 * sq + 0.1417 * charge


def collision_cross_section(mobility: Column, mz: Column, charge: Column) -> Column:
    """In nitrogen at 31.85 C; fixed constants of the Mason-Schamp equation."""
    mass = mz * charge * 28.013 / (mz * charge + 28.013)
    return 18509.8632163405 * charge * mobility / F.sqrt(mass * (31.85 + 273.15))


def window_edge(mass: Column, kind: str = "peptide") -> Column:
    """Nearest mass above where few peptides lie."""
    return F.ceil(mass / MASS_SPACING) * MASS_SPACING + EDGE_OFFSET[kind]


def windows(low: float, high: float, width: float, overlap: bool = False) -> list[tuple[float, float]]:
    """Isolation windows between optimal edges; overlapping schemes add windows shifted by half a width."""
    edge = lambda m: math.ceil(m / MASS_SPACING) * MASS_SPACING + EDGE_OFFSET["peptide"]
    n = max(1, round((high - low) / width))
    cuts = [edge(low + k * width) for k in range(n + 1)]
    out = list(zip(cuts, cuts[1:]))
    if overlap:
        half = [edge(low + (k + 0.5) * width) for k in range(-1, n + 1)]
        out += list(zip(half, half[1:]))
    return sorted(out)
