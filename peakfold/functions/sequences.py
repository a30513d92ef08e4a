"""String expressions for modified sequences, identifiers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One residue with its bracketed modification; a leading bracket belongs to the first residue.
TOKEN = r"(?:^\[[^\]]*\])?[A-Z](?:\[[^\]]*\])?"
MODIFICATION = r"\[[^\]]*\]"
PROTON_ACCEPTORS = "KRH"


def tokens(sequence: Column) -> Column:
    return F.regexp_extract_all(sequence, F.lit(TOKEN), F.lit(0))


def strip_modifications(sequence: Column) -> Column:
    return F.regexp_replace(sequence, MODIFICATION, "")


def count_modifications(sequence: Column) -> Column:
    return F.regexp_count(sequence, F.lit(MODIFICATION))


def modification_positions(sequence: Column) -> Column:
    """Positions, from 0, of modified residues."""
    t = tokens(sequence)
    return F.filter(F.transform(t, lambda x, i: F.when(x.contains("["), i).otherwise(F.lit(-1))), lambda i: i >= 0)


def modification_mass(sequence: Column) -> Column:
    """Sum of the bracketed masses."""
    m = F.regexp_extract_all(sequence, F.lit(r"\[([+-]?[0-9.]+)\]"), F.lit(1))
    return F.aggregate(m, F.lit(0.0), lambda s, x: s + x.cast("double"))


def reverse_inside(sequence: Column) -> Column:
    """Reversed between the first and the last residue, modifications kept with their residues."""
    t = tokens(sequence)
    n = F.size(t)
    return F.when(n > 2, F.array_join(F.concat(F.slice(t, 1, 1), F.reverse(F.slice(t, 2, F.greatest(n - 2, F.lit(0)))), F.slice(t, n, 1)), "")).otherwise(sequence)


def expected_charge(sequence: Column) -> Column:
    """1 and one more for each basic residue."""
    plain = strip_modifications(sequence)
    return 1 + F.length(plain) - F.length(F.translate(plain, PROTON_ACCEPTORS, ""))


def psm_id(source: Column, rt: Column, sequence: Column, charge: Column, decoy: Column) -> Column:
    """file:rt:[decoy]sequence+charge"""
    return F.concat(source, F.lit(":"), rt.cast("string"), F.lit(":"), F.when(decoy, F.lit("decoy")).otherwise(F.lit("")), sequence, F.lit("+"), charge.cast("string"))


def parse_psm_id(ident: Column) -> Column:
    """struct<source, rt, decoy, sequence, charge>; the source may hold colons."""
    pattern = r"^(.*):([0-9.]+):(decoy)?(.*)\+([0-9]+)$"
    part = lambda k: F.regexp_extract(ident, pattern, k)
    return F.struct(part(1).alias("source"), part(2).cast("double").alias("rt"), (part(3) != "").alias("decoy"), part(4).alias("sequence"), part(5).cast("int").alias("charge"))


def accessions(joined: Column) -> Column:
    """Distinct sorted accessions of a ;-joined string."""
    return F.array_sort(F.array_distinct(F.filter(F.split(joined, ";"), lambda x: x != "")))


def natural_key(name: Column, width: int = 12) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    padded = F.regexp_replace(name, r"([0-9]+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*([0-9]{{{width}}})(?![0-9])", "$1")


def common_prefix(a: Column, b: Column) -> Column:
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), F.lit(0), lambda s, k: F.when((s == k - 1) & (F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k)), k).otherwise(s))
    return F.substr(a, F.lit(1), n)


def collapse_similar(sequence: Column) -> Column:
    """Residues that count as equal in similarity mapped to one letter: I/L, D/N, Q/E/K."""
    return F.translate(sequence, "INEK", "LDQQ")


def mismatches(a: Column, b: Column) -> Column:
    """Differing positions of two sequences of one length, similar residues equal; null for other lengths."""
    x, y = F.split(collapse_similar(a), ""), F.split(collapse_similar(b), "")
    return F.when(F.length(a) == F.length(b), F.aggregate(F.zip_with(x, y, lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v))


def is_decoy(accession: Column, prefix: str = "DECOY_") -> Column:
    return accession.startswith(prefix)


def is_entrapment(accession_list: Column, marker: str = "shuffle_") -> Column:
    """At least one accession and all of them shuffled."""
    return (F.size(accession_list) > 0) & F.forall(accession_list, lambda a: a.contains(marker))


def lcg(seed: Column, multiplier: int = 1103515245, increment: int = 12345) -> Column:
    """Linear congruential step on signed 32 bits with a truncated remainder (ANSI C rand)."""
    x = seed.cast("decimal(20,0)") * multiplier + increment
    wrapped = F.pmod(x + (1 << 31), F.lit(1 << 32).cast("decimal(20,0)")) - (1 << 31)
    return (wrapped.cast("long") % 2147483647).cast("int")


def unit_interval(random: Column) -> Column:
    """0 to 1 from a signed 32-bit random value."""
    return (random / 2147483647.0 + 1) / 2
