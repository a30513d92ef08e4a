"""Table-valued generators: arrays by expressions, rows by explode; no Python rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakfold.functions import chemistry as chem
from peakfold.functions.sequences import reverse_inside, tokens


def digest(df: DataFrame, sequence: str, enzyme: str = "trypsin", missed: int = 1, least: int = 6, most: int = 40, start_methionine: bool = True) -> DataFrame:
    """One row a peptide: `peptide`, `start` (from 0), `missed`.  A protein's first M may be lost."""
    parts = df.withColumn("__p", chem.pieces(F.col(sequence), enzyme))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__p") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(missed), F.size("__p") - 1 - i)), lambda m: F.struct(i.alias("i"), m.alias("m")))))
    x = parts.where(F.size("__p") > 0).withColumn("__s", F.explode(spans))
    x = x.withColumn("peptide", F.array_join(F.slice("__p", F.col("__s.i") + 1, F.col("__s.m") + 1), "")).withColumn("missed", F.col("__s.m"))
    x = x.withColumn("start", F.length(F.array_join(F.slice("__p", F.lit(1), F.col("__s.i")), "")))
    if start_methionine:
        both = F.when((F.col("start") == 0) & F.col("peptide").startswith("M"), F.array(F.struct(F.col("peptide").alias("p"), F.col("start").alias("s")), F.struct(F.substr("peptide", F.lit(2)).alias("p"), F.lit(1).alias("s"))))
        x = x.withColumn("__e", F.explode(F.coalesce(both, F.array(F.struct(F.col("peptide").alias("p"), F.col("start").alias("s"))))))
        x = x.withColumn("peptide", F.col("__e.p")).withColumn("start", F.col("__e.s")).drop("__e")
    return x.where(F.length("peptide").between(least, most)).drop("__p", "__s")


def modified_forms(df: DataFrame, sequence: str, residues: str, mass: str) -> DataFrame:
    """The sequence and each form with one modified residue."""
    t = tokens(F.col(sequence))
    sites = F.filter(F.transform(t, lambda x, i: F.when(F.lit(residues).contains(x), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    forms = F.transform(sites, lambda i: F.array_join(F.transform(t, lambda x, j: F.when(i == j, F.concat(x, F.lit(mass))).otherwise(x)), ""))
    return df.withColumn("form", F.explode(F.concat(F.array(F.col(sequence)), forms)))


def site_choices(df: DataFrame, sequence: str, residues: str, k: int) -> DataFrame:
    """Every choice of k sites (k at most 5) among the given residues, as a sorted array of positions from 0."""
    if not 1 <= k <= 5:
        raise ValueError("between one and five sites")
    site = lambda x: F.array_contains(F.split(F.lit(residues), ""), x)
    sites = F.filter(F.transform(tokens(F.col(sequence)), lambda x, i: F.when(site(x), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    x = df.withColumn("__all", sites).withColumn("sites", F.transform("__all", lambda i: F.array(i))).withColumn("sites", F.explode("sites"))
    for _ in range(k - 1):
        x = x.withColumn("__n", F.explode(F.filter("__all", lambda i: i > F.element_at("sites", -1)))).withColumn("sites", F.concat("sites", F.array("__n"))).drop("__n")
    return x.drop("__all")


def _labelled(ions: Column, name: str, charge: int) -> Column:
    return F.transform(ions, lambda z, i: F.struct(F.lit(name).alias("ion"), (i + 1).alias("index"), F.lit(charge).alias("charge"), z.alias("mz")))


def fragments(df: DataFrame, sequence: str, most_charge: int = 2) -> DataFrame:
    """One row an ion: `ion` (b or y), `index`, `charge`, `mz` of a plain sequence."""
    m = chem.residue_masses(F.col(sequence))
    rows = []
    for c in range(1, most_charge + 1):
        for name, ions in (("b", chem.b_ions(m, c)), ("y", chem.y_ions(m, c))):
            rows.append(_labelled(ions, name, c))
    x = df.where(F.length(sequence) > 1).withColumn("__f", F.explode(F.concat(*rows)))
    return x.select(*df.columns, "__f.ion", "__f.index", "__f.charge", "__f.mz")


def charge_states(df: DataFrame, low: Column, high: Column) -> DataFrame:
    return df.withColumn("charge", F.explode(F.sequence(low, high)))


def with_decoys(df: DataFrame, sequence: str, ident: str, extra: float = 0.0, seed: int = 1) -> DataFrame:
    """Target, decoy and, for a share `extra` drawn by hash, a second decoy (rotated)."""
    s = F.col(sequence)
    rotated = F.concat(F.substr(s, F.lit(1), F.lit(1)), F.substr(s, F.lit(3), F.length(s) - 3), F.substr(s, F.lit(2), F.lit(1)), F.substr(s, F.length(s)))
    draw = F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(1 << 30)) / (1 << 30) < extra
    kinds = F.array(F.struct(F.lit("target").alias("kind"), s.alias("s")), F.struct(F.lit("decoy").alias("kind"), reverse_inside(s).alias("s")))
    kinds = F.when(draw, F.concat(kinds, F.array(F.struct(F.lit("entrapment").alias("kind"), rotated.alias("s"))))).otherwise(kinds)
    return df.withColumn("__k", F.explode(kinds)).withColumn("kind", F.col("__k.kind")).withColumn(sequence, F.col("__k.s")).drop("__k")


def shifted_peaks(peaks: Column, targets: Column, shift: float, ppm: float) -> Column:
    """Peaks near a target moved by `shift`, others kept; sorted by m/z."""
    from peakfold.functions.arrays import within_ppm

    hit = lambda p: F.exists(targets, lambda t: within_ppm(p["mz"], t, ppm))
    return F.array_sort(F.transform(peaks, lambda p: F.struct((p["mz"] + F.when(hit(p), F.lit(shift)).otherwise(F.lit(0.0))).alias("mz"), p["intensity"].alias("intensity"))))


def polymer_series(spark, unit: float, adduct: float, low: float, high: float) -> DataFrame:
    """m/z of n units plus an adduct within a range."""
    first, last = int(max(1, -(-(low - adduct) // unit))), int((high - adduct) // unit)
    return spark.range(first, max(first, last + 1)).select(F.col("id").cast("int").alias("units"), (F.col("id") * unit + adduct).alias("mz"))


def range_bins(spark, low: float, high: float, n: int) -> DataFrame:
    step = (high - low) / n
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), (low + F.col("id") * step).alias("start"), (low + (F.col("id") + 1) * step).alias("stop"))
