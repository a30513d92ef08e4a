"""Variants and decoys: codons, decoys that collide with nothing, alleles that compete on the ions that tell them apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.functions import chemistry as chem
from peakfold.functions import sequences as seq
from peakfold.operators import windows as win
from peakfold.operators.joins import SMALL, band_anti, band_join, small_side

# The standard genetic code, residues of the codons in the order of BASES at each place; * ends.
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


# -- codons ------------------------------------------------------------------------------------------------------------


def translate(dna: Column, frame: int = 0) -> Column:
    """Residues of a coding sequence from a frame on, * for ends and X for codons with other letters; a rest of one or two bases is
    left out; U reads as T."""
    plain = F.replace(F.upper(dna), F.lit("U"), F.lit("T"))
    n = F.floor((F.length(plain) - frame) / 3).cast("int")

    def residue(i: Column) -> Column:
        codon = F.substr(plain, i * 3 + 1 + frame, F.lit(3))
        place = [F.instr(F.lit(BASES), F.substr(codon, F.lit(k + 1), F.lit(1))) - 1 for k in range(3)]
        return F.when(codon.rlike(f"^[{BASES}]{{3}}$"), F.substr(F.lit(CODE), place[0] * 16 + place[1] * 4 + place[2] + 1, F.lit(1))).otherwise(F.lit("X"))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), residue), "")).when(dna.isNotNull(), F.lit(""))


def one_base_changes() -> dict[str, str]:
    """Residues that a change of one base makes of each residue, sorted; ends left out."""
    codons = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    out: dict[str, set[str]] = {}
    for codon, residue in codons.items():
        for place in range(3):
            for base in BASES:
                other = codons[codon[:place] + base + codon[place + 1 :]]
                if "*" not in (residue, other) and other != residue:
                    out.setdefault(residue, set()).add(other)
    return {r: "".join(sorted(s)) for r, s in sorted(out.items())}


def single_variants(df: DataFrame, sequence: str) -> DataFrame:
    """Every sequence that one changed base can make of a plain sequence: columns of df, position (from 1), was, becomes, variant."""
    table = F.create_map(*[F.lit(x) for kv in one_base_changes().items() for x in kv])
    s = F.col(sequence)
    x = df.select("*", F.posexplode(F.split(s, "(?!^)")).alias("__p", "was")).withColumn("becomes", F.explode(F.split(F.coalesce(F.try_element_at(table, F.col("was")), F.lit("")), "(?!^)"))).where("becomes <> ''")
    x = x.withColumn("position", F.col("__p") + 1)
    return x.withColumn("variant", F.concat(F.substr(s, F.lit(1), F.col("__p")), F.col("becomes"), F.substr(s, F.col("__p") + 2))).select(*df.columns, "position", "was", "becomes", "variant")


# -- decoys ------------------------------------------------------------------------------------------------------------


def reversed_inside(t: Column) -> Column:
    """Tokens with all but the ends in reverse."""
    return F.when(F.size(t) > 2, F.concat(F.slice(t, 1, 1), F.reverse(F.slice(t, 2, F.size(t) - 2)), F.slice(t, F.size(t), 1))).otherwise(t)


def shuffled_inside(t: Column, seed: Column) -> Column:
    """Tokens with all but the ends in an order that their own text and the seed decide."""
    text = F.array_join(t, "")
    keyed = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(text, i, seed).alias("k"), x.alias("x")))
    return F.when(F.size(t) > 2, F.concat(F.slice(t, 1, 1), F.transform(F.array_sort(keyed), lambda p: p["x"]), F.slice(t, F.size(t), 1))).otherwise(t)


def _ions(sequence: str) -> np.ndarray:
    m = np.array([chem.RESIDUES.get(a, 0.0) for a in sequence])
    b = np.cumsum(m)[:-1] + chem.PROTON
    return np.concatenate([b, np.cumsum(m[::-1])[:-1] + chem.WATER + chem.PROTON])


def shared_ions(a: Column, b: Column, ppm: float) -> Column:
    """Share of b's singly charged ions that a has within the tolerance, of plain sequences; 0 without ions."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            u, v = np.sort(_ions(p or "")), _ions(q or "")
            if not len(v) or not len(u):
                out.append(0.0)
                continue
            i = np.clip(np.searchsorted(u, v), 1, max(len(u) - 1, 1))
            near = np.minimum(np.abs(u[np.minimum(i, len(u) - 1)] - v), np.abs(u[i - 1] - v))
            out.append(float((near <= v * ppm * 1e-6).mean()))
        return pd.Series(out)

    return run(a, b)


def checked_decoys(df: DataFrame, sequence: str, background: DataFrame, tries: int = 3, most_shared: float | None = None, ppm: float = 10.0) -> DataFrame:
    """df with `decoy` and `attempt`: the reverse of each sequence (ends kept, modifications with their residues), or else the
    first of `tries` shuffles that is no sequence of the background and, if `most_shared` is given, shares at most that part of
    the target's ions; the last shuffle if none is (`attempt` is tries + 1 then).

    All tries are laid out at once and meet the background (one column of sequences) in one join, instead of a join a try.  A
    decoy depends on nothing but its sequence, so each different sequence is tried once, however many rows have it.
    """
    own = df.select(sequence).distinct()
    t = seq.tokens(F.col(sequence))
    first = F.struct(reversed_inside(t).alias("t"), F.lit(0).alias("k"))
    more = lambda prev, k: F.struct(shuffled_inside(prev, F.lit(k)).alias("t"), F.lit(k).alias("k"))
    x = own.withColumn("__c0", first)
    for k in range(1, tries + 1):
        x = x.withColumn(f"__c{k}", more(F.col(f"__c{k - 1}.t"), k))
    names = [f"__c{k}" for k in range(tries + 1)]
    each = x.select(sequence, F.explode(F.array(*names)).alias("__c")).withColumn("decoy", F.array_join("__c.t", "")).withColumn("attempt", F.col("__c.k")).drop("__c")
    known = background.select(F.col(background.columns[0]).alias("decoy")).distinct().withColumn("__taken", F.lit(True))
    each = each.join(known, "decoy", "left")
    ok = F.col("__taken").isNull()
    if most_shared is not None:
        ok = ok & (shared_ions(seq.strip_modifications(F.col(sequence)), seq.strip_modifications(F.col("decoy")), ppm) <= most_shared)
    best = each.withColumn("__ok", ok).groupBy(F.col(sequence).alias("__s")).agg(
        F.coalesce(F.min(F.when(F.col("__ok"), F.struct("attempt", "decoy"))), F.struct(F.lit(tries + 1).alias("attempt"), F.max(F.struct("attempt", "decoy"))["decoy"].alias("decoy"))).alias("__b")
    )
    if own.limit(SMALL + 1).count() <= SMALL:
        best = F.broadcast(best)  # a row a sequence, counted
    return df.join(best, F.col(sequence).eqNullSafe(F.col("__s"))).select(*df.columns, F.col("__b.decoy").alias("decoy"), F.col("__b.attempt").alias("attempt"))


# -- alleles that compete ------------------------------------------------------------------------------------------------


def telling_ions(ions: DataFrame, batch: list[str], form: str, mz: str, ppm: float) -> DataFrame:
    """Ions of a form that no other form of its batch has within the tolerance."""
    other = ions.select(*[F.col(b).alias(f"__{b}") for b in batch], F.col(form).alias("__form"), F.col(mz).alias("__mz")).distinct()
    same = F.lit(True)
    for b in batch:
        same = same & (F.col(b) == F.col(f"__{b}"))
    return band_anti(ions, other, mz, "__mz", ppm, same & (F.col(form) != F.col("__form")))


def allele_competition(primary: DataFrame, ions: DataFrame, peaks: DataFrame, batch: list[str], form: str, width: float, scans: int = 5, ppm: float = 10.0, minimum: float = 3.0, fewest: int = 3) -> DataFrame:
    """Which of a site's alleles the scans speak for.

    primary: batch, form, at, rt, primary (say the XCorr of the form in each scan), dense over scans; ions: batch, form, mz,
    frequency (of such an ion by chance in the window); peaks: batch, at, mz, the acquired peaks that the batch may be in.
    Targets and decoys are batches of their own.

    A form is looked for within `width` in rt of its best scan (the first of equals), at the scan where the ions that only it
    has are least likely by chance: the sum of -log10 frequency over those with a peak, ties to the greater primary, averaged with
    Gaussian weights over `scans`, then to the earlier scan.  It is localised with a score of `minimum` and `fewest` such
    ions.  All localised forms are reported; a batch without any reports its form of the greatest primary there.

    Returns batch, form, at, rt, primary, localization, n_ions, localized, reported; forms without a scan have no row.  Tables here hold
    a row a scan, which Spark takes for fewer where they were laid out by `explode`; none of them is broadcast.
    """
    own = [*batch, form]
    order = win.over(own, ["at"])
    p = primary.withColumn("__avg", win.gaussian_average("primary", order, scans))
    start = p.groupBy(*own).agg(F.min_by("rt", F.struct(-F.col("primary"), F.col("at"))).alias("__rt"))
    near = p.join(start.hint("merge"), own).where(F.abs(F.col("rt") - F.col("__rt")) < width)
    telling = telling_ions(ions, batch, form, "mz", ppm).select(*own, F.col("mz").alias("__ion"), "frequency").distinct()
    named = peaks.select(*[F.col(b).alias(f"__{b}") for b in batch], F.col("at").alias("__at"), F.col("mz").alias("__peak"))
    same = F.lit(True)
    for b in batch:
        same = same & (F.col(b) == F.col(f"__{b}"))
    hits = band_join(telling, named, "__ion", "__peak", ppm, same).select(*own, "__ion", "frequency", F.col("__at").alias("at")).distinct()
    local = hits.groupBy(*own, "at").agg(F.sum(-F.log10("frequency")).alias("localization"), F.count(F.lit(1)).alias("n_ions"))
    x = near.join(local.hint("merge"), [*own, "at"], "left").withColumns({"localization": F.coalesce("localization", F.lit(0.0)), "n_ions": F.coalesce("n_ions", F.lit(0))})
    best = Window.partitionBy(*own).orderBy(F.desc(F.round("localization", 9)), F.desc(F.round("__avg", 9)), "at")
    x = x.withColumn("__r", F.row_number().over(best)).where("__r = 1").withColumn("localized", (F.round("localization", 9) >= minimum) & (F.col("n_ions") >= fewest))
    any_ = F.max("localized").over(Window.partitionBy(*batch))
    first = F.row_number().over(Window.partitionBy(*batch).orderBy(F.desc("primary"), form)) == 1
    return x.withColumn("reported", F.when(any_, F.col("localized")).otherwise(first)).select(*own, "at", "rt", "primary", "localization", "n_ions", "localized", "reported")


# -- scores by chance ----------------------------------------------------------------------------------------------------


def chance_scores(ions: DataFrame, key: list[str], background: DataFrame | None = None, ppm: float = 10.0) -> DataFrame:
    """Auxiliary scores of matched ions: ions (key, mz, library, intensity (0 where unmatched), magnitude (of the spectrum),
    length (of the sequence), window); background (window, mass, frequency).

    raw (sum of library times intensity), similarity (over the magnitude), weighted (mean of the products weighted by m/z, over the
    matched masses), n_above (products over raw / (length + 1)), n_matched; with a background, expected (ions that chance alone would
    match in that window) and excess over it.
    """
    hit = F.col("intensity") > 0
    product = F.when(hit, F.col("library") * F.col("intensity"))
    x = ions.withColumn("__p", product).withColumn("__raw", F.coalesce(F.sum("__p").over(Window.partitionBy(*key)), F.lit(0.0)))
    aggs = [
        F.max("__raw").alias("raw"), F.coalesce(F.try_divide(F.max("__raw"), F.max("magnitude")), F.lit(0.0)).alias("similarity"), F.coalesce(F.try_divide(F.sum(F.col("__p") * F.col("mz")), F.sum(F.when(hit, F.col("mz")))), F.lit(0.0)).alias("weighted"),
        F.count_if(F.col("__p") > F.col("__raw") / (F.col("length") + 1)).alias("n_above"), F.count_if(hit).alias("n_matched"),
    ]
    if background is None:
        return x.groupBy(*key).agg(*aggs)
    named = small_side(background.select(F.col("window").alias("__w"), F.col("mass").alias("__m"), F.col("frequency").alias("__f")))
    masses = x.select("window", "mz").distinct()
    chance = band_join(masses, named, "mz", "__m", ppm, F.col("window") == F.col("__w")).groupBy("window", "mz").agg(F.least(F.lit(1.0), F.sum("__f")).alias("__chance"))
    x = x.join(chance, ["window", "mz"], "left")
    out = x.groupBy(*key).agg(*aggs, F.coalesce(F.sum("__chance"), F.lit(0.0)).alias("expected"))
    return out.withColumn("excess", F.col("n_matched") - F.col("expected"))
