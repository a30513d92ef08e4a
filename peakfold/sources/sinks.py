"""Sinks.  Text formats are one expression a record, written by Spark's text writer in parallel."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfold.functions.sequences import strip_modifications
from peakfold.sources import binary, text


def write_scans(df: DataFrame, path: str, partition: list[str]) -> None:
    """Scans by window, sorted by rt inside, so that a window's slice is a range of row groups."""
    df.repartition(*partition).sortWithinPartitions(*partition, "rt").write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_library(tables: dict[str, DataFrame], path: str) -> None:
    """A library as one Parquet table each for entries, bridge, scores, quantities."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_library(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_features(df: DataFrame, path: str, key: list[str], score: str, ident: str, most_rank: int = 2) -> None:
    """Feature TSV: at most `most_rank` rows of each key by score, sorted by id."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), ident)
    x = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most_rank).drop("__r")
    x.orderBy(ident).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_results(df: DataFrame, path: str, pi0: float) -> None:
    """Scored results with the trailer row that holds pi_0."""
    names = df.columns
    body = df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in names]).alias("value"), F.lit(1).alias("k"), F.monotonically_increasing_id().alias("i"))
    spark = df.sparkSession
    ends = spark.createDataFrame([("\t".join(names), 0, 0), (f"pi_0={pi0}", 2, 0)], "value string, k int, i long")
    body.unionByName(ends).orderBy("k", "i").select("value").coalesce(1).write.mode("overwrite").text(path)


def _peak_text(sep: str = "\t"):
    return F.array_join(F.transform("peaks", lambda p: F.concat_ws(sep, p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")


def write_mgf(df: DataFrame, path: str) -> None:
    """title, precursor_mz, charge, rt, peaks."""
    df.select(F.concat(F.lit("BEGIN IONS\nTITLE="), "title", F.lit("\nPEPMASS="), F.col("precursor_mz").cast("string"), F.lit("\nCHARGE="), F.col("charge").cast("string"), F.lit("+\nRTINSECONDS="), F.col("rt").cast("string"), F.lit("\n"), _peak_text(" "), F.lit("\nEND IONS"))).write.mode("overwrite").text(path)


def write_msp(df: DataFrame, path: str) -> None:
    """Library entries as MSP records."""
    head = F.concat(F.lit("Name: "), "seq", F.lit("/"), F.col("charge").cast("string"), F.lit("\nComment: Parent="), F.col("precursor_mz").cast("string"), F.lit(" RetentionTime="), F.coalesce(F.col("rt").cast("string"), F.lit("0")), F.lit(' Protein="'), F.array_join("accessions", ";"), F.lit('"\nNum peaks: '), F.size("peaks").cast("string"), F.lit("\n"))
    df.select(F.concat(head, _peak_text(), F.lit("\n"))).write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    df.select(F.concat(F.lit(">"), "annotation", F.lit("\n"), F.rtrim(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n")))).write.mode("overwrite").text(path)


def write_transitions(df: DataFrame, path: str) -> None:
    """Library entries as a transition list, a row a fragment; rt in minutes."""
    x = df.withColumn("p", F.explode("peaks"))
    x.select(F.concat_ws("+", "modseq", F.col("charge").cast("string")).alias("transition_group_id"), F.col("precursor_mz").alias("PrecursorMz"), F.col("charge").alias("PrecursorCharge"), F.col("modseq").alias("ModifiedPeptideSequence"), strip_modifications(F.col("modseq")).alias("PeptideSequence"), (F.col("rt") / 60).alias("NormalizedRetentionTime"), F.col("p.mz").alias("ProductMz"), F.col("p.intensity").alias("LibraryIntensity"), F.array_join("accessions", ";").alias("ProteinId")).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_prediction_request(df: DataFrame, path: str, low: int = 2, high: int = 3, energy: int = 33) -> None:
    """Distinct sequences by charge for a fragment predictor."""
    df.select(F.col("modseq").alias("modified_sequence")).distinct().select("modified_sequence", F.lit(energy).alias("collision_energy"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("precursor_charge")).write.mode("overwrite").csv(path, header=True)


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_irt_database(df: DataFrame, path: str) -> None:
    """A retention database for other tools: a local file on the driver, rows streamed to it; small by nature."""
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE IrtLibrary (Id INTEGER PRIMARY KEY, PeptideModSeq TEXT, Irt REAL)")
    con.executemany("INSERT INTO IrtLibrary (PeptideModSeq, Irt) VALUES (?, ?)", ((r["modseq"], r["irt"]) for r in df.select("modseq", "irt").toLocalIterator()))
    con.commit()
    con.close()


def write_blib(df: DataFrame, path: str) -> None:
    """A spectral library for other tools; as write_irt_database."""
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE RefSpectra (id INTEGER PRIMARY KEY, peptideSeq TEXT, peptideModSeq TEXT, precursorMZ REAL, precursorCharge INTEGER, retentionTime REAL, copies INTEGER)")
    con.execute("CREATE TABLE RefSpectraPeaks (RefSpectraID INTEGER, peakMZ BLOB, peakIntensity BLOB)")
    for i, r in enumerate(df.select("seq", "modseq", "precursor_mz", "charge", "rt", "peaks").toLocalIterator(), 1):
        con.execute("INSERT INTO RefSpectra VALUES (?, ?, ?, ?, ?, ?, 1)", (i, r["seq"], r["modseq"], r["precursor_mz"], r["charge"], (r["rt"] or 0) / 60))
        con.execute("INSERT INTO RefSpectraPeaks VALUES (?, ?, ?)", (i, binary.pack_blob([p["mz"] for p in r["peaks"]], True), binary.pack_blob([p["intensity"] for p in r["peaks"]], False)))
    con.commit()
    con.close()


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".parquet": lambda s, p: s.read.parquet(p), ".mzml": binary.mzml, ".mgf": text.mgf, ".msp": text.msp, ".sptxt": text.msp, ".fasta": text.fasta, ".fa": text.fasta, ".peff": text.fasta,
    ".traml": binary.traml, ".blib": binary.blib, ".irtdb": binary.irt_database, ".tsv": text.transition_list, ".csv": lambda s, p: text.transition_list(s, p, ","),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The reader that a path's ending names."""
    low = path.lower().rstrip("/")
    for ending, reader in READERS.items():
        if low.endswith(ending):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")


def predicted(df: DataFrame, client: Callable[[list[str]], list[float]], column: str, out: str, batch: int = 1000) -> DataFrame:
    """A column of predictions from a pluggable client (service or model), asked in batches on the executors."""
    @F.pandas_udf("double")
    def ask(v: pd.Series) -> pd.Series:
        return pd.Series([x for a in range(0, len(v), batch) for x in client(v.iloc[a : a + batch].tolist())], index=v.index, dtype=float)

    return df.withColumn(out, ask(F.col(column)))


def write_quant_reports(peptides: DataFrame, proteins: DataFrame, path: str) -> None:
    """Reports of quantities for other tools, each a folder of text files under `path`.

    peptides: modseq, seq, accessions, run, intensity, n_ions; proteins: accessions, run, intensity, n_peptides, sequences.
    peptides and proteins (a row each, a column a run, 0 where a run has none), diffacto (plain sequence and protein by run, empty
    where a run has none), diffacto_samples (run and sample group) and variation (of each peptide over the runs: mean, deviation and
    their ratio).
    """
    runs = [r[0] for r in peptides.select("run").distinct().orderBy("run").collect()]  # a column each
    tab = lambda df, name: df.write.mode("overwrite").csv(f"{path}/{name}", sep="\t", header=True)
    wide = peptides.groupBy("modseq", F.col("accessions").alias("Protein")).pivot("run", runs).agg(F.sum("intensity"))
    sizes = peptides.groupBy("modseq").agg(F.max("n_ions").alias("numFragments"))
    out = wide.join(sizes, "modseq").select(F.col("modseq").alias("Peptide"), "Protein", "numFragments", *[F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(r) for r in runs])
    tab(out.orderBy("Peptide"), "peptides")
    wide = proteins.groupBy(F.col("accessions").alias("Protein")).pivot("run", runs).agg(F.sum("intensity"))
    sizes = proteins.groupBy(F.col("accessions").alias("Protein")).agg(F.max("n_peptides").alias("NumPeptides"), F.max("sequences").alias("PeptideSequences"))
    tab(wide.join(sizes, "Protein").select("Protein", "NumPeptides", "PeptideSequences", *[F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(r) for r in runs]).orderBy("Protein"), "proteins")
    peptides.groupBy(F.col("seq").alias("sequences"), F.col("accessions").alias("Protein")).pivot("run", runs).agg(F.sum("intensity")).orderBy("sequences").write.mode("overwrite").csv(f"{path}/diffacto", header=True)
    groups = peptides.select("run").distinct().withColumn("sample", F.concat(F.lit("S"), (F.array_position(F.array(*[F.lit(r) for r in runs]), F.col("run"))).cast("string")))
    groups.orderBy("run").write.mode("overwrite").csv(f"{path}/diffacto_samples", sep="\t")
    spread = peptides.groupBy("modseq", "run").agg(F.sum("intensity").alias("x")).groupBy("modseq").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("stdev"))
    tab(spread.withColumn("cv", F.try_divide("stdev", "mean")).orderBy("modseq"), "variation")


def write_localizations(df: DataFrame, path: str) -> None:
    """Localised forms as a table: modseq, annotation, rt, score, n_ions, n_mods, site_specific, localized, ions, localizing_intensity,
    total_intensity under the names that other tools read."""
    # The columns of the format, in its order.
    names = {
        "modseq": "peptideModSeq", "annotation": "localizationPeptideModSeq", "rt": "retentionTimeApexInSeconds", "score": "localizationScore", "n_ions": "numIdentificationPeaks", "n_mods": "numberOfMods", "site_specific": "isSiteSpecific", "localized": "isLocalized",
        "ions": "localizingIons", "localizing_intensity": "localizingIntensity", "total_intensity": "totalIntensity",
    }
    df.select(*[F.col(k).alias(v) for k, v in names.items()]).write.mode("overwrite").csv(path, sep="\t", header=True)
