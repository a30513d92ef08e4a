"""Text formats as DataFrames.  Records are split by the text reader's separator and taken apart by expressions, so a file
of any size is read by many tasks and no Python runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.functions import arrays as A
from peakfold.functions.sequences import strip_modifications


def fasta(spark: SparkSession, path: str, keyword: str | None = None) -> DataFrame:
    """accession, annotation, sequence; `keyword` filters on the annotation in lower case.  PEFF is read alike."""
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^>|\r", "").alias("v"))
    raw = raw.where((F.length("v") > 0) & ~F.col("v").startswith("#"))
    head = F.substring_index("v", "\n", 1)
    df = raw.select(F.regexp_extract(head, r"^(\S+)", 1).alias("accession"), head.alias("annotation"), F.upper(F.regexp_replace(F.when(F.col("v").contains("\n"), F.substr("v", F.length(head) + 2)).otherwise(""), r"\s+", "")).alias("sequence"))
    return df if keyword is None else df.where(F.lower("annotation").contains(keyword.lower()))


def peff_variants(df: DataFrame) -> DataFrame:
    """Variants of a PEFF annotation: accession, position, residues."""
    found = F.regexp_extract_all(F.regexp_extract("annotation", r"\\VariantSimple=(\S+)", 1), F.lit(r"\((\d+\|[A-Z*]+)"), F.lit(1))
    x = df.select("accession", F.explode(found).alias("v"))
    return x.select("accession", F.split("v", r"\|")[0].cast("int").alias("position"), F.split("v", r"\|")[1].alias("residues"))


def _peak_lines(text: Column) -> Column:
    """Peaks of all lines that begin with two numbers, by m/z."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([0-9][0-9.eE+-]*[ \t]+[0-9][0-9.eE+-]*)"), F.lit(1))
    p = F.transform(lines, lambda x: F.struct(F.split(x, r"[ \t]+")[0].cast("double").alias("mz"), F.split(x, r"[ \t]+")[1].cast("double").alias("intensity")))
    return F.array_sort(F.filter(p, lambda x: x["intensity"] > 0))


def mgf(spark: SparkSession, path: str) -> DataFrame:
    """title, precursor_mz, charge, rt (seconds), peaks."""
    raw = spark.read.text(path, lineSep="END IONS").where(F.col("value").contains("BEGIN IONS"))
    part = lambda p: F.regexp_extract("value", p, 1)
    return raw.select(part(r"TITLE=([^\r\n]*)").alias("title"), part(r"PEPMASS=([0-9.]+)").try_cast("double").alias("precursor_mz"), part(r"CHARGE=([0-9]+)").try_cast("int").alias("charge"), part(r"RTINSECONDS=([0-9.]+)").try_cast("double").alias("rt"), _peak_lines(F.substring_index("value", "BEGIN IONS", -1)).alias("peaks"))


def msp(spark: SparkSession, path: str, source: str = "msp") -> DataFrame:
    """Library entries of MSP / SPTXT records; modifications are put into the sequence as bracketed names."""
    raw = spark.read.text(path, lineSep="\nName:").where(F.col("value").contains("eaks:"))
    part = lambda p: F.regexp_extract("value", p, 1)
    name = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "^(Name:)?", ""))
    mods = F.filter(F.regexp_extract_all("value", F.lit(r"[(/](\d+,[A-Z],[^)/\s]+)"), F.lit(1)), lambda m: m != "")
    seq = F.regexp_replace(F.substring_index(name, "/", 1), r"[^A-Z\[\]+0-9.-]", "")
    plain = strip_modifications(seq)
    marked = F.aggregate(F.reverse(F.array_sort(F.transform(mods, lambda m: F.struct(F.split(m, ",")[0].cast("int").alias("i"), F.split(m, ",")[2].alias("n"))))), plain, lambda s, m: F.concat(F.substr(s, F.lit(1), m["i"] + 1), F.lit("["), m["n"], F.lit("]"), F.substr(s, m["i"] + 2)))
    return raw.select(
        F.lit(source).alias("source"), part(r"(?:Parent=|PrecursorMZ:\s*)([0-9.]+)").try_cast("double").alias("precursor_mz"), F.coalesce(F.regexp_extract(name, r"/(\d+)", 1).try_cast("int"), F.lit(1)).alias("charge"),
        F.when(F.size(mods) > 0, marked).otherwise(seq).alias("modseq"), plain.alias("seq"), part(r"(?:RetentionTime(?:Mins)?=|iRT=|RTINSECONDS=)([0-9.-]+)").try_cast("double").alias("rt"),
        F.filter(F.split(part(r'Protein="?([^"\r\n ]+)'), ";"), lambda a: a != "").alias("accessions"), _peak_lines(F.regexp_extract("value", r"(?s)eaks:[^\n]*\n(.*)", 1)).alias("peaks"),
    )


def table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited file with a header: strings, blank lines skipped, fields beyond the header dropped, names trimmed."""
    df = spark.read.csv(path, sep=sep, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    return df.toDF(*[c.strip() for c in df.columns])


def first_of(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first column of a list of synonyms that the table has, without regard to case; null if none."""
    have = {c.lower(): c for c in df.columns}
    hit = next((have[n.lower()] for n in names if n.lower() in have), None)
    return F.lit(None).cast(kind) if hit is None else F.col(f"`{hit}`").try_cast(kind)


# Column names that tools write for the same field.
SYNONYMS = {
    "group": ["transition_group_id", "TransitionGroupId"],
    "mz": ["PrecursorMz", "Q1"],
    "charge": ["PrecursorCharge", "Charge"],
    "modseq": ["FullUniModPeptideName", "ModifiedPeptideSequence", "ModifiedPeptide", "LabeledPeptide", "LabeledSequence"],
    "seq": ["PeptideSequence", "StrippedPeptide", "StrippedSequence"],
    "rt": ["NormalizedRetentionTime", "Tr_recalibrated", "iRT", "RetentionTime", "RT"],
    "fragment_mz": ["ProductMz", "FragmentMz", "Q3"],
    "intensity": ["LibraryIntensity", "RelativeIntensity", "RelativeFragmentIntensity"],
    "accession": ["ProteinId", "ProteinName", "UniprotID", "UniProtIds", "ProteinGroups", "Protein"],
    "decoy": ["decoy", "Decoy"],
}


def transition_list(spark: SparkSession, path: str, sep: str = "\t", minutes: bool = True, source: str = "transitions") -> DataFrame:
    """Library entries of a transition list (one row a fragment): decoys and zero peaks go, rt in minutes becomes seconds.

    Rows are grouped by the group id, or by modified sequence and charge where there is none.
    """
    t = table(spark, path, sep)
    get = lambda k, kind="string": first_of(t, SYNONYMS[k], kind)
    x = t.select(get("group").alias("g"), get("mz", "double").alias("precursor_mz"), get("charge", "int").alias("charge"), get("modseq").alias("modseq"), get("seq").alias("seq"), get("rt", "double").alias("rt"), get("fragment_mz", "double").alias("mz"), get("intensity", "double").alias("intensity"), get("accession").alias("acc"), F.coalesce(get("decoy"), F.lit("0")).alias("decoy"))
    x = x.where(~F.lower("decoy").isin("1", "true") & (F.col("intensity") > 0)).withColumn("modseq", F.regexp_replace(F.coalesce("modseq", "seq"), r"^_|_$|^\.|\.$", ""))
    x = x.withColumn("g", F.coalesce("g", F.concat_ws("+", "modseq", F.col("charge").cast("string"))))
    e = x.groupBy("g").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("precursor_mz", "charge", "modseq", "seq", "rt")], F.array_sort(F.collect_set("acc")).alias("accs"), F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    return e.select(F.lit(source).alias("source"), "precursor_mz", "charge", "modseq", F.coalesce("seq", strip_modifications(F.col("modseq"))).alias("seq"), (F.col("rt") * (60 if minutes else 1)).alias("rt"), F.array_distinct(F.flatten(F.transform("accs", lambda a: F.split(a, ";")))).alias("accessions"), "peaks")


def maxquant(spark: SparkSession, path: str, fixed: dict[str, str] | None = None) -> DataFrame:
    """Library entries of an msms table: the row of the lowest PEP for each modified sequence and charge; malformed rows go."""
    from peakfold.operators.aggregates import best_per_key

    t = table(spark, path)
    num = lambda n, k="double": first_of(t, [n], k)
    floats = lambda n: F.transform(F.split(first_of(t, [n]), ";"), lambda v: v.try_cast("double"))
    seq = F.regexp_replace(first_of(t, ["Modified sequence"]), "_", "")
    for residue, mark in (fixed or {}).items():
        seq = F.regexp_replace(seq, residue, f"{residue}[{mark}]")
    x = t.select(first_of(t, ["Raw file"]).alias("source"), num("m/z").alias("precursor_mz"), num("Charge", "int").alias("charge"), F.regexp_replace(F.regexp_replace(seq, r"\(", "["), r"\)", "]").alias("modseq"), first_of(t, ["Sequence"]).alias("seq"), (num("Retention time") * 60).alias("rt"), num("PEP").alias("pep"), F.split(F.coalesce(first_of(t, ["Proteins"]), F.lit("")), ";").alias("accessions"), A.peaks(floats("Masses"), floats("Intensities")).alias("peaks"), F.coalesce(first_of(t, ["Reverse"]), F.lit("")).alias("reverse"))
    x = x.where(F.col("charge").isNotNull() & F.col("pep").isNotNull() & (F.col("reverse") != "+") & F.forall("peaks", lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull()) & (F.size("peaks") > 0)).drop("reverse")
    return best_per_key(x.withColumn("score", -F.log10(F.greatest("pep", F.lit(1e-300)))).withColumn("peaks", F.array_sort("peaks")), ["modseq", "charge"], "score", [F.col("source"), F.col("rt")])


def ms2pip(spark: SparkSession, peprec: str, predictions: str) -> DataFrame:
    """Library entries of a peptide list joined with predicted peaks on the spectrum id."""
    p = table(spark, peprec, " ").select(F.col("spec_id"), F.col("peptide").alias("seq"), F.col("charge").cast("int").alias("charge"), F.col("modifications"))
    y = table(spark, predictions, ",").select("spec_id", F.struct(F.col("mz").cast("double").alias("mz"), F.col("prediction").cast("double").alias("intensity")).alias("p")).groupBy("spec_id").agg(F.array_sort(F.collect_list("p")).alias("peaks"))
    return p.join(y, "spec_id")


def scored_results(spark: SparkSession, path: str, threshold: float | None = None, decoys: bool = False, strict: bool = True) -> DataFrame:
    """psm_id, score, q, pep, peptide, accessions of a results table; the trailer that holds pi_0 is no row."""
    t = table(spark, path)
    x = t.select(first_of(t, ["PSMId"]).alias("psm_id"), first_of(t, ["score"], "double").alias("score"), first_of(t, ["q-value"], "double").alias("q"), first_of(t, ["posterior_error_prob"], "double").alias("pep"), first_of(t, ["peptide"]).alias("peptide"), F.filter(F.split(F.coalesce(first_of(t, ["proteinIds"]), F.lit("")), ";"), lambda a: a != "").alias("accessions"))
    x = x.where(~F.col("psm_id").startswith("pi_0=") & F.col("q").isNotNull())
    if threshold is not None:
        x = x.where(F.col("q") < threshold if strict else F.col("q") <= threshold)
    return x if decoys else x.where(~F.exists("accessions", lambda a: a.startswith("DECOY_")))


def pi_zero(spark: SparkSession, path: str) -> float | None:
    """The pi_0 of a results table's trailer."""
    row = spark.read.text(path).where(F.col("value").startswith("pi_0=")).select(F.regexp_extract("value", r"pi_0=([0-9.eE+-]+)", 1).cast("double")).first()
    return row[0] if row else None


def target_list(spark: SparkSession, path: str) -> DataFrame:
    """Scheduled targets: mz, charge, start, stop (seconds)."""
    t = table(spark, path, ",")
    return t.select(first_of(t, ["m/z", "mz"], "double").alias("mz"), first_of(t, ["z", "charge"], "int").alias("charge"), (first_of(t, ["t start (min)", "start"], "double") * 60).alias("start"), (first_of(t, ["t stop (min)", "stop"], "double") * 60).alias("stop"))
