"""Names of ions and modifications, and sequences whose modified sites are not certain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic masses of common modifications, by name.
MODIFICATIONS = {
    "Acetyl": 42.010565, "Amidated": -0.984016, "Carbamidomethyl": 57.021464, "Carbamyl": 43.005814, "Deamidated": 0.984016, "Dimethyl": 28.0313, "GG": 114.042927, "Gln->pyro-Glu": -17.026549,
    "Glu->pyro-Glu": -18.010565, "HexNAc": 203.079373, "Label:13C(6)": 6.020129, "Label:13C(6)15N(2)": 8.014199, "Label:13C(6)15N(4)": 10.008269, "Methyl": 14.01565, "Oxidation": 15.994915, "Phospho": 79.966331,
    "Propionyl": 56.026215, "Succinyl": 100.016044, "Sulfo": 79.956815, "TMT6plex": 229.162932, "Trimethyl": 42.04695,
}


def _entries(known: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("mass")) for n, m in sorted(known.items())])


def nearest_modification(mass: Column, tolerance: float = 0.01, known: dict[str, float] | None = None) -> Column:
    """struct(name, mass) of the known modification nearest to a mass within the tolerance, ties to the name that sorts first;
    else null."""
    close = F.array_sort(F.transform(F.filter(_entries(known or MODIFICATIONS), lambda m: F.abs(m["mass"] - mass) <= tolerance), lambda m: F.struct(F.abs(m["mass"] - mass).alias("d"), m["name"].alias("name"), m["mass"].alias("mass"))))
    return F.when(F.size(close) > 0, F.struct(close[0]["name"].alias("name"), close[0]["mass"].alias("mass")))


def modification_mass(name: Column, known: dict[str, float] | None = None) -> Column:
    """Mass of a modification's name, whatever its case; null for unknown ones."""
    low = {n.lower(): m for n, m in (known or MODIFICATIONS).items()}
    return F.create_map(*[F.lit(x) for kv in low.items() for x in kv])[F.lower(name)]


def parts(modseq: Column) -> Column:
    """Residues and bracketed masses of a modified sequence, in order."""
    return F.regexp_extract_all(modseq, F.lit(r"(\[[^\]]*\]|[A-Za-z])"), F.lit(1))


def canonical_masses(modseq: Column, tolerance: float = 0.01, known: dict[str, float] | None = None) -> Column:
    """Bracketed masses and names as the masses of known modifications, six decimals with their sign; unknown names stay."""

    def one(p):
        inner = F.regexp_extract(p, r"^\[(.*)\]$", 1)
        mass = F.coalesce(inner.try_cast("double"), modification_mass(inner, known))
        exact = F.coalesce(nearest_modification(mass, tolerance, known)["mass"], mass)
        return F.when(p.startswith("[") & exact.isNotNull(), F.format_string("[%+.6f]", exact)).otherwise(p)

    return F.array_join(F.transform(parts(modseq), one), "")


def ion_name(kind: Column, index: Column, charge: Column) -> Column:
    """y7, y7++ for two charges, and so on."""
    return F.concat(kind, index.cast("string"), F.when(charge > 1, F.repeat(F.lit("+"), charge.cast("int"))).otherwise(F.lit("")))


def parse_ion(name: Column) -> Column:
    """struct(kind, index, charge) of an ion's name; null for what is none."""
    m = lambda k: F.regexp_extract(name, r"^([A-Za-z]+)(\d+)(\+*)$", k)
    return F.when(m(1) != "", F.struct(m(1).alias("kind"), m(2).cast("int").alias("index"), F.greatest(F.length(m(3)), F.lit(1)).alias("charge")))


def archive(ions: Column) -> Column:
    """array<struct<kind, index, mass>> as one string: kind|index|mass, comma-joined."""
    return F.array_join(F.transform(ions, lambda i: F.concat_ws("|", i["kind"], i["index"].cast("string"), i["mass"].cast("string"))), ",")


def from_archive(text: Column) -> Column:
    """The ions of such a string; none for null, blank or "null"."""
    blank = text.isNull() | (F.trim(text) == "") | (F.lower(F.trim(text)) == "null")
    one = lambda s: F.struct(F.split(s, r"\|")[0].alias("kind"), F.split(s, r"\|")[1].cast("int").alias("index"), F.split(s, r"\|")[2].cast("double").alias("mass"))
    return F.transform(F.when(blank, F.array().cast("array<string>")).otherwise(F.split(text, ",")), one)


# -- uncertain sites ---------------------------------------------------------------------------------------------------


def site_groups(forms: Column) -> Column:
    """forms: array of placements (arrays of sites from 0).  Modification k is among the sites that any placement has in its k-th
    place; groups that meet are one: array<struct<sites, mods>>, by site."""
    n = F.array_max(F.transform(forms, lambda f: F.size(f)))
    kth = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.array_sort(F.array_distinct(F.transform(forms, lambda f: f[k]))).alias("sites"), F.lit(1).alias("mods")))

    def join(groups, g):
        last = F.element_at(groups, -1)
        merged = F.struct(F.array_sort(F.array_union(last["sites"], g["sites"])).alias("sites"), (last["mods"] + g["mods"]).alias("mods"))
        head = F.slice(groups, 1, F.size(groups) - 1)
        return F.when((F.size(groups) > 0) & F.arrays_overlap(F.coalesce(F.try_element_at(groups, F.lit(-1))["sites"], F.array().cast("array<int>")), g["sites"]), F.concat(head, F.array(merged))).otherwise(F.concat(groups, F.array(g)))

    return F.aggregate(kth, F.array().cast("array<struct<sites:array<int>,mods:int>>"), join)


def ambiguous_notation(sequence: Column, groups: Column) -> Column:
    """S[1]PT[1]: sites of group k carry [k]; the sites of a group that is certain carry [k!]."""
    tag = lambda i: F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size(groups) - 1, F.lit(0))), lambda k: F.when(F.array_contains(groups[k]["sites"], i), k + 1).otherwise(F.lit(0))))
    sure = lambda k: F.size(groups[k - 1]["sites"]) == groups[k - 1]["mods"]
    mark = lambda k: F.when(k > 0, F.concat(F.lit("["), k.cast("string"), F.when(sure(k), F.lit("!")).otherwise(F.lit("")), F.lit("]"))).otherwise(F.lit(""))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(sequence) - 1), lambda i: F.concat(F.substr(sequence, i + 1, F.lit(1)), mark(tag(i)))), "")


def ambiguous_residues(groups: Column) -> Column:
    """Sites of groups that have more sites than modifications."""
    return F.aggregate(F.filter(groups, lambda g: F.size(g["sites"]) > g["mods"]), F.lit(0), lambda s, g: s + F.size(g["sites"]))


def without(forms: Column, confirmed: Column) -> Column:
    """Placements that agree with confirmed sites: those that hold all of them."""
    return F.filter(forms, lambda f: F.size(F.array_intersect(f, confirmed)) == F.size(F.array_distinct(confirmed)))
