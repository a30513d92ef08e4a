"""XML and SQLite formats.  mzML is read in ranges of bytes; of the others a file is one unit of work."""

from __future__ import annotations

import base64
import sqlite3
import struct
import tempfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.sources.schemas import SCANS


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def decode_array(text: str | None, wide: bool, packed: bool) -> np.ndarray:
    """A base64 array; values that are no numbers become 0."""
    raw = base64.b64decode(text or "")
    raw = zlib.decompress(raw) if packed and raw else raw
    v = np.frombuffer(raw, "<f8" if wide else "<f4").astype(float)
    return np.where(np.isfinite(v), v, 0.0)


def spectrum_row(node, run: str) -> dict:
    par = {}
    for p in node.iter():
        if _local(p.tag) == "cvParam":
            par.setdefault(p.get("accession"), p)
    num = lambda a, d=None: float(par[a].get("value")) if a in par and par[a].get("value") else d
    rt = num("MS:1000016")
    if rt is not None and "minute" in (par["MS:1000016"].get("unitName") or ""):
        rt *= 60
    arrays = {}
    for b in (x for x in node.iter() if _local(x.tag) == "binaryDataArray"):
        acc = {p.get("accession") for p in b if _local(p.tag) == "cvParam"}
        text = next((x.text for x in b if _local(x.tag) == "binary"), None)
        arrays["mz" if "MS:1000514" in acc else "intensity" if "MS:1000515" in acc else "other"] = decode_array(text, "MS:1000523" in acc, "MS:1000574" in acc)
    centre, below, above = num("MS:1000827"), num("MS:1000828", 0.0), num("MS:1000829", 0.0)
    mz, y = arrays.get("mz", np.zeros(0)), arrays.get("intensity", np.zeros(0))
    return {
        "run": run, "spectrum": node.get("id"), "index": int(node.get("index", -1)), "rt": rt, "injection_time": num("MS:1000927"), "low": None if centre is None else centre - below, "centre": centre, "high": None if centre is None else centre + above,
        "charge": int(num("MS:1000041", 0)), "ms_level": int(num("MS:1000511", 1)), "peaks": [{"mz": float(a), "intensity": float(b)} for a, b in zip(mz, y)],
    }


def mzml(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """Scans of mzML files, in ranges of `split` bytes.  A truncated file is an error, not a shorter table."""
    from peakfold.sources.mzml import MzmlSource

    spark.dataSource.register(MzmlSource)
    return spark.read.format("mzml").option("split", split).load(path)


def windows_of(scans: DataFrame) -> DataFrame:
    """Isolation windows with their duty cycle and scan counts."""
    from peakfold.operators.aggregates import duty_cycle

    return duty_cycle(scans.where("ms_level = 2"), ["low", "high"], "rt")


def traml(spark: SparkSession, path: str) -> DataFrame:
    """Transitions of TraML: peptide, sequence, charge, rt, precursor_mz, product_mz, intensity."""
    schema = "peptide string, sequence string, charge int, rt double, precursor_mz double, product_mz double, intensity double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p.content:
                root = ElementTree.fromstring(content)
                par = lambda n: {x.get("accession"): x.get("value") for x in n.iter() if _local(x.tag) == "cvParam"}
                peptides = {n.get("id"): (n.get("sequence"), par(n)) for n in root.iter() if _local(n.tag) == "Peptide"}
                rows = []
                for n in (x for x in root.iter() if _local(x.tag) == "Transition"):
                    parts_ = {_local(x.tag): par(x) for x in n}
                    seq, pep = peptides.get(n.get("peptideRef"), (None, {}))
                    get = lambda d, *k: next((float(d[a]) for a in k if d.get(a)), None)
                    rows.append((n.get("peptideRef"), seq, int(get(pep, "MS:1000041") or 0), get(pep, "MS:1000896", "MS:1000895"), get(parts_.get("Precursor", {}), "MS:1000827"), get(parts_.get("Product", {}), "MS:1000827"), get(par(n), "MS:1001226")))
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite files (spectral libraries, retention databases), with the file's name as `source`."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, content in zip(p.path, p.content):
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # SQLite needs a file; it lives as long as this loop
                    f.write(content)
                    f.flush()
                    con = sqlite3.connect(f.name)
                    cur = con.execute(query)
                    while rows := cur.fetchmany(5000):
                        out = pd.DataFrame(rows, columns=names)
                        out.insert(0, "source", name.rsplit("/", 1)[-1])
                        yield out
                    con.close()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"source string, {schema}")


def unpack_blob(df: DataFrame, column: str, wide: bool, little: bool = True, packed: bool = True) -> DataFrame:
    """A column of (zlib-packed) number blobs as array<double>; a blob whose length is what it would be unpacked isn't packed."""
    kind = ("<" if little else ">") + ("f8" if wide else "f4")

    @F.pandas_udf("array<double>")
    def unpack(v: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                raw = zlib.decompress(b) if packed else bytes(b)
            except zlib.error:
                raw = bytes(b)
            return np.frombuffer(raw, kind).astype(float)

        return v.map(one)

    return df.withColumn(column, unpack(F.col(column)))


def pack_blob(values, wide: bool, little: bool = True) -> bytes:
    return zlib.compress(struct.pack(f"{'<' if little else '>'}{len(values)}{'d' if wide else 'f'}", *values))


def blib(spark: SparkSession, path: str) -> DataFrame:
    """Library entries of BLIB files."""
    q = "SELECT r.peptideSeq, r.peptideModSeq, r.precursorMZ, r.precursorCharge, r.retentionTime * 60, r.copies, p.peakMZ, p.peakIntensity FROM RefSpectra r JOIN RefSpectraPeaks p ON p.RefSpectraID = r.id"
    x = sqlite(spark, path, q, "seq string, modseq string, precursor_mz double, charge int, rt double, copies int, mz binary, intensity binary")
    x = unpack_blob(unpack_blob(x, "mz", True), "intensity", False)
    from peakfold.functions.arrays import peaks

    return x.withColumn("peaks", peaks(F.col("mz"), F.col("intensity"))).drop("mz", "intensity")


def irt_database(spark: SparkSession, path: str) -> DataFrame:
    return sqlite(spark, path, "SELECT PeptideModSeq, Irt FROM IrtLibrary", "modseq string, irt double")
