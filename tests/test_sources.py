"""Readers and writers: round trips and odd inputs."""

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.sources import binary, sinks, text


@pytest.fixture
def library(spark):
    rows = [("s", 500.25, 2, "PEPTC[+57.02]K", "PEPTCK", 1, 60.0, 1.0, [(100.0, 5.0), (200.5, 7.0)], ["P1", "P2"]), ("s", 400.0, 3, "AAK", "AAK", 1, 120.0, 2.0, [(150.0, 1.0)], ["P3"])]
    return spark.createDataFrame(rows, "source string, precursor_mz double, charge int, modseq string, seq string, copies int, rt double, score double, peaks array<struct<mz:double,intensity:double>>, accessions array<string>")


def peaks(r):
    return [(p.mz, p.intensity) for p in r.peaks]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("# header\n>sp|P1 first KEY protein\nMKR\nPEP\n>P2\n\n>P3 x\nAAA\n")
    rows = text.fasta(spark, str(tmp_path / "a.fasta")).orderBy("accession").collect()
    assert [(r.accession, r.sequence) for r in rows] == [("P2", ""), ("P3", "AAA"), ("sp|P1", "MKRPEP")]
    assert [r.accession for r in text.fasta(spark, str(tmp_path / "a.fasta"), "key").collect()] == ["sp|P1"]
    sinks.write_fasta(text.fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"), width=3)
    again = text.fasta(spark, str(tmp_path / "out")).collect()
    assert {(r.accession, r.sequence) for r in again} == {(r.accession, r.sequence) for r in rows}


def test_peff(spark, tmp_path):
    (tmp_path / "a.peff").write_text("# PEFF 1.0\n# //\n>nx:A1 \\Length=5 \\VariantSimple=(2|K)(4|R)\nMAAAA\n")
    v = text.peff_variants(text.fasta(spark, str(tmp_path / "a.peff"))).orderBy("position").collect()
    assert [(r.accession, r.position, r.residues) for r in v] == [("nx:A1", 2, "K"), ("nx:A1", 4, "R")]


def test_mgf_round_trip(spark, library, tmp_path):
    sinks.write_mgf(library.withColumn("title", F.col("modseq")), str(tmp_path / "m"))
    rows = {r.title: r for r in text.mgf(spark, str(tmp_path / "m")).collect()}
    assert peaks(rows["AAK"]) == [(150.0, 1.0)] and rows["PEPTC[+57.02]K"].charge == 2 and rows["AAK"].rt == 120.0


def test_msp_round_trip(spark, library, tmp_path):
    sinks.write_msp(library, str(tmp_path / "m"))
    rows = {r.seq: r for r in text.msp(spark, str(tmp_path / "m")).collect()}
    assert peaks(rows["PEPTCK"]) == [(100.0, 5.0), (200.5, 7.0)] and rows["AAK"].charge == 3 and rows["AAK"].accessions == ["P3"]
    (tmp_path / "x.msp").write_text('Name: ACDEK/2\nMW: 1\nComment: Mods=1/1,C,Carbamidomethyl Parent=300.5\nNum peaks: 2\n100.1\t3\t"b1"\n90.5\t2\t"a"\n\n')
    r = text.msp(spark, str(tmp_path / "x.msp")).first()
    assert r.modseq == "AC[Carbamidomethyl]DEK" and r.precursor_mz == 300.5 and peaks(r) == [(90.5, 2.0), (100.1, 3.0)]


def test_transition_list_round_trip(spark, library, tmp_path):
    sinks.write_transitions(library, str(tmp_path / "t"))
    rows = {r.modseq: r for r in text.transition_list(spark, str(tmp_path / "t")).collect()}
    assert peaks(rows["PEPTC[+57.02]K"]) == [(100.0, 5.0), (200.5, 7.0)] and rows["AAK"].rt == 120.0 and rows["PEPTC[+57.02]K"].accessions == ["P1", "P2"]


def test_transition_list_drops_decoys_and_zeros(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("PrecursorMz\tPrecursorCharge\tModifiedPeptideSequence\tProductMz\tLibraryIntensity\tdecoy\n500\t2\t_AAK_\t100\t5\t0\n500\t2\t_AAK_\t110\t0\t0\n\n600\t2\tCCK\t100\t5\t1\n")
    rows = text.transition_list(spark, str(tmp_path / "t.tsv")).collect()
    assert len(rows) == 1 and rows[0].modseq == "AAK" and peaks(rows[0]) == [(100.0, 5.0)]


def test_maxquant(spark, tmp_path):
    head = "Raw file\tSequence\tModified sequence\tProteins\tCharge\tm/z\tRetention time\tPEP\tIntensities\tMasses\tReverse"
    rows = ["a\tPEPK\t_PEPK_\tP1;P2\t2\t300.1\t10\t0.01\t5;6\t100;200\t", "b\tPEPK\t_PEPK_\tP1\t2\t300.2\t11\t0.001\t7\t101\t", "b\tAAK\t_AAK_\tP9\tx\t300.2\t11\t0.001\t7\t101\t", "c\tCCK\t_CCK_\tP1\t2\t1\t1\t0.1\tbad\t5\t", "c\tDDK\t_DDK_\tR\t2\t1\t1\t0.1\t1\t5\t+"]
    (tmp_path / "m.txt").write_text("\n".join([head, *rows]))
    got = text.maxquant(spark, str(tmp_path / "m.txt")).collect()
    assert [(r.modseq, r.source, r.rt) for r in got] == [("PEPK", "b", 660.0)]


def test_ms2pip(spark, tmp_path):
    (tmp_path / "a.peprec").write_text("spec_id modifications peptide charge\ns1 - PEPK 2\n")
    (tmp_path / "p.csv").write_text("spec_id,charge,ion,ionnumber,mz,prediction\ns1,2,B,1,98.06,0.5\ns1,2,Y,1,147.1,0.7\n")
    r = text.ms2pip(spark, str(tmp_path / "a.peprec"), str(tmp_path / "p.csv")).first()
    assert peaks(r) == [(98.06, 0.5), (147.1, 0.7)]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 2.0, 0.001, 0.01, "-.PEPK.-", "P1;P2"), ("b", 1.0, 0.01, 0.1, "-.AAK.-", "DECOY_P1"), ("c", 0.5, 0.01, 0.2, "-.CCK.-", "P3")], "PSMId string, score double, `q-value` double, posterior_error_prob double, peptide string, proteinIds string")
    sinks.write_results(df, str(tmp_path / "r"), 0.75)
    assert text.pi_zero(spark, str(tmp_path / "r")) == 0.75
    assert {r.psm_id for r in text.scored_results(spark, str(tmp_path / "r")).collect()} == {"a", "c"}
    assert {r.psm_id for r in text.scored_results(spark, str(tmp_path / "r"), 0.01).collect()} == {"a"}
    assert {r.psm_id for r in text.scored_results(spark, str(tmp_path / "r"), 0.01, decoys=True, strict=False).collect()} == {"a", "b", "c"}


def spectrum_xml(i, rt, mz, y):
    def arr(v, kind, wide):
        raw = base64.b64encode(zlib.compress(np.array(v, "<f8" if wide else "<f4").tobytes())).decode()
        return f'<binaryDataArray><cvParam accession="{kind}"/><cvParam accession="{"MS:1000523" if wide else "MS:1000521"}"/><cvParam accession="MS:1000574"/><binary>{raw}</binary></binaryDataArray>'

    return f"""<spectrum index="{i}" id="scan={i}"><cvParam accession="MS:1000511" value="2"/><scanList><scan><cvParam accession="MS:1000016" value="{rt}" unitName="minute"/></scan></scanList>
<precursorList><precursor><isolationWindow><cvParam accession="MS:1000827" value="500"/><cvParam accession="MS:1000828" value="2"/><cvParam accession="MS:1000829" value="3"/></isolationWindow></precursor></precursorList>
<binaryDataArrayList>{arr(mz, "MS:1000514", True)}{arr(y, "MS:1000515", False)}</binaryDataArrayList></spectrum>"""


def test_mzml(spark, tmp_path):
    body = "".join(spectrum_xml(i, 1 + i / 10, [100.5, 200.25], [3.0, float("nan")]) for i in range(3))
    (tmp_path / "a.mzml").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{body}</spectrumList></run></mzML>')
    rows = sinks.read(spark, str(tmp_path / "a.mzml")).orderBy("index").collect()
    assert len(rows) == 3 and rows[0].rt == 60 and rows[0].low == 498 and rows[0].high == 503 and peaks(rows[0]) == [(100.5, 3.0), (200.25, 0.0)]
    w = binary.windows_of(binary.mzml(spark, str(tmp_path / "a.mzml"))).first()
    assert w.duty_cycle == pytest.approx(6) and w.n == 3
    (tmp_path / "bad.mzml").write_text((tmp_path / "a.mzml").read_text()[:900])
    with pytest.raises(Exception, match="ParseError|no element|mismatched|unclosed|truncated"):
        binary.mzml(spark, str(tmp_path / "bad.mzml")).collect()


def test_mzml_in_ranges(spark, tmp_path):
    """Ranges of any size give what one range gives: no spectrum twice, none lost, whatever is cut in two; folders and patterns."""
    body = "".join(spectrum_xml(i, 1 + i / 10, [100.5 + i] * (i % 7), [float(i)] * (i % 7)) for i in range(40))
    (tmp_path / "x").mkdir()
    whole = f'<?xml version="1.0" encoding="utf-8"?><indexedmzML><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList count="40">{body}</spectrumList></run></mzML><indexList/></indexedmzML>\n'
    for name in ("a.mzML", "b.mzML"):
        (tmp_path / "x" / name).write_text(whole)
    (tmp_path / "x" / "notes.txt").write_text("none")
    say = lambda df: sorted((r.run, r["index"], r.rt, peaks(r)) for r in df.collect())
    one = say(binary.mzml(spark, str(tmp_path / "x" / "a.mzML")))
    assert [r[1] for r in one] == list(range(40))
    for split in (701, 4096, 20_011):
        df = binary.mzml(spark, f"file://{tmp_path}/x/a.mzML", split)
        assert say(df) == one and df.rdd.getNumPartitions() == -(-len(whole) // split)
    assert len(say(binary.mzml(spark, str(tmp_path / "x"), 5000))) == 80 == len(say(binary.mzml(spark, str(tmp_path / "x" / "*.mzML"))))
    (tmp_path / "cut.mzml").write_text(whole[:-40])
    (tmp_path / "half.mzml").write_text(whole[: len(whole) // 2])
    for bad in ("cut.mzml", "half.mzml"):
        with pytest.raises(Exception, match="truncated"):
            binary.mzml(spark, str(tmp_path / bad), 3000).collect()


def test_mzml_elements():
    """A tag that lies across a border belongs to the range it starts in."""
    import io

    from peakfold.sources.mzml import elements

    text = b"<spectrumList><spectrum id='a'>1</spectrum> <spectrum\nid='b'></spectrum></spectrumList>"
    for k in range(len(text) + 1):
        got = [*elements(io.BytesIO(text), 0, k), *elements(io.BytesIO(text), k, len(text))]
        assert got == [b"<spectrum id='a'>1</spectrum>", b"<spectrum\nid='b'></spectrum>"]


def test_traml(spark, tmp_path):
    (tmp_path / "a.traml").write_text('<TraML><CompoundList><Peptide id="p1" sequence="PEPK"><cvParam accession="MS:1000041" value="2"/></Peptide></CompoundList><TransitionList><Transition id="t" peptideRef="p1"><Precursor><cvParam accession="MS:1000827" value="300.5"/></Precursor><Product><cvParam accession="MS:1000827" value="147.1"/></Product><cvParam accession="MS:1001226" value="9"/></Transition></TransitionList></TraML>')
    r = binary.traml(spark, str(tmp_path / "a.traml")).first()
    assert (r.sequence, r.charge, r.precursor_mz, r.product_mz, r.intensity) == ("PEPK", 2, 300.5, 147.1, 9.0)


def test_sqlite_round_trips(spark, library, tmp_path):
    sinks.write_blib(library, str(tmp_path / "l.blib"))
    rows = {r.seq: r for r in sinks.read(spark, str(tmp_path / "l.blib")).collect()}
    assert peaks(rows["PEPTCK"]) == [(100.0, 5.0), (200.5, 7.0)] and rows["AAK"].rt == pytest.approx(120)
    sinks.write_irt_database(spark.createDataFrame([("AAK", 1.5)], "modseq string, irt double"), str(tmp_path / "i.irtdb"))
    assert [(r.modseq, r.irt) for r in sinks.read(spark, str(tmp_path / "i.irtdb")).collect()] == [("AAK", 1.5)]


def test_features_and_scans(spark, library, tmp_path):
    x = spark.createDataFrame([("a", f"id{i}", float(i)) for i in range(5)], "pep string, id string, s double")
    sinks.write_features(x, str(tmp_path / "f"), ["pep"], "s", "id")
    assert [r.id for r in text.table(spark, str(tmp_path / "f")).collect()] == ["id3", "id4"]
    sinks.write_scans(library.withColumn("w", F.col("charge")), str(tmp_path / "s"), ["w"])
    assert spark.read.parquet(str(tmp_path / "s")).where("w = 3").count() == 1
    sinks.write_library({"entries": library}, str(tmp_path / "lib"))
    assert sinks.read_library(spark, str(tmp_path / "lib"), "entries").count() == 2


def test_predictions(spark):
    df = sinks.predicted(spark.createDataFrame([("AAK",), ("PEPTK",)], "s string"), lambda v: [float(len(x)) for x in v], "s", "rt", batch=1)
    assert {(r.s, r.rt) for r in df.collect()} == {("AAK", 3.0), ("PEPTK", 5.0)}


def test_msp_full_names(spark, tmp_path):
    (tmp_path / "x.sptxt").write_text("### comment\nName: AAAAK/2\nLibID: 1\nFullName: R.AAAAK.S/2\nComment: Parent=250.25\nNumPeaks: 1\n100.1\t3\tb1\n\nName: CCK/3\nFullName: K.CCK.M/3\nComment: Parent=99.5\nNumPeaks: 2\n90.5\t2\ta\n91.5\t4\tb\n\n")
    rows = {r.seq: r for r in text.msp(spark, str(tmp_path / "x.sptxt")).collect()}
    assert set(rows) == {"AAAAK", "CCK"} and rows["AAAAK"].precursor_mz == 250.25 and rows["AAAAK"].charge == 2 and rows["CCK"].charge == 3 and len(rows["CCK"].peaks) == 2
