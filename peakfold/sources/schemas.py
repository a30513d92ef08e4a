"""Column contracts of the engine's tables; arrays that belong together are one array of structs."""

from __future__ import annotations

SCANS = "run string, spectrum string, index long, rt double, injection_time double, low double, centre double, high double, charge int, ms_level int, peaks array<struct<mz:double,intensity:double>>"
LIBRARY = "source string, precursor_mz double, charge int, modseq string, seq string, copies int, rt double, score double, peaks array<struct<mz:double,intensity:double>>, accessions array<string>"
PROTEINS = "accession string, annotation string, sequence string"
SCORED = "psm_id string, score double, q double, pep double, peptide string, accessions array<string>"
