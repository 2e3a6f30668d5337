"""Export files: encodings, headers, quoting, BibTeX fields, stream and report."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.text import SHORT_SUMMARY
from shelfmark.plans.report import report_tables
from shelfmark.sources.bibtex import read_bibtex_exports, rejected_entries
from shelfmark.sources.exports import read_exports, read_unified, skipped_files, unify, write_unified
from shelfmark.streaming.ingest import ingest_batch, ingest_stream, read_ingested

UTF8 = (
    "title,abstract,contributors,publicationDate,doi\n"
    '"Comma, quote "" and\nline",' + "x" * 21 + ",Ann,20260401,10.1/a\n"
    "Five5," + "y" * 30 + ",Bob,2026,\n"
    "  Sixsix ," + "z" * 20 + ",Çem,Mar2026,https://doi.org/10.1/b\n"
    "NA,n,n,n,n"
)
OTHER = "TI,AB,AU,PY,DOI\nAnother title,Some long abstract of text,Dee,2025,10.1/c\nSixsix,again a long abstract here,Dee,2025,\n"
LATIN = "DOI,TI\n10.1/d,Énergie solaire\n"
BIB = """@article{k1,
title = {The {API} of things},
year = {2026},
author = {Ann Lee and Bo Ray},
doi = {https://doi.org/10.9/x},
abstract = {First line
second = line, with {braces}
third}
}

@article{k2,
title = {Another title},
author = {Cy}
}"""


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "exports"
    path.mkdir()
    (path / "a.csv").write_bytes(("﻿" + UTF8).encode("utf-8"))
    (path / "b.csv").write_text(OTHER, encoding="utf-8")
    (path / "c.CSV").write_bytes(LATIN.encode("latin-1"))
    (path / "d.csv").write_text("")
    (path / "e.csv").write_text("foo,bar\n1,2\n")
    (path / "f.bib").write_text(BIB, encoding="utf-8")
    (path / "g.ris").write_text("TY  - JOUR\n")
    return str(path)


def test_exports_become_unified_records(spark, folder):
    rows = {(r["title"], r["archivo"][-5:]): r for r in read_exports(spark, folder).collect()}
    assert set(rows) == {
        ('Comma, quote " and\nline', "a.csv"), ("Sixsix", "a.csv"), ("Another title", "b.csv"), ("Sixsix", "b.csv"),
        ("Énergie solaire", "c.CSV"), ("The API of things", "f.bib"), ("Another title", "f.bib"),
    }
    first = rows[('Comma, quote " and\nline', "a.csv")]
    assert (first["summary"], first["authors"], first["published"], first["url"]) == (
        "x" * 21, "Ann", "20260401", "https://doi.org/10.1/a")
    six = rows[("Sixsix", "a.csv")]
    assert (six["summary"], six["url"], six["authors"]) == (SHORT_SUMMARY, "https://doi.org/10.1/b", "Çem")
    assert rows[("Énergie solaire", "c.CSV")]["summary"] == SHORT_SUMMARY
    bib = rows[("The API of things", "f.bib")]
    assert bib["summary"] == "First line\nsecond = line, with braces\nthird"
    assert (bib["authors"], bib["published"], bib["url"]) == ("Ann Lee and Bo Ray", "2026", "https://doi.org/10.9/x")
    other = rows[("Another title", "f.bib")]
    assert (other["summary"], other["published"], other["url"]) == (None, None, "")


def test_bibtex_defaults_when_no_entry_has_the_field(spark, tmp_path):
    (tmp_path / "x.bib").write_text("@misc{a,\ntitle = {Only a title}\n}\n@comment stray\n")
    row = read_bibtex_exports(spark, str(tmp_path)).first()
    assert (row["authors"], row["summary"], row["published"], row["url"]) == ("Sin autor", "Sin resumen", "2024", "")
    lost = rejected_entries(spark, str(tmp_path)).collect()
    assert [(r["piece"].strip(), r["reason"]) for r in lost] == [("@comment stray", "outside")]


def test_bibtex_values_nest_to_any_depth_and_lost_pieces_have_a_reason(spark, tmp_path):
    (tmp_path / "a.bib").write_text(
        "% made by hand\n@article{k, title = {a {b {c {d {e, f} g}}} = h}, note = \"q, {\"} r\", YEAR=2020 }\n"
        "@comment{nothing}\n@misc(p, title = \"In (parens), quoted\", year = {1999})\n@misc{empty}\n"
        "@book{open, title = {Never {closed}, year = 2001}\n"
    )
    rows = {r["title"]: r["published"] for r in read_bibtex_exports(spark, str(tmp_path)).collect()}
    assert rows["a b c d e, f g = h"] == "2020" and rows["In (parens), quoted"] == "1999"
    lost = [(r["piece"].strip(), r["reason"]) for r in rejected_entries(spark, str(tmp_path)).collect()]
    assert sorted(lost) == sorted([
        ("% made by hand", "outside"), ("comment{nothing}", "no record"), ("misc{empty}", "no fields"),
        ("book{open, title = {Never {closed}, year = 2001}", "no end"),
    ])


def test_unify_keeps_the_first_title_and_round_trips(spark, folder, tmp_path):
    got = unify(spark, folder)
    kept = {r["title"]: r["archivo"][-5:] for r in got.collect()}
    assert kept["Sixsix"] == "a.csv" and kept["Another title"] == "b.csv" and len(kept) == 5
    for fmt in ("parquet", "csv"):
        write_unified(got, str(tmp_path / fmt), fmt)
        back = read_unified(spark, str(tmp_path / fmt), fmt)
        assert sorted(r["title"] for r in back.collect()) == sorted(kept)
        assert dict(back.dtypes)["published"] == "string"
    assert [r["path"][-5:] for r in skipped_files(spark, folder).collect()] == ["g.ris"]


def test_stream_equals_batch_and_reruns_are_idempotent(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest_stream(spark, folder, out, mark, max_files=2).awaitTermination()
    titles = sorted(r["title"] for r in read_ingested(spark, out).collect())
    assert titles == sorted(r["title"] for r in unify(spark, folder).collect())
    last = read_ingested(spark, out).agg(F.max("batch_id")).first()[0]
    ingest_batch(spark, [f"{folder}/b.csv"], out, last + 1)
    ingest_batch(spark, [f"{folder}/b.csv"], out, last + 1)
    assert sorted(r["title"] for r in read_ingested(spark, out).collect()) == titles


def test_report_tables(spark, tmp_path):
    rows = [("Wang, Beijing", "robot robots learn quickly", "2024"), ("Lee", "no place", "2025")]
    df = spark.createDataFrame(rows, "authors string, summary string, published string")
    tables = report_tables(df, str(tmp_path / "r"))
    assert [tuple(r) for r in tables["countries"].collect()] == [("China", 1)]
    assert [r["year"] for r in tables["timeline"].orderBy("year").collect()] == [2024, 2025]
    assert {r["term"] for r in tables["cloud"].collect()} >= {"robot", "learn"}
    nowhere = report_tables(df.where("authors = 'Lee'"))
    assert nowhere["countries"].count() == 0
