"""Readers and writers on files made here."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from tessera.sources import articles as S
from tessera.sources import containers as C


def test_articles_with_side_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffarticle_id;title;year\n1;First;2020\n;No id;2020\n2;;2021\n3;Third;2022\n", encoding="utf-8")
    side = tmp_path / "html"
    side.mkdir()
    (side / "1 - b.html").write_text("<div id='abstract1'>An &amp; abstract<br>here</div><p>Keywords: a, B; A, c</p>")
    (side / "1 - c.html").write_text("later")
    rows = S.card_fields(S.read_articles(spark, str(tmp_path / "a.csv"), S.side_files_of(spark, str(side)))).orderBy("article_id").collect()
    assert [(r.article_id, r.abstract) for r in rows] == [("1", "An & abstract here"), ("3", None)]
    got = spark.createDataFrame([(rows[0].keywords,)], "k string").select(S.split_keywords(F.col("k")).alias("k")).first().k
    assert got == ["a", "B", "c"]


def test_export_with_shifted_row(spark, tmp_path):
    cols = ["ID", "YEAR", "NAME", "INSPECTOR_FLG"]
    (tmp_path / "e.csv").write_text("ID;YEAR;NAME;INSPECTOR_FLG\n1;2020;Monograph; with a subtitle;A\n2;2021;Plain;A\n3;2020;Not;B\n4;x;Bad year;A\n5;2020\n")
    good, bad = S.read_export(spark, str(tmp_path / "e.csv"), cols, "NAME", years=[2020, 2021])
    assert sorted((r.ID, r.NAME) for r in good.collect()) == [("1", "Monograph; with a subtitle"), ("2", "Plain")]
    assert sorted(r.ID for r in bad.collect()) == ["4", "5"]


def test_newest_copies(spark):
    names = ["d/Plan A.xlsx", "d/01.02.2024 Plan A.xlsx", "d/03.02.2024 plan a.xlsx", "d/Plan B.xlsx", "e/Plan A.xlsx", "e/Plan of 05.05.2024.xlsx"]
    got = S.newest_copies(spark.createDataFrame([(n,) for n in names], "path string"))
    assert sorted(r.path for r in got.collect()) == ["d/03.02.2024 plan a.xlsx", "d/Plan B.xlsx", "e/Plan A.xlsx", "e/Plan of 05.05.2024.xlsx"]


def test_journals_and_staff(spark, tmp_path):
    (tmp_path / "j.json").write_text(json.dumps([{"titles": ["A", "AA"], "issns": ["1"], "level": 3}, {"titles": ["A"], "issns": ["2"], "level": 1}, {"titles": [], "issns": []}]))
    rows = S.read_journals(spark, str(tmp_path / "j.json")).collect()
    assert [(r.title, r.titles, r.issns, r.level) for r in rows] == [("A", ["A", "AA"], ["1", "2"], 1)]
    html = """<a href="javascript:passBack('7','x');">Ann Bee / Head, senior, Department of Maths, applied</a><a href="javascript:passBack('8','x');">Cid / Clerk, Archive</a>"""
    got = S.staff_entries(spark.createDataFrame([(html,)], "html string")).orderBy("external_id").collect()
    assert [tuple(r) for r in got] == [("7", "Ann Bee", "Head, senior", "Department of Maths, applied"), ("8", "Cid", "Clerk", "Archive")]


def test_index_round_trip(spark, tmp_path):
    text = " ".join(f"Sentence number {i} is long enough to be kept in a chunk of its own text." for i in range(60))
    S.write_index(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), str(tmp_path))
    arts, chunks = S.read_index(spark, str(tmp_path))
    assert arts.count() == 2 and chunks.count() >= 4
    parts = [r.chunk for r in chunks.orderBy("place").collect()]
    assert all(len(p) <= 1250 for p in parts) and all(a.split(". ")[-1] == b.split(". ")[0] + "." or b.startswith(a.rsplit(". ", 1)[-1]) for a, b in zip(parts, parts[1:]))


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _frame(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_spreadsheet_cells(spark):
    book = _zip({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>Head</t></si><si><r><t>sp</t></r><r><t>lit</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="B1" t="s"><v>0</v></c><c r="AA1"><v>5</v></c></row><row><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    })
    grid = C.cells(_frame(spark, good=book, bad=b"no zip")).cache()
    assert sorted((r.row, r.col, r.text) for r in grid.where("error is null").collect()) == [(1, 2, "Head"), (1, 27, "5"), (2, 2, "split"), (2, 3, "in")]
    assert [r.path for r in grid.where("error is not null").collect()] == ["bad"]
    heads = spark.createDataFrame([("head", "h")], "header string, code string")
    assert [(r.row, r.text) for r in C.below_headers(grid, heads).collect()] == [(2, "split")]
    assert [r.text for r in C.right_of_label(grid, "head").collect()] == ["5"]


def test_word_document(spark):
    xml = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Bold</w:t></w:r></w:p><w:tbl/><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    rows = C.paragraphs(_frame(spark, d=_zip({"word/document.xml": xml}))).orderBy("number").collect()
    assert [(r.style, r.text, r.bold, r.tables_before) for r in rows] == [("H1", "Bold", 1.0, 0), (None, "ab", 0.0, 1)]


def test_archive_listing(spark):
    listing = C.members(_frame(spark, z=_zip({"main.tex": "x", "../up.txt": "y", "big.txt": "0" * 2_000_000})))
    assert {r.name: r.reason for r in C.unsafe(listing).collect()} == {"../up.txt": "traversal", "big.txt": "ratio"}
    assert listing.where("name = 'main.tex'").first().sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_bibliography_and_latex(spark):
    bib = b'@article{k1, title = {A {B} title}, year=2020, doi = "10.1/x"}\n@book{k2,\n author={O},}'
    rows = C.bibliography(_frame(spark, b=bib)).orderBy("key").collect()
    assert [(r.key, r.type, r.fields, r.doi) for r in rows] == [("k1", "article", {"title": "A B title", "year": "2020", "doi": "10.1/x"}, "10.1/x"), ("k2", "book", {"author": "O"}, None)]
    tex = rb"\title{A {nested} one}\label{a}\label{a}\ref{b}\cite{x, y}\bibitem{x} % \ref{comment}"
    commands = C.latex_commands(_frame(spark, t=tex)).cache()
    assert commands.where("command = 'title'").first().value == "A {nested} one"
    assert sorted((r.problem, r.key) for r in C.latex_integrity(commands).collect()) == [("citation", "y"), ("label", "a"), ("reference", "b")]


def test_text_encodings(spark):
    got = {r.path: (r.text, r.encoding) for r in C.texts(_frame(spark, a="é".encode(), b="Привет".encode("cp1251"), c=b"\xef\xbb\xbfx")).collect()}
    assert got == {"a": ("é", "utf-8-sig"), "b": ("Привет", "cp1251"), "c": ("x", "utf-8-sig")}
