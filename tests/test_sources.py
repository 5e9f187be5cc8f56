import io
import zipfile

import pytest

from corpuslake.sources import extract, loaders

W = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t> One </w:t></w:r></w:p><w:p/><w:p><w:r><w:t>T</w:t><w:t>wo</w:t></w:r></w:p></w:body></w:document>'
SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:t>Title</a:t></p:sp><p:sp><a:t>Body</a:t></p:sp></p:sld>'
EMPTY = '<p:sld xmlns:p="p"/>'
BOOK = '<workbook><sheets><sheet name="S1"/><sheet name="S2"/></sheets></workbook>'
SHEET = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c><v> </v></c></row></sheetData></worksheet>'
ODS = '<o xmlns:t="t"><t:table t:name="A"><t:table-row><t:table-cell>x</t:table-cell><t:table-cell>y</t:table-cell></t:table-row></t:table></o>'


def packed(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_office_files():
    doc = packed(word__document_dot_xml=W)
    assert extract.sections_of("a/x.docx", doc) == [("a/x.docx", "", "One\nTwo")]
    deck = packed(ppt__slides__slide1_dot_xml=SLIDE, ppt__slides__slide2_dot_xml=EMPTY, ppt__slides__slide10_dot_xml=SLIDE)
    assert [p for _, p, _ in extract.sections_of("x.pptx", deck)] == ["1", "3"]
    book = packed(xl__workbook_dot_xml=BOOK, xl__sharedStrings_dot_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_dot_xml=SHEET)
    assert extract.sections_of("x.xlsx", book) == [("x.xlsx", "S1", "[Planilha: S1]\nname\t7")]
    assert extract.sections_of("x.ods", packed(content_dot_xml=ODS)) == [("x.ods", "A", "[Sheet: A]\nx\ty")]


def test_archives_and_broken_files(spark):
    inner = packed(**{"c_dot_txt": "deep"})
    middle = packed(**{"b_dot_zip": inner, "a_dot_py": "1"})
    outer = packed(**{"m_dot_zip": middle, "t_dot_md": "top", "x_dot_exe": "no"})
    df = spark.createDataFrame([("o.zip", bytearray(outer)), ("bad.docx", bytearray(b"?")), ("n.txt", None)], "path string, content binary")
    got = {(r.path, r.source_path, r.text) for r in extract.extract_sections(df).collect()}
    assert got == {("o.zip", "m.zip/a.py", "```py\n1\n```"), ("o.zip", "t.md", "top"), ("n.txt", "n.txt", "")}


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.MD").write_text("x")
    (tmp_path / "d/b.exe").write_text("x")
    assert [(r.length, r.file_type) for r in extract.scan_documents(spark, str(tmp_path)).collect()] == [(1, "txt")]


def test_scan_of_many_small_files(spark, tmp_path):
    """A task reads many small files, and files of unknown types are not listed for reading."""
    for i in range(3000):
        (tmp_path / f"{i}.{('Txt', 'PY', 'exe')[i % 3]}").write_text(str(i))
    (tmp_path / ".txt").write_text("hidden")
    (tmp_path / "txt").write_text("no suffix")
    (tmp_path / "a.tar.Zip").write_text("z")
    found = extract.scan_documents(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 3000 // 32
    assert not [f for f in found.inputFiles() if f.endswith(".exe")]
    want = {(f"{i}.{('Txt', 'PY')[i % 3]}", str(i).encode(), ("txt", "code")[i % 3]) for i in range(3000) if i % 3 < 2} | {("a.tar.Zip", b"z", "zip")}
    assert {(r.path.rpartition("/")[2], bytes(r.content), r.file_type) for r in found.collect()} == want
    (tmp_path / "none").mkdir()
    assert extract.scan_documents(spark, str(tmp_path / "none")).count() == 0


def test_scan_lists_empty_files(spark, tmp_path):
    """Spark's readers pass over files without a byte; hidden ones and those in hidden folders stay out."""
    import os

    for name in ("d/e/a.md", "b.py", "c d.txt", "_x/a.py", "d/.h/a.py", "d/_y=1/a.py", "d/.a.py", "d/a.exe"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    os.utime(tmp_path / "b.py", ns=(0, 1_700_000_000_123_456_789))
    (tmp_path / "d/full.txt").write_text("x")
    found = {r.path.removeprefix(f"file:{tmp_path}/"): r for r in extract.scan_documents(spark, str(tmp_path)).collect()}
    assert {p: (r.length, bytes(r.content), r.file_type) for p, r in found.items()} == {
        "d/e/a.md": (0, b"", "txt"), "b.py": (0, b"", "code"), "c d.txt": (0, b"", "txt"), "d/_y=1/a.py": (0, b"", "code"), "d/full.txt": (1, b"x", "txt"),
    }
    assert found["b.py"].modified.timestamp() == 1_700_000_000.123
    for one in (str(tmp_path / "b.py"), f"file://{tmp_path}/b.*"):
        assert [(r.length, r.file_type) for r in extract.scan_ordered(spark, one).collect()] == [(0, "code")]


def test_files_are_written_whole(spark, tmp_path):
    """An attempt that ends while it writes leaves the file of another one as it is, and nothing that a scan lists."""
    from corpuslake.sources import landed

    landed.write_files(spark.createDataFrame([("d/a.txt", bytearray(b"whole"))], "path string, content binary"), str(tmp_path))
    with pytest.raises(Exception, match="encoding"):  # a string has no bytes of its own: the task fails once the file is open
        landed.write_files(spark.createDataFrame([("d/a.txt", "part")], "path string, content string"), str(tmp_path))
    assert [bytes(r.content) for r in extract.scan_documents(spark, str(tmp_path)).collect()] == [b"whole"]


def odd_documents(spark, folder):
    """A few documents with what keys and texts may be: repeated, negative and missing keys, empty and missing texts."""
    ids = [0, 1, 2, 3, 21, 21, 21, 24, 24, -1, -2, -3, -21, 100, 101, 123, 10, 1000, None]
    texts = {1: "", 3: None, 100: None, 123: ""}
    rows = [(n, texts.get(n, f"text {i} \u00e9" if i != 8 else "text 7 \u00e9"), "en", "web", 1) for i, n in enumerate(ids)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    made.repartition(3).write.parquet(f"{folder}/documents.parquet")


def same_as_sql(spark, folder, name):
    """Rows of a query, which are those of its SQL."""
    import duckdb

    from corpuslake.plans import registry

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = [tuple(r) for r in registry.queries()[name](spark, str(folder)).select(*want.columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    return got


def test_scan_of_odd_documents(spark, tmp_path):
    """Rows of one key, keys below zero, and empty and missing texts come out as SQL has them."""
    odd_documents(spark, tmp_path)
    got = same_as_sql(spark, tmp_path, "a1_scan_documents")
    assert len(got) == 16 and sum(r[1] is None for r in got) == 2 and sum(r[1] == 0 for r in got) == 2


def test_order_of_odd_documents(spark, tmp_path):
    """The order of the files is that of their names without marks, whatever rows share a doc_id."""
    odd_documents(spark, tmp_path)
    got = same_as_sql(spark, tmp_path, "a3_scan_ordered")
    assert [p for p, _ in sorted(got, key=lambda r: r[1])][:4] == ["d-1/-1.py", "d-2/-2.py", "d0/100.py", "d0/1000.py"]


def test_golden(spark, tmp_path):
    csv = tmp_path / "g.csv"
    csv.write_text('query;expected_answer;expected_docs;metadata\nq1;a1;doc1.pdf, doc2.pdf;not-json\nq2;a2;;{"k":"v"}\n')
    rows = loaders.load_golden_csv(spark, str(csv)).orderBy("query").collect()
    assert rows[0].expected_docs == ["doc1.pdf", "doc2.pdf"] and rows[0].metadata == {"raw": "not-json"} and rows[1].metadata == {"k": "v"}
    csv.write_text("question\nx\n")
    with pytest.raises(ValueError):
        loaders.load_golden_csv(spark, str(csv))
    js = tmp_path / "g.json"
    js.write_text('[{"query": "q", "expected_answer": "a", "expected_docs": ["d"], "metadata": {"x": "1"}}]')
    assert loaders.load_golden_json(spark, str(js)).first().metadata == {"x": "1"}


def test_overrides(spark):
    rows = [("a", '{"defaults": {"doc_type": "howto"}, "files": {"f.pdf": {"product": "P"}}}'), ("b", '{"defaults": {"doc_type": "odd"}}'), ("c", "nonsense")]
    folders, files, rejects = loaders.parse_overrides(spark.createDataFrame(rows, "folder string, value string"), ("howto",))
    assert [r.doc_type for r in folders.collect()] == ["howto"] and [(r.path, r["product"]) for r in files.collect()] == [("a/f.pdf", "P")] and rejects.count() == 2
