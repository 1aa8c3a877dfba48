import pytest
from pyspark.sql import functions as F

from folio import functions as fn
from folio import operators as op
from folio.pdf import relations as rel
from folio.pdf.content import interpret
from folio.pdf.cos import Document, Lexer, Ref
from folio.pdf.writer import write_pdf

HELLO = [[("Hello World", 0.0, 0.0)]]


@pytest.mark.parametrize("args, want", [(("Hello there world!", "Hello", "world"), " there "), (("Hello world!", "cat", "dog"), "Hello world!"), (("Hello world!", "Hello", "dog"), " world!"), (("Hello world!", "cat", " world"), "Hello")])
def test_carve_out(spark, args, want):
    assert spark.range(1).select(fn.carve_out(F.lit(args[0]), *args[1:])).head()[0] == want


def test_scalars(spark):
    row = spark.range(1).select(
        fn.is_ascii(F.lit("Hello World!")), fn.is_ascii(F.lit("é")), F.hex(fn.hex_to_bytes(F.lit("01ABEX F2A"))), fn.int_to_hex(F.lit(161)), fn.int_to_hex(F.lit(100000)),
        fn.hex_to_raw(F.lit("01ABEF2A")), fn.string_to_raw(F.lit("Hello")), fn.parse_refs(F.lit("1 0 R 2 0 R 31 5 R")), fn.parse_ints(F.lit("01.04 2.1 A 31")), fn.parse_floats(F.lit("a 3.14 b 2.72 1.4")),
        fn.symbol_type(F.lit("a")), fn.symbol_type(F.lit("7")), fn.symbol_type(F.lit("!")), fn.symbol_type(F.lit("\t")), fn.font_name(F.lit("/ABCDEF+Arial")), fn.expand_ligatures(F.lit("ﬁn")),
    ).head()
    assert list(row) == [True, False, "01ABEF2A", "00A1", "FFFF", [0x1AB, 0xEF2A], [0x48, 0x65, 0x6C, 0x6C, 0x6F], [1, 2, 31], [1, 2, 31], [3.14, 2.72, 1.4], "L", "D", "!", " ", "Arial", "fin"]


def test_lexer():
    v = Lexer(rb"<< /A (x\(y\)\101) /B [1 -2.5 3 0 R] /C <</D /E#20F>> /G <4a4> >>").value()
    assert v == {"/A": b"x(y)A", "/B": [1, -2.5, Ref(3)], "/C": {"/D": "/E F"}, "/G": b"J@"}


@pytest.mark.parametrize("flate", [False, True])
@pytest.mark.parametrize("stream_xref", [False, True])
@pytest.mark.parametrize("encrypt", [0, 2, 3])
def test_written_files_read_back(flate, stream_xref, encrypt):
    doc = Document(write_pdf(HELLO, 18, flate, stream_xref, encrypt))
    glyphs, paths = interpret(doc, doc.pages()[0])
    assert "".join(g[0] for g in glyphs) == "HelloWorld" and not paths
    assert [round(g[1], 3) for g in glyphs[:3]] == [0, 9, 18] and glyphs[0][5] == "Plain"


def test_paths_and_state():
    doc = Document(write_pdf(HELLO))
    doc.program = lambda page: b"q 2 0 0 2 10 10 cm 1 0 0 RG 3 w 0 0 5 5 re S Q 0 0 m 1 1 2 2 3 3 c f BI /W 1 ID xx EI 0 0 m 1 0 l 1 1 l s"
    _, paths = interpret(doc, doc.pages()[0])
    assert paths[0]["x"] == [10, 20, 20, 10, 10] and paths[0]["size"] == 6 and paths[0]["colour"] == [1, 0, 0]
    assert len(paths[1]["x"]) == 101 and paths[1]["filled"] and paths[2]["x"][0] == paths[2]["x"][-1]


def test_relations(spark):
    files = spark.createDataFrame([(1, bytearray(write_pdf(HELLO, 18))), (2, bytearray(b"no pdf"))], "doc_id long, content binary")
    assert [(r.text, r.left) for r in rel.document_text(files).collect()] == [("Hello World", 0.0)]
    assert rel.xref(files).count() == 5 and rel.objects(files).count() == 5 and [r.doc_id for r in rel.errors(files).collect()] == [2]
    assert rel.page_boxes(files).head().right == 612 and "Tj" in rel.page_programs(files).head().program
    assert rel.glyph_map(files).where("codepoint = 32").head().width == 300


def test_one_bad_page(spark):
    data = write_pdf([[("one", 10.0, 10.0)], [("two", 10.0, 10.0)]], 10, True)
    i = data.index(b"stream\n") + 7
    files = spark.createDataFrame([(1, bytearray(data[:i] + b"\xff" * 8 + data[i + 8 :])), (2, bytearray(data))], "doc_id long, content binary")
    assert sorted((r.doc_id, r.page, r.text) for r in rel.document_text(files).collect()) == [(1, 2, "two"), (2, 1, "one"), (2, 2, "two")]
    assert rel.objects(files).where("doc_id = 1").count() == rel.objects(files).where("doc_id = 2").count() - 1
    assert [(r.doc_id, r.page) for r in rel.page_programs(files).orderBy("doc_id", "page").collect()] == [(1, 2), (2, 1), (2, 2)]
    assert {(r.doc_id, r.page, r.error.startswith("object 5")) for r in rel.errors(files).collect()} == {(1, 1, False), (1, None, True)}


def test_engulfed(spark):
    b = spark.createDataFrame([(1, 1, 0, 10, 0, 10), (1, 1, 2, 8, 2, 8), (1, 1, 20, 30, 0, 10)], "doc_id long, page long, left int, right int, bottom int, top int")
    assert sorted(r.left for r in op.engulfed(b).collect()) == [0, 20]


def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "pages", "part", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("edge_flags", "strip_islands", "paste_lines", "roundtrip_text", "carve_out"):
        got, want = entry.queries()[name](spark, d).toPandas(), con.sql(entry.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name
