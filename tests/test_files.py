"""Files from bytes to text: sample files, damaged ones, fonts, streams, and every query of the library against its SQL."""

import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folio import documents
from folio import operators as op
from folio.operators import blocks
from folio.operators import lookups as lu
from folio.pdf import relations as rel
from folio.pdf import truetype as tt
from folio.pdf.content import interpret
from folio.pdf.cos import Document, inflated, rc4, unpredicted
from folio.pdf.encodings import core_widths, encoding, glyph_unicode, type1_encoding
from folio.pdf.font_writer import write_font
from folio.pdf.samples import NAMES, damaged, packed, sample, updated
from folio.pdf.writer import _assembled, write_pdf


def test_hello_world_has_the_widths_of_its_font():
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 300 144] >>", "<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >> >> >> /Contents 4 0 R >>", ""]
    doc = Document(_assembled(objects, {4: b"BT /F1 18 Tf 0 0 Td (Hello World) Tj ET"}, "", lambda _, b: b, False))
    found = [(g[0], round(g[1], 1), round(g[2], 1)) for g in interpret(doc, doc.pages()[0])[0]]
    # The boxes that these letters must have.
    assert found == [("H", 0.0, 13.0), ("e", 13.0, 21.0), ("l", 21.0, 26.0), ("l", 26.0, 31.0), ("o", 31.0, 40.0), ("W", 44.5, 61.5), ("o", 61.5, 70.5), ("r", 70.5, 76.5), ("l", 76.5, 81.5), ("d", 81.5, 90.5)]
    assert doc.box(doc.pages()[0]) == [0, 0, 300, 144]


def test_names_and_encodings():
    given = {"/Aacute": "Á", "/zcaron": "ž", "/alpha": "α", "/sigma1": "ς", "/afii10023": "Ё", "/afii10097": "я", "/uni20AC": "€", "/G41": "A", "/odd": None, "/a.alt": "a", "/fi": "ﬁ"}
    assert {n: glyph_unicode(n) for n in given} == given
    assert encoding("/WinAnsiEncoding")[0x80] == "€" and encoding("/WinAnsiEncoding")[0x81] == "\x81" and encoding("/MacRomanEncoding")[0x80] == "Ä" and encoding("/PDFDocEncoding")[0x8D] == "“" and encoding("/StandardEncoding")[0xE9] == "Ø"
    assert core_widths("Helvetica-BoldOblique")["é"] == 556 and core_widths("Courier")["x"] == 600 and core_widths("Arial") is None
    assert type1_encoding(b"/Encoding StandardEncoding def") != {} and type1_encoding(b"nothing") == {}


def test_streams_that_are_damaged_or_predicted():
    data = bytes(range(256)) * 40
    packed_ = zlib.compress(data)
    assert inflated(packed_) == data and data.startswith(inflated(packed_[:-10])) and len(inflated(packed_[: len(packed_) // 2])) > 0
    broken = packed_[:60] + bytes([packed_[60] ^ 255]) + packed_[61:]
    assert isinstance(inflated(broken), bytes)
    with pytest.raises(ValueError, match="damaged"):
        inflated(b"\xff" * 20)
    rows = [bytes([2, 1, 2, 3]), bytes([2, 255, 1, 1]), bytes([2, 1, 1, 1])]
    assert unpredicted(b"".join(rows), {"/Predictor": 12, "/Columns": 3}) == bytes([1, 2, 3, 0, 3, 4, 1, 4, 5])
    mixed = bytes([0, 5, 6, 7]) + bytes([1, 1, 1, 1]) + bytes([2, 1, 1, 1]) + bytes([3, 2, 2, 2]) + bytes([4, 1, 1, 1])
    assert unpredicted(mixed, {"/Predictor": 15, "/Columns": 3}) == bytes([5, 6, 7, 1, 2, 3, 2, 3, 4, 3, 5, 6, 4, 6, 7])
    assert rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3" and rc4(b"k", b"") == b""


@pytest.mark.parametrize("flate", [False, True])
@pytest.mark.parametrize("stream_xref", [False, True])
def test_sample_pages(flate, stream_xref):
    doc = Document(sample(4, flate, stream_xref))
    pages = doc.pages()
    assert len(pages) == len(NAMES) and doc.box(pages[5]) == [4, 0, 300, 400] and doc.box(pages[0]) == [0, 0, 612, 792]
    texts = ["".join(g[0] for g in interpret(doc, p)[0]) for p in pages]
    assert texts == ["HelloWorld", "α€A", "Aabd", "QZ", "ABCDEFG", "", "p", "βÉ"]  # the form within itself ends
    assert "".join(g[0] for g in interpret(Document(updated(7)), Document(updated(7)).pages()[0])[0]) == "n7"
    assert "".join(g[0] for g in interpret(Document(packed(7)), Document(packed(7)).pages()[0])[0]) == "pack"


def test_files_of_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.pdf").write_bytes(damaged(k))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "X.PDF").write_bytes(write_pdf([[("one two", 100.0, 700.0), ("three", 100.0, 688.0), ("far", 400.0, 700.0)], [("second", 100.0, 700.0)]]))
    (tmp_path / "other.txt").write_text("no")
    files = documents.read_files(spark, str(tmp_path))
    names = {r.path.rsplit("/", 1)[1]: r.doc_id for r in files.collect()}
    assert set(names) == {"0.pdf", "1.pdf", "2.pdf", "X.PDF"}
    lines = Counter((r.doc_id, r.page, r.text) for r in documents.document_text(files).collect())
    x = names["X.PDF"]
    assert lines == Counter([(names["0.pdf"], 2, "page0"), (names["2.pdf"], 1, "page2"), (names["2.pdf"], 2, "page2"), (x, 1, "one two"), (x, 1, "three"), (x, 1, "far"), (x, 2, "second")])
    one = files.where(F.col("doc_id") == x)
    assert sorted((r.page, r.text) for r in documents.page_text(one).collect()) == [(1, "far"), (1, "one two three"), (2, "second")]
    assert documents.page_text(one, [2], atomic=True).count() == 6 and documents.boxes(one, [1]).count() == 2
    assert {r.doc_id for r in rel.errors(files).collect()} == {names["0.pdf"], names["1.pdf"]}


def test_arriving_files(spark, tmp_path):
    from folio.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(updated(1))
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest(spark, str(folder), target, checkpoint).awaitTermination()
    (folder / "b.pdf").write_bytes(updated(22))
    (folder / "c.pdf").write_bytes(b"broken")
    ingest(spark, str(folder), target, checkpoint).awaitTermination()
    assert "".join(r.text for r in spark.read.parquet(target).orderBy("doc_id", "seq").collect()) in ("n1n22", "n22n1")


def test_fonts(spark):
    fonts = spark.createDataFrame([(1, bytearray(write_font(3, "Own", 1000))), (2, bytearray(b"no font")), (3, bytearray(write_font(4, "Own", 1000)[:300])), (4, None)], "font_id long, content binary")
    assert {r.font_id for r in tt.font_errors(fonts).collect()} == {2, 3, 4}
    assert {r.font_id for r in tt.font_names(fonts).collect()} == {1} and tt.MAC_NAMES[:4] == [".notdef", ".null", "nonmarkingreturn", "space"] and len(tt.MAC_NAMES) == 258 and tt.MAC_NAMES[-1] == "dcroat"
    assert tt.checksum(b"\0\0\0\1\xff\xff\xff\xff\1") == 0x01000000 and tt.smooth([]) == []
    round_ = tt.smooth([(0.0, 1.0, False), (1.0, 0.0, False), (0.0, -1.0, False), (-1.0, 0.0, False)])
    assert len(round_) == 41 and round_[0] == round_[-1]


def slow_lines(words):
    """The rule of greedy lines, word by word and again after each join."""
    words = sorted((list(w) for w in words), key=lambda w: (w[0], -w[2], w[5]))
    i = 0
    while i < len(words):
        a = words[i]
        for j in range(i + 1, len(words)):
            b = words[j]
            gap = b[0] - a[1]
            if b[0] > a[1] and abs(a[2] - b[2]) < 0.7 * b[4] and gap <= 0.5 * a[4] and not (gap > 0 and (a[6] or b[7])):
                a[1], a[5], a[6], a[3] = b[1], f"{a[5]} {b[5]}", a[6] or b[6], max(a[4], b[4]) + a[2]
                del words[j]
                break
        else:
            i += 1
    return Counter((w[5], w[0], w[1], w[2], w[3]) for w in words)


def test_greedy_lines_and_adjacent_letters(spark):
    r = random.Random(1)
    words = []
    for n in range(150):
        left, bottom, size = r.randrange(0, 400) / 2, 12.0 * r.randrange(10) + r.choice([0, 0.25, -0.5, 3]), r.choice([8.0, 10.0])
        words.append((left, left + r.randrange(4, 40) / 2, bottom, bottom + size, size, f"w{n}", r.random() < 0.1, r.random() < 0.1))
    frame = spark.createDataFrame([(1, 1, *w) for w in words], "doc_id long, page long, left double, right double, bottom double, top double, size double, text string, right_edge boolean, left_edge boolean")
    got = blocks.greedy_lines(frame)
    assert Counter((x.text, x.left, x.right, x.bottom, x.top) for x in got.collect()) == slow_lines(words)
    seq = frame.withColumn("seq", F.expr("CAST(substring(text, 2) AS BIGINT)"))
    want = set()
    for i, a in enumerate(words):
        near = [(b[0], j) for j, b in enumerate(words) if i != j and b[0] > a[0] and abs(b[2] - a[2]) < 0.1 * a[4] and (abs(b[0] - a[1]) < 0.01 * a[4] or b[0] < a[1])]
        if near:
            want.add((i, min(near)[1]))
    assert {(x.seq, x.next_seq) for x in blocks.adjacent_letters(seq).collect()} == want


def test_words_of_uneven_baselines(spark):
    letters = [(1, 1, i, c, 10.0 + 5 * i, 15.0 + 5 * i, 100 + (0.3 if i % 2 else 0.0), 110.0, 10.0) for i, c in enumerate("uneven")] + [(1, 1, 9, "x", 10.0, 15.0, 98.0, 108.0, 10.0)]
    frame = spark.createDataFrame(letters, "doc_id long, page long, i long, text string, left double, right double, bottom double, top double, size double")
    assert sorted(r.text for r in op.words_from_letters(frame).collect()) == ["uneven", "x"]


def test_blocks_break_at_indents_and_join_hyphens(spark):
    words = [("one", 50, 700), ("two-", 50, 688), ("three", 50, 676), ("indented", 70, 664), ("four", 50, 652), ("aside", 400, 700), ("low", 400, 100)]
    rows = [(1, 1, n, 0, t, float(x), float(x + 5 * len(t)), float(y), y + 10.0, 10.0) for n, (t, x, y) in enumerate(words)]
    frame = spark.createDataFrame(rows, "doc_id long, page long, row long, k long, text string, left double, right double, bottom double, top double, size double")
    got = blocks.text_blocks(frame, blocks.text_boxes(frame)).orderBy("box", "part").collect()
    assert [(r.part, r.text) for r in got if r.text not in ("aside", "low")] == [(0, "one twothree"), (1, "indented four")] and {r.text for r in got} >= {"aside", "low"}
    upper, lower = (r for r in got if r.box == got[0].box)
    assert upper.bottom == 676 and lower.top == 674 and upper.left == lower.left
    assert blocks.text_boxes(frame.limit(0)).count() == 0


def test_corners_that_touch_are_two(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 5, 20, 10), (1, 1, 5, 9, 10, 0)], "doc_id long, page long, left long, right long, top long, bottom long")
    flags = {(r.x, r.y): r.flags for r in blocks.vertices(boxes).collect()}
    assert flags[5, 10] == 10 and flags[0, 20] == 2 and flags[9, 0] == 8
    assert sorted(r.flags for r in blocks.corners(blocks.vertices(boxes)).where("x = 5 AND y = 10").collect()) == [2, 8]


def test_page_tree_that_leads_back(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 0), (1, 3, 1, 1), (1, 4, 2, 0), (1, 1, 2, 1)], "doc_id long, node long, parent long, place long")
    assert [(r.node, r.page) for r in lu.page_leaves(nodes).orderBy("page").collect()] == [(4, 1), (3, 2)]


def test_all_queries_match_their_sql(spark):
    import __spark_entry__ as entry

    con, d, wrong = duckdb.connect(), "/root/testdata/sf0.001", []
    for name in ("documents", "pages", "part", "lineitem", "nation", "supplier", "customer", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")

    def rows(values):
        return Counter(tuple(round(v, 8) + 0.0 if isinstance(v, float) else v for v in r) for r in values)

    names = [n for n in entry.oracle_sql() if not n.startswith("op") and n not in ("strip_gaps", "atomic_letters", "dedupe_letters", "adjacent_letters")]  # large at any size
    for name in names:
        want = con.sql(entry.oracle_sql()[name])
        got = entry.queries()[name](spark, d).select(*[f"`{c}`" for c in want.columns])
        if rows(got.collect()) != rows(want.fetchall()):
            wrong.append(name)
    assert not wrong and len(names) > 80
