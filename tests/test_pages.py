"""Page rules over whole pages: only texts are shuffled, pages stay whole however batches fall, and odd rows keep their places."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folio import operators as op
from folio import sources
from folio.operators import lookups as lu
from folio.operators.pages import whole_groups
from folio.pdf import relations as rel
from folio.sources import words_of

#: Queries of pages of texts, by the findings that named them.
PAGED = {
    "F1": "adjacent_letters", "F2": "assign_text", "F3": "greedy_lines", "F4": "polygon_boxes", "F5": "words_from_letters", "F6": "roundtrip_plain", "F7": "roundtrip_text", "F8": "text_boxes",
    "F9": "text_blocks", "F11": "text_elements", "F12": "strip_gaps", "F13": "vertex_next", "F14": "paste_lines", "F15": "vertex_flags", "F16": "dedupe_letters", "F17": "white_boxes",
    "F18": "strip_islands", "F19": "indent_breaks", "F20": "edge_table_mid", "F21": "edge_flags", "F23": "edge_table_right", "F24": "atomic_letters",
}


@pytest.mark.parametrize("finding", PAGED)
def test_only_texts_are_shuffled(spark, finding):
    plan = entry.queries()[PAGED[finding]](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(shuffles) == 1 and "Window" not in plan and "Aggregate" not in plan and "FlatMapGroups" not in plan
    assert "Generate" not in plan.split("Exchange")[1] and "MapInArrow" not in plan.split("Exchange")[1]  # below it are texts


@pytest.mark.parametrize("finding", [f for f in PAGED if f not in ("F6", "F7", "F24")])
def test_words_stay_in_python(spark, finding):
    """The steps run where the words are laid out: nothing but results goes from Python to Spark."""
    plan = entry.queries()[PAGED[finding]](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def moved(spark, frame):
    """Bytes that a run of it shuffles, and that it spills."""
    sc, java = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        held = sc.statusStore().stageList(java.jvm.java.util.ArrayList(), False, False, java.new_array(java.jvm.double, 0), java.jvm.java.util.ArrayList())
        return [held.apply(k) for k in range(held.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    frame.write.format("noop").mode("overwrite").save()
    own = [s for s in stages() if s.stageId() > last]
    return sum(s.shuffleWriteBytes() for s in own), sum(s.diskBytesSpilled() for s in own)


@pytest.mark.parametrize("finding", ["F13", "F14", "F18"])
def test_what_is_moved_follows_the_texts(spark, tmp_path, finding):
    """No more is shuffled than the bytes of the texts, four times as many texts take four times as much, and none spills."""
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = texts.select(F.sum(F.octet_length("text"))).first()[0]
    took = []
    for copies in (1, 4):
        texts.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).withColumn("doc_id", F.expr("doc_id + copy * 1000000")).drop("copy").write.parquet(f"{tmp_path}/{copies}/documents.parquet")
        shuffled, spilled = moved(spark, entry.queries()[PAGED[finding]](spark, f"{tmp_path}/{copies}"))
        assert 0 < shuffled <= copies * size and spilled == 0
        took.append(shuffled)
    assert took[1] <= 4.4 * took[0]


@pytest.mark.parametrize("name", ["reading_order", "upper_median_size", "page_bounds"])
def test_sharing_queries_move_texts_only(spark, name):
    """queries of the same pages shuffle no words and no pages either."""
    size = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.sum(F.octet_length("text"))).first()[0]
    frame = entry.queries()[name](spark, "/root/testdata/sf0.01")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and sum("Exchange" in line for line in plan.splitlines()) == 1
    shuffled, spilled = moved(spark, frame)
    assert 0 < shuffled <= size and spilled == 0


def test_page_measures(spark):
    """Places, middle widths and bounds of pages whose rows come in any order; also of a table without rows."""
    kind = "doc_id long, page long, row long, k long, left long, right long, bottom long, top long"
    rows = [(1, 1, 0, 0, 50, 60, 700, 710), (1, 1, 0, 1, 40, 70, 700, 710), (1, 1, 1, 0, -3, 613, 790, 800), (1, 2, 2, 0, 5, 6, -1, 9), (None, 1, 0, 1, 9, 29, 8, 18), (None, 1, 0, 0, 9, 10, 8, 18)]
    words = spark.createDataFrame(rows, kind)
    assert {(r.doc_id, r.page, r.row, r.k): r.place for r in op.reading_order(words).collect()} == {(1, 1, 1, 0): 1, (1, 1, 0, 1): 2, (1, 1, 0, 0): 3, (1, 2, 2, 0): 1, (None, 1, 0, 0): 1, (None, 1, 0, 1): 2}
    assert sorted((r.doc_id or 0, r.page, r.median) for r in op.upper_median_size(words).collect()) == [(0, 1, 20), (1, 1, 30), (1, 2, 1)]
    assert sorted((r.doc_id or 0, r.page, r.left, r.bottom, r.right, r.top) for r in op.page_bounds(words).collect()) == [(0, 1, 0, 0, 612, 792), (1, 1, -10, 0, 622, 802), (1, 2, 0, -10, 612, 792)]
    none = spark.createDataFrame([], kind)
    assert [f(none).count() for f in (op.reading_order, op.upper_median_size, op.page_bounds)] == [0, 0, 0]


@pytest.mark.parametrize("limit", [1, 3, 70, 10_000])
def test_laid_out_pages_stay_whole(spark, monkeypatch, limit):
    """Steps see whole pages, whatever number of rows is taken at a time, and also a table without rows."""
    texts = spark.createDataFrame([(k, "\n".join(f"a{k} b" for _ in range(45 * (k % 4)))) for k in range(9)], "doc_id long, text string")
    counted = lambda p: p.of_columns(np.arange(p.count), n=np.bincount(p.of, minlength=p.count))
    monkeypatch.setattr(sources, "PAGE_ROWS", limit)
    got = {(r.doc_id, r.page): r.n for r in words_of(texts, counted).collect()}
    want = {(k, page + 1): 2 * min(60, 45 * (k % 4) - 60 * page) for k in range(9) for page in range(3) if 45 * (k % 4) > 60 * page}
    assert got == want and words_of(texts.where("doc_id < 0"), counted).count() == 0


def test_tasks_follow_the_input(spark, monkeypatch, tmp_path):
    """With more input there are more tasks than shuffle partitions; rows whose size is not known keep those."""
    texts = spark.range(100).selectExpr("id AS doc_id", "repeat(cast(id AS string), 50) AS text")
    texts.coalesce(1).write.parquet(f"{tmp_path}/t")
    held = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(sources, "TASK_BYTES", 50)
    assert 4 < words_of(held).rdd.getNumPartitions() <= 100 and words_of(held).count() == 100
    monkeypatch.setattr(sources, "TASK_BYTES", 1 << 23)
    assert words_of(held).rdd.getNumPartitions() == words_of(spark.createDataFrame(texts.collect())).rdd.getNumPartitions() == 4


def test_groups_stay_whole():
    ids = [1, 1, 1, 2, None, None, 3, 3, 3, 3, 3, 3, 3, 4]
    for size in (1, 2, 5, 14):
        for limit in (1, 3, 100):
            batches = (pa.RecordBatch.from_pydict({"id": pa.array(ids[i : i + size], pa.int64()), "n": list(range(i, min(i + size, 14)))}) for i in range(0, 14, size))
            tables = [t.to_pydict() for t in whole_groups(batches, ("id",), limit)]
            assert [n for t in tables for n in t["n"]] == list(range(14))
            firsts = [t["id"][0] for t in tables]
            assert len(firsts) == len(set(firsts)) and all(set(a["id"]).isdisjoint(b["id"]) for a, b in zip(tables, tables[1:], strict=False))


def test_words_of_odd_texts(spark):
    rows = [(1, "a  bb \n\nc" + " d" * 43 + " " + "x" * 200 + " y"), (2, None), (3, ""), (None, "n o"), (5, " \n ")]
    got = words_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.row, r.k, r.text) for r in got if r.doc_id is None] == [(None, 0, 0, "n"), (None, 0, 1, "o")]
    one = [(r.row, r.k, r.text, r.left) for r in got if r.doc_id == 1]
    assert one[:3] == [(0, 0, "a", 36), (0, 1, "bb", 44), (1, 0, "c", 36)] and one[-2:] == [(1, 44, "x" * 200, 36 + 44 * 8), (2, 0, "y", 36)]
    assert {r.doc_id for r in got} == {None, 1}


def test_files_of_words_anywhere(spark):
    """Words that do not stand together give the same files as those that do."""
    texts = spark.createDataFrame([(k, f"one two\nthree {k}") for k in range(30)], "doc_id long, text string")
    words = words_of(texts)
    near = {r.doc_id: bytes(r.content) for r in rel.as_files(words, together=True).collect()}
    far = {r.doc_id: bytes(r.content) for r in rel.as_files(words.repartition(7, "text")).collect()}
    assert near == far and len(near) == 30


def test_names_of_more_than_four_digits(spark):
    names = ["/uni20AC", "/uni1F600", "/uni10FFFF", "/uni00410042", "/uni0041.alt", "/G7F", "/odd"]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "raw long, name string")
    table = spark.createDataFrame([], "name string, unicode int")
    got = {r.name: r.unicode for r in lu.named_glyphs(frame, table).collect()}
    assert [got[n] for n in names] == [0x20AC, 0x1F600, 0x10FFFF, 0x41, 0x41, 0x7F, 6]


def test_page_leaves_run_in_batches(spark):
    nodes = spark.range(2000).selectExpr("id DIV 4 AS doc_id", "id % 4 AS node", "IF(id % 4 = 0, NULL, 0) AS parent", "3 - id % 4 AS place")
    leaves = lu.page_leaves(nodes)
    assert "FlatMapGroups" not in leaves._jdf.queryExecution().executedPlan().toString()
    assert leaves.count() == 1500 and leaves.where(F.col("page") != 4 - F.col("node")).count() == 0
