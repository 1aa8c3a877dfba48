"""Queries of whole files, with the SQL that DuckDB checks them against: the files follow from the table nation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import documents
from .. import functions as fn
from .. import operators as op
from ..operators.lookups import live
from ..pdf import relations as rel
from ..pdf.samples import damaged, packed, sample, updated
from ..sources import sample_files
from .queries import ORACLE_SQL, QUERIES, query, words

K = "(SELECT n_nationkey::BIGINT AS k FROM nation)"


def files(make: Callable[[int], bytes]) -> Callable[[SparkSession, str], DataFrame]:
    def run(rows):
        for b in rows:
            yield pd.DataFrame({"doc_id": b["n_nationkey"], "content": [make(int(k)) for k in b["n_nationkey"]]})

    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").mapInPandas(run, "doc_id long, content binary")


#: Page, text, font, size, and for left, right and bottom what k is multiplied with and what is added.
GLYPHS = """(VALUES (1, 'H', 'Times-Roman', 10, 1, 0, 7.22, 700, 0), (1, 'e', 'Times-Roman', 10, 1, 7.22, 11.66, 700, 0), (1, 'l', 'Times-Roman', 10, 1, 11.66, 14.44, 700, 0), (1, 'l', 'Times-Roman', 10, 1, 14.44, 17.22, 700, 0), (1, 'o', 'Times-Roman', 10, 1, 17.22, 22.22, 700, 0),
(1, 'W', 'Times-Roman', 10, 1, 24.72, 34.16, 700, 0), (1, 'o', 'Times-Roman', 10, 1, 34.16, 39.16, 700, 0), (1, 'r', 'Times-Roman', 10, 1, 39.16, 42.49, 700, 0), (1, 'l', 'Times-Roman', 10, 1, 42.49, 45.27, 700, 0), (1, 'd', 'Times-Roman', 10, 1, 45.27, 50.27, 700, 0),
(2, 'α', 'Own', 10, 1, 0, 6, 700, 0), (2, '€', 'Own', 10, 1, 6, 13, 700, 0), (2, 'A', 'Own', 10, 1, 13, 21, 700, 0),
(3, 'A', 'Wide', 10, 1, 0, 5, 700, 0), (3, 'a', 'Wide', 10, 1, 5, 11, 700, 0), (3, 'b', 'Wide', 10, 1, 11, 18, 700, 0), (3, 'd', 'Wide', 10, 1, 18, 27, 700, 0),
(4, 'Q', 'Courier', 20, 2, 10, 22, 220, 0), (4, 'Z', 'Courier', 10, 0, 0, 6, 0, 0),
(5, 'A', 'Courier', 10, 1, 0, 3.5, 700, 0), (5, 'B', 'Courier', 10, 1, 9.5, 13, 700, 0), (5, 'C', 'Courier', 10, 1, 0, 3.5, 688, 0), (5, 'D', 'Courier', 10, 1, 0, 3.5, 676, 0), (5, 'E', 'Courier', 10, 1, 3.5, 7, 676, 0), (5, 'F', 'Courier', 10, 1, 12, 15.5, 676, 0), (5, 'G', 'Courier', 10, 1, 0, 6, 100, 0),
(7, 'p', 'Courier', 10, 1, 0, 6, 700, 0), (8, 'β', 'Embedded', 10, 1, 0, 5, 700, 0), (8, 'É', 'Embedded', 10, 1, 5, 10, 700, 0)) g(page, text, font, size, f, l, r, b, nothing)"""


@query(f'SELECT k AS doc_id, page::BIGINT AS page, text, round(f * k + l::DOUBLE, 4) AS "left", round(f * k + r::DOUBLE, 4) AS "right", b::DOUBLE AS bottom, (b + size)::DOUBLE AS top, font, size::DOUBLE AS size FROM {K}, {GLYPHS}', files(sample))
def pdf_glyphs(f):
    return rel.glyphs(f).select("doc_id", "page", "text", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"), F.round("bottom", 4).alias("bottom"), F.round("top", 4).alias("top"), "font", F.round("size", 4).alias("size"))


@query(f"SELECT k AS doc_id, page, text FROM {K}, (VALUES (1::BIGINT, 'Hello World'), (2, 'α€A'), (3, 'Aabd'), (4, 'Q'), (4, 'Z'), (5, 'A'), (5, 'B'), (5, 'C'), (5, 'DE F'), (5, 'G'), (7, 'p'), (8, 'βÉ')) t(page, text)", files(lambda k: sample(k, False, False)))
def pdf_lines(f):
    return documents.document_text(f).select("doc_id", "page", "text")


@query(f"SELECT k AS doc_id, page::INT AS page, CASE WHEN page = 6 THEN k ELSE 0 END::DOUBLE AS \"left\", 0.0::DOUBLE AS bottom, CASE WHEN page = 6 THEN 300 ELSE 612 END::DOUBLE AS \"right\", CASE WHEN page = 6 THEN 400 ELSE 792 END::DOUBLE AS top FROM {K}, range(1, 9) p(page)", files(sample))
def pdf_page_boxes(f):
    return rel.page_boxes(f)


@query(f"SELECT k AS doc_id, 7 AS page, path, l::DOUBLE AS \"left\", r::DOUBLE AS \"right\", t::DOUBLE AS top, b::DOUBLE AS bottom FROM {K}, LATERAL (VALUES (0, 10, 2 * k + 12, 20, 10), (1, 0, 10, k + 10, 0), (2, 0, 3, 3, 0), (3, 900, 950, 950, 900)) p(path, l, r, t, b)", files(sample))
def pdf_path_boxes(f):
    sides = [F.round(c, 4).alias(c) for c in ("left", "right", "top", "bottom")]
    return rel.path_boxes(rel.paths(f)).select("doc_id", "page", "path", *sides)


@query(f"""SELECT k AS doc_id, shape, kind, fill, col, lwd::DOUBLE AS lwd, fontsize::DOUBLE AS fontsize, label, points, round(x::DOUBLE / 612, 6) AS x, round(y::DOUBLE / 792, 6) AS y FROM {K}, LATERAL (VALUES (0, 'polygon', '#00ff00', '#ff0000', 2, NULL, NULL, 5, 10, 10), (1, 'polyline', NULL, '#7f7f7f', 2, NULL, NULL, 4, 0, 0), (2, 'text', NULL, '#7f7f7f', 1, 10, 'p', 1, k, 700),
(3, 'polygon', '#00ff00', NULL, 2, NULL, NULL, 101, 0, 0), (4, 'polygon', '#000000', NULL, 2, NULL, NULL, 2, 900, 900)) p(shape, kind, fill, col, lwd, fontsize, label, points, x, y)""", files(sample))  # fmt: skip
def pdf_drawables(f):
    d = rel.drawables(f).where("page = 7")
    return d.select("doc_id", "shape", "kind", "fill", "col", "lwd", "fontsize", "label", F.size("x").alias("points"), F.round(F.col("x")[0], 6).alias("x"), F.round(F.col("y")[0], 6).alias("y"))


@query(f"SELECT k AS doc_id, poly, n::BIGINT AS points, filled, has_text, CASE WHEN has_text THEN 20 / 3.0::DOUBLE END AS text_size FROM {K}, (VALUES (1, 5, true, false), (2, 4, false, false), (3, 1, false, true), (4, 101, true, false)) p(poly, n, filled, has_text)", files(sample))
def pdf_graphics(f):
    g = rel.graphics(f, scale=2.0).where("page = 7")
    return g.groupBy("doc_id", "poly", "filled", "has_text", "text_size").agg(F.count("*").alias("points"))


@query(f"SELECT k AS doc_id, 'n' || k AS text FROM {K}", files(updated))
def pdf_newest_section(f):
    return documents.document_text(f).select("doc_id", "text")


@query(f"SELECT k AS doc_id, object::INT AS object, 1 AS given FROM {K}, (VALUES (1), (2), (3), (5)) o(object)", files(updated))
def pdf_xref(f):
    return rel.xref(f).select("doc_id", "object", F.col("start_byte").isNotNull().cast("int").alias("given"))


@query(f"SELECT k AS doc_id, object::INT AS object, CASE WHEN object <= 3 THEN 11 ELSE 0 END::INT AS in_object FROM {K}, (VALUES (1), (2), (3), (10), (11), (12)) o(object)", files(packed))
def pdf_object_streams(f):
    return rel.xref(f).select("doc_id", "object", F.coalesce("in_object", F.lit(0)).alias("in_object"))


@query(f"SELECT k AS doc_id, object::INT AS object, kind FROM {K}, (VALUES (1, '/Catalog'), (2, '/Pages'), (3, '/Page'), (10, NULL), (11, '/ObjStm'), (12, '/XRef')) o(object, kind) WHERE object <> 10", files(packed))
def pdf_objects(f):
    return rel.objects(f).where("object <> 10").select("doc_id", "object", F.col("header")["/Type"].alias("kind"))


@query(f"SELECT k AS doc_id, 'BT /F1 10 Tf ' || k || ' 50 Td (pack) Tj ET' AS program FROM {K}", files(packed))
def pdf_page_programs(f):
    return rel.page_programs(f).select("doc_id", F.rtrim(F.regexp_replace("program", "\n+$", "")).alias("program"))


@query(f"SELECT k AS doc_id, code AS codepoint, unicode, width::DOUBLE AS width FROM {K}, (VALUES (65, 945, 600), (66, 8364, 700), (67, 65, 800), (65, 946, 500), (66, 201, 500)) g(code, unicode, width)", files(sample))
def pdf_glyph_map(f):
    return rel.glyph_map(f).where("codepoint BETWEEN 65 AND 67 AND unicode <> codepoint").select("doc_id", "codepoint", "unicode", "width")


@query(f"SELECT k AS doc_id, page FROM {K}, (VALUES (0), (1)) p(page) WHERE k % 3 = 0 OR (k % 3 = 1 AND page = 0)", files(damaged))
def pdf_errors(f):
    return rel.errors(f).select("doc_id", F.coalesce("page", F.lit(0)).alias("page"))


@query(f"SELECT k AS doc_id, page::BIGINT AS page, 'page' || k AS text FROM {K}, (VALUES (1), (2)) p(page) WHERE k % 3 = 2 OR (k % 3 = 0 AND page = 2)", files(damaged))
def pdf_sound_pages(f):
    return documents.document_text(f).select("doc_id", "page", "text")


@query(f"SELECT k AS doc_id, 'Hello World' AS text FROM {K}", files(lambda k: sample(k + 100)))
def pdf_blocks(f):
    return documents.page_text(f, [1]).select("doc_id", "text")


@query(f"SELECT k AS doc_id, text, x::DOUBLE AS x, y::DOUBLE AS y FROM {K}, LATERAL (VALUES ('α', k + 3, 705), ('€', k + 9.5, 705), ('A', k + 17, 705)) m(text, x, y)", files(sample))
def pdf_midpoints(f):
    return documents.plotted(f, [2], atomic=True).select("doc_id", "text", "x", "y")


TOKENS = "(VALUES (0, 'BT', 'operator'), (1, '/F1', 'name'), (2, '10', 'number'), (3, 'Tf', 'operator'), (4, NULL, 'number'), (5, '700', 'number'), (6, 'Td', 'operator'), (7, 'AB', 'string'), (8, 'Tj', 'operator'), (9, 'ET', 'operator')) t(seq, token, type)"


@query(f"SELECT k AS doc_id, seq::INT AS seq, coalesce(token, k::VARCHAR) AS token, type FROM {K}, {TOKENS}", files(sample))
def page_tokens(f):
    return rel.tokens(f).where("page = 8").select("doc_id", "seq", "token", "type")


@query(f"SELECT k AS doc_id, n::INT AS object, 'Contents,Parent,Resources,Type' AS keys, (n + 1)::INT AS contents, 2 AS parent FROM {K}, (VALUES (7), (9), (11), (13)) p(n)", files(lambda k: sample(k, False, True)))
def dictionary_views(f):
    """Keys, and the first reference of a value."""
    o = rel.objects(f).where("header['/Type'] = '/Page' AND object <= 13")
    first = lambda key: F.get(fn.parse_refs(F.col("header")[key]), 0)
    keys = F.regexp_replace(F.array_join(F.array_sort(F.map_keys("header")), ","), "/", "")
    return o.select("doc_id", "object", keys.alias("keys"), first("/Contents").alias("contents"), first("/Parent").alias("parent"))


@query("""WITH b AS (SELECT p_partkey // 50 AS doc_id, p_partkey AS id, p_partkey % 37 AS l, p_partkey % 37 + p_size AS r, p_partkey % 11 AS b, p_partkey % 11 + p_size % 13 + 1 AS t FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l, t DESC, r, b) AS n FROM b)
SELECT doc_id, id FROM n i WHERE NOT EXISTS (FROM n o WHERE o.doc_id = i.doc_id AND o.n < i.n AND o.l <= i.l AND o.r >= i.r AND o.t >= i.t AND o.b <= i.b)""", lambda spark, d: spark.read.parquet(f"{d}/part.parquet"))  # fmt: skip
def engulfed_boxes(p):
    left, bottom = F.col("p_partkey") % 37, F.col("p_partkey") % 11
    boxes = p.select(F.floor(F.col("p_partkey") / 50).alias("doc_id"), F.lit(1).alias("page"), F.col("p_partkey").alias("id"), left.alias("left"), (left + F.col("p_size")).alias("right"), bottom.alias("bottom"), (bottom + F.col("p_size") % 13 + 1).alias("top"))
    return op.engulfed(boxes).select("doc_id", "id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'R'", lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet"))
def live_elements(x):
    return live(x.withColumn("consumed", F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_partkey")


QUERIES["roundtrip_plain"] = lambda spark, d: rel.roundtrip(words(spark, d), flate=False, stream_xref=False, encrypt=2, together=True)
ORACLE_SQL["roundtrip_plain"] = ORACLE_SQL["roundtrip_text"]


@query("SELECT 'sample' || k AS name, page::INT AS page FROM range(9) s(k), range(1, 9) p(page)", lambda spark, d: documents.numbered(sample_files(spark)).join(sample_files(spark).select("name", "path"), "path"))
def sample_pages(f):
    return rel.page_boxes(f).join(f.select("doc_id", "name"), "doc_id").select("name", "page")


@query("SELECT p_partkey, list_min(b)::INT AS least, list_max(b)::INT AS greatest FROM (SELECT p_partkey, list_transform(string_split(p_name || CASE WHEN p_partkey % 2 = 0 THEN '~' ELSE '!' END, ''), lambda c: ascii(c)) AS b FROM part)", lambda spark, d: spark.read.parquet(f"{d}/part.parquet"))
def byte_range(p):
    text = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "~").otherwise("!"))
    return p.select("p_partkey", fn.byte_range(text).alias("b")).select("p_partkey", "b.least", "b.greatest")
