"""Queries of look-ups, orderings, decoders and TrueType tables, with the SQL that DuckDB checks them against."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups as lu
from ..pdf import truetype as tt
from ..pdf.font_writer import write_font
from .queries import ORACLE_SQL, docs, query, tables

#: The base relations of these queries. Fonts are numbered by supplier, codes by part.
CODES = "SELECT p_partkey AS id, p_partkey % 7 AS font, p_partkey % 256 AS raw FROM part"
ENCODING = "SELECT n_nationkey % 7 AS font, (n_nationkey * 11 + 3)::BIGINT AS raw, (n_nationkey + 1000)::BIGINT AS unicode FROM nation"
WIDTHS = "SELECT s_suppkey % 7 AS font, s_suppkey AS code, any_value(s_nationkey * 10)::DOUBLE AS width FROM supplier WHERE s_suppkey < 256 GROUP BY ALL"


def codes(p: DataFrame) -> DataFrame:
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("font"), (F.col("p_partkey") % 256).alias("raw"))


def encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select((F.col("n_nationkey") % 7).alias("font").cast("long"), (F.col("n_nationkey") * 11 + 3).cast("long").alias("raw"), (F.col("n_nationkey") + 1000).cast("long").alias("unicode"))


def widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey < 256")
    return s.select((F.col("s_suppkey") % 7).alias("font"), F.col("s_suppkey").alias("code"), (F.col("s_nationkey") * 10).cast("double").alias("width"))


def whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return codes(spark.read.parquet(f"{sf_dir}/part.parquet")), encoding(spark, sf_dir), widths(spark, sf_dir)


@query(f"SELECT c.id, c.font, c.raw, coalesce(e.unicode, c.raw) AS unicode FROM ({CODES}) c LEFT JOIN ({ENCODING}) e ON c.font = e.font AND c.raw = e.raw", whole)
def encoding_default(t):
    return lu.encoded(t[0], t[1]).select("id", "font", "raw", "unicode")


@query(f"SELECT c.id, c.font, c.raw, coalesce(w.width, 500)::DOUBLE AS width FROM ({CODES}) c LEFT JOIN ({WIDTHS}) w ON c.font = w.font AND c.raw = w.code", whole)
def width_default(t):
    return lu.with_widths(t[0], t[2]).select("id", "font", "raw", "width")


@query(f"SELECT e.font, e.raw, e.unicode, coalesce(w.width, 500)::DOUBLE AS width FROM ({ENCODING}) e LEFT JOIN ({WIDTHS}) w ON e.font = w.font AND e.raw = w.code", whole)
def glyph_table(t):
    return lu.glyph_table(t[1], t[2])


@query(f"SELECT c.id, c.font, c.raw, e.unicode, coalesce(w.width, 500)::DOUBLE AS width FROM ({CODES}) c JOIN ({ENCODING}) e ON c.font = e.font AND c.raw = e.raw LEFT JOIN ({WIDTHS}) w ON e.font = w.font AND e.raw = w.code", whole)
def glyph_lookup(t):
    return lu.glyph_lookup(t[0], lu.glyph_table(t[1], t[2])).select("id", "font", "raw", "unicode", "width")


@query("""WITH fonts AS (SELECT DISTINCT c_nationkey AS doc_id, 'F' || (c_custkey % 9) AS name FROM customer WHERE c_custkey % 9 <> 4)
SELECT s_suppkey AS id, s_nationkey AS doc_id, 'F' || (s_suppkey % 9) AS name, coalesce(f.name, (SELECT min(name) FROM fonts a WHERE a.doc_id = s_nationkey)) AS found FROM supplier LEFT JOIN fonts f ON f.doc_id = s_nationkey AND f.name = 'F' || (s_suppkey % 9)""", lambda spark, d: (tables("supplier")(spark, d), tables("customer")(spark, d)))  # fmt: skip
def font_fallback(t):
    uses = t[0].select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("doc_id"), F.concat(F.lit("F"), F.col("s_suppkey") % 9).alias("name"))
    fonts = t[1].where("c_custkey % 9 <> 4").select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("F"), F.col("c_custkey") % 9).alias("name"))
    return lu.with_fallback_fonts(uses, fonts).select("id", "doc_id", "name", "found")


@query("""SELECT p_partkey AS raw, CASE p_partkey % 4 WHEN 0 THEN '/' || n_name WHEN 1 THEN printf('/uni%04X', p_partkey) WHEN 2 THEN printf('/G%02X', p_partkey % 256) ELSE '/odd' END AS name,
CASE p_partkey % 4 WHEN 0 THEN n_nationkey + 50 WHEN 1 THEN p_partkey WHEN 2 THEN p_partkey % 256 ELSE p_partkey END::BIGINT AS unicode FROM part JOIN nation ON n_nationkey = p_partkey % 25""", lambda spark, d: (tables("part")(spark, d), tables("nation")(spark, d)))  # fmt: skip
def name_fallback(t):
    names = t[0].join(t[1], F.col("n_nationkey") == F.col("p_partkey") % 25)
    kind, key = F.col("p_partkey") % 4, F.col("p_partkey")
    name = F.when(kind == 0, F.concat(F.lit("/"), "n_name")).when(kind == 1, F.format_string("/uni%04X", key)).when(kind == 2, F.format_string("/G%02X", key % 256)).otherwise("/odd")
    table = t[1].select(F.concat(F.lit("/"), "n_name").alias("name"), (F.col("n_nationkey") + 50).alias("unicode"))
    return lu.named_glyphs(names.select(key.alias("raw"), name.alias("name")), table).select("raw", "name", F.col("unicode").cast("long").alias("unicode"))


@query("""SELECT l_orderkey AS font, l_linenumber * 20 + i AS raw, '/g' || i AS name FROM lineitem, range(3) r(i) WHERE l_linenumber <= 3 AND i <= l_linenumber % 3""", tables("lineitem"))
def differences(x):
    parts = F.concat(F.array((F.col("l_linenumber") * 20).cast("string")), F.transform(F.sequence(F.lit(0), F.col("l_linenumber") % 3), lambda i: F.concat(F.lit("/g"), i)))
    entries = x.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("font"), "l_linenumber", F.posexplode(parts).alias("i", "entry"))
    return lu.differences(entries.select("font", (F.col("l_linenumber") * 10 + F.col("i")).alias("pos"), "entry"))


@query("SELECT p_partkey AS font, p_size + i AS raw, p_partkey * 3 + i AS unicode FROM part, range(50) r(i) WHERE i <= p_size % 8", tables("part"))
def bfrange_expand(p):
    low = F.col("p_size").cast("long")
    return lu.bfrange(p.select(F.col("p_partkey").alias("font"), low.alias("lo"), (low + low % 8).alias("hi"), (F.col("p_partkey") * 3).alias("start")))


@query("SELECT p_partkey AS font, p_size + i AS raw, p_partkey + 2 * i AS unicode FROM part, range(2) r(i)", tables("part"))
def bfchar_pairs(p):
    pair = lambda i: (F.format_string("<%04X>", F.col("p_size") + i), F.format_string(" <%04X>\n", F.col("p_partkey") + 2 * i))
    text = F.concat(F.lit("/CMap def 2 beginbfchar\n"), *pair(0), *pair(1), F.lit("endbfchar end"))
    return lu.bfchar(p.select(F.col("p_partkey").alias("font"), text.alias("text")))


@query("SELECT p_partkey AS font, 32 + i AS code, (p_size * 10 + i)::DOUBLE AS width FROM part, range(5) r(i)", tables("part"))
def widths_explode(p):
    each = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("p_size") * 10 + i)
    return lu.simple_widths(p.select(F.col("p_partkey").alias("font"), F.lit(32).alias("first_char"), each.alias("widths"))).withColumn("code", F.col("code").cast("long"))


@query("SELECT p_partkey AS font, 10 + i AS code, (300 + i)::DOUBLE AS width FROM part, range(3) r(i) UNION ALL SELECT p_partkey, 100 + i, p_size::DOUBLE FROM part, range(51) r(i) WHERE i <= p_size", tables("part"))
def cid_widths(p):
    font = F.col("p_partkey").alias("font")
    given = F.array(*[F.lit(300.0 + i) for i in range(3)])
    lists = p.select(font, F.lit(10).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("double").alias("width"), given.alias("widths"))
    ranges = p.select(font, F.lit(100).cast("long").alias("first"), (F.col("p_size") + 100).cast("long").alias("last"), F.col("p_size").cast("double").alias("width"), F.lit(None).cast("array<double>").alias("widths"))
    return lu.cid_widths(lists.unionByName(ranges))


@query("SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS rank FROM orders", tables("orders"))
def rank_of(o):
    return lu.ranked(o, "o_totalprice", ("o_custkey",)).select("o_orderkey", "o_custkey", "rank")


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS place, o_orderkey FROM orders", tables("orders"))
def gather_by_rank(o):
    return lu.gathered(o, "o_orderkey", "o_totalprice", "o_custkey")


@query('SELECT l_orderkey, l_linenumber, coalesce(lead("at") OVER w, 100000) - "at" AS length FROM (SELECT *, l_linenumber * 100 + l_partkey % 50 AS "at" FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY "at")', tables("lineitem"))
def offset_lengths(x):
    rows = x.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 100 + F.col("l_partkey") % 50).alias("at"), F.lit(100000).cast("long").alias("end"))
    return lu.lengths(rows, "l_orderkey", "at", "end").select("l_orderkey", "l_linenumber", "length")


@query("SELECT l_orderkey, l_linenumber, (sum(l_partkey % 256) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) % 256)::BIGINT AS byte FROM lineitem", tables("lineitem"))
def png_up(x):
    rows = x.select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey").alias("row"), F.lit(0).alias("c"), (F.col("l_partkey") % 256).alias("v"))
    return lu.undone_up(rows, "l_orderkey", "row", "c", "v").select("l_orderkey", "l_linenumber", "byte")


@query("SELECT p_partkey, p_partkey % 256 * 65536 + p_size * 256 + 7 AS number FROM part", tables("part"))
def big_endian(p):
    return p.select("p_partkey", lu.big_endian(F.array((F.col("p_partkey") % 256).cast("long"), F.col("p_size").cast("long"), F.lit(7).cast("long"))).alias("number"))


@query("SELECT p_partkey, (p_partkey >> (p_size % 5)) & 7 AS bits, list_sum(list_transform(range(8), lambda i: ((p_partkey >> i) & 1) << (7 - i)))::BIGINT AS flipped FROM part", tables("part"))
def bit_reader(p):
    key = F.col("p_partkey")
    return p.select("p_partkey", lu.bits_of(key, (F.col("p_size") % 5).cast("int"), F.lit(3)).alias("bits"), lu.flipped(key, 8).cast("long").alias("flipped"))


@query("SELECT o_custkey, (sum(o_orderkey * 100000) % 4294967296)::BIGINT AS total FROM orders GROUP BY o_custkey", tables("orders"))
def word_checksum(o):
    return o.groupBy("o_custkey").agg(lu.checksum(F.collect_list(F.col("o_orderkey") * 100000)).alias("total"))


@query("SELECT o_custkey AS doc_id, o_orderkey % 50 AS object, arg_max(o_orderkey, o_orderkey) AS start_byte FROM orders GROUP BY ALL HAVING arg_max(o_orderstatus, o_orderkey) <> 'P'", tables("orders"))
def xref_latest(o):
    rows = o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 50).alias("object"), F.col("o_orderkey").alias("start_byte"), F.col("o_orderkey").alias("section"), F.when(F.col("o_orderstatus") == "P", "f").otherwise("n").alias("kind"))
    return lu.latest(rows, ("doc_id", "object"), "section")


@query("""WITH RECURSIVE nodes AS (SELECT o_custkey AS doc_id, -1::BIGINT AS node, NULL::BIGINT AS parent, 0::BIGINT AS place FROM orders GROUP BY o_custkey
UNION ALL SELECT o_custkey, o_orderkey, CASE WHEN lag(o_orderkey, 2) OVER w IS NOT NULL AND n % 3 <> 0 THEN lag(o_orderkey, 2) OVER w ELSE -1 END, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
walk AS (SELECT doc_id, node, []::BIGINT[] AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.node, list_append(path, n.place) FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.parent = w.node)
SELECT doc_id, node, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS page FROM walk WHERE (doc_id, node) NOT IN (SELECT doc_id, parent FROM nodes WHERE parent IS NOT NULL)""", tables("orders"))  # fmt: skip
def page_tree(o):
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("o_orderkey", 2).over(order))
    parent = F.when(F.col("before").isNotNull() & (F.col("n") % 3 != 0), F.col("before")).otherwise(-1).cast("long")
    nodes = rows.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("node"), parent.alias("parent"), F.col("n").cast("long").alias("place"))
    roots = o.select(F.col("o_custkey").alias("doc_id")).distinct().selectExpr("doc_id", "-1L AS node", "CAST(NULL AS BIGINT) AS parent", "0L AS place")
    return lu.page_leaves(nodes.unionByName(roots))


BOX = "{{'left': {a} % 10, 'right': {a} % 10 + {b} % 7 + 1, 'bottom': {b} % 9, 'top': {b} % 9 + {a} % 5 + 1}}"


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey % 10 AS l, p_partkey % 10 + p_size % 7 + 1 AS r, p_size % 9 AS b, p_size % 9 + p_partkey % 5 + 1 AS t FROM part),
p AS (SELECT a.id, a.l, a.r, a.b, a.t, o.l AS l2, o.r AS r2, o.b AS b2, o.t AS t2 FROM b a JOIN b o ON o.id = a.id + 1)
SELECT id, l = l2 OR r = r2 OR t = t2 OR b = b2 AS shares, l = r2 AND t = t2 AND b = b2 AS adjacent, l < r2 AND r > l2 AND b < t2 AND t > b2 AS encroaches,
l <= l2 AND r >= r2 AND t >= t2 AND b <= b2 AND NOT (l = l2 AND r = r2 AND t = t2 AND b = b2) AS engulfs, l = l2 AND r = r2 AND t = t2 AND b = b2 AS equal,
CASE WHEN l2 BETWEEN l AND r AND b2 BETWEEN b AND t THEN (CASE WHEN l2 > l AND b2 < t THEN 8 ELSE 0 END) + (CASE WHEN l2 < r AND b2 < t THEN 4 ELSE 0 END) + (CASE WHEN l2 < r AND b2 > b THEN 2 ELSE 0 END) + (CASE WHEN l2 > l AND b2 > b THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS quarters,
abs(b - b2) < 0.7::DOUBLE * (t2 - b2) AS same_line FROM p""", tables("part"))  # fmt: skip
def box_predicates(p):
    left, bottom = F.col("p_partkey") % 10, (F.col("p_size") % 9).cast("long")
    box = F.struct(left.alias("left"), (left + F.col("p_size") % 7 + 1).alias("right"), bottom.alias("bottom"), (bottom + F.col("p_partkey") % 5 + 1).alias("top"))
    b = p.select(F.col("p_partkey").alias("id"), box.alias("a"))
    pairs = b.join(b.select((F.col("id") - 1).alias("id"), F.col("a").alias("o")), "id")
    a, o = F.col("a"), F.col("o")
    return pairs.select("id", lu.shares_edge(a, o).alias("shares"), lu.adjacent(a, o).alias("adjacent"), lu.encroaches(a, o).alias("encroaches"), lu.engulfs(a, o).alias("engulfs"), lu.about_equal(a, o).alias("equal"), lu.quadrants(a, o["left"], o["bottom"]).cast("long").alias("quarters"), lu.same_line(a["bottom"], o["bottom"], o["top"] - o["bottom"]).alias("same_line"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(substr(text, 1, 40), '.', 0), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z]') THEN 'L' WHEN regexp_full_match(c, '[0-9]') THEN 'D' WHEN regexp_full_match(c, '\\s') THEN ' ' ELSE c END), '') AS kinds FROM documents", docs)
def symbol_types(d):
    from .. import functions as fn

    return d.select("doc_id", F.array_join(F.transform(F.regexp_extract_all(F.substring("text", 1, 40), F.lit("."), 0), fn.symbol_type), "").alias("kinds"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(text, '[-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)'), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL AND x < 1000), lambda x: printf('%.3f', x)), ',') AS floats FROM documents", docs)
def parse_floats(d):
    from .. import functions as fn

    found = F.filter(fn.parse_floats(F.col("text")), lambda x: x.isNotNull() & (x < 1000))
    return d.select("doc_id", F.array_join(F.transform(found, lambda x: F.format_string("%.3f", x)), ",").alias("floats"))


@query("SELECT p_partkey, (p_partkey % 65536) || ',' || p_size AS units, array_to_string(list_transform(string_split(p_brand, ''), lambda c: ascii(c) & 255), ',') AS raw FROM part", tables("part"))
def raw_characters(p):
    from .. import functions as fn

    text = F.format_string("%04X%04X", F.col("p_partkey") % 65536, F.col("p_size"))
    return p.select("p_partkey", F.array_join(fn.hex_to_raw(text), ",").alias("units"), F.array_join(fn.string_to_raw(F.col("p_brand")), ",").alias("raw"))


@query("SELECT p_partkey, regexp_full_match(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN '.PDF' WHEN p_partkey % 3 = 1 THEN '.pdf' ELSE '.pdf.txt' END), '.*\\.pdf') AS ok, 'ffi' || p_brand || 'fl' AS spelt FROM part", tables("part"))
def path_and_ligatures(p):
    from .. import functions as fn

    end = F.when(F.col("p_partkey") % 3 == 0, ".PDF").when(F.col("p_partkey") % 3 == 1, ".pdf").otherwise(".pdf.txt")
    return p.select("p_partkey", fn.is_pdf_path(F.concat("p_name", end)).alias("ok"), fn.expand_ligatures(F.concat(F.lit("ﬃ"), "p_brand", F.lit("ﬂ"))).alias("spelt"))


@query("""SELECT l_orderkey, l_linenumber, 2 * l_quantity + 3 * l_partkey AS a, 2 * l_suppkey + 3 AS b, 5 * l_quantity + 7 * l_partkey AS c, 5 * l_suppkey + 7 AS d, 11 * l_quantity + 13 * l_partkey + 1 AS e, 11 * l_suppkey + 13 + 2 AS f FROM lineitem""", tables("lineitem"))
def matrix_multiply(x):
    from .. import functions as fn

    p = F.array(*map(F.lit, (2.0, 3.0, 5.0, 7.0, 11.0, 13.0)))
    q = F.array(F.col("l_quantity"), F.col("l_suppkey").cast("double"), F.col("l_partkey").cast("double"), F.lit(1.0), F.lit(1.0), F.lit(2.0))
    m = fn.matrix_multiply(p, q)
    return x.select("l_orderkey", "l_linenumber", *[(m[i].cast("long") if c in "bdf" else m[i]).alias(c) for i, c in enumerate("abcdef")])


def nation_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(rows):
        for b in rows:
            yield pd.DataFrame({"font_id": b["n_nationkey"], "content": [write_font(int(k), n, 1000 + int(r)) for k, n, r in zip(b["n_nationkey"], b["n_name"], b["n_regionkey"], strict=True)]})

    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").mapInPandas(run, "font_id long, content binary")


N = "FROM (SELECT n_nationkey::BIGINT AS k, n_name, n_regionkey FROM nation)"


@query(f"SELECT k AS font_id, name AS \"table\", size AS length, true AS sound {N}, (VALUES ('OS/2', 68), ('cmap', 386), ('glyf', 84), ('head', 54), ('maxp', 32)) t(name, size)", nation_fonts)
def font_tables(f):
    found = tt.font_tables(f).where(F.col("table").isin("OS/2", "cmap", "glyf", "head", "maxp"))
    return found.select("font_id", "table", F.col("length").cast("int").alias("length"), (F.col("checksum") == F.col("computed")).alias("sound"))


@query(f"SELECT k AS font_id, 1.0::DOUBLE AS version, 1.5::DOUBLE AS fontRevision, 1594834165::BIGINT AS magicNumber, 1000 + n_regionkey AS unitsPerEm, 86400 * k AS created, 86400 * k + 60 AS modified, (100 + 11 * k)::INT AS xMax, 220 AS yMax, (k % 4)::INT AS macStyle, (k % 2)::INT AS indexToLocFormat {N}", nation_fonts)
def font_head(f):
    return tt.font_head(f).select("font_id", "version", "fontRevision", "magicNumber", "unitsPerEm", F.unix_timestamp("created").alias("created"), F.unix_timestamp("modified").alias("modified"), "xMax", "yMax", "macStyle", "indexToLocFormat")


@query(f"SELECT k AS font_id, 4 AS numGlyphs, 6 AS maxPoints, 2 AS maxContours, 1 AS maxComponentDepth {N}", nation_fonts)
def font_maxp(f):
    return tt.font_maxp(f).select("font_id", "numGlyphs", "maxPoints", "maxContours", "maxComponentDepth")


@query(f"SELECT k AS font_id, (500 + k)::INT AS xAvgCharWidth, 400 AS usWeightClass, 10 AS ySubscriptXSize, '0,1,2,3,4,5,6,7,8,9' AS panose, '1,2,3,' || k AS ranges, 'FOLI' AS achVendID, 67 AS usLastCharIndex {N}", nation_fonts)
def font_os2(f):
    return tt.font_os2(f).select("font_id", "xAvgCharWidth", "usWeightClass", "ySubscriptXSize", F.array_join("panose", ",").alias("panose"), F.array_join("ulUnicodeRange", ",").alias("ranges"), "achVendID", "usLastCharIndex")


@query(f"SELECT k AS font_id, glyph, \"at\" AS \"offset\", size AS length {N}, (VALUES (0, 0::BIGINT, 0::BIGINT), (1, 0, 32), (2, 32, 28), (3, 60, 24)) t(glyph, \"at\", size)", nation_fonts)
def font_loca(f):
    return tt.font_loca(f)


@query(f"""SELECT k AS font_id, format, code AS first, glyph AS second {N}, (VALUES (1, 0), (2, 1), (3, 2)) g(glyph, i), LATERAL (VALUES (0, 65 + i), (4, 65 + i), (6, (97 + k % 5 + i)::INT), (12, (128512 + k + i)::INT)) c(format, code)
UNION ALL SELECT k, 4, (299 + k + i)::INT, 3 - 2 * i {N}, (VALUES (0), (1)) g(i)""", nation_fonts)
def font_cmap(f):
    return tt.font_cmap(f).select("font_id", "format", "first", "second")


@query(f"SELECT k AS font_id, 2.0::DOUBLE AS version, -0.5::DOUBLE AS italic_angle, -75 AS UnderlinePosition, 50 AS UnderlineThickness, k % 2 AS IsFixedPitch {N}", nation_fonts)
def font_post(f):
    return tt.font_post(f).select("font_id", "version", "italic_angle", "UnderlinePosition", "UnderlineThickness", "IsFixedPitch")


@query(f"SELECT k AS font_id, code AS code_point, glyph AS glyph_number, CASE glyph WHEN 1 THEN 'A' WHEN 2 THEN 'glyph' || k ELSE 'arc' END AS glyph_name {N}, LATERAL (VALUES (65, 1), (66, 2), (67, 3), ((299 + k)::INT, 3), ((300 + k)::INT, 1)) c(code, glyph)", nation_fonts)
def font_glyph_names(f):
    return tt.font_glyph_names(f)


@query(f"SELECT k AS font_id, 1 AS \"platformID\", 0 AS \"languageID\", 1 AS \"nameID\", n_name AS text {N} UNION ALL SELECT k, 3, 1033, 2, 'Style ' || k {N}", nation_fonts)
def font_names(f):
    return tt.font_names(f).select("font_id", "platformID", "languageID", "nameID", "text")


@query(f"SELECT k AS font_id, glyph, n AS n_contours, r::INT AS xmax, t::INT AS ymax {N}, LATERAL (VALUES (1, 1, 100 + k, 200), (2, -1, 100 + 11 * k, 220), (3, 1, 100, 100 + k)) c(glyph, n, r, t)", nation_fonts)
def font_glyphs(f):
    return tt.font_glyphs(f).select("font_id", "glyph", "n_contours", "xmax", "ymax")


@query(f"""SELECT k AS font_id, glyph, contour, seq, x::DOUBLE AS x, y::DOUBLE AS y {N}, LATERAL (VALUES (1, 0, 0, 0, 0), (1, 0, 1, 100 + k, 0), (1, 0, 2, 100 + k, 200), (2, 0, 0, 0, 0), (2, 0, 1, 100 + k, 0), (2, 0, 2, 100 + k, 200),
(2, 1, 0, 10 * k, 20), (2, 1, 1, 10 * k + (100 + k) / 2, 20), (2, 1, 2, 10 * k + (100 + k) / 2, 120), (3, 0, 0, 0, 0), (3, 0, 1, 50, 100 + k), (3, 0, 2, 100, 0)) c(glyph, contour, seq, x, y)""", nation_fonts)
def glyph_points(f):
    return tt.glyph_points(f).drop("on_curve")


@query(f"""WITH f AS (SELECT * {N}), c AS (SELECT k AS font_id, 3 AS glyph, 0 AS contour, i AS seq, 100 * i / 10.0::DOUBLE AS x, 2 * (i / 10.0::DOUBLE) * (1 - i / 10.0::DOUBLE) * (100 + k) AS y FROM f, range(11) r(i) UNION ALL SELECT k, 3, 0, 11, 0, 0 FROM f
UNION ALL SELECT k, glyph, contour, seq, x::DOUBLE, y::DOUBLE FROM f, LATERAL (VALUES (1, 0, 0, 0, 0), (1, 0, 1, 100 + k, 0), (1, 0, 2, 100 + k, 200), (1, 0, 3, 0, 0), (2, 0, 0, 0, 0), (2, 0, 1, 100 + k, 0), (2, 0, 2, 100 + k, 200), (2, 0, 3, 0, 0),
(2, 1, 0, 10 * k, 20), (2, 1, 1, 10 * k + (100 + k) / 2, 20), (2, 1, 2, 10 * k + (100 + k) / 2, 120), (2, 1, 3, 10 * k, 20)) c(glyph, contour, seq, x, y))
SELECT font_id, glyph, contour, seq::INT AS seq, round(x, 6) AS x, round(y, 6) AS y FROM c""", nation_fonts)
def glyph_outlines(f):
    return tt.glyph_outlines(f).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


assert ORACLE_SQL  # the decorator fills the tables of the sister module
