"""The queries of the layout and function operators, with the SQL that DuckDB checks them against."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import steps
from ..operators.pages import Pages, begins
from ..pdf.relations import roundtrip
from ..sources import glyphs_of, letters, words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORDS = """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
w0 AS (SELECT doc_id, line, unnest(string_split(t, ' ')) AS text, generate_subscripts(string_split(t, ' '), 1) AS w FROM l),
w1 AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 90 AS vrow FROM w0 WHERE text <> ''),
w2 AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY line, vrow) - 1 AS row FROM w1),
w3 AS (SELECT *, row_number() OVER here - 1 AS k, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, row ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS letters FROM w2 WINDOW here AS (PARTITION BY doc_id, row ORDER BY w)),
words AS (SELECT doc_id, (row // 60 + 1)::BIGINT AS page, row, k, text, (36 + 5 * letters + 3 * k)::BIGINT AS "left", (36 + 5 * letters + 3 * k + 5 * length(text))::BIGINT AS "right", (770 - 12 * (row % 60))::BIGINT AS bottom, (780 - 12 * (row % 60))::BIGINT AS top, 10::BIGINT AS size FROM w3),
flagged AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, "left") >= 4 OR count(*) OVER (PARTITION BY doc_id, page, "left" + "right") >= 4 AS left_edge, count(*) OVER (PARTITION BY doc_id, page, "right") >= 4 OR count(*) OVER (PARTITION BY doc_id, page, "left" + "right") >= 4 AS right_edge FROM words),
joined AS (SELECT *, CASE WHEN "left" - lag("right") OVER b > 0 AND "left" - lag("right") OVER b <= 5 AND NOT left_edge AND NOT lag(right_edge) OVER b THEN 0 ELSE 1 END AS new FROM flagged WINDOW b AS (PARTITION BY doc_id, page, bottom ORDER BY "left", row, k)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, bottom ORDER BY "left", row, k ROWS UNBOUNDED PRECEDING) AS island FROM joined),
lines AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY "left") AS text, min("left") AS "left", max("right") AS "right", bottom, bottom + 10 AS top, max(size) AS size FROM islands GROUP BY doc_id, page, bottom, island),
covered AS (SELECT doc_id, page, top, bottom, unnest(range(greatest(floor("left" / 3.06::DOUBLE), 0)::BIGINT, least(ceil("right" / 3.06::DOUBLE), 200)::BIGINT)) AS strip FROM words WHERE "right" > 0 AND "left" < 612),
gap0 AS (SELECT doc_id, page, strip, coalesce(lag(low) OVER o, 792) AS top, top AS bottom FROM (SELECT *, min(bottom) OVER (PARTITION BY doc_id, page, strip ORDER BY bottom DESC, top DESC ROWS UNBOUNDED PRECEDING) AS low FROM covered) WINDOW o AS (PARTITION BY doc_id, page, strip ORDER BY bottom DESC, top DESC)),
gaps AS (SELECT * FROM gap0 WHERE top > bottom UNION ALL SELECT doc_id, page, strip, min(bottom), 0 FROM covered GROUP BY ALL HAVING min(bottom) > 0)
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(docs(spark, sf_dir))


def laid_out(**layout: int) -> Callable[[SparkSession, str], Callable[..., DataFrame]]:
    """Pages of the texts for steps: the relation that the steps given make of them."""
    return lambda spark, sf_dir: partial(words_of, docs(spark, sf_dir), **layout)


def only(*names: str) -> steps.Step:
    return lambda p: p.only(*names)


LINES, GAPS, WHITE, BOXED = (steps.edge_flags, steps.lines_from_words), steps.strip_gaps(612, 792), steps.white_boxes(612, 792), steps.text_boxes(612, 792)
TURNS = (WHITE, steps.vertices, steps.corners, steps.next_corners)
pages = laid_out()


def query(sql: str | None = None, over: Callable = words) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(over(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def tables(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


ELEMENT = 'doc_id, page, text, "left", "right", bottom, top, size'


@query(f"{WORDS} SELECT {ELEMENT} FROM lines ORDER BY doc_id, page, bottom DESC, \"left\"", pages)
def text_elements(w):
    return w(*LINES, steps.in_reading_order)  # in order of doc_id and page, as the words come


@query(f"{WORDS} SELECT {ELEMENT} FROM words")
def word_elements(w):
    return w.select("doc_id", "page", "text", "left", "right", "bottom", "top", "size")


LETTERS = 'SELECT doc_id, page, row, k, i, text[(i + 1)::INT] AS text, "left" + 5 * i AS "left", "left" + 5 * i + 5 AS "right", bottom, top, size FROM words, range(1000) r(i) WHERE i < length(text)'


@query(f"{WORDS} {LETTERS}")
def atomic_letters(w):
    return glyphs_of(w)


@query(f"{WORDS} {LETTERS}", pages)
def dedupe_letters(w):
    def twice(p):
        e = pc.equal(p["text"], "e").to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(p)), 1 + e)
        return p.take(at, i=p["i"][at] + 1000 * ~begins(at))

    return w(letters, twice, steps.dedupe_letters)


for side, x in (("left", '"left"::DOUBLE'), ("right", '"right"::DOUBLE'), ("mid", '("left" + "right") / 2.0::DOUBLE')):
    QUERIES[f"edge_table_{side}"] = lambda spark, sf_dir, side=side: pages(spark, sf_dir)(steps.edge_table(side))
    ORACLE_SQL[f"edge_table_{side}"] = f"{WORDS} SELECT doc_id, page, floor(10 * {x})::BIGINT AS edge, count(*) AS n FROM words GROUP BY ALL HAVING count(*) >= 4"


@query(f"{WORDS} SELECT doc_id, page, row, k, left_edge, right_edge FROM flagged", pages)
def edge_flags(w):
    return w(steps.edge_flags, only("row", "k", "left_edge", "right_edge"))


@query(f"{WORDS} SELECT {ELEMENT} FROM words", pages)
def words_from_letters(w):
    return w(letters, steps.words_from_letters)


@query(f'{WORDS} SELECT doc_id, page, list_sort(list("right" - "left"))[count(*) // 2 + 1] AS median FROM words GROUP BY doc_id, page', pages)
def upper_median_size(w):
    return w(steps.upper_median_size)


@query(f'{WORDS} SELECT doc_id, page, 0 AS "left", 0 AS bottom, CASE WHEN max("right") > 612 THEN 622 ELSE 612 END AS "right", CASE WHEN max(top) > 792 THEN 802 ELSE 792 END AS top FROM words GROUP BY doc_id, page', pages)
def page_bounds(w):
    return w(steps.page_bounds(612, 792))


@query(f"{WORDS} SELECT doc_id, page, strip, top::BIGINT AS top, bottom::BIGINT AS bottom FROM gaps", pages)
def strip_gaps(w):
    return w(GAPS)


@query(f"{WORDS} SELECT doc_id, page, top::BIGINT AS top, bottom::BIGINT AS bottom, min(strip) AS first_strip, max(strip) AS last_strip FROM (SELECT *, strip - row_number() OVER (PARTITION BY doc_id, page, top, bottom ORDER BY strip) AS run FROM gaps) GROUP BY doc_id, page, top, bottom, run", pages)
def strip_islands(w):
    return w(GAPS, steps.strip_islands)


@query(f"{WORDS} SELECT doc_id, page, row, k, row_number() OVER (PARTITION BY doc_id, page ORDER BY bottom DESC, \"left\", row, k) AS place FROM words", pages)
def reading_order(w):
    return w(steps.reading_order, only("row", "k", "place"))


@query(f"{WORDS} SELECT doc_id, page, bottom, \"left\", coalesce(bottom < lag(bottom) OVER o AND \"left\" - lag(\"left\") OVER o > 0.1, false) AS breaks FROM lines WINDOW o AS (PARTITION BY doc_id, page ORDER BY bottom DESC, \"left\")", pages)
def indent_breaks(w):
    return w(*LINES, steps.indent_breaks, only("bottom", "left", "breaks"))


@query(f"{WORDS} SELECT doc_id, page, rtrim(string_agg(CASE WHEN right(text, 1) IN ('-','‐','‑','‒','–','—','―') THEN left(text, length(text) - 1) WHEN right(text, 1) IN (' ', chr(160)) THEN text ELSE text || ' ' END, '' ORDER BY bottom DESC, \"left\"), ' ') AS text FROM lines GROUP BY doc_id, page", pages)
def paste_lines(w):
    return w(*LINES, steps.paste_lines)


#: The same documents in two columns of up to 40 characters, without words of more than 12 letters.
WORDS2 = WORDS.replace("// 90", "// 40").replace("WHERE text <> ''", "WHERE text <> '' AND length(text) <= 12").replace("(row // 60 + 1)", "(row // 120 + 1)").replace("(36 + 5 * letters", "(36 + 270 * (row % 120 // 60) + 5 * letters")
BOXES = f"""{WORDS2},
strips AS (SELECT doc_id, page, strip, top::BIGINT AS top, bottom::BIGINT AS bottom FROM gaps UNION ALL SELECT doc_id, page, strip, 792, 0 FROM (SELECT DISTINCT doc_id, page FROM words), range(200) s(strip) WHERE (doc_id, page, strip) NOT IN (SELECT DISTINCT doc_id, page, strip FROM covered)),
runs AS (SELECT doc_id, page, top, bottom, min(strip) AS l, max(strip) + 1 AS r FROM (SELECT *, strip - row_number() OVER (PARTITION BY doc_id, page, top, bottom ORDER BY strip) AS run FROM strips) GROUP BY doc_id, page, top, bottom, run),
white AS MATERIALIZED (SELECT runs.* FROM runs JOIN (SELECT doc_id, page, list_sort(list(size))[count(*) // 2 + 1] AS median FROM words GROUP BY ALL) USING (doc_id, page) WHERE l = 0 OR r = 200 OR top = 792 OR bottom = 0 OR top - bottom >= 0.3::DOUBLE * median),
points AS (SELECT DISTINCT * FROM (SELECT doc_id, page, unnest([l, l, r, r]) AS x, unnest([top, bottom, top, bottom]) AS y FROM white)),
flagged2 AS MATERIALIZED (SELECT p.doc_id, p.page, x, y, bit_or(CASE WHEN x > l AND y < top THEN 8 ELSE 0 END + CASE WHEN x < r AND y < top THEN 4 ELSE 0 END + CASE WHEN x < r AND y > bottom THEN 2 ELSE 0 END + CASE WHEN x > l AND y > bottom THEN 1 ELSE 0 END) AS flags
  FROM points p JOIN white w ON p.doc_id = w.doc_id AND p.page = w.page AND x BETWEEN l AND r AND y BETWEEN bottom AND top GROUP BY ALL),
turns AS MATERIALIZED (SELECT *, row_number() OVER () AS id, substr(way, 1, 1) AS ins, substr(way, 2, 1) AS outs FROM (SELECT *, CASE f WHEN 1 THEN 'NW' WHEN 2 THEN 'WS' WHEN 4 THEN 'SE' WHEN 7 THEN 'SW' WHEN 8 THEN 'EN' WHEN 11 THEN 'WN' WHEN 13 THEN 'NE' WHEN 14 THEN 'ES' END AS way
  FROM (SELECT doc_id, page, x, y, unnest(CASE flags WHEN 5 THEN [4, 1] WHEN 10 THEN [8, 2] ELSE [flags] END) AS f FROM flagged2 WHERE flags % 3 <> 0))),
nexts AS (SELECT t.id, arg_min(o.id, abs(o.y - t.y)) AS nxt FROM turns t JOIN turns o ON t.doc_id = o.doc_id AND t.page = o.page AND t.x = o.x AND t.outs = o.ins AND ((t.outs = 'N' AND o.y > t.y) OR (t.outs = 'S' AND o.y < t.y)) GROUP BY t.id
  UNION ALL SELECT t.id, arg_min(o.id, abs(o.x - t.x)) FROM turns t JOIN turns o ON t.doc_id = o.doc_id AND t.page = o.page AND t.y = o.y AND t.outs = o.ins AND ((t.outs = 'E' AND o.x > t.x) OR (t.outs = 'W' AND o.x < t.x)) GROUP BY t.id)
"""
LABELS = ", p0 AS MATERIALIZED (SELECT id, nxt, id AS least FROM turns LEFT JOIN nexts USING (id))" + "".join(f", p{k + 1} AS MATERIALIZED (SELECT a.id, b.nxt, least(a.least, coalesce(b.least, a.least)) AS least FROM p{k} a LEFT JOIN p{k} b ON a.nxt = b.id)" for k in range(12))
ENCLOSED = f"""{BOXES}{LABELS},
poly AS MATERIALIZED (SELECT doc_id, page, min(x) AS l, max(x) AS r, max(y) AS top, min(y) AS bottom FROM turns JOIN p12 USING (id) GROUP BY doc_id, page, least),
inner_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY l, top DESC, r, bottom) AS n FROM poly WHERE NOT (l = 0 AND r = 200 AND top = 792 AND bottom = 0)),
boxed AS (SELECT doc_id, page, l * (612 / 200::DOUBLE) AS xmin, bottom::DOUBLE AS ymin, r * (612 / 200::DOUBLE) AS xmax, top::DOUBLE AS ymax, row_number() OVER (PARTITION BY doc_id, page ORDER BY l, top DESC, r, bottom) - 1 AS box
  FROM inner_ i WHERE NOT EXISTS (FROM inner_ o WHERE o.doc_id = i.doc_id AND o.page = i.page AND o.n < i.n AND o.l <= i.l AND o.r >= i.r AND o.top >= i.top AND o.bottom <= i.bottom))
"""
HELD = '"left" > xmin - 0.1::DOUBLE AND "right" < xmax + 0.1::DOUBLE AND top < ymax + 0.1::DOUBLE AND bottom > ymin - 0.1::DOUBLE AND NOT ("left" = xmin AND "right" = xmax AND top = ymax AND bottom = ymin)'


columns = laid_out(wrap=40, columns=2, longest=12)


@query(f'{BOXES} SELECT doc_id, page, l AS "left", r AS "right", top, bottom FROM white', columns)
def white_boxes(w):
    return w(WHITE)


@query(f"{BOXES} SELECT doc_id, page, x, y, flags FROM flagged2", columns)
def vertex_flags(w):
    return w(WHITE, steps.vertices)


@query(f"{BOXES} SELECT t.doc_id, t.page, t.x, t.y, t.f AS flags, t.ins, t.outs, o.x AS next_x, o.y AS next_y, o.f AS next_flags FROM turns t LEFT JOIN nexts USING (id) LEFT JOIN turns o ON o.id = nxt", columns)
def vertex_next(w):
    return w(*TURNS)


@query(f'{ENCLOSED} SELECT doc_id, page, l AS "left", r AS "right", top, bottom FROM poly', columns)
def polygon_boxes(w):
    return w(*TURNS, steps.polygons, steps.polygon_boxes, only("left", "right", "top", "bottom"))


@query(f"{ENCLOSED} SELECT * FROM boxed", columns)
def text_boxes(w):
    return w(BOXED)


@query(f"{ENCLOSED} SELECT doc_id, page, row, k, box FROM words JOIN boxed USING (doc_id, page) WHERE {HELD}", columns)
def assign_text(w):
    return w(lambda p: steps.assigned(p, BOXED(p)), only("row", "k", "box"))


@query(f"""{ENCLOSED},
held AS (SELECT * FROM lines JOIN boxed USING (doc_id, page) WHERE {HELD}),
parted AS (SELECT *, sum(coalesce(bottom < above AND "left" - side > 0.1::DOUBLE AND top < above, false)::INT) OVER (PARTITION BY doc_id, page, box ORDER BY bottom DESC, "left", text ROWS UNBOUNDED PRECEDING)::BIGINT AS part
  FROM (SELECT *, lag(bottom) OVER o AS above, lag("left") OVER o AS side FROM held WINDOW o AS (PARTITION BY doc_id, page, box ORDER BY bottom DESC, "left", text))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, box, part ORDER BY bottom DESC, "left", text) AS i, count(*) OVER (PARTITION BY doc_id, page, box, part) AS n, max(part) OVER (PARTITION BY doc_id, page, box) AS parts FROM parted)
SELECT doc_id, page, box, part, string_agg(CASE WHEN i = n THEN text WHEN right(text, 1) IN ('-','‐','‑','‒','–','—','―') THEN left(text, length(text) - 1) WHEN right(text, 1) IN (' ', chr(160)) THEN text ELSE text || ' ' END, '' ORDER BY i) AS text,
  any_value(xmin) AS "left", any_value(xmax) AS "right", CASE WHEN part = any_value(parts) THEN any_value(ymin) ELSE min(bottom) END::DOUBLE AS bottom, CASE WHEN part = 0 THEN any_value(ymax) ELSE max(top) END::DOUBLE AS top, min(size) FILTER (i = 1) AS size
FROM numbered GROUP BY doc_id, page, box, part""", columns)
def text_blocks(w):
    return w(lambda p: steps.assigned(steps.lines_from_words(steps.edge_flags(p)), BOXED(p)), steps.text_blocks)


@query(f'{WORDS} SELECT doc_id, page, text, "left"::DOUBLE AS "left", "right"::DOUBLE AS "right", bottom::DOUBLE AS bottom, top::DOUBLE AS top, size::DOUBLE AS size FROM lines', pages)
def greedy_lines(w):
    return w(steps.edge_flags, steps.greedy_lines)


@query(f"""{WORDS}, g AS (SELECT doc_id, page, ((row * 1000 + k) * 1000 + i)::BIGINT AS seq, "left" + 5 * i AS l, bottom, row FROM words, range(1000) r(i) WHERE i < length(text))
SELECT a.doc_id, a.page, a.seq, b.seq AS next_seq FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.page = b.page AND a.bottom = b.bottom AND b.l = a.l + 5""", pages)
def adjacent_letters(w):
    def numbered(p):
        return Pages(p.keys, p.of, p.columns | {"seq": (p["row"] * 1000 + p["k"]) * 1000 + p["i"]})

    return w(letters, numbered, steps.adjacent_letters)


CARVE = "CASE WHEN instr({r}, '{b}') > 0 THEN left({r}, instr({r}, '{b}') - 1) ELSE {r} END"
REST = "(CASE WHEN instr(html, '<h1>') > 0 THEN substr(html, instr(html, '<h1>') + 4) ELSE html END)"


@query(f"SELECT page_id, {CARVE.format(r=REST, b='</h1>')} AS piece FROM pages", tables("pages"))
def carve_out(p):
    return p.select("page_id", fn.carve_out(F.col("html"), "<h1>", "</h1>").alias("piece"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), '|') AS pieces FROM pages", tables("pages"))
def multi_carve(p):
    return p.select("page_id", F.array_join(fn.multi_carve(F.col("html"), "<p>", "</p>"), "|").alias("pieces"))


@query("SELECT doc_id, regexp_full_match(text, '(?s)[\\x08-\\x7e]+') AS ascii FROM documents", docs)
def is_ascii(d):
    return d.select("doc_id", fn.is_ascii(F.col("text")).alias("ascii"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '([-+]?\\d+)(?:\\.\\d*)?', 1), lambda x: TRY_CAST(x AS BIGINT)::VARCHAR), ',') AS ints FROM documents", docs)
def parse_ints(d):
    return d.select("doc_id", F.array_join(fn.parse_ints(F.col("text")), ",").alias("ints"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey || ',' || (p_partkey + 7) WHEN 1 THEN p_partkey || '' WHEN 2 THEN '' ELSE p_size || ',' || p_partkey || ',' || p_size END AS refs FROM part""", tables("part"))
def parse_refs(p):
    n, size = F.col("p_partkey"), F.col("p_size")
    whole, broken = F.format_string("[%d 0 R %d 5 R]", n, n + 7), F.format_string("<< /A 1 /B %d 0 R /C 3 0 RG 1.5 0 R 4 R >>", n)
    none, nested = F.format_string("[%d 0 S R 12 0]", n), F.format_string("<< /K [<< /P %d 1 R >> [%d 0 R]] /L %d 0 R>>", size, n, size)
    text = F.when(n % 4 == 0, whole).when(n % 4 == 1, broken).when(n % 4 == 2, none).otherwise(nested)
    return p.select("p_partkey", F.array_join(fn.parse_refs(text), ",").alias("refs"))


@query("SELECT doc_id, h || CASE WHEN length(h) % 2 = 1 THEN '0' ELSE '' END AS bytes FROM (SELECT doc_id, upper(regexp_replace(substr(text, 1, 200), '[^0-9A-Fa-f]', '', 'g')) AS h FROM documents)", docs)
def hex_to_bytes(d):
    return d.select("doc_id", F.hex(fn.hex_to_bytes(F.substring("text", 1, 200))).alias("bytes"))


@query("SELECT p_partkey, CASE WHEN p_partkey * 5 > 65535 THEN 'FFFF' ELSE lpad(printf('%X', p_partkey * 5), 4, '0') END AS h FROM part", tables("part"))
def int_to_hex(p):
    return p.select("p_partkey", fn.int_to_hex(F.col("p_partkey") * 5).alias("h"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'ABCDE+' ELSE '' END || CASE p_partkey % 4 WHEN 3 THEN 'AbCDEF+' ELSE '' END || p_brand AS font FROM part", tables("part"))
def font_name(p):
    n = F.col("p_partkey") % 4
    prefix = F.when(n == 0, "/ABCDEF+").when(n == 1, "/").when(n == 2, "/ABCDE+").otherwise("/AbCDEF+")
    return p.select("p_partkey", fn.font_name(F.concat(prefix, "p_brand")).alias("font"))


@query("SELECT doc_id, CASE WHEN right(text, 1) IN ('-','‐','‑','‒','–','—','―') THEN left(text, length(text) - 1) WHEN right(text, 1) IN (' ', chr(160)) THEN text ELSE text || ' ' END AS line FROM documents", docs)
def line_endings(d):
    return d.select("doc_id", fn.line_ending(F.col("text")).alias("line"))


@query("SELECT l_orderkey, l_linenumber, '#' || lower(lpad(printf('%X', floor(255 * l_discount)::BIGINT), 2, '0')) || lower(lpad(printf('%X', floor(255 * l_tax)::BIGINT), 2, '0')) || 'ff' AS colour FROM lineitem", tables("lineitem"))
def rgb_hex(x):
    return x.select("l_orderkey", "l_linenumber", fn.rgb_hex(F.col("l_discount"), F.col("l_tax"), F.lit(1.0)).alias("colour"))


@query("SELECT l_orderkey, l_linenumber, (1 - l_discount) * (1 - l_tax) AS r, (1 - l_quantity / 64.0::DOUBLE) * (1 - l_tax) AS g, 1 - l_tax AS b FROM lineitem", tables("lineitem"))
def cmyk_rgb(x):
    c = fn.cmyk_rgb(F.col("l_discount"), F.col("l_quantity") / 64, F.lit(0.0), F.col("l_tax"))
    return x.select("l_orderkey", "l_linenumber", *[c[i].alias(v) for i, v in enumerate("rgb")])


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 + l_partkey * 3 + 5 AS x, l_quantity * 7 + l_partkey * 11 + 13 AS y FROM lineitem", tables("lineitem"))
def matrix_apply(x):
    m = F.array(*map(F.lit, (2.0, 7.0, 3.0, 11.0, 5.0, 13.0)))
    return x.select("l_orderkey", "l_linenumber", fn.matrix_apply(m, F.col("l_quantity"), F.col("l_partkey")).alias("p")).select("l_orderkey", "l_linenumber", "p.x", "p.y")


@query("SELECT p_partkey, i, 3 * (1 - i / 100.0::DOUBLE) * (i / 100.0::DOUBLE) * (i / 100.0::DOUBLE) * p_size + (i / 100.0::DOUBLE) * (i / 100.0::DOUBLE) * (i / 100.0::DOUBLE) * p_retailprice AS x FROM part, range(1, 101) t(i)", tables("part"))
def bezier_points(p):
    return p.select("p_partkey", F.posexplode(fn.bezier(F.lit(0.0), F.lit(0.0), F.col("p_size"), F.col("p_retailprice"))).alias("i", "x")).select("p_partkey", (F.col("i") + 1).cast("long").alias("i"), "x")


QUERIES["roundtrip_text"] = lambda spark, sf_dir: roundtrip(words(spark, sf_dir), together=True)
ORACLE_SQL["roundtrip_text"] = f'{WORDS} SELECT doc_id, page, string_agg(text, \' \' ORDER BY "left") AS text, min("left")::DOUBLE AS "left", max("right")::DOUBLE AS "right", bottom::DOUBLE AS bottom, (bottom + 10)::DOUBLE AS top, 10::DOUBLE AS size FROM words GROUP BY doc_id, page, bottom'
