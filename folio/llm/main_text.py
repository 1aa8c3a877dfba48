"""Main text of web pages by wrapper induction: the trees of a host's pages are aligned, constant nodes become template,
and the slots that vary most hold the content.

Each page becomes a tree of its block elements in which siblings of the same tag and names
are one repeated node (records of a list, paragraphs of a text). Pages are compared within
their host, and within their layout: the containers in the upper levels of a page, and its
language. Of each such group one page is the reference, and the tree of every other one is
aligned with it by simple tree matching: roots match, and of two matched nodes' children
those pairs of equal tag and names that keep their order and have most matched nodes below
them. What has no partner belongs to the slot of its nearest ancestor that has.

A text that stands in the same slot on most pages of a group, counted over all of its
different pages, is constant: template. The words of the varying texts, links excepted,
show where the content is: from the root the way goes down as long as one container holds
four fifths of what its parent holds, and ends at an article, or at a container with
headings of its own. That region is the content of each page of the group.

Roles break ties. Scripts, styles, forms, menus, headers and footers of pages, asides and
what is hidden are never read; blocks in containers named as adverts, notices or comments
are no content; and where a page has an article or main inside the region, only that
counts, whole: constant texts in it stay, since the page's reader has them as part of the
article. Without a region (groups of fewer than three different pages, or words spread
over the page) article or main decide, and without those all that is no template counts.
A container with an article in it is not taken out for its name, or for being a form.

Blocks are separated by one line break; a line break inside a block is white space. Null
html counts as empty, and gives an empty text. A null url or one without a host is of the
host ''. Null page_ids pass through, repeated rows give repeated results and count once in
their host. Pages of any length, depth and width are read whole. An empty table gives no
rows. Other columns are ignored, also those of the same names as results.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, table
from .line_dedup import host

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title|object)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+|<)", re.S | re.I)
#: One attribute after another, so that nothing is looked for inside of values.
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
OUT = frozenset("nav footer aside button select option head menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Parts of names that say what a container is, beginnings of such parts, and parts that say that something else has one.
NAMES = frozenset("ad ads banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead topbar cookie cookies consent gdpr notice newsletter subscribe signup popup modal overlay comment comments commentlist disqus respond replies related recommended share sharing social widget skip pagination pager login paywall".split())
BEGINNINGS = ("advert", "sponsor", "promo")
MODIFIERS = frozenset("has with without no is not layout".split())
#: What takes out even an article or main.
LESSER = frozenset("comment comments teaser teasers related recommended".split())
#: An open tag of the first kind ends open elements of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a layout is told by, down to this depth below body; regions of content are such containers, or cells.
CONTAINERS, DEPTH = frozenset("article aside center div footer form header main nav section table".split()), 2
REGIONS = CONTAINERS | frozenset("html body tbody tr td ul ol li blockquote fieldset".split())
DIGITS = re.compile(r"\d+")
LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", re.I)
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section main div body nav aside footer header form".split())
#: Different pages that a wrapper needs, the share of them that makes a text constant, and what a region holds of its parent and of all.
LEAST, MOST, HOLDS, HALF = 3, 0.6, 0.8, 0.5


class Node:
    __slots__ = ("children", "kind", "mark", "out", "soft", "tag", "text", "within")

    def __init__(self, tag: str, mark: str = "", kind: str = "", within: bool = False) -> None:
        self.tag, self.mark, self.kind, self.within, self.text, self.children = tag, mark, kind, within, "", []
        self.out = self.soft = False  # never read; taken out unless it holds an article or main


def _named(names: str, words: frozenset[str], beginnings: tuple[str, ...] = ()) -> bool:
    for name in names.lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] not in MODIFIERS and any(p in words or beginnings and p.startswith(beginnings) for p in parts):
            return True
    return False


def parse(html: str) -> Node:
    """The tree of a page. Text stands in nodes of tag '', ends of blocks are nodes of tag '/'."""
    root = Node("html")
    stack = [root]

    def end(tags: set[str] | frozenset[str], scope: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    for m in TOKEN.finditer(html):
        if m[5] is not None:
            node = Node("")
            node.text = entities.unescape(m[5])
            stack[-1].children.append(node)
        elif m[3]:
            tag = m[3].lower()
            if m[2]:
                end({tag}, frozenset("article main nav aside footer".split()) - {tag} if tag not in ("html", "body", "article", "main") else frozenset())
                if tag in BLOCK:
                    stack[-1].children.append(Node("/"))
                continue
            if tag == "br":
                node = Node("")
                node.text = " "
                stack[-1].children.append(node)
                continue
            if tag in BLOCK:
                end({"p"}, SCOPES - {"p"})
            if tag in CLOSES:
                end(CLOSES[tag], SCOPES)
            about = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[4])} if m[4] else {}
            names, role = f"{about.get('class', '')} {about.get('id', '')}".strip(), about.get("role", "").lower()
            kind = "main" if tag == "main" or role == "main" else "article" if tag == "article" or role == "article" or "articlebody" in about.get("itemprop", "").lower().split() else ""
            node = Node(tag, names, kind, stack[-1].within or bool(stack[-1].kind))
            hidden = "hidden" in about or about.get("aria-hidden") == "true" or "display:none" in about.get("style", "").replace(" ", "").lower()
            node.out = tag in OUT or role in ROLES or hidden or tag == "header" and not node.within
            node.soft = tag in ("form", "dialog") or role == "form" or bool(names and tag not in ("html", "body") and (_named(names, LESSER) if kind else _named(names, NAMES | LESSER, BEGINNINGS)))
            stack[-1].children.append(node)
            if tag not in VOID and not m[4].rstrip().endswith("/"):
                stack.append(node)
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """What would be taken out for its name stays if an article or main stands in it."""
    order, todo = [], [(root, None)]
    while todo:
        node, above = todo.pop()
        order.append((node, above))
        if not node.out:
            todo.extend((c, node) for c in node.children if c.tag not in ("", "/"))
    holds = set()
    for node, above in reversed(order):
        if id(node) in holds and not node.kind:
            node.soft = False
        if (id(node) in holds or node.kind) and not node.out and not (node.kind and node.soft):
            holds.add(id(above))


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


#: A block: its text, its node, its words that are no links, and whether it is in an article or main (1) and taken out by a name (2).
INSIDE, NO = 1, 2


def blocks(root: Node) -> tuple[list[tuple[str, int, int, int]], list[list]]:
    """The blocks in page order, and the nodes that they stand in as [tag, names, kind, parent]: siblings of the same tag and
    names are one node. Numbers in names do not count (post-17)."""
    nodes: list[list] = [["html", "", "", -1]]
    known: dict[tuple, int] = {}
    out: list[tuple[str, int, int, int]] = []
    now: list[str] = []
    linked = 0
    at = (0, 0, False)  # node, mark, in a link
    todo: list[tuple[Node | None, tuple[int, int, bool]]] = [(root, at)]

    def flush() -> None:
        nonlocal linked
        if text := " ".join("".join(now).split()):
            out.append((text, at[0], max(0, text.count(" ") + 1 - linked), at[1]))
        now.clear()
        linked = 0

    while todo:
        node, here = todo.pop()
        if node is None:  # a block ends
            flush()
            at = here
        elif node.tag == "":
            if here[:2] != at[:2]:
                flush()
            at = here
            now.append(node.text)
            linked += len(node.text.split()) if here[2] else 0
        elif node.tag == "/":
            flush()
        elif not node.out:
            place, mark = here[0], here[1] | (INSIDE if node.kind else 0) | (NO if node.soft else 0)
            if node.tag in BLOCK:
                names = DIGITS.sub("0", node.mark)
                key = (place, node.tag, names, node.kind)
                if key not in known:
                    known[key] = len(nodes)
                    nodes.append([node.tag, names, node.kind, place])
                place = known[key]
                flush()
                todo.append((None, here))
                at = (place, mark, here[2])
            inner = (place, mark, here[2] or node.tag == "a")
            todo.extend((c, inner) for c in reversed(node.children))
        elif node.tag in BLOCK:
            flush()
    flush()
    return out, nodes


def matched(own: list[list], other: list[list]) -> list[int]:
    """For each node of a tree the node of the other that simple tree matching gives it or its nearest ancestor. As siblings
    differ in tag or names, a child has one possible partner, and the best ordered choice is a heaviest increasing sequence."""

    def children(tree: list[list]) -> list[dict[tuple, int]]:
        below: list[dict[tuple, int]] = [{} for _ in tree]
        for i, (tag, names, kind, above) in enumerate(tree):
            if above >= 0:
                below[above][tag, names, kind] = i
        return below

    mine, theirs = children(own), children(other)
    pairs, at = [(0, 0)], 0
    while at < len(pairs):
        a, b = pairs[at]
        pairs += [(i, theirs[b][key]) for key, i in mine[a].items() if key in theirs[b]]
        at += 1
    weight: dict[int, int] = {}
    chosen: dict[int, list[tuple[int, int]]] = {}
    for a, b in reversed(pairs):
        met = [(i, theirs[b][key]) for key, i in mine[a].items() if key in theirs[b]]
        order = {j: r for r, j in enumerate(sorted(j for _, j in met), 1)}
        best, back = [(0, -1)] * (len(met) + 1), []  # prefix maxima in a binary indexed tree
        for n, (i, j) in enumerate(met):
            r, top = order[j] - 1, (0, -1)
            while r:
                top, r = max(top, best[r]), r & (r - 1)
            back.append(top[1])
            r, mark = order[j], (top[0] + weight[i], n)
            while r <= len(met):
                best[r], r = max(best[r], mark), r + (r & -r)
        r, top = len(met), (0, -1)
        while r:
            top, r = max(top, best[r]), r & (r - 1)
        weight[a], n, chosen[a] = 1 + top[0], top[1], []
        while n >= 0:
            chosen[a].append(met[n])
            n = back[n]
    slot, todo = {0: 0}, [0]
    while todo:
        for i, j in chosen[todo.pop()]:
            slot[i] = j
            todo.append(i)
    out = []
    for i, (*_, above) in enumerate(own):
        out.append(slot[i] if i in slot else out[above])
    return out


def region(tree: list[list], mass: dict[int, int]) -> list[int] | None:
    """The nodes below and with the one that holds the content, by the varying words of each node; None if there is none."""
    total, below = [mass.get(i, 0) for i in range(len(tree))], defaultdict(list)
    for i in range(len(tree) - 1, 0, -1):
        total[tree[i][3]] += total[i]
        below[tree[i][3]].append(i)
    at = 0
    while tree[at][2] != "article" and not any(tree[c][0] in ("h1", "h2") for c in below[at]):
        best = max((c for c in below[at] if tree[c][0] in REGIONS), key=lambda c: total[c], default=None)
        if best is None or total[best] < HOLDS * total[at]:
            break
        at = best
    if not total[0] or total[at] < HALF * total[0]:
        return None
    inner = {at}
    for i in range(at + 1, len(tree)):
        if tree[i][3] in inner:
            inner.add(i)
    return sorted(inner)


def layout(root: Node, html: str) -> int:
    """What tells a page's layout: containers of the upper levels and the language."""
    found: set[tuple[str, ...]] = set()
    todo: list[tuple[Node, tuple[str, ...]]] = [(root, ())]
    while todo:
        node, path = todo.pop()
        for c in node.children:
            if c.tag in ("html", "body"):
                todo.append((c, path))
            elif c.tag in CONTAINERS:
                inner = (*path, f"{c.tag} {DIGITS.sub('0', c.mark)}")
                found.add(inner)
                if len(inner) < DEPTH:
                    todo.append((c, inner))
    lang = m[1].lower() if (m := LANG.search(html, 0, 4096)) else ""
    return _hash(lang, *sorted("/".join(f) for f in found))


def main_text(html: str) -> str:
    """The text that roles alone give."""
    found = [b for b in blocks(parse(html))[0] if not b[3] & NO]
    return "\n".join(t for t, *_ in [b for b in found if b[3] & INSIDE] or found)


READ = "page_id long, url string, host string, same long, layout long, tree string, texts array<string>, nodes array<int>, keys array<long>, words array<int>, marks array<int>"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
READ_TYPES = pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in READ.split(", "))])


def read_pages(pages: DataFrame) -> DataFrame:
    """One parse of each page: its blocks, its tree and its layout; ``same``, equal for equal html and null without html."""

    def read(html: str | None) -> tuple:
        root = parse(html or "")
        found, nodes = blocks(root)
        texts, at, words, marks = map(list, zip(*found, strict=True)) if found else ([], [], [], [])
        return None if html is None else _hash(html), layout(root, html or ""), json.dumps(nodes, ensure_ascii=False), texts, at, list(map(_hash, texts)), words, marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                columns = zip(*(read(h) for h in part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *(pa.array(v, f.type) for v, f in zip(columns, list(READ_TYPES)[3:], strict=True))], schema=READ_TYPES)
        give_back()

    return pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host")).mapInArrow(run, READ)


def aligned(trees: DataFrame) -> DataFrame:
    """host, level, tree, slots: for each node of a tree its node in the reference's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = functools.lru_cache(64)(json.loads)
        for batch in batches:
            slots = [matched(json.loads(own), held(other)) for own, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), pa.array(slots, pa.list_(pa.int32()))], ["host", "level", "tree_id", "slots"])

    return trees.select("host", "level", "tree", "reference", "tree_id").mapInArrow(run, "host string, level long, tree_id long, slots array<int>")


def regions(groups: DataFrame) -> DataFrame:
    """host, level, region: the slots that hold the content, null if there is no region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [region(json.loads(tree), {s["slot"]: s["mass"] for s in slots}) for tree, slots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], ["host", "level", "region"])

    return groups.select("host", "level", "reference", "slots").mapInArrow(run, "host string, level long, region array<int>")


def induced(read: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The alignment of each tree (host, level, tree_id, slots), and the wrappers (host, level, region, template: hashes of slot
    and text). Level 0 is a whole host, any other a layout of it."""
    levels = F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("layout")))).alias("level")
    pages = read.where("same IS NOT NULL").select("host", "same", "layout", "tree_id", "tree", "nodes", "keys", "words", "marks").dropDuplicates(["host", "same"])
    pages = scratch.keep(pages, "pages")
    groups = pages.select("host", levels, "same", "tree").groupBy("host", "level").agg(F.count("*").alias("pages"), F.min_by("tree", "same").alias("reference")).where(F.col("pages") >= LEAST)
    groups = scratch.keep(groups, "groups")
    trees = pages.select("host", levels, "tree_id", "tree").dropDuplicates(["host", "level", "tree_id"])
    slots = scratch.keep(aligned(trees.join(groups.select("host", "level", "reference"), ["host", "level"])), "slots")

    each = pages.select("host", levels, "tree_id", "nodes", "keys", "words", "marks").join(slots, ["host", "level", "tree_id"])
    block = F.expr("transform(sequence(0, size(nodes) - 1), i -> struct(slots[nodes[i]] AS slot, keys[i] AS key, words[i] AS words, marks[i] AS mark))")
    each = each.where("size(nodes) > 0").select("host", "level", F.explode(F.array_distinct(block)).alias("b")).select("host", "level", "b.*")
    told = each.groupBy("host", "level", "slot", "key").agg(F.count("*").alias("n"), F.sum(F.when(F.col("mark").bitwiseAND(NO) == 0, F.col("words")).otherwise(0)).alias("words"))
    told = told.join(groups.select("host", "level", "pages"), ["host", "level"]).withColumn("constant", (F.col("n") >= LEAST) & (F.col("n") >= MOST * F.col("pages")))
    told = scratch.keep(told, "told")
    mass = told.where("NOT constant").groupBy("host", "level", "slot").agg(F.sum("words").alias("mass")).groupBy("host", "level").agg(F.collect_list(F.struct("slot", "mass")).alias("slots"))
    found = regions(groups.join(mass, ["host", "level"]))
    template = told.where("constant").groupBy("host", "level").agg(F.collect_set(_place("slot", "key")).alias("template"))
    return slots, scratch.keep(groups.select("host", "level").join(found, ["host", "level"], "left").join(template, ["host", "level"], "left"), "wrappers")


def _place(slot: str, key: str) -> Column:
    return F.expr(f"xxhash64({slot}, {key})")


#: The indices of a page's blocks that are its main text.
CHOSEN = f"""
transform(array(filter(sequence(0, size(texts)), i -> i < size(texts) AND marks[i] & {NO} = 0)), open ->
transform(array(struct(filter(open, i -> marks[i] & {INSIDE} = {INSIDE}) AS inside,
                filter(open, i -> NOT coalesce(array_contains(template0, xxhash64(slots0[nodes[i]], keys[i])), false) AND NOT coalesce(array_contains(template1, xxhash64(slots1[nodes[i]], keys[i])), false)) AS varying)), s ->
transform(array(struct(filter(s.inside, i -> array_contains(region, region_slots[nodes[i]])) AS inside, filter(s.varying, i -> array_contains(region, region_slots[nodes[i]])) AS varying)), r ->
  CASE WHEN region IS NOT NULL AND size(r.inside) > 0 THEN r.inside
       WHEN size(s.inside) > 0 THEN s.inside
       WHEN region IS NOT NULL AND size(r.varying) > 0 THEN r.varying
       ELSE s.varying END)[0])[0])[0]
"""


def extracted(pages: DataFrame, how: bool = False) -> DataFrame:
    """page_id, url, text, n_chars for each page; with ``how`` also whether a region was found for it and its text is of it."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    read = scratch.keep(read_pages(pages).withColumn("tree_id", F.xxhash64("tree")), "blocks")
    slots, wrappers = induced(read, scratch)
    # Joined by the size of the written tables; beyond broadcasts a hot host's pages are split by Spark.
    for n, level in enumerate((F.lit(0).cast("long"), F.col("layout"))):
        mine = slots.select(F.col("host").alias("h"), F.col("level").alias("l"), F.col("tree_id").alias("t"), F.col("slots").alias(f"slots{n}"))
        read = read.join(mine, (F.col("host") == F.col("h")) & (level == F.col("l")) & (F.col("tree_id") == F.col("t")), "left").drop("h", "l", "t")
        mine = wrappers.select(F.col("host").alias("h"), F.col("level").alias("l"), F.col("region").alias(f"region{n}"), F.col("template").alias(f"template{n}"))
        read = read.join(mine, (F.col("host") == F.col("h")) & (level == F.col("l")), "left").drop("h", "l")
    read = read.withColumn("region_slots", F.expr("if(region1 IS NOT NULL, slots1, slots0)")).withColumn("region", F.coalesce("region1", "region0"))
    read = read.withColumn("chosen", F.expr(CHOSEN))
    text = F.expr("array_join(transform(chosen, i -> texts[i]), '\n')")
    out = read.select("page_id", "url", text.alias("text"), F.expr("region IS NOT NULL AND size(chosen) > 0 AND forall(chosen, i -> array_contains(region, region_slots[nodes[i]]))").alias("by_region"), F.expr(f"exists(marks, m -> m & {INSIDE} > 0)").alias("has_role"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *(["by_region", "has_role"] if how else []))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


#: The given pages have one article each, whose text this reads with patterns; it knows only the references that occur there.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '(?i)</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|pre|table|tr|td|figure|figcaption)\b[^>]*>', chr(10), 'g'), '(?i)<br\b[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, string_split(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&apos;', chr(39)), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(10)) AS lines FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '[\s\x{A0}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
"""
