"""Operators against plain versions that try everything, on small tables with nulls, repeats, ties and long texts."""

import datetime
import itertools
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.llm import decontaminate, exact_dedup, main_text, mixing, parity_join, pii, tool_calls, toxicity
from folio.llm.common import Scratch
from tests.llm.test_llm import reference_components


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def best_run(same):
    here = best = 0
    for ok in same:
        here = max(0, here + (1 if ok else -2))
        best = max(best, here)
    return best


def all_overlaps(docs, items, full=12):
    out = Counter()
    for (doc_id, text), (item_id, item) in itertools.product(docs, set(items)):
        d, w = tokens(text), tokens(item)
        hit, best = set(), None
        for at in range(-len(w), len(d)):
            for j in range(len(w)):
                windows = [(at + j, j)] if 0 <= at + j else []
                if len(w) >= 10 and any(0 <= i <= len(d) - 10 and j <= len(w) - 10 and all(d[i + n] == w[j + n] for n, b in enumerate(m) if b == "1") for i, j in windows for m in decontaminate.MASKS):
                    hit.add(at)
            if 0 < len(w) < 10 and at >= 0 and d[at : at + len(w)] == w and (len(w) >= 5 or len(d) == len(w)):
                hit.add(at)
        for at in sorted(hit):
            same = [0 <= at + n < len(d) and d[at + n] == w[n] for n in range(len(w))]
            found = (best_run(same), sum(same), -at)
            best = max(best or found, found)
        if best and (len(w) < 10 or best[0] >= min(full, math.ceil(len(w) / 2))):
            out[doc_id, item_id, -best[2], best[0], best[1], len(w)] += 1
    return out


@pytest.mark.parametrize("broadcast_seeds", [2_000_000, 0])
def test_overlaps(spark, broadcast_seeds):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(r.choices(words, k=30))), (2, " ".join(r.choices(words, k=12))), (2, " ".join(r.choices(words, k=12))), (3, "a b c d e f g h i"), (4, "only this"), (5, "x " * 25), (6, None), (7, "..."), (None, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 n11")]
    items += items[:1]

    def near(text, k):
        w = text.split()
        for i in r.sample(range(len(w)), k):
            w[i] = "changed"
        return " ".join(w)

    docs = [(i, " ".join(r.choices(words, k=20)) + f", {near(items[i % 3][1], i // 3)}; " + " ".join(r.choices(words, k=9))) for i in range(12)]
    docs += [(20, "before A b c d E f g h i after"), (21, "only  This!"), (22, "only this not"), (23, "(x) " + "x " * 70), (None, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 n11"), (None, None), (24, ""), docs[0], (0, "another text of the same number")]
    got = decontaminate.overlaps(spark.createDataFrame([(*d, "?") for d in docs], "doc_id long, text string, tokens string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=broadcast_seeds)
    want = all_overlaps(docs, items)
    assert Counter(tuple(x) for x in got.collect()) == want and len(want) > 12


def test_overlaps_of_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "ha " * 20_000), (2, "ho " * 300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ha " * 500)], "item_id long, text string")
    for seeds in (2_000_000, 0):
        assert [(r.doc_id, r.doc_start, r.score) for r in decontaminate.overlaps(docs, items, broadcast_seeds=seeds).collect()] == [(1, 0, 500)]


def test_shuffled_seeds_carry_no_texts(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").select(F.lit(1).alias("key"), F.split("text", " ").alias("tokens"))
    wanted = spark.createDataFrame([(1, ["x"] * 20)], "item long, tokens array<string>")
    plan = decontaminate._alignments(docs, wanted, 0)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :].splitlines()
    assert "rightHint=(strategy=merge)" in join[0] and "tokens" not in "".join(x for x in join if re.search(r"Project \[key#\d+, i#", x))


def test_links_of_null_and_repeated_ids(spark):
    def text(k, n=60, without=()):
        return " ".join(f"d{k}w{i}" for i in range(n) if i not in without)

    rows = [(1, text("a")), (1, text("b")), (3, text("b", without={30})), (None, text("c")), (None, text("c", without={3})), (7, text("c", 61)), (None, text("d")), (None, text("d")), (None, None), (5, "")]
    got = parity_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, 56, 1), (1, 56, 1), (3, 55, 1), (None, 56, 7), (None, 55, 7), (7, 57, 7), (None, 56, None), (None, 56, None), (None, 0, None), (5, 0, 5)])


def test_dates_are_permuted_within_their_layouts():
    key, days = b"k" * 32, [datetime.date.fromordinal(o) for o in range(*pii.DAYS)]
    layouts = {"{d:02d}/{m:02d}/{y}", "{m:02d}/{d:02d}/{y}", "{d}.{m}.{y}", "{m}-{d}-{y}", "{y}-{m:02d}-{d:02d}"}
    values = {lay.format(d=x.day, m=x.month, y=x.year) for lay in layouts for x in days}
    new = {v: pii.date(v, key) for v in values}
    assert None not in new.values() and len(set(new.values())) == len(values)
    assert all(re.sub(r"\d", "0", v) == re.sub(r"\d", "0", p) and pii.date(p, key) for v, p in new.items())
    assert pii.date("29/02/2020", key)[-4:] == pii.date("2020-02-29", key)[:4]
    named = {f: {x: pii.named_date(x.strftime(f), key) for x in days[::97]} for f in ("%d %B %Y", "%b %d, %Y")}
    assert all(len(set(n.values())) == len(n) for n in named.values())
    for v in ("31/02/2020", "2020-13-40", "1/2-2020", "32 March 2020"):
        assert pii.pseudonyms(key)(v)[0] == v


def test_values_stay_linked_and_valid_in_all_documents(spark):
    key = b"q" * 32
    of, pairs = pii.pseudonyms(key), {}
    finds = [(kind, re.compile(p), f) for kind, p, f in pii.FORMATS]
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        new, counts = of(r.text)
        assert of(new)[1] == counts and (counts or new == r.text)
        for kind, pattern, f in finds:
            for m in pattern.finditer(r.text):
                if (p := f(m[0], key)) is not None:
                    assert pairs.setdefault((kind, m[0]), p) == p
    assert len(set(pairs.items())) == len({(k, p) for (k, _), p in pairs.items()}) > 20
    assert of("to 2001:db8::1, 555.123.4567 or 12:30:45 std::x")[1] == Counter(ipv6=1, phone=1)
    long = "x " * 100_000 + "4785380592391139"
    assert of(long)[0][:200_000] == long[:200_000] and of(long)[1] == Counter(card=1) and of("")[0] == ""


def test_tool_calls_of_odd_rows(spark, tmp_path):
    call = '{"tool_calls":[{"id":"a","name":"f","arguments":{"it\'s":1}}]}'
    rows = [(1, 1, "assistant", call), (1, 1, "assistant", call), (None, 1, "assistant", call), (None, 2, "tool", '{"tool_call_id":"a","content":1}'), (2, None, None, "x" * 300_000)]
    schemas = {"f": {"properties": {"it's": {"type": "string"}}}}
    got = tool_calls.linked_messages(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, kind string"), schemas).collect()
    calls = [r for r in got if r.kind == "call"]
    assert Counter((r.conv_id, r.linked, tuple(r.errors)) for r in calls) == Counter([(1, False, ("it's: not string",)), (1, False, ("id: repeated", "it's: not string")), (None, True, ("it's: not string",))])
    assert [(r.conv_id, r.linked) for r in got if r.kind == "result"] == [(None, True)] and len(got) == 5
    assert tool_calls.linked_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_queries_match_their_sql(spark):
    from folio.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()

    def rows(values):
        return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values)

    for name in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*[f"`{c}`" for c in want.columns])
        assert rows(got.collect()) == rows(want.fetchall()), name


def test_index_appends(spark):
    def rows(lo, hi):
        return spark.range(lo, hi, 1, 8).select(F.sha2((F.col("id") % 500).cast("string"), 256).alias("digest"), F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("sha"))

    index = exact_dedup.DigestIndex(Scratch(spark, "index"))
    index.append(rows(0, 400))
    index.append(rows(450, 800))
    assert index._probed(index.entries()).where("maybe").count() in range(600, 640)  # 300 digests that both batches have, and chance
    level = {(r.digest, r.keep_id, r.group_size) for r in index.compact().collect()}
    groups = defaultdict(list)
    for i in [*range(400), *range(450, 800)]:
        groups[i % 500].append(i)
    assert {(k, n) for _, k, n in level} == {(min(g), len(g)) for g in groups.values()}
    index.append(rows(800, 900))
    found = {r.keep_id: r.group_size for r in index.lookup(rows(300, 460)).collect()}
    want = {}
    for i in [*range(400), *range(450, 900)]:
        want.setdefault(i % 500, []).append(i)
    assert found == {min(g): len(g) for k, g in want.items() if k in range(300, 460)}


def test_exact_groups_of_null_ids(spark):
    rows = [(None, "a"), (3, "a"), (None, "b"), (None, "b"), (4, "c"), (4, "c"), (4, "d"), (5, None), (None, ""), (6, "long " * 50_000), (7, " long" * 50_000)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, keep_id int")
    want = Counter([(None, 3, 2, False), (3, 3, 2, True), (None, None, 2, True), (None, None, 2, True), (4, 4, 2, True), (4, 4, 2, True), (4, 4, 1, True), (5, 5, 2, True), (None, 5, 2, False), (6, 6, 1, True), (7, 7, 1, True)])
    for digest in (exact_dedup.sha256, lambda c: F.lit("same")):
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame, digest).collect()) == want


def test_telling_words_and_held_out_accuracy(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices([f"word{k}" for k in range(60)], k=30)) + (" vile" * (i % 4 == 0)) + (" Shoddy" * (i % 3 == 0))) for i in range(400)]
    labels = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(0, 400, 2)] + [(0, 1, 0), (None, 0, 1), (2, None, 1)]
    docs = spark.createDataFrame([(*x, 0.5) for x in [*rows, (None, None), (900, "vile " * 30_000)]], "doc_id long, text string, p_toxic double")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = toxicity.labelled(docs, frame, toxicity.CATEGORIES, 10_000)
    words = [toxicity.features(t)[0] for i, t in rows if i % 2 == 0]
    y = {"low_quality": [int(i % 3 == 0) for i in range(0, 400, 2)], "toxic": [int(i % 4 == 0) for i in range(0, 400, 2)]}
    for c in y:
        for k in (-1, 0, 3):
            at = [n for n in range(len(words)) if sample.fold[n] != k]
            share, gain = sum(y[c][n] for n in at) / len(at), {}
            for w in set().union(*(words[n] for n in at)):
                has = [n for n in at if w in words[n]]
                if len(has) >= 4:
                    gain[w] = (sum(y[c][n] for n in has) - len(has) * share) ** 2 / (len(has) * share * (1 - share))
            assert sorted(sample.told.get((c, k), [])) == sorted(w for w, g in gain.items() if g > 6)
    chain, threshold, held = toxicity.fit_chain(sample, ["low_quality", "toxic"])
    assert ((held["toxic"] >= threshold) == sample.y["toxic"]).mean() > 0.98
    got = {x.doc_id: x.p_toxic for x in toxicity.scored(docs, chain).collect()}
    assert all((got[i] >= threshold) == (i % 4 == 0) for i in range(1, 400, 2)) and got[900] >= threshold and got[None] < threshold


def slow_matching(own, other):
    """Simple tree matching by its textbook recursion: the number of matched nodes."""

    def kids(tree, i):
        return [k for k, n in enumerate(tree) if n[3] == i]

    def size(a, b):
        if own[a][:3] != other[b][:3]:
            return 0
        x, y = kids(own, a), kids(other, b)
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(x[i], y[j]))
        return 1 + m[-1][-1]

    return size(0, 0)


def test_tree_matching():
    r = random.Random(9)

    def tree():
        nodes, todo = [["html", "", "", -1]], [0]
        while todo:
            at = todo.pop()
            for tag in r.sample("abcde", r.randint(0, 4) if len(nodes) < 14 else 0):
                nodes.append([tag, "", "", at])
                todo.append(len(nodes) - 1)
        return nodes

    for _ in range(60):
        own, other = tree(), tree()
        slots = main_text.matched(own, other)
        pairs = [(i, s) for i, s in enumerate(slots) if i == 0 or s != slots[own[i][3]] and own[i][:3] == other[s][:3] and other[s][3] == slots[own[i][3]]]
        assert len(pairs) == slow_matching(own, other)


def test_main_text_reads_attributes_and_keeps_articles():
    for html, want in [
        ('<div style="overflow:hidden"><article><p title="no hidden fees">A<br>b</article>', "A b"),
        ('<div class="layout has-sidebar"><article>X</article></div><div class="sidebar">no</div>', "X"),
        ('<div id="sidebar-wrapper"><article>X</article></div>', "X"),
        ("<form><article>Y</article><button>go</button></form>", "Y"),
        ('<main><article>Z<p>q</article><article class="teaser">t</article><div class="ad-slot">ad</div></main>', "Z\nq"),
        ('<p>seen<div hidden>no</div><div style="display: none">no</div><p>too', "seen\ntoo"),
        ("<div>" * 3000 + "deep", "deep"),
    ]:
        assert main_text.main_text(html) == want


def test_wrappers_of_generated_hosts(spark):
    r = random.Random(2)

    def text(k):
        return " ".join(f"{r.choice('abcdefgh')}{r.randrange(10_000)}" for _ in range(k))

    rows, want, alone = [], {}, 0
    for h in range(6):  # no roles or telling names: tables and divisions with constant and varying menus, long and short texts
        menu = f"<div class=x{h}>Menu {h}<ul>" + "".join(f"<li><a href=/>link {k}</a>" for k in range(4)) + "</ul></div>"
        for i in range(12):
            body = [text(r.randint(20, 60)) for _ in range(r.randint(2, 6))]
            varying = "<ul>" + "".join(f"<li><a href=/{k}>{text(2)}</a>" for k in range(5)) + "</ul>"
            inner = f"<div class=t><h2>{body[0]}</h2>" + "".join(f"<p>{p}" for p in body[1:]) + "</div>"
            page = f"<body><div class=top>Welcome to host {h}</div>{menu}<table><tr><td>{varying}<td>{inner}</table><div class=low>Imprint {text(1)}</div>"
            rows.append((100 * h + i, f"http://host{h}/{i}", page + (f"<div class=e>{text(3)}</div>" if i % 3 == 0 else "")))
            want[100 * h + i] = "\n".join(body)
    rows += [(900, "http://host0/copy", rows[0][2]), (901, None, None), (None, "http://host0/none", "")]
    got = {x.page_id: x for x in main_text.extracted(spark.createDataFrame([(*x, "?") for x in rows], "page_id long, url string, html string, text string"), True).collect()}
    words = Counter(right=0, all=0, more=0)
    for i, t in want.items():
        a, b = Counter(t.split()), Counter(got[i].text.split())
        words.update(right=(a & b).total(), all=a.total(), more=(b - a).total())
        alone += got[i].by_region
    assert words["right"] >= 0.9 * words["all"] and words["more"] <= 0.1 * words["all"] and alone == len(want), words
    assert got[900].text == got[0].text and got[901].text == "" and got[None].text == "" and len(got) == len(rows)
    large = [(i, "http://large/", "<body>" + "".join(f'<div class="c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}">w{k}i{i}</div>' for k in range(3000)) + "<div>" * 3000 + f"x{i}") for i in range(3)]
    assert {x.page_id: x.n_chars > 20_000 for x in main_text.extracted(spark.createDataFrame(large, "page_id long, url string, html string")).collect()} == {0: True, 1: True, 2: True}
    assert main_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def filled(sizes):
    """Targets by filling sources up one after another until none is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, rest, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] <= weight[s] * level}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= 2 * sizes[s]
        open_ -= over
    return target


def test_targets_and_seats(spark):
    r = random.Random(7)
    for trial in range(3):
        sizes = {(None if k == 4 else f"s{k}"): r.choice([0, 3, 400, 5000, 90_000]) + r.randrange(50) for k in range(3 + 3 * trial)}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        targets = mixing.source_targets(frame)
        got = {x.source: x.target for x in targets.collect()}
        want = filled(sizes)
        assert got == pytest.approx(want)
        block = mixing.block_words(sum(sizes.values()), smallest=min(t for t in want.values() if t > 0))
        order = sorted(want, key=lambda s: (s is None, s or ""))
        seats, total = Counter(), sum(want.values())
        for _ in range(math.floor(total / block + 0.5)):
            seats[max(order, key=lambda s: (want[s] / (2 * seats[s] + 1), -order.index(s)))] += 1
        assert {x.source: x.quota for x in mixing.apportion(targets, block).collect()} == {s: min(seats[s], math.ceil(2 * sizes[s] / block)) for s in sizes}


def test_pipeline_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    stages, d, scratch = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001", Scratch(spark, "stages")
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows += [(None, rows[0][1], "en", None, 1), (rows[1][0], rows[2][1] + " more", "en", "twice", 1), (None, None, None, None, None), (7_000, "", None, "empty", 0), (7_001, "word " * 30_000, "en", "long", 150_000)]
    frame = scratch.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    columns = frame.columns

    def after(name, docs):
        out = scratch.keep(stages[name](spark, docs, d), name)
        return out, [tuple(r) for r in out.collect()]

    frame, kept = after("toxicity", frame)
    chain, threshold = toxicity.toxicity_model(scratch.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "again"), spark.read.parquet(f"{d}/labels.parquet"))
    assert Counter(kept) == Counter(r for r in rows if toxicity.probabilities(chain, r[1])[-1] < threshold)

    frame, unique = after("near_duplicates", frame)
    groups = defaultdict(list)
    for place, _, least in reference_components([(i, r[1]) for i, r in enumerate(kept)]):
        groups[least].append(kept[place])
    assert len(unique) == len(groups)
    first = Counter((min((r[0] is None, r[0] or 0) for r in g)) for g in groups.values())
    assert Counter((r[0] is None, r[0] or 0) for r in unique) == first and not Counter(unique) - Counter(kept)

    frame, clean = after("decontamination", frame)
    bad = Counter()
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {w for _, t in items for w in zip(*(tokens(t)[k:] for k in range(12)), strict=False)}
    for r in unique:  # twelve equal tokens in a row are more than enough
        bad[r] += any(w in grams for w in zip(*(tokens(r[1])[k:] for k in range(12)), strict=False))
    gone = Counter(unique) - Counter(clean)
    assert not Counter(clean) - Counter(unique) and all(gone[r] for r, n in bad.items() if n) and gone.total() <= bad.total() + 3

    frame, mixed = after("mixing", frame)
    size = {}
    for r in clean:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(mixing.WORD, r[1] or ""))
    took = Counter()
    for r in mixed:
        took[r[3]] += len(re.findall(mixing.WORD, r[1]))
    want = filled(size)
    assert frame.columns == columns and all(abs(took[s] - want[s]) <= 256 for s in want)

    _, coded = after("token_output", frame)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], tokenizer.encode(r[1], add_special_tokens=False).ids + [2]) for r in mixed]
    assert Counter((r[0], r[2], r[3]) for r in coded) == Counter((i, len(x), zlib.crc32(array("I", x).tobytes())) for i, x in ids)
    assert [r[1] for r in sorted(coded, key=lambda r: r[1])] == list(itertools.accumulate((r[2] for r in sorted(coded, key=lambda r: r[1])), initial=0))[:-1]


def test_lines_of_odd_pages(spark):
    from folio.llm import line_dedup

    long = "".join(f"<p>line {k}" for k in range(20_000))
    rows = [(i, "http://h/", f"<p>menu<p>own {i}<p>own {i}") for i in range(4)] + [(0, "http://h/", "<p>menu<p>own 0<p>own 0"), (None, "http://h/", "<p>menu<p>none"), (9, None, None), (10, "http://one/", long)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, lines int")
    got = Counter((r.page_id, r.text if len(r.text) < 99 else len(r.text.split("\n")), r.n_lines, r.n_dropped) for r in line_dedup.without_boilerplate(frame).collect())
    assert got == Counter([*((i, f"own {i}\nown {i}", 3, 1) for i in range(4)), (0, "own 0\nown 0", 3, 1), (None, "none", 2, 1), (9, "", 0, 0), (10, 20_000, 20_000, 0)])
    assert {r.page_id: r.n_dropped for r in line_dedup.without_boilerplate(frame, least_pages=1).collect()}[10] == 20_000
    assert line_dedup.without_boilerplate(frame.limit(0)).count() == 0
