import re
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import decontaminate, exact_dedup, line_dedup, main_text, mixing, parity_join, pii, token_output, tool_calls, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long"
LONG = " ".join(f"w{i}" for i in range(400))
ROWS = [(1, None), (2, ""), (3, "  \n\t"), (4, "Same text"), (5, "same  text"), (6, "Same text"), (7, LONG), (8, LONG.replace("w77 ", "zz ")), (9, "x" * 200_000), (10, "a b c"), (10, "a b c"), (11, LONG + " tail")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None if i % 3 else f"s{i % 2}", None if t is None else len(t), 1) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_components(rows):
    sets, inverted, parent = {}, defaultdict(list), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in inverted[s])
        for s in sets[i]:
            inverted[s].append(i)
        for j, k in both.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rounds", [0, 3])
def test_parity_join(spark, docs, rounds):
    rows = ROWS + [(1000 + i, " ".join(f"v{(i * k) % 97}" for k in range(1, 60 + i))) for i in range(40)] + [(2000 + i, " ".join(f"u{k}" for k in range(i, 90 + i))) for i in range(0, 60, 3)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in parity_join.link_components(more, rounds=rounds).collect()} == reference_components(rows)


def test_parity_join_of_nothing(empty):
    assert parity_join.link_components(empty).count() == 0


def test_tokens(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, at = Tokenizer.from_file(path), 0
    got = token_output.token_digest(docs, path, path=str(tmp_path / "t")).orderBy("start").collect()
    for r, (i, t) in zip(got, sorted(ROWS, key=lambda x: (x[0], x[1] or "")), strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)
    one = token_output.read_shards(spark, str(tmp_path / "t"), [4]).collect()
    assert one[0].token_ids == tokenizer.encode("Same text", add_special_tokens=False).ids + [2]
    shard = next(p for p in (tmp_path / "t" / "shards").glob("part-*") if p.stat().st_size)
    data, dictionary = shard.read_bytes(), bytes(spark.read.parquet(str(tmp_path / "t" / "dictionary")).head().dictionary)
    _, offset, length, n = token_output.read_index(data)[0]
    assert len(token_output.read_document(data, offset, length, dictionary)) == n
    assert token_output.token_digest(empty, path).count() == 0


def test_exact_dedup(docs, empty):
    for digest in (exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, digest).collect()}
        groups = defaultdict(list)
        for i, t in ROWS:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        assert got == {(i, min(g), len(g), i == min(g)) for g in groups.values() for i in g}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_decontamination(spark, empty):
    item = " ".join(f"t{k}" for k in range(30))
    changed = " ".join("zz" if k % 9 == 4 else f"t{k}" for k in range(30))
    d = spark.createDataFrame([(1, f"before {item.upper()} after"), (2, f"x, y; {changed}!"), (3, "t1 t2 t3 and nothing more of this kind at all here"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, "short"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_start, r.matched) for r in decontaminate.overlaps(d, b).collect()}
    assert got == {(1, 7, 1, 30), (2, 7, 2, 27)}
    assert {tuple(r)[:2] for r in decontaminate.overlaps(d, b, broadcast_seeds=0).collect()} == {(1, 7), (2, 7)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, b).collect()) == [3, 4]
    assert decontaminate.overlaps(empty, b).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    sources = defaultdict(list)
    for r in got:
        sources[r.source].append(r)
    assert sum(s[0].target for s in sources.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert all(abs(sum(r.taken for r in s) - s[0].target) <= 256 for s in sources.values())
    words = {i: len(re.findall(mixing.WORD, t or "")) for i, t in ROWS}
    assert all(r.size == words[r.doc_id] for r in got)
    assert mixing.mix(empty).count() == 0


def test_tool_calls(spark):
    rows = [(1, 0, "tool", '{"content":{"z":1,"a":2},"tool_call_id":"a"}'), (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"y":1,"x":"q"}},{"id":"a","name":"g","arguments":"[]"}]}'), (2, 0, None, None), (3, 1, "tool", '{"tool_call_id":"zz"}')]
    schemas = {"f": {"properties": {"x": {"type": "string"}, "y": {"type": "string"}}, "required": ["w"]}}
    got = tool_calls.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).orderBy("conv_id", "order_turn", "order_step", "turn", "call_index").collect()
    assert [(r.kind, r.linked, r.errors) for r in got] == [("call", True, ["y: not string", "w: missing"]), ("call", False, ["id: repeated", "arguments: not an object"]), ("result", True, []), ("message", None, []), ("result", False, ["call: missing"])]
    assert got[0].json == '{"arguments":{"x":"q","y":1},"id":"a","name":"f","role":"assistant","type":"tool_call"}'


def test_line_dedup(spark):
    rows = [(i, "http://H.example/p", f"<nav>Menu</nav><p>own {i}<p>Menu") for i in range(5)] + [(9, "http://other/", "<p>Menu"), (10, None, None)]
    got = {r.page_id: r.text for r in line_dedup.without_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"own {i}" for i in range(5)}, 9: "Menu", 10: ""}


def test_pseudonyms():
    key = b"k" * 32
    for n in (1, 2, 7, 100, 1000):
        assert sorted(pii.permuted(i, n, key) for i in range(n)) == list(range(n))
    of = pii.pseudonyms(key)
    text = "card 4785380592391139, ip 224.213.17.73, on 2020-02-29, mail bosbt.42@mail8.example.com, +1 (555) 123-4567, not 4785380592391138"
    new, counts = of(text)
    assert counts == Counter(card=1, ip=1, date=1, email=1, phone=1) and new.endswith("not 4785380592391138") and len(new.split()) == len(text.split())
    assert of(new)[1] == counts and of(text)[0] == new


def test_pii_rows(docs, empty):
    got = pii.pseudonymised(docs, b"k" * 32).collect()
    assert len(got) == len(ROWS) and [r.text for r in got if r.doc_id == 1] == [None]
    assert pii.pseudonymised(empty, b"k" * 32).count() == 0


def test_toxicity(spark, docs, empty):
    rows = [(i, f"plain words number{i % 50} here" + (" awful" * (i % 3 == 0))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in toxicity.without_toxic(d, labels).collect()) == [i for i in range(300) if i % 3]
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == len(ROWS) and toxicity.without_toxic(empty, labels).count() == 0


def test_main_text(spark):
    page = '<body><header>Site</header><nav>m</nav><div class="cookie-notice">We</div><article><h1>T</h1><p>One &amp; two<p>Three <b>b</b>old<script>x</script><div class="comments"><p>c</div></article><footer>z</footer>'
    assert main_text.main_text(page) == "T\nOne & two\nThree bold" and main_text.main_text("") == ""
    pages = [f"<body><div>Welcome</div><div><p>text {i}</p></div><div>Imprint</div></body>" for i in range(5)]
    rows = spark.createDataFrame([(i, "http://h/x", p, 1) for i, p in enumerate(pages)] + [(9, None, None, 1)], "page_id long, url string, html string, text int")
    assert {r.page_id: r.text for r in main_text.extracted(rows).collect()} == {**{i: f"text {i}" for i in range(5)}, 9: ""}


def test_main_text_counts_all_pages_of_a_layout(spark):
    rows, want = [], {}
    for i in range(60):  # three layouts of one host, none of them in most of its pages
        k = i % 3
        menu = (f"<div class=x>Menu <b>{k}</b></div>", f"<table><tr><td>Menu {k}</table>", f"<section><p>Menu {k}</section>")[k]
        rows.append((i, "http://many/x", f"<body>{menu}<div><p>text {i}</p></div></body>"))
        want[i] = f"text {i}"
    for i in range(100, 130):  # near copies hold a third of a host
        copy = i < 110
        rows.append((i, "http://copies/x", f"<body><div>Menu</div><div>{'<p>shared' * copy}<p>text {i}</div></body>"))
        want[i] = "shared\n" * copy + f"text {i}"
    for i in range(200, 204):  # pages of over 1 MiB
        rows.append((i, "http://large/x", f"<body><div>Menu</div><div>{i} {'long ' * 220_000}</div></body>"))
        want[i] = f"{i} {'long ' * 220_000}".strip()
    got = {r.page_id: r.text for r in main_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_mixing_keeps_small_sources(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(500)), f"large{k % 3}") for k in range(12)] + [(100 + k, "one two three"[: 3 + 4 * (k % 2)], f"tiny{k}") for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(frame).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 9 and all(taken[s] > 0 and abs(taken[s] - t) <= 2 for s, t in target.items())


def test_null_and_repeated_ids(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, source string"

    def text(k, n=600):
        return " ".join(f"d{k}w{i}" for i in range(n))

    # mixing: all of one source without ids, all of another with one id
    rows = [(None, text(k), "none") for k in range(8)] + [(7, text(k), "one") for k in range(8, 16)] + [(k, text(k), "own") for k in range(100, 108)]
    frame = spark.createDataFrame(rows, schema)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    for s in ("none", "one", "own"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 256
    out = mixing.mixed_documents(frame).collect()
    of = [(r, Counter(w.split("w")[0] for w in r.text.split())) for r in out]
    assert all(len(c) == 1 and sum(c.values()) <= 1200 for _, c in of) and len({next(iter(c)) for _, c in of}) == len(of)
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out) == Counter((r.doc_id, r.source, r.taken) for r in got if r.taken)

    # decontamination: each row by its own text
    item = text("i", 30)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    frame = spark.createDataFrame([(None, item, "bad"), (None, text(1), "good"), (5, item, "bad"), (5, text(2), "good")], schema)
    assert sorted(r.source for r in decontaminate.decontaminate(frame, items).collect()) == ["good", "good"]

    # near duplicates: one row of each component, the smallest doc_id
    frame = spark.createDataFrame([(None, text(1), "copy"), (3, text(1), "stays"), (3, text(1), "stays"), (3, text(2), "copy"), (2, text(2), "stays"), (None, text(3), "stays"), (4, "", "stays"), (4, "", "stays")], schema)
    kept = Counter((r.doc_id, r.text.split("w")[0], r.source) for r in corpus_pipeline.near_duplicates(spark, frame, "").collect())
    assert kept == Counter({(3, "d1", "stays"): 1, (2, "d2", "stays"): 1, (None, "d3", "stays"): 1, (4, "", "stays"): 2})


def test_pipeline(spark):
    import corpus_pipeline

    from folio.llm.common import Scratch

    d, scratch = "/root/testdata/sf0.001", Scratch(spark, "test")
    frame = spark.read.parquet(f"{d}/documents.parquet")
    columns, counts = frame.columns, [frame.count()]
    for name, stage in corpus_pipeline.STAGES:
        frame = scratch.keep(stage(spark, frame, d), name)
        counts.append(frame.count())
        assert name == "token_output" or frame.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1]
    assert corpus_pipeline.run(spark, d).count() == counts[-1]
