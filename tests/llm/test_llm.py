"""The ten corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import math
import random
import tracemalloc
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliograph.llm import _tok, chat, decontam, html, langid, lm, minhash, packing, sharding, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, language string, kept boolean, h string, row string, shard string, window_id string"
EN = "the of and with from there light under river house stone morning carry window garden never".split()
DE = "der die und nicht unter haus stein morgen fenster garten immer wasser straße grün über schön".split()


def words(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed=0, n=60):
    """Documents of two invented vocabularies, with copies, nulls, empties, one very long and one repeated outright."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tu", "sha", "vor", "el", "ni", "gra"]
    rare = ["".join(rng.choice(syllables) for _ in range(4)) for _ in range(400)]
    rows = []
    for i in range(n):
        vocabulary, lang = (EN, "en") if i % 2 else (DE, "de")
        rows.append((i, words(rng, vocabulary + rng.sample(rare, 12), rng.randint(20, 120)), lang, f"s{i % 3}", 1))
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[3][1] + " stone", "en", "s", 1), (102, None, "en", "s", None), (103, "", "de", None, 0), (104, " ... !!", None, "s", 1), (105, words(rng, EN + rare, 30000), "en", "s", 1), (None, rows[5][1], None, "s", 1)]
    return rows + [rows[7], rows[7]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(*r, 1.0, "x", True, "h", "r", "s", "w") for r in corpus()], EXTRA)


# tokens


def test_tokens_are_those_of_the_plain_loop():
    rng = random.Random(1)
    chars = "abcXYZ019 \n.,-_ÀÉßéç×÷«»“—、。漢字ا،؟۔Œœİ\u0130ΑΩάЖжӁẞ，（Ａ​ÿ "
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "x" * 700_000, "ab " * 200_000]
    t = _tok.tokenize(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        want = _tok.py_tokens(text)
        assert t.first[i + 1] - t.first[i] == len(want)
        for w, h in zip(want, t.hash[t.first[i] : t.first[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_wordy_texts_are_those_with_tokens(spark):
    texts = ["", " .,", "\u00d7 \u2014", "\u060c\u061f", "\uff0c", "a", "\u0627", "\u6f22", "\u00e9", "7"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(_tok.WORDY)).collect()
    assert [r[0] for r in got] == [bool(_tok.py_tokens(t)) for t in texts]


def test_memory_follows_the_longest_text_by_a_known_factor():
    text = "word another " * 400_000  # 5 MB
    col = pa.array([text])
    for f, most in ((lambda: _tok.tokenize(col), 14), (lambda: minhash.signatures(col, minhash.Params()), 24), (lambda: decontam.contaminated(_tok.tokenize(col), decontam.build(["word another thing"], decontam.Params()), decontam.Params()), 24)):
        f()
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(text), peak / len(text)


def test_shingles_stay_within_their_row():
    texts = ["a b c d", "a b", "", None, "b c d"]
    h, doc, first = _tok.shingles(_tok.tokenize(pa.array(texts)), 3)
    assert doc.tolist() == [0, 0, 1, 4]
    assert h[1] == h[3] and len(set(h.tolist())) == 3


# 1 language


def test_language_by_brute_force(docs):
    got = {(r.doc_id, r.language, round(r.cosine, 4)) for r in langid.identify(docs).collect()}
    m = langid.fit(docs)
    rows = corpus()
    texts = [r[1] or "" for r in rows]
    grams = [Counter() for _ in texts]
    for g, t in zip(grams, texts):
        c, _ = langid.counts(pa.array([t]))
        g.update({k: v for k, v in enumerate(c[0]) if v})
    df = Counter(k for g in grams for k in g)
    idf = [math.log((len(texts) + 1) / (df[k] + 1)) for k in range(langid.WIDTH)]
    assert np.allclose(idf, m.idf, atol=1e-5)
    for r, g in zip(rows, grams):
        v = {k: math.log1p(n) * idf[k] for k, n in g.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        sims = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in m.centroids] if norm else []
        if sims:
            best = max(range(len(sims)), key=lambda i: sims[i])
            assert any(d == r[0] and lang == m.langs[m.owner[best]] and abs(cos - sims[best]) < 1e-3 for d, lang, cos in got)
        else:
            assert (r[0], None, 0.0) in got


def test_language_accuracy_and_rejection(docs, clashing):
    right = [r.language == ("en" if r.doc_id % 2 else "de") for r in langid.identify(docs).collect() if r.doc_id is not None and r.doc_id < 60]
    assert sum(right) / len(right) >= 0.95
    kept = langid.accepted(clashing)
    assert kept.columns == clashing.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i in range(60) if i in ids]) >= 58 and not ids & {102, 103, 104}


def test_language_without_rows_or_labels(empty, docs):
    assert langid.identify(empty).count() == 0
    from pyspark.sql import functions as F

    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.rejected and r.language is None for r in none) and len(none) == len(corpus())


# 2 HTML


PAGE = "<html><head><title>x</title></head><body><nav><a href='/'>home</a><li><a>about us</a></li></nav><p>%s</p><p>%s</p><script>var a='<p>no</p>'</script><!-- <p>no</p> --><footer>© all rights</footer>" % ("word " * 40, "other &amp; text " * 20)


def test_html_blocks_and_text(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p>" + "a b " * 50_000), (1, PAGE), (None, "<script>never closed " * 3)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'x' as text")).collect()
    assert len(got) == 6
    page = [r for r in got if r.page_id == 1]
    assert page[0].text == page[1].text and "word word" in page[0].text and "other & text" in page[0].text
    assert not any(w in page[0].text for w in ("home", "about", "no", "rights"))
    by = {r.page_id: r for r in got if r.page_id != 1}
    assert by[2].text is None and by[2].blocks == 0 and by[3].text == "" and by[None].text == "" and by[4].content_blocks == 1


def plain_blocks(page):
    """Blocks of a page by a loop over its characters."""
    out, text, words, linked, depth, i = [], "", 0, 0, 0, 0

    def close():
        nonlocal text, words, linked
        if words:
            n = len(text.split())
            out.append((" ".join(text.split()), n, min(linked, n)))
        text, words, linked = "", 0, 0

    piece = ""

    def flush():
        nonlocal piece, text, words, linked
        piece = piece.replace("&amp;", "&").replace("&eacute;", "\u00e9")
        text += piece
        words += len(piece.split())
        linked += len(piece.split()) if depth else 0
        piece = ""

    while i < len(page):
        if page.startswith("<!--", i):
            z = page.find("-->", i)
            i = len(page) if z < 0 else z + 3
            piece += " "
        elif page[i] == "<":
            z, quote = i + 1, None
            while z < len(page) and (quote or page[z] != ">"):
                quote = None if page[z] == quote else quote or (page[z] if page[z] in "\"'" else None)
                z += 1
            name = page[i + 1 : z].split()[0].lower()
            i = z + 1
            if name in ("script", "style", "head"):
                i = page.index(">", page.index(f"</{name}", i)) + 1
                piece += " "
            else:
                flush()
                if name.strip("/") == "a":
                    depth = max(0, depth - 1) if name[0] == "/" else depth + 1
                elif name.strip("/") in html.BLOCK:
                    close()
        else:
            piece += page[i]
            i += 1
    flush()
    close()
    return out


def test_pages_by_brute_force(spark):
    rng = random.Random(14)
    bits = ["<p>", "</p>", "<div class='x y'>", "</div>", "<a href=\"u?a>b\">", "</a>", "<b>", "</b>", "<br>", "<!-- a <p> b -->", "<script>if (a < b) x</script>", "<style>p {}</style>", "<li>", "</li>", "<h2 title='a > b'>", "</h2>", "<span>"]
    pages = ["<html><head><title>none of this</title></head><body>" * (i % 2) + "".join(rng.choice(bits) if rng.random() < 0.4 else rng.choice(["one ", "two", " three &amp; four ", "caf&eacute; ", "\n", words(rng, EN, 12) + " "]) for _ in range(rng.randint(1, 60))) for i in range(120)]

    def decided(node, x):
        while node.feature >= 0:
            node = node.left if x[node.feature] <= node.limit else node.right
        return node.value

    rows = [(i, p) for i, p in enumerate(pages)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("blocks", F.lit(3))).collect()}
    for i, page in rows:
        own = plain_blocks(page)
        assert html.blocks(page) == own, page
        side = [(w, n / w) for _, w, n in own]
        keep = [t for k, (t, _, _) in enumerate(own) if decided(html.tree(), [*(side[k - 1] if k else (-1, 0)), *side[k], *(side[k + 1] if k + 1 < len(own) else (-1, 0))])]
        assert (got[i].text, got[i].blocks, got[i].content_blocks) == ("\n".join(keep), len(own), len(keep))


def test_tree_is_the_best_split_of_brute_force():
    data = np.array(html.LABELLED, float)
    x, y = data[:, :-1], data[:, -1].astype(int)
    root = html.grow(x, y, depth=1)

    def gini(left):
        return sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))

    costs = [gini(x[:, f] <= v) for f in range(6) for v in np.unique(x[:, f])[:-1] if 2 <= (x[:, f] <= v).sum() <= len(y) - 2]
    assert math.isclose(gini(x[:, root.feature] <= root.limit), min(costs))
    one = html.tree()

    def walk(n, row):
        return n.value if n.feature < 0 else walk(n.left if row[n.feature] <= n.limit else n.right, row)

    assert html.classify(one, x).tolist() == [walk(one, r) for r in x]
    assert (html.classify(one, x) == y).mean() > 0.95


def test_html_held_out_accuracy():
    blocks = [(2, 1.0), (3, 1.0), (9, 0.0), (70, 0.0), (55, 0.02), (61, 0.0), (4, 1.0), (5, 0.0)]
    w, d = np.array([b[0] for b in blocks], float), np.array([b[1] for b in blocks])
    f = html.block_features(w, w * d, np.zeros(len(w), int))
    assert html.classify(html.tree(), f).tolist()[3:6] == [True] * 3 and not html.classify(html.tree(), f)[[0, 1, 6, 7]].any()


# 3 chat


def test_chat_plan_keeps_every_turn_once():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 15)
        tokens = np.array([rng.choice([1, 5, 30, 80, 200]) for _ in range(n)])
        system = rng.randint(0, min(2, n))
        p = chat.Params(budget=150, history=40)
        plan = chat.plan(tokens, system, p)
        assert [i for _, a, z in plan for i in range(a, z)] == list(range(system, n))
        for back, a, z in plan:
            fixed, total = tokens[:system].sum(), tokens[:system].sum() + tokens[back:z].sum()
            assert total <= p.budget or z - a <= 1 and back == a
            if back < a:
                assert tokens[back:a].sum() <= p.history
            if total <= p.budget and z < n and a < n:
                assert fixed + tokens[back : z + 1].sum() > p.budget  # the longest run that fits


def test_chat_windows_of_odd_input(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", "yo " * 400), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "system", "only"), (None, 1, None, "x"), (3, None, "assistant", "a"), (3, 1, "user", "b"), (3, 1, "user", "b")]
    got = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as n"), chat.Params(budget=100, history=20)).collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    assert all(r.text.startswith("<|system|>\nbe kind") for r in by[1])
    assert sum(r.over_budget for r in by[1]) == 1
    assert len(by[2]) == 1 and by[2][0].loss_mask == "0"
    assert by[None][0].text == "<|user|>\nx\n" and by[3][0].loss_mask == "100"
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 4 packing


P4 = packing.Params(window=64, bucket_tokens=2000)


def test_bottom_is_that_of_brute_force():
    rng = np.random.default_rng(0)
    doc = np.sort(rng.integers(0, 20, 3000))
    h = rng.integers(0, 1 << 60, 3000, dtype=np.uint64) % np.uint64(500) * np.uint64(1 << 50)
    h[doc == 3] = h[doc == 3][0]
    got, own = packing.bottom(h, doc, 21, 8)
    for r in range(21):
        assert got[own == r].tolist() == sorted(set(h[doc == r].tolist()))[:8]


def test_overlaps_by_brute_force():
    rng = random.Random(3)
    lists = [(sorted(rng.sample(range(40), rng.randint(1, 12))), sorted(rng.sample(range(40), rng.randint(1, 12)))) for _ in range(200)]
    for k in (8, 100):
        sides = [(np.array([x for t in lists for x in t[i]], np.uint32), np.array([len(t[i]) for t in lists])) for i in range(2)]
        got = packing.overlaps(*sides[0], *sides[1], k)
        for j, (a, b) in zip(got, lists):
            union = sorted({*a, *b})[:k]
            assert j == pytest.approx(sum(x in a and x in b for x in union) / len(union))


def related(n, rng):
    """Texts in families of six that share sentences, a third of all with a frequent line."""
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    line, out = words(rng, vocabulary, 8), []
    for i in range(n):
        if i % 6 == 0:
            sentences = [words(rng, vocabulary, 12) for _ in range(6)]
        out.append(" ".join(rng.sample(sentences, 4) + [words(rng, vocabulary, rng.randint(20, 80))] + [line] * (i % 3 == 0)))
    return out


def test_neighbours_are_those_of_whole_texts(spark):
    texts = related(600, random.Random(4))
    p = packing.Params()
    rows = packing.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", p)
    got, of = {}, {r.doc_id: r.node for r in rows.select("doc_id", "node").collect()}
    for r in packing.neighbours(rows.select("node", "sig", "features").dropDuplicates(["node"]), p).collect():
        got.setdefault(r.a, {})[r.b] = r.s
    assert all(len(v) <= p.neighbours for v in got.values())
    pairs = [set(itertools.pairwise(_tok.py_tokens(t))) for t in texts]
    hit = want = 0
    for a in range(600):
        sims = sorted((-len(pairs[a] & pairs[b]) / len(pairs[a] | pairs[b]), b) for b in range(600) if b != a)[: p.neighbours]
        true = {of[b]: -s for s, b in sims if -s >= 0.1}
        want += len(true)
        hit += sum(b in got.get(of[a], {}) for b in true)
        if len(pairs[a]) < 60:
            assert all(abs(got[of[a]][b] - s) < 0.03 for b, s in true.items() if b in got.get(of[a], {}) and len(pairs[a]) < 60)
    assert want > 1000 and hit / want >= 0.9


def test_one_key_in_most_nodes_leaves_no_large_group(spark):
    # a third of all nodes share all first values: each still meets only its neighbours in order
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 16, (900, 64)).astype(np.uint16)
    sig[:300, :48] = 7
    nodes = spark.createDataFrame([(int(i), sig[i].tobytes()) for i in range(900)], "node long, sig binary")
    got = packing.meetings(nodes, packing.Params()).collect()
    count = Counter(r.a for r in got)
    assert set(count) >= set(range(300)) and max(count.values()) <= packing.Params().shortlist
    assert all(r.m == int((sig[r.a].astype(np.uint8) == sig[r.b].astype(np.uint8)).sum()) for r in got)


def test_walk_by_brute_force():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(1, 12)
        edges = [(a, b, rng.choice([1.0, 2.0, 3.0])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.3]
        a, b, s = (np.array([e[i] for e in edges]) for i in range(3))
        near = {v: {} for v in range(n)}
        for x, y, w in edges:
            near[x][y] = near[y][x] = w
        left, out = set(range(n)), []
        while left:
            v = min(left, key=lambda v: (len(near[v]), v))
            while v is not None:
                left.discard(v)
                out.append(v)
                v = min((u for u in near[v] if u in left), key=lambda u: (-near[v][u], u), default=None)
        assert packing.walk(np.arange(n), a, b, s) == out


def levels(links):
    """The walk of each component, by a plain loop: cells by best links, a walk in each, cells as nodes."""
    nodes = {x: [x] for link in links for x in link[:2]}
    best, done = {}, []
    for a, b, s, h in links:
        for x, y in ((a, b), (b, a)):
            best[x, y] = max(best.get((x, y), (s, h)), (s, h))
    while best:
        first = {x: max((w, y) for (a, y), w in best.items() if a == x)[1] for x in {a for a, _ in best}}
        cell = {}
        for x in first:
            y = x
            while first[first[y]] != y:
                y = first[y]
            cell[x] = min(y, first[y])
        after, outer = {}, {}
        for c in set(cell.values()):
            own = sorted(x for x in cell if cell[x] == c)
            degree = {x: sum(a == x for a, _ in best) for x in own}
            left, out = set(own), []
            while left:
                v = min(left, key=lambda v: (degree[v], v))
                while v is not None:
                    left.discard(v)
                    out += nodes[v]
                    v = min((y for a, y in best if a == v and y in left), key=lambda y: (-best[v, y][0], y), default=None)
            after[c] = out
        for (a, b), w in best.items():
            if cell[a] != cell[b]:
                k = cell[a], cell[b]
                outer[k] = max(outer.get(k, w), w)
        linked = {a for a, _ in outer}
        done += [(c, after[c]) for c in after if c not in linked]
        nodes, best = {c: after[c] for c in linked}, outer
    return sorted(done)


def test_cells_follow_their_links(spark):
    rng = random.Random(8)
    links = {(a, b): rng.choice([0.2, 0.4, 0.6, 0.8]) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(75)) if a != b}
    rows = [(a, b, s) for (a, b), s in links.items()]
    edges = spark.createDataFrame(rows, "a long, b long, s double")
    marked = edges.select("a", "b", "s", packing.mark("a", "b")).collect()
    want = levels([tuple(r) for r in marked])
    assert len(want) > 1 and max(len(x) for _, x in want) > 20
    for limit in (1_000_000, 20, 0):  # in one task, some levels by Spark, and all of them
        got = {}
        for r in sorted(packing.paths(edges, packing.Params(local_links=limit)).collect(), key=lambda r: (r.component, r.place, r.tail)):
            got.setdefault(r.component, []).append(r.node)
        assert sorted(got.items()) == want, limit
    # edges to other cells count in the degree: 1 has none, 2 has one
    assert packing.walk(np.array([1, 2]), np.array([1]), np.array([2]), np.array([1.0]), np.array([1, 0])) == [2, 1]


def test_copies_are_spread_over_buckets(spark):
    text = "one two three four five six seven eight"
    table = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string")
    got = packing.pack(table, p=replace(P4, bucket_tokens=400)).collect()
    per = Counter()
    for r in got:
        per[r.window_id >> 32] += r.end_token - r.start_token
    assert sum(per.values()) == 2400 and len(per) >= 4 and max(per.values()) <= 1000


def test_windows_hold_every_token_once(docs, empty, clashing):
    for table in (docs, clashing):
        got = packing.pack(table, p=P4).collect()
        size = Counter()
        for r in got:
            size[r.window_id] += r.end_token - r.start_token
            assert r.end_token > r.start_token
        assert max(size.values()) == P4.window
        assert sum(v < P4.window for v in size.values()) <= len({w >> 32 for w in size})
        count = {}
        for r in corpus():
            n = len(_tok.py_tokens(r[1]))
            if n:
                count.setdefault(r[0], Counter()).update(range(n))
        have = {}
        for r in got:
            have.setdefault(r.doc_id, Counter()).update(range(r.start_token, r.end_token))
        assert have == count
    assert packing.pack(empty).count() == 0


# 5 decontamination


def longest(tokens, items, end):
    """Longest match that ends before ``end``, and the shortest item that holds it."""
    for n in range(end, 0, -1):
        own = [len(s) for s in items if any(s[i : i + n] == tokens[end - n : end] for i in range(len(s) - n + 1))]
        if own:
            return n, min(own)
    return 0, 0


def test_automaton_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        items = [[rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
        a = decontam.Automaton(items).flat()
        tokens = [rng.randint(-1, 3) for _ in range(25)]
        got = {(i, j): a.short[s] for i, j, s in a.matches(tokens)}
        want = {}
        for end in range(1, len(tokens) + 1):
            n, short = longest(tokens, items, end)
            after = longest(tokens, items, end + 1)[0] if end < len(tokens) else 0
            if n and after != n + 1:
                want[end - n, end] = short
        assert got == want


def test_spans_removed_by_brute_force(spark):
    rng = random.Random(4)
    items = [words(rng, EN, 20), words(rng, EN, 7), words(rng, EN, 14), None, "", "!!"]
    rows = []
    for i in range(40):
        t = words(rng, DE, 15).split()
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(items[:3]).split()
            a = rng.randint(0, len(s) - 4)
            t[rng.randint(0, len(t)) : 0] = [w.upper() if rng.random() < 0.3 else w + "," for w in s[a : a + rng.randint(3, 20)]]
        rows.append((i, " ".join(t)))
    rows += [(50, None), (51, ""), (52, items[0]), (52, items[0]), (53, items[0] + " tail " * 50_000), (None, "head " + items[2])]
    p = decontam.Params(min_tokens=9, coverage=0.8, floor=5)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in enumerate(items + items[:1])], "item_id long, text string")
    known = [x for x in map(_tok.py_tokens, items) if x]

    def expect(text):
        if text is None:
            return None
        t, start, k = [], [], 0
        spans = []
        for w in _tok.py_tokens(text):
            k = next(i for i in range(k, len(text)) if "".join(map(_tok.py_fold, text[i : i + len(w)])) == w)
            t.append(w)
            start.append((k, k + len(w)))
            k += len(w)
        gone = [False] * len(text)
        for end in range(1, len(t) + 1):
            n, short = longest(t, known, end)
            if (end == len(t) or longest(t, known, end + 1)[0] != n + 1) and n and (n >= p.min_tokens or n >= p.floor and n >= p.coverage * short):
                spans.append((start[end - n][0], start[end - 1][1]))
        if not spans:
            return text
        for a, z in spans:
            gone[a:z] = [True] * (z - a)
        parts = "".join("\0" if g else c for c, g in zip(text, gone)).split("\0")
        return " ".join(x.strip() for x in parts if x.strip())

    small = [r for r in rows if r[0] != 53]
    for limit, together in ((10**6, 64), (15, 64), (15, 1)):  # one automaton, one an item, and one a pass
        got = {r.doc_id: r for r in decontam.spans(docs, bench, p=replace(p, shard_tokens=limit, together=together)).collect()}
        for i, text in small:
            assert got[i].text == expect(text), i
        assert got[53].text.startswith("tail") and got[53].removed_bytes == len(items[0])
    for q in (p, replace(p, shard_tokens=15, together=1)):
        kept = decontam.clean(docs.selectExpr("*", "cast(7 as long) as n_chars", "1 as removed_bytes", "2 as c0"), bench, p=q).collect()
        assert len(kept) == len(rows) and all(r.n_chars in (7, len(r.text or "")) and r.c0 == 2 for r in kept)
        assert Counter(r.text for r in kept if r.doc_id != 53) == Counter(expect(t) for _, t in small)
    assert decontam.spans(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.spans(docs.limit(0), bench).count() == 0


# 6 toxicity


P6 = toxicity.Params(bits=14, batch=32, steps=200)
BAD = ["grumbleworf", "snarkelbit", "vexidrome"]


def labelled(n=160):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    rows = []
    for i in range(n):
        t = words(rng, vocabulary, rng.randint(15, 60)).split()
        if i % 3 == 0:
            for w in BAD:
                t.insert(rng.randint(0, len(t)), w)
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    return rows, vocabulary


def test_toxicity_catches_unseen_misspellings_and_leaves_clean_texts():
    rows, vocabulary = labelled(400)
    m = toxicity.fit_local([r[1] for r in rows[:300]], np.array([r[2] for r in rows[:300]]), P6)
    flagged = m.predict(pa.array([r[1] for r in rows[300:]]))[1]
    truth = np.array([r[2] for r in rows[300:]], bool)
    assert (flagged == truth).mean() >= 0.95
    rng = random.Random(9)
    near = [words(rng, vocabulary, 20) + " grumblewurf snarkelbitt vexidrone " + words(rng, vocabulary, 20) for _ in range(20)]
    clean = [words(rng, vocabulary, 43) for _ in range(40)]
    assert m.predict(pa.array(near))[1].mean() >= 0.5 and m.predict(pa.array(clean))[1].mean() <= 0.1
    long = words(rng, vocabulary, 3000)
    assert m.predict(pa.array([long + " " + " ".join(BAD) + " " + long]))[1][0]


def test_reduced_shares_are_the_softmax():
    """One number a feature gives what the embeddings, averaged by plain loops, and the softmax give."""
    texts = [r[1] for r in labelled(60)[0]]
    p = replace(P6, min_docs=1, window=16, least=5)
    rng = np.random.default_rng(0)
    e, w, b = rng.normal(size=(1 << p.bits, p.dim)), rng.normal(size=(p.dim, 2)), rng.normal(size=2)
    m = toxicity.Model(e @ (w[:, 1] - w[:, 0]), float(b[1] - b[0]), 0.0, p)
    for text in texts:
        words = list(dict.fromkeys(_tok.py_tokens(text)))
        vectors = []
        for x in words:
            _, bucket, first = toxicity.features(_tok.tokenize(pa.array([x])), p.bits)
            assert first.tolist() == [0, len(bucket)] and len(bucket) == 1 + sum(max(0, len(x) + 3 - k) for k in toxicity.NGRAMS)
            vectors.append(e[bucket].mean(0))
        best, at = -np.inf, 0
        for start in range(0, max(1, len(words)), p.window // 2):
            end = min(start + p.window, len(words))
            own = vectors[max(0, min(start, end - p.window)) : end]
            z = sum(own) / max(len(own), p.least) @ w + b
            best = max(best, z[1] - z[0])
            if end == len(words):
                break
        got = m.logits(toxicity.once(_tok.tokenize(pa.array([text]))), 1)[0]
        assert math.isclose(got, best, abs_tol=1e-6)


def test_gathered_windows_are_those_of_the_texts():
    texts = [r[1] for r in labelled(30)[0]] + [None, "", "a a a"]
    p = replace(P6, min_docs=1, window=7)
    m = toxicity.gather(texts, p)
    n = [len(dict.fromkeys(_tok.py_tokens(x))) for x in texts]
    assert [int(np.diff(m.start)[m.doc == i].sum()) for i in range(len(texts))] == n and np.diff(m.start).max() == 7
    word, own = m.words(np.arange(len(m.doc)))
    assert len(word) == sum(n)
    few = toxicity.gather(texts, replace(p, min_docs=3))
    docs = Counter()
    for i in range(len(texts)):
        docs.update(set(m.features(m.words(np.flatnonzero(m.doc == i))[0])[0].tolist()))
    assert few.bucket.tolist() == [x for x in m.bucket.tolist() if docs[x] >= 3]


def test_toxicity_of_tables(spark, empty):
    rows, _ = labelled()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (None, rows[0][1], 1.0), rows[0][:2] + (1.0,)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, p=P6).collect()
    assert len(got) == len(rows) + 4
    assert all(not r.is_toxic and r.toxicity == 0 for r in got if r.doc_id in (900, 901))
    assert sum(r.is_toxic == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 900) >= 0.95 * len(rows)
    assert toxicity.clean(docs, labels, p=P6).columns == docs.columns
    assert toxicity.score(docs, labels.filter("toxic = 0"), p=P6).filter("is_toxic").count() == 0
    assert toxicity.score(empty, labels, p=P6).count() == 0 and toxicity.score(docs, labels.limit(0), p=P6).filter("is_toxic").count() == 0


# 7 top-k


def test_topk_by_brute_force(spark, docs, empty, clashing):
    rng = random.Random(7)
    qs = [(i, words(rng, EN + DE, 6)) for i in range(12)] + [(50, None), (51, ""), (52, "unknownword"), (None, "the"), (1, words(rng, EN, 3))]
    queries = spark.createDataFrame(qs, "item_id long, text string").selectExpr("*", "1 as rank")
    rows = [(r[0], _tok.py_tokens(r[1])) for r in corpus()]
    n = sum(bool(t) for _, t in rows)
    mean = sum(len(t) for _, t in rows) / n
    df = Counter(w for _, t in rows for w in set(t))
    p = topk.Params(k=4, block=3, query_group=5)
    for table in (docs, clashing):
        got = Counter((r.query_id, r.doc_id, r.score) for r in topk.search(table, queries, p=replace(p, query_group=1000)).collect())
        want = Counter()
        for q in {q for q, _ in qs if q is not None}:
            terms = Counter(w for i, t in qs if i == q for w in _tok.py_tokens(t))
            if sum(i == q for i, _ in qs) > 1:
                continue  # two queries of one id share a ranking: looked at below
            best = []
            for d, t in rows:
                tf = Counter(t)
                s = sum(w * math.floor(p.scale * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * (p.k1 + 1) / (tf[x] + p.k1 * (1 - p.b + p.b * len(t) / mean)) + 0.5) for x, w in terms.items() if tf[x])
                if s > 0:
                    best.append((-s, d is None, d or 0, d))
            want.update((q, d, -s) for s, _, _, d in sorted(best)[: p.k])
        assert Counter({k: v for k, v in got.items() if k[0] != 1}) == want
    grouped = topk.search(docs, queries.filter("item_id <> 1"), p=p).collect()
    assert Counter((r.query_id, r.doc_id, r.score) for r in grouped) == Counter({k: v for k, v in got.items() if k[0] != 1})
    assert topk.search(empty, queries).count() == 0 and topk.search(docs, queries.limit(0)).count() == 0


def test_pruning_skips_blocks():
    rng = random.Random(8)
    texts = [words(rng, EN, 20) for _ in range(400)] + [" ".join(["zebra"] * 5)]
    t = _tok.tokenize(pa.array(texts))
    qs = topk.parse([(0, "zebra")])
    row, term, tf = topk.forward(t, qs.vocab)
    best = topk.Best(1, 1)
    assert topk.search_slice(best, qs, np.arange(len(texts)), row, term, tf * 10, topk.Params(k=1, block=8)) == 1


# 8 LM


P8 = lm.Params(orders=(1, 2, 3), block=8, blocks=4, part_bytes=2000, slice_bytes=700)


def test_huffman_lengths_are_optimal():
    counts = np.zeros(256, int)
    counts[[65, 66, 67, 68, 200]] = [50, 20, 15, 10, 5]
    code = lm.huffman(counts)
    assert code.length[[65, 66, 67, 68, 200]].tolist() == [1, 2, 3, 4, 4] or (counts * code.length).sum() == 50 + 40 + 45 + 40 + 20
    assert code.length[0] == 0 and sorted(code.rank[counts > 0].tolist()) == [1, 2, 3, 4, 5]
    for b in np.flatnonzero(counts):
        for d in range(code.length[b]):
            low, mid, high = code.low[b, d], code.mid[b, d], code.high[b, d]
            assert low <= code.rank[b] < high and (code.rank[b] >= mid) == (code.bit[b, d] == 1)
    alone = lm.huffman(np.eye(256, dtype=int)[65])
    assert alone.length.sum() == 0 and lm.huffman(np.zeros(256, int)).length.sum() == 0


def test_messages_round_trip():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 1 << 54, 500, dtype=np.uint64))
    count = rng.integers(1, 1 << 20, len(key))
    got = lm.unpack(lm.pack(key, count))
    assert (got[0] == key).all() and (got[1] == count).all()
    half = lm.whole([lm.pack(key[:300], count[:300]), lm.pack(key[200:], count[200:])])
    k, c = lm.unpack(half)
    assert (k == key).all() and c[250] == 2 * count[250] and c[0] == count[0]


@pytest.mark.parametrize("room", [0, 1 << 20])
def test_pairs_by_sort_and_by_table(room):
    rng = random.Random(7)
    texts = [words(rng, EN, 30).encode(), b"", b"aaaa", bytes(range(256)), words(rng, EN, 9).encode()]
    code = lm.huffman(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    where, found = lm.pairs(texts, code, (0, 1, 3), room=room)
    assert len(where) == sum(map(len, texts))
    for n, f in zip((0, 1, 3), found):
        keys = []
        for t in texts:
            r = [0] * n + code.rank[np.frombuffer(t, np.uint8)].tolist()
            keys += [sum(v << lm.BITS * (n - j) for j, v in enumerate(r[i : i + n + 1])) for i in range(len(t))]
        assert f.key[f.at[where]].tolist() == keys
        want = Counter(keys)
        assert {k: c for k, c in zip(f.key.tolist(), f.count.tolist()) if c} == want
        assert (np.diff(f.key.astype(np.int64)) > 0).all() and (f.rank == (f.key & np.uint64(511)).astype(int)).all()


def test_decisions_are_laid_out_by_pair_not_by_byte():
    rng = random.Random(8)
    texts = [words(rng, EN, 400).encode() for _ in range(150)]
    size = sum(map(len, texts))
    p = lm.Params()
    code = lm.huffman(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    tracemalloc.start()
    bits = lm.block_bits(texts, {}, [1, 1, 1], code, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bits == pytest.approx([sum(code.length[np.frombuffer(t, np.uint8)]) for t in texts], rel=0.2)
    assert peak < 80 * size, peak / size


def slow_bits(text, others, code, p):
    """Bits of one text by loops over its bytes and decisions."""
    counts = [Counter() for _ in p.orders]
    for t in others:
        for i in range(len(t)):
            for k, n in enumerate(p.orders):
                counts[k][bytes(max(0, n - i)), t[max(0, i - n) : i], t[i]] += 1
    w = [[p.weight / 16] * len(p.orders) for _ in range(len(p.orders) + 1)]
    table = np.linspace(-8, 8, p.cells)
    begin = [*lm.steps(len(text), p.block).tolist(), len(text)]
    total = 0.0
    for a, z in itertools.pairwise(begin):
        grads = [[0.0] * len(p.orders) for _ in w]
        fix, hits = np.zeros(p.cells), np.zeros(p.cells)
        for i in range(a, z):
            b = text[i]
            for d in range(code.length[b]):
                low, mid, high = (t[b, d] for t in (code.low, code.mid, code.high))
                x = []
                for k, n in enumerate(p.orders):
                    context = bytes(max(0, n - i)), text[max(0, i - n) : i]
                    zero = sum(counts[k][(*context, c)] for c in range(256) if low <= code.rank[c] < mid)
                    one = sum(counts[k][(*context, c)] for c in range(256) if mid <= code.rank[c] < high)
                    x.append(float(np.clip(np.rint(16 * np.log((one + p.prior) / (zero + p.prior))), -127, 127)))
                g, sign = g if d else sum(v != 0 for v in x), 2 * int(code.bit[b, d]) - 1
                y = min(7.99, max(-7.99, sum(u * v for u, v in zip(x, w[g]))))
                cell, part = divmod((y + 8) * (p.cells - 1) / 16, 1)
                cell = int(cell)
                r = table[cell] * (1 - part) + table[cell + 1] * part
                total += math.log2(1 + math.exp(-0.5 * sign * (y + r)))
                err = sign / (1 + math.exp(sign * y))
                for k in range(len(x)):
                    grads[g][k] += err * x[k]
                near = cell if part < 0.5 else cell + 1
                fix[near] += sign / (1 + math.exp(sign * r))
                hits[near] += 1
        size = begin[begin.index(a) + 1] - a if z != len(text) else p.block
        for g in range(len(w)):
            for k in range(len(p.orders)):
                w[g][k] += p.rate / 256 * p.block / max(p.block, size) * grads[g][k]
        table = table + fix / (hits + 6)
    return total


def test_bits_by_brute_force(spark):
    rng = random.Random(6)
    texts = [words(rng, EN, rng.randint(5, 40)) for _ in range(14)] + ["", words(rng, DE, 150) + " \u6f22", None, "x"]
    raw = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    size = -(-sum(map(len, raw)) // P8.blocks)
    block, held, own = 0, 0, []
    for t in raw:
        if held and held + len(t) > size:
            block, held = block + 1, 0
        held += len(t)
        own.append(block)
    assert len(set(own)) >= 4
    counts = np.zeros(256, int)
    for t in raw:
        for b in t:
            counts[b] += 1
    code = lm.huffman(counts)
    got = {r.doc_id: r for r in lm.score(docs, p=P8).collect()}
    for i, t in enumerate(raw):
        want = slow_bits(t, [x for j, x in enumerate(raw) if own[j] != own[i]], code, P8)
        assert got[i].bytes == len(t) and got[i].bits == pytest.approx(want, rel=1e-3, abs=1e-6), i
        assert got[i].bits_per_byte == (pytest.approx(want / len(t), rel=1e-3) if t else None)


def test_a_text_is_one_run_of_steps():
    begin = lm.steps(1_000_000, 32)
    assert begin[:4].tolist() == [0, 32, 64, 96] and (np.diff(begin) >= 32).all() and len(begin) < 700
    assert (np.diff(begin)[1:] <= np.maximum(32, begin[1:-1] / 64)).all()


def test_bits_of_tables(docs, empty, clashing):
    p = lm.Params(blocks=8)
    for table in (docs, clashing):
        got = lm.score(table, p=p).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus())
        by = {r.doc_id: r for r in got}
        assert by[102].bytes == by[103].bytes == 0 and by[102].bits == 0 and by[103].bits_per_byte is None
        assert all(0 < r.bits_per_byte < 6 for r in got if r.bytes > 200)
        assert by[105].bytes == len(corpus()[65][1].encode()) or by[105].bytes > 100_000
    assert lm.score(empty, p=p).count() == 0


def test_a_copy_elsewhere_lowers_the_bits(spark):
    rng = random.Random(9)
    rare = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    rows = [(i, words(rng, rare, 60)) for i in range(80)]
    rows.append((100, rows[3][1]))  # far from the first: in another block
    got = {r.doc_id: r.bits_per_byte for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    others = sorted(v for k, v in got.items() if k not in (3, 100))
    assert max(got[3], got[100]) < others[0]


# 9 near-duplicates


def test_minmax_estimates_jaccard():
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    p = minhash.Params(perms=256)
    for share in (0.0, 0.1, 0.3):
        other = [f"x{i}" if rng.random() < share else w for i, w in enumerate(base)]
        sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (base, other)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        sig, _ = minhash.signatures(pa.array([" ".join(base), " ".join(other)]), p)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.09


def test_linkage_and_components_by_brute_force(spark):
    rng = np.random.default_rng(0)
    for _ in range(20):
        sig = rng.integers(0, 3, (12, 8)).astype(np.uint8)
        parent = list(range(12))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in itertools.combinations(range(12), 2):
            if (sig[a] == sig[b]).sum() >= 5:
                parent[find(a)] = find(b)
        want = {frozenset(i for i in range(12) if find(i) == r) for r in map(find, range(12))}
        edges = minhash.linkage(sig, 5)
        parent = list(range(12))
        for a, b in zip(*edges):
            parent[find(a)] = find(b)
        assert {frozenset(i for i in range(12) if find(i) == r) for r in map(find, range(12))} == want
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_large_buckets_lose_no_link(spark):
    # one bucket holds most rows: a chain that only neighbours link, copies, and rows alone
    rng = np.random.default_rng(2)
    p = minhash.Params(perms=16, chunk=16)
    chain = np.repeat(rng.integers(0, 256, (1, 32)), 40, 0)
    for i in range(1, 40):
        chain[i] = chain[i - 1]
        chain[i, rng.choice(32, 12, replace=False)] = rng.integers(0, 256, 12)
    sig = np.concatenate([chain, np.repeat(rng.integers(0, 256, (1, 32)), 100, 0), rng.integers(0, 256, (60, 32))]).astype(np.uint8)
    rows = [(b, n, i, sig[i].tobytes()) for b, own in ((1, range(200)), (2, range(190, 200)), (3, range(5))) for n in [len(own)] for i in own]
    members = spark.createDataFrame(rows, "bucket long, n long, rid long, sig binary")
    got = {r.node: r.root for r in minhash.components(minhash.bucket_edges(members, p)).collect()}
    need = minhash.share(p.threshold) * 32 - 1e-9
    root = list(range(200))
    for _ in range(200):
        before = root[:]
        for a, b in itertools.combinations(range(200), 2):
            if (sig[a] == sig[b]).sum() >= need:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert {i: got.get(i, i) for i in range(200)} == dict(enumerate(root)) and len(set(root)) < 110


def test_groups_by_brute_force(spark):
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [words(rng, vocabulary, 150).split() for _ in range(12)]
    texts = []
    for i in range(60):
        t = list(base[i % 12])
        for k in rng.sample(range(150), rng.choice([0, 3, 10, 60])):
            t[k] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    p = minhash.Params()
    sig = minhash.signatures(pa.array(texts), p)[0]
    bands = sig.reshape(60, p.bands, -1)
    root = list(range(60))
    for _ in range(60):
        for a, b in itertools.combinations(range(60), 2):
            meet = (bands[a] == bands[b]).all(1).any()
            if meet and (sig[a].astype(np.uint8) == sig[b].astype(np.uint8)).sum() >= minhash.share(p.threshold) * 128 - 1e-9:
                root[a] = root[b] = min(root[a], root[b])
    got = minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in got} == dict(enumerate(root)) and len(set(root)) < 50


def test_near_duplicates(spark, docs, empty, clashing):
    rng = random.Random(11)
    base = [words(rng, [f"v{i}" for i in range(4000)], 120).split() for _ in range(8)]
    rows = []
    for i, b in enumerate(base):
        for k in range(1 if i > 4 else 12):
            t = list(b)
            if k:
                t[rng.randrange(len(t))] = f"edit{k}"
            rows.append((100 * i + k, " ".join(t)))
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.group_id) for r in got} == {(d, d - d % 100) for d, _ in rows}
    assert sum(r.kept for r in got) == len(base)
    for table in (docs, clashing):
        left = minhash.distinct(table)
        assert left.columns == table.columns
        kept = Counter(r.doc_id for r in left.collect())
        assert kept[3] == 1 and not kept[100] and not kept[101]  # exact and near copies
        assert kept[7] == 1 and not kept[None]  # repeated outright; a NULL id gives way
        assert all(kept[i] == 1 for i in (102, 103, 104, 105))
    assert minhash.groups(empty).count() == 0 and minhash.distinct(empty).count() == 0


# 10 sharding


def test_differencing_by_brute_force():
    rng = random.Random(10)
    for _ in range(60):
        k, n = rng.randint(2, 4), rng.randint(1, 9)
        sizes = [rng.randint(0, 40) for _ in range(n)]
        parts = [(i, np.array([v] + [0] * (k - 1))) for i, v in enumerate(sizes)]
        sums, place = sharding.difference(parts, k)
        real = [0] * k
        for i, v in enumerate(sizes):
            real[place[i][0]] += v
        assert sorted(real, reverse=True) == sums.tolist() and real == sums.tolist()
        state = [(v - 0, -i, [v] + [0] * (k - 1)) for i, v in enumerate(sizes)]  # the plain rule
        while len(state) > 1:
            state.sort(key=lambda x: (-x[0], -x[1]))
            a, b = state.pop(0), state.pop(0)
            s = sorted((x + y for x, y in zip(a[2], b[2][::-1])), reverse=True)
            state.append((s[0] - s[-1], max(a[1], b[1]), s))
        assert state[0][2] == sums.tolist()


def test_shards(docs, empty, clashing):
    p = sharding.Params(shards=4, bucket_groups=7, fan=3)
    rows = corpus()
    for table in (docs, clashing):
        got = sharding.shard(table, p=p).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        text = {}
        for r in rows:
            text.setdefault(r[0], r[1])
        shard = {}
        load = Counter()
        for r in got:
            assert shard.setdefault(text[r.doc_id], r.shard) == r.shard
            load[r.shard] += r.bytes
            assert r.bytes == len((text[r.doc_id] or "").encode())
        rest = sorted(load.values())[:-1]  # the very long text has a shard of its own
        largest = max(len((r[1] or "").encode()) for r in rows if r[0] != 105)
        assert max(rest) - min(rest) <= largest
    assert sharding.shard(empty).count() == 0


def plain_difference(parts):
    """(sums, for each key where its parts lie) by the rule, with lists; ``parts`` are (key, sums)."""
    state = [(s, k, {k: list(range(len(s)))}) for k, s in parts]
    while len(state) > 1:
        state.sort(key=lambda x: (-(x[0][0] - x[0][-1]), x[1]))
        (s, k, at), (t, m, to) = state[:2]
        total = [a + b for a, b in zip(s, t[::-1])]
        order = sorted(range(len(total)), key=lambda i: -total[i])
        new = {old: i for i, old in enumerate(order)}
        both = {x: [new[i] for i in p] for x, p in at.items()} | {x: [new[len(s) - 1 - i] for i in p] for x, p in to.items()}
        state = [*state[2:], ([total[i] for i in order], min(k, m), both)]
    return state[0][0], state[0][2]


def test_shards_in_levels_by_brute_force(spark):
    rng = random.Random(15)
    texts = ["x" * rng.randint(1, 400) + str(i) for i in range(90)] + [None, "", None, ""]
    p = sharding.Params(shards=3, bucket_groups=10, fan=4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.shard(docs, p=p).collect()}
    assert got[90] == got[92] and got[91] == got[93]
    buckets = -(-92 // p.bucket_groups)
    text = F.col("text")
    g = F.struct(F.xxhash64(text).alias("g1"), F.xxhash64(F.reverse(text), F.lit(1)).alias("g2"))
    rows = docs.select("doc_id", F.pmod(F.xxhash64(g), F.lit(buckets)).alias("b"), g.alias("g")).filter("doc_id < 92").collect()
    size = lambda r: len((texts[r.doc_id] or "").encode())
    place, level = {}, []
    for b in sorted({r.b for r in rows}):
        own = sorted((r for r in rows if r.b == b), key=lambda r: (-size(r), r.g.g1, r.g.g2))
        sums, at = plain_difference([(i, [size(r)] + [0] * (p.shards - 1)) for i, r in enumerate(own)])
        place |= {r.doc_id: (b, at[i][0]) for i, r in enumerate(own)}
        level.append((b, sums))
    count = buckets
    while True:
        above = -(-count // p.fan)
        done = []
        for a in range(above):
            parts = sorted(x for x in level if x[0] % above == a)
            if parts:
                sums, at = plain_difference(parts)
                place = {d: (a, at[b][i]) if (b % above == a and b in at) else (b, i) for d, (b, i) in place.items()} if above == 1 else {d: ((a, at[b][i], 1) if len(v) == 2 and b % above == a else v) for d, v in place.items() for b, i in [v[:2]]}
                done.append((a, sums))
        place = {d: v[:2] for d, v in place.items()}
        if above == 1:
            break
        level, count = done, above
    assert {d: got[d] for d in place} == {d: i for d, (_, i) in place.items()}


# pipeline


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, vocabulary = labelled(120)
    rng = random.Random(12)
    item = words(rng, vocabulary, 25)
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(500, rows[1][1], "en", "s", 1), (501, words(rng, vocabulary, 40) + " " + item, "en", "s", 1), (502, None, "en", "s", None), (503, "", None, "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    have = {r.doc_id for r in got}
    clean = {i for i, _, y in rows if not y}
    assert len(have & clean) >= 0.93 * len(clean)
    assert len(have & ({i for i, _, y in rows if y})) <= 2
    assert 500 not in have and 502 not in have and 503 not in have
    size = Counter()
    for r in got:
        size[r.doc_id] += r.end_token - r.start_token
    assert size[501] == 40  # the passage is gone
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
