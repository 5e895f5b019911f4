"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strideflow.llm import bpe, chat, decontaminate, eliasfano, forest, graph, html, jaccard, knn, langid, lm, queries, textops

WORD = re.compile(r"[^\x20\x09-\x0d]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, score string, n_tokens string, kept string, component_id string"


def table(spark, data, name):
    return queries.table(spark, data, name)


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and further columns whose names clash."""
    long = " ".join(f"word{k % 700} and{k % 13}," for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (None, None), (6, long), (7, long + " x"), (8, "x" * 3000), (9, "é " * 50), (10, "1234 5678 !!"), (11, "<|endoftext|> b  c\n \n d")]
    return spark.createDataFrame([(i, t, None if i and i % 2 else "en", "s", "n", "k", "c") for i, t in rows], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


# ---- tokenisation


def test_words_and_windows_match_python():
    random.seed(0)
    texts = ["".join(random.choice([" ", "\n", "\t", "a", "B", "é", "Ü", "日", "x1", "\x0b", "\u00a0", ""]) for _ in range(random.randint(0, 40))) for _ in range(300)] + [None]
    seen = []
    for rows, w in textops.chunks(pa.array(texts), limit=200):
        hashes = w.hashes()
        for k in range(rows.stop - rows.start):
            s, e = w.first[k], w.first[k + 1]
            assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start[s:e], w.end[s:e], strict=True)] == words(texts[rows.start + k])
        seen += list(zip((bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)), hashes.tolist(), strict=True))
    assert len(set(seen)) == len({a for a, _ in seen}) == len({b for _, b in seen})


# ---- 1


def test_chats_read_back(spark, data):
    extra = [(-8, 0, "user", "a\\"), (-8, 1, "user", "\\</s>"), (-8, 2, "user", None), (-8, 3, "assistant", "x\n</s>\\\\[SEP]\n[SEP]"), (-8, 3, "assistant", "x\n</s>\\\\[SEP]\n[SEP]"), (None, None, None, None), (-9, 1, "assistant", "")]
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, data, "conversations").collect()] + extra
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_sql(spark, data):
    import oracle

    assert oracle.compare(queries.op1_chat_format(spark, data), oracle.connect(data), queries.ORACLE_SQL["op1_chat_format"]) == ""


def test_chat_plan_is_native(spark, data):
    plan = queries.op1_chat_format(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- 2


def test_base_score(spark, data, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 2000)
    monkeypatch.setattr(lm, "START_IDS", 20_000)
    monkeypatch.setattr(lm, "STEPS", 100)
    docs = table(spark, data, "documents").select("doc_id", "text").limit(80).unionByName(odd_documents(spark).select("doc_id", "text"))
    docs = spark.createDataFrame([(*r, "s", "n", "r") for r in docs.collect()], "doc_id long, text string, score string, n_tokens string, row_id string")
    got = [tuple(r) for r in lm.score_documents(docs).collect()]
    rows = docs.collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = collections.Counter(w for r in rows if not held(r.doc_id) for w in [*words(r.text), "\0end"])
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(r.doc_id), len(words(r.text)) + 1, sum(counts[w] > 0 for w in [*words(r.text), "\0end"]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(r.text), "\0end"]), 4)) for r in rows)
    assert sorted((str(g[0]), g[2], g[3], round(g[5], 4)) for g in got) == expected
    assert all(g[1] == held(g[0]) and g[4] == n and g[6] < 0 for g in got)


def test_attention_scores_sum_to_one_and_depend_on_the_past_alone():
    rng = np.random.default_rng(0)
    sequences = [rng.integers(0, 30, n).astype(np.int32) for n in (1, 15, 16, 17, 70)]
    model = lm.Attention(rng.integers(0, 50, 31).astype(float), sequences)
    losses = model.train(sequences, steps=60)
    assert np.mean(losses[-5:]) < losses[0]
    start = sequences[4][:20]
    total = sum(np.exp(model.token_logs([np.append(start, np.int32(i))])[-1]) for i in range(31))
    assert abs(total - 1) < 1e-3
    one = model.token_logs([sequences[4]])
    np.testing.assert_allclose(model.token_logs([sequences[4][:33]]), one[:33], atol=1e-4)
    np.testing.assert_allclose(model.token_logs(sequences)[-70:], one, atol=1e-4)


def brute_logs(model, sequence):
    """The model's formula, one target after another."""
    w, inputs, out = model.w, [model.begin, *sequence[:-1]], []
    for t, target in enumerate(sequence):
        first = max(0, t // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE))
        x = w["e"][inputs[first : t + 1]].astype(float)
        score = (x @ w["k"]) @ (x[-1] @ w["q"]) / math.sqrt(lm.WIDTH) + w["near"][np.arange(t - first, -1, -1)]
        weight = np.exp(score - score.max())
        h = np.concatenate([x[-1], weight @ (x @ w["v"]) / weight.sum()])
        g = np.concatenate([np.maximum(h @ w["f"] + w["fb"], 0), x[-1]])
        m, k = model.group[target], model.slot[target]
        top, part = g @ w["o"] + w["ob"], g @ w["p"][m] + w["pb"][m]
        out.append(top[m] - np.logaddexp.reduce(top) + part[k] - np.logaddexp.reduce(part) + model.within[target])
    return np.array(out)


def test_scores_equal_the_formula():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 60, n).astype(np.int32) for n in (1, 3, 16, 50)]
    model = lm.Attention(rng.integers(0, 9, 61).astype(float), sequences)
    model.train(sequences, steps=40)
    expected = np.concatenate([brute_logs(model, s) for s in sequences])
    np.testing.assert_allclose(model.token_logs(sequences), expected, atol=1e-3)
    inputs, targets, _ = model.windows(sequences)
    np.testing.assert_allclose(model._shifted(inputs, targets.ravel()), expected, atol=1e-3)


def test_gradients():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 20, 40).astype(np.int32)]
    model = lm.Attention(np.ones(21), sequences)
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    inputs, targets, _ = model.windows(sequences)
    loss, grad = model.step(inputs, targets)
    for name, place in (("q", (1, 2)), ("k", (3, 0)), ("v", (2, 2)), ("near", (1,)), ("f", (20, 5)), ("fb", (3,)), ("o", (4, 6)), ("ob", (2,)), ("p", (model.group[sequences[0][5]], 3, model.slot[sequences[0][5]])), ("e", (int(sequences[0][2]), 4))):
        model.w[name][place] += 1e-4
        more = model.step(inputs, targets)[0]
        model.w[name][place] -= 1e-4
        if name == "e":
            used, de = grad["e"]
            own = de[np.flatnonzero(used == place[0])[0], place[1]]
        else:
            own = grad[name][place]
        assert abs((more - loss) / 1e-4 - own) < 2e-3, name


def test_every_segment_is_drawn_at_one_rate():
    draws = [len(lm.drawn_segments([b"x"] * n, key, 8)) for key in range(400) for n in (0, 63, 64, 640)]
    assert abs(sum(draws) / (400 * 15) - lm.ROUNDS / 8) < 0.03
    assert sorted(s for _, s in lm.drawn_segments([b"x"] * 700, 5, lm.ROUNDS)) == list(range(11))


def test_training_windows_and_rounds(spark, monkeypatch):
    """With every segment drawn, the targets are the ids of all training texts, and a round lowers the loss."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 150) % 300) for _ in range(40)] + ["", None]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = bpe.default_vocabulary()
    tokens = lm.SubwordTable(path)
    tokens.add({w for t in texts for w in lm.words(t)})
    sequences = [tokens.sequence(lm.words(t)) for t in texts]
    model = lm.Attention(np.bincount(np.concatenate(sequences), minlength=tokens.size + 1).astype(float), sequences)
    rows = lm.training_windows(train, model, path, lm.ROUNDS)
    targets = np.concatenate([np.frombuffer(r.targets, model.kind) for r in rows.collect()])
    assert np.array_equal(np.sort(targets[targets < model.pad]), np.sort(np.concatenate(sequences)))
    before = model.token_logs(sequences).mean()
    rows = spark.createDataFrame(rows.collect(), rows.schema).repartition(2)
    for _ in range(3):
        lm.average_round(rows.select("inputs", "targets"), model)
    assert model.token_logs(sequences).mean() > before


# ---- 3


def test_classifier_on_the_held_out_fold(spark, data):
    labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    got = knn.classify(table(spark, data, "documents"), table(spark, data, "labels")).collect()
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    fold = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in fold]) > 0.9


def test_classifier_neighbours_are_exact():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((200, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    space = knn.Space(np.zeros((knn.TERMS, 8), np.float32), v, rng.integers(0, 2, 200).astype(float), 0.4)
    q = v[:30] + np.float32(0.1)
    for x, got in zip(q, space.score(q), strict=True):
        s = v @ x
        top = np.argsort(-s)[: knn.NEIGHBOURS]
        weight = np.maximum(s[top].astype(float), 0) ** 4
        assert abs((weight * space.labels[top]).sum() / weight.sum() - got) < 1e-5


# ---- 4


def counts_of(text):
    found = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 5)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rule_counts(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    got = sorted(tuple(map(str, r)) for r in forest.count_statistics(docs).select("doc_id", *forest.COUNTS).collect())
    assert got == sorted(tuple(map(str, (r.doc_id, *counts_of(r.text)))) for r in docs.collect())


def test_rules_keep_good_and_drop_bad(spark, data):
    labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    got = forest.quality_rules(table(spark, data, "documents"), table(spark, data, "labels")).collect()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    kept = {q: np.mean([r.kept for r in got if labels.get(r.doc_id) == q and not (q and r.base_failed)]) for q in (0, 1)}
    assert kept[0] < 0.1 and kept[1] > 0.95


def test_path_lengths():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((300, 2)), [[9.0, 9.0]]])
    s = forest.IsolationForest(x).score(x)
    assert s.argmax() == 300


# ---- 5


def shingle_set(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[i].append(shingle_set(t))
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = collections.defaultdict(set)
    for i in root:
        for s in sets[i]:
            for t in s:
                owners[t].add(i)
    pairs = {p for o in owners.values() for p in itertools.combinations(sorted(o), 2)}
    for a, b in pairs:
        if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in root}


def test_links_and_components(spark, data):
    rng = random.Random(3)
    base = [f"v{k}" for k in range(120)]
    near = []
    for i in range(70):  # a chain: neighbours link, ends do not; sizes differ
        w = list(base)
        for k in range(i // 10):
            w[(11 * k + 3) % 120] = f"z{k}"
        near.append((10_000 + i, " ".join(w[: 120 - i % 7] + [f"q{rng.randint(0, 5)}"])))
    passage = " ".join(f"p{k}" for k in range(60))
    shared = [(20_000 + i, f"{passage} " + " ".join(f"u{i}x{k}" for k in range(3 + i % 25))) for i in range(60)]
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()] + near + shared + [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    rows = [(None if i is None else i + 100_000 * (k >= len(rows) - 14), t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.link_components(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    expected = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert all(r.component_id is None for r in got if r.doc_id is None)
    sizes = collections.Counter((str(i), len(shingle_set(t))) for i, t in rows)
    assert collections.Counter((str(r.doc_id), r.n_shingles) for r in got) == sizes


def test_linked_sets_share_a_key():
    """The prefix scheme by itself: sets that link at sizes from 1 to 600 share a key, whatever the classes of their tokens."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 80), 127, 128, 160, 255, 256, 300, 320, 600]:
        for share in (0.0, 0.5, 1.0):
            common = rng.integers(0, 1 << 62, n, np.uint64)
            common = np.where(rng.random(n) < share, common | jaccard.TOP, common)
            room = len(common) * 20 // 80
            other = rng.integers(0, 1 << 62, room, np.uint64) | np.where(rng.random(room) < share, jaccard.TOP, np.uint64(0))
            cut = rng.integers(0, room + 1)
            x, y = np.unique(np.concatenate([common, other[:cut]])), np.unique(np.concatenate([common, other[cut:]]))
            assert 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
            keys = [set(np.concatenate(jaccard.prefix_keys(t)).tolist()) for t in (x, y)]
            assert keys[0] & keys[1], (n, share)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, **{k: 100 for k in range(101, 160)}}


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (2, "other", "z"), (None, "a b c d e f g", "w")], "doc_id long, text string, other_id string")
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(df).collect()) == ["1", "2", "None"]


# ---- 6

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">Accept</div><main><article><header><h1>Title &amp; co</h1></header><p>One<p>Two &lt;b&gt; <em>x</em>y<br>z
<div class="ad box">Buy</div><p class="share">Share me<p>Three<form>Mail <input> <button>Go</button></form><section class="comments"><article><p>Nice!</p></article></section></article></main><aside>Side</aside><footer>foot</footer>"""


def test_article_text():
    assert html.main_text(html.page_lines(PAGE), None) == "Title & co One Two <b> xy z Three"
    assert html.page_lines(None) == html.page_lines("") == [] and html.page_lines("a < b") == [("a < b", 0)]


def test_broken_markup():
    text = lambda page: html.main_text(html.page_lines(page), None)
    assert text("<html><head><title>x</title><meta charset=utf-8><body><p>One<p>Two") == "One Two"
    assert text("<article><p>One</p><div><select><option>a</div><p>Two</p></article>") == "One Two"
    assert text('<article><div class="article-header"><h1>Title</h1></div><p>One</p><div class="site-header">x</div></article>') == "Title One"
    assert text("<p>a</p><svg><p>b</p>") == "a b" and text("<p>a</p><svg><text>b</text></svg><p>c") == "a c"


def brute_extract(rows):
    """Each page against its nearest neighbour in the order of all pages."""
    def place(url):
        m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)", url or "")
        return (m[1] or "").lower(), m[2]

    rows = sorted(rows, key=lambda r: (*place(r[1]), r[0]))
    out = {}
    for k, (i, url, page) in enumerate(rows):
        near = []
        for rank, j in ((1, k - 1), (0, k + 1)):
            if 0 <= j < len(rows) and place(rows[j][1])[0] == place(url)[0]:
                near.append((html._shared_prefix(place(url)[1], place(rows[j][1])[1]), rank, rows[j][2]))
        out[i] = html.main_text(html.page_lines(page), html.page_lines(max(near, key=lambda n: n[:2])[2]) if near else None)
    return out


def test_extraction_equals_brute_force_whatever_the_partitions(spark, data):
    frame = "<div>Site name</div><p>{}</p><p>{}</p><div>All pages say this</div>"
    rows = [(r.page_id, r.url, r.html) for r in table(spark, data, "pages").collect()] + [(10_000 + k, f"http://h{k % 3}/a/{k // 7}/{k}", frame.format(f"one {k}", f"two {k}")) for k in range(90)]
    rows += [(20_000, None, None), (20_001, None, ""), (20_002, "http://h1/a", "<p>x" * 3000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    expected = brute_extract(rows)
    for n in ("1", "4", "17"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = html.extract(df).collect()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == expected
    assert html.extract(df.limit(0)).collect() == []
    assert len(html.extract(df.where("page_id >= 20000").union(df.where("page_id >= 20000"))).collect()) == 6


def test_long_pages_take_little_memory():
    a, b = ([f"x{k * m % 997}" for k in range(3000)] for m in (5, 7))
    pairs = html.common_lines(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False)) and len(pairs) > 100


def test_shared_lines_go(spark):
    frame = "<div>Site name</div><p>{}</p><p>{}</p><div>All pages say this</div>"
    rows = [(1, "http://h/a/1", frame.format("one", "two")), (2, "http://h/a/2", frame.format("three", "four")), (3, "http://g/a", PAGE), (4, None, None), (5, "http://h/a/3", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).coalesce(1).collect()}
    assert got[3] == "Title & co One Two <b> xy z Three" and got[4] == got[5] == ""
    assert {"one", "two"} <= set(got[1].split()) and {"three", "four"} <= set(got[2].split())


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(2))
        pairs = html.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        best = max(n for n in range(len(a) + 1) if any(_is_sub(c, b) for c in itertools.combinations(a, n)))
        assert len(pairs) == best


def _is_sub(c, b):
    rest = iter(b)
    return all(x in rest for x in c)


# ---- 7


def test_leaks(spark, data):
    items, docs = table(spark, data, "benchmark").collect(), table(spark, data, "documents").collect()
    planted = {(d.doc_id, i.item_id) for d in docs for i in items if i.text.strip() in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, data, "documents"), table(spark, data, "benchmark")).collect()}
    assert planted and planted <= got
    five = lambda t: set(zip(*[words(t)[k:] for k in range(5)], strict=False))
    by_id = {d.doc_id: d.text for d in docs}, {i.item_id: i.text for i in items}
    assert all(len(five(by_id[0][d]) & five(by_id[1][i])) >= 0.4 * len(five(by_id[1][i])) for d, i in got)


def test_slots_have_to_be_consistent(spark):
    item = "Then Alice Brown has 12 apples and gives 5 km of them to Bob today for free. But then Bob eats 12 of them."
    same, other = item.replace("12", "17").replace("Bob", "Tom"), item.replace("12", "17", 1).replace("Bob", "Tom", 1)
    docs = [(1, f"x y. {same} z"), (2, f"x y. {item} z"), (3, "nothing here"), (4, f"x y. {other} z"), (None, item), (5, None), (6, "")]
    b = spark.createDataFrame([(7, item), (8, None), (9, "one two"), (10, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert got[1].reparameterised and not got[2].reparameterised and got[2].coverage == 1.0 and set(got) <= {1, 2, 4}
    assert 4 not in got or got[4].coverage < 1.0
    kept = decontaminate.drop_leaked(spark.createDataFrame(docs, "doc_id long, text string"), b)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "5", "6", "None"] + ["4"] * (4 not in got))


# ---- 8 and 9


def test_ids_equal_the_library(spark, data):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    docs = table(spark, data, "documents").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        expected.append((str(r.doc_id), len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.decode(ids, skip_special_tokens=False).encode())))
    assert sorted((str(a), *b) for a, *b in map(tuple, bpe.encode_decode_digest(docs).collect())) == sorted(expected)


def test_word_table_equals_the_library_on_any_text():
    t, table_ = Tokenizer.from_file(bpe.default_vocabulary()), bpe.WordTable(bpe.default_vocabulary())
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "\u00a0", "\u3000", "'s", "'ll", "!", "<|endoftext|>", "日本", "🙂", "\x1c", "\x85", "\u200b", "\r\n", "e\u0301", "x" * 1200, "<|endof", "text|>"]
    random.seed(4)
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(texts, table_.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_with_white_space_inside_are_encoded_with_the_others(monkeypatch):
    """Only first words, which have no space before them, go through the library one by one."""
    table_, alone = bpe.WordTable(bpe.default_vocabulary()), []
    own = table_._encode
    monkeypatch.setattr(table_, "_encode", lambda texts: alone.extend(texts) or own(texts))
    texts = ["first one\ntwo three\tfour five", "", "first \u00e9\u00a0b  c", None, "first\n\nd e\n\nf"] * 3
    t = Tokenizer.from_file(bpe.default_vocabulary())
    for text, ids in zip(texts, table_.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert set(alone) == {"first", "first\n\nd", " "}


def test_chunks_and_repeated_words_over_tasks(spark):
    """Every word is wanted by many chunks, and batches end within a bucket's rows."""
    t = Tokenizer.from_file(bpe.default_vocabulary())
    texts = ["a b  c", "", None, "x\0 y z", "a <|endoftext|> b ", " lead", "\n\n q"] + [" ".join(f"w{j % 40}" for j in range(k)) for k in range(60)]
    docs = spark.createDataFrame([(None if k % 9 == 4 else -k, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    split = spark.createDataFrame(bpe.split_texts(docs, ["<|endoftext|>"], 5, 50).collect(), "chunk long, kind int, at long, body binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = bpe.by_position(split, bpe.default_vocabulary(), lambda ids: [pa.array([i.tobytes() for i in ids], pa.binary())], "doc_id long, ids binary").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = [(str(r.doc_id), np.array(t.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in docs.collect()]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted(expected)


def test_pack():
    numbers = np.array([0, 0, 1, 2, 1, 3, 0, 4], "<u4")
    assert bpe.code_new(numbers, 0).tolist() == [0, 1, 0, 0, 2, 0, 1, 0]
    for before in (0, 2, 5):
        assert bpe.number_new(bpe.code_new(numbers, before), before).tolist() == numbers.tolist()
    parts = [np.array(x, "<u4") for x in ([], [1, 2**32 - 1], [], [7])]
    assert [x.tolist() for x in bpe.unpack(bpe.pack(parts))] == [x.tolist() for x in parts] and bpe.unpack(bpe.pack([])) == []
    for codes in ([], [0], [127, 128, 255, 256, 32639, 32640, 394_000, 2**31 - 1, 0]):
        assert bpe.unpack_codes(bpe.pack_codes(np.array(codes, np.int64))).tolist() == codes
    for words in ([], ["a", "", " \u00df"]):
        assert bpe.unpack_words(bpe.pack_words(pa.array(words, pa.large_string()))) == words
    for ids in ([], [b""], [b"\1\0\0\0", b""], [b"\1\0\1\0\2\0\0\0", b"\0\0\0\0"]):
        lengths, flat = bpe.unpack_ids(bpe.pack_ids(ids))
        assert (lengths * 4).tolist() == list(map(len, ids)) and flat.tobytes() == b"".join(ids)


def test_files_hold_all_ids(spark, data):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    docs = spark.createDataFrame([(r.doc_id - 50, r.text) for r in table(spark, data, "documents").collect()] + [(None, "null id"), (None, None)], "doc_id long, text string")
    at = 0
    got = {r.doc_id: r for r in eliasfano.write_read_digest(docs).where("doc_id IS NOT NULL").collect()}
    for text in sorted([x.text or "" for x in docs.where("doc_id IS NULL").collect()]):
        at += len(t.encode(text, add_special_tokens=False).ids) + 1
    for r in sorted(docs.where("doc_id IS NOT NULL").collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_elias_fano():
    rng = random.Random(2)
    for n, u in ((0, 1), (1, 0), (1, 10**12), (5, 3), (1000, 10**6), (3000, 100), (700, 2**40)):
        v = sorted(rng.randint(0, u) for _ in range(n))
        e = eliasfano.EliasFano(code := eliasfano.ef_encode(np.array(v, np.int64)))
        assert e.values().tolist() == v and [e.select(i) for i in range(n)] == v
        assert n < 500 or 8 * len(code) / n < 3.5 + max(0, math.log2(u / n))
    with pytest.raises(IndexError):
        e.select(700)


# ---- 10


def test_forward_sums_all_segmentations():
    model = langid.PieceModel([b"ab", b"bc", b"abc"], ["x", "y"])
    model.prob[:-1] = np.random.default_rng(0).random((len(model.pieces), 2))

    def brute(word, k):
        return 1.0 if not word else sum(model.prob[model.index[word[:n]], k] * brute(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in model.index)

    found = [b"a", b"abc", b"cab", b"abcabc", b"zz"]
    for word, got in zip(found, model.score(found), strict=True):
        np.testing.assert_allclose(got, np.log([brute(word, k) for k in range(2)]), rtol=1e-9)
        np.testing.assert_allclose(model.log_probability(word), got, rtol=1e-9)


def test_languages_on_the_held_out_fold(spark, data):
    truth = {r.doc_id: r.lang for r in table(spark, data, "documents").collect()}
    got = langid.identify(table(spark, data, "documents")).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.95


# ---- odd and empty tables


def labels_of(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 0, 0), (9, 1, None), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")


APPLY = {
    "rules": lambda spark, d: forest.quality_rules(d, labels_of(spark)),
    "keep_good": lambda spark, d: forest.keep_good(d, labels_of(spark)),
    "classify": lambda spark, d: knn.classify(d, labels_of(spark)),
    "languages": lambda spark, d: langid.identify(d),
    "keep_identified": lambda spark, d: langid.keep_identified(d),
    "components": lambda spark, d: jaccard.link_components(d),
    "keep_one": lambda spark, d: jaccard.keep_one(d),
    "leaks": lambda spark, d: decontaminate.leaks(d, d.selectExpr("doc_id AS item_id", "text")),
    "ids": lambda spark, d: eliasfano.write_read_digest(d),
    "round_trip": lambda spark, d: bpe.encode_decode_digest(d),
}
ONE_EACH = {"rules", "classify", "languages", "components", "ids", "round_trip"}


@pytest.mark.parametrize("name", APPLY)
def test_odd_and_empty_tables(spark, name):
    docs = odd_documents(spark)
    got = APPLY[name](spark, docs).collect()
    assert len(got) == docs.count() if name in ONE_EACH else True
    assert APPLY[name](spark, docs.limit(0)).collect() == []
    if name.startswith("keep"):
        assert APPLY[name](spark, docs).columns == docs.columns


def test_empty_scoring(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 2)
    assert lm.score_documents(odd_documents(spark).limit(0)).collect() == []
