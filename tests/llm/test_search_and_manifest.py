"""Hard negatives, min-max near copies and the Merkle manifest: against their SQL, brute force and on odd tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import oracle
import pytest

from strideflow.llm import merkle, minhash, negatives, queries, textops

WORD = re.compile(r"[^\x20\x09-\x0d]+")
ASCII_LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_minhash_dedup", "op13_merkle_manifest"])
def test_query_agrees_with_its_sql(spark, data, name):
    assert oracle.compare(queries.QUERIES[name](spark, data), oracle.connect(data), queries.ORACLE_SQL[name]) == ""


# ---- 11


def brute_negatives(rows):
    seen = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(x))) for x in v]
        own = ((label + 1) % 10 if i % 7 == 0 else label, whole)
        seen[i] = min(seen.get(i, own), own)
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  a shorter vector ends in zeros
    out = []
    for a in (i for i in seen if i % 100 == 0):
        ranked = sorted((-score(seen[a][1], v), i, label == seen[a][0]) for i, (label, v) in seen.items() if i != a)
        for p, i, _ in [x for x in ranked if x[2]][:5]:
            window = [(-s, j) for s, j, same in ranked if not same and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, i, k + 1, j, -p, s) for k, (s, j) in enumerate(window)]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in negatives.mine(df).collect())


SCHEMA = "vec_id long, embedding array<float>, label int, score string, list string, anchor string, rank string"


@pytest.mark.parametrize("sizes", [(1024, 4096, 65536), (7, 20, 2)])
def test_negatives_match_brute_force(spark, monkeypatch, sizes):
    """Ties, a vector that a third of the rows share, rows that take no part, vectors of other lengths, repeated and clashing ids; also with tiny blocks and dealt visitors."""
    for name, value in zip(("BLOCK", "FIRST", "VISITORS"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 0.3, (12, 8))
    rows = [(int(i), [float(np.float32(x)) for x in (centre[i % 12] + rng.normal(0, 0.05, 8) if i % 3 else centre[0])], int(rng.integers(0, 3))) for i in range(900)]
    rows += [(1000, None, 1), (1001, [0.5, None] + [0.0] * 6, 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 1), (1004, [0.1] * 8, None), (None, [0.1] * 8, 1)]
    rows += [(1100, [0.5], 1), (1200, [], 1), (1005, [0.25] * 11, 2), rows[3], rows[3], (5, [9.0] * 8, 0), (1300, [0.1] * 8, 77)]
    df = spark.createDataFrame([(*r, "s", "l", "a", "r") for r in rows], SCHEMA).repartition(5)
    got, expected = mined(df), brute_negatives(rows)
    assert got == expected and len(got) > 100


def test_negatives_of_odd_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [], 1, "", "", "", ""), (100, [], 1, "", "", "", "")], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [1e30], 1, "", "", "", ""), (100, [1e30], 1, "", "", "", ""), (1, [1e30], 2, "", "", "", "")], SCHEMA)) == [(0, 1, 1, 100, 1 << 52, 1 << 52)]


def test_lists_are_skipped_by_their_bounds():
    rng = np.random.default_rng(0)
    x, centroids = rng.normal(0, 100, (50, 6)).round(), rng.normal(0, 100, (5, 6))
    own = negatives.nearest(x, centroids)
    radius = np.array([np.sqrt(((x[own == c] - centroids[c]) ** 2).sum(1)).max(initial=0) for c in range(5)])
    low, high = negatives.bounds(x, centroids, radius)
    score = x @ x.T
    for c in range(5):
        assert (score[:, own == c] <= high[:, [c]]).all() and (score[:, own == c] >= low[:, [c]]).all()


# ---- 12


def brute_components(rows, size):
    sets, label = collections.defaultdict(list), {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(ASCII_LOWER))
        s = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        if i is not None:
            sets[i].append(s)
            label[i] = i
    changed = True
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_near_copies_match_brute_force(spark):
    """Chains of altered copies, copies of one text altered in many ways, exact copies, very long texts, nulls, empties and repeated ids."""
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ä", "é", "I"]
    rows, text = [], [random.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # a chain: each differs from the one before in few words
        text = [random.choice(vocabulary) if random.random() < 0.03 else w for w in text]
        rows.append((900 - i, " ".join(text).upper() if i % 4 == 0 else "\n".join(text)))
    base = [random.choice(vocabulary) for _ in range(60)]
    rows += [(2000 + i, " ".join(random.choice(vocabulary) if random.random() < 0.06 else w for w in base)) for i in range(80)]
    rows += [(3000 + i, "same text here") for i in range(30)] + [(3100 + i, " ".join(random.choice(vocabulary) for _ in range(random.randint(0, 40)))) for i in range(60)]
    long = " ".join(f"x{k % 9000} y{k % 11}" for k in range(30_000))
    rows += [(4000, long), (4001, long + " z"), (4002, None), (4003, ""), (4004, "a"), (4005, "A"), (4005, "b"), (4006, "B"), (None, "a"), (None, None), (4007, " "), (4008, "a b"), (4009, "a b"), (4009, "a b")]
    df = spark.createDataFrame([(i, t, "n", "c", "k") for i, t in rows], "doc_id long, text string, n_shingles string, component_id string, kept string").repartition(6)
    got = minhash.link_components(df).collect()
    expected = brute_components(rows, 2)
    assert len(got) == len(rows)
    assert all(r.component_id == expected.get(r.doc_id) and r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (4002, 4003, 4004, 4008)} == {4002: 0, 4003: 0, 4004: 1, 4008: 1}
    assert minhash.link_components(df.where("false")).count() == 0


def test_keys_left_open_are_paired(spark, monkeypatch):
    """Without further turns the last step alone finds what the first star misses."""
    monkeypatch.setattr(minhash, "TURNS", 1)
    test_near_copies_match_brute_force(spark)


def test_minima_and_maxima_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    total = []
    for _ in range(40):
        tokens = textops.mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        x, y = tokens[:270], tokens[30:]
        s = minhash.signatures(np.concatenate([x, y]), np.array([0, 270]))
        total.append((s[0] == s[1]).mean())
    assert abs(np.mean(total) - 240 / 300) < 0.01
    assert len({*minhash.band_keys(s)[0].tolist()}) == minhash.BANDS


# ---- 13


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        run, place = level[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        yield run[:place], run[place + 1 :]
        i //= 16


def brute_manifest(rows):
    leaf = lambda r: H("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r)
    sources = collections.defaultdict(list)
    for r in rows:
        crc = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        altered = leaf((*r[:4], r[4].translate(ASCII_LOWER) if r[4] is not None else None)) if crc % 5 == 0 else leaf(r)
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), altered))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (known, doc_id, own, altered) in enumerate(sorted(sources[s])):
            way = [*steps(trees[s], i), *steps(top, k)]
            folded = altered
            for before, after in way:
                folded = H([*before, folded, *after])
            out.append((doc_id if known else None, own, trees[s][-1][0], top[-1][0], H(x for b, a in way for x in (*b, *a)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, n string"


@pytest.mark.parametrize("counts", [[1], [16], [17], [257, 1, 1], [4097, 300, 33], [1] * 300 + [20]])
def test_manifest_matches_brute_force(spark, counts):
    random.seed(len(counts))
    rows = [(random.randint(-9, 10**6), f"s{s}é" if s else None, random.choice([None, "en"]), random.choice([None, 3]), random.choice([None, "", "abc", f"Ü text {k}"])) for s, n in enumerate(counts) for k in range(n)]
    rows[0] = (None, *rows[0][1:])
    rows.append(rows[-1])  # a repeated row
    df = spark.createDataFrame([(*r, "l", "r", "n") for r in rows], FIELDS).repartition(7)
    assert sorted((tuple(r) for r in merkle.verify(df).collect()), key=str) == brute_manifest(rows)


def test_manifest_of_no_rows(spark):
    assert merkle.verify(spark.createDataFrame([], FIELDS)).count() == 0


def test_merging_forests_is_associative_and_commutative():
    random.seed(2)
    sizes = {"a": 5000, "b": 17, "c": 1, "d": 256}
    nodes = [(t, n, 0, i, H([t, str(i)])) for t, n in sizes.items() for i in range(n)]
    for _ in range(5):
        random.shuffle(nodes)
        cuts = sorted(random.sample(range(len(nodes)), 4))
        parts = [nodes[a:b] for a, b in zip([0, *cuts], [*cuts, len(nodes)], strict=True)]

        def forest(part, out):
            f = merkle.Forest(lambda *x: out.append(x))
            for x in part:
                f.add(*x)
            return f

        made = [[], []]
        a, b, c, d, e = (forest(p, made[0]) for p in parts)
        left = a.merge(b).merge(c.merge(d)).merge(e)
        a, b, c, d, e = (forest(p, made[1]) for p in parts)
        right = e.merge(d.merge(a.merge(c).merge(b)))
        assert not left.runs and not right.runs
        assert sorted(made[0]) == sorted(made[1])
        assert {x[0] for x in made[0] if x[2] == merkle.height(x[1])} == {"a", "b", "d"}
