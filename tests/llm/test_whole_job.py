"""Tests of whole results: nothing is left out of the input, the model or the output."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from strideflow.llm import bpe, decontaminate, lm


def test_model_keeps_its_members():
    counts = np.arange(5000, 0, -1).astype(float)
    model = lm.Attention(counts)
    assert ((model.slot < lm.SLOTS - 1).sum(), lm.GROUPS, model.w["f"].shape[1]) == (3008, 64, 48)


def test_rare_words_get_their_counts(spark, monkeypatch):
    """The bound of the broadcast table decides where a count is looked up, never a score."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 40) % 500) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "STEPS", 20)
    scores = []
    for common in (1 << 17, 5):
        monkeypatch.setattr(lm, "COMMON", common)
        scores.append([(r.base_score, r.n_known, r.score) for r in lm.score_documents(docs).orderBy("doc_id").collect()])
    np.testing.assert_allclose(scores[0], scores[1], atol=1e-6)


def test_partly_altered_copies_leak(spark):
    """Verbatim windows count although a value is altered once, and different item values may become equal."""
    item = (
        "Then Alice Brown has 12 apples and puts all of them in the green basket near the old door of the barn. "
        "After some time she sells 12 apples there, eats 3 pears and gives 4 plums to Bob, who lives with Tom in the house by the river and never says no."
    )
    altered = {1: item.replace("12", "17", 1), 2: item.replace("3 pears", "5 pears").replace("4 plums", "5 plums"), 3: item.replace("to Bob", "to Tom"), 4: item}
    docs = spark.createDataFrame([*altered.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2].coverage == got[3].coverage == got[4].coverage == 1.0
    assert [got[k].reparameterised for k in (1, 2, 3, 4)] == [True, True, True, False]


def test_largest_consistent_set():
    rng = random.Random(3)
    for _ in range(200):
        windows = [{i: rng.randrange(3) for i in rng.sample(range(4), rng.randint(0, 3))} for _ in range(rng.randint(0, 8))]
        fits = lambda some: all(a.get(i, d) == d for a, b in itertools.combinations(some, 2) for i, d in b.items())
        most = max(n for n in range(len(windows) + 1) if any(map(fits, itertools.combinations(windows, n))))
        got = [windows[k] for k in decontaminate.consistent(windows)]
        assert fits(got) and len(got) == most


def test_start_uses_texts_whole(monkeypatch):
    seen = {}
    monkeypatch.setattr(lm, "START_IDS", 10)
    monkeypatch.setattr(lm.Attention, "train", lambda self, sequences: seen.update(ids=sum(map(len, sequences))))
    path = bpe.default_vocabulary()
    lm.start_model(["a " * 3000, "b " * 500, "c"], np.ones(lm.SubwordTable(path).size + 1), path)
    assert seen == {"ids": 3001}


def test_every_segment_is_learned_from_once():
    from strideflow.llm import lm

    for key in range(50):
        found = lm.drawn_segments([b"x"] * 700, key, lm.DRAW)
        assert sorted(s for _, s in found) == list(range(11)) and {k for k, _ in found} <= set(range(lm.ROUNDS))


def test_ids_of_numbered_words_equal_those_of_single_words():
    texts = ["  A b c \x1c d\x0b", "<|endoftext|> x<|endoftext|>y", None, "", " \n ", "z" * 3000, "É   ß 你好", "w " * 64, "w " * 65 + "A"]
    table = lm.SubwordTable(bpe.default_vocabulary())
    table.add({w for t in texts for w in lm.words(t)})
    for limit in (5, 1 << 20):
        got = []
        for part in lm.numbered(pa.array(["cut off", *texts])[1:], limit):
            ids, place = table.stream(part, [7, 8])
            assert [len(lm.words(t)) for t in texts[part.at : part.at + part.rows]] == np.diff(part.bounds).tolist()
            got += np.split(ids, place[part.bounds[1:] + np.arange(part.rows)][:-1] + 1)
        assert all(np.array_equal(g, [7, 8, *table.sequence(lm.words(t))]) for g, t in zip(got, texts, strict=True))


def test_a_learning_step_does_not_grow_with_the_vocabulary():
    """Only ids of the batch get queries, keys and values."""
    model = lm.Attention(np.ones(400_000))
    inputs, targets, _ = model.windows([np.arange(40, dtype=np.int32)])
    tracemalloc.start()
    model.step(inputs, targets)
    assert tracemalloc.get_traced_memory()[1] < model.w["e"].nbytes
    tracemalloc.stop()


def test_a_step_whose_logits_overflow_is_done_with_shifted_ones():
    model = lm.Attention(np.ones(100))
    inputs, targets, _ = model.windows([np.arange(40, dtype=np.int32)])
    expected = model.step(inputs, targets)
    model.w["ob"] += np.float32(500)  # no probability changes
    loss, grad = model.step(inputs, targets)
    assert abs(loss - expected[0]) < 1e-3 and np.abs(grad["p"] - expected[1]["p"]).max() < 1e-4
