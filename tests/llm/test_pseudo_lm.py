"""Masked pseudo-likelihood: gradients, probabilities that sum to one, brute-force scores, learning."""

import numpy as np
from pyspark.sql import functions as F

import touchline.llm.pseudo_lm as lm
from llm_tables import DOCS, documents


def test_windows_brute_force():
    owner, cls = np.array([0, 0, 0, 2, 3, 3]), np.array([5, 6, 7, 8, 9, 10])
    e = lm.EDGE
    assert lm.windows(owner, cls, 4).tolist() == [[e, e, 6, 7], [e, 5, 7, e], [5, 6, e, e], [e, e, e, e], [e, e, 10, e], [e, 9, e, e]]


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    weights = [w.astype(np.float64) for w in lm.start_weights()]
    window, target = rng.integers(0, lm.CLASSES + 1, (50, 4)), rng.integers(0, lm.CLASSES, 50)
    loss = lambda w: -lm.forward(w, window)[2][np.arange(50), target].mean()
    stepped = [w.copy() for w in weights]
    lm.train_batch(stepped, window, target, 1.0)
    for k, at in ((0, (window[0, 0], 1)), (1, (3, 4)), (2, (5,)), (3, (6, 7)), (4, (8,))):
        up, down = [w.copy() for w in weights], [w.copy() for w in weights]
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - (weights[k][at] - stepped[k][at])) < 1e-6


def test_vocabulary_and_scores(spark):
    rows = [(i, f"the cat sat on the mat number {i} " * 3) for i in range(80)] + [(900, None), (901, ""), (902, " \n"), (903, "the"),
            (904, "lots of words " * 30_000), (905, "again"), (905, "again"), (None, "the cat")]
    docs = documents(spark, rows).withColumn("n_words", F.lit("x")).withColumn("word", F.lit(1))
    vocab = lm.learn_vocabulary(docs, vocabulary=60)
    for c in range(lm.CLASSES):                            # a class's words, with the others' share, make up at most one
        assert np.exp(vocab.log_in_class[:60][vocab.word_class[:60] == c]).sum() <= 1 + 1e-9
    got = lm.score_documents(docs, vocabulary=60, rounds=(1,)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_words == 0 and by[i].log_likelihood == 0 and by[i].mean_log_likelihood is None for i in (900, 901, 902))
    assert by[904].n_words == 90_000 and by[0].mean_log_likelihood > by[905].mean_log_likelihood
    weights, numbers = lm.train(docs, vocab, rounds=(1,)), vocab.numbering()
    for i, text in rows[:3] + rows[-1:]:                   # word by word
        number = [numbers[w] for w in lm.words_of(text)]
        line = [lm.EDGE] * 2 + [int(vocab.word_class[n]) for n in number] + [lm.EDGE] * 2
        total = 0.0
        for j, n in enumerate(number):
            z = lm.forward(weights, np.array([[line[j], line[j + 1], line[j + 3], line[j + 4]]]))[2][0]
            assert abs(np.exp(z).sum() - 1) < 1e-4
            total += z[line[j + 2]] + vocab.log_in_class[n]
        assert abs(total - by[i].log_likelihood) < 1e-2 * max(1, len(number))


def test_vocabulary_is_the_most_frequent_words(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 30 + 1))) for i in range(300)]
    count = {}
    for _, t in rows:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    for size in (1, 7, 30, 500):
        want = sorted(count, key=lambda w: (-count[w], w))[:size]
        assert lm.learn_vocabulary(documents(spark, rows), vocabulary=size).words == want


def test_learns_from_both_sides(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}x" for i in range(6)]
    # the middle word follows from the words on both sides only together
    text = lambda: " ".join(f"{words[a]} {words[(a + b) % 6]} {words[b]} ." for a, b in rng.integers(0, 6, (150, 2)))
    docs = documents(spark, [(i, text()) for i in range(150)]).repartition(2)
    vocab = lm.learn_vocabulary(docs)
    weights = lm.train(docs, vocab, rounds=(1, 1, 1, 1, 1, 1, 1, 1))
    known = lm.score_texts(vocab, weights, vocab.numbering(), [text() for _ in range(20)])
    mixed = lm.score_texts(vocab, weights, vocab.numbering(), [" ".join(rng.permutation(text().split())) for _ in range(20)])
    assert known[1].sum() / known[0].sum() > mixed[1].sum() / mixed[0].sum() + 0.2


def test_scores_do_not_depend_on_the_vocabulary(spark):
    rows = [(i, " ".join(f"w{(i * j) % 211}" for j in range(i % 40 + 1))) for i in range(200)] + [(7, "w1 w1"), (None, "w210 once")]
    few, all_ = (sorted((r.doc_id or -1, r.n_words, round(r.log_likelihood, 2)) for r in lm.score_documents(
        documents(spark, rows).coalesce(1), vocabulary=v, rounds=(1,)).collect()) for v in (41, 1000))
    assert len(few) == len(rows) and few == all_


def test_classes_grow_and_probabilities_of_all_words_sum_to_one(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 100, i * 100 + 150))) for i in range(60)]
    docs = documents(spark, rows)
    vocab = lm.learn_vocabulary(docs, vocabulary=100_000)
    assert vocab.groups == 16 and len(set(vocab.word_class[:160])) == 160
    weights = lm.start_weights(groups=16, class_count=vocab.class_count)
    window = np.array([[3, 200, lm.EDGE, lm.EDGE], [1, 2, 3, 4]])
    z = lm.forward(weights, window)[2]
    n = len(vocab.words)
    total = np.exp(z[0][vocab.word_class[:n]] + vocab.log_in_class[:n]).sum()
    unseen = np.exp(z[0] + vocab.log_in_class[n:])[160:].sum()
    assert abs(total + unseen - 1) < 1e-3
    target = np.array([250, 17])
    assert np.allclose(lm.class_log_p(weights, window, target), z[[0, 1], target], atol=1e-4)


def test_gradient_with_many_groups_and_edges():
    rng = np.random.default_rng(0)
    weights = [w.astype(np.float64) for w in lm.start_weights(groups=16)]
    window, target = rng.integers(-1, 256, (50, 4)), rng.integers(0, 256, 50)
    window[0, 0] = lm.EDGE
    loss = lambda w: -lm.class_log_p(w, window, target).mean()
    stepped = [w.copy() for w in weights]
    lm.train_batch(stepped, window, target, 1.0)
    for k, at in ((0, (256, 1)), (1, (3, 4)), (3, (6, int(target[0]))), (4, (int(target[1]),)), (5, (6, 7)), (6, (8,))):
        up, down = [w.copy() for w in weights], [w.copy() for w in weights]
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - (weights[k][at] - stepped[k][at])) < 1e-6


def test_empty(spark):
    assert lm.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.log_likelihood for r in lm.score_documents(documents(spark, [(1, None), (2, "")])).collect()] == [0.0, 0.0]


def test_other_words_are_numbered_by_their_endings(monkeypatch):
    monkeypatch.setattr(lm, "KNOWN_ENDINGS", 3)            # fewer than there are
    numbers = lm._Numbers({"the": 0, "cat": 1}, 2, lm.LEAST_GROUPS)
    texts = ["the Walking cat", None, "", "x é talking\u2003the", " ".join(f"w{i} the" for i in range(50))]
    owner, number, others = lm._numbered(texts, numbers)
    words = [w for t in texts for w in lm.words_of(t)]
    assert number.tolist() == [numbers[w] for w in words]
    assert number.tolist() == [{"the": 0, "cat": 1}.get(w, 2 + lm.suffix_class(w, lm.LEAST_GROUPS)) for w in words]
    assert others == [w for w in words if w not in ("the", "cat")] and len(numbers.endings) <= 3
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in lm.words_of(t)]


def test_log_softmax_of_short_rows():
    z = np.random.default_rng(1).normal(0, 30, (500, 24)).astype(np.float32)
    wanted = z - z.max(-1, keepdims=True)
    wanted -= np.log(np.exp(wanted).sum(-1, keepdims=True))
    assert (lm._log_softmax(z.copy()) == wanted).all()
    assert (lm._log_softmax(z.reshape(500, 3, 8).copy()).reshape(500, 24)[:, :8] == lm._log_softmax(z[:, :8].copy())).all()


def test_words_of_runs_are_those_of_str_split():
    texts = [f"{chr(c)}A{chr(c)}{chr(c)}b{chr(c)}" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts += [None, "", " \n", "The END\x1cof\u2003\u0130x \u0391\u03a3"]
    n, words = lm._words(texts)
    want = [lm.words_of(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [w for ws in want for w in ws]


def test_word_counts_sent_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED_BYTES", 50)           # less than a text holds
    docs = documents(spark, [(i, f"a b{i % 7} " * 20) for i in range(40)] + [(90, None), (91, "")])
    got = {r.word: r.n for r in lm.word_counts(docs, "text").collect()}
    assert got == {"a": 800, **{f"b{k}": 20 * len(range(k, 40, 7)) for k in range(7)}}
