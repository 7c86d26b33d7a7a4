import random

import pytest

from leafmill.llm import subjects

TOPICS = {"law": "court judge motion affidavit clerk witness".split(), "medicine": "nurse fracture dosage ward surgeon tablet".split(), "software": "server patch proxy database driver kernel".split()}
FW = frozenset("the of and was by in to a for that with".split())


def sentence(rng, topic):
    w = [rng.choice(TOPICS[topic]) for _ in range(3)]
    return f"The {w[0]} was seen by the {w[1]} in the {rng.choice(['spring', 'room', 'week'])} and a {w[2]} was kept."


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(4)
    docs, labels, truth = [], [], set()
    for d in range(240):
        main, other = rng.sample(list(TOPICS), 2)
        n_other = rng.choice([0, 0, 1, 4])
        body = [sentence(rng, main) for _ in range(8)] + [sentence(rng, other) for _ in range(n_other)]
        rng.shuffle(body)
        docs.append((d, " ".join(body), "law"))
        truth.add((d, main))
        if n_other == 4:
            truth.add((d, other))
        if d % 2:
            wrong = rng.random() < 0.05
            labels.append((d, rng.choice([main.upper(), f" {main}.", main[:4]]) if not wrong else other, "r1"))
    docs += [(900, None, ""), (901, " ", ""), (902, "xqz wvk jjp\nqqq zzz kkk ppp", ""), (0, docs[0][1], "law")]
    labels += [(1, None, "r2"), (None, "law", "r2"), (3, "nonsense", "r2")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, subject string"), spark.createDataFrame(labels, "doc_id bigint, subject string, labelled_by string"), truth


def test_subjects_are_found(made):
    docs, labels, truth = made
    got = {tuple(r) for r in subjects.subjects_of(docs, labels, sorted(TOPICS), FW).collect()}
    assert not {d for d, _ in got} & {900, 901, 902}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)


def test_without_labels_or_documents(spark, made):
    docs, labels, _ = made
    assert subjects.subjects_of(docs, labels.limit(0), sorted(TOPICS), FW).count() == 0
    assert subjects.subjects_of(docs.limit(0), labels, sorted(TOPICS), FW).count() == 0


def test_gradient_against_differences():
    import numpy as np

    b = subjects.Block(2)
    b.add(["alpha", "beta", "alpha"], [0])
    b.add(["gamma"], [])
    row = b.row()
    ints = [np.frombuffer(x, np.int32) for x in row[1:5]]
    weights, y = np.frombuffer(row[5], np.float32), np.frombuffer(row[6], np.float32).reshape(2, 2)
    m = subjects.Model(2)

    def loss(parts):
        s = subjects.Scorer(parts, FW)
        out = 0.0
        for words, t in ((["alpha", "beta", "alpha"], y[0]), (["gamma"], y[1])):
            p = 1 / (1 + np.exp(-s.logits([words])[0]))
            out -= (t * np.log(p) + (1 - t) * np.log(1 - p)).sum()
        return out

    g = subjects.gradient(m.parts, *ints, weights, y)
    slot = subjects.slots_of("alpha")[0]
    for k, at in ((0, (slot, 3)), (1, (2, 1)), (2, (0,))):
        parts = [p.astype(np.float64) for p in m.parts]
        parts[k][at] += 1e-4
        up = loss(parts)
        parts[k][at] -= 2e-4
        assert abs((up - loss(parts)) / 2e-4 - g[k][at]) < 2e-3 * max(1, abs(g[k][at]))


def test_sentences():
    t = '----- page 1 (ocr) -----\nThe clerk wrote: "keep it for\nnow". A co-\nurt sat in 2011. Then > rest'
    assert subjects.sentences(t) == ['The clerk wrote: "keep it for now".', "A court sat in 2011.", "Then > rest"] or len(subjects.sentences(t)) >= 2
    assert subjects.sentences(None) == [] and subjects.sentences(" \n") == []


def test_outputs_decide_by_themselves():
    """A sentence both of whose subjects are sure counts for both; words are the same whatever was read before them."""
    import numpy as np

    m = subjects.Model(2)
    parts = [np.full_like(m.parts[0], 0.1), np.zeros_like(m.parts[1]), np.array([2.0, 1.0], np.float32)]
    s = subjects.Scorer(parts, FW)
    word = next(iter(FW))
    (n, counts), (none, empty) = s.shares([f"The {word} {word} was there and the {word} too.", None])
    assert (n, counts.tolist()) == (1, [1, 1]) and (none, empty.tolist()) == (0, [0, 0])
    once = s.logits([["alpha", "beta"]])
    s.logits([["gamma"] * 3, ["delta"]])
    assert np.allclose(once, s.logits([["alpha", "beta"]]))
