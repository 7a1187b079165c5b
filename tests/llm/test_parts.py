"""Parts of the corpus operators by themselves: checkpoints, rows without ids, and the fit of the severity model."""

import numpy as np
import pytest


def test_blocks_decode_from_every_checkpoint():
    from trailframe.llm import rans

    draw = np.random.default_rng(1)
    ids = np.minimum(draw.zipf(1.3, 3 * rans.LANES * rans.CHECKPOINT_STEPS + 77), 40_000).astype(np.uint32)
    table = rans.Frequencies.of(ids)
    data, slots, step = rans.encode_block(ids, table, table.dense()), table.slots(), rans.LANES * rans.CHECKPOINT_STEPS
    for mark in range(-(-len(ids) // step)):
        assert (rans.decode_block(data, table, slots, mark) == ids[mark * step :]).all()
    for first, stop in [(0, 1), (5, 900), (step - 1, step + 1), (step, 2 * step), (2 * step + 3, len(ids)), (len(ids) - 1, len(ids))]:
        assert (rans.decode_between(data, table, slots, first, stop) == ids[first:stop]).all()
    broken = bytearray(data)
    broken[-len(data) // 3] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), table, slots)


def test_ids_between_two_places_of_the_files(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from trailframe.llm import rans
    from trailframe.llm.common import scratch_path

    path = scratch_path(spark, "tokens")
    docs = spark.createDataFrame([(i, f"document {i} " + "word " * (i % 700)) for i in range(300)], "doc_id long, text string").repartition(4)
    rans.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    every = np.concatenate([np.array(r.ids) for r in rans.read_tokens(spark, path).orderBy("start").collect()])
    for first, stop in [(0, 10), (1234, 60_000), (len(every) - 5, len(every) + 50), (7, 7)]:
        found = sorted((r.start, r.ids) for r in rans.read_between(spark, path, first, stop).collect())
        got = np.concatenate([np.zeros(0, int), *[np.array(x) for _, x in found]])
        assert (got == every[first:stop]).all() and (not found or found[0][0] == first)


def test_secrets_of_rows_without_or_with_shared_ids(spark):
    from trailframe.llm import secrets

    key = "ghp_" + "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY1zA2"
    rows = [(None, "src/a.py", f"token = {key}"), (None, "src/b.py", "nothing to see"), (None, None, None), (5, "src/a.py", f"api_key = {key}"), (5, "src/a.py", f"api_key = {key}"), (5, "src/c.py", "plain words " * 20)]
    filler = [(100 + i, "src/x.py", "some plain words about nothing at all") for i in range(50)]
    found = secrets.redacted(spark.createDataFrame(rows + filler, "doc_id long, source string, text string")).filter("doc_id IS NULL OR doc_id < 100").collect()
    assert sorted((str(r.doc_id), str(r.text)[:20].strip(), r.n_candidates, r.n_secrets) for r in found) == [
        ("5", f"api_key = {secrets.MARK}", 1, 1), ("5", f"api_key = {secrets.MARK}", 1, 1), ("5", "plain words plain wo", 0, 0), ("None", "None", 0, 0), ("None", "nothing to see", 0, 0), ("None", f"token = {secrets.MARK}", 1, 1),
    ]


def test_the_fit_against_a_second_optimiser():
    """Newton steps on the same likelihood, with numerical derivatives, end at the same weights and bounds."""
    from trailframe.llm import toxicity

    draw = np.random.default_rng(2)
    n, names = 600, ["a", "b", "c"]
    x = (draw.random((n, 3)) < (0.3, 0.5, 0.2)).astype(float)
    logit = x @ np.array([1.5, -1.0, 2.5]) + draw.logistic(size=n)
    grades = (logit > 1).astype(int) + (logit > 3)
    rows, columns = np.nonzero(x)
    model = toxicity.fit(rows, columns, grades, names, rounds=4000, rate=0.02)

    def loss(p):
        bounds = p[3] + np.array([0, np.exp(p[4])])
        s = 1 / (1 + np.exp(-((x @ p[:3])[:, None] - bounds)))
        upper, lower = np.c_[np.ones(n), s][np.arange(n), grades], np.c_[s, np.zeros(n)][np.arange(n), grades]
        return -np.log(upper - lower).mean() + 0.01 / 2 * (p[:3] ** 2).sum() / np.sqrt(n)

    p, h = np.zeros(5), 1e-4
    unit = np.eye(5) * h
    for _ in range(60):
        slope = np.array([(loss(p + u) - loss(p - u)) / (2 * h) for u in unit])
        bend = np.array([[(loss(p + u + w) - loss(p + u - w) - loss(p - u + w) + loss(p - u - w)) / (4 * h * h) for w in unit] for u in unit])
        step = np.linalg.solve(bend + 1e-6 * np.eye(5), slope)
        while loss(p - step) > loss(p) + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        p = p - step
    got = np.concatenate([model.weights, model.bounds])
    assert got == pytest.approx(np.concatenate([p[:3], [p[3], p[3] + np.exp(p[4])]]), abs=0.02)


def test_near_copies_of_templates_against_all_pairs(spark):
    """Keys of more documents than a run holds, so that groups are compared block by block."""
    import random
    import re

    from trailframe.llm import jaccard

    draw = random.Random(9)
    templates = [[f"{t}w{i}" for i in range(60)] for t in range(6)]
    texts = []
    for i in range(180):
        words = list(templates[i % 6])
        for _ in range(draw.randrange(5)):
            words[draw.randrange(60)] = f"x{draw.randrange(40)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.split(r"\s+", t) for t in texts)]
    label = list(range(len(sets)))
    for _ in range(6):
        for a in range(len(sets)):
            for b in range(len(sets)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    found = jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(x), label[i]) for i, x in enumerate(sets)}
    assert len(set(label)) > 6
