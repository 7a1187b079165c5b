"""The stages of the corpus pipeline against plain Python, each on its own input."""

import base64
import hashlib
import re

import pytest

P = pytest.importorskip("public_tokenizers")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stages(spark, sf_dir):
    import numpy as np
    import regex
    import tiktoken

    import corpus_pipeline as C
    from trailframe.llm import secrets, toxicity
    from trailframe.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    extra = spark.createDataFrame([(None, "no id here", "en", "s", 10), (900001, None, "en", "s", None), (900002, "", "en", "s", 0), (900003, "token = ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4", "en", "s", 40)], docs.schema)
    docs = materialize(docs.unionByName(extra), "in")
    stages = dict(C.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = toxicity.train(docs, toxicity.severity_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    weight = dict(zip(model.names, model.weights, strict=True))
    clean = materialize(stages["toxicity"](spark, docs, sf_dir), "a")
    odds = lambda t: 1 / (1 + np.exp(model.bounds[0] - sum(weight[x] for x in {x for w in regex.findall(P.PATTERN, t or "") for x in toxicity.features_of(w)} if x in weight)))
    assert texts(clean) == {d: t for d, t in texts(docs).items() if odds(t) < toxicity.LEAST_ODDS}
    assert clean.columns == docs.columns

    single = materialize(stages["ngram_jaccard_join"](spark, clean, sf_dir), "b")
    sets = {}
    for d, t in texts(clean).items():
        w = re.findall(r"[^\x20\x09-\x0d]+", lowered(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                if a is not None and b is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert texts(single) == {d: t for d, t in texts(clean).items() if label[d] == d}

    kept = materialize(stages["benchmark_decontamination"](spark, single, sf_dir), "c")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
    assert texts(kept) == {d: t for d, t in texts(single).items() if not hit(t)}

    safe = materialize(stages["secret_scans"](spark, kept, sf_dir), "d")
    before, after = texts(kept), texts(safe)
    assert set(before) == set(after) and after[900003] == f"token = {secrets.MARK}" and after[900001] is None
    for d, t in after.items():  # nothing but marks differs
        assert re.fullmatch(".+".join(map(re.escape, (t or "").split(secrets.MARK))), before[d] or "", re.S), d

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in stages["byte_level_bpe"](spark, safe, sf_dir).collect():
        ids = enc.encode_ordinary(after[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((after[r.doc_id] or "").encode()).hexdigest())
