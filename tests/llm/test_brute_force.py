"""The corpus operators against plain Python on a small table with nulls, empty texts, ties, copies and extra columns."""

import base64
import hashlib
import re
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")

PASSAGE = " ".join(f"passage{i} of many words" for i in range(30))
TEXTS = [
    None, "", "   ", "one two", "ONE two", PASSAGE, PASSAGE, PASSAGE + " end", "Straße é 12 don't\n\n  x " + PASSAGE[:300],
    "a b c d e f g", "the quick brown fox jumps over the lazy dog again today", "THE quick-brown fox jumps over the lazy dog, again today! more", "z" * 700, "ab" * 300,
]
ITEMS = [("i1", "The quick brown fox jumps over the lazy dog again"), ("i2", "e f g"), ("i3", None), ("i4", ""), ("i5", "missing words here"), ("i6", "E F G")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(3)


def test_decontamination(spark, docs):
    from trailframe.llm import decontam

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for d, t in enumerate(TEXTS):
        w, hit, ids = words(t), set(), set()
        for item, text in ITEMS:
            x = words(text)
            for win in [x[i : i + 10] for i in range(max(1, len(x) - 9))] if x else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(item)
        want[d] = (len(w), len(hit), sorted(ids), bool(hit))
    found = decontam.contaminated(docs, spark.createDataFrame(ITEMS, "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in found} == want


def test_jaccard_classes(docs):
    from trailframe.llm import jaccard

    sets = []
    for t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()} == {d: (len(s), label[d]) for d, s in enumerate(sets)}


def test_removed_bytes(docs):
    from trailframe.llm import suffixes

    raw, at = [(t or "").encode() for t in TEXTS], {}
    for d, x in enumerate(raw):
        for s in range(len(x) - 199):
            at.setdefault(x[s : s + 200], []).append((d, s))
    gone = [bytearray(len(x)) for x in raw]
    for places in at.values():
        for d, s in places if len(places) > 1 else []:
            gone[d][s : s + 200] = b"\1" * 200
    want = {d: (len(x), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(bytes(c for c, y in zip(x, g) if not y)).hexdigest()) for d, (x, g) in enumerate(zip(raw, gone))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicated(docs).collect()} == want


def test_byte_pairs(docs):
    import tiktoken
    from trailframe.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    found = bpe.digest(bpe.encode(docs, path), path).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want


def test_token_files(spark, docs, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer
    from trailframe.llm import rans

    path = P.path("byte_bpe_50k.json")
    tok, want, start = Tokenizer.from_file(path), {}, 0
    tok.encode_special_tokens = True
    for d, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rans.write_tokens(docs, str(tmp_path / "t"), path, 2)
    found = rans.read_tokens(spark, str(tmp_path / "t"), keep_ids=False).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want


def test_nearest_recall(spark, sf_dir):
    import numpy as np
    from trailframe.llm.queries import op8_nearest_vectors

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in op8_nearest_vectors(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    near = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        near += len(got[q] & set(order)) / len(order)
    assert near / (ids % 20 == 0).sum() >= 0.9


def test_archive_round_trip(spark, tmp_path):
    from trailframe.llm import warc

    pages = [(1, "http://a/x", "same"), (2, "http://b/y", "same"), (3, None, None), (4, "http://c", "in \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc the payload"), (5, "http://d", "é")]
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    found = {r.record_id: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert len(found) == 5
    for page, _, html in pages:
        r = found[f"<urn:page:{page}>"]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if page == 1 else "response")


def test_empty_tables(spark, docs):
    from trailframe.llm import bpe, decontam, jaccard, secrets, suffixes

    none = docs.filter("false")
    assert decontam.contaminated(none, spark.createDataFrame(ITEMS, "item_id string, text string")).count() == 0
    assert jaccard.classes(none).count() == 0 and suffixes.deduplicated(none).count() == 0
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken")).count() == 0
    assert secrets.redacted(none.withColumn("source", none.component)).count() == 0


def test_toxic_documents_are_found_on_held_out_labels(spark):
    from trailframe.llm import toxicity

    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    grades = toxicity.severity_grades(labels)
    model = toxicity.train(docs, grades.filter("doc_id % 4 <> 0"))
    held = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.filter("doc_id % 4 = 0"), "doc_id")
    r = held.selectExpr("count_if(found and toxic = 1) / greatest(1, count_if(toxic = 1)) AS recall", "count_if(found and toxic = 0) / greatest(1, count_if(toxic = 0)) AS wrong").first()
    assert r.recall >= 0.8 and r.wrong <= 0.05


def test_bpe_takes_a_word_that_is_a_token_whole(spark, tmp_path):
    import base64

    from trailframe.llm import bpe

    # no merge gives "abcd": the library looks whole words up first
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abcd", b"abc"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens) if t != b"abc"))
    docs = spark.createDataFrame([(1, "abcd abcd"), (2, "abcdabcd"), (3, "abcd"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r.ids for r in bpe.encode(docs, str(path)).collect()}
    assert found == {1: [257, 32, 256, 99, 100], 2: [256, 99, 100, 256, 99, 100], 3: [257], 4: []}
