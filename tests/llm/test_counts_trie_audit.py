"""Token counts, the prefix trie and the filter audit against plain Python on rows with nulls, ties, copies and clashing columns."""

import hashlib
import re
import zlib
from itertools import permutations

import pytest

P = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", "  \n ", "one two", "one two", "don't stop <|endoftext|> now<|endoftext|>", "z" * 5000, "Straße é 12\n\n  x", "<|endoftext|>",
    " ".join(f"w{i}" for i in range(1500)), "one two", "日本語 text 😀 ok",
]


@pytest.mark.parametrize("chunk_bytes", [200, 12 << 20])
def test_token_counts(spark, chunk_bytes):
    from tokenizers import Tokenizer

    from trailframe.llm import token_counts

    rows = [(None if i == 3 else i // 2, t, "x", 5) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, chunk int").repartition(3)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    found = token_counts.counted(docs, P.path("byte_bpe_50k.json"), 1024, chunk_bytes=chunk_bytes).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert token_counts.counted(docs.limit(0), P.path("byte_bpe_50k.json"), 1024).collect() == []


def plain_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + seq[h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[:-1] == x for y in members if y) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(ids) if made[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks():
    rows = [(None, 0, "user", "lost", 1)]
    for c in range(130):
        if c == 40:
            continue  # no conversation to borrow from
        for t in range(c % 7):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, None if c % 5 == 0 else "user", None if t == 2 else f"shared {t} of {c % 2} words", 1))
    rows += [(60, t, "user", f"deep {t}", 1) for t in range(90)] + [(63, t, "user", f"deep {t}", 1) for t in range(89)]
    rows += [(5, 0, "user", "twice", 1)] * 3
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def test_prefix_trie(spark):
    from trailframe.llm import prefix_trie

    rows = talks()
    found = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(tuple, found), key=str) == plain_trie(rows)
    assert {r[1] for r in found} >= set(range(90))


def test_trie_of_little(spark):
    from trailframe.llm import prefix_trie

    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in ([(None, 1, "a", "b", 0)], [(1, 0, "a", "b", 0)], [(-3, 0, "a", "b", 0), (7, 0, "a", "b", 0)]):
        found = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
        if any(c is not None and c < 0 for c, *_ in rows):
            assert sum(r.n_convs for r in found if r.depth == 0) == 2
        else:
            assert sorted(map(tuple, found), key=str) == plain_trie(rows)


def test_hot_conversation_is_dealt_out(spark):
    """One conversation holds most turns: its prefixes come from several ranges."""
    from trailframe.llm import prefix_trie

    rows = [(20, t, "user", f"turn {t % 17}", 0) for t in range(3000)] + [(c, 0, "user", "hello", 0) for c in range(100, 140)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert prefix_trie.dealt_turns(frame).filter("conv_id = 20").select("pid").distinct().count() > 4
        found = {r.depth: r for r in prefix_trie.trie(frame).collect() if r.conv_id == 20 and r.depth > 1}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert len(found) == 2999
    assert all(found[d].parent_conv_id == 20 and found[d].n_leaves == 1 and found[d].n_children == (d < 3000) for d in found)
    assert found[3000].ends_sha256 == hashlib.sha256(b"20").hexdigest()


def test_long_lists_of_members(spark):
    from trailframe.llm import prefix_trie

    ids = [*range(-700, 900), 2**40, 2**40 + 1, 2**62]
    ends = spark.createDataFrame([(1, 2, 3, c) for c in ids] + [(1, 2, 4, 9)], "x long, y long, depth long, conv_id long").repartition(5)
    found = {r.depth: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    assert found == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"9").hexdigest()}


def plain_audit(docs, labels):
    first = {}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    rows = []
    for d, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        failed = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d,
        }
        mine = [(q, x) for i, q, x in labels if i is not None and i == d]
        rows.append((lang or "", {f for f in failed if failed[f]}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out = []
    for part in {r[0] for r in rows}:
        here, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        got = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [r for r in here if f in r[1] and not r[1] & before]
                shapley[f] += len(removed)
                kept = sum(not r[1] & (before | {f}) for r in here)
                redundant = sum(f in r[1] and bool(r[1] & before) for r in here)
                got.append((part, "".join(order), k + 1, kept, len(removed), redundant, sum(r[1] == {f} for r in here), sum(r[2] for r in removed), sum(r[3] for r in removed)))
        out += [(*g, shapley[g[1][g[2] - 1]]) for g in got]
    return sorted(out)


def test_filter_audit(spark):
    from trailframe.llm import filter_audit

    long = " ".join(f"word{i}" for i in range(120))
    texts = [None, "", long, long, long + " #", "A B C " + long, "LOUD " * 110, "a " * 150, "x # Y", long.upper(), "é" * 3, long, "tab\x0bsep\x1cno"]
    docs = [(None if i in (5, 11) else i if i != 8 else 7, t, (None, "en", "", "de")[i % 4], i) for i, t in enumerate(texts)] + [(3, long, "en", 0), (99, None, "de", 0)]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (4, None, 1), (None, 1, 1), (7, 1, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, good int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    found = filter_audit.audit(frame, marks)
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).collect() == []
    assert filter_audit.audit(frame, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
