"""Every corpus operator on rows that tables should not have: null and shared ids, repeats, long texts, clashing columns, nothing at all."""

import pytest

P = pytest.importorskip("public_tokenizers")

#: Names that the operators themselves use.
CLASHING = ("d", "n", "label", "component", "hits", "row_key", "words", "row", "found", "secrets", "n_secrets", "severity", "grade", "lower", "mean", "rule", "host", "payload", "first", "path_", "sketch", "key")
PASSAGE = " ".join(f"some{i} words of it" for i in range(40))
ROWS = [
    (1, PASSAGE), (None, PASSAGE), (2, None), (None, None), (3, ""), (4, "one two"), (4, PASSAGE + " and more"), (5, PASSAGE), (5, PASSAGE), (6, "the quick brown fox jumps over the lazy dog again"),
    (None, "the quick brown fox jumps over the lazy dog again"),
]


@pytest.fixture(scope="module")
def documents(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, "src") for i, t in ROWS], "doc_id long, text string, source string")
    return docs.withColumns({c: F.lit("x") for c in CLASHING}).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).repartition(3)


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://A.net/x", "same"), (2, None, "same"), (2, None, "same"), (None, "http://b.org/fr/y?z", "same"), (3, "no url", None), (4, "http://c.com#f", "x" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASHING})


def operators(spark, tmp_path):
    from trailframe.llm import bpe, decontam, jaccard, rans, secrets, suffixes, toxicity

    items = spark.createDataFrame([("i", "The quick brown fox jumps over the lazy dog again"), ("j", None), (None, "some1 words of")], "item_id string, text string")
    grades = spark.createDataFrame([(1, 1), (6, 0), (6, None), (None, 1), (77, 1)], "doc_id long, grade int")
    tokens, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")

    def files(docs):
        path = str(tmp_path / f"t{id(docs)}")
        rans.write_tokens(docs, path, tokens, 2)
        return rans.read_tokens(spark, path, keep_ids=False)

    return {
        "decontam": lambda d: decontam.contaminated(d, items), "toxicity": lambda d: toxicity.score(d, toxicity.train(d, grades)), "secrets": secrets.redacted, "jaccard": jaccard.classes,
        "rans": files, "suffixes": suffixes.deduplicated, "bpe": lambda d: bpe.digest(bpe.encode(d, ranks), ranks),
    }


@pytest.mark.parametrize("name", ["decontam", "toxicity", "secrets", "jaccard", "rans", "suffixes", "bpe"])
def test_odd_documents(spark, documents, tmp_path, name):
    run = operators(spark, tmp_path)[name]
    found = run(documents).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in ROWS)
    assert run(documents.filter("false")).count() == 0
    if name == "decontam":
        assert sorted(str((r.doc_id, r.n_hit)) for r in found if r.n_words == 10) == ["(6, 10)", "(None, 10)"]
    if name == "jaccard":
        # both rows of 4 are one document, and its second text is like 1 and 5
        assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (None, None), (2, 2), (3, 3), (4, 1), (5, 1), (6, 6)}
    if name == "suffixes":
        gone = sorted((str(r.doc_id), r.n_bytes > 0 and r.n_removed == r.n_bytes) for r in found if r.n_bytes == len(PASSAGE))
        assert gone == [("1", True), ("5", True), ("5", True), ("None", True)]


@pytest.mark.parametrize("name", ["decontam", "toxicity", "secrets", "jaccard", "rans", "suffixes", "bpe"])
def test_a_very_long_text(spark, tmp_path, name):
    text = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(700_000)) + " password=hunter2x end"  # over five megabytes
    docs = spark.createDataFrame([(1, text, "s"), (2, text[:-4], "s"), (3, "short", "s")], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in operators(spark, tmp_path)[name](docs).collect()}
    assert set(found) == {1, 2, 3}
    if name == "jaccard":
        assert [found[i].component_id for i in (1, 2, 3)] == [1, 1, 3] and found[1].n_shingles == 700_002 - 4
    if name == "secrets":
        assert found[1].text.endswith("password=[SECRET] end")
    if name == "suffixes":
        assert found[2].n_removed == len(text) - 4 and found[1].n_removed == len(text) - 4


def test_odd_pages(spark, pages, tmp_path):
    from trailframe.llm import urls, warc

    rules = (("block", "net/"), ("allow", "org/fr/"))
    judged = urls.judged(pages, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, 1)], "page_id long, bad int"), rules)
    assert sorted((str(r.page_id), r.host, r.path, r.rule or "") for r in judged.collect()) == sorted(
        [("1", "a.net", "/x", "net/"), ("2", "", "", ""), ("2", "", "", ""), ("None", "b.org", "/fr/y", "org/fr/"), ("3", "", "", ""), ("4", "c.com", "", "")])
    assert urls.judged(pages.filter("false"), spark.createDataFrame([], "page_id long, bad int"), rules).count() == 0
    warc.write_archive(pages, str(tmp_path / "w"))
    found = [(r.record_id, r.record_type, r.payload_bytes) for r in warc.read_archive(spark, str(tmp_path / "w"), payloads=False).collect()]
    same = [("<urn:page:1>", "revisit", 4), ("<urn:page:2>", "response", 4), ("<urn:page:2>", "response", 4), (None, "response", 4), ("<urn:page:3>", "response", 0), ("<urn:page:4>", "response", 3_000_000)]
    assert sorted(map(str, found)) == sorted(map(str, same))
    warc.write_archive(pages.filter("false"), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_no_vectors(spark):
    from trailframe.llm import ann

    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, none).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(one, one).count() == 0
