"""Every stage of the corpus pipeline against brute force or labels, and the whole run."""

import zlib

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_by_name():
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "near_duplicates", "repeats", "packing"] and P.ORACLE_SQL is None


def test_toxic_documents_go(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in P.drop_toxic(spark, documents, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()
    assert sum((r.doc_id in kept) == (r.toxic == 0) for r in labels) >= 0.95 * len(labels)
    assert P.drop_toxic(spark, documents, sf).columns == documents.columns


def test_documents_of_known_languages_stay(spark, documents):
    import corpus_pipeline as P

    odd = spark.createDataFrame([(-1, None, None, None, 0), (-2, "123 !!", "en", None, 6)], documents.schema)
    kept = P.keep_languages(spark, documents.union(odd), SF).collect()
    assert not {r.doc_id for r in kept} & {-1, -2} and len(kept) >= 0.99 * documents.count()


def test_one_of_each_group_stays(spark):
    import corpus_pipeline as P

    w = [f"w{i}" for i in range(60)]
    texts = [w, w[:58], w[::-1], w, ["other"] * 3, w[:20]]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)] + [(None, " ".join(w), "en", "s", 1)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} or {tuple(t)} for t in texts]
    alike = {(i, j) for i in range(6) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert alike == {(1, 0), (3, 0), (3, 1)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in P.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == [0, 2, 4, 5, None]


def test_documents_that_stay_are_not_shuffled(spark):
    import corpus_pipeline as P

    rows = [(i, f"text {i} " + "of its own " * (i + 1), "en", "s", 1) for i in range(500)] + [(500, "text 0 of its own ", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = P.drop_near_duplicates(spark, docs, SF)
    want = P.jaccard.near_duplicates(docs.select("doc_id", "text"), 5, 80, 100).where("component_id = doc_id").count()
    assert kept.count() == want < 501
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    # the anti join takes what the table of ids lets pass; the rest comes by a union
    assert plan.startswith("Union") and "_word" in plan.split("LeftAnti")[1].split("hint")[0]


def test_repeated_passages_go(spark):
    import corpus_pipeline as P

    shared = " ".join(f"passage{i}" for i in range(30))
    rows = [(1, "head one " + shared + " tail", "en", "s", 1), (2, shared + "\ufffd end", "en", "s", 2), (3, "clean \ufffd", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.drop_repeats(spark, docs, SF).collect()}
    assert got == {1: ("head one  tail", 14), 2: ("\ufffd end", 5), 3: ("clean \ufffd", 9)}


def test_run_packs_what_is_left(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    pieces = P.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert {p.doc_id for p in pieces} == set(ids) and sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == p.ids_crc32
