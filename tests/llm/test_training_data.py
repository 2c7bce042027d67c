"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, sid long"


@pytest.fixture
def docs(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(120))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 260))) for _ in range(40)]
    for i in range(0, 12):
        w = texts[i].split()
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], "", None, "   ", "x" * 3000, "tail " + passage, passage + " head " + texts[5], "Ünï 😀 \n\t done"]
    rows = [(i, t, "en" if i % 2 else None, None, len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def _sets(rows, width):
    out = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        out[r.doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("limit", [4_000_000, 300])
def test_jaccard_components(docs, limit):
    from reelquarry.llm.jaccard import near_duplicates

    rows = docs.collect()
    sets, parent = _sets(rows, 4), {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 4, 85, 100, limit).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("length", [20, 400])
def test_repeats(docs, length):
    from reelquarry.llm.suffixes import remove_repeats

    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = {}
    for _, raw in rows:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    want = {}
    for d, raw in rows:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        want[d] = (bytes(np.frombuffer(raw, np.uint8)[~gone]), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()))
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in remove_repeats(docs, length).collect()}
    assert got == want


@pytest.mark.parametrize("hot, hotter", [(1, 3), (0, 1 << 16), (0, 0)])
def test_repeats_of_hot_anchors(spark, hot, hotter):
    from reelquarry.llm.suffixes import remove_repeats

    length, rng = 64, np.random.default_rng(5)

    def words(n):
        return "".join(rng.choice(list("abcdefgh "), n))

    passages = [words(n) for n in (30, 60, 70, 150, 700)]
    texts = [words(90) + passages[i % 5] + words(40) + passages[(i * 3) % 4] + words(int(rng.integers(0, 90))) for i in range(60)]
    texts += [passages[4] + passages[4], "ab" * 200, "x" * 300, texts[0], texts[1][1:], None, "", "é" * 100 + passages[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raws = {i: (t or "").encode() for i, t in enumerate(texts)}
    seen = {}
    for raw in raws.values():
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    want = {}
    for d, raw in raws.items():
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        want[d] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    assert {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, length, hot, hotter).collect()} == want


def test_word_tokenizer_equals_library():
    import public_tokenizers
    from reelquarry.llm.packing import PLAIN, WordTokenizer
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    plain, r = [chr(c) for a, b in PLAIN for c in range(a, b + 1)], random.Random(3)
    mixed = plain[:128] + list("'stremld'’ éÉ½²³ªº \u0085\x1c漢字🙂\u0301")
    texts = ["".join(r.choice(mixed if i % 3 else plain) for _ in range(r.randint(0, 60))) for i in range(600)]
    texts += ["<|endoftext|> <|startoftext|>", "a <|EndOfText|> b", "x<|endoftext|>y z", "</w> w</w>", "it's 'S'tree 'll'd", "", *plain, *["a" + c + "'s" for c in plain]]
    got = WordTokenizer(path).encode_many(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_tables(spark, docs):
    from reelquarry.llm import fingerprints, jaccard, langid, suffixes, toxicity

    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert jaccard.near_duplicates(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert langid.identify(docs, langid.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels)).count() == docs.count()
    fingerprints.prepare(spark)
    assert fingerprints.with_successor(none, fingerprints._edit, fingerprints._SCHEMA).count() == 0


def test_fingerprints(docs):
    from reelquarry.llm import fingerprints as fp

    fp.prepare(docs.sparkSession)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fp.with_successor(docs.select("doc_id", "text"), fp._edit, fp._SCHEMA, pieces=7).collect()}
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].fingerprint == fp.fingerprints([t.encode()])[0]
        assert got[d].near_next == fp.likeness(got[d].fingerprint, fp.fingerprints([n.encode()])[0])
    assert fp.likeness("4:ABCDEFGH:AB", "4:ABCDEFGH:AB") == 1.0 and fp.likeness("4:ABCDEFGH:AB", "64:ABCDEFGH:AB") == 0.0


def test_media_round_trip_and_retry(spark, docs, tmp_path):
    from reelquarry.llm import media

    media.prepare(spark)
    spark.dataSource.register(media.MediaArchive)
    media.pack_texts(docs, f"file://{tmp_path}/a")
    got = {r.doc_id: r for r in spark.read.format(media.FORMAT).option("splitBytes", 1000).load(f"file://{tmp_path}/a").select("name", "media").mapInArrow(media.describe, media._OUT).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert got[r.doc_id].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[r.doc_id].tail_crc32 == zlib.crc32(payload[-64:])
    victim = next((tmp_path / "a").glob("*.zip"))
    data = bytearray(victim.read_bytes())
    data[60] ^= 255
    victim.write_bytes(bytes(data))
    back = spark.read.format(media.FORMAT).option("onError", "null").load(f"file://{tmp_path}/a")
    assert back.where("error IS NOT NULL").count() == 1 and back.where("media IS NOT NULL").count() == len(got) - 1


def test_chat(spark):
    from reelquarry.llm.chat import format_conversations, parse_formatted

    rows = [(1, 0, "user", "\\b <turn x> </turn>\n"), (1, 1, "assistant", "\\\\c\\"), (2, 0, "assistant", None), (3, 0, "us>er", "a"), (None, 0, "user", "")]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in made.select("*", parse_formatted(made.formatted).alias("back")).collect()}
    assert [(x.role, x.text) for x in got[1].back] == [(r[2], r[3]) for r in rows[:2]] and got[1].state == "assistant"
    assert [(x.role, x.text) for x in got[3].back] == [("us>er", "a")] and got[3].state == "rejected"
    assert got[2].first_invalid_turn == 0 and [s.text for s in got[2].segments if s.loss] == [""] and None in got


def test_byte_bpe():
    import base64

    import public_tokenizers as P
    import tiktoken

    from reelquarry.llm.byte_bpe import ByteBPE

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd, bpe = random.Random(1), ByteBPE(path, P.PATTERN, chunk=100, overlap=16)
    for i in range(400):
        t = "".join(rnd.choice("ab c  \n\t'sre1２ é漢😀\x1c\x85　!..?Σ") for _ in range(rnd.randint(0, 900)))
        if i % 3 == 0:
            t = "".join(rnd.choice(["a" * rnd.randint(1, 400), " " * rnd.randint(1, 300), "!" * 50, "x 'll"]) for _ in range(8))
        assert bpe.encode(t) == library.encode_ordinary(t)
        assert bpe.decode(bpe.encode(t)) == t.encode()


def test_packing(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from reelquarry.llm.packing import best_fit_decreasing, pack_documents

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces = pack_documents(docs, P.path("word_bpe_49k.json"), window=64).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    where, offset = best_fit_decreasing([30, 40, 20, 64, 24], 64)
    assert where[1] == where[4] and offset[4] == 40 and len(set(where)) == 3


def test_html():
    from reelquarry.llm.html_text import render

    assert render("<ul><li>a<li>b</ul><p hidden>no</p><p>x<br>y<table><tr><td>long<td>1<tr><td>b<td>2</table>") == "- a\n- b\n\nx\ny\n\nlong  1\nb     2"
    assert render(None) == "" and render("<style>.q{display:none}</style><i class=q>z</i>ok &lt;") == "ok <"
    assert render("<pre>\n a\n  b</pre>") == " a\n  b" and render("<div>" * 5000 + "deep") == "deep"


def test_language_and_toxicity(spark):
    from reelquarry.llm.langid import op8_language
    from reelquarry.llm.toxicity import op4_toxicity

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in op8_language(spark, sf).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op4_toxicity(spark, sf).collect() if r.held_out and r.doc_id in label]
    assert sum(label[r.doc_id] == r.predicted for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("limit", [4_000_000, 40])
def test_jaccard_of_different_texts_under_one_id(spark, limit):
    from reelquarry.llm.jaccard import near_duplicates

    # 1 holds two unlike texts, linked to each other through 5, and each with a partner of its own
    w = [f"w{i}" for i in range(60)]
    base, a, b = w[:40], w[:40] + w[40:44], w[4:40]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join(base)), (6, " ".join(a + w[44:48])), (7, " ".join(b[4:])), (8, "alone " * 3)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100, limit).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (5, 1), (6, 1), (7, 1), (8, 8)]
