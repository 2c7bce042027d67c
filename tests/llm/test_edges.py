"""Clashing columns, nulls, repeated ids, colliding words, hostile pages, long texts."""

import hashlib
import random

import numpy as np
import pytest

LONG = "doc_id long, text string"


def _brute(raws, length):
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot, hotter, large", [(0, 0, 500), (0, 1 << 16, 2000), (1 << 12, 1 << 16, 500)])
def test_repeats_of_large_groups_null_ids_and_repeated_ids(spark, hot, hotter, large):
    from reelquarry.llm.suffixes import remove_repeats

    rnd = random.Random(3)

    def words(n):
        return "".join(rnd.choice("abcdefg ") for _ in range(n))

    passage, other = words(90), words(70)
    texts = [words(rnd.randint(0, 80)) + passage[: rnd.randint(60, 90)] + words(rnd.randint(0, 80)) for _ in range(60)] + [other + "é" * 40, "ü" + other, None, ""]
    ids = [*range(50), *[None] * 6, *[7] * 8]
    want = sorted((i if i is not None else -1, k) for i, k in zip(ids, _brute([(t or "").encode() for t in texts], 64), strict=True))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), LONG).repartition(3)
    got = remove_repeats(docs, 64, hot, hotter, large).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.kept)) for r in got) == want


def test_kept_text_drops_only_cut_characters(spark):
    from reelquarry.llm.suffixes import remove_repeats

    shared = "é" * 40
    docs = spark.createDataFrame([(1, "a\ufffd" + shared + "è"), (2, "bê" + shared + "\u00eb")], LONG)
    got = {r.doc_id: r for r in remove_repeats(docs, 20).collect()}
    assert got[1].kept_text == "a\ufffd" and len(got[1].kept) == 5 and got[2].kept_text == "bê" and len(got[2].kept) == 4


def test_clashing_columns(spark):
    from reelquarry.llm import langid, suffixes, toxicity

    docs = spark.createDataFrame([(1, "some words here", 5, "x", 0.5, "y"), (2, None, 6, "x", 0.5, "y")], "doc_id long, text string, n_removed long, lang_pred string, toxicity double, key string")
    cut = suffixes.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_removed, r.key, r.lang_pred) for r in cut) == [(1, 0, "y", "x"), (2, 0, "y", "x")]
    model = langid.fit(docs.selectExpr("doc_id", "text", "'en' AS lang"))
    found = langid.identify(docs, model)
    assert found.columns.count("lang_pred") == 1 and {r.key for r in found.collect()} == {"y"}
    scored = toxicity.score_documents(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert scored.columns.count("toxicity") == 1 and all(0 <= r.toxicity <= 1 for r in scored.collect())


def test_words_with_equal_polynomials_do_not_link(spark):
    from reelquarry.llm.jaccard import near_duplicates, shingle_sets

    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[x] for x in bits), "".join("ab"[1 - x] for x in bits)
    assert not set(shingle_sets([a.encode()], 4)[0].tolist()) & set(shingle_sets([b.encode()], 4)[0].tolist())
    got = near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], LONG), 4, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_loss_text_comes_from_the_formatted_text(spark, tmp_path):
    from reelquarry.llm.chat import op3_chat

    rows = [(1, 0, "system", "s"), (1, 1, "user", "u <turn "), (1, 2, "assistant", "\\b</turn>\n"), (1, 3, "user", None), (1, 4, "assistant", "é"), (2, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op3_chat(spark, str(tmp_path)).collect()}
    loss = "\\b</turn>\né"
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[-7].n_turns == 2 and got[-7].loss_chars == 26


def test_empty_tables_of_the_other_operators(spark):
    import public_tokenizers as P

    from reelquarry.llm import byte_bpe, chat, html_text, media, packing

    none = spark.createDataFrame([], LONG)
    assert byte_bpe.encode_documents(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    media.prepare(spark)


def test_page_columns_may_be_null(spark):
    from reelquarry.llm.html_text import extract

    got = extract(spark.createDataFrame([(None, None, "<p>a"), (1, None, None), (1, "u", "")], "page_id long, url string, html string")).collect()
    assert sorted((r.text, r.n_lines) for r in got) == [("", 0), ("", 0), ("a", 1)]


def test_hostile_pages_stay_near_their_size():
    from reelquarry.llm.html_text import PADDING, render

    pages = [
        "<table><tr><td>" + "x" * 20_000 + "<td>b" + "<tr><td>a<td>b" * 2000,
        "<table>" + "<tr><td colspan=999 rowspan=999><td>b" * 5000,
        "<table><tr><td>" * 200 + "x" * 90 + "<td>a<td>b",
        "<ul><li>" * 250 + "a<br>" * 20_000,
        "<p>" + "<b>x</b> y " * 90_000,
    ]
    for page in pages:
        assert len(render(page)) <= (PADDING + 2) * len(page)
    assert render("<table><tr><td>" + "w" * 300 + "<td>b<tr><td>cc<td>d") == "w" * 300 + "  b\ncc  d"
    assert render("<style>@media print {nav {display:none}} .a{display:none}</style><nav>n</nav><i class=a>h</i>") == "n"
    assert render("<svg><title>t</title><path d=x /><text>label</text></svg><math><mi>x</mi></math>") == "label x"
    assert render("<div>" * 400 + "<script>var x</script><template>h<b>i</b></template>ok") == "ok"


def test_pages_keep_their_visible_words_in_order():
    """Random trees against a plain walk of the tree."""
    from reelquarry.llm.html_text import render

    rnd = random.Random(11)

    def tree(depth):
        tag = rnd.choice("div p span b ul section h2 blockquote table hidden script".split())
        own = [f"w{rnd.randrange(1000)}" for _ in range(rnd.randint(1, 3))]
        if tag == "hidden":
            return f"<div style='display: none'>{' '.join(own)}</div>", []
        if tag == "script":
            return f"<script>{' '.join(own)}</script>", []
        parts = [tree(depth - 1) for _ in range(rnd.randint(0, 3))] if depth and tag not in ("p", "span", "b", "h2") else []
        if tag == "ul":
            items = [(" ".join(own), own), *parts]
            return "<ul>" + "".join(f"<li>{h}" for h, _ in items) + "</ul>", [w for _, ws in items for w in ws]
        if tag == "table":
            cells = [[f"w{rnd.randrange(1000)}" for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 3))]
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>", [c for row in cells for c in row]
        return f" <{tag}>{' '.join(own)} " + "".join(h for h, _ in parts) + f"</{tag}> ", own + [w for _, ws in parts for w in ws]

    for _ in range(300):
        made = [tree(3) for _ in range(3)]
        got = [w for w in render(" ".join(h for h, _ in made)).split() if w.startswith("w")]
        assert got == [w for _, ws in made for w in ws]


def test_long_texts_are_stitched_from_chunks():
    import base64

    import public_tokenizers as P
    import tiktoken

    from reelquarry.llm.byte_bpe import ByteBPE

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd, bpe = random.Random(5), ByteBPE(path, P.PATTERN)
    words = ["".join(rnd.choice("etaoinsé'") for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    text = "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", ", ", " " * 700, "!" * 600]) for _ in range(20_000))
    for t in (text, text[:30_000] + "x" * 9000 + text[:20_000], " " * 20_000 + "z"):
        assert len(t) > bpe.chunk + bpe.overlap and bpe.encode(t) == library.encode_ordinary(t)


def test_packing_places_every_piece(spark):
    import public_tokenizers as P

    from reelquarry.llm.packing import pack_documents

    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["red", "of", "packing", "zz"]) for _ in range(rnd.randint(0, 200))) if i % 9 else None) for i in range(80)], LONG).repartition(2)
    pieces = pack_documents(docs, P.path("word_bpe_49k.json"), window=64).collect()
    windows, lengths = {}, {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        lengths.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    for own in lengths.values():
        at = 0
        for start, length, total in sorted(own):
            assert start == at
            at += length
        assert at == total
    assert len(lengths) == 80


def test_a_large_family_of_near_copies_is_not_squared(spark, monkeypatch):
    from reelquarry.llm import jaccard

    # 300 near copies of one text, 3 at the end of a chain that begins at one of them, 40 of another size
    w, extra = [f"w{i}" for i in range(120)], [f"x{i}" for i in range(400)]
    texts = [" ".join(w[:i % 100] + [extra[i]] + w[i % 100 + 1 :]) for i in range(300)]
    chain = [extra[350], extra[351], *w[2:]]
    for k in range(3):
        chain = chain[: 4 + 6 * k] + [extra[360 + 8 * k + j] for j in range(6)] + chain[10 + 6 * k :]
        texts.append(" ".join(chain))
    texts += [" ".join(w[:108] + [extra[i]]) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [set(t.split()) for t in texts]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    made = {}

    def spied(name):
        own = getattr(jaccard, name)

        def run(*args):
            made[name] = own(*args)
            return made[name]

        monkeypatch.setattr(jaccard, name, run)

    spied("_assign_cells")
    spied("_remaining_cells")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, LONG), 1, 85, 100, 2_000).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    # every set goes to its part, the pivots to all parts of three bands; then the rest alone meets the others
    first, second = (made[name].selectExpr("sum(size(cells))").first()[0] for name in ("_assign_cells", "_remaining_cells"))
    parts = sum(map(len, sets)) // 2_000 + 2
    assert first <= len(rows) + 2 * jaccard.PIVOTS * parts
    assert (second or 0) <= 2 * len(rows) + 5 * parts


def test_fit_tells_texts_in_no_learned_language(spark):
    from reelquarry.llm import langid

    random.seed(5)
    english, german = "the and of that with have this from they which".split(), "der und die nicht mit sich auch werden eine noch".split()
    texts = [(i, " ".join(random.choices(english if i % 2 else german, k=40)), "en" if i % 2 else "de") for i in range(400)]
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    odd = ["Все люди рождаются свободными и равными в своём достоинстве", "the", " ".join("".join(random.choices("qxzjkvwy", k=6)) for _ in range(40)), None, "12 34", "the werden of und " * 5]
    held = [" ".join(random.choices(english + german, k=40)) for _ in range(200)]
    found = langid.identify(spark.createDataFrame(list(enumerate(odd + held)), LONG), model).orderBy("doc_id").collect()
    assert [r.lang_fit >= model.least_fit for r in found] == [False, True, False, True, True, True] + [True] * 200
    # the sum over the words, whatever the slices
    mixture = langid.MixtureInference(model)
    alone = [x[0] for x in (mixture.likelihoods([t]) for t in odd)]
    assert np.allclose(np.concatenate(alone), mixture.likelihoods(odd)[0])
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert nothing.least_fit == -np.inf and langid.identify(spark.createDataFrame([(1, "the")], LONG), nothing).first().lang_pred == "und"


def test_alike_sets_share_enough_parts():
    from reelquarry.llm.jaccard import _mix, parts_of

    rng = np.random.default_rng(11)
    for num in (50, 80, 85, 95):
        sets, linked = [], []
        for n in [*range(1, 60), 100, 137, 400, 1500]:
            for _ in range(6):
                a = _mix(rng.integers(0, 1 << 60, 2 * n).astype(np.uint64))
                # the greatest difference that still links: tokens that go, and tokens that come
                gone = int(rng.integers(0, n * (100 - num) // 100 + 1))
                more = max(0, (n - gone) * 100 // num - n)
                sets += [np.sort(a[:n]), np.sort(a[gone : n + more])]
                linked.append((len(sets) - 2, len(sets) - 1))
        digests, index, least = parts_of(sets, num, 100)
        for i, j in linked:
            a, b = (set(s.tolist()) for s in (sets[i], sets[j]))
            assert 100 * len(a & b) >= num * len(a | b)
            if a != b:
                of = [dict(zip(digests[index == k].tolist(), least[index == k].tolist(), strict=True)) for k in (i, j)]
                shared = of[0].keys() & of[1].keys()
                assert shared and len(shared) >= max(max(of[0][d], of[1][d]) for d in shared)


def test_common_shingles_do_not_cluster_unlike_texts(spark, monkeypatch):
    from reelquarry.llm import jaccard

    # every shingle is one of 625 and lies in about 30 texts, none of which are alike
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices([f"w{k}" for k in range(25)], k=60)) for i in range(300)]
    texts.append(texts[0] + " changed")
    sizes = []
    own = jaccard.connected_components

    def spied(edges):
        found = own(edges)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "connected_components", spied)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), LONG), 2, 85, 100).collect()}
    assert got == {**{i: i for i in range(300)}, 300: 0}
    assert sizes[0] < 30


def test_texts_of_other_ids_are_not_sent(spark):
    from reelquarry.llm.common import split_by_ids

    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text").union(spark.createDataFrame([(None, "t")], LONG))
    some, rest = ([r.doc_id for r in part.collect()] for part in split_by_ids(docs, docs.where("doc_id % 100 = 7").select("doc_id")))
    assert {i for i in range(20_000) if i % 100 == 7} <= set(some) and len(some) < 1_000
    assert sorted(some + rest, key=str) == sorted([None, *range(20_000)], key=str)
    assert [len(part.collect()) for part in split_by_ids(docs, docs.where("false"))] == [0, 20_001]


def test_hot_anchors_without_repeats_send_nothing():
    import types

    import pyarrow as pa

    from reelquarry.llm.suffixes import _ANCHORS, SLOT_BITS, _fields, _repeated_anchors, _scan

    # 40 bytes in common, unlike surroundings: anchors repeat, no 64 bytes do; the last two texts share 64 bytes
    rnd = random.Random(4)

    def words(n):
        return "".join(rnd.choices("abcdefgh ", k=n))

    passage, longer = words(40), words(120)
    texts = [words(200) + passage + words(200) for _ in range(60)]

    def sent(texts, level):
        levels = types.SimpleNamespace(value=np.full(1 << SLOT_BITS, level, np.uint8))
        rows = [r for k in range(2) for b in _scan(64, 16, levels)(iter([pa.RecordBatch.from_pydict({"text": texts[k::2]})])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(rows), strict=True)], names=_fields(_ANCHORS))
        return sum(b.num_rows for b in _repeated_anchors(iter([batch])))

    assert sent(texts, 0) > 60
    for level in (1, 2):
        assert sent(texts, level) == 0
        assert sent([*texts, words(50) + longer, longer + words(50)], level) > 0


def test_texts_are_shuffled_once_for_repeats(spark, tmp_path):
    import re

    from reelquarry.llm.suffixes import op10_suffixes

    rows = [(i, f"{i} " * 150 + "common words " * 40) for i in range(30)]
    spark.createDataFrame(rows, LONG).write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_suffixes(spark, str(tmp_path))
    assert len(got.collect()) == 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReusedExchange \[key#\d+L?, text#", plan)


def test_ranges_of_long_texts_are_as_of_short_ones(monkeypatch):
    from reelquarry.llm import suffixes

    rnd = random.Random(6)
    text = "".join(rnd.choices("abcd ", k=5_000)).encode()
    ((hashes, pos, first, last),) = suffixes.anchors([text], 64, 16)
    level = np.arange(len(pos)) % 2 + 1
    args = ([text], np.zeros(len(pos), np.int64), level, hashes, pos, first, last, 64)
    whole = suffixes._ranges(*args)
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, suffixes._ranges(*args), strict=True))
