import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute
from tests.llm.conftest import NASTY, plain

from fallow import session
from fallow.llm import chat_format, decontaminate, nearest, packing, queries


def in_order(rows):
    return sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", (r.text or "").encode()))


def test_chats_read_back(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    got = {r["conv_id"]: r for r in plain(queries.op5_chat_format(spark, sf_dir))}
    own = {}
    for r in in_order(rows):
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    own[-7] = [("user", queries.PLANTED_TURN), ("assistant", queries.PLANTED_TURN)]
    assert set(got) == set(own)
    for conv, turns in own.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute.conversation(turns)
        shown = sum(len("<turn><says></turn>") + len(chat_format.escape(a)) + len(chat_format.escape(b)) for a, b in turns)
        assert r["formatted_chars"] == shown


def test_chats_of_nasty_turns(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(None, None, None, None), (None, 2, "assistant", "x"), (2, 1, "as</turn>\\", "\\"), (2, 1, "as</turn>\\", "\\"), (3, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, tokens string")
    formatted = chat_format.format_chats(df)
    chunks = formatted.where("conv_id = 3").collect()
    assert len(chunks) > 1 and all(len(c.input_ids) == len(c.loss_mask) <= chat_format.CHUNK for c in chunks)
    own = {}
    for r in in_order(df.collect()):
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = chat_format.read_chats(formatted).collect()
    assert len(got) == len(own)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute.conversation(own[r.conv_id])
    assert chat_format.read_chats(chat_format.format_chats(df.limit(0))).collect() == []


def test_stored_chats_are_read_in_any_order(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", "long words " * 900) for i in range(400)] + [(2, 0, "assistant", "short")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    stored = session.settle(chat_format.format_chats(df).repartition(3, "chunk"))
    assert stored.where("conv_id = 1").count() > 5
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_chats(stored).collect()}
    assert got == {c: brute.conversation([(t[2], t[3]) for t in turns if t[0] == c]) for c in (1, 2)}
    for damaged in (stored.where("chunk != 2"), stored.where("not (conv_id = 1 and last)"), stored.union(stored.where("chunk = 1"))):
        with pytest.raises(Exception, match="must follow"):
            chat_format.read_chats(damaged).collect()


@given(st.text(alphabet="\\<>/turnsayx\n ", max_size=40))
def test_escape_is_reversible(text):
    shown = chat_format.escape(text)
    assert chat_format.unescape(shown) == text
    for c in chat_format.CONTROLS:  # a control string in content has a backslash before it
        at = shown.find(c)
        while at >= 0:
            run = len(shown[:at]) - len(shown[:at].rstrip("\\"))
            assert run % 2
            at = shown.find(c, at + 1)


def test_content_never_makes_reserved_ids():
    enc, ids = chat_format.encoding(chat_format.VOCABULARY), chat_format.reserved(chat_format.VOCABULARY)
    for t in [*NASTY, *chat_format.CONTROLS, "<|endoftext|>"]:
        assert max(enc.encode_ordinary(t), default=0) < min(ids.values())


@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.lists(st.sampled_from("abcd"), max_size=30))
@settings(max_examples=200)
def test_myers_equals_the_quadratic_recurrence(item, words):
    assert min([len(item), *decontaminate.myers(item, words)]) == brute.edits(item, words)


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.lists(st.sampled_from("abc"), max_size=60), st.sampled_from([0.0, 0.2, 0.4]))
@settings(max_examples=200)
def test_search_loses_no_match(item, words, rate):
    found = decontaminate.Matcher([(5, " ".join(item))], rate).search(" ".join(words))
    least = brute.edits(item, words)
    budget = int(rate * len(item))
    assert bool(found) == (least <= budget)
    if found:
        _, edits, _, m, first, end = found[0]
        assert edits == least and m == len(item)
        assert brute.edits(item, words[first:end]) == least


def test_leaks_equal_all_comparisons(spark, sf_dir):
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op8_decontaminate(spark, sf_dir).collect()}
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = decontaminate.words_of(r.text)
        for i, item in items:
            budget = int(decontaminate.RATE * len(item))
            if sum(w in set(words) for w in item) >= len(item) - budget:  # each missing word is an edit
                e = brute.edits(item, words)
                if e <= budget:
                    want[r.doc_id, i] = e
    assert want and got == want


def test_edited_passages_are_found_and_clean_documents_stay(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    words = item.text.split()
    changed = [*words[:5], "other", *words[6:12], *words[13:], "tail"]
    rows = [(1, "start of it. " + item.text.upper() + " and on"), (2, "x " + " ".join(changed)), (3, "nothing here"), (4, None), (5, ""), (None, item.text), (2, "x " + " ".join(changed))]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, item_id string")
    for size in (1 << 20, 2000):  # one block of items, and several
        hits = decontaminate.find_leaks(docs, bench, block_bytes=size)
        assert sorted(((r.doc_id or 0), r.edits) for r in hits.where(f"item_id = {item.item_id}").collect()) == [(0, 0), (1, 0), (2, 2), (2, 2)]
        left = decontaminate.without_leaks(docs, bench, block_bytes=size)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []


def test_words_of_any_script(spark):
    items = [(1, "吾輩は猫である。名前はまだ無い。"), (2, "the quick brown fox"), (3, "ceci n’est pas une pipe"), (4, "สวัสดีครับ")]
    docs = [(1, "昔の本に「吾輩は猫である。名前はまだ無い」と書いてある"), (2, "he said “the quick—brown fo­x” and left"), (3, "(Ceci n'est pas une pipe…)"),
            (4, "เขาพูดว่าสวัสดีครับแล้วไป"), (5, "吾輩は犬であった"), (6, "the quick browner fox"), (7, "“—” 😀 ­")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (1 << 20, 10):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench, block_bytes=size).collect()) == [(i, i) for i in range(1, 5)]
        assert sorted(r.doc_id for r in decontaminate.without_leaks(df, bench, block_bytes=size).collect()) == [5, 6, 7]
    assert decontaminate.words_of("É-tude​ 2½") == ["é".encode(), b"tude", "2½".encode()]


def test_packing_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = brute.token_pieces([(r.doc_id, r.text) for r in docs.collect()])
    rows = plain(queries.op9_pack(spark, sf_dir))
    padding, _ = brute.check_packing(rows, tokens)
    assert padding < 0.02
    by_step = {}
    for r in rows:
        by_step.setdefault(r["step_group"], set()).add(r["tier"])
    assert all(len(t) == 1 for t in by_step.values())


def test_step_groups_are_balanced_over_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(9)
    rows = plain(packing.pack_documents(docs, step_tokens=8192))
    steps = {}
    for r in rows:
        steps.setdefault((r["tier"], r["step_group"]), set()).add(r["sequence_id"])
    assert len({g for _, g in steps}) == len(steps)
    assert len({t for t, _ in steps}) == len(packing.TIERS)
    for tier in packing.TIERS:
        mine = [len(s) for (t, _), s in sorted(steps.items()) if t == tier]
        assert all(n * tier == 8192 for n in mine[:-1]) and 0 < mine[-1] * tier <= 8192


def test_packing_of_nasty_texts(spark, nasty_docs, no_docs):
    tokens = brute.token_pieces([(i, t) for i, t in enumerate(NASTY) if i != 7] + [(100, None), (101, "word " * 60_000), (102, "x" * 100_000)])
    for parts in (1, 5):
        rows = plain(packing.pack_documents(nasty_docs.where("doc_id != 7").repartition(parts)))
        brute.check_packing(rows, tokens)
    repeated = plain(packing.pack_documents(nasty_docs.where("doc_id = 7")))
    assert len(repeated) == 3 and {r["start"] for r in repeated} == {0}
    assert packing.pack_documents(no_docs).collect() == []


def test_encoder_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 8)
    enc = packing.CachedEncoder(packing.VOCABULARY)
    want = brute.token_pieces(enumerate(NASTY))
    for i, got in enumerate(enc.encode(NASTY)):
        assert list(np.frombuffer(got, "<u4")) == list(want[i][:-1])


ODD = ["a", "B", "é", "É", "'s", "'LL", "'", "!", "1", "½", "²", " ", "\x85", "\xa0", "\x1c", "<|", "|>", "<|endoftext|>", "ß", "ŉ", "ª", "Σ", "İ", "\n", "\u0301", "x"]
_encoder = packing.CachedEncoder(packing.VOCABULARY)


@given(st.lists(st.sampled_from(ODD), max_size=9))
@settings(max_examples=500)
def test_cut_strings_encode_like_the_tokenizer(parts):
    text = "".join(parts)
    assert list(np.frombuffer(_encoder.encode([text])[0], "<u4")) == _encoder.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 5000), max_size=60))
@settings(max_examples=50)
def test_packer_loses_nothing(sizes):
    packer = packing.Packer()
    for d, n in enumerate(sizes):
        packer.add(d, np.arange(n, dtype="<u4"))
    packer.pack()
    left = packer.lay()
    assert sum(len(p[2]) for p in left) < packing.TIERS[-1]
    seen = {}
    for tier, pieces in [*packer.done, (None, left)]:
        assert tier is None or sum(len(p[2]) for p in pieces) == tier
        for d, start, ids in pieces:
            assert list(ids[:1]) == [start]
            seen.setdefault(d, []).extend(ids.tolist())
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(sizes))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_neighbour_recall(spark, name):
    sf_dir = f"/root/testdata/{name}"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r.vec_id for r in rows]
    want = brute.neighbours(ids, [r.embedding for r in rows], [i for i in ids if i % 50 == 0])
    got = {}
    for r in sorted(queries.op10_nearest(spark, sf_dir).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    exact = {q: dict(v) for q, v in want.items()}
    hits = sum(v in exact[q] for q, found in got.items() for v, _ in found)
    assert hits >= 0.9 * 5 * len(want)
    assert all(abs(s - exact[q][v]) < 1e-12 for q, found in got.items() for v, s in found if v in exact[q])


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0] * 3), (7, [nan, 1.0, 0.0]),
            (8, [inf, 0.0, 0.0]), (9, [None, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = nearest.nearest(df, df.where("vec_id in (0, 4, 6)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 10, -1.0)]
    assert nearest.nearest(df.limit(0), df).collect() == []
    assert nearest.nearest(df, df.limit(0)).collect() == []


def test_very_large_and_very_small_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [3e307, 1e307]), (3, [-5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(nearest.nearest(df, df.where("vec_id = 0")).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got] == [2, 1, 3]
    assert np.allclose([r.score for r in got], [3 / 10**0.5, 0.5**0.5, -1])


def test_equal_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(i, rng.normal(size=4).tolist()) for i in range(300, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, df.where("vec_id % 50 = 0"), block=8).collect()
    for q in range(0, 300, 50):
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [v for _, v in mine] == [v for v in range(6) if v != q][:5]


def test_rows_of_one_id_with_different_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in nearest.nearest(df, df.where("vec_id = 0")).collect())
    a, b, c = round(0.5**0.5, 9), round(1 / 1.25**0.5, 9), round(0.5 / 1.25**0.5, 9)
    assert got == sorted([(1, 2, b), (2, 1, a), (3, 0, 0.0), (1, 1, a), (2, 2, c), (3, 0, 0.0)])


def test_neighbours_do_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    answers = lambda block: sorted(tuple(r) for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), probes=2, block=block).collect())
    assert answers(7) == answers(100) == answers(100_000)


def test_hadamard_is_a_rotation():
    rows = np.random.default_rng(1).normal(size=(5, 8))
    turned = nearest.rotate(rows, nearest.rotation_signs(8, 1, 0)[0])
    assert np.allclose(turned @ turned.T, rows @ rows.T)
