import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute
from tests.llm.conftest import NASTY, plain
from tests.oracle import connect, differences

from fallow.llm import language_id, minmax_dedup, queries
from fallow.llm.components import components


def test_statements(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in queries.SQL.items():
        found = differences(spark, con, queries.QUERIES[name], sql, sf_dir)
        assert found in ("", "no rows"), (name, found)




def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(1000, 1090)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5)] + edges[:20]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_equal_all_comparisons(spark):
    for name in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
        given_ = [(r.doc_id, r.text) for r in docs.collect()]
        for width, percent in ((3, 85), (5, 80)):
            got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(docs, width, percent).collect()}
            assert got == brute.near_groups(given_, width, percent)


def test_chains_and_large_groups_of_near_copies(spark):
    """A text that changes a little at each step: neighbours are linked, ends are not; and many changes of one text."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows, text = [], list(words)
    for i in range(40):
        rows.append((1000 - i, " ".join(text)))
        text[rng.randrange(len(text))] = f"x{i}"
    base = [f"v{i}" for i in range(150)]
    for i in range(150):
        other = list(base)
        for _ in range(rng.randrange(4)):
            other[rng.randrange(len(other))] = f"y{rng.randrange(50)}"
        rows.append((2000 + i, " ".join(other)))
    half = [f"u{i}" for i in range(60)]
    rows += [(3000 + i, " ".join(half + [f"z{i}_{j}" for j in range(rng.randrange(5, 60))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(df).collect()}
    assert got == brute.near_groups(rows)


def test_near_duplicates_of_nasty_texts(spark, nasty_docs, no_docs):
    rows = minmax_dedup.near_duplicates(nasty_docs).collect()
    want = brute.near_groups([(i, t) for i, t in enumerate(NASTY)] + [(100, None), (101, "word " * 60_000), (102, "x" * 100_000)])
    assert len(rows) == nasty_docs.count()
    assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in rows)
    assert minmax_dedup.near_duplicates(no_docs).collect() == []
    odd = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "alone it stands"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_shingles, r.component_id or 0, r.kept) for r in minmax_dedup.near_duplicates(odd).where("doc_id is null").collect())
    assert got == [(0, 0, True), (1, 0, True), (2, 3, False)]


def test_rows_without_id_link_go_and_stay_like_others(spark):
    words = [f"w{i}" for i in range(100)]
    near = lambda base, i: " ".join([*base[:i], "other", *base[i + 1 :]])
    alone = [f"u{i}" for i in range(100)]
    rows = [(5, " ".join(words)), (None, near(words, 0)), (None, near(words, 99)), (8, near(words, 50)), (None, " ".join(alone)), (None, near(alone, 0)), (None, near(alone, 99)), (None, None), (None, "")]
    # a row without id links two others that are no neighbours of each other
    rows += [(21, " ".join(f"c{i}" for i in range(0, 60))), (None, " ".join(f"c{i}" for i in range(3, 63))), (20, " ".join(f"c{i}" for i in range(6, 66)))]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = minmax_dedup.near_duplicates(df, 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got if r.n_shingles == 98) == sorted(
        [(5, 5, True), (8, 5, False), (0, 5, False), (0, 5, False), (0, 0, True), (0, 0, False), (0, 0, False)])
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.n_shingles == 58) == [(0, 20, False), (20, 20, True), (21, 20, False)]
    left = minmax_dedup.without_copies(df, 3, 85)
    assert left.columns == df.columns
    kept = sorted((r.doc_id or 0, r.row) for r in left.collect())
    assert [k for k, _ in kept] == [0, 0, 0, 5, 20] and {r for _, r in kept} >= {0, 7, 8, 11}


def test_min_and_max_both_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    values = minmax_dedup.signatures([np.sort(a), np.sort(b)], minmax_dedup.permutations(400, 1))
    agree = values[0] == values[1]
    assert abs(agree[0::2].mean() - 600 / 1400) < 0.08 and abs(agree[1::2].mean() - 600 / 1400) < 0.08


def test_band_shape_misses_little():
    for s in (0.5, 0.8, 0.85, 0.95):
        rows, bands = minmax_dedup.band_shape(s)
        assert (1 - s**rows) ** bands <= 1e-6


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_accuracy_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    own = [r for r in rows if r.held_out]
    assert {r.doc_id for r in own} == {i for i in truth if held_out(i)}
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)


def test_labels_of_the_held_out_are_not_used(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hidden = docs.withColumn("lang", language_id.F.when(language_id.fold(language_id.F.col("doc_id")) > 0, language_id.F.col("lang")))
    one, two = (language_id.learn(d) for d in (docs, hidden))
    assert one.languages == two.languages and all((x.values == y.values).all() for x, y in zip(one.grams, two.grams, strict=True))


def test_languages_of_nasty_texts(spark, nasty_docs, no_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs)
    rows = plain(language_id.predict(nasty_docs, model))
    assert len(rows) == nasty_docs.count()
    for r in rows:
        text = NASTY[r["doc_id"]] if r["doc_id"] < 100 else {100: None, 101: "word", 102: "x"}[r["doc_id"]]
        none = not text or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == none and (not none or r["rejected"] and r["score"] == 0)
    left = language_id.recognised(nasty_docs, model)
    assert left.columns == nasty_docs.columns and left.count() == sum(not r["rejected"] for r in rows)
    assert language_id.learn(nasty_docs) is None and language_id.learn(no_docs) is None
    assert {r["lang_pred"] for r in plain(language_id.predict(nasty_docs, None))} == {"und"}
    assert language_id.predict(no_docs, model).collect() == []
    noise = spark.createDataFrame([(1, "ঋঌএঐ ওঔকখ গঘঙচ " * 20), (2, docs.first().text)], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in language_id.predict(noise, model).collect()} == {1: True, 2: False}


def kneser_ney(counts, text, order=language_id.ORDER):
    """Probabilities by the recursion on dictionaries, for one language."""
    levels = {order: dict(counts)}
    for o in range(order - 1, 0, -1):
        levels[o] = {}
        for g in levels[o + 1]:
            levels[o][g[1:]] = levels[o].get(g[1:], 0) + 1
    discounts = {}
    for o, own in levels.items():
        ones, twos = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        discounts[o] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
    base = 1 / (len(levels[1]) + 1)

    def p(gram):
        o = len(gram)
        if o == 0:
            return base
        peers = [n for g, n in levels[o].items() if g[:-1] == gram[:-1]]
        lower = p(gram[1:])
        if not peers:
            return lower
        d, total = discounts[o], sum(peers)
        return max(levels[o].get(gram, 0) - d, 0) / total + d * len(peers) / total * lower

    return [p(text[i : i + order]) for i in range(len(text) - order + 1)]


def as_key(gram):
    return sum(ord(c) << 16 * i for i, c in enumerate(reversed(gram)))


@given(st.lists(st.text(alphabet="abc ", min_size=1, max_size=30), min_size=1, max_size=4), st.text(alphabet="abcd ", min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_model_equals_the_recursion(texts, other):
    keys, _, _ = language_id.grams([t + "a" for t in texts])
    unique, n = np.unique(keys, return_counts=True)
    name = lambda k: "".join(chr(int(k) >> 16 * i & 0xFFFF) for i in (3, 2, 1, 0))
    model = language_id.build_model({"x": (unique, n)})
    asked = np.unique(language_id.grams([other + "a"])[0])
    got = np.exp(model.log_probabilities(asked)[:, 0])
    counts = {name(k): int(c) for k, c in zip(unique, n, strict=True)}
    want = [kneser_ney(counts, name(k))[0] for k in asked]
    assert np.allclose(got, want, rtol=1e-4)


def test_grams_of_texts():
    keys, text, letters = language_id.grams(["Ab", "", "1 c!\0d", "  "])
    name = lambda k: "".join(chr(int(k) >> 16 * i & 0xFFFF) for i in (3, 2, 1, 0))
    assert [(name(k), int(t)) for k, t in zip(keys, text, strict=True)] == [("\0\0\0a", 0), ("\0\0ab", 0), ("\0\0\0c", 2), ("\0\0c ", 2), ("\0c d", 2)]
    assert list(letters) == [2, 0, 2, 0]


def test_stored_tables_hold_every_gram(spark, monkeypatch):
    """More 4-grams than any bound that a driver would hold, in small row groups and a cache smaller than the tables."""
    monkeypatch.setattr(language_id, "GROUP", 1 << 16)
    monkeypatch.setattr(language_id, "CACHE", 1 << 16)
    rng = np.random.default_rng(1)
    own = {"one": rng.integers(0x4E00, 0x5200, 400_000), "two": rng.integers(0x61, 0x7B, 50_000)}
    texts = {x: ["".join(map(chr, c[i : i + 5000])) for i in range(0, len(c), 5000)] for x, c in own.items()}
    rows = [(i, t, x) for i, (x, t) in enumerate((x, t) for x in texts for t in texts[x])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {}
    for x in texts:
        learned = [t for i, t, y in rows if y == x and zlib.crc32(str(i).encode()) % 5 > 1]
        counts[x] = np.unique(language_id.grams(learned)[0], return_counts=True)
    stored, want = language_id.learn(docs), language_id.build_model(counts)
    assert len(counts["one"][0]) > 200_000 and stored.base == want.base
    assert len(language_id._index(stored.grams[3].files)[0]) > 1
    for a, b in zip(stored.grams + stored.contexts, want.grams + want.contexts, strict=True):
        order = np.argsort(a.keys)
        assert (a.keys[order] == b.keys).all() and np.allclose(a.values[order], b.values, atol=1e-5)
    asked = language_id.grams(texts["one"][:2] + texts["two"][:2] + ["qq\u4e00 x\u0431"])[0]
    assert np.allclose(stored.log_probabilities(asked), want.log_probabilities(asked), atol=1e-5)


def test_noise_beside_a_wide_alphabet_is_rejected(spark):
    """20000 characters of one language leave the limit of the others alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(2)
    wide = [(10**6 + i, "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 20_000, 5000))), "wide") for i in range(40)]
    alone = language_id.learn(docs)
    beside = language_id.learn(docs.unionByName(spark.createDataFrame(wide, docs.schema)))
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 400)) for _ in range(5)]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem"
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto"
    noise = [*letters, polish, finnish]
    real = [r.text for r in docs.where("length(text) > 200").limit(50).collect()]
    for model in (alone, beside):
        assert language_id.judge(model, noise)[3].all()
    assert (language_id.judge(beside, real)[3] == language_id.judge(alone, real)[3]).all()
    assert np.allclose(beside.chance[[beside.languages.index(x) for x in alone.languages]], alone.chance)
