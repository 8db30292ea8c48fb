"""Work and disk that grew with every text, not with those that need it."""

import random

from pyspark.sql import functions as F

from fallow.llm import license_scan, minmax_dedup, packing, secret_scan
from fallow.operators import graph
from fallow.session import settle
from tests.llm import brute


def test_words_are_taken_of_texts_that_may_meet_a_template(spark):
    texts = {
        1: "Released under the MIT License",
        2: "released undermit licence",  # lacks a word of the notice
        3: "This work is licensed under a Creative Commons Attribution 4.0 International License",
        4: "xattribution sharealike This work is licensed under a Creative Commons Attribution 4.0 International License",  # a sibling's name ends inside a word
        5: "The committee released a limited license to the mit.",
        6: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lowered = F.lower("text")
    own, names = license_scan.words_of("Released under the MIT License"), ["license", "mit", "released"]
    may = docs.select("doc_id", license_scan.may_meet(lowered, own, 4, names, ["released"]).alias("m")).where("m")
    assert {r.doc_id for r in may.collect()} == {1, 5}
    free = docs.select("doc_id", license_scan.may_meet(lowered, own, 4, [], ["released", "mit"]).alias("m")).where("m")
    assert {r.doc_id for r in free.collect()} == {1, 5}  # an anchor and four words; 2 has three
    got = {r.doc_id: set(r.labels) for r in license_scan.scan_licenses(docs).collect()}
    assert got[1] == {"mit", "mit-notice"} and "cc-by-4.0" in got[3] and "cc-by-4.0" in got[4] and got[6] == set()


def test_stored_texts_are_dense(spark):
    docs = spark.createDataFrame([(1, "plain"), (2, None)], "doc_id long, text string")
    rows = secret_scan.stored(docs, "text", doc=F.struct("doc_id", "text"))
    assert all(".zstd." in f for f in rows.inputFiles()) and rows.count() == 2


def test_copies_of_one_text_meet_in_few_pairs(spark, monkeypatch):
    """Copies with so many changes that a pair in sixty is linked: groups as by all pairs, links not."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(700):
        words = list(base)
        for at in draw.sample(range(150), draw.randint(2, 3)):
            words[at] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [texts[0], " ".join(base[:75]), "alone " * 9]
    counts = []
    links = minmax_dedup._links
    monkeypatch.setattr(minmax_dedup, "_links", lambda *a: counts.append(links(*a)) or counts[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(docs, 5, 80).collect()}
    assert got == brute.near_groups(list(enumerate(texts)), 5, 80)
    assert counts[0].count() < 3 * len(texts)


def test_strings_of_letters_are_merged_uncut(monkeypatch):
    enc = packing.CachedEncoder(packing.VOCABULARY)
    texts = ["plain words", "Thndhain ONHALYTI qzxv", "it's 12, caf\u00e9 \u00c9T\u00c9 x\x1cy"]
    whole = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    read = lambda found: [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in found]
    assert read(enc.encode(texts)) == whole
    enc.known.clear()
    monkeypatch.setattr(enc, "_pieces", None)
    assert read(enc.encode(texts[:2])) == whole[:2]


def many_partitions(monkeypatch, spark, *modules):
    """Shuffles are left in 64 partitions; the files of each table that the modules store."""
    files = []

    def stored(df, *more):
        files.append(len((table := settle(df, *more)).inputFiles()))
        return table

    for module in modules:
        monkeypatch.setattr(module, "settle", stored)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("64", "false"), strict=True):
        spark.conf.set(k, v)
    return files, before


def test_small_tables_of_near_copies_take_few_tasks(spark, monkeypatch):
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(base[:at] + [f"x{draw.randrange(10**6)}"] + base[at + 1 :]) for at in range(120)] + [f"alone {i} of all others" for i in range(200)]
    files, before = many_partitions(monkeypatch, spark, minmax_dedup, graph)
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(docs, 5, 80).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.near_groups(list(enumerate(texts)), 5, 80)
    # the last pairs are not counted before they are stored
    assert len([n for n in files if n > spark.sparkContext.defaultParallelism]) <= 1


def test_links_with_the_smallest_id_join_in_one_round(spark, monkeypatch):
    links = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1, 299, 2)] + [(1000, 1001)], "i long, j long")
    files, before = many_partitions(monkeypatch, spark, graph)
    try:
        got = {r.id: r.root for r in graph.connected_parts(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000}
    assert len(files) == 3  # links, one step, no links


def test_words_with_a_sign_behind_or_accents_are_not_cut(monkeypatch):
    enc = packing.CachedEncoder(packing.VOCABULARY)
    texts = ["plain, words. (odd) a1 it' x\x1c b<", "café été ſa ªß ŉ naïve é", "abc<|endoftext|> a| <|endoftext|>", "Été, été, x\x85y"]
    read = lambda found: [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in found]
    assert read(enc.encode(texts)) == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert read(enc.encode(texts[:1])) == [enc.tokenizer.encode(texts[0], add_special_tokens=False).ids]
    enc.known.clear()
    enc.encode([", . ' ) ("])
    monkeypatch.setattr(enc, "_pieces", None)
    read(enc.encode(["plain, words. it'", "café naïve"]))  # no string is cut
