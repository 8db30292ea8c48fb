import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute
from tests.llm.conftest import plain

from fallow.llm import filter_audit, lexical, queries, token_files
from fallow.llm.queries import new_folder, table

# --- filter audit ---------------------------------------------------------------------------------


def failures(text, repeats):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        c
        for c, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)),
            ("D", bool(re.search("[#$%&*|]", text))), ("E", repeats),
        )
        if bad
    }


def audit_by_hand(docs, labels):
    """docs: (id, text, lang); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = [(p or "", failures(t or "", i is not None and i > least[t or ""]), i in good, i in toxic) for i, t, p in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in own if letter in r[1] and not r[1] & before]
                removed[letter] += len(here)
                out[part, "".join(order), step] = [
                    sum(not r[1] & (before | {letter}) for r in own), len(here), sum(letter in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {letter} for r in own), sum(r[2] for r in here), sum(r[3] for r in here),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed[order[step - 1]])
    return out


METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(rows):
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): [r[m] for m in METRICS] for r in rows}


def test_audit_equals_all_orders_by_hand(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, sf_dir, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, sf_dir, "labels").collect()]
    assert audited(queries.op11_filter_audit(spark, sf_dir).collect()) == audit_by_hand(docs, labels)


def test_audit_of_nulls_repeats_and_extra_columns(spark, nasty_docs, no_docs):
    texts = ["same", "same", "SHOUT # a", None, "", "w " * 200, " ".join(map(str, range(200)))]
    rows = [(i, t, p) for i, (t, p) in enumerate(zip(texts, ["en", "de", None, "", "en", "en", "en"], strict=True))]
    rows += [(None, "same", "en"), (None, "w " * 200, "fr"), (0, "same", "en"), (0, "same", "de"), (9, "same", "en"), (9, "same", "en")]
    docs = spark.createDataFrame([(*r, "m", 1, "d") for r in rows], "doc_id long, text string, lang string, mask string, n int, digest string")
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (2, None, None), (9, 0, 1), (None, 1, 1), (77, 1, 1)]
    marks = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert audited(filter_audit.audit_filters(docs, marks).collect()) == audit_by_hand(rows, labels)
    assert filter_audit.audit_filters(no_docs, marks).collect() == []
    odd = [(r.doc_id, r.text, r.lang) for r in nasty_docs.collect()]
    assert audited(filter_audit.audit_filters(nasty_docs, marks.limit(0)).collect()) == audit_by_hand(odd, [])


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "ab", "x"), (3, "b", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    cells, letters = filter_audit.mask_cells(docs, labels, lambda t: {"P": t.contains("a")}, repeat="R")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost) for r in filter_audit.audit(cells, letters).collect()}
    assert got == {("PR", 1): (1, 2, 0, 1), ("PR", 2): (1, 0, 1, 0), ("RP", 1): (2, 1, 0, 0), ("RP", 2): (1, 1, 1, 1)}


def test_audit_spreads_a_text_that_many_rows_share(spark):
    """Copies are counted before they are shuffled by text."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) as text", "'en' as lang")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells, _ = filter_audit.mask_cells(docs, marks)
    by_mask = {r["mask"]: r["n"] for r in cells.collect()}
    assert by_mask == {1: 20_000 - 6_667 + 1, 1 | 16: 6_666}
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "partial_sum" in plan


# --- ranked search --------------------------------------------------------------------------------


def found_by_hand(docs, items, k=50):
    """Sorted (item, rank, doc, score) by scoring every document for every item."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = [(i, Counter(term.findall(brute.lower(t)))) for i, t in docs]
    words = [(i, c, sum(c.values())) for i, c in words if c]
    n_docs, size = len(words), sum(n for *_, n in words)
    df = Counter(w for _, c, _ in words for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in words:
            m = 100 - 50 + (50 * n * n_docs) // size
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m))
                for w in set(term.findall(brute.lower(text))) if w in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_search_equals_scoring_everything(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert found(queries.op12_lexical_search(spark, sf_dir)) == found_by_hand(docs, items)


def test_search_of_nulls_ties_and_odd_texts(spark, nasty_docs, no_docs, monkeypatch):
    docs = nasty_docs.select("doc_id", "text", "score", "source")
    docs = docs.unionByName(spark.createDataFrame([(None, "mit license", 0.5, "s"), (None, "mit license", 0.5, "s"), (300, "mit license", 1.0, "s")], "doc_id long, text string, score double, source string"))
    asked = [(1, "MIT license word"), (2, None), (3, "..."), (None, "é ß ü"), (1, "a b c mit"), (4, "nowhere"), (5, "😀 ſ K")]
    items = spark.createDataFrame([(i, t, 7) for i, t in asked], "item_id int, text string, rank int")
    given_docs = [(r.doc_id, r.text) for r in docs.collect()]
    want = found_by_hand(given_docs, asked, k=3)
    assert found(lexical.search(docs, items, k=3)) == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 4)  # several passes
    assert found(lexical.search(docs, items, k=3)) == want
    assert lexical.search(no_docs, items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []


LISTS = st.lists(st.dictionaries(st.integers(0, 199), st.integers(0, 9), min_size=1, max_size=199), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(LISTS, st.integers(1, 30), st.integers(1, 5))
def test_run_keeps_every_document_that_may_win(lists, beat, k):
    made = [(np.array(sorted(x)), np.array([x[i] for i in sorted(x)], np.int64), max(x.values())) for x in lists]
    total = Counter()
    for x in lists:
        total.update(x)
    rows, scores = lexical.top_of_run(made, 200, beat, k)
    got = dict(zip(rows.tolist(), scores.tolist(), strict=True))
    assert all(total[i] == s >= beat for i, s in got.items())
    best = sorted((s for s in total.values() if s >= beat), reverse=True)
    least = best[k - 1] if len(best) >= k else beat
    assert {i for i, s in total.items() if s >= least and s > 0} <= set(got)


# --- token files ----------------------------------------------------------------------------------


def test_token_files_hold_every_id_in_order(spark, sf_dir):
    tokens = brute.token_pieces([(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()])
    got = {r["doc_id"]: r for r in plain(queries.op13_token_files(spark, sf_dir))}
    assert set(got) == set(tokens)
    at = 0
    for i in sorted(tokens):
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(tokens[i]), zlib.crc32(tokens[i].tobytes()))
        at += len(tokens[i])


def stream(spark, folder):
    """The whole stream from the files: (doc, ids) in order."""
    rows = token_files.read_tokens(spark, folder).orderBy("part", "at").collect()
    return [(r.doc_id, r.ids) for r in rows]


def test_token_files_of_nasty_rows(spark, nasty_docs, no_docs):
    extra = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    docs = nasty_docs.withColumn("part", nasty_docs.lang).unionByName(extra, allowMissingColumns=True)
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs, folder)
    rows = stream(spark, folder)
    ids = [i for i, _ in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == docs.count()
    want = Counter((r.doc_id, tuple(brute.token_pieces([(0, r.text)])[0].tolist())) for r in docs.collect())
    assert Counter((i, tuple(x)) for i, x in rows) == want
    whole = [t for _, x in rows for t in x]
    starts = sorted((r.start, r.n_tokens) for r in token_files.places(spark, folder).collect())
    assert [s for s, _ in starts] == [sum(len(x) for _, x in rows[:n]) for n in range(len(rows))]
    for first, last in ((0, 1), (5, 40), (100, 60_300), (len(whole) - 3, len(whole) + 9), (7, 7), (len(whole), len(whole) + 1)):
        pieces = token_files.window(spark, folder, first, last).orderBy("start").collect()
        assert [t for p in pieces for t in p.ids] == whole[first:last]
        assert all(p.start == min(p.start, last) >= first for p in pieces)
    empty = new_folder(spark, "tokens")
    token_files.write_tokens(no_docs, empty)
    assert token_files.read_back(spark, empty).collect() == [] and token_files.window(spark, empty, 0, 9).collect() == []


def test_token_files_can_be_read_in_part(spark, sf_dir):
    """Encodings, bounded row groups, page indexes; a reader of places asks for no token column."""
    folder = new_folder(spark, "tokens")
    sizes = token_files.Sizes(file_rows=50, group_bytes=20_000, page_bytes=4_000, page_rows=20)
    given = table(spark, sf_dir, "documents")
    many = given.union(given.withColumn("doc_id", given.doc_id + 1000)).union(given.withColumn("doc_id", given.doc_id + 2000))
    token_files.write_tokens(many, folder, sizes=sizes)
    names = [f for f in token_files.read_tokens(spark, folder).inputFiles()]
    assert len(names) == max(12, spark.sparkContext.defaultParallelism)
    groups = 0
    for name in names:
        meta = pq.ParquetFile(name.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            groups += 1
            columns = {c.path_in_schema: c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "at", "n_tokens"))
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert groups > len(names)
    plan = token_files.places(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan
    some = token_files.read_tokens(spark, folder).where("doc_id between 10 and 12")
    assert "GreaterThanOrEqual(doc_id,10)" in some._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in some.orderBy("doc_id").collect()] == [10, 11, 12]
