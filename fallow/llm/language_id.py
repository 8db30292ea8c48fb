"""Language identification by interpolated Kneser-Ney character models.

Text is reduced to letters, lowered, with one space for everything else.  For each
language the n-grams of `ORDER` characters are counted over all training documents;
lower orders use Kneser-Ney continuation counts, the number of different characters
seen before.  An n-gram is one 64-bit key of four 16-bit characters; all models lie in
sorted key arrays with one column per language, so a text is scored for all languages
by one binary search per character, and only n-grams that no language knows go on to
the next lower order.  The language with the lowest cross-entropy per character wins.

Counting is one pass with a partial count per partition.  Continuation counts, context
totals, discounts and probabilities are Spark aggregates and joins over all n-grams.  The
tables are stored sorted, in range partitions in the shared folder; only sums per language
reach the driver.  Tasks read the row groups that hold their texts' n-grams with pyarrow,
which must know the shared folder's file system, and keep at most `CACHE` bytes of them.

One fifth of the training documents is left out of the counts and calibrates: the
score is the share of right answers at a document's margin over the second language
(made monotone by pooling neighbours), and a document is rejected if its cross-entropy
lies over its language's mean by more than `SPREADS` standard deviations at its length
and by more than `CHANCE` of the way to chance, any character of the language's own
alphabet each time.  The alphabet has the most frequent characters that make up `COVERED`
of the language's text, so that neither another language nor rare letters raise the limit.

Defined results: null texts and texts without a letter are `und` with score 0 and are
rejected; without any training document all texts are; ties go to the language that
sorts first; rows without id are never learned from; repeated rows are counted as
often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallow.session import settle, shared_dir, ship_package

ORDER = 4
GROUP = 1 << 20  # bytes of a row group
CACHE = 128 << 20  # bytes of row groups that a Python worker holds
SPREADS = 8.0
CHANCE = 0.75
COVERED = 0.9999
FOLDS = 5
CHUNK = 1_000_000  # characters counted or scored at a time
MARGINS = 200
UNKNOWN = "und"


@functools.cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its character in the models (space unless a letter or mark), and whether it is a letter."""
    codes = np.full(0x110000, 32, np.uint64)
    letter = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        letter[i] = c.isalpha()
        if letter[i] or (i > 0x2FF and unicodedata.category(c)[0] == "M"):
            low = c.lower()
            code = ord(low) if len(low) == 1 else i
            codes[i] = code if code < 0x10000 else 0xE000 + code % 0x1900  # rare scripts share the private range
    codes[0] = 0  # parts documents
    return codes, letter


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all n-grams of the texts, the text that each belongs to, and each text's letters."""
    codes, letter = alphabet()
    raw = np.frombuffer("\0".join(["", *(t.replace("\0", " ") for t in texts)]).encode("utf-32-le"), np.uint32)
    c = codes[raw]
    text = np.cumsum(raw == 0) - 1
    letters = np.bincount(text[letter[raw]], minlength=len(texts))
    before = np.concatenate([[0], c[:-1]])
    keep = (c != 32) | ((before != 32) & (before != 0))
    c, text = c[keep], text[keep]
    past = c
    key = c.copy()
    for i in range(1, ORDER):
        past = np.concatenate([np.zeros(1, np.uint64), past[:-1]])
        if i > 1:
            past = np.where(last == 0, np.uint64(0), past)  # nothing of the text before
        last = past
        key |= past << np.uint64(16 * i)
    inside = c != 0
    return key[inside], text[inside], letters


def chunks(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts with about `size` characters."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of a partition; a key comes again when more are distinct than are held."""
    held: dict[str, list] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = _merged(parts)
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    size = lambda: sum(len(k) for parts in held.values() for k, _ in parts)
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for a, b in chunks(texts, CHUNK):
                held.setdefault(lang, []).append(np.unique(grams(texts[a:b])[0], return_counts=True))
                if size() > 4 * CHUNK:
                    held = {x: [_merged(parts)] for x, parts in held.items()}
                if size() > 2 * CHUNK:
                    yield from rows()
                    held = {}
    yield from rows()


def fold(key: Column) -> Column:
    """Remainder of crc32 of an id as text; rows without id fall into the held-out fold 0."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class Table(NamedTuple):
    keys: np.ndarray
    values: np.ndarray  # by key, then language

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys are there, and their values (any, where not)."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


_groups: OrderedDict[tuple[str, int], Table] = OrderedDict()  # of this process, the last used at the end
_held = 0  # their bytes


def _group(file: str, number: int) -> Table:
    """A row group of a stored table, from the cache if there."""
    global _held
    name = (file, number)
    if name in _groups:
        _groups.move_to_end(name)
        return _groups[name]
    system, path = pyarrow.fs.FileSystem.from_uri(file)
    with system.open_input_file(path) as source:
        rows = pyarrow.parquet.ParquetFile(source).read_row_group(number).combine_chunks()
    keys = rows["key"].to_numpy().view(np.uint64)
    group = Table(keys, rows["value"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1))
    _groups[name] = group
    _held += group.keys.nbytes + group.values.nbytes
    while _held > CACHE and len(_groups) > 1:
        old = _groups.popitem(last=False)[1]
        _held -= old.keys.nbytes + old.values.nbytes
    return group


@functools.lru_cache(maxsize=64)
def _index(files: tuple[str, ...]) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Row groups of a stored table in the order of their keys, and the first key of each."""
    found = []
    for file in files:
        system, path = pyarrow.fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as source:
            footer = pyarrow.parquet.ParquetFile(source).metadata
        found += [(footer.row_group(i).column(0).statistics.min, file, i) for i in range(footer.num_row_groups) if footer.row_group(i).num_rows]
    found.sort()
    return [(file, i) for _, file, i in found], np.array([first for first, _, _ in found], np.int64)


class Stored(NamedTuple):
    """A table in files of the shared folder, sorted by key as a signed number."""

    files: tuple[str, ...]
    languages: int

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys are there, and their values (any, where not)."""
        groups, firsts = _index(self.files)
        wanted, inverse = np.unique(keys.view(np.int64), return_inverse=True)
        found, values = np.zeros(len(wanted), bool), np.zeros((len(wanted), self.languages), np.float32)
        at = np.searchsorted(firsts, wanted, "right") - 1
        for i in np.unique(at[at >= 0]):
            a, b = np.searchsorted(at, [i, i + 1])
            group = _group(*groups[i])
            own = group.keys.view(np.int64)
            place = np.minimum(np.searchsorted(own, wanted[a:b]), len(own) - 1)
            found[a:b], values[a:b] = own[place] == wanted[a:b], group.values[place]
        return found[inverse], values[inverse]

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate([_group(*g).keys for g in _index(self.files)[0]])

    @property
    def values(self) -> np.ndarray:
        return np.concatenate([_group(*g).values for g in _index(self.files)[0]])


class Model(NamedTuple):
    languages: list[str]
    grams: list[Table] | list[Stored]  # log probability, by order from 1
    contexts: list[Table] | list[Stored]  # log weight of the lower order, by order from 1
    base: float  # log probability of an unseen character
    accuracy: np.ndarray  # by margin
    typical: np.ndarray  # by language: mean cross-entropy, and its variance at one character
    chance: np.ndarray  # by language: cross-entropy of even chances over its alphabet

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.base, np.float32)
        found, out = self.grams[order - 1].find(keys)
        if not found.all():
            miss = keys[~found]
            lower = self.log_probabilities(miss & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            known, weight = self.contexts[order - 1].find(miss >> np.uint64(16))
            out[~found] = np.where(known[:, None], weight, 0) + lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: cross-entropy per character for each language, characters, letters."""
        entropy = np.zeros((len(texts), len(self.languages)))
        sizes, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in chunks(texts, max(20_000, CHUNK // len(self.languages))):
            keys, text, letters[a:b] = grams(texts[a:b])
            starts, counts = np.unique(text, return_index=True, return_counts=True)[1:]
            if len(starts):
                own = a + text[starts]
                entropy[own] = -np.add.reduceat(self.log_probabilities(keys), starts, axis=0, dtype=np.float64) / counts[:, None]
                sizes[own] = counts
        return entropy, sizes, letters


def margin_bin(margin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.minimum(margin * np.sqrt(sizes) * 8, MARGINS - 1).astype(np.int64)


def chance_of(n: np.ndarray) -> float:
    """Log of one more than the characters, of counts n, that make up `COVERED` of a language."""
    n = np.sort(n[n > 0])[::-1]
    return float(np.log(np.searchsorted(np.cumsum(n), COVERED * n.sum()) + 2))


def discount_of(ones: int, twos: int) -> float:
    return float(min(0.95, max(0.1, ones / max(1, ones + 2 * twos))))


def _sorted_table(df: DataFrame, languages: int) -> Stored:
    """`df` (key, value: one number a language) in files of the shared folder, in range partitions sorted by key."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    rows = df.select("key", F.transform("value", lambda v: F.log(v).cast("float")).alias("value")).orderBy("key")
    rows.write.option("parquet.block.size", GROUP).option("parquet.enable.dictionary", "false").parquet(path)
    return Stored(tuple(sorted(spark.read.schema("key long, value array<float>").parquet(path).inputFiles())), languages)


def stored_model(counted: DataFrame) -> Model | None:
    """Tables of all languages from stored n-gram counts (lang, key, n); None without any."""
    languages = sorted(x for (x,) in counted.select("lang").distinct().collect())
    if not languages:
        return None
    each = range(len(languages))
    counts = [counted.groupBy("key").agg(F.array(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in languages]).alias("n"))]
    for o in range(ORDER - 1, 0, -1):  # continuation counts
        counts[0] = settle(counts[0])
        suffix = F.col("key").bitwiseAND(F.lit((1 << 16 * o) - 1))
        counts.insert(0, counts[0].groupBy(suffix.alias("key")).agg(F.array(*[F.count_if(F.col("n")[i] > 0) for i in each]).alias("n")))
    counts[0] = settle(counts[0])
    base = 1.0 / (counts[0].count() + 1)

    grams, contexts, lower = [], [], None
    for o, own in enumerate(counts, 1):
        few = own.agg(*[F.count_if(F.col("n")[i] == k) for i in each for k in (1, 2)]).first()
        discounts = [discount_of(few[2 * i], few[2 * i + 1]) for i in each]
        context = F.shiftrightunsigned("key", 16)
        summed = own.groupBy(context.alias("context")).agg(
            F.array(*[F.sum(F.col("n")[i]) for i in each]).alias("total"),
            F.array(*[F.count_if(F.col("n")[i] > 0) for i in each]).alias("kinds"),
        )
        weight = F.array(*[F.when(F.col("total")[i] > 0, F.lit(discounts[i]) * F.col("kinds")[i] / F.col("total")[i]).otherwise(1.0) for i in each])
        summed = settle(summed.select("context", "total", weight.alias("weight")))
        rows = own.withColumn("context", context).join(summed, "context")
        if o == 1:
            rows = rows.withColumn("lower", F.array(*[F.lit(base) for _ in each]))
        else:
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 16 * (o - 1)) - 1))).join(lower.select(F.col("key").alias("suffix"), F.col("value").alias("lower")), "suffix")
        share = lambda i: F.when(F.col("total")[i] > 0, F.greatest(F.col("n")[i] - F.lit(discounts[i]), F.lit(0.0)) / F.col("total")[i]).otherwise(0.0)  # noqa: B023, E731
        lower = rows.select("key", F.array(*[share(i) + F.col("weight")[i] * F.col("lower")[i] for i in each]).alias("value"))
        if o < ORDER:
            lower = settle(lower)
        grams.append(_sorted_table(lower, len(languages)))
        contexts.append(_sorted_table(summed.select(F.col("context").alias("key"), F.col("weight").alias("value")), len(languages)))
    never = np.column_stack([np.full(len(languages), np.inf), np.zeros(len(languages))])
    character = F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("character")  # of 16 bits, so few rows
    seen = counts[-1].groupBy(character).agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in each]).toArrow()
    chance = np.array([chance_of(seen[f"n{i}"].to_numpy()) for i in each])
    return Model(languages, grams, contexts, float(np.log(base)), np.zeros(MARGINS), never, chance)


def build_model(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Tables of all languages from n-gram counts in memory; `stored_model` gives the same from a table of any size."""
    languages = sorted(counts)
    levels: dict[str, list] = {}  # by language, by order from 1: keys, discounted share, contexts, lower weight
    alphabets = []
    for lang in languages:
        keys, n = counts[lang]
        order = np.argsort(keys)
        keys, n, own = keys[order], n[order].astype(float), []
        for o in range(ORDER, 0, -1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = discount_of(ones, twos)
            contexts, inverse, kinds = np.unique(keys >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(inverse, weights=n)
            own.insert(0, (keys, np.maximum(n - discount, 0) / total[inverse], contexts, discount * kinds / total))
            if o > 1:  # continuation counts
                keys, n = np.unique(keys & np.uint64((1 << 16 * (o - 1)) - 1), return_counts=True)
                n = n.astype(float)
        levels[lang] = own
        alphabets.append(own[0][0])
    base = 1.0 / (len(np.unique(np.concatenate(alphabets))) + 1)

    def look(keys, values, wanted, missing):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def probability(lang: str, order: int, wanted: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(wanted), base)
        keys, share, contexts, weight = levels[lang][order - 1]
        lower = probability(lang, order - 1, wanted & np.uint64((1 << 16 * (order - 1)) - 1))
        return look(keys, share, wanted, 0.0) + look(contexts, weight, wanted >> np.uint64(16), 1.0) * lower

    tables, weights = [], []
    for o in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([levels[x][o - 1][0] for x in languages]))
        tables.append(Table(keys, np.log(np.stack([probability(x, o, keys) for x in languages], axis=1)).astype(np.float32)))
        contexts = np.unique(np.concatenate([levels[x][o - 1][2] for x in languages]))
        weights.append(Table(contexts, np.log(np.stack([look(*levels[x][o - 1][2:], contexts, 1.0) for x in languages], axis=1)).astype(np.float32)))
    never = np.column_stack([np.full(len(languages), np.inf), np.zeros(len(languages))])
    chance = np.array([chance_of(np.bincount((counts[x][0] & np.uint64(0xFFFF)).astype(np.int64), weights=counts[x][1])) for x in languages])
    return Model(languages, tables, weights, float(np.log(base)), np.zeros(MARGINS), never, chance)


def pooled(right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares right / n made to rise with the bin, by pooling neighbours; a bin counts one right and one wrong answer more."""
    blocks: list[list[float]] = []
    for r, m in zip(right + 1, n + 2, strict=True):
        blocks.append([r, m, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(size), r / m) for r, m, size in blocks])


def _own(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    return docs.select(fold(F.col(key)).alias("fold"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Models and calibration from the documents outside fold 0; None without any n-gram."""
    spark = docs.sparkSession
    ship_package(spark)
    given = _own(docs, key, text, lang)
    counted = given.where("fold > 1").select("lang", "text").mapInArrow(_counter, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    model = stored_model(settle(counted))
    if model is None:
        return None

    scored = given.where("fold = 1").select("lang", "text").mapInArrow(
        _scorer(spark.sparkContext.broadcast(model)), "lang string, lang_pred string, margin_bin long, entropy double, sizes double"
    )
    scored = settle(scored)
    bins = scored.groupBy("margin_bin").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("long"))).collect()
    totals, right = np.zeros(MARGINS), np.zeros(MARGINS)
    for b, count, good in bins:
        totals[b], right[b] = count, good
    weight = F.least("sizes", F.lit(400.0))
    moments = scored.groupBy("lang_pred").agg(F.avg("entropy"), F.avg(weight), F.avg(weight * F.col("entropy")), F.avg(weight * F.col("entropy") * F.col("entropy"))).collect()
    typical = model.typical.copy()
    for x, mean, w, first, second in moments:
        typical[model.languages.index(x)] = mean, max(0.0, second - 2 * mean * first + mean * mean * w)
    return model._replace(accuracy=pooled(right, totals), typical=typical)


def _best(entropy: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winner, its cross-entropy, and the margin over the second (over an unseen character with one language)."""
    winner = entropy.argmin(axis=1)
    ordered = np.sort(np.column_stack([entropy, np.full(len(entropy), np.inf)]), axis=1)
    second = np.where(np.isinf(ordered[:, 1]), -base, ordered[:, 1])
    return winner, ordered[:, 0], np.maximum(0, second - ordered[:, 0])


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            entropy, sizes, letters = m.entropies(batch["text"].to_pylist())
            winner, least, margin = _best(entropy, m.base)
            rows = pa.record_batch(
                [batch["lang"], pa.array([m.languages[w] for w in winner], pa.string()), pa.array(margin_bin(margin, sizes)), pa.array(least), pa.array(sizes.astype(float))],
                names=["lang", "lang_pred", "margin_bin", "entropy", "sizes"],
            )
            yield rows.filter(pa.array(letters > 0))

    return run


def judge(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """By text: language, score, cross-entropy, rejected."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
    entropy, sizes, letters = model.entropies([t or "" for t in texts])
    winner, least, margin = _best(entropy, model.base)
    known = letters > 0
    mean, variance = model.typical[winner].T
    limit = np.maximum(mean + SPREADS * np.sqrt(variance / np.clip(sizes, 1, 400)), mean + CHANCE * (model.chance[winner] - mean))
    score = np.where(known, model.accuracy[margin_bin(margin, sizes)], 0.0)
    names = [model.languages[w] if k else UNKNOWN for w, k in zip(winner, known, strict=True)]
    return names, score, np.where(known, least, 0.0), ~known | (least > limit)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, entropy, rejected = judge(shared.value, batch["text"].to_pylist())
            yield pa.record_batch(
                [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    own = docs.select(F.col(key).cast("long").alias("doc_id"), (fold(F.col(key)) == 0).alias("held_out"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def recognised(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~judge(shared.value, batch.column(column).to_pylist())[3]))

    return docs.mapInArrow(run, docs.schema)
