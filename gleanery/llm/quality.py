"""Quality rules: repetition and length rules, then n-gram perplexity bands of characters and of words.

The language model is an interpolated modified Kneser-Ney model over runs of
``ORDER`` characters, one per language and of that language's text alone, case
kept. Spark counts every run of every document; continuation counts, counts of
counts, discounts and back-off weights are aggregates over all of them, and
every counted run is in the model, however rare. Its keys are 64-bit (four
16-bit character codes) in sorted arrays. Per language, documents whose log
perplexity leaves the band around the median, in robust deviations, are
rejected on either side.

Beside it stands a model of word unigrams per language, absolutely discounted:
four characters of context learn the habits of junk that it was trained on,
words show them as words that hardly any other document has. Of a document's
mean each word counts ``REPEATS`` times at most, so that one frequent separator
does not make up for the rest. Documents above the word band are rejected.

Scale. Counting pre-aggregates per task, so the shuffle carries distinct runs
and words. What each costs stands in a table that grows with the corpus and is
never in one place whole. The executors get what makes up 1/``COMMON`` of all
text or more, which is bounded at any size and for any number of languages and
changes no result; occurrences of all else are joined to the table, so no key
of that join is hot. Texts are read once for scoring and not shuffled. Bands
come from a histogram with bins of fixed width. Statistics of languages are a
table too; languages beyond the ``MOST_LANGUAGES`` with most documents share
one model and one band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .blocks import blocks, offsets_of, tidy

ORDER = 4
#: Bins of log perplexity in the bands' histogram.
BIN = 0.002
#: Robust deviations (1.4826 times the median absolute deviation) below and above the median.
BELOW, ABOVE = 6.0, 10.0
#: The share of all words, and of all runs, that makes one common is 1 to this: so many are sent to the executors at most.
COMMON, COMMON_RUNS = 1 << 22, 1 << 24
#: Languages that have a model of their own.
MOST_LANGUAGES = 1024
#: How often a word counts in one document; the word band.
REPEATS, WORDS_ABOVE = 3, 3.0
#: Costs are whole numbers of this many to a nat, so that sums don't depend on their order.
UNITS = 1_000_000
#: Rejected texts that are sent to the executors, more are joined by a shuffle.
SENT = 1 << 18
MARK = "__text_mark"
#: Names the model that the languages beyond ``MOST_LANGUAGES`` share; no language's key is like it.
OTHERS = "*"
#: Bytes of text that are worked on at once: the arrays of a block take about 80 times as much.
WORK_BYTES = 1 << 20
HELD_KEYS = 1_000_000  # of a language that a task gathers before it sends them
START = 2  # stands before a text's first character

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


# Base rules


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's number, and the distinct values."""
    d = pa.array(values).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_numpy(zero_copy_only=False)


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[bounds])


def base_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text (no nulls)."""
    n = len(texts)
    data = np.frombuffer(b"".join(t.encode() for t in texts.to_pylist()), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    space = _SPACE[data]
    out = {"word_chars": _sums(~space & ((data & 0xC0) != 0x80), bounds), "n_symbols": _sums(_SYMBOL[data], bounds)}

    split = pc.ascii_split_whitespace(texts)
    flat, doc = split.flatten(), np.repeat(np.arange(n), np.diff(offsets_of(split)))
    real = pc.greater(pc.binary_length(flat), 0)
    doc = doc[real.to_numpy(zero_copy_only=False)]
    out["n_words"] = np.bincount(doc, minlength=n)
    repeat = np.zeros(len(doc), bool)
    if len(doc) > 2:
        w = flat.filter(real).dictionary_encode()
        code, size = w.indices.to_numpy().astype(np.int64), len(w.dictionary)
        pair, _ = _encode(code[:-2] * size + code[1:-1])
        triple, _ = _encode(pair.astype(np.int64) * size + code[2:])
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        key, _ = _encode(triple[inside].astype(np.int64) * n + doc[inside])
        often = inside[np.bincount(key)[key] > 1] if len(key) else inside
        for k in range(3):
            repeat[often + k] = True
    out["n_repeat_words"] = np.bincount(doc[repeat], minlength=n)

    split = pc.split_pattern(texts, "\n")
    flat, doc = split.flatten(), np.repeat(np.arange(n), np.diff(offsets_of(split)))
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    doc = doc[real.to_numpy(zero_copy_only=False)]
    code = flat.filter(real).dictionary_encode().indices.to_numpy().astype(np.int64)
    _, distinct = _encode(code * n + doc)
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(distinct % n, minlength=n)
    return out


# The language model


def language_key(lang: Column, rows: DataFrame) -> Column:
    """What a language is called inside: null, the empty string and any name have keys of their own."""
    key = F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang))
    first = rows.select(key.alias("l")).groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES + 1).collect()
    if len(first) <= MOST_LANGUAGES:
        return key
    return F.when(key.isin([r.l for r in first[:MOST_LANGUAGES]]), key).otherwise(OTHERS)


def run_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The key of the run that ends at each character, text after text, and the texts' bounds."""
    pad = chr(START) * (ORDER - 1)
    code = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), np.uint32)
    code = np.where(code > 0xFFFF, 0xE000 | (code & 0xFFF), code).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    key = code.copy()
    for k in range(1, ORDER):
        key[k:] |= code[:-k] << np.uint64(16 * k)
    ends = np.cumsum(lengths + ORDER - 1)
    keep = np.ones(len(code), bool)
    for k in range(ORDER - 1):
        keep[ends - lengths - ORDER + 1 + k] = False
    return key[keep].view(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def word_keys(texts: pa.Array, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and its language, text after text, and the number of the word's text."""
    import pandas as pd

    split = pc.ascii_split_whitespace(texts)
    flat, doc = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(offsets_of(split)))
    real = pc.greater(pc.binary_length(flat), 0)
    number, words = _encode(flat.filter(real))
    salt = pd.util.hash_array(np.array([lang], object), categorize=False)
    keys = pd.util.hash_array(words.astype(object), categorize=False) * np.uint64(0x9E3779B97F4A7C15) ^ salt
    return keys.view(np.int64)[number], doc[real.to_numpy(zero_copy_only=False)]


def _runs_of(texts: list[str], lang: str) -> np.ndarray:
    return run_keys(texts)[0]


def _words_of(texts: list[str], lang: str) -> np.ndarray:
    return word_keys(pa.array(texts, pa.string()), lang)[0]


def _count(keys_of: Callable) -> Callable:
    """Rows (l, key, n): the counts of the keys that ``keys_of`` finds in a task's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang) -> pa.RecordBatch:
            keys, counts = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["l", "key", "n"])

        for block in blocks(batches, 1, WORK_BYTES):
            langs = block.column(0).to_pylist()
            texts = block.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                keys = keys_of([t for t, other in zip(texts, langs, strict=True) if t and other == lang], lang)
                number, keys = _encode(keys)
                counts = np.bincount(number, minlength=len(keys))
                if lang in held:
                    keys, counts = np.concatenate([held[lang][0], keys]), np.concatenate([held[lang][1], counts])
                    number, keys = _encode(keys)
                    counts = np.bincount(number, counts, minlength=len(keys)).astype(np.int64)
                held[lang] = (keys, counts)
                if len(keys) > HELD_KEYS:
                    yield out(lang)
        for lang in list(held):
            if len(held[lang][0]):
                yield out(lang)

    return tidy(count)


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.1), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _discount(n: Column) -> Column:
    """The same over columns n1 to n4, for a run that was counted ``n`` times."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    of = lambda k, lower, upper: F.least(F.greatest(k - (k + 1) * y * F.col(upper) / F.col(lower), F.lit(0.1)), F.lit(float(k)))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    fine = F.when(n == 1, of(1, "n1", "n2")).when(n == 2, of(2, "n2", "n3")).otherwise(of(3, "n3", "n4"))
    return F.when(known, fine).otherwise(F.least(n, F.lit(3)) / 2)


def _with_language(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of languages beside rows: at most ``MOST_LANGUAGES`` and one."""
    return rows.join(F.broadcast(stats), "l")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(language_key(F.col(f"`{lang_col}`").cast("string"), docs).alias("l"), F.col(f"`{text_col}`").cast("string"))


def _orders(texts: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """From ``ORDER`` down: statistics of languages, and runs (count, probability above back-off, weight of the context)."""
    found = texts.mapInArrow(_count(_runs_of), "l string, key long, n long")
    table = cut(found.groupBy("l", "key").agg(F.sum("n").alias("n")))
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            # how many different characters stand before the run
            table = cut(table.groupBy("l", F.col("key").bitwiseAND((1 << 16 * n) - 1).alias("key")).agg(F.count("*").alias("n")))
        stats = table.groupBy("l").agg(F.count("*").alias("kinds"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)])
        rows = _with_language(table, stats).select("l", "key", "n", F.shiftrightunsigned("key", 16).alias("context"), (F.col("n") - _discount(F.col("n"))).alias("rest"))
        sums = rows.groupBy("l", "context").agg(F.sum("n").alias("all"), (1 - F.sum("rest") / F.sum("n")).alias("weight"))
        yield n, stats, rows.join(sums, ["l", "context"]).select("l", "key", "n", (F.col("rest") / F.col("all")).alias("p"), "weight")


def run_costs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON_RUNS) -> tuple[DataFrame, dict]:
    """What every run costs by its language's model, in ``UNITS``; per language the common runs' sorted keys and costs.

    From the lowest order up, a run's probability is that above back-off and
    its context's weight times the probability of the run without its first
    character, which was counted as well.
    """
    orders = list(_orders(_texts(docs, text_col, lang_col)))
    full = None
    for n, stats, runs in reversed(orders):
        if full is None:
            full = _with_language(runs, stats).select("l", "key", "n", (F.col("p") + F.col("weight") / (F.col("kinds") + 1)).alias("p"))
        else:
            lower = full.select("l", F.col("key").alias("end"), F.col("p").alias("less"))
            runs = runs.withColumn("end", F.col("key").bitwiseAND((1 << 16 * (n - 1)) - 1))
            full = runs.join(lower, ["l", "end"]).select("l", "key", "n", (F.col("p") + F.col("weight") * F.col("less")).alias("p"))
        if n < ORDER:
            # one plan for all orders is planned anew with each of its stages, which fills the driver; these tables are small
            full = cut(full)
    return _split(full.select("l", "key", "n", F.round(-F.log("p") * UNITS).cast("long").alias("cost")), common)


def _split(costs: DataFrame, common: int) -> tuple[DataFrame, dict]:
    """Costs of the rare keys as a table, and those of the common ones in sorted arrays per language."""
    costs = cut(costs)
    total = costs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, -(-total // common))
    got = costs.where(F.col("n") >= least).select("l", "key", "cost").orderBy("l", "key").toArrow()
    l = got.column("l").combine_chunks().dictionary_encode()
    key, price, code = got.column("key").to_numpy(), got.column("cost").to_numpy().astype(np.int32), l.indices.to_numpy(zero_copy_only=False)
    sent = {name: (key[code == i], price[code == i]) for i, name in enumerate(l.dictionary.to_pylist())}
    return costs.where(F.col("n") < least).select("l", "key", "cost"), sent


def _look_up(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the table has, and their costs (0: absent)."""
    if not len(table[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    known = table[0][at] == keys
    return known, np.where(known, table[1][at], 0).astype(np.int64)


def _lists(keys: np.ndarray, docs: np.ndarray, n: int) -> pa.Array:
    """A list of keys for each of ``n`` texts."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[np.argsort(docs, kind="stable")], pa.int64()))


def _by_language(langs: list) -> Iterator[tuple[str, np.ndarray]]:
    for lang in dict.fromkeys(langs):
        yield lang, np.array([i for i, other in enumerate(langs) if other == lang])


_NONE = (np.zeros(0, np.int64),) * 2


def _run_sums(texts: list[str], langs: list, common: dict) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each text: characters, the cost of its common runs, keys of the others."""
    n = len(texts)
    size, cost = np.array([len(t) for t in texts], np.int64), np.zeros(n, np.int64)
    rare_keys, rare_docs = [_NONE[0]], [_NONE[0]]
    for lang, at in _by_language(langs):
        keys, bounds = run_keys([texts[i] for i in at])
        if not len(keys):
            continue
        number, distinct = _encode(keys)
        known, price = _look_up(common.get(lang, _NONE), distinct)
        cost[at] = np.diff(np.concatenate([[0], np.cumsum(price[number])])[bounds])
        rare = np.flatnonzero(~known[number])
        rare_keys.append(keys[rare])
        rare_docs.append(at[np.searchsorted(bounds, rare, "right") - 1])
    return size, cost, _lists(np.concatenate(rare_keys), np.concatenate(rare_docs), n)


def word_costs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> tuple[DataFrame, dict]:
    """The cost (negative log probability in ``UNITS``) of every word, by language and key; per language the common words' sorted keys and costs."""
    found = _texts(docs, text_col, lang_col).mapInArrow(_count(_words_of), "l string, key long, n long")
    counts = cut(found.groupBy("l", "key").agg(F.sum("n").alias("n")))
    stats = counts.groupBy("l").agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2)])
    discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.least(F.greatest(F.col("n1") / (F.col("n1") + 2 * F.col("n2")), F.lit(0.1)), F.lit(0.9))).otherwise(0.5)
    cost = F.round(-F.log((F.col("n") - discount) / F.col("total")) * UNITS).cast("long")
    return _split(_with_language(counts, stats).select("l", "key", "n", cost.alias("cost")), common)


def _word_sums(texts: pa.Array, langs: list, common: dict) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each text: words that count, the cost of the common ones, keys of the others (as often as they count)."""
    n = len(texts)
    counted, cost = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rare_keys, rare_docs = [_NONE[0]], [_NONE[0]]
    for lang, at in _by_language(langs):
        keys, doc = word_keys(texts.take(pa.array(at)), lang)
        if not len(keys):
            continue
        number, distinct = _encode(keys)
        pair, pairs = _encode(doc * len(distinct) + number)
        times = np.minimum(np.bincount(pair), REPEATS)
        doc, number = at[pairs // len(distinct)], pairs % len(distinct)
        known, price = _look_up(common.get(lang, _NONE), distinct)
        np.add.at(counted, doc, times)
        np.add.at(cost, doc, times * price[number])
        rare = ~known[number]
        rare_keys.append(np.repeat(distinct[number[rare]], times[rare]))
        rare_docs.append(np.repeat(doc[rare], times[rare]))
    return counted, cost, _lists(np.concatenate(rare_keys), np.concatenate(rare_docs), n)


def score(docs: DataFrame, runs: tuple[DataFrame, dict], words: tuple[DataFrame, dict], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, language key, base statistics, ``loss`` (log perplexity per character), ``word_loss`` (per word; both null without text) and a hash of language and text."""
    shared = docs.sparkSession.sparkContext.broadcast((runs[1], words[1]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for block in blocks(batches, 2, WORK_BYTES):
            texts, langs = pc.fill_null(block.column(2), ""), block.column(1).to_pylist()
            stats = base_stats(texts)
            size, run_cost, rare_runs = _run_sums(texts.to_pylist(), langs, shared.value[0])
            counted, cost, rare_words = _word_sums(texts, langs, shared.value[1])
            rows = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *[pa.array(stats[n], pa.int64()) for n in names], block.column(3), rows, pa.array(size), pa.array(run_cost), rare_runs, pa.array(counted), pa.array(cost), rare_words], names=schema.names)

    long, keys = T.LongType(), T.ArrayType(T.LongType())
    made = {"n_words": long, "word_chars": long, "n_symbols": long, "n_dup_lines": long, "n_repeat_words": long, MARK: long, "__row": long, "__size": long, "__runs": long, "__rare_runs": keys, "__counted": long, "__cost": long, "__rare_words": keys}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("l", T.StringType()), *[T.StructField(k, v) for k, v in made.items()]])
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    # kept between jobs: row numbers hold only as long as the rows stand as they are
    found = cut(docs.select(F.col(f"`{id_col}`"), language_key(lang, docs).alias("l"), text, F.xxhash64(lang, text)).mapInArrow(tidy(run), schema))

    def more(column: str, table: DataFrame, into: str) -> DataFrame:
        asked = found.where(F.size(column) > 0).select("__row", "l", F.explode(column).alias("key"))
        return asked.join(table, ["l", "key"]).groupBy("__row").agg(F.sum("cost").alias(into))

    mean = lambda known, rest, n: F.when(F.col(n) > 0, (F.col(known) + F.coalesce(rest, F.lit(0))) / F.lit(float(UNITS)) / F.col(n))
    out = found.drop("__rare_runs", "__rare_words").join(more("__rare_runs", runs[0], "__r"), "__row", "left").join(more("__rare_words", words[0], "__w"), "__row", "left")
    return out.select(id_col, "l", *names, mean("__runs", "__r", "__size").alias("loss"), mean("__cost", "__w", "__counted").alias("word_loss"), MARK)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scored: DataFrame, below: float = BELOW, above: float = ABOVE, loss: str = "loss") -> dict[str, tuple[float, float]]:
    """Per language the lowest and highest loss that is kept, from all documents that pass the base rules."""
    histogram = scored.where(~base_failed() & F.col(loss).isNotNull()).groupBy("l", F.floor(F.col(loss) / BIN).alias("bin")).count().collect()
    out = {}
    for lang in {r.l for r in histogram}:
        at, n = map(np.array, zip(*sorted((r.bin, r["count"]) for r in histogram if r.l == lang), strict=True))
        x = (at + 0.5) * BIN
        middle = _middle(x, n)
        spread = max(1.4826 * _middle(np.abs(x - middle), n), BIN)
        out[lang] = (float(middle - below * spread), float(middle + above * spread))
    return out


def _middle(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(n[order])
    return float(x[order][np.searchsorted(total, total[-1] / 2)])


def _verdicts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, below: float, above: float, words_above: float, common: int, common_runs: int) -> DataFrame:
    scored = cut(score(docs, run_costs(docs, text_col, lang_col, common_runs), word_costs(docs, text_col, lang_col, common), id_col, text_col, lang_col))
    limits, most = bands(scored, below, above), bands(scored, 0.0, words_above, "word_loss")
    rows = [(lang, low, high, most[lang][1]) for lang, (low, high) in limits.items()]
    limits = docs.sparkSession.createDataFrame(rows, "l string, low double, high double, word_high double")
    inside = F.coalesce(F.col("loss").between(F.col("low"), F.col("high")) & (F.col("word_loss") <= F.col("word_high")), F.lit(False))
    return scored.join(F.broadcast(limits), "l", "left").withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside}).drop("low", "high", "word_high")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE, words_above: float = WORDS_ABOVE, common: int = COMMON, common_runs: int = COMMON_RUNS) -> DataFrame:
    """Per row: the id, base statistics, ``base_failed``, ``kept``, ``loss`` and ``word_loss``.

    A row is kept when it passes the base rules, its loss lies in its
    language's band and its word loss not above that of words. ``common``
    and ``common_runs`` change no result.

    Defined cases. Null or empty text: no words, base rules failed. A null
    language is a language of its own. Null ids and repeated rows pass
    through, a result for each row. No rows: no rows. Texts are read whole.
    Other input columns are not looked at.
    """
    found = _verdicts(docs, id_col, text_col, lang_col, below, above, words_above, common, common_runs)
    return found.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "loss", "word_loss")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE, words_above: float = WORDS_ABOVE, common: int = COMMON, common_runs: int = COMMON_RUNS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are.

    A verdict depends on language and text alone, so the rejected ones are
    taken out by a hash of both. Up to ``SENT`` of them go to the executors;
    with more, the planner shuffles. Defined cases are those of ``judge``.
    """
    bad = cut(_verdicts(docs, id_col, text_col, lang_col, below, above, words_above, common, common_runs).where("NOT kept").select(MARK).distinct())
    mark = F.xxhash64(F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    bad = F.broadcast(bad) if bad.count() <= SENT else bad
    return docs.withColumn(MARK, mark).join(bad, MARK, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict = {}
