"""Nearest neighbours, packing, WARC, mixing, quality and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm import ann as A
from gleanery.llm import mixing as M
from gleanery.llm import oracle_sql, queries
from gleanery.llm import packing as P
from gleanery.llm import quality as Q
from gleanery.llm import warc as W

from ..conftest import duck, same_rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, small, name):
    same_rows(queries()[name](spark, small), duck(small).sql(oracle_sql()[name]))


# Nearest neighbours


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>, rank string")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 24))[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 24))).astype(np.float32)
    x[700:760] = x[5]  # copies
    x[900] = 4 * x[900]  # a larger norm
    got = A.nearest(vectors(spark, x), F.col("vec_id") % 20 == 0).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append((r.vec_id, r.score))
    s = x.astype(float) @ x.astype(float).T
    hit = 0
    for q in range(0, 1500, 20):
        order = sorted((-round(s[q, i], 9), i) for i in range(1500) if i != q)[:20]
        assert len(by[q]) == 20 and all(abs(s[q, i] - v) < 1e-9 for i, v in by[q])
        assert [v for _, v in by[q]] == sorted((v for _, v in by[q]), reverse=True)
        hit += len({i for _, i in order} & {i for i, _ in by[q]})
    assert hit / (75 * 20) >= 0.9
    # the nearest of a copy are the copies with the smallest ids
    assert [i for i, _ in by[720]][:1] == [5] or by[720][0][1] >= s[720, 5]


def test_vectors_that_take_no_part(spark):
    odd = [(100, None, "x"), (101, [0.0, 0.0], "x"), (102, [1.0, None], "x"), (103, [float("nan"), 1.0], "x"), (104, [float("inf"), 1.0], "x"), (None, [1.0, 1.0], "x"), (105, [1.0, 2.0, 3.0], "x"), (0, [1.0, 0.0], "again")]
    got = A.nearest(vectors(spark, [[1, 0], [1, 0], [0, 1], [2, 0]], odd), F.lit(True)).collect()
    assert {r.query_id for r in got} == {0, 1, 2, 3}
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [(1, 3, 2.0), (2, 1, 1.0), (3, 2, 0.0)]
    assert A.nearest(vectors(spark, []), F.lit(True)).count() == 0


# Packing


def pieces_ok(rows, texts, end_id=1, tokens=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, end_id] for i, x in texts}
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and bytes(r.ids) == part
            at += r.length
        assert at == len(ids)
    padding = 0
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_packing_round_trip(docs, corpus):
    rows = P.pack(docs).collect()
    assert pieces_ok(rows, list(enumerate(corpus))) == 0
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in P.pack_digest(docs).collect()}
    assert all(digest[(r.doc_id, r.start)] == zlib.crc32(bytes(r.ids)) for r in rows)


def test_packing_of_odd_rows(odd, nothing):
    rows = P.pack(odd.where("doc_id IN (1, 2, 5, 6, 7)")).collect()
    assert pieces_ok(rows, [(1, None), (2, ""), (5, "\n\n \t\n"), (6, "tie\ntie\ntie"), (7, "word " * 30000)]) == 0
    assert Counter(r.doc_id for r in P.pack(odd).where("start = 0").collect())[4] == 3
    assert P.pack(nothing).count() == 0


@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=60), st.integers(1, 64), st.integers(1, 6), st.integers(1, 64), st.integers(1, 9), st.booleans())
@settings(max_examples=120, deadline=None)
def test_limits_hold_and_nothing_is_lost(examples, tokens, segments, loss, pool, cutting):
    p, bins = P.VectorPacker(tokens, segments, loss, pool, cutting), []
    for i, (n, loss_from) in enumerate(examples):
        bins += p.add(P.Piece(i, 0, np.arange(n, dtype=np.uint32), min(loss_from, n), n))
    bins += p.finish()
    got = defaultdict(list)
    for b in bins:
        assert sum(len(x.ids) for x in b) <= tokens and len(b) <= segments and sum(x.loss() for x in b) <= loss
        for x in b:
            got[x.example].append(x)
    for i, (n, _) in enumerate(examples):
        ids = np.concatenate([x.ids for x in sorted(got[i], key=lambda x: x.start)])
        assert ids.tolist() == list(range(n))


def test_each_limit_decides(docs, odd):
    """Under the registered limits each of the three closes sequences, and a packer of tokens alone would pack otherwise."""
    rng, examples = np.random.default_rng(6), []
    for i in range(400):
        n = int(rng.choice([20, 60, 300, 1500, 5000]))
        examples.append(P.Piece(i, 0, np.arange(n, dtype=np.uint32), min(P.CONTEXT, n), n))

    def bins(*limits):
        p = P.VectorPacker(*limits)
        return [b for e in examples for b in p.add(e)] + list(p.finish())

    shape = lambda found: sorted(tuple(sorted((x.example, x.start, len(x.ids)) for x in b)) for b in found)
    every = bins(P.TOKENS, P.SEGMENTS, P.LOSS)
    size = lambda b: sum(len(x.ids) for x in b)
    assert any(size(b) == P.TOKENS for b in every) and any(sum(x.loss() for x in b) == P.LOSS for b in every)
    assert max(len(b) for b in every) == P.SEGMENTS
    others = [bins(P.TOKENS, 10**6, 10**6), bins(P.TOKENS, P.SEGMENTS, 10**6), bins(P.TOKENS, 10**6, P.LOSS)]
    assert all(shape(o) != shape(every) for o in others)
    assert max(len(b) for b in others[2]) > P.SEGMENTS and max(sum(x.loss() for x in b) for b in others[1]) > P.LOSS
    rows = P.pack(docs.unionByName(odd.drop("n_lines"))).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert all(len(b) <= P.SEGMENTS and sum(r.loss_tokens for r in b) <= P.LOSS for b in by.values())
    assert all(r.loss_tokens == max(0, r.start + r.length - max(r.start, P.CONTEXT)) for r in rows)


@given(st.text(alphabet=st.sampled_from("ab c  \n\t'sIé日<|>1 "), max_size=40))
@settings(max_examples=200, deadline=None)
def test_units_encode_like_the_tokenizer(text):
    e = P._encoder(P.default_tokenizer())
    assert e.texts(pa.array([text]))[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# WARC


def test_archive_round_trip(spark, tmp_path):
    big, other = "<p>" + "x" * 200, "<p>ünï" + "y" * 150
    rows = [(3, "http://a/b c\r\nX: y", big, 1), (1, None, big, 2), (2, "u", other, 3), (7, "u", "short", 4), (8, "u", "short", 5), (9, "u", None, 6), (None, "u", big, 7), (5, "u", other, 8), (5, "u", other, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes long").repartition(3)
    hashes = []
    for k in range(2):
        uri = W.write_archive(pages, f"file://{tmp_path}/{k}", roll_bytes=700)
        manifest = sorted(map(tuple, spark.read.parquet(f"{uri}/_manifest").select("file", "bytes", "sha256").collect()))
        hashes.append(manifest)
    assert hashes[0] == hashes[1] and len(hashes[0]) > 1  # the same bytes, rolled
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in W.read_archive(spark, uri).collect())
    assert got == sorted([("3", "revisit", 1, 203), ("1", "response", None, 203), ("2", "response", None, 158), ("7", "response", None, 5), ("8", "response", None, 5), ("9", "response", None, 0), ("None", "revisit", 1, 203), ("5", "revisit", 2, 158), ("5", "revisit", 2, 158)])
    assert not [p for p in (tmp_path / "1").iterdir() if p.suffix == ".tmp"]
    empty = W.write_archive(pages.limit(0), f"file://{tmp_path}/none")
    assert W.read_archive(spark, empty).count() == 0


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 300)], "page_id long, url string, html string")
    uri = W.write_archive(pages, f"file://{tmp_path}/a")
    (tmp_path / "a" / "pages-00099-00000.warc.gz").write_bytes(b"junk")
    assert W.read_archive(spark, uri).count() == 1


# Mixing


def target_brute(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(sizes)
    total = sum(sizes.values())
    while open_:
        rest, w = total - sum(target.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * weights[s] / w for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("rows_per_range", [1024, 7])
def test_mix_meets_targets(docs, corpus, rows_per_range):
    rows = M.mix(docs, rows_per_range=rows_per_range).collect()
    again = M.mix(docs.repartition(2), rows_per_range=rows_per_range).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes = defaultdict(int)
    for i, t in enumerate(corpus):
        sizes[source[i]] += len(t.split())
    want, taken, largest = target_brute(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)
    assert abs(sum(taken.values()) - sum(sizes.values())) <= max(largest.values()) / 2


@pytest.mark.parametrize(("budget", "rows_per_range"), [(1.0, 1024), (0.4, 3), (0.05, 1024), (2.0, 7)])
def test_queue_order_and_budget(docs, budget, rows_per_range, monkeypatch):
    """Copies leave in the order of their finish times until the budget is spent, whole; what is taken follows the queue alone."""
    monkeypatch.setattr(M, "GROUP", 2)
    plan = M.mix_plan(docs, budget=budget, rows_per_range=rows_per_range).where("virtual_finish IS NOT NULL").orderBy("before").collect()
    total, at = M.mix(docs).agg(F.sum("size")).first()[0], 0
    spend = int(total * budget)
    assert [r.virtual_finish for r in plan] == sorted(r.virtual_finish for r in plan)
    for r in plan:
        assert r.before == at and r.take == (r.size if 2 * (spend - at) >= r.size else 0)
        at += r.size
    assert at >= min(spend, 3 * total)
    taken = defaultdict(int)
    for r in plan:
        taken[r["__src"]] += r.take
    if budget < 1:
        want, largest = {r["__src"]: r.target * budget for r in plan}, max(r.size for r in plan)
        assert all(abs(taken[s] - want[s]) <= largest + 1 for s in want)


def test_mix_is_sorted_over_all_partitions(docs, corpus):
    order = {r.doc_id: r.virtual_finish for r in M.mix_plan(docs).where("take > 0 AND pass = 0").collect()}
    out = [r.doc_id for r in M.mix_documents(docs).collect()]
    first = list(dict.fromkeys(out))
    assert set(out) == set(order) and [order[i] for i in first if i in order] == sorted(order[i] for i in first)
    assert Counter(out) == {i: n for i, n in ((r.doc_id, r.taken // r.size) for r in M.mix(docs).where("taken > 0").collect())}


def test_mix_of_odd_rows(odd, nothing):
    rows = Counter((r.doc_id, r.size) for r in M.mix(odd).collect())
    assert rows[(4, 12)] == 2 and rows[(1, 0)] == 1 and sum(rows.values()) == 9
    assert M.mix(nothing).count() == 0
    out = M.mix_documents(odd)
    assert out.columns == odd.columns
    taken = M.mix(odd).agg(F.sum("taken")).first()[0]
    assert sum(len((r.text or "").split()) for r in out.select("text").collect()) == taken


# Quality


def stats_brute(text):
    spaces = " \t\n\x0b\x0c\r"
    words, now = [], ""
    for c in text:
        if c in spaces:
            words += [now] if now else []
            now = ""
        else:
            now += c
    words += [now] if now else []
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(spaces)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


@given(st.lists(st.text(alphabet=st.sampled_from("ab é日#| \n\x0b\xa0"), max_size=60), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_base_statistics(texts):
    got = Q.base_stats(pa.array(texts))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == stats_brute(t)


def kn_brute(texts):
    """A plain modified Kneser-Ney model over padded characters: probability of the last character of a run."""
    pad = chr(Q.START) * 3
    tables = {4: Counter(s[i - 3 : i + 1] for t in texts for s in [pad + t] for i in range(3, len(s)))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    d = {n: Q._discounts([sum(c == k for c in t.values()) for k in (1, 2, 3, 4)]) for n, t in tables.items()}

    def p(run):
        n = len(run)
        if n == 0:
            return 1 / (len(tables[1]) + 1)
        mine = {g: c for g, c in tables[n].items() if g[:-1] == run[:-1]}
        total = sum(mine.values())
        if not total:
            return p(run[1:])
        cut = lambda c: d[n][min(c, 3) - 1]
        kept = sum(c - cut(c) for c in mine.values())
        c = mine.get(run, 0)
        return (c - cut(c) if c else 0) / total + (1 - kept / total) * p(run[1:])

    return p


def judge_brute(rows):
    """(n_words, base_failed, kept, loss, word_loss) of (text, lang) rows, by the plain models and medians."""
    texts = [t or "" for t, _ in rows]
    by = defaultdict(list)
    for i, (_, lang) in enumerate(rows):
        by[lang].append(i)
    stats = [stats_brute(t) for t in texts]
    failed = [s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"] for s in stats]
    loss, word_loss, kept = [None] * len(rows), [None] * len(rows), [False] * len(rows)
    for at in by.values():
        p, cost = kn_brute([texts[i] for i in at]), {}
        counts = Counter(w for i in at for w in texts[i].encode().split())
        n1, n2, total = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()), sum(counts.values())
        d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 and n2 else 0.5
        for i in at:
            s = chr(Q.START) * 3 + texts[i]
            runs = [s[k - 3 : k + 1] for k in range(3, len(s))]
            for r in set(runs) - set(cost):
                cost[r] = round(-math.log(p(r)) * Q.UNITS)
            words = Counter(texts[i].encode().split())
            count = {w: min(c, Q.REPEATS) for w, c in words.items()}
            if runs:
                loss[i] = sum(cost[r] for r in runs) / Q.UNITS / len(runs)
            if count:
                word_loss[i] = sum(c * round(-math.log((counts[w] - d) / total) * Q.UNITS) for w, c in count.items()) / Q.UNITS / sum(count.values())
        good = [i for i in at if not failed[i]]
        if not good:
            continue

        def band(x, low, high):
            x = np.sort((np.floor(np.array(x) / Q.BIN) + 0.5) * Q.BIN)
            middle = x[np.searchsorted(np.arange(1, len(x) + 1), len(x) / 2)]
            far = np.sort(np.abs(x - middle))
            spread = max(1.4826 * far[np.searchsorted(np.arange(1, len(x) + 1), len(x) / 2)], Q.BIN)
            return middle - low * spread, middle + high * spread

        low, high = band([loss[i] for i in good], Q.BELOW, Q.ABOVE)
        most = band([word_loss[i] for i in good], 0, Q.WORDS_ABOVE)[1]
        for i in good:
            kept[i] = low <= loss[i] <= high and word_loss[i] <= most
    return [(s["n_words"], f, k, a, b) for s, f, k, a, b in zip(stats, failed, kept, loss, word_loss, strict=True)]


def test_verdicts_match_brute_force(spark):
    """Bands of every language, those called null, nothing, a star and an equals sign among them, by plain models."""
    rng = np.random.default_rng(4)
    rows = []
    for lang in ("en", None, "", "*", "="):
        words = ["".join(rng.choice(list("aeioulnrstbc"), rng.integers(2, 7))) for _ in range(60)]
        for k in range(24):
            text = " ".join(rng.choice(words, rng.integers(40, 90)))
            if k % 8 == 3:
                text = " ".join("".join(rng.choice(list("#$%&*qxzjkv"), 6)) for _ in range(60))
            rows.append((len(rows), text + ("\n" + text if k % 11 == 5 else ""), lang))
    rows.append((len(rows), None, "en"))
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), common=500, common_runs=300).collect()}
    want = judge_brute([(t, lang) for _, t, lang in rows])
    assert 0 < sum(w[2] for w in want) < len(want) - sum(w[1] for w in want)
    for i, (n, failed, kept, loss, word_loss) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.base_failed, r.kept) == (n, failed, kept)
        assert (loss is None) == (r.loss is None) and (loss is None or abs(r.loss - loss) < 1e-5)
        assert (word_loss is None) == (r.word_loss is None) and (word_loss is None or abs(r.word_loss - word_loss) < 1e-5)


def test_languages_beyond_the_bound_share_a_model(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_LANGUAGES", 2)
    rows = [(i, f"some words of number {i} " * 20, f"l{i % 5 if i % 2 else 0}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shared = {r.l for r in docs.select(Q.language_key(F.col("lang"), docs).alias("l")).distinct().collect()}
    assert len(shared) == 3 and Q.OTHERS in shared
    assert Q.judge(docs).count() == 40


def test_clean_stays_and_junk_goes(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(300)]
    clean = [(i, " ".join(rng.choice(words, 80)), "en", "s", 1) for i in range(200)]
    junk = [(1000 + i, " ".join("".join(rng.choice(list("#$%&*qxzjkv0123456789"), 6)) for _ in range(80)), "en", "s", 1) for i in range(6)]
    foreign = [(2000 + i, " ".join(rng.choice(["früh", "große", "müssen", "straße", "schön", "über"], 80)), "de", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(clean + junk + foreign, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in Q.judge(docs).where("kept").collect()}
    assert sum(i in kept for i in range(200)) >= 198 and not kept & set(range(1000, 1006))
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == kept
    # a text in a language that isn't its own leaves the band of that language
    wrong = docs.unionByName(docs.where("doc_id = 2003").selectExpr("9000 AS doc_id", "text", "'en' AS lang", "source", "n_chars"))
    assert [r.kept for r in Q.judge(wrong).where("doc_id = 9000").collect()] == [False]


def test_quality_of_odd_rows(odd, nothing):
    got = Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in Q.judge(odd).collect())
    assert got[(1, 0, True, False)] == 1 and got[(4, 12, True, False)] == 2 and got[(7, 30000, True, False)] == 1
    assert Q.judge(nothing).count() == 0 and Q.keep_good(nothing).count() == 0


# Pipeline


def test_pipeline_by_stages(spark, small, tmp_path):
    """Each stage against a plain account of what it should do to its own input."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = docs
    outs = []
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, before, small).write.parquet(f"{tmp_path}/{i}")
        before = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append(before)
    good, lines, single, mixed, packed = outs
    assert all(o.columns == columns for o in outs[:-1])
    verdict = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in verdict.items() if k}

    from .test_text_operators import component_brute, line_brute, pieces_of

    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted((i, t) for i, _, _, t in line_brute(rows))
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in component_brute(rows, 5, 80, 100) if d == c}
    taken = {r.doc_id: r.taken for r in M.mix(single).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
        assert r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(words)
    assert packed.agg(F.sum("length")).first()[0] == pieces_of(mixed)


def test_removal_leaves_the_rest(tmp_path):
    """Without the training-data folders the entry point still imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "gleanery", tmp_path / "gleanery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_two_terms' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k.startswith("JAVA")}})
