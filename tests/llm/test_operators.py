"""Training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stratograph.llm import (
    _arrays,
    _bpe,
    decontamination,
    hmm_lm,
    line_dedup,
    minhash,
    mixing,
    quality_classifier,
    quality_rules,
    sharding,
    token_counts,
    token_output,
)
from stratograph.llm._spark import scratch_path
from stratograph.llm.queries import ORACLES, QUERIES

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def awkward():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, base, "en", "a", len(base)), (5, base, "en", "b", len(base)),
        (5, base, "en", "b", len(base)), (None, base + " x", None, "a", 1), (6, (base + " ") * 3000, "en", None, 1), (7, "word", "en", "b", 4),
        (8, base + "\n" + base, "de", "a", 1), (9, base.upper(), "en", "c", 1), (10, "a b 　 café \x00 z", "fr", "c", 1), (5, "other text here now yes", "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def clash(odd):
    """Extra columns whose names the operators use themselves."""
    extra = ["size", "key", "row", "n_words", "score", "taken", "shard", "slot", "epochs", "salt", "kept", "host", "matches", "found", "all"]
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("mine").alias(c) for c in extra])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def bench_items(spark):
    return spark.createDataFrame([(1, " ".join(awkward()[3][1].split()[:13])), (2, "word"), (3, None), (4, ""), (5, "Nothing such")], "item_id long, text string")


# ---- against DuckDB


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, (bool, np.bool_)) else v
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        duck.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(ORACLES[name]).fetchdf())


# ---- arrays and encoding


def test_words_are_those_of_the_patterns():
    rng = random.Random(1)
    alphabet = list(" \t\n\x0b\x0c\rabABz0é\U0001f600$.\x00\x7f")
    for _ in range(100):
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(4)] + [None]
        raw, offsets = _arrays.texts_of(pa.array(texts))
        for kind, pattern in ((_arrays.SPACE_WORDS, SPACE), (_arrays.ALNUM_WORDS, ALNUM)):
            w = _arrays.Words(raw, offsets, kind)
            got = [[w.text(i).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
            assert got == [re.findall(pattern, lower(t)) for t in texts]


def test_encoder_is_the_library():
    encoder = _bpe.Encoder(_bpe.public_path())
    rng = random.Random(2)
    pieces = [" ", " ", "a", "B", "'s", "1", "\n", " ", "é", "!", "<|endoftext|>", "\x1c", "​", "日", "\x85", "\t", "word"]
    for _ in range(300):
        texts = ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(3)]
        ids, offsets = encoder.encode(texts)
        want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 31])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 4096, 5000):
        ids = rng.integers(0, 2**bits, n).astype(np.uint32)
        f = token_output.File(token_output.to_file(ids, np.array([0, n // 3, n]), bits))
        assert (f.ids(0, n) == ids).all() and (f.document(1) == ids[n // 3 :]).all() and (f.ids(n // 4, n // 2) == ids[n // 4 : n // 2]).all()
    with pytest.raises(ValueError):
        token_output.pack(np.array([2**bits], dtype=np.uint64), bits)


# ---- operators against brute force on awkward rows


def test_token_files(spark, odd):
    files = token_output.write_tokens(odd, _bpe.public_path(), scratch_path(spark, "t"), file_ids=500)
    assert files.count() > 1
    got = token_output.read_tokens(files).orderBy("start").collect()
    library = _bpe.encoder(_bpe.public_path()).library
    order = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc, text, *_) in zip(got, order):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_token_files_are_read_at_any_place(spark, tmp_path, odd):
    index = token_output.write_tokens(odd, _bpe.public_path(), str(tmp_path), file_ids=500)
    library = _bpe.encoder(_bpe.public_path()).library
    texts = defaultdict(set)
    for d, t, *_ in awkward():
        texts[d].add(tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,))
    for r in index.collect():
        file = token_output.open_file(r["file"])
        for i, d in enumerate(r["doc_ids"]):
            assert tuple(file.document(i).tolist()) in texts[d]
    lost = tmp_path / "ids" / "of-a-lost-task.tpk"
    lost.write_bytes(b"TPK1")
    token_output.drop_remains(index, str(tmp_path / "ids"))
    assert not lost.exists() and len(list((tmp_path / "ids").glob("*.tpk"))) == index.count()


def test_token_cache_encodes_misses_once(spark, odd):
    cache = scratch_path(spark, "cache")
    # a cache that has some: the misses are sent to the rows, or the rows to the misses
    for most in (100, 0):
        warm = scratch_path(spark, "warm")
        token_counts.token_counts(odd.where("doc_id in (4, 7)"), _bpe.public_path(), warm).collect()
        again = token_counts.token_counts(odd, _bpe.public_path(), warm, broadcast_digests=most).collect()
        assert spark.read.parquet(warm).count() == len({t or "" for _, t, *_ in awkward()})
        assert Counter(r["n_tokens"] for r in again) == Counter(r["n_tokens"] for r in token_counts.token_counts(odd, _bpe.public_path(), warm).collect())
    out = token_counts.token_counts(odd, _bpe.public_path(), cache).collect()
    library = _bpe.encoder(_bpe.public_path()).library
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "").ids)) for d, t, *_ in awkward())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t, *_ in awkward()})
    assert stored.count() == distinct
    token_counts.token_counts(odd, _bpe.public_path(), cache).collect()
    assert spark.read.parquet(cache).count() == distinct


def test_language_model(spark, odd):
    out = hmm_lm.language_model_scores(odd, block_tokens=20, part_pairs=5).collect()
    tokens = [(d, re.findall(SPACE, lower(t)) + ["\0end"]) for d, t, *_ in awkward()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, held(d), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def brute_sums(symbols, first, emit, m):
    """Forward-backward without scaling, text by text."""
    k = len(m.start)
    start, step, emits, logs = np.zeros(k), np.zeros((k, k)), np.zeros_like(emit), []
    for x, z in zip(first, first[1:]):
        own = symbols[x:z]
        a, b = np.zeros((len(own), k)), np.ones((len(own), k))
        a[0] = m.start * emit[own[0]]
        for t in range(1, len(own)):
            a[t] = (a[t - 1] @ m.step) * emit[own[t]]
        for t in range(len(own) - 2, -1, -1):
            b[t] = m.step @ (emit[own[t + 1]] * b[t + 1])
        p = a[-1].sum()
        logs.append(math.log10(p))
        start += a[0] * b[0] / p
        np.add.at(emits, own, a * b / p)
        for t in range(1, len(own)):
            step += np.outer(a[t - 1], emit[own[t]] * b[t]) * m.step / p
    return start, step, emits, logs


def test_recursions_cross_segments_exactly(monkeypatch):
    monkeypatch.setattr(hmm_lm, "SEGMENT", 16)
    rng = np.random.default_rng(3)
    m = hmm_lm.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), None, 40)
    emit = rng.dirichlet(np.ones(40), 4).T
    lengths = [1, 2, 15, 16, 17, 33, 70, 5, 64]
    first = np.concatenate([[0], np.cumsum(lengths)])
    symbols = rng.integers(0, 40, first[-1])
    sums, emits = hmm_lm.Sums(4), np.zeros((40, 4))
    hmm_lm.expected_counts(symbols, first, emit, m, sums, emits)
    start, step, want, logs = brute_sums(symbols, first, emit, m)
    assert sums.start == pytest.approx(start) and sums.step == pytest.approx(step) and emits == pytest.approx(want)
    assert sums.log / math.log(10) == pytest.approx(sum(logs))
    assert hmm_lm.log_likelihoods(symbols, first, emit, m) == pytest.approx(logs)


def test_language_model_end_to_end(spark):
    """The same start, rounds and scores by brute force over all texts at once."""
    rng = random.Random(2)
    texts = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(60)}" for _ in range(rng.randrange(1, 60)))) for i in range(60)] + [(60, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    h, first = hmm_lm.tokens_of(pa.array([t for _, t in texts], type=pa.string()))
    held = np.array([zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts])
    ranges = list(zip(first, first[1:]))
    train = np.concatenate([h[a:z] for (a, z), x in zip(ranges, held) if not x])
    own = np.concatenate([[0], np.cumsum([z - a for (a, z), x in zip(ranges, held) if not x])])
    words, symbols, count = np.unique(train, return_inverse=True, return_counts=True)
    # the sample holds all training texts, so the rounds go on from where its own end
    g = hmm_lm.spread(words, count, hmm_lm.STATES)
    m = hmm_lm.Model.first(hmm_lm.STATES, g.sum(0), len(words))
    for _ in range(2):
        before = -math.inf
        while True:
            start, step, emits, logs = brute_sums(symbols, own, m.emissions(g), m)
            sums = hmm_lm.Sums(hmm_lm.STATES)
            sums.start, sums.step, sums.total, g = start, step, emits.sum(0), emits
            m = hmm_lm.Model.of_sums(sums, len(words))
            if sum(logs) - before <= hmm_lm.TOLERANCE * abs(sum(logs)):
                break
            before = sum(logs)
    place = np.searchsorted(words, h) % len(words)
    emit = m.emissions(np.vstack([g, np.zeros(hmm_lm.STATES)]))
    every = np.where(words[place] == h, place, len(words))
    want = dict(zip([d for d, _ in texts], brute_sums(every, first, emit, m)[3]))
    for block_tokens, part_pairs in ((1 << 20, 1 << 19), (200, 30)):
        got = {r["doc_id"]: r["score"] for r in hmm_lm.language_model_scores(docs, block_tokens=block_tokens, part_pairs=part_pairs).collect()}
        assert got == pytest.approx(want, rel=1e-3)


def test_training_sees_whole_texts():
    import pyarrow as pa

    text = pa.array([" ".join(f"w{i}" for i in range(5_000))])
    places, counts = quality_classifier.features(text)
    (own, weights), = quality_classifier.sparse_rows(text)
    assert own.tolist() == np.unique(places).tolist() and weights.sum() == pytest.approx(quality_classifier.SCALE)


def test_training_stays_out_of_the_driver(spark, monkeypatch):
    """Updates run in a worker, which imports the module anew; the driver sees no features, only the weights."""
    texts = [(i, f"{'good' if i % 2 else 'bad'} text {i}") for i in range(30)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")

    def refused(*_):
        raise AssertionError("an update in the driver")

    monkeypatch.setattr(quality_classifier.FollowTheLeader, "update", refused)
    weights = quality_classifier.train(docs, labels)
    assert weights.shape == ((1 << quality_classifier.BITS) + 1,) and weights.any()


def test_training_against_brute_force(spark):
    """The weights of rows trained one by one, with a dictionary for each table."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["good", "bad", "x1", "Y?", "the"], k=12))) for i in range(40)]
    docs = spark.createDataFrame(texts + [(0, "zzz repeats an id"), (None, "no id")], "doc_id long, text string")
    labels = {i: int("good" in t) for i, t in texts}
    got = quality_classifier.train(docs, spark.createDataFrame([*labels.items(), (5, 0), (None, 1)], "doc_id long, quality int"))
    q = quality_classifier
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= q.L1 else -(z[k] - math.copysign(q.L1, z[k])) / ((q.BETA + math.sqrt(n[k])) / q.ALPHA + q.L2)

    chosen = sorted((hashlib.md5(str(i).encode()).hexdigest(), t, labels[i]) for i, t in texts if zlib.crc32(str(i).encode()) % 3 != 1)
    for _ in range(q.EPOCHS):
        for _, text, label in chosen:
            places, _ = q.features(pa.array([text]))
            row = {p: c / len(places) * q.SCALE for p, c in Counter(places.tolist()).items()} | {1 << q.BITS: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in row.items())))
            for k, v in row.items():
                g, w = (p - label) * v, weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / q.ALPHA * w
                n[k] += g * g
    assert {k for k in np.flatnonzero(got).tolist()} == {k for k in z if weight(k)}
    assert all(got[k] == pytest.approx(weight(k), rel=1e-4, abs=1e-6) for k in z)


def brute_components(texts):
    sets = {}
    for d, t in texts:
        w = re.findall(SPACE, lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def edited_copies(seed=5, families=6, copies=25):
    """Copies with one to six edits each: some link, others share most shingles and do not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    out = []
    for f in range(families):
        original = [word() for _ in range(rng.choice([8, 60, 150, 400]))]
        for _ in range(copies):
            w = list(original)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                del w[rng.randrange(len(w))]
            out.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    out += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates_lose_no_link(spark):
    texts = edited_copies()
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = brute_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edge_cases(spark, odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(awkward())
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[None] == {(None, False)} and by[1] == {(1, True)} and by[2] == {(2, True)} and by[4] == {(4, True)} and by[9] == {(4, False)} and by[5] == {(4, False), (5, True)}
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_hot_lists_and_string_ids(spark, monkeypatch):
    from stratograph.llm import _spark

    monkeypatch.setattr(_spark, "LEAST_HOT", 1)
    texts = [(f"d{i:04d}", t) for i, t in edited_copies(seed=11, families=3, copies=30)]
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in minhash.deduplicated(docs).collect()) == [0, 1]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    out = {r["c"]: r["comp"] for r in minhash.components(links).collect()}
    assert set(out.values()) == {0, 500} and len(out) == 203


def test_decontamination_brute_force(spark, odd, bench_items):
    items = {i: re.findall(ALNUM, lower(t)) for i, t in [(r["item_id"], r["text"]) for r in bench_items.collect()]}
    want = Counter()
    for d, t, *_ in awkward():
        w = re.findall(ALNUM, lower(t))
        hit, found = set(), set()
        for i, words in items.items():
            n = min(13, len(words))
            wins = {tuple(words[p : p + n]) for p in range(len(words) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    found.add(str(i))
        want[d, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for block_words in (200_000, 1):  # one block, and a pass for each item
        out = decontamination.find_contamination(odd, bench_items, block_words=block_words).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(sorted(r["item_ids"])), r["contaminated"]) for r in out) == want
    longest = [m for r in out if r["doc_id"] == 4 for m in r["matches"]]
    assert [(m["item_id"], m["start"], m["length"]) for m in longest] == [("1", 0, 13)]


def test_longest_match_is_joined(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[5:35]) + " z")], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    m = decontamination.find_contamination(docs, items).first()["matches"]
    assert [(x["item_start"], x["start"], x["length"]) for x in m] == [(5, 2, 30)]


def test_longest_matches_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        items = [(str(i), " ".join(rng.choices("abc", k=rng.randrange(1, 14)))) for i in range(4)]
        texts = [" ".join(rng.choices("abcx", k=rng.randrange(30))) for _ in range(5)]
        needles = decontamination.Needles(items, 4)
        words = _arrays.Words(*_arrays.texts_of(pa.array(texts)), _arrays.ALNUM_WORDS)
        for text, (own, matches) in zip(texts, decontamination.found_in(words, decontamination.numbered(words, needles), needles)):
            w = text.split()
            want, best = set(), {}
            for k, (i, t) in enumerate(items):
                t = t.split()
                n = min(4, len(t))
                if any(w[p : p + n] == t[q : q + n] for p in range(len(w) - n + 1) for q in range(len(t) - n + 1)):
                    want.add(k)
                for p in range(len(w)):
                    for q in range(len(t)):
                        n = 0
                        while p + n < len(w) and q + n < len(t) and w[p + n] == t[q + n]:
                            n += 1
                        if n >= 4:
                            best[p] = max(n, best.get(p, 0))
            assert set(own) == want
            assert [(s, n) for _, _, s, n in matches if n >= 4] == [(p, n) for p, n in sorted(best.items()) if best.get(p - 1, 0) <= n]
            assert all(w[s : s + n] == items[i][1].split()[p : p + n] for i, p, s, n in matches)


def test_repetitive_texts_stay_small():
    import tracemalloc

    text = " ".join(["same"] * 20_000)
    words = _arrays.Words(*_arrays.texts_of(pa.array([text, text])), _arrays.ALNUM_WORDS)
    tracemalloc.start()
    needles = decontamination.Needles([("1", text), ("2", text)])
    (own, matches), _ = decontamination.found_in(words, decontamination.numbered(words, needles), needles)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert own == [0, 1] and [(s, n) for _, _, s, n in matches] == [(0, 20_000)]


def test_mixing_laws(spark, odd):
    out = mixing.mix(odd).collect()
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        assert r["size"] == len(re.findall(SPACE, r["text"] or "")) and r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    assert len(out) == len(awkward()) and sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    # equal rows at a cut are treated alike; other sources end on their target
    assert all(abs(taken[s] - targets[s]) <= 15 for s in sizes)


def test_mixed_documents_take_effect(spark, odd):
    m = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(odd).collect()}
    got = defaultdict(int)
    for r in mixing.mixed_documents(odd).collect():
        got[r["source"]] += len(re.findall(SPACE, r["text"] or ""))
    want = defaultdict(int)
    for d, t, _, s, _ in awkward():
        want[s] += m[d, len(re.findall(SPACE, t or ""))]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_sharding_laws(spark, odd):
    copies = [(100 + i, "same text", "en", "a", 9) for i in range(60)] + [(300 + i, f"text {i // 3}", "en", "a", 9) for i in range(90)]
    out = sharding.assign(odd.union(spark.createDataFrame(copies, DOCS)), 4).collect()
    assert len(out) == len(awkward()) + 150
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    together = Counter(len({r["shard"] for r in out if 300 <= (r["doc_id"] or 0) and (r["doc_id"] - 300) // 3 == g}) for g in range(30))
    assert together[1] >= 24
    assert {r["size"] for r in out if r["doc_id"] == 1} == {1} and {r["text_crc32"] for r in out if r["doc_id"] == 4} == {zlib.crc32(awkward()[3][1].encode())}


def test_cut_links_against_the_best_split(spark):
    """Tiny tables: the cut that propagation leaves, against the least that any split into equal shards has."""
    from itertools import combinations

    rng = random.Random(9)
    for sizes in ([3, 3, 2], [4, 2, 2], [2, 2, 2, 2], [5, 1, 1, 1], [6, 2]):
        texts = [f"t{g}" for g, n in enumerate(sizes) for _ in range(n)]
        rng.shuffle(texts)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 2).collect()}
        cut = lambda one: sum(texts[i] == texts[j] and (i in one) != (j in one) for i in range(8) for j in range(i))
        best = min(cut(set(one)) for one in combinations(range(8), 4))
        worst = max(cut(set(one)) for one in combinations(range(8), 4))
        assert best <= cut({i for i, s in out.items() if s == 0}) <= (best + worst) / 2


def test_cut_links_counts_pairs(spark):
    atoms = spark.createDataFrame([("a", 0, 3), ("a", 1, 2), ("a", 1, 1), ("b", 0, 9), ("c", 0, 1), ("c", 2, 1)], "key string, shard int, n long")
    assert sharding.cut_links(atoms) == 10
    assert sharding.cut_links(atoms.where("false")) == 0


def test_hot_group_fills_shards(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(600)], "doc_id long, text string")
    sizes = Counter(r["shard"] for r in sharding.assign(docs, 16).collect())
    assert set(sizes.values()) <= {37, 38} and sum(sizes.values()) == 600


def test_line_frequency_keeps_copies_and_drops_boilerplate(spark):
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))
    page = "Share this page with all your friends today please\nAll rights reserved by the owners of this site"
    rows_ = [(i, "en", "h", f"{prose()}\n{page}") for i in range(60)] + [(100 + i, "en", "h", page + " " + "tail of some words here") for i in range(3)]
    rows_ += [(200 + i, "en", "h", page + "\n" + " ".join(prose().split()[:8])) for i in range(20)]
    copy = prose()
    rows_ += [(300 + i, "en", "h", copy) for i in range(40)]
    docs = spark.createDataFrame([(d, t, lang, s, len(t)) for d, lang, s, t in rows_], DOCS)
    out = {r["doc_id"]: r for r in quality_rules.line_frequency_rules(docs).collect()}
    assert all(out[i]["kept"] and out[i]["removed_words"] == 18 for i in range(60))
    assert not any(out[200 + i]["kept"] for i in range(20))
    assert all(out[300 + i]["kept"] and out[300 + i]["removed_words"] == 0 for i in range(40))


def test_repeated_windows_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(40))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    for r in quality_rules.line_frequency_rules(docs).collect():
        w = texts[r["doc_id"]].split()
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {p for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        assert r["n_repeat_words"] == len(hit) and r["n_words"] == len(w)


def test_many_common_lines_are_joined(spark, monkeypatch):
    """Beyond the broadcast bounds, with every line hot, the results are the same."""
    from stratograph.llm import _spark

    monkeypatch.setattr(_spark, "LEAST_HOT", 1)
    rng = random.Random(12)
    text = lambda: "\n".join(rng.choice(["menu of this site and more", "all rights reserved here now", "w" + str(rng.random())]) for _ in range(6))
    docs = spark.createDataFrame([(i, text(), "en", rng.choice(["a", "b", None]), 1) for i in range(80)], DOCS)
    pages = docs.selectExpr("doc_id as page_id", "concat('http://', coalesce(source, 'x'), '.example/') as url", "replace(text, '\n', '<br>') as html")
    cleaned = lambda given, **how: quality_rules.cleaned_documents(given, min_left=1, max_removed=0.99, **how)
    for f, given in ((quality_rules.line_frequency_rules, docs), (cleaned, docs), (line_dedup.without_boilerplate, pages)):
        few, many = (Counter(map(tuple, f(given, broadcast_lines=n).collect())) for n in (10**6, 0))
        assert few == many and few
    assert not any("menu of this site" in r["text"] for r in cleaned(docs).collect())


def test_line_dedup(spark):
    rows_ = [(i, f"https://Site.example/{i}", f"<p>menu entry</p><p>story {i}</p><script>x()</script>") for i in range(6)]
    rows_ += [(7, None, None), (8, "no address", "<b>alone</b>"), (9, "http://other.example/", "<p>menu entry</p>")]
    out = {r["page_id"]: r for r in line_dedup.without_boilerplate(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()}
    assert all(out[i]["text"] == f"story {i}" and out[i]["n_dropped"] == 1 and out[i]["host"] == "site.example" for i in range(6))
    assert out[7]["n_lines"] == 0 and out[8]["text"] == "alone" and out[9]["text"] == "menu entry"


def test_classifier_held_out_accuracy(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = [r for r in QUERIES["op10_quality_classifier"](spark, d).collect() if r["doc_id"] in labels and r["held_out"]]
    assert len(out) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in out) >= 0.95 * len(out)


def test_classifier_edge_cases(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality_classifier.train(odd, no_labels)
    assert {r["score"] for r in quality_classifier.scored(odd, weights).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (9, 0), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    weights = quality_classifier.train(odd, labels)
    assert len(quality_classifier.scored(odd, weights).collect()) == len(awkward())
    assert quality_classifier.scored(none, weights).count() == 0


def test_empty_tables(spark, none, bench_items):
    assert quality_rules.line_frequency_rules(none).count() == 0
    assert decontamination.find_contamination(none, bench_items).count() == 0
    assert decontamination.find_contamination(none, bench_items.where("false")).count() == 0
    assert token_output.read_tokens(token_output.write_tokens(none, _bpe.public_path(), scratch_path(spark, "e"))).count() == 0
    assert token_counts.token_counts(none, _bpe.public_path(), scratch_path(spark, "e")).count() == 0
    assert hmm_lm.language_model_scores(none).count() == 0
    assert sharding.assign(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert line_dedup.without_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_columns(clash, bench_items):
    n = clash.count()
    assert quality_rules.line_frequency_rules(clash).count() == n
    assert decontamination.find_contamination(clash, bench_items).count() == n
    assert decontamination.decontaminated(clash, bench_items).columns == clash.columns
    assert mixing.mixed_documents(clash).columns == clash.columns
    assert minhash.deduplicated(clash).columns == clash.columns
    assert sharding.assign(clash).count() == n
    assert sorted(sharding.sharded_documents(clash).columns) == sorted(clash.columns)
    assert sorted(mixing.mix(clash).columns) == sorted({*clash.columns, *mixing.MIXED})
    assert quality_rules.cleaned_documents(clash).columns == clash.columns
    assert token_output.read_tokens(token_output.write_tokens(clash, _bpe.public_path(), scratch_path(clash.sparkSession, "c"))).count() == n
    assert token_counts.token_counts(clash, _bpe.public_path(), scratch_path(clash.sparkSession, "c")).count() == n
    pages = clash.selectExpr("doc_id as page_id", "text as url", "text as html", "host", "row", "key as lines", "found as drop")
    assert line_dedup.without_boilerplate(pages).count() == n
    assert quality_classifier.accepted(clash, np.zeros((1 << quality_classifier.BITS) + 1)).columns == clash.columns
    assert hmm_lm.language_model_scores(clash).count() == n


def test_sharded_rows_are_those_given(odd, spark):
    copies = spark.createDataFrame([(500 + i, "hot text", None, "a", i) for i in range(300)], DOCS)
    given = odd.union(copies)
    assert Counter(map(tuple, sharding.sharded_documents(given).drop("shard", "slot").collect())) == Counter(map(tuple, given.collect()))


def test_ranks_are_those_of_a_sort(spark):
    from pyspark.sql import functions as F

    from stratograph.llm._spark import ranked

    rows_ = [(None,), *((f"s{i % 40:02d}{i}",) for i in range(300))]
    got = ranked(spark.createDataFrame(rows_, "s string").repartition(5), F.col("s").asc_nulls_last()).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(301)) and [r["s"] for r in got] == sorted(x for x, in rows_ if x) + [None]


def test_items_digest():
    assert decontamination.items_digest(["10", "9"]) == hashlib.sha256(b"10,9").hexdigest()
