"""Collocations, prefix trie and language model against plain versions, and on awkward rows."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from netpulse.llm import collocations, count_automata, elias_fano, lm_score, near_dedup, prefix_trie, queries
from netpulse.llm.text import hashed_runs
from tools.check import compare, oracle_connection

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, bucket int, part string, n long"
AWKWARD = [
    (1, None, None, None, 1, "x", 0),
    (None, "a b a b. a b", None, "s", 1, "x", 0),
    (2, "", "en", "s", 1, "x", 0),
    (3, "The cat; the CAT! the cat\x0bthe cat", "en", "s", 1, "x", 0),
    (3, "The cat; the CAT! the cat\x0bthe cat", "en", "s", 1, "x", 0),
    (4, "x\x1cy été ÉTÉ 東京 東京 東京 " * 40, "de", None, 1, "x", 0),
    (5, "long words " * 20_000, "en", "s", 1, "x", 0),
    (6, " \t\r\n ", "en", "s", 1, "x", 0),
    (7, "y" * 3_000_000 + " end", "en", "s", 1, "x", 0),
    (8, "a b a b a b a b a b a b", "und", "s", 1, "x", 0),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).cache()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_prefix_trie"])
def test_queries_equal_their_sql(spark, sf_dir, oracle, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), oracle.sql(queries.ORACLES[name]).df()
    for frame in (got, want):
        if "parent_conv_id" in frame:
            frame["parent_conv_id"] = frame["parent_conv_id"].fillna(-1).astype("int64")
    assert compare(got, want) == "ok"
    assert len(got)


# Collocations


def test_automata_of_many_words_take_no_object_a_word():
    text = " ".join(f"w{i}x{i * 7919 % 1000003}" for i in range(100_000))
    hashed_runs(b"a ", collocations._INSIDE)
    held = collocations.Words()
    tracemalloc.start()
    try:
        held.add(["en"], [text])
        kept = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        built = held.automaton(3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert b"w99999x" + str(99999 * 7919 % 1000003).encode() in built.names.spelled().values() and len(built.words) == 100_000
    # Bytes a word at most, held and while building (with Python objects for words and states: 158 and 799).
    assert kept < 100 * 100_000 and peak < 550 * 100_000


def plain_phrases(docs, longest, least, best):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        chosen = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in chosen.items():
            inside = (p[i : i + m] for m in [len(p)] for i in range(1))
            if any(p != q and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in chosen.items()):
                continue
            score, k = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), found[p[:k]], found[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, r[2], r[1], r[3], r[4], n[lang], r[0]) for i, r in enumerate(rows[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_plain_counting(spark, monkeypatch, longest):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(["a", "b", "C", "d.", "e", "hot hot"], 60, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1])), ["en", None, "fr"][i % 3]) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    # Small automata and ranges: many unions, and first words that go over several ranges.
    monkeypatch.setattr(collocations, "CHUNK", 200)
    monkeypatch.setattr(collocations, "RANGE", 40)
    got = collocations.collocations(frame, longest, 4, 15).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == plain_phrases([(d[2], d[1]) for d in docs], longest, 4, 15)


def test_collocations_of_awkward_rows(spark, awkward):
    got = collocations.collocations(awkward, 3, 2, 50).toPandas()
    want = plain_phrases([(r[2], r[1]) for r in AWKWARD], 3, 2, 50)
    assert sorted(got.itertuples(index=False, name=None)) == want
    assert collocations.collocations(awkward.limit(0)).count() == 0
    assert collocations.collocations(awkward.where("doc_id IN (1, 2, 6)")).count() == 0


def test_scores_past_64_bits_are_exact(spark):
    """The products of the score, with counts no test table can hold."""
    rows = [(123_456_789_012, 999_999_999_999, 123_456_789_013), (10**12, 10**12, 10**12), (10, 10**13, 10**13)]
    got = spark.createDataFrame(rows, "a long, l long, r long").selectExpr(f"{collocations.SCORE} AS s").collect()
    assert sorted(r["s"] for r in got) == sorted(10**6 * a * a // (left * r) for a, left, r in rows)


def test_automata_are_minimal_and_keep_their_sequences():
    rng = np.random.default_rng(5)
    columns = [np.zeros(4000, np.int64), *[rng.integers(0, 12, 4000) for _ in range(3)]]
    rows, weight = count_automata.summed(columns, np.ones(4000, np.int64))
    weight = weight % 3 + 1
    words, tags = np.arange(12) * 10**17 - 10**18, np.array([b"en"], object)
    built = [count_automata.CountAutomaton.build(rows, weight, words, tags, None, block) for block in (1, 7, 1 << 17)]
    for a in [*built, count_automata.CountAutomaton.from_bytes(built[0].to_bytes())]:
        columns, counts = a.sequences()
        assert all((x == y).all() for x, y in zip(columns, rows, strict=True)) and (counts == weight).all()
        kinds = {tuple(zip(a.levels[3][1][i:j], a.levels[3][2][i:j], strict=True)) for i, j in zip(a.levels[3][0], a.levels[3][0][1:], strict=False)}
        assert len(kinds) == len(a.levels[3][0]) - 1
    one, two = count_automata.Sequences(rows, weight, words, tags), count_automata.Sequences(rows, weight * 2, words, tags)
    assert (count_automata.union([one, two]).weight == 3 * weight).all()
    some = count_automata.CountAutomaton.build([c[::5] for c in rows], weight[::5] * 0, words, tags)
    columns, counts = some.compose(built[0])
    assert (counts == weight[::5]).all() and all((x == y[::5]).all() for x, y in zip(columns, rows, strict=True))


# Prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children, out = defaultdict(list), []
    for key in members:
        if key:
            children[key[:-1]].append(key)

    def totals(key):
        own_saved = (len(members[key]) - 1) * len(WORDS.findall(key[-1][1])) if key else 0
        below = [totals(k) for k in children[key]]
        return (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))

    for key, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(key))
        leaves, saved = totals(key)
        out.append((convs[0], len(key), members[key[:-1]][0] if key else -1, len(convs), len(children[key]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found_trie(frame):
    got = prefix_trie.prefix_trie(frame).toPandas()
    got["parent_conv_id"] = got["parent_conv_id"].fillna(-1).astype("int64")
    return sorted(got.itertuples(index=False, name=None))


CONVERSATIONS = "conv_id long, turn long, role string, text string, pos long, depth int, a string"


def test_trie_of_awkward_rows(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 2, "bot", "one two"), (20, 0, "user", "x y"), (3, 0, "user", "only"),
            (-7, 5, "user", "minus"), (-7, 6, "user", "minus"), (-27, 0, "user", "a\tb"), (25, 0, "u", "t " * 30_000), (26, 0, "u", "t " * 30_000), (41, 1, "a", "b"), (41, 2, "a", "c")]
    rows += [(c, t, "user", f"turn {t}") for c in (60, 61, 62, 80) for t in range(c % 5 + 3)]
    rows += [(100, t, "user", f"deep {t}") for t in range(37)] + [(101, t, "user", f"deep {t}") for t in range(35)]
    frame = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], CONVERSATIONS)
    assert found_trie(frame) == plain_trie(rows)
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0
    # One conversation whose beginning is absent and longer than itself: the root alone.
    lone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 1)
    assert found_trie(spark.createDataFrame([(lone, 1, "u", "t", 1, 1, "x")], CONVERSATIONS)) == plain_trie([(lone, 1, "u", "t")])


def test_trie_of_random_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng = np.random.default_rng(9)
    rows = [(int(c), int(t), "ab"[rng.integers(2)], "w " * int(rng.integers(3))) for c in range(300) for t in range(rng.integers(1, 9))]
    assert found_trie(spark.createDataFrame([(*r, 1, 1, "x") for r in rows], CONVERSATIONS)) == plain_trie(rows)


# Language model


@pytest.mark.parametrize("top", [1, 40, 5000, 1 << 40, (1 << 62)])
def test_elias_fano_access_and_search(top):
    rng = np.random.default_rng(top % 97)
    for n in (1, 2, 63, 64, 65, 3000):
        values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        held = elias_fano.EliasFano(elias_fano.EliasFano.encode(values))
        assert (held.get(np.arange(n)) == values).all()
        once = np.unique(values)
        held = elias_fano.EliasFano(elias_fano.EliasFano.encode(once))
        asked = np.r_[once, rng.integers(0, top + 2, 200).astype(np.uint64), np.uint64(top + 1)]
        begin, end = rng.integers(0, len(once) + 1, len(asked)), rng.integers(0, len(once) + 1, len(asked))
        place = np.searchsorted(once, asked)
        hit = (place < len(once)) & (once[np.minimum(place, len(once) - 1)] == asked) & (place >= begin) & (place < end)
        assert (held.find(asked, begin, end) == np.where(hit, place, -1)).all()


def test_trie_of_trigrams_finds_all_and_nothing_else(tmp_path):
    rng = np.random.default_rng(1)
    columns = [rng.integers(1, 30, 6000), rng.integers(1, 200, 6000), rng.integers(0, 3000, 6000)]
    columns, counts = count_automata.summed(columns, np.ones(6000, np.int64))
    data, _ = lm_score.build_trie(columns, counts, {}, 0.75)
    (tmp_path / "trie").write_bytes(data)
    for trie in (elias_fano.NgramTrie.mapped(data), elias_fano.NgramTrie.open(str(tmp_path / "trie"))):
        one = trie.find_one(columns[0])
        two = trie.find_two(one, columns[1])
        three = trie.find_three(two, columns[2])
        assert (one >= 0).all() and (two >= 0).all() and ((three >= 0) == (columns[2] > 0)).all()
        assert len(np.unique(three[three >= 0])) == (columns[2] > 0).sum()
        known = set(zip(*[c.tolist() for c in columns], strict=True))
        asked = [rng.integers(1, 32, 3000), rng.integers(1, 210, 3000), rng.integers(1, 3100, 3000)]
        got = trie.find_three(trie.find_two(trie.find_one(asked[0]), asked[1]), asked[2])
        assert [(g >= 0) for g in got] == [t in known for t in zip(*[a.tolist() for a in asked], strict=True)]
    assert len(data) < 6000 * 12


def plain_scores(docs, discount=0.75):
    tokens = [["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORDS.findall(t or "")] + [None] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for ts, h in zip(tokens, held, strict=True):
        if not h:
            line = ["<2>", "<1>", *ts]
            c1.update(ts)
            c2.update(zip(line[1:], line[2:], strict=False))
            c3.update(zip(line, line[1:], line[2:], strict=False))
    total, kinds = sum(c1.values()), len(c1)
    n1, t1, n2, t2 = Counter(), Counter(), Counter(), Counter()
    for (a, _), c in c2.items():
        n1[a] += 1
        t1[a] += c
    for (a, b, _), c in c3.items():
        n2[a, b] += 1
        t2[a, b] += c
    out = []
    for (i, _), ts, h in zip(docs, tokens, held, strict=True):
        line, base, score = ["<2>", "<1>", *ts], 0.0, 0.0
        for j, w in enumerate(ts):
            a, b = line[j], line[j + 1]
            p = (c1[w] + 1) / (total + kinds + 1)
            base += math.log10(p)
            if t1[b]:
                p = max(c2[b, w] - discount, 0) / t1[b] + discount * n1[b] / t1[b] * p
            if t2[a, b]:
                p = max(c3[a, b, w] - discount, 0) / t2[a, b] + discount * n2[a, b] / t2[a, b] * p
            score += math.log10(p)
        out.append((i, h, len(ts), sum(c1[w] > 0 for w in ts), total, base, score))
    return out


def check_scores(frame, docs):
    def order(row):
        return (row[0] is None, row[0] or 0, row[2], row[5])

    got = [tuple(None if x is pd.NA or x is None or x != x else x for x in r) for r in frame.itertuples(index=False, name=None)]
    got, want = sorted(got, key=order), sorted(plain_scores(docs), key=order)
    assert [(g[0] if g[0] is None else int(g[0]), *g[1:5]) for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        # An eighth of a bit a step: each of the parts is off by half a step at most.
        assert abs(g[6] - w[6]) <= 2 * w[2] * 0.5 / 8 * math.log10(2)


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_a_plain_model(spark, sf_dir, monkeypatch, small):
    docs = [(int(i), t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id LIMIT 150").fetchall()]
    if small:
        # Many chunks and shards, so that frequent words are dealt by two words.
        for name, size in (("CHUNK", 3000), ("SHARD", 1500), ("VOCABULARY", 700)):
            monkeypatch.setattr(lm_score, name, size)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check_scores(lm_score.lm_scores(frame).toPandas().astype({"doc_id": object}), docs)


def test_scores_of_awkward_rows(spark, awkward, tmp_path):
    docs = [(r[0], r[1]) for r in AWKWARD]
    got = lm_score.lm_scores(awkward, model_path=str(tmp_path / "model"))
    frame = got.toPandas()
    check_scores(frame.assign(doc_id=[None if pd.isna(i) else int(i) for i in frame["doc_id"]]), docs)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert all(elias_fano.NgramTrie(bytes(r["trie"])).one.size for r in spark.read.parquet(str(tmp_path / "model")).collect())
    assert lm_score.lm_scores(awkward.limit(0)).count() == 0
    # Nothing to learn from: every token is as likely.
    lone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score.lm_scores(spark.createDataFrame([(lone, "a b")], "doc_id long, text string")).first()
    assert (row["n_known"], row["train_tokens"], row["score"]) == (0, 0, 0.0)


# Near duplicates by forests


def test_a_large_group_of_partly_similar_copies_gives_a_forest(spark):
    """Documents that differ from a common text in a few words each: some pairs are near and some are not."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(2000):
        own = list(words)
        for at in rng.choice(90, 2, replace=False):
            own[at] = f"x{i}-{at}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    links = []
    real = near_dedup.cross_links

    def counted(*args):
        links.append(near_dedup.written(real(*args), "test-links"))
        return links[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near_dedup, "cross_links", counted)
        got = near_dedup.near_duplicates(frame, 4, 80, cell=300, orders=0).toPandas().sort_values("doc_id")
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in map(str.split, texts)]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[max(find(i), find(j))] = min(find(i), find(j))
    assert got["component_id"].tolist() == [find(i) for i in range(len(texts))]
    # Far fewer than the pairs: a forest per cell.
    assert links[0].count() < 112 * len(texts)


def test_near_copies_keep_clashing_columns_and_other_texts_of_an_id(spark):
    rows = [(1, "a b c d e f", "q", 7, "k"), (1, "other words than those before", "r", 8, "l"), (1, "a b c d e f", "s", 9, "m"), (2, "a b c d e f", "t", 1, "n"), (None, "a b c d e f", "u", 2, "o")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string, nth int, mark string")
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    found = sorted(map(tuple, kept.collect()), key=str)
    assert [r[:2] for r in found] == [(1, "a b c d e f"), (1, "other words than those before"), (None, "a b c d e f")]
    assert all(r in rows for r in found)
    assert near_dedup.keep_one(frame.limit(0)).count() == 0
