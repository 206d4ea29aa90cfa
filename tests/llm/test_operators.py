"""Each training-data operator against a brute-force version, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netpulse.llm import best_fit, cross_polytope, language_id, line_spread, link_trust, multiset_hash, near_dedup, quality_qda, queries, source_mix, token_planes
from netpulse.llm.text import BATCH, WORD, TokenIds
from tools.check import compare, oracle_connection

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, extra int, tie int, key string"
AWKWARD = [
    (1, None, None, None, None, 1, 0, "a"),
    (None, "no id at all\nsecond line", "en", "s1", 1, 1, 0, "a"),
    (2, "", "en", "s1", 0, 1, 0, "a"),
    (3, "the same text here. twice over\nline", "en", None, 35, 1, 0, "a"),
    (4, "the same text here. twice over\nline", "fr", "s2", 35, 1, 0, "a"),
    (4, "the same text here. twice over\nline", "fr", "s2", 35, 2, 0, "b"),
    (5, "été über ß ÉTÉ 東京 " * 300, "de", "s2", 9, 1, 0, "a"),
    (6, " \t\n ", "en", "s3", 4, 1, 0, "a"),
    (7, "one", "en", "s3", 3, 1, 0, "a"),
    (8, "long " * 20_000 + "\nend", "en", "s1", 1, 1, 0, "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, KIND).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").df()


@pytest.fixture(scope="module")
def encoded(docs):
    return [e.ids for e in TokenIds(queries.TOKENIZER).tokenizer.encode_batch(list(docs["text"]), add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    odd = ["a\x0bb\x0cc", "H\u0331ello H", "it's -'s don't. 'tis x<y", "foo<|endoftext|>bar", "A\x1cb  c d\x85e", "ÄÖÜß. é,a-b/c 1,2.3 ...",
           "x\u0338≠", "İIı ΣΑΣ σ", "", "   ", "a" * 3000 + " " + "é" * 3000, "日本語 テスト。abc。", "I'LL HE'S 'S", "naïve!!naïve?? a!b"]
    encoder = TokenIds(queries.TOKENIZER)
    assert [x.tolist() for x in encoder.ids_of(odd)] == [e.ids for e in encoder.tokenizer.encode_batch(odd, add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(tmp_path, kind):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 2500, dtype=np.uint32)
    writer = token_planes.ShardWriter(str(tmp_path / "x.tpl"), kind, 1000)
    cuts = [0, 10, 10, 2100, 2500]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        writer.add(None if i == 1 else i, ids[a:b])
    writer.close()
    reader = token_planes.ShardReader(str(tmp_path / "x.tpl"))
    assert [c[1] for c in reader.chunks] == [1000, 1000, 500]
    assert (reader.chunk(1) == ids[1000:2000]).all()
    got = list(reader.documents())
    assert [g[0] for g in got] == [0, None, 2, 3] and (np.concatenate([g[1] for g in got]) == ids).all()


def test_token_planes(spark, sf_dir, docs, encoded, awkward, empty):
    got = queries.op1_token_planes(spark, sf_dir).toPandas().sort_values("doc_id")
    sizes = np.array([len(e) + 1 for e in encoded])
    assert got["doc_id"].tolist() == docs["doc_id"].tolist() and got["n_tokens"].tolist() == sizes.tolist()
    assert got["start"].tolist() == (np.cumsum(sizes) - sizes).tolist()
    assert got["ids_crc32"].tolist() == [crc([*e, 2]) for e in encoded]
    rows = token_planes.token_planes(awkward, queries.TOKENIZER, 2, block=100).collect()
    assert len(rows) == len(AWKWARD) and next(r for r in rows if r["doc_id"] == 1)["ids_crc32"] == crc([2])
    assert token_planes.token_planes(empty, queries.TOKENIZER, 2).count() == 0


def one_by_one(lengths, capacity):
    """Plain best-fit decreasing: remaining capacities of the bins."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= length]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_pack_counts_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400) if seed % 2 else rng.choice([3, 34, 50, 67, 100], 400)
    runs, bins = best_fit.pack_counts({int(k): int(v) for k, v in Counter(lengths.tolist()).items()}, 100)
    left = [100] * bins
    for length, first, first_bin, per_bin, _ in runs:
        upto = min([r[1] for r in runs if r[0] == length and r[1] > first], default=Counter(lengths.tolist())[length])
        for i in range(upto - first):
            left[first_bin + i // per_bin] -= length
    assert sorted(left) == one_by_one(lengths.tolist(), 100)


def test_best_fit(spark, sf_dir, docs, encoded, awkward, empty):
    got = queries.op9_best_fit(spark, sf_dir).toPandas()
    expected = {}
    for doc, ids in zip(docs["doc_id"], encoded, strict=True):
        ids = [*ids, 1]
        expected |= {(doc, k): (s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == expected and len(got) == len(expected)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096
    assert got["sequence_id"].nunique() == len(one_by_one(got["length"].tolist(), 4096))
    assert best_fit.best_fit_pack(awkward, queries.TOKENIZER).select("doc_id").distinct().count() == 9
    assert best_fit.best_fit_pack(empty, queries.TOKENIZER).count() == 0


def test_source_mix(spark, sf_dir, docs, awkward, empty):
    got = queries.op2_source_mix(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    again = queries.op2_source_mix(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(again) and got["size"].tolist() == [len(WORDS.findall(t)) for t in docs["text"]]
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(by["taken"] - by["target"]) <= 1).all() and abs(by["target"].sum() - got["size"].sum()) < 1e-6
    rows = source_mix.source_mix(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert source_mix.source_mix(empty).count() == 0
    texts = source_mix.mixed_documents(awkward, block=50)
    assert texts.columns == awkward.columns
    words = texts.toPandas()["text"].map(lambda t: len(WORDS.findall(t))).sum()
    assert words == sum(r["taken"] for r in source_mix.source_mix(awkward, block=50).collect())
    assert source_mix.mixed_documents(empty).count() == 0


def test_mix_cuts_texts_without_workers(spark, awkward):
    texts = ["  a b\x0bc\n\nd  ", "\ta", "éü\x85x  y  日本 語\U0001f600 z\x1cq", "\r\nx  y\x00z w\n"]
    rows = [(t, [(a, b), (b, min(b + 1, n))]) for t in texts for n in [len(re.findall(WORD, t))] for b in range(n + 1) for a in range(b + 1)]
    frame = spark.createDataFrame(rows, "text string, spans array<struct<at: long, upto: long>>")
    for text, spans, got in frame.withColumn("cut", source_mix._cut("text", "spans")).collect():
        starts = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
        starts[0] = 0
        assert got == "".join(text[starts[a] : starts[b]] for a, b in spans)
    # Workers draw the slots only: no text goes there, and the table of sources comes from no list of rows.
    plan = source_mix.mixed_documents(awkward, block=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "ExternalRDD" not in plan and "LogicalRDD" not in plan


def test_targets_stop_at_three_times_the_size():
    table = pd.DataFrame({"source": [None, "b", "a"], "source_size": [80, 10, 10]})
    got = source_mix.targets(table)
    assert got["source"].tolist() == ["a", "b", None] and np.allclose(got["target"], [30, 30, 40])


def test_permutations_and_draws():
    for size in (1, 2, 7, 1000):
        place = np.arange(size)
        out = source_mix.permute(place, np.full(size, size), np.full(size, 9, np.uint64))
        assert sorted(out.tolist()) == place.tolist()
    slots = np.array([5000, 100, 1, 0])
    draws = [source_mix.shard_counts(slots, s, 3, 64) for s in range(80)]
    assert (sum(d[1] for d in draws) == slots).all() and (np.cumsum([d[1] for d in draws], axis=0)[:-1] == [d[0] for d in draws[1:]]).all()
    assert {int(d[1].sum()) for d in draws[:-1]} == {64}


def brute_groups(texts, ids, width, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [ids[find(i)] for i in range(len(texts))]


def test_near_dedup(spark, awkward, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(15):
        base = list(rng.choice(vocabulary, rng.integers(5, 200)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 6)):
            base = base.copy()
            for at in rng.integers(0, len(base), rng.integers(1, 1 + len(base) // 30 + 1)):
                base[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(base).upper() if rng.random() < 0.3 else "  ".join(base))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, groups = brute_groups(texts, list(range(len(texts))), 4, 80)
    # The small cell forces buckets to be dealt to several cells.
    for limits in ({"orders": 1}, {"cell": 2, "orders": 0}):
        got = near_dedup.near_duplicates(frame, 4, 80, **limits).toPandas().sort_values("doc_id")
        assert got["n_shingles"].tolist() == sizes and got["component_id"].tolist() == groups
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(awkward, 4, orders=0).collect()}
    assert rows[4]["component_id"] == 3 and rows[1]["n_shingles"] == 0 and rows[6]["kept"] and rows[None]["component_id"] is None and rows[None]["kept"]
    kept = near_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_loops_of_near_dedup_leave_few_files(spark, monkeypatch):
    files, real = defaultdict(list), near_dedup.written

    def counted(frame, purpose):
        out = real(frame, purpose)
        files[purpose].append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    base = [f"{i} " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(150)]
    rows = [(3 * i + k, f"{text}{' more' * k}") for i, text in enumerate(base) for k in range(3)]
    kept = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d - d % 3 for d, _ in rows}
    assert files["labels"] and max(files["labels"] + files["edges"] + files["members"] + files["paired"]) <= near_dedup.FEW


def test_near_dedup_compares_all_pairs_of_a_large_bucket(spark, monkeypatch):
    # All documents share one key and no second one; seven components are more than the bucket has.
    monkeypatch.setattr(near_dedup, "_keys", lambda: F.array(F.lit(16).cast("long")))
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([*words[:60], f"x{i}", *words[61:]]) for i in range(4)] + [" ".join(f"y{i}{j}" for j in range(50)) for i in range(3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(frame, 4, 80, bucket=2, orders=0).toPandas().sort_values("doc_id")
    assert got["component_id"].tolist() == brute_groups(texts, list(range(7)), 4, 80)[1] == [0, 0, 0, 0, 4, 5, 6]


def test_language_id(spark, sf_dir, docs, awkward, empty):
    got = queries.op4_language_id(spark, sf_dir).toPandas().merge(docs, on="doc_id")
    held = got[got["held_out"]]
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["score"].between(0, 1).all() and got["rejected"].mean() < 0.02
    rows = language_id.language_id(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["lang_pred"] == "und" and r["rejected"] for r in rows if r["doc_id"] in (1, 2, 6))
    assert language_id.in_known_language(awkward).columns == awkward.columns
    assert language_id.language_id(empty).count() == 0


def test_long_texts_give_every_subword_once():
    text = "ab cdé " * 50
    whole = np.sort(np.concatenate(list(language_id.subwords(text))))
    size, language_id._CHARS = language_id._CHARS, 17
    try:
        assert (np.sort(np.concatenate(list(language_id.subwords(text)))) == whole).all()
    finally:
        language_id._CHARS = size


def test_nearest(spark, sf_dir):
    rows = duckdb.sql(f"SELECT * FROM '{sf_dir}/embeddings.parquet' ORDER BY vec_id").df()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = queries.op5_cross_polytope(spark, sf_dir).toPandas().sort_values(["query_id", "rank"])
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -9
        mine = got[got["query_id"] == ids[i]]
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine["score"], scores[np.searchsorted(ids, mine["vec_id"])], atol=1e-12)
        hits.append(len(set(mine["vec_id"]) & set(ids[np.lexsort((ids, -scores))[:20]])) / 20)
    assert np.mean(hits) >= 0.9


def test_nearest_of_awkward_vectors(spark):
    kind = "vec_id long, embedding array<float>, v int"
    rows = [(0, [1.0, 0.0], 1), (1, [3.0, 0.0], 1), (2, [3.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (20, [0.0, -1.0], 1)]
    got = cross_polytope.nearest(spark.createDataFrame(rows, kind), F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert cross_polytope.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["norms", "outlier", "dimensions"])
def test_nearest_of_unlike_norms_and_other_dimensions(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 384 if kind == "dimensions" else 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms":
        x *= rng.lognormal(0, 0.3, (500, 1))
    elif kind == "outlier":
        x[7] *= 5
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = cross_polytope.nearest(frame, F.col("vec_id") % 20 == 0, k=20).toPandas()
    hits = []
    for i in range(0, 500, 20):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits.append(len(set(got[got["query_id"] == i]["vec_id"]) & set(np.argsort(-scores)[:20])) / 20)
    assert np.mean(hits) >= 0.9


PAGES = [
    (1, "http://Good.ORG/fr/x?q#f", '<a href="http://b.com/1"><a href=/own><a href="//c.com">', 0),
    (2, "https://b.com/p", "<a HREF='https://d.com'>", 0),
    (3, "http://e.com/", '<a href="http://bad.net/">', 0),
    (4, "http://bad.net/", None, 0),
    (5, "http://www.example.net/en/a://b", "", 0),
    (6, "http://example.com/de/x", '<a href="http://bad.net/z">', 0),
    (7, None, None, 0),
    (8, "no scheme/en/", None, 0),
    (None, "http://bad.net?x=/", None, 0),
    (4, "http://bad.net/", None, 0),
]


def test_link_trust(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, host int")
    got = link_trust.url_verdicts(pages).toPandas()
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    assert compare(got, con.sql(queries.ORACLES["op6_link_trust"]).df()) == "ok"
    by = {r.page_id: r for r in got.itertuples() if r.page_id == r.page_id}
    assert (by[1].verdict, by[1].rule, by[1].host, by[1].path) == ("allow", "org/fr/", "good.org", "/fr/x")
    assert by[2].trust > 0 and by[3].verdict == "block" and by[3].rule is None and by[5].rule == "example.net/en/" and by[6].verdict == "block"
    assert (by[7].host, by[7].path, by[7].verdict, by[8].host) == ("", "", "allow", "")
    assert link_trust.url_verdicts(pages.limit(0)).count() == 0


def test_link_trust_does_not_depend_on_the_number_of_seeds(spark):
    def pages(n):
        # n blocked hosts, each with a host that links to it alone; then a way of 12 hosts to the first of them.
        rows = [(i, f"http://s{i}.net/", None) for i in range(n)]
        rows += [(n + i, f"http://f{i}.com/", f'<a href="http://s{i}.net/">') for i in range(n)]
        rows += [(2 * n + i, f"http://c{i}.com/", f'<a href="http://{f"c{i - 1}" if i else "f0"}.com/">') for i in range(12)]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    for n in (1, 400):
        got = link_trust.url_verdicts(pages(n)).toPandas()
        assert (got["verdict"] == "block").sum() == len(got) == 2 * n + 12
        con = duckdb.connect()
        frame = pages(n).toPandas()
        con.register("pages", frame)
        assert compare(got, con.sql(queries.ORACLES["op6_link_trust"]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir).toPandas(), oracle_connection(sf_dir).sql(queries.ORACLES[name]).df()) == "ok"


def test_line_dedup(spark, awkward, empty):
    rows = [(i, f"own line {i}\nshared\n\ntwice" if i < 4 else f"shared\nown {i}", f"s{i}") for i in range(8)]
    rows.append((9, "shared\nshared", "s9"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_spread.line_dedup(frame, 5).collect()}
    assert got[0]["text"] == rows[0][1] and got[1]["text"] == "own line 1\n\ntwice" and got[9]["text"] == "" and got[9]["n_removed"] == 2
    out = line_spread.without_boilerplate(awkward, 2)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)
    assert line_spread.line_dedup(empty).count() == 0
    places = line_spread.line_places(frame)
    parts = [line_spread.line_sketches(places.where(c)) for c in ("doc_id < 4", "doc_id >= 4")]
    merged = line_spread.merge_sketches(parts[0].unionByName(parts[1])).select("line", F.hll_sketch_estimate("sites").alias("n"))
    exact = {r["line"]: r["n"] for r in places.groupBy("line").agg(F.count_distinct("site").alias("n")).collect()}
    assert {r["line"]: r["n"] for r in merged.collect()} == exact


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["removed", "_gone_id", "n_lines", "n_removed", "row", "id", "tie", "gone_id", "gone_tie", "line", "first", "part", "a.b"]
    rows = [(i, f"own {i}\nshared", f"s{i}", *[f"{n}{i}" for n in names]) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = line_spread.without_boilerplate(frame)
    assert out.columns == frame.columns
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got == {r[0]: (r[0], r[1] if r[0] == 0 else f"own {r[0]}", *r[2:]) for r in rows}
    assert {r["n_removed"] for r in line_spread.line_dedup(frame).collect()} == {0, 1}


def test_line_dedup_counts_sites_exactly_near_the_threshold_only(spark):
    """Lines on 1 to 40 sites, each repeated on its sites, against plain counts; no exchange of all (line, site) pairs."""
    rows = [(1000 * n + i, f"line {n}\nown {n} {i}", f"s{i % n}") for n in range(1, 41) for i in range(2 * n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (5, 12):
        got = {r["doc_id"]: r["n_removed"] for r in line_spread.line_dedup(frame, least).collect()}
        assert got == {d: int(d // 1000 >= least and d % 1000 > 0) for d, _, _ in rows}


def test_multiset_hash(spark, sf_dir, docs, awkward, empty):
    got = queries.op8_multiset_hash(spark, sf_dir).toPandas().sort_values("doc_id")
    texts = list(docs["text"])
    edited = [t[: len(t) - len(t) // 3] + texts[i - 1][: len(t) // 3] for i, t in enumerate(texts)]
    assert got["edited_sha256"].tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    assert got["n_chars"].tolist() == [len(t) for t in texts] and got["fingerprint"].nunique() == len(set(texts))
    assert (got["near_edited"] > got["near_next"]).mean() > 0.95
    rows = {r["doc_id"]: r for r in multiset_hash.multiset_hash(awkward).collect()}
    assert len(rows) == 9 and rows[3]["fingerprint"] == rows[4]["fingerprint"] and rows[1]["fingerprint"] == rows[2]["fingerprint"]
    assert multiset_hash.multiset_hash(empty).count() == 0


def test_fingerprints_are_homomorphic(spark):
    texts = spark.createDataFrame([(1, "a b.\nc d.\ne"), (2, "e\na b.\nc d."), (3, "a b.\nc d."), (4, "e"), (5, "x")], "k long, t string")
    p = {r["k"]: r for r in multiset_hash.fingerprints(texts, ["k"], "t").collect()}
    assert p[1]["exact"] == p[2]["exact"] != p[3]["exact"] and p[1]["like"] == p[2]["like"]
    both = spark.createDataFrame([(p[3]["exact"], p[4]["exact"], p[1]["exact"])], "a array<long>, b array<long>, c array<long>")
    row = both.select(multiset_hash.combine(F.col("a"), F.col("b")).alias("plus"), multiset_hash.combine(F.col("c"), F.col("b"), -1).alias("minus")).first()
    assert row["plus"] == p[1]["exact"] and row["minus"] == p[3]["exact"]


def test_quality(spark, sf_dir, awkward, empty):
    labels = duckdb.sql(f"SELECT * FROM '{sf_dir}/labels.parquet'").df()
    got = queries.op10_quality_qda(spark, sf_dir).toPandas().merge(labels, on="doc_id")
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9 and (got["predicted"] == (got["score"] >= 0.5)).all()
    marks = spark.createDataFrame([(2, 1, 0), (2, None, 1), (None, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality_qda.quality_scores(awkward, marks).collect()] == [0.5] * len(AWKWARD)
    assert quality_qda.quality_scores(empty, marks).count() == 0


def test_quadratic_discriminant_equals_plain_densities():
    rng = np.random.default_rng(2)
    x = [rng.normal(0, 1, (300, 3)) @ np.diag([1, 2, 3]), rng.normal(1, 2, (200, 3))]
    model = quality_qda.fit([300.0, 200.0], [a.sum(axis=0) for a in x], [a.T @ a for a in x])
    pooled = sum(np.cov(a.T, bias=True) * len(a) for a in x) / 500
    density = []
    for a in x:
        cov = 0.85 * np.cov(a.T, bias=True) + 0.1 * pooled + 0.05 * np.diag(np.diag(pooled))
        away = x[1] - a.mean(axis=0)
        density.append(np.log(len(a) / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    assert np.allclose(model.scores(x[1]), 1 / (1 + np.exp(-(density[1] - density[0]) / 3)))


@pytest.mark.parametrize("module", [language_id, best_fit])
def test_texts_go_to_workers_in_small_batches(spark, sf_dir, monkeypatch, module):
    name, sizes, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], module.written

    def noted(frame, purpose):
        sizes.append((purpose, int(spark.conf.get(name))))
        return real(frame, purpose)

    monkeypatch.setattr(module, "written", noted)
    before = spark.conf.get(name)
    import corpus_pipeline

    stage = {language_id: corpus_pipeline.language, best_fit: corpus_pipeline.pack}[module]
    stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).count()
    assert sizes == [({language_id: "known-language", best_fit: "pieces"}[module], BATCH)] and spark.conf.get(name) == before


def test_pipeline(spark, sf_dir, docs, tmp_path):
    import corpus_pipeline

    frame, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path / name)
        stage(spark, frame, sf_dir).write.parquet(folder)
        frame = spark.read.parquet(folder)
        seen.append((name, frame.toPandas()))
        if name != "pack":
            assert frame.columns == list(docs.columns)
    stages = dict(seen)
    assert len(stages["language"]) >= 0.98 * len(docs)
    lines = stages["lines"].sort_values("doc_id")
    _, groups = brute_groups(lines["text"].tolist(), lines["doc_id"].tolist(), 5, 80)
    assert sorted(stages["near_copies"]["doc_id"]) == sorted(set(groups))
    words = stages["mix"]["text"].map(lambda t: len(WORDS.findall(t))).sum()
    assert abs(words - stages["near_copies"]["text"].map(lambda t: len(WORDS.findall(t))).sum()) <= 20
    assert stages["pack"].groupby("sequence_id")["length"].sum().max() <= 4096
