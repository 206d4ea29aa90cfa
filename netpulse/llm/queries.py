"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.llm.best_fit import best_fit_pack
from netpulse.llm.collocations import BEST, LEAST, collocations
from netpulse.llm.cross_polytope import nearest
from netpulse.llm.language_id import language_id
from netpulse.llm.lm_score import lm_scores
from netpulse.llm.line_spread import MIN_SITES, line_dedup
from netpulse.llm.link_trust import BOUND, DAMPING, MARGIN, ROUNDS, RULES, SEED, UNIT, url_verdicts
from netpulse.llm.multiset_hash import multiset_hash
from netpulse.llm.near_dedup import near_duplicates
from netpulse.llm.prefix_trie import prefix_trie
from netpulse.llm.quality_qda import quality_scores
from netpulse.llm.source_mix import source_mix
from netpulse.llm.token_planes import token_planes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash(_table(spark, sf_dir, "documents"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=1, capacity=4096)


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), longest=3, least=LEAST, best=BEST)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_planes, op2_source_mix, op3_near_dedup, op4_language_id, op5_cross_polytope,
        op6_link_trust, op7_line_spread, op8_multiset_hash, op9_best_fit, op10_quality_qda,
        op11_collocations, op12_prefix_trie, op13_lm_score,
    )
}


def _line_spread_sql() -> str:
    return f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, text, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents WHERE text IS NOT NULL),
spread AS (SELECT line FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
hits AS (SELECT doc_id, place, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS nth
  FROM lines SEMI JOIN spread USING (line)),
gone AS (SELECT doc_id, place FROM hits WHERE nth > 1),
marked AS (SELECT l.*, g.place IS NOT NULL AS removed FROM lines l LEFT JOIN gone g USING (doc_id, place)),
clean AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT removed), '') AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  length(c.text) AS n_chars, sha256(c.text) AS text_sha256
FROM documents LEFT JOIN clean c USING (doc_id)"""


def _after(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _host(url: str) -> str:
    return (
        f"coalesce(translate(regexp_extract({_after(url)}, '^[^/?#]*', 0), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    )


def _link_trust_sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))

    def case(value) -> str:
        whens = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in rules
        )
        return f"CASE {whens} END"

    rounds = "".join(
        f""",
heard{i} AS (SELECT there AS host, kind,
    sum((score * {DAMPING} // 100) * (links * 1000000 // all_links) // 1000000)::BIGINT AS part
  FROM ways JOIN score{i} ON ways.here = score{i}.host AND ways.kind = score{i}.kind2 GROUP BY ALL),
score{i + 1} AS (SELECT coalesce(s.host, h.host) AS host, coalesce(s.kind, h.kind) AS kind2,
    coalesce(base * {100 - DAMPING} // 100, 0) + coalesce(part, 0) AS score
  FROM start s FULL JOIN heard{i} h ON s.host = h.host AND s.kind = h.kind)"""
        for i in range(ROUNDS)
    )
    own = SEED * (100 - DAMPING) // 100
    # A step holds every host of either kind; the last step is the first that changes little enough after ROUNDS rounds.
    seeded = f"""
seed_step(step, host, kind, seeds, before) AS (
  SELECT 0, host, kind, {own}::HUGEINT, 0::HUGEINT FROM start
  UNION ALL SELECT * FROM (
    WITH alive AS (SELECT * FROM seed_step
        WHERE step < {ROUNDS} OR (SELECT sum(seeds - before) FROM seed_step) > {BOUND}),
      heard AS (SELECT there AS host, w.kind AS kind, sum(seeds * (links * {DAMPING}) // (all_links * 100)::HUGEINT) AS part
        FROM ways w JOIN alive a ON w.here = a.host AND w.kind = a.kind GROUP BY ALL),
      hosts AS (SELECT host, kind FROM alive UNION SELECT host, kind FROM heard)
    SELECT (SELECT max(step) FROM alive) + 1, h.host, h.kind,
      CASE WHEN s.host IS NULL THEN 0 ELSE {own} END + coalesce(part, 0), coalesce(a.seeds, 0)
    FROM hosts h LEFT JOIN start s ON s.host = h.host AND s.kind = h.kind
      LEFT JOIN heard d ON d.host = h.host AND d.kind = h.kind LEFT JOIN alive a ON a.host = h.host AND a.kind = h.kind)),
by_seeds AS (SELECT host, max(seeds) FILTER (WHERE kind = 'trust') AS trust_seeds,
    max(seeds) FILTER (WHERE kind = 'distrust') AS distrust_seeds
  FROM seed_step WHERE step = (SELECT max(step) FROM seed_step) GROUP BY host),"""
    link = r"""(?i)\bhref\s*=\s*["'']?([^"''\s>]+)"""
    return f"""
WITH RECURSIVE split AS (SELECT page_id, html, {_host('url')} AS host,
    coalesce(regexp_extract({_after('url')}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS decided FROM split),
links AS (SELECT host AS from_host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM split),
full_links AS (SELECT from_host, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM links),
ends AS (SELECT from_host, {_host('link')} AS to_host FROM full_links),
edges AS (SELECT from_host, to_host, count(*) AS links FROM ends
  WHERE from_host <> '' AND to_host <> '' AND from_host <> to_host GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, from_host AS here, to_host AS there, links FROM edges
  UNION ALL SELECT 'distrust', to_host, from_host, links FROM edges),
ways AS (SELECT *, sum(links) OVER (PARTITION BY kind, here)::BIGINT AS all_links FROM both_ways),
sides AS (SELECT host, bool_or(decided = 'block') AS bad, bool_or(decided = 'allow') AS good
  FROM judged WHERE decided IS NOT NULL AND host <> '' GROUP BY host),
seeds AS (SELECT host, CASE WHEN bad THEN 'distrust' ELSE 'trust' END AS kind FROM sides WHERE bad <> good),
start AS (SELECT host, kind, {UNIT} // count(*) OVER (PARTITION BY kind) AS base FROM seeds),
score0 AS (SELECT host, kind AS kind2, base AS score FROM start){rounds},{seeded}
by_host AS (SELECT host, max(score) FILTER (WHERE kind2 = 'trust') AS trust,
    max(score) FILTER (WHERE kind2 = 'distrust') AS distrust FROM score{ROUNDS} GROUP BY host)
SELECT page_id, j.host AS host, path, rule, coalesce(decided,
    CASE WHEN coalesce(distrust_seeds, 0) > coalesce(trust_seeds, 0) + {MARGIN * SEED // UNIT} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM judged j LEFT JOIN by_host b ON j.host = b.host LEFT JOIN by_seeds c ON j.host = c.host"""


def _collocations_sql() -> str:
    return f"""
WITH low AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, text FROM
  (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS text FROM low)),
words AS (SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS place
  FROM (SELECT lang, piece, regexp_extract_all(text, '[^\\x20\\x09]+') AS w FROM pieces)),
windows AS (SELECT lang, w, lead(w) OVER (PARTITION BY piece ORDER BY place) AS w2,
    lead(w, 2) OVER (PARTITION BY piece ORDER BY place) AS w3 FROM words),
f1 AS (SELECT lang, w AS p1, count(*) AS f FROM windows GROUP BY ALL),
f2 AS (SELECT lang, w AS p1, w2 AS p2, count(*) AS f FROM windows WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w AS p1, w2 AS p2, w3 AS p3, count(*) AS f FROM windows WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT f2.lang, f2.p1, f2.p2, NULL AS p3, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2
    JOIN f1 x ON x.lang = f2.lang AND x.p1 = f2.p1 JOIN f1 y ON y.lang = f2.lang AND y.p1 = f2.p2 WHERE f2.f >= {LEAST}
  UNION ALL SELECT f3.lang, f3.p1, f3.p2, f3.p3, f3.f, x.f, y.f, 1 FROM f3
    JOIN f1 x ON x.lang = f3.lang AND x.p1 = f3.p1 JOIN f2 y ON y.lang = f3.lang AND y.p1 = f3.p2 AND y.p2 = f3.p3
  UNION ALL SELECT f3.lang, f3.p1, f3.p2, f3.p3, f3.f, x.f, y.f, 2 FROM f3
    JOIN f2 x ON x.lang = f3.lang AND x.p1 = f3.p1 AND x.p2 = f3.p2 JOIN f1 y ON y.lang = f3.lang AND y.p1 = f3.p3),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p1, p2, p3 ORDER BY score, k) = 1),
longer AS (SELECT lang, p1, p2, max(f) AS f FROM
  (SELECT lang, p1, p2, f FROM f3 UNION ALL SELECT lang, p2, p3, f FROM f3) GROUP BY lang, p1, p2),
kept AS (SELECT c.*, concat_ws(' ', c.p1, c.p2, c.p3) AS phrase FROM lowest c
  LEFT JOIN longer g ON c.p3 IS NULL AND g.lang = c.lang AND g.p1 = c.p1 AND g.p2 = c.p2 WHERE g.f IS NULL OR 100 * g.f < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {BEST}"""


def _prefix_trie_sql() -> str:
    return r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base FROM turns GROUP BY conv_id),
bits AS (SELECT conv_id, base, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
      lambda x, i: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM convs),
plan AS (SELECT conv_id, base, xor(crc, 4294967295) % 4 AS h FROM bits),
rebuilt AS (SELECT p.conv_id, pos, 0 AS part, role, text FROM plan p JOIN turns t ON t.conv_id = p.base WHERE pos < h
  UNION ALL SELECT p.conv_id, pos, 1, role, text FROM plan p JOIN turns t USING (conv_id) WHERE pos >= h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM rebuilt),
lists AS (SELECT conv_id, list([role, text] ORDER BY depth) AS turns FROM placed GROUP BY conv_id),
prefixes AS (SELECT conv_id, depth, to_json(turns[1:depth])::VARCHAR AS key, turns[depth][2] AS last
    FROM (SELECT *, unnest(range(1, len(turns) + 1)) AS depth FROM lists)
  UNION ALL SELECT conv_id, 0, '', '' FROM plan),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')) AS own FROM prefixes GROUP BY key, depth),
ups AS (SELECT n.key, u.key AS up_key, u.conv_id AS up_id FROM nodes n
  JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes u ON u.key = p.key),
children AS (SELECT up_key AS key, count(*) AS n_children FROM ups GROUP BY up_key),
marked AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)),
sums AS (SELECT p.key, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(m.own) AS saved_tokens
  FROM marked m JOIN prefixes p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.key),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM prefixes
  JOIN (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id) USING (conv_id, depth) GROUP BY key)
SELECT m.conv_id, m.depth::BIGINT AS depth, up_id AS parent_conv_id, n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM marked m JOIN sums USING (key) LEFT JOIN ups USING (key) LEFT JOIN ends USING (key)"""


ORACLES = {"op11_collocations": _collocations_sql(), "op12_prefix_trie": _prefix_trie_sql(), "op6_link_trust": _link_trust_sql(), "op7_line_spread": _line_spread_sql()}
