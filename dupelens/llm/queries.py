"""The registered queries of this subpackage and their SQL: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    """Where an installed public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import read_tokens, write_tokens

    folder, manifest = write_tokens(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), end_id=1)
    return read_tokens(spark, folder, manifest)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN, ids=False, digest=True)


#: A stated key, so that reruns agree; production jobs pass their own.
PII_KEY = b"dupelens-example-key"


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op5_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import measure, read_archives, write_archives

    return measure(read_archives(spark, write_archives(table(spark, sf_dir, "documents"))))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score(docs, *train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: Fixed by the contract: verdict and rule.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import html_label, judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES, html_label(F.col("html"))).drop("html")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, digest=True)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, quality_weights

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, quality=quality_weights(table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import dedup_passages

    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, digest=True)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize
    from .prefixtrie import prefix_trie, rebuilt, signed

    turns = materialize(signed(table(spark, sf_dir, "conversations")), "turns")
    convs = turns.select("conv_id").distinct()
    return prefix_trie(rebuilt(turns, convs), convs)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT w.doc_id, coalesce(any_value(k.c), 0) AS n, md5(coalesce(string_agg(s.g, chr(10) ORDER BY s.g), '')) AS name
  FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, count(*) AS c FROM s GROUP BY 1) k ON k.doc_id = w.doc_id GROUP BY w.doc_id
), c AS (
  SELECT name, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM n GROUP BY name
), r AS (
  SELECT s.* FROM s JOIN c ON c.rep = s.doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y, cy.copies FROM p JOIN c cx ON cx.rep = x JOIN c cy ON cy.rep = y WHERE 5 * m >= 4 * (cx.n + cy.n - m)
), walk AS (
  SELECT rep AS x, rep AS y FROM c UNION SELECT walk.x, l.y FROM walk JOIN l ON l.x = walk.y
), heads AS (
  SELECT x, min(y) AS head FROM walk GROUP BY x
), deg AS (
  SELECT x, count(*) AS texts, sum(copies) AS docs FROM l GROUP BY x
)
SELECT n.doc_id, heads.head AS class_id, c.rep AS copy_id, (coalesce(deg.docs, 0) + c.copies - 1)::BIGINT AS n_links, coalesce(deg.texts, 0)::BIGINT AS n_text_links
FROM n JOIN c USING (name) JOIN heads ON heads.x = c.rep LEFT JOIN deg ON deg.x = c.rep
"""

OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), often AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, o.k IS NOT NULL AND l.doc_id <> o.keeper AS gone FROM lines l LEFT JOIN often o ON o.k = l.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS v FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (CASE WHEN v = 1 THEN 2.0 WHEN v = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS k
  FROM documents LEFT JOIN q USING (doc_id)
), s AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM (
    SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
    FROM d GROUP BY source)
), lev AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN lam IS NULL THEN cap ELSE least(cap, w * lam) END::DOUBLE AS target
  FROM (SELECT *, min_by(level, ratio) FILTER (ratio >= level) OVER () AS lam FROM lev)
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t
), r AS (
  SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN rest > 0 AND rest - before > 0 AND size <= 2 * (rest - before) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)
), gone AS (
  SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, p) > 1
), run AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
    SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (
      SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM gone)) GROUP BY doc_id, r
), keep AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY doc_id
), stay AS (
  SELECT doc_id, a, lead(a, 1, n) OVER (PARTITION BY doc_id ORDER BY a, b) AS e, b FROM (SELECT doc_id, a, b, n FROM run JOIN d USING (doc_id) UNION ALL SELECT doc_id, 0, 0, n FROM d)
)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d LEFT JOIN keep USING (doc_id) JOIN (
  SELECT doc_id, string_agg(substr(x, 2 * b + 1, 2 * greatest(e - b, 0)), '' ORDER BY a, b) AS t FROM stay JOIN d USING (doc_id) GROUP BY doc_id) USING (doc_id)
"""

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, sig, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sig) AS i FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sig,
      length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, t.i, sig, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= h
  UNION ALL SELECT conv_id, 1, i, sig, chars FROM c JOIN t USING (conv_id) WHERE i > h
), p AS (
  SELECT conv_id, row_number() OVER w AS d, sha256(string_agg(sig, ',') OVER w) AS k, chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY d, k
), kids AS (
  SELECT p.d, p.k, count(*) AS n_children FROM n JOIN p ON p.conv_id = n.conv_id AND p.d = n.d - 1 GROUP BY p.d, p.k
), sub AS (
  SELECT p.d, p.k, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k GROUP BY p.d, p.k
), e AS (
  SELECT d, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p
  WHERE (conv_id, d) IN (SELECT (conv_id, max(d)) FROM p GROUP BY conv_id) GROUP BY d, k
)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sub USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN e USING (d, k)
LEFT JOIN p ON p.conv_id = n.conv_id AND p.d = n.d - 1 LEFT JOIN n AS up ON up.d = p.d AND up.k = p.k
"""

OP13_SQL = r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), cut AS (
  SELECT c.lang, c.phrase, c.a, n.n, j, x.f AS l, y.f AS r, (1000 * c.a::HUGEINT * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:c.k], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY 1, 2
)
SELECT lang, (row_number() OVER w)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_token_files": op2_token_files,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_media_archives": op5_media_archives,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_toxicity": op7_toxicity,
    "op8_url_rules": op8_url_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op9_line_dedup": OP9_SQL, "op10_mix_sources": OP10_SQL, "op11_suffix_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_collocations": OP13_SQL}
