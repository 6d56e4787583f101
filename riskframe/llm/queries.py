"""One query per operator, over its whole table, and SQL twins where SQL can state the result."""

from __future__ import annotations

import public_tokenizers

from riskframe.llm.common import read_documents
from riskframe.llm.conversations import repair
from riskframe.llm.language import language_table
from riskframe.llm.language_model import score_table
from riskframe.llm.line_dedup import line_table
from riskframe.llm.mixing import mix_table
from riskframe.llm.near_dups import near_duplicates
from riskframe.llm.packing import pack
from riskframe.llm.periodic import run_table
from riskframe.llm.quality import judge
from riskframe.llm.repeats import repeat_table
from riskframe.llm.secret_scan import scan_secrets
from riskframe.llm.token_files import token_table
from riskframe.llm.topk import search_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () AS whole,
         sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source) AS caps,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight DESC, source DESC) - weight AS rest
  FROM s),
lvl AS (
  SELECT min(level) AS level FROM (
    SELECT (1.5 * whole - caps)::DOUBLE / rest AS level, 2.0 * source_size / weight AS own,
           lead(2.0 * source_size / weight) OVER (ORDER BY 2.0 * source_size / weight, source) AS next
    FROM r WHERE rest > 0
    UNION ALL
    SELECT (1.5 * sum(source_size))::DOUBLE / sum(weight), 0, min(2.0 * source_size / weight) FROM s)
  WHERE level >= own AND (next IS NULL OR level < next)),
t AS (
  SELECT source, source_size,
         CASE WHEN weight * level >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM s, lvl),
c AS (SELECT doc_id, source, digest, size, count(*) AS copies FROM d GROUP BY ALL),
b AS (
  SELECT c.doc_id, c.source, c.digest, copies, target, epoch, block,
         least(256, size - block * 256) AS words,
         md5(concat_ws(':', 'mix', c.doc_id, c.digest, epoch, block)) AS key
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source,
       (VALUES (0), (1)) e(epoch), unnest(range((size + 255) // 256)) u(block)
  WHERE size > 0),
k AS (
  SELECT *, words * copies AS load,
         sum(words * copies) OVER (PARTITION BY source ORDER BY epoch, key ROWS UNBOUNDED PRECEDING) AS upto
  FROM b),
taken AS (
  SELECT doc_id, source, digest, sum(words) AS taken, count(*) AS n_blocks
  FROM k WHERE upto - load + load / 2.0 < target GROUP BY ALL)
SELECT d.doc_id, d.size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       coalesce(taken, 0)::BIGINT AS taken, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.source IS NOT DISTINCT FROM x.source AND d.digest = x.digest
"""


@query("op1_mix_sources")
def op1_mix_sources(spark, sf_dir):
    """What the mix takes of every document, and the shards and places it goes to, which SQL cannot draw."""
    return mix_table(read_documents(spark, sf_dir))


@query("mix_sources_amounts", MIX_SQL)
def mix_sources_amounts(spark, sf_dir):
    """The amounts of the same mix."""
    return mix_table(read_documents(spark, sf_dir)).drop("blocks", "shards", "positions")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                             ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT g, count(*) AS f FROM g GROUP BY g HAVING count(*) > 1),
o AS (
  SELECT g.doc_id, g.g, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY f.f NULLS FIRST, g.g) AS pos
  FROM g JOIN n USING (doc_id) LEFT JOIN f USING (g)),
p AS (SELECT doc_id, g, n FROM o WHERE pos <= n - ceil(0.8 * n) + 1),
c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b USING (g)
  WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (
  SELECT a, b FROM c JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b AND x.g = y.g
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id,
       d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS component FROM r GROUP BY doc_id) USING (doc_id)
"""


@query("op2_near_dups", NEAR_SQL)
def op2_near_dups(spark, sf_dir):
    return near_duplicates(read_documents(spark, sf_dir), size=2, percent=80).drop("own")


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    return language_table(read_documents(spark, sf_dir))


TOP_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * v.c[i]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op4_top_k", TOP_SQL)
def op4_top_k(spark, sf_dir):
    return search_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    judged = judge(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "rejected_by")


@query("op6_language_model")
def op6_language_model(spark, sf_dir):
    return score_table(read_documents(spark, sf_dir))


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    return token_table(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return pack(read_documents(spark, sf_dir))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (
  SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE largest IS NOT NULL AND largest <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE largest IS NULL OR largest = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id
"""


@query("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark, sf_dir):
    return line_table(read_documents(spark, sf_dir))


@query("op10_repeated_strings")
def op10_repeated_strings(spark, sf_dir):
    return repeat_table(read_documents(spark, sf_dir))


def crc32_sql(text: str, key: str) -> str:
    """CTEs that end in `crc(key, h)`: unsigned CRC-32 (polynomial 0xEDB88320) of each distinct ASCII text."""
    return f"""
bit AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
crc AS (
  SELECT key, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)),
         lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]))) AS h
  FROM (SELECT DISTINCT {key} AS key, {text} AS s FROM {{table}}), bit)"""


# spans come from cutting the text at marked matches; lengths count code points
SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
p(kind, name, least, pattern) AS (VALUES
  (0, 'assign', 6, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 0, 'AKIA[A-Z0-9]{16,}'), (2, 'hex', 0, '[0-9a-f]{24,}'), (3, 'owned', 0, '[A-Za-z0-9_-]{20,}')),
cut AS (
  SELECT doc_id, source, kind, name, least,
         string_split(regexp_replace(text, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS parts
  FROM d, p),
m AS (
  SELECT doc_id, source, kind, name, least, string_split(part, chr(2))[1] AS match,
         sum(length(part)) OVER w - length(part) - (i - 2) AS start
  FROM (SELECT * EXCLUDE (parts), unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut)
  WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) QUALIFY i > 1),
v AS (
  SELECT doc_id, source, kind, name, start, start + length(match) AS stop,
         CASE WHEN kind = 0 THEN regexp_extract(match, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE match END AS value, least
  FROM m),
live AS (
  SELECT *, len(list_distinct(string_split(value, ''))) >= 10 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AS live
  FROM v WHERE length(value) >= least),
found AS (
  SELECT * FROM live a WHERE kind < 3 OR live AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM live b WHERE b.kind < 3 AND b.doc_id = a.doc_id AND b.start < a.stop AND a.start < b.stop)),
owners AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM found GROUP BY value),
j AS (
  SELECT doc_id, kind, live AND owners = 1 AS mine, owners, start, name || ':' || start || ':' || stop AS span
  FROM found JOIN owners USING (value)),
s AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
         string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR mine) AS spans,
         count(*) FILTER (WHERE kind = 3 AND mine) AS n_owned, count(*) FILTER (WHERE mine) AS n_live,
         count(*) FILTER (WHERE owners >= 3) AS n_copied
  FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN s USING (doc_id)
"""


@query("op11_secret_scan", SECRETS_SQL)
def op11_secret_scan(spark, sf_dir):
    return scan_secrets(read_documents(spark, sf_dir))


# the cheapest edits from each state to the end, with the least audit, row by row from the last
REPAIR_SQL = (
    r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),"""
    + crc32_sql("key", "key").replace("{table}", "src")
    + r""",
hit AS (
  SELECT conv_id, turn, h % 20 AS act, CASE WHEN h % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE h % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src JOIN crc USING (key)),
r AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM hit, unnest(range(CASE WHEN act = 3 THEN 2 ELSE 1 END)) WHERE act <> 0),
o AS (SELECT *, min(i) OVER (PARTITION BY conv_id, role, text) < i AS seen FROM r),
f AS (
  SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
k AS (
  SELECT *, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM f),
n AS (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id),
dp AS (
  SELECT conv_id, n AS i, struct_pack(c := 0, a := '', t := '') AS s0, struct_pack(c := 10, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:') AS s1,
         struct_pack(c := 5, a := 'I', t := chr(10) || 'assistant:') AS s2, struct_pack(c := 0, a := '', t := '') AS s3 FROM n
  UNION ALL
  SELECT conv_id, i - 1,
    least(struct_pack(c := b0.c, a := b0.a, t := b0.t), struct_pack(c := i2.c + 5, a := 'I' || i2.a, t := chr(10) || 'user:' || i2.t)),
    least(struct_pack(c := b1.c, a := b1.a, t := b1.t), struct_pack(c := i2.c + 5, a := 'I' || i2.a, t := chr(10) || 'user:' || i2.t)),
    i2, i3
  FROM (
    SELECT *, least(b2, struct_pack(c := b3.c + 5, a := 'I' || b3.a, t := chr(10) || 'assistant:' || b3.t)) AS i2,
           least(b3, struct_pack(c := b2.c + 5, a := 'I' || b2.a, t := chr(10) || 'user:' || b2.t)) AS i3
    FROM (
      SELECT dp.conv_id, dp.i,
        least(struct_pack(c := s0.c + 2, a := 'D' || s0.a, t := s0.t),
              CASE WHEN stays AND k.c = 's' THEN struct_pack(c := s1.c + extra, a := 'K' || s1.a, t := line || s1.t) END,
              CASE WHEN stays AND k.c = 'u' THEN struct_pack(c := s2.c + extra, a := 'K' || s2.a, t := line || s2.t) END,
              CASE WHEN stays THEN struct_pack(c := s2.c + 1 + extra, a := 'R' || s2.a, t := chr(10) || 'user:' || text || s2.t) END) AS b0,
        least(struct_pack(c := s1.c + 2, a := 'D' || s1.a, t := s1.t),
              CASE WHEN stays AND k.c = 'u' THEN struct_pack(c := s2.c + extra, a := 'K' || s2.a, t := line || s2.t) END,
              CASE WHEN stays THEN struct_pack(c := s2.c + 1 + extra, a := 'R' || s2.a, t := chr(10) || 'user:' || text || s2.t) END) AS b1,
        least(struct_pack(c := s2.c + 2, a := 'D' || s2.a, t := s2.t),
              CASE WHEN stays AND k.c = 'a' THEN struct_pack(c := s3.c + extra, a := 'K' || s3.a, t := line || s3.t) END,
              CASE WHEN stays THEN struct_pack(c := s3.c + 1 + extra, a := 'R' || s3.a, t := chr(10) || 'assistant:' || text || s3.t) END) AS b2,
        least(struct_pack(c := s3.c + 2, a := 'D' || s3.a, t := s3.t),
              CASE WHEN stays AND k.c = 'u' THEN struct_pack(c := s2.c + extra, a := 'K' || s2.a, t := line || s2.t) END,
              CASE WHEN stays THEN struct_pack(c := s2.c + 1 + extra, a := 'R' || s2.a, t := chr(10) || 'user:' || text || s2.t) END) AS b3
      FROM dp JOIN (SELECT *, chr(10) || role || ':' || text AS line FROM k) k ON dp.conv_id IS NOT DISTINCT FROM k.conv_id AND dp.i = k.i))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit,
       sha256(coalesce(substr(s0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN (SELECT * FROM dp WHERE i = 0) e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
)


@query("op12_repair_conversations", REPAIR_SQL)
def op12_repair_conversations(spark, sf_dir):
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# equal words at every distance, as stretches of consecutive positions
RUNS_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),"""
    + crc32_sql("doc_id::VARCHAR", "doc_id").replace("{table}", "documents")
    + r""",
a AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS altered, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS share
  FROM d JOIN crc ON crc.key = doc_id),
x AS (
  SELECT doc_id, n, i, hash(word) AS k, word FROM (
    SELECT doc_id, n, unnest(range(n)) AS i,
           unnest(CASE WHEN altered THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // share) END + 1])
                       ELSE w END) AS word
    FROM a)),
e AS (
  SELECT l.doc_id, l.i, r.i - l.i AS q, l.i - row_number() OVER (PARTITION BY l.doc_id, r.i - l.i ORDER BY l.i) AS stretch
  FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.k = r.k AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
s AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM e GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), struct_pack(l := -length, s := start, p := period)) AS b,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length)
  GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period,
       1000 * b.length // b.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
)


@query("op13_periodic_runs", RUNS_SQL)
def op13_periodic_runs(spark, sf_dir):
    return run_table(read_documents(spark, sf_dir))
