"""One query per operator, over whole tables with production parameters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.decontaminate import contaminated, find_matches
from tidemark.llm.frames import LlmTables
from tidemark.llm.near_duplicates import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality_rules
from tidemark.llm.quotes import link_quotations
from tidemark.llm.registry import query
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.secrets import BASE, RULES, find_secrets, named
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.token_counts import token_counts
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import toxicity
from tidemark.llm.urls import judge_urls
from tidemark.llm.whitening import whiten


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_NORMAL = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
OP1_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, contains(text, '>') AS quoting FROM conversations),
ln AS (SELECT conv_id, turn, i, x[i] AS line FROM (SELECT conv_id, turn, x, unnest(range(1, len(x) + 1)) AS i
  FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM m WHERE quoting))),
lv AS (SELECT conv_id, turn, i, line, len(string_split(marks, '>')) - 1 AS level,
  regexp_replace(substr(line, length(marks) + 1), '^ ', '') AS body
  FROM (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks FROM ln)),
nx AS (SELECT *, coalesce(lead(level) OVER w, 0) AS below, coalesce(lag(level) OVER w, -1) <> level AS new FROM lv
  WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
rn AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM nx),
q AS (SELECT conv_id, turn, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS passage
  FROM rn WHERE level > 0 GROUP BY conv_id, turn, run HAVING trim(string_agg(body, chr(10) ORDER BY i)) <> ''),
own AS (SELECT conv_id, turn, trim(string_agg(body, chr(10) ORDER BY i), concat(' ', chr(9), chr(10))) AS body FROM rn
  WHERE level = 0 AND NOT (below > 0 AND regexp_matches(body, '^(On|Am|Le|El) .*(wrote|schrieb|a écrit|escribió) ?:[ \t]*$')) GROUP BY 1, 2),
b AS (SELECT m.*, CASE WHEN quoting THEN coalesce(own.body, '') ELSE text END AS body FROM m LEFT JOIN own USING (conv_id, turn)),
u AS (SELECT DISTINCT conv_id, turn, NORMAL_x AS x FROM (SELECT conv_id, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n\s*\n'), string_split(body, chr(10)))) AS x FROM b WHERE body IS NOT NULL)),
l AS (SELECT q.conv_id, q.turn, q.run, q.level, max(u.turn) AS origin FROM q LEFT JOIN u ON u.conv_id = q.conv_id AND u.turn < q.turn AND u.x = NORMAL_q AND u.x <> '' GROUP BY 1, 2, 3, 4),
p AS (SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked,
  first(origin ORDER BY level, origin DESC) FILTER (origin IS NOT NULL) AS parent FROM l GROUP BY 1, 2),
chain(conv_id, turn, root) AS (SELECT conv_id, turn, parent FROM p WHERE parent IS NOT NULL
  UNION ALL SELECT c.conv_id, c.turn, p.parent FROM chain c JOIN p ON p.conv_id = c.conv_id AND p.turn = c.root WHERE p.parent IS NOT NULL),
t AS (SELECT conv_id, turn, min(root) AS root FROM chain GROUP BY 1, 2)
SELECT b.conv_id, b.turn, b.role, b.body AS text, coalesce(p.n_quotes, 0) AS n_quotes, coalesce(p.n_linked, 0) AS n_linked,
  coalesce(p.parent, -1) AS reply_to, coalesce(t.root, b.turn) AS thread_turn,
  row_number() OVER (PARTITION BY b.conv_id ORDER BY coalesce(t.root, b.turn), b.turn, b.role, b.body) - 1 AS position
FROM b LEFT JOIN p USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)""".replace("NORMAL_x", _NORMAL.format("x")).replace("NORMAL_q", _NORMAL.format("q.passage"))


@query("op1_quotation_linking", OP1_SQL)
def op1(spark, sf_dir):
    """reply_to is -1 for messages that quote nothing that was said."""
    found = link_quotations(LlmTables(spark, sf_dir, "conversations"))
    return found.withColumn("reply_to", F.coalesce("reply_to", F.lit(-1).cast("long")))


@query("op2_token_counts")
def op2(spark, sf_dir):
    return token_counts(LlmTables(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048)


OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
         JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) AS component_id,
       coalesce(low.m, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id"""


@query("op3_minhash_near_dedup", OP3_SQL)
def op3(spark, sf_dir):
    return near_duplicates(LlmTables(spark, sf_dir, "documents"))


def _spans_sql() -> str:
    """Every kind's matches with their places, from the gaps between them."""
    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("(?i)", "").replace("'", "''")
        flags = "i" if r.pattern.startswith("(?i)") else "c"
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, m, g, before, row_number() OVER () AS _ FROM (
  SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}', 0, '{flags}')) AS m,
         unnest(regexp_extract_all(t, '{pattern}', {r.group}, '{flags}')) AS g,
         unnest(list_transform(range(1, len(regexp_extract_all(t, '{pattern}', 0, '{flags}')) + 1),
           lambda i: list_sum(list_transform(regexp_split_to_array(t, '{'(?i)' if flags == 'i' else ''}{pattern}')[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0, '{flags}')[1:i - 1], lambda x: length(x))), 0))) AS before
  FROM d) WHERE length(g) >= {max(r.least, 1)}""")
    return " UNION ALL ".join(parts)


def _op4_sql() -> str:
    base = ", ".join(f"'{k}'" for k in BASE)
    listed = "string_agg(kind || ':' || CAST(before AS BIGINT) || ':' || CAST(before + length(m) AS BIGINT), ',' ORDER BY before, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql()}),
g AS (SELECT doc_id, {counts}, {listed} FILTER (kind IN ({base})) AS base, {listed} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


@query("op4_secret_scan", _op4_sql())
def op4(spark, sf_dir):
    found = find_secrets(LlmTables(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, BASE),
        F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    return pack_documents(LlmTables(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


#: Fixed values.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


@query("op6_url_filter")
def op6(spark, sf_dir):
    return judge_urls(LlmTables(spark, sf_dir, "pages"), URL_RULES)


OP7_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
c AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM c)),
m AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM m),
span AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY r, k),
gap AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS z FROM span
        UNION ALL SELECT r, max(z), NULL FROM span GROUP BY r),
kept AS (SELECT gap.r, string_agg(hex(b[gap.a:coalesce(z, octet_length(b) + 1) - 1]), '' ORDER BY gap.a) AS x FROM gap JOIN d USING (r) GROUP BY gap.r),
cut AS (SELECT r, sum(z - a) AS removed, count(*) AS spans FROM span GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       CASE WHEN x IS NULL THEN sha256(b) ELSE sha256(unhex(x)) END AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)"""


@query("op7_suffix_array_dedup", OP7_SQL)
def op7(spark, sf_dir):
    return remove_repeats(LlmTables(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8(spark, sf_dir):
    return quality_rules(LlmTables(spark, sf_dir, "documents"), LlmTables(spark, sf_dir, "labels"))


@query("op9_toxicity_chain")
def op9(spark, sf_dir):
    """Chain: bad quality, toxic, both. Toxic is the verdict; quality tells it junk from abuse."""
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    found = toxicity(LlmTables(spark, sf_dir, "documents"), LlmTables(spark, sf_dir, "labels"),
                     {"low_quality": bad, "toxic": toxic, "toxic_junk": bad & toxic})
    return found.select("doc_id", *[F.round(c, 9).alias(c) if c.startswith("p_") else F.col(c) for c in found.columns[1:]])


OP10_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
ks AS (SELECT DISTINCT k FROM bs),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks)),
hits AS (SELECT DISTINCT dg.doc_id, win.item_id, dg.i, dg.k FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.l, '')) AS items_sha256,
       coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op10_decontamination", OP10_SQL)
def op10(spark, sf_dir):
    found = find_matches(LlmTables(spark, sf_dir, "documents"), LlmTables(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@query("op11_spectrum_whitening")
def op11(spark, sf_dir):
    return whiten(LlmTables(spark, sf_dir, "embeddings"), 32)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, q.z, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id, z ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op12_exact_top_k", OP12_SQL)
def op12(spark, sf_dir):
    return top_k(LlmTables(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling_variants(LlmTables(spark, sf_dir, "documents"))
