"""The registered queries: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, exact_search, jaccard, lines, mixing, neighbours, packing, prefix_trie, private, quality, substring, urls

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def surrogate_key(spark: SparkSession) -> str:
    """The secret that surrogates are drawn with: spark.pitloom.surrogateKey of the session, else a key of the query's own, for tables of no secrets."""
    return spark.conf.get("spark.pitloom.surrogateKey", "public test tables")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), rules)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_windows_removed(_table(spark, sf_dir, "documents"))


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_private_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private.with_surrogates(_table(spark, sf_dir, "documents"), surrogate_key(spark))
    return out.select("doc_id", *(f"n_{k}" for k in private.KINDS), "text")


#: What the calls that conversations are read as may hold.
SCHEMAS = {"respond": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "chars": {"type": "integer"}}, "required": ["prompt", "chars"], "additionalProperties": False}}


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(chat.turns_as_calls(_table(spark, sf_dir, "conversations")), SCHEMAS)


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_repeated_runs(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"), F.size("_runs").alias("n_runs"), F.coalesce(F.array_max("_runs"), F.lit(0)).alias("longest_run"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(_table(spark, sf_dir, "conversations")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.largest_products(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_url_filter, op3_quality_rules, op4_substring_dedup, op5_sequence_packing, op6_private_surrogates, op7_tool_calls, op8_nearest_vectors, op9_line_dedup, op10_jaccard_join, op11_prefix_trie, op12_source_divergence, op13_exact_search)}

_URL_SQL = """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(h, x, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, h || x AS rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || x) DESC NULLS LAST) = 1"""

_WORD = r"'[^\x20\x09-\x0D]+'"

#: Whole and part repetitions in the order of md5; the level of a water filling is the largest that any number of held sources gives.
_MIX_SQL = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(sum(source_size) OVER () - sum(3 * source_size) OVER p + 3 * source_size AS DOUBLE) / CAST(sum(w) OVER () - sum(w) OVER p + w AS DOUBLE) AS level FROM s WINDOW p AS (ORDER BY 3.0 * source_size / w, source ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(w * (SELECT max(level) FROM o), CAST(3 * source_size AS DOUBLE)) AS target FROM o),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, size, source_size, target, whole, CAST(round(target) AS BIGINT) - whole * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM r"""

_WINDOW_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, unnest([md5(array_to_string(ws[j:j + 34], ' ')) for j in range(1, len(ws) - 33)]) AS h FROM d WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM k, range(0, 35) AS t(j) WHERE n > 1),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

#: Runs of 1, 2, 4, ... lines that an earlier place holds; overlapping ones join.
_LINE_SQL = r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, min(doc_id) OVER (PARTITION BY text) AS doc FROM documents),
l AS (SELECT doc_id, doc, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d WHERE text IS NOT NULL),
n AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS real, sum(CAST(regexp_matches(line, '[^\x20\x09-\x0D]') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l),
a AS (SELECT doc_id, list(line ORDER BY seq) AS ls FROM n WHERE real AND doc_id = doc GROUP BY doc_id),
p AS (SELECT doc_id, ls, h, unnest(range(1, len(ls) - h + 2)) AS seq FROM a, (SELECT CAST(pow(2, i) AS BIGINT) AS h FROM range(0, 20) AS t(i)) WHERE len(ls) >= h),
o AS (SELECT doc_id, seq, h, row_number() OVER (PARTITION BY h, md5(array_to_string(ls[seq:seq + h - 1], chr(10))) ORDER BY doc_id, seq) AS k FROM p),
c AS (SELECT doc_id, seq, max(h) AS run FROM o WHERE k > 1 GROUP BY doc_id, seq),
m AS (SELECT *, max(seq + run) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM c),
g AS (SELECT *, sum(CASE WHEN past IS NULL OR seq >= past THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS g FROM m),
r AS (SELECT doc_id, count(*) AS n_runs, max(len) AS longest FROM (SELECT doc_id, max(seq + run) - min(seq) AS len FROM g GROUP BY doc_id, g) GROUP BY doc_id),
f AS (SELECT n.doc_id, n.doc, real, line, pos, real AND (n.doc_id <> n.doc OR c.seq IS NOT NULL) AS gone FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.seq = c.seq AND real),
t AS (SELECT doc_id, any_value(doc) AS doc, count(*) FILTER (real) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t.text, '')) END AS kept_sha256,
CAST(CASE WHEN t.doc <> d.doc_id THEN least(n_lines, 1) ELSE coalesce(n_runs, 0) END AS INTEGER) AS n_runs, CAST(CASE WHEN t.doc <> d.doc_id THEN n_lines ELSE coalesce(longest, 0) END AS INTEGER) AS longest_run
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN r ON d.doc_id = r.doc_id"""

_LINK_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.id AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS id FROM r GROUP BY x) c ON d.doc_id = c.x"""

#: crc32 is worked out bit by bit; a prefix is named by the md5s of its turns.
_TRIE_SQL = """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
  lambda acc, x: list_reduce(list_prepend(xor(acc, x), CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 6 AS h FROM t GROUP BY conv_id),
w AS (SELECT c.*, least(h, coalesce((SELECT b.n FROM c b WHERE b.conv_id = c.base), 0)) AS taken FROM c),
r AS (SELECT w.conv_id, place, role, text FROM w JOIN t ON t.conv_id = w.base AND place <= taken UNION ALL SELECT w.conv_id, place - h + taken, role, text FROM w JOIN t ON t.conv_id = w.conv_id AND place > h),
l AS (SELECT c.conv_id, count(place) AS n, list(md5(role) || md5(text) ORDER BY place) AS k, list(length(text) ORDER BY place) AS chars FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id),
d AS (SELECT *, unnest(range(0, n + 1)) AS depth FROM l),
p AS (SELECT conv_id, n, depth, array_to_string(k[1:depth], ',') AS name, array_to_string(k[1:depth - 1], ',') AS up, chars[depth] AS chars FROM d),
v AS (SELECT depth, name, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY depth, name),
kids AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
below AS (SELECT p.depth, p.name, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(CASE WHEN v.depth > 0 THEN (n_convs - 1) * v.chars ELSE 0 END) AS saved_tokens FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth LEFT JOIN kids ON kids.up = v.name AND kids.depth = v.depth GROUP BY ALL)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256 FROM v JOIN below USING (depth, name) LEFT JOIN kids ON kids.up = v.name AND kids.depth = v.depth LEFT JOIN v o ON v.depth > 0 AND o.depth = v.depth - 1 AND o.name = v.up"""

_DIVERGENCE_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
x AS (SELECT lang, source, k, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total FROM d GROUP BY lang, source),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 * CAST(coalesce(n, 0) + 5 AS HUGEINT) // CAST(total + 5 * v AS HUGEINT) AS BIGINT) AS p FROM g JOIN kept ON g.lang = kept.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + CAST(1000000000 * CAST(sum(n) + 5 AS HUGEINT) // CAST((SELECT sum(n) FROM c WHERE c.lang = p.lang) + 5 * (SELECT v FROM v WHERE v.lang = p.lang) AS HUGEINT) AS BIGINT) AS q FROM p GROUP BY lang, term),
two AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
top AS (SELECT p.lang, source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM top))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""

_PRODUCT_SQL = """WITH e AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

ORACLE = {"op1_source_mixing": _MIX_SQL, "op2_url_filter": _URL_SQL, "op4_substring_dedup": _WINDOW_SQL, "op9_line_dedup": _LINE_SQL, "op10_jaccard_join": _LINK_SQL, "op11_prefix_trie": _TRIE_SQL, "op12_source_divergence": _DIVERGENCE_SQL, "op13_exact_search": _PRODUCT_SQL}
