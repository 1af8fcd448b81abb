"""Registered queries of the ten operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.llm import bpe, conversations, debruijn, html, lines, minhash, packing, quality, shards, suffixes, tokens, topk, whitening
from casetrail.llm.base import table
from casetrail.llm.html_pages import labelled_pages
from casetrail.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS_SQL = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(configure(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op1_suffix_dedup", f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - {suffixes.WINDOW - 1}, 0))) AS p, h FROM t),
k AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, {2 * suffixes.WINDOW})) AS g FROM w),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM k),
s AS (SELECT doc_id, p, p + {suffixes.WINDOW} AS e FROM f WHERE n > 1),
m AS (SELECT *, CASE WHEN p <= max(e) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
r AS (SELECT doc_id, run, min(p) AS a, max(e) AS b FROM g GROUP BY ALL),
c AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM r GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, n + 1), lambda i:
    substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1, 2 * ((CASE WHEN i = n THEN length(h) // 2 ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE b[i] END)))), '') END)) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id)""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_substring_dedup", f"""
WITH t AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - {debruijn.WINDOW - 2})) AS p, ws FROM t),
k AS (SELECT doc_id, p, md5_number(array_to_string(ws[p:p + {debruijn.WINDOW - 1}], ' ')) AS g FROM w),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM k),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + {debruijn.WINDOW})) AS i FROM f WHERE n > 1),
c AS (SELECT doc_id, count(*) AS gone, list(i) AS gone_at FROM x GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone_at, i))), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id)""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    cut = debruijn.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op2_line_dedup", f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ls) - size + 2)) AS p, size, ls FROM t, (SELECT unnest(range(1, {lines.RUN + 1})) AS size)),
k AS (SELECT doc_id, p, size, md5_number(array_to_string(ls[p:p + size - 1], chr(10))) AS g FROM w
  WHERE size = {lines.RUN} OR length(array_to_string(ls[p:p + size - 1], '')) >= {lines.LONG}),
f AS (SELECT doc_id, p, size, row_number() OVER (PARTITION BY size, g ORDER BY doc_id, p) AS n FROM k),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS i FROM f WHERE n > 1),
y AS (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) = i - 1 THEN 0 ELSE 1 END AS new FROM x),
c AS (SELECT doc_id, count(*) AS gone, sum(new) AS runs, list(i) AS gone_at FROM y GROUP BY 1)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_runs,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ls ELSE list_transform(list_sort(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone_at, i))), lambda i: ls[i]) END, chr(10))) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id)""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    cut = lines.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op4_best_fit_packing")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op5_extendible_shards", f"""
WITH t AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
  lpad(bin(('0x' || substr(md5(doc_id::VARCHAR || ':' || md5(coalesce(text, ''))), 1, {shards.CONTENT_BITS // 4}))::BIGINT), {shards.CONTENT_BITS}, '0') AS bits FROM documents),
p AS (SELECT doc_id, n_bytes, d AS depth, substr(bits, 1, d) AS shard FROM t, (SELECT unnest(range(0, 41)) AS d)),
b AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL),
l AS (SELECT doc_id, n_bytes, p.shard, p.depth, shard_bytes, shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY p.depth) AS n
      FROM p JOIN b USING (depth, shard) WHERE shard_bytes <= {shards.LIMIT} OR shard_rows = 1)
SELECT doc_id, n_bytes, shard, depth::INT AS depth, shard_bytes, shard_rows FROM l WHERE n = 1""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(table(spark, folder, "documents"))


@query("op7_exact_top_products", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
q AS (SELECT vec_id AS query_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v WHERE vec_id % 100 = 0),
c AS (SELECT vec_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS y FROM v),
s AS (SELECT query_id, vec_id, sum(x * y)::BIGINT AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_bpe")
def _(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary`` is the path of a tokenizer file, by default the installed public one."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, folder, "documents"), vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op6_minhash_near_dedup", f"""
WITH RECURSIVE t AS (SELECT doc_id, {WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
h AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: md5_number(array_to_string(ws[i:i + 3], ' ')))
      WHEN len(ws) > 0 THEN [md5_number(array_to_string(ws, ' '))] ELSE [] END) AS s FROM t),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM h),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n - c)),
r AS (SELECT doc_id, doc_id AS seen FROM h UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM h JOIN m USING (doc_id)""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=4)


@query("op3_quality_rules")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rules(table(spark, folder, "documents"), copies=False)


@query("op9_html_main_text")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"), html.train(labelled_pages()))


@query("op12_token_counts")
def _(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary`` is the path of a tokenizer file, by default the installed public one."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count(table(spark, folder, "documents"), vocabulary)


@query("op13_embedding_whitening")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


#: The same repair as a forward search over (row, state) that carries the cheapest audit and text of each state.
@query("op11_conversation_repair", """
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce("role", ' ') AS ro, coalesce("text", ' ') AS te,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 4 * length(hex(encode(k)))), lambda i:
      ((('0x' || substr(hex(encode(k)), 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)) & 1))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS roll FROM r),
d AS (SELECT conv_id, turn, CASE WHEN roll = 4 THEN 'user' ELSE ro END AS ro, unnest(range(0, CASE WHEN roll = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE roll WHEN 1 THEN '' WHEN 2 THEN regexp_replace(te, '[.!?]', '', 'g') ELSE te END AS te FROM h WHERE roll <> 0),
n AS (SELECT *, row_number() OVER w AS p, row_number() OVER (PARTITION BY conv_id, ro, te ORDER BY turn NULLS FIRST, copy) AS nth, substr(ro, 1, 1) AS i,
    rtrim(te, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, lag(substr(ro, 1, 1)) OVER w || substr(ro, 1, 1) AS two
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, ro, sha256(length(ro) || ':' || ro || te), copy)),
f AS (SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS dup, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS trunc FROM n),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum(dup::INT)::BIGINT AS duplicate, sum(trunc::INT)::BIGINT AS truncated,
    (count(*) - 1 - count(*) FILTER (WHERE two IN ('su', 'ua', 'au')))::BIGINT AS illegal, count(*) AS n FROM f GROUP BY 1),
m(q, z) AS (VALUES (0, 'user'), (1, 'user'), (2, 'assistant'), (3, 'user')),
b AS (SELECT conv_id, 0::BIGINT AS p, q, cost, a, t FROM c, (VALUES (0, 0::BIGINT, '', ''), (2, 5, 'I', chr(10) || 'user:'), (3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) AS s(q, cost, a, t)
  UNION ALL
  SELECT conv_id, p, q, best.cost, best.a, best.t FROM (SELECT conv_id, p, q, min({'cost': cost, 'a': a, 't': t}) AS best FROM (
    SELECT conv_id, p, unnest([q, CASE WHEN z = 'user' THEN 2 ELSE 3 END, 5 - CASE WHEN z = 'user' THEN 2 ELSE 3 END]) AS q, unnest([cost, cost + 5, cost + 10]) AS cost, unnest([a, a || 'I', a || 'II']) AS a,
        unnest([t, t || chr(10) || z || ':', t || chr(10) || z || ':' || chr(10) || CASE WHEN z = 'user' THEN 'assistant:' ELSE 'user:' END]) AS t
    FROM (SELECT conv_id, p, q, best.cost AS cost, best.a AS a, best.t AS t FROM (SELECT conv_id, p, q, min({'cost': cost, 'a': a, 't': t}) AS best FROM (
      SELECT b.conv_id, f.p, unnest(CASE WHEN f.blank OR f.dup THEN [b.q] ELSE [b.q, CASE WHEN i = 's' AND b.q = 0 THEN 1 WHEN i = substr(m.z, 1, 1) THEN CASE WHEN i = 'u' THEN 2 ELSE 3 END END, CASE WHEN m.z = 'user' THEN 2 ELSE 3 END] END) AS q,
        unnest(CASE WHEN f.blank OR f.dup THEN [cost + 2] ELSE [cost + 2, cost + 5 * trunc::INT, cost + 1 + 5 * trunc::INT] END) AS cost,
        unnest([a || 'D', a || 'K', a || 'R']) AS a, unnest([t, t || chr(10) || ro || ':' || te, t || chr(10) || m.z || ':' || te]) AS t
      FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.p = b.p + 1 JOIN m ON m.q = b.q) WHERE cost IS NOT NULL AND q IS NOT NULL GROUP BY ALL)) JOIN m USING (q)) GROUP BY conv_id, p, q)),
e AS (SELECT conv_id, min({'cost': cost, 'a': a, 't': t}) AS best FROM b JOIN c USING (conv_id) WHERE p = n AND q IN (0, 3) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, folder, "conversations"))
