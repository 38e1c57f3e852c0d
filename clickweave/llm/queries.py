"""The registered queries of this package, one for each operator, and the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, scratch_path, table
from .embed_dedup import link_embeddings
from .host_rules import judge
from .jaccard import JaccardParams, link_documents
from .langid import predict_langid, train_langid
from .mixing import MixParams, replicate
from .packing import pack_documents
from .prefix_free import remove_repeats
from .quality import score_quality, train_quality
from .runs import find_runs, repeat_words
from .secrets import labelled_samples, scan, train_markov
from .toxicity import score_toxicity, train_toxicity
from .variants import VariantParams, count_words, group_variants, word_runs
from .warc import originals, page_records, read_archives, resolve, write_archives


def _labels(spark: SparkSession, sf_dir: str, label: str, folds: int, held_out: int) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.filter(crc_mod("doc_id", folds) != held_out).select("doc_id", F.col(label).alias("y"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, _labels(spark, sf_dir, "quality", 3, 1))
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_langid(docs.filter(crc_mod("doc_id", 4) != 2))
    return predict_langid(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train_markov(labelled_samples(docs)))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), JaccardParams(words=3, num=90, den=100))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives stay in the shared scratch folder; the result is read back from them."""
    path = scratch_path(spark, "archives")
    write_archives(resolve(page_records(table(spark, sf_dir, "pages"))), path)
    return originals(Scratch(spark).save(read_archives(spark, path, payloads=False), "headers"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def source_weights(docs: DataFrame) -> DataFrame:
    """Explicit, unequal target weights: 1 to 4 by the hash of a source's name."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    weight = F.conv(F.substring(F.md5(source.cast("binary")), 1, 4), 16, 10).cast("long") % 4 + 1
    return docs.select(source.alias("source"), weight.cast("double").alias("weight")).distinct()


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, with all sources drawn towards explicit weights, at twice the input's total; its text is told by a digest after the shuffle."""
    docs = table(spark, sf_dir, "documents")
    mixture = replicate(docs, MixParams(epochs=2.0), source_weights(docs))
    return mixture.select("doc_id", "source", "copy", "order_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source."""
    return judge(table(spark, sf_dir, "documents"), F.col("source")).drop("host_rate", "host_rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, _labels(spark, sf_dir, "toxic", 5, 0))
    return score_toxicity(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by hash, have their words repeated first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return find_runs(docs.withColumn("text", F.when(h % 10 == 0, repeat_words(F.col("text"), F.floor(h / 10))).otherwise(F.col("text"))))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in 31 of the words of a document, by hash, lacks a letter."""
    params = VariantParams()
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(word_runs(F.col("text"), params.min_length)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    misspelt = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return group_variants(count_words(runs.select(F.when(h % 31 == 0, misspelt).otherwise(F.col("run")).alias("word")), params), params)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_secrets": op3_secrets,
    "op4_jaccard": op4_jaccard,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_embeddings": op8_embeddings,
    "op9_host_rules": op9_host_rules,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_variants": op12_variants,
    "op13_repeats": op13_repeats,
}


def _crc32(hex_text: str) -> str:
    """SQL of the unsigned crc32 of bytes given as a text of hexadecimal digits."""
    byte = f"('0x' || substr({hex_text}, 2 * i + 1, 2))::BIGINT"
    bits = f"flatten(list_transform(range(0, length({hex_text}) // 2), lambda i: list_transform(range(0, 8), lambda k: ({byte} >> k) & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)))"


_REACH = """
both_ways AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(node, low) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT both_ways.b, reach.low FROM reach JOIN both_ways ON both_ways.a = reach.node),
lows AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
degrees AS (SELECT a AS node, count(*) AS n FROM both_ways GROUP BY a)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS k FROM shingles p JOIN shingles q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 90 * (s.n + t.n - k)),
{_REACH}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(g.n, 0) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN lows ON lows.node = d.doc_id LEFT JOIN degrees g ON g.node = d.doc_id""",
    "op5_warc": """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sums AS (SELECT page_id, strlen(body) AS payload_bytes, list_transform(range(0, 8), lambda k: ('0x' || substr(sha1(body), 1 + 5 * k, 5))::BIGINT) AS fives FROM bodies),
digests AS (SELECT page_id, payload_bytes, array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> s) & 31), 1)), '')), '') AS payload_digest FROM sums),
firsts AS (SELECT payload_digest, min(page_id) AS original FROM digests GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM digests JOIN firsts USING (payload_digest)""",
    "op7_mixing": """
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT *, (('0x' || substr(md5(s), 1, 4))::BIGINT % 4 + 1)::DOUBLE AS weight FROM n),
sums AS (SELECT sum(n) AS rows, sum(weight) AS total FROM w),
rates AS (SELECT s, rows * 2.0::DOUBLE * weight / total / n AS rate FROM w, sums),
terms AS (SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates)),
cdfs AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
units AS (SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counts AS (SELECT doc_id, any_value(source) AS source, any_value(md5(coalesce(text, ''))) AS text_md5, count(*) AS n FROM units JOIN cdfs ON s = coalesce(source, '') AND c <= u GROUP BY doc_id)
SELECT doc_id, source, text_md5, copy::INTEGER AS copy, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS order_key
FROM (SELECT doc_id, source, text_md5, unnest(range(1, n + 1)) AS copy FROM counts)""",
    "op8_embeddings": f"""
WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS x, q.vec_id AS y FROM vectors p JOIN vectors q ON p.label = q.label AND len(p.v) = len(q.v) AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= 0.98),
{_REACH}
SELECT e.vec_id, coalesce(g.n, 0) AS n_links, coalesce(low, e.vec_id) AS component_id, coalesce(low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN lows ON lows.node = e.vec_id LEFT JOIN degrees g ON g.node = e.vec_id""",
    "op9_host_rules": r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM words),
windows AS (SELECT r, i, ws[i:i + 4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) t(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
stats AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats),
hosts AS (SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM base GROUP BY host),
moments AS (SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS k, sum(f * f / n) AS ff FROM hosts),
spread AS (SELECT m, (ff - n * m * m - m * (1 - m) * (k - 1)) / n AS v FROM moments),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS strength FROM spread)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bound > 3 * m AND bound > 0.2) AS kept
FROM base JOIN (SELECT host, m, rate - 2.33::DOUBLE * sqrt(rate * (1 - rate) / (n + strength + 1)) AS bound FROM (SELECT *, (f + m * strength) / (n + strength) AS rate FROM hosts, prior)) USING (host)""",
    "op11_runs": rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_crc32("hex(encode(coalesce(doc_id::VARCHAR, '')))")} AS h FROM documents),
planted AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM base),
words AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS ws FROM planted),
grams AS (SELECT r, i, ws[i + 1:i + 8] AS g FROM (SELECT r, ws, unnest(range(0, len(ws) - 7)) AS i FROM words WHERE len(ws) >= 24)),
twice AS (SELECT r, i, g FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
lags AS (SELECT x.r, x.i, y.i - x.i AS q FROM twice x JOIN twice y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
islands AS (SELECT r, q, min(i) AS s, max(i) + 8 - min(i) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM lags) GROUP BY r, q, k HAVING max(i) + 8 - min(i) + q >= greatest(24, 3 * q)),
found AS (SELECT * FROM islands x WHERE NOT EXISTS (FROM islands y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
per_row AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM found GROUP BY r),
best AS (SELECT r, s, len, q FROM found x WHERE NOT EXISTS (FROM found y WHERE y.r = x.r AND (y.len * x.q > x.len * y.q OR (y.len * x.q = x.len * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q)))))),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM found),
gone AS (SELECT r, list(i) AS gone FROM dropped GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: ws[i + 1]) END, ' ')) AS collapsed_sha256
FROM words LEFT JOIN per_row USING (r) LEFT JOIN best USING (r) LEFT JOIN gone USING (r)""",
    "op12_variants": rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {_crc32("hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run))")} AS h FROM counted),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
holed AS (SELECT word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole FROM places),
pairs AS (SELECT s.word AS a, s.n AS an, v.word AS b, v.n AS bn FROM shorter s JOIN vocabulary v ON v.word = s.less
  UNION ALL SELECT v.word, v.n, s.word, s.n FROM shorter s JOIN vocabulary v ON v.word = s.less
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM holed x JOIN holed y ON x.hole = y.hole AND x.i = y.i AND x.word <> y.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY bn DESC, encode(b)) AS place, count(*) OVER (PARTITION BY a) AS n_near FROM pairs),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n FROM vocabulary LEFT JOIN ranked ON a = word AND place = 1),
chain(word, reached) AS (SELECT word, word FROM forms UNION ALL SELECT chain.word, f.form FROM chain JOIN forms f ON f.word = chain.reached WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, reached AS root FROM chain JOIN forms f ON f.word = reached WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
    "op13_repeats": """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, hex(encode(coalesce(text, ''))) AS hx FROM documents),
windows AS (SELECT r, d, i, substr(hx, 2 * i + 1, 100) AS s FROM (SELECT r, d, hx, unnest(range(0, length(hx) // 2 - 49)) AS i FROM texts)),
firsts AS (SELECT r, d, i, min(d) OVER (PARTITION BY s) AS f FROM windows),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM firsts WHERE f < d),
numbered AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM hit),
spans AS (SELECT r, k, min(i) AS s, max(i) + 50 AS e FROM numbered GROUP BY r, k),
edges AS (SELECT r, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM spans GROUP BY r)
SELECT doc_id, length(hx) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN ss IS NULL THEN hx ELSE array_to_string(list_transform(range(0, len(ss) + 1),
    lambda j: substr(hx, 1 + 2 * CASE WHEN j = 0 THEN 0 ELSE es[j] END, 2 * (CASE WHEN j = len(ss) THEN length(hx) // 2 ELSE ss[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE es[j] END))), '') END)) AS kept_sha256
FROM texts LEFT JOIN edges USING (r)""",
}
