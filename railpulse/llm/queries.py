"""The registered queries of the numbered operators, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.llm import blob_ledger, byte_bpe, compress_quality, conversation_repair, histogram_packing, license_dice, permutation_index, pii_bootstrap, segment_topk, subword_langid, trie_join, url_templates, whitening
from railpulse.llm.common import held_out, table
from railpulse.session import scratch_path


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    found = url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every vector whose id is divisible by 50."""
    return permutation_index.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the rank file, and digests of them and of the bytes they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.transcode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base patterns, and what patterns learnt from their contexts add."""
    found = pii_bootstrap.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii_bootstrap.KINDS], F.sha2(pii_bootstrap.joined(base), 256).alias("base_sha256"), pii_bootstrap.joined(F.col("spans")).alias("spans"))


def op5_compress_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compress_quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ~held_out())
    return compress_quality.predict(docs, model, threshold=0.7).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = subword_langid.fit(docs, ~held_out())
    return subword_langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty highest integer products for every vector whose id is divisible by 20."""
    return segment_topk.top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op8_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and lines of every document that match a licence template."""
    return license_dice.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8)


def op9_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids cut into pieces and packed into sequences of 1024."""

    def derive(cut_up: DataFrame) -> DataFrame:
        return cut_up.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), seq_len=1024, end_id=0, derive=derive)


def op10_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document: five-word shingles, Jaccard 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return trie_join.near_copies(docs, words=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op11_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector projected on the 32 leading components of all, each with variance 1."""
    rows = table(spark, sf_dir, "embeddings").where(whitening.finite("embedding")).select("vec_id", whitening.scaled("embedding", 64.0, 1_000_000).alias("x"))
    found, model = whitening.whiten(rows, components=32, pad=1_000_000)
    shares = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    return (
        found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
    )


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found once for each distinct text and joined back to all documents that hold it."""
    ledger = blob_ledger.Ledger(spark, scratch_path(spark, f"ledger-{uuid.uuid4().hex}"))
    ledger.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "documents", ["doc_id"])
    base = [r.kind for r in blob_ledger.RULES if r.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return ledger.report("documents").select("doc_id", *[count(k) for k in base], F.sha2(blob_ledger.joined(of_base), 256).alias("base_sha256"), blob_ledger.joined(F.col("spans")).alias("spans"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the faults that their keys' checksums stand for; nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and a digest of the repaired rows."""
    rows = table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(damaged(rows))
    parts = [rows.select("conv_id").distinct(), repaired.conversations.drop("n_rows"), conversation_repair.gaps(repaired.stored), conversation_repair.digests(repaired.rows)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    number = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    return whole.groupBy("conv_id").agg(
        *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_url_templates": op1_url_templates,
    "op2_permutation_index": op2_permutation_index,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pii_bootstrap": op4_pii_bootstrap,
    "op5_compress_quality": op5_compress_quality,
    "op6_subword_langid": op6_subword_langid,
    "op7_segment_topk": op7_segment_topk,
    "op8_license_dice": op8_license_dice,
    "op9_histogram_packing": op9_histogram_packing,
    "op10_trie_join": op10_trie_join,
    "op11_jacobi_davidson": op11_jacobi_davidson,
    "op12_blob_ledger": op12_blob_ledger,
    "op13_repair_grammar": op13_repair_grammar,
}

def _op8_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in license_dice.TEMPLATES.items())
    norm = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    grams = "CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return f"""
WITH t AS (SELECT license, {grams} AS tb FROM (SELECT license, string_split({norm.format('text')}, ' ') AS w FROM (VALUES {values}) AS v(license, text))),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 0 AS line, text AS unit FROM lines
  UNION ALL
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS unit FROM lines WHERE len(l) > 1),
u AS (SELECT doc_id, line, {grams} AS ub FROM (SELECT doc_id, line, string_split({norm.format('unit')}, ' ') AS w FROM units) WHERE w[1] <> ''),
m AS (
  SELECT doc_id, line, license, len(ub) AS n, len(tb) AS b, len(list_intersect(ub, tb)) AS shared
  FROM u JOIN t ON len(ub) BETWEEN ceil(len(tb) * (0.8 / 1.2) - 1e-9) AND floor(len(tb) * (1.2 / 0.8) + 1e-9))
SELECT doc_id, CAST(line AS INTEGER) AS line, license, round(2.0 * shared / (n + b), 6) AS dice, CAST(n AS INTEGER) AS n_bigrams
FROM m WHERE CAST(2 * shared AS DOUBLE) / (n + b) >= 0.8
"""


def _op12_sql() -> str:
    """Places from the lengths of the matches and of what lies between them."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = "\n  UNION ALL\n".join(
        f"""  SELECT doc_id, rid, {k} AS place, {quoted(r.kind)} AS kind, {str(r.base).lower()} AS base, {quoted(r.test)} AS test,
    regexp_extract_all(t, {quoted(r.pattern)}) AS m, string_split_regex(t, {quoted(r.pattern)}) AS g FROM d"""
        for k, r in enumerate(blob_ledger.RULES))
    one = "kind || ':' || s || ':' || e, ',' ORDER BY s, place"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {quoted(r.kind)}) AS n_{r.kind}" for r in blob_ledger.RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
k AS (
{kinds}),
p AS (
  SELECT rid, place, kind, base, test, unnest(m) AS hit, unnest(range(1, len(m) + 1)) AS i, g, m FROM k WHERE len(m) > 0),
s AS (
  SELECT rid, place, kind, base, hit,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(hit) AS len
  FROM p WHERE regexp_full_match(hit, test)),
f AS (SELECT *, s + len AS e FROM s),
a AS (SELECT rid, {counts}, string_agg({one}) FILTER (WHERE base) AS b, string_agg({one}) AS spans FROM f GROUP BY rid)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in blob_ledger.RULES if r.base)},
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


_OP13_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      flatten(list_transform(string_split(k, ''), lambda c: list_concat([CAST(ord(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS fault FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE fault <> 0),
convs AS (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (
  SELECT cid, turn, role, text,
    row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id),
marked AS (SELECT *, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) AS seen FROM numbered),
rows AS (
  SELECT cid, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS unlawful
  FROM marked),
counts AS (
  SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE unlawful) AS illegal FROM rows GROUP BY cid),
nxt(p, put, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, q, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
edit(p, q, put, name, price) AS (
  SELECT p, q, put, 'K', 0 FROM nxt UNION ALL SELECT p, q, NULL, 'R', 3 FROM nxt WHERE put <> 's'
  UNION ALL SELECT p, p, NULL, 'D', 4 FROM (VALUES (0), (1), (2), (3)) AS v(p)),
step(p, q, put, name, price) AS (SELECT ins.p, edit.q, put, repeat('I', k) || name, price + 3 * k FROM ins JOIN edit ON ins.q = edit.p),
way(cid, i, q, best) AS (
  SELECT cid, CAST(0 AS BIGINT), 0, '00000000' FROM counts
  UNION ALL
  SELECT way.cid, way.i + 1, step.q,
    min(printf('%08d', CAST(left(best, 8) AS INTEGER) + price + CASE WHEN fault = 'truncated' AND name NOT LIKE '%D' THEN 3 ELSE 0 END) || substr(best, 9) || name)
  FROM way JOIN rows ON rows.cid = way.cid AND rows.i = way.i + 1
  JOIN step ON step.p = way.q AND (put IS NULL OR put = initial) AND (name LIKE '%D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY way.cid, way.i, step.q),
final AS (
  SELECT cid, min(printf('%08d', CAST(left(best, 8) AS INTEGER) + 3 * k) || substr(best, 9) || repeat('I', k)) AS best
  FROM way JOIN counts USING (cid) JOIN ins ON ins.p = way.q WHERE i = n AND ins.q IN (0, 3) GROUP BY cid),
letters AS (SELECT cid, substr(best, 9) AS audit, unnest(string_split(substr(best, 9), '')) AS e, unnest(range(1, length(best) - 7)) AS j FROM final),
aligned AS (
  SELECT cid, j, e, count(*) FILTER (WHERE e <> 'I') OVER upto AS i, count(*) FILTER (WHERE e <> 'D') OVER upto AS o FROM letters
  WINDOW upto AS (PARTITION BY cid ORDER BY j)),
kept AS (
  SELECT a.cid, j, e, o, r.role, r.text, max(o = 1 AND e = 'K' AND initial = 's') OVER (PARTITION BY a.cid) AS led
  FROM aligned AS a LEFT JOIN rows AS r ON r.cid = a.cid AND r.i = a.i AND e <> 'I' WHERE e <> 'D'),
lines AS (
  SELECT cid, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
  FROM kept GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 8) AS BIGINT), 0) AS cost, coalesce(substr(best, 9), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM convs LEFT JOIN counts USING (cid) LEFT JOIN final USING (cid) LEFT JOIN lines USING (cid)
"""


ORACLE: dict[str, str] = {
    "op12_blob_ledger": _op12_sql(),
    "op13_repair_grammar": _OP13_SQL,
    "op8_license_dice": _op8_sql(),
}
