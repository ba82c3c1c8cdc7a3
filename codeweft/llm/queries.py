"""The registered queries of the operators, with the SQL that states the same results where SQL can."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import bag_search, bit_sliced, decontaminate, html_text, jaccard_join, lattice_lm, license_scan, merkle, nearest, packing, substring_dedup, toxicity, url_rules
from codeweft.llm.words import training


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeated_windows(_table(spark, folder, "documents"))
    return substring_dedup.with_digest(kept).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later
), gone AS (
  SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id
), stays AS (
  SELECT doc_id, len(w) AS n,
    CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS k
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n AS n_words, n - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM stays
"""

def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    linked = jaccard_join.link_components(_table(spark, folder, "documents"))
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", jaccard_join.component_id().alias("component_id"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS s FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS s, a AS t FROM edges UNION SELECT s, b FROM reach JOIN edges ON t = a
), roots AS (
  SELECT s, min(t) AS root FROM reach GROUP BY s
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON s = doc_id
"""

def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(_table(spark, folder, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    scored = lattice_lm.score_texts(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), group_col="lang")
    return scored.withColumnRenamed("id", "doc_id")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", "coverage", "matched", "inserted", "words", "start", "stop")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (~training(F.col("doc_id"), 5)).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_spans",
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    leaks = decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), **decontaminate.WIDE)
    return leaks.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "stop", "edits")


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), lambda a, b: a + b) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""

#: host, path and verdict of the rules that op4 applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge(_table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP4_SQL = r"""
WITH rules(rh, rp, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), fits AS (
  SELECT page_id, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(verdict, len(rh || rp)) AS verdict
  FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
"""


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_bit_sliced(spark: SparkSession, folder: str) -> DataFrame:
    return bit_sliced.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""

def op12_bag_search(spark: SparkSession, folder: str) -> DataFrame:
    return bag_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), sizes AS (
  SELECT count(*) FILTER (len(t) > 0) AS nd, sum(len(t))::BIGINT AS nt FROM words
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM words) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sizes GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term), sizes GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

#: What op13 hashes of a document.
MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    values = [F.col(c) for c in MANIFEST_COLUMNS]
    # A copy in which line ends were lost, for every second document; other rows claim what they are.
    damaged = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    claimed = F.when(damaged, merkle.digest([*values[:-1], F.translate("text", "\n", "")]))
    manifest = merkle.build(docs, merkle.digest(values), F.col("source"), F.col("doc_id"), claimed, carry=("doc_id",))
    proof = F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256)
    return merkle.prove(manifest).select("row.doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def _hashed(text: str) -> str:
    parts = [text if c == "text" else f"{c}::VARCHAR" for c in MANIFEST_COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_hashed("text")} AS leaf, row_number() OVER () AS nth,
    -- CRC-32 of the decimal id, bit by bit
    CASE WHEN xor(list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 2 = 0
      THEN {_hashed("replace(text, chr(10), '')")} END AS damaged
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes(tree, lvl, pos, h, n) AS (
  SELECT source, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3
), subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(lvl, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, pos // 3
), steps AS (
  SELECT p.nth, 0 AS part, x.lvl, x.pos - p.pos // (3 ** x.lvl)::BIGINT AS side, x.h
  FROM placed p JOIN nodes x ON x.tree IS NOT DISTINCT FROM p.source AND x.n > 1 AND x.pos // 3 = p.pos // (3 ** (x.lvl + 1))::BIGINT
  UNION ALL
  SELECT p.nth, 1, x.lvl, x.pos - s.pos // (3 ** x.lvl)::BIGINT, x.h
  FROM placed p JOIN subroots s ON s.tree IS NOT DISTINCT FROM p.source JOIN tops x ON x.n > 1 AND x.pos // 3 = s.pos // (3 ** (x.lvl + 1))::BIGINT
), levels AS (
  SELECT nth, part, lvl, coalesce(string_agg(h, '' ORDER BY side) FILTER (side < 0), '') AS l, coalesce(string_agg(h, '' ORDER BY side) FILTER (side > 0), '') AS r
  FROM steps GROUP BY nth, part, lvl
), proofs AS (
  SELECT nth, string_agg(l || r, '' ORDER BY part, lvl) AS siblings, list(l || '|' || r ORDER BY part, lvl) AS path FROM levels GROUP BY nth
), folds AS (
  SELECT p.*, coalesce(siblings, '') AS siblings, subroot,
    list_reduce(list_prepend(coalesce(damaged, leaf), coalesce(path, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM placed p LEFT JOIN proofs USING (nth) JOIN subroots s ON s.tree IS NOT DISTINCT FROM p.source
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folds, (SELECT h AS root FROM tops WHERE n = 1)
"""


QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_substring_dedup": (op1_substring_dedup, OP1_SQL),
    "op2_decontamination": (op2_decontamination, None),
    "op3_nearest": (op3_nearest, OP3_SQL),
    "op4_url_rules": (op4_url_rules, OP4_SQL),
    "op5_packing": (op5_packing, None),
    "op10_jaccard_join": (op10_jaccard_join, OP10_SQL),
    "op6_html_text": (op6_html_text, None),
    "op7_lattice_lm": (op7_lattice_lm, None),
    "op8_license_scan": (op8_license_scan, None),
    "op9_toxicity": (op9_toxicity, None),
    "op11_bit_sliced": (op11_bit_sliced, OP11_SQL),
    "op12_bag_search": (op12_bag_search, OP12_SQL),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
