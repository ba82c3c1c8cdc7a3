"""The engine's input tables derived from the driver tables, and the same derivations as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import text as t
from codeweft.operators.chunking import number_rows
from codeweft.operators.fusion import embed

REPO = "corpus"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repo(key: str) -> Column:
    """The one repo all rows belong to, as a value of the row rather than a constant the optimizer would drop from joins."""
    return F.when(F.col(key).isNotNull(), REPO).alias("repo_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(repo("doc_id"), F.col("doc_id").alias("id"), "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), repo("item_id"), F.col("text").alias("query")
    )


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(documents(spark, sf_dir))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(repo("vec_id"), F.col("vec_id").alias("id"), "embedding")


def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module symbol per document."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select(
        repo("doc_id"),
        F.col("doc_id").alias("id"),
        F.lit("module").alias("type"),
        name.alias("name"),
        F.concat_ws(".", "source", name).alias("qualified_name"),
        F.concat(F.col("source"), F.lit("/"), name, F.lit(".py")).alias("file_path"),
        F.lit(1).cast("long").alias("start_line"),
        F.size(F.split("text", "\n")).cast("long").alias("end_line"),
        F.lit("").alias("signature"),
        F.lit("").alias("docstring"),
        F.col("text").alias("code_snippet"),
    )


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document calls the next one of its source and imports the next one of its language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")

    def chain(group: str, kind: str) -> DataFrame:
        # Ordinals instead of a window over the group: the largest group is spread over many tasks.
        placed = number_rows(docs.select(F.col(group).alias("of"), "doc_id"), ["doc_id"], group="of").select("of", "doc_id", "ordinal")
        after = placed.select("of", F.col("doc_id").alias("dst_id"), (F.col("ordinal") - 1).alias("ordinal"))
        return placed.join(after, ["of", "ordinal"]).select(repo("doc_id"), F.col("doc_id").alias("src_id"), "dst_id", F.lit(kind).alias("type"))

    return chain("source", "CALLS").unionByName(chain("lang", "IMPORTS"))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function symbol per part; brand and type are its directories, so short names are highly ambiguous."""
    brand = F.lower(F.translate("p_brand", "#", ""))
    name = F.translate("p_name", " ", "_")
    start = (F.col("p_partkey") + 1).cast("long")
    columns = read(spark, sf_dir, "part").select(
        "p_partkey",
        repo("p_partkey"),
        F.lit("function").alias("type"),
        name.alias("name"),
        F.concat_ws(".", brand, F.lower("p_type"), name).alias("qualified_name"),
        F.concat(brand, F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("file_path"),
        start.alias("start_line"),
        (start + F.col("p_size")).cast("long").alias("end_line"),
        F.concat(F.lit("def "), name, F.lit("(size)")).alias("signature"),
        F.concat_ws(" of ", "p_name", "p_brand").alias("docstring"),
        F.concat(F.lit("def "), name, F.lit("(size):\n    return "), F.col("p_size").cast("string")).alias("code_snippet"),
    )
    return columns.select(
        "p_partkey",
        "repo_id",
        t.symbol_id(F.col("type"), F.col("qualified_name"), F.col("file_path"), F.col("start_line")).alias("id"),
        *[c for c in columns.columns if c not in ("p_partkey", "repo_id")],
    )


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part-to-part links: each order line's part to the next line's part."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "N", "IMPORTS").otherwise("OWNS")
    return (
        read(spark, sf_dir, "lineitem")
        .select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), kind.alias("type"))
        .where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .distinct()
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph keyed by part number (as text), which keeps traversal rows narrow."""
    return part_links(spark, sf_dir).select(
        repo("src"),
        F.col("src").cast("string").alias("src_id"),
        F.col("dst").cast("string").alias("dst_id"),
        "type",
    )


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part symbols keyed like ``part_edges``."""
    return part_symbols(spark, sf_dir).withColumn("id", F.col("p_partkey").cast("string")).drop("p_partkey")


def part_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved relations of the part graph: hints are full names, quoted paths, short names or unknown names."""
    symbols = part_symbols(spark, sf_dir)
    src = symbols.select(F.col("p_partkey").alias("src"), F.col("qualified_name").alias("src_qname"), F.col("file_path").alias("src_file"))
    dst = symbols.select(F.col("p_partkey").alias("dst"), F.col("qualified_name").alias("q"), F.col("name").alias("n"))
    shape = (7 * F.col("src") + 13 * F.col("dst")) % 5
    hint = (
        F.when(shape == 0, F.col("q"))
        .when(shape == 1, F.concat(F.lit('"./'), F.translate("q", ".", "/"), F.lit('"')))
        .when(shape == 2, F.col("n"))
        .when(shape == 3, F.concat(F.lit("helper."), F.col("n")))
        .otherwise(F.concat(F.lit("missing_"), F.col("n")))
    )
    return (
        part_links(spark, sf_dir)
        .join(src, "src")
        .join(dst, "dst")
        .select(repo("src"), "src_qname", hint.alias("dst_hint"), F.col("type").alias("rel_type"), "src_file")
    )


# --- the same tables as SQL ------------------------------------------------------------------------------------------

SYMBOLS_CTE = """
parts AS (
  SELECT p_partkey, 'corpus' AS repo_id, 'function' AS type, replace(p_name, ' ', '_') AS name,
         lower(replace(p_brand, '#', '')) || '.' || lower(p_type) || '.' || replace(p_name, ' ', '_') AS qualified_name,
         lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.py' AS file_path,
         p_partkey + 1 AS start_line, p_partkey + 1 + p_size AS end_line,
         'def ' || replace(p_name, ' ', '_') || '(size)' AS signature,
         p_name || ' of ' || p_brand AS docstring,
         'def ' || replace(p_name, ' ', '_') || '(size):' || chr(10) || '    return ' || p_size AS code_snippet
  FROM part),
symbols AS (
  SELECT *, sha1(type || '|' || qualified_name || '|' || file_path || '|' || start_line) AS id FROM parts)
"""

LINKS_CTE = """
links AS (
  SELECT DISTINCT src, dst, type FROM (
    SELECT l_partkey AS src,
           lead(l_partkey) OVER (PARTITION BY l_orderkey
                                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
           CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'IMPORTS' ELSE 'OWNS' END AS type
    FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst),
edges AS (SELECT CAST(src AS VARCHAR) AS src_id, CAST(dst AS VARCHAR) AS dst_id, type FROM links)
"""

RELATIONS_CTE = """
relations AS (
  SELECT s.qualified_name AS src_qname, s.file_path AS src_file, l.type AS rel_type,
         CASE (7 * l.src + 13 * l.dst) % 5
           WHEN 0 THEN d.qualified_name
           WHEN 1 THEN '"./' || replace(d.qualified_name, '.', '/') || '"'
           WHEN 2 THEN d.name
           WHEN 3 THEN 'helper.' || d.name
           ELSE 'missing_' || d.name END AS dst_hint
  FROM links l JOIN symbols s ON s.p_partkey = l.src JOIN symbols d ON d.p_partkey = l.dst)
"""

BM25_CTE = """
toks AS (
  SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[A-Za-z_][\\p{L}\\p{N}_]+|\\p{Nd}+')) AS term
  FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
len AS (SELECT id, sum(tf) AS n_tokens FROM tf GROUP BY id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n_docs,
                  (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents)::DOUBLE AS avg_len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw_idf FROM df, corpus),
idf AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25::DOUBLE * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (
        SELECT query_id, unnest(regexp_extract_all(lower(query), '[A-Za-z_][\\p{L}\\p{N}_]+|\\p{Nd}+')) AS term FROM asked)
      GROUP BY query_id, term),
bm25 AS (
  SELECT query_id, id,
         sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / avg_len))) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (id), corpus
  GROUP BY query_id, id HAVING score > 0),
keyword AS (
  SELECT * FROM (SELECT query_id, id, score,
                        row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm25)
  WHERE rank <= 8)
"""

HASH_SEARCH_CTE = """
dimension AS (SELECT unnest(range(128)) AS i),
raw_doc AS (SELECT doc_id AS id, i, ('0x' || substr(sha1(text || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1 AS x
            FROM documents, dimension),
doc_vec AS (SELECT id, list(x / norm ORDER BY i) AS v
            FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) AS norm FROM raw_doc) GROUP BY id),
raw_ask AS (SELECT query_id, i, ('0x' || substr(sha1(query || '|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1 AS x
            FROM asked, dimension),
ask_vec AS (SELECT query_id, list(x / norm ORDER BY i) AS v
            FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS norm FROM raw_ask) GROUP BY query_id),
semantic AS (
  SELECT * FROM (
    SELECT query_id, id, 1 - power(list_distance(a.v, d.v), 2) / sqrt(2.0::DOUBLE) AS score,
           row_number() OVER (PARTITION BY query_id
                              ORDER BY round(1 - power(list_distance(a.v, d.v), 2) / sqrt(2.0::DOUBLE), 9) DESC, id) AS rank
    FROM ask_vec a, doc_vec d)
  WHERE rank <= 8)
"""

FUSED_CTE = """
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, semantic_rank NULLS LAST, keyword_rank) AS rank
    FROM (
      SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.id, k.id) AS id, s.rank AS semantic_rank, k.rank AS keyword_rank,
             coalesce(s.score, 0) AS semantic_score, coalesce(k.score, 0) AS keyword_score,
             coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS score
      FROM semantic s FULL OUTER JOIN keyword k ON s.query_id = k.query_id AND s.id = k.id))
  WHERE rank <= 8)
"""

ASKED_CTE = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
DOC_SYMBOLS_CTE = """
doc_symbols AS (
  SELECT doc_id AS id, 'doc' || doc_id AS name, source || '.doc' || doc_id AS qualified_name,
         source || '/doc' || doc_id || '.py' AS file_path, 1 AS start_line,
         len(string_split(text, chr(10))) AS end_line, text AS code_snippet
  FROM documents)
"""


def with_ctes(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c.strip() for c in ctes) + "\n"
