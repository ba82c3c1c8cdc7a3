"""Text, source and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.catalog import tables as d
from codeweft.functions import text as t
from codeweft.operators import chunking
from codeweft.sources import repos

INCLUDE, EXCLUDE = ["*/en/*", "*/fr/*", "*.example.[cn]*"], ["m.*", "*/???#*"]


def tokenize_terms(spark, sf_dir):
    tokens = F.posexplode(t.search_tokens(F.col("text"))).alias("position", "term")
    return d.documents(spark, sf_dir).select("id", tokens)


def split_identifiers(spark, sf_dir):
    pieces = F.array_join(t.identifier_pieces(F.concat_ws(".", "p_type", F.initcap("p_name"), "p_brand")), " ")
    return d.read(spark, sf_dir, "part").select("p_partkey", pieces.alias("pieces"))


def symbol_document_text(spark, sf_dir):
    document = t.symbol_document(F.col("qualified_name"), F.col("signature"), F.col("docstring"))
    return d.part_symbols(spark, sf_dir).select("id", document.alias("document"))


def index_text(spark, sf_dir):
    docs = _document_files(spark, sf_dir)
    chunks = chunking.first_chunks(chunking.token_windows(docs, 200, 20))
    symbols = d.document_symbols(spark, sf_dir)
    document = t.symbol_document(F.col("qualified_name"), F.col("signature"), F.col("docstring"))
    joined = symbols.join(chunks, ["repo_id", "file_path"], "left")
    return joined.select("id", t.index_text(document, F.col("texts")).alias("document"))


def symbol_ids(spark, sf_dir):
    return d.part_symbols(spark, sf_dir).select("p_partkey", "id")


def _page_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"\?.*$", "")
    return d.read(spark, sf_dir, "pages").select("page_id", path.alias("file_path"))


def repo_ids(spark, sf_dir):
    return d.read(spark, sf_dir, "pages").select("page_id", t.repo_id(F.col("url")).alias("repo_id"))


def slice_text(spark, sf_dir):
    return d.documents(spark, sf_dir).select("id", F.posexplode(t.pieces(F.col("text"))).alias("position", "piece"))


def parent_dir(spark, sf_dir):
    return _page_paths(spark, sf_dir).select("page_id", t.parent_dir(F.col("file_path")).alias("dir"))


def symbol_hint(spark, sf_dir):
    return d.read(spark, sf_dir, "conversations").select("conv_id", "turn", t.symbol_hint(F.col("text")).alias("hint"))


def path_endpoints(spark, sf_dir):
    texts = d.read(spark, sf_dir, "conversations").select("conv_id", "turn", t.path_endpoints(F.col("text")).alias("ends"))
    return texts.select("conv_id", "turn", "ends.from_symbol", "ends.to_symbol")


def glob_filter(spark, sf_dir):
    return repos.glob_filter(_page_paths(spark, sf_dir), INCLUDE, EXCLUDE)


def _code_paths(spark, sf_dir):
    """Page paths with the extensions of source files, by page number."""
    names = ["py", "PY", "js", "jsx", "mjs", "cjs", "ts", "tsx", "txt", "py.bak", "d.ts"]
    suffix = F.get(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % len(names)).cast("int"))
    return _page_paths(spark, sf_dir).withColumn("file_path", F.concat_ws(".", "file_path", suffix))


def language_filter(spark, sf_dir):
    return repos.language_filter(_code_paths(spark, sf_dir), ["python", "typescript"])


def language_label(spark, sf_dir):
    return _code_paths(spark, sf_dir).select("page_id", t.language_label(F.col("file_path")).alias("language"))


def _registry(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)/", 1)
    seen = d.read(spark, sf_dir, "pages").select(F.concat(F.lit("/repos/"), host).alias("repo_path"), F.col("page_id").alias("seq"))
    return repos.register_repos(None, seen)


def register_repo(spark, sf_dir):
    return _registry(spark, sf_dir)


def known_repos(spark, sf_dir):
    asked = d.read(spark, sf_dir, "pages").select(
        "page_id", t.repo_id(F.concat(F.lit("/repos/"), F.regexp_extract("url", r"^https://([^/#?]+)", 1))).alias("repo_id")
    )
    registry = _registry(spark, sf_dir)
    known = repos.known_requests(asked, registry).withColumn("known", F.lit(True))
    return known.unionByName(repos.unknown_requests(asked, registry).withColumn("known", F.lit(False)))


def _document_files(spark, sf_dir):
    path = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".py"))
    return d.read(spark, sf_dir, "documents").select(d.repo("doc_id"), path.alias("file_path"), "text")


def chunk_token_windows(spark, sf_dir):
    return chunking.token_windows(_document_files(spark, sf_dir)).select("file_path", "position", "text")


def chunk_numbering(spark, sf_dir):
    chunks = chunking.number_chunks(chunking.token_windows(_document_files(spark, sf_dir)))
    return chunks.select("file_path", "position", "chunk_idx", "chunk_id")


def first_chunks_per_file(spark, sf_dir):
    chunks = chunking.token_windows(_document_files(spark, sf_dir), 200, 20)
    return chunking.first_chunks(chunks).select("file_path", F.array_join("texts", "\n").alias("text"))


def chunks_grouped(spark, sf_dir):
    chunks = chunking.token_windows(_document_files(spark, sf_dir), 200, 20)
    return chunking.chunks_by_file(chunks).select("file_path", F.size("texts").alias("n"), F.sha1(F.array_join("texts", "|")).alias("digest"))


def sentence_chunks(spark, sf_dir):
    return chunking.sentence_chunks(_document_files(spark, sf_dir)).select("file_path", "position", "text")


_WINDOWS = """
files AS (SELECT source || '/doc' || doc_id || '.py' AS file_path, regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+') AS tokens FROM documents),
windows AS (
  SELECT file_path, i AS position, array_to_string(tokens[i * {step} + 1 : i * {step} + {size}], ' ') AS text
  FROM (SELECT file_path, tokens, unnest(range(1 + greatest(len(tokens) - {over} - 1, 0) // {step})) AS i FROM files WHERE len(tokens) > 0))
"""
# A chunk is units [start, stop): it stops at the first unit that no longer fits, and the next one re-reads at most 80 words.
_SENTENCES = r"""
sentences AS (
  SELECT source || '/doc' || doc_id || '.py' AS file_path,
         regexp_extract_all(text, '[^.!?。！？\n]*[.!?。！？\n]+[ \t\n\x0B\f\r]*|[^.!?。！？\n]+') AS s FROM documents),
units AS (
  SELECT file_path, flatten(list_transform(s, lambda x: CASE WHEN len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+')) > 700
           THEN regexp_extract_all(x, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*') ELSE [x] END)) AS u FROM sentences),
sized AS (SELECT *, len(u) AS n, list_transform(u, lambda x: len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+'))) AS z FROM units WHERE len(u) > 0),
summed AS (SELECT *, list_transform(range(n + 1), lambda i: coalesce(list_sum(z[1:i]), 0)::BIGINT) AS p FROM sized),
pack AS (
  SELECT file_path, 0 AS k, 0::BIGINT AS start,
         list_filter(range(1, n), lambda j: p[j + 1] > 0 AND p[j + 2] > 700)[1] AS stop FROM summed
  UNION ALL
  SELECT file_path, k + 1, start, list_filter(range(stop + 1, n), lambda j: p[j + 1] - p[start + 1] > 0 AND p[j + 2] - p[start + 1] > 700)[1]
  FROM (SELECT a.file_path, k, n, p, stop,
               list_filter(range(start + 1, stop + 1), lambda j: p[stop + 1] - p[j + 1] <= least(80, 700 - z[stop + 1]) OR j = stop)[1] AS start
        FROM pack a JOIN summed b ON a.file_path = b.file_path WHERE stop IS NOT NULL)),
chunks AS (
  SELECT file_path, k, trim(array_to_string(u[start + 1 : coalesce(stop, n)], ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
  FROM pack JOIN summed USING (file_path))
SELECT file_path, (row_number() OVER (PARTITION BY file_path ORDER BY k) - 1)::INTEGER AS position, text FROM chunks WHERE text <> ''
"""
_PATHS = r"""paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\?.*$', '') AS file_path FROM pages)"""
_CODE = (
    _PATHS
    + r""",
code AS (SELECT page_id, file_path || '.' || (['py','PY','js','jsx','mjs','cjs','ts','tsx','txt','py.bak','d.ts'])[page_id % 11 + 1] AS file_path
         FROM paths),
labelled AS (SELECT page_id, file_path,
  CASE WHEN lower(file_path) LIKE '%.py' THEN 'python' WHEN regexp_matches(lower(file_path), '\.(ts|tsx)$') THEN 'typescript'
       WHEN regexp_matches(lower(file_path), '\.(js|jsx|mjs|cjs)$') THEN 'javascript' ELSE 'unknown' END AS language FROM code)"""
)
_REGISTRY = r"""
registry AS (
  SELECT 'repo_' || substr(sha1(repo_path), 1, 16) AS repo_id, repo_path, max(seq) AS seq
  FROM (SELECT '/repos/' || regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS p, page_id AS seq FROM pages),
       LATERAL (SELECT CASE WHEN p = '/repos/' THEN '/repos' ELSE p END AS repo_path)
  GROUP BY ALL)"""
_SPLIT = r"regexp_extract_all(translate({}, '._', '  '), '[A-Za-z][a-z]*|\p{{Nd}}+')"
_DOCUMENT = (
    "qualified_name || chr(10) || signature || chr(10) || docstring || chr(10) || "
    + "array_to_string(list_transform(" + _SPLIT.format("qualified_name") + ", lambda x: lower(x)), ' ')"
)

QUERIES = {
    "tokenize_terms": (
        tokenize_terms,
        r"""SELECT doc_id AS id, unnest(range(len(terms))) AS position, unnest(terms) AS term
            FROM (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z_][\p{L}\p{N}_]+|\p{Nd}+') AS terms FROM documents)""",
    ),
    "split_identifiers": (
        split_identifiers,
        "SELECT p_partkey, array_to_string(list_transform("
        + _SPLIT.format(
            "p_type || '.' || array_to_string(list_transform(string_split(p_name, ' '), "
            "lambda w: upper(w[1]) || lower(w[2:])), ' ') || '.' || p_brand"
        )
        + ", lambda x: lower(x)), ' ') AS pieces FROM part",
    ),
    "symbol_document_text": (
        symbol_document_text,
        d.with_ctes(d.SYMBOLS_CTE) + f"SELECT id, {_DOCUMENT} AS document FROM symbols",
    ),
    "index_text": (
        index_text,
        d.with_ctes(d.DOC_SYMBOLS_CTE, _WINDOWS.format(size=200, over=20, step=180))
        + r"""SELECT s.id, trim(qualified_name || chr(10) || array_to_string(list_transform("""
        + _SPLIT.format("qualified_name")
        + r""", lambda x: lower(x)), ' ') || coalesce(chr(10) || c.text, ''), chr(10) || chr(9) || chr(13) || ' ') AS document
              FROM doc_symbols s LEFT JOIN (SELECT file_path, string_agg(text, chr(10) ORDER BY position) AS text
                                            FROM windows WHERE position < 2 GROUP BY file_path) c USING (file_path)""",
    ),
    "symbol_id": (symbol_ids, d.with_ctes(d.SYMBOLS_CTE) + "SELECT p_partkey, id FROM symbols"),
    "repo_id": (repo_ids, "SELECT page_id, 'repo_' || substr(sha1(url), 1, 16) AS repo_id FROM pages"),
    "slice_text": (
        slice_text,
        """SELECT doc_id AS id, i AS position, substr(text, i * 8 + 1, 8) AS piece
           FROM (SELECT doc_id, text, unnest(range((length(text) + 7) // 8)) AS i FROM documents)""",
    ),
    "parent_dir": (
        parent_dir,
        f"WITH {_PATHS} SELECT page_id, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir FROM paths",
    ),
    "symbol_hint": (
        symbol_hint,
        r"""SELECT conv_id, turn, CASE WHEN w <> '' THEN w ELSE t END AS hint
            FROM (SELECT conv_id, turn, trim(text, chr(10) || chr(9) || chr(13) || ' ') AS t, regexp_extract(text, '[A-Za-z_][\p{L}\p{N}_.]*') AS w
                  FROM conversations)""",
    ),
    "path_endpoints": (
        path_endpoints,
        r"""WITH m AS (
              SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z_][\p{L}\p{N}_.]*') AS w,
                     regexp_extract(text, '(?i)from\s+([A-Za-z_][\p{L}\p{N}_.]*)\s+to\s+([A-Za-z_][\p{L}\p{N}_.]*)', ['a', 'b']) AS en,
                     regexp_extract(text, '从\s*([A-Za-z_][\p{L}\p{N}_.]*)\s*到\s*([A-Za-z_][\p{L}\p{N}_.]*)', ['a', 'b']) AS zh
              FROM conversations)
            SELECT conv_id, turn,
                   CASE WHEN en.a <> '' THEN en.a WHEN zh.a <> '' THEN zh.a WHEN len(w) >= 1 THEN w[1] ELSE '' END AS from_symbol,
                   CASE WHEN en.a <> '' THEN en.b WHEN zh.a <> '' THEN zh.b WHEN len(w) >= 2 THEN w[2] WHEN len(w) = 1 THEN w[1] ELSE '' END
                     AS to_symbol
            FROM m""",
    ),
    "glob_filter": (
        glob_filter,
        f"""WITH {_PATHS} SELECT page_id, file_path FROM paths
            WHERE (file_path GLOB '*/en/*' OR file_path GLOB '*/fr/*' OR file_path GLOB '*.example.[cn]*')
              AND NOT (file_path GLOB 'm.*' OR file_path GLOB '*/???#*')""",
    ),
    "language_filter": (
        language_filter,
        f"""WITH {_CODE} SELECT page_id, file_path, language FROM labelled
            WHERE language IN ('python', 'typescript') AND NOT regexp_matches(file_path, '(^|/)[.][^./]*$')""",
    ),
    "language_label": (language_label, f"WITH {_CODE} SELECT page_id, language FROM labelled"),
    "register_repo": (register_repo, f"WITH {_REGISTRY} SELECT repo_id, repo_path, seq FROM registry"),
    "known_repos": (
        known_repos,
        f"""WITH {_REGISTRY},
            asked AS (SELECT page_id, 'repo_' || substr(sha1('/repos/' || regexp_extract(url, '^https://([^/#?]+)', 1)), 1, 16) AS repo_id FROM pages)
            SELECT page_id, repo_id, repo_id IN (SELECT repo_id FROM registry) AS known FROM asked""",
    ),
    "chunk_token_windows": (
        chunk_token_windows,
        d.with_ctes(_WINDOWS.format(size=700, over=80, step=620)) + "SELECT file_path, position, text FROM windows",
    ),
    "chunk_numbering": (
        chunk_numbering,
        d.with_ctes(_WINDOWS.format(size=700, over=80, step=620))
        + """SELECT file_path, position, row_number() OVER (ORDER BY file_path, position) - 1 AS chunk_idx,
                    'corpus-chunk-' || (row_number() OVER (ORDER BY file_path, position) - 1) AS chunk_id FROM windows""",
    ),
    "first_chunks_per_file": (
        first_chunks_per_file,
        d.with_ctes(_WINDOWS.format(size=200, over=20, step=180))
        + "SELECT file_path, string_agg(text, chr(10) ORDER BY position) AS text FROM windows WHERE position < 2 GROUP BY file_path",
    ),
    "chunks_grouped": (
        chunks_grouped,
        d.with_ctes(_WINDOWS.format(size=200, over=20, step=180))
        + "SELECT file_path, count(*) AS n, sha1(string_agg(text, '|' ORDER BY position)) AS digest FROM windows GROUP BY file_path",
    ),
    "sentence_chunks": (sentence_chunks, "WITH RECURSIVE " + _SENTENCES),
}
