"""Relation resolution, symbol lookups and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.catalog import tables as d
from codeweft.operators import lookup, resolve, sessions


def representative_symbol(spark, sf_dir):
    return lookup.by_qualified_name(d.part_symbols(spark, sf_dir)).select("qualified_name", "id")


def first_by_name(spark, sf_dir):
    return lookup.by_short_name(d.part_symbols(spark, sf_dir)).select("name", "id")


def find_by_name(spark, sf_dir):
    """All symbols named like each distinct last segment of the relation hints."""
    hints = d.part_relations(spark, sf_dir).select("repo_id", resolve.last_segment(resolve.clean_hint(F.col("dst_hint"))).alias("name"))
    return d.part_symbols(spark, sf_dir).join(hints.distinct(), ["repo_id", "name"]).select("name", "id", "qualified_name")


def clean_hint(spark, sf_dir):
    relations = d.part_relations(spark, sf_dir).select("src_qname", "dst_hint", "rel_type").distinct()
    return relations.withColumn("cleaned", resolve.clean_hint(F.col("dst_hint")))


def _by_rule(rule):
    def run(spark, sf_dir):
        found = resolve.resolve(d.part_relations(spark, sf_dir), d.part_symbols(spark, sf_dir), (rule,))
        return found.where(F.col("dst_id").isNotNull()).select("src_qname", "dst_hint", "rel_type", "dst_id")

    return run


def resolve_relations(spark, sf_dir):
    found = resolve.resolve(d.part_relations(spark, sf_dir), d.part_symbols(spark, sf_dir))
    return found.select("src_qname", "dst_hint", "rel_type", "src_id", "dst_id", "rule")


def resolve_edges(spark, sf_dir):
    return resolve.resolve_edges(d.part_relations(spark, sf_dir), d.part_symbols(spark, sf_dir)).select("src_id", "dst_id", "type")


def _event_log(spark, sf_dir):
    return d.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("symbol"), "event_id"
    )


def recent_symbols(bound):
    def run(spark, sf_dir):
        return sessions.recent_symbols(_event_log(spark, sf_dir), bound).select("session_id", "event_id", "symbol", "age")

    return run


def session_boosts(bound):
    def run(spark, sf_dir):
        boosts = sessions.session_boosts(sessions.recent_symbols(_event_log(spark, sf_dir), bound))
        return boosts.select("session_id", "symbol", F.round("boost", 6).alias("boost"))

    return run


def session_history(bound):
    def run(spark, sf_dir):
        messages = d.read(spark, sf_dir, "conversations").select(
            F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
        )
        return sessions.session_history(messages, bound)

    return run


_R0 = "arg_min(id, (start_line, end_line, file_path, id))"
_KEYS = f"""
rel AS (
  SELECT *, string_split(cleaned, '.')[-1] AS short, string_split(src_qname, '.')[1] AS frag,
         regexp_replace(src_file, '/[^/]*$', '') AS dir,
         trim(CASE WHEN contains(src_qname, '.') THEN regexp_replace(src_qname, '[.][^.]*$', '') ELSE src_qname END || '.' || cleaned, '.') AS sibling
  FROM (SELECT DISTINCT *, trim(replace(replace(trim(trim(dst_hint), '"''`'), '/', '.'), '..', '.'), '.') AS cleaned FROM relations)),
by_q AS (SELECT qualified_name AS q, {_R0} AS sid FROM symbols GROUP BY 1),
by_file AS (SELECT name, file_path, {_R0} AS sid FROM symbols GROUP BY 1, 2),
by_dir AS (SELECT name, regexp_replace(file_path, '/[^/]*$', '') AS dir, {_R0} AS sid FROM symbols GROUP BY 1, 2),
by_frag AS (SELECT f.short, f.frag, {_R0} AS sid
            FROM (SELECT DISTINCT short, frag FROM rel) f JOIN symbols s ON s.name = f.short AND starts_with(s.qualified_name, f.frag) GROUP BY 1, 2),
by_name AS (SELECT name, {_R0} AS sid FROM symbols GROUP BY 1),
res AS (
  SELECT r.src_qname, r.dst_hint, r.rel_type, s0.sid AS s0, s1.sid AS s1, s2.sid AS s2, s3.sid AS s3, s4.sid AS s4, s5.sid AS s5, s6.sid AS s6
  FROM rel r
  LEFT JOIN by_q s0 ON s0.q = r.src_qname LEFT JOIN by_q s1 ON s1.q = r.cleaned LEFT JOIN by_q s2 ON s2.q = r.sibling
  LEFT JOIN by_file s3 ON s3.name = r.short AND s3.file_path = r.src_file
  LEFT JOIN by_dir s4 ON s4.name = r.short AND s4.dir = r.dir
  LEFT JOIN by_frag s5 ON s5.short = r.short AND s5.frag = r.frag
  LEFT JOIN by_name s6 ON s6.name = r.short)
"""
_RESOLVE = d.with_ctes(d.SYMBOLS_CTE, d.LINKS_CTE, d.RELATIONS_CTE, _KEYS)
_ALL = "SELECT src_qname, dst_hint, rel_type, s0 AS src_id, coalesce(s1, s2, s3, s4, s5, s6) AS dst_id, "
_LOG = "SELECT user_id AS session_id, event_id, event_type AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events"


def _boost_sql(bound: int) -> str:
    return f"""SELECT session_id, symbol, round(n / max(n) OVER (PARTITION BY session_id)::DOUBLE, 6) AS boost
               FROM (SELECT session_id, symbol, count(*) AS n FROM ({_LOG}) WHERE age <= {bound} GROUP BY ALL)"""


def _history_sql(bound: int) -> str:
    return f"""SELECT session_id, seq, role, content, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS position
               FROM (SELECT conv_id AS session_id, turn AS seq, role, text AS content,
                            row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= {bound}"""


QUERIES = {
    "representative_symbol": (
        representative_symbol,
        d.with_ctes(d.SYMBOLS_CTE) + f"SELECT qualified_name, {_R0} AS id FROM symbols GROUP BY qualified_name",
    ),
    "first_by_name": (
        first_by_name,
        d.with_ctes(d.SYMBOLS_CTE) + "SELECT name, arg_min(id, (file_path, start_line, id)) AS id FROM symbols GROUP BY name",
    ),
    "find_by_name": (
        find_by_name,
        _RESOLVE + "SELECT name, id, qualified_name FROM symbols WHERE name IN (SELECT short FROM rel)",
    ),
    "clean_hint": (
        clean_hint,
        _RESOLVE + "SELECT DISTINCT src_qname, dst_hint, rel_type, cleaned FROM rel",
    ),
    **{
        name: (_by_rule(rule), _RESOLVE + f"SELECT src_qname, dst_hint, rel_type, s{rule} AS dst_id FROM res WHERE s{rule} IS NOT NULL")
        for name, rule in {
            "resolve_exact": resolve.EXACT,
            "resolve_sibling": resolve.SIBLING,
            "resolve_same_file": resolve.SAME_FILE,
            "resolve_same_dir": resolve.SAME_DIR,
            "resolve_fragment": resolve.FRAGMENT,
            "resolve_by_name": resolve.ANY_NAME,
        }.items()
    },
    "resolve_relations": (
        resolve_relations,
        _RESOLVE
        + _ALL
        + """CASE WHEN s1 IS NOT NULL THEN 1 WHEN s2 IS NOT NULL THEN 2 WHEN s3 IS NOT NULL THEN 3 WHEN s4 IS NOT NULL THEN 4
             WHEN s5 IS NOT NULL THEN 5 WHEN s6 IS NOT NULL THEN 6 END AS rule FROM res""",
    ),
    "resolve_edges": (
        resolve_edges,
        _RESOLVE
        + f"SELECT DISTINCT src_id, dst_id, rel_type AS type FROM ({_ALL} 0 AS z FROM res) WHERE src_id <> dst_id",
    ),
    "recent_symbols": (recent_symbols(100), f"SELECT * FROM ({_LOG}) WHERE age <= 100"),
    "recent_symbols_30": (recent_symbols(30), f"SELECT * FROM ({_LOG}) WHERE age <= 30"),
    "session_boosts": (session_boosts(100), _boost_sql(100)),
    "session_boosts_30": (session_boosts(30), _boost_sql(30)),
    "session_history": (session_history(30), _history_sql(30)),
    "session_history_3": (session_history(3), _history_sql(3)),
}
