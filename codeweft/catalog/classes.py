"""Extraction over a corpus of classes: a class with a base and one method for every part, in python or typescript.

Headers carry nested defaults, strings and comments that a search for parentheses would trip over; some functions have overload
lines, some imports are commented out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.catalog import tables as d
from codeweft.operators.extract import ParsedFiles

_PYTHON = (
    "import abc, os.path as p  # class Gone(Old): (\n\n\nclass C{k}(base.B{z}, abc.ABC):\n    note = 'def no(('\n\n"
    "    def m{k}(self, a=((((((1,),),),),)), b=')'):\n        # (\n        \"\"\"About {name}\"\"\"\n        return help{z}(a)\n"
)
_SCRIPT = (
    '/* import {{ x }} from "./gone"; */\nimport {{ B }} from "./kit{z}";\nexport function f{k}(a: {{ k: number; }}): string;\n'
    "export function f{k}(a: any): string {{\n  return help{z}(a);\n}}\nexport class C{k} extends B{z} {{\n"
    "  m{k}(a = (1, (2))): void {{\n    f{k}(a);\n  }}\n}}\n"
)


def _filled(template: str):
    """A column with ``{k}``, ``{z}`` and ``{name}`` replaced by the part's key, size and name."""
    columns = {"k": F.col("p_partkey").cast("string"), "z": F.col("p_size").cast("string"), "name": F.col("p_name")}
    marked = template.format(k="\x02k\x02", z="\x02z\x02", name="\x02name\x02").split("\x02")
    return F.concat(*[columns[piece] if i % 2 else F.lit(piece) for i, piece in enumerate(marked)])


def class_modules(spark, sf_dir):
    script = F.col("p_size") % 2 == 0
    path = F.concat(F.lit("p/c"), F.col("p_partkey").cast("string"), F.when(script, ".ts").otherwise(".py"))
    return d.read(spark, sf_dir, "part").select(
        d.repo("p_partkey"),
        path.alias("file_path"),
        F.when(script, "typescript").otherwise("python").alias("language"),
        F.when(script, _filled(_SCRIPT)).otherwise(_filled(_PYTHON)).alias("content"),
    )


def extract_classes(spark, sf_dir):
    found = ParsedFiles(class_modules(spark, sf_dir)).symbols().where("type <> 'module'")
    return found.select("file_path", "type", "name", "qualified_name", "start_line", "end_line", "signature", "docstring")


def class_relations(spark, sf_dir):
    found = ParsedFiles(class_modules(spark, sf_dir)).relations()
    return found.select("src_qname", "dst_hint", "rel_type", F.col("rel_seq.line").alias("line"), F.col("rel_seq.pos").alias("pos"))


_CLASSES = """
mods AS (SELECT 'p.c' || p_partkey AS m, 'p/c' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.ts' ELSE '.py' END AS file_path, p_size % 2 = 0 AS ts,
                p_partkey::VARCHAR AS k, p_size::VARCHAR AS z, p_name FROM part)
"""

QUERIES = {
    "extract_classes": (
        extract_classes,
        d.with_ctes(_CLASSES)
        + """SELECT file_path, 'class' AS type, 'C' || k AS name, m || '.C' || k AS qualified_name, CASE WHEN ts THEN 7 ELSE 4 END AS start_line,
                    CASE WHEN ts THEN 11 ELSE 10 END AS end_line, 'class C' || k AS signature, '' AS docstring FROM mods
             UNION ALL SELECT file_path, 'method', 'm' || k, m || '.C' || k || '.m' || k, CASE WHEN ts THEN 8 ELSE 7 END, 10,
                    CASE WHEN ts THEN 'm' || k || '()' ELSE 'def m' || k || '(self, a=((((((1,),),),),)), b='')'')' END,
                    CASE WHEN ts THEN '' ELSE 'About ' || p_name END FROM mods
             UNION ALL SELECT file_path, 'function', 'f' || k, m || '.f' || k, 4, 6, 'function f' || k || '()', '' FROM mods WHERE ts""",
    ),
    "class_relations": (
        class_relations,
        d.with_ctes(_CLASSES)
        + """SELECT m AS src_qname, 'abc' AS dst_hint, 'IMPORTS' AS rel_type, 1 AS line, 0 AS pos FROM mods WHERE NOT ts
             UNION ALL SELECT m, 'os.path', 'IMPORTS', 1, 1 FROM mods WHERE NOT ts
             UNION ALL SELECT m, 'kit' || z, 'IMPORTS', 2, 0 FROM mods WHERE ts
             UNION ALL SELECT m, m || '.C' || k, 'OWNS', CASE WHEN ts THEN 7 ELSE 4 END, 0 FROM mods
             UNION ALL SELECT m || '.C' || k, m || '.C' || k || '.m' || k, 'OWNS', CASE WHEN ts THEN 8 ELSE 7 END, 0 FROM mods
             UNION ALL SELECT m, m || '.f' || k, 'OWNS', 4, 0 FROM mods WHERE ts
             UNION ALL SELECT m || '.C' || k, CASE WHEN ts THEN 'B' || z ELSE 'base.B' || z END, 'HERITAGE', CASE WHEN ts THEN 7 ELSE 4 END, 1 FROM mods
             UNION ALL SELECT m || '.C' || k, 'abc.ABC', 'HERITAGE', 4, 2 FROM mods WHERE NOT ts
             UNION ALL SELECT m || '.C' || k || '.m' || k, CASE WHEN ts THEN 'f' || k ELSE 'help' || z END, 'CALLS', CASE WHEN ts THEN 9 ELSE 10 END, 0 FROM mods
             UNION ALL SELECT m || '.f' || k, 'help' || z, 'CALLS', 5, 0 FROM mods WHERE ts""",
    ),
}
