"""Entity, dependency and clustering tables derived from the given tables by SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_entities": """
SELECT 'F:' || p_brand AS entity_id, CAST(NULL AS STRING) AS parent_id, p_brand || '.java' AS name, 'File' AS kind, CAST(0 AS BIGINT) AS start_byte
FROM part GROUP BY p_brand
UNION ALL
SELECT 'C:' || p_brand || '/' || p_type, 'F:' || p_brand, p_type, 'Class', MIN(p_partkey) FROM part GROUP BY p_brand, p_type
UNION ALL
SELECT 'M:' || CAST(p_partkey AS STRING), 'C:' || p_brand || '/' || p_type,
  CASE p_partkey % 3
    WHEN 0 THEN split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
    WHEN 1 THEN replace(p_name, ' ', '_') ELSE p_name END,
  'Method', p_partkey
FROM part""",
    "fx_flat_entities": """
SELECT entity_id, parent_id, name, kind, start_byte FROM fx_entities WHERE kind = 'File'
UNION ALL
SELECT m.entity_id, c.parent_id, m.name, m.kind, m.start_byte
FROM fx_entities m JOIN fx_entities c ON c.entity_id = m.parent_id WHERE m.kind = 'Method'""",
    "fx_deps": """
SELECT src_id, tgt_id, kind, commit_id FROM (
  SELECT 'M:' || CAST(l_partkey AS STRING) AS src_id,
    'M:' || CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus, l_quantity, l_extendedprice) AS STRING) AS tgt_id,
    l_returnflag AS kind, CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'c1' END AS commit_id
  FROM lineitem) x
WHERE tgt_id IS NOT NULL""",
    "fx_dag_edges": """
SELECT DISTINCT coalesce(d.commit_id, 'WORKDIR') AS commit_key, s.parent_id, s.start_byte AS a, t.start_byte AS b
FROM fx_deps d JOIN fx_flat_entities s ON s.entity_id = d.src_id JOIN fx_flat_entities t ON t.entity_id = d.tgt_id
WHERE s.parent_id = t.parent_id AND s.start_byte < t.start_byte""",
    "fx_path_names": """
SELECT 'geo' AS clustering_id, 'c' || CAST(c_custkey AS STRING) AS entity,
  CASE c_custkey % 3 WHEN 0 THEN 'world$' || r_name WHEN 1 THEN 'world$' || r_name || '$' || n_name ELSE 'world$' || r_name || '$' || n_name || '$' || c_mktsegment END AS path_name
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION
SELECT 'geo', 'c' || CAST(c_custkey AS STRING), 'world$' || r_name
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey % 5 = 0
UNION
SELECT 'seg', 's' || CAST(s_suppkey AS STRING), r_name || '$' || n_name || '$' || CAST(s_suppkey % 7 AS STRING)
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
}
NEEDS = {"fx_flat_entities": ["fx_entities"], "fx_dag_edges": ["fx_deps", "fx_entities", "fx_flat_entities"]}
GIVEN = re.compile(r"\b(FROM|JOIN) (part|lineitem|customer|supplier|nation|region)\b")


def with_views(*names: str) -> str:
    """``WITH`` clause (without the word) that defines these views and what they need, for either engine."""
    wanted = list(dict.fromkeys(v for n in names for v in [*NEEDS.get(n, []), n]))
    order = [v for v in VIEWS if v in wanted]
    return ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables of ``sf_dir``."""
    return spark.sql(GIVEN.sub(rf"\1 parquet.`{sf_dir}/\2.parquet`", f"WITH {with_views(name)} SELECT * FROM {name}"))


def clusterings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(clustering_id, entity, path array<string>)``."""
    return fixture(spark, sf_dir, "fx_path_names").selectExpr("clustering_id", "entity", "split(path_name, '[$]') AS path").distinct()
