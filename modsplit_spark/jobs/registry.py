"""Queries of the library's own operators over the fixture views, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modsplit_spark.functions import identifiers as I
from modsplit_spark.functions import paths as P
from modsplit_spark.operators import clustering as C
from modsplit_spark.operators import export as D
from modsplit_spark.operators import extract as R
from modsplit_spark.operators import graph as G
from modsplit_spark.operators import partition as N
from modsplit_spark.operators import similarity as M
from modsplit_spark.sources import tables
from modsplit_spark.sources.fixtures import GIVEN, clusterings, fixture, with_views
from modsplit_spark.sources.workspace import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
UNIT = G.UNIT


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---------------------------------------------------------------- shared frames and their SQL


class Frames:
    """The fixture frames that a query needs, each made when asked for and once. What costs several stages is written."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        view = lambda name: fixture(spark, sf_dir, name)
        self.spark, self.entities, self.flat, self.deps = spark, view("fx_entities"), view("fx_flat_entities"), view("fx_deps")

    @cached_property
    def internal(self) -> DataFrame:
        return materialize(R.internal_deps(self.written_deps, self.flat), "internal")

    @cached_property
    def written_deps(self) -> DataFrame:
        return materialize(self.deps, "deps")

    @cached_property
    def units(self) -> DataFrame:
        return self.internal.select(*UNIT).distinct()

    @cached_property
    def outside(self) -> DataFrame:
        return materialize(R.outside_deps(self.written_deps, self.flat, R.root_closure(self.flat)).distinct(), "outside")

    @cached_property
    def children_nodes(self) -> DataFrame:
        none = self.spark.createDataFrame([], "commit_key string, parent_id string, entity_id string, name string, kind string")
        return materialize(G.index_nodes(R.label_clients(self.units, self.flat, none)), "nodes")

    @cached_property
    def nodes(self) -> DataFrame:
        return materialize(G.index_nodes(R.label_clients(self.units, self.flat, R.clients(self.outside, self.flat))), "nodes")

    @cached_property
    def all_deps(self) -> DataFrame:
        return self.internal.unionByName(R.client_deps(self.outside))

    @cached_property
    def directed(self) -> DataFrame:
        return G.directed_edges(self.all_deps, self.nodes)

    @cached_property
    def joined(self) -> DataFrame:
        return materialize(self.directed, "directed")

    def termed(self, stem: bool = True) -> DataFrame:
        return I.termize(self.flat.where("parent_id is not null").select("parent_id", "entity_id", "name"), stem)

    @cached_property
    def terms_found(self) -> DataFrame:
        return materialize(self.termed(), "terms")

    @cached_property
    def vocabulary(self) -> tuple[DataFrame, DataFrame]:
        starts = self.flat.select("entity_id", "start_byte")
        return M.vocabulary(I.placed_occurrences(self.termed().join(starts, "entity_id")))

    def pairs(self) -> DataFrame:
        return M.drop_isolated_terms(M.pair_counts(I.occurrences(self.terms_found)))

    def sims(self) -> DataFrame:
        return M.doc_similarity(materialize(self.pairs(), "pairs"))

    def near(self) -> DataFrame:
        return M.similar_pairs(materialize(self.pairs(), "pairs"))

    @cached_property
    def sims_found(self) -> DataFrame:
        return materialize(self.near(), "sims")

    @cached_property
    def named_nodes(self) -> DataFrame:
        """Nodes with ``doc``, null for clients."""
        docs = self.terms_found.select("parent_id", "entity_id", "doc", F.lit(False).alias("is_client"))
        return materialize(self.nodes.join(docs, ["parent_id", "entity_id", "is_client"], "left"), "named")

    @cached_property
    def scc(self) -> DataFrame:
        return materialize(G.strong_components(self.nodes, self.joined), "scc")

    @cached_property
    def condensed(self) -> DataFrame:
        return materialize(G.condense_nodes(self.nodes, self.scc).select(*UNIT, "scc", F.array_min("members").alias("least"), "weight", F.size("members").cast("long").alias("members")), "condensed")


def over(make: Callable[[Frames], DataFrame]) -> Query:
    """A query of one set of frames."""
    return lambda spark, sf_dir: make(Frames(spark, sf_dir))


#: The words of the fixture's names whose stem is another word, stemmed by hand.
STEMS = {"large": "larg"}
STEM_MAP = f"map({list(STEMS)}, {list(STEMS.values())})"

CTE = {
    "d": (["fx_deps"], "SELECT coalesce(nullif(commit_id, ''), 'WORKDIR') AS commit_key, src_id, tgt_id, kind FROM fx_deps"),
    "kids": (["fx_flat_entities"], "SELECT parent_id, entity_id, name, kind, start_byte FROM fx_flat_entities WHERE parent_id IS NOT NULL"),
    "internal": (["d", "kids"], "SELECT d.commit_key, s.parent_id, d.src_id, d.tgt_id, d.kind FROM d JOIN kids s ON s.entity_id = d.src_id JOIN kids t ON t.entity_id = d.tgt_id WHERE s.parent_id = t.parent_id AND d.src_id <> d.tgt_id"),
    "units": (["internal"], "SELECT DISTINCT commit_key, parent_id FROM internal"),
    "flatroot": (["fx_flat_entities"], "SELECT entity_id, coalesce(parent_id, entity_id) AS root_id FROM fx_flat_entities"),
    "outside": (["d", "kids", "flatroot"], "SELECT d.commit_key, k.parent_id, r.root_id, d.tgt_id, d.kind FROM d JOIN kids k ON k.entity_id = d.tgt_id JOIN flatroot r ON r.entity_id = d.src_id JOIN flatroot o ON o.entity_id = k.parent_id WHERE r.root_id <> o.root_id"),
    "clients": (["outside"], "SELECT DISTINCT o.commit_key, o.parent_id, o.root_id AS entity_id, e.name, e.kind FROM outside o JOIN fx_flat_entities e ON e.entity_id = o.root_id"),
    "labelled": (["units", "clients"], "SELECT u.commit_key, u.parent_id, k.entity_id, k.name, k.start_byte, false AS is_client FROM units u JOIN kids k ON k.parent_id = u.parent_id UNION ALL SELECT u.commit_key, u.parent_id, c.entity_id, '(Client) ' || c.name, NULL, true FROM units u JOIN clients c ON c.commit_key = u.commit_key AND c.parent_id = u.parent_id"),
    "nodes": (["labelled"], "SELECT *, CAST(row_number() OVER (PARTITION BY commit_key, parent_id ORDER BY is_client, start_byte, name, entity_id) - 1 AS INTEGER) AS ix, CASE WHEN is_client THEN 0 ELSE 1 END AS weight FROM labelled"),
    "alldeps": (["internal", "outside"], "SELECT * FROM internal UNION ALL SELECT DISTINCT commit_key, parent_id, root_id, tgt_id, kind FROM outside"),
    "directed": (["alldeps", "nodes"], "SELECT DISTINCT d.commit_key, d.parent_id, a.ix AS a, b.ix AS b FROM alldeps d JOIN nodes a ON a.commit_key = d.commit_key AND a.parent_id = d.parent_id AND a.entity_id = d.src_id JOIN nodes b ON b.commit_key = d.commit_key AND b.parent_id = d.parent_id AND b.entity_id = d.tgt_id WHERE a.ix <> b.ix"),
    "termed": (["kids"], r"SELECT parent_id, entity_id, name, list_filter(flatten(list_transform(string_split_regex(name, '[ _]'), lambda p: CASE WHEN upper(p) = p AND lower(p) <> p THEN [lower(p)] ELSE string_split(lower(regexp_replace(p, '([A-Z0-9])', chr(1) || '\1', 'g')), chr(1)) END)), lambda t: len(t) > 0) AS terms FROM kids"),
    "stemmed": (["termed"], "SELECT parent_id, entity_id, name, list_transform(terms, lambda t: coalesce(map_extract_value(" + STEM_MAP + ", t), t)) AS terms FROM termed"),
    "docs": (["stemmed"], "SELECT *, array_to_string(terms, '_') AS doc FROM stemmed"),
    "occ": (["docs"], "SELECT parent_id, doc, unnest(list_concat(terms, list_transform(range(2, len(terms) + 1), lambda i: terms[i - 1] || '-' || terms[i]))) AS term FROM docs"),
    "allpairs": (["occ"], "SELECT parent_id, term, doc, count(*) AS n FROM occ GROUP BY ALL"),
    "pairs": (["allpairs"], "SELECT parent_id, term, doc, n FROM (SELECT *, sum(n) OVER (PARTITION BY parent_id, term) AS t FROM allpairs) WHERE t > 1"),
    "tc": (["pairs"], "SELECT parent_id, term, sum(n) AS t FROM pairs GROUP BY ALL"),
    "dc": (["pairs"], "SELECT parent_id, doc, sum(n) AS d FROM pairs GROUP BY ALL"),
    "tot": (["pairs"], "SELECT parent_id, sum(n) AS s FROM pairs GROUP BY ALL"),
    "grid": (["tc", "dc", "tot"], "SELECT tc.parent_id, tc.term, dc.doc, CAST(coalesce(p.n, 0) AS DOUBLE) AS n, CAST(t AS DOUBLE) AS t, CAST(d AS DOUBLE) AS d, CAST(s AS DOUBLE) AS s FROM tc JOIN dc ON dc.parent_id = tc.parent_id JOIN tot ON tot.parent_id = tc.parent_id LEFT JOIN pairs p ON p.parent_id = tc.parent_id AND p.term = tc.term AND p.doc = dc.doc"),
    "mi": (["grid"], "SELECT parent_id, term, doc, " + " + ".join(f"CASE WHEN {x} = 0 OR {a} = 0 OR {b} = 0 THEN 0 ELSE {x} / s * ln(greatest({x}, 1) * s / greatest({a} * {b}, 1)) END" for x, a, b in (("n", "t", "d"), ("(t - n)", "t", "(s - d)"), ("(d - n)", "(s - t)", "d"), ("(s + n - t - d)", "(s - t)", "(s - d)"))) + " AS mi FROM grid"),
    "centred": (["mi"], "SELECT *, mi - avg(mi) OVER (PARTITION BY parent_id, doc) AS c FROM mi"),
    "norm": (["mi"], "SELECT parent_id, doc, sqrt(sum(mi * mi)) AS len FROM mi GROUP BY ALL"),
    "dots": (["centred"], "SELECT x.parent_id, x.doc AS doc_a, y.doc AS doc_b, sum(x.c * y.c) AS dot FROM centred x JOIN centred y ON x.parent_id = y.parent_id AND x.term = y.term AND x.doc <= y.doc GROUP BY ALL"),
    "sims": (["dots", "norm"], "SELECT t.parent_id, t.doc_a, t.doc_b, CASE WHEN a.len * b.len > 0 THEN greatest(t.dot / (a.len * b.len), 0) ELSE 0 END AS sim FROM dots t JOIN norm a ON a.parent_id = t.parent_id AND a.doc = t.doc_a JOIN norm b ON b.parent_id = t.parent_id AND b.doc = t.doc_b"),
    "near": (["sims"], "SELECT parent_id, doc_a, doc_b, CASE WHEN sim < 0.25 THEN 0 ELSE sim END AS sim FROM sims"),
    "sym": (["near"], "SELECT parent_id, doc_a, doc_b, sim FROM near UNION ALL SELECT parent_id, doc_b, doc_a, sim FROM near WHERE doc_a <> doc_b"),
    "targets": (["nodes", "docs"], "SELECT n.commit_key, n.parent_id, n.ix, d.doc FROM nodes n JOIN docs d ON d.parent_id = n.parent_id AND d.entity_id = n.entity_id WHERE NOT n.is_client"),
    "simedges": (["targets", "sym"], "SELECT x.commit_key, x.parent_id, x.ix AS a, y.ix AS b, s.sim FROM targets x JOIN sym s ON s.parent_id = x.parent_id AND s.doc_a = x.doc AND s.sim > 0 JOIN targets y ON y.commit_key = x.commit_key AND y.parent_id = x.parent_id AND y.doc = s.doc_b WHERE x.ix < y.ix"),
    "edges": (["directed", "simedges"], "SELECT commit_key, parent_id, a, b, sum(w) AS w, bool_or(dir) AS directed, bool_or(NOT dir) AS undirected FROM (SELECT commit_key, parent_id, a, b, 1.0 AS w, true AS dir FROM directed UNION ALL SELECT commit_key, parent_id, a, b, sim, false FROM simedges) GROUP BY commit_key, parent_id, a, b"),
    "cl": (["fx_path_names"], "SELECT DISTINCT clustering_id, entity, string_split(path_name, '$') AS path FROM fx_path_names"),
    "wide": (["cl"], "SELECT DISTINCT clustering_id, entity, path[1:i] AS path FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM cl)"),
    "rooted": (["cl"], "SELECT clustering_id, a[1:coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b)))] AS root FROM (SELECT clustering_id, min(path) AS a, max(path) AS b FROM cl GROUP BY ALL)"),
    "bare": (["cl", "rooted"], "SELECT DISTINCT cl.clustering_id, entity, path[len(root) + 1:] AS path FROM cl JOIN rooted ON rooted.clustering_id = cl.clustering_id"),
}
VIEWS = ("fx_entities", "fx_flat_entities", "fx_deps", "fx_dag_edges", "fx_path_names")


def sql(body: str, *needs: str, recursive: bool = False, more: str = "") -> str:
    """``body`` behind the CTEs it needs."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        if name not in wanted:
            for n in CTE.get(name, ([],))[0]:
                visit(n)
            wanted.append(name)

    for n in needs:
        visit(n)
    views = [n for n in wanted if n in VIEWS]
    parts = [with_views(*views)] if views else []
    parts += [f"{n} AS ({CTE[n][1]})" for n in wanted if n in CTE]
    if more:
        parts.append(more)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; the added 0.0 turns -0.0 to 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def _six(w: Column) -> Column:
    return F.round(w, 6) + F.lit(0.0)


def named(df: DataFrame, column: str = "path") -> DataFrame:
    """Paths as names, so that values compare across engines."""
    return df.withColumn(column, P.path_name(F.col(column)))


# ---------------------------------------------------------------- extraction


@register("unit_components", sql("""
SELECT k.commit_key, k.parent_id, k.entity_id, k.ix, coalesce(c.n, 0.0) AS dependencies, w.wcc FROM nodes k
LEFT JOIN (SELECT commit_key, parent_id, src_id, CAST(count(*) AS DOUBLE) AS n FROM internal GROUP BY ALL) c ON c.commit_key = k.commit_key AND c.parent_id = k.parent_id AND c.src_id = k.entity_id
JOIN (SELECT commit_key, parent_id, ix, dense_rank() OVER (PARTITION BY commit_key, parent_id ORDER BY m DESC) - 1 AS wcc FROM (
  SELECT commit_key, parent_id, ix, max(other) AS m FROM reach GROUP BY ALL)) w ON w.commit_key = k.commit_key AND w.parent_id = k.parent_id AND w.ix = k.ix
WHERE NOT k.is_client""", "nodes", "internal", recursive=True, more="""
kid AS (SELECT * FROM nodes WHERE NOT is_client),
e AS (SELECT DISTINCT i.commit_key, i.parent_id, x.ix AS a, y.ix AS b FROM internal i JOIN kid x ON x.commit_key = i.commit_key AND x.parent_id = i.parent_id AND x.entity_id = i.src_id JOIN kid y ON y.commit_key = i.commit_key AND y.parent_id = i.parent_id AND y.entity_id = i.tgt_id),
u AS (SELECT * FROM e UNION SELECT commit_key, parent_id, b, a FROM e),
reach AS (SELECT commit_key, parent_id, ix, ix AS other FROM kid UNION SELECT r.commit_key, r.parent_id, r.ix, u.b FROM reach r JOIN u ON u.commit_key = r.commit_key AND u.parent_id = r.parent_id AND u.a = r.other)"""))  # fmt: skip
def unit_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per unit, the weak component of each child and how many of its dependencies stay inside."""
    f = Frames(spark, sf_dir)
    internal, nodes = f.internal, f.children_nodes
    wcc = G.weak_components(nodes, G.directed_edges(internal, nodes))
    counts = internal.groupBy(*UNIT, F.col("src_id").alias("entity_id")).agg(F.count("*").cast("double").alias("dependencies"))
    return nodes.join(wcc, [*UNIT, "ix"]).join(counts, [*UNIT, "entity_id"], "left").select(*UNIT, "entity_id", "ix", F.coalesce("dependencies", F.lit(0.0)).alias("dependencies"), "wcc")


#: A store as another tool leaves it: binary ids, every file twice, a row without an id for each nation, and kinds that are not known.
STORE = """
store AS (SELECT entity_id AS id, parent_id, name, kind, start_byte FROM fx_entities UNION ALL SELECT entity_id, parent_id, name, kind, start_byte + 5 FROM fx_entities WHERE parent_id IS NULL UNION ALL SELECT NULL, NULL, n_name, 'File', n_nationkey FROM nation),
hexed AS (SELECT lower(hex(id)) AS entity_id, lower(hex(parent_id)) AS parent_id, name, kind, CAST(start_byte AS BIGINT) AS start_byte FROM store)"""
KINDS = ("File", "Class")


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    body = f"WITH {with_views('fx_entities')},{STORE.partition('hexed AS')[0].rstrip().rstrip(',')} SELECT CAST(id AS BINARY) AS id, CAST(parent_id AS BINARY) AS parent_id, name, kind, start_byte FROM store"
    return tables.read_entities(spark.sql(GIVEN.sub(rf"\1 parquet.`{sf_dir}/\2.parquet`", body)), KINDS)


register("read_entities", sql("SELECT entity_id, parent_id, name, kind, min(start_byte) AS start_byte FROM hexed WHERE entity_id IS NOT NULL AND kind IN ('File', 'Class') GROUP BY ALL", "fx_entities", more=STORE))(lambda s, d: _store(s, d)[0])
register("rejected_entities", sql("""SELECT entity_id, parent_id, name, kind, start_byte, CASE WHEN entity_id IS NULL THEN 'null_id' WHEN kind NOT IN ('File', 'Class') THEN 'unknown_kind' ELSE 'repeated_id' END AS reason
FROM hexed WHERE entity_id IS NULL OR kind NOT IN ('File', 'Class') OR (parent_id IS NULL AND start_byte = 5)""", "fx_entities", more=STORE))(lambda s, d: _store(s, d)[1])
register("read_deps", sql("SELECT lower(hex(src_id)) AS src_id, lower(hex(tgt_id)) AS tgt_id, kind, nullif(commit_id, '') AS commit_id FROM fx_deps WHERE commit_id = 'c1'", "fx_deps"))(
    lambda s, d: tables.read_deps(fixture(s, d, "fx_deps").select(F.col("src_id").cast("binary").alias("src"), F.col("tgt_id").cast("binary").alias("tgt"), "kind", "commit_id"), "c1")[0]
)
#: The hierarchy with every seventh file's parent missing, and every eleventh file's parent one of its own classes, which closes a cycle.
BROKEN = """
files AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) AS r FROM fx_entities WHERE parent_id IS NULL),
ring AS (SELECT parent_id AS file, min(entity_id) AS class FROM fx_entities WHERE kind = 'Class' GROUP BY parent_id),
broken AS (SELECT e.entity_id, CASE WHEN f.r % 7 = 1 THEN 'gone ' || e.entity_id WHEN f.r % 11 = 2 THEN ring.class ELSE e.parent_id END AS parent_id FROM fx_entities e LEFT JOIN files f ON f.entity_id = e.entity_id LEFT JOIN ring ON ring.file = e.entity_id),
up AS (SELECT entity_id AS below, parent_id, 1 AS depth FROM broken UNION ALL SELECT u.below, b.parent_id, depth + 1 FROM up u JOIN broken b ON b.entity_id = u.parent_id WHERE depth < 12),
top AS (SELECT u.below, coalesce(b.entity_id, u.below) AS entity_id FROM (SELECT below, max(depth) AS depth FROM up WHERE parent_id IS NULL GROUP BY below) t JOIN up u ON u.below = t.below AND u.depth = t.depth LEFT JOIN (SELECT below, parent_id AS entity_id, depth FROM up) b ON b.below = t.below AND b.depth = t.depth - 1),
far AS (SELECT below AS entity_id, CASE WHEN max(depth) < 12 THEN 'dangling' ELSE 'cycle' END AS kind, CASE WHEN max(depth) < 12 THEN max(CASE WHEN parent_id LIKE 'gone %' THEN parent_id END) ELSE min(CASE WHEN depth > 4 THEN parent_id END) END AS witness FROM up GROUP BY below HAVING bool_and(parent_id IS NOT NULL))"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GIVEN.sub(rf"\1 parquet.`{sf_dir}/\2.parquet`", f"WITH {with_views('fx_entities')},{BROKEN.partition('up AS')[0].rstrip().rstrip(',')} SELECT * FROM broken"))


register("list_commits", sql("SELECT DISTINCT commit_key FROM d", "d"))(lambda s, d: R.list_commits(Frames(s, d).deps))
register("resolve_commit", sql("SELECT r.commit_key, CASE WHEN k.commit_key IS NULL THEN 'unknown_commit' ELSE 'ok' END AS status FROM (SELECT DISTINCT commit_key FROM d UNION SELECT n_name FROM nation) r LEFT JOIN (SELECT DISTINCT commit_key FROM d) k ON k.commit_key = r.commit_key", "d"))(
    lambda s, d: R.resolve_commit(Frames(s, d).deps, R.list_commits(Frames(s, d).deps).union(s.read.parquet(f"{d}/nation.parquet").select("n_name")))
)
register("filter_commit", sql("SELECT src_id, tgt_id, kind FROM fx_deps WHERE commit_id IS NULL OR commit_id = ''", "fx_deps"))(lambda s, d: R.filter_commit(Frames(s, d).deps, None).select("src_id", "tgt_id", "kind"))
register("list_roots", sql("SELECT name, entity_id FROM fx_entities WHERE parent_id IS NULL", "fx_entities"))(lambda s, d: R.list_roots(Frames(s, d).entities))
register("children", sql("SELECT parent_id, entity_id, name, kind, start_byte, row_number() OVER (PARTITION BY parent_id ORDER BY start_byte, entity_id) - 1 AS ord FROM fx_entities WHERE parent_id IS NOT NULL", "fx_entities"))(lambda s, d: R.children(Frames(s, d).entities))
register("descend_single_child", sql("SELECT r.entity_id AS root_id, CASE WHEN c.n = 1 THEN c.child ELSE r.entity_id END AS parent_id FROM fx_entities r LEFT JOIN (SELECT parent_id, count(*) AS n, min(entity_id) AS child FROM fx_entities WHERE parent_id IS NOT NULL GROUP BY ALL) c ON c.parent_id = r.entity_id WHERE r.parent_id IS NULL", "fx_entities"))(
    lambda s, d: R.descend_single_child(Frames(s, d).entities)
)
register("resolve_units", sql("""SELECT q.filename, r.entity_id AS root_id, CASE WHEN c.n = 1 THEN c.child ELSE r.entity_id END AS parent_id,
CASE WHEN r.entity_id IS NULL THEN 'unknown_file' WHEN g.parent_id IS NULL THEN 'no_entities' ELSE 'ok' END AS status
FROM (SELECT DISTINCT name AS filename FROM fx_entities WHERE parent_id IS NULL UNION SELECT n_name FROM nation) q
LEFT JOIN (SELECT * FROM fx_entities WHERE parent_id IS NULL) r ON r.name = q.filename
LEFT JOIN (SELECT parent_id, count(*) AS n, min(entity_id) AS child FROM fx_entities WHERE parent_id IS NOT NULL GROUP BY ALL) c ON c.parent_id = r.entity_id
LEFT JOIN (SELECT DISTINCT parent_id FROM fx_entities) g ON g.parent_id = CASE WHEN c.n = 1 THEN c.child ELSE r.entity_id END""", "fx_entities"))(
    lambda s, d: R.resolve_units(Frames(s, d).entities, R.list_roots(Frames(s, d).entities).select(F.col("name").alias("filename")).union(s.read.parquet(f"{d}/nation.parquet").select("n_name")))
)
register("root_closure", sql("SELECT entity_id, root_id FROM up WHERE done", "fx_entities", recursive=True, more="""
up AS (SELECT entity_id, coalesce(parent_id, entity_id) AS root_id, parent_id IS NULL AS done FROM fx_entities
UNION ALL SELECT u.entity_id, coalesce(e.parent_id, e.entity_id), e.parent_id IS NULL FROM up u JOIN fx_entities e ON e.entity_id = u.root_id WHERE NOT u.done)"""))(lambda s, d: R.root_closure(Frames(s, d).entities))
register("root_report", sql("""SELECT e.entity_id, CASE WHEN g.kind IS NULL THEN r.entity_id END AS root_id, coalesce(g.kind, 'ok') AS status, g.witness FROM broken e
LEFT JOIN far g ON g.entity_id = e.entity_id LEFT JOIN top r ON r.below = e.entity_id""", "fx_entities", recursive=True, more=BROKEN))(lambda s, d: R.root_report(_broken(s, d)))
register("internal_deps", sql("SELECT * FROM internal", "internal"))(over(lambda f: R.internal_deps(f.deps, f.flat)))
register("clients", sql("SELECT * FROM clients", "clients"))(over(lambda f: R.clients(f.outside, f.flat)))
register("client_deps", sql("SELECT DISTINCT commit_key, parent_id, root_id AS src_id, tgt_id, kind FROM outside", "outside"))(over(lambda f: R.client_deps(R.outside_deps(f.deps, f.flat, R.root_closure(f.flat)))))


@register("label_clients", sql("SELECT * FROM labelled", "labelled"))
def label_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return R.label_clients(f.units, f.flat, R.clients(f.outside, f.flat))


# ---------------------------------------------------------------- identifiers

register("split_identifier", sql("SELECT entity_id, array_to_string(terms, '|') AS tokens FROM termed", "termed"))(lambda s, d: Frames(s, d).flat.where("parent_id is not null").select("entity_id", F.array_join(I.split_identifier(F.col("name")), "|").alias("tokens")))
register("split_camel", sql("SELECT entity_id, array_to_string(list_filter(string_split(lower(regexp_replace(split_part(name, ' ', 1), '([A-Z0-9])', chr(1) || '\\1', 'g')), chr(1)), lambda t: len(t) > 0), '|') AS tokens FROM kids", "kids"))(
    lambda s, d: Frames(s, d).flat.where("parent_id is not null").select("entity_id", F.array_join(F.filter(I.split_camel(F.split_part("name", F.lit(" "), F.lit(1))), lambda t: F.length(t) > 0), "|").alias("tokens"))
)
PIECES = """
p AS (SELECT entity_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT entity_id, list_filter(string_split(regexp_replace(name, '([aeiou])', chr(1) || '\\1', 'g'), chr(1)), lambda t: len(t) > 0) AS ps FROM kids)),
g AS (SELECT entity_id, piece, i, sum(CASE WHEN len(piece) = 1 AND before = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY i) AS g FROM (SELECT *, lag(len(piece)) OVER (PARTITION BY entity_id ORDER BY i) AS before FROM p)),
t AS (SELECT entity_id, g, string_agg(piece, '' ORDER BY i) AS token FROM g GROUP BY entity_id, g)"""
register("join_singles", sql("SELECT entity_id, string_agg(token, '|' ORDER BY g) AS tokens FROM t GROUP BY entity_id", "kids", more=PIECES))(
    lambda s, d: Frames(s, d).flat.where("parent_id is not null").select("entity_id", F.array_join(F.split(I.join_singles(F.regexp_replace("name", "(?<=.)(?=[aeiou])", I.CUT)), I.CUT), "|").alias("tokens"))
)
register("termize", sql("SELECT parent_id, entity_id, array_to_string(terms, '|') AS terms FROM stemmed", "stemmed"))(lambda s, d: Frames(s, d).termed().select("parent_id", "entity_id", F.array_join("terms", "|").alias("terms")))
register("normalize_name", sql("SELECT parent_id, entity_id, doc FROM docs", "docs"))(lambda s, d: Frames(s, d).termed().select("parent_id", "entity_id", "doc"))
register("bigramize", sql("SELECT entity_id, array_to_string(list_transform(range(2, len(terms) + 1), lambda i: terms[i - 1] || '-' || terms[i]), '|') AS bigrams FROM stemmed", "stemmed"))(lambda s, d: Frames(s, d).termed().select("entity_id", F.array_join(I.bigramize(F.col("terms"), 1), "|").alias("bigrams")))
register("occurrences", sql("SELECT * FROM occ", "occ"))(lambda s, d: I.occurrences(Frames(s, d).termed()))

# ---------------------------------------------------------------- similarity

register("pair_counts", sql("SELECT * FROM allpairs", "allpairs"))(lambda s, d: M.pair_counts(I.occurrences(Frames(s, d).termed())))
register("term_counts", sql("SELECT parent_id, term, CAST(t AS BIGINT) AS term_count FROM tc", "tc"))(lambda s, d: M.term_counts(Frames(s, d).pairs()))
register("doc_counts", sql("SELECT parent_id, doc, CAST(d AS BIGINT) AS doc_count FROM dc", "dc"))(lambda s, d: M.doc_counts(Frames(s, d).pairs()))
register("drop_isolated_terms", sql("SELECT * FROM pairs", "pairs"))(lambda s, d: Frames(s, d).pairs())
register("total", sql("SELECT parent_id, CAST(s AS BIGINT) AS total FROM tot", "tot"))(lambda s, d: M.total(Frames(s, d).pairs()))
register("marginal_joint_probs", sql("""SELECT g.parent_id, g.term, g.doc, round(t/s,9) AS p_i_1, round((s-t)/s,9) AS p_i_0, round(d/s,9) AS p_j_1, round((s-d)/s,9) AS p_j_0,
round(n/s,9) AS p_ij_11, round((t-n)/s,9) AS p_ij_10, round((d-n)/s,9) AS p_ij_01, round((s+n-t-d)/s,9) AS p_ij_00 FROM grid g WHERE n > 0""", "grid"))(
    lambda s, d: rounded(M.marginal_joint_probs(Frames(s, d).pairs()), *(f"p_{x}" for x in ("i_1", "i_0", "j_1", "j_0", "ij_11", "ij_10", "ij_01", "ij_00")), digits=9)
)
register("mutual_information", sql("SELECT parent_id, term, doc, round(mi, 6) + 0.0 AS mi FROM mi", "mi"))(lambda s, d: rounded(M.mutual_information(Frames(s, d).pairs()), "mi"))
VOCABULARY = """
occat AS (SELECT s.parent_id, k.start_byte, s.entity_id, array_to_string(s.terms, '_') AS doc, unnest(list_concat(s.terms, list_transform(range(2, len(s.terms) + 1), lambda i: s.terms[i - 1] || '-' || s.terms[i]))) AS term,
  unnest(range(2 * len(s.terms))) AS i FROM stemmed s JOIN kids k ON k.entity_id = s.entity_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY start_byte, entity_id, i) AS seat, count(*) OVER (PARTITION BY parent_id, term) AS t FROM occat WHERE term IS NOT NULL),
vd AS (SELECT parent_id, doc, row_number() OVER (PARTITION BY parent_id ORDER BY min(seat)) - 1 AS doc_ix FROM ranked WHERE t > 1 GROUP BY parent_id, doc),
vt AS (SELECT parent_id, term, row_number() OVER (PARTITION BY parent_id ORDER BY min(seat)) - 1 AS term_ix FROM ranked WHERE t > 1 GROUP BY parent_id, term)"""


register("vocabulary", sql("SELECT parent_id, doc, CAST(doc_ix AS INTEGER) AS doc_ix FROM vd", "stemmed", more=VOCABULARY))(over(lambda f: f.vocabulary[1]))
register("vocabulary_terms", sql("SELECT parent_id, term, CAST(term_ix AS INTEGER) AS term_ix FROM vt", "stemmed", more=VOCABULARY))(over(lambda f: f.vocabulary[0]))
register("doc_similarity", sql("SELECT parent_id, doc_a, doc_b, round(sim, 6) + 0.0 AS sim FROM sims", "sims"))(lambda s, d: rounded(Frames(s, d).sims().drop("dist"), "sim"))
register("doc_distance", sql("SELECT parent_id, doc_a, doc_b, round(1 - sim, 6) + 0.0 AS dist FROM sims", "sims"))(lambda s, d: rounded(Frames(s, d).sims().drop("sim"), "dist"))
register("has_doc", sql("SELECT k.parent_id, k.entity_id, k.doc FROM docs k WHERE EXISTS (SELECT 1 FROM dc WHERE dc.parent_id = k.parent_id AND dc.doc = k.doc)", "docs", "dc"))(lambda s, d: M.has_doc(Frames(s, d).termed(), Frames(s, d).pairs()).select("parent_id", "entity_id", "doc"))
register("doc_index", sql("SELECT k.parent_id, k.entity_id, CAST(v.doc_ix AS INTEGER) AS doc_ix FROM docs k LEFT JOIN vd v ON v.parent_id = k.parent_id AND v.doc = k.doc", "docs", more=VOCABULARY))(
    over(lambda f: M.doc_index(f.termed(), f.vocabulary[1]).select("parent_id", "entity_id", "doc_ix"))
)


@register("name_sim", sql("""SELECT x.parent_id, x.entity_id, y.entity_id AS other_id, round(coalesce(s.sim, 0), 6) + 0.0 AS sim
FROM (SELECT *, lead(entity_id) OVER (PARTITION BY parent_id ORDER BY entity_id) AS other FROM docs) x JOIN docs y ON y.entity_id = x.other
LEFT JOIN sims s ON s.parent_id = x.parent_id AND s.doc_a = least(x.doc, y.doc) AND s.doc_b = greatest(x.doc, y.doc)""", "docs", "sims"))  # fmt: skip
def name_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each entity's name and that of the next entity of its parent."""
    from pyspark.sql import Window as W

    f = Frames(spark, sf_dir)
    order = W.partitionBy("parent_id").orderBy("entity_id")
    next_doc = f.termed().select("parent_id", "entity_id", F.col("doc").alias("doc_a"), F.lead("doc").over(order).alias("doc_b"), F.lead("entity_id").over(order).alias("other_id"))
    return rounded(M.name_sim(next_doc.where("other_id is not null"), f.sims()), "sim").select("parent_id", "entity_id", "other_id", "sim")


register("most_similar", sql("""SELECT parent_id, doc, rank, round(sim, 6) + 0.0 AS sim FROM (
SELECT x.parent_id, doc_a AS doc, sim, row_number() OVER (PARTITION BY x.parent_id, doc_a ORDER BY sim DESC, doc_ix DESC) - 1 AS rank FROM (
SELECT parent_id, doc_a, doc_b, sim FROM sims UNION ALL SELECT parent_id, doc_b, doc_a, sim FROM sims WHERE doc_a <> doc_b) x JOIN vd ON vd.parent_id = x.parent_id AND vd.doc = doc_b) WHERE rank BETWEEN 1 AND 4""", "sims", more=VOCABULARY))(
    over(lambda f: rounded(M.most_similar(f.sims(), 5, f.vocabulary[1]), "sim").select("parent_id", "doc", "rank", "sim"))
)
register("entity_sim", sql("SELECT parent_id, doc_a, doc_b, round(sim, 6) + 0.0 AS sim FROM near", "near"))(lambda s, d: rounded(M.entity_sim(Frames(s, d).sims()).drop("dist"), "sim"))
register("similar_pairs", sql("SELECT parent_id, doc_a, doc_b, round(sim, 6) + 0.0 AS sim FROM near WHERE sim > 0", "near"))(over(lambda f: rounded(f.near(), "sim")))

# ---------------------------------------------------------------- graph

register("index_nodes", sql("SELECT commit_key, parent_id, entity_id, name, ix FROM nodes", "nodes"))(over(lambda f: f.nodes.select(*UNIT, "entity_id", "name", "ix")))
register("node_weights", sql("SELECT commit_key, parent_id, ix, weight FROM nodes", "nodes"))(over(lambda f: f.nodes.select(*UNIT, "ix", "weight")))
register("directed_edges", sql("SELECT * FROM directed", "directed"))(over(lambda f: f.directed))


@register("similarity_edges", sql("SELECT commit_key, parent_id, a, b, round(sim, 6) + 0.0 AS sim FROM simedges", "simedges"))
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return G.similarity_edges(f.nodes, f.terms_found, materialize(rounded(f.sims_found, "sim"), "rounded"))


register("edge_weights", sql("SELECT commit_key, parent_id, a, b, round(w, 6) + 0.0 AS w, directed, undirected FROM edges", "edges"))(
    over(lambda f: G.mixed_edges(f.named_nodes.withColumn("node", F.col("ix")), f.joined, f.sims_found).edges(_six))
)
register("transpose_edges", sql("SELECT commit_key, parent_id, b AS a, a AS b FROM directed", "directed"))(over(lambda f: G.transpose_edges(f.directed)))
register("adjacency", sql("SELECT commit_key, parent_id, a, string_agg(b, ',' ORDER BY b) AS neighbours FROM directed GROUP BY ALL", "directed"))(
    over(lambda f: G.adjacency(f.directed).withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",")))
)
REACH = "reach AS (SELECT commit_key, parent_id, ix, ix AS other FROM nodes UNION SELECT r.commit_key, r.parent_id, r.ix, e.b FROM reach r JOIN {edges} e ON e.commit_key = r.commit_key AND e.parent_id = r.parent_id AND e.a = r.other)"


@register("weak_components", sql("SELECT commit_key, parent_id, ix, CAST(dense_rank() OVER (PARTITION BY commit_key, parent_id ORDER BY m DESC) - 1 AS INTEGER) AS wcc FROM (SELECT commit_key, parent_id, ix, max(other) AS m FROM reach GROUP BY ALL)",
    "nodes", "directed", recursive=True, more="u AS (SELECT * FROM directed UNION SELECT commit_key, parent_id, b, a FROM directed), " + REACH.format(edges="u")))
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return G.weak_components(f.nodes, f.directed)


@register("strong_components", sql("SELECT x.commit_key, x.parent_id, x.ix, min(x.other) AS least FROM reach x JOIN reach y ON y.commit_key = x.commit_key AND y.parent_id = x.parent_id AND y.ix = x.other AND y.other = x.ix GROUP BY ALL", "nodes", "directed", recursive=True, more=REACH.format(edges="directed")))
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's strong component, named by its least node."""
    from pyspark.sql import Window as W

    f = Frames(spark, sf_dir)
    found = G.strong_components(f.nodes, f.directed)
    return found.select(*UNIT, "ix", F.min("ix").over(W.partitionBy(*UNIT, "scc")).alias("least"))


MUTUAL = REACH.format(edges="directed") + ", scc AS (SELECT x.commit_key, x.parent_id, x.ix, min(x.other) AS least FROM reach x JOIN reach y ON y.commit_key = x.commit_key AND y.parent_id = x.parent_id AND y.ix = x.other AND y.other = x.ix GROUP BY ALL)"
register("condense_nodes", sql("SELECT s.commit_key, s.parent_id, s.least, CAST(sum(n.weight) AS INTEGER) AS weight, count(*) AS members FROM scc s JOIN nodes n ON n.commit_key = s.commit_key AND n.parent_id = s.parent_id AND n.ix = s.ix GROUP BY ALL", "nodes", "directed", recursive=True, more=MUTUAL))(
    over(lambda f: f.condensed.drop("scc"))
)


def _members(f: Frames) -> DataFrame:
    """Nodes as members of their strong component, which has its least node's name."""
    return f.named_nodes.join(f.scc, [*UNIT, "ix"]).join(f.condensed.select(*UNIT, "scc", F.col("least").alias("node")), [*UNIT, "scc"])


@register("condense_edges", sql("""SELECT e.commit_key, e.parent_id, x.least AS a, y.least AS b, round(max(e.w), 6) + 0.0 AS w, bool_or(e.directed) AS directed, bool_or(e.undirected) AS undirected
FROM edges e JOIN scc x ON x.commit_key = e.commit_key AND x.parent_id = e.parent_id AND x.ix = e.a JOIN scc y ON y.commit_key = e.commit_key AND y.parent_id = e.parent_id AND y.ix = e.b GROUP BY ALL""", "nodes", "edges", recursive=True, more=MUTUAL))  # fmt: skip
def condense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the condensation, components named by their least node."""
    f = Frames(spark, sf_dir)
    return G.mixed_edges(_members(f), f.joined, f.sims_found).edges(_six)


WEAK = """u AS (SELECT * FROM directed UNION SELECT commit_key, parent_id, b, a FROM directed),
both_ways AS (SELECT commit_key, parent_id, ix, ix AS other FROM nodes UNION SELECT r.commit_key, r.parent_id, r.ix, u.b FROM both_ways r JOIN u ON u.commit_key = r.commit_key AND u.parent_id = r.parent_id AND u.a = r.other),
weak AS (SELECT commit_key, parent_id, ix, min(other) AS least FROM both_ways GROUP BY ALL)"""


@register("component_edges", sql("""SELECT e.commit_key, e.parent_id, x.least AS a, y.least AS b, v.least AS component, round(max(e.w), 6) + 0.0 AS w, bool_or(e.directed) AS directed, bool_or(e.undirected) AS undirected
FROM edges e JOIN scc x ON x.commit_key = e.commit_key AND x.parent_id = e.parent_id AND x.ix = e.a JOIN scc y ON y.commit_key = e.commit_key AND y.parent_id = e.parent_id AND y.ix = e.b
JOIN weak v ON v.commit_key = e.commit_key AND v.parent_id = e.parent_id AND v.ix = e.a JOIN weak z ON z.commit_key = e.commit_key AND z.parent_id = e.parent_id AND z.ix = e.b AND z.least = v.least GROUP BY ALL""", "nodes", "edges", recursive=True, more=MUTUAL + ",\n" + WEAK))  # fmt: skip
def component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within a weak component; strong and weak components are named by their least node."""
    f = Frames(spark, sf_dir)
    wcc = G.weak_components(f.nodes, f.joined)
    least = wcc.groupBy(*UNIT, "wcc").agg(F.min("ix").alias("component"))
    members = _members(f).join(wcc, [*UNIT, "ix"]).join(least, [*UNIT, "wcc"])
    return G.mixed_edges(materialize(members, "members"), f.joined, f.sims_found, ["component"]).edges(_six).select(*UNIT, "a", "b", "component", "w", "directed", "undirected")


# ---------------------------------------------------------------- partition

DAG_POS = "pos AS (SELECT commit_key, parent_id, v, row_number() OVER (PARTITION BY commit_key, parent_id ORDER BY v) - 1 AS pos FROM (SELECT commit_key, parent_id, a AS v FROM fx_dag_edges UNION SELECT commit_key, parent_id, b FROM fx_dag_edges))"
SWEEP = DAG_POS + """,
step AS (SELECT commit_key, parent_id, pos, sum(u) AS u FROM (
  SELECT e.commit_key, e.parent_id, p.pos, 65536 AS u FROM fx_dag_edges e JOIN pos p ON p.commit_key = e.commit_key AND p.parent_id = e.parent_id AND p.v = e.a
  UNION ALL SELECT e.commit_key, e.parent_id, p.pos, -65536 FROM fx_dag_edges e JOIN pos p ON p.commit_key = e.commit_key AND p.parent_id = e.parent_id AND p.v = e.b) GROUP BY ALL),
curve AS (SELECT commit_key, parent_id, pos, sum(u) OVER w AS cut, count(*) OVER w AS l, count(*) OVER (PARTITION BY commit_key, parent_id) AS n FROM step WINDOW w AS (PARTITION BY commit_key, parent_id ORDER BY pos)),
best AS (SELECT commit_key, parent_id, pos AS at FROM (SELECT *, row_number() OVER (PARTITION BY commit_key, parent_id ORDER BY cut, abs(2 * l - n), pos) AS r FROM curve
  WHERE n >= 2 AND l >= 1 AND n - l >= 1 AND l <= ceil(1.1::DOUBLE * ceil(n / 2)) AND n - l <= ceil(1.1::DOUBLE * ceil(n / 2))) WHERE r = 1)"""


def _dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The acyclic fixture: every unit as one component, positions in order of node."""
    from pyspark.sql import Window as W

    raw = materialize(fixture(spark, sf_dir, "fx_dag_edges"), "dag-edges")
    ends = raw.select(*UNIT, F.col("a").alias("v")).union(raw.select(*UNIT, F.col("b"))).distinct()
    pos = materialize(ends.withColumn("pos", F.row_number().over(W.partitionBy(*UNIT).orderBy("v")) - 1), "dag-nodes")
    left, right = pos.withColumnsRenamed({"v": "a", "pos": "pa"}), pos.withColumnsRenamed({"v": "b", "pos": "pb"})
    edges = raw.join(left, [*UNIT, "a"]).join(right, [*UNIT, "b"]).select(*UNIT, F.lit(0).alias("wcc"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.lit(1.0).alias("w"))
    return pos.select(*UNIT, F.lit(0).alias("wcc"), "pos", F.lit(1).alias("weight")), edges


@register("acyclic_bisect", sql("SELECT c.commit_key, c.parent_id, c.pos, CAST(c.cut AS BIGINT) AS cut, CAST(CASE WHEN b.at IS NOT NULL THEN c.pos > b.at END AS INTEGER) AS label FROM curve c LEFT JOIN best b ON b.commit_key = c.commit_key AND b.parent_id = c.parent_id", "fx_dag_edges", more=SWEEP))
def acyclic_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _dag(spark, sf_dir)
    blocks = N.cut_curve(nodes, edges).withColumn("path", F.array().cast("array<int>"))
    return N.acyclic_bisect(blocks).select(*UNIT, "pos", "cut", "label")


@register("cut_weight", sql("SELECT e.commit_key, e.parent_id, CAST(sum(CASE WHEN (p.pos > b.at) <> (q.pos > b.at) THEN 65536 ELSE 0 END) AS BIGINT) AS cut FROM fx_dag_edges e JOIN pos p ON p.commit_key = e.commit_key AND p.parent_id = e.parent_id AND p.v = e.a JOIN pos q ON q.commit_key = e.commit_key AND q.parent_id = e.parent_id AND q.v = e.b JOIN best b ON b.commit_key = e.commit_key AND b.parent_id = e.parent_id GROUP BY ALL", "fx_dag_edges", more=SWEEP))
def cut_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight cut by the first split of each unit."""
    nodes, edges = _dag(spark, sf_dir)
    blocks = N.cut_curve(nodes, edges).withColumn("path", F.array().cast("array<int>"))
    labels = N.acyclic_bisect(blocks).where("label is not null").select(*UNIT, F.col("pos").alias("ix"), "label")
    return N.cut_weight(edges, labels)


register("balance_bound", sql("SELECT commit_key, parent_id, CAST(ceil(1.1::DOUBLE * ceil(n / 2)) AS BIGINT) AS bound FROM (SELECT commit_key, parent_id, count(*) AS n FROM pos GROUP BY ALL)", "fx_dag_edges", more=DAG_POS))(
    lambda s, d: _dag(s, d)[0].groupBy(*UNIT).agg(N.balance_bound(F.sum("weight")).alias("bound"))
)


#: Every level splits all open blocks; a row of ``r`` is a node at one level, and the last level of a node holds its path.
SPLITS = """r AS (SELECT commit_key, parent_id, wcc, pos, cut, '' AS path, 0 AS depth, true AS open FROM curves
UNION ALL SELECT commit_key, parent_id, wcc, pos, cut, CASE WHEN split IS NULL THEN path WHEN path = '' THEN CAST(CAST(pos > split AS INTEGER) AS VARCHAR) ELSE path || '$' || CAST(CAST(pos > split AS INTEGER) AS VARCHAR) END, depth + 1, split IS NOT NULL FROM (
  SELECT *, arg_min(pos, rank) OVER (PARTITION BY commit_key, parent_id, wcc, path) AS split FROM (
    SELECT *, CASE WHEN n >= 2 AND n - l >= 1 AND l <= ceil(1.1::DOUBLE * ceil(n / 2)) AND n - l <= ceil(1.1::DOUBLE * ceil(n / 2)) THEN CAST(cut AS HUGEINT) * 1000000000000 + abs(2 * l - n) * 1000000 + pos END AS rank FROM (
      SELECT *, count(*) OVER (PARTITION BY commit_key, parent_id, wcc, path ORDER BY pos) AS l, count(*) OVER (PARTITION BY commit_key, parent_id, wcc, path) AS n FROM r WHERE open)))),
labels AS (SELECT commit_key, parent_id, wcc, pos, arg_max(path, depth) AS path FROM r GROUP BY ALL)"""
CURVES = DAG_POS + """,
e AS (SELECT e.commit_key, e.parent_id, p.pos AS a, q.pos AS b FROM fx_dag_edges e JOIN pos p ON p.commit_key = e.commit_key AND p.parent_id = e.parent_id AND p.v = e.a JOIN pos q ON q.commit_key = e.commit_key AND q.parent_id = e.parent_id AND q.v = e.b),
{weak},
ends AS (SELECT commit_key, parent_id, a AS pos, 65536 AS u FROM e UNION ALL SELECT commit_key, parent_id, b, -65536 FROM e),
curves AS (SELECT s.commit_key, s.parent_id, w.wcc, s.pos, sum(s.u) OVER (PARTITION BY s.commit_key, s.parent_id, w.wcc ORDER BY s.pos) AS cut FROM (SELECT commit_key, parent_id, pos, sum(u) AS u FROM ends GROUP BY ALL) s JOIN wcc w ON w.commit_key = s.commit_key AND w.parent_id = s.parent_id AND w.pos = s.pos)"""
ONE_WCC = "wcc AS (SELECT commit_key, parent_id, pos, 0 AS wcc FROM pos)"
DAG_WCC = """u AS (SELECT DISTINCT * FROM e UNION SELECT commit_key, parent_id, b, a FROM e),
far AS (SELECT commit_key, parent_id, pos, pos AS other FROM pos UNION SELECT f.commit_key, f.parent_id, f.pos, u.b FROM far f JOIN u ON u.commit_key = f.commit_key AND u.parent_id = f.parent_id AND u.a = f.other),
wcc AS (SELECT commit_key, parent_id, pos, dense_rank() OVER (PARTITION BY commit_key, parent_id ORDER BY m DESC) - 1 AS wcc FROM (SELECT commit_key, parent_id, pos, max(other) AS m FROM far GROUP BY ALL))"""
DAG_PATHS = CURVES.format(weak=DAG_WCC) + ",\n" + SPLITS + """,
paths AS (SELECT w.commit_key, w.parent_id, w.pos, CAST(w.wcc AS VARCHAR) || CASE WHEN coalesce(l.path, '') = '' THEN '' ELSE '$' || l.path END AS path FROM wcc w LEFT JOIN labels l ON l.commit_key = w.commit_key AND l.parent_id = w.parent_id AND l.wcc = w.wcc AND l.pos = w.pos)"""


@register("recursive_partition", sql("SELECT commit_key, parent_id, pos, path FROM labels", "fx_dag_edges", recursive=True, more=CURVES.format(weak=ONE_WCC) + ",\n" + SPLITS))
def recursive_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _dag(spark, sf_dir)
    return N.recursive_partition(nodes, edges).select(*UNIT, "pos", F.array_join(F.transform("path", lambda x: x.cast("string")), "$").alias("path"))


def _paths(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "$"))


def _dag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(unit, scc, path)`` of the acyclic fixture, whose nodes are strong components in topological order as they are."""
    nodes, edges = _dag(spark, sf_dir)
    marked = materialize(edges.select(*UNIT, "a", "b", "w", F.lit(True).alias("directed")), "scc-edges")
    return N.partition_dag(nodes.select(*UNIT, F.col("pos").alias("scc"), "weight"), marked)


def _dag_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(unit, ix, name, path)``: the acyclic fixture's members, every seventh marked as a client, with their clusters."""
    name = F.when(F.col("ix") % 7 == 3, F.concat(F.lit("(Client) m"), (F.col("ix") % 5).cast("string"))).otherwise(F.concat(F.lit("m"), (F.col("ix") % 5).cast("string")))
    return materialize(_dag_paths(spark, sf_dir).withColumnRenamed("scc", "ix").withColumn("name", name), "assigned")


ASSIGNED = DAG_PATHS + """,
assigned AS (SELECT commit_key, parent_id, pos AS ix, path, CASE WHEN pos % 7 = 3 THEN '(Client) m' ELSE 'm' END || CAST(pos % 5 AS VARCHAR) AS name FROM paths)"""


@register("partition_dag", sql("SELECT commit_key, parent_id, pos AS scc, path FROM paths", "fx_dag_edges", recursive=True, more=DAG_PATHS))
def partition_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(_dag_paths(spark, sf_dir).drop("status"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return materialize(N.cluster_named_units(f.nodes, f.joined, f.terms_found, f.sims_found), "clusters")


register("cluster_units")(lambda s, d: _paths(_clustered(s, d)))
#: All labellings of the components of up to 12 nodes: bit i of ``m`` is the label of the component's i-th node.
MASKS = CURVES.format(weak=DAG_WCC) + """,
place AS (SELECT commit_key, parent_id, wcc, pos, row_number() OVER (PARTITION BY commit_key, parent_id, wcc ORDER BY pos) - 1 AS bit, count(*) OVER (PARTITION BY commit_key, parent_id, wcc) AS n FROM curves),
small AS (SELECT * FROM place WHERE n <= 12),
masks AS (SELECT commit_key, parent_id, wcc, n, unnest(range(1, (1 << n) - 1)) AS m FROM (SELECT DISTINCT commit_key, parent_id, wcc, n FROM small)),
ends2 AS (SELECT x.commit_key, x.parent_id, x.wcc, x.bit AS a, y.bit AS b FROM e JOIN small x ON x.commit_key = e.commit_key AND x.parent_id = e.parent_id AND x.pos = e.a JOIN small y ON y.commit_key = e.commit_key AND y.parent_id = e.parent_id AND y.pos = e.b AND y.wcc = x.wcc),
judged AS (SELECT masks.commit_key, masks.parent_id, masks.wcc, n, m, sum((m >> a & 1) <> (m >> b & 1)) AS cut, max((m >> a & 1) > (m >> b & 1)) AS back FROM masks JOIN ends2 ON ends2.commit_key = masks.commit_key AND ends2.parent_id = masks.parent_id AND ends2.wcc = masks.wcc GROUP BY ALL),
chosen AS (SELECT commit_key, parent_id, wcc, arg_min(m, cut * 1000000000 + abs(2 * bit_count(m) - n) * 1000000 + m) AS m FROM judged WHERE NOT back AND n >= 2 AND bit_count(m) <= ceil(1.1::DOUBLE * ceil(n / 2)) AND n - bit_count(m) <= ceil(1.1::DOUBLE * ceil(n / 2)) GROUP BY ALL)"""


@register("exact_partition", sql("SELECT s.commit_key, s.parent_id, s.pos, CAST(c.m >> s.bit & 1 AS INTEGER) AS label FROM small s LEFT JOIN chosen c ON c.commit_key = s.commit_key AND c.parent_id = s.parent_id AND c.wcc = s.wcc", "fx_dag_edges", recursive=True, more=MASKS))
def exact_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of least cut of every component of up to 12 nodes of the acyclic fixture."""
    nodes, edges = _dag(spark, sf_dir)
    marked = materialize(edges.select(*UNIT, "a", "b", "w", F.lit(True).alias("directed")), "scc-edges")
    wcc = materialize(G.weak_components(nodes.select(*UNIT, F.col("pos").alias("scc")), marked, node="scc"), "wcc")
    sizes = wcc.groupBy(*UNIT, "wcc").count().where(F.col("count").between(2, N.EXACT_NODES))
    members = wcc.join(sizes, [*UNIT, "wcc"], "left_semi").select(*UNIT, "wcc", F.col("scc").alias("pos"), F.lit(1).alias("weight"))
    split = N.exact_partition(members, G.component_edges(marked, wcc))
    return split.select(*UNIT, "pos", F.get("path", F.lit(0)).alias("label"))


register("assignment_lines", sql("SELECT commit_key, parent_id, ix, name || ' : [' || replace(path, '$', ', ') || ']' AS line FROM assigned", "fx_dag_edges", recursive=True, more=ASSIGNED))(lambda s, d: tables.assignment_lines(_dag_assigned(s, d)))

# ---------------------------------------------------------------- clustering algebra

CONTRACT = "SELECT a.clustering_id, a.entity, array_to_string(a.path, '$') AS path FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE b.clustering_id = a.clustering_id AND b.entity = a.entity AND len(b.path) > len(a.path) AND b.path[1:len(a.path)] = a.path)"
cl = clusterings
register("path_name", sql("SELECT clustering_id, entity, array_to_string(path, '$') AS path FROM cl", "cl"))(lambda s, d: named(cl(s, d).withColumn("path", P.path_validate(F.col("path")))))
register("path_parent", sql("SELECT clustering_id, entity, array_to_string(path, '$') AS path, CASE WHEN len(path) > 1 THEN array_to_string(path[1:len(path)-1], '$') END AS parent FROM cl", "cl"))(lambda s, d: named(cl(s, d).withColumn("parent", P.path_name(P.path_parent(F.col("path"))))))
register("path_ancestors", sql("SELECT clustering_id, entity, array_to_string(path[1:i], '$') AS path, i AS depth FROM (SELECT *, unnest(range(1, len(path))) AS i FROM cl)", "cl"))(
    lambda s, d: named(cl(s, d).select("clustering_id", "entity", F.explode(P.path_ancestors(F.col("path"))).alias("path")).withColumn("depth", F.size("path").cast("long")))
)
register("path_truncate", sql("SELECT clustering_id, entity, array_to_string(path[1:2], '$') AS path FROM cl", "cl"))(lambda s, d: named(cl(s, d).withColumn("path", P.path_truncate(F.col("path"), 1))))
register("path_fill", sql("SELECT clustering_id, entity, array_to_string(list_concat(path, list_transform(range(greatest(6 - len(path), 0)), lambda i: '_')), '$') AS path FROM cl", "cl"))(lambda s, d: named(cl(s, d).withColumn("path", P.path_fill(F.col("path"), "_", 6))))
PAIRED = "p AS (SELECT clustering_id, entity, path AS b, lag(path) OVER (PARTITION BY clustering_id ORDER BY path, entity) AS a FROM cl)"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    return cl(spark, sf_dir).select("clustering_id", "entity", F.col("path").alias("b"), F.lag("path").over(W.partitionBy("clustering_id").orderBy("path", "entity")).alias("a")).where("a is not null")


register("is_ancestor_of", sql("SELECT clustering_id, entity, array_to_string(b, '$') AS path, len(a) < len(b) AND b[1:len(a)] = a AS ancestor FROM p WHERE a IS NOT NULL", "cl", more=PAIRED))(lambda s, d: _paired(s, d).select("clustering_id", "entity", P.path_name(F.col("b")).alias("path"), P.is_ancestor_of(F.col("a"), F.col("b")).alias("ancestor")))
register("path_compare", sql("SELECT clustering_id, entity, array_to_string(b, '$') AS path, a = b AS equal, a < b AS less, len(b) AS length FROM p WHERE a IS NOT NULL", "cl", more=PAIRED))(
    lambda s, d: _paired(s, d).select("clustering_id", "entity", P.path_name(F.col("b")).alias("path"), P.path_equal(F.col("a"), F.col("b")).alias("equal"), (F.col("a") < F.col("b")).alias("less"), F.size("b").cast("long").alias("length"))
)
register("union", sql("SELECT clustering_id, entity, array_to_string(path, '$') AS path FROM cl UNION SELECT clustering_id, entity, array_to_string(path[1:1], '$') FROM cl", "cl"))(lambda s, d: named(C.union(cl(s, d), C.truncate(cl(s, d), 0))))
register("subset", sql("SELECT clustering_id, entity, array_to_string(path, '$') AS path FROM cl WHERE entity IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0)", "cl"))(
    lambda s, d: named(C.subset(cl(s, d), s.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"))))
)
register("truncate", sql("SELECT DISTINCT clustering_id, entity, array_to_string(path[1:2], '$') AS path FROM cl", "cl"))(lambda s, d: named(C.truncate(cl(s, d), 1)))
register("expand", sql("SELECT clustering_id, entity, array_to_string(path, '$') AS path FROM wide", "wide"))(lambda s, d: named(C.expand(cl(s, d))))
register("contract", sql(CONTRACT.format("cl"), "cl"))(lambda s, d: named(C.contract(cl(s, d))))
register("without_singletons", sql(CONTRACT.format("large"), "wide", more="large AS (SELECT clustering_id, entity, path FROM (SELECT *, count(*) OVER (PARTITION BY clustering_id, path) AS n FROM wide) WHERE n > 1)"))(lambda s, d: named(C.without_singletons(cl(s, d))))
register("fill", sql("SELECT DISTINCT cl.clustering_id, entity, array_to_string(list_concat(path, list_transform(range(m - len(path)), lambda i: '-')), '$') AS path FROM cl JOIN (SELECT clustering_id, max(len(path)) AS m FROM cl GROUP BY ALL) x ON x.clustering_id = cl.clustering_id", "cl"))(lambda s, d: named(C.fill(cl(s, d), "-")))
register("per_level", sql("SELECT DISTINCT cl.clustering_id, level, entity, array_to_string(path[1:level + 1], '$') AS path FROM cl JOIN (SELECT clustering_id, unnest(range(m)) AS level FROM (SELECT clustering_id, max(len(path)) AS m FROM cl GROUP BY ALL)) x ON x.clustering_id = cl.clustering_id", "cl"))(lambda s, d: named(C.per_level(cl(s, d))))
register("root", sql("SELECT clustering_id, array_to_string(root, '$') AS root FROM rooted", "rooted"))(lambda s, d: named(C.root(cl(s, d)), "root"))
register("without_root", sql("SELECT clustering_id, entity, array_to_string(path, '$') AS path FROM bare", "bare"))(lambda s, d: named(C.without_root(cl(s, d))))
register("with_root", sql("SELECT clustering_id, entity, 'top$' || array_to_string(path, '$') AS path FROM cl", "cl"))(lambda s, d: named(C.with_root(cl(s, d), ["top"])))
register("replace_root", sql("SELECT clustering_id, entity, array_to_string(list_concat(['new', 'top'], path), '$') AS path FROM bare", "bare"))(lambda s, d: named(C.replace_root(cl(s, d), ["new", "top"])))
register("with_isolated", sql("SELECT clustering_id, entity, array_to_string(path, '$') AS path FROM cl UNION ALL SELECT 'geo', 's' || s_suppkey, 's' || s_suppkey FROM supplier", "cl"))(
    lambda s, d: named(C.with_isolated(cl(s, d), s.read.parquet(f"{d}/supplier.parquet").select(F.lit("geo").alias("clustering_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"))))
)
register("normalize", sql("SELECT * FROM kept UNION ALL SELECT clustering_id, entity, entity FROM (SELECT DISTINCT clustering_id, entity FROM cl) WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.entity = cl.entity AND k.clustering_id = cl.clustering_id)".replace("FROM (SELECT DISTINCT clustering_id, entity FROM cl) WHERE", "FROM (SELECT DISTINCT clustering_id, entity FROM cl) cl WHERE"), "bare", more="""
bw AS (SELECT DISTINCT clustering_id, entity, path[1:i] AS path FROM (SELECT *, unnest(CASE WHEN len(path) = 0 THEN [0] ELSE range(1, len(path) + 1) END) AS i FROM bare)),
large AS (SELECT clustering_id, entity, path FROM (SELECT *, count(*) OVER (PARTITION BY clustering_id, path) AS n FROM bw) WHERE n > 1), kept AS (""" + CONTRACT.format("large") + ")"))(lambda s, d: named(C.normalize(cl(s, d))))
register("entities", sql("SELECT DISTINCT clustering_id, entity FROM cl", "cl"))(lambda s, d: C.entities(cl(s, d)))
register("clusters", sql("SELECT DISTINCT clustering_id, array_to_string(path, '$') AS path FROM cl", "cl"))(lambda s, d: named(C.clusters(cl(s, d))))
register("singleton_clusters", sql("SELECT clustering_id, array_to_string(path, '$') AS path, min(entity) AS entity FROM cl GROUP BY clustering_id, path HAVING count(*) = 1", "cl"))(lambda s, d: named(C.singleton_clusters(cl(s, d))))
register("singleton_entities", sql("SELECT clustering_id, entity, array_to_string(min(path), '$') AS path FROM cl GROUP BY clustering_id, entity HAVING count(*) = 1", "cl"))(lambda s, d: named(C.singleton_entities(cl(s, d))))
register("entities_for", sql("SELECT clustering_id, array_to_string(path, '$') AS path, string_agg(entity, ',' ORDER BY entity) AS entities FROM cl GROUP BY clustering_id, path", "cl"))(lambda s, d: named(C.entities_for(cl(s, d))).withColumn("entities", F.array_join("entities", ",")))
BLOCKED = "SELECT clustering_id, {key}, CAST(b AS INTEGER) AS block, string_agg(member, ',' ORDER BY member) AS members FROM (SELECT clustering_id, key, member, (row_number() OVER (PARTITION BY clustering_id, key ORDER BY member) - 1) // 7 AS b FROM ({pairs})) GROUP BY clustering_id, key, b"
register("entities_blocks", sql(BLOCKED.format(key="key AS path", pairs="SELECT DISTINCT clustering_id, array_to_string(path, '$') AS key, entity AS member FROM cl"), "cl"))(
    lambda s, d: named(C.entities_blocks(clusterings(s, d), 7)).withColumn("members", F.array_join("members", ","))
)
register("clusters_blocks", sql(BLOCKED.format(key="key AS entity", pairs="SELECT DISTINCT clustering_id, entity AS key, array_to_string(path, '$') AS member FROM wide"), "wide"))(
    lambda s, d: C.clusters_blocks(C.expand(clusterings(s, d)), 7).withColumn("members", F.array_join(F.transform("members", P.path_name), ","))
)
register("clusters_for", sql("SELECT clustering_id, entity, string_agg(array_to_string(path, '$'), ',' ORDER BY path) AS paths FROM cl GROUP BY clustering_id, entity", "cl"))(lambda s, d: C.clusters_for(cl(s, d)).withColumn("paths", F.array_join(F.transform("paths", P.path_name), ",")))
register("num_levels", sql("SELECT clustering_id, max(len(path)) AS num_levels FROM cl GROUP BY ALL", "cl"))(lambda s, d: C.num_levels(cl(s, d)).withColumn("num_levels", F.col("num_levels").cast("long")))

# ---------------------------------------------------------------- export

register("unique_names", sql("SELECT commit_key, parent_id, ix, CASE WHEN r = 0 THEN name ELSE name || ' (' || r || ')' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY commit_key, parent_id, name ORDER BY ix) - 1 AS r FROM nodes)", "nodes"))(over(lambda f: D.unique_names(f.nodes).select(*UNIT, "ix", "unique_name")))
register("matrix_variables", sql("SELECT commit_key, parent_id, entity_id, name, row_number() OVER (PARTITION BY commit_key, parent_id ORDER BY name, ix) - 1 AS var_ix FROM nodes", "nodes"))(over(lambda f: D.matrix_variables(f.nodes)))
COUNTS = "v AS (SELECT *, row_number() OVER (PARTITION BY commit_key, parent_id ORDER BY name, ix) - 1 AS var_ix FROM nodes), n AS (SELECT d.commit_key, d.parent_id, a.var_ix AS src, b.var_ix AS dest, d.kind, CAST(count(*) AS DOUBLE) AS c FROM alldeps d JOIN v a ON a.commit_key = d.commit_key AND a.parent_id = d.parent_id AND a.entity_id = d.src_id JOIN v b ON b.commit_key = d.commit_key AND b.parent_id = d.parent_id AND b.entity_id = d.tgt_id GROUP BY ALL)"
register("dependency_counts", sql("SELECT commit_key, parent_id, src, dest, kind, c AS count FROM n", "alldeps", "nodes", more=COUNTS))(over(lambda f: D.dependency_counts(f.all_deps, f.nodes)))
register("matrix_cells", sql("SELECT commit_key, parent_id, src, dest, string_agg(kind || '=' || CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY kind) AS cell FROM n GROUP BY ALL", "alldeps", "nodes", more=COUNTS))(
    lambda s, d: D.matrix_cells(D.dependency_counts((f := Frames(s, d)).all_deps, f.nodes)).select(*UNIT, "src", "dest", F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), ",").alias("cell"))
)


@register("dependency_json", sql("""SELECT v.commit_key, v.parent_id, '{"@schemaVersion":"1.0","name":' || CAST(to_json(v.parent_id) AS VARCHAR) || ',"variables":' || CAST(to_json(v.names) AS VARCHAR) || ',"cells":[' || coalesce(c.cells, '') || ']}' AS json
FROM (SELECT commit_key, parent_id, list(name ORDER BY var_ix) AS names FROM v GROUP BY ALL) v LEFT JOIN (
  SELECT commit_key, parent_id, string_agg('{"src":' || src || ',"dest":' || dest || ',"values":{' || cell || '}}', ',' ORDER BY src, dest) AS cells FROM (
    SELECT commit_key, parent_id, src, dest, string_agg(CAST(to_json(kind) AS VARCHAR) || ':' || CAST(c AS VARCHAR), ',' ORDER BY kind) AS cell FROM n GROUP BY ALL) GROUP BY ALL) c ON c.commit_key = v.commit_key AND c.parent_id = v.parent_id""", "alldeps", "nodes", more=COUNTS))
def dependency_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return D.dependency_json(f.nodes, D.dependency_counts(f.all_deps, f.nodes))


register("tree_groups", sql("""SELECT commit_key, parent_id, array_to_string(prefix, '$') AS path, array_to_string(list_transform(prefix, lambda c, i: CASE WHEN i % 2 = 1 THEN 'L' ELSE 'M' END || c), '/') AS name, CAST(len(prefix) AS INTEGER) AS depth, min(ix) AS ord
FROM (SELECT commit_key, parent_id, ix, string_split(path, '$')[1:i] AS prefix FROM (SELECT *, unnest(range(1, len(string_split(path, '$')) + 1)) AS i FROM assigned)) GROUP BY commit_key, parent_id, prefix""", "fx_dag_edges", recursive=True, more=ASSIGNED))(
    lambda s, d: _paths(D.tree_groups(_dag_assigned(s, d)).withColumnRenamed("node_path", "path"))
)
register("tree_items", sql("SELECT commit_key, parent_id, path, CASE WHEN r = 0 THEN name ELSE name || ' (' || r || ')' END AS name, ix FROM (SELECT *, row_number() OVER (PARTITION BY commit_key, parent_id, name ORDER BY ix) - 1 AS r FROM assigned)", "fx_dag_edges", recursive=True, more=ASSIGNED))(
    lambda s, d: _paths(D.tree_items(_dag_assigned(s, d)).withColumnRenamed("node_path", "path"))
)
register("client_root_items", sql("SELECT commit_key, parent_id, name, ix FROM nodes WHERE name LIKE '(Client)%'", "nodes"))(over(lambda f: D.client_root_items(f.nodes)))
register("tree_json")(lambda s, d: D.tree_json(_clustered(s, d)))
