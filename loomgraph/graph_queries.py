"""Registered graph queries and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import BucketHash
from .functions.tiling import Tiling
from .operators import algorithms as A
from .operators import report as R
from .operators.edges import compact_index
from .plans.graph import Graph
from .plans.program import VertexProgram, run
from .sources import edge_files as E
from .sources import tables as T
from .storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
UNDIRECTED = {"directed": False, "parallel_edges": False}
SEARCH = UNDIRECTED | {"self_loops": False}
PATHS = {"self_loops": False, "parallel_edges": False}

# --- SQL pieces ---------------------------------------------------------------------------------------------------

_EDGES = {
    "events_seq": "SELECT * FROM (SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS u, user_id AS v, CAST(floor(value) AS BIGINT) % 128 + 1 AS w FROM events) WHERE u IS NOT NULL",
    "part_supp": "SELECT l_partkey AS u, l_suppkey + (SELECT max(p_partkey) FROM part) + 1 AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem",
    "part_supp_raw": "SELECT l_partkey AS u, l_suppkey AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem",
    "order_part": "SELECT l_orderkey AS u, l_partkey AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem",
    "order_cust": "SELECT o_orderkey AS u, o_custkey AS v, o_orderkey % 128 + 1 AS w FROM orders",
}


def _ctes(graph: str, edges: str = "SELECT u, v, w FROM g") -> str:
    return f"""WITH RECURSIVE g AS ({_EDGES[graph]}), e AS MATERIALIZED ({edges}),
        dom AS MATERIALIZED (SELECT unnest(range(0, (SELECT max(greatest(u, v)) FROM g) + 1)) AS id)"""


_SEARCH_SQL = "SELECT u, v, min(w) AS w FROM (SELECT u, v, w FROM g UNION ALL SELECT v, u, w FROM g) WHERE u <> v GROUP BY u, v"
_PATHS_SQL = "SELECT u, v, min(w) AS w FROM g WHERE u <> v GROUP BY u, v"


def _degree_sql(graph: str, edges: str = "SELECT u, v, w FROM g", key: str = "u", agg: str = "count(*)") -> str:
    return f"""{_ctes(graph, edges)}, d AS (SELECT {key} AS id, {agg} AS n FROM e GROUP BY 1)
        SELECT dom.id, CAST(coalesce(d.n, 0) AS BIGINT) AS degree FROM dom LEFT JOIN d ON d.id = dom.id"""


def _pagerank_sql(graph: str, n: int, standard: bool = False) -> str:
    share = "r.rank / r.degree"
    receive, send = ("v", "u") if standard else ("u", "v")
    start = "SELECT 0 AS it, id, CAST(0.15 AS DOUBLE) AS rank, degree FROM deg" + ("" if standard else " WHERE degree > 0")
    return f"""{_ctes(graph)}, deg AS MATERIALIZED (SELECT dom.id, count(e.u) AS degree FROM dom LEFT JOIN e ON e.u = dom.id GROUP BY dom.id),
        r AS ({start} UNION ALL
            SELECT c.it, c.id, 0.15 + 0.85 * sum(c.x), any_value(c.degree) FROM (
                SELECT r.it + 1 AS it, e.{receive} AS id, {share} AS x, d.degree FROM e JOIN r ON r.id = e.{send} AND r.degree > 0
                    JOIN deg d ON d.id = e.{receive} WHERE r.it < {n}
                UNION ALL SELECT r.it + 1, r.id, 0.0, r.degree FROM r WHERE r.it < {n}) c GROUP BY c.it, c.id),
        pr AS (SELECT deg.id, round(coalesce(r.rank, 0.0), 6) AS rank, deg.degree FROM deg LEFT JOIN r ON r.id = deg.id AND r.it = {n})"""


def _bfs_ctes(graph: str, root: int = 0) -> str:
    return f"""{_ctes(graph, _SEARCH_SQL)}, b(id, hops) USING KEY (id) AS (
            SELECT CAST({root} AS BIGINT), CAST(0 AS BIGINT) UNION
            SELECT e.v, min(b.hops) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b o ON o.id = e.v WHERE o.id IS NULL GROUP BY e.v),
        s AS (SELECT dom.id, b.hops, CASE WHEN b.hops = 0 THEN dom.id ELSE p.parent END AS parent FROM dom LEFT JOIN b ON b.id = dom.id
            LEFT JOIN (SELECT c.id, min(e.u) AS parent FROM b c JOIN e ON e.v = c.id JOIN b q ON q.id = e.u AND q.hops = c.hops - 1 GROUP BY c.id) p ON p.id = dom.id)"""


def _sssp_ctes(graph: str, weight: str = "e.w", root: int = 0) -> str:
    return f"""{_ctes(graph, _PATHS_SQL)}, b(id, distance) USING KEY (id) AS (
            SELECT CAST({root} AS BIGINT), CAST(0 AS BIGINT) UNION
            SELECT e.v, min(b.distance + {weight}) FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b o ON o.id = e.v
            GROUP BY e.v HAVING min(b.distance + {weight}) < coalesce(any_value(o.distance), 1000000000000)),
        s AS (SELECT dom.id, b.distance FROM dom LEFT JOIN b ON b.id = dom.id)"""


def _cc_ctes(graph: str) -> str:
    return f"""{_ctes(graph, "SELECT u, v FROM g UNION SELECT v, u FROM g")}, b(id, label) USING KEY (id) AS (
            SELECT id, id FROM dom UNION
            SELECT e.v, min(b.label) FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b o ON o.id = e.v
            GROUP BY e.v HAVING min(b.label) < any_value(o.label)),
        s AS (SELECT id, label FROM b)"""


def _total(value: str, where: str) -> str:
    return f"SELECT CAST(coalesce(sum(CAST(floor({value}) AS BIGINT)), 0) AS BIGINT) AS checksum, count(*) AS reachable FROM s WHERE {where}"


# --- queries ------------------------------------------------------------------------------------------------------

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def graph(spark: SparkSession, sf_dir: str, name: str, weighted: bool = False, **flags) -> Graph:
    return Graph.from_edges(getattr(T, name)(spark, sf_dir), weight="weight" if weighted else None, **flags)


def _degrees() -> None:
    for name, source, flags, args, sql in (
        ("degree_out", "events_seq", {}, {}, {}),
        ("degree_in", "events_seq", {}, {"ordering": "col"}, {"key": "v"}),
        ("degree_transposed", "events_seq", {"transpose": True}, {}, {"key": "v"}),
        ("degree_no_loops", "events_seq", {"self_loops": False}, {}, {"edges": "SELECT * FROM g WHERE u <> v"}),
        ("degree_simple", "events_seq", {"parallel_edges": False}, {}, {"edges": "SELECT DISTINCT u, v FROM g"}),
        ("degree_undirected", "events_seq", {"directed": False}, {}, {"edges": "SELECT u, v FROM g UNION ALL SELECT v, u FROM g"}),
        ("degree_acyclic", "events_seq", {"acyclic": True}, {}, {"edges": "SELECT least(u, v) AS u, greatest(u, v) AS v FROM g"}),
    ):
        _query(name, _degree_sql(source, **sql))(lambda s, d, source=source, flags=flags, args=args: A.degree(graph(s, d, source, **flags), **args))
    _query("degree_weighted", _degree_sql("part_supp", agg="sum(w)"))(lambda s, d: A.degree(graph(s, d, "part_supp", weighted=True)))


def _edges() -> None:
    sql = "{} SELECT u AS src, v AS dst, w AS weight FROM e"
    _query("edges_normalized_bfs", sql.format(_ctes("events_seq", _SEARCH_SQL)))(lambda s, d: graph(s, d, "events_seq", True, **SEARCH).edges)
    _query("edges_normalized_sssp", sql.format(_ctes("events_seq", "SELECT v AS u, u AS v, min(w) AS w FROM g WHERE u <> v GROUP BY 1, 2")))(
        lambda s, d: graph(s, d, "events_seq", True, transpose=True, **PATHS).edges)
    top = "(SELECT (max(greatest(u, v)) + 1) // 1024 FROM g)"
    moved = "CASE WHEN {c} >= " + top + " * 1024 THEN {c} ELSE {c} // 1024 + {c} % 1024 * " + top + " END"
    _query("edges_hashed", f"{_ctes('order_part')} SELECT {moved.format(c='u')} AS src, {moved.format(c='v')} AS dst FROM e")(
        lambda s, d: graph(s, d, "order_part", hashing="bucket", buckets=8).edges)

    def unhashed(s, d):
        g = graph(s, d, "order_part", hashing="bucket", buckets=8)
        return g.original(A.degree(g))

    _query("degree_unhashed", _degree_sql("order_part"))(unhashed)
    _query("vertex_classes", f"""{_ctes("part_supp_raw")}, r AS (SELECT DISTINCT u AS id FROM e), c AS (SELECT DISTINCT v AS id FROM e)
        SELECT dom.id, CASE WHEN r.id IS NOT NULL AND c.id IS NOT NULL THEN 'regular' WHEN r.id IS NOT NULL THEN 'source' WHEN c.id IS NOT NULL THEN 'sink' ELSE 'isolated' END AS class
        FROM dom LEFT JOIN r ON r.id = dom.id LEFT JOIN c ON c.id = dom.id""")(lambda s, d: graph(s, d, "part_supp_raw").classes())
    _query("compact_row_index", f"""{_ctes("part_supp_raw")} SELECT id, id // 64 AS segment, row_number() OVER (PARTITION BY id // 64 ORDER BY id) - 1 AS index
        FROM (SELECT DISTINCT u AS id FROM e)""")(lambda s, d: compact_index(graph(s, d, "part_supp_raw").edges, "src", 64))


def _ranks() -> None:
    def ranks(s, d, source, n, **how):
        return A.pagerank(graph(s, d, source), n, **how).state.select("id", F.round("rank", 6).alias("rank"), "degree")

    for name, source, n, sql_n, how in (
        ("pagerank_pull_1", "events_seq", 1, 1, {}),
        ("pagerank_pull_20", "events_seq", 20, 20, {}),
        ("pagerank_pull_20_mixed", "part_supp_raw", 20, 20, {}),
        ("pagerank_cf_equiv", "part_supp_raw", 20, 20, {"split": False}),
        ("pagerank_standard_20", "order_part", 20, 20, {"mode": "standard"}),
    ):
        _query(name, f"{_pagerank_sql(source, sql_n, how.get('mode') == 'standard')} SELECT id, rank, degree FROM pr")(
            lambda s, d, source=source, n=n, how=how: ranks(s, d, source, n, **how))
    # SQL can't stop by tolerance; at sf0.01 the tolerance of 1e-5 is met in superstep 61.
    _query("pagerank_converged", f"{_pagerank_sql('events_seq', 61)} SELECT id, rank, degree FROM pr")(lambda s, d: ranks(s, d, "events_seq", 0))


def _searches() -> None:
    bfs = lambda s, d: A.bfs(graph(s, d, "order_part", **SEARCH), 1)
    b = _bfs_ctes("order_part", 1)
    _query("bfs_hops", f"{b} SELECT id, hops FROM s")(lambda s, d: bfs(s, d).state.select("id", "hops"))
    _query("bfs_parents", f"{b} SELECT id, parent FROM s")(lambda s, d: bfs(s, d).state.select("id", "parent"))
    _query("bfs_levels", f"{b} SELECT hops, count(*) AS vertices FROM s GROUP BY hops")(lambda s, d: bfs(s, d).state.groupBy("hops").agg(F.count(F.lit(1)).alias("vertices")))
    _query("display_bfs", f"""{b} SELECT id, 'vertex[' || id || ']:Parent=' || coalesce(CAST(parent AS VARCHAR), '0') || ',Hops=' || coalesce(CAST(hops AS VARCHAR), 'INF') AS shown
        FROM s ORDER BY id LIMIT 31""")(lambda s, d: R.display(bfs(s, d).state))
    shown = "SELECT id, 'vertex[' || id || ']:{}' AS shown FROM s ORDER BY id LIMIT 31"
    _query("display_sssp", f"{_sssp_ctes('events_seq')} {shown.format(chr(39).join(('Distance=', ' || coalesce(CAST(distance AS VARCHAR), ', 'INF', ') || ', '')))}")(
        lambda s, d: R.display(A.sssp(graph(s, d, "events_seq", True, **PATHS)).state))
    _query("display_cc", f"{_cc_ctes('order_cust')} {shown.format(chr(39).join(('Label=', ' || label || ', '')))}")(
        lambda s, d: R.display(A.connected_components(graph(s, d, "order_cust", **UNDIRECTED)).state))
    _query("bfs_sentinel", f"{b} SELECT id, coalesce(hops, 2147483647) AS hops, coalesce(parent, 0) AS parent FROM s")(
        lambda s, d: A.bfs(graph(s, d, "order_part", **SEARCH), 1, sentinel=True).state)
    # Many levels: orders and customers in turn.
    _query("bfs_levels_deep", f"{_bfs_ctes('order_cust', 1)} SELECT hops, count(*) AS vertices FROM s GROUP BY hops")(
        lambda s, d: A.bfs(graph(s, d, "order_cust", **SEARCH), 1).state.groupBy("hops").agg(F.count(F.lit(1)).alias("vertices")))
    for name, source, weighted, weight in (("sssp_weighted", "events_seq", True, "e.w"), ("sssp_weighted_deep", "order_part", True, "e.w"), ("sssp_hops", "order_part", False, "1")):
        root = 0 if source == "events_seq" else 1
        _query(name, f"{_sssp_ctes(source, weight, root)} SELECT id, distance FROM s")(
            lambda s, d, source=source, weighted=weighted, root=root: A.sssp(graph(s, d, source, weighted, **PATHS), root).state)
    cc = lambda s, d, source, **k: A.connected_components(graph(s, d, source, **UNDIRECTED), **k).state
    _query("cc_labels", f"{_cc_ctes('order_part')} SELECT id, label FROM s")(lambda s, d: cc(s, d, "order_part"))
    _query("cc_labels_plain", f"{_cc_ctes('order_part')} SELECT id, label FROM s")(lambda s, d: cc(s, d, "order_part", method="plain"))
    _query("cc_labels_deep", f"{_cc_ctes('order_cust')} SELECT id, label FROM s")(lambda s, d: cc(s, d, "order_cust"))
    _query("cc_sizes", f"{_cc_ctes('order_cust')} SELECT label, count(*) AS size FROM s GROUP BY label")(
        lambda s, d: cc(s, d, "order_cust").groupBy("label").agg(F.count(F.lit(1)).alias("size")))


def _reports() -> None:
    _query("checksum_deg", f"{_degree_sql('events_seq').replace('SELECT dom.id,', ', s AS (SELECT dom.id,', 1)}) {_total('degree', 'degree <> 0')}")(
        lambda s, d: R.checksum(A.degree(graph(s, d, "events_seq"))))
    _query("checksum_pr", f"{_pagerank_sql('events_seq', 20)}, s AS (SELECT * FROM pr) {_total('rank', 'rank <> 0')}")(
        lambda s, d: R.checksum(A.pagerank(graph(s, d, "events_seq"), 20).state))
    _query("checksum_bfs", f"{_bfs_ctes('order_part', 1)} {_total('hops', 'hops IS NOT NULL')}")(lambda s, d: R.checksum(A.bfs(graph(s, d, "order_part", **SEARCH), 1).state))
    _query("checksum_sssp", f"{_sssp_ctes('events_seq')} {_total('distance', 'distance IS NOT NULL')}")(
        lambda s, d: R.checksum(A.sssp(graph(s, d, "events_seq", True, **PATHS)).state))
    _query("checksum_cc", f"{_cc_ctes('order_part')} {_total('label', 'true')}")(
        lambda s, d: R.checksum(A.connected_components(graph(s, d, "order_part", **UNDIRECTED)).state))
    height = 1024
    _query("tile_histogram", f"{_ctes('order_part')} SELECT u // {height} AS row_group, v // {height} AS col_group, count(*) AS edges FROM e GROUP BY 1, 2")(
        lambda s, d: R.tile_histogram(graph(s, d, "order_part").edges, height))
    _query("edge_balance", f"""{_ctes('part_supp_raw')}, c AS (SELECT u // 64 AS k, count(*) AS n FROM e GROUP BY 1), x AS (SELECT unnest(range(0, 32)) AS k)
        SELECT x.k AS "group", coalesce(c.n, 0) AS edges, round(coalesce(c.n, 0) * 32 / CAST((SELECT count(*) FROM e) AS DOUBLE), 6) AS ratio,
            abs(coalesce(c.n, 0) * 32 / CAST((SELECT count(*) FROM e) AS DOUBLE) - 1) > 0.2 AS uneven FROM x LEFT JOIN c ON c.k = x.k""")(
        lambda s, d: R.balance(graph(s, d, "part_supp_raw").edges, 32, 64).withColumn("ratio", F.round("ratio", 6)))
    # 6 ranks of 4 threads: 24 groups, 2 ranks across, 12 down, gcd 2.
    own = "(i % 12 * 2 + j % 2 + i // 12 * 2) % 24"
    _query("tile_placement", f"""SELECT i AS row_group, j AS col_group, {own} AS owner, {own} % 6 AS rank, {own} // 6 AS thread
        FROM (SELECT unnest(range(0, 24)) AS i) CROSS JOIN (SELECT unnest(range(0, 24)) AS j)""")(lambda s, d: Tiling(6, 4).placement(s))
    h = BucketHash(15001, 8)
    deal = "CASE WHEN {v} >= {top} THEN {v} ELSE {v} // {low} + {v} % {low} * {high} END"
    hashed = deal.format(v="id", top=h.height * h.parts, low=h.parts, high=h.height)
    _query("bucket_hash_roundtrip", f"""SELECT DISTINCT o_custkey AS id, {hashed.replace('id', 'o_custkey')} AS hashed, o_custkey AS back FROM orders""")(
        lambda s, d: T.order_cust(s, d).select(F.col("dst").alias("id")).distinct().withColumn("hashed", h.hash(F.col("id"))).withColumn("back", h.unhash(F.col("hashed"))))


def _files() -> None:
    def new_path(spark, kind):
        return f"{shared_dir(spark)}/edges-{kind}-{uuid.uuid4().hex}"

    def written(spark, edges, kind):
        """A round trip through files in the shared folder."""
        path = new_path(spark, kind)
        {"text": E.write_text, "binary": E.write_binary}[kind](edges, path)
        return E.read_edges(spark, path, weighted=True)

    same = "{} SELECT u AS src, v AS dst, w AS weight FROM e"
    _query("text_roundtrip", same.format(_ctes("events_seq")))(lambda s, d: written(s, T.events_seq(s, d), "text"))
    _query("binary_roundtrip", same.format(_ctes("events_seq")))(lambda s, d: written(s, T.events_seq(s, d), "binary"))
    def lines(spark, *parts):
        """A text file of the given lines (column value), read again as an edge list."""
        path = new_path(spark, "lines")
        reduce(DataFrame.unionAll, [p.select("value") for p in parts]).write.text(path)
        return path

    def line(edges, *columns):
        return edges.select(F.concat_ws(" ", *columns).alias("value"))

    def noise(spark):
        """Comments and blank lines."""
        return spark.range(30).select(F.when(F.col("id") % 3 == 0, "# a comment").when(F.col("id") % 3 == 1, "% 1 2").otherwise("").alias("value"))

    _query("text_unweighted", f"{_ctes('order_cust')} SELECT u AS src, v AS dst FROM e")(
        lambda s, d: E.read_text(s, lines(s, line(T.order_cust(s, d), "src", "dst"), noise(s))))

    def malformed(s, d):
        e = T.order_cust(s, d)
        return E.read_text(s, lines(s, line(e.where("src % 2 = 0"), "src", "dst"), line(e.where("src % 2 = 1"), "src", "dst", "weight")), mode="DROPMALFORMED")

    _query("text_malformed_dropped", f"{_ctes('order_cust')} SELECT u AS src, v AS dst FROM e WHERE u % 2 = 0")(malformed)

    def loaded(s, d):
        e = T.order_cust(s, d)
        path = lines(s, line(e, "src", "dst", "weight"), noise(s))
        top = e.agg(F.max(F.greatest("src", "dst"))).first()[0]
        return Graph.load(s, path, top, weighted=True, expected_edges=T.order_cust(s, d).count()).edges

    _query("load_reconciled", f"{_ctes('order_cust')} SELECT u AS src, v AS dst, w AS weight FROM e")(loaded)

    def converted(s, d, report):
        source, target = lines(s, line(T.order_cust(s, d), "src", "dst", "weight"), noise(s)), new_path(s, "converted")
        said = E.convert(s, source, target, source_weighted=True, offset=3)
        return s.createDataFrame([said], "comments long, max_id long, edges long, lines long") if report else E.read_edges(s, target)

    _query("convert_file", f"{_ctes('order_cust')} SELECT u + 3 AS src, v + 3 AS dst FROM e")(lambda s, d: converted(s, d, False))
    _query("convert_report", f"{_ctes('order_cust')} SELECT 20 AS comments, max(greatest(u, v)) + 3 AS max_id, count(*) AS edges, count(*) + 20 AS lines FROM e")(
        lambda s, d: converted(s, d, True))
    _query("convert_offset", f"{_ctes('order_part')} SELECT u + 7 AS src, v + 7 AS dst, w AS weight FROM e")(lambda s, d: E.displace(T.order_part(s, d), 7))
    _query("convert_stats", f"{_ctes('order_part')} SELECT max(greatest(u, v)) AS max_id, count(*) AS edges FROM e")(lambda s, d: E.stats(T.order_part(s, d)))
    _query("convert_drop_weights", f"{_ctes('order_cust')} SELECT u AS src, v AS dst FROM e")(lambda s, d: T.order_cust(s, d).select("src", "dst"))
    _query("random_weights_range", f"{_ctes('order_cust')} SELECT count(*) AS edges, true AS in_range FROM e")(
        lambda s, d: E.with_weights(T.order_cust(s, d).select("src", "dst")).agg(
            F.count(F.lit(1)).alias("edges"), F.coalesce(F.every(F.col("weight").between(1, 128)), F.lit(True)).alias("in_range")))


def _custom() -> None:
    def largest(s, d):
        """The largest id from which a vertex is reachable against the edges, itself included."""
        return run(graph(s, d, "part_supp_raw", **PATHS), VertexProgram(
            init={"top": F.col("id")}, message=F.col("top"), combine=F.max, apply=lambda _: {"top": F.greatest("top", "acc")}, changed=F.col("new_top") > F.col("top"))).state

    _query("custom_max_label", f"""{_ctes('part_supp_raw', _PATHS_SQL)}, b(id, top) USING KEY (id) AS (SELECT id, id FROM dom UNION
        SELECT e.u, max(b.top) FROM b JOIN e ON e.v = b.id LEFT JOIN recurring.b o ON o.id = e.u GROUP BY e.u HAVING max(b.top) > any_value(o.top))
        SELECT id, top FROM b""")(largest)

    def widest(s, d):
        """The largest bottleneck of a path from vertex 0."""
        return run(graph(s, d, "events_seq", True, **PATHS), VertexProgram(
            init={"width": F.when(F.col("id") == 0, F.lit(A.INFINITY)).cast("long")}, active=F.col("width").isNotNull(), message=F.col("width"), ordering="col",
            edge_map=lambda msg, weight: F.least(msg, weight), combine=F.max, apply=lambda _: {"width": F.greatest("width", "acc")},
            changed=~F.col("width").eqNullSafe(F.col("new_width")))).state

    _query("custom_widest_path", f"""{_ctes('events_seq', _PATHS_SQL)}, b(id, width) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), CAST(2147483647 AS BIGINT) UNION
        SELECT e.v, max(least(b.width, e.w)) FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b o ON o.id = e.v GROUP BY e.v
        HAVING max(least(b.width, e.w)) > coalesce(any_value(o.width), -1))
        SELECT dom.id, b.width FROM dom LEFT JOIN b ON b.id = dom.id""")(widest)


for _add in (_degrees, _edges, _ranks, _searches, _reports, _files, _custom):
    _add()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
