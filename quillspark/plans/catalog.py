"""The registered queries over the given tables, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

import re
import string

import functools
import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.functions import fuzzy, scores, text as T
from quillspark.operators import clusters, community, dashboard, filters, keywords, listings, models, resolve, store, traverse, versions
from quillspark.plans.surrogate import NAMES, PAPERS, PROJECTS, cited, cites, cites_sql, linked, meta, papers, pieces, projects, table
from quillspark.session import shared_dir, stored
from quillspark.sources import bibtex as bib, index, normalize
from quillspark.streaming import ingest, jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def named(sql: str) -> str:
    """``sql`` with the names that DuckDB reserves in quotes; text literals stay as they are."""
    parts = sql.split("'")
    return "'".join(p if i % 2 else re.sub(r"\b(at|both)\b", r'"\1"', p) for i, p in enumerate(parts))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = named(sql)
        return f

    return register


def scored(spark, d) -> DataFrame:
    return papers(spark, d).withColumn("score", scores.composite_score())


LOG = "log10(1 + CAST(coalesce({0}, 0) AS DOUBLE))"
FLAG = "CAST(CASE WHEN {0} THEN 1 ELSE 0 END AS DOUBLE)"
PARTS = [LOG.format("citation_count"), FLAG.format("has_public_code"), FLAG.format("is_peer_reviewed"), "CAST(0 AS DOUBLE)", LOG.format("repo_stars")]
SCORED = f"WITH {PAPERS}, scored AS (SELECT *, round({' + '.join(PARTS)}, 2) AS score FROM papers)"


@query(f"WITH {PAPERS} SELECT ord, title, citation_count FROM papers WHERE (contains(lower(title), 'the') OR contains(lower(abstract), 'the')) AND (contains(lower(title), 'and') OR contains(lower(abstract), 'and')) ORDER BY citation_count DESC, ord LIMIT 100")
def keyword_and_search(spark, d):
    rows = papers(spark, d).where(T.matches_all(["The", "and"]))
    return filters.top(rows, 100, F.desc_nulls_last("citation_count"), F.col("ord")).select("ord", "title", "citation_count")


@query(f"WITH {PAPERS} SELECT ord FROM papers WHERE contains(lower(title || ' ' || abstract), 'que') OR contains(lower(title || ' ' || abstract), 'license')")
def keyword_or_match(spark, d):
    return papers(spark, d).where(T.matches_any(["Que", " ", "license"])).select("ord")


@query(f"{SCORED} SELECT ord, score FROM scored ORDER BY score DESC, ord LIMIT 50")
def score_topk(spark, d):
    return filters.top(scored(spark, d), 50, F.desc("score"), F.col("ord")).select("ord", "score")


@query(f"{SCORED} SELECT ord, round({PARTS[0]}, 2) AS citations, round({PARTS[1]}, 2) AS code, round({PARTS[2]}, 2) AS peer_reviewed, round({PARTS[4]}, 2) AS stars, round(round({PARTS[0]}, 2) + {PARTS[1]} + {PARTS[2]} + round({PARTS[4]}, 2), 2) AS score FROM scored")
def score_breakdown(spark, d):
    return papers(spark, d).select("ord", scores.score_breakdown().alias("b")).select("ord", "b.citations", "b.code", "b.peer_reviewed", "b.stars", "b.score")


@query(f"{SCORED} SELECT ord, title, score FROM scored WHERE year >= 2000 AND year <= 2020 AND coalesce(citation_count, 0) >= 100 AND is_open_access AND src_name IN ('arxiv', 'openalex', 'core') ORDER BY score DESC, ord LIMIT 10 OFFSET 10")
def filter_facets_sorted(spark, d):
    f = filters.Filters(min_year=2000, max_year=2020, min_citations=100, open_access_only=True, sources=["arxiv", "openalex", "core"])
    return filters.page(scored(spark, d).where(filters.predicate(f)), 2, 10, *filters.order()).select("ord", "title", "score")


@query(f"WITH {PAPERS} SELECT min(year) AS min_year, max(year) AS max_year, max(citation_count) AS max_citations FROM papers")
def range_bounds(spark, d):
    return filters.bounds(papers(spark, d))


def _rule_sql() -> str:
    low = "lower(title || ' ' || abstract)"
    s = {k: " + ".join(f"CAST(contains({low}, '{c}') AS INTEGER)" for c in v) for k, v in models.CUES.items()}
    best = f"greatest({', '.join(f'({x})' for x in s.values())})"
    return f"CASE WHEN trim(abstract) = '' OR {best} = 0 THEN NULL " + " ".join(f"WHEN {x} = {best} THEN '{k}'" for k, x in s.items()) + " END"


LABELS = ", ".join(f"('{x}')" for x in filters.ARCHETYPES)


@query(f"WITH {PAPERS}, l AS (SELECT {_rule_sql()} AS label FROM papers), c AS (SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY label), t AS (SELECT sum(n) AS t FROM c) SELECT v.label, coalesce(n, 0) AS n, CAST(CASE WHEN t > 0 THEN floor(100 * coalesce(n, 0) / t + 0.5) ELSE 0 END AS BIGINT) AS percent FROM (VALUES {LABELS}) v(label) LEFT JOIN c USING (label), t")
def archetype_distribution(spark, d):
    return filters.distribution(models.classified(papers(spark, d)), filters.ARCHETYPES)


@query(f"WITH {PAPERS} SELECT label, count(*) AS n FROM (SELECT lang AS label FROM papers WHERE lang IS NOT NULL UNION ALL SELECT source FROM papers WHERE source IS NOT NULL AND source <> coalesce(lang, '')) GROUP BY label")
def facet_counts(spark, d):
    p = papers(spark, d)
    return filters.facet_counts(p.select(p["keywords"][0].alias("a"), p["keywords"][1].alias("b")), "a", "b")


@query(f"WITH {PAPERS}, c AS (SELECT src_name AS source, count(*) AS n FROM papers GROUP BY 1) SELECT v.source, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({x!r})' for x in NAMES)}) v(source) LEFT JOIN c USING (source)")
def source_counts(spark, d):
    return filters.source_counts(papers(spark, d), NAMES)


@query(f"{SCORED}, g AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM scored), t AS (SELECT min(score) FILTER (r <= greatest(1, ceil(n * 0.01))) AS gold, min(score) FILTER (r <= greatest(1, ceil(n * 0.05))) AS silver FROM g) SELECT ord, score, CASE WHEN score >= gold THEN 'gold' WHEN score >= silver THEN 'silver' END AS tier FROM scored, t WHERE score >= silver")
def star_tiers(spark, d):
    return filters.star_tiers(scored(spark, d)).where("tier is not null").select("ord", "score", "tier")


# --- dashboard --------------------------------------------------------------------------------------------------------


@query(f"WITH {PROJECTS} SELECT p.project_id, p.name, coalesce(l.n, 0) AS n_library, coalesce(s.n, 0) AS n_searches, coalesce(greatest(l.at, s.at), l.at, s.at, updated_at) AS last_activity FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n, max(at) AS at FROM library GROUP BY 1) l USING (project_id) LEFT JOIN (SELECT project_id, count(*) AS n, max(at) AS at FROM searches GROUP BY 1) s USING (project_id)")
def dashboard_per_project(spark, d):
    t = projects(spark, d)
    held = {k: t[k] for k in ("library", "searches")}
    return dashboard.per_project(t["projects"], held, {"library": "at", "searches": "at"}).drop("updated_at")


@query(f"WITH {PROJECTS} SELECT 'projects' AS name, count(*) AS n FROM projects UNION ALL SELECT 'library', count(*) FROM library UNION ALL SELECT 'searches', count(*) FROM searches")
def dashboard_totals(spark, d):
    t = projects(spark, d)
    return dashboard.totals(t["projects"], {k: t[k] for k in ("library", "searches")})


@query(f"WITH {PROJECTS}, a AS (SELECT * FROM (SELECT 'library' AS kind, * FROM library ORDER BY at DESC, project_id, label LIMIT 15) UNION ALL SELECT * FROM (SELECT 'searches' AS kind, * FROM searches ORDER BY at DESC, project_id, label LIMIT 15)) SELECT a.kind, a.project_id, p.name AS project_name, a.label, a.at FROM a JOIN projects p USING (project_id) ORDER BY at DESC, kind, project_id, label LIMIT 15")
def dashboard_activity(spark, d):
    t = projects(spark, d)
    return dashboard.recent(t["projects"], {k: t[k] for k in ("library", "searches")})


@query("SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def dashboard_last_days(spark, d):
    e = projects(spark, d)["searches"]
    now = e.agg(F.max("at").alias("now"))
    rows = e.join(F.broadcast(now), F.col("at") >= F.col("now") - F.make_dt_interval(F.lit(7)))
    return rows.agg(F.count("*").alias("n"))


@query(f"WITH {PROJECTS}, n AS (SELECT project_id, count(*) AS n FROM library GROUP BY 1) SELECT project_id, n, CAST(greatest(2, round(100 * n / (SELECT max(n) FROM n))) AS BIGINT) AS width FROM n ORDER BY n DESC, project_id LIMIT 20")
def ranked_projects(spark, d):
    n = projects(spark, d)["library"].groupBy("project_id").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    rows = filters.top(n, 20, F.desc("n"), F.col("project_id")).join(F.broadcast(most), F.lit(True))
    return rows.select("project_id", "n", F.greatest(F.lit(2), F.round(100 * F.col("n") / F.col("most"))).cast("long").alias("width"))


# --- entity resolution ------------------------------------------------------------------------------------------------


def doubled(spark, d) -> DataFrame:
    """Papers and a copy of each from another source, its DOI written as a link, title in capitals, without abstract."""
    p = papers(spark, d)
    q = p.withColumns({
        "ord": F.col("ord") + (1 << 40), "doi": F.when(F.pmod("ord", F.lit(3)) < 2, F.concat(F.lit("https://doi.org/"), F.upper("doi"))), "title": F.translate("title", string.ascii_lowercase, string.ascii_uppercase), "abstract": F.lit(None).cast("string"),
        "citation_count": F.col("citation_count") * 2, "sources": F.array(F.lit("crossref")), "is_peer_reviewed": F.lit(True), "year": F.when(F.pmod("ord", F.lit(5)) > 0, F.col("year")),
    })
    return p.unionByName(q)


NORM_TITLE = "trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'))"
DOUBLED = f"""{PAPERS}, doubled AS (
  SELECT ord, doi, title, abstract, year, citation_count, src_name, is_peer_reviewed, repo_stars FROM papers
  UNION ALL
  SELECT ord + 1099511627776, CASE WHEN ord % 3 < 2 THEN 'https://doi.org/' || upper(doi) END, translate(title, '{string.ascii_lowercase}', '{string.ascii_uppercase}'), NULL, CASE WHEN ord % 5 > 0 THEN year END, citation_count * 2, 'crossref', true, repo_stars FROM papers
), keyed AS (
  SELECT ord, 'd' || trim(lower(regexp_replace(doi, '(?i)^https?://(?:dx\\.)?doi\\.org/', ''))) AS k FROM doubled WHERE doi IS NOT NULL
  UNION ALL SELECT ord, 't' || {NORM_TITLE} || '|' || coalesce(CAST(year AS VARCHAR), '-') FROM doubled WHERE {NORM_TITLE} <> ''
), firsts AS (SELECT k, min(ord) AS f FROM keyed GROUP BY k), links AS (SELECT DISTINCT f AS a, ord AS b FROM keyed JOIN firsts USING (k) WHERE f <> ord),
both AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT ord AS a, ord AS b FROM doubled UNION SELECT r.a, e.b FROM reach r JOIN both e ON r.b = e.a),
groups AS (SELECT a AS ord, min(b) AS group_id FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {DOUBLED} SELECT ord, group_id FROM groups")
def dedup_exact(spark, d):
    return resolve.closure_groups(doubled(spark, d))


@query()
def dedup_fuzzy_greedy(spark, d):
    return resolve.greedy_groups(doubled(spark, d))


@query(f"""WITH RECURSIVE {DOUBLED}, r AS (SELECT * FROM doubled JOIN groups USING (ord))
SELECT group_id AS ord, count(*) AS n_records, CASE WHEN count(*) = 1 THEN any_value(title) ELSE arg_min(title, coalesce(list_position(['crossref', 'openalex', 'semantic_scholar', 'europe_pmc', 'dblp', 'pubmed', 'arxiv', 'core'], src_name), 9) * 10000000000000 + ord) FILTER (title <> '') END AS title,
  CASE WHEN count(*) = 1 THEN any_value(citation_count) ELSE arg_min(citation_count, coalesce(list_position(['semantic_scholar', 'openalex', 'crossref', 'europe_pmc'], src_name), 5) * 10000000000000 + ord) FILTER (citation_count <> 0) END AS citation_count,
  CASE WHEN count(*) = 1 THEN any_value(abstract) ELSE arg_min(abstract, coalesce(list_position(['semantic_scholar', 'openalex', 'europe_pmc', 'arxiv', 'pubmed', 'core'], src_name), 7) * 10000000000000 + ord) FILTER (abstract <> '') END AS abstract,
  bool_or(is_peer_reviewed) AS is_peer_reviewed, max(repo_stars) AS repo_stars, array_to_string(list_sort(list_distinct(list(src_name))), ',') AS sources FROM r GROUP BY group_id""")
def merge_priority(spark, d):
    p = doubled(spark, d)
    m = resolve.merged(p, resolve.closure_groups(p))
    return m.select("ord", "n_records", "title", "citation_count", "abstract", "is_peer_reviewed", "repo_stars", F.array_join("sources", ",").alias("sources"))


@query(f"WITH RECURSIVE {DOUBLED} SELECT count(*) AS n_records, count(DISTINCT group_id) AS n_groups, count(*) - count(DISTINCT group_id) AS n_removed FROM groups")
def dedup_removed(spark, d):
    p = doubled(spark, d)
    return resolve.removed(p, resolve.closure_groups(p))


@query(f"""WITH {PAPERS}, b AS (SELECT ord % 10 AS project_id, ord AS at, '10.1000/' || (ord // 2) AS doi, CASE WHEN ord % 3 > 0 THEN title END AS t, repo_stars, src_name FROM papers)
SELECT project_id, doi, count(*) AS n, arg_min(t, at) FILTER (t IS NOT NULL) AS venue, max(repo_stars) AS repo_stars, array_to_string(list_sort(list_distinct(list(src_name))), ',') AS sources FROM b GROUP BY 1, 2""")
def upsert_fill(spark, d):
    p = papers(spark, d).withColumns({"project_id": F.pmod("ord", F.lit(10)), "doi": F.concat(F.lit("10.1000/"), F.floor(F.col("ord") / 2)), "venue": F.when(F.pmod("ord", F.lit(3)) > 0, F.col("title")), "reference_count": F.lit(1)})
    n = p.groupBy("project_id", "doi").agg(F.count("*").alias("n"))
    out = resolve.upserted(p.where("ord % 20 < 10"), p.where("ord % 20 >= 10"))
    return out.join(n, ["project_id", "doi"]).select("project_id", "doi", "n", "venue", "repo_stars", F.array_join("sources", ",").alias("sources"))


ORACLES["upsert_fill"] = ORACLES["upsert_fill"].replace('ord AS "at"', "(CASE WHEN ord % 20 < 10 THEN 0 ELSE 1 END) * 1000000000000 + ord AS \"at\"")


@query()
def fuzzy_title(spark, d):
    return fuzzy.best_match(table(spark, d, "part"), "p_name", "p_partkey", "blue part 17")


# --- citation graph ---------------------------------------------------------------------------------------------------


@query(f"WITH {cites_sql()} SELECT src AS id, count(*) AS reference_count FROM cites GROUP BY 1")
def citation_index(spark, d):
    return traverse.reference_counts(cites(spark, d))


SEEDS = ["7", "11", "part", "no such"]


@query(f"""WITH {cites_sql()}, w(query) AS (SELECT * FROM (VALUES ('7'), ('11')) UNION ALL SELECT upper(title) FROM meta WHERE id = 3 UNION ALL SELECT * FROM (VALUES ('no such'), ('a'), ('re')) UNION ALL SELECT substr(title, 2, 9) FROM meta WHERE id % 500 = 8),
q AS (SELECT DISTINCT query, lower(trim(query)) AS low FROM w), f AS (SELECT query, low, (SELECT CAST(arg_min(id, ord) AS VARCHAR) FROM meta WHERE lower(trim(title)) = low) AS id FROM q WHERE query NOT IN ('7', '11'))
SELECT query, query AS id FROM q WHERE query IN ('7', '11') UNION ALL SELECT query, id FROM f WHERE id IS NOT NULL UNION ALL
SELECT query, CAST(arg_max(m.id, (coalesce(m.n_citation, 0), -m.ord)) AS VARCHAR) FROM f, meta AS m WHERE f.id IS NULL AND contains(lower(m.title), low) GROUP BY query""")
def seed_resolve(spark, d):
    m = meta(spark, d).withColumn("id", F.col("id").cast("string"))
    wanted = spark.createDataFrame([(x,) for x in ("7", "11", "no such", "a", "re")], "query string").union(m.where("id = '3'").select(F.upper("title")))
    wanted = wanted.union(m.where("cast(id as long) % 500 = 8").select(F.substring("title", 2, 9)))
    return traverse.resolve_seeds(m, wanted)


def seeds(spark, d) -> DataFrame:
    return meta(spark, d).where("id % 500 = 7").select("id")


def _bfs_sql(sides: list[str], cap: int | None, keep: str = "true") -> str:
    rows = {"past": "SELECT 0 AS side, src AS at, dst AS other, src, dst FROM cites", "future": "SELECT 1 AS side, dst AS at, src AS other, src, dst FROM cites"}
    place = "row_number() OVER (PARTITION BY side, at ORDER BY CASE WHEN side = 0 THEN dst END, src, dst)"
    return f"""WITH {cites_sql()}, s AS ({' UNION ALL '.join(rows[x] for x in sides)}), r AS (SELECT *, {place} AS place FROM s),
near AS (SELECT DISTINCT at, other, src, dst FROM r JOIN meta ON other = id WHERE place <= {cap or 1 << 40} AND {keep}),
h0 AS (SELECT id FROM meta WHERE id % 500 = 7), h1 AS (SELECT DISTINCT other AS id FROM near JOIN h0 ON at = id WHERE other NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT other AS id FROM near JOIN h1 ON at = id WHERE other NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1)), nodes AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"""


@query(_bfs_sql(["past", "future"], 5) + " SELECT id, hop FROM nodes")
def bfs_khop(spark, d):
    return traverse.explore(cites(spark, d), meta(spark, d), seeds(spark, d), 2, cap=5)[0]


@query(_bfs_sql(["past"], 4) + " SELECT DISTINCT src, dst FROM near JOIN (SELECT id FROM nodes WHERE hop < 2) ON at = id")
def explore_past(spark, d):
    return traverse.explore(cites(spark, d), meta(spark, d), seeds(spark, d), 2, "past", cap=4)[1]


@query(_bfs_sql(["future"], 4) + " SELECT id, hop FROM nodes")
def explore_future(spark, d):
    return traverse.explore(cites(spark, d), meta(spark, d), seeds(spark, d), 2, "future", cap=4)[0]


@query(_bfs_sql(["past", "future"], 8, "(contains(lower(title || ' ' || abstract), 'brand#1') OR contains(lower(title || ' ' || abstract), 'brand#2'))") + " SELECT id, hop FROM nodes")
def explore_keyword(spark, d):
    return traverse.explore(cites(spark, d), meta(spark, d), seeds(spark, d), 2, cap=8, keywords=["Brand#1", "Brand#2"])[0]


@query(f"WITH {cites_sql()} SELECT c.src, c.dst FROM cites c JOIN meta a ON a.id = c.src JOIN meta b ON b.id = c.dst WHERE contains(lower(a.title || ' ' || a.abstract), '1') AND contains(lower(b.title || ' ' || b.abstract), '1')")
def induced_subgraph(spark, d):
    return traverse.induced(cites(spark, d), meta(spark, d).where(T.matches_any(["1"])))


@query(f"WITH {cites_sql()} SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM cites GROUP BY 1, 2")
def undirected_edges(spark, d):
    return traverse.undirected(cites(spark, d))


@query(f"WITH {cites_sql()}, c AS (SELECT src, dst FROM cites), ids AS (SELECT id, ord FROM meta) SELECT DISTINCT src, dst FROM c JOIN ids a ON a.id = src JOIN ids b ON b.id = dst")
def reference_graph(spark, d):
    m, c = meta(spark, d), cites(spark, d)
    refs = c.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.concat(F.lit("P"), F.col("dst"))).alias("references"))
    rows = m.join(refs, "id", "left").select("ord", F.concat(F.lit("p"), F.col("id")).alias("doi"), F.coalesce("references", F.array()).alias("references"), F.array().cast("array<string>").alias("referenced_by"))
    return traverse.reference_graph(rows, ["doi"])


# --- communities ------------------------------------------------------------------------------------------------------


def brand_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """One graph of the parts, citations as edges."""
    pairs = traverse.undirected(cited(spark, d), pieces(spark, d)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes, edges = traverse.reindexed(meta(spark, d), pairs)
    nodes, edges = nodes.select("id", "idx", "p_brand"), stored(edges)
    edges = edges.select(F.lit("parts").alias("graph_id"), "source", "target", F.lit(1.0).alias("weight"), (F.col("source") * (1 << 32) + F.col("target")).alias("ord"))
    return nodes.withColumn("graph_id", F.lit("parts")), edges


BRANDS = f"""{cites_sql()}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM cites JOIN meta m ON m.id = src JOIN meta n ON n.id = dst),
at AS (SELECT id AS node, p_brand AS c FROM meta), k AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1)"""


@query(f"WITH {BRANDS} SELECT node, CAST(k AS DOUBLE) AS degree FROM k")
def weighted_degree(spark, d):
    nodes, edges = brand_graph(spark, d)
    return community.degrees(edges).join(nodes.select(F.col("idx").alias("node"), "id"), "node").select(F.col("id").alias("node"), "degree")


@query(f"WITH {BRANDS}, m AS (SELECT sum(k) AS m2 FROM k) SELECT round(sum(2 * (1 - 0.5 * x.k * y.k / m2) / m2), 9) AS modularity FROM e JOIN k x ON x.node = a JOIN k y ON y.node = b JOIN at p ON p.node = a JOIN at q ON q.node = b, m WHERE p.c = q.c")
def modularity(spark, d):
    nodes, edges = brand_graph(spark, d)
    at = nodes.select("graph_id", F.col("idx").alias("node"), F.xxhash64("p_brand").alias("community"))
    return community.modularity(edges, at, 0.5).select(F.round("modularity", 9).alias("modularity"))


@query(f"WITH {BRANDS} SELECT least(p.c, q.c) AS a, greatest(p.c, q.c) AS b, count(*) AS n FROM e JOIN at p ON p.node = a JOIN at q ON q.node = b WHERE p.c <> q.c GROUP BY 1, 2")
def cluster_edges(spark, d):
    edges = traverse.undirected(cites(spark, d)).select(F.col("a").alias("source"), F.col("b").alias("target"))
    return clusters.cluster_edges(edges, meta(spark, d).select(F.col("id").alias("node"), F.col("p_brand").alias("community")))


def brand_graphs(spark, d) -> tuple[DataFrame, DataFrame]:
    """A graph for each brand: its parts, linked where one order holds both or a part cites another; a pair is one link, however often it is held or cited.

    Links to parts of another brand are in no brand's graph. An order's parts of a brand meet by an equi-join, so a large order spreads.
    """
    m = meta(spark, d).select("id", F.col("p_brand").alias("graph_id"))
    nodes = stored(m.withColumn("idx", F.row_number().over(W.partitionBy("graph_id").orderBy("id")) - 1))
    held = linked(spark, d).join(community.aside(nodes.withColumnRenamed("id", "part")), "part")
    first, second = (held.select("order", "graph_id", F.col("idx").alias(x)) for x in ("source", "target"))
    # A hash of one side takes half the time of sorting both.
    pairs = first.join(second.hint("shuffle_hash"), ["order", "graph_id"]).where("source < target").select("graph_id", "source", "target").distinct()
    edges = pairs.select("graph_id", "source", "target", F.lit(1.0).alias("weight"), (F.col("source") * (1 << 32) + F.col("target")).alias("ord"))
    return nodes, stored(edges)


@query()
def louvain_levels(spark, d):
    return community.louvain(*brand_graphs(spark, d))


@query("SELECT p_brand AS graph_id, true AS nested, true AS rising FROM part GROUP BY p_brand")
def louvain_nested(spark, d):
    nodes, edges = brand_graphs(spark, d)
    paths = community.louvain_paths(nodes, edges)
    q = community.modularities(paths, edges).withColumn("before", F.lag("modularity").over(W.partitionBy("graph_id").orderBy("level")))
    rising = q.groupBy("graph_id").agg(F.bool_and(F.coalesce(F.col("before") <= F.col("modularity") + 1e-9, F.lit(True))).alias("rising"))
    return community.nested_paths(paths).join(rising, "graph_id", "left").select("graph_id", "nested", F.coalesce("rising", F.lit(True)).alias("rising"))


@query()
def lane_order(spark, d):
    nodes, edges = brand_graphs(spark, d)
    top = community.at_level(community.louvain(nodes, edges), 0)
    sizes = top.groupBy("graph_id", "community").agg(F.count("*").alias("size"), F.bool_or("is_misc").alias("is_misc"))
    ends = edges.join(top.select("graph_id", F.col("node").alias("source"), F.col("community").alias("a")), ["graph_id", "source"]).join(top.select("graph_id", F.col("node").alias("target"), F.col("community").alias("b")), ["graph_id", "target"])
    return community.lanes(sizes, ends.where("a <> b").groupBy("graph_id", "a", "b").agg(F.count("*").alias("n")))


def type_levels(spark, d) -> tuple[DataFrame, DataFrame]:
    """A fixed dendrogram of parts: brand below, first letter group of the brand above; nodes with score, year and title."""
    m = meta(spark, d)
    nodes = m.select(F.col("id").alias("node"), scores.rep_score("n_citation").alias("score"), "title", "ord", (F.pmod("id", F.lit(40)) + 1980).alias("year"))
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    base = m.select(F.lit(0).alias("level"), F.col("id").alias("node"), number.alias("community"))
    return base.union(m.select(F.lit(1), F.col("id"), F.floor(number / 10))), nodes


TYPE = """m AS (SELECT p_partkey AS node, p_name AS title, p_partkey AS ord, round(log10(1 + CAST(p_size AS DOUBLE)), 2) AS score, CAST(p_partkey % 40 + 1980 AS BIGINT) AS year, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS b FROM part),
levels AS (SELECT 0 AS level, node, b AS community FROM m UNION ALL SELECT 1, node, b // 10 FROM m),
reps AS (SELECT level, community, arg_max(node, score * 1000000000 - node) AS rep, count(*) AS size FROM levels JOIN m USING (node) GROUP BY 1, 2)"""


@query(f"WITH {TYPE} SELECT level, community, rep, size FROM reps")
def cluster_representatives(spark, d):
    return clusters.representatives(*type_levels(spark, d))


@query(f"WITH {TYPE}, rl AS (SELECT rep AS node, max(level) AS rep_level FROM reps GROUP BY 1), q AS (SELECT l.community AS lane, node, coalesce(rep_level, -1) AS rep_level, score FROM m JOIN levels l USING (node) LEFT JOIN rl USING (node) WHERE level = 1 AND year = 1990 AND node % 7 <> 0) SELECT lane, node, rep_level, CAST(row_number() OVER (PARTITION BY lane ORDER BY rep_level DESC, score DESC, node) AS INTEGER) AS place FROM q")
def year_queue(spark, d):
    levels, nodes = type_levels(spark, d)
    return clusters.year_queues(levels, nodes, levels.where("level = 1"), nodes.where("node % 7 = 0"), 1990)


@query(f"WITH {TYPE}, {cites_sql()}, e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM cites GROUP BY 1, 2), x AS (SELECT p.b // 10 AS t1, q.b // 10 AS t2, p.b AS s1, q.b AS s2 FROM e JOIN m p ON p.node = e.a JOIN m q ON q.node = e.b WHERE p.b // 10 <> q.b // 10), y AS (SELECT least(t1, t2) AS a, greatest(t1, t2) AS b, CASE WHEN t1 < t2 THEN s1 ELSE s2 END AS sa, CASE WHEN t1 < t2 THEN s2 ELSE s1 END AS sb, count(*) AS k FROM x GROUP BY 1, 2, 3, 4), z AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY k DESC, sa, sb) AS r, sum(k) OVER (PARTITION BY a, b) AS n FROM y) SELECT a, b, CAST(n AS BIGINT) AS n, sa AS sub_a, sb AS sub_b, ra.rep AS rep_a, rb.rep AS rep_b FROM z JOIN reps ra ON ra.level = 0 AND ra.community = sa JOIN reps rb ON rb.level = 0 AND rb.community = sb WHERE r = 1")
def bridges(spark, d):
    levels, nodes = type_levels(spark, d)
    edges = traverse.undirected(cites(spark, d)).select(F.col("a").alias("source"), F.col("b").alias("target"))
    top = levels.where("level = 1").select("node", "community", F.lit(False).alias("is_misc"))
    return clusters.bridges(edges, top, levels.where("level = 0").select("node", "community"), nodes)


@query(f"WITH {TYPE}, f AS (SELECT b AS community, count(*) AS n, list(title ORDER BY ord)[1:3] AS t FROM m GROUP BY 1), h AS (SELECT community // 10 AS community, count(*) AS n, list(t[1] ORDER BY community)[1:3] AS t FROM f GROUP BY 1) SELECT 0 AS level, community, t[1] AS title, 'A group of ' || n || ' related paper' || CASE WHEN n = 1 THEN '' ELSE 's' END || '. Representative works: ' || array_to_string(t, '; ') || '.' AS summary FROM f UNION ALL SELECT 1, community, t[1], 'A broader area grouping ' || n || ' sub-cluster' || CASE WHEN n = 1 THEN '' ELSE 's' END || ': ' || array_to_string(t, '; ') || '.' FROM h")
def cluster_summaries(spark, d):
    levels, nodes = type_levels(spark, d)
    return clusters.hierarchy(levels, nodes)


@query(f"WITH {TYPE} SELECT b AS community, count(*) AS papers, count_if(node % 3 = 0) AS shown, count_if(score >= 1.6) AS gold, count_if(score < 1.6 AND score >= 1.2) AS silver FROM m GROUP BY 1")
def cluster_kpis(spark, d):
    levels, nodes = type_levels(spark, d)
    tiers = nodes.select("node", F.when(F.col("score") >= 1.6, "gold").when(F.col("score") >= 1.2, "silver").alias("tier"))
    return clusters.kpis(levels.where("level = 0"), nodes, nodes.where("node % 3 = 0"), tiers)


@query(f"WITH {TYPE}, y AS (SELECT DISTINCT year FROM m), x AS (SELECT year, dense_rank() OVER (ORDER BY year) - 1 AS x FROM y) SELECT node, b AS lane, x, (row_number() OVER (PARTITION BY b, year ORDER BY score DESC, node) - 1) - (count(*) OVER (PARTITION BY b, year) - 1) / 2 AS y FROM m JOIN x USING (year)")
def grid_cells(spark, d):
    levels, nodes = type_levels(spark, d)
    rows = nodes.join(levels.where("level = 0").select("node", F.col("community").alias("lane")), "node")
    return clusters.cells(rows).withColumn("x", F.col("x").cast("long"))


@query(f"WITH {TYPE} SELECT DISTINCT year FROM m WHERE node % 11 <> 0")
def expandable_years(spark, d):
    levels, nodes = type_levels(spark, d)
    return clusters.expandable_years(nodes, nodes.where("node % 11 = 0"))


# --- text -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[\\s()\"]+'), x -> x <> '' AND x NOT IN ('AND', 'OR', 'NOT')), ' ') AS stripped, list_has_any(string_split_regex(text, '\\s+'), ['AND', 'OR', 'NOT']) AS has_operators FROM documents".replace("x -> ", "lambda x: "))
def strip_boolean(spark, d):
    unquoted = F.replace("text", F.lit('"'), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", T.strip_boolean(unquoted).alias("stripped"), T.has_boolean_operators("text").alias("has_operators"))


def _build_sql() -> str:
    first = "list_slice(k, 1, greatest(1, CAST(round_even(len(k) * (CASE WHEN len(k) <= 3 THEN 0.8 WHEN len(k) <= 6 THEN 0.5 ELSE least(0.3, 3.0 / len(k)) END), 0) AS INTEGER)))"
    return f"""WITH k AS (SELECT p_partkey, list_slice(string_split(p_name || ' ' || p_type, ' '), 1, CAST(1 + p_partkey % 7 AS INTEGER)) AS k FROM part),
a AS (SELECT p_partkey, k, {first} AS must FROM k), b AS (SELECT *, list_slice(k, len(must) + 1, len(k)) AS rest FROM a)
SELECT p_partkey, CASE WHEN len(rest) = 0 THEN array_to_string(must, ' AND ') ELSE '(' || array_to_string(must, ' AND ') || ') AND (' || array_to_string(rest, ' OR ') || ')' END AS arxiv,
CASE WHEN len(rest) = 0 THEN array_to_string(must, ' ') ELSE array_to_string(must, ' ') || ' ' || array_to_string(rest, ' ') END AS dblp FROM b"""


@query(_build_sql())
def build_query(spark, d):
    words = F.slice(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), F.lit(1), (1 + F.pmod("p_partkey", F.lit(7))).cast("int"))
    rows = table(spark, d, "part").withColumn("k", words)
    return rows.select("p_partkey", T.build_query("k", F.lit("arxiv")).alias("arxiv"), T.build_query("k", F.lit("dblp")).alias("dblp"))


@query(f"WITH {PAPERS} SELECT ord, lower(lang) || CAST(year AS VARCHAR) || lower(regexp_replace(coalesce(string_split_regex(nullif(trim(title), ''), '\\s+')[1], 'untitled'), '[^A-Za-z0-9]', '', 'g')) AS cite_key FROM papers")
def cite_keys(spark, d):
    return papers(spark, d).select("ord", T.cite_key("authors", "year", "title").alias("cite_key"))


@query(f"""WITH {PAPERS}, f AS (SELECT *, CASE WHEN coalesce(journal, '') <> '' THEN 'article' WHEN coalesce(venue, '') <> '' THEN 'inproceedings' ELSE 'misc' END AS kind, lower(lang) || CAST(year AS VARCHAR) || lower(regexp_replace(coalesce(string_split_regex(nullif(trim(title), ''), '\\s+')[1], 'untitled'), '[^A-Za-z0-9]', '', 'g')) AS key FROM papers)
SELECT ord, '@' || kind || '{{' || key || ',' || chr(10) || concat_ws(chr(10), '  title          = {{' || replace(replace(nullif(title, ''), '{{', '\\{{'), '}}', '\\}}') || '}}', '  author         = {{Ann ' || upper(left(lang, 1)) || substr(lang, 2) || '}}', '  year           = {{' || year || '}}',
CASE WHEN kind = 'article' THEN '  journal        = {{' || journal || '}}' END, CASE WHEN kind = 'inproceedings' THEN '  booktitle      = {{' || venue || '}}' END, '  doi            = {{' || doi || '}}') || chr(10) || '}}' AS bibtex FROM f""")
def bibtex(spark, d):
    return models.attached_bibtex(papers(spark, d)).select("ord", "bibtex")


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9-]+')) AS w FROM documents) WHERE len(w) >= 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ") GROUP BY 1")
def phrase_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.candidate_phrases("text")).alias("p")).select(F.explode(F.split("p", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9-]+'), lambda w: w <> '') AS w FROM documents),
e AS (SELECT doc_id, i, w[i] AS w FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)), m AS (SELECT *, len(w) < 2 OR w IN ({STOP}) AS stop FROM e),
g AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m), p AS (SELECT doc_id, g, list(w ORDER BY i) AS ws, min(i) AS pos FROM g WHERE NOT stop GROUP BY 1, 2),
f AS (SELECT doc_id, w, count(*) AS f FROM g WHERE NOT stop GROUP BY 1, 2), d AS (SELECT doc_id, ws[1:4] AS ws, min(pos) AS pos FROM p GROUP BY doc_id, p.ws),
s AS (SELECT doc_id, pos, ws, sum(f) * len(ws) AS score FROM (SELECT doc_id, pos, ws, unnest(ws) AS w FROM d) JOIN f USING (doc_id, w) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM s) SELECT doc_id AS id, string_agg(array_to_string(ws, ' '), '; ' ORDER BY r) AS keywords FROM r WHERE r <= 10 GROUP BY 1""")
def rake_keywords(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.candidate_phrases("text").alias("phrases"))
    return filters.keyword_ranking(rows, "doc_id", "phrases").select("id", F.array_join("keywords", "; ").alias("keywords"))


@query("SELECT page_id, regexp_matches(html, '(?i)(?:" + T.DATASET_HOSTS + "|" + T.DATASET_PHRASES + ")') AS has_dataset, 'https://github.com/' || regexp_replace(regexp_replace(nullif(regexp_extract(html, '" + T.GITHUB + "', 1), ''), '\\.(git|zip|tar\\.gz)$', ''), '\\.+$', '') AS repo FROM pages")
def code_signals(spark, d):
    return table(spark, d, "pages").select("page_id", T.has_dataset("html").alias("has_dataset"), T.repo_url(F.lit(None).cast("string"), "html").alias("repo"))


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), ' ') AS abstract FROM documents")
def inverted_abstract(spark, d):
    """Each text as an index of words to positions, made where the text is, and read back."""

    def indexed(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = b.slice(at, 64)
                found = []
                for text in rows["text"].to_pylist():
                    places: dict[str, list[int]] = {}
                    for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", text or "")):
                        places.setdefault(w, []).append(i)
                    found.append(list(places.items()))
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(found, pa.map_(pa.string(), pa.list_(pa.int32())))], ["doc_id", "index"])

    rows = table(spark, d, "documents").select("doc_id", "text")
    rows = rows.mapInArrow(indexed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, index map<string,array<int>>")
    return rows.select("doc_id", F.coalesce(normalize.abstract_from_index(F.col("index")), F.lit("")).alias("abstract"))


def _landed(spark, d, **fields) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("raw"))


@query("SELECT doc_id AS ord, '10.1/' || doc_id AS doi, text AS title, 'A ' || source AS author, CAST(1990 + doc_id % 30 AS INTEGER) AS year, doc_id % 2 = 0 AS is_peer_reviewed, n_chars AS citation_count FROM documents")
def source_crossref(spark, d):
    i = F.col("doc_id")
    kind = F.when(F.pmod(i, F.lit(2)) == 0, "journal-article").otherwise("dataset")
    raw = _landed(spark, d, DOI=F.concat(F.lit(" 10.1/"), i, F.lit(" ")), title=F.array(F.col("text")), author=F.array(F.struct(F.lit("A").alias("given"), F.col("source").alias("family"))), published=F.struct(F.array(F.array(1990 + F.pmod(i, F.lit(30)))).alias("date-parts")), type=kind, **{"is-referenced-by-count": F.col("n_chars")})
    return normalize.from_landed(raw, "crossref", "raw").select("ord", "doi", "title", F.col("authors")[0]["name"].alias("author"), "year", "is_peer_reviewed", "citation_count")


@query("SELECT doc_id AS ord, text AS title, array_to_string(['a ' || lang, 'b'], ';') AS authors, doc_id % 3 = 0 AS is_open_access, CASE WHEN doc_id % 2 = 0 THEN CAST(1990 + doc_id % 30 AS INTEGER) END AS year FROM documents")
def source_europe_pmc(spark, d):
    i = F.col("doc_id")
    raw = _landed(spark, d, title=F.col("text"), authorString=F.concat(F.lit("a "), F.col("lang"), F.lit(", b,.")), isOpenAccess=F.when(F.pmod(i, F.lit(3)) == 0, "Y").otherwise("N"), pubYear=F.when(F.pmod(i, F.lit(2)) == 0, (1990 + F.pmod(i, F.lit(30))).cast("string")).otherwise("n.d."))
    return normalize.from_landed(raw, "europe_pmc", "raw").select("ord", "title", F.array_join(F.transform("authors", lambda a: a["name"]), ";").alias("authors"), "is_open_access", "year")


# --- events and labels ------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return ingest.tumbling(table(spark, d, "events")).withColumns({"total": F.round("total", 4), "window_start": F.col("window_start").cast("timestamp_ntz")})


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, s")
def events_sessions(spark, d):
    rows = ingest.sessions(table(spark, d, "events"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("WITH l AS (SELECT quality AS t, toxic AS g FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), s AS (SELECT t, count(*) AS support, count_if(t = g) AS hit FROM l GROUP BY t), p AS (SELECT g AS t, count(*) AS guessed FROM l GROUP BY g), f AS (SELECT *, 2.0 * hit / (support + coalesce(guessed, 0)) AS f1 FROM s LEFT JOIN p USING (t)) SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hit) / sum(support), 9) AS accuracy, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM f")
def label_metrics(spark, d):
    rows = table(spark, d, "labels").where("quality is not null and toxic is not null")
    return models.metrics(rows, "quality", "toxic").withColumns({c: F.round(c, 9) for c in ("accuracy", "weighted_f1")})


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_state(spark, d):
    return store.latest(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("WITH s AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT event_id, event_id = first AND event_type <> 'error' AS accepted FROM events JOIN s USING (user_id, event_type)")
def unique_insert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("ord"))
    taken = e.where("event_type = 'error'").select("user_id", "event_type")
    accepted, rejected = store.insert_unique(taken, e, ["user_id", "event_type"])
    return accepted.select(F.col("ord").alias("event_id"), F.lit(True).alias("accepted")).union(rejected.select("ord", F.lit(False)))


@query("SELECT c_custkey, c_name, coalesce(max(o_orderdate), DATE '1990-01-01') AS last_used_at, 1 + count(o_orderkey) AS use_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def touched_items(spark, d):
    items = table(spark, d, "customer").select("c_custkey", "c_name", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("last_used_at"), F.lit(1).alias("use_count"))
    uses = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return store.touched(items, uses, "c_custkey")


@query("WITH o AS (SELECT o_custkey AS project_id, o_orderpriority AS label, o_orderkey FROM orders WHERE o_custkey % 10 <> 3), c AS (SELECT c_custkey AS project_id FROM customer WHERE c_custkey % 10 <> 3) SELECT 'library' AS name, count(*) AS n FROM o UNION ALL SELECT 'projects', count(*) FROM c")
def cascade_delete(spark, d):
    t = projects(spark, d)
    left = store.delete_projects({k: t[k] for k in ("projects", "library")}, t["projects"].where("project_id % 10 = 3"))
    return dashboard.totals(left["projects"], {"library": left["library"]})


# --- display, layout and settings -------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT *, round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) // 1000 / 1000.0) AS s FROM events), m AS (SELECT *, round(s / 60) AS m FROM s), h AS (SELECT *, round(m / 60) AS h FROM m), a AS (SELECT *, round(h / 24) AS a FROM h)
SELECT event_id, CASE WHEN len(event_type) <= 5 THEN event_type ELSE rtrim(left(event_type, 4)) || '…' END AS short,
CASE WHEN s < 45 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || 'm ago' WHEN h < 24 THEN CAST(h AS BIGINT) || 'h ago' WHEN a < 30 THEN CAST(a AS BIGINT) || 'd ago' WHEN a < 345 THEN CAST(round(a / 30) AS BIGINT) || 'mo ago' ELSE CAST(round(round(a / 30) / 12) AS BIGINT) || 'y ago' END AS age,
CASE WHEN event_id % 10 >= 7 THEN 'high' WHEN event_id % 10 >= 4 THEN 'medium' ELSE 'low' END AS bucket FROM a""")
def display_functions(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.select("event_id", T.truncated("event_type", 5).alias("short"), T.relative_time("ts", now).alias("age"), T.score_bucket(F.pmod("event_id", F.lit(10)) / 10).alias("bucket"))


@query(f"WITH {TYPE} SELECT b AS community, node, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, title, node) AS INTEGER) AS place, node = first_value(node) OVER (PARTITION BY b ORDER BY score DESC, node) AS is_rep FROM m")
def cluster_members(spark, d):
    return clusters.members(*type_levels(spark, d), 0)


@query(f"WITH {TYPE}, p AS (SELECT node, node % 5 AS level, node AS ord FROM m WHERE node % 9 = 0) SELECT b AS community, arg_max(p.node, p.level * 1000000000 - p.ord) AS parent FROM p JOIN m USING (node) GROUP BY 1")
def parent_links(spark, d):
    levels, nodes = type_levels(spark, d)
    placed = nodes.where("node % 9 = 0").select("node", F.pmod("node", F.lit(5)).alias("level"), F.col("node").alias("ord"))
    return clusters.parent_links(placed, levels.where("level = 0").select("node", "community"))


@query(f"""WITH {TYPE}, placed AS (SELECT node FROM m WHERE node % 97 = 0), me AS (SELECT level, community FROM levels WHERE node = 11),
up AS (SELECT 1 AS level, r.rep AS node FROM reps r WHERE r.level = 0 AND r.community IN (SELECT l.community FROM levels l WHERE l.level = 0 AND l.node IN (SELECT node FROM levels WHERE level = 1 AND community = (SELECT community FROM me WHERE level = 1)))),
leaf AS (SELECT 0 AS level, node FROM levels WHERE level = 0 AND community = (SELECT community FROM me WHERE level = 0)),
free AS (SELECT DISTINCT * FROM (SELECT * FROM up UNION ALL SELECT * FROM leaf) WHERE node <> 11 AND node NOT IN (SELECT node FROM placed)) SELECT node, level FROM free WHERE level = (SELECT max(level) FROM free)""")
def sibling_recommendations(spark, d):
    levels, nodes = type_levels(spark, d)
    return clusters.siblings(levels, nodes, nodes.where("node % 97 = 0"), 11)


@query(f"WITH {TYPE}, h AS (SELECT b AS lane, count(*) AS height FROM m GROUP BY 1) SELECT lane, coalesce(CAST(sum(height) OVER (ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS top FROM h")
def lane_tops(spark, d):
    levels, _ = type_levels(spark, d)
    heights = levels.where("level = 0").groupBy(F.col("community").alias("lane")).agg(F.count("*").alias("height"))
    return clusters.lane_offsets(heights)


@query("WITH w AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) SELECT year, CAST(CASE WHEN year < 1996 THEN 0 WHEN year >= 2000 THEN 10 ELSE (year - 1996) * 10.0 / 4 END AS DOUBLE) AS x FROM w")
def year_positions(spark, d):
    axis = spark.createDataFrame([(1996, 0.0), (2000, 10.0)], "year int, x double")
    return clusters.year_position(axis, table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct())


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 1.0) AS code, 1.0::DOUBLE AS citations FROM events")
def project_settings(spark, d):
    raw = F.replace(F.col("props"), F.lit('"k"'), F.lit('"code"'))
    return table(spark, d, "events").select("event_id", scores.weights_from_json(raw).alias("w")).select("event_id", "w.code", "w.citations")


@query(f"WITH {PAPERS} SELECT ord, CASE WHEN regexp_matches(abstract, '(?i)(?:{T.DATASET_HOSTS}|{T.DATASET_PHRASES})') THEN true ELSE false END AS has_dataset, coalesce(has_public_code, false) AS has_public_code, 0::BIGINT AS repo_stars FROM papers")
def enriched_papers(spark, d):
    return models.enriched(papers(spark, d)).select("ord", "has_dataset", "has_public_code", "repo_stars")


def chained(spark, d) -> DataFrame:
    """Threes of untitled papers: one with a DOI, one with an arXiv id, one with both. In sequence the third joins the first, though it shares a key with the second too."""
    p, k, third = papers(spark, d), F.floor(F.col("ord") / 3), F.pmod("ord", F.lit(3))
    return p.withColumns({"title": F.lit(""), "doi": F.when(third != 1, F.concat(F.lit("10.1/"), k)), "arxiv_id": F.when(third != 0, F.concat(F.lit("x"), k))})


@query(f"WITH {PAPERS}, g AS (SELECT ord, src_name, ord // 3 AS k, CASE WHEN ord % 3 = 2 THEN 1 ELSE 0 END AS third FROM papers), t AS (SELECT k, list(ord ORDER BY ord) AS o, list(src_name ORDER BY ord) AS s FROM g GROUP BY k) SELECT CASE WHEN ord % 3 = 2 AND list_contains(o, 3 * k) THEN 3 * k WHEN ord % 3 = 2 AND list_contains(o, 3 * k + 1) THEN 3 * k + 1 ELSE ord END AS ord, array_to_string(list_sort(list_distinct(list(src_name))), ',') AS sources FROM g JOIN t USING (k) GROUP BY 1")
def first_kept(spark, d):
    return resolve.first_kept(chained(spark, d)).select("ord", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {PAPERS} SELECT ord % 2 AS project_id, '10.1/' || (ord // 6) AS doi, 'x' || (ord // 6) AS arxiv_id, count(*) AS n_records, max(repo_stars) AS repo_stars FROM papers WHERE ord // 6 IN (SELECT ord // 6 FROM papers GROUP BY 1 HAVING count(*) = 6) GROUP BY 1, 2, 3")
def upsert_chain(spark, d):
    """In each project: a stored paper with an arXiv id, then a record that adds its DOI, then one with that DOI alone; all three are one paper."""
    p, k, place = papers(spark, d), F.floor(F.col("ord") / 6), F.floor(F.pmod("ord", F.lit(6)) / 2)
    whole = p.groupBy(k.alias("k")).agg(F.count("*").alias("n")).where("n = 6").select("k")
    p = p.withColumn("k", k).join(whole, "k", "left_semi").withColumns({
        "project_id": F.pmod("ord", F.lit(2)), "doi": F.when(place > 0, F.concat(F.lit("10.1/"), "k")), "arxiv_id": F.when(place < 2, F.concat(F.lit("x"), "k")), "reference_count": F.lit(1).cast("long"),
        "keywords": F.array(), "n": F.lit(1)})
    incoming = F.lit(1 << 60)
    both = p.select("project_id", (F.col("ord") + F.when(place > 0, incoming).otherwise(0)).alias("at"), "doi", "arxiv_id", "semantic_scholar_id")
    groups = stored(resolve.upsert_groups(both))
    n = groups.groupBy("project_id", F.pmod("group_at", incoming).alias("ord")).agg(F.count("*").alias("n_records"))
    out = resolve.upserted(p.where(place == 0), p.where(place > 0), groups)
    return out.join(n, ["project_id", "ord"]).select("project_id", "doi", "arxiv_id", "n_records", "repo_stars")


@query("SELECT l.l_shipmode AS kind, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode FROM lineitem) l GROUP BY 1 HAVING count(*) > 10 ORDER BY n DESC")
def legend_sizes(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("level"), F.concat("l_returnflag", "l_linestatus").alias("community"))
    return clusters.legend(rows, 0).where("size > 10").select(F.col("community").alias("kind"), F.col("size").alias("n"))


# --- more sources -----------------------------------------------------------------------------------------------------


def _xml(tag: str, *parts) -> F.Column:
    return F.concat(F.lit(f"<{tag}>"), *[F.coalesce(x.cast("string"), F.lit("")) if not isinstance(x, str) else F.lit(x) for x in parts], F.lit(f"</{tag.split(' ')[0]}>"))


@query("SELECT doc_id AS ord, '10.2/' || doc_id AS doi, 'W' || doc_id AS openalex_id, text AS title, array_to_string(list_filter(string_split_regex(source || ' of ' || lang, ' '), lambda w: w <> ''), ' ') AS abstract, 'Ann ' || lang AS author, CAST(1990 + doc_id % 30 AS INTEGER) AS year, '1-' || (doc_id % 9) AS pages, doc_id % 2 = 0 AS is_open_access, 'R' || (doc_id % 50) AS \"references\" FROM documents")
def source_openalex(spark, d):
    i, words = F.col("doc_id"), F.split(F.concat_ws(" ", "source", F.lit("of"), "lang"), " ")
    index = F.map_from_entries(F.transform(words, lambda w, k: F.struct(w, F.array(k))))
    raw = _landed(spark, d, id=F.concat(F.lit("W"), i), doi=F.concat(F.lit("https://doi.org/10.2/"), i), title=F.col("text"), publication_year=1990 + F.pmod(i, F.lit(30)), abstract_inverted_index=index,
                  authorships=F.array(F.struct(F.struct(F.concat(F.lit("Ann "), "lang").alias("display_name")).alias("author"))), biblio=F.struct(F.lit("1").alias("first_page"), F.pmod(i, F.lit(9)).cast("string").alias("last_page")),
                  open_access=F.struct((F.pmod(i, F.lit(2)) == 0).alias("is_oa")), referenced_works=F.array(F.concat(F.lit("https://openalex.org/R"), F.pmod(i, F.lit(50)))))
    out = normalize.from_landed(raw, "openalex", "raw")
    return out.select("ord", "doi", "openalex_id", "title", "abstract", F.col("authors")[0]["name"].alias("author"), "year", "pages", "is_open_access", F.array_join("references", ",").alias("references"))


@query("SELECT doc_id AS ord, '10.3/' || doc_id AS doi, 'S' || doc_id AS semantic_scholar_id, text AS title, source AS journal, 'Bo ' || lang AS author, n_chars AS citation_count, doc_id % 2 = 0 AS is_peer_reviewed, 'https://x/' || doc_id AS pdf_url FROM documents")
def source_semantic_scholar(spark, d):
    i = F.col("doc_id")
    kind = F.when(F.pmod(i, F.lit(2)) == 0, "Conference").otherwise("Review")
    raw = _landed(spark, d, paperId=F.concat(F.lit("S"), i), externalIds=F.struct(F.concat(F.lit("10.3/"), i).alias("DOI")), title=F.col("text"), journal=F.struct(F.col("source").alias("name")),
                  authors=F.array(F.struct(F.concat(F.lit("Bo "), "lang").alias("name"))), citationCount=F.col("n_chars"), publicationTypes=F.array(kind), openAccessPdf=F.struct(F.concat(F.lit("https://x/"), i).alias("url")))
    return normalize.from_landed(raw, "semantic_scholar", "raw").select("ord", "doi", "semantic_scholar_id", "title", "journal", F.col("authors")[0]["name"].alias("author"), "citation_count", "is_peer_reviewed", "pdf_url")


@query("SELECT doc_id AS ord, '10.4/' || doc_id AS doi, text AS title, CASE WHEN doc_id % 3 = 0 THEN 'Cy ' || lang WHEN doc_id % 3 = 1 THEN 'Di' ELSE 'Ed;Flo' END AS authors, CASE WHEN doc_id % 2 = 0 THEN source END AS journal, source AS venue, doc_id % 2 = 0 AS is_peer_reviewed FROM documents")
def source_dblp(spark, d):
    i = F.col("doc_id")
    one = F.to_json(F.struct(F.concat(F.lit("Cy "), "lang").alias("text")))
    people = F.when(F.pmod(i, F.lit(3)) == 0, one).when(F.pmod(i, F.lit(3)) == 1, F.lit('"Di"')).otherwise(F.lit('[{"text":"Ed"},"Flo"]'))
    info = F.to_json(F.struct(F.concat(F.lit("https://doi.org/10.4/"), i).alias("doi"), F.col("text").alias("title"), F.col("source").alias("venue"), F.when(F.pmod(i, F.lit(2)) == 0, "Journal Articles").otherwise("Data").alias("type")))
    raw = F.concat(F.lit('{"info":{"authors":{"author":'), people, F.lit("},"), F.substring(info, 2, 1 << 30), F.lit("}"))
    rows = table(spark, d, "documents").select(i.alias("ord"), raw.alias("raw"))
    return normalize.from_landed(rows, "dblp", "raw").select("ord", "doi", "title", F.array_join(F.transform("authors", lambda a: a["name"]), ";").alias("authors"), "journal", "venue", "is_peer_reviewed")


@query("SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS core_id, text AS title, CASE WHEN doc_id % 4 > 0 THEN CAST(1990 + doc_id % 30 AS INTEGER) END AS year, 'Gus' AS author, source AS journal, CASE WHEN doc_id % 2 = 0 THEN 'https://d/' || doc_id ELSE 'https://f/' || doc_id END AS pdf_url FROM documents")
def source_core(spark, d):
    i = F.col("doc_id")
    raw = _landed(spark, d, id=i.cast("string"), title=F.col("text"), yearPublished=F.when(F.pmod(i, F.lit(4)) > 0, (1990 + F.pmod(i, F.lit(30))).cast("string")).otherwise("0"), authors=F.array(F.struct(F.lit("Gus").alias("name")), F.struct(F.lit("").alias("name"))),
                  journals=F.array(F.struct(F.col("source").alias("title"))), downloadUrl=F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit("https://d/"), i)).otherwise(""), sourceFulltextUrls=F.array(F.concat(F.lit("https://f/"), i)))
    return normalize.from_landed(raw, "core", "raw").select("ord", "core_id", "title", "year", F.col("authors")[0]["name"].alias("author"), "journal", "pdf_url")


@query("SELECT doc_id AS ord, '24' || doc_id AS arxiv_id, 'On ' || source AS title, CASE WHEN doc_id % 2 = 0 THEN 'https://p/' || doc_id ELSE 'https://arxiv.org/pdf/24' || doc_id END AS pdf_url, CAST(1990 + doc_id % 30 AS INTEGER) AS year, 'Hal;Ida' AS authors, lang AS fields FROM documents")
def source_arxiv(spark, d):
    i = F.col("doc_id")
    link = F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit('<link title="pdf" href="https://p/'), i, F.lit('"/>'))).otherwise(F.lit('<link href="https://q"/>'))
    raw = _xml("entry", _xml("id", "http://arxiv.org/abs/24", i, "v3"), _xml("title", "On\n", F.col("source")), _xml("published", 1990 + F.pmod(i, F.lit(30)), "-01-02T00:00:00Z"),
               "<author><name>Hal</name></author><author><name>Ida</name></author>", link, '<category term="', F.col("lang"), '"/><category term=""/>')
    out = normalize.from_landed(table(spark, d, "documents").select(i.alias("ord"), raw.alias("raw")), "arxiv", "raw")
    return out.select("ord", "arxiv_id", "title", "pdf_url", "year", F.array_join(F.transform("authors", lambda a: a["name"]), ";").alias("authors"), F.array_join("fields_of_study", ",").alias("fields"))


@query("SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS pubmed_id, 'On ' || source AS title, 'One ' || lang || ' Two' AS abstract, CASE WHEN doc_id % 3 = 0 THEN 'The Group' ELSE 'Jo ' || source END AS author, CAST(1990 + doc_id % 30 AS INTEGER) AS year, '10.5/' || doc_id AS doi FROM documents")
def source_pubmed(spark, d):
    i = F.col("doc_id")
    who = F.when(F.pmod(i, F.lit(3)) == 0, F.lit("<Author><CollectiveName>The Group</CollectiveName></Author>")).otherwise(F.concat(F.lit("<Author><LastName>"), "source", F.lit("</LastName><ForeName>Jo</ForeName></Author>")))
    article = _xml("Article", _xml("ArticleTitle", "On ", F.col("source")), _xml("Abstract", _xml("AbstractText", 'One ', F.col("lang")), '<AbstractText Label="x">Two</AbstractText>'), _xml("AuthorList", who),
                   _xml("Journal", _xml("JournalIssue", _xml("PubDate", _xml("Year", 1990 + F.pmod(i, F.lit(30)))))))
    ids = F.concat(F.lit('<PubmedData><ArticleIdList><ArticleId IdType="pii">z</ArticleId><ArticleId IdType="doi">10.5/'), i, F.lit("</ArticleId></ArticleIdList></PubmedData>"))
    raw = _xml("PubmedArticle", _xml("MedlineCitation", F.concat(F.lit('<PMID Version="1">'), i, F.lit("</PMID>")), article), ids)
    out = normalize.from_landed(table(spark, d, "documents").select(i.alias("ord"), raw.alias("raw")), "pubmed", "raw")
    return out.select("ord", "pubmed_id", "title", "abstract", F.col("authors")[0]["name"].alias("author"), "year", "doi")


# --- lists, nodes and settings ----------------------------------------------------------------------------------------


@query(f"{SCORED}, told AS (SELECT lower(title) AS low, max(doc_id % 13 + 0.5) AS told FROM (SELECT ord AS doc_id, upper(title) AS title FROM papers WHERE ord % 4 = 0) GROUP BY 1) SELECT ord, CAST(coalesce(told, score) AS DOUBLE) AS score FROM scored LEFT JOIN told ON lower(title) = low")
def score_join(spark, d):
    p = papers(spark, d)
    told = p.where("ord % 4 = 0").select(F.upper("title").alias("title"), (F.pmod("ord", F.lit(13)) + 0.5).cast("double").alias("score"))
    return listings.with_scores(p, told, scores.composite_score()).select("ord", "score")


@query("""WITH RECURSIVE r AS (SELECT doc_id AS ord, source AS name, CASE WHEN doc_id % 2 = 0 THEN 'A' || lang END AS oa FROM documents),
pairs AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM (SELECT name, oa, min(ord) AS ord FROM r WHERE oa IS DISTINCT FROM 'Aen' AND name IS DISTINCT FROM 'src1' GROUP BY name, oa)),
w AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS names, []::VARCHAR[] AS ids, []::BIGINT[] AS made UNION ALL
  SELECT p.i, CASE WHEN new THEN list_append(names, name) ELSE names END, CASE WHEN new AND oa IS NOT NULL THEN list_append(ids, oa) ELSE ids END, CASE WHEN new THEN list_append(made, ord) ELSE made END
  FROM (SELECT pairs.*, w.names, w.ids, w.made, NOT list_contains(w.names, name) AND (oa IS NULL OR NOT list_contains(w.ids, oa)) AS new FROM w JOIN pairs ON pairs.i = w.i + 1) AS p),
m AS (SELECT name, oa, ord FROM pairs WHERE list_contains((SELECT made FROM w ORDER BY i DESC LIMIT 1), ord))
SELECT r.ord, coalesce(CASE WHEN r.oa = 'Aen' THEN 's1' END, CASE WHEN o.ord <= r.ord THEN 'new:' || o.ord END, CASE WHEN r.name = 'src1' THEN 's2' END, 'new:' || n.ord) AS author_id
FROM r LEFT JOIN m AS o ON o.oa = r.oa LEFT JOIN m AS n ON n.name = r.name""")
def author_match(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("ord"), F.col("source").alias("name"), F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit("A"), "lang")).alias("openalex_id"))
    held = spark.createDataFrame([("s1", "Someone", "Aen"), ("s2", "src1", None)], "author_id string, name string, openalex_id string")
    return listings.matched_authors(held, rows).select("ord", "author_id")


@query(f"""WITH {PAPERS}, s AS (SELECT doi AS id, CAST(ord % 17 AS DOUBLE) / 4 AS score FROM papers WHERE ord % 3 <> 0 UNION ALL SELECT doi, 1.0 FROM papers WHERE ord % 6 = 1 UNION ALL SELECT 'none', 9.0),
b AS (SELECT id, max(score) AS score FROM s GROUP BY id)
SELECT row_number() OVER (ORDER BY score DESC, b.id) AS place, b.id, score, p.title FROM b JOIN papers AS p ON p.doi = b.id""")
def scored_papers(spark, d):
    p = papers(spark, d).withColumn("id", F.col("doi"))
    told = p.where("ord % 3 <> 0").select("id", ((F.col("ord") % 17) / 4).alias("score")).union(p.where("ord % 6 = 1").select("id", F.lit(1.0))).union(spark.createDataFrame([("none", 9.0)], "id string, score double"))
    return listings.scored_papers(p, told).select(F.col("place").cast("long").alias("place"), "id", "score", "title")


@query(f"WITH {PAPERS} SELECT CAST(row_number() OVER (ORDER BY ord DESC) AS INTEGER) AS place, doi AS id, CASE WHEN ord % 5 = 0 THEN 'saved' WHEN ord % 3 = 0 THEN 'external' ELSE 'search' END AS layer FROM papers WHERE ord % 5 = 0 OR ord % 3 = 0 OR ord % 2 = 0")
def override_union(spark, d):
    p = papers(spark, d)
    of = lambda name, n: p.where(f"ord % {n} = 0").select("ord", "doi", F.lit(name).alias("from"))
    wanted = p.select(F.col("doi").alias("id"), (-F.col("ord")).alias("place")).union(spark.createDataFrame([("none", 0)], "id string, place long"))
    rows = listings.overridden(wanted, [of("search", 2), of("external", 3), of("saved", 5)], F.col("doi"))
    # -ord is the selection's order; its rank makes the places of what is found comparable.
    return rows.withColumn("place", F.row_number().over(W.orderBy("place"))).select("place", "id", F.col("from").alias("layer"))


@query("SELECT o_orderkey AS ord, CAST(o_orderdate AS TIMESTAMP) AS last_used_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def shelf_recent(spark, d):
    return listings.recent(table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderdate").cast("timestamp_ntz").alias("last_used_at")))


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place, o_orderkey AS ord FROM orders WHERE o_custkey = 7")
def shelf_listing(spark, d):
    rows = table(spark, d, "orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("ord"), F.col("o_orderdate").alias("at"))
    return listings.listing(rows, "at").select(F.row_number().over(W.orderBy(F.desc("at"), "ord")).alias("place"), "ord")


@query(f"WITH {PAPERS} SELECT ord, CASE WHEN ord % 4 = 0 THEN ord * 10 ELSE citation_count END AS citation_count FROM papers")
def arxiv_citation_counts(spark, d):
    p = papers(spark, d).withColumn("arxiv_id", F.when(F.pmod("ord", F.lit(2)) == 0, F.concat(F.lit("x"), "ord")))
    counts = p.where("arxiv_id is not null").select("arxiv_id", F.when(F.pmod("ord", F.lit(4)) == 0, F.col("ord") * 10).alias("citation_count"))
    return listings.with_citation_counts(p, counts).select("ord", "citation_count")


def _nodes(spark, d) -> DataFrame:
    i = F.col("doc_id")
    journal = F.when(F.pmod(i, F.lit(3)) == 0, F.concat(F.lit('{"name":"'), "source", F.lit('"}'))).when(F.pmod(i, F.lit(3)) == 1, F.concat(F.lit('"'), "lang", F.lit('"'))).otherwise("null")
    rest = F.to_json(F.struct(F.when(F.pmod(i, F.lit(7)) > 0, F.concat(F.lit("N"), i)).alias("paperId"), F.col("text").alias("title"), F.col("n_chars").alias("citationCount"), F.array(F.struct(F.col("lang").alias("name"))).alias("authors")))
    return table(spark, d, "documents").select(F.pmod(i, F.lit(3)).alias("hop"), F.concat(F.lit('{"journal":'), journal, F.lit(","), F.substring(rest, 2, 1 << 30)).alias("raw"))


@query("SELECT 'N' || doc_id AS semantic_scholar_id, text AS title, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang END AS journal, lang AS authors, n_chars AS citation_count, false AS is_open_access, false AS has_public_code, round(log10(1 + CAST(n_chars AS DOUBLE)), 2) AS score FROM documents WHERE doc_id % 7 > 0")
def node_papers(spark, d):
    rows = listings.node_papers(listings.graph_nodes(_nodes(spark, d)), scores.rep_score("citation_count"))
    return rows.select("semantic_scholar_id", "title", "journal", F.array_join("authors", ",").alias("authors"), "citation_count", "is_open_access", "has_public_code", "score")


@query("SELECT o_orderkey AS id, CAST(n - 1 AS INTEGER) AS place FROM (SELECT l_orderkey AS o_orderkey, count(*) AS c FROM lineitem GROUP BY 1) o, LATERAL (SELECT unnest(range(1, least(c, 3) + 1)) AS n) WHERE o_orderkey % 3 = 0")
def neighbour_answers(spark, d):
    k = F.col("l_orderkey")
    held = table(spark, d, "lineitem").groupBy(k.alias("id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("paperId"))).alias("data"))
    status = F.when(F.pmod("id", F.lit(3)) == 1, 404).otherwise(200)
    body = F.when(F.pmod("id", F.lit(3)) == 2, '{"data":null}').otherwise(F.to_json(F.struct("data")))
    return listings.neighbours(held.select("id", F.lit("references").alias("kind"), status.alias("status"), body.alias("body")), 3).select("id", "place")


@query(f"WITH {cites_sql()}, kept AS (SELECT id FROM meta WHERE id = 7 OR contains(lower(title || ' ' || abstract), 'brand#1')) SELECT src, dst FROM cites WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def filter_toggle(spark, d):
    return traverse.filtered_graph(meta(spark, d), cites(spark, d), F.lit(7), ["Brand#1"])[1]


@query("SELECT count(*) AS n, count(*) <= 3000 AS shown FROM part")
def node_guard(spark, d):
    return traverse.clusters_shown(meta(spark, d))


@query("SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN event_id % 9 + 1 WHEN event_id % 4 = 2 THEN 2 ELSE 2 END AS INTEGER) AS hops, CAST(CASE WHEN event_id % 4 = 1 THEN event_id % 9 + 1 END AS INTEGER) AS most_per_hop, CASE WHEN event_id % 4 = 1 THEN event_id % 9 + 0.5 WHEN event_id % 4 = 3 THEN 1.5 ELSE 0.5 END::DOUBLE AS resolution FROM events")
def graph_settings(spark, d):
    i, kind = F.col("event_id"), F.pmod("event_id", F.lit(4))
    half = F.concat(F.pmod(i, F.lit(9)).cast("string"), F.lit(".5"))
    hops = F.when(kind == 0, " ").when(kind == 1, half).when(kind == 2, "-3").otherwise("1.5")
    most = F.when(kind == 0, "").when(kind == 1, half).when(kind == 2, "0").otherwise("many")
    resolution = F.when(kind == 0, "").when(kind == 1, half).when(kind == 2, "-1").otherwise("15e-1")
    return table(spark, d, "events").select("event_id", traverse.sanitized_settings(hops, most, resolution).alias("s")).select("event_id", "s.*")


@query(f"WITH {TYPE}, y AS (SELECT DISTINCT year FROM m WHERE node % 11 <> 0 AND year % 3 = 0), g AS (SELECT year AS left, year + 1 + year % 4 AS right FROM (SELECT DISTINCT year FROM m)) SELECT g.left, g.right, (g.left + g.right) // 2 IN (SELECT year FROM y) OR ((g.left + g.right) % 2 = 1 AND (g.left + g.right) // 2 + 1 IN (SELECT year FROM y)) AS expandable FROM g")
def expandable_gaps(spark, d):
    _, nodes = type_levels(spark, d)
    years = nodes.where("node % 11 <> 0 and year % 3 = 0").select("year").distinct()
    return clusters.expandable_gaps(nodes.select(F.col("year").alias("left"), (F.col("year") + 1 + F.pmod("year", F.lit(4))).alias("right")).distinct(), years)


MODES = {"relevancy": "score DESC", "year_desc": "year DESC", "year_asc": "year", "citations_desc": "citation_count DESC", "citations_asc": "citation_count", "title": "lower(title) COLLATE C"}


@query(f"{SCORED} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, CAST(row_number() OVER (ORDER BY {by.replace(' COLLATE C', '')}, ord) AS INTEGER) AS place, ord FROM scored ORDER BY place LIMIT 20)" for m, by in MODES.items()))
def sort_modes(spark, d):
    rows, out = scored(spark, d), None
    for mode in MODES:
        best = filters.top(rows, 20, *filters.order(mode))
        part = best.select(F.lit(mode).alias("mode"), F.row_number().over(W.orderBy(*filters.order(mode))).alias("place"), "ord")
        out = part if out is None else out.union(part)
    return out


# --- keywords and answers ---------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT p_partkey, list_concat([p_name], list_filter(string_split(p_type, ' '), lambda w: len(w) >= 2)) AS k FROM part), l AS (SELECT p_partkey, k, list_transform(k, lambda x: lower(x)) AS low FROM k)
SELECT p_partkey, array_to_string(list_filter(k, lambda x, i: list_position(low, lower(x)) = i), ';') AS keywords FROM l""")
def parsed_keywords(spark, d):
    raw = F.concat(F.lit('-"not this" "'), "p_name", F.lit('" AND ('), "p_type", F.lit(") or x -"), "p_brand", F.lit(" NOT "), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.parsed_keywords(raw), ";").alias("keywords"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN 'told' WHEN doc_id % 8 = 0 THEN 'heuristic' END AS method, CASE WHEN doc_id % 4 > 0 THEN lang || ';' || source WHEN doc_id % 8 = 0 THEN 'graph nets;' || source END AS keywords, CASE WHEN doc_id % 8 = 4 THEN 'Could not derive keywords from the input.' END AS error FROM documents")
def keyword_chain(spark, d):
    """A model's answers first, the heuristic with a bibliography's keywords where there is none."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        i.alias("id"), F.when(F.pmod(i, F.lit(8)) == 0, "Graph nets").otherwise("the").alias("prompt"), F.when(F.pmod(i, F.lit(8)) == 0, F.concat(F.lit("Title: a | Keywords: GRAPH nets, "), "source", F.lit(" | Abstract: b, c"))).otherwise("").alias("context"),
        F.concat(F.lit("I think of ['x'] and [] but [\"old\"], so: [\""), "lang", F.lit("\", \" "), "source", F.lit("\", \" \"]")).alias("answer"))
    told = lambda r: models.recovered(r.where("id % 4 > 0"), "answer").select("id", "keywords")
    out = keywords.generated(rows, {"told": told, "heuristic": lambda r: keywords.heuristic(r, context="context")})
    return out.select("id", "method", F.nullif(F.array_join("keywords", ";"), F.lit("")).alias("keywords"), "error")


@query("SELECT doc_id, len(left(text, 100000)) AS n, CASE WHEN doc_id % 3 = 0 AND trim(left(coalesce(text, ''), 100000), ' ') = '' THEN 'Provide a research description or a .bib file.' END AS error FROM documents")
def keyword_guard(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, "  ").otherwise("on graphs").alias("prompt"), F.col("text").alias("bibtex"))
    return keywords.guarded(rows).select("doc_id", F.char_length("bibtex").cast("long").alias("n"), "error")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'On \"' || lang || '\"' ELSE 'Of ' || source END AS title, CASE WHEN doc_id % 2 = 0 THEN 'Café {' || source || '}' ELSE 'Several works.' END AS summary FROM documents")
def answer_summaries(spark, d):
    """Objects at the end of prose, and fields of prose with escapes."""
    i = F.col("doc_id")
    object_ = F.concat(F.lit('Draft {"title": "no", "summary": "old"}. Final: {"title": "On \\"'), "lang", F.lit('\\"", "summary": "Caf\\u00e9 {'), "source", F.lit('}"} done'))
    prose = F.concat(F.lit("Thinking.\n* Title: draft\n* **\n> Title: Of "), "source", F.lit("\nSummary:\nSeveral works.\nBye"))
    rows = table(spark, d, "documents").select(i.alias("id"), F.when(F.pmod(i, F.lit(2)) == 0, object_).otherwise(prose).alias("answer"))
    return models.recovered(rows, "answer").select("id", "title", "summary")


@query("SELECT doc_id AS row_index, CASE WHEN doc_id % 3 = 0 THEN lang END AS main_archetype, CASE WHEN doc_id % 3 = 0 THEN source END AS second_tier_archetype, doc_id % 3 > 0 AS failed FROM documents")
def answer_labels(spark, d):
    i = F.col("doc_id")
    good = F.to_json(F.struct(F.lit(-1).alias("row_index"), F.col("lang").alias("main_archetype"), F.col("source").alias("second_tier_archetype")))
    rows = table(spark, d, "documents").select(i.alias("row_index"), F.when(F.pmod(i, F.lit(3)) == 0, good).when(F.pmod(i, F.lit(3)) == 1, '{"row_index": 1}').otherwise("no JSON").alias("answer"))
    return models.recovered_labels(rows, "answer").select("row_index", "main_archetype", "second_tier_archetype", F.col("parse_error").isNotNull().alias("failed"))


@query(f"WITH {PAPERS} SELECT ord AS id, CASE WHEN coalesce(trim(abstract, ' '), '') <> '' THEN lang END AS main, CASE WHEN coalesce(trim(abstract, ' '), '') <> '' THEN 0.25 ELSE 0 END::DOUBLE AS main_confidence FROM papers")
def classified_items(spark, d):
    p = papers(spark, d).withColumn("id", F.col("ord"))
    head = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.lit(0.25).alias("confidence"))
    return models.classified_items(p, {"main": head}).select("id", "main", "main_confidence")


def _f1_sql(t: str, g: str, k: int) -> str:
    return f"c{k} AS (SELECT {t} AS t, {g} AS g, count(*) AS n FROM l GROUP BY 1, 2), a{k} AS (SELECT sum(n) FILTER (t = g) / sum(n) AS accuracy FROM c{k}), s{k} AS (SELECT t, sum(n) AS support, coalesce(sum(n) FILTER (t = g), 0) AS hit FROM c{k} GROUP BY t), p{k} AS (SELECT g AS t, sum(n) AS guessed FROM c{k} GROUP BY g), f{k} AS (SELECT sum(2.0 * hit / (support + coalesce(guessed, 0)) * support) / sum(support) AS f1 FROM s{k} LEFT JOIN p{k} USING (t))"


@query(f"WITH l AS (SELECT quality, toxic, doc_id % 2 AS o FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), {_f1_sql('quality', 'toxic', 1)}, {_f1_sql('toxic', 'o', 2)} SELECT round((a1.accuracy + a2.accuracy) / 2, 9) AS accuracy, round((f1.f1 + f2.f1) / 2, 9) AS f1 FROM a1, a2, f1, f2")
def two_heads(spark, d):
    rows = table(spark, d, "labels").where("quality is not null and toxic is not null").withColumn("o", F.pmod("doc_id", F.lit(2)))
    return models.two_heads(rows, ("quality", "toxic"), ("toxic", "o")).select(F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '—' WHEN c_custkey % 7 <= 3 THEN array_to_string(list_transform(range(1, c_custkey % 7 + 1), lambda i: 'n' || i), ', ') ELSE 'n1, n2, n3, et al.' END AS listed, CASE WHEN c_custkey % 7 <= 5 THEN array_to_string(list_transform(range(1, c_custkey % 7 + 1), lambda i: 'n' || i), ', ') ELSE 'n1, n2, n3, n4, n5 et al.' END AS card, CASE WHEN c_custkey % 2 = 0 THEN 'semantic scholar (' || c_mktsegment || '), core' ELSE 'semantic scholar, core' END AS failed FROM customer")
def author_and_source_lines(spark, d):
    names = F.filter(F.lit([f"n{i}" for i in range(1, 7)]), lambda x: F.substring(x, 2, 1).cast("int") <= F.pmod("c_custkey", F.lit(7)))
    reasons = F.create_map(F.lit("semantic_scholar"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", T.author_line(names, 3, ", et al.", "—").alias("listed"), T.author_line(names, 5).alias("card"), T.failed_label(F.lit(["semantic_scholar", "core"]), reasons).alias("failed"))


@query("SELECT p_partkey AS id, 'article' AS entry_type, p_name || ' {' AS opened, p_name || ' of parts' AS title, p_brand || ';' || p_type AS keywords FROM part".replace("p_name || ' {' AS opened, ", ""))
def parsed_bibtex(spark, d):
    """Entries with braces inside titles, quoted and bare values."""
    entry = F.concat(F.lit("junk @Article{key"), "p_partkey", F.lit(",\n title = {"), "p_name", F.lit(" {of}  parts},\n year = 2020, keywords = \""), "p_brand", F.lit("; "), "p_type", F.lit("\"\n}"))
    rows = bib.parse_bibtex(table(spark, d, "part").select(F.col("p_partkey").alias("id"), entry.alias("text")))
    return rows.select("id", "entry_type", "title", F.array_join("keywords", ";").alias("keywords"))


# --- versions, the index by files, answers as of a time, views of clusters --------------------------------------------


def fresh_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH o AS (SELECT o_custkey AS project_id FROM orders), e AS (SELECT user_id AS project_id FROM events),
v2 AS (SELECT * FROM o WHERE project_id % 5 <> 0 UNION ALL SELECT * FROM e WHERE project_id % 5 = 0), v3 AS (SELECT * FROM v2 WHERE project_id % 7 <> 0), v4 AS (SELECT * FROM v3 UNION ALL SELECT * FROM e WHERE project_id % 2 = 0)
SELECT version, project_id, count(*) AS n FROM (SELECT 1::BIGINT AS version, * FROM o UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4 UNION ALL SELECT 5, * FROM v4) GROUP BY 1, 2""")
def store_versions(spark, d):
    """Orders as library rows; then events in place of a fifth of the projects, a seventh deleted, events added, and a compaction: all five versions as read at the end."""
    v = versions.Versions(spark, fresh_folder(spark, "versions"))
    o, e = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id")), table(spark, d, "events").select(F.col("user_id").alias("project_id"))
    fifth, every = "project_id % 5 = 0", o.union(e).distinct()
    v.commit({"library": o})
    v.commit({"library": e.where(fifth)}, {"library": every.where(fifth)})
    versions.delete_projects(v, every.where("project_id % 7 = 0"))
    v.commit({"library": e.where("project_id % 2 = 0")})
    v.compact()
    counted = [v.read("library", n).groupBy("project_id").agg(F.count("*").alias("n")).select(F.lit(n).cast("long").alias("version"), "project_id", "n") for n in range(1, 6)]
    return functools.reduce(DataFrame.unionByName, counted)


@query("""SELECT c_custkey AS project_id, c_mktsegment || ' ' || c_nationkey AS query_text, '["' || c_mktsegment || '","' || c_nationkey || '"]' AS keywords, coalesce(n, 0) AS n_results, coalesce(n, 0) AS n_papers
FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_custkey % 3 > 0 OR o_orderstatus = 'F' GROUP BY 1) USING (c_custkey)""")
def job_log(spark, d):
    """Each customer's search brings all orders; then a third of the customers search again and get those of one status."""
    v = versions.Versions(spark, fresh_folder(spark, "projects"))
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey", "o_orderstatus")

    def search(which, papers):
        n = papers.groupBy("project_id").agg(F.count("*").alias("n_results"))
        jobs = c.select(F.col("c_custkey").alias("project_id"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("keywords"), F.array(F.lit("orders")).alias("databases"), F.lit(None).cast("array<string>").alias("failed_sources"), F.current_timestamp().alias("completed_at"))
        versions.load_projects(v, papers, jobs.where(which).join(n, "project_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0))))

    search("true", o)
    search("project_id % 3 = 0", o.where("project_id % 3 = 0 AND o_orderstatus = 'F'"))
    held = v.read("papers").groupBy("project_id").agg(F.count("*").alias("n_papers"))
    return v.read("jobs").join(held, "project_id", "left").select("project_id", "query_text", "keywords", "n_results", F.coalesce("n_papers", F.lit(0)).alias("n_papers"))


@query(f"WITH {cites_sql()} SELECT dst AS id, count(*) AS citations FROM cites WHERE src % 4 <> 3 OR dst % 2 = 0 GROUP BY 1")
def index_update(spark, d):
    """The parts as CSV files by fours; when the files of one four are written anew, with fewer references, the index follows."""
    folder, v = fresh_folder(spark, "corpus"), versions.Versions(spark, fresh_folder(spark, "index"), owner="file")
    uid = lambda c: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col(c).cast("string"), 12, "0"))

    def land(which):
        refs = cites(spark, d).where(which).repartition(pieces(spark, d), "src").groupBy("src").agg(F.array_join(F.collect_list(F.concat(F.lit("'"), uid("dst"), F.lit("'"))), ", ").alias("refs"))
        rows = meta(spark, d).join(refs.withColumnRenamed("src", "id"), "id", "left").withColumn("part", F.pmod("id", F.lit(4)))
        no = F.lit("")
        rows = rows.select(uid("id").alias("id"), "title", "abstract", no.alias("authors"), no.alias("venue"), F.lit(2000).alias("year"), "n_citation", F.concat(F.lit("["), F.coalesce("refs", no), F.lit("]")).alias("references"), no.alias("one"), no.alias("two"), "part")
        rows = rows if which == "true" else rows.where("part = 3")
        rows.write.mode("overwrite").options(header=True, escape='"', partitionOverwriteMode="dynamic").partitionBy("part").csv(folder)
        index.update_index(v, folder)

    land("true")
    land("src % 4 = 3 AND dst % 2 = 0")
    return index.index_tables(v)["cites"].groupBy("dst").agg(F.count("*").alias("citations")).select(F.right("dst", F.lit(12)).cast("long").alias("id"), "citations")


@query("""WITH r AS (SELECT event_id, event_type, ts FROM events WHERE event_id % 3 > 0), g AS (SELECT event_type, ts, max(value) AS value FROM events WHERE event_id % 3 = 0 AND event_id % 4 > 0 AND value IS NOT NULL GROUP BY 1, 2)
SELECT r.event_id, g.value, CASE WHEN g.ts IS NULL THEN 'none' WHEN epoch_us(r.ts) - epoch_us(g.ts) < 300000000 THEN 'fresh' ELSE 'stale' END AS state FROM r ASOF LEFT JOIN g ON r.event_type = g.event_type AND r.ts >= g.ts""")
def answers_as_of(spark, d):
    """A third of the events as answers, of which a fourth failed; the others ask for their type's."""
    e = table(spark, d, "events")
    answers = e.where("event_id % 3 = 0").select("event_type", "ts", "value", (F.col("event_id") % 4 > 0).alias("ok"))
    return store.answered(e.where("event_id % 3 > 0").select("event_id", "event_type", "ts"), answers, "event_type", "ts").select("event_id", "value", "state")


def placed_levels(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dendrogram of parts with the brand of number 11 as that of unlinked nodes, nodes with places, edges."""
    levels, nodes = type_levels(spark, d)
    levels = levels.withColumn("is_misc", (F.col("level") == 0) & (F.col("community") == 11))
    edges = traverse.undirected(cites(spark, d)).select(F.col("a").alias("source"), F.col("b").alias("target"))
    return levels, nodes.withColumns({"x": F.col("year").cast("double"), "y": F.pmod("node", F.lit(10)).cast("double")}), edges


@query(f"""WITH {TYPE}, {cites_sql()}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM cites),
c AS (SELECT level, community, count(*) AS n, avg(year) AS x, avg(node % 10) AS y FROM levels JOIN m USING (node) GROUP BY 1, 2),
l AS (SELECT p.level, least(p.community, q.community) AS a, greatest(p.community, q.community) AS b, count(*) AS n FROM e JOIN levels p ON p.node = a JOIN levels q ON q.node = b AND q.level = p.level WHERE p.community <> q.community GROUP BY 1, 2, 3)
SELECT level, 'cluster' AS kind, community AS a, NULL::BIGINT AS b, n, CASE WHEN community = CASE level WHEN 0 THEN 11 ELSE 1 END AND EXISTS (SELECT 1 FROM m WHERE b = 11) THEN 'Miscellaneous' ELSE 'Cluster ' || community END || ' · ' || n AS label, round(x, 6) AS x, round(y, 6) AS y, round(least(46, 12 + 4 * sqrt(n)), 6) AS radius FROM c
UNION ALL SELECT level, 'link', a, b, n, NULL, NULL, NULL, NULL FROM l
UNION ALL SELECT -1, 'paper', node, NULL, 1, CASE WHEN length(title) > 22 THEN left(title, 20) || '...' ELSE title END, year, node % 10, 12 FROM m UNION ALL SELECT -1, 'link', a, b, 1, NULL, NULL, NULL, NULL FROM e WHERE a IN (SELECT node FROM m) AND b IN (SELECT node FROM m)""")
def meta_graph(spark, d):
    levels, nodes, edges = placed_levels(spark, d)
    known = nodes.select("node")
    edges = edges.join(known.select(F.col("node").alias("source")), "source", "left_semi").join(known.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target")
    shown = [clusters.meta_graph(levels, nodes, edges, n).withColumn("level", F.lit(-1 if n is None else n)) for n in (None, 0, 1)]
    return functools.reduce(DataFrame.unionByName, shown).withColumns({c: F.round(c, 6) for c in ("x", "y", "radius")})


@query(f"WITH {TYPE} SELECT node, title FROM m WHERE b // 10 = 2")
def cluster_scope(spark, d):
    levels, nodes = type_levels(spark, d)
    return clusters.scope(levels, nodes, 2).select("node", "title")


@query(f"WITH {TYPE} SELECT community, rep AS node, first FROM reps JOIN (SELECT b // 10 AS community, min(node) AS first FROM m GROUP BY 1) USING (community) WHERE level = 1")
def top_seeds(spark, d):
    return clusters.seeds(*type_levels(spark, d)).select("community", "node", "first")


@query(f"WITH {TYPE} SELECT DISTINCT level, community FROM levels JOIN m USING (node) WHERE b = 11")
def misc_clusters(spark, d):
    return clusters.misc_clusters(placed_levels(spark, d)[0])


@query("""SELECT o_orderkey AS id, coalesce(parts, '') AS parts, coalesce(flags, '') AS flags FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts,
string_agg(l_returnflag, '' ORDER BY l_shipdate, l_returnflag) FILTER (l_quantity > 25) AS flags FROM lineitem GROUP BY 1) USING (o_orderkey)""")
def ordered_children(spark, d):
    """Orders as papers, their lines as two kinds of children, each in an order of its own."""
    i = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey"))
    rows = listings.with_children(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", parts=(i.select("id", "l_partkey", "l_linenumber"), [F.col("l_linenumber"), F.col("l_partkey")]),
                                  flags=(i.where("l_quantity > 25").select("id", "l_returnflag", "l_shipdate"), [F.col("l_shipdate"), F.col("l_returnflag")]))
    return rows.select("id", F.array_join(F.transform("parts", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"), F.array_join(F.transform("flags", lambda x: x["l_returnflag"]), "").alias("flags"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'click' THEN 'fetched' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'start' WHEN 'purchase' THEN CASE WHEN event_id % 16 = 0 THEN 'cancel' ELSE 'start' END ELSE 'other' END AS kind, 's' || event_id % 6 AS source, event_id % 10 AS n, ts FROM events),
c AS (SELECT job_id, min(ts) AS stop FROM e WHERE kind = 'cancel' GROUP BY 1), f AS (SELECT job_id, source, min((ts, kind, n)) AS r FROM e WHERE kind IN ('fetched', 'failed') GROUP BY 1, 2),
g AS (SELECT f.*, stop FROM f LEFT JOIN c USING (job_id) WHERE stop IS NULL OR r[1] <= stop), w AS (SELECT DISTINCT job_id, source FROM e WHERE kind = 'start'),
d AS (SELECT job_id, bool_and(g.source IS NOT NULL) AS over FROM w LEFT JOIN g USING (job_id, source) GROUP BY 1), j AS (SELECT DISTINCT job_id FROM g UNION SELECT job_id FROM c UNION SELECT job_id FROM d WHERE over)
SELECT job_id, CASE WHEN coalesce(over, false) THEN 'done' WHEN stop IS NOT NULL THEN 'cancelled' ELSE 'running' END AS status, coalesce(total, 0) AS total_papers, coalesce(failed, '') AS failed_sources
FROM j LEFT JOIN c USING (job_id) LEFT JOIN d USING (job_id) LEFT JOIN (SELECT job_id, CAST(sum(CASE WHEN r[2] = 'fetched' THEN r[3] ELSE 0 END) AS BIGINT) AS total, string_agg(CASE WHEN r[2] = 'failed' THEN source END, ',' ORDER BY source) AS failed FROM g GROUP BY 1) USING (job_id)""")
def job_states(spark, d):
    """Users as jobs: views and most purchases name a source, clicks bring papers, errors fail, a few purchases cancel."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 'fetched' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'start' WHEN 'purchase' THEN IF(event_id % 16 = 0, 'cancel', 'start') ELSE 'other' END")
    n = F.col("event_id")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), kind.alias("kind"), F.concat(F.lit("s"), n % 6).alias("source"), (n % 10).alias("n"), F.lit("gone").alias("error"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.job_status(jobs.progressed(e)).withColumn("failed_sources", F.array_join("failed_sources", ","))


# --- facets, labels and project rows ----------------------------------------------------------------------------------


def labelled(spark, d) -> DataFrame:
    """Papers with a primary label by language, none for English, and a secondary one by year."""
    main = F.when(F.col("lang") == "de", "The Analyst").when(F.col("lang") == "fr", "The Architect").when(F.col("lang") != "en", "The Evaluator")
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "lang").select("ord", main.alias("__main"))
    p = papers(spark, d).join(langs, "ord").withColumn("predicted_main_archetype", F.col("__main")).drop("__main")
    return p.withColumns({"predicted_second_tier_archetype": F.when(F.col("year") % 3 == 0, "The Analyst").when(F.col("year") % 3 == 1, "None"), "code_url": F.when(F.col("ord") % 5 == 0, "https://example.org/x").when(F.col("ord") % 5 == 1, " ")})


LABELLED = f"WITH {PAPERS}, labelled AS (SELECT *, CASE WHEN lang = 'de' THEN 'The Analyst' WHEN lang = 'fr' THEN 'The Architect' WHEN lang <> 'en' THEN 'The Evaluator' END AS main, CASE year % 3 WHEN 0 THEN 'The Analyst' WHEN 1 THEN 'None' END AS second FROM papers)"


@query(f"{LABELLED} SELECT ord FROM labelled WHERE (coalesce(has_public_code, false) OR ord % 5 < 2) AND coalesce(is_peer_reviewed, false) AND (main IS NULL OR main IN ('The Architect', 'The Evaluator')) AND (second IS NULL OR second = 'None')")
def code_and_label_facets(spark, d):
    f = filters.Filters(code_only=True, peer_reviewed_only=True, archetypes=["The Architect", "The Evaluator"])
    return labelled(spark, d).where(filters.predicate(f)).select("ord")


@query(f"{LABELLED} SELECT ord, CASE WHEN ord % 4 = 0 THEN 'The Combiner' ELSE main END AS main, CASE WHEN ord % 8 = 0 THEN 'The Analyst' ELSE second END AS second FROM labelled")
def patched_labels(spark, d):
    p = labelled(spark, d)
    told = p.where("ord % 4 = 0").select(F.col("doi").alias("key"), F.lit("The Combiner").alias("main"), F.when(F.col("ord") % 8 == 0, "The Analyst").alias("second"))
    return models.patched(p, told, F.col("doi")).select("ord", F.col("predicted_main_archetype").alias("main"), F.col("predicted_second_tier_archetype").alias("second"))


@query(f"{LABELLED} SELECT ord AS row_index, main, coalesce(second, 'None') AS second, CASE main WHEN 'The Analyst' THEN 1 WHEN 'The Architect' THEN 2 ELSE 0 END AS main_id FROM labelled WHERE ord % 3 > 0 AND main IS NOT NULL")
def training_rows(spark, d):
    """Texts of two thirds of the papers with their labels; a label beyond the known three takes the place of None."""
    p = labelled(spark, d)
    told = p.select(F.col("ord").alias("row_index"), F.col("predicted_main_archetype").alias("main_archetype"), F.coalesce("predicted_second_tier_archetype", F.lit(" ")).alias("second_tier_archetype"))
    rows = models.prepared(p.where("ord % 3 > 0").select(F.col("ord").alias("row_index"), "abstract"), told)
    rows = models.encoded_labels(rows, "main_archetype", ["None", "The Analyst", "The Architect"])
    return rows.select("row_index", F.col("main_archetype").alias("main"), F.col("second_tier_archetype").alias("second"), F.col("main_archetype_id").alias("main_id"))


@query("""WITH k AS (SELECT user_id AS project_id, event_type AS paper_identifier, arg_max(props, event_id) AS kept FROM events GROUP BY 1, 2)
SELECT o_orderkey AS ord, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, kept) AS notes FROM orders LEFT JOIN k ON project_id = o_custkey AND paper_identifier = CASE WHEN o_orderkey % 3 = 0 THEN 'view' ELSE 'click' END""")
def restored_notes(spark, d):
    """Orders as rows added again, half of them with a note of their own; events as the notes kept."""
    kept = table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("paper_identifier"), F.col("props").alias("notes"), F.col("event_id").alias("at"))
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("ord"), F.col("o_custkey").alias("project_id"), F.when(k % 3 == 0, "view").otherwise("click").alias("paper_identifier"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("notes"))
    return store.with_notes(rows, kept).select("ord", "notes")


@query("SELECT DISTINCT c_custkey AS project_id, user_id IS NOT NULL AS present FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') ON user_id = c_custkey")
def membership(spark, d):
    held = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("project_id"))
    return store.contains(held, table(spark, d, "customer").select(F.col("c_custkey").alias("project_id")), ["project_id"])


@query("SELECT o_orderkey AS id, trim(o_orderstatus) AS name FROM orders WHERE o_orderkey % 4 > 1 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def remaining_projects(spark, d):
    """Orders with blank names for half of them; those with a returned line are done, those with another line have a blank label."""
    k = F.col("o_orderkey")
    rows = store.valid_projects(table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 0, "  ").when(k % 4 > 1, F.concat(F.lit(" "), "o_orderstatus")).alias("name")))
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "R").otherwise(" ").alias("label"))
    return store.remaining(rows, done, "id", "label").select("id", "name")


@query(f"WITH {cites_sql()} SELECT src, dst, true AS link FROM cites WHERE src % 10 > 0 AND dst % 10 > 0 UNION ALL SELECT id, NULL, false FROM meta WHERE id % 10 > 0")
def removed_nodes(spark, d):
    gone = meta(spark, d).where("id % 10 = 0").select(F.col("id").alias("node"))
    nodes, links = store.without_node(meta(spark, d).select(F.col("id").alias("node")), cites(spark, d).select("src", "dst"), gone)
    return links.withColumn("link", F.lit(True)).unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(False).alias("link")))
