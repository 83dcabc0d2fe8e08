"""The driver's queries: the test tables as a graph with two series resources, and SPARQL with its oracle SQL by name."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Catalog, DataProduct, Engine
from .operators.scratch import scratch_path
from .sources.graph import Graph, Property, TableMap
from .sources.resource import ID, Parameter, Resource, Template, TripleTemplate, Vocabulary
from .terms import DOUBLE, IRI, Literal, Variable

M, D = "urn:m:", "urn:d:"
V = Vocabulary()
PREFIXES = f"PREFIX m: <{M}> PREFIX d: <{D}> PREFIX g: <{V.namespace}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The test tables as a graph; events and lineitem as series of customers and parts."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "events", "lineitem")}
    p = lambda column, template=None: Property(column, f"{D}{template}/" if template else None)
    m = lambda name: IRI(M + name)
    ext, res, series = IRI(V.has_external_id), IRI(V.has_resource), IRI(V.has_timeseries)
    g = Graph(spark)
    g.map_table(TableMap(t["region"], f"{D}region/", "r_regionkey", {m("name"): p("r_name"), m("key"): p("r_regionkey")}, m("Region")))
    g.map_table(TableMap(t["nation"], f"{D}nation/", "n_nationkey", {m("name"): p("n_name"), m("key"): p("n_nationkey"), m("region"): p("n_regionkey", "region"), m("within"): p("n_regionkey", "region")}, m("Nation")))
    g.map_table(TableMap(t["customer"], f"{D}customer/", "c_custkey", {
        m("name"): p("c_name"), m("key"): p("c_custkey"), m("nation"): p("c_nationkey", "nation"), m("within"): p("c_nationkey", "nation"), m("balance"): p("c_acctbal"), m("segment"): p("c_mktsegment"), series: p("c_custkey", "events")}, m("Customer")))
    g.map_table(TableMap(t["supplier"], f"{D}supplier/", "s_suppkey", {m("name"): p("s_name"), m("key"): p("s_suppkey"), m("nation"): p("s_nationkey", "nation"), m("balance"): p("s_acctbal")}, m("Supplier")))
    g.map_table(TableMap(t["part"], f"{D}part/", "p_partkey", {
        m("name"): p("p_name"), m("key"): p("p_partkey"), m("brand"): p("p_brand"), m("type"): p("p_type"), m("size"): p("p_size"), m("price"): p("p_retailprice"), series: p("p_partkey", "lineitem")}, m("Part")))
    g.map_table(TableMap(t["customer"], f"{D}events/", "c_custkey", {ext: p("c_custkey"), res: Property(constant=Literal("events"))}))
    g.map_table(TableMap(t["part"], f"{D}lineitem/", "p_partkey", {ext: p("p_partkey"), res: Property(constant=Literal("lineitem"))}))
    ts, x, kind, dp = map(Variable, ("timestamp", "value", "kind", "dp"))
    common = (TripleTemplate(ID, IRI(V.has_data_point), dp), TripleTemplate(dp, IRI(V.has_value), x), TripleTemplate(dp, IRI(V.has_timestamp), ts))
    events = t["events"].selectExpr("user_id AS id", "ts AS timestamp", "value", "event_type AS kind")
    lines = t["lineitem"].selectExpr("l_partkey AS id", "l_shipdate AS timestamp", "l_extendedprice AS value")
    return Engine(spark, g, [
        Resource("events", events, Template(tuple(map(Parameter, (ID, ts, x, kind))), (*common, TripleTemplate(dp, m("kind"), kind)))),
        Resource("lineitem", lines, Template(tuple(map(Parameter, (ID, ts, x))), common))])


_POINT = "?c g:hasTimeseries ?s . ?s g:hasDataPoint ?dp . ?dp g:hasTimestamp ?t ; g:hasValue ?v . "
_CUSTOMER = "?c a m:Customer ; m:key ?key ; m:nation ?n . ?n m:name ?nation . "
_FROM = "FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"


def _round(e: str) -> str:
    return f"xsd:double(ROUND({e} * 100)) / 100e0"


def _sql_round(e: str) -> str:
    return f"CAST(floor({e} * 100 + 0.5) AS DOUBLE) / 100"


#: name: (SPARQL, oracle SQL)
CATALOG: dict[str, tuple[str, str]] = {
    # Scans and joins of the graph.
    "bgp_star": ("SELECT ?key ?name ?balance ?segment WHERE { ?c a m:Customer ; m:key ?key ; m:name ?name ; m:balance ?balance ; m:segment ?segment }",
                 "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer"),
    "bgp_chain": ("SELECT ?key ?nation ?region WHERE { ?c a m:Customer ; m:key ?key ; m:nation ?n . ?n m:name ?nation ; m:region ?r . ?r m:name ?region }",
                  "SELECT c_custkey AS key, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "bgp_constant_subject": ("SELECT ?name ?balance WHERE { d:customer\\/7 m:name ?name ; m:balance ?balance }", "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey = 7"),
    "bgp_constant_object": ("SELECT ?key WHERE { ?c a m:Customer ; m:nation d:nation\\/3 ; m:segment \"BUILDING\" ; m:key ?key }", "SELECT c_custkey AS key FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'"),
    "bgp_union_sources": ("SELECT ?name ?balance WHERE { ?x m:balance ?balance ; m:name ?name }", "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier"),
    "bgp_predicate_variable": ("SELECT ?p ?n WHERE { { SELECT ?p (COUNT(*) AS ?n) WHERE { d:nation\\/1 ?p ?o } GROUP BY ?p } }",
                               "SELECT * FROM (VALUES ('<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', CAST(1 AS BIGINT)), ('<urn:m:name>', 1), ('<urn:m:key>', 1), ('<urn:m:region>', 1), ('<urn:m:within>', 1)) AS v(p, n)"),
    # Series.
    "hybrid_filter": (f"SELECT ?key ?t ?v WHERE {{ ?c a m:Customer ; m:key ?key . {_POINT} FILTER(?t > \"2024-01-15T00:00:00Z\"^^xsd:dateTime && ?v < 20) }}",
                      "SELECT c_custkey AS key, ts AS t, value AS v FROM events JOIN customer ON user_id = c_custkey WHERE ts > TIMESTAMP '2024-01-15' AND value < 20"),
    "hybrid_constant_value": (f"SELECT ?key ?v WHERE {{ ?c a m:Customer ; m:key ?key . {_POINT} ?dp m:kind \"purchase\" . FILTER(?v > 50) }}",
                              "SELECT c_custkey AS key, value AS v FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase' AND value > 50"),
    "hybrid_one_series": (f"SELECT ?t ?v WHERE {{ BIND(1 AS ?one) d:customer\\/3 g:hasTimeseries ?s . ?s g:hasDataPoint ?dp . ?dp g:hasTimestamp ?t ; g:hasValue ?v }}", "SELECT ts AS t, value AS v FROM events WHERE user_id = 3"),
    "hybrid_two_resources": ("SELECT ?kind (COUNT(?v) AS ?n) WHERE { ?x a ?kind ; g:hasTimeseries ?s . ?s g:hasDataPoint ?dp . ?dp g:hasValue ?v } GROUP BY ?kind",
                             "SELECT '<urn:m:Customer>' AS kind, count(*) AS n FROM events JOIN customer ON user_id = c_custkey UNION ALL SELECT '<urn:m:Part>', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "sync_join": ("SELECT ?a ?b ?t ?va ?vb WHERE { ?p a m:Part ; m:key ?a ; g:hasTimeseries ?x . ?q a m:Part ; m:key ?b ; g:hasTimeseries ?y . ?x g:hasDataPoint ?d1 . ?d1 g:hasTimestamp ?t ; g:hasValue ?va . "
                  "?y g:hasDataPoint ?d2 . ?d2 g:hasTimestamp ?t ; g:hasValue ?vb . FILTER(?a < ?b && ?b < 60) }",
                  "SELECT e.l_partkey AS a, f.l_partkey AS b, e.l_shipdate AS t, e.l_extendedprice AS va, f.l_extendedprice AS vb FROM lineitem e JOIN lineitem f ON e.l_shipdate = f.l_shipdate AND e.l_partkey < f.l_partkey AND f.l_partkey < 60"),
    # Aggregates.
    "hybrid_group_sum": (f"SELECT ?nation ({_round('SUM(?v)')} AS ?total) WHERE {{ {_CUSTOMER} {_POINT} }} GROUP BY ?nation", f"SELECT n_name AS nation, {_sql_round('sum(e.value)')} AS total {_FROM} GROUP BY n_name"),
    "hybrid_group_avg": (f"SELECT ?nation ({_round('AVG(?v)')} AS ?mean) WHERE {{ {_CUSTOMER} {_POINT} }} GROUP BY ?nation", f"SELECT n_name AS nation, {_sql_round('avg(e.value)')} AS mean {_FROM} GROUP BY n_name"),
    "hybrid_group_min_max": (f"SELECT ?nation (MIN(?v) AS ?low) (MAX(?v) AS ?high) WHERE {{ {_CUSTOMER} {_POINT} }} GROUP BY ?nation", f"SELECT n_name AS nation, min(e.value) AS low, max(e.value) AS high {_FROM} GROUP BY n_name"),
    "hybrid_group_count": (f"SELECT ?nation (COUNT(?v) AS ?n_points) (COUNT(DISTINCT ?key) AS ?n_customers) WHERE {{ {_CUSTOMER} {_POINT} }} GROUP BY ?nation", f"SELECT n_name AS nation, count(e.value) AS n_points, count(DISTINCT c.c_custkey) AS n_customers {_FROM} GROUP BY n_name"),
    "sum_distinct": ("SELECT ?brand (SUM(DISTINCT ?size) AS ?sizes) WHERE { ?p a m:Part ; m:brand ?brand ; m:size ?size } GROUP BY ?brand", "SELECT p_brand AS brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand"),
    "avg_distinct": (f"SELECT ?brand ({_round('AVG(DISTINCT ?size)')} AS ?mean) WHERE {{ ?p a m:Part ; m:brand ?brand ; m:size ?size }} GROUP BY ?brand", f"SELECT p_brand AS brand, {_sql_round('avg(DISTINCT p_size)')} AS mean FROM part GROUP BY p_brand"),
    "count_star": (f"SELECT (COUNT(*) AS ?n) WHERE {{ {_CUSTOMER} {_POINT} }}", f"SELECT count(*) AS n {_FROM}"),
    "count_distinct_star": ("SELECT (COUNT(DISTINCT *) AS ?n) WHERE { SELECT ?brand ?size WHERE { ?p a m:Part ; m:brand ?brand ; m:size ?size } }", "SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part)"),
    "count_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?total) WHERE { ?x a m:Region ; m:key ?k FILTER(?k > 100) }", "SELECT count(*) AS n, CAST(coalesce(sum(r_regionkey), 0) AS BIGINT) AS total FROM region WHERE r_regionkey > 100"),
    "group_concat": ("SELECT ?region (GROUP_CONCAT(?name; SEPARATOR=\"|\") AS ?names) WHERE { SELECT ?region ?name WHERE { ?n a m:Nation ; m:name ?name ; m:region ?r . ?r m:name ?region } ORDER BY ?name } GROUP BY ?region",
                     "SELECT r_name AS region, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "group_concat_distinct": ("SELECT ?brand (GROUP_CONCAT(DISTINCT STR(?type); SEPARATOR=\",\") AS ?types) WHERE { ?p a m:Part ; m:brand ?brand ; m:type ?type } GROUP BY ?brand",
                              "SELECT p_brand AS brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand"),
    "sample": ("SELECT ?brand (SAMPLE(?b2) AS ?same) WHERE { ?p a m:Part ; m:brand ?brand BIND(?brand AS ?b2) } GROUP BY ?brand", "SELECT DISTINCT p_brand AS brand, p_brand AS same FROM part"),
    "nest": ("SELECT ?region (g:nestAggregation(?name) AS ?names) WHERE { ?n a m:Nation ; m:name ?name ; m:region ?r . ?r m:name ?region } GROUP BY ?region",
             "SELECT r_name AS region, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "having": (f"SELECT ?key (COUNT(*) AS ?n) WHERE {{ ?c a m:Customer ; m:key ?key . {_POINT} }} GROUP BY ?key HAVING(COUNT(*) > 60)", "SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60"),
    "group_by_expression": ("SELECT ?first (COUNT(*) AS ?n) WHERE { ?p a m:Part ; m:type ?type } GROUP BY (SUBSTR(?type, 1, 3) AS ?first)", "SELECT substr(p_type, 1, 3) AS first, count(*) AS n FROM part GROUP BY 1"),
    # Time.
    "group_date_parts": (f"SELECT ?year ?month ?day ?hour (COUNT(*) AS ?n) WHERE {{ ?c a m:Customer . {_POINT} BIND(YEAR(?t) AS ?year) BIND(MONTH(?t) AS ?month) BIND(DAY(?t) AS ?day) BIND(HOURS(?t) AS ?hour) }} GROUP BY ?year ?month ?day ?hour",
                         "SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL"),
    "minutes_seconds": (f"SELECT ?m5 ?sec (COUNT(*) AS ?n) WHERE {{ ?c a m:Customer . {_POINT} BIND(xsd:integer(FLOOR(MINUTES(?t) / 5)) AS ?m5) BIND(xsd:integer(FLOOR(SECONDS(?t))) AS ?sec) }} GROUP BY ?m5 ?sec",
                        "SELECT minute(ts) // 5 AS m5, CAST(second(ts) AS BIGINT) AS sec, count(*) AS n FROM events GROUP BY ALL"),
    "floor_interval": (f"SELECT ?key ?bucket (COUNT(*) AS ?n) WHERE {{ ?c a m:Customer ; m:key ?key . {_POINT} BIND(g:FloorDateTimeToSecondsInterval(?t, 3600) AS ?bucket) }} GROUP BY ?key ?bucket",
                       "SELECT user_id AS key, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY ALL"),
    "date_bin": (f"SELECT ?bucket (COUNT(*) AS ?n) WHERE {{ ?c a m:Customer . {_POINT} BIND(g:dateBin(\"P2D\", ?t, \"2024-01-01T00:00:00Z\"^^xsd:dateTime) AS ?bucket) }} GROUP BY ?bucket",
                 "SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '2024-01-01') AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "dt_raw": ("SELECT ?key WHERE { ?c a m:Customer ; m:key ?key ; g:hasTimeseries ?s . DT { timestamp = ?when, from = \"2024-01-10T00:00:00Z\", to = \"2024-01-11T00:00:00Z\", } }",
               "SELECT user_id AS key, ts AS \"when\", value AS s_value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11'"),
    "dt_agg": ("SELECT ?key WHERE { ?c a m:Customer ; m:key ?key ; g:hasTimeseries ?s . DT { from = \"2024-01-10T00:00:00Z\", aggregation = \"max\", interval = \"12h\", } }",
               "SELECT user_id AS key, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS \"timestamp\", max(value) AS s_value_max FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL"),
    "dt_multi_agg": ("SELECT ?key WHERE { ?c a m:Customer ; m:key ?key ; g:hasTimeseries ?s . DT { timeseries = ?s, aggregation = \"min\", \"count\", interval = \"1d\", } }",
                     "SELECT user_id AS key, date_trunc('day', ts) AS \"timestamp\", min(value) AS s_value_min, count(value) AS s_value_count FROM events GROUP BY ALL"),
    # Expressions.
    "bind_arithmetic": (f"SELECT ?key ?x ?y ?z WHERE {{ ?p a m:Part ; m:key ?key ; m:size ?size ; m:price ?price BIND(?size * 2 + 1 AS ?x) BIND(?price - ?size AS ?y) BIND(xsd:double(?size / 4) AS ?z) }}",
                        "SELECT p_partkey AS key, CAST(p_size * 2 + 1 AS BIGINT) AS x, p_retailprice - p_size AS y, p_size / 4.0e0 AS z FROM part"),
    "bind_if": ("SELECT ?key ?grade WHERE { ?p a m:Part ; m:key ?key ; m:size ?size BIND(IF(?size > 25, \"large\", \"small\") AS ?grade) }", "SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS grade FROM part"),
    "bind_coalesce": ("SELECT ?key ?x WHERE { ?p a m:Part ; m:key ?key ; m:size ?size BIND(COALESCE(1 / (?size - ?size), ?size) AS ?y) BIND(xsd:integer(?y) AS ?x) }", "SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS x FROM part"),
    "bind_concat": ("SELECT ?label WHERE { ?n a m:Nation ; m:name ?name ; m:key ?k BIND(CONCAT(?name, \"-\", STR(?k)) AS ?label) }", "SELECT n_name || '-' || n_nationkey AS label FROM nation"),
    "rounding": ("SELECT ?key ?a ?b ?c ?d WHERE { ?x a m:Customer ; m:key ?key ; m:balance ?v BIND(FLOOR(?v) AS ?a) BIND(CEIL(?v) AS ?b) BIND(ROUND(?v) AS ?c) BIND(ABS(?v) AS ?d) }",
                 "SELECT c_custkey AS key, floor(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal + 0.5) AS c, abs(c_acctbal) AS d FROM customer"),
    "casts": ("SELECT ?key ?i ?s ?f ?bad WHERE { ?x a m:Customer ; m:key ?key ; m:name ?name BIND(xsd:integer(SUBSTR(?name, 10)) AS ?i) BIND(xsd:string(?key) AS ?s) BIND(xsd:double(?key) AS ?f) BIND(xsd:integer(?name) AS ?bad) }",
              "SELECT c_custkey AS key, TRY_CAST(substr(c_name, 10) AS BIGINT) AS i, CAST(c_custkey AS VARCHAR) AS s, CAST(c_custkey AS DOUBLE) AS f, CAST(NULL AS BIGINT) AS bad FROM customer"),
    "unary": ("SELECT ?key ?a ?b WHERE { ?x a m:Customer ; m:key ?key ; m:balance ?v BIND(-?v AS ?a) BIND(+?v AS ?b) }", "SELECT c_custkey AS key, -c_acctbal AS a, c_acctbal AS b FROM customer"),
    "string_functions": ("SELECT ?name ?u ?l ?n ?s ?b ?a WHERE { ?p a m:Part ; m:type ?name BIND(UCASE(?name) AS ?u) BIND(LCASE(?name) AS ?l) BIND(STRLEN(?name) AS ?n) BIND(SUBSTR(?name, 2, 3) AS ?s) BIND(STRBEFORE(?name, \" \") AS ?b) BIND(STRAFTER(?name, \" \") AS ?a) }",
                         "SELECT p_type AS name, upper(p_type) AS u, lower(p_type) AS l, CAST(length(p_type) AS BIGINT) AS n, substr(p_type, 2, 3) AS s, CASE WHEN position(' ' IN p_type) > 0 THEN substr(p_type, 1, position(' ' IN p_type) - 1) ELSE '' END AS b, "
                         "CASE WHEN position(' ' IN p_type) > 0 THEN substr(p_type, position(' ' IN p_type) + 1) ELSE '' END AS a FROM part"),
    "string_tests": ("SELECT ?name WHERE { ?x a m:Nation ; m:name ?name FILTER(CONTAINS(?name, \"1\") || STRSTARTS(?name, \"NATION_2\") || STRENDS(?name, \"3\") || STRSTARTS(?name, \"A\")) }",
                     "SELECT n_name AS name FROM nation WHERE contains(n_name, '1') OR starts_with(n_name, 'NATION_2') OR ends_with(n_name, '3') OR starts_with(n_name, 'A')"),
    "regex_replace": ("SELECT ?name ?r WHERE { ?x a m:Part ; m:brand ?name FILTER(REGEX(?name, \"^brand\", \"i\")) BIND(REPLACE(?name, \"[0-9]+\", \"#\") AS ?r) }", "SELECT p_brand AS name, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS r FROM part WHERE regexp_matches(p_brand, '^brand', 'i')"),
    "hashes": ("SELECT ?name ?m ?s WHERE { ?x a m:Nation ; m:name ?name BIND(MD5(?name) AS ?m) BIND(SHA256(?name) AS ?s) }", "SELECT n_name AS name, md5(n_name) AS m, sha256(n_name) AS s FROM nation"),
    "term_functions": ("SELECT ?key ?iri ?i ?l ?num ?dt WHERE { ?x a m:Nation ; m:key ?key BIND(STR(?x) AS ?iri) BIND(ISIRI(?x) AS ?i) BIND(ISLITERAL(?key) AS ?l) BIND(ISNUMERIC(?key) AS ?num) BIND(STR(DATATYPE(?key)) AS ?dt) }",
                       "SELECT n_nationkey AS key, 'urn:d:nation/' || n_nationkey AS iri, true AS i, true AS l, true AS num, 'http://www.w3.org/2001/XMLSchema#int' AS dt FROM nation"),
    # Filters.
    "filter_in": ("SELECT ?key WHERE { ?p a m:Part ; m:key ?key ; m:size ?s FILTER(?s IN (1, 5, 3 + 4)) }", "SELECT p_partkey AS key FROM part WHERE p_size IN (1, 5, 7)"),
    "filter_not_in": ("SELECT ?key WHERE { ?p a m:Part ; m:key ?key ; m:size ?s FILTER(?s NOT IN (1, 5, 7)) }", "SELECT p_partkey AS key FROM part WHERE p_size NOT IN (1, 5, 7)"),
    "filter_or_not": ("SELECT ?key WHERE { ?p a m:Part ; m:key ?key ; m:size ?s ; m:price ?x FILTER(!(?s > 10) || ?x >= 1500 && ?s != 20) }", "SELECT p_partkey AS key FROM part WHERE NOT p_size > 10 OR p_retailprice >= 1500 AND p_size <> 20"),
    # OPTIONAL, MINUS, EXISTS, UNION, VALUES.
    "optional": ("SELECT ?key ?v WHERE { ?c a m:Customer ; m:key ?key OPTIONAL { ?c g:hasTimeseries ?s . ?s g:hasDataPoint ?dp . ?dp g:hasValue ?v . FILTER(?v > 95) } }",
                 "SELECT c_custkey AS key, value AS v FROM customer LEFT JOIN events ON user_id = c_custkey AND value > 95"),
    "optional_theta": ("SELECT ?key ?other WHERE { ?c a m:Nation ; m:key ?key ; m:region ?r OPTIONAL { ?d a m:Nation ; m:key ?other ; m:region ?r FILTER(?other > ?key + 2) } }",
                       "SELECT a.n_nationkey AS key, b.n_nationkey AS other FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey + 2"),
    "optional_unbound": ("SELECT ?key WHERE { ?p a m:Part ; m:key ?key OPTIONAL { ?p m:size ?s FILTER(?s > 20) } FILTER(!BOUND(?s)) }", "SELECT p_partkey AS key FROM part WHERE NOT p_size > 20"),
    "unbound_join": ("SELECT ?key ?other WHERE { ?a a m:Region ; m:key ?key OPTIONAL { ?a m:key ?other FILTER(?other > 2) } ?b a m:Region ; m:key ?other }",
                     "SELECT a.r_regionkey AS key, CAST(b.r_regionkey AS BIGINT) AS other FROM region a JOIN region b ON a.r_regionkey <= 2 OR a.r_regionkey = b.r_regionkey"),
    "minus": ("SELECT ?key WHERE { ?c a m:Customer ; m:key ?key MINUS { ?c m:segment \"BUILDING\" } }", "SELECT c_custkey AS key FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "minus_points": (f"SELECT ?key ?t WHERE {{ ?c a m:Customer ; m:key ?key . {_POINT} MINUS {{ ?dp g:hasValue ?x FILTER(?x > 10) }} }}", "SELECT user_id AS key, ts AS t FROM events WHERE NOT value > 10"),
    "exists": ("SELECT ?key WHERE { ?c a m:Customer ; m:key ?key FILTER EXISTS { ?c g:hasTimeseries ?s . ?s g:hasDataPoint ?dp . ?dp g:hasValue ?v FILTER(?v > 99) } }",
               "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND value > 99)"),
    "not_exists": ("SELECT ?key WHERE { ?c a m:Customer ; m:key ?key FILTER NOT EXISTS { ?c g:hasTimeseries ?s . ?s g:hasDataPoint ?dp . ?dp g:hasValue ?v FILTER(?v > 99) } }",
                   "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND value > 99)"),
    "exists_group_having": ("SELECT ?key WHERE { ?c a m:Customer ; m:key ?key FILTER EXISTS { SELECT ?c WHERE { ?c g:hasTimeseries ?s . ?s g:hasDataPoint ?dp . ?dp g:hasValue ?v } GROUP BY ?c HAVING(COUNT(?v) > 66) } }",
                            "SELECT user_id AS key FROM events GROUP BY user_id HAVING count(*) > 66"),
    "exists_correlated": ("SELECT ?key WHERE { ?n a m:Nation ; m:key ?key ; m:region ?r FILTER EXISTS { ?o a m:Nation ; m:region ?r ; m:key ?k FILTER(?k > ?key) } }",
                          "SELECT n_nationkey AS key FROM nation a WHERE EXISTS (SELECT 1 FROM nation b WHERE a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey)"),
    "exists_in_expression": ("SELECT ?key ?big WHERE { ?c a m:Nation ; m:key ?key BIND(EXISTS { ?s a m:Supplier ; m:nation ?c } AS ?big) }", "SELECT n_nationkey AS key, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS big FROM nation"),
    "union": ("SELECT ?name WHERE { { ?x a m:Supplier ; m:name ?name } UNION { ?x a m:Nation ; m:name ?name } }", "SELECT s_name AS name FROM supplier UNION ALL SELECT n_name FROM nation"),
    "union_disjoint": ("SELECT ?s ?n WHERE { { ?x a m:Supplier ; m:key ?s } UNION { ?y a m:Nation ; m:key ?n } }", "SELECT s_suppkey AS s, CAST(NULL AS INTEGER) AS n FROM supplier UNION ALL SELECT NULL, n_nationkey FROM nation"),
    "union_grouped": (f"SELECT ?kind ?key ?n WHERE {{ {{ SELECT ?kind ?key (COUNT(*) AS ?n) WHERE {{ ?c a m:Customer ; m:key ?key . {_POINT} BIND(\"low\" AS ?kind) FILTER(?v < 10) }} GROUP BY ?kind ?key }} UNION "
                      f"{{ SELECT ?kind ?key (COUNT(*) AS ?n) WHERE {{ ?c a m:Customer ; m:key ?key . {_POINT} BIND(\"high\" AS ?kind) FILTER(?v > 90) }} GROUP BY ?kind ?key }} }}",
                      "SELECT 'low' AS kind, user_id AS key, count(*) AS n FROM events WHERE value < 10 GROUP BY ALL UNION ALL SELECT 'high', user_id, count(*) FROM events WHERE value > 90 GROUP BY ALL"),
    "values": ("SELECT ?key ?label WHERE { ?r a m:Region ; m:key ?key VALUES (?key ?label) { (1 \"one\") (3 \"three\") (9 \"nine\") } }", "SELECT CAST(k AS BIGINT) AS key, l AS label FROM (VALUES (1, 'one'), (3, 'three'), (9, 'nine')) v(k, l) JOIN region ON r_regionkey = k"),
    "values_undef": ("SELECT ?key ?label WHERE { ?r a m:Region ; m:key ?key VALUES (?key ?label) { (1 \"one\") (UNDEF \"any\") } }", "SELECT CAST(r_regionkey AS BIGINT) AS key, l AS label FROM region JOIN (VALUES (1, 'one'), (NULL, 'any')) v(k, l) ON k IS NULL OR k = r_regionkey"),
    # Modifiers.
    "distinct": ("SELECT DISTINCT ?brand ?size WHERE { ?p a m:Part ; m:brand ?brand ; m:size ?size }", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part"),
    "reduced": ("SELECT REDUCED ?segment WHERE { ?c a m:Customer ; m:segment ?segment }", "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "order_limit": ("SELECT ?key ?price WHERE { ?p a m:Part ; m:key ?key ; m:price ?price } ORDER BY DESC(?price) ?key LIMIT 10", "SELECT p_partkey AS key, p_retailprice AS price FROM part ORDER BY 2 DESC, 1 LIMIT 10"),
    "order_offset": ("SELECT ?key ?price WHERE { ?p a m:Part ; m:key ?key ; m:price ?price } ORDER BY ?price ?key LIMIT 7 OFFSET 5", "SELECT p_partkey AS key, p_retailprice AS price FROM part ORDER BY 2, 1 LIMIT 7 OFFSET 5"),
    "subselect_limit": ("SELECT ?key ?nation WHERE { { SELECT ?c ?key WHERE { ?c a m:Customer ; m:key ?key ; m:balance ?b } ORDER BY DESC(?b) ?key LIMIT 5 } ?c m:nation ?n . ?n m:name ?nation }",
                        "SELECT key, n_name AS nation FROM (SELECT c_custkey AS key, c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) JOIN nation ON c_nationkey = n_nationkey"),
    # Paths.
    "path_sequence": ("SELECT ?key ?region WHERE { ?c m:key ?key ; a m:Customer ; m:nation/m:region/m:name ?region }", "SELECT c_custkey AS key, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_sequence_series": ("SELECT ?key (MAX(?v) AS ?top) WHERE { ?c a m:Customer ; m:key ?key ; g:hasTimeseries/g:hasDataPoint/g:hasValue ?v } GROUP BY ?key", "SELECT user_id AS key, max(value) AS top FROM events GROUP BY user_id"),
    "path_inverse": ("SELECT ?region ?name WHERE { ?r a m:Region ; m:name ?region ; ^m:region/m:name ?name }", "SELECT r_name AS region, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "path_alternative": ("SELECT ?x ?y WHERE { ?n a m:Nation ; m:key ?x ; (m:name|m:name) ?y }", "SELECT n_nationkey AS x, n_name AS y FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation"),
    "path_plus": ("SELECT ?key ?up WHERE { ?n a m:Nation ; m:key ?key ; m:within+ ?r . ?r m:name ?up }", "SELECT n_nationkey AS key, r_name AS up FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "path_star": ("SELECT ?key ?up WHERE { ?c a m:Customer ; m:key ?key ; m:within* ?r . ?r m:name ?up }",
                  "SELECT c_custkey AS key, c_name AS up FROM customer UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_optional": ("SELECT ?key ?up WHERE { ?n a m:Nation ; m:key ?key ; m:region? ?r . ?r m:name ?up }", "SELECT n_nationkey AS key, n_name AS up FROM nation UNION ALL SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "path_negated": ("SELECT ?name WHERE { ?n a m:Region ; m:key ?k ; !(a|m:key) ?o BIND(STR(?o) AS ?name) }", "SELECT r_name AS name FROM region"),
    # Terms made and taken apart.
    "lang_functions": ("SELECT ?key ?l ?m ?other ?none WHERE { ?n a m:Nation ; m:key ?key ; m:name ?name BIND(STRLANG(?name, \"en-GB\") AS ?tagged) BIND(LCASE(LANG(?tagged)) AS ?l) BIND(LANGMATCHES(LANG(?tagged), \"EN\") AS ?m) BIND(LANGMATCHES(LANG(?tagged), \"de\") AS ?other) BIND(LANG(?name) AS ?none) }",
                       "SELECT n_nationkey AS key, 'en-gb' AS l, true AS m, false AS other, '' AS none FROM nation"),
    "made_terms": ("SELECT ?key ?i ?is ?dt ?blank ?row WHERE { ?n a m:Nation ; m:key ?key ; m:name ?name BIND(IRI(CONCAT(\"urn:x:\", ?name)) AS ?i) BIND(ISIRI(?i) AS ?is) BIND(STRDT(STR(?key), xsd:integer) AS ?d) BIND(STR(DATATYPE(?d)) AS ?dt) BIND(ISBLANK(BNODE()) AS ?blank) BIND(ISBLANK(?n) AS ?row) }",
                   "SELECT n_nationkey AS key, '<urn:x:' || n_name || '>' AS i, true AS \"is\", 'http://www.w3.org/2001/XMLSchema#integer' AS dt, true AS blank, false AS row FROM nation"),
    "strdt_filter": ("SELECT ?key WHERE { ?n a m:Nation ; m:key ?key FILTER(STRDT(STR(?key), xsd:integer) >= 20) }", "SELECT n_nationkey AS key FROM nation WHERE n_nationkey >= 20"),
    "encode_for_uri": ("SELECT ?key ?u WHERE { ?p a m:Part ; m:key ?key ; m:type ?type BIND(ENCODE_FOR_URI(CONCAT(?type, \"/\u00e9*~+&=_.-\")) AS ?u) }", "SELECT p_partkey AS key, url_encode(p_type || '/\u00e9*~+&=_.-') AS u FROM part"),
    "random_terms": ("SELECT ?key ?a ?b ?c ?d WHERE { ?n a m:Nation ; m:key ?key BIND(RAND() AS ?r) BIND(?r >= 0 && ?r < 1 AS ?a) BIND(STRLEN(STRUUID()) AS ?b) BIND(STRSTARTS(STR(UUID()), \"urn:uuid:\") AS ?c) BIND(NOW() > \"2024-01-01T00:00:00Z\"^^xsd:dateTime AS ?d) }",
                     "SELECT n_nationkey AS key, true AS a, CAST(36 AS BIGINT) AS b, true AS c, true AS d FROM nation"),
    "long_hashes": ("SELECT ?key ?a ?b ?c WHERE { ?n a m:Nation ; m:key ?key BIND(SHA1(STR(?key)) AS ?a) BIND(SHA384(STR(?key)) AS ?b) BIND(SHA512(STR(?key)) AS ?c) }",
                    "SELECT n_nationkey AS key, sha1(CAST(n_nationkey AS VARCHAR)) AS a, b, c FROM nation JOIN (VALUES " + ", ".join(f"({k}, '{hashlib.sha384(str(k).encode()).hexdigest()}', '{hashlib.sha512(str(k).encode()).hexdigest()}')" for k in range(25)) + ") v(k, b, c) ON n_nationkey = k"),
    "same_term": ("SELECT ?key ?same ?other ?iri WHERE { ?n a m:Nation ; m:key ?key ; m:name ?name BIND(SAMETERM(?name, STR(?name)) AS ?same) BIND(SAMETERM(?key, ?name) AS ?other) BIND(SAMETERM(?n, d:nation\\/4) AS ?iri) }",
                  "SELECT n_nationkey AS key, true AS same, false AS other, n_nationkey = 4 AS iri FROM nation"),
    "time_zones": (f"SELECT ?tz (COUNT(?t) AS ?n) (COUNT(?zone) AS ?zones) (COUNT(?fixed) AS ?fixeds) WHERE {{ ?c a m:Customer . {_POINT} BIND(TZ(?t) AS ?tz) BIND(TIMEZONE(?t) AS ?zone) BIND(TIMEZONE(\"2024-01-01T00:00:00Z\"^^xsd:dateTime) AS ?fixed) }} GROUP BY ?tz",
                   "SELECT '' AS tz, count(ts) AS n, CAST(0 AS BIGINT) AS zones, count(ts) AS fixeds FROM events"),
    # Products and empty parts.
    "cross_join": ("SELECT ?r ?n WHERE { ?a a m:Region ; m:name ?r . ?b a m:Nation ; m:name ?n }", "SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation"),
    "attach_empty": (f"SELECT ?key ?v WHERE {{ ?c a m:Customer ; m:key ?key . FILTER(?key < 0) {_POINT} }}", "SELECT c_custkey AS key, value AS v FROM events JOIN customer ON user_id = c_custkey WHERE c_custkey < 0"),
    "optional_empty": ("SELECT ?key ?v WHERE { ?n a m:Nation ; m:key ?key OPTIONAL { ?n g:hasTimeseries ?s . ?s g:hasDataPoint ?dp . ?dp g:hasValue ?v } }", "SELECT n_nationkey AS key, CAST(NULL AS DOUBLE) AS v FROM nation"),
    "group_concat_mixed_order": ("SELECT ?brand (GROUP_CONCAT(?label; SEPARATOR=\",\") AS ?labels) WHERE { SELECT ?brand ?label WHERE { ?p a m:Part ; m:key ?key ; m:brand ?brand ; m:size ?size BIND(CONCAT(STR(?size), \":\", STR(?key)) AS ?label) } ORDER BY DESC(?size) ?key } GROUP BY ?brand",
                                 "SELECT p_brand AS brand, string_agg(p_size || ':' || p_partkey, ',' ORDER BY p_size DESC, p_partkey) AS labels FROM part GROUP BY p_brand"),
}


def run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).query(PREFIXES + text)


def catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data product as a view, and SQL over it."""
    product = DataProduct(PREFIXES + f"SELECT ?nation ?key ?v WHERE {{ {_CUSTOMER} {_POINT} }}", {"key": "bigint", "v": "double"})
    Catalog({"customer_points": product}).register(engine(spark, sf_dir))
    return spark.sql("SELECT nation, count(DISTINCT key) AS customers, count(v) AS points FROM customer_points WHERE v > 10 GROUP BY nation")


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")


def _ask(graph: Graph, text: str, resources: tuple = (), **k) -> DataFrame:
    return Engine(graph.spark, graph, resources, V, **k).query(PREFIXES + text)


def _named(spark: SparkSession, sf_dir: str) -> Graph:
    nation, region = _nations(spark, sf_dir)
    name = IRI(M + "name")
    nations = Graph(spark).map_table(TableMap(nation, f"{D}nation/", "n_nationkey", {name: Property("n_name"), IRI(M + "region"): Property("n_regionkey", f"{D}region/")}))
    regions = Graph(spark).map_table(TableMap(region, f"{D}region/", "r_regionkey", {name: Property("r_name")}))
    return Graph(spark).add_graph(IRI(M + "nations"), nations).add_graph(IRI(M + "regions"), regions)


def named_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join over two named graphs."""
    return _ask(_named(spark, sf_dir), "SELECT ?name ?region WHERE { GRAPH m:nations { ?n m:name ?name ; m:region ?r } GRAPH m:regions { ?r m:name ?region } }")


def named_graph_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the graph they are in."""
    return _ask(_named(spark, sf_dir), "SELECT ?g (COUNT(?name) AS ?n) WHERE { GRAPH ?g { ?x m:name ?name } } GROUP BY ?g")


def service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join with a graph that is known as a service."""
    g = _named(spark, sf_dir)
    g.named[M + "nations"].add_service(IRI(M + "regions"), g.named[M + "regions"])
    return _ask(g.named[M + "nations"], "SELECT ?name ?region WHERE { ?n m:name ?name ; m:region ?r SERVICE m:regions { ?r m:name ?region } }")


def _loaded(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and regions, written as N-Triples and loaded again."""
    nation, region = _nations(spark, sf_dir)
    line = lambda s, k, p, o: F.concat(F.lit(f"<{D}{s}/"), F.col(k).cast("string"), F.lit(f"> <{M}{p}> "), o, F.lit(" ."))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    lines = [nation.select(line("nation", "n_nationkey", "name", quoted("n_name"))), region.select(line("region", "r_regionkey", "name", F.concat(quoted("r_name"), F.lit("@en")))),
             nation.select(line("nation", "n_nationkey", "key", F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer>')))),
             nation.select(line("nation", "n_nationkey", "within", F.concat(F.lit(f"<{D}region/"), F.col("n_regionkey").cast("string"), F.lit(">"))))]
    path = scratch_path(nation)
    functools.reduce(DataFrame.union, lines).write.text(path)
    return Graph(spark).load_ntriples(path)


def loaded_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with typed and tagged literals over loaded triples."""
    return _ask(_loaded(spark, sf_dir), "SELECT ?key ?name ?region ?l WHERE { ?n m:key ?key ; m:name ?n1 BIND(STR(?n1) AS ?name) ?n m:within ?r . ?r m:name ?tagged BIND(STR(?tagged) AS ?region) BIND(LANG(?tagged) AS ?l) FILTER(?key > 3) }")


def loaded_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure over loaded triples."""
    return _ask(_loaded(spark, sf_dir), "SELECT ?key ?up WHERE { ?n m:key ?key ; m:within+ ?r . ?r m:name ?tagged BIND(STR(?tagged) AS ?up) }")


def _turtle(spark: SparkSession) -> Graph:
    return Graph(spark).load_turtle(f"""@prefix m: <{M}> . @prefix d: <{D}> . @prefix g: <{V.namespace}> .
d:first a m:Sensor ; m:label "one", "uno" ; g:hasTimeseries [ g:hasExternalId 1 ; g:hasResource "events" ] .
d:second a m:Sensor ; m:label "two" ; g:hasTimeseries [ g:hasExternalId 2 ; g:hasResource "events" ] .
d:third a m:Sensor ; m:label "three" .
""")


def turtle_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loaded Turtle graph over a series whose store is asked for few ids; a function and an aggregate by IRI."""
    from .sources.resource import series_template

    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS id", "ts AS timestamp", "value")
    resource = Resource("events", lambda ids: events if ids is None else events.where(F.col("id").isin([int(i) for i in ids])), series_template(V), push_ids=10)
    text = f"SELECT ?label (COUNT(?v) AS ?n) (g:spread(?w) AS ?spread) WHERE {{ ?c a m:Sensor ; m:label ?label . {_POINT} BIND(g:half(?v) AS ?w) }} GROUP BY ?label"
    return _ask(_turtle(spark), text, (resource,), functions={V.namespace + "half": lambda v: (v[0] / 2, v[1])}, aggregates={V.namespace + "spread": lambda c: (F.max(c) - F.min(c), DOUBLE)})


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "named_graph": (named_graph, "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "service": (service, "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "named_graph_variable": (named_graph_variable, "SELECT '<urn:m:nations>' AS g, count(*) AS n FROM nation UNION ALL SELECT '<urn:m:regions>', count(*) FROM region"),
    "loaded_triples": (loaded_triples, "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, r_name AS region, 'en' AS l FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3"),
    "loaded_path": (loaded_path, "SELECT CAST(n_nationkey AS BIGINT) AS key, r_name AS up FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "turtle_series": (turtle_series, "SELECT label, count(value) AS n, max(value / 2) - min(value / 2) AS spread FROM events JOIN (VALUES (1, 'one'), (1, 'uno'), (2, 'two')) v(id, label) ON user_id = id GROUP BY label"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(text) for name, (text, _) in CATALOG.items()} | {"catalog_view": catalog_view} | {name: f for name, (f, _) in EXTRA.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (CATALOG | EXTRA).items()} | {
        "catalog_view": f"SELECT n_name AS nation, count(DISTINCT c.c_custkey) AS customers, count(e.value) AS points {_FROM} WHERE e.value > 10 GROUP BY n_name"}


flagship = functools.partial(run, CATALOG["hybrid_group_avg"][0])
