"""Queries of the graph engine by name, over the star schema, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import counts, distances, graph, ids, links, outliers, plot, shortest_paths
from ..scratch import materialize, scratch_path
from ..sources import gfa, scan, sinks, tables
from . import runs, star

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

STEPS = """steps AS (SELECT c_nationkey::BIGINT AS genome, l_orderkey::BIGINT AS path, l_partkey::BIGINT AS seg,
  CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS orient, l_quantity::BIGINT AS overlap,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus DESC, l_quantity) - 1 AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
RAW = STEPS + """, raw AS (SELECT * FROM (SELECT genome, path, pos, overlap, seg AS from_id, orient AS from_orient,
  lead(seg) OVER w AS to_id, lead(orient) OVER w AS to_orient FROM steps WINDOW w AS (PARTITION BY path ORDER BY pos)) WHERE to_id IS NOT NULL)"""
CANON = RAW + """, canon AS (SELECT genome, path, pos, overlap_ AS overlap, least(from_id, to_id) AS from_id, greatest(from_id, to_id) AS to_id,
  CASE WHEN from_id > to_id AND from_orient = to_orient THEN CASE WHEN from_orient = '+' THEN 'RR' ELSE 'FF' END
       ELSE translate(from_orient || to_orient, '+-', 'FR') END AS edge_type
  FROM (SELECT raw.*, s.overlap AS overlap_ FROM raw JOIN steps s ON s.path = raw.path AND s.pos = raw.pos + 1))"""
MAIN = CANON + """, sides AS (SELECT DISTINCT 2 * from_id + (edge_type[1] = 'F')::INT AS a, 2 * to_id + (edge_type[2] = 'R')::INT AS b FROM canon),
  u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, 1.0::DOUBLE AS w FROM sides WHERE a <> b
        UNION ALL SELECT 2 * p_partkey, 2 * p_partkey + 1, (length(p_name) - 5)::DOUBLE FROM part),
  g AS (SELECT a::BIGINT AS a, b::BIGINT AS b, min(w) AS w FROM u GROUP BY a, b),
  main AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g)"""
GENOMES = CANON + """, gl AS (SELECT DISTINCT genome, from_id, to_id, edge_type FROM canon),
  gs AS (SELECT genome, 2 * from_id + (edge_type[1] = 'F')::INT AS a, 2 * to_id + (edge_type[2] = 'R')::INT AS b FROM gl),
  gm AS (SELECT DISTINCT genome, unnest([from_id, to_id]) AS u FROM gl),
  gu AS (SELECT genome, least(a, b) AS a, greatest(a, b) AS b, 1.0::DOUBLE AS w FROM gs WHERE a <> b
         UNION ALL SELECT genome, 2 * u, 2 * u + 1, (length(p_name) - 5)::DOUBLE FROM gm JOIN part ON p_partkey = u),
  gg AS (SELECT genome, a::BIGINT AS a, b::BIGINT AS b, min(w) AS w FROM gu GROUP BY genome, a, b),
  gedges AS (SELECT genome, a, b, w FROM gg UNION ALL SELECT genome, b, a, w FROM gg)"""
PAIRS = f"""n AS (SELECT max(p_partkey)::BIGINT + 1 AS n FROM part),
  pairs AS (SELECT qid, (i * 97 + 5) % n AS v, (i * 97 + 5 + j * 37) % n AS w
            FROM (SELECT q AS qid, q // {star.N_TARGETS} AS i, q % {star.N_TARGETS} AS j, n
                  FROM (SELECT n, unnest(range((n + {star.PARTS_PER_SOURCE - 1}) // {star.PARTS_PER_SOURCE} * {star.N_TARGETS})) AS q FROM n))),
  queries AS (SELECT qid, v, w, round(pv.p_retailprice / (pv.p_retailprice + pw.p_retailprice), 6) AS score
              FROM pairs JOIN part pv ON pv.p_partkey = v JOIN part pw ON pw.p_partkey = w)"""
#: The text of ``star.gfa_lines``, line by line.
GFA = CANON + """, text AS (SELECT rec, key, pos, row_number() OVER (ORDER BY rec, key, pos) AS line_no FROM (
    SELECT 0 AS rec, p_partkey::BIGINT AS key, 0 AS pos FROM part
    UNION ALL SELECT 1, path, pos FROM raw WHERE path % 3 = 0
    UNION ALL SELECT DISTINCT 2, path, 0 FROM steps)),
  seg AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_partkey::BIGINT AS part, replace(p_name, ' ', '') AS sequence FROM part),
  ref AS (SELECT row_number() OVER (ORDER BY min(path)) - 1 AS ref_id, genome, min(path) AS first FROM steps GROUP BY genome)"""


def _search(edges: str, seeds: str, name: str = "reach") -> str:
    """Distances (genome, src, node, dist) in a graph; seeds has (genome, src)."""
    return f"""{name}(genome, src, node, dist) USING KEY (genome, src, node) AS (
  SELECT genome, src, 2 * src + side, 0.0::DOUBLE FROM {seeds}, (VALUES (0), (1)) s(side)
  UNION
  SELECT genome, src, node, dist FROM (
    SELECT d.genome, d.src, e.b AS node, min(d.dist + e.w) AS dist
    FROM {name} d JOIN {edges} e ON e.genome = d.genome AND e.a = d.node
    LEFT JOIN recurring.{name} k ON k.genome = d.genome AND k.src = d.src AND k.node = e.b
    GROUP BY d.genome, d.src, e.b
    HAVING any_value(k.dist) IS NULL OR min(d.dist + e.w) < any_value(k.dist)))"""


MAIN_FOUND = f"""WITH RECURSIVE {MAIN}, {PAIRS}, medges AS (SELECT 0::BIGINT AS genome, a, b, w FROM main),
  seeds AS (SELECT DISTINCT 0::BIGINT AS genome, v AS src FROM pairs WHERE v <> w), {_search("medges", "seeds")},
  found AS (SELECT qid, min(dist) AS distance FROM pairs JOIN reach ON src = v AND node // 2 = w WHERE v <> w GROUP BY qid)"""
GENOME_FOUND = f"""WITH RECURSIVE {GENOMES}, {PAIRS},
  seeds AS (SELECT DISTINCT genome, v AS src FROM pairs JOIN gm ON gm.u = v WHERE v <> w), {_search("gedges", "seeds")},
  found AS (SELECT qid, genome, min(dist) AS distance FROM pairs JOIN reach ON src = v AND node // 2 = w WHERE v <> w GROUP BY qid, genome)"""
SCORED = """scored AS (SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS qid, l_partkey::BIGINT AS v, (l_suppkey + 1000000)::BIGINT AS w,
  round(1000.0::DOUBLE / (1 + l_orderkey * 7919 % 9973), 4) AS score, CASE WHEN floor(l_extendedprice)::BIGINT % 11 <> 0 THEN floor(l_extendedprice) END AS distance,
  l_quantity::BIGINT % 13 AS cnt FROM lineitem)"""
LD, COUNT = 20000, 3
MAXIMA = f"""{SCORED}, passing AS (SELECT * FROM scored WHERE cnt >= {COUNT} AND coalesce(distance, -1) >= {LD}),
  maxima AS (SELECT vertex, max(score) AS score FROM (SELECT unnest([v, w]) AS vertex, score FROM passing) GROUP BY vertex HAVING max(score) > 0)"""
TUKEY = f"""{MAXIMA}, o AS (SELECT list_sort(list(score)) AS x, count(*) AS n FROM maxima),
  t AS (SELECT n, x[least(n - 1, n // 4) + 1] AS q1, x[least(n - 1, 3 * n // 4) + 1] AS q3, x[n - least(n - 1, 10)] AS nth_score FROM o),
  fences AS (SELECT n, q1, q3, q3 + 1.5 * (q3 - q1) AS outlier, q3 + 3 * (q3 - q1) AS extreme, nth_score FROM t)"""


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Scalars and parsing


@query("step_decode", f"WITH {STEPS} SELECT path, pos::BIGINT AS pos, seg, orient FROM steps")
def _(spark, sf_dir):
    told = star.paths(spark, sf_dir).select("path", F.posexplode("steps").alias("pos", "s")).select("path", F.col("pos").cast("bigint").alias("pos"), F.concat(F.col("s.seg").cast("string"), "s.orient").alias("step"))
    return told.select("path", "pos", scalars.step_name(F.col("step")).cast("bigint").alias("seg"), scalars.step_orientation(F.col("step")).alias("orient"))


@query("split_fields", """WITH t AS (SELECT c_custkey, c_name || ',,' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ',' ELSE '' END AS s FROM customer)
  SELECT c_custkey::BIGINT AS id, len(CASE WHEN s[-1] = ',' THEN string_split(s, ',')[:-2] ELSE string_split(s, ',') END)::BIGINT AS n,
         CASE WHEN s[-1] = ',' THEN string_split(s, ',')[:-2] ELSE string_split(s, ',') END[3] AS third FROM t""")
def _(spark, sf_dir):
    t = star.table(spark, sf_dir, "customer")
    f = scalars.split_fields(F.concat("c_name", F.lit(",,"), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, ",").otherwise("")), ",")
    return t.select(F.col("c_custkey").cast("bigint").alias("id"), F.size(f).cast("bigint").alias("n"), scalars.field(f, 2).alias("third"))


@query("path_names", """SELECT o_orderkey::BIGINT AS path, 'g' || o_custkey AS reference, 's' || o_orderkey AS sequence FROM orders""")
def _(spark, sf_dir):
    name = F.concat(F.lit("Reference:g"), F.col("o_custkey").cast("string"), F.lit("_Sequence:s"), F.col("o_orderkey").cast("string"))
    return star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("path"), scalars.path_reference(name).alias("reference"), scalars.path_sequence(name).alias("sequence"))


@query("edge_weight", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 0 THEN l_quantity::BIGINT::VARCHAR WHEN 1 THEN l_quantity::BIGINT || 'M' WHEN 2 THEN '2.5e1' WHEN 3 THEN '5d' ELSE '' END AS x FROM lineitem)
  SELECT l_orderkey::BIGINT AS path, l_linenumber::BIGINT AS line, l_partkey::BIGINT AS seg,
         CASE WHEN regexp_full_match(x, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN x::DOUBLE ELSE 1.0 END AS weight FROM t""")
def _(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint").cast("string")
    r = F.col("l_linenumber") % 5
    x = F.when(r == 0, q).when(r == 1, F.concat(q, F.lit("M"))).when(r == 2, "2.5e1").when(r == 3, "5d").otherwise("")
    return star.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("path"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").cast("bigint").alias("seg"), scalars.edge_weight(x).alias("weight"))


@query("number_formats", """SELECT p_partkey::BIGINT AS id, replace(format('{:,}', p_partkey * 7919), ',', ' ') AS spaced, floor(p_size * 100 / (p_partkey + 3)) / 100 AS ratio, format('{:.6g}', p_retailprice * p_size / 7) AS short, trunc(p_retailprice)::BIGINT AS whole FROM part""")
def _(spark, sf_dir):
    t = star.table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").cast("bigint").alias("id"), scalars.spaced_thousands(F.col("p_partkey") * 7919).alias("spaced"), scalars.truncated_ratio(F.col("p_size"), F.col("p_partkey") + 3).alias("ratio"), scalars.significant(F.col("p_retailprice") * F.col("p_size") / 7).alias("short"), scalars.whole(F.col("p_retailprice")).alias("whole"))


# Text files, written in many parts and read back


def _parsed(spark, sf_dir):
    return gfa.read_gfa(spark, star.write_gfa(spark, sf_dir))


@query("gfa_segments", f"WITH {GFA} SELECT id, part::VARCHAR AS name, sequence FROM seg")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).segments.select("id", "name", "sequence")


@query("gfa_links", f"""WITH {GFA}, c AS (SELECT f.id AS x, t.id AS y, from_orient, to_orient, s.overlap, line_no FROM raw r JOIN steps s ON s.path = r.path AND s.pos = r.pos + 1
    JOIN text ON rec = 1 AND key = r.path AND text.pos = r.pos JOIN seg f ON f.part = from_id JOIN seg t ON t.part = to_id)
  SELECT least(x, y) AS from_id, greatest(x, y) AS to_id, CASE WHEN x > y AND from_orient = to_orient THEN CASE WHEN from_orient = '+' THEN 'RR' ELSE 'FF' END
         ELSE translate(from_orient || to_orient, '+-', 'FR') END AS edge_type, overlap, min(line_no) AS seq FROM c GROUP BY 1, 2, 3, 4""")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).links.select("from_id", "to_id", "edge_type", "overlap", "seq")


@query("gfa_references", f"WITH {GFA} SELECT ref_id, 'n' || genome AS reference, 'o' || first AS sequence FROM ref")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).references


@query("gfa_steps", f"""WITH {GFA} SELECT ref_id, line_no, s.pos::BIGINT AS pos, id AS seg, orient FROM steps s JOIN ref USING (genome) JOIN seg ON part = s.seg
  JOIN text ON rec = 2 AND key = path""")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).paths.select("ref_id", "line_no", F.posexplode("steps").alias("pos", "s")).select("ref_id", "line_no", F.col("pos").cast("bigint").alias("pos"), "s.seg", "s.orient")


@query("gfa_counts", f"WITH {GFA} SELECT 2 AS rec, count(DISTINCT path) AS n_paths, count(*) AS n_steps, genome AS reference FROM steps GROUP BY genome")
def _(spark, sf_dir):
    found = _parsed(spark, sf_dir)
    sums = found.paths.groupBy("ref_id").agg(F.count("*").alias("n_paths"), F.sum(F.size("steps")).alias("n_steps"))
    return sums.join(found.references, "ref_id").select(F.lit(2).alias("rec"), "n_paths", "n_steps", F.expr("CAST(substr(reference, 2) AS BIGINT)").alias("reference"))


ERRORS = f"""WITH {GFA} SELECT line_no, CASE WHEN rec = 0 AND key % 50 = 7 THEN 'a segment needs a name and a sequence'
    WHEN rec = 1 AND key % 50 = 9 THEN 'a link''s overlap isn''t a number' WHEN rec = 2 AND key % 50 = 3 THEN 'a path''s name needs Reference: and _Sequence:'
    ELSE 'empty line' END AS message FROM text WHERE rec = 0 AND key % 50 IN (7, 8) OR rec = 1 AND key % 50 = 9 OR rec = 2 AND key % 50 = 3
  UNION ALL SELECT -1, 'a path names the unknown segment ' || p_partkey FROM part WHERE p_partkey % 50 = 8 AND p_partkey IN (SELECT seg FROM steps)
    AND p_partkey NOT IN (SELECT unnest([from_id, to_id]) FROM raw WHERE path % 3 = 0)
  UNION ALL SELECT -1, 'a link names the undefined segment ' || p_partkey FROM part WHERE p_partkey % 50 = 8 AND p_partkey IN (SELECT unnest([from_id, to_id]) FROM raw WHERE path % 3 = 0)"""


@query("gfa_errors", ERRORS)
def _(spark, sf_dir):
    """Text with faults: segments without a sequence, blank lines, links without an overlap, paths without a sequence name."""
    of = lambda rec, r: (F.col("rec") == rec) & (F.col("key") % 50 == r)
    broken = F.when(of(0, 7), F.regexp_replace("value", "\t[^\t]*$", "")).when(of(0, 8), "").when(of(1, 9), F.regexp_replace("value", "\t[^\t]*$", "\t*")).when(of(2, 3), F.replace("value", F.lit("_Sequence:"), F.lit("_"))).otherwise(F.col("value"))
    path = scratch_path(spark, "gfa")
    star.gfa_lines(spark, sf_dir).repartitionByRange(8, "rec", "key", "pos").sortWithinPartitions("rec", "key", "pos").select(broken.alias("value")).write.text(path)
    lines = materialize(scan.numbered_lines(spark, path).drop("file"), "lines")
    found = gfa.records(lines)
    return gfa.errors(lines, gfa.segment_records(found), gfa.link_records(found), gfa.path_records(found)).select(F.coalesce("line_no", F.lit(-1).cast("bigint")).alias("line_no"), "message")


def _outputs(spark, sf_dir):
    """What parsing the text and writing its files left, and the stem of their names."""
    stem = scratch_path(spark, "run") + "/out"
    runs.parse_gfa(spark, star.write_gfa(spark, sf_dir), stem)
    return stem


@query("written_unitigs", f"WITH {GFA} SELECT id AS unitig, sequence FROM seg")
def _(spark, sf_dir):
    return tables.read_unitigs(spark, _outputs(spark, sf_dir) + ".unitigs", 1)


WRITTEN = """c AS (SELECT r.genome, f.id AS x, t.id AS y, from_orient, to_orient, s.overlap FROM raw r JOIN steps s ON s.path = r.path AND s.pos = r.pos + 1 JOIN seg f ON f.part = from_id JOIN seg t ON t.part = to_id {where}),
  w AS (SELECT DISTINCT {genome} least(x, y) AS from_id, greatest(x, y) AS to_id, CASE WHEN x > y AND from_orient = to_orient THEN CASE WHEN from_orient = '+' THEN 'RR' ELSE 'FF' END
        ELSE translate(from_orient || to_orient, '+-', 'FR') END AS edge_type, overlap FROM c)"""


@query("written_edges", f"WITH {GFA}, {WRITTEN.format(where='WHERE r.path % 3 = 0', genome='')} SELECT from_id, to_id, edge_type, overlap FROM w")
def _(spark, sf_dir):
    return tables.read_links(spark, _outputs(spark, sf_dir) + ".edges").select("from_id", "to_id", "edge_type", "overlap")


@query("written_genome_edges", f"WITH {GFA}, {WRITTEN.format(where='', genome='genome,')} SELECT ref_id AS genome, from_id, to_id, edge_type, overlap FROM w JOIN ref USING (genome)")
def _(spark, sf_dir):
    return tables.read_genome_links(spark, _outputs(spark, sf_dir) + ".paths").select("genome", "from_id", "to_id", "edge_type", "overlap")


@query("written_fasta", f"""WITH {GFA}, long AS (SELECT path FROM steps GROUP BY path HAVING count(*) <> 1),
  have AS (SELECT DISTINCT genome, seg FROM steps JOIN long USING (path)),
  grid AS (SELECT ref_id, first, string_agg(CASE WHEN h.seg IS NULL THEN 'a' ELSE 'c' END, '' ORDER BY id) AS p FROM ref CROSS JOIN seg LEFT JOIN have h ON h.genome = ref.genome AND h.seg = part GROUP BY 1, 2)
  SELECT unnest(list_concat(['>o' || first], list_transform(range(0, length(p), 60), lambda i: substr(p, i + 1, 60)))) AS value FROM grid""")
def _(spark, sf_dir):
    return spark.read.text(_outputs(spark, sf_dir) + ".fasta").select("value")


QUERY_TEXT = f"""SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus, l_quantity, l_discount) - 1 AS qid, l_partkey::BIGINT AS v, l_suppkey::BIGINT AS w,
  trunc(l_extendedprice)::DOUBLE AS distance, l_linestatus = 'F' AS flag, l_discount AS score, l_quantity::BIGINT AS cnt FROM lineitem"""


def _query_file(spark, sf_dir):
    """Line items as a file of queries in many parts."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_quantity", "l_discount"]
    path = scratch_path(spark, "queries")
    flag = F.when(F.col("l_linestatus") == "F", "1").otherwise("0")
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_extendedprice")), flag, F.col("l_discount").cast("string"), F.col("l_quantity").cast("bigint").cast("string"))
    star.table(spark, sf_dir, "lineitem").repartitionByRange(8, *order).sortWithinPartitions(*order).select(text.alias("value")).write.text(path)
    return path


@query("read_queries", f"{QUERY_TEXT}")
def _(spark, sf_dir):
    return tables.read_queries(spark, _query_file(spark, sf_dir), layout=5, outliers_only=True)


@query("limited_queries", f"SELECT * FROM ({QUERY_TEXT}) WHERE qid < 1000")
def _(spark, sf_dir):
    return tables.read_queries(spark, _query_file(spark, sf_dir), n_queries=1000, outliers_only=True)


@query("read_edges", f"SELECT v, w, CASE WHEN qid % 2 = 0 THEN distance ELSE 1.0 END AS weight FROM (SELECT *, l_linenumber AS qid FROM (SELECT l_partkey::BIGINT AS v, l_suppkey::BIGINT AS w, trunc(l_extendedprice)::DOUBLE AS distance, l_linenumber FROM lineitem))")
def _(spark, sf_dir):
    path = scratch_path(spark, "edges")
    weight = F.floor("l_extendedprice").cast("bigint").cast("string")
    text = F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, weight).otherwise(F.concat(weight, F.lit("M"))))
    star.table(spark, sf_dir, "lineitem").repartition(8).select(text.alias("value")).write.text(path)
    return tables.read_edges(spark, path)


@query("read_plot_rows", f"SELECT qid + 1 AS line_no, q.v, q.w, distance, flag, score, x.cnt FROM ({QUERY_TEXT}) q JOIN (SELECT qid, w::DOUBLE AS cnt FROM ({QUERY_TEXT})) x USING (qid) WHERE x.cnt >= 5")
def _(spark, sf_dir):
    path = _query_file(spark, sf_dir)
    rows = tables.read_plot_rows(spark, path).withColumn("distance", F.floor("distance").cast("double"))
    lines = materialize(scan.field_lines(spark, path), "lines")
    other = scratch_path(spark, "counts")
    f = F.col("fields")
    lines.repartitionByRange(8, "line_no").sortWithinPartitions("line_no").select(F.concat_ws(" ", scalars.field(f, 0), scalars.field(f, 0), scalars.field(f, 1)).alias("value")).write.text(other)
    counts_ = tables.read_plot_counts(spark, other).select("line_no", "cnt")
    return plot.with_counts(rows, counts_, 5).join(counts_, "line_no").select("line_no", "v", "w", "distance", "flag", "score", "cnt")


# Links


@query("adjacency_links", f"WITH {CANON} SELECT r.genome, r.path, r.pos::BIGINT AS pos, from_id, from_orient, to_id, to_orient, s.overlap FROM raw r JOIN steps s ON s.path = r.path AND s.pos = r.pos + 1")
def _(spark, sf_dir):
    return star.raw_links(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))


@query("canonical_links", f"WITH {CANON} SELECT genome, path, pos::BIGINT AS pos, overlap, from_id, to_id, edge_type FROM canon")
def _(spark, sf_dir):
    return star.canonical_links(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))


@query("distinct_links", f"WITH {CANON} SELECT from_id, to_id, edge_type, overlap, min(path * 100 + pos)::BIGINT AS seq FROM canon GROUP BY ALL")
def _(spark, sf_dir):
    return links.distinct_links(star.canonical_links(spark, sf_dir), (F.col("path") * 100 + F.col("pos")).cast("bigint"))


@query("genome_links", f"WITH {CANON} SELECT genome, from_id, to_id, edge_type, overlap, min(path * 100 + pos)::BIGINT AS seq FROM canon GROUP BY ALL")
def _(spark, sf_dir):
    return links.distinct_links(star.canonical_links(spark, sf_dir), (F.col("path") * 100 + F.col("pos")).cast("bigint"), ("genome",))


@query("link_lines", f"WITH {CANON} SELECT DISTINCT from_id || ' ' || to_id || ' ' || edge_type || ' ' || overlap || 'M' AS value FROM canon")
def _(spark, sf_dir):
    return sinks.link_lines(links.distinct_links(star.canonical_links(spark, sf_dir), F.col("path"))).select("value")


@query("zero_overlap_filter", f"WITH {CANON} SELECT genome, path, pos::BIGINT AS pos, from_id, to_id, edge_type, overlap % 3 AS overlap FROM canon WHERE overlap % 3 <> 0")
def _(spark, sf_dir):
    return links.nonzero_overlap(star.canonical_links(spark, sf_dir).withColumn("overlap", F.col("overlap") % 3).withColumn("pos", F.col("pos").cast("bigint")))


# Identifiers


@query("segment_ids", f"""WITH {STEPS}, s AS (SELECT 'U' || seg AS name, min(path * 100 + pos) AS k FROM steps GROUP BY seg)
  SELECT name, row_number() OVER (ORDER BY k) - 1 AS id FROM s""")
def _(spark, sf_dir):
    seen = star.paths(spark, sf_dir).select("path", F.posexplode("steps").alias("pos", "s")).select(F.concat(F.lit("U"), F.col("s.seg").cast("string")).alias("name"), (F.col("path") + 1).alias("line_no"), F.lit(0).alias("class"), "pos")
    return ids.first_seen(seen)


@query("reference_ids", f"""WITH {STEPS}, r AS (SELECT 'g' || genome AS reference, min(path) AS k, 's' || min(path) AS sequence FROM steps GROUP BY genome)
  SELECT row_number() OVER (ORDER BY k) - 1 AS ref_id, reference, sequence FROM r""")
def _(spark, sf_dir):
    return ids.references(star.paths(spark, sf_dir).select(F.concat(F.lit("g"), F.col("genome").cast("string")).alias("reference"), F.concat(F.lit("s"), F.col("path").cast("string")).alias("sequence"), F.col("path").alias("line_no")))


@query("undefined_segments", f"WITH {STEPS} SELECT DISTINCT seg::VARCHAR AS name FROM steps WHERE seg NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(spark, sf_dir):
    used = star.paths(spark, sf_dir).select(F.explode("steps.seg").alias("seg")).select(F.col("seg").cast("string").alias("name"))
    return gfa.undefined_segments(used, star.table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("name")))


@query("conflicting_sequences", "SELECT p_name AS name, count(DISTINCT p_brand) AS n_sequences FROM part WHERE p_brand <> '' GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def _(spark, sf_dir):
    return gfa.conflicting_sequences(star.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("sequence")))


@query("overlap_count_check", f"""WITH {STEPS}, p AS (SELECT path, count(*) AS n FROM steps GROUP BY path)
  SELECT path FROM p WHERE n > 1 AND n - path % 3 NOT IN (n, n - 1)""")
def _(spark, sf_dir):
    p = star.paths(spark, sf_dir).withColumn("overlaps", F.expr("slice(overlaps, 1, greatest(0, size(steps) - CAST(path % 3 AS INT)))"))
    return gfa.bad_overlap_counts(p).select("path")


# Counts


def _counts(spark, sf_dir):
    return counts.unitig_counts(star.paths(spark, sf_dir), "genome")


COUNTS = f"WITH {STEPS}, long AS (SELECT path FROM steps GROUP BY path HAVING count(*) <> 1), c AS (SELECT genome, seg AS unitig, count(*) AS cnt FROM steps JOIN long USING (path) GROUP BY genome, seg)"


@query("unitig_counts", f"{COUNTS} SELECT * FROM c")
def _(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("max_counts", f"{COUNTS} SELECT unitig, max(cnt) AS cnt FROM c GROUP BY unitig")
def _(spark, sf_dir):
    return counts.max_counts(_counts(spark, sf_dir))


@query("repeat_filter", f"{COUNTS} SELECT unitig || ' ' || cnt AS value, genome FROM c WHERE cnt > 1")
def _(spark, sf_dir):
    return counts.repeated(_counts(spark, sf_dir)).select(F.concat_ws(" ", "unitig", "cnt").alias("value"), "genome")


DENSE = f"{COUNTS}, d AS (SELECT n_nationkey::BIGINT AS genome, p_partkey::BIGINT AS unitig, coalesce(cnt, 0) AS cnt FROM nation CROSS JOIN part LEFT JOIN c ON c.genome = n_nationkey AND c.unitig = p_partkey)"


def _grid(spark, sf_dir):
    return star.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("genome")), star.unitigs(spark, sf_dir)


@query("dense_counts", f"{DENSE} SELECT * FROM d")
def _(spark, sf_dir):
    return counts.dense_counts(_counts(spark, sf_dir), *_grid(spark, sf_dir), "genome")


@query("presence_matrix", f"{DENSE} SELECT genome, unitig, CASE WHEN cnt > 0 THEN 'c' ELSE 'a' END AS presence FROM d")
def _(spark, sf_dir):
    return counts.presence_matrix(_counts(spark, sf_dir), *_grid(spark, sf_dir), "genome")


@query("fasta_rows", f"""{DENSE}, s AS (SELECT genome, string_agg(CASE WHEN cnt > 0 THEN 'c' ELSE 'a' END, '' ORDER BY unitig) AS p FROM d WHERE genome IN (SELECT genome FROM c) GROUP BY genome)
  SELECT genome, '>' || genome || chr(10) || array_to_string(list_transform(range(0, length(p), 60), lambda i: substr(p, i + 1, 60)), chr(10)) AS fasta FROM s""")
def _(spark, sf_dir):
    n = star.table(spark, sf_dir, "part").count()
    return counts.fasta_rows(counts.presence_strings(_counts(spark, sf_dir), n, "genome"), "genome")


# Graphs


@query("self_weights", "SELECT p_partkey::BIGINT AS unitig, (length(p_name) - 5)::DOUBLE AS self_w FROM part")
def _(spark, sf_dir):
    return star.weights(spark, sf_dir)


ORDINARY = """g AS (SELECT least(v, w) AS a, greatest(v, w) AS b, min(x) AS w FROM (SELECT l_partkey::BIGINT AS v, l_suppkey::BIGINT AS w, l_quantity AS x FROM lineitem) WHERE v <> w GROUP BY 1, 2),
  og AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g)"""


def _ordinary(spark, sf_dir):
    return graph.ordinary_graph(star.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("bigint").alias("v"), F.col("l_suppkey").cast("bigint").alias("w"), F.col("l_quantity").cast("double").alias("weight")))


@query("general_edges", f"WITH {ORDINARY} SELECT a, b, w FROM og")
def _(spark, sf_dir):
    return _ordinary(spark, sf_dir)


@query("two_sided_edges", f"WITH {MAIN} SELECT a, b, w FROM main")
def _(spark, sf_dir):
    return star.main_edges(spark, sf_dir)


@query("genome_edges", f"WITH {GENOMES} SELECT genome, a, b, w FROM gedges")
def _(spark, sf_dir):
    return star.genome_edges(spark, sf_dir)


SUMMARY = """SELECT {by} sum((d > 0)::INT)::BIGINT AS n_nodes, (sum(d) // 2)::BIGINT AS n_edges, floor(sum(d) * 100 / sum((d > 0)::INT)) / 100 AS avg_degree, max(d) AS max_degree FROM d {group}"""


@query("graph_summary", f"WITH {MAIN}, d AS (SELECT CASE WHEN count(*) >= 2 THEN count(*) - 2 ELSE count(*) END AS d FROM main GROUP BY a // 2) " + SUMMARY.format(by="", group=""))
def _(spark, sf_dir):
    return graph.summary(star.main_edges(spark, sf_dir), True)


@query("ordinary_summary", f"WITH {ORDINARY}, d AS (SELECT count(*) AS d FROM og GROUP BY a) " + SUMMARY.format(by="", group=""))
def _(spark, sf_dir):
    return graph.summary(_ordinary(spark, sf_dir), False)


@query("genome_summary", f"WITH {GENOMES}, d AS (SELECT genome, CASE WHEN count(*) >= 2 THEN count(*) - 2 ELSE count(*) END AS d FROM gedges GROUP BY genome, a // 2) " + SUMMARY.format(by="genome,", group="GROUP BY genome"))
def _(spark, sf_dir):
    return graph.summary(star.genome_edges(spark, sf_dir), True, ("genome",))


@query("average_graph_size", f"WITH {GENOMES}, s AS (SELECT genome, count(DISTINCT a) AS nodes, count(*) / 2 AS edges FROM gedges GROUP BY genome) SELECT round(avg(nodes), 6) AS avg_nodes, round(avg(edges), 6) AS avg_edges FROM s")
def _(spark, sf_dir):
    return graph.average_size(star.genome_edges(spark, sf_dir)).select(F.round("avg_nodes", 6).alias("avg_nodes"), F.round("avg_edges", 6).alias("avg_edges"))


@query("largest_vertex", "SELECT max(greatest(l_partkey, l_suppkey))::BIGINT AS largest FROM lineitem")
def _(spark, sf_dir):
    return graph.n_vertices(star.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("bigint").alias("v"), F.col("l_suppkey").cast("bigint").alias("w")))


@query("remove_edges", f"WITH {ORDINARY} SELECT a, b, w FROM og WHERE w <= 25")
def _(spark, sf_dir):
    edges = materialize(_ordinary(spark, sf_dir), "ordinary")
    return graph.remove_edges(edges, edges.filter("w > 25 AND a < b").select("a", "b"))


@query("disconnect_nodes", f"WITH {ORDINARY} SELECT a, b, w FROM og WHERE a % 7 <> 0 AND b % 7 <> 0")
def _(spark, sf_dir):
    edges = _ordinary(spark, sf_dir)
    return graph.disconnect(edges, star.unitigs(spark, sf_dir).filter("unitig % 7 = 0").select(F.col("unitig").alias("node")))


@query("has_edge", f"WITH {ORDINARY}, p AS (SELECT DISTINCT ps.a, (ps.a + 1) % 50 AS b FROM og ps) SELECT p.a, p.b, og.a IS NOT NULL AS connected FROM p LEFT JOIN og ON og.a = p.a AND og.b = p.b")
def _(spark, sf_dir):
    edges = _ordinary(spark, sf_dir)
    return graph.has_edge(edges, edges.select("a", ((F.col("a") + 1) % 50).alias("b")).distinct())


@query("add_edges", f"""WITH {ORDINARY}, more AS (SELECT o_custkey::BIGINT % 5000 AS v, o_orderkey::BIGINT % 5000 AS w, floor(o_totalprice) % 40 AS x FROM orders WHERE o_custkey % 5000 <> o_orderkey % 5000),
  m AS (SELECT least(a, b) AS a, greatest(a, b) AS b, w FROM og UNION ALL SELECT least(v, w), greatest(v, w), x FROM more), l AS (SELECT a, b, min(w) AS w FROM m GROUP BY 1, 2)
  SELECT a, b, w FROM l UNION ALL SELECT b, a, w FROM l""")
def _(spark, sf_dir):
    more = star.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5000).cast("bigint").alias("a"), (F.col("o_orderkey") % 5000).cast("bigint").alias("b"), (F.floor("o_totalprice") % 40).cast("double").alias("w"))
    return graph.add_edges(_ordinary(spark, sf_dir), more)


@query("contracted_paths", f"""WITH RECURSIVE {GENOMES}, inner_ AS (SELECT genome, a AS node FROM gedges GROUP BY genome, a HAVING count(*) = 2),
  walk(genome, a, last, here, w) AS (
    SELECT e.genome, e.a, e.a, e.b, e.w FROM gedges e ANTI JOIN inner_ i ON i.genome = e.genome AND i.node = e.a
    UNION ALL SELECT k.genome, k.a, k.here, e.b, k.w + e.w FROM walk k JOIN inner_ i ON i.genome = k.genome AND i.node = k.here JOIN gedges e ON e.genome = k.genome AND e.a = k.here AND e.b <> k.last)
  SELECT genome, a, here AS b, min(w) AS w FROM walk k ANTI JOIN inner_ i ON i.genome = k.genome AND i.node = k.here WHERE a <> here GROUP BY ALL""")
def _(spark, sf_dir):
    return shortest_paths.contracted(star.genome_edges(spark, sf_dir), by=("genome",))


@query("inner_path_nodes", f"WITH {GENOMES} SELECT genome, a AS node, count(*) = 2 AS degree2 FROM gedges GROUP BY genome, a")
def _(spark, sf_dir):
    return shortest_paths.chains(star.genome_edges(spark, sf_dir), ("genome",))


@query("path_offsets", f"""WITH {STEPS}, s AS (SELECT path, pos, (length(p_name) - 5)::DOUBLE AS w FROM steps JOIN part ON p_partkey = seg)
  SELECT path, pos::BIGINT AS pos, sum(w) OVER (PARTITION BY path ORDER BY pos) AS to_start, sum(w) OVER (PARTITION BY path) - sum(w) OVER (PARTITION BY path ORDER BY pos) AS to_end FROM s""")
def _(spark, sf_dir):
    steps = star.paths(spark, sf_dir).select("path", F.posexplode("steps.seg").alias("pos", "unitig")).join(star.weights(spark, sf_dir), "unitig").select("path", F.col("pos").cast("bigint").alias("pos"), F.col("self_w").alias("w"))
    return shortest_paths.path_offsets(steps).drop("w")


# Queries and layouts


LINES = """SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS line_no, l_partkey::BIGINT AS v, l_suppkey::BIGINT AS w, trunc(l_extendedprice)::DOUBLE AS distance, l_linestatus = 'F' AS flag, l_discount AS score, l_quantity::BIGINT AS cnt FROM lineitem"""


def _query_lines(spark, sf_dir):
    flag = F.when(F.col("l_linestatus") == "F", "1").otherwise("0")
    parts = [F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_extendedprice")] + [flag, F.col("l_discount").cast("string"), F.col("l_quantity").cast("bigint").cast("string")]
    return star.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("line_no"), scalars.split_fields(F.concat_ws(" ", *parts), " ").alias("fields"))


@query("layout_projection", f"WITH t AS ({LINES}) SELECT line_no - 1 AS qid, v, w, distance, flag, score, cnt FROM t")
def _(spark, sf_dir):
    return tables.project_layout(_query_lines(spark, sf_dir), 5, with_distance=True)


@query("base_shift", f"WITH t AS ({LINES}) SELECT line_no - 1 AS qid, v - 1 AS v, w - 1 AS w, flag, score, cnt FROM t")
def _(spark, sf_dir):
    return tables.project_layout(_query_lines(spark, sf_dir), 5, one_based=True)


@query("oriented_pairs", f"""WITH {PAIRS}, p AS (SELECT DISTINCT least(v, w) AS v, greatest(v, w) AS w FROM pairs WHERE v <> w),
  e AS (SELECT x, count(*) AS n FROM (SELECT unnest([v, w]) AS x FROM p) GROUP BY x)
  SELECT CASE WHEN a.n > b.n THEN p.v ELSE p.w END AS src, CASE WHEN a.n > b.n THEN p.w ELSE p.v END AS dst FROM p JOIN e a ON a.x = p.v JOIN e b ON b.x = p.w""")
def _(spark, sf_dir):
    return shortest_paths.orient_pairs(star.queries(spark, sf_dir))


# Greedy picks one after another are beyond SQL; tests hold them against a loop.
@query("search_jobs")
def _(spark, sf_dir):
    return shortest_paths.search_jobs(star.raw_links(spark, sf_dir).select(F.col("from_id").alias("v"), F.col("to_id").alias("w")))


# Distances


@query("main_distances", f"{MAIN_FOUND} SELECT q.qid, v, w, score, distance FROM queries q LEFT JOIN found USING (qid)")
def _(spark, sf_dir):
    return distances.main_distances(star.queries(spark, sf_dir), star.main_links(spark, sf_dir))


@query("max_distance_filter", f"{MAIN_FOUND} SELECT q.qid, v, w, score, CASE WHEN distance < 8 THEN distance END AS distance FROM queries q LEFT JOIN found USING (qid)")
def _(spark, sf_dir):
    return distances.main_distances(star.queries(spark, sf_dir), star.main_links(spark, sf_dir), limit=8.0)


@query("distances_by_joins", f"{MAIN_FOUND} SELECT DISTINCT least(v, w) AS v, greatest(v, w) AS w, distance FROM pairs JOIN found USING (qid)")
def _(spark, sf_dir):
    pairs = star.queries(spark, sf_dir)
    jobs = materialize(shortest_paths.orient_pairs(pairs), "jobs")
    found = shortest_paths.relaxation(star.main_edges(spark, sf_dir), jobs)
    return found.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("w"), "distance")


@query("genome_distances", f"{GENOME_FOUND} SELECT DISTINCT genome, least(v, w) AS v, greatest(v, w) AS w, distance FROM pairs JOIN found USING (qid)")
def _(spark, sf_dir):
    return distances.genome_distances(star.queries(spark, sf_dir), star.genome_links(spark, sf_dir))


@query("genome_moments", f"""{GENOME_FOUND}, m AS (SELECT qid, avg(distance) AS distance, count(*) AS cnt, var_pop(distance) * count(*) AS m2, min(distance) AS min_d, max(distance) AS max_d FROM found GROUP BY qid)
  SELECT q.qid, v, w, score, round(distance, 6) AS distance, coalesce(cnt, 0) AS cnt, round(m2, 6) AS m2, min_d, max_d FROM queries q LEFT JOIN m USING (qid)""")
def _(spark, sf_dir):
    found = distances.genome_moments(star.queries(spark, sf_dir), star.genome_links(spark, sf_dir))
    return found.select("qid", "v", "w", "score", F.round("distance", 6).alias("distance"), "cnt", F.round("m2", 6).alias("m2"), "min_d", "max_d")


@query("moments", "SELECT l_partkey::BIGINT AS part, round(avg(l_quantity), 6) AS mean, count(*) AS cnt, round(var_pop(l_quantity) * count(*), 6) AS m2, min(l_quantity) AS min_d, max(l_quantity) AS max_d FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    t = star.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("bigint").alias("part"), F.col("l_quantity").cast("double").alias("distance"))
    return distances.moments(t, ("part",)).select("part", F.round("mean", 6).alias("mean"), "cnt", F.round("m2", 6).alias("m2"), "min_d", "max_d")


# The fold's roundings depend on the order, so this is the same fold over the same order, to the last bit.
@query("ordered_moments", """WITH o AS (SELECT l_partkey::BIGINT AS part, list(l_extendedprice / 3 ORDER BY l_orderkey, l_extendedprice / 3) AS d FROM lineitem GROUP BY 1),
  f AS (SELECT part, d, list_reduce(list_transform(d, lambda x: {'n': 0::BIGINT, 'mean': x, 'm2': 0.0::DOUBLE}), lambda s, x: {'n': s.n + 1, 'mean': (s.mean * s.n + x.mean) / (s.n + 1), 'm2': s.m2 + (x.mean - s.mean) * (x.mean - (s.mean * s.n + x.mean) / (s.n + 1))}, {'n': 0::BIGINT, 'mean': 0.0::DOUBLE, 'm2': 0.0::DOUBLE}) AS s FROM o)
  SELECT part, s.mean AS mean, s.n AS cnt, s.m2 AS m2, list_min(d) AS min_d, list_max(d) AS max_d FROM f""")
def _(spark, sf_dir):
    t = star.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("bigint").alias("part"), F.col("l_orderkey").alias("o"), (F.col("l_extendedprice") / 3).alias("distance"))
    return distances.ordered_moments(t, ("part",), "o").select("part", "mean", "cnt", "m2", "min_d", "max_d")


@query("distance_output", f"""{GENOME_FOUND}, m AS (SELECT qid, avg(distance) AS d, count(*) AS c, var_pop(distance) * count(*) AS m2, min(distance) AS lo, max(distance) AS hi FROM found GROUP BY qid)
  SELECT qid, (v + 1) || ' ' || (w + 1) || ' ' || coalesce(trunc(d)::BIGINT, -1) || ' ' || format('{{:g}}', score) || ' ' || coalesce(c, 0) || ' ' || format('{{:g}}', round(coalesce(m2, -1), 9)) || ' ' || format('{{:g}}', coalesce(lo, -1)) || ' ' || format('{{:g}}', coalesce(hi, -1)) AS value
  FROM queries q LEFT JOIN m USING (qid)""")
def _(spark, sf_dir):
    found = distances.genome_moments(star.queries(spark, sf_dir), star.genome_links(spark, sf_dir))
    return sinks.distance_lines(found.withColumn("m2", F.round("m2", 9)), True, one_based=True)


# Outliers


@query("score_summary", f"WITH {SCORED} SELECT count(DISTINCT x) AS n_vertices, greatest(max(score), 0) AS largest_score FROM (SELECT unnest([v, w]) AS x, score FROM scored)")
def _(spark, sf_dir):
    return outliers.score_summary(star.scored(spark, sf_dir))


@query("largest_distance", f"WITH {SCORED} SELECT greatest(max(coalesce(distance, -1)), 0) AS largest_distance FROM scored WHERE cnt >= {COUNT}")
def _(spark, sf_dir):
    return outliers.largest_distance(star.scored(spark, sf_dir), COUNT)


def _maxima(spark, sf_dir):
    return outliers.vertex_maxima(outliers.passing(star.scored(spark, sf_dir), LD, COUNT))


@query("vertex_max_score", f"WITH {MAXIMA} SELECT vertex, score FROM maxima")
def _(spark, sf_dir):
    return _maxima(spark, sf_dir)


@query("tukey_thresholds", f"WITH {TUKEY} SELECT n::BIGINT AS n, q1, q3, round(outlier, 6) AS outlier, round(extreme, 6) AS extreme FROM fences")
def _(spark, sf_dir):
    return outliers.tukey(_maxima(spark, sf_dir)).select("n", "q1", "q3", F.round("outlier", 6).alias("outlier"), F.round("extreme", 6).alias("extreme"))


@query("nth_largest", f"WITH {TUKEY} SELECT nth_score FROM fences")
def _(spark, sf_dir):
    return outliers.tukey(_maxima(spark, sf_dir)).select("nth_score")


@query("outliers", f"WITH {TUKEY} SELECT qid, v, w, p.score, distance, cnt, p.score >= extreme AS extreme FROM passing p, fences WHERE p.score >= outlier")
def _(spark, sf_dir):
    pairs = star.scored(spark, sf_dir)
    settings = outliers.Settings(ld_distance=LD, count_threshold=COUNT)
    return outliers.collect_outliers(pairs, outliers.find_thresholds(pairs, settings), COUNT)


@query("outlier_stats", f"WITH {TUKEY} SELECT {LD}::BIGINT AS ld, round(outlier, 6) AS outlier, round(extreme, 6) AS extreme, {COUNT}::BIGINT AS count_threshold FROM fences")
def _(spark, sf_dir):
    found = outliers.find_thresholds(star.scored(spark, sf_dir), outliers.Settings(ld_distance=LD, count_threshold=COUNT))
    return outliers.outlier_stats(spark, found, COUNT).select("ld", F.round("outlier", 6).alias("outlier"), F.round("extreme", 6).alias("extreme"), "count_threshold")


BISECT_SCORE = 0.1
_AT = "(SELECT count(*) AS n, list_sort(list(score)) AS x FROM (SELECT vertex, max(score) AS score FROM ends WHERE distance >= {} GROUP BY vertex HAVING max(score) > 0))"


@query("ld_bisection", f"""WITH RECURSIVE {SCORED}, ends AS (SELECT unnest([v, w]) AS vertex, score, coalesce(distance, -1) AS distance FROM scored WHERE cnt >= {COUNT}),
  s AS (SELECT {BISECT_SCORE} * (SELECT max(score) FROM scored) AS need, (SELECT greatest(max(distance), 0)::BIGINT FROM ends) AS top),
  r(a, b, ld, nth) AS (SELECT CASE WHEN top >= 1000 THEN 1000 ELSE 0 END::BIGINT, top, -1::BIGINT, NULL::DOUBLE FROM s
    UNION ALL SELECT CASE WHEN nth < need THEN a ELSE m END, CASE WHEN nth < need THEN m ELSE b END, m, nth
    FROM (SELECT r.a, r.b, (r.a + r.b) // 2 AS m, need, (SELECT CASE WHEN n > 0 THEN x[n - least(n - 1, 10)] ELSE 0 END FROM {_AT.format('(r.a + r.b) // 2')}) AS nth FROM r, s WHERE r.b - r.a > 1)),
  last AS (SELECT ld, b - a AS gap FROM r ORDER BY gap, ld DESC),
  final AS (SELECT arg_min(ld, (b - a) * 1000000 - ld) AS ld FROM r WHERE b - a = (SELECT min(b - a) FROM r))
  SELECT ld FROM final""")
def _(spark, sf_dir):
    found = outliers.find_thresholds(star.scored(spark, sf_dir), outliers.Settings(ld_distance_score=BISECT_SCORE, count_threshold=COUNT))
    return spark.createDataFrame([(int(found.ld_distance),)], "ld long")


# Plot


ROWS = "rows AS (SELECT qid AS line_no, coalesce(distance, -1) AS distance, score, cnt, v % 2 = 0 AS flag FROM scored)"


def _rows(spark, sf_dir):
    return star.scored(spark, sf_dir).select(F.col("qid").alias("line_no"), F.coalesce("distance", F.lit(-1.0)).alias("distance"), "score", (F.col("v") % 2 == 0).alias("flag"))


@query("connected_split", f"WITH {SCORED}, {ROWS} SELECT line_no, distance, score, flag, distance <> -1 AS connected FROM rows")
def _(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return plot.connected(rows).withColumn("connected", F.lit(True)).unionByName(plot.disconnected(rows).withColumn("connected", F.lit(False)))


@query("direct_split", f"WITH {SCORED}, {ROWS} SELECT line_no, distance, score, flag, CASE WHEN flag THEN 'direct' ELSE 'indirect' END AS kind FROM rows")
def _(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return plot.direct(rows).withColumn("kind", F.lit("direct")).unionByName(plot.indirect(rows).withColumn("kind", F.lit("indirect")))


@query("count_filtered_plot", """WITH o AS (SELECT o_orderkey::BIGINT AS line_no, o_totalprice AS score, floor(o_totalprice) % 17 AS cnt FROM orders) SELECT line_no, score FROM o WHERE cnt >= 9""")
def _(spark, sf_dir):
    rows = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("line_no"), F.col("o_totalprice").alias("score"))
    return plot.with_counts(rows, rows.select("line_no", (F.floor("score") % 17).alias("cnt")), 9)


@query("plot_extents", f"WITH {SCORED}, {ROWS} SELECT min(score) AS min_score, max(score) AS max_score, max(distance) AS max_distance, (round_even(log10(max(distance)), 0) - 1)::INT AS exponent FROM rows WHERE distance <> -1")
def _(spark, sf_dir):
    return plot.extents(_rows(spark, sf_dir))


@query("plot_counts", f"WITH {SCORED}, {ROWS} SELECT (sum((distance <> -1)::INT) // 1000)::BIGINT AS connected_k, (sum((distance = -1)::INT) // 1000)::BIGINT AS disconnected_k FROM rows")
def _(spark, sf_dir):
    return plot.annotations(_rows(spark, sf_dir))


@query("plot_raster", f"""WITH {SCORED}, {ROWS}, e AS (SELECT min(score) AS low, max(score) AS high, max(distance) AS far FROM rows WHERE distance <> -1)
  SELECT least(floor(distance / far * 1200), 1199)::INT AS x, least(floor((score - low) / (high - low) * 700), 699)::INT AS y, flag, count(*) AS n FROM rows, e WHERE distance <> -1 GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return plot.raster(_rows(spark, sf_dir))
