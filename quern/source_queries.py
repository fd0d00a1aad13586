"""Queries over readers, curation, budgets and controls: the driver tables as
notes, transcripts, commit exports, claims, runs and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .functions.ranks import global_rank
from .graph_queries import QUERIES, SQL
from .linalg import components as dense
from .operators import claims, ledger, metrics, reconcile, search
from .plans import controls
from .queries import chunks, edges_at, edges_sql, query, table
from .scratch import scratch_path
from .sources import notes

__all__ = ["QUERIES", "SQL"]

# -- readers --------------------------------------------------------------------------


@query("""SELECT 'a/n' || doc_id || '.md' AS source_path, 'a/n' || doc_id AS title, sha256(t) AS digest, length(t) AS chars, 'k' || doc_id % 7 AS owner, 'd' || doc_id AS id
FROM (SELECT doc_id, 'id:: d0' || chr(10) || coalesce(text, '') || chr(10) || 'owner:: k' || doc_id % 7 || chr(10) || 'id::  d' || doc_id AS t FROM documents)""")
def notes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as note files, each with a property that comes twice."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    body = F.concat(F.lit("id:: d0\n"), F.coalesce("text", F.lit("")), F.lit("\nowner:: k"), (F.col("doc_id") % 7).cast("string"), F.lit("\nid::  d"), n)
    files = d.select(F.concat(F.lit("a/n"), n, F.lit(".md")).alias("path"), body.cast("binary").alias("data"))
    out = notes.notes(files)
    return out.select("source_path", "title", "digest", F.char_length("text").cast("long").alias("chars"), F.col("properties")["owner"].alias("owner"), F.col("properties")["id"].alias("id"))


@query("""WITH u AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'f' || turn || '.md' END AS path, turn % 3 = 1 AS commits FROM conversations WHERE role IN ('user', 'assistant')),
e AS (SELECT conv_id, turn, 0 AS b, role, CASE role WHEN 'user' THEN 'prompt' ELSE 'response' END AS kind, NULL AS ref FROM u
 UNION ALL SELECT conv_id, turn, 1, role, CASE WHEN path IS NOT NULL THEN 'file_edit' WHEN commits THEN 'commit' ELSE 'tool_use' END, CASE WHEN path IS NOT NULL THEN path WHEN commits THEN substr(md5(conv_id || ':' || turn), 1, 9) ELSE 'Bash' END FROM u WHERE role = 'assistant')
SELECT conv_id::VARCHAR AS session_id, row_number() OVER w - 1 AS ord, CASE role WHEN 'user' THEN 'owner' ELSE 'agent' END AS actor, kind, ref, count(*) FILTER (WHERE kind IN ('prompt', 'response')) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS turn_index FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, b)""")
def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lines, with tool uses and their results."""
    c = table(spark, sf_dir, "conversations").withColumn("use", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    path = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("f"), F.col("turn").cast("string"), F.lit(".md")))
    given = F.to_json(F.struct(path.alias("file_path"), F.when(F.col("turn") % 3 == 1, "git commit -m x").when(F.col("turn") % 3 == 2, "ls").alias("command")))
    block = lambda **k: F.struct(*[k.get(n, F.lit(None).cast("string")).alias(n) for n in ("type", "text", "id", "name", "input", "tool_use_id", "content")])
    said = block(type=F.lit("text"), text=F.coalesce("text", F.lit("")))
    used = block(type=F.lit("tool_use"), id=F.col("use"), name=F.lit("Bash"), input=given)
    result = block(type=F.lit("tool_result"), tool_use_id=F.col("use"), content=F.concat(F.lit("[main "), F.substring(F.md5(F.col("use").cast("binary")), 1, 9), F.lit("] x")))
    content = F.when(F.col("role") == "assistant", F.array(said, used, result)).otherwise(F.array(said))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.to_json(content).alias("content")).alias("message")))
    lines = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("line"), line.alias("value"))
    out = notes.transcript_events(notes.transcript_blocks(lines))
    return out.select("session_id", F.col("ord").cast("long").alias("ord"), "actor", "kind", "ref", F.col("turn_index").cast("long").alias("turn_index"))


@query("""SELECT sha1(o_orderkey::VARCHAR) AS commit_sha, 'p' || l_partkey || '.md' AS path, CASE WHEN l_linenumber > 1 THEN sha1('o' || l_partkey) END AS old_blob, CASE WHEN l_linenumber <> 3 THEN sha1('n' || l_partkey) END AS new_blob
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def commit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, their lines as changed files, written as a commit
    export and read back."""
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    none, sha = F.lit("0" * 40), lambda c: F.sha1(c.cast("binary"))
    row = F.concat(F.lit(":100644 100644 "), F.when(n > 1, sha(F.concat(F.lit("o"), p))).otherwise(none), F.lit(" "), F.when(n != 3, sha(F.concat(F.lit("n"), p))).otherwise(none), F.lit(" M\tp"), p, F.lit(".md"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    of = lines.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r"))))["r"], "\n").alias("rows"))
    place = scratch_path(spark, "commits")
    of.select(F.concat_ws("\n", sha(F.col("o_orderkey").cast("string")), "rows").alias("value")).write.text(place)
    return notes.commit_diffs(spark, place)


@query("""SELECT doc_id, 'p' || doc_id AS plan, (doc_id % 900 + 1) * 1000 AS tokens FROM documents""")
def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    written = F.concat(F.lit("---\nplan: p"), n, F.lit("\ntokens: "), (F.col("doc_id") % 900 + 1).cast("string"), F.lit("K \nplan: other\n---\n"), F.coalesce("text", F.lit("")))
    front = text.front_matter(written)
    return d.select("doc_id", front["plan"].alias("plan"), text.token_amount(front["tokens"]).alias("tokens"))


@query("""SELECT split_part(lower(p_type), ' ', 1) AS type, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS scope, count(*) AS n FROM part GROUP BY 1, 2""")
def commit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    scope = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), "p_name", F.lit(")"))).otherwise("")
    kind, scope = text.commit_header(F.concat(F.substring_index(F.lower("p_type"), " ", 1), scope, F.when(F.col("p_partkey") % 3 == 0, "!").otherwise(""), F.lit(": "), "p_brand"))
    return p.select(kind.alias("type"), scope.alias("scope")).groupBy("type", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '  ' || p_name || '   ' || p_type WHEN 1 THEN p_name || ' a@b.org' WHEN 2 THEN p_brand WHEN 3 THEN p_name || ' 123456' WHEN 4 THEN p_name || ' 12/10' ELSE 'a b c d e f ' || p_name END AS term FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(term, '\\s+', ' ', 'g')) AS t FROM t)
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 AND length(t) <= 64 AND len(string_split(t, ' ')) <= 6 THEN t END AS term FROM c""")
def terms_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with addresses, marks, numbers, dates or too many words go."""
    p = table(spark, sf_dir, "part")
    forms = [F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type"), F.concat("p_name", F.lit(" a@b.org")), F.col("p_brand"), F.concat("p_name", F.lit(" 123456")), F.concat("p_name", F.lit(" 12/10")), F.concat(F.lit("a b c d e f "), "p_name")]
    return p.select("p_partkey", text.clean_term(F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("term"))


@query("""WITH a AS (SELECT 's/' || s_nationkey || '/' || s_suppkey || '.md' AS p FROM supplier WHERE s_suppkey % 5 <> 0), r AS (SELECT s_suppkey || '.md' AS ref FROM supplier UNION SELECT s_nationkey || '/' || s_suppkey || '.md' FROM supplier UNION SELECT 's/' || s_nationkey || '/' || s_suppkey || '.md' FROM supplier UNION SELECT 'x/' || s_suppkey || '.md' FROM supplier),
h AS (SELECT r.ref, count(a.p) AS n, min(a.p) AS p FROM r LEFT JOIN a ON a.p = r.ref OR ends_with(a.p, '/' || r.ref) GROUP BY r.ref)
SELECT ref, CASE WHEN n = 1 THEN p END AS source_path, CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM h""")
def documents_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n, k = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    full = F.concat(F.lit("s/"), k, F.lit("/"), n, F.lit(".md"))
    catalog = s.select(full.alias("source_path"), (F.col("s_suppkey") % 5 != 0).alias("active"))
    refs = s.select(F.explode(F.array(F.concat(n, F.lit(".md")), F.concat(k, F.lit("/"), n, F.lit(".md")), full, F.concat(F.lit("x/"), n, F.lit(".md")))).alias("ref"))
    return reconcile.resolve_documents(catalog, refs)


@query("""WITH p AS (SELECT doc_id AS arrival, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '10.1/' || n_chars % 500 END AS doi, 'Paper  ' || n_chars % 300 AS title, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'u' END AS url, doc_id % 11 = 0 AS pre FROM documents),
k AS (SELECT *, CASE WHEN doi <> '' THEN doi ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) END AS key, CASE WHEN pre THEN 3 ELSE 2 END AS rank FROM p WHERE doi <> '' OR url <> '')
SELECT arrival, rank::INTEGER AS evidence_rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, arrival) AS n FROM k) WHERE n = 1 ORDER BY rank, arrival LIMIT 100""")
def papers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best papers, each under its identifier or title once."""
    d = table(spark, sf_dir, "documents")
    part = lambda k: (F.col("n_chars") % k).cast("string")
    papers = d.select(
        F.col("doc_id").alias("arrival"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("10.1/"), part(500))).alias("doi"), F.concat(F.lit("Paper  "), part(300)).alias("title"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise("u").alias("url"), F.lit("other").alias("type"), (F.col("doc_id") % 11 == 0).alias("is_preprint"),
    )
    return search.best_papers(papers, 100).select("arrival", "evidence_rank")


# -- claims and curation ------------------------------------------------------------------

@query("""WITH a AS (SELECT 100 + n_nationkey AS id, n_regionkey AS parent FROM nation UNION SELECT 1000 + s_suppkey, 100 + s_nationkey FROM supplier UNION SELECT 1000 + s_suppkey, 100 + (s_nationkey + s_suppkey % 3) % 25 FROM supplier)
SELECT id, count(DISTINCT parent)::DOUBLE AS strength FROM a GROUP BY id""")
def grounding_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers rest on one or two nations, nations on a region, regions are authored."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    arcs = n.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"))
    for nation in (F.col("s_nationkey"), (F.col("s_nationkey") + F.col("s_suppkey") % 3) % 25):
        arcs = arcs.unionAll(s.select((F.col("s_suppkey") + 1000).cast("long").alias("id"), (nation + 100).cast("long").alias("parent")))
    return dense.grounding_cut(arcs.distinct(), table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"))).select("id", "strength")


@query(f"""WITH {edges_sql(0.42)}, c AS (SELECT vec_id, label::VARCHAR AS digest FROM embeddings) SELECT 'near_duplicate' AS kind, u || ',' || v AS subjects, round(w, 4) AS sim FROM e
UNION ALL SELECT 'prune_candidate', digest, NULL FROM c WHERE digest::INTEGER % 4 = 0 GROUP BY digest""")
def curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    raw = c.where("cast(digest AS int) % 4 <> 0").select("digest").distinct()
    out = claims.curate(c, c.select("id", "title", "vector"), raw, 0.42)
    return out.select("kind", F.array_join("subjects", ",").alias("subjects"), F.when(F.col("kind") == "near_duplicate", F.round(F.col("detail").try_cast("double"), 4)).alias("sim"))


@query("""SELECT doc_id AS claim_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def claims_surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "claim_id")
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"))
    return claims.surfaceable(found, lab.select("claim_id", (F.col("toxic") == 1).alias("changed")), lab.where("quality = 0"))


@query("""WITH o AS (SELECT user_id AS c, count(*) FILTER (WHERE event_type = 'error') AS d, count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 50 = 0) AS s, list(DISTINCT (event_id % 9)::VARCHAR) FILTER (WHERE event_type = 'click') AS w FROM events GROUP BY user_id)
SELECT k.c::VARCHAR AS claim_id, round(0.8 * pow(0.5, coalesce(d, 0)), 9) AS confidence, array_to_string(list_sort(list_distinct(list_concat(['base'], coalesce(w, [])))), ',') AS support
FROM (SELECT DISTINCT o_custkey AS c FROM orders) k LEFT JOIN o ON o.c = k.c WHERE coalesce(s, 0) = 0""")
def operations_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "defeater").when((F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0), "supersede").when(F.col("event_type") == "click", "warrant")
    ops = e.select(F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").cast("string").alias("claim_id"), (F.col("event_id") % 9).cast("string").alias("related_id"))
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("claim_id")).distinct().withColumns({"confidence": F.lit(0.8), "support": F.array(F.lit("base"))})
    return claims.apply_operations(own, ops).select("claim_id", F.round("confidence", 9).alias("confidence"), F.array_join("support", ",").alias("support"))


# -- runs, prompts, controls ------------------------------------------------------------

@query("""WITH r AS (SELECT o_custkey AS pipeline, o_orderkey AS run_id, o_orderdate, o_orderstatus <> 'P' AS clean, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT pipeline, arg_min(run_id, n) AS run_id, arg_min(clean, n) AS clean, count(*) FILTER (WHERE clean) AS recent_clean, count(*) AS recent FROM r WHERE n <= 5 GROUP BY pipeline""")
def runs_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_custkey").alias("pipeline"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("finished_at"), (F.col("o_orderstatus") == "P").cast("int").alias("failed"))
    return ledger.last_runs(runs).select("pipeline", "run_id", "clean", "recent_clean", "recent")


@query("""WITH p AS (SELECT user_id AS request, event_id AS rank, ['frame', 'retrieved', 'retrieved', 'history', 'tool'][event_id % 5 + 1] AS kind, event_id % 40 + 1 AS tokens FROM events),
c AS (SELECT *, tokens + 4 AS cost FROM p), t AS (SELECT *, coalesce(sum(cost) FILTER (WHERE kind = 'frame') OVER r, 0) AS f, coalesce(sum(cost) FILTER (WHERE kind = 'history') OVER r, 0) AS h, coalesce(sum(cost) FILTER (WHERE kind = 'tool') OVER r, 0) AS o,
 sum(cost) OVER (PARTITION BY request, kind ORDER BY rank) AS up, sum(cost) OVER (PARTITION BY request, kind ORDER BY rank DESC) AS down FROM c WINDOW r AS (PARTITION BY request))
SELECT request, rank, kind, f > 600 AS escalate, (CASE kind WHEN 'frame' THEN tokens WHEN 'retrieved' THEN CASE WHEN f + h + o + up <= 600 THEN tokens END WHEN 'history' THEN CASE WHEN f + o + down <= 600 THEN tokens END
 ELSE CASE WHEN f + o <= 600 OR f + up <= 600 THEN tokens WHEN 600 - f - up + cost - 4 > 0 THEN 600 - f - up + cost - 4 END END)::BIGINT AS kept_tokens FROM t""")
def prompts_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(k) for k in ("frame", "retrieved", "retrieved", "history", "tool")])
    parts = e.select(F.col("user_id").alias("request"), F.col("event_id").alias("rank"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"), (F.col("event_id") % 40 + 1).alias("tokens"))
    return metrics.prompt_budget(parts, 600).select("request", "rank", "kind", "escalate", "kept_tokens")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v), c AS (SELECT list_cosine_similarity(x.x, y.x) AS cos FROM p JOIN v x ON x.vec_id = a LEFT JOIN v y ON y.vec_id = b WHERE b IS NOT NULL),
m AS (SELECT avg(list_cosine_similarity(x.x, y.x)) AS m FROM v x JOIN v y ON x.vec_id < y.vec_id)
SELECT count(*) AS pairs_total, count(cos) AS pairs_scored, count(*) FILTER (WHERE cos < 0.1) AS below_floor, round(avg(cos), 6) AS mean_cos, round(count(*) FILTER (WHERE cos < 0.1) / count(cos), 6) AS mismatch_density, round((SELECT m FROM m), 6) AS ambient_mean_cos FROM c""")
def class_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by label against what their vectors say."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    nxt = e.select(F.col("vec_id").alias("a"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).where("b IS NOT NULL")
    out = metrics.mismatch_density(nxt, e.select(F.col("vec_id").alias("id"), "vector"), 0.1)
    return out.select("pairs_total", "pairs_scored", "below_floor", *[F.round(c, 6).alias(c) for c in ("mean_cos", "mismatch_density", "ambient_mean_cos")])


@query()
def control_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes as places of a noise world and a planted one."""
    n = global_rank(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), ["id"], "place")
    return controls.control_battery(n, [0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85], seeds=3)


@query(f"""WITH {edges_sql(0.40)}, b AS (SELECT u, v, w + 0.01 * (u % 3) AS w2, w FROM e WHERE (u + v) % 4 <> 0) SELECT round(sqrt(sum((w2 - w) * (w2 - w))), 6) AS energy, count(*) AS edges FROM b""")
def change_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a change are orthogonal: their energies add up to its own."""
    before = edges_at(spark, sf_dir, 0.40)
    after = before.where("(u + v) % 4 <> 0").select("u", "v", (F.col("w") + 0.01 * (F.col("u") % 3)).alias("w"))
    parts = dense.alive_stale(before, after, "v1", "v1")
    total = F.sqrt(F.pow("gradient_energy", F.lit(2)) + F.pow("curl_energy", F.lit(2)) + F.pow("harmonic_energy", F.lit(2)))
    return parts.select(F.round(total, 6).alias("energy"), "edges")
