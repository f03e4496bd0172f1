"""More named queries with their SQL: branches that the catalog's own data don't reach, and functions that no other query calls.

Importing this module adds them to the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import EDGES, FILES, JOBS, MESSAGES, PAGE_PATHS, edges, files, jobs, knn, messages, page_paths, query, spans, SCORED, SPANS, START, END, window
from .functions import keys, sizes, status, vectors
from .operators import filters, gates, graph, guards, maintenance, paths, reports, reuse, shaping, snapshots
from .session import table
from .sources import logs
from .streaming import events as event_streams

# -- retrieval --------------------------------------------------------------------------------


@query(f"SELECT * FROM {SCORED} ORDER BY score DESC, vec_id LIMIT 10 OFFSET 5")
def knn_offset(spark, sf):
    return knn(spark, sf, limit=10, offset=5)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v)
SELECT vec_id, round(n, 6) AS norm, round(e[1] / n, 4) AS first, round(e[64] / n, 4) AS last FROM l""")
def vector_norms(spark, sf):
    e = table(spark, sf, "embeddings")
    unit = vectors.normalised(F.col("embedding"))
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(unit[0].cast("double"), 4).alias("first"), F.round(unit[63].cast("double"), 4).alias("last"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding)::DOUBLE[] AS r, vec_id % 2 AS m FROM embeddings),
p AS (SELECT vec_id, e, CASE WHEN m = 1 THEN list_transform(list_zip(e, r), lambda x: (x[1] + x[2]) / 2) ELSE e END AS k FROM v)
SELECT vec_id, round(k[2] / sqrt(list_dot_product(k, k)), 5) AS mean, round(e[2] / sqrt(list_dot_product(e, e)), 5) AS first FROM p""")
def pooled_vectors(spark, sf):
    """Two token vectors for each row, of which the mask keeps one or both, and a third that it never keeps."""
    e = F.col("embedding")
    tokens = F.array(e, F.reverse(e), F.transform(e, lambda x: x * 3))
    mask = F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(0))
    at = lambda v: F.round(v[1].cast("double"), 5)
    return table(spark, sf, "embeddings").select("vec_id", at(vectors.mean_pooled(tokens, mask)).alias("mean"), at(vectors.first_pooled(tokens)).alias("first"))


# -- messages ---------------------------------------------------------------------------------


@query(f"""SELECT conversation_id, message_index, 'conv/' || conversation_id || '/' || message_index || '/2' AS own, 'convtool/' || conversation_id || '/' || message_index || '/1' AS tool,
'convthink/' || conversation_id || '/' || message_index AS think, message_index AS number, 2 AS part, 'conv/' || conversation_id || '/' || message_index AS family, 'convtool/' || conversation_id || '/' || message_index || '/1' AS tool_family, NULL::INTEGER AS odd FROM {MESSAGES}""")
def message_paths(spark, sf):
    """Paths of a message, its tool output and its thinking, and what can be read from them again."""
    i, n = F.col("conversation_id"), F.col("message_index")
    own, tool = keys.message_path(i, n, F.lit(2)), keys.tool_path(i, n, F.lit(1))
    return messages(spark, sf).select(i, n, own.alias("own"), tool.alias("tool"), keys.thinking_path(i, n).alias("think"), keys.message_index(own, i).alias("number"), keys.part_index(own, i).alias("part"), keys.family_path(own).alias("family"), keys.family_path(F.concat(tool, F.lit("/7"))).alias("tool_family"), keys.message_index(tool, i).alias("odd"))


@query(f"SELECT conversation_id, message_index, role, timestamp_unix, split_part(conversation_id, ':', 1) AS provider FROM {MESSAGES}")
def metadata_backfill(spark, sf):
    """Columns of rows that only have their metadata."""
    m = messages(spark, sf)
    made = keys.metadata_json(conversation_id=F.col("conversation_id"), message_index=F.col("message_index"), role=F.upper("role"), timestamp_unix=F.col("timestamp_unix"))
    none = F.lit(None).cast("string")
    rows = m.select(made.alias("metadata"), none.alias("conversation_id"), none.alias("parent_conversation_id"), none.cast("int").alias("message_index"), none.cast("long").alias("timestamp_unix"), none.alias("load_rules"), none.alias("role"), none.alias("provider"))
    return maintenance.backfilled(rows).select("conversation_id", "message_index", "role", "timestamp_unix", "provider")


#: Ids with and without slashes are asked for; half of the rows have no id of their own.
BATCH_IDS = "(SELECT source AS id FROM documents WHERE source < 'src15' UNION SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang FROM documents WHERE doc_id % 10 = 0)"


@query(f"""SELECT doc_id, batch_id FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND source IN (SELECT id FROM {BATCH_IDS}) THEN source WHEN path IN (SELECT id FROM {BATCH_IDS}) THEN path WHEN source IN (SELECT id FROM {BATCH_IDS}) THEN source END AS batch_id FROM {FILES}) WHERE batch_id IS NOT NULL""")
def conversation_batch(spark, sf):
    f = files(spark, sf)
    rows = f.select("doc_id", F.concat(F.lit("conv/"), "path", F.lit("/0")).alias("relative_path"), F.when(F.col("doc_id") % 2 == 1, F.col("source")).alias("conversation_id"))
    ids = f.where("source < 'src15'").select(F.col("source").alias("conversation_id")).union(f.where("doc_id % 10 = 0").select("path"))
    return filters.of_conversations(rows, ids).select("doc_id", "batch_id")


@query(f"SELECT doc_id FROM {FILES} WHERE NOT starts_with(path, 'src1/')")
def conversation_removal(spark, sf):
    """A conversation goes with its messages, tool output and thinking."""
    kinds = F.when(F.col("doc_id") % 3 == 0, "conv/").when(F.col("doc_id") % 3 == 1, "convtool/").otherwise("convthink/")
    return maintenance.without_conversation(files(spark, sf).select("doc_id", F.concat(kinds, "path").alias("relative_path")), "src1").select("doc_id")


@query(f"""SELECT conversation_id, message_index, 'convthink/' || conversation_id || '/' || message_index AS relative_path, 'why' AS content FROM {MESSAGES}
UNION ALL SELECT conversation_id, message_index, 'conv/' || conversation_id || '/' || message_index || '/' || p, CASE p WHEN 0 THEN repeat('é', 5) ELSE repeat('é', 5) || 'z' END FROM {MESSAGES}, (SELECT unnest([0, 1]) AS p)""")
def message_pieces(spark, sf):
    """Text over the budget is cut between characters into numbered pieces, thinking is a row of its own, blank tools give none."""
    blank = F.struct(F.lit(" ").alias("name"), F.lit("").alias("display"), F.lit("bash").alias("lang_hint"), F.lit("x").alias("output"), F.lit(True).alias("is_error"))
    m = messages(spark, sf).withColumn("thinking", F.lit("why")).withColumn("text", F.lit("é" * 10 + "z")).withColumn("tools", F.array(blank))
    return shaping.message_rows(m, 11).select("conversation_id", "message_index", "relative_path", "content")


@query(f"SELECT conversation_id, message_index FROM {MESSAGES} WHERE message_index % 3 = 1 AND starts_with(conversation_id, 'cursor:') AND message_index < 6 AND role IN ('user', 'assistant') AND md5(conversation_id) < 'c'")
def conversation_filter_all(spark, sf):
    """Every clause of the filter at once, the conversations as a table."""
    n = F.col("message_index")
    m = messages(spark, sf).withColumns({"provider": keys.provider(F.col("conversation_id")), "workspace_root": F.when(n < 6, "/w").otherwise("/v"), "parent_conversation_id": F.when(n % 3 == 1, "p").otherwise(""), "archived": F.when(n % 3 == 1, True)})
    ids = m.select("conversation_id").where("md5(conversation_id) < 'c'").distinct()
    f = filters.ConversationFilter(providers=["cursor"], workspace_roots=["/w", "/x"], roles=["USER", "Assistant"], parent_conversation_id="p", from_unix=1, until_unix=1 << 40, message_index_from=1, message_index_until=6, archived=True)
    rows = m.where(f.predicate()).withColumn("relative_path", F.concat_ws("/", F.lit("conv"), "conversation_id", F.col("message_index").cast("string")))
    return filters.in_conversations(rows, ids).select("conversation_id", "message_index")


# -- sizes, keys and status -------------------------------------------------------------------


@query("SELECT event_id, CAST(least(greatest(event_id * 1000000 - 3000000000, -2147483648), 2147483647) AS INTEGER) AS clamped, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def clamped_and_times(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", sizes.clamped_int(F.col("event_id") * 1_000_000 - 3_000_000_000).alias("clamped"), sizes.rfc3339(F.col("ts")).alias("at"))


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE TRUE END AS shown FROM events")
def visible_collections(spark, sf):
    i = F.col("event_id")
    name = F.concat(F.lit("code_chunks_"), i.cast("string"), F.when(i % 4 == 1, "_stg").when(i % 4 == 2, "_swap_previous_1").otherwise(""))
    return table(spark, sf, "events").select("event_id", keys.visible(name).alias("shown"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || content || chr(65533) || 'y' ELSE content END AS text FROM {FILES}")
def repaired_text(spark, sf):
    """A run of bytes that aren't UTF-8 becomes one replacement character."""
    data = F.encode("content", "UTF-8")
    broken = F.concat(F.encode(F.lit("x"), "UTF-8"), data, F.unhex(F.lit("FFFEC3")), F.encode(F.lit("y"), "UTF-8"))
    return files(spark, sf).select("doc_id", keys.repaired(F.when(F.col("doc_id") % 3 == 0, broken).otherwise(data)).alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN greatest(CAST(ceil(c_nationkey * 1000 * 4.0) AS BIGINT), c_nationkey * 1000 + 10000) END AS usual, NULL::BIGINT AS off,
CASE WHEN c_nationkey > 0 THEN c_nationkey * 1000 + 50 END AS floored, CASE WHEN c_nationkey > 0 THEN CAST(ceil(c_nationkey * 1000 * 1.5) AS BIGINT) END AS factored FROM customer""")
def growth_limits(spark, sf):
    """Without factor and floor there is no limit; either alone gives one."""
    n = F.col("c_nationkey").cast("long") * 1000
    limits = {"usual": status.growth_limit(n), "off": status.growth_limit(n, 0, 0), "floored": status.growth_limit(n, 0, 50), "factored": status.growth_limit(n, 1.5, 0)}
    return table(spark, sf, "customer").select("c_custkey", *[v.cast("long").alias(k) for k, v in limits.items()])


COLLECTION = "CASE c_nationkey % 6 WHEN 0 THEN 'ready' WHEN 1 THEN 'idle' WHEN 2 THEN 'loading' WHEN 3 THEN 'building' WHEN 4 THEN 'absent' ELSE 'unknown' END"


@query(f"""SELECT c_custkey, c_custkey % 4 > 0 AND c_custkey % 5 > 0 AND c_nationkey % 6 <= 2 AS searchable,
CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'waiting' ELSE 'stale' END WHEN c_custkey % 2 = 1 THEN 'stale'
WHEN c_nationkey % 6 = 4 THEN 'missing' WHEN c_nationkey % 6 = 1 THEN 'idle' WHEN c_nationkey % 6 IN (2, 3) THEN 'loading' ELSE 'indexed' END AS display FROM customer""")
def searchable_fold(spark, sf):
    """A dependency that is down, and what a collection is doing, decide over searches and over what is shown."""
    k, no = F.col("c_custkey"), F.lit(False)
    own = F.when(k % 2 == 0, "indexed").otherwise("stale")
    c = F.expr(COLLECTION)
    shown = status.display_status(own, active=no, reconcile=no, queued=no, scope_known=no, degraded=k % 5 == 0, collection=c)
    return table(spark, sf, "customer").select("c_custkey", status.searchable(k % 4 > 0, k % 5 == 0, c).alias("searchable"), shown.alias("display"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN 'proceed' WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'repair' ELSE 'missing' END AS search,
CASE WHEN c_nationkey % 3 = 0 THEN 'bootstrap' WHEN c_nationkey % 3 = 1 AND c_custkey % 4 = 0 AND c_custkey % 3 > 0 THEN 'bootstrap' ELSE 'noop' END AS empty_diff,
CASE c_custkey % 3 WHEN 0 THEN 'files (full build)' WHEN 1 THEN 'changed files' ELSE 'files' END AS scope, c_custkey % 2 = 0 OR c_nationkey % 2 = 0 OR TRUE = (c_custkey % 7 = c_nationkey % 7) AS same_model FROM customer""")
def modes_and_labels(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    presence = F.when(n % 3 == 0, "missing").when(n % 3 == 1, "present").otherwise("unknown")
    run = F.when(k % 3 == 0, "bootstrap").when(k % 3 == 1, "incremental").otherwise("")
    stored, current = F.when(k % 2 == 1, (k % 7).cast("string")), F.when(n % 2 == 1, (n % 7).cast("string")).otherwise("")
    return table(spark, sf, "customer").select(
        "c_custkey", status.search_mode(presence, k % 2 == 0, F.when(k % 3 == 0, "stale").otherwise("indexed")).alias("search"), status.empty_diff_mode(presence, k % 4, k % 3).alias("empty_diff"),
        status.scope_label(run, F.lit("file")).alias("scope"), status.same_model(stored, current).alias("same_model"),
    )


# -- guards -----------------------------------------------------------------------------------


@query("""SELECT coalesce(max(c_nationkey * 1000 + c_custkey % 1000), 0) AS expected FROM customer WHERE c_custkey % 4 = 1 AND c_custkey <> 1 AND c_custkey % 5 > 0 AND c_custkey % 3 > 0 AND c_custkey % 7 = 2
UNION ALL SELECT 0""")
def sibling_baseline(spark, sf):
    """What a first build of a worktree may expect from its siblings, and what without any."""
    k = F.col("c_custkey")
    registry = table(spark, sf, "customer").select(
        F.concat(F.lit("/w/"), k.cast("string")).alias("canonical_path"), F.when(k % 5 == 0, "document").otherwise("code").alias("kind"),
        F.when(k % 3 > 0, F.col("c_nationkey").cast("long") * 1000 + k % 1000).alias("last_chunks"), (k % 7).cast("string").alias("model"), k.alias("k"),
    )
    roots = registry.where("k % 4 = 1").select(F.col("canonical_path").alias("root"))
    found = guards.sibling_baseline(registry, roots, "/w/1", {"model": "2"})
    return found.unionAll(guards.sibling_baseline(registry, roots.limit(0), "/w/1", {"model": "2"}))


@query("""SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN c_nationkey WHEN c_custkey % 3 > 0 THEN c_custkey % 3 WHEN c_custkey % 5 > 0 THEN c_custkey % 5 ELSE 0 END AS total,
CASE WHEN c_custkey % 2 = 0 AND c_custkey >= 100 AND c_custkey % 7 = 0 THEN 'vcs_transient' WHEN c_custkey % 2 = 0 AND c_custkey >= 100 AND c_custkey % 3 > 0 AND c_custkey * 4 >= c_nationkey * 100 AND c_nationkey > 0 THEN 'large_delete' END AS wave FROM customer""")
def watcher_waves(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    total = guards.tracked_total(F.when(n > 3, n).otherwise(0), k % 3, k % 5)
    wave = guards.watcher_wave(F.when(k % 2 == 0, "code").otherwise("document"), k % 3 > 0, k, n * 100, k % 7 == 0)
    return table(spark, sf, "customer").select("c_custkey", total.cast("long").alias("total"), wave.alias("wave"))


@query("""WITH t AS (SELECT doc_id, sum(1) OVER (ORDER BY doc_id) AS total_chunks, sum(strlen(text)) OVER (ORDER BY doc_id) AS total_bytes FROM documents),
b AS (SELECT *, CASE WHEN total_chunks > 400 THEN 'chunk_cap' WHEN total_bytes > 600000 THEN 'byte_cap' END AS breach FROM t), h AS (SELECT min(doc_id) AS h FROM b WHERE breach IS NOT NULL)
SELECT doc_id, breach, h IS NULL OR doc_id < h AS admitted FROM b, h""")
def admission_caps(spark, sf):
    """The caps of a server that a request has tightened, without an expectation."""
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.lit(1).alias("chunks"), F.octet_length("text").cast("long").alias("bytes"))
    out = guards.admitted(items, max_chunks=guards.tighter(500, 400), max_bytes=guards.tighter(0, 600_000))
    return out.select(F.col("seq").alias("doc_id"), "breach", "admitted")


@query("SELECT change, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'removed' END AS change, doc_id FROM documents) WHERE change <> 'removed' GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM documents")
def absent_messages(spark, sf):
    """Messages that a delivery lacks stay, unless the delivery is authoritative."""
    k = F.col("doc_id") % 3
    changes = table(spark, sf, "documents").select(F.when(k == 0, "added").when(k == 1, "modified").otherwise("removed").alias("change"))
    n = F.count(F.lit(1)).alias("n")
    every = guards.absence(changes, "document", authoritative=True).unionByName(guards.absence(changes.limit(0), "code", quarantined=True)).agg(F.lit("all").alias("change"), n)
    return guards.absence(changes, "document").groupBy("change").agg(n).unionByName(every)


# -- paths and gates --------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT page_id, rtrim(regexp_replace(path, '^[^/]*/', ''), '/') AS p FROM {PAGE_PATHS})
SELECT page_id, CASE WHEN starts_with(p, 'fr/') THEN 'fr/' WHEN starts_with(p, 'de/13') THEN NULL WHEN starts_with(p, 'de/1') THEN '/de/1*' WHEN ends_with(p, '.html') THEN '*.html' END AS pattern,
CASE WHEN starts_with(p, 'fr/') THEN 'root' WHEN starts_with(p, 'de/13') THEN NULL WHEN starts_with(p, 'de/1') THEN 'sub' WHEN ends_with(p, '.html') THEN 'root' END AS source FROM p""")
def ignore_rules(spark, sf):
    """The last rule that matches decides; below an excluded directory nothing comes back."""
    rules = gates.rule_set([("*.html", "root"), ("fr/", "root"), ("!/fr/4*", "root"), ("/de/1*", "sub"), ("!de/13*", "sub")], builtin=False)
    path = F.rtrim(F.regexp_replace("path", "^[^/]*/", ""), F.lit("/"))
    found = page_paths(spark, sf).select("page_id", gates.ignored(path, rules).alias("x"))
    return found.select("page_id", "x.pattern", "x.source")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 NOT IN (0, 1)")
def builtin_ignores(spark, sf):
    i = F.col("doc_id")
    path = F.concat(F.lit("a/"), F.when(i % 4 == 0, "x.min.js").when(i % 4 == 1, ".git/config").otherwise(F.concat(i.cast("string"), F.lit(".go"))))
    return table(spark, sf, "documents").where(gates.verdict(path, F.lit(1), F.lit(True)).isNull()).select("doc_id")


@query(f"SELECT path FROM {FILES} WHERE source NOT IN ('src1', 'src3') AND doc_id % 50 <> 0")
def scope_gate(spark, sf):
    """Files in or below a nested worktree or submodule go, and a file that is one."""
    f = files(spark, sf).select("path", "source", "doc_id")
    barred = f.where("source in ('src1', 'src3')").select(F.col("source").alias("root")).union(f.where("doc_id % 50 = 0").select("path")).distinct()
    return gates.in_scope(f, barred).select("path")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'untracked' WHEN c_custkey % 3 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'ignored' WHEN c_custkey % 2 = 0 THEN 'indexed' ELSE 'pending' END AS state FROM customer""")
def path_states(spark, sf):
    k = F.col("c_custkey")
    state = paths.classified(F.lit("a"), F.when(k % 5 > 0, "r"), k % 7 == 0, k % 3 > 0, F.when(k % 2 == 0, "indexed").otherwise("stale"))
    return table(spark, sf, "customer").select("c_custkey", state.alias("state"))


@query(f"WITH r AS (SELECT DISTINCT source AS root FROM documents) SELECT root, path FROM {FILES}, r WHERE starts_with(path, root || '/')")
def descendant_codebases(spark, sf):
    f = files(spark, sf)
    own = f.select(F.col("source").alias("root")).distinct()
    return paths.descendants(own, own.union(f.select("path")))


@query(f"SELECT path FROM {FILES} WHERE NOT starts_with(path, 'src1/')")
def absorbed_codebases(spark, sf):
    return maintenance.absorbed(files(spark, sf).select("path"), "src1/", "path")


@query("SELECT event_id, event_type AS path, CAST(user_id AS VARCHAR) AS codebase_id FROM events WHERE event_id % 5 NOT IN (1, 2, 3) AND NOT (user_id = 4 AND event_type = 'click')")
def dispatched_events(spark, sf):
    """File events reach the roots that cover them; directories, .git, built-in and own ignore rules are left out."""
    e = table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    tail = F.when(i % 5 == 1, ".git/index").when(i % 5 == 2, "yarn.lock").otherwise(F.col("event_type"))
    rows = e.select(F.timestamp_micros(i).alias("ts"), F.concat(F.lit("/w/"), u, F.lit("/"), tail).alias("path"), (i % 5 == 3).alias("is_dir"))
    roots = e.select(u.alias("codebase_id"), F.concat(F.lit("/w/"), u).alias("root")).distinct()
    out = event_streams.dispatched(rows, roots, {"4": gates.rule_set([("click", "own")])})
    return out.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("event_id"), "path", "codebase_id")


# -- reports ----------------------------------------------------------------------------------

FEED = "SELECT user_id AS job_id, event_id AS \"offset\", event_type AS state FROM events WHERE user_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query(FEED)
def job_feed(spark, sf):
    """The state of the requested jobs, once; unknown ones are left out."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("offset"), F.col("event_type").alias("state"))
    ids = e.where("job_id % 3 = 0").select("job_id").union(spark.createDataFrame([(-1,), (-1,)], "job_id long"))
    return reports.job_feed(e, ids)


@query("""WITH n AS (SELECT unnest(['embed_vectors_total', 'jobs_active', 'sweep_runs_total']) AS name, unnest([0, 1, 2]) AS k), s AS (SELECT name, CAST(sum(CASE WHEN k = 1 AND event_id % 2 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS value FROM events JOIN n ON event_id % 4 = k GROUP BY name)
SELECT count(*) AS counters, count(*) FILTER (value > 0) AS used, CAST(sum(value) AS BIGINT) AS total, CAST(max(value) FILTER (name = 'jobs_active') AS BIGINT) AS active FROM (SELECT name, value FROM s UNION ALL SELECT 'other', 0 FROM range(30))""")
def counters_of_process(spark, sf):
    """All 33 counters, also those that nothing changed."""
    i = F.col("event_id")
    name = F.when(i % 4 == 0, "embed_vectors_total").when(i % 4 == 1, "jobs_active").when(i % 4 == 2, "sweep_runs_total")
    changes = table(spark, sf, "events").select(name.alias("name"), F.when((i % 4 == 1) & (i % 2 == 0), -1).otherwise(1).alias("delta")).where("name is not null")
    v = F.col("value")
    return reports.process_counters(changes).agg(F.count(F.lit(1)).alias("counters"), F.count(F.when(v > 0, 1)).alias("used"), F.sum(v).alias("total"), F.max(F.when(F.col("name") == "jobs_active", v)).alias("active"))


@query(f"""WITH s AS (SELECT ts AS "at" FROM events WHERE ts >= TIMESTAMP '{START}' - INTERVAL 1 DAY)
SELECT epoch_us(max("at") FILTER ("at" <= TIMESTAMP '{START}')) AS first, epoch_us(max("at")) AS last, max("at") >= TIMESTAMP '{END}' AND count(*) FILTER ("at" <= TIMESTAMP '{START}') > 0 AS complete FROM s""")
def report_coverage(spark, sf):
    start, end = window()
    e = table(spark, sf, "events").select(F.col("ts").alias("at")).where(F.col("at") >= start - F.expr("INTERVAL 1 DAY"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return reports.coverage(e, start, end).select(micros("first"), micros("last"), "complete")


@query(f"""WITH t AS (SELECT DISTINCT ts FROM events WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
g AS (SELECT epoch(ts) - epoch(coalesce(lag(ts) OVER (ORDER BY ts), TIMESTAMP '{START}')) AS s, ts FROM t)
SELECT greatest(max(s), epoch(TIMESTAMP '{END}') - epoch(max(ts))) > m AS gap, CAST(m AS INTEGER) AS most FROM g, (SELECT unnest([600, 900, 1800, 3600, 90000]) AS m) GROUP BY m""")
def sampling_gap_of_all(spark, sf):
    e, out = table(spark, sf, "events").select(F.col("ts").alias("at")), None
    for most in (600, 900, 1800, 3600, 90000):
        one = reports.sampling_gap(e, *window(), most=most).withColumn("most", F.lit(most))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(sum(floor(value)) AS DOUBLE) AS total_ms, CAST(count(*) AS DOUBLE) AS calls, CAST(sum(floor(value)) AS DOUBLE) / count(*) AS mean_ms FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def embedding_latency(spark, sf):
    """Of the events of one type, as the two counters that embedding keeps; a third counter plays no part."""
    e = table(spark, sf, "events")
    one = e.join(F.broadcast(e.agg(F.min("event_type").alias("event_type"))), "event_type")
    counters = {"embed_latency_ms_sum": F.sum(F.floor("value")), "embed_batches_total": F.count(F.lit(1)), "jobs_active": F.max(F.floor("value"))}
    wide = one.agg(*[v.cast("double").alias(k) for k, v in counters.items()])
    return reports.latency(wide.unpivot([], list(counters), "name", "delta"))


def ended(jobs: DataFrame, name: str) -> DataFrame:
    """(name, delta) of the jobs of each state."""
    return jobs.groupBy(F.format_string(name, "state").alias("name")).agg(F.count(F.lit(1)).alias("delta"))


@query(f"""WITH c AS (SELECT state, count(*) AS n FROM {JOBS} WHERE state IN ('completed', 'failed') GROUP BY state), r AS (SELECT state, count(*) AS n FROM {JOBS} WHERE state IN ('completed', 'failed') AND job_id % 3 > 0 GROUP BY state)
SELECT bool_or(c.n > coalesce(r.n, 0)) AS mismatch FROM c LEFT JOIN r USING (state) UNION ALL SELECT bool_or(a.n > b.n) FROM r a JOIN r b USING (state)""")
def journal_mismatches(spark, sf):
    """Counters of all jobs against a journal that lost a third of them, and counters of what it kept."""
    every = jobs(spark, sf)
    kept = every.where("job_id % 3 > 0")
    journal = ended(kept, "jobs_%s")
    return reports.journal_mismatch(ended(every, "jobs_%s_total"), journal).unionAll(reports.journal_mismatch(ended(kept, "jobs_%s_total"), journal))


@query(f"""WITH s AS (SELECT * FROM {SPANS}), c AS (SELECT parent_span_id AS span_id, sum(duration_ms) AS d FROM s WHERE parent_span_id IS NOT NULL GROUP BY 1),
x AS (SELECT name, greatest(0, duration_ms - coalesce(d, 0)) AS e FROM s LEFT JOIN c USING (span_id))
SELECT name, CAST(sum(e) AS BIGINT) AS total_ms, count(*) AS calls, CAST(max(e) AS BIGINT) AS max_ms, CAST(quantile_disc(e, 0.5) AS BIGINT) AS p50_ms FROM x GROUP BY name""")
def time_breakdown(spark, sf):
    long = {c: F.col(c).cast("long") for c in ("total_ms", "max_ms", "p50_ms")}
    return reports.time_breakdown(spans(spark, sf)).withColumns(long).select("name", "total_ms", "calls", "max_ms", "p50_ms")


@query("SELECT o_orderkey, kind, \"count\" FROM (SELECT o_orderkey, unnest(['added', 'reused']) AS kind, unnest([o_custkey % 9, o_custkey % 4]) AS \"count\" FROM orders) WHERE kind = 'added' OR o_orderkey % 2 = 0")
def chunk_outcomes(spark, sf):
    c = F.col("o_custkey")
    rows = reports.chunk_rows(c % 9, c % 4, F.col("o_orderkey") % 2 == 0)
    return table(spark, sf, "orders").select("o_orderkey", F.explode(rows).alias("x")).select("o_orderkey", "x.kind", "x.count")


def log_lines(spark, sf) -> DataFrame:
    """A log: counters, spans, messages of other kinds, and lines that aren't JSON objects."""
    i = F.col("event_id")
    at = F.date_format(F.timestamp_micros(F.lit(1_700_000_000_000_000) + i * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    counters = F.to_json(F.struct(at.alias("time"), F.lit(logs.SAMPLE_MESSAGE).alias("msg"), F.lit("INFO").alias("level"), i.alias("jobs_active"), (i * 2).alias("embed_vectors_total"), F.lit("x").alias("note")))
    parent = F.when(i % 8 == 1, F.lit("")).otherwise(F.concat(F.lit("s"), (i - 4).cast("string")))
    span = F.to_json(F.struct(at.alias("time"), F.lit(logs.SPAN_MESSAGE).alias("msg"), F.lit("run").alias("span"), F.concat(F.lit("s"), i.cast("string")).alias("span_id"), parent.alias("parent_span_id"), F.lit("j").alias("job_id"), (i * 1.5).alias("duration_ms")))
    line = F.when(i % 4 == 0, counters).when(i % 4 == 1, span).when(i % 4 == 2, F.when(i % 8 == 2, "[1, 2]").otherwise("{torn")).otherwise(F.to_json(F.struct(F.lit("other").alias("msg"))))
    return logs.checked(table(spark, sf, "events").select(line.alias("line")))


@query("""SELECT 1700000000 + event_id AS at, name, value FROM (SELECT event_id, unnest(['jobs_active', 'embed_vectors_total']) AS name, unnest([event_id, event_id * 2]) AS value FROM events WHERE event_id % 4 = 0)""")
def log_samples(spark, sf):
    return logs.samples(log_lines(spark, sf)).select(F.unix_seconds("at").alias("at"), "name", "value")


@query("""SELECT 1700000000 + event_id AS at, 'run' AS name, 's' || event_id AS span_id, CASE WHEN event_id % 8 <> 1 THEN 's' || (event_id - 4) END AS parent_span_id, 'j' AS job_id, CAST(floor(event_id * 1.5) AS BIGINT) AS duration_ms FROM events WHERE event_id % 4 = 1""")
def log_spans(spark, sf):
    return logs.spans(log_lines(spark, sf)).withColumn("at", F.unix_seconds("at"))


@query("SELECT count(*) AS malformed FROM events WHERE event_id % 4 = 2")
def log_malformed(spark, sf):
    return logs.malformed(log_lines(spark, sf))


@query("""SELECT "offset", user_id::VARCHAR AS job_id, event_type AS state, n AS files FROM (SELECT event_id AS "offset", user_id, event_type, event_id % 5 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 10 > 0) WHERE r = 1""")
def journal_events(spark, sf):
    """The last event of each job of a journal in which every tenth line is torn."""
    i = F.col("event_id")
    job = F.struct(F.col("user_id").cast("string").alias("id"), F.lit("c").alias("codebase_id"), F.col("event_type").alias("state"), F.create_map(F.lit("files_processed"), i % 5).alias("progress"))
    line = F.to_json(F.struct(F.lit("x").alias("event"), F.lit("2024-01-01T00:00:00Z").alias("occurred_at"), job.alias("job")))
    rows = table(spark, sf, "events").select(i.alias("offset"), F.when(i % 10 == 0, F.lit('{"event":')).otherwise(line).alias("line"))
    last = reports.last_events(logs.events_of(logs.checked(rows)))
    return last.select("offset", "job_id", "state", F.col("progress")["files_processed"].alias("files"))


# -- maintenance and reuse --------------------------------------------------------------------


@query(f"""WITH f AS (SELECT doc_id, source, sha256(content) AS h FROM {FILES}), own AS (SELECT h, min(doc_id) AS v FROM f WHERE doc_id % 3 = 0 GROUP BY h), wide AS (SELECT h, min(doc_id) + 1000000 AS v FROM f GROUP BY h)
SELECT wide.h AS content_hash, CAST(coalesce(own.v, wide.v) AS BIGINT) AS v FROM wide LEFT JOIN own USING (h)""")
def reuse_overlay(spark, sf):
    """An item's own vectors before those of the whole build."""
    f = files(spark, sf).select("doc_id", keys.content_key(F.col("content")).alias("content_hash"))
    vector = lambda rows, more: rows.groupBy("content_hash").agg(F.array((F.min("doc_id") + more).cast("double")).alias("vector"))
    return reuse.overlay(vector(f.where("doc_id % 3 = 0"), 0), vector(f, 1_000_000)).select("content_hash", F.col("vector")[0].cast("long").alias("v"))


@query(f"""WITH f AS (SELECT doc_id, sha256(content) AS h FROM {FILES}), c AS (SELECT DISTINCT h FROM f WHERE doc_id % 5 = 0), o AS (SELECT DISTINCT h FROM f WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN c.h IS NOT NULL THEN 0 WHEN o.h IS NOT NULL THEN 1 END AS store FROM f LEFT JOIN c USING (h) LEFT JOIN o USING (h)""")
def catalog_first(spark, sf):
    """Vectors of the catalog, which holds no content, come before those of the collection itself."""
    f = files(spark, sf)
    catalog = f.where("doc_id % 5 = 0").select(keys.content_key(F.col("content")).alias("content_hash"), F.lit("m").alias("model"), F.array(F.lit(1.0)).cast("array<float>").alias("vector"))
    own = f.where("doc_id % 2 = 0").select(F.lit(None).cast("string").alias("content_hash"), "content", F.lit(None).cast("string").alias("embedding_model"), F.array(F.lit(2.0)).cast("array<float>").alias("vector"))
    return reuse.reuse(f, [catalog, own], "m").select("doc_id", "store")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 = 0")
def index_lookup(spark, sf):
    """Rows of the labels that an index found."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return reuse.looked_up(e.where("vec_id % 7 = 0").select("vec_id"), e, "vec_id")


@query("""WITH f AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'ignored' ELSE 'indexed' END AS reason, strlen(text) AS b, doc_id FROM documents)
SELECT reason, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes, CASE WHEN reason = 'indexed' THEN CAST(sum(1 + doc_id % 3) AS BIGINT) ELSE 0 END AS chunks, CASE WHEN reason = 'indexed' THEN CAST(sum((1 + doc_id % 3) * b) AS BIGINT) ELSE 0 END AS chunk_bytes FROM f GROUP BY reason""")
def run_totals_of_chunks(spark, sf):
    f = files(spark, sf)
    reason = F.when(F.col("doc_id") % 9 == 0, "ignored")
    chunks = f.where(reason.isNull()).select("content", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int") + 1)))
    return maintenance.run_totals(f, reason, chunks)


@query(f"SELECT c_custkey AS node, CASE WHEN EXISTS (SELECT 1 FROM {EDGES} e WHERE e.src = c_custkey) THEN 1 ELSE 0 END AS depth FROM customer WHERE c_custkey % 100 = 0 AND EXISTS (SELECT 1 FROM {EDGES} e WHERE e.src = c_custkey)")
def trace_inbound(spark, sf):
    """Callers of every callee, one step up, of which some are looked at."""
    e = edges(spark, sf)
    found = graph.trace(e, e.select(F.col("dst").alias("node")).distinct(), "inbound", 1)
    return found.where("depth = 1 and node % 100 = 0")


@query(f"SELECT path, sha256(content) AS hash FROM {FILES} WHERE doc_id % 7 <> 0 AND doc_id % 2 = 0")
def snapshot_equal_parts(spark, sf):
    """A snapshot equals itself and differs from another; the files both of them agree on."""
    f = files(spark, sf)
    one, two = snapshots.captured(f.where("doc_id % 7 != 0")), snapshots.captured(f.where("doc_id % 2 = 0"))
    assert snapshots.equal(one, one) and not snapshots.equal(one, two)
    return one.join(snapshots.diff(one, two).select("path"), "path", "left_anti")


def embed_short(texts: list[str]) -> list[list[float]]:
    """Vectors of one number, for texts of up to 600 characters."""
    for i, t in enumerate(texts):
        if len(t) > 600:
            raise shaping.Rejected(i)
    return [[float(len(t))] for t in texts]


@query(f"""SELECT fate, count(*) AS pieces, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'reused' WHEN doc_id % 5 = 1 THEN 'refused' ELSE 'embedded' END AS fate,
CASE WHEN doc_id % 5 = 1 THEN 2 WHEN doc_id % 5 = 2 THEN 1 ELSE 500 END AS b FROM documents UNION ALL SELECT 'embedded', 500 FROM documents WHERE doc_id % 5 = 3) GROUP BY fate UNION ALL SELECT 'dropped', 0, 0""")
def embedding_fates(spark, sf):
    """What was reused, embedded (some of it in halves), dropped and refused as blank, each counted for itself."""
    k = F.col("doc_id") % 5
    content = F.when(k == 1, " \n").when(k == 2, "x").when(k == 3, F.repeat(F.lit("y"), 1000)).otherwise(F.repeat(F.lit("z"), 500))
    rows = table(spark, sf, "documents").select("doc_id", content.alias("content"), F.lit(None).cast("int").alias("split_part"), F.when(k == 0, F.array(F.lit(1.0))).cast("array<double>").alias("vector"))
    return shaping.fates(shaping.embedded_with_fate(rows, embed_short))
