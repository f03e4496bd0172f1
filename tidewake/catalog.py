"""Named queries over the test tables, and the same in SQL.

The tables stand in for the engine's own: `documents` are files (path source/id.lang),
`conversations` messages, `embeddings` rows of a collection, `labels` a nullable flag,
`events` samples, spans and file events, `orders` and `lineitem` jobs and what they did.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, sizes, status
from .operators import blocks, bounds, filters, gates, graph, guards, hashtree, lexical, maintenance, many, paths, reports, retrieval, reuse, shaping, snapshots
from .session import staged, table, work_dir
from .streaming import events as event_streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- the tables in their roles ------------------------------------------------------------------

FILES = "(SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, '.' || lang AS extension, text AS content, source, lang FROM documents)"
MESSAGES = "(SELECT CASE WHEN conv_id % 3 = 0 THEN 'claude' WHEN conv_id % 3 = 1 THEN 'cursor' ELSE '' END || ':' || CAST(conv_id AS VARCHAR) AS conversation_id, CAST(turn AS INTEGER) AS message_index, role, text, 1700000000 + conv_id * 1000 + turn AS timestamp_unix FROM conversations)"
#: Seconds since the epoch, so that neither engine's time zone matters.
SAMPLES = "(SELECT event_type || '_' || CAST(user_id % 40 AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN '_total' ELSE '' END AS name, ts AS \"at\", CAST(max(floor(value)) AS BIGINT) AS value FROM events GROUP BY 1, 2)"
START, END = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
JOBS = "(SELECT o_orderkey AS job_id, o_custkey AS codebase_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS state, CAST(o_orderdate AS TIMESTAMP) AS completed_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.concat(F.lit("."), "lang").alias("extension"), F.col("text").alias("content"), "source", "lang")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    maker = F.when(F.col("conv_id") % 3 == 0, "claude").when(F.col("conv_id") % 3 == 1, "cursor").otherwise("")
    return c.select(F.concat(maker, F.lit(":"), F.col("conv_id").cast("string")).alias("conversation_id"), F.col("turn").cast("int").alias("message_index"), "role", "text", (1700000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp_unix"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    name = F.concat("event_type", F.lit("_"), (F.col("user_id") % 40).cast("string"), F.when(F.col("user_id") % 2 == 0, "_total").otherwise(""))
    return e.groupBy(name.alias("name"), F.col("ts").alias("at")).agg(F.max(F.floor("value")).cast("long").alias("value")).withColumn("live", F.lit(False))


def window() -> tuple[Column, Column]:
    return F.to_timestamp(F.lit(START)), F.to_timestamp(F.lit(END))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("codebase_id"), state.alias("state"), at.alias("completed_at"), at.alias("updated_at"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a collection."""
    return table(spark, sf, "embeddings")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The query is the vector of row 0."""
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


def knn(spark: SparkSession, sf: str, rows: DataFrame | None = None, **how) -> DataFrame:
    rows = vectors(spark, sf) if rows is None else rows
    found = retrieval.search(rows, query_vector(spark, sf), id_col="vec_id", vector="embedding", digits=6, **how)
    return found.select("vec_id", "label", "score")


SCORED = "(SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))"

# -- ranked retrieval ---------------------------------------------------------------------------


@query(f"SELECT * FROM {SCORED} ORDER BY score DESC, vec_id LIMIT 10")
def knn_topk(spark, sf):
    return knn(spark, sf)


@query(f"SELECT * FROM {SCORED} WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered_label(spark, sf):
    return knn(spark, sf, where=F.col("label").isin(1, 3))


@query(f"SELECT * FROM {SCORED} WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 50")
def knn_min_score(spark, sf):
    return knn(spark, sf, min_score=0.1, limit=50)


@query(f"SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM {SCORED} WHERE score >= 0.001) WHERE n <= 2 ORDER BY score DESC, vec_id LIMIT 10")
def knn_capped(spark, sf):
    return knn(spark, sf, group="label", cap=2, min_score=0.001)


@query(f"SELECT * FROM {SCORED} WHERE label IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY score DESC, vec_id LIMIT 10")
def knn_id_scope(spark, sf):
    ids = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("label"))
    return retrieval.search_in(vectors(spark, sf), ids, "label", query_vector(spark, sf), id_col="vec_id", vector="embedding", digits=6).select("vec_id", "label", "score")


@query(f"SELECT * FROM {SCORED} ORDER BY score DESC, vec_id LIMIT 10")
def knn_merged_batches(spark, sf):
    v = vectors(spark, sf)
    return retrieval.merged([knn(spark, sf, v.where(F.col("label") % 2 == r)) for r in (0, 1)], 10, "vec_id")


#: Of so many cells so many are probed. The vectors form no clusters, so recall only comes from rows scored (see the README).
CELLS, PROBES = 8, 7


def celled(spark: SparkSession, sf: str) -> tuple[DataFrame, list[list[float]]]:
    """The collection with its cells, and their centres."""
    e = vectors(spark, sf)
    centres = [r["embedding"] for r in e.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(CELLS).collect()]
    return retrieval.assign_cells(e, centres, "embedding"), centres


@query(f"""WITH k AS (SELECT embedding AS c, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS n FROM embeddings QUALIFY n < 8),
p AS (SELECT n FROM k, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY list_dot_product(c::DOUBLE[], q::DOUBLE[]) DESC, n LIMIT 7),
a AS (SELECT vec_id, arg_max(n, (list_dot_product(embedding::DOUBLE[], c::DOUBLE[]), -n)) AS n FROM embeddings, k GROUP BY vec_id)
SELECT vec_id, label, score FROM {SCORED} JOIN a USING (vec_id) JOIN p USING (n) ORDER BY score DESC, vec_id LIMIT 10""")
def knn_cells(spark, sf):
    """Approximate: rows of the PROBES cells nearest to the query, of CELLS centres."""
    rows, centres = celled(spark, sf)
    return retrieval.approximate(rows, query_vector(spark, sf), centres, PROBES, id_col="vec_id", vector="embedding", digits=6).select("vec_id", "label", "score")


@query(f"SELECT * FROM {SCORED} ORDER BY score DESC, vec_id LIMIT 10")
def knn_bounded(spark, sf):
    """Exact, with full vectors read only where the codes' bounds leave them in."""
    codes = staged(bounds.coded(vectors(spark, sf).select("vec_id", "embedding"), "embedding").drop("embedding"), "codes")
    found = bounds.search_bounded(codes, vectors(spark, sf), query_vector(spark, sf), id_col="vec_id", vector="embedding", digits=6)
    return found.select("vec_id", "label", "score")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""")
def knn_many(spark, sf):
    """The neighbours of every row whose id 50 divides, in one query."""
    e = vectors(spark, sf)
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = many.nearest(e, asked, id_col="vec_id", vector="embedding", query_col="query_id", query_vector="embedding", digits=6)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT path, extension FROM {FILES} WHERE extension IN ('.en', '.de') AND (path = 'src1' OR starts_with(path, 'src1/') OR starts_with(path, 'src10/'))")
def search_ext_prefix(spark, sf):
    return files(spark, sf).where(filters.code_filter(["en", " .de", ""], ["/src1/", "src10"], "path", "extension")).select("path", "extension")


BM25 = r"""
WITH q AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark WHERE item_id = 0),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d),
p AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d),
f AS (SELECT doc_id, l, term, count(*) AS tf FROM p JOIN q USING (term) GROUP BY ALL),
x AS (SELECT term, count(*) AS df FROM f GROUP BY term),
sparse AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / av))) AS score FROM f JOIN x USING (term), s GROUP BY doc_id)
"""


def first_item(spark, sf) -> str:
    return table(spark, sf, "benchmark").where("item_id = 0").first()["text"]


#: Indexes of this process: by application, and name, size and time of every file they are made of.
_indexes: dict[tuple, str] = {}


def document_index(spark: SparkSession, sf: str) -> str:
    """The keyword index of documents, built once for each application and state of the table's files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(at)))
    key = (spark.sparkContext.applicationId, *found)
    if key not in _indexes:
        path = f"{work_dir(spark)}/documents-index-{len(_indexes)}"
        blocks.write(table(spark, sf, "documents"), path, "doc_id", "text")
        _indexes[key] = path
    return _indexes[key]


@query(BM25 + "SELECT doc_id, round(score, 6) AS score FROM sparse ORDER BY score DESC, doc_id LIMIT 10")
def bm25_blocks(spark, sf):
    """bm25_topk from the index, which leaves most blocks unread."""
    found = blocks.search(spark, document_index(spark, sf), first_item(spark, sf), 10, digits=6)
    return found.rows.withColumnRenamed("id", "doc_id")


@query(BM25 + "SELECT doc_id, round(score, 6) AS score FROM sparse ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    docs = table(spark, sf, "documents")
    found = lexical.bm25(docs, first_item(spark, sf), "doc_id", "text").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return retrieval.top(found, 10, "doc_id")


@query(BM25 + f""", dense AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM {SCORED} JOIN documents ON doc_id = vec_id QUALIFY r <= 10),
lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM sparse JOIN embeddings ON vec_id = doc_id QUALIFY r <= 10)
SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM lex) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_rrf(spark, sf):
    docs, v = table(spark, sf, "documents"), vectors(spark, sf)
    ids = v.select(F.col("vec_id").alias("id"))
    dense = retrieval.scored(v, query_vector(spark, sf), "embedding", 6).select(F.col("vec_id").alias("id"), "score").join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    sparse = blocks.search(spark, document_index(spark, sf), first_item(spark, sf), 10, among=ids, digits=6).rows
    return lexical.hybrid(dense, sparse, 10).select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@query("""WITH RECURSIVE d AS (SELECT source AS relative_path, CAST(doc_id AS INTEGER) AS rank, CAST(doc_id * 37 % 200 AS INTEGER) AS s, CAST(doc_id * 37 % 200 + len(text) % 60 AS INTEGER) AS e, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT relative_path, n, rank, TRUE AS kept, [{'s': s, 'e': e}] AS have FROM d WHERE n = 1
UNION ALL SELECT relative_path, n, rank, ok, CASE WHEN ok THEN list_append(have, {'s': s, 'e': e}) ELSE have END FROM (
SELECT d.*, r.have, len(list_filter(r.have, lambda k: least(k.e, d.e) - greatest(k.s, d.s) + 1 > 0 AND (least(k.e, d.e) - greatest(k.s, d.s) + 1) * 2 > d.e - d.s + 1)) = 0 AS ok FROM r JOIN d ON d.relative_path = r.relative_path AND d.n = r.n + 1))
SELECT d.relative_path, d.rank, s AS start_line, e AS end_line FROM d JOIN r USING (relative_path, rank) WHERE kept""")
def min_line_overlap_dedupe(spark, sf):
    """Results on line ranges of one file each."""
    d = table(spark, sf, "documents")
    start = (F.col("doc_id") * 37 % 200).cast("int")
    rows = d.select(F.col("source").alias("relative_path"), F.col("doc_id").cast("int").alias("rank"), start.alias("start_line"), (start + F.pmod(F.length("text"), F.lit(60)).cast("int")).alias("end_line"))
    return retrieval.without_overlaps(rows)


# -- predicates over messages --------------------------------------------------------------------


def with_columns(rows: DataFrame) -> DataFrame:
    empty = F.lit("")
    return rows.withColumns({"provider": keys.provider(F.col("conversation_id")), "workspace_root": empty, "parent_conversation_id": empty, "archived": F.lit(None).cast("boolean")})


@query(f"SELECT conversation_id, message_index, role FROM {MESSAGES} WHERE lower(role) IN ('user', 'system')")
def conv_filter_roles(spark, sf):
    f = filters.ConversationFilter(roles=["USER", "System"])
    return with_columns(messages(spark, sf)).where(f.predicate()).select("conversation_id", "message_index", "role")


@query(f"SELECT conversation_id, message_index, role FROM {MESSAGES} WHERE timestamp_unix >= 1700010000 AND timestamp_unix < 1700060000 AND message_index >= 1 AND message_index < 4")
def conv_filter_range(spark, sf):
    f = filters.ConversationFilter(from_unix=1700010000, until_unix=1700060000, message_index_from=1, message_index_until=4)
    return with_columns(messages(spark, sf)).where(f.predicate()).select("conversation_id", "message_index", "role")


@query(f"SELECT conversation_id, message_index, role FROM {MESSAGES} WHERE starts_with(conversation_id, 'claude:')")
def conv_filter_provider(spark, sf):
    return with_columns(messages(spark, sf)).where(filters.ConversationFilter(providers=["claude"]).predicate()).select("conversation_id", "message_index", "role")


@query("SELECT doc_id, toxic = 1 AS archived FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 0")
def nullable_flag_filter(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", (F.col("toxic") == 1).alias("archived"))
    return rows.where(filters.ConversationFilter(archived=False).predicate())


# -- keys ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, 'chunk_' || substr(sha256(path || ':1:' || CAST(len(content) AS VARCHAR) || CASE WHEN doc_id % 3 > 0 THEN ':' || CAST(doc_id % 3 AS VARCHAR) ELSE '' END || ':' || content), 1, 16) AS id FROM {FILES}")
def chunk_ids(spark, sf):
    part = (F.col("doc_id") % 3).cast("int")
    return files(spark, sf).select("doc_id", keys.chunk_id(F.col("path"), F.lit(1), F.length("content"), F.col("content"), part).alias("id"))


@query(f"SELECT doc_id, sha256(content) AS content_key, greatest(1, (strlen(content) + 3) // 4) AS tokens, strlen(content) + strlen(path) + 256 AS row_bytes FROM {FILES}")
def content_hash(spark, sf):
    c = F.col("content")
    return files(spark, sf).select("doc_id", keys.content_key(c).alias("content_key"), sizes.token_estimate(c).cast("long").alias("tokens"), sizes.row_bytes(64, c, F.col("path")).cast("long").alias("row_bytes"))


@query(f"SELECT doc_id, substr(md5(path), 1, 8) AS short_hash, extension FROM {FILES}")
def path_prefix_hash(spark, sf):
    return files(spark, sf).select("doc_id", keys.short_hash(F.col("path")).alias("short_hash"), keys.extension(F.col("path")).alias("extension"))


@query(f"SELECT conversation_id, message_index, CASE WHEN role = 'user' THEN json_object('conversation_id', conversation_id, 'message_index', message_index) ELSE json_object('conversation_id', conversation_id, 'message_index', message_index, 'role', role) END::VARCHAR AS metadata FROM {MESSAGES}")
def metadata_json(spark, sf):
    made = keys.metadata_json(conversation_id=F.col("conversation_id"), message_index=F.col("message_index"), role=F.when(F.col("role") == "user", "").otherwise(F.col("role")))
    return messages(spark, sf).select("conversation_id", "message_index", made.alias("metadata"))


# -- snapshots -----------------------------------------------------------------------------------

#: Two snapshots of the same files: a seventh is new, another was removed, of a third the content changed.
PREVIOUS = f"(SELECT path, sha256(content) AS hash FROM {FILES} WHERE doc_id % 7 <> 0)"
CURRENT = f"(SELECT path, CASE WHEN doc_id % 7 = 2 THEN sha256(content || '!') ELSE sha256(content) END AS hash FROM {FILES} WHERE doc_id % 7 <> 1)"
DIFF = f"(SELECT path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN p.hash <> c.hash THEN 'modified' END AS change FROM {PREVIOUS} p FULL JOIN {CURRENT} c USING (path) WHERE p.path IS NULL OR c.path IS NULL OR p.hash <> c.hash)"


def two_snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf)
    kind = F.col("doc_id") % 7
    changed = F.when(kind == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return snapshots.captured(f.where(kind != 0)), snapshots.captured(f.where(kind != 1).withColumn("content", changed))


@query("WITH f AS (SELECT source, source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, sha256(text) AS hash FROM documents) SELECT source, sha256('config:x' || chr(0) || string_agg(path || chr(0) || hash || chr(0), '' ORDER BY path, hash)) AS digest FROM f GROUP BY source")
def snapshot_digest(spark, sf):
    f = files(spark, sf).select("source", "path", keys.content_key(F.col("content")).alias("hash"))
    return snapshots.digest(f, "x", "source")


@query(f"SELECT * FROM {DIFF}")
def snapshot_diff(spark, sf):
    return snapshots.diff(*two_snapshots(spark, sf))


@query(f"SELECT * FROM {DIFF}")
def snapshot_tree_diff(spark, sf):
    """snapshot_diff by hash trees: only rows of leaves with unequal digests are joined."""
    return hashtree.diff_by_leaves(*two_snapshots(spark, sf), levels=3)


FINGERPRINT = "sha256(string_agg(CAST(message_index AS VARCHAR) || chr(0) || role || chr(0) || text || chr(0) || chr(0), '' ORDER BY message_index))"


@query(f"SELECT conversation_id, {FINGERPRINT} AS fingerprint FROM {MESSAGES} GROUP BY conversation_id")
def conversation_fingerprint(spark, sf):
    return snapshots.fingerprints(messages(spark, sf))


def manifests(spark, sf) -> tuple[DataFrame, DataFrame]:
    m = messages(spark, sf)
    old = m.where((F.col("message_index") < 3) & (F.col("timestamp_unix") % 5000 >= 1000))
    return snapshots.fingerprints(old), snapshots.fingerprints(m)


MANIFESTS = f"""WITH m AS (SELECT * FROM {MESSAGES}),
old AS (SELECT conversation_id, {FINGERPRINT} AS f FROM m WHERE message_index < 3 AND timestamp_unix % 5000 >= 1000 GROUP BY 1),
new AS (SELECT conversation_id, {FINGERPRINT} AS f FROM m GROUP BY 1),
ch AS (SELECT conversation_id, CASE WHEN old.f IS NULL THEN 'added' ELSE 'modified' END AS change FROM new LEFT JOIN old USING (conversation_id) WHERE old.f IS NULL OR old.f <> new.f)
"""


@query(MANIFESTS + "SELECT * FROM ch")
def manifest_needed(spark, sf):
    return snapshots.needed(*manifests(spark, sf))


@query(f"WITH d AS (SELECT * FROM {DIFF}) SELECT * FROM d UNION ALL SELECT path, 'modified' FROM {CURRENT} WHERE path IN (SELECT path FROM {FILES} WHERE doc_id % 5 = 0) AND path NOT IN (SELECT path FROM d)")
def forced_union(spark, sf):
    previous, current = two_snapshots(spark, sf)
    ids = files(spark, sf).where("doc_id % 5 = 0").select("path")
    return snapshots.forced(snapshots.diff(previous, current), current, ids)


@query(f"SELECT path FROM (SELECT path FROM {DIFF} WHERE change = 'added' ORDER BY path <= 'src15/', path LIMIT 25)")
def needed_rotation(spark, sf):
    added = snapshots.diff(*two_snapshots(spark, sf)).where("change = 'added'").select("path")
    return snapshots.rotated(added, "path", "src15/", 25)


@query(MANIFESTS + """, mo AS (SELECT conversation_id FROM ch WHERE change = 'modified'), ad AS (SELECT conversation_id FROM ch WHERE change = 'added'),
n AS (SELECT count(*) AS n FROM mo)
SELECT conversation_id FROM mo, n WHERE n <= 70 UNION ALL
SELECT conversation_id FROM (SELECT conversation_id, row_number() OVER (ORDER BY conversation_id <= 'cursor:3', conversation_id) AS r FROM ad), n WHERE n <= 70 AND r <= 70 - n UNION ALL
SELECT conversation_id FROM (SELECT conversation_id, row_number() OVER (ORDER BY conversation_id <= 'cursor:3', conversation_id) AS r FROM mo), n WHERE n > 70 AND r <= 70""")
def needed_capped(spark, sf):
    return snapshots.capped_needed(snapshots.needed(*manifests(spark, sf)), 70, "cursor:3")[0]


@query(f"""WITH p AS (SELECT path, hash, CAST(regexp_extract(path, '/(\\d+)\\.', 1) AS BIGINT) AS inode FROM {PREVIOUS}),
c AS (SELECT path || CASE WHEN i % 7 = 3 THEN '.moved' ELSE '' END AS path, hash, i AS inode, CASE WHEN i % 11 = 0 THEN 'ignored' END AS reason FROM (SELECT path, hash, CAST(regexp_extract(path, '/(\\d+)\\.', 1) AS BIGINT) AS i FROM {CURRENT})),
b AS (SELECT path FROM p UNION SELECT path FROM c),
s AS (SELECT c.path, min(p.path) AS source FROM c JOIN p ON c.inode = p.inode AND c.hash = p.hash WHERE c.reason IS NULL AND c.path NOT IN (SELECT path FROM p) GROUP BY 1)
SELECT path, CASE WHEN c.path IS NULL OR reason IS NOT NULL THEN CASE WHEN p.path IS NULL THEN 'noop' ELSE 'remove' END WHEN p.hash = c.hash THEN 'noop' WHEN s.source IS NOT NULL THEN 'copy' ELSE 'upsert' END AS action,
CASE WHEN c.path IS NOT NULL AND reason IS NULL AND p.hash IS DISTINCT FROM c.hash THEN s.source END AS source
FROM b LEFT JOIN p USING (path) LEFT JOIN c USING (path) LEFT JOIN s USING (path)""")
def converge_actions(spark, sf):
    inode = F.regexp_extract("path", r"/(\d+)\.", 1).cast("long")
    previous, current = (x.withColumns({"inode": inode, "device": F.lit(1)}) for x in two_snapshots(spark, sf))
    current = current.withColumn("path", F.concat("path", F.when(F.col("inode") % 7 == 3, ".moved").otherwise(""))).withColumn("reason", F.when(F.col("inode") % 11 == 0, "ignored"))
    return snapshots.converge(previous.select("path").union(current.select("path")), previous, current)


# -- reuse ---------------------------------------------------------------------------------------


def store(rows: DataFrame, model: str | None) -> DataFrame:
    """A collection of documents with vectors of one number, their ids."""
    return rows.select(F.when(F.col("doc_id") % 3 != 0, keys.content_key(F.col("content"))).alias("content_hash"), "content", F.lit(model).cast("string").alias("embedding_model"), F.array(F.col("doc_id").cast("float")).alias("vector"))


@query(f"WITH s AS (SELECT DISTINCT sha256(content) AS h FROM {FILES} WHERE doc_id % 2 = 0) SELECT doc_id, h IS NOT NULL AS reused FROM {FILES} f LEFT JOIN s ON s.h = sha256(f.content)")
def vector_reuse(spark, sf):
    f = files(spark, sf)
    return reuse.reuse(f, [store(f.where("doc_id % 2 = 0"), "m")], "m").select("doc_id", "reused")


@query(f"""WITH s AS (SELECT sha256(content) AS h, 0 AS p FROM {FILES} WHERE doc_id % 5 = 0 UNION ALL SELECT sha256(content), 2 FROM {FILES} WHERE doc_id % 3 = 0),
b AS (SELECT h, min(p) AS p FROM s GROUP BY h) SELECT doc_id, p AS store FROM {FILES} f LEFT JOIN b ON b.h = sha256(f.content)""")
def reuse_priority(spark, sf):
    f = files(spark, sf)
    stores = [store(f.where("doc_id % 5 = 0"), "m"), store(f.where("doc_id % 2 = 0"), "other"), store(f.where("doc_id % 3 = 0"), None)]
    return reuse.reuse(f, stores, "m").select("doc_id", "store")


@query(f"SELECT DISTINCT sha256(sha256(content) || chr(0) || 'm') AS catalog_key FROM {FILES} WHERE sha256(content) NOT IN (SELECT sha256(content) FROM {FILES} WHERE doc_id % 4 = 0)")
def catalog_append(spark, sf):
    f = files(spark, sf).select("doc_id", keys.content_key(F.col("content")).alias("content_hash"), F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("vector"))
    catalog = f.where("doc_id % 4 = 0").select(keys.catalog_key(F.col("content_hash"), F.col("model")).alias("catalog_key"))
    return reuse.append(catalog, f).select("catalog_key")


# -- maintenance ---------------------------------------------------------------------------------


@query(f"SELECT doc_id, path FROM {FILES} WHERE doc_id % 3 = 0")
def prune_current(spark, sf):
    f = files(spark, sf)
    return maintenance.pruned(f, f.where("doc_id % 3 = 0").select("path"), "path").select("doc_id", "path")


@query(f"SELECT path, content FROM {FILES} WHERE doc_id % 4 <> 0 UNION ALL SELECT path, 'new' FROM {FILES} WHERE doc_id % 4 = 0")
def replace_by_id(spark, sf):
    f = files(spark, sf).select("path", "content")
    new = files(spark, sf).where("doc_id % 4 = 0").select("path", F.lit("new").alias("content"))
    return maintenance.replaced(f, new, "path")


def piece_rows(spark, sf) -> DataFrame:
    m = messages(spark, sf)
    base = keys.message_path(F.col("conversation_id"), F.col("message_index"))
    return m.select("conversation_id", "message_index", "role", base.alias("relative_path"), F.col("text").alias("content"))


@query(f"SELECT 'conv/' || conversation_id || '/' || message_index || '/0' AS relative_path FROM {MESSAGES} WHERE message_index % 2 = 1")
def missing_families(spark, sf):
    rows = piece_rows(spark, sf)
    produced = rows.select(F.concat("relative_path", F.lit("/0")).alias("relative_path"))
    return maintenance.missing_families(produced, rows.where("message_index % 2 = 0"))


@query(f"SELECT DISTINCT conversation_id FROM {MESSAGES} WHERE message_index >= 5")
def needs_work(spark, sf):
    rows = piece_rows(spark, sf)
    return maintenance.needs_work(rows.select("conversation_id", "relative_path"), rows.where("message_index < 5").select("relative_path", "content"))


def flagged(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Rows of which a third have a root and those labelled a flag, and entries for half of the conversations."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.concat("source", F.lit(":"), "lang").alias("conversation_id"), F.when(F.col("doc_id") % 3 == 0, "/root").otherwise("").alias("workspace_root"), (F.col("toxic") == 1).alias("archived"))
    entries = rows.where("conversation_id < 'src15'").groupBy("conversation_id").agg(F.lit("/new").alias("workspace_root"), F.lit(True).alias("archived"))
    # a conversation that was sent twice has two entries
    return rows, entries.unionByName(entries.withColumn("workspace_root", F.lit("/alt")))


FLAGGED = "WITH r AS (SELECT doc_id, source || ':' || lang AS conversation_id, CASE WHEN doc_id % 3 = 0 THEN '/root' ELSE '' END AS workspace_root, toxic = 1 AS archived FROM documents LEFT JOIN labels USING (doc_id))\n"


@query(FLAGGED + "SELECT doc_id, CASE WHEN workspace_root = '' AND conversation_id < 'src15' THEN '/new' ELSE workspace_root END AS workspace_root, CASE WHEN archived IS NULL AND conversation_id < 'src15' THEN TRUE ELSE archived END AS archived FROM r")
def enrichment_backfill(spark, sf):
    return maintenance.enriched(*flagged(spark, sf)).select("doc_id", "workspace_root", "archived")


@query(FLAGGED + "SELECT count(*) FILTER (conversation_id < 'src15') AS changed, count(*) FILTER (conversation_id >= 'src15') AS orphan FROM r WHERE workspace_root = '' OR archived IS NULL")
def enrichment_counts(spark, sf):
    return maintenance.enrichment_counts(*flagged(spark, sf))


ROWS = f"(SELECT path AS relative_path, 'chunk_' || CAST(doc_id AS VARCHAR) AS id, content, CAST(doc_id % 2 AS INTEGER) AS split_part FROM {FILES})"


@query(f"""WITH r AS (SELECT CASE WHEN starts_with(relative_path, 'src1/') THEN 'src1' ELSE relative_path END AS relative_path, id, content, split_part FROM {ROWS})
SELECT CASE WHEN relative_path = 'src1' THEN 'moved' ELSE relative_path END AS relative_path, CASE WHEN relative_path <> 'src1' THEN id WHEN split_part > 0 THEN 'chunk_' || substr(sha256('moved:1:2:1:' || content), 1, 16) ELSE 'chunk_' || substr(sha256('moved:' || id), 1, 16) END AS id FROM r""")
def copy_rename(spark, sf):
    f = files(spark, sf)
    path = F.when(F.startswith("path", F.lit("src1/")), "src1").otherwise(F.col("path"))
    rows = f.select(path.alias("relative_path"), F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("id"), "content", (F.col("doc_id") % 2).cast("int").alias("split_part"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    return maintenance.copied(rows, "src1", "moved", move=True).select("relative_path", "id")


@query(f"SELECT relative_path FROM {ROWS} WHERE NOT (relative_path = 'src1' OR starts_with(relative_path, 'src1/') OR starts_with(relative_path, 'src3/'))")
def removal_prefix(spark, sf):
    return maintenance.removed(files(spark, sf).select(F.col("path").alias("relative_path")), prefixes=["src1", "src3/"])


# -- shaping -------------------------------------------------------------------------------------


#: What a file's bytes are cut into: (path, at, bytes), by the last character that ends in the budget.
CUT_AT = f"""WITH RECURSIVE f AS (SELECT path, content, strlen(content) AS total FROM {FILES}),
c AS (SELECT path, total, unnest(string_split(content, '')) AS ch, generate_subscripts(string_split(content, ''), 1) AS i FROM f WHERE total > 1152),
b AS (SELECT path, total, CAST(sum(strlen(ch)) OVER (PARTITION BY path ORDER BY i) AS BIGINT) AS off FROM c UNION ALL SELECT path, total, 0 FROM f WHERE total > 1152),
nxt AS (SELECT x.path, x.off, y.off AS following FROM (SELECT path, off, off + 1152 AS most FROM b WHERE off < total) x ASOF JOIN b y ON x.path = y.path AND x.most >= y.off),
r AS (SELECT path, off, following FROM nxt WHERE off = 0 UNION ALL SELECT r.path, nxt.off, nxt.following FROM r JOIN nxt ON nxt.path = r.path AND nxt.off = r.following)
"""


@query(CUT_AT + "SELECT path, CAST(off + 1 AS INTEGER) AS split_part, CAST(following - off AS INTEGER) AS bytes FROM r UNION ALL SELECT path, NULL, CAST(total AS INTEGER) FROM f WHERE total <= 1152 OR total IS NULL")
def byte_budget_split(spark, sf):
    rows = files(spark, sf).select("path", "content", F.lit(None).cast("int").alias("split_part"))
    return shaping.split_rows(rows, 1152).select("path", "split_part", F.octet_length("content").alias("bytes"))


@query(f"""WITH RECURSIVE f AS (SELECT path, regexp_extract_all(regexp_replace(content, '[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]', ' ', 'g'), '[^\n]*\n|[^\n]+$') AS ls FROM {FILES}),
l AS (SELECT path, generate_subscripts(ls, 1) AS i, len(unnest(ls)) AS n FROM f), c AS (SELECT path, i, CAST(sum(n) OVER (PARTITION BY path ORDER BY i) AS BIGINT) AS upto, CAST(coalesce(sum(n) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM l),
m AS (SELECT path, max(i) AS lines FROM c GROUP BY path),
w AS (SELECT x.path, x.i AS first, greatest(x.i, coalesce(y.i, 0)) AS last FROM (SELECT path, i, before + 2500 AS most FROM c) x ASOF LEFT JOIN c y ON x.path = y.path AND x.most >= y.upto),
g AS (SELECT w.path, w.first, w.last, min(b.i) AS back FROM w JOIN c z ON z.path = w.path AND z.i = w.last JOIN c b ON b.path = w.path AND b.i > w.first AND b.i <= w.last AND z.upto - b.before <= 300 GROUP BY ALL),
s AS (SELECT w.path, w.first, w.last, CASE WHEN w.last < lines THEN coalesce(g.back, w.last + 1) END AS following FROM w JOIN m USING (path) LEFT JOIN g USING (path, first, last)),
r AS (SELECT path, first, last, following FROM s WHERE first = 1 UNION ALL SELECT s.path, s.first, s.last, s.following FROM r JOIN s ON s.path = r.path AND s.first = r.following)
SELECT path, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line, sha256(array_to_string(ls[first:last], '')) AS hash FROM r JOIN f USING (path) WHERE regexp_matches(array_to_string(ls[first:last], ''), '\\S')""")
def file_line_chunks(spark, sf):
    """Of line ends only \\n is left, which is what the SQL knows."""
    f = files(spark, sf).withColumn("content", F.regexp_replace("content", "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\u2028\u2029]", " "))
    return shaping.file_chunks(f).select("path", "start_line", "end_line", F.sha2("content", 256).alias("hash"))


@query()
def structure_chunks(spark, sf):
    """Files cut by structure; held against its invariants in tests/test_structure.py, as SQL has no trees."""
    f = files(spark, sf).select("path", "content")
    return shaping.file_chunks(f, windows=shaping.structure_windows).select("path", "start_line", "end_line", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("hash"))


def packing_sql(cost: str, budget: int, most: int) -> str:
    """Documents of each source in order, in groups within the budget and of at most so many."""
    return f"""WITH RECURSIVE d AS (SELECT source, doc_id, CAST({cost} AS BIGINT) AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT source, doc_id, n, CAST(0 AS BIGINT) AS "group", c AS used, CAST(1 AS BIGINT) AS held FROM d WHERE n = 1
UNION ALL SELECT source, doc_id, n, CASE WHEN fresh THEN "group" + 1 ELSE "group" END, CASE WHEN fresh THEN c ELSE used + c END, CASE WHEN fresh THEN 1 ELSE held + 1 END FROM (
SELECT d.*, r."group", r.used, r.held, r.used + d.c > {budget} OR r.held >= {most} AS fresh FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1))
SELECT source, doc_id, "group" FROM r"""


@query(packing_sql("CASE WHEN doc_id % 4 = 0 THEN 0 ELSE greatest(1, (strlen(text) + 3) // 4) END", 6000, 32))
def pack_tokens(spark, sf):
    rows = files(spark, sf).select("source", "doc_id", "content")
    return shaping.packed_by_tokens(rows, "source", "doc_id", F.col("doc_id") % 4 == 0).select("source", "doc_id", "group")


@query(packing_sql("strlen(text)", 65_536, 1 << 40))
def pack_bytes(spark, sf):
    rows = files(spark, sf).select("source", "doc_id", F.octet_length("content").alias("bytes"))
    return shaping.packed_by_bytes(rows, "source", "doc_id", F.col("bytes"), 65_536).select("source", "doc_id", "group")


@query(f"""SELECT conversation_id, message_index, role, 'conv/' || conversation_id || '/' || message_index AS relative_path, text AS content FROM {MESSAGES} WHERE regexp_matches(text, '\\S')
UNION ALL SELECT conversation_id, message_index, role, 'convtool/' || conversation_id || '/' || message_index || '/0', 'run' || chr(10) || role FROM {MESSAGES}""")
def conversation_rows(spark, sf):
    tool = F.struct(F.lit(" run ").alias("name"), F.col("role").alias("display"), F.lit("").alias("lang_hint"), F.lit("").alias("output"), F.lit(False).alias("is_error"))
    m = messages(spark, sf).withColumn("tools", F.array(tool)).withColumn("thinking", F.lit(" \n"))
    return shaping.message_rows(m, 1_000_000)


@query(f"SELECT conversation_id, message_index, role, text, starts_with(conversation_id, 'claude:') AS has_derived FROM {MESSAGES}")
def message_reassembly(spark, sf):
    """Messages cut into pieces of 100 bytes and put together again; a third also have a tool call."""
    tool = F.struct(F.lit("run").alias("name"), F.repeat(F.lit("é x "), 60).alias("display"), F.lit("").alias("lang_hint"), F.lit("out").alias("output"), F.lit(False).alias("is_error"))
    m = messages(spark, sf).withColumn("tools", F.when(F.startswith("conversation_id", F.lit("claude:")), F.array(tool)))
    return shaping.reassembled(shaping.message_rows(m, 100))


@query(f"""SELECT conversation_id, message_index, 'convtool/' || conversation_id || '/' || message_index || '/0' AS relative_path, CASE WHEN message_index % 2 = 0
THEN concat_ws(chr(10), 'run', 'cat', 'grep', '/out/' || message_index, 'out/' || message_index, 'cat ' || role || '.txt | grep x > out/' || message_index)
ELSE concat_ws(chr(10), 'run', 'cat ' || role || '.txt | grep x > out/' || message_index) END AS content FROM {MESSAGES}""")
def tool_rows(spark, sf):
    """Calls of a shell give its programs and files beside the command; what a call put out is left out."""
    command = F.concat(F.lit("cat "), "role", F.lit(".txt | grep x > out/"), F.col("message_index").cast("string"))
    tool = F.struct(F.lit(" run ").alias("name"), command.alias("display"), F.when(F.col("message_index") % 2 == 0, "bash").otherwise("sql").alias("lang_hint"), F.lit("what it put out").alias("output"), F.lit(False).alias("is_error"))
    m = messages(spark, sf).withColumn("tools", F.array(tool)).withColumn("text", F.lit(" "))
    return shaping.message_rows(m, 1_000_000).select("conversation_id", "message_index", "relative_path", "content")


# -- gates and guards ----------------------------------------------------------------------------

REASON = "CASE WHEN doc_id % 17 = 0 THEN 'out_of_scope' WHEN extension = '.fr' THEN 'ignored' WHEN strlen(content) > 4000 THEN 'oversize' WHEN doc_id % 13 = 0 THEN 'non_utf8' END"


def reasons(spark, sf) -> tuple[DataFrame, Column]:
    """Files of which some lie in .git, and some end in a byte that isn't UTF-8."""
    f = files(spark, sf)
    path = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("a/.git/"), "path")).otherwise(F.col("path"))
    text = F.when(F.col("doc_id") % 13 == 0, F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("C3"))).cast("string")).otherwise(F.col("content"))
    return f, gates.verdict(path, F.octet_length("content"), F.is_valid_utf8(text), excluded=F.endswith("path", F.lit(".fr")), limit=4000)


@query(f"SELECT path, {REASON} AS reason FROM {FILES}")
def gate_reasons(spark, sf):
    f, reason = reasons(spark, sf)
    return f.select("path", reason.alias("reason"))


@query(f"SELECT coalesce({REASON}, 'indexed') AS reason, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM {FILES} GROUP BY 1")
def run_totals(spark, sf):
    return maintenance.run_totals(*reasons(spark, sf))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '/7[0-9]*[^/]*$') THEN '*/7*' END AS pattern FROM pages")
def ignore_explained(spark, sf):
    rules = gates.rule_set([("7*", ".gitignore"), ("# none", ".gitignore")], builtin=False)
    path = F.regexp_replace("url", "^[a-z]+://", "")
    found = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("last"))
    return found.select("page_id", F.when(gates.ignored(F.col("last"), rules)["pattern"].isNotNull(), "*/7*").alias("pattern"))


@query("""WITH t AS (SELECT doc_id, sum(1 + doc_id % 3) OVER (ORDER BY doc_id) AS total_chunks, sum(strlen(text)) OVER (ORDER BY doc_id) AS total_bytes FROM documents),
h AS (SELECT min(doc_id) AS h FROM t WHERE total_bytes > 1000000 OR total_chunks > greatest(ceil(300 * 4.0), 300 + 200))
SELECT doc_id, CAST(total_chunks AS BIGINT) AS total_chunks, CAST(total_bytes AS BIGINT) AS total_bytes, h IS NULL OR doc_id < h AS admitted FROM t, h""")
def admission_halt(spark, sf):
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), (1 + F.col("doc_id") % 3).alias("chunks"), F.octet_length("text").cast("long").alias("bytes"))
    out = guards.admitted(items, expected=300, max_bytes=1_000_000, floor=200)
    return out.select(F.col("seq").alias("doc_id"), "total_chunks", "total_bytes", "admitted")


@query("SELECT source, count(*) FILTER (doc_id % 3 = 0) AS missing, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) >= 100 AND count(*) FILTER (doc_id % 3 = 0) * 4 >= count(*) AS suspicious FROM documents GROUP BY source")
def delete_wave(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.when(F.col("doc_id") % 3 == 0, 1)).alias("missing"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("suspicious", guards.suspicious(F.lit("code"), F.lit(True), F.col("missing"), F.col("total")))


@query("SELECT count(*) FILTER (doc_id % 4 = 0) AS missing, count(*) AS total FROM documents")
def wave_of_snapshot(spark, sf):
    f = files(spark, sf)
    return guards.wave(f, f.where("doc_id % 4 != 0"))


RELEASE = "CASE WHEN c_custkey % 7 = 0 THEN 'mark_missing' WHEN c_custkey % 5 = 0 THEN 'hold' WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'clear' ELSE 'clear_and_sync' END WHEN c_nationkey % 3 + 1 >= 2 THEN 'sync' ELSE 'hold' END"


@query(f"SELECT c_custkey, {RELEASE} AS action FROM customer")
def quarantine_release(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", guards.release(k % 7 == 0, k % 5 == 0, k % 2 != 0, k % 3 == 0, F.col("c_nationkey") % 3).alias("action"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'indexed' WHEN c_custkey % 5 = 0 THEN 'pending' WHEN c_custkey % 7 = 0 THEN 'indexing' ELSE 'preparing' END
WHEN c_nationkey % 3 = 0 THEN 'idle' WHEN c_nationkey % 3 = 1 THEN 'stale' ELSE 'preparing' END AS display FROM customer""")
def display_status(spark, sf):
    k, n, no = F.col("c_custkey"), F.col("c_nationkey") % 3, F.lit(False)
    own = F.when(n == 0, "indexed").when(n == 1, "stale").otherwise("indexing")
    shown = status.display_status(own, active=k % 2 == 0, reconcile=k % 3 == 0, queued=k % 5 == 0, scope_known=k % 7 == 0, degraded=no, collection=F.when(k % 2 == 0, "ready").otherwise("idle"))
    return table(spark, sf, "customer").select("c_custkey", shown.alias("display"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'bootstrap' ELSE 'incremental' END WHEN c_nationkey % 4 = 1 THEN 'bootstrap'
WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'already' WHEN c_custkey % 3 = 0 THEN 'bootstrap' ELSE 'incremental' END AS mode FROM customer""")
def start_mode(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    own = F.when(n == 0, "stale").when(n == 1, "discovered").otherwise("indexed")
    mode = status.start_mode(F.lit(True), own, k % 2 == 0, F.lit(False), F.when(k % 3 == 0, "missing").otherwise("present"))
    return table(spark, sf, "customer").select("c_custkey", mode.alias("mode"))


# -- paths ---------------------------------------------------------------------------------------

PAGE_PATHS = "(SELECT page_id, split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#', 1) AS path FROM pages)"


def page_paths(spark, sf) -> DataFrame:
    plain = F.substring_index(F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "?", 1), "#", 1)
    return table(spark, sf, "pages").select("page_id", plain.alias("path"))


ROOTS = f"(SELECT DISTINCT split_part(path, '/', 1) AS root FROM {PAGE_PATHS} UNION SELECT DISTINCT split_part(path, '/', 1) || '/en' FROM {PAGE_PATHS})"


def roots(p: DataFrame) -> DataFrame:
    host = F.substring_index("path", "/", 1)
    return p.select(host.alias("root")).union(p.select(F.concat(host, F.lit("/en")))).distinct()


@query(f"SELECT DISTINCT path, root FROM {PAGE_PATHS}, {ROOTS} WHERE path = root OR starts_with(path, root || '/')")
def path_coverage(spark, sf):
    p = page_paths(spark, sf)
    return paths.covering(p.select("path").distinct(), roots(p))


@query(f"SELECT path, arg_max(root, len(root)) AS root FROM {PAGE_PATHS}, {ROOTS} WHERE path = root OR starts_with(path, root || '/') GROUP BY path")
def nearest_ancestor(spark, sf):
    p = page_paths(spark, sf)
    return paths.nearest(p.select("path").distinct(), roots(p))


# -- reports -------------------------------------------------------------------------------------

WINDOWED = f"""WITH s AS (SELECT * FROM {SAMPLES}),
b AS (SELECT name, arg_max(value, "at") AS baseline, max("at") AS "at" FROM s WHERE "at" <= TIMESTAMP '{START}' GROUP BY name),
r AS (SELECT name, coalesce(bool_or(fell), FALSE) AS reset FROM (SELECT name, value < lag(value) OVER (PARTITION BY name ORDER BY "at") AS fell FROM (SELECT name, "at", value FROM s WHERE "at" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' UNION SELECT name, "at", baseline FROM b)) GROUP BY name)
"""


@query(WINDOWED + f"""SELECT name, "current", CASE WHEN ok THEN "current" - baseline END AS delta, CASE WHEN ok THEN round(("current" - baseline) / 864000.0, 12) END AS rate_per_second
FROM (SELECT c.name, "current", baseline, NOT coalesce(reset, FALSE) AND baseline IS NOT NULL AND "current" >= baseline AS ok FROM (SELECT name, arg_max(value, "at") AS "current" FROM s WHERE "at" <= TIMESTAMP '{END}' GROUP BY name) c LEFT JOIN b USING (name) LEFT JOIN r USING (name)) WHERE ends_with(name, '_total')""")
def counter_summary(spark, sf):
    s = samples(spark, sf).where(reports.counter(F.col("name")))
    return reports.counter_summary(s, *window()).withColumn("rate_per_second", F.round("rate_per_second", 12))


@query(f"""WITH s AS (SELECT * FROM {SAMPLES}), m AS (SELECT name, max("at") AS last FROM s GROUP BY name),
x AS (SELECT s.*, "at" = last AS live, "at" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AS inside FROM s JOIN m USING (name))
SELECT name, max(value) FILTER (live) AS "current", CASE WHEN count(*) FILTER (inside AND NOT live) > 0 THEN min(value) FILTER (inside) END AS min,
CASE WHEN count(*) FILTER (inside AND NOT live) > 0 THEN round(avg(value) FILTER (inside), 6) END AS mean, CASE WHEN count(*) FILTER (inside AND NOT live) > 0 THEN max(value) FILTER (inside) END AS max FROM x GROUP BY name""")
def gauge_summary(spark, sf):
    s = samples(spark, sf)
    last = s.groupBy("name").agg(F.max("at").alias("last"))
    marked = s.join(last, "name").withColumn("live", F.col("at") == F.col("last"))
    return reports.gauge_summary(marked, *window()).withColumn("mean", F.round("mean", 6))


@query(WINDOWED + "SELECT name, reset AND ends_with(name, '_total') AS reset FROM r")
def counter_resets(spark, sf):
    return reports.resets(samples(spark, sf), *window())


@query(WINDOWED + f"""SELECT name, reset AND ends_with(name, '_total') AS before, ends_with(name, '_total') AS inside, d.delta FROM r
LEFT JOIN (SELECT name, NULL::BIGINT AS delta FROM r) d USING (name)""")
def counter_resets_on_start(spark, sf):
    """A process that started before the window resets nothing, one that started in it resets every counter, which hides their deltas."""
    s, (start, end) = samples(spark, sf), window()
    before = reports.resets(s, start, end, start - F.expr("INTERVAL 1 DAY")).withColumnRenamed("reset", "before")
    inside = reports.resets(s, start, end, start + F.expr("INTERVAL 1 DAY")).withColumnRenamed("reset", "inside")
    hidden = reports.counter_summary(s.where(reports.counter(F.col("name"))), start, end, end).select("name", "delta")
    return before.join(inside, "name").join(hidden, "name", "left")


@query(f"""WITH t AS (SELECT DISTINCT event_type, ts FROM events WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
g AS (SELECT event_type, epoch(ts) - epoch(coalesce(lag(ts) OVER (PARTITION BY event_type ORDER BY ts), TIMESTAMP '{START}')) AS s, ts FROM t)
SELECT event_type, greatest(max(s), epoch(TIMESTAMP '{END}') - epoch(max(ts))) > 7200 AS gap FROM g GROUP BY event_type""")
def sampling_gaps(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("ts").alias("at"))
    return reports.sampling_gap(e, *window(), key="event_type", most=7200)


SPANS = "(SELECT event_id AS span_id, CASE WHEN event_id % 4 > 0 THEN event_id - event_id % 4 END AS parent_span_id, event_type AS name, CAST(floor(value) AS BIGINT) AS duration_ms FROM events)"


def spans(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select(i.alias("span_id"), F.when(i % 4 > 0, i - i % 4).alias("parent_span_id"), F.col("event_type").alias("name"), F.floor("value").cast("long").alias("duration_ms"))


@query(f"SELECT name, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS calls, round(avg(duration_ms), 6) AS mean_ms, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, max(duration_ms) AS max_ms FROM {SPANS} GROUP BY name")
def duration_summary(spark, sf):
    out = reports.durations(spans(spark, sf), "duration_ms", "name")
    return out.withColumns({"mean_ms": F.round("mean_ms", 6), "p50_ms": F.col("p50_ms").cast("long"), "p95_ms": F.col("p95_ms").cast("long")})


EXCLUSIVE = f"""WITH s AS (SELECT * FROM {SPANS}), c AS (SELECT parent_span_id AS span_id, sum(duration_ms) AS d FROM s WHERE parent_span_id IS NOT NULL GROUP BY 1),
x AS (SELECT s.*, greatest(0, duration_ms - coalesce(d, 0)) AS exclusive_ms, parent_span_id IS NULL OR parent_span_id NOT IN (SELECT span_id FROM s) AS root FROM s LEFT JOIN c USING (span_id))
"""


@query(EXCLUSIVE + "SELECT span_id, CAST(exclusive_ms AS BIGINT) AS exclusive_ms, root FROM x")
def exclusive_span_time(spark, sf):
    return reports.exclusive(spans(spark, sf)).select("span_id", "exclusive_ms", "root")


def span_jobs(spark, sf) -> DataFrame:
    """A job for every user: from their first event to their last."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"))


@query(EXCLUSIVE + """, j AS (SELECT CAST(sum(round((epoch(b) - epoch(a)) * 1000)) AS BIGINT) AS job_ms FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)), r AS (SELECT CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS root_ms FROM x WHERE root)
SELECT job_ms, root_ms, CASE WHEN coalesce(job_ms, 0) > 0 THEN job_ms - least(root_ms, job_ms) END AS unattributed_ms FROM j, r""")
def unattributed_time(spark, sf):
    return reports.unattributed(span_jobs(spark, sf), spans(spark, sf))


JOB_START, JOB_END = "1995-01-01 00:00:00", "1996-01-01 00:00:00"


@query(f"""WITH l AS (SELECT l_orderkey AS job_id, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT * FROM {JOBS} LEFT JOIN l USING (job_id) WHERE completed_at BETWEEN TIMESTAMP '{JOB_START}' AND TIMESTAMP '{JOB_END}'),
w AS (SELECT count(*) FILTER (state = 'completed') AS c, count(*) FILTER (state = 'failed') AS f, CAST(coalesce(sum(q), 0) AS BIGINT) AS q, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM j)
SELECT name, delta, round(delta / 31536000.0, 12) AS rate_per_second FROM (SELECT unnest(['jobs_completed', 'jobs_failed', 'jobs_cancelled', 'files_processed', 'files_embedded', 'chunks_processed', 'chunks_reused', 'chunks_embedded', 'embedding_batches', 'collection_rows_written', 'job_failures']) AS name,
unnest([c, f, 0, n, n, q, 0, q, n, q, f]) AS delta FROM w)""")
def job_rollup(spark, sf):
    done = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"))
    q, n = F.col("q"), F.col("n")
    rows = jobs(spark, sf).join(done, "job_id", "left").withColumns({"files_processed": n, "files_embedded": n, "chunks_processed": q, "chunks_reused": F.lit(0), "chunks_embedded": q, "embedding_batches": n, "collection_rows_written": q})
    return reports.job_rollup(rows, F.to_timestamp(F.lit(JOB_START)), F.to_timestamp(F.lit(JOB_END))).withColumn("rate_per_second", F.round("rate_per_second", 12))


@query("SELECT user_id AS job_id, event_id AS offset_, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_event_per_job(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("offset_"), F.col("event_type").alias("state"))
    return reports.last_events(e, "offset_")


@query(f"""WITH j AS (SELECT * FROM {JOBS}), t AS (SELECT *, row_number() OVER (PARTITION BY codebase_id ORDER BY coalesce(completed_at, updated_at) DESC, job_id) AS n FROM j WHERE state IN ('completed', 'failed', 'cancelled'))
SELECT job_id FROM (SELECT job_id FROM t WHERE n <= 5 ORDER BY coalesce(completed_at, updated_at) DESC, job_id LIMIT 5000) UNION ALL SELECT job_id FROM j WHERE state = 'running'""")
def journal_retention(spark, sf):
    return reports.retained(jobs(spark, sf)).select("job_id")


@query(f"SELECT job_id, lead(job_id) OVER (PARTITION BY codebase_id ORDER BY coalesce(completed_at, updated_at), job_id) AS successor FROM {JOBS} WHERE state IN ('completed', 'failed', 'cancelled')")
def superseded_jobs(spark, sf):
    return reports.superseded(jobs(spark, sf)).select("job_id", "successor")


@query("""WITH v AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'stale' ELSE 'odd' END AS d FROM orders), k AS (SELECT unnest(['indexed', 'indexing', 'preparing', 'pending', 'discovered', 'quarantined', 'stale', 'failed', 'missing', 'waiting', 'idle', 'loading']) AS d),
c AS (SELECT d, count(*) AS n FROM v GROUP BY d) SELECT 'codebases_total' AS name, count(*) AS value FROM v UNION ALL SELECT 'codebases.status=' || d, coalesce(n, 0) FROM k FULL JOIN c USING (d)""")
def status_counts(spark, sf):
    s = F.col("o_orderstatus")
    views = table(spark, sf, "orders").select(F.when(s == "F", "indexed").when(s == "O", "stale").otherwise("odd").alias("display"))
    return reports.status_counts(views)


@query(f"SELECT count(*) FILTER (o_orderstatus <> 'P') + 0 AS running, count(*) FILTER (o_orderstatus = 'P') + (SELECT count(*) FROM nation) AS queued FROM orders")
def activity_counts(spark, sf):
    j = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "queued").otherwise("running").alias("state"))
    return reports.activity(j, j.limit(0), table(spark, sf, "nation"))


OUTCOME = "(SELECT o_orderkey, o_custkey % 50 AS processed, o_custkey % 7 AS embedded, o_orderkey % 3 AS removed, o_orderkey % 2 AS pending, o_custkey % 2 AS skipped_oversize, o_orderkey % 4 AS skipped_unreadable FROM orders)"


@query(f"""SELECT o_orderkey, kind, "count" FROM (SELECT o_orderkey, unnest(['embedded', 'unchanged', 'removed', 'pending', 'oversize', 'unreadable']) AS kind,
unnest([embedded, greatest(processed - embedded - skipped_oversize - skipped_unreadable - pending, 0), removed, pending, skipped_oversize, skipped_unreadable]) AS "count" FROM {OUTCOME}) WHERE "count" > 0 OR kind = 'embedded'""")
def outcome_breakdown(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select("o_orderkey", (c % 50).alias("processed"), (c % 7).alias("embedded"), (o % 3).alias("removed"), (o % 2).alias("pending"), (c % 2).alias("skipped_oversize"), (o % 4).alias("skipped_unreadable"))
    return rows.select("o_orderkey", F.explode(reports.outcome_rows()).alias("x")).select("o_orderkey", "x.kind", "x.count")


@query("""SELECT o_orderkey, round(CASE WHEN o_custkey % 90 > o_orderkey % 60 THEN greatest(CAST(o_orderkey % 100 AS DOUBLE), (o_orderkey % 60) / (o_custkey % 90) * 100) ELSE CAST(o_orderkey % 100 AS DOUBLE) END, 9) AS overall,
round(CASE WHEN o_custkey % 3 > 0 THEN least(greatest((o_orderkey % 5) / (o_custkey % 3) * 100, 0), 100) WHEN o_custkey % 4 > 0 THEN least(greatest((o_orderkey % 3) / (o_custkey % 4) * 100, 0), 100) ELSE 0 END, 9) AS phase FROM orders""")
def percents(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    overall = reports.overall_percent(c % 90, o % 60, (o % 100).cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(overall, 9).alias("overall"), F.round(reports.phase_percent(c % 3, o % 5, c % 4, o % 3), 9).alias("phase"))


# -- streams and graphs --------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT CAST(user_id AS VARCHAR) AS codebase_id, epoch_us(min(ts)) AS start_us, count(DISTINCT event_type) AS paths, count(*) AS events FROM g GROUP BY user_id, g""")
def debounce_sessions(spark, sf):
    e = table(spark, sf, "events").select("ts", F.col("user_id").cast("string").alias("codebase_id"), F.col("event_type").alias("path"))
    out = event_streams.debounced(e, "6 hours")
    return out.select("codebase_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.size("paths").cast("long").alias("paths"), "events")


EDGES = "(SELECT DISTINCT o_custkey AS src, l_suppkey + 1000000 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45)"


def edges(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").where("l_quantity > 45")
    return table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), w AS (SELECT (SELECT min(src) FROM e) AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 2)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def trace_path_bfs(spark, sf):
    e = edges(spark, sf)
    return graph.trace(e, e.agg(F.min("src").alias("node")), "both", 2)


@query(f"""WITH e AS (SELECT * FROM {EDGES}), n AS (SELECT c_custkey AS node, CAST(c_nationkey AS VARCHAR) AS directory FROM customer), o AS (SELECT src AS node, count(*) AS c FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS c FROM e GROUP BY 1)
SELECT directory, count(*) AS nodes, CAST(coalesce(sum(o.c), 0) AS BIGINT) AS calls_out, CAST(coalesce(sum(i.c), 0) AS BIGINT) AS calls_in FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node) GROUP BY directory""")
def architecture_summary(spark, sf):
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string")).alias("path"))
    return graph.architecture(nodes, edges(spark, sf))


@query(f"SELECT src, count(*) AS calls FROM {EDGES} GROUP BY src ORDER BY calls DESC, src LIMIT 200")
def graph_query(spark, sf):
    e = edges(spark, sf)
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return graph.query("SELECT src, count(*) AS calls FROM {edges} GROUP BY src ORDER BY calls DESC, src", nodes, e)
