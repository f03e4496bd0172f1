"""Chat formatting by quotation linking.

Each message is cut into lines with a quote level (how many > stand before it); the
lines that announce a quote go with it. Quoted passages, which are runs of lines of one
level, and their single lines are normalised and hashed and looked up among the own
passages and lines of earlier messages of the same conversation: the latest earlier message
that wrote one is its source. A passage that was wrapped anew so links as a whole, a part
of one by its lines. A message replies to the source of most of its lines and passages of
the lowest quote level that has a source (ties: the later one). Following
replies upwards gives every message its thread, and (thread, turn) orders a conversation
so that replies follow what they answer; the text keeps only what the message itself says.

Sources are found by hash and by blocks of turns, so that neither a conversation nor a
line that stands in very many messages is ever gathered in one task; threads are found
by doubling, in rounds as many as the logarithm of the longest chain of replies.

Defined results: a null text is empty; a message without quotes, or whose quotes have no
source, starts its own thread; rows that repeat conversation and turn count as one
message whose replies are the union, and each gives a row; a very long message is cut into lines whole; a null conversation or turn
is linked with nothing; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

TURNS = 1024
MARK = r"^(?:[ \t]?>)++[ \t]?"  # possessive: no recursion on deep quotes
#: How mail programs announce a quote, in the four languages of the tables.
ANNOUNCES = r"^(?:On|Am|Le|El)\b.{0,200}(?:wrote|schrieb|a écrit|escribió)\s?.{0,80}:\s*$"


def lines(text: Column) -> Column:
    """array<struct<level, line>>; the announcement of a quote has its level."""
    plain = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK, "").alias("line")))
    following = F.concat(F.slice(plain, F.lit(2), F.size(plain)), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("line"))))
    return F.zip_with(plain, following, lambda a, b: F.struct(F.when((a["level"] == 0) & (b["level"] > 0) & a["line"].rlike(ANNOUNCES), -1).otherwise(a["level"]).alias("level"), a["line"].alias("line")))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def passages(lines_: Column) -> Column:
    """array<struct<level, line>> of the runs of several lines of one level, joined by spaces; a blank line ends a run."""
    before = F.concat(F.array(F.lit(None).cast("struct<level:int,line:string>")), F.slice(lines_, F.lit(1), F.size(lines_) - 1))
    blank = lambda x: F.trim(x["line"]) == ""

    def piece(x: Column, last: Column) -> Column:
        goes_on = last.isNotNull() & (last["level"] == x["level"]) & ~blank(x) & ~blank(last)
        text = F.translate(x["line"], "\u0001\u0002\u0003", "")
        return F.when(goes_on, F.concat(F.lit("\u0003"), text)).otherwise(F.concat(F.lit("\u0001"), x["level"].cast("string"), F.lit("\u0002"), text))

    runs = F.split(F.array_join(F.zip_with(lines_, before, piece), ""), "\u0001")
    several = F.filter(runs, lambda r: F.contains(r, F.lit("\u0003")))
    return F.transform(several, lambda r: F.struct(F.substring_index(r, "\u0002", 1).cast("int").alias("level"), F.translate(F.substring_index(r, "\u0002", -1), "\u0003", " ").alias("line")))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with own_text and lines."""
    rows = messages.select("conv_id", "turn", "role", lines(F.col("text")).alias("lines"))
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"])
    return rows.withColumn("own_text", F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""))


def sources(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source) of every quoted line that has one."""
    said = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.concat("lines", passages(F.col("lines")))).alias("x"))
    said = said.select("conv_id", "turn", F.col("x.level").alias("level"), normalised(F.col("x.line")).alias("line")).where("line != '' and level >= 0")
    said = said.select("conv_id", "turn", "level", F.sha2("line", 256).alias("hash"))
    quoted = written(said.where("level > 0").groupBy("conv_id", "turn", "level", "hash").agg(F.count(F.lit(1)).alias("n")), "quoted")
    wanted = quoted.select("conv_id", "hash").distinct()
    own = written(said.where("level = 0").select("conv_id", "hash", "turn").distinct().join(wanted, ["conv_id", "hash"], "left_semi"), "own-lines")
    block = F.floor(F.col("turn") / TURNS)
    own, quoted = own.withColumn("block", block), quoted.withColumn("block", block)
    keys = ["conv_id", "hash"]
    # the latest own line of the blocks before, then of the same block
    blocks = own.groupBy(*keys, "block").agg(F.max("turn").alias("latest")).unionByName(quoted.select(*keys, "block").distinct().withColumn("latest", F.lit(None).cast("long")))
    blocks = blocks.groupBy(*keys, "block").agg(F.max("latest").alias("latest"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block", F.max("latest").over(earlier).alias("before"))
    both = own.select(*keys, "block", "turn", F.lit(0).alias("level"), F.lit(0).cast("long").alias("n"), F.col("turn").alias("own_turn"))
    both = both.unionByName(quoted.select(*keys, "block", "turn", "level", "n").withColumn("own_turn", F.lit(None).cast("long")))
    upto = Window.partitionBy(*keys, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("near", F.max("own_turn").over(upto)).where("level > 0")
    found = both.join(blocks, [*keys, "block"]).withColumn("source", F.coalesce("near", "before"))
    return found.where("source is not null").select("conv_id", "turn", "level", "n", "source")


def replies(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_linked)."""
    votes = found.groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = F.max_by("source", F.struct(-F.col("level"), F.col("n"), F.col("source")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("parent"), F.sum("n").alias("n_linked"))


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of the messages that reply to another: the turn at the top and the replies up to it."""
    state = written(linked.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        state = state.join(above, ["conv_id", "up"], "left")
        state = written(state.select("conv_id", "turn", F.coalesce("higher", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "replies")
        if state.where("moved").isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("thread"), "depth")


def format_chat(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own_text, n_quoted, n_linked, parent, thread, depth, formatted) of every row; order by conv_id, thread, turn."""
    rows = parsed(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    linked = written(replies(sources(rows)), "linked")
    out = rows.select("conv_id", "turn", "role", "own_text", F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"))
    if linked.isEmpty():
        none = F.lit(None).cast("long")
        out = out.withColumns({"parent": none, "n_linked": none, "thread": none, "depth": none})
    else:
        out = out.join(linked.join(threads(linked), ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own_text"), F.lit("\n"))
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", "own_text", "n_quoted", F.coalesce("n_linked", zero).alias("n_linked"), "parent", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", zero).alias("depth"), formatted.alias("formatted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS k, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
l AS (SELECT k, conv_id, turn, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM m),
p AS (SELECT *, CAST(len(regexp_replace(regexp_extract(x, '^(?:[ \t]?>)+[ \t]?'), '[^>]', '', 'g')) AS INTEGER) AS lv, regexp_replace(x, '^(?:[ \t]?>)+[ \t]?', '') AS line FROM l),
q AS (SELECT *, CASE WHEN lv = 0 AND lead(lv) OVER w > 0 AND regexp_matches(line, '^(?:On|Am|Le|El)\b.{0,200}(?:wrote|schrieb|a écrit|escribió)\s?.{0,80}:\s*$') THEN -1 ELSE lv END AS level FROM p WINDOW w AS (PARTITION BY k ORDER BY i)),
r AS (SELECT *, lag(level) OVER w = level AND trim(line) <> '' AND trim(lag(line) OVER w) <> '' AS goes_on FROM q WINDOW w AS (PARTITION BY k ORDER BY i)),
u AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM r),
said AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS t FROM (
  SELECT conv_id, turn, level, line FROM u UNION ALL SELECT conv_id, turn, level, string_agg(line, ' ' ORDER BY i) FROM u GROUP BY k, conv_id, turn, level, run HAVING count(*) > 1
) WHERE level >= 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
quoted AS (SELECT conv_id, turn, level, t, count(*) AS n FROM said WHERE level > 0 AND t <> '' GROUP BY ALL),
found AS (SELECT a.conv_id, a.turn, a.level, a.t, a.n, max(b.turn) AS source FROM quoted a JOIN (SELECT DISTINCT conv_id, turn, t FROM said WHERE level = 0) b ON a.conv_id = b.conv_id AND a.t = b.t AND b.turn < a.turn GROUP BY ALL),
votes AS (SELECT conv_id, turn, level, source, sum(n) AS n FROM found GROUP BY ALL),
linked AS (SELECT conv_id, turn, arg_max(source, (-level, n, source)) AS parent, CAST(sum(n) AS BIGINT) AS n_linked FROM votes GROUP BY ALL),
up AS (SELECT conv_id, turn, parent AS top, CAST(1 AS BIGINT) AS depth FROM linked UNION ALL SELECT up.conv_id, up.turn, linked.parent, up.depth + 1 FROM up JOIN linked ON linked.conv_id = up.conv_id AND linked.turn = up.top),
thread AS (SELECT conv_id, turn, arg_max(top, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL),
own AS (SELECT k, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS own_text, CAST(count(*) FILTER (level > 0) AS BIGINT) AS n_quoted FROM q GROUP BY k)
SELECT m.conv_id, m.turn, role, own_text, n_quoted, coalesce(n_linked, 0) AS n_linked, parent, coalesce(thread, m.turn) AS thread, coalesce(depth, 0) AS depth, '<|' || coalesce(role, '') || '|>' || chr(10) || own_text || chr(10) AS formatted
FROM m JOIN own USING (k) LEFT JOIN linked USING (conv_id, turn) LEFT JOIN thread USING (conv_id, turn)
"""
