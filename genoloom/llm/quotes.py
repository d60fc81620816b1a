"""Quotation linking: messages are cut into quoted levels, and quotes are joined to the messages they repeat.

A line's level is the number of ``>`` it begins with (blanks between them allowed). Lines of level 0
are the message's own, but for an attribution ("... wrote:") right before a quote. Quoted lines that
follow each other on one level are a passage. Passages and own texts are cut into sentences, so that
re-wrapped lines still agree; a sentence is normalised (lower case, letters and digits only) and
hashed. The original of a sentence is the first message of the same conversation that has it as its
own, or else the first of all messages; if that one stands in the same conversation (later on), the
first message of the last conversation that has it. Sums, minima and maxima are taken before anything
is joined, so a sentence that stands everywhere is one row. Sentences of all levels are linked (``originals``). A
message replies to the message most of its sentences of the shallowest linked level come from (the
latest, if equal), or to the greatest smaller turn if it quotes nothing known; turns may have gaps.
Threads and depths follow by pointer doubling. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.common import salted_join, stored

LEVEL = r"^((?:[ \t]*>)+)"
#: Turns of a conversation that are put in order by one task at once, about.
BLOCK = 1024
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$"


def parsed_lines(text: Column) -> Column:
    """array<struct<level, content>> of the lines of a text."""
    return F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, LEVEL, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, LEVEL + r"[ \t]?", "").alias("content"),
        ),
    )


def sentences(text: Column) -> Column:
    """Distinct hashes of the normalised sentences of a text; those without a letter or digit are none."""
    plain = F.transform(F.split(text, r"[.!?]+(?=\s|$)"), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    return F.array_distinct(F.transform(F.filter(plain, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))


def parse(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """__conv (null: a conversation of its own name), conv_id, turn, role, own, quoted (array of level and passage text)."""
    rows = messages.select(
        F.coalesce(F.concat(F.lit("c"), messages[conv].cast("string")), F.lit("n")).alias("__conv"),
        messages[conv].alias("conv_id"), messages[turn].alias("turn"), messages[role].alias("role"), F.coalesce(messages[text], F.lit("")).alias("__text"),
    )
    rows = rows.withColumn("__lines", F.when(F.instr("__text", ">") > 0, parsed_lines(F.col("__text"))))
    after = lambda i: F.try_element_at(F.col("__lines"), i + 2)["level"]
    own = F.filter("__lines", lambda x, i: (x["level"] == 0) & ~F.coalesce(x["content"].rlike(ATTRIBUTION) & (after(i) > 0), F.lit(False)))
    rows = rows.withColumns(
        {
            "own": F.when(F.col("__lines").isNull(), F.col("__text")).otherwise(F.btrim(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), F.lit(" \t\r\n"))),
            # quoted lines in order; a line joins the passage before it if that has its level
            "quoted": F.when(
                F.col("__lines").isNotNull(),
                F.filter(
                    F.aggregate(
                        "__lines",
                        F.array().cast("array<struct<level:int,content:string>>"),
                        lambda a, x: F.when(
                            F.try_element_at(a, F.lit(-1))["level"] == x["level"],
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(x["level"].alias("level"), F.concat(F.try_element_at(a, F.lit(-1))["content"], F.lit(" "), x["content"]).alias("content")))),
                        ).otherwise(F.concat(a, F.array(x))),
                    ),
                    lambda x: x["level"] > 0,
                ),
            ),
        }
    )
    return rows.drop("__text", "__lines")


def _votes(placed: DataFrame, kind: str) -> DataFrame:
    """__conv, turn, level, o (inside, conv_id, turn of an original), n: the distinct quoted sentences of each level by their originals."""
    said = placed.select("__conv", "conv_id", "turn", F.explode(sentences(F.col("own"))).alias("s"))
    here = said.groupBy("__conv", "s").agg(F.min("turn").alias("at"))
    # the ends of the order of conversations: one of the two is another conversation, if any other has the sentence
    anywhere = said.groupBy("s").agg(F.min(F.struct("conv_id", "turn")).alias("first"), F.max(F.struct("conv_id", (-F.col("turn")).alias("up"))).alias("last"))
    quoted = placed.filter(F.size("quoted") > 0).select("__conv", "turn", F.explode("quoted").alias("q"))
    quoted = quoted.select("__conv", "turn", F.col("q.level").alias("level"), F.explode(sentences(F.col("q.content"))).alias("s")).distinct()
    found = salted_join(quoted, here, ["__conv", "s"], F.col("turn"), "left").withColumn("at", F.when(F.col("at") < F.col("turn"), F.col("at")))
    found = salted_join(found, anywhere, ["s"], F.xxhash64("__conv", "turn"), "left")
    # a quote of another conversation: only where its own has no earlier message with the sentence
    named = lambda c: F.coalesce(F.concat(F.lit("c"), F.col(c).cast("string")), F.lit("n"))
    other = F.when(named("first.conv_id") != F.col("__conv"), F.col("first")).when(named("last.conv_id") != F.col("__conv"), F.struct(F.col("last.conv_id").alias("conv_id"), (-F.col("last.up")).alias("turn")))
    found = found.withColumn("other", F.when(F.col("first").isNotNull(), other))
    origin = F.when(F.col("at").isNotNull(), F.struct(F.lit(True).alias("inside"), F.lit(None).cast(kind).alias("conv_id"), F.col("at").alias("turn"))).when(
        F.col("other").isNotNull(), F.struct(F.lit(False).alias("inside"), F.col("other.conv_id").alias("conv_id"), F.col("other.turn").alias("turn"))
    )
    return found.select("__conv", "turn", "level", origin.alias("o")).filter("o is not null").groupBy("__conv", "turn", "level", "o").agg(F.count(F.lit(1)).alias("n"))


def originals(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message, level and original: conv_id, turn, level, original_conv, original_turn, n_linked (distinct sentences)."""
    placed = stored(parse(messages, conv, turn, role, text)).filter(F.col("turn").isNotNull())
    ids = placed.groupBy("__conv").agg(F.first("conv_id").alias("conv_id"))
    votes = salted_join(_votes(placed, dict(messages.dtypes)[conv]), ids, ["__conv"], F.col("turn"))
    return votes.select("conv_id", "turn", F.col("level").cast("bigint").alias("level"), F.when(F.col("o.inside"), F.col("conv_id")).otherwise(F.col("o.conv_id")).alias("original_conv"), F.col("o.turn").alias("original_turn"), F.col("n").cast("bigint").alias("n_linked"))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, text (without quotes), n_passages, max_level, n_linked, parent_conv, parent_turn, thread, depth.

    n_linked counts the sentences from the parent, of the shallowest linked level. thread is the turn of the thread's first
    message, depth the number of replies from it. Sorted by conv_id, thread, turn the messages of a
    conversation stand in the order of replies. A null text has no own words; a message with a null
    turn has no parent and is no original. Null ids of conversations are one conversation. Rows that
    share conversation and turn are one message for the links and are all returned. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = stored(parse(messages, conv, turn, role, text))
    placed = rows.filter(F.col("turn").isNotNull())
    votes = _votes(placed, dict(messages.dtypes)[conv])
    best = votes.groupBy("__conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("up"), "n", "o")).alias("b")).select("__conv", "turn", F.col("b.n").alias("n"), F.col("b.o").alias("o"))
    parents = _preceded(placed.select("__conv", "turn").distinct()).join(best, ["__conv", "turn"], "left")
    tree = stored(
        parents.select(
            "__conv", "turn", "n", "o",
            F.when(F.col("o").isNull(), F.col("previous")).when(F.col("o.inside"), F.col("o.turn")).alias("up"),
        ).select("*", F.coalesce("up", "turn").alias("top"), F.col("up").isNotNull().cast("int").alias("depth"))
    )
    tree = _rooted(tree)
    inside = F.col("up").isNotNull()
    out = rows.join(tree, ["__conv", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"),
        F.greatest(F.size(F.coalesce("quoted", F.array().cast("array<struct<level:int,content:string>>"))), F.lit(0)).cast("bigint").alias("n_passages"),
        F.coalesce(F.array_max(F.transform("quoted", lambda x: x["level"])), F.lit(0)).cast("bigint").alias("max_level"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_linked"),
        F.when(inside, F.col("conv_id")).otherwise(F.col("o.conv_id")).alias("parent_conv"),
        F.coalesce("up", "o.turn").alias("parent_turn"),
        F.col("top").alias("thread"), F.col("depth").cast("bigint").alias("depth"),
    )


def _preceded(nodes: DataFrame) -> DataFrame:
    """``nodes`` (__conv, turn) with previous, the greatest smaller turn of the conversation.

    Turns are looked at in blocks of ``BLOCK`` numbers, and then the blocks' last turns in order: a conversation
    of very many messages is dealt to many tasks.
    """
    cut = F.floor(F.col("turn") / BLOCK)
    within = nodes.withColumn("__block", cut).withColumn("inner", F.lag("turn").over(Window.partitionBy("__conv", "__block").orderBy("turn")))
    tops = nodes.groupBy("__conv", cut.alias("__block")).agg(F.max("turn").alias("top"))
    tops = tops.withColumn("before", F.lag("top").over(Window.partitionBy("__conv").orderBy("__block"))).select("__conv", "__block", "before")
    return within.join(tops, ["__conv", "__block"]).select("__conv", "turn", F.coalesce("inner", "before").alias("previous"))


def _rooted(tree: DataFrame) -> DataFrame:
    """top: the first message of the thread, depth: steps to it. Each round doubles the steps taken, for the messages that still move."""
    names = ["__conv", "turn", "n", "o", "up", "top", "depth"]
    settled, active = tree.filter("depth = 0").select(names), tree.filter("depth > 0").select(names)
    while True:
        above = settled.unionByName(active).select("__conv", F.col("turn").alias("top"), F.col("top").alias("higher"), F.col("depth").alias("more"))
        step = salted_join(active, above, ["__conv", "top"], F.col("turn"))
        step = stored(step.select("__conv", "turn", "n", "o", "up", F.col("higher").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        settled, active = settled.unionByName(step.filter("not moved").select(names)), step.filter("moved").select(names)
        if active.isEmpty():
            return settled


#: Under DuckDB.
OP2_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, coalesce('c' || conv_id::VARCHAR, 'n') AS c, turn, role, coalesce(text, '') AS t FROM conversations),
l AS (
  SELECT rid, i, length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', '') AS content
  FROM (SELECT rid, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS x FROM m WHERE t LIKE '%>%')),
a AS (
  SELECT *, level = 0 AND NOT (regexp_matches(content, '(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$') AND coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i), 0) > 0) AS own,
         level <> coalesce(lag(level) OVER (PARTITION BY rid ORDER BY i), -1) AS new FROM l),
o AS (
  SELECT m.rid, CASE WHEN t LIKE '%>%' THEN trim(coalesce(x, ''), ' ' || chr(9) || chr(13) || chr(10)) ELSE t END AS own
  FROM m LEFT JOIN (SELECT rid, string_agg(content, chr(10) ORDER BY i) AS x FROM a WHERE own GROUP BY rid) USING (rid)),
p AS (
  SELECT rid, g, any_value(level) AS level, string_agg(content, ' ' ORDER BY i) AS content
  FROM (SELECT *, sum(new::INT) OVER (PARTITION BY rid ORDER BY i) AS g FROM a) WHERE level > 0 GROUP BY 1, 2),
s AS (
  SELECT DISTINCT rid, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS s FROM (
    SELECT rid, unnest(regexp_split_to_array(regexp_replace(own, '[.!?]+(\s|$)', chr(1) || '\1', 'g'), chr(1))) AS x FROM o)),
q AS (
  SELECT DISTINCT c, turn, level, s FROM (
    SELECT rid, level, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS s FROM (
      SELECT rid, level, unnest(regexp_split_to_array(regexp_replace(content, '[.!?]+(\s|$)', chr(1) || '\1', 'g'), chr(1))) AS x FROM p))
  JOIN m USING (rid) WHERE s <> '' AND turn IS NOT NULL),
said AS (SELECT c, conv_id, turn, s FROM s JOIN m USING (rid) WHERE s <> '' AND turn IS NOT NULL),
h AS (SELECT c, s, min(turn) AS "at" FROM said GROUP BY 1, 2),
w1 AS (SELECT s, conv_id AS fc, turn AS ft, c AS fk FROM said QUALIFY row_number() OVER (PARTITION BY s ORDER BY conv_id NULLS FIRST, turn) = 1),
w2 AS (SELECT s, conv_id AS lc, turn AS lt, c AS lk FROM said QUALIFY row_number() OVER (PARTITION BY s ORDER BY conv_id DESC NULLS LAST, turn) = 1),
v AS (
  SELECT c, turn, level, CASE WHEN h."at" < turn THEN true ELSE false END AS inside,
         CASE WHEN h."at" < turn THEN NULL WHEN fk <> c THEN fc ELSE lc END AS oc, CASE WHEN h."at" < turn THEN h."at" WHEN fk <> c THEN ft ELSE lt END AS ot
  FROM q LEFT JOIN h USING (c, s) LEFT JOIN w1 USING (s) LEFT JOIN w2 USING (s) WHERE coalesce(h."at" < turn, false) OR fk <> c OR lk <> c),
b AS (
  SELECT * FROM (SELECT c, turn, level, inside, oc, ot, count(*) AS n FROM v GROUP BY c, turn, level, inside, oc, ot)
  QUALIFY row_number() OVER (PARTITION BY c, turn ORDER BY level, n DESC, inside DESC, oc DESC NULLS LAST, ot DESC) = 1),
nodes AS (SELECT DISTINCT c, turn FROM m WHERE turn IS NOT NULL),
e AS (
  SELECT z.c, z.turn, n, inside, oc, ot, CASE WHEN inside IS NULL THEN z.previous WHEN inside THEN ot END AS up
  FROM (SELECT c, turn, lag(turn) OVER (PARTITION BY c ORDER BY turn) AS previous FROM nodes) z LEFT JOIN b USING (c, turn)),
r AS (
  SELECT c, turn, turn AS top, 0 AS depth FROM e WHERE up IS NULL
  UNION ALL SELECT e.c, e.turn, r.top, r.depth + 1 FROM e JOIN r ON e.c = r.c AND e.up = r.turn),
f AS (SELECT rid, count(*) AS n_passages, max(level) AS max_level FROM p GROUP BY 1)
SELECT m.conv_id, m.turn, m.role, own AS text, coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(max_level, 0)::BIGINT AS max_level, coalesce(n, 0)::BIGINT AS n_linked,
       CASE WHEN up IS NOT NULL THEN m.conv_id ELSE oc END AS parent_conv, coalesce(up, ot) AS parent_turn, top AS thread, depth::BIGINT AS depth
FROM m JOIN o USING (rid) LEFT JOIN f USING (rid) LEFT JOIN e ON e.c = m.c AND e.turn = m.turn LEFT JOIN r ON r.c = m.c AND r.turn = m.turn
"""
