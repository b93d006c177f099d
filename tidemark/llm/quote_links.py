"""Reply structure of conversations from quoted passages.

Lines are parsed into quote levels by their marks (">"), nested as often as they are.
Consecutive lines of one level make paragraphs; each quoted paragraph is hashed in
normalised form and joined to the latest earlier message of the conversation that has it
as its own words. A quoted paragraph that equals none is looked up by its lines and
sentences of ten characters or more, so trimmed quotes and those cut by replies between
the lines count too. A passage weighs its characters over the number of turns that say
it, so that thanks and greetings tell little; the message of most weight, at the lowest
level that leads anywhere, is the one replied to. Threads follow from the replies by
pointer jumping, and messages come out in order of threads without their quotes.

The main path has built-in functions only. The latest earlier message is a running value
over the different turns of a passage, in slices where a passage has more of them than a
task should hold, so no conversation and no passage has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.operators.ordered import Running, running

MARKS = r"^(?:[ \t]*>)+"
#: Lines that announce a quote, if one follows.
ANNOUNCE = r"(?i)^(on|am|le|el) .{1,300}(wrote|schrieb|écrit|escribió)[ \t]?:[ \t\r]*$"

#: Lines and sentences below this length link nothing by themselves.
MIN_PIECE = 10


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\f\x0B]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, msg_key, own (the message's own lines), paragraphs (level, lines), level 0 being its own."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    marked = messages.select("conv_id", "turn", "role", "msg_key", lines.alias("lines")).select(
        "*",
        F.transform("lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", ""))).alias("levels"),
        F.transform("lines", lambda x: plain(F.regexp_replace(x, MARKS, ""))).alias("bodies"),
    )
    next_level = lambda i: F.coalesce(F.get("levels", i + 1), F.lit(0))
    # -1: announces a quote, -2: blank
    kind = lambda x, i: (
        F.when(F.get("bodies", i) == "", F.lit(-2)).when((F.get("levels", i) == 0) & (next_level(i) > 0) & x.rlike(ANNOUNCE), F.lit(-1)).otherwise(F.get("levels", i))
    )
    kinds = marked.withColumn("kinds", F.transform("lines", kind))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    starts = kinds.withColumn("starts", F.filter(every, lambda i: (i == 0) | (F.get("kinds", i) != F.get("kinds", i - 1))))
    paragraph = lambda s, j: F.struct(
        F.get("kinds", s).alias("level"), F.slice("bodies", s + 1, F.coalesce(F.get("starts", j + 1), F.size("lines")) - s).alias("lines")
    )
    own = F.array_join(F.transform(F.filter(every, lambda i: (F.get("levels", i) == 0) & (F.get("kinds", i) != -1)), lambda i: F.get("lines", i)), "\n")
    return starts.select(
        "conv_id", "turn", "role", "msg_key", F.regexp_replace(F.regexp_replace(own, r"^([ \t\r]*\n)+", ""), r"[ \t\r\n]+$", "").alias("own"),
        F.filter(F.transform("starts", paragraph), lambda x: x["level"] >= 0).alias("paragraphs"),
    )


def keyed(messages: DataFrame) -> DataFrame:
    told = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in ("conv_id", "turn", "role", "text")]
    return messages.select("conv_id", "turn", "role", "text", F.md5(F.concat_ws(":", *told)).alias("msg_key"))


def spot(passage: Column) -> Column:
    """A passage within its conversation, as one digest that is never null."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-")), F.lit("\n"), passage)))


def weight(size: Column) -> Column:
    return F.floor(size * 1000 / F.col("n_turns"))


def nearest(own: DataFrame, asked: DataFrame) -> DataFrame:
    """For each different (spot, turn) of ``asked`` the latest earlier turn in ``own`` (spot, turn), if there is one, as quoted_turn, and n_turns, how many turns of ``own`` have the spot."""
    said = own.join(asked.select("spot").distinct(), "spot", "left_semi").distinct()
    at = lambda mine: (F.col("turn").cast("decimal(20,0)") * 2 + mine).alias("at")
    steps = stored(said.select("spot", "turn", F.lit(True).alias("mine"), at(1)).unionByName(asked.distinct().select("spot", "turn", F.lit(False).alias("mine"), at(0))))
    before = running(steps, ["spot"], "at", {"quoted_turn": Running("last", F.when(F.col("mine"), F.col("turn")))}).where("NOT mine AND quoted_turn IS NOT NULL")
    spread = steps.where("mine").groupBy("spot").agg(F.count("*").alias("n_turns"))
    return before.select("spot", "turn", "quoted_turn").join(spread, "spot")


def quote_links(parts: DataFrame) -> DataFrame:
    """(msg_key, conv_id, turn, level, quoted_turn, weight, n_passages): what each message quotes of which earlier message, per level."""
    text = F.array_join("p.lines", " ")
    each = parts.select("conv_id", "turn", "msg_key", F.explode("paragraphs").alias("p")).where("turn IS NOT NULL").select(
        "conv_id", "turn", "msg_key", "p.level", spot(text).alias("spot"), F.length(text).alias("size"), "p.lines"
    )
    own = each.where("level = 0")
    quotes = stored(each.where("level > 0").groupBy("msg_key", "conv_id", "turn", "level", "spot").agg(F.max("size").alias("size"), F.min("lines").alias("lines")))
    met = stored(quotes.join(nearest(own.select("spot", "turn"), quotes.select("spot", "turn")), ["spot", "turn"], "left"))
    columns = ["msg_key", "conv_id", "turn", "level", "quoted_turn"]
    found = met.where("quoted_turn IS NOT NULL").select(*columns, weight(F.col("size")).alias("weight"), F.lit(1).alias("passages"))
    rest = met.where("quoted_turn IS NULL").drop("quoted_turn", "n_turns")
    if not rest.isEmpty():
        found = found.unionByName(piece_links(own, rest).select(*columns, "weight", "passages"))
    return found.groupBy(*columns).agg(F.sum("weight").alias("weight"), F.sum("passages").alias("n_passages"))


def pieces(lines: Column) -> Column:
    """The different lines (kind 0) and the different sentences (kind 1) of a paragraph."""
    sentences = F.split(F.array_join(lines, " "), r"(?<=[.!?]) +")
    made = [F.transform(F.array_distinct(x), lambda y, k=kind: F.struct(F.lit(k).alias("kind"), y.alias("piece"))) for kind, x in enumerate((lines, sentences))]
    return F.filter(F.concat(*made), lambda x: F.length(x["piece"]) >= MIN_PIECE)


def piece_links(own: DataFrame, rest: DataFrame) -> DataFrame:
    """``rest``'s paragraphs by their lines or sentences, whichever tell more, in ``own`` ones: (..., quoted_turn, weight, passages), the last 0 as no whole paragraph is met."""
    near = rest.select(F.col("conv_id").alias("c")).distinct()
    split = own.join(near, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "turn", F.explode(pieces(F.col("lines"))).alias("x"))
    paragraph = ["msg_key", "conv_id", "turn", "level", "whole"]
    asked = rest.withColumnRenamed("spot", "whole").select(*paragraph, F.explode(pieces(F.col("lines"))).alias("x"))
    asked = stored(asked.select(*paragraph, "x.kind", spot(F.col("x.piece")).alias("spot"), F.length("x.piece").alias("size")))
    met = asked.join(nearest(split.select(spot(F.col("x.piece")).alias("spot"), "turn"), asked.select("spot", "turn")), ["spot", "turn"])
    told = met.groupBy(*paragraph, "quoted_turn", "kind").agg(F.sum(weight(F.col("size"))).alias("weight"))
    return told.groupBy(*paragraph, "quoted_turn").agg(F.max("weight").alias("weight")).withColumn("passages", F.lit(0))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) from replies (conv_id, turn, parent_turn): the first message of the thread, and how many replies lie between.

    A turn with several rows follows its smallest parent. Parents come before their
    replies, so there are no circles; rounds grow with the logarithm of the depth.
    """
    now = stored(replies.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("thread")).withColumn("depth", F.lit(1).cast("long")))
    while True:
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        joined = now.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("thread") == F.col("t")), "left")
        moved = stored(joined.select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def linked(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, with what it replies to, in reply order.

    Returns conv_id, turn, role, parent_turn (null if it quotes nothing known), thread
    (turn of the thread's first message), depth, n_quotes (quoted paragraphs), n_linked
    (those found whole in earlier messages; parents follow from parts too), text (own words) and chat (role and own words in
    one string); rows are sorted by conversation, thread and turn, so every reply stands
    after what it answers and threads are not mixed.

    A null text is empty. A message without turn can quote, but not be quoted, and is
    its own thread; so are those of null conversations only if they quote nothing, as a
    null conv_id is one conversation. Repeated rows all stay. Where several messages have
    equal weight the later one is the parent. An empty table gives an empty result.
    """
    whole = keyed(messages)
    parts = stored(parsed(whole))
    links = stored(quote_links(parts))
    best = F.max(F.struct(-F.col("level"), "weight", "quoted_turn"))["quoted_turn"]
    replies = stored(links.groupBy("msg_key", "conv_id", "turn").agg(best.alias("parent_turn"), F.sum("n_passages").alias("n_linked")))
    roots = threads(replies).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("top"), F.col("depth").alias("deep"))
    placed = replies.join(roots, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))).select("msg_key", "parent_turn", "n_linked", "top", "deep")
    every = parts.join(placed, "msg_key", "left")
    quoted = F.size(F.filter("paragraphs", lambda x: x["level"] > 0))
    return every.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("top", "turn").alias("thread"), F.coalesce("deep", F.lit(0)).cast("long").alias("depth"),
        quoted.cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("own").alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own"), F.lit("\n")).alias("chat"),
    )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """``linked`` in order of conversation, thread and turn."""
    return stored(linked(messages)).orderBy("conv_id", "thread", "turn", "role", "text")


LINK_SQL = r"""
WITH RECURSIVE message AS (
  SELECT DISTINCT conv_id, turn, role, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations
), line AS (
  SELECT conv_id, turn, role, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM message
), leveled AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[ \t\r\f\x0B]+', ' ', 'g')) AS body
  FROM line
), kinds AS (
  SELECT *, CASE WHEN body = '' THEN -2
                 WHEN level = 0 AND lead(level, 1, 0) OVER w > 0 AND regexp_matches(line, '(?i)^(on|am|le|el) .{1,300}(wrote|schrieb|écrit|escribió)[ \t]?:[ \t\r]*$') THEN -1
                 ELSE level END AS kind
  FROM leveled WINDOW w AS (PARTITION BY conv_id, turn, role, text ORDER BY i)
), runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn, role, text ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY conv_id, turn, role, text ORDER BY i) THEN 1 ELSE 0 END AS opens FROM kinds)
), paragraph AS (
  SELECT conv_id, turn, role, text, kind AS level, string_agg(body, ' ' ORDER BY i) AS body, list(body ORDER BY i) AS lines FROM runs WHERE kind >= 0 GROUP BY conv_id, turn, role, text, run, kind
), own AS (
  SELECT conv_id, turn, role, text,
         regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND kind <> -1), ''), '^([ \t\r]*\n)+', ''), '[ \t\r\n]+$', '') AS own
  FROM kinds GROUP BY conv_id, turn, role, text
), quote AS (
  SELECT conv_id, turn, role, text, level, body, min(lines) AS lines FROM paragraph WHERE level > 0 AND turn IS NOT NULL GROUP BY ALL
), said AS (
  SELECT DISTINCT conv_id, turn, body, lines FROM paragraph WHERE level = 0 AND turn IS NOT NULL
), spread AS (
  SELECT conv_id, body, count(DISTINCT turn) AS n_turns FROM said GROUP BY ALL
), found AS (
  SELECT q.conv_id, q.turn, q.role, q.text, q.level, q.body, max(s.turn) AS quoted_turn
  FROM quote q JOIN said s ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.body = s.body AND s.turn < q.turn GROUP BY ALL
), rest AS (
  SELECT q.* FROM quote q WHERE NOT EXISTS (SELECT 1 FROM said s WHERE q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.body = s.body AND s.turn < q.turn)
), asked AS (
  SELECT DISTINCT conv_id, turn, role, text, level, body, kind, piece FROM (
    SELECT * EXCLUDE (lines), 0 AS kind, unnest(lines) AS piece FROM rest
    UNION ALL SELECT * EXCLUDE (lines), 1, unnest(string_split(regexp_replace(body, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))) FROM rest)
  WHERE len(piece) >= 10
), told AS (
  SELECT DISTINCT conv_id, turn, piece FROM (
    SELECT conv_id, turn, unnest(lines) AS piece FROM said
    UNION ALL SELECT conv_id, turn, unnest(string_split(regexp_replace(body, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))) FROM said)
  WHERE len(piece) >= 10
), piece_spread AS (
  SELECT conv_id, piece, count(*) AS n_turns FROM told GROUP BY ALL
), piece_found AS (
  SELECT a.*, max(t.turn) AS quoted_turn FROM asked a JOIN told t ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.piece = t.piece AND t.turn < a.turn GROUP BY ALL
), piece_kind AS (
  SELECT f.conv_id, f.turn, role, text, level, body, kind, quoted_turn, sum(len(f.piece) * 1000 // n_turns) AS weight
  FROM piece_found f JOIN piece_spread s ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.piece = s.piece GROUP BY ALL
), met AS (
  SELECT conv_id, turn, role, text, level, quoted_turn, sum(weight) AS weight, sum(n) AS n FROM (
    SELECT f.conv_id, f.turn, role, text, level, quoted_turn, len(f.body) * 1000 // n_turns AS weight, 1 AS n
    FROM found f JOIN spread s ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.body = s.body
    UNION ALL SELECT conv_id, turn, role, text, level, quoted_turn, max(weight), 0 FROM piece_kind GROUP BY conv_id, turn, role, text, level, body, quoted_turn)
  GROUP BY ALL
), replies AS (
  SELECT conv_id, turn, role, text, sum(n) AS n_linked, (max({'a': -level, 'b': weight, 'c': quoted_turn})).c AS parent_turn FROM met GROUP BY ALL
), links AS (
  SELECT conv_id, turn, min(parent_turn) AS parent FROM replies GROUP BY conv_id, turn
), climb(conv_id, turn, top, depth) AS (
  SELECT conv_id, turn, parent, 1 FROM links
  UNION ALL
  SELECT c.conv_id, c.turn, l.parent, c.depth + 1 FROM climb c JOIN links l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.top = l.turn
), tops AS (
  SELECT conv_id, turn, arg_max(top, depth) AS top, max(depth) AS depth FROM climb GROUP BY conv_id, turn
), quoted AS (
  SELECT conv_id, turn, role, text, count(*) FILTER (WHERE level > 0) AS n_quotes FROM paragraph GROUP BY conv_id, turn, role, text
)
SELECT m.conv_id, m.turn, m.role, r.parent_turn, coalesce(t.top, m.turn) AS thread, coalesce(CASE WHEN r.parent_turn IS NOT NULL THEN t.depth END, 0)::BIGINT AS depth,
       coalesce(q.n_quotes, 0)::BIGINT AS n_quotes, coalesce(r.n_linked, 0)::BIGINT AS n_linked, o.own AS text,
       '<|' || coalesce(m.role, '') || '|>' || chr(10) || o.own || chr(10) AS chat
FROM conversations m
JOIN own o ON m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.turn IS NOT DISTINCT FROM o.turn AND m.role IS NOT DISTINCT FROM o.role AND m.text IS NOT DISTINCT FROM o.text
LEFT JOIN replies r ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.turn IS NOT DISTINCT FROM r.turn AND m.role IS NOT DISTINCT FROM r.role AND m.text IS NOT DISTINCT FROM r.text
LEFT JOIN tops t ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.turn = t.turn
LEFT JOIN quoted q ON m.conv_id IS NOT DISTINCT FROM q.conv_id AND m.turn IS NOT DISTINCT FROM q.turn AND m.role IS NOT DISTINCT FROM q.role AND m.text IS NOT DISTINCT FROM q.text
"""
