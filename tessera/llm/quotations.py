"""Operator 3, chat formatting by quotation linking; DataFrame functions only.

A message's lines carry a quote level: the number of ``>`` marks they begin with (blanks
between marks allowed).  Lines in a row with one level form a passage; level 0 is the
message's own words.  A passage is normalised (marks gone, A-Z lower-cased, white space
collapsed) and hashed whole and line by line, so that partial quotes link too.  Quoted
hashes meet the own passages and lines of the conversation's messages; the latest
earlier message that holds one is the original, and the latest original of level 1 is
what the message replies to.  A message without a linked quote replies to the turn
before it.  A conversation's reply order sorts by the turn replied to, then by turn: it
puts every message after the one it answers and keeps the answers to a message together.

Only conversations with quotes are looked at, and quoted and held hashes meet in a window
over (conversation, hash) that streams and spills: no array or task holds a whole group.

Cases: null and empty texts are empty bodies; a quote that no earlier message holds links
to nothing; rows with one (conversation, turn) are separate messages of that turn, their
quotes count for each of them; null conversation ids form one conversation; a message
with a null turn comes first and is never linked; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER

_MARKS = r"^(?:[ \t]*>)+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _normal(line: Column) -> Column:
    bare = F.translate(F.regexp_replace(line, _MARKS, ""), UPPER, LOWER)
    return F.trim(F.regexp_replace(bare, r"[\s]+", " "))


def passages(text: Column) -> Column:
    """Array of (level, line) of a text, blank lines left out, in order."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    return F.filter(F.transform(lines, lambda x: F.struct(_level(x).alias("level"), _normal(x).alias("line"))), lambda x: x["line"] != "")


def own_words(text: Column) -> Column:
    """The text without its quoted lines, and without blank lines at its ends."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: ~F.regexp_like(x, F.lit(_MARKS)))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def _groups(lines: Column, quoted: bool) -> Column:
    """Passages as text: neighbouring lines of one level joined; own ones, or (level, passage) quoted ones."""
    start = F.array().cast("array<struct<level:int,passage:string>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x["level"].alias("level"), F.concat_ws("\n", last["passage"], x["line"]).alias("passage"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["level"] == x["level"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["level"].alias("level"), x["line"].alias("passage")))))

    found = F.aggregate(lines, start, add)
    return F.filter(found, lambda g: (g["level"] > 0) if quoted else (g["level"] == 0))


def _hashes(g: Column) -> Column:
    return F.array_union(F.array(F.xxhash64(g["passage"])), F.transform(F.split(g["passage"], "\n"), lambda x: F.xxhash64(x)))


def quotation_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, original): the turns of the earlier messages that a turn quotes."""
    m = messages.select("conv_id", "turn", passages(F.col("text")).alias("lines"))
    quoting = m.where(F.exists("lines", lambda x: x["level"] > 0))
    quoted = quoting.select("conv_id", "turn", F.explode(_groups(F.col("lines"), True)).alias("g")) \
        .select("conv_id", "turn", F.col("g.level").alias("level"), F.explode(_hashes(F.col("g"))).alias("hash"))
    chats = quoting.select(F.col("conv_id").alias("c")).distinct()
    held = m.join(chats, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "turn", F.explode(_groups(F.col("lines"), False)).alias("g")) \
        .select("conv_id", "turn", F.lit(0).alias("level"), F.explode(_hashes(F.col("g"))).alias("hash"))
    both = quoted.unionByName(held).where("turn is not null").distinct()
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("original", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier))
    return found.where("level > 0 and original is not null").select("conv_id", "turn", "level", "original").distinct()


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_quoted (turns quoted), reply_to, place (from 0, in reply order), body."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    links = quotation_links(m).groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")) \
        .agg(F.countDistinct("original").alias("n_quoted"), F.max(F.when(F.col("level") == 1, F.col("original"))).alias("quoted"))
    m = m.select("conv_id", "turn", "role", own_words(F.col("text")).alias("body")) \
        .join(links, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
    chat = Window.partitionBy("conv_id")
    before = F.max("turn").over(chat.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    m = m.select("conv_id", "turn", "role", F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("quoted", before).alias("reply_to"), "body")
    order = chat.orderBy(F.col("reply_to").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "body")
    return m.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select("conv_id", "turn", "role", "n_quoted", "reply_to", "place", "body")


def chat_format(messages: DataFrame, begin: str = "<|", end: str = "|>") -> DataFrame:
    """conv_id, place, formatted: one formatted turn a row, in reply order, without quotes."""
    turn = F.concat(F.lit(begin), F.coalesce("role", F.lit("unknown")), F.lit(end + "\n"), "body")
    return reply_order(messages).select("conv_id", "place", turn.alias("formatted"))
