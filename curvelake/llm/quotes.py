"""Quotation linking of chat messages in Spark SQL.

A line is quoted at the level of its leading '>' marks. Consecutive lines of one level are a passage. Passages, and
their single lines, are normalised and hashed; each message is indexed under the hashes of what it says
itself. A quote links to the latest earlier message of its conversation with an equal hash. The message it
answers is the one that most of its lowest-level quotes link to (ties: the latest); without a linked quote
it answers the message before it. Conversations are ordered by replies: each message is followed by all
answers to it, in order of turn. Quoted lines are gone from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.llm.common import shared

MARKS = r"^[\x20\t]*(?:>[\x20\t]*)+"
TURN_CELL = 4096
KEY = ["conv_id", "turn", "copy"]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """conv_id, turn, copy, pos, level, content: one row per line of each message."""
    lines = messages.select(*KEY, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    return lines.select(*KEY, "pos", F.regexp_count(marks, F.lit(">")).alias("level"), F.regexp_replace("line", MARKS, "").alias("content"))


def passages(lines: DataFrame) -> DataFrame:
    """conv_id, turn, copy, level, first, hash: whole passages and their single lines; blank lines end a passage of level 0.

    Windows run inside one message.
    """
    message = Window.partitionBy(*KEY).orderBy("pos")
    lines = lines.withColumn("said", normalised(F.col("content")))
    blank = F.col("said") == ""
    starts = (F.lag("level").over(message).isNull() | (F.lag("level").over(message) != F.col("level")) | (blank & (F.col("level") == 0))).cast("int")
    lines = lines.withColumn("run", F.sum(starts).over(message)).filter(~blank)
    whole = lines.groupBy(*KEY, "run").agg(
        F.first("level").alias("level"), F.min("pos").alias("first"), F.count("*").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ").alias("said"),
    )
    single = lines.select(*KEY, "level", F.col("pos").alias("first"), F.lit(1).cast("long").alias("n"), "said")
    return single.unionByName(whole.filter("n > 1").select(*KEY, "level", "first", "n", "said")).select(*KEY, "level", "first", "n", F.md5("said").alias("hash"))


def latest_before(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """Quotes with `source`, the latest earlier turn of the conversation that says the same.

    An as-of lookup in two steps, so that a phrase of very many turns is no single task: inside cells of turns,
    and from the last turn of each cell on.
    """
    cell = F.floor(F.col("turn") / TURN_CELL).alias("cell")
    said = said.groupBy("conv_id", "hash", "turn").agg(F.lit(1).alias("own")).select("conv_id", "hash", "turn", cell)
    marks = said.select("conv_id", "hash", "cell", "turn", F.col("turn").alias("own"), F.lit(None).cast("struct<copy:int,level:int,first:int,n:bigint>").alias("quote"))
    asks = quotes.select("conv_id", "hash", cell, "turn", F.lit(None).cast("bigint").alias("own"), F.struct("copy", "level", "first", "n").alias("quote"))
    inside = Window.partitionBy("conv_id", "hash", "cell").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = marks.unionByName(asks).withColumn("source", F.max("own").over(inside)).filter("quote IS NOT NULL")
    lasts = said.groupBy("conv_id", "hash", "cell").agg(F.max("turn").alias("last"))
    wanted = quotes.select("conv_id", "hash", cell).distinct().select("*", F.lit(None).cast("bigint").alias("last"), F.lit(True).alias("ask"))
    before = Window.partitionBy("conv_id", "hash").orderBy("cell").rangeBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("ask", F.lit(False)).unionByName(wanted).withColumn("carry", F.max("last").over(before)).filter("ask").drop("last", "ask")
    return both.join(carried, ["conv_id", "hash", "cell"], "left").select(
        "conv_id", "turn", "quote.*", F.coalesce("source", "carry").alias("source")
    )


def previous_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, before: the next lower turn, again by cells and from the last turn of the cells before."""
    turns = messages.select("conv_id", "turn").distinct().withColumn("cell", F.floor(F.col("turn") / TURN_CELL))
    inside = Window.partitionBy("conv_id", "cell").orderBy("turn")
    lasts = turns.groupBy("conv_id", "cell").agg(F.max("turn").alias("last"))
    carry = lasts.select("conv_id", "cell", F.lag("last").over(Window.partitionBy("conv_id").orderBy("cell")).alias("carry"))
    return turns.withColumn("near", F.lag("turn").over(inside)).join(carry, ["conv_id", "cell"]).select("conv_id", "turn", F.coalesce("near", "carry").alias("before"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, copy, role, text (without quotes), n_quotes, n_linked, reply_to, depth, path for every row of `messages`.

    n_quotes counts quoted passages (runs of lines of one level), n_linked those with a source. reply_to is the turn answered, null for a first
    message. Sorting a conversation by path puts each message before its answers; depth counts the quoted branches
    above it. Null texts are empty; messages of a null conv_id or turn stand alone (reply_to null). Repeated
    (conv_id, turn) rows are told apart by `copy`, from 0 in order of role and text. A quote of a later message, of
    itself, or of nothing known links to nothing. An empty table gives an empty one.
    """
    every = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    copies = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    known = shared(every.filter(whole).withColumn("copy", F.row_number().over(copies) - 1))
    quoting = known.filter(F.col("text").rlike("(?m)" + MARKS))
    quoted = passages(lines_of(quoting)).filter("level > 0")
    # Only conversations that quote at all need an index of what is said in them.
    said = passages(lines_of(known.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi"))).filter("level = 0")
    found = shared(latest_before(quoted, said.select("conv_id", "turn", "hash")))
    counted = found.groupBy(*KEY, "level", "first").agg(F.max("n").alias("n"), F.max("source").alias("source"))
    runs = lines_of(quoting).filter("level > 0").withColumn("gap", F.col("pos") - F.row_number().over(Window.partitionBy(*KEY, "level").orderBy("pos")))
    n_quotes = runs.groupBy(*KEY, "level", "gap").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    linked = n_quotes.join(counted, [*KEY, "level"], "left").filter("first IS NULL OR first BETWEEN start AND end")
    linked = linked.groupBy(*KEY, "level", "gap").agg(F.max("source").isNotNull().cast("int").alias("hit"))
    totals = linked.groupBy(*KEY).agg(F.count("*").alias("n_quotes"), F.sum("hit").alias("n_linked"))
    votes = found.filter("source IS NOT NULL").groupBy(*KEY, "level", "source").agg(F.sum("n").alias("votes"))
    answers = votes.groupBy(*KEY).agg(F.max_by("source", F.struct(-F.col("level"), F.col("votes"), F.col("source"))).alias("answers"))

    linked = known.join(previous_turns(known), ["conv_id", "turn"]).join(answers, KEY, "left").join(totals, KEY, "left")
    branch = F.col("answers").isNotNull() & ~F.col("answers").eqNullSafe(F.col("before"))
    linked = shared(linked.withColumn("branch", branch))
    placed = _ordered(linked)
    own_lines = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(MARKS))
    plain = F.when(F.col("text").rlike("(?m)" + MARKS), F.trim(F.array_join(own_lines, "\n"))).otherwise(F.col("text"))
    columns = [plain.alias("text"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")]
    out = placed.select("conv_id", "turn", "copy", "role", *columns, F.coalesce("answers", "before").alias("reply_to"), "depth", "path")
    alone = every.filter(~whole).select(
        "conv_id", "turn", F.lit(0).alias("copy"), "role", plain.alias("text"), F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"),
        F.lit(None).cast("long").alias("reply_to"), F.lit(0).alias("depth"), F.array(F.lit(0).cast("long"), F.coalesce("turn", F.lit(0))).alias("path"),
    )
    return out.unionByName(alone)


def _ordered(linked: DataFrame) -> DataFrame:
    """depth and path: sorted by path, a message comes before its answers and they in order of turn.

    A stretch of messages that each answer the one before is one segment; it hangs on the message that its head
    answers. Along a segment the messages come in order of turn, then the branches that leave it, the latest
    departure first: inner answers precede outer ones. So a path holds (1, -departure, head) for each branch taken and ends in (0, turn, copy).
    The loop runs once for each level of branches inside branches.
    """
    heads = linked.filter("branch").select("conv_id", F.col("turn").alias("head"), F.min("answers").over(Window.partitionBy("conv_id", "turn")).alias("leaves")).distinct()
    cells = linked.select("conv_id", "turn", F.floor(F.col("turn") / TURN_CELL).alias("cell"), F.when(F.col("branch"), F.col("turn")).alias("head"))
    inside = Window.partitionBy("conv_id", "cell").orderBy("turn")
    lasts = cells.groupBy("conv_id", "cell").agg(F.max("head").alias("last"))
    carry = lasts.select("conv_id", "cell", F.max("last").over(Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    segment = cells.groupBy("conv_id", "cell", "turn").agg(F.max("head").alias("head")).withColumn("near", F.max("head").over(inside))
    segment = segment.join(carry, ["conv_id", "cell"]).select("conv_id", "turn", F.coalesce("near", "carry").alias("segment"))
    heads = heads.join(segment.withColumnRenamed("turn", "leaves").withColumnRenamed("segment", "under"), ["conv_id", "leaves"])
    step = F.array(F.lit(1).cast("long"), -F.col("leaves"), F.col("head"))
    heads = shared(heads.select("conv_id", "head", "under", step.alias("step")))
    level = heads.filter("under IS NULL").select("conv_id", F.col("head").alias("segment"), F.lit(1).alias("depth"), F.col("step").alias("prefix"))
    prefixes = level
    while not level.isEmpty():
        above = level.select("conv_id", F.col("segment").alias("under"), "depth", "prefix")
        level = shared(heads.join(above, ["conv_id", "under"]).select("conv_id", F.col("head").alias("segment"), (F.col("depth") + 1).alias("depth"), F.concat("prefix", "step").alias("prefix")))
        prefixes = prefixes.unionByName(level)
    rows = linked.join(segment, ["conv_id", "turn"]).join(prefixes, ["conv_id", "segment"], "left")
    end = F.array(F.lit(0).cast("long"), F.col("turn"), F.col("copy").cast("long"))
    return rows.withColumns({"depth": F.coalesce("depth", F.lit(0)), "path": F.concat(F.coalesce("prefix", F.array().cast("array<bigint>")), end)})
