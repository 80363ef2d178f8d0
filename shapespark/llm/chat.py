r"""Chat formatting of reply trees, in DataFrame functions only.

Messages name the message they reply to. Iterative self-joins double the distance to an ancestor in each round, so that the depth and the sum
of scores of every root-to-leaf path are known after as many rounds as the greatest depth has binary digits. The leaves of each tree are
ranked by the mean score of their path (then longer paths, then smaller ids first), and the best `branches` of them are formatted, one
conversation each. Chosen paths are enumerated by going down the same tables of ancestors from the farthest to the nearest; each message of a
path is met once.

A turn is written "### ROLE\nTEXT</turn>\n". In a text, "\" is written "\\", "###" is "\#\#\#" and "</turn>" is "<\/turn>", so markers
occur nowhere else and a backslash always stands before the character that it keeps. In a role "%", "#" and line feeds are percent-encoded. The loss
mask is the array of [start, end) spans, in code points, of the escaped texts of the trained roles.

Defined cases: a null text or role is an empty one; very long texts and deep trees are formatted whole; branches that tie in mean score and
length are taken by id; messages of a null tree are one tree; a message whose parent isn't there starts a tree of
its own path; rows that repeat a message id are one message, that of the smallest (parent, role, text); messages whose parents form a circle
have no root and are in no path; in conversations() turns that tie are ordered by role and text, and a null turn comes first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, table

TRAINED = ("assistant",)
END = "</turn>\n"


def escape(text: Column) -> Column:
    """Of a longer run of "#" the last ones are escaped, three at a time (hence the text is turned round), so that no three are left side by
    side."""
    slashed = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    marked = F.reverse(F.replace(F.reverse(slashed), F.lit("###"), F.lit("#\\#\\#\\")))
    return F.replace(marked, F.lit("</turn>"), F.lit(r"<\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("#"), F.lit("%23")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%23"), F.lit("#")), F.lit("%25"), F.lit("%"))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """From rows (tree, id, parent, score) with unique (tree, id), tree and id never null: rows (tree, leaf, id, place) of the chosen paths, where
    place is the distance from the leaf."""
    known = messages.select("tree", F.col("id").alias("parent"))
    replies = messages.filter("parent is not null")
    rooted = replies.join(known, ["tree", "parent"], "left_semi").select("tree", "id", F.col("parent").alias("up"), F.col("score").cast("double").alias("total"))
    roots = messages.join(rooted.select("tree", "id"), ["tree", "id"], "left_anti").select("tree", "id", F.lit(None).cast("long").alias("up"), F.col("score").cast("double").alias("total"))
    level = materialise(rooted.unionByName(roots).withColumn("depth", F.lit(1).cast("long")), "reply-level")
    most = level.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels = [level]
    while len(levels) <= int(most).bit_length() and level.filter("up is not null").limit(1).count():
        above = level.select("tree", F.col("id").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        done, going = level.filter("up is null"), level.filter("up is not null")
        doubled = going.join(above, ["tree", "up"]).select("tree", "id", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        level = materialise(doubled.unionByName(done), "reply-level")
        levels.append(level)
    parents = levels[0].filter("up is not null").select("tree", F.col("up").alias("id")).distinct()
    leaves = level.filter("up is null").join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches).select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("place"))
    for step in range(len(levels) - 2, -1, -1):
        chosen = materialise(chosen, "reply-paths")
        up = levels[step].filter("up is not null").select("tree", "id", "up")
        climbed = chosen.join(up, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("place") + (1 << step)).alias("place"))
        chosen = chosen.unionByName(climbed)
    return chosen


def conversations(paths: DataFrame, messages: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Rows (tree, leaf, formatted, loss) of the chosen paths; messages has tree, id, role and text."""
    turns = paths.join(messages.select("tree", "id", "role", "text"), ["tree", "id"])
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("tree", "leaf", F.struct((-F.col("place")).alias("place"), head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*trained).alias("trained")).alias("turn"))
    whole = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)).alias("at"),
        F.when(t["trained"], F.concat(acc["out"], F.array(F.struct((acc["at"] + F.char_length(t["head"])).alias("start"), (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"])).alias("end"))))).otherwise(acc["out"]).alias("out"),
    )
    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), step, lambda acc: acc["out"])
    return whole.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text) read from `formatted`, and trained, the texts under the mask."""
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        return F.struct(unescape_role(F.substring(piece, F.lit(5), at - 5)).alias("role"), unescape(F.substring(piece, at + 1, F.char_length(piece))).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "trained": masked})


def linear_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees without branches: each turn replies to the one before it."""
    clean = rows.select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("tree"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    placed = clean.withColumn("id", F.row_number().over(order).cast("long"))
    return placed.select("conv_id", "tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def tree_messages(rows: DataFrame) -> DataFrame:
    """Rows (tree_id, message_id, parent_id, role, text, score) made ready for reply_paths(): repeated ids are one message."""
    clean = rows.select(F.coalesce(F.concat(F.lit("="), F.col("tree_id").cast("string")), F.lit("")).alias("tree"), F.col("message_id").cast("long").alias("id"), F.struct(F.col("parent_id").cast("long").alias("parent"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")], F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).alias("m"))
    return clean.filter("id is not null").groupBy("tree", "id").agg(F.min("m").alias("m")).select("tree", "id", "m.*")


def format_trees(rows: DataFrame, branches: int = 1, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Rows (tree, leaf, formatted, loss) of the best branches of reply trees."""
    messages = materialise(tree_messages(rows), "messages")
    return conversations(reply_paths(messages, branches), messages, trained)


def chat_report(rows: DataFrame) -> DataFrame:
    """Format whole conversations, write them, and report what is read back."""
    messages = materialise(linear_messages(rows), "messages")
    written = materialise(conversations(reply_paths(messages), messages), "formatted")
    spelled = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    masked = F.array_join("trained", "")
    return parse(written).select(
        F.when(F.col("tree") != "", F.substring("tree", 2, 20).cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", spelled), ""), 256).alias("turns_sha256"), F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for n, role in enumerate(("user", "assistant"))])
    added = spark.range(1, numPartitions=1).select(F.explode(turns).alias("t")).select("t.*")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_report(rows.unionByName(added))
