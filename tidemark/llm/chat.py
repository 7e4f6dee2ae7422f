"""Reply trees to formatted conversations, in DataFrame operations only.

Messages form trees: each has a parent in its tree or is a root. Paths are enumerated by iterative self-joins that
double their reach: level k holds, for every message, its ancestor 2^k steps up with the sum of scores on the way, so
a chain of 400 turns takes nine joins. A path is the way from a root to a leaf; the branches of a tree are ranked by
the sum of their scores (longer first on ties, then the smaller leaf), the best ``branches`` stay, and the messages of
each chosen path are listed by going back down the levels, which meets every ancestor exactly once.

The template is ``<|turn|>role\\ntext\\n<|end|>\\n`` per turn. Control strings (its own and those of other common
templates) inside a text get a ``~`` in front, after any number of ``~`` already there, so that removing one ``~``
undoes it; roles escape ``%``, line ends and ``<``. The loss mask lists the code-point range of each assistant text.

Defined results: null text and null role count as empty; a null tree is a tree like others; a parent that does not
exist makes a root; rows of one turn are ordered by role and text when ``chain`` builds the tree; of messages that
repeat an id in a tree the first by parent, role, text and score counts; messages on a circle of parents have no root
and are left out; equal scores rank the longer branch first, then the smaller leaf; very long conversations are one
row; other columns are ignored, whatever their names; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_path

#: Control strings of this template and of other public chat templates; fixed values.
CONTROLS = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_ANY = "(" + "|".join("".join("\\" + c if c in "|[]" else c for c in x) for x in CONTROLS) + ")"
_TURN = "(?s)<\\|turn\\|>([^\\n]*)\\n(.*?)\\n<\\|end\\|>\\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"(~*){_ANY}", "~$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"~(~*){_ANY}", "$1$2")


def _role(role: Column) -> Column:
    for mark, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(mark), F.lit(code))
    return role


def _unrole(role: Column) -> Column:
    for mark, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(mark))
    return role


def chain(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of linear conversations: each turn answers the one before it."""
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    flat = rows.select(F.col(f"`{tree}`").alias("tree"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    flat = flat.withColumn("id", F.row_number().over(order).cast("long"))
    return flat.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def messages_of(rows: DataFrame, distinct: bool) -> DataFrame:
    """(tree, id, parent, role, text, score) of messages with trees as never-null structs, one row per id."""
    m = rows.select(F.struct("tree").alias("tree"), "id", "parent", "role", "text", "score")
    if distinct:
        return m
    first = F.row_number().over(W.partitionBy("tree", "id").orderBy("parent", "role", "text", "score"))
    return m.withColumn("__n", first).where("__n = 1").drop("__n")


def paths(messages: DataFrame, branches: int = 1, distinct: bool = False) -> DataFrame:
    """(tree, leaf, branch, id, depth): the messages of the best ``branches`` root-to-leaf paths of every tree.

    ``distinct``: ids are known not to repeat within a tree.
    """
    return _paths(messages_of(messages, distinct), branches).withColumn("tree", F.col("tree.tree"))


def _paths(messages: DataFrame, branches: int) -> DataFrame:
    """``paths`` of messages whose ``tree`` is never null: a struct of it equals itself in joins, with a null inside too."""
    nodes = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    nodes = nodes.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("steps"))
    # score and steps cover the message itself and all ancestors below ``up``.
    levels = [cut(nodes)]
    # No chain is longer than the messages with a parent; what waits beyond that has a circle above it.
    most = levels[0].where("up is not null").count()
    while 2 ** (len(levels) - 1) <= most and not levels[-1].where("up is not null").isEmpty():
        # Only messages that have not reached their root go on; the others are carried over as they are.
        low, high = levels[-1].where("up is not null").alias("a"), levels[-1].alias("b")
        both = low.join(high, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.id")))
        longer = both.select("a.tree", "a.id", F.col("b.up").alias("up"), (F.col("a.score") + F.col("b.score")).alias("score"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        levels.append(cut(longer.unionByName(levels[-1].where("up is null"))))
    whole = levels[-1].where("up is null")
    inner = levels[0].where("up is not null").select("tree", F.col("up").alias("id")).distinct()
    leaves = whole.join(inner, ["tree", "id"], "left_anti")
    rank = W.partitionBy("tree").orderBy(F.desc("score"), F.desc("steps"), "id")
    best = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    found = best.select("tree", F.col("id").alias("leaf"), "branch", "id", F.col("steps").alias("depth"))
    for k in range(len(levels) - 2, -1, -1):
        jump = levels[k].where("up is not null").select("tree", "id", "up")
        found = found.unionByName(found.join(jump, ["tree", "id"]).select("tree", "leaf", "branch", F.col("up").alias("id"), (F.col("depth") - 2**k).alias("depth")))
        if k % 4 == 0:
            found = cut(found)
    return found


def format_paths(messages: DataFrame, branches: int = 1, learn: str = "assistant", distinct: bool = False) -> DataFrame:
    """(tree, leaf, branch, formatted, mask): one conversation per chosen path.

    ``mask`` is an array of (start, end) code-point ranges of ``formatted``, one per text of role ``learn``.
    """
    messages = messages_of(messages, distinct)
    said = messages.select("tree", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _paths(messages, branches).join(said, ["tree", "id"])
    head = F.concat(F.lit("<|turn|>"), _role(F.col("role")), F.lit("\n"))
    turns = rows.select("tree", "leaf", "branch", "depth", head.alias("head"), escape(F.col("text")).alias("body"), F.when(F.col("role") == learn, True).otherwise(False).alias("learn"))
    turns = turns.withColumn("long", F.length("head") + F.length("body") + F.length(F.lit("\n<|end|>\n")))
    path = W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("long").over(path), F.lit(0)) + F.length("head"))
    piece = F.struct("depth", F.concat("head", "body", F.lit("\n<|end|>\n")).alias("piece"), F.when(F.col("learn"), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.length("body")).cast("long").alias("end"))).alias("range"))
    one = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return one.select("tree.tree", "leaf", "branch", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), F.filter(F.transform("pieces", lambda p: p["range"]), lambda r: r.isNotNull()).alias("mask"))


def write_formatted(formatted: DataFrame, path: str) -> DataFrame:
    """Writes the conversations to ``path`` and returns what is read back from there."""
    formatted.write.mode("overwrite").parquet(path)
    return formatted.sparkSession.read.parquet(path)


def parse(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role and text, unescaped) and ``learned`` (texts under the mask, unescaped)."""
    roles = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(_unrole(r).alias("role"), unescape(t).alias("text")))
    learned = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("learned", learned)


def chat_report(spark: SparkSession, conversations: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the written output."""
    back = parse(write_formatted(format_paths(cut(chain(conversations)), distinct=True), path or shared_path(spark, "chat")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "utf-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
