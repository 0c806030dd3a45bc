"""Chat formatting of reply trees.

Messages name their parent; pointers to ancestors are doubled by self-joins (parent, grandparent, fourth, eighth ...) until all lead
out of their tree, and with each of them the known part of every leaf's path to its root doubles too. So a path of n messages
takes log2(n) rounds, and no round gathers a tree in one task. A pointer over more messages than the largest tree has leads into a cycle. Paths are ranked in their tree by the mean score of their
messages, and each chosen path is formatted as one conversation.

A turn is <|im_start|>role, a line break, the text, <|im_end|> and a line break. Inside roles and texts a backslash is doubled and
"<|" becomes "<\\|" ("\\n" stands for a line break in a role), so no text can hold a control string, and reading back is exact. Loss spans are the code points
of what assistants say, without the marks around it.

Defined results: null roles and texts are empty; a message whose parent is null or not in the tree is a root; messages that share an id in a tree
are told apart and each takes part, as a parent the least of them; a cycle of parents has no root, so that neither its messages nor those that lead into it are on any path;
null scores count as 0, ties in rank go to the path whose leaf comes first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(s: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(s: str, role: bool = False) -> str:
    """What escaped() was given. Doubled backslashes are found from the left, as they were made."""
    parts = [p.replace("<\\|", "<|") for p in s.split("\\\\")] if "\\" in s else [s]
    return "\\".join(p.replace("\\n", "\n") for p in parts) if role else "\\".join(parts)


def numbered(messages: DataFrame, tree: str, message: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    """The columns that matter, with a number for each row."""
    own = {"_tree": F.col(tree), "_id": F.col(message), "_parent": F.col(parent), "_role": F.coalesce(F.col(role), F.lit("")), "_text": F.coalesce(F.col(text), F.lit(""))}
    own["_score"] = F.coalesce(F.col(score), F.lit(0)).cast("double") if score else F.lit(0.0)
    return stored(messages.select(*(c.alias(k) for k, c in own.items()), F.monotonically_increasing_id().alias("_row")))


def leaf_paths(rows: DataFrame, keep: int | None = None) -> DataFrame:
    """(_tree, _leaf, _node, _up, _rank): for each chosen leaf, its ancestors and itself, _up steps above it, by their numbers in `rows`."""
    first = rows.filter("_id is not null").groupBy("_tree", "_id").agg(F.min("_row").alias("_to"))
    known = first.select(F.col("_tree").alias("_t"), F.col("_id").alias("_i"), "_to")
    up = stored(rows.join(known, F.col("_tree").eqNullSafe(F.col("_t")) & (F.col("_parent") == F.col("_i"))).select("_row", "_to").filter("_row <> _to"))
    parents = up.select(F.col("_to").alias("_row")).distinct()
    leaves = rows.join(parents, "_row", "left_anti")
    # One number, whatever the input.
    largest = rows.groupBy("_tree").count().agg(F.max("count")).first()[0] or 0
    levels = []
    while not up.isEmpty():
        if 1 << len(levels) >= largest:
            leaves = leaves.join(up.select("_row"), "_row", "left_anti")
            break
        levels.append(up)
        up = stored(up.alias("x").join(up.alias("y"), F.col("x._to") == F.col("y._row")).select("x._row", "y._to"))
    paths = stored(leaves.select(F.col("_row").alias("_leaf"), F.col("_row").alias("_node"), F.lit(0).cast("long").alias("_up")))
    for k, level in enumerate(levels):
        further = paths.join(level.withColumnRenamed("_row", "_node"), "_node").select("_leaf", F.col("_to").alias("_node"), (F.col("_up") + (1 << k)).alias("_up"))
        paths = stored(paths.unionByName(further))
    means = paths.join(rows.select(F.col("_row").alias("_node"), "_score"), "_node").groupBy("_leaf").agg(F.avg("_score").alias("_mean"))
    ranked = leaves.select(F.col("_row").alias("_leaf"), "_tree", "_id").join(means, "_leaf").withColumn("_rank", F.row_number().over(Window.partitionBy("_tree").orderBy(F.desc("_mean"), "_id", "_leaf")))
    if keep is not None:
        ranked = ranked.filter(F.col("_rank") <= keep)
    return paths.join(ranked.select("_leaf", "_tree", "_rank"), "_leaf")


def format_paths(messages: DataFrame, tree: str = "tree_id", message: str = "message_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = None, keep: int | None = 1, spoken: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, rank, formatted, loss_spans): a row for each of the `keep` best paths of each tree (all, if None).

    loss_spans holds start and end (code points, end excluded) of each turn of the roles in `spoken`.
    """
    rows = numbered(messages, tree, message, parent, role, text, score)
    said = rows.select("_row", "_role", escaped(F.col("_text")).alias("_text"))
    head = F.concat(F.lit(START), escaped(F.col("_role"), role=True), F.lit("\n"))
    said = said.select(F.col("_row").alias("_node"), F.concat(head, "_text", F.lit(END)).alias("_turn"), F.char_length(head).alias("_head"), F.char_length("_text").alias("_said"), F.col("_role").isin(*spoken).alias("_spoken"))
    chosen = leaf_paths(rows, keep).join(said, "_node")
    before = Window.partitionBy("_leaf").orderBy(F.desc("_up")).rowsBetween(Window.unboundedPreceding, -1)
    placed = chosen.withColumn("_from", F.coalesce(F.sum(F.char_length("_turn").cast("long")).over(before), F.lit(0)) + F.col("_head"))
    span = F.struct((-F.col("_up")).alias("at"), F.col("_from").alias("start"), (F.col("_from") + F.col("_said")).alias("end"))
    whole = placed.groupBy("_leaf").agg(
        F.first("_tree").alias(tree),
        F.first("_rank").alias("rank"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_up")).alias("at"), "_turn"))), lambda x: x["_turn"]), "").alias("formatted"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_spoken"), span))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )
    return whole.select(tree, "rank", "formatted", "loss_spans")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition("\n")
        out.append((unescaped(role, role=True), unescaped(text)))
    return out


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """What a conversation says, read back from its formatted text: turns and the text under the loss mask, as counts and hashes."""

    def run(batches: Iterator):
        import hashlib

        import pyarrow as pa

        for b in batches:
            keys, texts, spans = (b.column(i).to_pylist() for i in range(3))
            turns = [read_turns(t) for t in texts]
            loss = ["".join(unescaped(t[s["start"] : s["end"]]) for s in x) for t, x in zip(texts, spans, strict=True)]
            hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
            yield pa.RecordBatch.from_pydict(
                {
                    key: b.column(0),
                    "n_turns": pa.array(map(len, turns), pa.int64()),
                    "turns_sha256": [hexed("".join(f"{r}\n{t}\n" for r, t in x)) for x in turns],
                    "loss_chars": pa.array(map(len, loss), pa.int64()),
                    "loss_sha256": list(map(hexed, loss)),
                    "formatted_chars": pa.array(map(len, texts), pa.int64()),
                }
            )

    kind = formatted.schema[key].dataType.simpleString()
    return formatted.select(key, "formatted", "loss_spans").mapInArrow(run, f"{key} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
