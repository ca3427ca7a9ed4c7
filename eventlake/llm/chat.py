"""Chat formatting with cumulative-snapshot collapse (operator 8). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import ranked, select_only, settings, stored

# Turns whose prefix hash is summed in one task; turns in one rendered part.
BLOCK, PART = 4096, 1000


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Rolling hashes of a stored table (conv, position, role, text): p1, p2 cover all turns up to this one.

    A turn's hash covers its position, so the exclusive-or of the turns so far stands for their
    sequence. Blocks of `BLOCK` turns are rolled on their own and shifted by the blocks before, so a
    conversation may hold any share of the rows.
    """
    hashed = turns.withColumns(
        {f"h{i}": F.xxhash64(F.lit(i), "position", "role", "text") for i in (1, 2)}
        | {"block": F.floor(F.col("position") / BLOCK)}
    )
    blocks = hashed.groupBy("conv", "block").agg(*[F.bit_xor(f"h{i}").alias(f"b{i}") for i in (1, 2)])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = blocks.select(
        "conv", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"e{i}") for i in (1, 2)]
    ).where("block > 0")
    inside = Window.partitionBy("conv", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({f"r{i}": F.bit_xor(f"h{i}").over(inside) for i in (1, 2)})
    return rolled.join(earlier, ["conv", "block"], "left").select(
        "conv", "position", *[F.col(f"r{i}").bitwiseXOR(F.coalesce(f"e{i}", F.lit(0))).alias(f"p{i}") for i in (1, 2)]
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Conversations (conv, n) that no longer one starts with; of equal ones the smallest id."""
    rolled = prefix_hashes(turns)
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.first("conv_id").alias("conv_id"))
    rolled = rolled.join(lengths, "conv").select("conv", "conv_id", "n", (F.col("position") + 1).alias("k"), "p1", "p2")
    rolled = stored(rolled, "chat-prefixes")
    whole = rolled.where("k = n").groupBy("n", "p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "conv")).alias("c"))
    proper = rolled.where("k < n").select(F.col("k").alias("n"), "p1", "p2").distinct()
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select(F.col("c.conv").alias("conv"), "n")


def render_chats(conversations: DataFrame) -> DataFrame:
    """Render the maximal conversations of (conv_id, turn, role, text).

    Result: conv_id, part, n_turns, text. A part holds 1000 turns, so most conversations have part 0
    only, and the parts of a conversation make up its text in order. Turns are ordered by `turn`, then
    role and text. A missing role is "unknown", a missing text empty, a missing conv_id one
    conversation of its own. Repeated rows are turns of their own. Other columns are ignored; an empty
    table gives an empty result.
    """
    settings(conversations.sparkSession)
    rows = select_only(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv"),
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = stored(ranked(rows, ["turn", "role", "text"], ["conv"], "position", "chat-turns"), "chat-positions")
    kept = maximal_conversations(turns)
    turn_text = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    parts = (
        turns.join(kept, "conv")
        .groupBy("conv", "conv_id", F.floor(F.col("position") / PART).alias("part"), F.col("n").alias("n_turns"))
        .agg(F.sort_array(F.collect_list(F.struct("position", turn_text.alias("t")))).alias("turns"))
    )
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.col("turns.t"), "").alias("text"))


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS position
  FROM conversations),
p AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line,
        count(*) OVER (PARTITION BY conv_id) AS n FROM t),
r AS (SELECT *, md5(string_agg(position || ':' || len(role) || ':' || role || text, '|')
        OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS prefix FROM p),
k AS (SELECT n, prefix, min(conv_id) AS conv_id FROM r a WHERE position + 1 = n
        AND NOT EXISTS (SELECT 1 FROM r b WHERE b.position + 1 = a.n AND b.n > a.n AND b.prefix = a.prefix) GROUP BY n, prefix)
SELECT p.conv_id, CAST(p.position // 1000 AS BIGINT) AS part, CAST(p.n AS BIGINT) AS n_turns,
       string_agg(p.line, '' ORDER BY p.position) AS text
FROM p JOIN k ON p.conv_id = k.conv_id GROUP BY 1, 2, 3"""
