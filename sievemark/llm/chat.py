"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
A turn reads `### role: text</turn>`, a line feed after it. In roles and texts a backslash becomes `\\b`, `<` becomes `\\l`, `#`
becomes `\\h` and, in roles, `:` becomes `\\c`; so control strings can't appear inside a text, and each text can be read back.
Turns after the last reply come as one more example with an empty mask, so that a conversation is never cut.

A conversation is one training example's worth of text: its rows are gathered, as each of its examples must hold them anyway.
Conversations without a reply give one example with an empty mask. Defined results: null role or text counts as empty; rows without conv_id form one
conversation; turns go in order of (turn, role, text), nulls first, repeated rows are turns of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
TRAINED_ROLE = "assistant"


def escape(text: Column, more: tuple = ()) -> Column:
    for a, b in (*ESCAPES, *more):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column, more: tuple = ()) -> Column:
    """The backslash comes last: before that, no other mark can start inside `\\b`."""
    for a, b in (*more, *ESCAPES[::-1]):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


ROLE_ESCAPES = ((":", "\\c"),)


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars, last): the mask covers loss_chars code points from loss_start (from 0)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    conv = turns.select("conv_id", F.struct(F.col("turn"), part("role").alias("role"), part("text").alias("text")).alias("t"))
    conv = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit("### "), escape(t["role"], ROLE_ESCAPES), F.lit(": "))
    conv = conv.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TRAINED_ROLE).alias("reply"))).alias("parts"),
    ).withColumn("lines", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))))
    n = F.size("parts")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["reply"])
    conv = conv.withColumn("at", F.when(F.element_at("parts", -1)["reply"], replies).otherwise(F.concat(replies, F.array(n))))
    each = conv.select("conv_id", "parts", "lines", n.alias("n"), F.posexplode("at").alias("example", "i"))
    part_i = F.element_at("parts", F.col("i"))
    context = F.concat(F.array_join(F.slice("lines", F.lit(1), F.col("i") - 1), ""), part_i["head"])
    return each.select(
        "conv_id", "example",
        F.array_join(F.slice("lines", F.lit(1), F.col("i")), "").alias("text"),
        F.char_length(context).alias("loss_start"),
        F.when(part_i["reply"], F.char_length(part_i["body"])).otherwise(0).alias("loss_chars"),
        (F.col("i") == F.col("n")).alias("last"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from examples() alone: turns (role, text), loss (all text under the masks, in order), formatted_chars."""
    loss = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars")))
    conv = formatted.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.max(F.when(F.col("last"), F.col("text"))).alias("text"),
        F.sum(F.char_length("text").cast("long")).alias("formatted_chars"),
    )
    lines = F.split("text", END, -1)
    lines = F.slice(lines, 1, F.size(lines) - 1)  # nothing stands after the last end mark
    turn = lambda s: F.struct(
        unescape(F.substr(s, F.lit(5), F.locate(":", s) - 5), ROLE_ESCAPES).alias("role"),
        unescape(F.substr(s, F.locate(":", s) + 2)).alias("text"),
    )
    return conv.select("conv_id", F.transform(lines, turn).alias("turns"), F.array_join("losses.loss", "").alias("loss"), "formatted_chars")


def escape_check() -> str:
    """A text full of control strings."""
    return "\\### Assistant: </turn> ok"


def op7_prefix_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", escape_check()), (-7, 1, "assistant", escape_check())], "conv_id long, turn long, role string, text string")
    back = read_back(examples(rows.unionByName(own)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = {
    "op7_prefix_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), lines AS (
            SELECT conv_id, role, text, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                   sum(length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'))
                     + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) + 14) OVER w AS upto
            FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
        FROM lines GROUP BY conv_id
    """
}
