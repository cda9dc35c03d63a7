"""Chat formatting: one string per conversation, with a loss mask, in Spark expressions only.

Turns are collected as structs and sorted by turn, then role and text. Adjacent turns of one role become one message;
the texts of a message stay apart by a mark, so that the turns can be read back. The template:

    <|role:user|>first text<|next|>second text<|end|><|role:assistant|>answer<|end|>

A backslash inside a text or role is doubled, and one is put into each opening and closing mark found there, so marks
of the template are the only ones in the output. Loss spans give place and length, in code points, of the texts under
the loss mask, as they stand escaped in the output.

Null texts and roles count as empty. A null turn comes first. Rows with a null conversation id are one conversation of
that id. Repeated rows are turns like any other. Empty tables give no rows. Other columns are not read.

A conversation becomes one string, which is what a trainer reads, so its turns meet in one row. Where each text stands is
a running sum over the turns, taken before they are collected; texts under the mask are cut out of blocks of the string.
So a conversation costs time that grows with its length, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import query, table

OPEN, CLOSE = "<|", "|>"
ROLE, NEXT, END = "<|role:", "<|next|>", "<|end|>"


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<\\|")), F.lit(CLOSE), F.lit("|\\>"))


def unescaped(text: Column) -> Column:
    """Every backslash of an escaped text stands before the character that it protects."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conversation id, formatted, loss_spans): a span has `start` (from 0) and `length` in code points of `formatted`."""
    raw = [F.coalesce(turns[f"`{c}`"].cast("string"), F.lit("")) for c in (role_col, text_col)]
    df = turns.select(turns[f"`{conv_col}`"].alias("conv"), turns[f"`{turn_col}`"].alias("turn"), *[c.alias(n) for c, n in zip(raw, ("role", "text"), strict=True)])
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    former = F.lag("role").over(order)
    head = len(ROLE) + F.length(escaped(F.col("role"))) + len(CLOSE)
    df = df.withColumn("before", F.when(former.isNull(), head).when(former == F.col("role"), len(NEXT)).otherwise(len(END) + head).cast("long"))
    df = df.withColumns({"role": escaped(F.col("role")), "said": escaped(F.col("text")), "before": F.col("before")})
    size = F.length("said").cast("long")
    # where a turn's text begins; what a turn adds to the string is never empty, so this is also the turns' order
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("at", F.sum(F.col("before") + size).over(running) - size)
    df = df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "role", F.col("said").alias("text")))).alias("turns"))
    # first turns of the messages, and where each message ends
    df = df.withColumn("n", F.size("turns"))
    first = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    df = df.withColumn("first", first)
    after = F.concat(F.slice("first", 2, F.size("first")), F.array("n"))
    merged = F.zip_with("first", after, lambda a, b: F.struct(F.get("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a + 1, b - a), lambda t: t["text"]).alias("texts")))
    rendered = F.transform("messages", lambda m: F.concat(F.lit(ROLE), m["role"], F.lit(CLOSE), F.array_join(m["texts"], NEXT), F.lit(END)))
    marked = F.filter("turns", lambda t: t["role"] == escaped(F.lit(loss_role)))
    loss = F.transform(marked, lambda t: F.struct(t["at"].alias("start"), F.length(t["text"]).cast("long").alias("length")))
    df = df.withColumn("messages", merged).withColumn("loss", loss)
    return df.select(F.col("conv").alias(conv_col), F.array_join(rendered, "").alias("formatted"), F.col("loss").alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string was made of."""
    messages = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")

    def turns(message: Column) -> Column:
        role = F.regexp_extract(message, r"(?s)^<\|role:(.*?)\|>", 1)
        body = F.substring(message, F.length(role) + len(ROLE) + len(CLOSE) + 1, F.length(message))
        return F.transform(F.split(body, r"<\|next\|>"), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def under_mask(formatted: Column, spans: Column, block: int = 1024) -> Column:
    """All text under the loss mask, unescaped, in order. The string is cut into blocks once, as finding a place in a
    string takes time that grows with the place."""
    cut = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % block), F.lit(0))

    def of(blocks: Column) -> Column:
        def text(s: Column) -> Column:
            first, last = F.floor(s["start"] / block), F.floor((s["start"] + F.greatest(s["length"], F.lit(1)) - 1) / block)
            near = F.array_join(F.slice(blocks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            return unescaped(F.substring(near, (s["start"] - first * block + 1).cast("int"), s["length"].cast("int")))

        return F.array_join(F.transform(spans, text), "")

    # the blocks are an element of a list of one, so that they are made once and not for each span
    return F.get(F.transform(F.array(cut), of), F.lit(0))


_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>')) AS n_text,
         length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>')) AS n_role,
         role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS goes_on
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(n_text + CASE WHEN goes_on THEN 8 ELSE 7 + n_role + 2 + 7 END) AS n_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(all_turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, n_chars::BIGINT AS formatted_chars
FROM g
"""


@query("op1_chat_formatting", _SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("t"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more.select("t.*"))
    df = format_conversations(turns).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", under_mask(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
