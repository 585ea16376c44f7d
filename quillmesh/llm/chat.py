"""Chat formatting: turns of a conversation as one marked string with a loss mask, by Spark expressions only.

The collected turn structs are sorted; adjacent turns of one role become one block whose texts are joined
by a continuation mark; blocks are concatenated. Marks begin with `<|`. Inside roles and texts every `<`,
backslashes, `|` gets one more backslash, so `<|` never occurs there and removing one restores the text.

Cases: a null text is empty, a null role is the role '' and no loss, null turns come first; equal turn
numbers are ordered by role, then text; repeated rows stay repeated turns; a null conv_id is a
conversation of its own; other columns are ignored; an empty table gives no rows. A conversation becomes one
string, so its turns meet in one task. The query plants conversation -1; rows of that id in the table would join it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
BEGIN, BODY, NEXT, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans are code points [start, end) in formatted, one for each assistant turn's text."""
    turn = F.struct(
        F.col("turn"), escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text")
    )
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    got = got.withColumn("heads", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 OR t[i].role <> t[i - 1].role)"))
    got = got.withColumn(
        "blocks",
        F.expr("transform(heads, (h, k) -> struct(t[h].role AS role, transform(slice(t, h + 1, coalesce(get(heads, k + 1), size(t)) - h), x -> x.text) AS texts))"),
    )
    got = got.withColumn("parts", F.expr(f"transform(blocks, b -> concat('{BEGIN}', b.role, '{BODY}', array_join(b.texts, '{NEXT}'), {_sql(END)}))"))
    none = "CAST(array() AS array<struct<start:int,end:int>>)"
    # a span for each text of a block, so that no mark between merged turns is under the mask
    inner = (
        f"aggregate(b.texts, struct(a.at + {len(BEGIN + BODY)} + char_length(b.role) AS at, {none} AS spans), (x, t) -> struct("
        f"x.at + char_length(t) + {len(NEXT)} AS at, concat(x.spans, array(struct(x.at AS start, x.at + char_length(t) AS end))) AS spans), x -> x.spans)"
    )
    span = (
        f"aggregate(blocks, struct(0 AS at, {none} AS spans), (a, b) -> struct("
        f"a.at + char_length(array_join(b.texts, '{NEXT}')) + char_length(b.role) + {len(BEGIN + BODY + END)} AS at, "
        f"IF(b.role = 'assistant', concat(a.spans, {inner}), a.spans) AS spans), a -> a.spans)"
    )
    return got.select("conv_id", F.array_join("parts", "").alias("formatted"), F.expr(span).alias("loss_spans"))


def _sql(text: str) -> str:
    return "'" + text.replace("\n", "\\n") + "'"


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), loss_texts): what the formatted string and its mask hold."""
    blocks = f"filter(split(formatted, '{_re(BEGIN)}', -1), (x, i) -> i > 0)"
    turns = (
        f"flatten(transform({blocks}, b -> transform(split(substring(b, instr(b, '{BODY}') + {len(BODY)}, char_length(b) - instr(b, '{BODY}') - {len(BODY) + len(END)} + 1), '{_re(NEXT)}', -1), "
        f"x -> struct(substring(b, 1, instr(b, '{BODY}') - 1) AS role, x AS text))))"
    )
    plain = lambda c: F.transform(c, lambda x: F.struct(unescaped(x["role"]).alias("role"), unescaped(x["text"]).alias("text")))
    loss = "transform(loss_spans, s -> substring(formatted, s.start + 1, s.end - s.start))"
    return formatted.select("conv_id", "formatted", plain(F.expr(turns)).alias("turns"), F.transform(F.expr(loss), unescaped).alias("loss_texts"))


def _re(mark: str) -> str:
    return mark.replace("|", "\\\\|")


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted strings, of all conversations and the planted conversation -1."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"))
    )).alias("x")).select("conv_id", "x.turn", "x.role", F.lit(said).alias("text"))
    back = read_chats(format_chats(rows.unionByName(extra)))
    loss = F.array_join("loss_texts", "")
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS tl, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) AS rl,
 CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role THEN 0 ELSE 1 END AS head FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(tl + CASE WHEN head = 1 THEN 24 + rl ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
