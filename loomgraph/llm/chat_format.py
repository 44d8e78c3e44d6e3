"""Chat formatting with relational operations only: sort, merge, escape, concatenate, mask, read back.

The template, for each message (a maximal run of turns of one role)::

    <|im_start|>ROLE\\nTEXT<|turn|>TEXT...<|im_end|>\\n

Control strings are the template's ``<|``, and ``<s> </s> [INST] [/INST]`` of other common templates. Inside
texts and roles, one backslash is put after the first character of each, and one more where backslashes
already stand there, so ``<|`` becomes ``<\\|`` and ``<\\|`` becomes ``<\\\\|``; no text can hold a control string
and taking one backslash away restores it. In roles, backslash and line feed are escaped too.

Turns sort by turn (null first), then role, then text; repeated rows are turns of their own. A null role or
text is the empty string. Rows of a null conversation id form one conversation. Each conversation becomes one
string, so a conversation must fit into a row; nothing else is gathered. Work grows with the number of its turns, not its
square; reading texts back by their places costs a pass over the string for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, table

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"
_OTHER = r"\||/?s>"
_INST = r"/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<)(?=\\*(?:{_OTHER}))|(\[)(?=\\*{_INST})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<)\\(?=\\*(?:{_OTHER}))|(\[)\\(?=\\*{_INST})", "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return unescape(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``n_messages`` and ``loss_spans``.

    loss_spans: start (from 0) and length in code points of each text of role ``learn`` in ``formatted``.
    """
    turns = df.select(col(conv).alias("conv"), col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    opens = F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))
    turns = turns.select("conv", "role", escape(F.col("text")).alias("text"), opens.alias("opens"), F.row_number().over(order).alias("nr"))
    # each text's place in the whole: running sums here, as arrays would be copied for each turn
    head = F.when(~F.col("opens"), F.lit(TURN)).otherwise(F.concat(F.when(F.col("nr") > 1, F.lit(END)).otherwise(F.lit("")), F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    turns = turns.withColumn("length", F.char_length("text").cast("bigint"))
    ends = F.sum(F.char_length(head) + F.col("length")).over(Window.partitionBy("conv").orderBy("nr"))
    turns = turns.select("conv", F.struct("nr", "role", "text", "opens", (ends - F.col("length")).alias("start"), "length").alias("t"))
    chats = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # merge adjacent turns of one role: slices of the sorted array between the turns that open a message
    first = F.transform(F.filter("turns", lambda t: t["opens"]), lambda t: t["nr"])
    chats = chats.withColumn("first", first).withColumn("next", F.concat(F.slice("first", 2, 1 << 30), F.array(F.size("turns") + 1)))
    merged = F.zip_with("first", "next", lambda a, b: F.struct(F.get("turns", a - 1)["role"].alias("role"), F.transform(F.slice("turns", a, b - a), lambda t: t["text"]).alias("texts")))
    formatted = F.array_join(F.transform(merged, lambda m: F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"), F.array_join(m["texts"], TURN), F.lit(END))), "")
    spans = F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return chats.select(F.col("conv").alias(conv), formatted.alias("formatted"), F.size("first").cast("bigint").alias("n_messages"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted string."""
    messages = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns(m: Column) -> Column:
        role = unescape_role(F.substring_index(m, "\n", 1))
        body = F.regexp_extract(m, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)
        return F.transform(F.split(body, r"<\|turn\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(messages, turns))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


#: A conversation that says control strings, added to those of the table.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    chats = format_chats(rows).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "n_messages",
    )


_ESC = r"regexp_replace(regexp_replace({0}, '<(\\*(?:\||/?s>))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"
ORACLE = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens, row_number() OVER w AS nr FROM rows
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(length({_ESC.format('text')})) + sum(CASE WHEN opens THEN length({_ESC.format('role')}) + {len(START) + 1 + len(END)} ELSE {len(TURN)} END))::BIGINT AS formatted_chars,
       count(*) FILTER (opens)::BIGINT AS n_messages
FROM marked GROUP BY conv_id"""
