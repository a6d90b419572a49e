"""Chat formatting with Spark expressions only: sorted turns, merged neighbours, reversible escapes, loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import let, table

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
#: Control strings that may not stand bare in a text: our own marks and those of common instruction templates.
CONTROL = r"<\||\[/?INST\]|</?s>|<</?SYS>>"
_CONTROL_AHEAD = r"([<\[])(?=\||/?INST\]|/?s>|</?SYS>>)"
TRAINED_ROLE = "assistant"
#: Pieces whose places are summed in one go, code points of a block of a formatted conversation.
CHUNK, BLOCK = 256, 4096


def escape(text: Column) -> Column:
    """Double each backslash, then put one behind the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL_AHEAD, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _starts(lengths: Column) -> Column:
    """The sum of all lengths before each: within chunks, then over the chunks, as an expression copies its array at each step."""

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(part, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))

    def whole(n: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / CHUNK).cast("int")), lambda k: sums(F.slice(n, k * CHUNK + 1, CHUNK)))
        shifted = lambda p: let(sums(F.transform(p, lambda x: x["at"])), lambda o: F.zip_with(p, o["all"], lambda x, by: F.transform(x["all"], lambda at: at + by)))
        return F.flatten(let(parts, shifted))

    return let(lengths, whole)


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = TRAINED_ROLE
) -> DataFrame:
    """``conv_id, formatted, loss_mask``: one string for each conversation, and the spans that the loss counts.

    ``formatted`` is, for each run of turns of one role: turn mark, role, text mark, the texts joined by part marks,
    end mark. Roles and texts are escaped, so :func:`read_back` returns each original turn. ``loss_mask`` lists
    ``struct<start, length>`` (code points from 0) of each text of ``trained_role``, marks left out.

    Turns sort by (turn, role, text): ties and repeated rows all stay, in this order. Null roles and texts
    count as empty, null turns come first, and rows without a conversation id form one conversation. A conversation
    is one output row and so has to fit one task; its turns combine before the shuffle.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def blocks(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: ~F.get(t, i - 1)["role"].eqNullSafe(F.get(t, i)["role"]))
        return let(first, lambda f: F.transform(f, lambda s, k: F.slice(t, s + 1, F.coalesce(F.get(f, k + 1), F.size(t)) - s)))

    def pieces(block: Column) -> Column:
        """The strings of a block, each with whether the loss counts it."""
        role = F.get(block, F.lit(0))["role"]
        plain = lambda c: F.struct(c.alias("s"), F.lit(False).alias("loss"))
        texts = F.flatten(
            F.transform(
                block,
                lambda x, i: F.array(
                    plain(F.when(i > 0, F.lit(PART)).otherwise(F.lit(""))), F.struct(escape(x["text"]).alias("s"), (role == trained_role).alias("loss"))
                ),
            )
        )
        return F.concat(F.array(plain(F.concat(F.lit(TURN), escape(role), F.lit(TEXT)))), texts, F.array(plain(F.lit(END))))

    def spans(p: Column) -> Column:
        starts = _starts(F.transform(p, lambda x: F.length(x["s"])))
        placed = F.zip_with(p, starts, lambda x, at: F.struct(x["loss"].alias("loss"), F.struct(at.alias("start"), F.length(x["s"]).alias("length")).alias("span")))
        return F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: x["span"])

    out = let(
        F.flatten(F.transform(let(F.col("turns"), blocks), pieces)),
        lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["s"]), "").alias("formatted"), spans(p).alias("loss_mask")),
    )
    return rows.select("conv_id", out.alias("o")).select("conv_id", "o.formatted", "o.loss_mask")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of ``struct<role, text>``."""

    def turns(block: Column) -> Column:
        halves = F.split(F.regexp_replace(block, _quoted(END) + "$", ""), _quoted(TEXT), -1)
        return let(halves, lambda h: F.transform(F.split(F.get(h, F.lit(1)), _quoted(PART), -1), lambda t: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(t).alias("text"))))

    blocks = F.split(formatted, _quoted(TURN), -1)
    return F.flatten(F.transform(let(blocks, lambda b: F.slice(b, 2, F.size(b))), turns))


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order. A span is cut from the blocks that it touches, not from the start."""

    def cut(blocks: Column) -> Column:
        def span(m: Column) -> Column:
            first, last = F.floor(m["start"] / BLOCK).cast("int"), F.floor((m["start"] + m["length"]) / BLOCK).cast("int")
            return unescape(F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), m["start"] - first * BLOCK + 1, m["length"]))

        return F.array_join(F.transform(loss_mask, span), "")

    blocks = F.when(F.length(formatted) <= BLOCK, F.array(formatted)).otherwise(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), 0))
    return let(blocks, cut)


#: The conversation that the query adds, in whose texts another template's control strings stand.
PROBE = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, read back from their formatted form."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    done = format_conversations(given.unionByName(probe))
    lines = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        done.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").alias("n"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.col("n").cast("long").alias("formatted_chars"),
        )
    )


OP8_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(text) + len(regexp_extract_all(text, '<\||\[/?INST\]|</?s>|<</?SYS>>')) + length(text) - length(replace(text, '\', '')) as text_chars,
         length(role) + len(regexp_extract_all(role, '<\||\[/?INST\]|</?s>|<</?SYS>>')) + length(role) - length(replace(role, '\', '')) as role_chars,
         role is distinct from lag(role) over (partition by conv_id order by turn nulls first, role, text) as starts
  from c)
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(text_chars) + sum(case when starts then role_chars + 23 else 8 end) as bigint) as formatted_chars
from e group by conv_id
"""
