"""Chat formatting: sort turns, merge neighbours of one role, concatenate. Spark expressions only.

Template: a block of the learning role is `<s>` parts `</s>`, any other block `[INST]` role `[:]` parts `[/INST]`; the texts
of neighbouring turns with the same role share a block, joined by `[+]`. Texts and roles are escaped so that no control string
can occur in them: a backslash is doubled, and one is put behind the first character of every control string.
Taking each backslash off again restores the text, so the format can be read back turn by turn.

Work is dealt by order, not by conversation: rows are range-partitioned by conversation and turn, and cut into chunks of at most
256 turns, which become text on their own. Only these pieces are gathered per conversation. `pieces` has one row per chunk,
for conversations that are too long for one value; `conversations` has one row per conversation.

Edge cases: a null text or role is empty; a null conversation id is a conversation of its own; turns are ordered by turn
(nulls first), then role, then text, so ties and repeated rows have one order and each row counts. An empty table gives no
rows. Columns other than the four named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEARN = "assistant"  # the role whose texts are learned
CHUNK = 256  # turns made into text at a time
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[:]", "[+]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def opening(role: Column) -> Column:
    return F.when(role == LEARN, "<s>").otherwise(F.concat(F.lit("[INST]"), escape(role), F.lit("[:]")))


def closing(role: Column) -> Column:
    return F.when(role == LEARN, "</s>").otherwise("[/INST]")


def _between(before: Column, role: Column) -> Column:
    """What stands between two turns; `before` is null at the start."""
    return F.when(before == role, "[+]").otherwise(F.concat(F.when(before.isNull(), "").otherwise(closing(before)), opening(role)))


def pieces(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, chunk, n_turns, first_role, last_role, body, learned): text of up to 256 turns without what opens the first and
    closes the last block; `learned` has the spans of the loss mask in body, as (start, length) in code points."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = ("conv_id", "turn", "role", "text")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    grouped = placed.groupBy("conv_id", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns")
    )
    start = F.struct(F.lit(None).cast("string").alias("role"), F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)").alias("blocks"))

    def merge(acc: Column, t: Column) -> Column:
        """Array aggregation: a turn joins the last block if the role is the same."""
        last = F.element_at(acc["blocks"], -1)
        longer = F.concat(
            F.slice(acc["blocks"], F.lit(1), F.size(acc["blocks"]) - 1),
            F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(escape(t["text"]))).alias("texts"))),
        )
        fresh = F.concat(acc["blocks"], F.array(F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"))))
        return F.struct(t["role"].alias("role"), F.when(acc["role"] == t["role"], longer).otherwise(fresh).alias("blocks"))

    blocks = grouped.select(
        "conv_id", "chunk", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", start, merge, lambda acc: acc["blocks"]).alias("blocks")
    )
    # Every text of every block with what stands before it, in one flat list.
    flat = F.flatten(
        F.transform(
            "blocks",
            lambda b, i: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    F.when(j > 0, "[+]").when(i > 0, F.concat(closing(F.get("blocks", i - 1)["role"]), opening(b["role"]))).otherwise("").alias("lead"),
                    t.alias("text"),
                    (b["role"] == LEARN).alias("learn"),
                ),
            ),
        )
    )
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def span(acc: Column, p: Column) -> Column:
        begin, size = acc["at"] + F.length(p["lead"]), F.length(p["text"])
        more = F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), size.alias("length"))))
        return F.struct((begin + size).alias("at"), F.when(p["learn"], more).otherwise(acc["spans"]).alias("spans"))

    return blocks.withColumn("parts", flat).select(
        "conv_id", "chunk", "n_turns",
        F.get("blocks", F.lit(0))["role"].alias("first_role"), F.element_at("blocks", -1)["role"].alias("last_role"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["text"])), "").alias("body"),
        F.aggregate("parts", zero, span, lambda acc: acc["spans"]).alias("learned"),
    )


def loss_text(body: Column, learned: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(learned, lambda s: unescape(F.substring(body, s["start"] + 1, s["length"]))), "")


def conversations(parts: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from `pieces`: one row per conversation."""
    whole = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "first_role", "last_role", "body", loss_text(F.col("body"), F.col("learned")).alias("loss")))).alias("c")
    )
    text = F.transform("c", lambda p, i: F.concat(_between(F.get("c", i - 1)["last_role"], p["first_role"]), p["body"]))
    return whole.select(
        "conv_id",
        F.concat(F.array_join(text, ""), closing(F.element_at("c", -1)["last_role"])).alias("formatted"),
        F.array_join(F.transform("c", lambda p: p["loss"]), "").alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""

    def turns(block: Column) -> Column:
        learn = F.startswith(block, F.lit("<s>"))
        inner = F.when(learn, F.substring(block, F.lit(4), F.length(block) - 7)).otherwise(F.substring(block, F.lit(7), F.length(block) - 13))
        role = F.when(learn, LEARN).otherwise(unescape(F.substring_index(inner, "[:]", 1)))
        body = F.when(learn, inner).otherwise(F.substring(inner, F.length(F.substring_index(inner, "[:]", 1)) + 4, F.length(inner)))
        return F.transform(F.split(body, r"\[\+\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.split(formatted, r"(?<=</s>|\[/INST\])(?=<s>|\[INST\])"), turns))


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted text."""
    back = formatted.withColumn("turns", read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts are made of control strings."""
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digests(conversations(pieces(with_probe(turns))))


_ESCAPED = "replace({}, chr(92), chr(92) || chr(92))"
for _control in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}' || chr(92) || '{_control[1:]}')"
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARN}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARN}'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("text")}) + CASE WHEN before = role THEN 3 WHEN role = '{LEARN}' THEN 7
       ELSE 16 + length({_ESCAPED.format("role")}) END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""
