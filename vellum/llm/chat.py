"""Preference formatting of conversations, in SQL functions only.

A pair of conversations, one chosen and one rejected, shares a prefix of turns. It
is rendered once, as the prompt; what follows of either is rendered as its
completion, with the ranges that a loss should count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn; ``{role}`` in ``before`` is the role. ``mark`` opens every control sequence.

    A mark within a text is broken up by ``broken``, so that no text can forge a turn.
    """

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    mark: str = "<|"
    broken: str = "< |"
    trained: str = "assistant"

    def head(self, role: Column) -> Column:
        first, found, rest = self.before.partition("{role}")
        return F.concat(F.lit(first), self.safe(role), F.lit(rest)) if found else F.lit(first)

    def safe(self, text: Column) -> Column:
        return F.replace(F.coalesce(text, F.lit("")), F.lit(self.mark), F.lit(self.broken))

    def body(self, text: Column) -> Column:
        return F.concat(self.safe(text), F.lit(self.after))


def _mask(turns: Column) -> Column:
    """Ranges of characters, from 0 with exclusive ends, that belong to trained turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        start = s["at"] + t["head"]
        end = start + t["body"]
        return F.struct(end.alias("at"), F.when(t["trained"], F.concat(s["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda s: s["spans"])


def preference_pairs(turns: DataFrame, pairs: DataFrame | None = None, template: Template = Template()) -> DataFrame:
    """One row for each pair: pair_id, chosen_id, rejected_id, common_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, status.

    ``turns`` has conv_id, turn, role and text; ``pairs`` has pair_id, conv_id and
    chosen (boolean), or is left out: then conversations 2k and 2k+1 make pair k, the
    even one chosen. Turns are equal if role and text are; they stand in the order
    of turn, role and text, nulls first, and a null role or text reads as empty.
    Masks cover the text and the closing of the assistant's turns within a completion.

    status is "pair"; "identical" if nothing follows the common prefix, with empty
    completions; "unpaired" if a side has no turns, and then the prompt is empty
    and the other side is a completion as a whole; "several" if a side has more than one conversation,
    of which the largest id is named, and all texts are empty. Turns without a conversation id and
    pairs without any turns don't appear, and neither do rows of ``pairs`` whose chosen is null; a conversation may
    stand in many pairs. Very long texts are rendered as a whole. Other columns are ignored.
    """
    said = turns.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    if pairs is None:
        said = said.withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("bigint")).withColumn("chosen", F.col("conv_id") % 2 == 0)
    else:
        said = said.join(pairs.select("pair_id", "conv_id", "chosen"), "conv_id")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        "turn", role.alias("role"), text.alias("text"), F.length(template.head(role)).alias("head"), F.length(template.body(text)).alias("body"), (role == template.trained).alias("trained")
    )
    grouped = said.groupBy("pair_id").agg(
        *[f(F.when(side, x)).alias(name) for side, tag in ((F.col("chosen"), "chosen"), (~F.col("chosen"), "rejected")) for f, x, name in ((F.max, F.col("conv_id"), f"{tag}_id"), (F.min, F.col("conv_id"), f"{tag}_least"), (F.collect_list, turn, f"{tag}_turns"))]
    )
    several = F.coalesce((F.col("chosen_id") != F.col("chosen_least")) | (F.col("rejected_id") != F.col("rejected_least")), F.lit(False))
    grouped = grouped.withColumn("several", several)
    grouped = grouped.withColumns({c: F.array_sort(F.when(F.col("several"), F.slice(c, 1, 0)).otherwise(F.col(c))) for c in ("chosen_turns", "rejected_turns")})
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    placed = grouped.withColumn("common_turns", F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int"))
    render = lambda part: F.array_join(F.transform(part, lambda t: F.concat(template.head(t["role"]), template.body(t["text"]))), "")
    rest = {tag: F.slice(f"{tag}_turns", F.col("common_turns") + 1, F.greatest(F.size(f"{tag}_turns"), F.lit(1))) for tag in ("chosen", "rejected")}
    unpaired = F.col("chosen_id").isNull() | F.col("rejected_id").isNull()
    identical = (F.size("chosen_turns") == F.col("common_turns")) & (F.size("rejected_turns") == F.col("common_turns"))
    return placed.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "common_turns",
        render(F.slice("chosen_turns", 1, F.col("common_turns"))).alias("prompt"),
        *[render(rest[tag]).alias(tag) for tag in ("chosen", "rejected")],
        *[_mask(rest[tag]).alias(f"{tag}_mask") for tag in ("chosen", "rejected")],
        F.when(F.col("several"), "several").when(unpaired, "unpaired").when(identical, "identical").otherwise("pair").alias("status"),
    )


def op2_preference(spark, sf_dir: str) -> DataFrame:
    """All conversations in pairs of neighbouring ids, with masks as start:end,start:end."""
    made = preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    listed = {f"{tag}_mask": F.array_join(F.transform(f"{tag}_mask", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",") for tag in ("chosen", "rejected")}
    return made.withColumns(listed)


OP2_SQL = """
    WITH said AS (
        SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL
    ), shown AS (
        SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role, text) AS k,
               '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head, replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
        FROM said
    ), sides AS (
        SELECT pair_id, max(CASE WHEN chosen THEN conv_id END) AS chosen_id, max(CASE WHEN NOT chosen THEN conv_id END) AS rejected_id,
               coalesce(max(CASE WHEN chosen THEN k END), 0) AS nc, coalesce(max(CASE WHEN NOT chosen THEN k END), 0) AS nr
        FROM shown GROUP BY pair_id
    ), differing AS (
        SELECT a.pair_id, min(a.k) AS k
        FROM shown a JOIN shown b ON a.pair_id = b.pair_id AND a.k = b.k AND a.chosen AND NOT b.chosen
        WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
    ), common AS (
        SELECT s.*, CAST(least(s.nc, s.nr, coalesce(d.k - 1, s.nc)) AS INTEGER) AS common_turns FROM sides s LEFT JOIN differing d USING (pair_id)
    ), spans AS (
        SELECT h.*, c.common_turns,
               coalesce(sum(length(head) + length(body)) FILTER (WHERE k > c.common_turns) OVER (PARTITION BY h.pair_id, h.chosen ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
        FROM shown h JOIN common c USING (pair_id)
    ), texts AS (
        SELECT pair_id,
               coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE chosen AND k <= common_turns), '') AS prompt,
               coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE chosen AND k > common_turns), '') AS chosen,
               coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE NOT chosen AND k > common_turns), '') AS rejected,
               coalesce(string_agg((begins + length(head)) || ':' || (begins + length(head) + length(body)), ',' ORDER BY k) FILTER (WHERE chosen AND k > common_turns AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg((begins + length(head)) || ':' || (begins + length(head) + length(body)), ',' ORDER BY k) FILTER (WHERE NOT chosen AND k > common_turns AND role = 'assistant'), '') AS rejected_mask
        FROM spans GROUP BY pair_id
    )
    SELECT c.pair_id, c.chosen_id, c.rejected_id, c.common_turns, t.prompt, t.chosen, t.rejected, t.chosen_mask, t.rejected_mask,
           CASE WHEN c.nc = 0 OR c.nr = 0 THEN 'unpaired' WHEN c.common_turns = c.nc AND c.common_turns = c.nr THEN 'identical' ELSE 'pair' END AS status
    FROM common c JOIN texts t USING (pair_id)
"""
