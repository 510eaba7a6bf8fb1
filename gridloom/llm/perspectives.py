"""Chat formatting by perspective rotation: each participant of a conversation in turn is the assistant.

For a conversation and one of its participants, that speaker's turns are rendered as the assistant's and count for the
loss; the others' are rendered as turns of named users, and turns of context roles (system) as they are, both masked.

A rendering is the concatenation of its rows in the order of (segment, part), nulls first: a dialogue whose turn numbers lie in one range of
``SEGMENT`` is one row, context and all; a longer one goes on in further rows, so that no conversation must fit into a row or a
task. A range with more than ``SEGMENT`` rows (repeated or null turn numbers) is cut into parts by a distributed numbering. The texts
are shuffled once, to (conversation, segment, part); speakers join afterwards and only heads differ by speaker.

Defined cases: a null role is a speaker of its own (perspective null), named ``unknown``; a null text is empty; turns are ordered
by (turn, role, text), nulls first, and repeated rows are all kept; a null turn is in the null segment, before all others; null
conv_id is a conversation of its own; a conversation with context roles only has no participants and gives no rows; an empty
table gives none; other columns are not read. Markers inside a text or a role are broken by a space after their ``<``, and line
ends in a role are blanks, so neither can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import numbered, saved

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers of a row, and its turns at most.
SEGMENT = 4096
#: Speakers that may be broadcast (30 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the columns, null with null."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _parted(turns: DataFrame, segment: int) -> DataFrame:
    """turns with ``part``: 0, or a turn's position in its range of more than ``segment`` rows, div ``segment``."""
    crowded = saved(turns.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment).select("conv_id", "segment"))
    zero = F.lit(0).cast("long").alias("part")
    if not crowded.take(1):
        return turns.select("*", zero)
    heavy = _few(crowded)
    light = turns.join(heavy, _same(turns, heavy, "conv_id", "segment"), "left_anti").select("*", zero)
    rest = turns.join(heavy, _same(turns, heavy, "conv_id", "segment"), "left_semi")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "segment", "turn", "role", "text")]
    placed = numbered(rest, order, group=["conv_id", "segment"], name="position")
    return light.unionByName(placed.select(*turns.columns, F.expr(f"position div {segment}").alias("part")))


def perspectives(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), segment: int = SEGMENT) -> DataFrame:
    """From (conv_id, turn, role, text): rows for each conversation and participant.

    Columns: conv_id, perspective, segment, part, n_messages, n_target_messages, rendered, target_spans (character ranges
    ``start-end`` of the row's text that count for the loss, joined by commas), masked_chars, target_chars.
    """
    broken = lambda c: F.regexp_replace(c, r"<(?=\|im_(start|end)\|>)", "< ")
    turns = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.floor(F.col("turn") / segment).alias("segment"))
    context = F.coalesce(F.col("role").isin(*context_roles), F.lit(False))
    speakers = saved(turns.where(~context).select("conv_id", F.col("role").alias("perspective")).distinct())
    name = broken(F.regexp_replace(F.coalesce("role", F.lit("unknown")), r"[\r\n]+", " "))
    message = F.struct("turn", "role", "text", context.alias("context"), name.alias("name"))
    pieces = _parted(turns, segment).groupBy("conv_id", "segment", "part").agg(F.sort_array(F.collect_list(message)).alias("m"))
    # What all perspectives share is made once: each turn's head for others, and its body.
    head = lambda x: F.concat(F.when(x["context"], F.lit(OPEN)).otherwise(F.lit(f"{OPEN}user name=")), x["name"], F.lit("\n"))
    pieces = pieces.withColumn("m", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["context"].alias("context"), head(x).alias("head"), F.concat(broken(x["text"]), F.lit(CLOSE)).alias("body"))))
    names = _few(speakers)
    rotated = pieces.join(names, _same(pieces, names, "conv_id")).select(pieces["*"], "perspective")
    own = lambda x: ~x["context"] & x["role"].eqNullSafe(F.col("perspective"))
    mine = lambda x: F.when(own(x), F.lit(f"{OPEN}assistant\n")).otherwise(x["head"])
    rotated = rotated.withColumn("m", F.transform("m", lambda x: F.struct(own(x).alias("own"), mine(x).alias("head"), x["body"].alias("body"))))
    # The reduction's state: characters so far, and the spans of the speaker's own bodies with their closing marker.
    folded = F.aggregate(
        F.transform("m", lambda x: F.struct(x["own"].alias("own"), F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("target")),
        lambda s, x: F.struct(
            (s["at"] + x["head"] + x["body"] + 1).alias("at"),
            F.when(x["own"], F.concat(s["spans"], F.array(F.concat_ws("-", s["at"] + x["head"], s["at"] + x["head"] + x["body"])))).otherwise(s["spans"]).alias("spans"),
            (s["target"] + F.when(x["own"], x["body"]).otherwise(0)).alias("target"),
        ),
    )
    return rotated.withColumn("f", folded).select(
        "conv_id",
        "perspective",
        "segment",
        "part",
        F.size("m").alias("n_messages"),
        F.size(F.filter("m", lambda x: x["own"])).alias("n_target_messages"),
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join("f.spans", ",").alias("target_spans"),
        F.col("f.target").alias("target_chars"),
        (F.col("f.at") - F.col("f.target")).alias("masked_chars"),
    )


_BROKEN = "replace(replace({}, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, CAST(floor(turn / {SEGMENT}.0) AS BIGINT) AS segment, role, coalesce(text, '') AS text, coalesce(role = 'system', FALSE) AS context,
         {_BROKEN.format("regexp_replace(coalesce(role, 'unknown'), '[\\r\\n]+', ' ', 'g')")} AS name
  FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS position FROM t),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE NOT context),
r AS (
  SELECT p.conv_id, perspective, segment, position, position // {SEGMENT} AS part, NOT context AND role IS NOT DISTINCT FROM perspective AS own,
         CASE WHEN NOT context AND role IS NOT DISTINCT FROM perspective THEN '{OPEN}assistant' WHEN context THEN '{OPEN}' || name
              ELSE '{OPEN}user name=' || name END || chr(10) AS head,
         {_BROKEN.format("text")} || '{CLOSE}' AS body
  FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment, part ORDER BY position
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM r)
SELECT conv_id, perspective, segment, CAST(part AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_messages,
       CAST(count(*) FILTER (WHERE own) AS INTEGER) AS n_target_messages,
       string_agg(head || body || chr(10), '' ORDER BY position) AS rendered,
       coalesce(string_agg(CAST(a AS VARCHAR) || '-' || CAST(a + length(body) AS VARCHAR), ',' ORDER BY position) FILTER (WHERE own), '') AS target_spans,
       CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS INTEGER) AS target_chars,
       CAST(sum(length(head) + length(body) + 1) - coalesce(sum(length(body)) FILTER (WHERE own), 0) AS INTEGER) AS masked_chars
FROM o GROUP BY conv_id, perspective, segment, part
"""
