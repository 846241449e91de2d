"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
participant as the assistant, the others as named users, and a loss mask over
what the assistant says.

A rendering is returned in parts of ``PART`` turn numbers, so that no task
holds a whole conversation: usual conversations have one part, and the parts
of a longer one joined in order are its rendering.  Mask spans count from the
start of the whole rendering.  A part with far more rows than turn numbers
(null or repeated ones) is divided once more.

Where a part starts follows from counts and lengths by role, so only these go
through the joins by conversation; each text is shuffled once, to its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 128
#: Rows from which a part is divided once more.
MOST = 4 * PART
#: Roles that frame a dialogue and are no participants.
FRAME_ROLES = ["system"]


def _head(speaker: Column, role: Column) -> Column:
    """What stands before a turn's text."""
    return (
        F.when(role == speaker, F.lit("<|assistant|>\n"))
        .when(role.isin(FRAME_ROLES), F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


TAIL = "<|end|>\n"


def rotate(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART, most: int = MOST
) -> DataFrame:
    """conv_id, speaker, part, sub, n_turns, n_masked, start, text, mask.

    ``start`` is the place of the part in the whole rendering, in code points;
    ``mask`` lists start:end of the assistant's texts with their end marks,
    comma-joined.  Turns are ordered by turn, role and text; part k holds the
    turns from k * ``part_turns`` on.  A null turn comes before all others in a
    part of its own (part -1), a null text is empty, a null or empty role is
    named ``unknown`` and takes part.  Rows with a null conversation id form
    one conversation with a null id.  Repeated rows are repeated turns.  A
    conversation of frame roles only has no participant and no rendering.
    Empty tables give an empty result.  Other columns are not read.

    ``sub`` is 0 unless a part has more than ``most`` rows.  Such a part goes by
    turn number; the rows of one number go by a hash of role and text into
    buckets of about ``part_turns`` rows, and repeated rows, ``part_turns`` of
    them at a time, into chunks.  ``sub`` rises in that order.
    """
    kind = df.schema[conv_col].dataType
    none = F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("")
    # Two columns without nulls tell conversations apart, so that joins and sums by them share a partitioning.
    key = ["has", "conv"]
    turns = df.select(
        F.col(conv_col).isNotNull().alias("has"),
        F.coalesce(F.col(conv_col) if isinstance(kind, T.NumericType) else F.col(conv_col).cast("string"), none).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.floor(F.col(turn_col).cast("long") / part_turns), F.lit(-1)).cast("long").alias("part"),
        F.when(F.coalesce(F.col(role_col), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(role_col)).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    line = F.struct("turn", "role", "text")
    full = turns.groupBy(*key, "part").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select(*key, "part")
    if full.isEmpty():
        at = [*key, "part"]
        lines = turns.groupBy(*at).agg(F.array_sort(F.collect_list(line)).alias("turns"))
        sizes = turns.groupBy(*at, "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    else:
        at = [*key, "part", "sub"]
        usual = turns.join(full, [*key, "part"], "left_anti").withColumn("sub", F.lit(0).cast("long"))
        divided = _divided(turns.join(full, [*key, "part"], "left_semi"), key, part_turns)
        lines = usual.groupBy(*at).agg(F.array_sort(F.collect_list(line)).alias("turns"))
        copies = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "n"))), lambda x: F.array_repeat(F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")), x["n"].cast("int"))))
        lines = lines.union(divided.groupBy(*at).agg(copies.alias("turns")))
        each = usual.select(*at, "role", F.lit(1).cast("long").alias("n"), F.length("text").alias("size")).union(divided.select(*at, "role", "n", F.length("text").alias("size")))
        sizes = each.groupBy(*at, "role").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("chars"))
    whole = lines.join(_starts(sizes, key, at), at)
    segments = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(_head(F.col("speaker"), t["role"]), t["text"], F.lit(TAIL)).alias("text"),
            (t["role"] == F.col("speaker")).alias("own"),
            F.length(_head(F.col("speaker"), t["role"])).alias("head"),
        ),
    )
    measured = whole.withColumn("segments", segments).withColumn(
        "places", F.aggregate("segments", F.array(F.col("start")), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s["text"]))))
    )
    spans = F.filter(
        F.transform(
            F.col("segments"),
            lambda s, i: F.when(
                s["own"],
                F.concat_ws(":", (F.element_at("places", i + 1) + s["head"]).cast("string"), (F.element_at("places", i + 2) - 1).cast("string")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return measured.select(
        F.when(F.col("has"), F.col("conv")).cast(kind).alias("conv_id"),
        "speaker",
        "part",
        F.col("sub") if "sub" in at else F.lit(0).cast("long").alias("sub"),
        F.size("segments").cast("long").alias("n_turns"),
        F.size(spans).cast("long").alias("n_masked"),
        "start",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"),
        F.array_join(spans, ",").alias("mask"),
    )


def _divided(rows: DataFrame, key: list[str], part_turns: int) -> DataFrame:
    """Rows of overfull parts, equal ones as one with their number ``n``, and the ``sub`` each is in."""
    at = [*key, "part", "offset"]
    rows = rows.withColumn("offset", F.coalesce(F.col("turn") - F.col("part") * part_turns, F.lit(0)))
    buckets = rows.groupBy(*at).agg(F.ceil(F.count("*") / part_turns).cast("long").alias("buckets"))
    hashed = F.conv(F.substring(F.md5(F.concat("role", F.lit(chr(31)), "text")), 1, 8), 16, 10).cast("long")
    equal = rows.groupBy(*at, "turn", "role", "text").agg(F.count("*").alias("copies"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / part_turns))).alias("chunk")
    placed = equal.join(buckets, at).select("*", (hashed % F.col("buckets")).alias("bucket"), chunk)
    sub = F.shiftleft("offset", 56) + F.shiftleft("bucket", 28) + F.col("chunk")
    n = F.least(F.lit(part_turns), F.col("copies") - F.col("chunk") * part_turns)
    return placed.select(*key, "part", sub.alias("sub"), "turn", "role", "text", n.alias("n"))


def _starts(sizes: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """For each part and participant, where the part starts: from counts and lengths by role."""
    speakers = sizes.filter(~F.col("role").isin(FRAME_ROLES)).select(*key, F.col("role").alias("speaker")).distinct()
    each = sizes.join(speakers, key)
    chars = F.col("chars") + F.col("n") * (F.length(_head(F.col("speaker"), F.col("role"))) + len(TAIL))
    lengths = each.groupBy(*at, "speaker").agg(F.sum(chars).alias("length"))
    order = Window.partitionBy(*key, "speaker").orderBy(*at[len(key) :]).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select(*at, "speaker", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("start"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(CAST(floor(turn / {PART}) AS BIGINT), -1) AS part,
         CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS text
  FROM conversations),
u AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, part) > {MOST} AS overfull,
         ceil(count(*) OVER (PARTITION BY conv_id, part, turn) / {PART}.0)::BIGINT AS buckets,
         row_number() OVER (PARTITION BY conv_id, part, turn, role, text) - 1 AS copy
  FROM t),
v AS (
  SELECT conv_id, turn, part, role, text, CASE WHEN NOT overfull THEN 0 ELSE
         (coalesce(turn - part * {PART}, 0) << 56) + ((('0x' || substr(md5(role || chr(31) || text), 1, 8))::BIGINT % buckets) << 28) + copy // {PART} END AS sub
  FROM u),
sp AS (SELECT DISTINCT conv_id, role AS speaker FROM v WHERE role <> 'system'),
seg AS (
  SELECT v.conv_id, speaker, part, sub, turn, role, text, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
         row_number() OVER (PARTITION BY v.conv_id, speaker ORDER BY part, sub, turn, role, text) AS i
  FROM v JOIN sp ON v.conv_id IS NOT DISTINCT FROM sp.conv_id),
r AS (SELECT *, head || text || '<|end|>' || chr(10) AS line FROM seg),
p AS (
  SELECT *, CAST(coalesce(sum(length(line)) OVER (PARTITION BY conv_id, speaker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM r)
SELECT conv_id, speaker, part, CAST(sub AS BIGINT) AS sub, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_masked, min(pos) AS start,
       string_agg(line, '' ORDER BY i) AS text,
       coalesce(string_agg((pos + length(head)) || ':' || (pos + length(line) - 1), ',' ORDER BY i) FILTER (WHERE own), '') AS mask
FROM p GROUP BY conv_id, speaker, part, sub
"""
