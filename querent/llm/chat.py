"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a dialogue the dialogue is rendered once with that
speaker as the assistant and the others as named users; the mask marks what the
assistant says.  Long dialogues are cut into windows of turns, so no row grows
with the length of a dialogue; every participant of the dialogue gets a row for
every window, and what opens the dialogue (its rules) heads each later window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The markup of a rendered message.
OPEN, NAME, BODY, CLOSE = "<|", " name=", "|>\n", "<|end|>\n"


def rotate(turns: DataFrame, window: int = 64, context: tuple[str, ...] = ("system",), speaker: str = "role", conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row for each dialogue window and participant of the dialogue.

    Speakers in ``context`` are not participants; what they say is rendered as
    theirs in every perspective and never trained on.  Windows hold ``window``
    turn numbers, and where more rows than that share them (ties, null turns)
    are cut further, in order of turn, speaker and text; a dialogue of at most
    ``window`` turns is whole.  What ``context`` says in the first window before
    any participant speaks is the opening; it is repeated at the head of each
    later one.  Rows that repeat as a whole count once.  Null texts are empty,
    null turns come first in a window of their own, null speakers are named
    ``unknown``, and a null conv_id is a dialogue of its own.  Markup inside
    names and texts loses its ``<|``.  A dialogue without participants gives no
    row, an empty table none.  Extra columns are not read.

    Returns conv_id, window, part, participant, n_messages, n_trained,
    messages array<struct<role, name, content, train>>, text, and
    mask array<struct<start, end>> (character ranges of text to learn).
    """
    clean = lambda c: F.replace(c, F.lit(OPEN), F.lit("< |"))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        clean(F.coalesce(F.col(speaker).cast("string"), F.lit("unknown"))).alias("name"),
        clean(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("content"),
    ).distinct().withColumn("window", F.coalesce(F.floor(F.col("turn") / window), F.lit(-1)))
    order = Window.partitionBy("conv_id", "window").orderBy("turn", "name", "content")
    rows = rows.withColumn("part", F.floor((F.row_number().over(order) - 1) / window))
    seen = rows.groupBy("conv_id", "window", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "name", "content"))).alias("m"))
    names = F.array_sort(F.array_except(F.array_distinct(F.col("m.name")), F.array(*map(F.lit, context))))
    known = ", ".join(f"'{c}'" for c in context)
    spoke = f"array_position(transform(m, x -> x.name NOT IN ({known})), true)"
    opening = F.expr(f"IF({spoke} > 0, slice(m, 1, CAST({spoke} - 1 AS INT)), m)")
    #: Equal sets of speakers are collected once, however many windows a dialogue has.
    per = seen.groupBy(F.col("conv_id").alias("of")).agg(F.array_distinct(F.flatten(F.collect_set(names))).alias("who"), F.min(F.struct("window", "part")).alias("start"), F.min_by(opening, F.struct("window", "part")).alias("opening"))
    each = seen.join(per, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("m", F.when(F.struct("window", "part") == F.col("start"), F.col("m")).otherwise(F.concat("opening", "m")))
    each = each.withColumn("participant", F.explode("who"))

    role = f"CASE WHEN x.name IN ({known}) THEN x.name WHEN x.name = participant THEN 'assistant' ELSE 'user' END"
    messages = F.expr(f"transform(m, x -> named_struct('role', {role}, 'name', x.name, 'content', x.content, 'train', x.name = participant))")
    each = each.select("conv_id", "window", "part", "participant", messages.alias("messages"))
    head = f"concat('{OPEN}', x.role, IF(x.role = 'user', concat('{NAME}', x.name), ''), '|>\\n')"
    each = each.withColumn("heads", F.expr(f"transform(messages, x -> {head})")).withColumn("parts", F.expr(f"transform(messages, x -> concat({head}, x.content, '<|end|>\\n'))"))
    #: Where each message begins: running sums of the lengths before it.
    each = each.withColumn("begins", F.expr("aggregate(parts, array(0), (s, p) -> concat(s, array(element_at(s, -1) + length(p))))"))
    mask = F.expr("filter(transform(messages, (x, i) -> IF(x.train, named_struct('start', begins[i] + length(heads[i]), 'end', begins[i + 1] - 1), NULL)), s -> s IS NOT NULL)")
    return each.select("conv_id", "window", "part", "participant", F.size("messages").alias("n_messages"), F.size(F.filter("messages", lambda x: x["train"])).alias("n_trained"), "messages", F.array_join("parts", "").alias("text"), mask.alias("mask"))
