"""Chat formatting by perspective rotation: each participant's view of a dialogue, by expressions alone.

For every participant of a conversation (each role but the system's) the turns are rendered in order with that speaker as
`assistant`, the others as `user` with their name, system turns as `system`. `mask` has the ranges [first, end) of
characters to train on: the assistant's texts with their end marks.

A conversation of up to SPAN turns is one sample a participant. A longer one is cut after every SPAN turns, whatever
their numbers, into parts: every participant of the whole conversation has a view of every part, and parts behind that of
the conversation's first system turn begin with it. So no sample grows with the conversation, every turn is in a view of
every participant once, and who spoke only early or late still sees all. The turns of longer conversations are numbered
over all of them together, not a conversation a task.

A null text is empty, a null role is the participant `unknown`, null conversations and turns are kept (turns without a
number come first). Repeated turns are rendered each time, in the order of role and text; a conversation of system turns
alone has no participant and gives nothing; an empty table gives an empty one; only the four columns named are read, so
others can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ranking import ranked
from tidelog.storage import written

#: Turns of a sample, without the system turn that it may begin with.
SPAN = 512


def _parts(turns: DataFrame, long: DataFrame, span: int) -> DataFrame:
    """conv_id, part, ts, participant of the conversations of more than `span` turns."""
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    some = turns.join(long, same(turns, long), "left_semi")
    placed = ranked(some, [("conv_id", True), ("turn", True), ("role", True), ("text", True)], "place")
    firsts = placed.groupBy("conv_id").agg(
        F.min("place").alias("first"),
        F.min_by(F.struct("place", "turn", "role", "text"), F.when(F.col("role") == "system", F.col("place"))).alias("prompt"),
    )
    # written first: a join of two plain exchanges, of which the engine can split a long conversation
    firsts = written(firsts, "firsts").withColumnRenamed("conv_id", "of")
    numbered = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("part", F.expr(f"(place - first) div {span}"))
    t = F.struct("turn", "role", "text")
    parts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(t)).alias("ts"), F.first(F.expr("if((prompt.place - first) div {} < part, prompt, null)".format(span))).alias("prompt"))
    carried = F.expr("if(prompt is null, ts, concat(array(struct(prompt.turn as turn, prompt.role as role, prompt.text as text)), ts))")
    speakers = some.where("role <> 'system'").select(F.col("conv_id").alias("of"), F.col("role").alias("participant")).distinct()
    return parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "part", carried.alias("ts"), "participant")


def rotations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN) -> DataFrame:
    """Per conversation, participant and part: conv_id, participant, part, n_turns, n_own, rendered, mask, mask_chars."""
    turns = df.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    long = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > span), "long")
    any_long = bool(long.limit(1).count())
    rest = turns.join(long, turns["conv_id"].eqNullSafe(long["conv_id"]), "left_anti") if any_long else turns
    whole = rest.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    speakers = F.expr("array_sort(array_distinct(transform(filter(ts, x -> x.role <> 'system'), x -> x.role)))")
    views = whole.select("conv_id", F.lit(0).cast("bigint").alias("part"), "ts", F.explode(speakers).alias("participant"))
    if any_long:
        views = views.unionByName(_parts(turns, long, span))
    # head, body and end of each turn as this participant sees it
    seen = """transform(ts, x -> struct(
        case when x.role = participant then '<|assistant|>\n' when x.role = 'system' then '<|system|>\n'
             else concat('<|user name=', x.role, '|>\n') end as head,
        concat(x.text, '<|end|>\n') as body, x.role = participant as own))"""
    views = views.select("conv_id", "part", "participant", F.explode(F.array(F.expr(seen))).alias("vs"))
    mask = """aggregate(vs, struct(0 as at, cast(array() as array<struct<first: int, end: int>>) as spans),
        (a, v) -> struct(a.at + length(v.head) + length(v.body) as at,
            if(v.own, concat(a.spans, array(struct(a.at + length(v.head) as first, a.at + length(v.head) + length(v.body) as end))), a.spans) as spans),
        a -> a.spans)"""
    return views.select(
        "conv_id",
        "participant",
        "part",
        F.size("vs").cast("bigint").alias("n_turns"),
        F.expr("cast(size(filter(vs, v -> v.own)) as bigint)").alias("n_own"),
        F.expr("array_join(transform(vs, v -> concat(v.head, v.body)), '')").alias("rendered"),
        F.expr(mask).alias("mask"),
        F.expr("aggregate(vs, 0L, (n, v) -> n + if(v.own, length(v.body), 0))").alias("mask_chars"),
    )
