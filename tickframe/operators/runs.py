"""Phases, counters and the one-row summary of a session.

Input is the tracker stream of ``schemas.TRACKER``. Only three phases exist, so a segment
of a session can be summarised without knowing the phase it began in: what happens before
its first dimension change is kept apart and credited once the entry phase is known. That
needs one shuffle of the stream, by (session, segment), however long the session is. The
same partial rows feed the streaming summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions import labels, scores
from tickframe.operators import segments
from tickframe.operators.segments import SEGMENT
from tickframe.schemas import MILESTONE_ADVANCEMENTS, RANKS_PER_TICK, RUN_SUMMARY

_SESSION = "session_id"
# Both are grouping keys: a text aggregate would keep Spark from aggregating by hash.
_KEYS = (_SESSION, "player_id")
_NETHER, _END = 1, 2

# Summed over segments once phases are resolved.
_SUMS = ("duration_ticks", "overworld_ticks", "nether_ticks", "end_ticks",
         "blaze_rods_used", "blaze_rods_collected", "blaze_kills", "pearls_used",
         "beds_used", "gold_traded", "deaths")
_FIRST_WINS = ("portal_build_tick", "dragon_enter_tick", *MILESTONE_ADVANCEMENTS.values())
_MILESTONES = (*_FIRST_WINS, "kill_tick")


def order_calls(stream: DataFrame) -> DataFrame:
    """Adds ``at``, which sorts calls by tick and then by their rank within the tick."""
    return stream.withColumn("at", F.col("tick") * RANKS_PER_TICK + F.col("rank"))


# The rules of the tracker as SQL over one call; every use below shares these texts.
_IS_TICK = "kind = 'TICK'"
_NEW_PHASE = """CASE WHEN kind = 'DIMENSION' THEN
  CASE name WHEN 'minecraft:the_nether' THEN 1Y WHEN 'minecraft:the_end' THEN 2Y ELSE 0Y END END"""
_BED = "IF(kind = 'PLACED' AND endswith(name, '_bed'), 1L, 0L)"


def _lost(item: str) -> str:
    return f"IF(kind = 'INVENTORY' AND name = '{item}' AND delta < 0, CAST(-delta AS BIGINT), 0L)"


_GOLD = _lost("minecraft:gold_ingot")
# Counters that do not depend on the phase.
_PLAIN = {
    "blaze_rods_used": _lost("minecraft:blaze_rod"),
    "blaze_rods_collected": "IF(kind = 'INVENTORY' AND name = 'minecraft:blaze_rod' AND delta >= 0, "
                            "CAST(delta AS BIGINT), 0L)",
    "blaze_kills": "IF(kind = 'KILLED' AND name = 'minecraft:blaze', 1L, 0L)",
    "pearls_used": _lost("minecraft:ender_pearl"),
    "deaths": "IF(kind = 'DIED', 1L, 0L)",
    "gold_given": "IF(kind = 'TRADE', CAST(delta AS BIGINT), 0L)",
}


def _stamp(condition: str, ticks_per_row: int) -> str:
    """Ticks counted so far in the segment at the calls that stamp a milestone, else null."""
    return f"IF({condition}, _counted * {ticks_per_row}, NULL)"


def _first_wins(ticks_per_row: int) -> dict[str, str]:
    stamps = {
        "portal_build_tick": "kind = 'DIMENSION' AND name = 'minecraft:the_nether'",
        "dragon_enter_tick": "kind = 'DIMENSION' AND name = 'minecraft:the_end'",
        **{column: f"kind = 'ADVANCEMENT' AND name = '{advancement}'"
           for advancement, column in MILESTONE_ADVANCEMENTS.items()},
    }
    return {n: _stamp(c, ticks_per_row) for n, c in stamps.items()}


def _kill(ticks_per_row: int) -> str:
    return _stamp("kind = 'KILLED' AND name = 'minecraft:ender_dragon'", ticks_per_row)


def _exprs(*texts: str) -> list[Column]:
    return [F.expr(t) for t in texts]


def attribute_phase(stream: DataFrame, width: int | None = None) -> DataFrame:
    """Adds the phase in force at each call (J5); the overworld before any change."""
    ordered = order_calls(stream)
    span = None if width is None else width * RANKS_PER_TICK
    span = segments.SEGMENT_TICKS * RANKS_PER_TICK if span is None else span
    known = segments.as_of(ordered, _KEYS, "at", {"_code": F.expr(_NEW_PHASE)}, span)
    return known.select(
        *stream.columns, labels.phase_name(F.coalesce("_code", F.lit(0))).alias("phase"))


def _locally_phased(segmented: DataFrame) -> DataFrame:
    """Adds the phase set so far within the segment, null before its first change, and the ticks counted so far."""
    w = segments.segment_window(_KEYS, "at").rowsBetween(Window.unboundedPreceding, 0)
    return segmented.withColumns({"_phase": F.last(F.expr(_NEW_PHASE), ignorenulls=True).over(w),
                                  "_counted": F.count_if(F.expr(_IS_TICK)).over(w)})


def segment_partials(stream: DataFrame, ticks_per_row: int = 1,
                     width: int | None = None, by: str | None = None,
                     also: tuple[str, ...] = ()) -> DataFrame:
    """One mergeable row per (session, segment).

    ``by`` names an existing column to use as the segment, such as ``chunk_index``; ``also``
    lists further aggregates to keep per segment.
    """
    ordered = order_calls(stream)
    if by is None:
        segmented = segments.add_segment(ordered, "tick", width)
    else:
        segmented = ordered.withColumn(SEGMENT, F.col(by).cast("long"))
    ticks = {
        "duration_ticks": _IS_TICK,
        "entry_ticks": f"_phase IS NULL AND {_IS_TICK}",
        "overworld_ticks": f"_phase = 0 AND {_IS_TICK}",
        "nether_ticks": f"_phase = {_NETHER} AND {_IS_TICK}",
        "end_ticks": f"_phase = {_END} AND {_IS_TICK}",
    }
    sums = {
        **_PLAIN,
        "entry_gold": f"IF(_phase IS NULL, {_GOLD}, 0L)",
        "nether_gold": f"IF(_phase = {_NETHER}, {_GOLD}, 0L)",
        "entry_beds": f"IF(_phase IS NULL, {_BED}, 0L)",
        "end_beds": f"IF(_phase = {_END}, {_BED}, 0L)",
    }
    return _locally_phased(segmented).groupBy(*_KEYS, SEGMENT).agg(*_exprs(
        *[f"count_if({c}) * {ticks_per_row} AS {n}" for n, c in ticks.items()],
        *[f"sum({v}) AS {n}" for n, v in sums.items()],
        *[f"min({v}) AS {n}" for n, v in _first_wins(ticks_per_row).items()],
        f"max({_kill(ticks_per_row)}) AS kill_tick",
        f"max_by({_NEW_PHASE}, IF(kind = 'DIMENSION', at, NULL)) AS exit_phase",
        "max(kind = 'END') AS ended",
        *also,
    ))


def resolve_partials(partials: DataFrame) -> DataFrame:
    """Credits what preceded a segment's first change to the phase the segment began in.

    Milestones are counted from the session's start then: a segment's own ticks follow those of earlier ones.
    """
    earlier = (Window.partitionBy(*_KEYS).orderBy(SEGMENT)
               .rowsBetween(Window.unboundedPreceding, -1))
    entered = F.coalesce(F.last("exit_phase", ignorenulls=True).over(earlier), F.lit(0))
    counted = F.coalesce(F.sum("duration_ticks").over(earlier), F.lit(0))

    def credit(total: str, share: str, phase: int) -> str:
        return f"{total} + IF(entry_phase = {phase}, {share}, 0L)"

    return partials.withColumns({"entry_phase": entered, "entry_count": counted}).select(
        *_KEYS, SEGMENT, "entry_phase", "entry_count",
        "duration_ticks", "blaze_rods_used", "blaze_rods_collected", "blaze_kills",
        "pearls_used", "deaths", *_exprs(
            *[f"{n} + entry_count AS {n}" for n in _MILESTONES],
            credit("overworld_ticks", "entry_ticks", 0) + " AS overworld_ticks",
            credit("nether_ticks", "entry_ticks", _NETHER) + " AS nether_ticks",
            credit("end_ticks", "entry_ticks", _END) + " AS end_ticks",
            credit("gold_given + nether_gold", "entry_gold", _NETHER) + " AS gold_traded",
            credit("end_beds", "entry_beds", _END) + " AS beds_used"))


def fold_partials(partials: DataFrame) -> DataFrame:
    """Session totals from segment partials; milestones that never happened are null."""
    return resolve_partials(partials).groupBy(*_KEYS).agg(*_exprs(
        *[f"sum({n}) AS {n}" for n in _SUMS],
        *[f"min({n}) AS {n}" for n in _FIRST_WINS],
        "max(kill_tick) AS kill_tick"))


def session_totals(stream: DataFrame, ticks_per_row: int = 1, width: int | None = None) -> DataFrame:
    return fold_partials(segment_partials(stream, ticks_per_row, width))


def finish_summary(totals: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The 30-column run summary.

    ``sessions`` brings ``started_at_ms`` and ``mod_version`` per ``session_id`` (J10);
    without it they are null.
    """
    if sessions is not None:
        totals = totals.join(sessions.select(_SESSION, "started_at_ms", "mod_version"),
                             _SESSION, "left")
    else:
        totals = totals.select("*", F.lit(None).cast("long").alias("started_at_ms"),
                               F.lit(None).cast("string").alias("mod_version"))
    never = F.lit(-1).cast("long")
    kill = F.coalesce("kill_tick", never)
    result = scores.outcome(kill, F.col("deaths"))
    derived = {
        "run_id": scores.run_id(F.col(_SESSION), F.col("player_id")),
        "category": F.lit("any_percent"),
        "completed": result == "win",
        "outcome": result,
        # The format has the column but nothing ever stamps it.
        "stronghold_enter_tick": never,
        "efficiency_score": scores.efficiency_score(
            F.col("blaze_rods_used"), F.col("pearls_used"), F.col("deaths")),
        "nether_score": scores.nether_score(F.col("nether_ticks")),
        "seed_quality": F.lit(-1),
        **{name: F.coalesce(name, never) for name in _MILESTONES},
    }
    return totals.select(*[derived.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
                           for f in RUN_SUMMARY])


def run_summary(stream: DataFrame, sessions: DataFrame | None = None,
                ticks_per_row: int = 1, width: int | None = None) -> DataFrame:
    return finish_summary(session_totals(stream, ticks_per_row, width), sessions)


def summary_json(summaries: DataFrame) -> DataFrame:
    """One JSON document per run with the summary's keys (K4)."""
    return summaries.select(_SESSION, F.to_json(
        F.struct(*summaries.columns), {"ignoreNullFields": "false"}).alias("json"))


def live_state(stream: DataFrame, ticks_per_row: int = 1, width: int | None = None) -> DataFrame:
    """Phase and running counters after each tick."""
    rows = _locally_phased(segments.add_segment(order_calls(stream), "tick", width))
    resolved = resolve_partials(segment_partials(stream, ticks_per_row, width))
    sums = [n for n in _SUMS if n not in ("duration_ticks", "blaze_rods_collected")]
    keys = ", ".join(_KEYS)
    before = (f"OVER (PARTITION BY {keys} ORDER BY {SEGMENT} "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    entry = resolved.select(*_KEYS, SEGMENT, "entry_phase", "entry_count", *_exprs(
        *[f"coalesce(sum({n}) {before}, 0L) AS _in_{n}" for n in sums],
        *[f"min({n}) {before} AS _in_{n}" for n in _FIRST_WINS],
        f"max(kill_tick) {before} AS _in_kill_tick"))
    phased = rows.join(entry, [*_KEYS, SEGMENT], "left").withColumns(
        {"_phase": F.coalesce("_phase", "entry_phase"),
         "_counted": F.col("_counted") + F.expr(f"entry_count div {ticks_per_row}")})
    tick = f"IF({_IS_TICK}, {ticks_per_row}L, 0L)"
    contribution = {
        "overworld_ticks": f"IF(_phase = 0, {tick}, 0L)",
        "nether_ticks": f"IF(_phase = {_NETHER}, {tick}, 0L)",
        "end_ticks": f"IF(_phase = {_END}, {tick}, 0L)",
        "gold_traded": f"IF(_phase = {_NETHER}, {_GOLD}, 0L) + {_PLAIN['gold_given']}",
        "beds_used": f"IF(_phase = {_END}, {_BED}, 0L)",
        **{n: _PLAIN[n] for n in ("blaze_rods_used", "blaze_kills", "pearls_used", "deaths")},
    }
    # Same clustering as the window above, so this aggregation adds no shuffle.
    per_tick = phased.groupBy(*_KEYS, SEGMENT, "tick").agg(*_exprs(
        "max_by(_phase, at) AS _phase",
        *[f"max(_in_{n}) AS _in_{n}" for n in (*sums, *_MILESTONES)],
        *[f"sum({contribution[n]}) AS {n}" for n in sums],
        *[f"min({v}) AS {n}" for n, v in _first_wins(ticks_per_row).items()],
        f"max({_kill(ticks_per_row)}) AS kill_tick"))
    upto = (f"OVER (PARTITION BY {keys}, {SEGMENT} ORDER BY tick "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return per_tick.select(
        _SESSION, "tick", labels.phase_name(F.col("_phase")).alias("phase"), *_exprs(
            *[f"sum({n}) {upto} + _in_{n} AS {n}" for n in sums],
            *[f"coalesce(least(min({n}) {upto}, _in_{n}), -1L) AS {n}" for n in _FIRST_WINS],
            f"coalesce(greatest(max(kill_tick) {upto}, _in_kill_tick), -1L) AS kill_tick",
            "-1L AS stronghold_enter_tick"))


def advancement_rows(updates: DataFrame) -> DataFrame:
    """One row per earned advancement of an update's ``earned`` map."""
    others = [c for c in updates.columns if c != "earned"]
    return updates.select(*others, F.explode(F.map_keys("earned")).alias("advancement"))
