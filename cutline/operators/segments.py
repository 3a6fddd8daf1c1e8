"""Cutting ordered series into contiguous half-open segments.

Every function takes the columns that name a series as ``keys``. Tables: *cuts* (keys, pos); *info* (keys, n_elements); *segments* (keys, seg_idx, start, end, ...);
*overrides* (keys, start, end, ...). Positions are whole numbers from 0 and ends are exclusive. What can run as a window over a series does; windows are partitioned by series, so a
table of many series spreads well. For very long series the functions with ``split`` take cells (``long.cells``) and run over those; without, one very long series is one task's sort. The two walks over ordered elements (``spaced``, ``guided_splits``) stream through partitions that
are sorted by series and position: nothing of a series is gathered but, for a segment that must be split, its own scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.session import sound_unions
from cutline.staging import staged

from . import long


def _series(keys: Sequence[str], order: str = "start"):
    return Window.partitionBy(*keys).orderBy(order)


# Slices


def every_nth(df: DataFrame, n: int, pos: str = "pos", start: int = 0) -> DataFrame:
    """Every n-th element (1 to 4), from start on."""
    if n not in (1, 2, 3, 4):
        raise ValueError("the sampling rate must be 1 to 4")
    return df.filter((F.col(pos) >= start) & ((F.col(pos) - start) % n == 0))


def between(df: DataFrame, start: int, end: int, pos: str = "pos") -> DataFrame:
    """Elements of [start, end)."""
    return df.filter((F.col(pos) >= start) & (F.col(pos) < end))


# Boundaries and segments


def from_cuts(cuts: DataFrame, info: DataFrame, keys: Sequence[str], pos: str = "pos", split: long.Cells | None = None) -> DataFrame:
    """Contiguous segments that cover each series: a segment from 0 and from each cut inside the series to the next."""
    keys = list(keys)
    inside = cuts.select(*keys, F.col(pos).alias("start")).join(info, keys).filter((F.col("start") > 0) & (F.col("start") < F.col("n_elements")))
    begins = inside.unionByName(info.filter("n_elements > 0").select(*keys, F.lit(0).cast("long").alias("start"), "n_elements")).distinct()
    sound_unions(cuts.sparkSession)
    found = long.running(begins, keys, ["start"], {"_row": ("row",), "_next": ("next", F.col("start"))}, split)
    return found.select(*keys, (F.col("_row") - 1).alias("seg_idx"), "start", F.coalesce("_next", "n_elements").alias("end"))


def gaps_filled(overrides: DataFrame, info: DataFrame, keys: Sequence[str], split: long.Cells | None = None) -> DataFrame:
    """overrides and, with nulls in their columns, the stretches between, before and after them."""
    keys = list(keys)
    marked = long.running(overrides, keys, ["start"], {"_before": ("max_before", F.col("end"))}, split).withColumn("_before", F.coalesce("_before", F.lit(0).cast("long")))
    before = marked.filter(F.col("start") > F.col("_before")).select(*keys, F.col("_before").alias("start"), F.col("start").alias("end"))
    last = overrides.groupBy(*keys).agg(F.max("end").alias("_last"))
    after = info.join(last, keys, "left").select(*keys, F.coalesce("_last", F.lit(0).cast("long")).alias("start"), F.col("n_elements").alias("end")).filter("start < end")
    return overrides.unionByName(before.unionByName(after), allowMissingColumns=True)


def overlaps(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals that reach into the next one, with where it starts."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return intervals.withColumn("next_start", F.lead("start").over(w)).filter("end > next_start")


def breaks(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments that do not end where the next one starts."""
    return segments.withColumn("next_start", F.lead("start").over(_series(keys))).filter("end != next_start")


def checked(overrides: DataFrame, info: DataFrame, keys: Sequence[str], base_kind: Column | None = None, groups: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(overrides, rejects with a reason): ends after starts, inside the series; a change of kind needs a compatible kind and ``reset``.

    groups maps a column of kinds to the format it writes; base_kind is the series' own kind.
    """
    joined = overrides.join(info, list(keys))
    reason = F.when(F.col("start") >= F.col("end"), "start must be before end").when((F.col("start") >= F.col("n_elements")) | (F.col("end") > F.col("n_elements")), "past the end of the series")
    if base_kind is not None:
        if groups is not None:
            reason = reason.when(F.element_at(groups, F.col("kind")) != F.element_at(groups, base_kind), "incompatible format")
        reason = reason.when((F.col("kind") != base_kind) & ~F.col("reset"), "change of kind without reset")
    marked = joined.withColumn("reject_reason", reason).drop("n_elements")
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


# Interval joins


def attached(elements: DataFrame, overrides: DataFrame, keys: Sequence[str], pos: str = "pos", width: int | None = None) -> DataFrame:
    """elements with the columns of the override that holds them, else nulls; overrides of a series must not overlap.

    Without width: an equi join on the series with the range as a further condition, right while a series has few overrides. With width: both sides
    are dealt by ``pos div width`` too, so a series with very many overrides does not pair each element with all of them.
    """
    keys = list(keys)
    columns = [c for c in overrides.columns if c not in (*keys, "start", "end")]
    o = overrides.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("start").alias("override_start"), F.col("end").alias("override_end"), *columns)
    same = (F.col("override_start") <= F.col(pos)) & (F.col(pos) < F.col("override_end"))
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    e = elements
    if width:
        o = o.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("override_start") / width), F.floor((F.col("override_end") - 1) / width))))
        e = elements.withColumn("_at", F.floor(F.col(pos) / width))
        same = same & (F.col("_at") == F.col("_cell"))
    return e.join(o, same, "left").drop(*(f"_k{i}" for i in range(len(keys))), *(("_cell", "_at") if width else ()))


def layered(df: DataFrame, fields: dict[str, Column], defaults: dict[str, Column], reset: str = "reset", kept: Sequence[str] = ()) -> DataFrame:
    """df with ``effective_<field>``: the override's value, else the inherited one, else the default. Where reset is true the inherited value is dropped, but for the fields in kept."""
    base = lambda f: fields[f] if f in kept else F.when(~F.coalesce(F.col(reset), F.lit(False)), fields[f])
    return df.select("*", *(F.coalesce(F.col(f), base(f), defaults[f]).alias(f"effective_{f}") for f in fields))


def merged_options(base: Column, override: Column, reset: Column) -> Column:
    """Option maps: the override's keys replace the inherited ones; reset drops all inherited."""
    empty = F.create_map().cast("map<string,string>")
    over, below = F.coalesce(override, empty), F.when(F.coalesce(reset, F.lit(False)), empty).otherwise(F.coalesce(base, empty))
    return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(over, k)), over)


def within_spans(segments: DataFrame, key_positions: DataFrame, info: DataFrame, keys: Sequence[str], split: long.Cells | None = None) -> DataFrame:
    """Segments that lie inside a span from one key position to the next, with span_start, span_end and start, end counted from the span's start."""
    keys = list(keys)
    spans = long.running(key_positions.select(*keys, "pos").join(info, keys), keys, ["pos"], {"_next": ("next", F.col("pos"))}, split).select(*keys, F.col("pos").alias("start"), F.coalesce("_next", "n_elements").alias("end"))
    found = long.swept(segments, spans, keys, "start", split).withColumnsRenamed({"override_start": "span_start", "override_end": "span_end"})
    held = found.filter("end <= span_end")
    return held.withColumn("rel_start", F.col("start") - F.col("span_start")).withColumn("rel_end", F.col("end") - F.col("span_start"))


def key_starts(key_positions: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key positions that are starts of segments."""
    keys = list(keys)
    return key_positions.join(segments.select(*keys, F.col("start").alias("pos")), [*keys, "pos"], "left_semi")


def concat_offsets(parts: DataFrame, keys: Sequence[str], order: str, last_pos: str) -> DataFrame:
    """parts with ``offset``, where each one starts when they are laid end to end. Without keys the parts are one series: one row a part."""
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(F.col(last_pos) + 1).over(w), F.lit(0)))


# Detection


def scalar_costs(df: DataFrame, keys: Sequence[str], pos: str, value: str, threshold: Column, split: long.Cells | None = None) -> DataFrame:
    """Cost of a cut before each element: how far its value is from the one before; nothing before the first."""
    paired = long.running(df, keys, [pos], {"_before": ("previous", F.col(value))}, split)
    return paired.select(*keys, F.col(pos).alias("pos"), F.abs(F.col(value) - F.col("_before")).alias("inter_cost"), threshold.alias("threshold"))


def vector_costs(df: DataFrame, keys: Sequence[str], pos: str, vector: str, threshold: Column) -> DataFrame:
    """The same for vectors: their Euclidean distance."""
    before = F.lag(vector).over(_series(keys, pos))
    squares = F.zip_with(F.col(vector), F.col("_before"), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    paired = df.withColumn("_before", before)
    cost = F.when(F.col("_before").isNotNull(), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))
    return paired.select(*keys, F.col(pos).alias("pos"), cost.alias("inter_cost"), threshold.alias("threshold"))


def candidates(costs: DataFrame) -> DataFrame:
    return costs.filter("inter_cost >= threshold")


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _positions(batch: pa.RecordBatch, keys: list[str], rows: list[int], pos: list[int]) -> pa.RecordBatch:
    """The keys of some rows of a batch, with positions of one's own."""
    taken = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_pydict({k: batch.column(k).take(taken) for k in keys} | {"pos": pa.array(pos, pa.int64())})


def spaced(cuts: DataFrame, keys: Sequence[str], min_len: str = "min_len", start: str = "scope_start") -> DataFrame:
    """Cuts that are at least min_len after the last accepted one, or after the start of their scope.

    cuts: keys (with the scope), pos, and min_len and start, the same for all cuts of a scope. One walk over each sorted partition; only the last accepted cut is held.
    """
    keys = list(keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, last = None, 0
        for batch in batches:
            rows, kept = [], []
            columns = [batch.column(c).to_pylist() for c in (*keys, "pos", min_len, start)]
            for i, (*key, pos, least, begin) in enumerate(zip(*columns, strict=True)):
                if key != scope:
                    scope, last = key, begin
                if pos - last >= least:
                    rows.append(i)
                    kept.append(pos)
                    last = pos
            yield _positions(batch, keys, rows, kept)

    chosen = cuts.select(*dict.fromkeys([*keys, min_len, start]), F.col("pos").cast("bigint").alias("pos"))  # the scope's start may be a key
    return chosen.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(walk, f"{_key_fields(cuts, keys)}, pos bigint")


def detected(costs: DataFrame, info: DataFrame, keys: Sequence[str], min_len: int, overrides: DataFrame | None = None) -> DataFrame:
    """Segments by change points. Detection starts anew at every border of an override, which is a cut itself, with the override's own min_len."""
    keys = list(keys)
    if overrides is None:
        scopes = info.select(*keys, F.lit(0).cast("long").alias("start"), F.col("n_elements").alias("end"), F.lit(None).cast("long").alias("min_len"))
    else:
        scopes = gaps_filled(overrides, info, keys).select(*keys, "start", "end", "min_len")
    placed = attached(candidates(costs), scopes, keys).filter("override_start is not null").withColumn("min_len", F.coalesce("min_len", F.lit(min_len)))
    kept = spaced(placed.filter(F.col("pos") > F.col("override_start")), [*keys, "override_start"], "min_len", "override_start")
    borders = scopes.filter("start > 0").select(*keys, F.col("start").alias("pos"))
    return from_cuts(kept.select(*keys, "pos").unionByName(borders), info, keys)


def forced(segments: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(segments cut at further positions, cuts outside every segment). A cut on a border changes nothing; columns of a segment go to all its pieces."""
    keys = list(keys)
    places = cuts.select(*keys, F.col("pos").alias("_pos")).distinct()
    split = segments.join(places, keys).filter("_pos > start and _pos < end").select(*keys, "start", "_pos")
    pieces = segments.join(split.groupBy(*keys, "start").agg(F.sort_array(F.collect_list("_pos")).alias("_at")), [*keys, "start"], "left")
    begins = F.concat(F.array("start"), F.coalesce("_at", F.array().cast("array<bigint>")))
    ends = F.concat(F.coalesce("_at", F.array().cast("array<bigint>")), F.array("end"))
    others = [c for c in segments.columns if c not in (*keys, "start", "end", "seg_idx")]
    cut = pieces.select(*keys, F.explode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("p"), *others).select(*keys, F.col("p.b").alias("start"), F.col("p.e").alias("end"), *others)
    length = segments.groupBy(*keys).agg(F.max("end").alias("_n"))
    outside = places.join(length, keys, "left").filter("_n is null or _pos >= _n or _pos < 0").select(*keys, F.col("_pos").alias("pos"), F.lit("outside the series").alias("reject_reason"))
    return numbered(cut, keys), outside


def numbered(segments: DataFrame, keys: Sequence[str], split: long.Cells | None = None) -> DataFrame:
    """Segments with seg_idx in their order."""
    found = long.running(segments.drop("seg_idx"), keys, ["start"], {"_row": ("row",)}, split)
    return found.withColumn("seg_idx", F.col("_row") - 1).drop("_row")


# Maximum length


def even_splits(segments: DataFrame, keys: Sequence[str], max_len: Column) -> DataFrame:
    """Segments longer than max_len in equal pieces, ``len div max_len + 1`` of them; null or 0 sets no limit. No shuffle but for the numbering."""
    n = F.col("end") - F.col("start")
    pieces = F.when((max_len > 0) & (n > max_len), F.floor(n / max_len) + 1).otherwise(F.lit(1))
    border = lambda i: F.col("start") + F.floor(F.col("_n") * (i / F.col("_k")))
    cut = segments.withColumn("_n", n).withColumn("_k", pieces.cast("long")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    ends = F.when(F.col("_i") == F.col("_k"), F.col("end")).otherwise(border(F.col("_i")))
    split = cut.withColumn("_b", border(F.col("_i") - 1)).withColumn("end", ends.cast("long")).withColumn("start", F.col("_b").cast("long"))
    return numbered(split.drop("_n", "_k", "_i", "_b"), keys)


def guided_cuts(start: int, end: int, limit: int, at: np.ndarray, scores: np.ndarray) -> list[int]:
    """Cut positions of one segment: each cut where the score, weighted by nearness to an even piece, is best; ties go to the larger piece.

    at, scores: positions, ascending, and their scores. Without any score in reach the even piece is taken. Weighted scores are compared rounded to four decimals, halves up.
    """
    cuts = []
    while end - start > limit:
        rest = end - start
        middle = max(1, rest // (rest // limit + 1))
        least, most = max(1, middle // 2), min(limit, middle + middle // 2)
        width = max(1, most - middle // 2)
        a, b = np.searchsorted(at, [start + least, start + most + 1])
        piece = middle
        if a < b:
            size = at[a:b] - start
            weighted = np.floor(np.nan_to_num(scores[a:b] * (1 - np.abs(middle - size) / width)) * 10000 + 0.5)
            piece = int(size[len(size) - 1 - int(weighted[::-1].argmax())])
        start += piece
        cuts.append(start)
    return cuts


def guided_splits(segments: DataFrame, costs: DataFrame, keys: Sequence[str], max_len: Column) -> DataFrame:
    """Segments longer than max_len cut where costs are high for their threshold; an element without cost, or with a threshold of 0, has no score.

    Segments and scores of a series meet in one sorted partition; the walk holds the scores of the segment it is in.
    """
    keys = list(keys)
    limited = segments.withColumn("_limit", max_len.cast("long"))
    long = limited.filter((F.col("_limit") > 0) & (F.col("end") - F.col("start") > F.col("_limit")))
    scores = costs.withColumn("_score", F.try_divide("inter_cost", "threshold")).filter("_score is not null")
    none = lambda kind: F.lit(None).cast(kind)
    rows = long.select(*keys, F.col("start").cast("long").alias("_at"), F.col("end").cast("long").alias("_end"), "_limit", none("double").alias("_score")).unionByName(
        scores.select(*keys, F.col("pos").cast("long").alias("_at"), none("long").alias("_end"), none("long").alias("_limit"), F.col("_score").cast("double").alias("_score"))
    )
    sound_unions(segments.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, segment, at, found = None, None, [], []
        kept: pa.RecordBatch | None = None  # a row with the segment's keys

        def cut() -> pa.RecordBatch:
            cuts = guided_cuts(*segment, np.array(at, np.int64), np.array(found))
            return _positions(kept, keys, [0] * len(cuts), cuts)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "_at", "_end", "_limit", "_score")]
            for i, (*key, pos, end, limit, score) in enumerate(zip(*columns, strict=True)):
                if segment and (key != series or pos >= segment[1]):
                    yield cut()
                    segment = None
                if end is not None:
                    series, segment, at, found, kept = key, (pos, end, limit), [], [], batch.slice(i, 1)
                elif segment and pos > segment[0]:
                    at.append(pos)
                    found.append(score)
        if segment:
            yield cut()

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_at", F.col("_end").asc_nulls_first())
    return forced(segments, ordered.mapInArrow(walk, f"{_key_fields(segments, keys)}, pos bigint"), keys)[0]


def bounded(segments: DataFrame, keys: Sequence[str], max_len: Column, costs: DataFrame | None = None) -> DataFrame:
    """Splits by score for series that have scores, even splits for the others."""
    keys = list(keys)
    if costs is None:
        return even_splits(segments, keys, max_len)
    scored = costs.filter("inter_cost is not null").select(*keys).distinct().withColumn("_scored", F.lit(True))
    marked = segments.join(scored, keys, "left")
    guided = guided_splits(marked.filter("_scored"), costs, keys, max_len)
    sound_unions(segments.sparkSession)
    return guided.unionByName(even_splits(marked.filter("_scored is null"), keys, max_len), allowMissingColumns=True).drop("_scored")


def segment(info: DataFrame, keys: Sequence[str], costs: DataFrame | None, min_len: int, max_len: int, overrides: DataFrame | None = None, cuts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments before, segments after the splits for length): detection or overrides only, forced cuts, then maximum lengths.

    An override's own max_len wins, and an override without one is never split; max_len 0 sets no limit outside overrides.
    """
    keys = list(keys)
    if costs is not None:
        found = detected(costs, info, keys, min_len, overrides)
    elif overrides is not None:
        found = numbered(gaps_filled(overrides, info, keys), keys).select(*keys, "seg_idx", "start", "end")
    else:
        found = from_cuts(info.select(*keys, F.lit(0).alias("pos")), info, keys)
    if cuts is not None:
        found = forced(found, cuts, keys)[0]
    limit = F.lit(max_len)
    if overrides is not None:
        found = attached(found, overrides.select(*keys, "start", "end", F.col("max_len").alias("_own")), keys, "start").withColumn("_limit", F.when(F.col("override_start").isNotNull(), F.col("_own")).otherwise(limit)).drop("override_start", "override_end", "_own")
    else:
        found = found.withColumn("_limit", limit)
    found = staged(found, "segments")  # what follows reads both several times
    costs = costs if costs is None else staged(costs, "costs")
    split = bounded(found, keys, F.col("_limit"), costs).drop("_limit")
    return found.drop("_limit").select(*keys, "seg_idx", "start", "end"), split.select(*keys, "seg_idx", "start", "end")

