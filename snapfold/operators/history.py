"""Week notes: a five-week window in the tracking table and a full-year archive beside it.

The archive is long: ``(key, opty, model, week, value)`` with one row per key and week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold import schema
from snapfold.functions import scalars as x
from snapfold.operators.skew import is_hot, lookup_join


def _week_name(week: int) -> str:
    return f"W{week:02d}"


def to_long(wide: DataFrame, ids, columns: dict[str, int]) -> DataFrame:
    """Wide week columns (name -> week) to rows, blank cells left out."""
    return wide.select(*ids, F.inline(_filled_cells(columns)))


def _filled_cells(columns: dict[str, int]) -> Column:
    """The filled week columns of a row as one list of ``(week, value)``, which is short where most cells are blank."""
    cells = F.array(*[
        F.when(~x.is_blank(f"`{c}`"), F.struct(F.lit(w).alias("week"), F.col(f"`{c}`").cast("string").alias("value")))
        for c, w in columns.items()
    ])
    return F.filter(cells, F.isnotnull)


def to_wide(history: DataFrame, ids=("key", "opty", "model"), weeks=schema.WEEKS, fill="") -> DataFrame:
    """Rows to columns ``W01`` to ``W53``: one short map per key instead of 53 aggregates."""
    by_week = F.map_from_entries(F.collect_list(F.struct("week", "value")))
    maps = history.groupBy(*ids).agg(by_week.alias("by_week"))
    return maps.select(*ids, *[
        F.coalesce(F.try_element_at("by_week", F.lit(w)), F.lit(fill)).alias(_week_name(w)) for w in weeks
    ])


def history_migrate(wide: DataFrame, order: str = "seq") -> DataFrame:
    """Stored wide archive of either layout to the long form.

    The newer layout names opportunity and model, and the key follows from them; the older
    one has only the key. A table with neither gives an empty archive. Of several rows with
    one key the first counts.
    """
    columns = set(wide.columns)
    if {"opty", "model"} <= columns:
        named = wide.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("opty", "model")})
        named = named.withColumn("key", x.composite_key("opty", "model"))
    elif "key" in columns:
        named = wide.withColumns({"opty": F.lit(""), "model": F.lit("")})
    else:
        return wide.sparkSession.createDataFrame([], schema.HISTORY_SCHEMA)
    weeks = {c: int(c[1:]) for c in wide.columns if c[:1] == "W" and c[1:].isdigit()}
    # a row is packed before rows of a key meet: 53 columns, most of them blank, are sorted and shuffled as a short list
    packed = named.select("key", order, F.struct("opty", "model", _filled_cells(weeks).alias("cells")).alias("row"))
    first = packed.groupBy("key").agg(F.min_by("row", order).alias("row"))
    return first.select("key", "row.opty", "row.model", F.inline("row.cells"))


def _note_weeks(master: DataFrame) -> dict[str, int]:
    names = {c: c.removeprefix("Week ").strip() for c in schema.week_columns(master.columns)}
    return {c: int(n) for c, n in names.items() if n.isdigit()}


def is_noted(master: DataFrame) -> Column:
    """Rows with at least one filled note."""
    noted = F.lit(False)
    for c in _note_weeks(master):
        noted = noted | ~x.is_blank(f"`{c}`")
    return noted


def any_rows(df: DataFrame) -> Column:
    """Whether a table has rows, as a scalar inside the plan."""
    return df.select(F.lit(1)).limit(1).agg(F.count("*")).scalar() > 0


def _merged_in_order(rows: DataFrame, known: DataFrame, last: dict[str, Column], first: dict[str, Column], also) -> DataFrame:
    """One row per key of ``rows``, which travel as they are, or of ``known``, which has one row per key of each kind.

    Rows are dealt out by key and sorted by it and ``seq``, so of ``last`` and ``first`` the cell met last or first counts. An
    aggregate that compares ``seq`` would hold it once for each of them, which is wider than the cells.
    """
    extra = [c for c in known.columns if c != "key"]
    both = rows.repartition("key").unionByName(known.select("key", F.struct(*extra).alias("__known")), allowMissingColumns=True)
    of_known = lambda c: F.col("__known")[c]
    cell = lambda c, e: F.coalesce(F.when(F.col("seq").isNotNull(), e), of_known(c))
    ordered = [
        *[F.last(cell(c, e), ignorenulls=True).alias(c) for c, e in last.items()],
        *[F.first(cell(c, e), ignorenulls=True).alias(c) for c, e in first.items()],
    ]
    others = [F.first(of_known(c), ignorenulls=True).alias(c) for c in extra if c not in last and c not in first]
    merged = both.sortWithinPartitions("key", "seq").groupBy("key").agg(F.struct(*also).alias("__own"), *ordered, *others)
    own = merged.schema["__own"].dataType.names
    return merged.withColumns({c: F.coalesce(F.col("__own")[c], F.col(c)) for c in own}).drop("__own")


def fold_notes(history: DataFrame, master: DataFrame, *also, hot: DataFrame | None = None) -> DataFrame:
    """One row per key of either table: names, the merged notes by week, and ``also``.

    The latest filled note of a key and week wins (by ``seq``) and any note wins over the
    archive; blanks never erase. Opportunity and model keep the archive's names, and are
    filled from the earliest noted row where it has none. ``also`` are further aggregates
    over the rows of a key, so that one shuffle of the tracking table serves them all. ``changed`` are the notes of which
    the archive has no equal row. ``hot`` may name the hot keys of ``master``. The result is dealt out by key, whatever
    the tables hold: a union of rows by key and one more grouping, where a full join would leave them in no known order.
    """
    def filled(c):
        return ~x.is_blank(f"`{c}`")

    weeks = _note_weeks(master)
    noted = is_noted(master)
    seq = F.col("seq")
    rows = master if also else master.filter(noted)
    names = {f"new_{c}": F.when(filled(c) & noted, F.col(c)) for c in ("opty", "model")}
    text = {f"n{w}": F.when(filled(c), F.col(f"`{c}`").cast("string")) for c, w in weeks.items()}
    per_key = (rows if hot is None else rows.filter(is_hot(hot, ["key"]))).groupBy("key").agg(
        *[F.max_by(e, F.when(e.isNotNull(), seq)).alias(n) for n, e in text.items()],
        *[F.min_by(e, F.when(e.isNotNull(), seq)).alias(n) for n, e in names.items()],
        *also,
    )
    note = "array<struct<week:int,value:string>>"
    # A key holds one entry per week at most, so its list stays short. What has no week is no note.
    stored = history.groupBy("key").agg(
        F.collect_list(F.when(F.col("week").isNotNull(), F.struct("week", "value"))).alias("stored"),
        F.max("opty").alias("old_opty"), F.max("model").alias("old_model"),
    )
    # at most one row of each table, whose columns the other lacks
    both = per_key.unionByName(stored, allowMissingColumns=True)
    if hot is None:
        merged = both.groupBy("key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c != "key"])
    else:
        merged = _merged_in_order(rows.filter(~is_hot(hot, ["key"])), both, text, names, also)
    none = F.array().cast(note)
    cell = lambda w: F.array(F.struct(F.lit(w).alias("week"), F.col(f"n{w}").alias("value")))
    notes = F.concat(none, *[F.when(F.col(f"n{w}").isNotNull(), cell(w)).otherwise(none) for w in weeks.values()])
    merged = merged.withColumn("fresh", F.when(~x.is_blank("key"), notes))
    fresh_notes, stored_notes = F.coalesce("fresh", none), F.coalesce("stored", none)
    fresh_weeks = fresh_notes["week"]
    # lists are gone through one by one, outside generated code, only where a week stands in both
    apart = ~F.arrays_overlap(stored_notes["week"], fresh_weeks)
    kept = F.when(apart, stored_notes).otherwise(
        F.filter(stored_notes, lambda n: ~F.array_contains(fresh_weeks, n["week"])))
    name = {c: F.coalesce(F.when(filled(f"old_{c}"), F.col(f"old_{c}")), F.col(f"new_{c}"), F.lit(""))
            for c in ("opty", "model")}
    extra = [c for c in per_key.columns
             if c not in ("key", "new_opty", "new_model", *[f"n{w}" for w in weeks.values()])]
    notes = F.concat(kept, fresh_notes)
    renamed = ~F.col("old_opty").eqNullSafe(name["opty"]) | ~F.col("old_model").eqNullSafe(name["model"])
    changed = F.when(apart, fresh_notes).otherwise(F.filter(fresh_notes, lambda n: ~F.array_contains(stored_notes, n)))
    return merged.select(
        "key", *[e.alias(c) for c, e in name.items()], notes.alias("notes"),
        F.when(renamed, notes).otherwise(changed).alias("changed"), *extra,
    )


def archive_rows(folded: DataFrame) -> DataFrame:
    """The archive in long form from :func:`fold_notes`."""
    return folded.select("key", "opty", "model", F.inline("notes"))


def archive_changes(folded: DataFrame) -> DataFrame:
    """Rows of the archive in long form that are new or different after :func:`fold_notes`."""
    return folded.select("key", "opty", "model", F.inline("changed"))


def left_rows(history: DataFrame, pipe: DataFrame) -> DataFrame:
    """Archive rows that :func:`history_semi` takes out: their key has left the pipe, which is not empty."""
    keys = pipe.select("key").distinct()
    return history.join(keys, "key", "left_anti").filter(any_rows(pipe))


def history_upsert(history: DataFrame, master: DataFrame) -> DataFrame:
    """Write the notes of a tracking table into the archive."""
    return archive_rows(fold_notes(history, master))


def window_values(history: DataFrame, weeks: list[int], names: list[str]) -> DataFrame:
    """One row per key: the archive's values of ``weeks`` under the column labels ``names``."""
    picked = history.filter(F.col("week").isin(*weeks))
    return picked.groupBy("key").agg(*[
        F.max(F.when(F.col("week") == w, x.strip("value"))).alias(n) for w, n in zip(weeks, names)
    ])


def apply_week_shift(master: DataFrame, history: DataFrame, weeks: list[int], shift: int,
                     known: Column | None = None) -> DataFrame:
    """Refill the note columns by position from the archive when the window has moved.

    Keys the archive does not know lose their notes, rows without a key keep theirs. An
    empty archive or fewer than five note columns leave the table as it is. ``known`` tells
    whether the archive has rows, where asking it would mean computing it twice.
    """
    names = schema.week_columns(master.columns)
    if shift == 0 or not weeks or len(names) < len(weeks):
        return master
    names = names[: len(weeks)]
    new = [f"__new{i}" for i in range(len(weeks))]
    values = window_values(history, weeks, new)
    known = any_rows(history) if known is None else known
    joined = lookup_join(master, values, ["key"])
    refill = known & ~x.is_blank("key")
    return joined.withColumns({
        old: F.when(refill, F.coalesce(F.col(n), F.lit(""))).otherwise(F.col(f"`{old}`"))
        for old, n in zip(names, new)
    }).drop(*new)


def week_columns_for_pipe(pipe: DataFrame, master: DataFrame, weeks: list[int]) -> DataFrame:
    """Note columns of the new window, by position from the last master row of the key."""
    old = schema.week_columns(master.columns)[: len(weeks)]
    picks = F.max_by(F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(old)]), "seq")
    found = master.groupBy("key").agg(picks.alias("notes"))
    joined = lookup_join(pipe, found, ["key"])
    cells = {
        schema.week_column(w): x.clean_text(F.col(f"notes.p{i}")) if i < len(old) else F.lit("")
        for i, w in enumerate(weeks)
    }
    return joined.withColumns(cells).drop("notes")


def history_semi(history: DataFrame, pipe: DataFrame) -> DataFrame:
    """Archive rows whose key is still in the pipe; an empty pipe removes nothing."""
    keys = pipe.select("key").distinct().withColumn("__kept", F.lit(True))
    empty = ~any_rows(pipe)
    joined = history.join(keys, "key", "left")
    return joined.filter(F.col("__kept").isNotNull() | empty).drop("__kept")


def history_values(pipe: DataFrame, history: DataFrame, weeks: list[int]) -> DataFrame:
    """Archive values of the given weeks beside each pipe row (empty text where none)."""
    names = [schema.week_column(w) for w in weeks]
    joined = lookup_join(pipe, window_values(history, weeks, names), ["key"])
    return joined.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names})
