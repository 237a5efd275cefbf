"""Names of exported files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.operators.ordered import ordinal, row_number, running_sum
from lumenloom.runtime import cut_lineage, look_up


def number_files(df: DataFrame, order: list[Column], out: str = "file_name", prefix: str = "", digits_floor: int = 4, total: int | None = None) -> DataFrame:
    """Zero-padded running numbers in plan order.

    The width follows the number of planned rows, ``total`` when rows that will
    not be written were planned too.
    """
    placed = ordinal(df, order, "ordinal")  # already materialised, so counting it is cheap
    planned = placed.count() if total is None else total
    width = max(digits_floor, len(str(max(1, planned))))
    return placed.withColumn(out, F.concat(F.lit(prefix), F.lpad(F.col("ordinal").cast("string"), width, "0"), F.lit(".png")))


def template_names(df: DataFrame, template: str, fields: dict[str, Column], out: str = "file_name") -> Column:
    """Column for a ``{idx:05d}_{w}x{h}_{basename}``-like template.

    Integer fields accept a zero-padded width; unknown fields raise early.
    """
    import string

    parts: list[Column] = []
    for text, name, spec, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            value = fields[name]
            parts.append(F.format_string(f"%{spec}", value) if spec else value.cast("string"))
    return F.concat(*parts)


_STEM = r"(?s)^(.*?)(\.[^./]*)?$"
_NUMBERED = r"(?s)^(.*)_([1-9][0-9]{0,17})$"


def _suffixed(name: Column, k: Column) -> Column:
    return F.concat(F.regexp_extract(name, _STEM, 1), F.lit("_"), k.cast("string"), F.regexp_extract(name, _STEM, 2))


def _numbered(names: DataFrame, name: str) -> DataFrame:
    """Add ``_base`` and ``_number`` of the names that later uses of another name may be given; NULL for others."""
    stem = F.regexp_extract(name, _STEM, 1)
    number = F.regexp_extract(stem, _NUMBERED, 2).try_cast("bigint")
    base = F.concat(F.regexp_extract(stem, _NUMBERED, 1), F.regexp_extract(name, _STEM, 2))
    return names.withColumns({"_base": F.when(number >= 2, base), "_number": F.when(number >= 2, number)})


def resolve_collisions(df: DataFrame, name: str, order: list[Column], taken: DataFrame | None = None) -> DataFrame:
    """Later uses of a name get ``_2``, ``_3``, ... before the extension, in the given order.

    Adds ``unique_name``. Names that already exist in ``taken`` (column ``name``)
    count as used, and so do names given to earlier rows. ``order`` must tell
    any two rows apart; null names stay null.

    A later use of ``a.png`` can only meet rows that want ``a_2.png``,
    ``a_3.png`` and so on. A number that was used once stays used, so numbers
    are given upwards. Names are therefore settled level by level, ``a.png``
    before ``a_2.png`` before ``a_2_2.png``; what one level gives away is gone
    for the next. Within a level all is counting: the uses of a name before a
    row, and the used numbers below a number. Only wanted names whose turn
    comes while they are still free are looked at one after the other, as one
    small row each.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = cut_lineage(row_number(df.withColumn("_at", at), [name], [F.col("_at")], "_use"))
    named = rows.where(F.col(name).isNotNull())
    used = (df.select(name).limit(0) if taken is None else taken.select(F.col("name").alias(name))).where(F.col(name).isNotNull()).distinct()
    used = cut_lineage(_numbered(used, name))
    wanted = _numbered(named.groupBy(name).agg(F.count(F.lit(1)).alias("_uses"), F.min("_at").alias("_first")), name)
    gone = used.select(name, F.lit(True).alias("_gone"))
    wanted = cut_lineage(wanted.join(gone, name, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False))))

    level = wanted.join(wanted.select(F.col(name).alias("_base")), "_base", "left_anti")
    done, passed = [], []
    while True:
        done.append(level.select(name, "_uses", "_gone"))
        over = level.select(F.col(name).alias("_base"), F.col("_uses").alias("_rivals"), F.col("_gone").alias("_base_gone"))
        below = cut_lineage(wanted.join(over, "_base"))
        settled = cut_lineage(_settle(named, over.where(F.col("_base_gone") | (F.col("_rivals") > 1)), below, used, name))
        passed.append(settled.where("not _given").select("_base", "_number"))
        if below.isEmpty():
            break
        lost = settled.where("_given").select("_base", "_number", "_given")
        level = below.join(lost, ["_base", "_number"], "left").withColumn("_gone", F.col("_gone") | F.coalesce("_given", F.lit(False)))
        level = cut_lineage(level.select(*wanted.columns))
    return _names_given(rows, _union(done), _union(passed), name, df.columns)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _settle(named: DataFrame, over: DataFrame, below: DataFrame, used: DataFrame, name: str) -> DataFrame:
    """(_base, _number, _given): the numbers of each name in ``over`` that exist or are wanted; is it given to a later use of the name?"""
    wanted = below.where("not _gone").select("_base", "_number", "_first")
    exist = used.where("_number is not null").select("_base", "_number", F.lit(None).cast(below.schema["_first"].dataType).alias("_first"))
    numbers = wanted.unionByName(exist).join(over, "_base")
    ranked = row_number(numbers, ["_base"], [F.col("_number")], "_rank")
    # later uses of the name before the first row that wants the number
    rivals = over.join(wanted.select("_base").distinct(), "_base", "left_semi").select(F.col("_base").alias(name), "_rivals", F.lit(True).alias("_met"))
    uses = look_up(named.select(name, "_at"), rivals, name, "_rivals").where("_met")
    marks = ranked.where("_first is not null")
    events = uses.select(F.col(name).alias("_base"), "_at", F.lit(1).alias("_one")).unionByName(
        marks.select("_base", F.col("_first").alias("_at"), F.lit(0).alias("_one"), "_number", "_rank", "_base_gone"), allowMissingColumns=True
    )
    counted = running_sum(events, ["_base"], "_at", "_one", "_before").where("_one = 0")
    later = F.col("_before") - F.when(F.col("_base_gone"), 0).otherwise(1)
    # with c wanted numbers below given away, the turn comes to number n at later use n - 1 - (rank - 1) + c
    room = counted.withColumn("_room", later - F.col("_number") + F.col("_rank"))
    given = room.where("_room >= 0").select("_base", "_number", "_room").repartition("_base").sortWithinPartitions("_base", "_number").mapInPandas(
        _take_turns, "_base string, _number bigint, _given boolean"
    )
    return ranked.select("_base", "_number").join(given, ["_base", "_number"], "left").withColumn("_given", F.coalesce("_given", F.lit(False)))


def _take_turns(batches):
    """A number is given away if fewer numbers than its room were given before it."""
    base, count = None, 0
    for pdf in batches:
        given = []
        for b, room in zip(pdf["_base"], pdf["_room"]):
            if b != base:
                base, count = b, 0
            given.append(count <= room)
            count += given[-1]
        yield pdf[["_base", "_number"]].assign(_given=given)


def _names_given(rows: DataFrame, names: DataFrame, passed: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Number the later uses of each name past the numbers in ``passed``."""
    ranked = row_number(passed, ["_base"], [F.col("_number")], "_rank")
    # a use passes the number if its turn is after so many free numbers below it
    steps = cut_lineage(ranked.select(F.col("_base").alias(name), (F.col("_number") - 1 - F.col("_rank")).alias("_turn")))
    table = names.join(steps.select(name, F.lit(True).alias("_steps")).distinct(), name, "left")
    placed = look_up(rows, cut_lineage(table), name, "_uses")
    turn = F.col("_use") - F.when(F.col("_gone"), 0).otherwise(1)
    placed = cut_lineage(placed.withColumn("_turn", turn).select(*columns, "_turn", "_steps"))
    plain = placed.where("_steps is null").withColumn("_past", F.lit(0).cast("bigint"))
    moved = placed.where("_steps").withColumn("_step", F.lit(0)).unionByName(steps.withColumn("_step", F.lit(1)), allowMissingColumns=True)
    moved = running_sum(moved.withColumn("_place", F.struct("_turn", "_step")), [name], "_place", "_step", "_past").where("_step = 0")
    out = plain.select(*columns, "_turn", "_past").unionByName(moved.select(*columns, "_turn", "_past"))
    own = F.col("_turn") <= 0
    return out.select(*columns, F.when(own | F.col(name).isNull(), F.col(name)).otherwise(_suffixed(F.col(name), F.col("_turn") + 1 + F.col("_past"))).alias("unique_name"))
