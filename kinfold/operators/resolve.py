"""Resolution: decisions about groups become a status of each record.

Decisions apply in order and the last that touches a record counts: KEEP and FLAG touch the whole group, DELETE and
MERGE the selected records. Decisions that cannot be applied go to a frame of rejects with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.normalize import stripped
from kinfold.operators.exact import public

#: Fields that tell how recent a record is, the first present counts.
TIME_FIELDS = ("created_date", "updated_date", "date", "timestamp")


def check(decisions: DataFrame, members: DataFrame, require_confirmation: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with `reason`) of decisions(seq, group_id, action, selected, notes)."""
    asked = decisions.select("seq", "group_id", F.upper("action").alias("action"), F.coalesce("selected", F.array().cast("array<bigint>")).alias("selected"), F.coalesce("notes", F.lit("")).alias("notes"))
    wanted = asked.select("seq", "group_id", F.explode_outer("selected").alias("record_id"))
    found = wanted.join(members, ["group_id", "record_id"]).groupBy("seq").agg(F.count(F.lit(1)).alias("found"))
    known = members.select("group_id").distinct().withColumn("known", F.lit(True))
    asked = asked.join(found, "seq", "left").join(known, "group_id", "left")
    n = F.size("selected")
    # One merge a group: its values are read by nothing that comes later.
    from pyspark.sql import Window

    merges = F.row_number().over(Window.partitionBy("group_id", "action").orderBy("seq"))
    reason = (
        F.when(F.col("known").isNull(), "unknown group")
        .when(~F.col("action").isin("KEEP", "DELETE", "MERGE", "FLAG") | F.col("action").isNull(), "unknown action")
        .when(F.col("action").isin("KEEP", "DELETE") & (n == 0), "no record selected")
        .when((F.col("action") == "DELETE") & F.lit(require_confirmation) & ~F.lower("notes").contains("confirmed"), "not confirmed")
        .when((F.col("action") == "MERGE") & (n < 2), "fewer than two records selected")
        .when((F.col("action") == "MERGE") & (F.coalesce("found", F.lit(0)) < 2), "fewer than two records found")
        .when((F.col("action") == "MERGE") & (merges > 1), "second merge of a group")
    )
    asked = asked.withColumn("reason", reason)
    return asked.where("reason is null").select("seq", "group_id", "action", "selected", "notes"), asked.where("reason is not null").select("seq", "group_id", "action", "reason")


def statuses(members: DataFrame, valid: DataFrame) -> DataFrame:
    """record_id, group_id, seq, status, action, merged_from of every record that a decision touches. Members meet the
    selected records by a join, not by searching each decision's list; only merged_from, which the records of a merge
    carry as text, is as long as the selection."""
    chosen = valid.select("seq", "group_id", F.posexplode("selected").alias("pos", "record_id")).groupBy("seq", "group_id", "record_id").agg(F.min("pos").alias("pos"))
    met = members.join(valid.select("seq", "group_id", "action"), "group_id").join(chosen, ["seq", "group_id", "record_id"], "left")
    selected = F.col("pos").isNotNull()
    status = (
        F.when(F.col("action") == "KEEP", F.when(selected, "kept").otherwise("soft_deleted"))
        .when(F.col("action") == "FLAG", "flagged")
        .when((F.col("action") == "DELETE") & selected, "hard_deleted")
        .when((F.col("action") == "MERGE") & selected, F.when(F.col("pos") == 0, "merged_primary").otherwise("merged_secondary"))
    )
    touched = met.withColumn("status", status).where("status is not null")
    action = F.when(F.col("status") == "soft_deleted", "SOFT_DELETE").otherwise(F.col("action"))
    last = touched.withColumn("x", F.struct("group_id", "seq", "status", action.alias("action")))
    last = last.groupBy("record_id").agg(F.max_by("x", "seq").alias("x")).select("record_id", "x.*")
    sources = valid.where("action = 'MERGE'").select("seq", "group_id", F.array_join(F.transform("selected", lambda x: x.cast("string")), ",").alias("merged_from"))
    return last.join(sources, ["seq", "group_id"], "left").select("record_id", "group_id", "seq", "status", "action", "merged_from")


def _time(columns: list[str]) -> Column:
    present = [c for c in TIME_FIELDS if c in columns]
    times = [F.try_to_timestamp(F.col(f"`{c}`").cast("string")) for c in present]
    return F.coalesce(*times, F.lit("1900-01-01").cast("timestamp")) if times else F.lit("1900-01-01").cast("timestamp")


def merged_values(records: DataFrame, id_col: str, members: DataFrame, valid: DataFrame) -> DataFrame:
    """group_id, primary record_id and the merged public values of each MERGE: the best record's (most filled fields,
    then latest, then first selected), its blanks filled from the others in the order of selection."""
    fields = public(records)
    rows = valid.where("action = 'MERGE'").select("group_id", F.col("selected")[0].alias("primary_id"), F.posexplode("selected").alias("pos", "record_id"))
    rows = rows.join(members, ["group_id", "record_id"]).join(records.withColumn("record_id", F.col(f"`{id_col}`")), "record_id")
    filled = sum([(stripped(F.col(f"`{f}`")) != "").cast("int") for f in fields], F.lit(0))
    rows = rows.withColumn("_best", F.struct(filled.alias("n"), _time(fields).alias("t"), (-F.col("pos")).alias("p")))
    picks = []
    for f in fields:
        v = F.col(f"`{f}`")
        first_filled = F.min_by(v, F.when(stripped(v) != "", F.col("pos")))
        best = F.max_by(F.struct(v.alias("v")), F.col("_best"))["v"]
        picks.append(F.when(F.coalesce(stripped(best) != "", F.lit(False)), best).otherwise(F.coalesce(first_filled, best)).alias(f))
    return rows.groupBy("group_id", "primary_id").agg(*picks)


def apply(records: DataFrame, id_col: str, members: DataFrame, decisions: DataFrame, require_confirmation: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records with _resolution_status, _resolution_action, _merged_from_ids and merged values, rejects). Untouched
    records are `original`. The primary record of a merge takes all public values of the merge."""
    valid, rejects = check(decisions, members, require_confirmation)
    marks = statuses(members, valid)
    fields = public(records)
    merged = merged_values(records, id_col, members, valid).select(F.col("primary_id").alias("record_id"), F.struct(*[F.col(f"`{f}`") for f in fields]).alias("_m"))
    out = records.withColumn("record_id", F.col(f"`{id_col}`")).join(marks, "record_id", "left").join(merged, "record_id", "left")
    takes = F.col("_m").isNotNull() & (F.col("status") == "merged_primary")
    columns = [F.when(takes, F.col("_m")[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in records.columns]
    return out.select(*columns, F.col("record_id").alias("_original_index"), F.coalesce("status", F.lit("original")).alias("_resolution_status"), F.col("action").alias("_resolution_action"), F.col("merged_from").alias("_merged_from_ids"), F.when(F.col("status").isNotNull(), F.current_timestamp()).alias("_resolution_timestamp")), rejects


def soft_delete(records: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Marks the records of ids(record_id)."""
    marks = ids.select(F.col("record_id").alias("_d")).distinct()
    gone = F.col("_d").isNotNull()
    return records.join(marks, F.col(f"`{id_col}`") == F.col("_d"), "left").select(*records.columns, F.when(gone, "soft_deleted").otherwise("original").alias("_resolution_status"), F.when(gone, "SOFT_DELETE").alias("_resolution_action"))


def hard_delete(records: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Records without those of ids(record_id)."""
    return records.join(ids.select(F.col("record_id").alias("_d")).distinct(), F.col(f"`{id_col}`") == F.col("_d"), "left_anti")


def simple_decisions(members: DataFrame, action: str) -> DataFrame:
    """The same decision for every group: keep its first record, merge all, or flag; other actions decide nothing."""
    none = F.array().cast(f"array<{members.schema['record_id'].dataType.simpleString()}>")
    # Only a merge needs the whole list of a group.
    wanted = {"keep": F.array(F.min("record_id")), "merge": F.array_sort(F.collect_list("record_id")), "flag": F.first(none)}.get(action.lower())
    per = members.groupBy("group_id").agg((wanted if wanted is not None else F.first(none)).alias("selected"))
    out = per.select(F.col("group_id").alias("seq"), "group_id", F.lit(action.upper()).alias("action"), "selected", F.lit("").alias("notes"))
    return out if wanted is not None else out.limit(0)


def clean(records: DataFrame, id_col: str, members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Records without those that share a group with a chosen one (group_id, record_id); groups without a choice stay."""
    gone = members.join(chosen.select("group_id", F.col("record_id").alias("kept")), "group_id").where("record_id != kept").select("record_id")
    return hard_delete(records, id_col, gone)


def summary(resolved: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row: records by status, rejected decisions and the share of decisions that were applied."""
    names = ("original", "kept", "soft_deleted", "hard_deleted", "merged_primary", "merged_secondary", "flagged")
    return resolved.agg(F.count(F.lit(1)).alias("total_records"), *[F.count_if(F.col("_resolution_status") == s).alias(s) for s in names]).crossJoin(rejects.agg(F.count(F.lit(1)).alias("rejected")))
