"""Curators' decisions: filters, queues, bulk actions, merges, exports, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundforge.functions import text
from roundforge.operators import screening as sc
from roundforge.session import checkpointed, placed

KEEP, REJECT = "keep", "reject"


def check_decisions(decisions: DataFrame) -> DataFrame:
    """Ids that are both kept and rejected: must be empty."""
    return decisions.filter(F.col("decision") == KEEP).select("id").intersect(decisions.filter(F.col("decision") == REJECT).select("id"))


def with_decisions(rounds: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rounds with their decision; a rejection wins over a keep."""
    one = decisions.groupBy("id").agg(F.max("decision").alias("decision"))  # 'reject' sorts after 'keep'
    return rounds.drop("decision").join(one, "id", "left")


def apply(rounds: DataFrame, decisions: DataFrame, only_kept: bool = False) -> DataFrame:
    decided = with_decisions(rounds, decisions)
    kept = F.col("decision") == KEEP
    wanted = kept if only_kept else kept | F.col("decision").isNull()
    return decided.filter(F.coalesce(wanted, F.lit(False))).drop("decision")


def summary(rounds: DataFrame, decisions: DataFrame, only_kept: bool = False) -> DataFrame:
    """One row of counts, unknown ids included."""
    d = F.col("decision")
    kept, rejected, open_ = F.count_if(d == KEEP), F.count_if(d == REJECT), F.count_if(d.isNull())
    inside = with_decisions(rounds, decisions).agg(F.count("*").alias("rounds_before"), kept.alias("kept"), rejected.alias("rejected"), open_.alias("unreviewed"))
    written = F.col("kept") if only_kept else F.col("kept") + F.col("unreviewed")
    lost = unknown(decisions, rounds).agg(F.count_if(d == KEEP).alias("unknown_kept"), F.count_if(d == REJECT).alias("unknown_rejected"))
    return inside.withColumn("rounds_after", written).join(lost)  # one row each


def unknown(decisions: DataFrame, rounds: DataFrame) -> DataFrame:
    return decisions.join(rounds.select("id"), "id", "left_anti")


def status_is(decision: Column, status: str) -> Column:
    return {"all": F.lit(True), "undecided": decision.isNull()}.get(status, F.coalesce(decision == status, F.lit(False)))


def has_signal(flags: Column, signal: str) -> Column:
    return F.lit(True) if signal in ("", "all") else F.coalesce(F.exists(flags, lambda f: f["name"] == signal), F.lit(False))


def has_tag(tags: Column, tag: str) -> Column:
    return F.lit(True) if tag in ("", "all") else F.coalesce(F.exists(tags, lambda t: text.fold(t) == tag.casefold()), F.lit(False))


def order_by(sort: str) -> list[Column]:
    """Sort keys of a queue; source order comes last."""
    keys = {
        "priority": [F.coalesce("analysis.curation_priority", F.lit(-1)).desc()],
        "screening": [F.coalesce("screening.risk_score", F.lit(-1)).desc()],
        "hardest": [F.coalesce("analysis.difficulty_score", F.lit(-1)).desc()],
        "easiest": [F.coalesce("analysis.difficulty_score", F.lit(101)).asc()],
    }
    return [*keys.get(sort, []), F.col("pos").asc()]


def queue(rounds: DataFrame, *, category: str = "all", status: str = "all", screening: str = "all", signal: str = "all", tag: str = "all", sort: str = "priority") -> DataFrame:
    """Rounds (category, decision, screening, analysis, tags, pos) that pass five filters, in order."""
    wanted = (F.lit(True) if category == "all" else F.col("category") == category) & status_is(F.col("decision"), status) & sc.matches(F.col("screening"), screening)
    wanted = wanted & has_signal(F.col("screening.flags"), signal) & (has_tag(F.col("tags"), tag) if tag != "all" else F.lit(True))
    return rounds.filter(wanted).orderBy(*order_by(sort))


def bulk_candidates(rounds: DataFrame, action: str, max_priority: float = 20) -> DataFrame:
    """Undecided rounds for a bulk action: reject-high or keep-clear."""
    s, p = F.col("screening"), F.col("analysis.curation_priority")
    wanted = {"reject-high": sc.high_risk(s), "keep-clear": s.isNotNull() & ~sc.needs_review(s) & F.coalesce(p <= max_priority, F.lit(False))}[action]
    return rounds.filter(F.col("decision").isNull() & wanted)


def apply_bulk(decisions: DataFrame, candidates: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """New decisions, and the undo log: the candidates' former decisions."""
    ids = candidates.select("id").distinct()
    undo = ids.join(decisions, "id", "left").select("id", F.col("decision").alias("previous"))
    return decisions.join(ids, "id", "left_anti").unionByName(ids.withColumn("decision", F.lit(value))), undo


def undo_bulk(decisions: DataFrame, undo: DataFrame) -> DataFrame:
    back = undo.filter("previous is not null").select("id", F.col("previous").alias("decision"))
    return decisions.join(undo.select("id"), "id", "left_anti").unionByName(back)


def upsert(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change of an id wins; a change to null clears it. changes: id, decision, pos."""
    last = changes.groupBy("id").agg(F.max_by("decision", "pos").alias("decision"))
    return decisions.join(last.select("id"), "id", "left_anti").unionByName(last.filter("decision is not null"))


def import_merge(own: DataFrame, imported: DataFrame, rounds: DataFrame) -> DataFrame:
    """Own decisions overwritten by imported ones of known ids; of an import's two, the rejection holds."""
    valid = imported.filter(F.col("decision").isin(KEEP, REJECT)).join(rounds.select("id"), "id", "left_semi").groupBy("id").agg(F.max("decision").alias("decision"))
    return own.join(valid.select("id"), "id", "left_anti").unionByName(valid)


def import_annotations(own: DataFrame, imported: DataFrame, rounds: DataFrame) -> DataFrame:
    """Own notes and tags (id, note, tags) with imported ones of known rounds in their place; imported rows that are empty change nothing."""
    norm = text.normalize_annotation(F.col("note"), F.col("tags"))
    valid = imported.withColumn("__a", norm).filter("__a is not null").join(rounds.select("id"), "id", "left_semi").select("id", "__a.note", "__a.tags")
    return own.join(valid.select("id"), "id", "left_anti").select("id", "note", "tags").unionByName(valid)


def import_presets(own: DataFrame, imported: DataFrame) -> DataFrame:
    """Own presets with imported ones, which take the place of those of the same name whatever its case; of an import's the last one holds.
    Both: pos, name and further fields; presets without a name are left out."""
    rows = own.withColumn("__new", F.lit(0)).unionByName(imported.withColumn("__new", F.lit(1))).withColumn("name", text.clean(F.col("name"), 60)).filter("name != ''")
    rest = [c for c in own.columns if c != "__new"]
    return rows.groupBy(text.fold(F.col("name")).alias("__key")).agg(F.max_by(F.struct(*rest), F.struct("__new", "pos")).alias("r")).select("r.*")


def decide(queue_rows: DataFrame, decisions: DataFrame, undo: DataFrame, id_: str, value: str | None, order: list[Column], status: str = "undecided") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One decision of a curator: the decisions with it, the undo log, which it clears, and the id to show next. A queue of undecided rounds
    loses the round, and the next one moves up, or the last one at the end; other queues go on to the next one and wrap around."""
    change = queue_rows.sparkSession.createDataFrame([(id_, value, 0)], "id string, decision string, pos int")
    after = upsert(decisions.select("id", "decision"), change)
    step = cursor(queue_rows, order).join(F.broadcast(change.select("id")), "id")  # one row
    if status == "undecided":
        last = checkpointed(placed(queue_rows, *order).select("id", "place"))
        at_end = last.agg(F.max_by("id", "place").alias("last"))
        step = step.join(at_end).withColumn("next", F.when(F.col("id") == F.col("last"), F.nullif("previous", "id")).otherwise(F.col("next")))
    return after, undo.limit(0), step.select(F.col("next").alias("id"))


def snapshot(decisions: DataFrame, rounds: DataFrame) -> DataFrame:
    """Decisions with valid values, of known rounds."""
    return decisions.filter(F.col("decision").isin(KEEP, REJECT)).join(rounds.select("id"), "id", "left_semi")


def statistics(rounds: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: kept, rejected, reviewed, remaining, flagged."""
    d = decisions.agg(F.count_if(F.col("decision") == KEEP).alias("kept"), F.count_if(F.col("decision") == REJECT).alias("rejected"))
    r = rounds.agg(F.count("*").alias("rounds"), F.count_if(sc.needs_review(F.col("screening"))).alias("flagged"))
    reviewed = F.col("kept") + F.col("rejected")
    return d.join(r).select("kept", "rejected", reviewed.alias("reviewed"), F.greatest(F.lit(0), F.col("rounds") - reviewed).alias("remaining"), "flagged")


def signal_names(rounds: DataFrame) -> DataFrame:
    return rounds.select(F.explode("screening.flags").alias("f")).select(F.trim("f.name").alias("signal")).filter("signal != ''").distinct().orderBy("signal")


def tag_names(annotations: DataFrame) -> DataFrame:
    """key, label: distinct tags whatever their case, spelled as first seen. annotations: pos, tags."""
    tags = annotations.select("pos", F.posexplode("tags").alias("at", "tag"))
    return tags.groupBy(text.fold(F.col("tag")).alias("key")).agg(F.min_by("tag", F.struct("pos", "at")).alias("label")).orderBy("label")


def cursor(rows: DataFrame, order: list[Column]) -> DataFrame:
    """id with the next and previous id of the queue, which wraps around. ``order`` tells all rows apart."""
    at = checkpointed(placed(rows, *order).select("id", "place"))
    n = at.count()
    beside = lambda step, name: at.select(F.pmod(F.col("place") + step, F.lit(n)).alias("place"), F.col("id").alias(name))
    return at.join(beside(n - 1, "next"), "place").join(beside(1, "previous"), "place").select("id", "next", "previous")


def export_actions(decisions: DataFrame, signature: str) -> DataFrame:
    """One row, version 1 of a decisions file: sorted ids."""
    ids = lambda v: F.sort_array(F.collect_list(F.when(F.col("decision") == v, F.col("id"))))
    return decisions.agg(F.lit(1).alias("version"), F.lit(signature).alias("dataset_signature"), ids(KEEP).alias("kept_ids"), ids(REJECT).alias("rejected_ids"))


def export_workspace(decisions: DataFrame, annotations: DataFrame, presets: DataFrame, signature: str) -> DataFrame:
    """One row, version 2: decisions and annotations as maps sorted by id, presets by name."""
    a = decisions.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "decision")))).alias("decisions"))
    b = annotations.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("note", "tags"))))).alias("annotations"))
    c = presets.agg(F.transform(F.array_sort(F.collect_list(F.struct(text.fold(F.col("name")).alias("k"), F.struct(*presets.columns).alias("v")))), lambda x: x["v"]).alias("queue_presets"))
    return a.join(b).join(c).select(F.lit(2).alias("version"), F.lit(signature).alias("dataset_signature"), "decisions", "annotations", "queue_presets")
