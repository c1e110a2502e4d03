"""Shared workspaces: revisions, three-way merge, optimistic saves by any number of writers."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundforge.functions import hashing
from roundforge.sources import stores

STRATEGIES = ("reject", "prefer_local", "prefer_remote")
HISTORY = (1, 100)
REVISIONS = "dataset_signature string, revision long, workspace_json string, actor string, created_at string"


def merge3(base: DataFrame, local: DataFrame, remote: DataFrame, strategy: str = "reject") -> DataFrame:
    """key, value, present, conflict, and the three sides, for keyed values (key, value) of three sides. A key
    that a side lacks is not the same as a key with a null. A side that didn't change gives way to the other; where both changed
    differently there is a conflict, and the remote side stands unless local is preferred."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    side = lambda df, n: df.select("key", F.struct("value").alias(n))  # noqa: E731  null: the key is missing
    rows = side(base, "base").join(side(local, "local"), "key", "full").join(side(remote, "remote"), "key", "full")
    b, x, y = F.col("base"), F.col("local"), F.col("remote")
    conflict = ~x.eqNullSafe(b) & ~y.eqNullSafe(b) & ~x.eqNullSafe(y)
    chosen = F.when(x.eqNullSafe(b), y).when(y.eqNullSafe(b) | x.eqNullSafe(y), x).otherwise(x if strategy == "prefer_local" else y)
    out = rows.select("key", chosen.alias("chosen"), conflict.alias("conflict"), "base", "local", "remote")
    return out.select("key", F.col("chosen.value").alias("value"), F.col("chosen").isNotNull().alias("present"), "conflict", "base", "local", "remote")


def valid_signature(x: Column) -> Column:
    """Whether a text can name a dataset."""
    return F.coalesce(x.rlike(r"^[A-Za-z0-9._-]{1,128}$"), F.lit(False))


def dirty(saved: Column, now: Column) -> Column:
    """Whether a workspace (JSON) differs from what was saved, by fingerprints that don't depend on the order of keys."""
    return ~hashing.fingerprint(saved).eqNullSafe(hashing.fingerprint(now))


def head(revisions: DataFrame) -> DataFrame:
    """The last revision of each signature."""
    rest = [c for c in revisions.columns if c != "dataset_signature"]
    return revisions.groupBy("dataset_signature").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("dataset_signature", "r.*")


def revision(revisions: DataFrame, signature: str, number: int) -> DataFrame:
    """One revision; number 0 has no row and is empty."""
    return revisions.filter((F.col("dataset_signature") == signature) & (F.col("revision") == number))


def history(revisions: DataFrame, signature: str, limit: int = 20) -> DataFrame:
    lo, hi = HISTORY
    return revisions.filter(F.col("dataset_signature") == signature).orderBy(F.desc("revision")).limit(max(lo, min(hi, limit)))


def log_name(signature: str, number: int) -> str:
    return f"dataset={signature}/revision={number:020d}.json"


class Store:
    """A revision log: a file for each revision, made exclusively, so of several writers that make the same one, on whatever machines, one wins. A
    writer that lost reads what the others wrote and merges again. The head of a dataset is the file with the greatest number."""

    def __init__(self, spark: SparkSession, path: str, tries: int = 100) -> None:
        self.spark, self.path, self.tries = spark, path, tries
        self.store, self.root = stores.opened(path)

    def read(self) -> DataFrame:
        """All revisions of all datasets."""
        if self.store.get_file_info(self.root).type == fs.FileType.NotFound:
            return self.spark.createDataFrame([], REVISIONS)
        # drafts have names that Spark passes over
        return self.spark.read.schema(REVISIONS).option("recursiveFileLookup", "true").json(self.path)

    def revision(self, signature: str, number: int) -> dict:
        """One revision's workspace; number 0 is empty."""
        if number == 0:
            return {}
        with self.store.open_input_stream(f"{self.root}/{log_name(signature, number)}") as f:
            return json.loads(json.loads(f.read())["workspace_json"])

    def newest(self, signature: str) -> int:
        """The number of the last revision. A revision is there only if the one before it is, so numbers are tried in doubled steps and then by halves: a
        look-up for each of a few of them, not a listing of all."""
        there = lambda n: stores.size(self.store, f"{self.root}/{log_name(signature, n)}") is not None
        if not there(1):
            return 0
        lo = 1
        while there(2 * lo):
            lo *= 2
        hi = 2 * lo
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if there(mid) else (lo, mid)
        return lo

    def current(self, signature: str) -> tuple[int, dict]:
        at = self.newest(signature)
        return at, self.revision(signature, at)

    def append(self, signature: str, number: int, workspace: dict, actor: str) -> bool:
        """Makes revision ``number``; False if another writer has."""
        row = {"dataset_signature": signature, "revision": number, "workspace_json": json.dumps(workspace, ensure_ascii=False, separators=(",", ":"), sort_keys=True), "actor": " ".join(actor.split())[:80] or "anonymous", "created_at": datetime.now(UTC).isoformat()}
        return stores.create(self.store, f"{self.root}/{log_name(signature, number)}", json.dumps(row, ensure_ascii=False).encode("utf-8"))

    def merged(self, old: dict, local: dict, remote: dict, strategy: str) -> tuple[dict, int]:
        """All parts of three workspaces merged by key, and the number of conflicts."""
        frame = lambda side: self.spark.createDataFrame([(p, k, json.dumps(v, sort_keys=True)) for p, values in side.items() for k, v in values.items()], "part string, k string, value string").select(F.struct("part", "k").alias("key"), "value")
        rows = merge3(frame(old), frame(local), frame(remote), strategy).collect()  # a workspace is one document
        out: dict = {part: {} for part in sorted({*old, *local, *remote})}
        for r in rows:
            if r["present"]:
                out[r["key"]["part"]][r["key"]["k"]] = json.loads(r["value"])
        return out, sum(r["conflict"] for r in rows)

    def save(self, signature: str, base_revision: int, workspace: dict, actor: str, strategy: str = "reject") -> dict:
        """Saves maps of a workspace. A base that is the head replaces it, deletions included; an older base is merged by key.
        Conflicts under 'reject', and results equal to the head, write nothing."""
        if base_revision < 0:
            raise ValueError("base_revision must not be negative")
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy}")
        for _ in range(self.tries):
            at, now = self.current(signature)
            if base_revision > at:
                raise ValueError("base_revision is newer than the workspace")
            conflicts, merged = 0, workspace
            if base_revision < at:
                merged, conflicts = self.merged(self.revision(signature, base_revision), workspace, now, strategy)
                if conflicts and strategy == "reject":
                    return {"ok": False, "conflict": True, "revision": at, "workspace": now}
            if merged == now:
                return {"ok": True, "changed": False, "revision": at, "workspace": now}
            if self.append(signature, at + 1, merged, actor):
                return {"ok": True, "changed": True, "revision": at + 1, "workspace": merged, "resolved": conflicts}
        raise RuntimeError(f"{self.tries} times another writer was faster")
