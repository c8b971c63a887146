"""Snapshots and the journal of runs, as joins, windows and folds.

A snapshot has path and hash. A journal has ``entries`` (entry_seq, run_id, parent, created_at, kind, unchanged) and ``changes``
(entry_seq, path, op: added, changed or removed, hash: what it then held, previous: what it held before).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaica import storage
from mosaica.errors import ContractError, SourceError
from mosaica.functions.text import abbreviated, canonical_column, content_hash

CONTRACT = "mosaica.run-journal/1-draft"
ABSENT, PRESENT = "\x00absent", "\x00present"


def compared(held: DataFrame, found: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """key, op (added, changed, unchanged, removed), hash, previous: one full outer join on the key."""
    a, b = held.select(key, F.col(digest).alias("previous"), F.lit(1).alias("was")), found.select(key, F.col(digest).alias("hash"), F.lit(1).alias("is"))
    op = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("hash").eqNullSafe(F.col("previous")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, op.alias("op"), "hash", "previous")


def refuse_mixed(held: DataFrame, found: DataFrame, key: str = "unit_key") -> None:
    """A comparison is of one source, and a key stands once in a read."""
    sources = held.select("source_id").union(found.select("source_id")).distinct().limit(2).count()
    if sources > 1:
        raise ValueError("a comparison is of one source at a time")
    refuse_repeated(found, key)


def refuse_repeated(found: DataFrame, key: str = "unit_key") -> None:
    twice = found.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise SourceError(f"key {twice[0][0]!r} stands for {twice[0].n} units")


def moves(changes: DataFrame, keys: list[str] = ["entry_seq"]) -> DataFrame:  # noqa: B006
    """keys, old, new: a removed and an added path of one run with the same bytes, where either side has it once."""
    gone = changes.where("op = 'removed' and previous is not null").groupBy(*keys, F.col("previous").alias("hash")).agg(F.count("*").alias("n"), F.min("path").alias("old")).where("n = 1")
    new = changes.where("op = 'added' and hash is not null").groupBy(*keys, "hash").agg(F.count("*").alias("m"), F.min("path").alias("new")).where("m = 1")
    return gone.join(new, [*keys, "hash"]).select(*keys, "old", "new")


def summaries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Per entry: added, changed, removed (moves counted apart), moved, unchanged, touched, total."""
    count = lambda op: F.sum(F.when(F.col("op") == op, 1).otherwise(0)).alias(op)
    ops = changes.groupBy("entry_seq").agg(*map(count, ("added", "changed", "removed")))
    moved = moves(changes).groupBy("entry_seq").agg(F.count("*").alias("moved"))
    rows = entries.join(ops, "entry_seq", "left").join(moved, "entry_seq", "left").na.fill(0, ["added", "changed", "removed", "moved"])
    return rows.select("entry_seq", (F.col("added") - F.col("moved")).alias("added"), "changed", (F.col("removed") - F.col("moved")).alias("removed"), "moved", "unchanged", (F.col("added") + F.col("changed") + F.col("removed")).alias("touched"), (F.col("unchanged") + F.col("added") + F.col("changed")).alias("total"))


def folded(changes: DataFrame, since: int | None = None) -> DataFrame:
    """Net effect of a range of entries: path, op, hash, previous, exact. What came and went, or is as it was, isn't listed.

    exact is whether all lines of the path tell their hashes; a change without them counts as changed.
    """
    rows = changes if since is None else changes.where(F.col("entry_seq") > since)
    before = F.when(F.col("op") == "added", F.lit(ABSENT)).otherwise(F.coalesce("previous", F.lit(PRESENT)))
    after = F.when(F.col("op") == "removed", F.lit(ABSENT)).otherwise(F.coalesce("hash", F.lit(PRESENT)))
    told = F.when(F.col("op") == "added", F.col("hash").isNotNull()).when(F.col("op") == "removed", F.col("previous").isNotNull()).otherwise(F.col("hash").isNotNull() & F.col("previous").isNotNull())
    net = rows.groupBy("path").agg(F.min_by(before, "entry_seq").alias("was"), F.max_by(after, "entry_seq").alias("now"), F.bool_and(told).alias("exact"))
    op = F.when((F.col("was") == ABSENT) & (F.col("now") == ABSENT), None).when(F.col("was") == ABSENT, "added").when(F.col("now") == ABSENT, "removed").when((F.col("was") != F.col("now")) | (F.col("was") == PRESENT) | (F.col("now") == PRESENT), "changed")
    real = lambda c: F.when(~F.col(c).isin(ABSENT, PRESENT), F.col(c))
    return net.select("path", op.alias("op"), real("now").alias("hash"), real("was").alias("previous"), "exact").where("op is not null")


def entry_id() -> Column:
    """Identity of an entry: of the corpus it made, where that came from, and when."""
    return content_hash(canonical_column(created_at=F.coalesce("created_at", F.lit("")), parent=F.coalesce("parent", F.lit("")), run_id=F.col("run_id")))


def chain_faults(entries: DataFrame, changes: DataFrame, corpus: DataFrame | None = None, run_id: str | None = None) -> DataFrame:
    """invariant, subject, entry_seq of what contradicts itself: journal 1 (last run isn't the corpus), 2 (parents), 3 (corpus against last hashes), 4 (previous hashes)."""
    line = W.orderBy("entry_seq")  # entries are runs: few, and in one order
    chained = entries.select("entry_seq", "run_id", "parent", F.lag("run_id").over(line).alias("older"), F.lead("run_id").over(line).isNull().alias("last"))
    broken = chained.where("older is not null and not (parent <=> older)").select(F.lit("journal 2").alias("invariant"), F.col("run_id").alias("subject"), "entry_seq")
    if run_id is not None:
        broken = broken.unionByName(chained.where(F.col("last") & (F.col("run_id") != run_id)).select(F.lit("journal 1").alias("invariant"), F.col("run_id").alias("subject"), "entry_seq"))
    path = W.partitionBy("path").orderBy("entry_seq")
    # A removal forgets what the path held; a line without a hash leaves the last one.
    spell = changes.withColumn("spell", F.coalesce(F.sum(F.when(F.col("op") == "removed", 1).otherwise(0)).over(path.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    known = F.last("hash", ignorenulls=True).over(W.partitionBy("path", "spell").orderBy("entry_seq").rowsBetween(W.unboundedPreceding, -1))
    told = spell.withColumn("known", known)
    wrong = told.where("op <> 'added' and previous is not null and known is not null and previous <> known").select(F.lit("journal 4").alias("invariant"), F.col("path").alias("subject"), "entry_seq")
    out = broken.unionByName(wrong)
    if corpus is not None:
        out = out.unionByName(last_hashes(changes).join(corpus.select("path", F.col("hash").alias("stated")), "path").where("hash <> stated").select(F.lit("journal 3").alias("invariant"), F.col("path").alias("subject"), F.lit(None).cast("long").alias("entry_seq")))
    return out


def last_hashes(changes: DataFrame) -> DataFrame:
    """path, hash: what the history last recorded of paths that it hasn't removed since."""
    gone = F.max(F.when(F.col("op") == "removed", F.col("entry_seq")))
    at = F.max_by("hash", F.when(F.col("hash").isNotNull(), F.col("entry_seq")))
    seen = F.max(F.when(F.col("hash").isNotNull(), F.col("entry_seq")))
    return changes.groupBy("path").agg(gone.alias("gone"), at.alias("hash"), seen.alias("seen")).where("hash is not null and (gone is null or gone < seen)").select("path", "hash")


def blame(changes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """path, first_seen, last_touched (entries), revisions: of paths that live at the end, moves not followed. Paths asked for that the history doesn't know are null."""
    order = W.partitionBy("path").orderBy("entry_seq")
    spell = changes.withColumn("spell", F.coalesce(F.sum(F.when(F.col("op") == "removed", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    born = spell.withColumn("birth", F.max(F.when(F.col("op") == "added", F.col("entry_seq"))).over(W.partitionBy("path", "spell")))
    life = born.where("birth is null or entry_seq >= birth").groupBy("path", "spell").agg(F.min(F.when(F.col("op") == "added", F.col("entry_seq"))).alias("first_seen"), F.max("entry_seq").alias("last_touched"), F.sum(F.when(F.col("op") == "changed", 1).otherwise(0)).alias("revisions"), F.max_by("op", "entry_seq").alias("end"))
    last = life.groupBy("path").agg(F.max_by(F.struct("first_seen", "last_touched", "revisions", "end"), "spell").alias("l")).where("l.end <> 'removed'").select("path", "l.first_seen", "l.last_touched", "l.revisions")
    if paths is None:
        return last
    return paths.select("path").distinct().join(last, "path", "left").na.fill(0, ["revisions"])


def blame_followed(changes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """path, first_seen, last_touched, revisions, formerly: as ``blame``, but a move carries a path's history to its new name.

    Histories of paths that moves tie together are worked out together: the ties are followed by joins (as many rounds as the longest chain
    of names) of the tied names only, any other path is a family of its own. A worker reads its families in the order of their entries,
    and holds the paths of one at a time.
    """
    changes = storage.written(changes, "changes")
    tied = storage.written(moves(changes), "moves")
    family = tied.select(F.col("old").alias("path")).union(tied.select(F.col("new").alias("path"))).distinct().withColumn("family", F.col("path"))
    while True:
        up = tied.join(family.select(F.col("path").alias("old"), F.col("family").alias("f")), "old").select(F.col("new").alias("path"), "f").union(tied.join(family.select(F.col("path").alias("new"), F.col("family").alias("f")), "new").select(F.col("old").alias("path"), "f"))
        lower = family.join(up.groupBy("path").agg(F.min("f").alias("f")), "path", "left").select("path", F.least("family", F.coalesce("f", "family")).alias("family"))
        lower = storage.written(lower, "families")
        changed = lower.join(family.withColumnRenamed("family", "old_family"), "path").where("family <> old_family").limit(1).count()
        family = lower
        if not changed:
            break
    rows = changes.join(family, "path", "left").join(tied.select("entry_seq", F.col("old").alias("path"), "new"), ["entry_seq", "path"], "left").join(tied.select("entry_seq", F.col("new").alias("path"), "old"), ["entry_seq", "path"], "left")
    step = F.when(F.col("op") == "removed", 0).when(F.col("op") == "added", 1).when(F.col("op") == "changed", 2)
    rows = rows.select(F.coalesce("family", "path").alias("family"), "entry_seq", step.alias("step"), "path", "new", "old").where("step is not null")
    known = rows.repartition("family").sortWithinPartitions("family", "entry_seq", "step", "path").mapInArrow(_followed, FOLLOWED)
    return known if paths is None else paths.select("path").distinct().join(known, "path", "left").na.fill(0, ["revisions"])


FOLLOWED = "path string, first_seen long, last_touched long, revisions long, formerly array<string>"


def _followed(batches: Iterator[pa.RecordBatch], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of ``FOLLOWED`` from family, entry_seq, step (removed, added, changed), path, new, old, which come in this order."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    names = ["path", "first_seen", "last_touched", "revisions", "formerly"]
    state: dict[str, tuple] = {}
    done: list[tuple] = []
    now = None

    def given() -> pa.RecordBatch:
        rows, done[:] = done[:], []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for family, seq, step, path, new, old in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if family != now:
                done += [(p, f, t, n, list(before)) for p, (f, t, n, before) in state.items()]
                state, now = {}, family
                if len(done) >= most:
                    yield given()
            if step == 0:
                first, _, n, before = state.pop(path, (None, None, 0, ()))
                if new is not None:
                    state[new] = (first, seq, n + 1, (path, *before))
            elif step == 1:
                if old is None:
                    state[path] = (seq, seq, 0, ())
            else:
                first, _, n, before = state.get(path, (None, None, 0, ()))
                state[path] = (first, seq, n + 1, before)
    done += [(p, f, t, n, list(before)) for p, (f, t, n, before) in state.items()]
    if done:
        yield given()


def touching(changes: DataFrame, paths: DataFrame, follow: bool = True) -> DataFrame:
    """path, entry_seq: the entries that touch a path asked for, under the names that it had before its moves as well.

    Names are followed backwards, a join for each rename in the longest chain; a name counts up to and with the entry that gave it up.
    """
    ties = storage.written(moves(changes), "moves") if follow else None
    names = paths.select("path", F.col("path").alias("name"), F.lit(None).cast("long").alias("until")).distinct()
    found = names
    while ties is not None:
        came = names.alias("n").join(ties.alias("m"), (F.col("n.name") == F.col("m.new")) & (F.col("n.until").isNull() | (F.col("m.entry_seq") < F.col("n.until"))))
        # Of several arrivals under a name the latest before counts.
        names = came.groupBy("n.path", "n.name", "n.until").agg(F.max_by(F.struct("m.old", "m.entry_seq"), "m.entry_seq").alias("m")).select("path", F.col("m.old").alias("name"), F.col("m.entry_seq").alias("until"))
        names = storage.written(names, "names")
        if not names.limit(1).count():
            break
        found = found.unionByName(names)
    # A name counts from the newest entry back to the oldest once it is known.
    met = found.alias("f").join(changes.alias("c"), (F.col("f.name") == F.col("c.path")) & (F.col("f.until").isNull() | (F.col("c.entry_seq") <= F.col("f.until"))))
    return met.select(F.col("f.path").alias("path"), F.col("c.entry_seq").alias("entry_seq")).distinct()


def named(entries: DataFrame, prefix: str) -> int:
    """entry_seq of the one entry whose id starts so, with or without the algorithm's name; none or several is an error."""
    wanted = prefix.strip()
    if not wanted:
        raise LookupError("no run was named")
    hit = entries.where(entry_id().startswith(wanted) | F.substring_index(entry_id(), ":", -1).startswith(wanted)).select("entry_seq").limit(2).collect()
    if len(hit) != 1:
        raise LookupError(f"{wanted!r} names {'no run' if not hit else 'several runs'}")
    return hit[0][0]


def log(entries: DataFrame, changes: DataFrame, limit: int | None = None, since: int | None = None) -> DataFrame:
    """Entries with their summaries and short ids, newest first."""
    rows = entries if since is None else entries.where(F.col("entry_seq") > since)
    out = rows.select("entry_seq", abbreviated(entry_id()).alias("entry"), abbreviated(F.col("run_id")).alias("run"), "created_at").join(summaries(entries, changes), "entry_seq").orderBy(F.desc("entry_seq"))
    return out if limit is None else out.limit(limit)


LINE = "contract string, entry_id string, run_id string, parent string, created_at string, engine_version string, kind string, added array<string>, changed array<string>, removed array<string>, unchanged long, hashes map<string,string>, previous map<string,string>"


def parsed(lines: DataFrame, seq_col: str = "entry_seq", line_col: str = "line") -> DataFrame:
    """Journal lines (JSON) with the parsed fields and ``fault``: bad_json, contract, run_id, overlap or entry_id; null where the line is sound."""
    rows = lines.select(seq_col, F.from_json(line_col, LINE).alias("j")).select(seq_col, "j.*")
    empty = F.array().cast("array<string>")
    every = F.concat(*(F.coalesce(c, empty) for c in ("added", "changed", "removed")))
    fault = (
        F.when(F.col("contract").isNull() & F.col("run_id").isNull(), "bad_json").when(~F.coalesce(F.col("contract").startswith(CONTRACT.split("-draft")[0]), F.lit(False)), "contract").when(F.coalesce("run_id", F.lit("")) == "", "run_id")
        .when(F.size(F.array_distinct(every)) < F.size(every), "overlap").when((F.coalesce("entry_id", F.lit("")) != "") & (F.col("entry_id") != entry_id()), "entry_id")
    )
    return rows.withColumn("fault", fault)


def from_lines(lines: DataFrame, seq_col: str = "entry_seq", line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """entries and changes of journal lines; a line that isn't sound is a ContractError."""
    rows = parsed(lines, seq_col, line_col)
    bad = rows.where("fault is not null").select(seq_col, "fault").limit(1).collect()
    if bad:
        raise ContractError(f"journal line {bad[0][0]}: {bad[0].fault}")
    one = lambda op: rows.select(F.col(seq_col).alias("entry_seq"), F.explode(op).alias("path"), F.lit(op).alias("op"), "hashes", "previous")
    every = one("added").unionByName(one("changed")).unionByName(one("removed"))
    changes = every.select("entry_seq", "path", "op", F.col("hashes")[F.col("path")].alias("hash"), F.col("previous")[F.col("path")].alias("previous"))
    return rows.select(F.col(seq_col).alias("entry_seq"), "run_id", "parent", "created_at", "kind", F.coalesce("unchanged", F.lit(0)).alias("unchanged")), changes


