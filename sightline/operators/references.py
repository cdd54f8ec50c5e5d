"""References to records that are missing, deleted or not yet there, and what is orphaned with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.runtime import Staging


@dataclass(frozen=True)
class Reference:
    """One referring field: ``rows`` has a row for each reference.

    ``owner``, ``target``: names of the referring and the referred table. ``src``: key of the referring
    row, ``pos`` the reference's place in it, ``at`` its time, ``key`` the columns that name the target.
    """

    field: str
    owner: str
    target: str
    rows: DataFrame
    src: str
    pos: str
    at: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class Target:
    """A referred table and the times within which each of its rows is live."""

    rows: DataFrame
    key: tuple[str, ...]
    added: str
    removed: str


def _lives(target: Target) -> DataFrame:
    """One row for each key with the distinct lives of its rows; repeats fall together on the map side."""
    life = F.struct(F.col(target.added).alias("added"), F.col(target.removed).alias("removed"))
    named = target.rows
    for c in target.key:
        named = named.filter(F.col(c).isNotNull())
    return named.groupBy(*[F.col(c).alias(f"t{i}") for i, c in enumerate(target.key)]).agg(F.collect_set(life).alias("lives"))


def _reason(lives: Column, at: Column) -> Column:
    live = F.exists(lives, lambda x: (x["added"] <= at) & (x["removed"].isNull() | (x["removed"] > at)))
    late = F.forall(lives, lambda x: x["added"] > at)
    return F.when(lives.isNull(), F.lit("missing")).when(live, F.lit(None).cast("string")).when(late, F.lit("late")).otherwise(F.lit("deleted"))


def orphan_references(references: Sequence[Reference], targets: Mapping[str, Target]) -> DataFrame:
    """Each reference without a live target: ``ref_field, src_id, pos, reason, at``.

    ``missing``: the target has no row; ``late``: all its rows come after the referring row; else
    ``deleted``. A target row is live at t if added <= t and it is not removed by t. References with a
    null key column name nothing and are skipped; a referring row without a time sees no live row, so its
    reference is ``missing`` or ``deleted``. References to one hot target are split by AQE's skew join:
    the target side has one row for each key. Empty tables give no rows, other columns are ignored.
    """
    lives = {(r.target, len(r.key)): None for r in references}
    for r in references:
        lives[(r.target, len(r.key))] = _lives(targets[r.target])
    out = None
    for r in references:
        named = r.rows
        for c in r.key:
            named = named.filter(F.col(c).isNotNull())
        refs = named.select(
            F.lit(r.field).alias("ref_field"), F.col(r.src).cast("long").alias("src_id"), F.col(r.pos).cast("int").alias("pos"), F.col(r.at).alias("at"),
            *[F.col(c).alias(f"t{i}") for i, c in enumerate(r.key)],
        )
        found = refs.join(lives[(r.target, len(r.key))], [f"t{i}" for i in range(len(r.key))], "left")
        found = found.select("ref_field", "src_id", "pos", _reason(F.col("lives"), F.col("at")).alias("reason"), "at").filter("reason IS NOT NULL")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


@dataclass(frozen=True)
class Link:
    """A foreign key for the cascade: rows ``child_key -> parent_key`` of two named tables, and the child's time, if it has one."""

    child: str
    parent: str
    rows: DataFrame
    child_key: str
    parent_key: str
    at: str | None = None


def orphan_cascade(direct: DataFrame, links: Sequence[Link], max_rounds: int = 50) -> DataFrame:
    """Direct orphans and all that is orphaned with them: ``tbl, id, kind, depth``, and ``at`` if ``direct`` has it.

    ``direct`` has the directly orphaned records as ``tbl, id``. Each round takes the records orphaned
    in the last one, finds their children by a semi-join along every link that leaves from their table,
    drops those already known, and stops when a round finds none; a cycle of links therefore ends too.
    Each round is written to the shared folder, so lineage does not grow. A record that is orphaned both
    ways is ``direct`` (depth 0); an ``inherited`` one has the least depth. Of several times of a record the
    first counts. No orphans give no rows; orphans left after ``max_rounds`` raise.
    """
    staging = Staging(direct.sparkSession, "cascade")
    timed = "at" in direct.columns
    first = F.min(F.col("at") if timed else F.lit(None).cast("timestamp")).alias("at")
    fresh = staging.write(direct.filter("id IS NOT NULL").groupBy("tbl", F.col("id").cast("long").alias("id")).agg(first).withColumn("depth", F.lit(0)))
    known, tables = fresh, {r[0] for r in fresh.select("tbl").distinct().collect()}
    for depth in range(1, max_rounds + 1):
        found = None
        for link in links:
            if link.parent not in tables:
                continue
            parents = fresh.filter(F.col("tbl") == link.parent).select(F.col("id").alias("p"))
            at = F.col(link.at) if link.at else F.lit(None).cast("timestamp")
            rows = link.rows.select(F.col(link.child_key).cast("long").alias("id"), F.col(link.parent_key).cast("long").alias("p"), at.alias("at")).filter("id IS NOT NULL")
            hit = rows.join(parents, "p", "left_semi").select(F.lit(link.child).alias("tbl"), "id", "at")
            found = hit if found is None else found.unionByName(hit)
        if found is None:
            break
        found = found.groupBy("tbl", "id").agg(F.min("at").alias("at"))
        fresh = staging.write(found.join(known.select("tbl", "id"), ["tbl", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        tables = {r[0] for r in fresh.select("tbl").distinct().collect()}
        if not tables:
            break
        known = known.unionByName(fresh)
    else:
        if tables:
            raise RuntimeError(f"orphans are left after {max_rounds} rounds")
    kind = F.when(F.col("depth") == 0, F.lit("direct")).otherwise(F.lit("inherited"))
    return known.select("tbl", "id", kind.alias("kind"), "depth", *(["at"] if timed else []))


@dataclass(frozen=True)
class Orphans:
    """What :func:`find_orphans` finds: direct orphan references, and on demand all orphaned records."""

    references: DataFrame
    owners: Mapping[str, str]
    links: Sequence[Link]

    def records(self) -> DataFrame:
        """``tbl, id, kind, depth, at`` of records that hold an orphan reference, and of all that depend on them."""
        owner = F.create_map(*[F.lit(x) for pair in sorted(self.owners.items()) for x in pair])
        return orphan_cascade(self.references.select(owner[F.col("ref_field")].alias("tbl"), F.col("src_id").alias("id"), "at"), self.links)


def find_orphans(references: Sequence[Reference], targets: Mapping[str, Target], links: Sequence[Link] = ()) -> Orphans:
    """The fixpoint cascade: references without a live target are its first step, its further ones follow the links down."""
    return Orphans(orphan_references(references, targets), {r.field: r.owner for r in references}, links)
