"""Jobs that start jobs: what a job takes over from all jobs above it, and what follows for its root and its custody.

A forest is rows (job_id, parent_id). What is above a job is folded by pointer jumping: each round a job takes the fold of
the job it points to and points where that one points, so a path of n jobs takes log n joins, and no path is walked by one
task. A parent that is not there counts as none.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.functions.spread import cut
from sedge.functions.udfs import nfkc
from sedge.operators import rules

# From how many rows on a job is hot, what a tag may be, the reasons of refusals and reroutes.
HOT = 100_000
TAG = r"\A[a-z0-9][a-z0-9-]{0,63}\z"
INVALID, UNKNOWN, WIDENS, NOT_ADMITTED = "envelope-invalid", "custody-label-unknown", "custody-widens", "custody-not-admitted"
OWN, INHERITED, INFERRED, UNCERTAIN = "carve-out", "carve-out-inherited", "carve-out-inferred", "carve-out-uncertain"


@dataclass(frozen=True)
class Lane:
    careful: bool  # its roots are of the careful class anyway
    custody: Sequence[str]  # classes that it admits


@dataclass(frozen=True)
class Policy:
    """``lanes`` by route; ``stems`` with the canonical tag each stands for; ``custody`` classes from wide to narrow, with
    the reason for which a class is admitted nowhere, if so; ``labels`` and the class each stands for."""

    lanes: Mapping[str, Lane]
    stems: Sequence[tuple[str, str]]
    custody: Mapping[str, str | None]
    labels: Mapping[str, str]
    careful: str = "careful"
    quick: str = "quick"


def _met(todo: DataFrame, to: DataFrame) -> DataFrame:
    """``todo`` with the row that ``up`` points to, if it is there. Jobs that more than HOT others point to are few, at most
    one for each HOT rows, and are broadcast: the rows below one of them would all be one task's else."""
    hot = cut(todo.groupBy(F.col("up").alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("_hot"))
    at = F.col("up") == F.col("_to")
    if hot.isEmpty():
        return todo.join(to, at, "left")
    few = to.join(F.broadcast(hot), F.col("_to") == F.col("_hot"), "left_semi")
    below = F.col("up") == F.col("_hot")
    return todo.join(F.broadcast(hot), below, "left_anti").join(to, at, "left").unionByName(todo.join(F.broadcast(hot), below, "left_semi").join(F.broadcast(few), at, "left"))


def above(jobs: DataFrame, value: str, merge: Callable[[Column, Column], Column], rounds: int = 64) -> DataFrame:
    """(job_id, above): ``value`` of all jobs above each one merged, null for a root. ``merge`` is associative, and is never
    given a null. Job ids are distinct. Parents in a circle are an error."""
    own = jobs.select("job_id", "parent_id", F.col(value).alias("_v"))
    parents = own.select(F.col("job_id").alias("_p"), "_v")
    to = parents.select(F.col("_p").alias("_to"), "_v")
    roots = own.where("parent_id is null").select("job_id", F.lit(None).cast(own.schema["parent_id"].dataType).alias("up"), F.lit(None).cast(own.schema["_v"].dataType).alias("acc"))
    first = _met(own.where("parent_id is not null").select("job_id", F.col("parent_id").alias("up")), to)
    now = cut(first.select("job_id", F.col("_to").alias("up"), F.col("_v").alias("acc")).unionByName(roots))
    done = None
    for _ in range(rounds):
        # what points nowhere any more leaves: in a join its nulls would all be one task's
        ended = now.where("up is null").select("job_id", F.col("acc").alias("above"))
        done, todo = ended if done is None else done.unionByName(ended), now.where("up is not null")
        if todo.isEmpty():
            return done
        to = todo.unionByName(done.select("job_id", F.lit(None).cast(todo.schema["up"].dataType).alias("up"), F.col("above").alias("acc")))
        both = _met(todo, to.select(F.col("job_id").alias("_to"), F.col("up").alias("_up"), F.col("acc").alias("_acc")))
        now = cut(both.select("job_id", F.col("_up").alias("up"), F.when(F.col("acc").isNotNull() & F.col("_acc").isNotNull(), merge(F.col("acc"), F.col("_acc"))).otherwise(F.coalesce("acc", "_acc")).alias("acc")))
    raise ValueError("parents go in a circle")


def tag_hits(tags: Column, stems: Sequence[tuple[str, str]]) -> Column:
    """The sorted canonical tags whose stem some tag holds, once hyphens in a row are one; nulls are passed over."""
    plain = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.regexp_replace(F.regexp_replace(t, "-+", "-"), r"^-|-\z", ""))
    gap = "\0"
    if any(gap in w for w, _ in stems):
        return rules.those_of([(F.exists(plain, lambda t, w=w: t.contains(w)), tag) for w, tag in stems])
    joined = F.array_join(plain, gap)  # one text, as a stem without the gap lies within one tag
    return rules.those_of([(joined.contains(w) & (F.size(plain) > 0) if not w else joined.contains(w), tag) for w, tag in stems])


def _lane(policy: Policy, what: Callable[[Lane], Column]) -> Column:
    out = F.lit(None)
    for route, lane in policy.lanes.items():
        out = F.when(F.col("lane") == route, what(lane)).otherwise(out)
    return out


def root_classes(jobs: DataFrame, policy: Policy) -> DataFrame:
    """(job_id, root_class, reroute, hits, error) of jobs (job_id, parent_id, tags, goal, lane).

    A careful lane decides first; then hits of the job's own tags, hits of the jobs above it (a hit that is above it is not
    its own), hits of its goal, a goal in which NFKC leaves a letter that is not ASCII, or no goal; else the root is quick.
    ``hits`` has all three kinds. A job on an unknown lane or with a malformed tag, or none at all, is refused; its hits
    still count below it.
    """
    c = F.col
    own = jobs.select("job_id", "parent_id", "tags", "goal", "lane").withColumn("_tags", tag_hits(c("tags"), policy.stems))
    own = rules.stem_hits(own.withColumn("_g", F.coalesce("goal", F.lit(""))), policy.stems, "_g").withColumnRenamed("hits", "_goal")
    own = cut(own.withColumn("_unsure", c("goal").isNull() | nfkc(c("goal")).rlike(r"[\p{L}&&[^\x00-\x7F]]")).drop("_g", "goal"))
    both = own.join(above(own, "_tags", F.array_union), "job_id").withColumn("_up", F.coalesce("above", F.array().cast("array<string>")))
    sound = c("tags").isNotNull() & F.forall("tags", lambda t: F.coalesce(t.rlike(TAG), F.lit(False)))
    careful = _lane(policy, lambda lane: F.lit(lane.careful))
    error = F.when(careful.isNull() | ~F.coalesce(sound, F.lit(False)), INVALID)
    some = lambda x: F.size(x) > 0
    reroute = F.when(careful, None).when(some(F.array_except("_tags", "_up")), OWN).when(some("_up"), INHERITED).when(some("_goal"), INFERRED).when(c("_unsure"), UNCERTAIN)
    told = lambda x: F.when(c("error").isNull(), x)
    both = both.withColumns({"error": error, "_reroute": reroute, "_careful": careful})
    return both.select("job_id", told(F.when(c("_careful") | c("_reroute").isNotNull(), policy.careful).otherwise(policy.quick)).alias("root_class"), told(c("_reroute")).alias("reroute"), told(F.array_sort(F.array_union(F.array_union("_tags", "_up"), "_goal"))).alias("hits"), "error")


def custody(jobs: DataFrame, policy: Policy) -> DataFrame:
    """(job_id, custody, reason) of jobs (job_id, parent_id, label, claimed, lane): the class that each may run under.

    The label stands for a class, which must not be one that is admitted nowhere. What a job claims (the label's class, if it
    claims nothing) must be no wider than that, nor than any claim above it; then its lane must admit it. The first check
    that fails is the reason.
    """
    c = F.col
    rank = lambda x: F.array_position(F.array(*map(F.lit, policy.custody)), x) - 1
    of = lambda values, x: F.try_element_at(F.create_map(*[F.lit(v).cast("string") for kv in values.items() for v in kv]), x)
    own = jobs.select("job_id", "parent_id", "lane", of(policy.labels, T.custody_label(c("label"))).alias("_class"), "claimed").withColumn("_claim", F.coalesce("claimed", "_class"))
    own = cut(own.withColumn("_rank", F.when(rank(c("_claim")) >= 0, rank(c("_claim")))))
    both = own.join(above(own, "_rank", lambda a, b: F.greatest(a, b)), "job_id")
    admitted = _lane(policy, lambda lane: F.array_contains(F.array(*map(F.lit, lane.custody)).cast("array<string>"), c("_claim")))
    reason = (
        F.when(c("_class").isNull(), UNKNOWN).when(of(policy.custody, c("_class")).isNotNull(), of(policy.custody, c("_class"))).when(c("_rank").isNull(), INVALID)
        .when(c("_rank") < rank(c("_class")), WIDENS).when(c("_rank") < c("above"), WIDENS).when(of(policy.custody, c("_claim")).isNotNull(), of(policy.custody, c("_claim")))
        .when(admitted.isNull(), INVALID).when(~admitted, NOT_ADMITTED)
    )
    return both.withColumn("reason", reason).select("job_id", F.when(c("reason").isNull(), c("_claim")).alias("custody"), "reason")
