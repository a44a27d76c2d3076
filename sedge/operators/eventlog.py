"""A run as one ordered log of events, and the log held against what was put in.

Events are a document's ``doc``, its cards and its ``end``, document by document, then ``summary`` and ``manifest``. Where an
event stands follows from prefix sums over documents, so no task sorts a run; a log is written in ranges of its order, a
file each. The comparison joins by run and document, both ways.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.spread import cut, ordinals
from sedge.functions.variants import json_variant, kind_at, number_at, string_at, with_variant
from sedge.operators.schema import Field, errors, sound

SHA256 = "[0-9a-f]{64}"
REASONS = "input-cap|budget|condense-error|redaction-error"
_EVENT = [Field("$", "object"), Field("$.event", "string"), Field("$.i", "integer", least=0)]
_SOURCE = [Field("$.source", "string"), Field("$.trust_tier", "string"), Field("$.sha256", "string", pattern=SHA256)]
#: The closed schemas of events that belong to a document.
SCHEMAS = {
    "doc": [*_EVENT, *_SOURCE, Field("$.bytes", "integer", least=0), Field("$.withheld", "boolean"), Field("$.reason", "string", pattern=REASONS, required=False), Field("$.findings", "array"), Field("$.findings[]", "string")],
    "card": [*_EVENT, *_SOURCE, *[Field(f"$.{k}", "string") for k in ("id", "claim", "evidence", "confidence")], *[Field(f"$.{k}", "integer", least=1) for k in ("line_start", "line_end")], Field("$.flags", "array"), Field("$.flags[]", "string")],
    "end": [*_EVENT, Field("$.cards", "integer", least=0)],
}


def event_log(run, generated_at: str, settings: Mapping[str, object]) -> DataFrame:
    """(run_id, pos from 1, event, doc, json) of a :class:`sedge.plans.condense.Run`; documents count from 0 by position.

    A document that is withheld has a reason and neither findings nor cards. A table without documents has no log.
    """
    c = F.col
    cards = run.cards
    first = c("ordinal").cast("long") - 1
    places = run.places.select("run_id", "position", "_n", first.alias("doc"), (c("before") + 2 * first).alias("before"), (c("_n") + 2).alias("_events"))
    own = cut(run.documents.join(places, ["run_id", "position"]).join(run.findings, ["run_id", "position"], "left"))
    event = lambda name, pos, *fields: [c("run_id"), pos.cast("long").alias("pos"), F.lit(name).alias("event"), c("doc"), F.to_json(F.struct(F.lit(name).alias("event"), *fields)).alias("json")]
    source = [c("source"), c("trust_tier"), c("sha256")]
    found = F.coalesce("findings", F.array().cast("array<string>")).alias("findings")
    docs = own.select(*event("doc", c("before") + 1, c("doc").alias("i"), *source, "bytes", "withheld", "reason", found))
    place = own.select("run_id", "position", "doc", "before")
    lines = [c("line_start").cast("long").alias("line_start"), c("line_end").cast("long").alias("line_end")]
    told = cards.join(place, ["run_id", "position"]).select(*event("card", c("before") + 1 + c("card_rank"), c("doc").alias("i"), c("card_id").alias("id"), *source, "claim", "evidence", "confidence", "flags", *lines))
    ends = own.select(*event("end", c("before") + 2 + c("_n"), c("doc").alias("i"), c("_n").alias("cards")))
    total = own.groupBy("run_id").agg(F.sum("_events").alias("_total")).withColumn("doc", F.lit(None).cast("long"))
    summary = total.join(run.summary, "run_id").select(*event("summary", c("_total") + 1, c("summary").alias("text")))
    held = [F.lit(v).alias(k) for k, v in settings.items()]
    inputs = F.transform("inputs", lambda x: F.struct(x["bytes"].alias("bytes"), x["sha256"].alias("sha256"), x["source"].alias("source"), x["trust_tier"].alias("trust_tier"))).alias("inputs")
    last = total.join(run.manifest, "run_id").select(*event("manifest", c("_total") + 2, c("run_id").alias("id"), F.lit(generated_at).alias("generated_at"), inputs, "mixed_trust_tiers", F.struct(*held).alias("settings")))
    out = docs
    for more in (told, ends, summary, last):
        out = out.unionByName(more)
    return out


def write_log(log: DataFrame, path: str) -> None:
    """JSON lines in the log's order: files by name, lines within them. An existing path is an error."""
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log.select("run_id", "pos", "json").repartitionByRange(n, "run_id", "pos").sortWithinPartitions("run_id", "pos").write.mode("errorifexists").json(path)


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema("run_id string, pos long, json string").json(path)


def _events(log: DataFrame, order: list[str]) -> DataFrame:
    own = ordinals(log.select("run_id", *order, "json").withColumn("_one", F.lit(1)), "run_id", order, "_one")
    own = with_variant(own.select("run_id", F.col("ordinal").cast("long").alias("pos"), "json"), "json", "_v")
    own = own.withColumns({"kind": F.coalesce(string_at("$.event"), F.lit("")), "i": number_at("$.i"), "n": number_at("$.cards"), "id": string_at("$.id")})
    facts = F.struct(string_at("$.source").alias("source"), string_at("$.trust_tier").alias("trust_tier"), string_at("$.sha256").alias("sha256"))
    own = own.withColumns({"facts": facts, "bytes": number_at("$.bytes"), "withheld": F.try_variant_get("_v", "$.withheld", "boolean"), "reason": kind_at("$.reason").isNotNull(), "found": F.size(F.try_variant_get("_v", "$.findings", "array<variant>")) > 0})
    right = reduce(lambda out, kind: out.when(F.col("kind") == kind, sound(F.col("_v"), SCHEMAS[kind])), SCHEMAS, F.when(F.lit(False), F.lit(False)))
    return cut(own.withColumn("sound", F.coalesce(right, F.lit(False))).drop("_v"))


def _named(rows: DataFrame, rules: Mapping[str, Column], i: str = "i") -> DataFrame:
    """(run_id, error, i): a row for each rule that a row breaks."""
    said = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return rows.select("run_id", F.explode(said).alias("error"), F.col(i).cast("long").alias("i"))


def echo_errors(log: DataFrame, documents: DataFrame, facts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(run_id, error, i): what a log (run_id, json, and ``order``, by default ``pos``) has that was not put in, and the
    other way round; ``i`` is the document, null for what belongs to the whole run. A log that is an echo gives no rows.

    ``documents`` (run_id, position, source, trust_tier, sha256, bytes) were put in; ``facts`` has a run's generated_at and
    settings (JSON). Documents: ``dropped``, ``surplus``, ``doubled``, ``changed`` (source, tier, digest or size), ``moved``
    (first occurrences do not come in the order of documents), ``reason``, ``findings`` (of a withheld one), ``withheld-cards``.
    Cards: ``card-doubled``, ``card-moved``, ``card-changed``; ``cards`` if they are not as many as ``end`` says; ``ends``
    unless there is one end; ``interleaved`` if another event stands between a document and its end. Runs:
    ``unknown-event``, ``no-summary``, ``no-manifest`` (none, several, or not last), ``id``, ``generated-at``, ``settings``,
    ``mixed``, ``inputs``, ``unknown-run``. Malformed events: ``doc:``, ``card:`` or ``end:`` with the schema's error. A line
    that is no JSON is an unknown event; lines of a run that are equal in order come in any order.
    """
    c = F.col
    own = _events(log, order or ["pos"])
    wanted = cut(ordinals(documents.select("run_id", "position", "source", "trust_tier", "sha256", "bytes").withColumn("_one", F.lit(1)), "run_id", ["position"], "_one"))
    wanted = wanted.select("run_id", (c("ordinal") - 1).cast("long").alias("i"), F.struct("source", "trust_tier", "sha256").alias("_facts"), c("bytes").alias("_bytes"))
    by = ["run_id", "i"]

    docs = own.where("kind = 'doc' and i is not null")
    one = F.min_by(F.struct("facts", "bytes", "withheld", "reason", "found"), "pos")
    first = docs.groupBy(*by).agg(F.min("pos").alias("at"), F.count("*").alias("times"), one.alias("d"))
    both = first.join(wanted, by, "full")
    changed = ~c("d.facts").eqNullSafe(c("_facts")) | ~c("d.bytes").eqNullSafe(c("_bytes"))
    held = c("d.withheld")
    found = [_named(both, {"dropped": c("at").isNull(), "surplus": c("_facts").isNull(), "doubled": c("times") > 1, "changed": c("at").isNotNull() & c("_facts").isNotNull() & changed, "reason": held != c("d.reason"), "findings": held & c("d.found")})]
    placed = ordinals(first.select(*by, "at").withColumn("_one", F.lit(1)), "run_id", ["at"], "_one").withColumnRenamed("ordinal", "_x").drop("before")
    found.append(_named(ordinals(placed, "run_id", ["i"], "_one"), {"moved": c("_x") != c("ordinal")}))

    inner = own.where("kind in ('card', 'end') and i is not null")
    same = F.struct("id", "pos")
    part = inner.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(c("kind") == "card", same))).alias("_by_id"), F.count_if(c("kind") == "end").alias("_ends"), F.max(F.when(c("kind") == "end", c("n"))).alias("_said"), F.max(F.when(c("kind") == "end", c("pos"))).alias("_end"),
        F.count_if(c("kind") == "card").alias("_cards"), F.count_distinct(F.when(c("kind") == "card", c("facts"))).alias("_kinds"), F.min(F.when(c("kind") == "card", c("facts"))).alias("_card"),
    )
    whole = first.join(part, by, "full").join(wanted, by, "left")
    ids, places = F.transform("_by_id", lambda x: x["id"]), F.transform("_by_id", lambda x: x["pos"])
    once = c("times") == 1
    found.append(_named(whole, {
        "withheld-cards": held & (c("_cards") > 0), "card-doubled": once & (F.size(F.array_distinct(ids)) < c("_cards")), "card-moved": F.array_sort(places) != places, "card-changed": (c("_kinds") > 1) | (c("_card") != c("_facts")),
        "cards": once & (F.coalesce("_cards", F.lit(0)) != c("_said")), "ends": once & (F.coalesce("_ends", F.lit(0)) != 1), "interleaved": once & (c("_ends") == 1) & (c("_end") - c("at") != c("_cards") + 1),
    }))

    total = own.groupBy("run_id").agg(F.max("pos").alias("_total"), *[F.max(F.when(c("kind") == k, c("pos"))).alias(f"_{k}") for k in ("summary", "manifest")], *[F.count_if(c("kind") == k).alias(f"_n_{k}") for k in ("summary", "manifest")], F.max(F.when(c("kind") == "manifest", c("json"))).alias("_json"), F.count_if(~c("kind").isin("doc", "card", "end", "summary", "manifest") | (c("kind").isin(*SCHEMAS) & c("i").isNull())).alias("_odd"))
    tiers = wanted.groupBy("run_id").agg((F.count_distinct("_facts.trust_tier") > 1).alias("_mixed"), F.count("*").alias("_inputs"))
    runs = cut(total.join(facts, "run_id", "full").join(tiers, "run_id", "left").withColumn("_m", json_variant("_json")))
    there = c("_n_manifest") == 1
    same_json = lambda path, text: F.to_json(F.try_variant_get("_m", path, "variant")).eqNullSafe(F.to_json(json_variant(text)))
    found.append(_named(runs.withColumn("i", F.lit(None)), {
        "unknown-event": c("_odd") > 0, "unknown-run": c("settings").isNull(), "no-summary": c("settings").isNotNull() & ~F.coalesce((c("_n_summary") == 1) & (c("_summary") == c("_total") - 1), F.lit(False)), "no-manifest": c("settings").isNotNull() & ~F.coalesce(there & (c("_manifest") == c("_total")), F.lit(False)),
        "id": there & ~string_at("$.id", "_m").eqNullSafe(c("run_id")), "generated-at": there & ~string_at("$.generated_at", "_m").eqNullSafe(c("generated_at")), "settings": there & ~same_json("$.settings", "settings"), "mixed": there & ~F.try_variant_get("_m", "$.mixed_trust_tiers", "boolean").eqNullSafe(c("_mixed")),
    }))
    told = runs.where("_n_manifest = 1").select("run_id", F.posexplode(F.try_variant_get("_m", "$.inputs", "array<variant>")).alias("_i", "_x"))
    told = told.select("run_id", c("_i").cast("long").alias("i"), F.struct(*[string_at(f"$.{k}", "_x").alias(k) for k in ("source", "trust_tier", "sha256")]).alias("_told"), number_at("$.bytes", "_x").alias("_size"))
    listed = told.join(wanted.join(runs.where("_n_manifest = 1").select("run_id"), "run_id", "left_semi"), by, "full")
    found.append(_named(listed, {"inputs": ~c("_told").eqNullSafe(c("_facts")) | ~c("_size").eqNullSafe(c("_bytes"))}))

    for kind, fields in SCHEMAS.items():
        # most events are seen to be sound from their kind alone; the others are taken apart
        rows = own.where((c("kind") == kind) & c("i").isNotNull() & ~c("sound")).select(F.struct("run_id", "pos", "i").alias("_at"), "json")
        bad = errors(rows, fields, "_at").where(F.size("errors") > 0)
        found.append(bad.select("_at.run_id", F.explode("errors").alias("_e"), "_at.i").select("run_id", F.concat(F.lit(f"{kind}:"), "_e").alias("error"), "i"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


