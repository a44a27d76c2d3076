"""Usage sidecars: what a model call used, bound to the exact bytes of its ledger, hand-off, requests and usage artifact.

Usage comes from artifacts of four kinds, each of which has one parser that either gives a usage or says why there is none.
A sidecar is a JSON document with a closed schema, and rules that hold between its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.spread import cut
from sedge.functions.variants import json_variant, kind_at, number_at, object_at, string_at
from sedge.operators import automata, ledger, schema
from sedge.operators.schema import Field
from sedge.operators.usage import FIELDS

# Kinds of usage artifacts, hand-offs with their artifacts, bounds, the forms of labels and digests.
SOURCES = ("responses-json", "responses-sse", "responses-input-count", "codex-jsonl")
HANDOFFS = {"raw_input": [], "summary_only": ["summary.md"], "summary_plus_authoritative_cards": ["summary.md", "source-cards.jsonl"], "summary_plus_toon_compact_view": ["summary.md", "source-cards.toon"]}
MAX_REQUEST, MAX_REQUESTS_BYTES, MAX_REQUESTS = 16 << 20, 64 << 20, 256
MAX_USAGE = MAX_ARTIFACT = 64 << 20
LABEL = "[A-Za-z0-9][A-Za-z0-9._:/-]{0,255}"
SHA = "[0-9a-f]{64}"
PROVENANCE = {"responses-json": "response_returned", "responses-sse": "response_returned", "responses-input-count": "request_declared", "codex-jsonl": "request_declared"}
KIND = "sedge-usage"
CLAIMS = {"artifacts": "bound by digest, not vouched for", "requests_made": 0, "cost": "none", "quality": "none"}


def _descriptor(path: str, most: int, *more: Field) -> list[Field]:
    return [Field(path, "object"), *more, Field(f"{path}.bytes", "integer", 0, most), Field(f"{path}.sha256", "string", pattern=SHA)]


SCHEMA: list[Field] = [
    Field("$", "object"), Field("$.schema_version", "integer", 1, 1), Field("$.kind", "string", pattern=KIND),
    Field("$.claims", "object"), *[Field(f"$.claims.{k}", "integer", v, v) if isinstance(v, int) else Field(f"$.claims.{k}", "string", pattern=v) for k, v in CLAIMS.items()],
    Field("$.ledger", "object"), *[Field(f"$.ledger.{k}", "string", pattern=SHA) for k in ("sha256", "corpus_ordered_sha256", "corpus_diversity_sha256")],
    Field("$.variant", "string", pattern="|".join(HANDOFFS)), Field("$.source", "string", pattern="|".join(SOURCES)),
    Field("$.handoff_artifacts", "array", 0, 2), *_descriptor("$.handoff_artifacts[]", MAX_ARTIFACT, Field("$.handoff_artifacts[].name", "string")),
    *_descriptor("$.manifest", MAX_ARTIFACT), *_descriptor("$.usage_artifact", MAX_USAGE),
    Field("$.requests", "object"), Field("$.requests.ordered", "array", 1, MAX_REQUESTS), *_descriptor("$.requests.ordered[]", MAX_REQUEST), Field("$.requests.sequence_sha256", "string", pattern=SHA),
    Field("$.model", "object"), Field("$.model.label", "string", pattern=LABEL), Field("$.model.provenance", "string", pattern="response_returned|request_declared"),
    Field("$.usage", "object"), *[Field(f"$.usage.{f}", "integer" if f == "input_tokens" else "integer|null", 0, (1 << 63) - 1) for f in FIELDS], Field("$.usage.omitted_fields", "array", 0, len(FIELDS)), Field("$.usage.omitted_fields[]", "string"),
]

# -- rules -----------------------------------------------------------------------------------------------------------


def usage_rules() -> dict[str, Column]:
    """Rules between the counts of a usage, over columns of the names in FIELDS; a null is unknown."""
    c, yes = F.col, F.lit(True)
    known = lambda ok: F.coalesce(ok, yes)
    return {
        "input-known": c("input_tokens").isNotNull(),
        "cached-within-input": known(c("cached_input_tokens") <= c("input_tokens")),
        "written-within-input": known(c("cache_write_tokens") <= c("input_tokens")),
        "reasoning-within-output": known(c("reasoning_output_tokens") <= c("output_tokens")),
        "total-covers-input": known(c("total_tokens") >= c("input_tokens")),
        "total-is-sum": known(c("total_tokens").cast("decimal(38,0)") == c("input_tokens").cast("decimal(38,0)") + c("output_tokens")),
    }


def sequence_digest(ordered: Column) -> Column:
    """The digest of a list of (bytes, sha256), as compact JSON with sorted keys."""
    one = F.transform(ordered, lambda x: F.concat(F.lit('{"bytes":'), x.bytes.cast("string"), F.lit(',"sha256":"'), x.sha256, F.lit('"}')))
    return F.sha2(F.concat(F.lit("["), F.array_join(one, ","), F.lit("]")), 256)


def omitted() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS]))


def validated(sidecars: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, errors): what is wrong with each sidecar. Rules between fields are asked only where the schema is kept."""
    sidecars = cut(sidecars.select(key, json))  # read once a level
    shaped = cut(schema.errors(sidecars, SCHEMA, key, json))
    at = lambda path, kind: F.try_variant_get("_v", path, kind)
    own = sidecars.join(shaped.where("size(errors) = 0").select(key), key).withColumn("_v", json_variant(json)).select(
        key, at("$.source", "string").alias("source"), at("$.variant", "string").alias("variant"), at("$.handoff_artifacts", "array<struct<name:string>>").alias("artifacts"), at("$.requests.ordered", "array<struct<bytes:bigint,sha256:string>>").alias("ordered"),
        at("$.requests.sequence_sha256", "string").alias("sequence"), at("$.model.provenance", "string").alias("provenance"), at("$.usage.omitted_fields", "array<string>").alias("omitted"), *[at(f"$.usage.{f}", "bigint").alias(f) for f in FIELDS],
    )
    c = F.col
    of = lambda values: F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in values.items() for x in kv])
    rules = {
        "artifacts-of-variant": F.transform("artifacts", lambda x: x["name"]) == of(HANDOFFS)[c("variant")],
        "one-request": (c("source") == "codex-jsonl") | (F.size("ordered") == 1),
        "requests-within-limit": F.aggregate("ordered", F.lit(0).cast("long"), lambda a, x: a + x.bytes) <= MAX_REQUESTS_BYTES,
        "request-sequence": c("sequence") == sequence_digest(c("ordered")),
        "provenance-of-source": c("provenance") == of(PROVENANCE)[c("source")],
        "omitted-are-null": c("omitted") == omitted(),
        "count-has-input-only": (c("source") != "responses-input-count") | (F.size(omitted()) == len(FIELDS) - 1),
        **usage_rules(),
    }
    return shaped.where("size(errors) > 0").unionByName(ledger.violations(own, rules).select(key, "errors"))


# -- usage artifacts -------------------------------------------------------------------------------------------------

PARSED = ["model", *FIELDS, "error"]
PATHS = {"input_tokens": "input_tokens", "cached_input_tokens": "input_tokens_details.cached_tokens", "cache_write_tokens": "input_tokens_details.cache_write_tokens", "output_tokens": "output_tokens", "reasoning_output_tokens": "output_tokens_details.reasoning_tokens", "total_tokens": "total_tokens"}


def _first(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that is broken (true: broken; null counts as broken), else null."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def _counts(at: str, paths: dict[str, str]) -> tuple[dict[str, Column], Column]:
    """Counts below a path, and whether one that is there is no count."""
    odd = F.lit(False)
    for p in paths.values():
        odd = odd | (kind_at(f"{at}.{p}").isNotNull() & number_at(f"{at}.{p}").isNull())
    return {f: number_at(f"{at}.{p}") for f, p in paths.items()}, odd


def _response(at: str) -> tuple[dict[str, Column], list[tuple[str, Column]]]:
    counts, odd = _counts(f"{at}.usage", PATHS)
    details = lambda p: (kind_at(f"{at}.usage.{p}").isNotNull() & (kind_at(f"{at}.usage.{p}") != "VOID")) & ~object_at(f"{at}.usage.{p}")
    rules = [("not-a-response", string_at(f"{at}.object") != "response"), ("not-completed", string_at(f"{at}.status") != "completed"), ("model", ~string_at(f"{at}.model").rlike(rf"\A{LABEL}\z")), ("no-usage", ~object_at(f"{at}.usage")), ("details", details("input_tokens_details") | details("output_tokens_details")), ("count", odd)]
    return counts | {"model": string_at(f"{at}.model")}, rules


def _finished(rows: DataFrame, key: str) -> DataFrame:
    """With the rules between counts; where there is an error there is no usage."""
    said = ledger.violations(rows.withColumnRenamed("error", "_e"), usage_rules())
    said = said.withColumn("error", F.coalesce("_e", F.try_element_at("errors", F.lit(1))))
    return said.select(key, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in PARSED[:-1]], "error")


def response_usage(artifacts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Usage of artifacts that are one completed response, bare or inside its completion event."""
    own = artifacts.withColumn("_all", json_variant(text))
    event, kind = string_at("$.type", "_all"), kind_at("$.type", "_all")
    bare = F.coalesce(kind == "VOID", F.lit(True))
    own = own.withColumn("_event", F.when(bare, "").otherwise(event)).withColumn("_v", F.when(bare, F.col("_all")).when(event == "response.completed", F.try_variant_get("_all", "$.response", "variant")))
    values, rules = _response("$")
    error = _first(("not-json", ~object_at("$", "_all")), ("type", F.col("_event").isNull()), ("not-completed", ~F.col("_event").isin("", "response.completed")), *rules)
    return _finished(own.select(key, *[v.alias(f) for f, v in values.items()], error.alias("error")), key)


def count_usage(artifacts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Usage of artifacts that count input tokens: an object of exactly two keys. The model is not theirs to tell."""
    own = artifacts.withColumn("_v", json_variant(text))
    keys = F.array_sort(F.json_object_keys(F.to_json("_v")))
    error = _first(("not-json", ~object_at("$")), ("keys", keys != F.array(F.lit("input_tokens"), F.lit("object"))), ("not-a-count", string_at("$.object") != "response.input_tokens"), ("count", number_at("$.input_tokens").isNull()))
    values = {f: number_at("$.input_tokens") if f == "input_tokens" else F.lit(None).cast("long") for f in FIELDS}
    return _finished(own.select(key, F.lit(None).cast("string").alias("model"), *[v.alias(f) for f, v in values.items()], error.alias("error")), key)


def agent_usage(artifacts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Usage of agents' logs, a JSON object a line: one completed turn with a usage, a message of the agent's, no error."""
    lines = artifacts.select(key, F.posexplode_outer(F.split(text, "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\u0085\\u2028\\u2029]")).alias("pos", "line")).where("line is null or trim(line) <> ''").withColumn("_v", json_variant("line"))
    kind = string_at("$.type")
    done = F.coalesce(kind == "turn.completed", F.lit(False))
    spoke = (kind == "item.completed") & (string_at("$.item.type") == "agent_message") & string_at("$.item.text").isNotNull()
    paths = {"input_tokens": "input_tokens", "cached_input_tokens": "cached_input_tokens", "cache_write_tokens": "cache_write_tokens", "output_tokens": "output_tokens", "reasoning_output_tokens": "reasoning_output_tokens"}
    counts, odd = _counts("$.usage", paths)
    whole = artifacts.select(key).distinct().join(lines.groupBy(key).agg(
        F.bool_or(~object_at("$")).alias("bad"), F.count_if(done).alias("turns"), F.count_if(F.coalesce(spoke, F.lit(False))).alias("spoken"), F.count_if(kind.isin("error", "turn.failed")).alias("failed"), F.bool_or(done & object_at("$.usage")).alias("used"), F.bool_or(done & odd).alias("odd"),
        *[F.max(F.when(done, v)).alias(f) for f, v in counts.items()],
    ), key, "left").withColumn("total_tokens", F.lit(None).cast("long"))
    error = _first(("not-json", F.coalesce("bad", F.lit(False))), ("turns", F.col("turns") != 1), ("no-message", F.col("spoken") == 0), ("failed", F.col("failed") > 0), ("no-usage", ~F.col("used")), ("count", F.col("odd")))
    return _finished(whole.select(key, F.lit(None).cast("string").alias("model"), *FIELDS, error.alias("error")), key)


# Classes of a line of an event stream, and where they lead from: nothing open, an event's name, its data, both; then the
# three ways to fail, which are final.
BLANK, COMMENT, NAME, DATA, OTHER = range(5)
GRAMMAR = [[0, 0, 1, 2, 4], [6, 1, 5, 3, 4], [0, 2, 3, 2, 4], [0, 3, 5, 3, 4], [4] * 5, [5] * 5, [6] * 5]
FAILED = {1: "unterminated", 2: "unterminated", 3: "unterminated", 4: "field", 5: "repeated-name", 6: "no-data"}
TERMINAL = ("response.completed", "response.failed", "response.incomplete", "error")


def stream_usage(artifacts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Usage of event streams that are kept as artifacts: comments, names and data only, every event ended by a blank line
    and its data a JSON object, and exactly one terminal event, a completion, named as its type says, with no event after it.

    Lines are run through an automaton block by block, so a stream's length is no one task's. Of several errors the first of
    this order is told: separator, field, repeated-name, no-data, unterminated, not-json, type, name, not-completed,
    after-completion, no-completion, then those of a response.
    """
    odd = F.coalesce(F.col(text).rlike("[\\x00\\u0085\\u2028\\u2029]"), F.lit(True))
    lines = artifacts.select(key, F.posexplode_outer(F.split(F.when(~odd, F.col(text)), "\r\n?|\n")).alias("pos", "line"))
    cls = F.when(F.col("line") == "", BLANK).when(F.col("line").startswith(":"), COMMENT).when(F.col("line").startswith("event:"), NAME).when(F.col("line").startswith("data:"), DATA).otherwise(OTHER)
    lines = lines.where("line is not null").withColumn("pos", F.col("pos").cast("long")).withColumn("c", cls)
    states = automata.final_states(lines, [key], "pos", "c", GRAMMAR)
    # an event is the lines between two blank ones: their number, then its name and data
    field = lambda name: F.array_join(F.transform(F.filter("own", lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: *", "")), "\n")
    split = artifacts.select(key, F.posexplode(F.split(F.regexp_replace(F.when(~odd, F.col(text)), "\r\n?", "\n"), "\n(?=\n)|(?<=\n)\n")).alias("pos", "e")).withColumn("own", F.filter(F.split("e", "\n"), lambda x: (x != "") & ~x.startswith(":"))).where("size(own) > 0")
    events = split.select(key, "pos", F.when(F.exists("own", lambda x: x.startswith("event:")), field("event")).alias("name"), json_variant(field("data")).alias("_v"))
    kind = string_at("$.type")
    ends = F.coalesce(F.col("name").isin(*TERMINAL), F.lit(False)) | F.coalesce(kind.isin(*TERMINAL), F.lit(False))
    told = events.groupBy(key).agg(
        F.bool_or(~object_at("$")).alias("bad"), F.bool_or(F.coalesce(kind_at("$.type") != "VOID", F.lit(False)) & kind.isNull()).alias("odd_type"), F.bool_or(ends & ~F.col("name").eqNullSafe(kind)).alias("odd_name"), F.bool_or(ends & ~F.coalesce(kind == "response.completed", F.lit(False))).alias("failed"),
        F.min(F.when(ends, F.col("pos"))).alias("end"), F.max("pos").alias("last"), F.min_by("_v", F.when(ends, F.col("pos"))).alias("_v"),
    )
    own = artifacts.select(key, odd.alias("separator")).join(states, key, "left").join(told, key, "left")
    values, rules = _response("$.response")
    grammar = F.coalesce("state", F.lit(0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    error = _first(
        ("separator", F.col("separator")), *[(name, grammar.isin(*[s for s, n in FAILED.items() if n == name])) for name in ("field", "repeated-name", "no-data", "unterminated")],
        ("not-json", no("bad")), ("type", no("odd_type")), ("name", no("odd_name")), ("not-completed", no("failed")), ("after-completion", F.coalesce(F.col("last") > F.col("end"), F.lit(False))), ("no-completion", F.col("end").isNull()), *rules,
    )
    return _finished(own.select(key, *[v.alias(f) for f, v in values.items()], error.alias("error")), key)


PARSERS = dict(zip(SOURCES, (response_usage, stream_usage, count_usage, agent_usage), strict=True))


def parsed(artifacts: DataFrame, key: str = "key", source: str = "source", content: str = "content") -> DataFrame:
    """(key, model, counts, error) of usage artifacts of all four kinds (bytes), each by its own parser."""
    valid = F.is_valid_utf8(F.col(content).cast("string")) & (F.octet_length(content) <= MAX_USAGE)
    own = artifacts.select(key, source, F.when(valid, F.col(content).cast("string")).alias("text"))
    nothing = [F.lit(None).cast("string" if c == "model" else "long").alias(c) for c in PARSED[:-1]]
    out = own.where("text is null").select(key, *nothing, F.when(F.col(source).isin(*SOURCES), "bytes").otherwise("source").alias("error")).unionByName(own.where(F.col("text").isNotNull() & ~F.coalesce(F.col(source).isin(*SOURCES), F.lit(False))).select(key, *nothing, F.lit("source").alias("error")))
    for name, parse in PARSERS.items():
        out = out.unionByName(parse(own.where((F.col(source) == name) & F.col("text").isNotNull()), key, "text"))
    return out


# -- artifacts and whole sidecars ------------------------------------------------------------------------------------


def described(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumns({"bytes": F.octet_length(content).cast("long"), "sha256": F.sha2(content, 256)})


def artifact_states(entries: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """(*by, state, ...) of ledger entries and files (``by``, bytes, sha256): same, changed, missing (no file) or surplus (no
    entry). Keys come once on either side; a null part of a key is a value."""
    own = lambda df, name: df.select(*by, F.struct("bytes", "sha256").alias(name)).groupBy(*by).agg(F.first(name).alias(name))
    both = own(entries, "entry").unionByName(own(files, "file"), allowMissingColumns=True).groupBy(*by).agg(F.first("entry", ignorenulls=True).alias("entry"), F.first("file", ignorenulls=True).alias("file"))
    state = F.when(F.col("file").isNull(), "missing").when(F.col("entry").isNull(), "surplus").when(F.col("entry") == F.col("file"), "same").otherwise("changed")
    return both.select(*by, state.alias("state"), "entry", "file")


def built(cases: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, error, sidecar): a sidecar for each case, or the first reason why there is none.

    ``cases``: case_id, source, variant, model_label, ledger_sha256, corpus_ordered_sha256, corpus_diversity_sha256.
    ``entries``: what each case's ledger says of its artifacts (case_id, name, bytes, sha256). ``files``: case_id, role
    (artifact, request or usage), name, ordinal, content. The manifest and the artifacts of the variant must be there byte
    for byte, in the ledger's words; requests are JSON objects that name a model; the model told and the one used agree.
    """
    c = F.col
    files = described(files)
    of = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in HANDOFFS.items() for x in kv])
    wanted = cases.select("case_id", F.posexplode(F.concat(F.array(F.lit("manifest.json")), F.coalesce(of[c("variant")], F.array().cast("array<string>")))).alias("place", "name"))
    states = artifact_states(entries, files.where("role = 'artifact'"), ["case_id", "name"])
    held = wanted.join(states, ["case_id", "name"], "left").groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "name", F.coalesce("state", F.lit("missing")).alias("state"), "file"))).alias("artifacts")
    )
    request = files.where("role = 'request'").withColumn("_v", json_variant(F.when(F.is_valid_utf8(c("content").cast("string")), c("content").cast("string"))))
    label = string_at("$.model")
    asked = request.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "bytes", "sha256"))).alias("ordered"), F.count("*").alias("n"), F.sum("bytes").alias("total"), F.max("bytes").alias("most"),
        F.bool_or(~object_at("$")).alias("odd"), F.bool_or(~F.coalesce(label.rlike(rf"\A{LABEL}\z"), F.lit(False))).alias("unnamed"), F.min(label).alias("model_a"), F.max(label).alias("model_z"),
    )
    usage = files.where("role = 'usage'").join(cases.select("case_id", "source"), "case_id").select("case_id", "source", "content", "bytes", "sha256")
    used = parsed(usage, "case_id").select("case_id", c("model").alias("returned"), *FIELDS, c("error").alias("usage_error")).join(usage.select("case_id", F.struct("bytes", "sha256").alias("usage_artifact")), "case_id")
    own = cases.join(held, "case_id").join(asked, "case_id", "left").join(used, "case_id", "left")
    model = F.when(c("source").startswith("responses-") & (c("source") != "responses-input-count"), c("returned")).when(c("source") == "codex-jsonl", c("model_label")).otherwise(c("model_a"))
    named = F.when(c("source") == "codex-jsonl", c("model_label").isNotNull() & c("model_label").rlike(rf"\A{LABEL}\z") & (c("model_a") == c("model_label")) & (c("model_z") == c("model_label"))).otherwise(c("model_label").isNull() | (c("model_label") == model))
    state = lambda s: F.exists("artifacts", lambda x: x.state == s)
    error = _first(
        ("source", ~c("source").isin(*SOURCES)), ("variant", ~c("variant").isin(*HANDOFFS)), ("no-request", c("n").isNull()), ("requests", c("n") > MAX_REQUESTS), ("one-request", (c("source") != "codex-jsonl") & (c("n") != 1)), ("request-bytes", (c("most") > MAX_REQUEST) | (c("total") > MAX_REQUESTS_BYTES)),
        ("artifact-missing", state("missing")), ("artifact-unlisted", state("surplus")), ("artifact-changed", state("changed")), ("request-json", c("odd")), ("request-model", c("unnamed")), ("no-usage-artifact", c("usage_artifact").isNull()),
    )
    error = F.coalesce(error, F.concat(F.lit("usage-"), "usage_error"), F.when(~F.coalesce(named, F.lit(False)), "model-label"))
    entry = lambda x: F.struct(x["name"].alias("name"), x.file.bytes.alias("bytes"), x.file.sha256.alias("sha256"))
    ordered = F.transform("ordered", lambda x: F.struct(x.bytes.alias("bytes"), x.sha256.alias("sha256")))
    sidecar = F.struct(
        F.lit(1).alias("schema_version"), F.lit(KIND).alias("kind"), F.struct(*[F.lit(v).alias(k) for k, v in CLAIMS.items()]).alias("claims"),
        F.struct(c("ledger_sha256").alias("sha256"), "corpus_ordered_sha256", "corpus_diversity_sha256").alias("ledger"), "variant", "source",
        F.transform(F.slice("artifacts", 2, 8), entry).alias("handoff_artifacts"), F.struct(c("artifacts")[0].file.bytes.alias("bytes"), c("artifacts")[0].file.sha256.alias("sha256")).alias("manifest"), "usage_artifact",
        F.struct(ordered.alias("ordered"), sequence_digest(c("ordered")).alias("sequence_sha256")).alias("requests"),
        F.struct(model.alias("label"), F.create_map(*[F.lit(x) for kv in PROVENANCE.items() for x in kv])[c("source")].alias("provenance")).alias("model"), F.struct(*FIELDS, omitted().alias("omitted_fields")).alias("usage"),
    )
    return own.withColumn("error", error).select("case_id", "error", F.when(c("error").isNull(), F.to_json(sidecar, {"ignoreNullFields": "false"})).alias("sidecar"))
