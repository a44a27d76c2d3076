"""Replies that must fit a size: entries of a receipt are left out from the end, or the reply says that it is too large.

Sizes are those of compact JSON in UTF-8. How many entries go is one fold over an entry's sizes from the end; a reply is never
written anew to try it. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.variants import json_variant, kind_at, object_at, string_at

TOO_LARGE = "reply-too-large"


def trim(replies: DataFrame, limit: int, protected: str, reply: str = "reply", digest: str = "receipt_sha256", schema: str = "dispatch.reply/v1") -> DataFrame:
    """``replies`` with ``action``, ``omitted`` and ``wire``, the JSON to be sent with its keys sorted.

    ``sent``: it fits as it is. ``trimmed``: entries of ``receipt.observed_models`` are left out from the end, as few as will
    do, but neither one of unit ``root`` nor one whose model matches all of ``protected``, nor what is no object; ``trimmed``
    in the reply counts them beside the receipt file's digest. ``too-large``: not even that fits, and the reply fails with
    that reason. ``split``: an acknowledgement of a halt without a receipt, which is to be packed instead; no wire form.
    ``invalid``: no JSON object, or null; no wire form.
    """
    c = F.col
    models = "$.receipt.observed_models"
    own = replies.withColumn("_v", json_variant(reply)).withColumn("_v", F.when(object_at("$"), c("_v"))).withColumn("_size", F.octet_length(F.to_json("_v")))
    model = lambda x: string_at("$.model", x)
    free = lambda x: object_at("$", x) & ~F.coalesce(string_at("$.unit", x) == "root", F.lit(False)) & ~F.coalesce(model(x).rlike(rf"\A(?:{protected})\z"), F.lit(False))
    entries = F.when(F.startswith(kind_at(models), F.lit("ARRAY")), F.try_variant_get("_v", models, "array<variant>"))
    own = own.withColumn("_e", F.transform(F.coalesce(entries, F.array().cast("array<variant>")), lambda x, i: F.struct(F.to_json(x).alias("j"), free(x).alias("free"), i.alias("i"))))
    own = own.withColumn("_free", F.filter("_e", lambda x: x["free"]))
    earlier = F.coalesce(F.octet_length(F.to_json(F.try_variant_get("_v", "$.trimmed", "variant"))) + len(',"trimmed":'), F.lit(0))
    mark = len(',"trimmed":{"observed_models_omitted":,"receipt_sha256":""}') + F.octet_length(digest)
    own = own.withColumns({"_base": c("_size") - earlier + F.coalesce(mark, F.lit(0)), "_n": F.size("_e")})
    last = F.when(c("_n") == F.size("_free"), F.lit(1)).otherwise(0)  # the comma that an empty list never had
    after = lambda a: c("_base") - a["saved"] + F.length(a["k"].cast("string")) + F.when(a["k"] == c("_n"), last).otherwise(0)
    start = F.struct(F.lit(0).alias("saved"), F.lit(0).alias("k"))
    more = lambda a, x: F.struct((a["saved"] + F.octet_length(x["j"]) + 1).alias("saved"), (a["k"] + 1).alias("k"))
    done = lambda a: (a["k"] > 0) & (after(a) <= limit)
    own = own.withColumn("_a", F.when(c("_size") > limit, F.aggregate(F.reverse("_free"), start, lambda a, x: F.when(done(a), a).otherwise(more(a, x)))))
    halted = (string_at("$.kind") == "halted") & (kind_at("$.receipt") == "VOID")
    own = own.withColumn("action", F.when(c("_v").isNull(), "invalid").when(c("_size") <= limit, "sent").when(F.coalesce(halted, F.lit(False)), "split").when(done(c("_a")), "trimmed").otherwise("too-large"))
    k = F.when(c("action") == "trimmed", c("_a.k"))
    own = own.withColumn("omitted", k).withColumn("_from", F.try_element_at("_free", -k)["i"])
    kept = F.transform(F.filter("_e", lambda x: ~(x["free"] & (x["i"] >= c("_from")))), lambda x: x["j"])
    whole = F.try_variant_get("_v", "$", "map<string,variant>")
    receipt = F.try_variant_get("_v", "$.receipt", "map<string,variant>")
    put = lambda m, name, json: F.map_concat(F.map_filter(m, lambda key, _: key != name), F.create_map(F.lit(name), F.try_parse_json(json)))
    noted = F.to_json(F.struct(k.alias("observed_models_omitted"), c(digest).alias("receipt_sha256")), {"ignoreNullFields": "false"})
    shorter = put(put(whole, "receipt", F.to_json(put(receipt, "observed_models", F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]"))))), "trimmed", noted)
    detail = F.concat(F.lit(f"Even without all entries that may go the reply has more than {limit} bytes. The receipt file, sha256 "), F.coalesce(digest, F.lit("unknown")), F.lit(", lists "), c("_n").cast("string"), F.lit(" models."))
    failed = F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit("failed").alias("kind"), string_at("$.job_id").alias("job_id"), F.lit(None).cast("string").alias("receipt"), F.lit(TOO_LARGE).alias("reason"), detail.alias("detail")), {"ignoreNullFields": "false"})
    sorted_ = lambda json: F.to_json(F.try_parse_json(json))
    wire = F.when(c("action") == "sent", F.to_json("_v")).when(c("action") == "trimmed", sorted_(F.to_json(shorter))).when(c("action") == "too-large", sorted_(failed))
    return own.select(*replies.columns, "action", "omitted", wire.alias("wire"))
