"""The data flow around a scoring model: request tables out, response tables in. The call is elsewhere.

Batches hold 120 entities of one investigation in triage order. A batch's hash covers its entities' ids and data, so
one changed entity scores its batch anew; labels number the rows of a batch that no earlier answer covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ranges import Ranges

BATCH = 120
PROMPT_VERSION = "2.0"
SHARE_90, SHARE_80 = 0.03, 0.08
REASON_MAX, TITLE_MAX, BODY_MAX, TAG_MAX, TAGS, HYPOTHESES = 400, 200, 2000, 40, 6, 10
SEVERITIES = ["critical", "high", "medium", "low", "unscored"]


def candidates(listed: Ranges, size: int = BATCH) -> DataFrame:
    """A1, A2: triage order without certificates; `batch` and `place` in the investigation."""
    return _batched(listed.where(F.col("triage") != "certificate").numbered("place"), size)


def batches(listed: Ranges, first: int, last: int, size: int = BATCH) -> DataFrame:
    """A2: only the batches first..last (from 0) of each investigation; ranges that hold none of them are not read."""
    chosen = listed.where(F.col("triage") != "certificate")
    wanted = chosen.totals().select("inv_id", F.lit(first * size + 1).alias("first"), F.lit((last + 1) * size).alias("last"))
    return _batched(chosen.between(wanted, "place"), size)


def _batched(placed: DataFrame, size: int) -> DataFrame:
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))


def _flags() -> Column:
    from .triage import FLAGS

    return F.array_sort(F.array_compact(F.array(*[F.when(F.col(f), f) for f in FLAGS])))


def input_hashes(rows: DataFrame, version: str = PROMPT_VERSION) -> DataFrame:
    """A3: inv_id, batch, input_hash."""
    record = F.to_json(F.struct("entity_id", "type", "norm", "n_tools", F.array_sort("tools").alias("tools"), "triage", _flags().alias("flags"), "connected"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", record.alias("record")))), lambda s: s["record"]), ",")
    return rows.groupBy("inv_id", "batch").agg(F.sha2(F.concat(F.lit(version + "\n"), body), 256).alias("input_hash"))


def uncached(rows: DataFrame, hashes: DataFrame, assessments: DataFrame, version: str = PROMPT_VERSION) -> DataFrame:
    """A4: the rows, with their batch's hash, that have no score of that hash and version; `label` numbers them."""
    done = assessments.where(F.col("prompt_version") == version).select("entity_id", "input_hash")
    left = rows.join(hashes, ["inv_id", "batch"]).join(done, ["entity_id", "input_hash"], "left_anti")
    number = F.row_number().over(Window.partitionBy("inv_id", "batch").orderBy("place"))
    return left.withColumn("label", F.concat(F.lit("v"), number.cast("string")))


def budgets(n: Column) -> tuple[Column, Column]:
    """A5: how many of n may be at 90 or more, and at 80 or more; halves round to even."""
    b90 = F.greatest(F.lit(1), F.bround(n * SHARE_90, 0).cast("bigint"))
    return b90, F.greatest(b90, F.bround(n * SHARE_80, 0).cast("bigint"))


def _plain(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def requests(rows: DataFrame) -> DataFrame:
    """One request a batch: n, both budgets, the body (JSON records in order) and its delimiter id."""
    record = F.to_json(F.struct(F.col("label").alias("id"), F.col("type").alias("tip"), _plain(F.col("norm")).alias("deger"), F.col("n_tools").alias("farkli_tool"), "tools", F.col("triage").alias("on_eleme_grubu"), _flags().alias("isaretler"), F.col("connected").alias("iliskisi_var")))
    # the escapes stay as they are, whatever JSON does with a backslash
    record = F.replace(record, F.lit("\\\\u003"), F.lit("\\u003"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", record.alias("record")))), lambda s: s["record"])
    one = rows.groupBy("inv_id", "batch", "input_hash").agg(F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("body"))
    b90, b80 = budgets(F.col("n"))
    return one.select("*", b90.alias("budget_90"), b80.alias("budget_80"), F.substring(F.sha2("body", 256), 1, 16).alias("delimiter"))


def _dealt(side: DataFrame) -> DataFrame:
    """The side of a join by keys that all differ in it or nearly so: both sides are shuffled at any size. Left alone, Spark
    gathers it in the driver to send it out wherever its compressed size is small, once for every join of a query."""
    return side.hint("merge")


def clean_tags(tags: Column) -> Column:
    """A8, on an array of VARIANT: text only, cleaned, distinct in order, at most six."""
    text = F.transform(tags, lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string")))
    clean = F.transform(F.array_compact(text), lambda t: F.trim(F.substring(F.regexp_replace(F.lower(F.trim(t)), r"[^a-z0-9\-_/. ]+", ""), 1, TAG_MAX)))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, TAGS)


def _whole(path: str) -> Column:
    """An integer from 0 to 100; no other kind of JSON value is one."""
    v = F.try_variant_get("item", path, "variant")
    n = F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    return F.when((n >= 0) & (n <= 100), n.cast("smallint"))


def _string(path: str, most: int) -> Column:
    v = F.try_variant_get("item", path, "variant")
    return F.substring(F.trim(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), 1, most)


def _answers(responses: DataFrame, field: str) -> DataFrame:
    """inv_id, batch, k, item of a response's array; a body of another shape has none."""
    v = F.try_parse_json("response")
    items = F.try_variant_get(v, f"$.{field}", "array<variant>")
    return responses.select("inv_id", "batch", F.posexplode(items).alias("k", "item"))


def checked_scores(responses: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, dropped per batch, missing labels). A score counts if its label is one of the batch's, seen
    for the first time among valid ones, its number an integer of 0 to 100 and its reason not empty."""
    item = _answers(responses, "skorlar").select("inv_id", "batch", "k", _string("$.id", 20).alias("label"), _whole("$.skor").alias("score"), _string("$.gerekce", REASON_MAX).alias("reason"), clean_tags(F.coalesce(F.try_variant_get("item", "$.etiketler", "array<variant>"), F.array().cast("array<variant>"))).alias("tags"))
    fine = item.where(F.col("label").rlike("^v[1-9][0-9]*$") & F.col("score").isNotNull() & (F.coalesce("reason", F.lit("")) != ""))
    known = fine.join(_dealt(labels.select("inv_id", "batch", "label", "entity_id")), ["inv_id", "batch", "label"])
    first = F.row_number().over(Window.partitionBy("inv_id", "batch", "label").orderBy("k"))
    scores = known.withColumn("_r", first).where("_r = 1").drop("_r", "k")
    kept = scores.groupBy("inv_id", "batch").agg(F.count("*").alias("kept"))
    dropped = item.groupBy("inv_id", "batch").agg(F.count("*").alias("given")).join(_dealt(kept), ["inv_id", "batch"], "left").select("inv_id", "batch", (F.col("given") - F.coalesce("kept", F.lit(0))).alias("dropped"))
    missing = labels.select("inv_id", "batch", "label").join(_dealt(scores.select("inv_id", "batch", "label")), ["inv_id", "batch", "label"], "left_anti")
    return scores, dropped, missing


def _hypotheses(responses: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all items of the responses, those that are whole, with the ids that their known labels stand for)."""
    item = _answers(responses, "hipotezler").select("inv_id", "batch", "k", _string("$.baslik", TITLE_MAX).alias("title"), _string("$.aciklama", BODY_MAX).alias("body"), _whole("$.guven").alias("confidence"), F.try_variant_get("item", "$.ids", "array<string>").alias("ids"))
    whole = item.where("title <> '' and body <> '' and confidence is not null")
    each = whole.select("inv_id", "batch", "k", F.posexplode(F.array_distinct("ids")).alias("p", "label")).join(_dealt(labels.select("inv_id", "batch", "label", "entity_id")), ["inv_id", "batch", "label"])
    ids = each.groupBy("inv_id", "batch", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "entity_id"))), lambda s: s["entity_id"]).alias("entity_ids"))
    return item, whole.drop("ids").join(_dealt(ids), ["inv_id", "batch", "k"])


def _dropped_hypotheses(responses: DataFrame, labels: DataFrame) -> DataFrame:
    """inv_id, batch, dropped: items that lack a title, a body, a number or known labels."""
    item, whole = _hypotheses(responses, labels)
    rows = item.select("inv_id", "batch", F.lit(1).alias("n")).unionByName(whole.select("inv_id", "batch", F.lit(-1).alias("n")))
    return rows.groupBy("inv_id", "batch").agg(F.sum("n").alias("dropped"))


def checked_hypotheses(responses: DataFrame, labels: DataFrame) -> DataFrame:
    """inv_id, batch, k, title, body, confidence, entity_ids (known labels only, distinct, in order)."""
    place = F.row_number().over(Window.partitionBy("inv_id", "batch").orderBy("k"))
    return _hypotheses(responses, labels)[1].withColumn("_r", place).where(F.col("_r") <= HYPOTHESES).drop("_r")


def live_only(scores: DataFrame, hypotheses: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: scores of entities still in their investigation; hypotheses with the scored and living of their ids,
    those with none dropped."""
    live = scores.join(_dealt(entities.select("inv_id", "entity_id")), ["inv_id", "entity_id"], "left_semi")
    each = hypotheses.select("inv_id", "batch", "k", F.posexplode("entity_ids").alias("p", "entity_id")).join(_dealt(live.select("inv_id", "entity_id").distinct()), ["inv_id", "entity_id"], "left_semi")
    ids = each.groupBy("inv_id", "batch", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "entity_id"))), lambda s: s["entity_id"]).alias("entity_ids"))
    return live, hypotheses.drop("entity_ids").join(_dealt(ids), ["inv_id", "batch", "k"])


def counters(responses: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """A10: for each investigation how many scores and hypotheses were written, how many answers were none that could
    be (against the contract, or about what is no longer there), and how many labels got no score."""
    scores, dropped, missing = checked_scores(responses, labels)
    hypotheses = checked_hypotheses(responses, labels)
    live, kept = live_only(scores, hypotheses, entities)
    bad = _dropped_hypotheses(responses, labels)
    one = lambda df, what, sign=1: df.select("inv_id", F.lit(what).alias("what"), F.lit(sign).cast("bigint").alias("n"))
    some = lambda df, what, n: df.select("inv_id", F.lit(what).alias("what"), F.col(n).cast("bigint").alias("n"))
    rows = [
        one(live, "scores_written"), one(kept, "hypotheses_written"), one(missing, "missing"),
        some(dropped, "hallucinated", "dropped"), some(bad, "hallucinated", "dropped"),
        one(scores, "hallucinated"), one(live, "hallucinated", -1), one(hypotheses, "hallucinated"), one(kept, "hallucinated", -1),
    ]
    every = reduce(DataFrame.unionByName, rows)
    names = ["scores_written", "hypotheses_written", "hallucinated", "missing"]
    return every.groupBy("inv_id").agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in names])


def latest(assessments: DataFrame) -> DataFrame:
    """Each entity's newest assessment, the greater id of equal times. One row a key by pre-aggregation."""
    columns = [c for c in assessments.columns if c != "entity_id"]
    best = assessments.groupBy("entity_id").agg(F.max_by(F.struct(*columns), F.struct("scored_at", "assessment_id")).alias("a"))
    return best.select("entity_id", "a.*")


def severity(score: Column) -> Column:
    """A12."""
    return F.when(score.isNull(), "unscored").when(score >= 90, "critical").when(score >= 70, "high").when(score >= 50, "medium").otherwise("low")


def display_band(score: Column) -> Column:
    """The finer band of a score's display."""
    return F.when(score.isNull(), None).when(score >= 90, 90).when(score >= 80, 80).when(score >= 70, 70).when(score >= 50, 50).otherwise(0)


def severity_counts(scored: DataFrame) -> DataFrame:
    """N of each severity of each investigation, zeros kept; `scored` has inv_id, score of all entities."""
    counted = scored.groupBy("inv_id", severity(F.col("score")).alias("severity")).agg(F.count("*").alias("n"))
    every = scored.select("inv_id").distinct().select("inv_id", F.explode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("severity"))
    return every.join(counted, ["inv_id", "severity"], "left").select("inv_id", "severity", F.coalesce("n", F.lit(0)).alias("n"))
