"""Review by a language model: prompt, pluggable provider, reply parsing, cache and get-or-create."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators import urls

# Models that may be asked, the first is the default; seconds for which a reply stays valid.
MODELS = ["gpt-5-nano", "gpt-4.1-nano", "gpt-4o-mini"]
TTL_SECONDS = 300
REPLY = "probability string, indicators array<string>, reasoning string"
# The texts of the prompt.
_INSTRUCTIONS = """\
**Common phishing indicators to look for:**
- Spoofed or suspicious sender information
- Urgent or threatening language
- Requests for personal/sensitive information
- Suspicious URLs (phishing links, shortened URLs, etc.)
- Mismatched or abnormal headers
- Unexpected attachments
- Poor grammar or unprofessional language
- Generic greetings or personalization issues
- Too-good-to-be-true offers or scams

**Task:**
Provide your analysis in the following JSON format only (no additional text):
{
  "probability": <integer 0-100, percentage likelihood this is phishing>,
  "indicators": ["specific red flag 1", "specific red flag 2", ...],
  "reasoning": "brief overall explanation"
}

Be precise and focus on concrete evidence from the email."""
_HEAD = "You are an expert at detecting phishing emails. Analyze the following email carefully and provide a detailed assessment focusing on specific phishing indicators."


def prompt(sender: Column, subject: Column, body: Column, attachments: Column) -> Column:
    """The text sent to the model; NULL fields are ''. Links are listed as ['a', 'b']."""
    text = lambda c: F.coalesce(c, F.lit(""))
    links = urls.extract(text(body))
    listed = F.when(F.size(links) > 0, F.concat(F.lit("['"), F.array_join(links, "', '"), F.lit("']"))).otherwise("[]")
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), c)
    return F.concat_ws(
        "\n", F.lit(_HEAD), F.lit(""), F.lit("**Email Details:**"), line("From", text(sender)), line("Subject", text(subject)), line("Body", text(body)),
        line("Attachments", text(attachments)), line("URLs found in body", listed), F.lit(""), F.lit(_INSTRUCTIONS),
    )


def model_or_default(model: Column) -> Column:
    """The model where it is allowed, the default for NULL and '', NULL for any other."""
    m = F.coalesce(F.when(model != "", model), F.lit(MODELS[0]))
    return F.when(m.isin(MODELS), m)


def digest(*columns: str) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; NULL fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def parse_reply(raw: Column) -> Column:
    """struct<reply, error>: '' is an empty reply; what is no JSON object gives an error and no reply."""
    got = F.from_json(raw, f"{REPLY}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = (F.trim(raw) != "") & (got.isNull() | got["_bad"].isNotNull())
    reply = F.when(~bad, F.struct(got["probability"].alias("probability"), got["indicators"].alias("indicators"), got["reasoning"].alias("reasoning")))
    return F.struct(reply.alias("reply"), F.when(bad, F.concat(F.lit("Failed to parse reply: "), raw)).alias("error"))


def verdict(probability: Column, indicators: Column, reasoning: Column) -> Column:
    """struct<label, score, explanations>: phishing above 50; a missing or odd probability is 0."""
    p = F.coalesce(probability.try_cast("double"), F.lit(0.0))
    told = F.transform(F.coalesce(indicators, F.array().cast("array<string>")), lambda x: F.concat(F.lit("Suspicious indicator: "), x))
    why = F.when(reasoning != "", F.array(F.concat(F.lit("LLM reasoning: "), reasoning))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(p > 50, "phishing").otherwise("safe").alias("label"), (p / 100).alias("score"), F.concat(told, why).alias("explanations"))


def latest_valid(cache: DataFrame, at: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Per (model, digest) the newest reply not older than ttl at the given time. cache: model, digest, ts, payload."""
    fresh = cache.where((F.col("ts") <= at) & (F.unix_micros("ts") >= F.unix_micros(at) - ttl * 1_000_000))
    return fresh.groupBy("model", "digest").agg(F.max_by("payload", "ts").alias("payload"), F.max("ts").alias("ts"))


def hits_and_misses(requests: DataFrame, cache: DataFrame, at: Column, ttl: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached payload, and those without one. requests: model, digest and any other columns."""
    valid = latest_valid(cache, at, ttl)
    both = requests.join(valid.select("model", "digest", "payload"), ["model", "digest"], "left")
    return both.where(F.col("payload").isNotNull()), both.where(F.col("payload").isNull()).drop("payload")


def stub(prompts: list[str]) -> list[str]:
    """A provider without a network: the probability follows the words of the prompt. Deterministic."""
    out = []
    for p in prompts:
        body = p.split("- Body: ", 1)[-1].split("\n- Attachments: ", 1)[0].lower()
        found = [w for w in ("urgent", "password", "verify", "login", "confirm account") if w in body]
        out.append(json.dumps({"probability": min(95, 20 * len(found)), "indicators": found, "reasoning": f"{len(found)} words of pressure"}))
    return out


def ask(requests: DataFrame, provider: Callable[[list[str]], list[str]] = stub) -> DataFrame:
    """requests (model, digest, prompt) with raw reply or error. The provider gets one batch of prompts after the
    other on the executors; where a batch fails its prompts are asked one by one, so that an error stays with its row."""

    def one(p: str) -> tuple[str | None, str | None]:
        try:
            return provider([p])[0], None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                b["raw"], b["error"] = provider(b["prompt"].tolist()), None
            except Exception:  # noqa: BLE001
                told = [one(p) for p in b["prompt"]]
                b["raw"], b["error"] = [r for r, _ in told], [e for _, e in told]
            yield b[["model", "digest", "raw", "error"]]

    return requests.select("model", "digest", "prompt").mapInPandas(run, "model string, digest string, raw string, error string")


def get_or_create(requests: DataFrame, cache: DataFrame, at: Column, provider=stub, ttl: int = TTL_SECONDS) -> DataFrame:
    """requests with payload (JSON reply) and cached: each distinct (model, digest) that the cache lacks is asked once."""
    hits, misses = hits_and_misses(requests, cache, at, ttl)
    new = ask(misses.dropDuplicates(["model", "digest"]), provider)
    answered = misses.join(new.select("model", "digest", F.col("raw").alias("payload"), "error"), ["model", "digest"], "left")
    return hits.withColumns({"error": F.lit(None).cast("string"), "cached": F.lit(True)}).unionByName(answered.withColumn("cached", F.lit(False)))


def review_batches(batches: DataFrame, cache: DataFrame, at: Column, default: str | None = None, provider=stub, ttl: int = TTL_SECONDS) -> DataFrame:
    """(batch_id, error, results) of batches (batch_id, items: array<struct<parsed: struct<from_addr, subject, body,
    attachments>, model>>): results is an array of struct<pos, model, label, score> in the order of the items.

    An item without a model has the default of its batch. A batch in which an item fails, for a model that is not
    allowed, a provider's error or a reply that is no JSON object, has no results but the first of its errors.
    Equal items of any batch are asked once."""
    each = batches.select("batch_id", F.posexplode("items").alias("pos", "i")).select("batch_id", "pos", "i.parsed.*", F.coalesce(F.when(F.col("i.model") != "", F.col("i.model")), F.lit(default)).alias("_asked"))
    fields = ("from_addr", "subject", "body", "attachments")
    each = each.withColumns({"model": model_or_default(F.col("_asked")), "digest": digest(*fields), "prompt": prompt(*map(F.col, fields))})
    known = get_or_create(each.where("model is not null"), cache, at, provider, ttl)
    reply = known.withColumn("p", parse_reply(F.col("payload"))).withColumn("e", F.coalesce("error", "p.error"))
    v = verdict(F.col("p.reply.probability"), F.col("p.reply.indicators"), F.col("p.reply.reasoning"))
    told = reply.select("batch_id", "pos", F.col("_asked"), "model", v.alias("v"), "e").select("batch_id", "pos", "model", "v.label", "v.score", "e")
    bad = each.where("model is null").select("batch_id", "pos", "model", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"), F.concat(F.lit("model not allowed: "), F.col("_asked")).alias("e"))
    # a batch is one request, so its items are few
    out = told.unionByName(bad).groupBy("batch_id").agg(F.min_by("e", F.when(F.col("e").isNotNull(), F.col("pos"))).alias("error"), F.sort_array(F.collect_list(F.struct("pos", "model", "label", "score"))).alias("results"))
    return out.select("batch_id", "error", F.when(F.col("error").isNull(), F.col("results")).alias("results"))


def cache_hits(requests: DataFrame, replies: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """requests (request_id, model, digest, requested_at) with hit: whether the newest earlier reply to the same model
    and digest is at most ttl seconds old. replies: model, digest, replied_at.

    Time is cut into buckets of ttl seconds, so that a popular digest is spread over its buckets: a reply serves its
    own bucket and the next. Only replies whose time precedes the request count."""
    bucket = lambda c: F.floor(F.unix_micros(c) / (ttl * 1_000_000))
    served = replies.where("replied_at is not null").select("model", "digest", F.col("replied_at").alias("_r"), F.explode(F.array(bucket("replied_at"), bucket("replied_at") + 1)).alias("_b")).distinct()
    asked = requests.withColumn("_b", bucket("requested_at"))
    both = asked.join(served, ["model", "digest", "_b"], "left")
    age = F.unix_micros("requested_at") - F.unix_micros("_r")
    return both.groupBy("request_id", "model", "digest", "requested_at").agg(F.coalesce(F.max((age > 0) & (age <= ttl * 1_000_000)), F.lit(False)).alias("hit"))
