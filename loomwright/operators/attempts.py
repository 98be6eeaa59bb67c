"""Retries, key rings and error classes as functions of a log of attempts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Request fields that may be refused, the smallest first.
FIELDS = ("imageSize", "aspectRatio", "imageConfig", "responseModalities")
BACKOFF_FIRST, BACKOFF_MOST, QUOTA_WAIT = 60, 900, 60.0


def error_class(code: Column, reason: Column, message: Column) -> Column:
    """quota, dead key, transient or permanent; the first rule that fits."""
    reason, message = F.coalesce(reason, F.lit("")), F.coalesce(message, F.lit(""))
    return (
        F.when((code == 429) | reason.isin("RATE_LIMIT_EXCEEDED", "RESOURCE_EXHAUSTED"), "quota")
        .when(code.isin(401, 403) | reason.isin("API_KEY_INVALID", "PERMISSION_DENIED"), "dead key")
        .when((code == 400) & message.contains("API key not valid"), "dead key")
        .when((code == 400) & rejected_field(message).isNotNull(), "transient")
        .when(code >= 500, "transient")
        .otherwise("permanent")
    )


def rejected_field(message: Column) -> Column:
    """The first known request field that a message names."""
    return F.get(F.filter(F.array(*[F.lit(f) for f in FIELDS]), lambda f: F.contains(message, f)), F.lit(0))


def retry_delay(delay: Column) -> Column:
    """Seconds to wait by a reply such as ``27s``, two more to be safe; the default without one."""
    given = F.nullif(F.regexp_extract(delay, r"^([0-9.]+)s", 1), F.lit("")).cast("double")
    return F.coalesce(given + 2.0, F.lit(QUOTA_WAIT))


def image_kind(content: Column) -> Column:
    """png, jpg, webp or gif by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("52494646"), "webp").when(head.startswith("47494638"), "gif")


def cover_crop(width: Column, height: Column, to_w: int = 1920, to_h: int = 1080) -> Column:
    """struct(w, h, x, y): size after scaling to cover, and the corner of the centred crop."""
    scale = F.greatest(to_w / width, to_h / height)
    w, h = F.greatest(F.bround(width * scale).cast("int"), F.lit(to_w)), F.greatest(F.bround(height * scale).cast("int"), F.lit(to_h))
    return F.struct(w.alias("w"), h.alias("h"), F.floor((w - to_w) / 2).alias("x"), F.floor((h - to_h) / 2).alias("y"))


def backoff(log: DataFrame, by: str = "user_id", order: str = "event_id", cooling: Column | None = None) -> DataFrame:
    """``log`` (``ok``) with ``k``, waits since the last success, and ``wait``, 60 * 2^k s up to 900.

    ``cooling``: seconds from the call until the first living key is free; a longer one is waited for.
    """
    w = Window.partitionBy(by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.col("ok").cast("int")).over(upto), F.lit(0))
    rows = log.withColumn("__run", run)
    inside = Window.partitionBy(by, "__run").orderBy(order)
    k = F.row_number().over(inside) - 1
    wait = F.when(~F.col("ok"), F.least(BACKOFF_FIRST * F.pow(F.lit(2.0), F.least(k, F.lit(10))), F.lit(float(BACKOFF_MOST))))
    if cooling is not None:
        wait = F.when(~F.col("ok"), F.greatest(wait, cooling))
    return rows.withColumn("k", k).withColumn("wait", wait).drop("__run")


def settle(outcomes: Column, engine: Column, fallback: Column, tries: int = 3) -> Column:
    """struct(ok, engine, used): what comes of a prompt whose calls end as ``outcomes`` says, in order.

    Transient failures count as tries; a permanent one, and running out of tries, send a
    prompt of the first engine to the other one where ``fallback`` allows it (with new
    tries after a permanent one, with one last call else).
    """

    def step(s, x):
        permanent, first = x == "permanent", s["engine"] == "gemini"
        spent = s["tries"] + 1 >= s["limit"]
        move = first & fallback & (permanent | spent)
        over = (x == "ok") | (~move & (permanent | spent))
        return F.when(s["done"], s).otherwise(
            F.struct(
                over.alias("done"),
                (x == "ok").alias("ok"),
                F.when((x != "ok") & move, "pollinations").otherwise(s["engine"]).alias("engine"),
                F.when(move, 0).otherwise(s["tries"] + 1).alias("tries"),
                F.when((x != "ok") & move & ~permanent, 1).otherwise(s["limit"]).alias("limit"),
                (s["used"] + 1).alias("used"),
            )
        )

    start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("ok"), engine.alias("engine"), F.lit(0).alias("tries"), F.lit(tries).alias("limit"), F.lit(0).alias("used"))
    return F.aggregate(outcomes, start, step, lambda s: F.struct(s["ok"].alias("ok"), s["engine"].alias("engine"), s["used"].alias("used")))


def key_ring(log: DataFrame, keys: int = 3, ring_col: str = "ring", schema_ts: str = "at") -> DataFrame:
    """Which key each call of a ring gets: round robin over keys that are neither dead nor cooling.

    ``log``: ``ring``, ``call``, ``at`` (seconds), ``outcome`` (ok, quota, dead) and ``wait_s``.
    Returns ``ring``, ``call``, ``key`` (-1 if all are cooling or dead). A ring's calls are a
    state machine, so each ring runs in one group; rings are many.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("call", kind="stable")
        until, dead, at, got = [0.0] * keys, [False] * keys, 0, []
        for now, outcome, wait in zip(pdf["at"], pdf["outcome"], pdf["wait_s"]):
            free = [(at + k) % keys for k in range(keys) if not dead[(at + k) % keys] and until[(at + k) % keys] <= now]
            key = free[0] if free else -1
            if key >= 0:
                at = (key + 1) % keys
                dead[key] = dead[key] or outcome == "dead"
                if outcome == "quota":
                    until[key] = now + max(5.0, wait)
            got.append(key)
        return pd.DataFrame({"ring": pdf[ring_col].to_numpy(), "call": pdf["call"].to_numpy(), "key": got})

    return log.groupBy(ring_col).applyInPandas(run, "ring long, call long, key int")


def spaced_starts(log: DataFrame, gap: float, by: str, order: str, at: str) -> DataFrame:
    """When calls start that arrive at ``at`` and must lie ``gap`` seconds apart, per ``by``.

    start_i = max over j <= i of (arrival_j + gap * (i - j)): a running maximum, no loop.
    """
    w = Window.partitionBy(by).orderBy(order)
    n = F.row_number().over(w)
    best = F.max(F.col(at) - gap * n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("start", best + gap * n)


#: Reasons for which a reply without an image is final.
BLOCKED = ("IMAGE_SAFETY", "PROHIBITED_CONTENT", "SAFETY", "BLOCKLIST", "RECITATION")
_PART = "struct<text:string,inlineData:struct<mimeType:string,data:string>,inline_data:struct<mime_type:string,data:string>>"
_REPLY = f"struct<candidates:array<struct<content:struct<parts:array<{_PART}>>,finishReason:string>>,promptFeedback:struct<blockReason:string>>"


def reply_image(reply: Column) -> Column:
    """struct(image, outcome) of a JSON reply: the first image of any candidate, else why there is none.

    A blocked prompt and the reasons in ``BLOCKED`` are permanent; anything else, an
    unreadable reply too, is transient.
    """
    r = F.from_json(reply, _REPLY)
    parts = F.flatten(F.transform(r["candidates"], lambda c: F.coalesce(c["content"]["parts"], F.array().cast(f"array<{_PART}>"))))
    kind = lambda p: F.coalesce(p["inlineData"]["mimeType"], p["inline_data"]["mime_type"])
    found = F.get(F.filter(parts, lambda p: F.startswith(kind(p), F.lit("image/"))), F.lit(0))
    data = F.coalesce(found["inlineData"]["data"], found["inline_data"]["data"])
    final = F.coalesce(r["promptFeedback"]["blockReason"], F.lit("")) != ""
    final = final | F.coalesce(F.get(r["candidates"], F.lit(0))["finishReason"].isin(*BLOCKED), F.lit(False))
    return F.struct(F.unbase64(data).alias("image"), F.when(data.isNotNull(), "ok").when(final, "permanent").otherwise("transient").alias("outcome"))


def request_body(prompt: Column, aspect_ratio: Column, image_size: Column, refused: Column) -> Column:
    """The JSON request for an image; settings that are empty or in the array ``refused`` are left out."""
    use = lambda name, value: F.when(~F.array_contains(refused, name), value)
    ratio, size = use("aspectRatio", F.nullif(aspect_ratio, F.lit(""))), use("imageSize", F.nullif(image_size, F.lit("")))
    image = use("imageConfig", F.when(ratio.isNotNull() | size.isNotNull(), F.struct(ratio.alias("aspectRatio"), size.alias("imageSize"))))
    kinds = use("responseModalities", F.array(F.lit("IMAGE")))
    config = F.when(kinds.isNotNull() | image.isNotNull(), F.struct(kinds.alias("responseModalities"), image.alias("imageConfig")))
    said = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(prompt.alias("text"))).alias("parts")))
    return F.to_json(F.struct(said.alias("contents"), config.alias("generationConfig")))


def image_accepted(content: Column, least_kb: int = 20) -> Column:
    """Whether bytes are large enough and begin like an image."""
    return F.coalesce((F.octet_length(content) >= least_kb * 1024) & image_kind(content).isNotNull(), F.lit(False))
