"""Health of contexts: token estimates, grades, strategies; error contexts as envelopes; scrubbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import noise, redaction, text, traces

# Limits in per cent, and texts.
MODERATE, CRITICAL = 25.0, 60.0
ADVICE = (
    "High framework noise detected. Route this payload through `get_error_context` with strategy='aggressive' to protect your LLM context window.",
    "Payload is token-lean. Ready for direct LLM reasoning.",
)
NO_FILE, NO_FRAME = "NO_LOCAL_APPLICATION_FRAME_DETECTED", "NO_LOCAL_FRAME_DETECTED"
NO_CONTEXT = "No local source context within workspace boundary."
TAG, VERSION = "SIEVEMILL", "1.0.0"


def tokens(s: Column) -> Column:
    return F.expr("0L") + F.floor(F.octet_length(s) / 4)


def saved(raw: Column, clean: Column) -> Column:
    return F.greatest(raw - clean, F.lit(0).cast("long"))


def noise_pct(raw: Column, clean: Column) -> Column:
    """Per cent of bytes dropped, one decimal, halves up; 0 for an empty text."""
    return F.when(raw > 0, F.round(saved(raw, clean) / raw * 100.0 * 10.0) / 10.0).otherwise(0.0)


def grade(pct: Column) -> Column:
    return F.when(pct > CRITICAL, "CRITICAL_BLOAT").when(pct > MODERATE, "MODERATE_BLOAT").otherwise("OPTIMAL")


def sized(rows: DataFrame, text_col: str, clean: Column) -> DataFrame:
    raw = F.octet_length(text_col).cast("long")
    rows = rows.withColumn("clean_bytes", F.octet_length(clean).cast("long")).withColumns({"raw_bytes": raw, "raw_tokens": tokens(F.col(text_col)), "clean_tokens": F.floor(F.col("clean_bytes") / 4)})
    rows = rows.withColumns({"noise_reduction_pct": noise_pct(F.col("raw_bytes"), F.col("clean_bytes")), "tokens_saved": saved(F.col("raw_tokens"), F.col("clean_tokens"))})
    return rows.withColumn("health_grade", grade(F.col("noise_reduction_pct")))


def measured(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """The numbers and the grade of an audit, without labels, hashes and advice: what totals need."""
    safe = redaction.fresh(logs.columns, "_safe")
    rows = redaction.redact_counted(logs, text_col, safe, "secrets_count")
    return sized(rows, text_col, noise.kept(F.col(safe))).drop(safe)


def audit(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """logs with the columns of a health audit: secrets masked first, then noise pruned."""
    safe, p = redaction.fresh(logs.columns, "_safe"), redaction.fresh(logs.columns, "_p")
    rows = redaction.redact_counted(logs, text_col, safe, "secrets_count").withColumn(p, noise.pruned(F.col(safe)))
    rows, high, less = sized(rows, text_col, F.col(p)["kept"]), F.col("noise_reduction_pct") > MODERATE, F.col("tokens_saved")
    compact = F.aggregate(F.filter(F.transform(text.lines(F.col(text_col)), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: x != ""), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 1)
    return rows.withColumns({
        "state": F.when(high, "REQUIRES_PRUNING").otherwise("OPTIMAL_HEALTH"),
        "suggested_action": F.when(high, "PRUNING_RECOMMENDED").otherwise("DIRECT_INGESTION_OPTIMAL"),
        "recommendation": F.when(high, ADVICE[0]).otherwise(ADVICE[1]),
        "dropped_frames": noise.summary(F.col(p)["dropped"], F.col(p)["categories"]),
        "dropped_frame_identities": F.col(p)["categories"],
        "raw_hash": F.concat(F.lit("sha256:"), F.sha2(text_col, 256)),
        "secrets_detected": (F.col("secrets_count") > 0) | (F.col(safe) != F.col(text_col)),
        "conservative_saved": F.floor(less * 7 / 10).cast("long"),
        "lossless_saved": F.floor(saved(F.col("raw_bytes"), compact) / 4).cast("long"),
    }).drop(safe, p)


def health(audited: DataFrame, *by: str) -> DataFrame:
    """Totals of audits by columns."""
    return audited.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("clean_bytes").alias("clean_bytes"), F.sum("tokens_saved").alias("tokens_saved"),
        F.sum("secrets_count").alias("secrets"), F.sum((F.col("health_grade") == "CRITICAL_BLOAT").cast("long")).alias("critical"),
    )


def error_context(logs: DataFrame, text_col: str = "text", strategy: str = "aggressive", files: Column | None = None, context: Column | None = None, tag: str = TAG, version: str = VERSION) -> DataFrame:
    """logs with clean_text, envelope and report. files: the files of its frames that could be read, in order (by default
    those of all distinct locations that aren't noise); context: their source windows."""
    rows = redaction.redact_counted(logs, text_col, "_safe", "secrets_count").withColumn("_p", noise.pruned(F.col("_safe")))
    compact = strategy == "lossless_compact"
    clean = text.lossless_compact(F.col("_safe")) if compact else F.col("_p.kept")
    frames = F.filter(traces.all_locations(F.col("_safe")), lambda x: ~noise.is_noise(x["file"]))
    files = F.array_distinct(F.transform(frames, lambda x: x["file"])) if files is None else files
    rows = rows.withColumns({"clean_text": clean, "_files": files, "_raw": F.octet_length(text_col).cast("long")})
    less = saved(F.col("_raw"), F.octet_length("clean_text").cast("long"))
    pct = F.when(F.col("_raw") > 0, F.floor(less * 100 / F.col("_raw"))).otherwise(0).cast("long")
    dropped = F.lit("0 frames (lossless_compact)") if compact else noise.summary(F.col("_p.dropped"), F.col("_p.categories"))
    fields = {
        "STATE": F.lit("FRAMEWORK_NOISE_PURGED"),
        "STRATEGY_APPLIED": F.lit(strategy.upper()),
        "": F.format_string("ORIGINAL_BYTES=%d | CLEAN_BYTES=%d | REDUCTION=%d%%", F.col("_raw"), F.octet_length("clean_text").cast("long"), pct),
        "ESTIMATED_TOKENS_SAVED": F.floor(less / 4).cast("long").cast("string"),
        "DROPPED_FRAMES": dropped,
        "RAW_RETRIEVAL_HASH": F.concat(F.lit("sha256:"), F.sha2(text_col, 256)),
        "SECRETS_NEUTRALIZED": F.col("secrets_count").cast("string"),
        "PRIMARY_CRASH_COORDINATES": F.when(F.size("_files") > 0, F.array_join("_files", ", ")).otherwise(NO_FILE),
        "SUGGESTED_NEXT_FRAME": F.coalesce(F.get("_files", F.lit(0)), F.lit(NO_FRAME)),
    }
    parts = [F.lit(f"[:{tag}:M2M_CONTROL_PLANE:v{version}]"), F.lit("[ADVISORY_ONLY=true]")]
    parts += [F.concat(F.lit(f"[{k}=" if k else "["), v, F.lit("]")) for k, v in fields.items()]
    envelope = F.concat_ws("\n", *parts, F.lit("[:END_CONTROL_PLANE]"))
    shown = F.lit(NO_CONTEXT) if context is None else F.when(F.coalesce(context, F.lit("")) == "", NO_CONTEXT).otherwise(context)
    rows = rows.withColumn("envelope", envelope)
    report = F.concat(F.col("envelope"), F.lit("\n\n=== SANITIZED APPLICATION LOG ===\n"), F.col("clean_text"), F.lit("\n\n=== RELEVANT WORKSPACE CONTEXT ===\n"), shown)
    return rows.withColumn("report", report).drop("_safe", "_p", "_files", "_raw")


def parsed_envelope(s: Column, tag: str = TAG) -> Column:
    """The fields of the first envelope in a text; null without one. Byte counts and per cent aren't read and are 0."""
    block = F.regexp_extract(s, rf"(\[:{tag}:M2M_CONTROL_PLANE:[\s\S]*?\[:END_CONTROL_PLANE\])", 1)
    line = lambda name: F.regexp_extract(block, rf"(?m)^[ \t]*\[{name}=(.*)\][ \t\r]*$", 1)
    number = lambda name: F.coalesce(line(name).try_cast("bigint"), F.lit(0).cast("long"))
    old = F.regexp_replace(line("COGNITIVE_DIRECTIVE"), r"\AINSPECT_CALLER_AT_", "")
    zero = F.lit(0).cast("long")
    found = F.struct(
        F.regexp_extract(block, rf"(?m)^[ \t]*\[:{tag}:M2M_CONTROL_PLANE:(v.*)\][ \t\r]*$", 1).alias("version"),
        block.rlike(r"(?m)^[ \t]*\[ADVISORY_ONLY=true\][ \t\r]*$").alias("advisory_only"),
        line("STATE").alias("state"), line("STRATEGY_APPLIED").alias("strategy_applied"),
        zero.alias("original_bytes"), zero.alias("clean_bytes"), zero.alias("reduction_pct"),
        number("ESTIMATED_TOKENS_SAVED").alias("estimated_tokens_saved"), line("DROPPED_FRAMES").alias("dropped_frames"),
        line("RAW_RETRIEVAL_HASH").alias("raw_retrieval_hash"), number("SECRETS_NEUTRALIZED").alias("secrets_neutralized"),
        line("PRIMARY_CRASH_COORDINATES").alias("primary_crash_coordinates"),
        F.when(line("SUGGESTED_NEXT_FRAME") != "", line("SUGGESTED_NEXT_FRAME")).otherwise(old).alias("suggested_next_frame"),
    )
    return F.when(block != "", found)


def scrubbed(s: Column) -> Column:
    """Noise pruned first, then secrets masked (the other order than audit's)."""
    return redaction.redact(noise.kept(s))


def verify(hashes: DataFrame, store: DataFrame) -> DataFrame:
    """Stored raw texts by hash, pruned and masked again: hash, raw_bytes, clean_bytes, clean. store: hash, content."""
    rows = hashes.select(F.regexp_replace("hash", r"\A(?:sha256:)+", "").alias("hash")).join(store.select("hash", "content"), "hash")
    rows = rows.withColumn("clean", scrubbed(F.col("content")))
    return rows.select("hash", F.octet_length("content").cast("long").alias("raw_bytes"), F.octet_length("clean").cast("long").alias("clean_bytes"), "clean")


def diagnosis(log: Column, context: Column, diff: Column | None = None, refs: Column | None = None) -> Column:
    """What is sent for a diagnosis: pruned log, context and, where there are any, diff and references; then masked."""
    parts = [F.concat(F.lit("Log:\n"), noise.kept(log)), F.concat(F.lit("\n\nContext:\n"), context)]
    parts += [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(head), c)).otherwise("") for head, c in (("\n\nRecent changes:\n", diff), ("\n\nReferences:\n", refs)) if c is not None]
    return redaction.redact(F.concat(*parts))
