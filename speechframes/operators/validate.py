"""Validation with reject reasons, in order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframes.functions import formats
from speechframes.functions.text import strip
from speechframes.operators import scan

# fixed values: the rules of each kind of stream, in their order of precedence
PROFILES = {
    "strict": {"rate": 16000, "most_bytes": 32000, "rules": ("tenant-too-long", "tenant-changed", "language-changed", "unsupported-language", "sequence-gap", "sample-rate", "empty-payload", "odd-payload", "payload-too-long")},
    "epoch": {"rate": 16000, "most_bytes": None, "rules": ("missing-session-id", "sequence-gap", "sample-rate", "odd-payload", "unsupported-language", "language-changed")},
    "native": {"rate": 16000, "most_bytes": 1 << 20, "rules": ("invalid-session-id", "sequence-gap", "sample-rate", "odd-payload", "payload-too-long", "unsupported-language", "language-changed", "invalid-tenant-id", "tenant-changed")},
}
IDENTIFIER = r"^[A-Za-z0-9_-]{1,64}$"
BIN = 4096
UPLOAD_BYTES = 512 << 20
UPLOAD_SECONDS = 4 * 3600


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that is broken, null if none is."""
    return F.coalesce(*[F.when(broken, name) for name, broken in rules])


def validate_chunks(chunks: DataFrame, keys: list[str], languages: list[str], profile: str = "strict", order: list[str] = ("arrival",), session: str = "session_id") -> DataFrame:
    """chunks with reason: the first broken rule of the profile.

    Tenant and language must stay those of the first chunk, and seq must run
    without gap from any start. An empty language stands for none and is always
    supported. ``native`` and ``epoch`` accept empty payloads and judge the
    language's name at the first chunk only; ``epoch`` bounds no payload.
    """
    p = PROFILES[profile]
    # bins of 4,096 arrivals: a stream of any length is the work of many tasks
    columns, chunks = chunks.columns, scan.with_previous(chunks, keys, list(order), BIN, "_ahead", "_opened")
    ahead = F.col("_ahead.seq")
    opening = F.col("_ahead").isNull()
    language, owner = (lambda at: F.coalesce(F.col(f"{at}lang"), F.lit(""))), (lambda at: F.coalesce(F.col(f"{at}tenant_id").cast("string"), F.lit("")))
    lang, tenant = language(""), owner("")
    changed = lambda named: named("") != named("_opened.")
    unknown = (lang != "") & ~lang.isin(languages)
    broken = {
        "missing-session-id": F.coalesce(F.col(session).cast("string"), F.lit("")) == "",
        "invalid-session-id": ~F.coalesce(F.col(session).cast("string").rlike(IDENTIFIER), F.lit(False)),
        "tenant-too-long": F.length(tenant) > 256,
        "invalid-tenant-id": opening & (tenant != "") & ~tenant.rlike(IDENTIFIER),
        "tenant-changed": changed(owner),
        "language-changed": changed(language),
        "unsupported-language": unknown if profile == "strict" else unknown & opening,
        "sequence-gap": ahead.isNotNull() & (F.col("seq") != ahead + 1),
        "sample-rate": F.col("sample_rate") != p["rate"],
        "empty-payload": F.col("payload_bytes") == 0,
        "odd-payload": F.col("payload_bytes") % 2 != 0,
        "payload-too-long": F.col("payload_bytes") > p["most_bytes"] if p["most_bytes"] else F.lit(False),
    }
    reason = first_reason(*[(rule, broken[rule]) for rule in p["rules"]])
    return chunks.withColumn("reason", reason).select(*dict.fromkeys([*columns, "reason"]))


def valid_prefix(validated: DataFrame, keys: list[str], order: list[str] = ("arrival",)) -> DataFrame:
    """The chunks of each stream before its first rejected one."""
    return scan.before_first(validated, keys, list(order), BIN, F.col("reason").isNotNull())


def upload_reason(session: Column, tenant: Column, url: Column, bucket: str) -> Column:
    suffix = F.concat(tenant, F.lit("/uploads/"), session, F.lit("/source"))
    key = formats.s3_key(url)
    inside = (formats.s3_bucket(url) == bucket) & ((key == suffix) | F.endswith(key, F.concat(F.lit("/"), suffix)))
    return first_reason(
        ("invalid-session-id", ~F.coalesce(session.rlike(formats.UUID), F.lit(False))),
        ("invalid-tenant-id", ~F.coalesce(tenant.rlike(formats.TENANT), F.lit(False))),
        ("foreign-source", ~F.coalesce(inside, F.lit(False))),
    )


def upload_bounds(n_bytes: Column, duration_s: Column | None = None, want_final: Column | None = None, most_bytes: int = UPLOAD_BYTES) -> Column:
    rules = [("final-disabled", ~want_final)] if want_final is not None else []
    rules += [("missing-source", n_bytes.isNull()), ("no-audio", n_bytes == 0), ("too-large", n_bytes > most_bytes)]
    if duration_s is not None:
        rules.append(("too-long", duration_s > UPLOAD_SECONDS))
    return first_reason(*rules)


def manifest_reason(manifest: DataFrame) -> Column:
    """speaker_id, label, and at least one sample, all with a url."""
    return first_reason(
        ("missing-speaker-id", F.coalesce(strip("speaker_id"), F.lit("")) == ""),
        ("missing-label", F.coalesce(strip("label"), F.lit("")) == ""),
        ("no-samples", F.coalesce(F.size("samples"), F.lit(0)) <= 0),
        ("sample-without-url", ~F.forall("samples", lambda s: F.coalesce(strip(s["url"]), F.lit("")) != "")),
    )


def strict_manifest_reason(folder: Column, root: str, tenant: Column) -> Column:
    """The stricter gallery policy: own folder, bounded label and samples, urls inside the speaker's samples folder."""
    inside = F.concat(F.lit(root.rstrip("/") + "/"), tenant, F.lit("/speakers/"), folder, F.lit("/samples/"))
    bad_url = F.exists("samples", lambda s: ~F.startswith(s["url"], inside) | s["url"].rlike(r"[?#]|(^|/)\.\.(/|$)"))
    return first_reason(
        ("foreign-folder", F.col("speaker_id") != folder),
        ("bad-label", (F.length("label") > 128) | F.col("label").rlike(r"[\x00-\x1f\x7f]") | F.col("label").rlike("^SPEAKER_")),
        ("too-many-samples", F.size("samples") > 5),
        ("foreign-sample", bad_url),
    )


def config_conflicts(configs: DataFrame, keys: list[str], knobs: list[str]) -> DataFrame:
    """Sessions whose settings change, after rounding to six decimals."""
    fingerprint = F.struct(*[F.round(F.col(k).cast("double"), 6).alias(k) for k in knobs])
    return configs.groupBy(*keys).agg(F.count_distinct(fingerprint).alias("n_configs")).where("n_configs > 1")
