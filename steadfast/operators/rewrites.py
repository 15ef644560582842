"""Rewrite records: last write wins, retention verdicts, validity, intersection."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfast import lexicons as L
from steadfast.functions import hashing as H
from steadfast.functions import text as X
from steadfast.functions import urls as U
from steadfast.operators.sampling import seeded_sample
from steadfast.operators.support import pinned
from steadfast.schemas import severity_key


VERDICT_COLUMNS = (
    "n_orig_urls", "missing_urls", "retained_urls", "match_kind", "n_primary_urls",
    "primary_urls", "missing_primary_urls", "retained_primary",
)


def union_generators(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Union of the generators that are present, tagged with their name."""
    present = [t.withColumn("generator", F.lit(n)) for n, t in tables.items() if t is not None]
    if not present:
        raise FileNotFoundError("no rewrite table is available")
    out = present[0]
    for table in present[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def latest_rewrites(
    df: DataFrame, keys: Sequence[str] = ("original_id", "severity"),
    order: Sequence[str] = ("ts", "pos"),
) -> DataFrame:
    """Last record per key; `order` tells the records of a key apart. The last ones are found
    on keys and order alone, combined before the shuffle; the wide rows are then matched to
    them, so no text is sorted and a key written very often costs one narrow row a task."""
    names = [*keys, *order]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f"_last.{c}").alias(f"_k_{c}") for c in order]
    )
    same = F.lit(True)
    for name in names:
        same = same & df[name].eqNullSafe(last[f"_k_{name}"])
    return df.join(last, same, "left_semi")


def with_verdicts(df: DataFrame, original: str = "original_text", rewrite: str = "rewrite_text") -> DataFrame:
    """Adds both retention verdicts and the refusal flag to rows holding both texts."""
    judged = df.withColumn("_v", U.retention(F.col(original), F.col(rewrite)))
    kept = [c for c in df.columns if c not in VERDICT_COLUMNS and c != "refused"]
    return judged.select(
        *kept, *[F.col(f"_v.{c}") for c in VERDICT_COLUMNS],
        X.looks_like_refusal(F.col(rewrite)).alias("refused"),
    )


def is_valid(retained: str = "retained_urls", refused: str = "refused") -> Column:
    """No URL to check (null) is not valid; a missing refusal flag means not refused."""
    return F.coalesce(F.col(retained), F.lit(False)) & ~F.coalesce(F.col(refused), F.lit(False))


def retention_label(
    retained: str = "retained_urls", missing: str = "missing_urls", total: str = "n_orig_urls"
) -> Column:
    failed = F.format_string("FAIL (missing %d/%d)", F.size(missing), F.col(total))
    return (
        F.when(F.coalesce(F.col("refused"), F.lit(False)), "REFUSED")
        .when(F.col(retained).isNull(), "manual (no URL)")
        .when(F.col(retained), "PASS")
        .otherwise(failed)
    )


def retention_summary(df: DataFrame, keys: Sequence[str] = ("severity",), retained: str = "retained_urls") -> DataFrame:
    refused = F.coalesce(F.col("refused"), F.lit(False))
    kept = F.col(retained)
    return df.groupBy(*keys).agg(
        F.count_if(~refused & F.coalesce(kept, F.lit(False))).alias("pass"),
        F.count_if(~refused & ~F.coalesce(kept, F.lit(True))).alias("fail"),
        F.count_if(~refused & kept.isNull()).alias("manual"),
        F.count_if(refused).alias("refused"),
        F.count("*").alias("total"),
    )


def intersection_ids(
    df: DataFrame, valid: Column, keys: Sequence[str] = ("original_id",),
    severities: Sequence[float] = L.REWRITE_SEVERITIES,
) -> DataFrame:
    """Ids valid at every listed severity. Each row contributes one bit; the bits are
    or-ed, so this is a plain mergeable aggregate."""
    bit = F.lit(0)
    for i, s in enumerate(severities):
        bit = F.when(severity_key(F.col("severity")) == F.lit(f"{s:.2f}").cast("decimal(3,2)"), 1 << i).otherwise(bit)
    seen = F.bit_or(F.when(valid, bit).otherwise(0))
    full = (1 << len(severities)) - 1
    return df.groupBy(*keys).agg(seen.alias("_seen")).where(F.col("_seen") == full).drop("_seen")


def valid_counts(df: DataFrame, valid: Column, keys: Sequence[str] = ("severity",)) -> DataFrame:
    return df.where(valid).groupBy(*keys).agg(F.count("*").alias("n_valid"))


def reconcile(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds status hit / stale / miss to (original_id, severity) work rows that carry the
    wanted prompt_hash and input_text_sha. A cached row without a text hash passes."""
    keys = ["original_id", "_sev"]
    have = cache.select(
        "original_id", severity_key(F.col("severity")).alias("_sev"), F.col("prompt_hash").alias("_ph"), F.col("input_text_sha").alias("_th"),
        F.lit(True).alias("_cached"),
    )
    same_text = F.coalesce(F.col("_th"), F.col("input_text_sha")) == F.col("input_text_sha")
    hit = F.coalesce((F.col("_ph") == F.col("prompt_hash")) & same_text, F.lit(False))
    status = F.when(F.col("_cached").isNull(), "miss").when(hit, "hit").otherwise("stale")
    keyed = work.withColumn("_sev", severity_key(F.col("severity")))
    return keyed.join(have, keys, "left").select(*work.columns, status.alias("status"))


def worklist(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Work rows that no usable cached record satisfies."""
    have = cache.select(
        "original_id", "severity", "prompt_hash", F.col("input_text_sha").alias("_th")
    )
    w, c = work.alias("w"), have.alias("c")
    same = (
        (F.col("w.original_id") == F.col("c.original_id"))
        & (severity_key(F.col("w.severity")) == severity_key(F.col("c.severity")))
        & (F.col("w.prompt_hash") == F.col("c.prompt_hash"))
        & (F.col("c._th").isNull() | (F.col("c._th") == F.col("w.input_text_sha")))
    )
    return w.join(c, same, "left_anti")


def severity_grid(df: DataFrame, severities: Sequence[float] = L.REWRITE_SEVERITIES) -> DataFrame:
    """Every row at every severity, as an in-row explode of a literal list."""
    return df.withColumn("severity", F.explode(F.array(*[F.lit(float(s)) for s in severities])))


def make_records(df: DataFrame) -> DataFrame:
    """Record projection for raw outputs: header split, verdicts, content hashes. Input has
    original_id, source, text, severity, provider, model, temperature, prompt, instruction,
    raw, usage, ts."""
    parsed = df.withColumn("_p", X.parse_rewrite(F.col("raw"))).withColumns({
        "rewrite_subject": F.col("_p.subject"),
        "rewrite_body": F.col("_p.body"),
        "rewrite_text": F.col("_p.text"),
    }).drop("_p")
    judged = with_verdicts(parsed, "text", "rewrite_text")
    return judged.withColumns({
        "severity": F.round("severity", 2),
        "prompt_hash": H.prompt_hash(
            F.col("prompt"), F.col("instruction"), F.col("text"), F.col("model"),
            F.format_string("%.4f", F.col("temperature")),
        ),
        "input_text_sha": H.text_sha(F.col("text")),
        "had_html": F.lit(False),
    })


def condition_texts(originals: DataFrame, rewrites: DataFrame, ids: DataFrame) -> DataFrame:
    """(original_id, severity, text, had_html) for the given ids: the original text at
    severity 0, the rewrite elsewhere."""
    base = originals.join(ids, "original_id", "left_semi").select(
        "original_id", F.lit(0.0).alias("severity"), "text",
        F.coalesce("had_html", F.lit(False)).alias("had_html"),
    )
    moved = rewrites.join(ids, "original_id", "left_semi").select(
        "original_id", F.col("severity").cast("double").alias("severity"),
        F.col("rewrite_text").alias("text"),
        F.coalesce("had_html", F.lit(False)).alias("had_html"),
    )
    return base.unionByName(moved)


def augment_training(
    train: DataFrame, rewrites: DataFrame, valid: Column,
    severities: Sequence[float] = L.AUGMENT_SEVERITIES,
) -> DataFrame:
    """Training rows plus passing rewrites at the chosen severities, as positives."""
    grid = [F.lit(f"{s:.2f}").cast("decimal(3,2)") for s in severities]
    extra = rewrites.where(valid & severity_key(F.col("severity")).isin(*grid)).select(
        F.col("rewrite_text").alias("text"),
        F.coalesce("had_html", F.lit(False)).alias("had_html"), F.lit(1).alias("label"),
        F.concat_ws("|", "original_id", severity_key(F.col("severity")).cast("string")).alias("row_id"),
    )
    base = train.select("text", "had_html", F.col("label").cast("int").alias("label"), F.col("original_id").alias("row_id"))
    return base.unionByName(extra)


def spotcheck_pairs(df: DataFrame, n_pass: int = 30, n_fail: int = 10, seed=L.SEED, clip: int = 4000) -> DataFrame:
    """Seeded PASS and FAIL pairs with both texts (missing originals give '')."""
    failed = ~F.coalesce(F.col("retained_urls"), F.lit(True)) & ~F.coalesce(F.col("refused"), F.lit(False))
    keyed = df.withColumns({
        "verdict": F.when(is_valid(), "PASS").when(failed, "FAIL"),
        "_pair": F.concat_ws("|", *_pair_key(df)),
    })
    # Sampling reads its input several times: give it pinned keys, not texts. Those without a verdict go afterwards;
    # a filter before would judge every pair a second time.
    keys = pinned(keyed.select("_pair", "verdict"))
    passed, not_passed = (
        seeded_sample(keys.where(F.col("verdict") == name), "_pair", n, seed=seed)
        for name, n in (("PASS", n_pass), ("FAIL", n_fail))
    )
    # At most n_pass + n_fail keys. As a filter they are looked for before anything is judged again.
    chosen = [r["_pair"] for r in passed.unionByName(not_passed).select("_pair").distinct().collect()]
    return keyed.where(F.col("_pair").isin(chosen)).select(
        "verdict", "original_id", "severity", "n_orig_urls",
        F.array_join("missing_urls", "; ").alias("missing_urls"), "refused",
        X.clip(F.col("original_text"), clip).alias("original_text"),
        X.clip(F.col("rewrite_text"), clip).alias("rewrite_text"),
    )


def _pair_key(df: DataFrame) -> list:
    parts = ["original_id", "generator"] if "generator" in df.columns else ["original_id"]
    return [F.col(p) for p in parts] + [F.format_string("%.2f", F.col("severity").cast("double"))]
