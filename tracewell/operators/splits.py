"""Top-k, vocabularies, de-duplication, sampling and leakage-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import constants as K
from tracewell.functions.scalars import last_segment
from tracewell.operators.joins import vector_columns, vector_keys
from tracewell.operators.normalize import is_recon, lookup
from tracewell.operators.partition import (
    draw_key,
    draw_number,
    range_totals,
    running_totals,
)
from tracewell.session import broadcast_if_small, materialize, small_side


def topk_sources(df: DataFrame, k: int, key: str = "src_ip", label: str = "label") -> DataFrame:
    """Sources with most attack rows and their share of all attacks."""
    per = df.where(F.col(label) == 1).groupBy(key).agg(F.count(F.lit(1)).alias("attacks"))
    total = df.agg(F.count_if(F.col(label) == 1)).first()[0]
    return per.orderBy(F.desc("attacks"), key).limit(k).select(
        key, "attacks", (F.col("attacks") / F.lit(max(total, 1))).alias("share"))


def vocabulary(tokens: DataFrame, column: str = "token") -> DataFrame:
    """Sorted distinct tokens numbered from 2, after ``<PAD>`` and ``<UNK>``.

    Numbers come from running sums over sampled ranges, so no task sorts all tokens.
    """
    distinct = tokens.select(F.col(column).alias("token")).distinct()
    numbered = range_totals(distinct, [F.col("token")], {"id": F.lit(1)})
    special = distinct.sparkSession.createDataFrame(
        [("<PAD>", 0), ("<UNK>", 1)], "token string, id bigint")
    return numbered.select("token", (F.col("id") + 1).cast("bigint").alias("id")).unionByName(special)


def encode_tokens(df: DataFrame, vocab: DataFrame, ids: list[str], column: str = "tokens",
                  literal_rows: int = 1_000) -> DataFrame:
    """Token arrays to id arrays, unknown tokens to 1.

    A counted, small vocabulary becomes a map literal and the arrays are rewritten in place. A
    larger one is joined per token, broadcast while its size allows it.
    """
    known = vocab.limit(literal_rows + 1).collect()
    if len(known) <= literal_rows:
        items = [F.lit(x) for r in known for x in (r["token"], r["id"])]
        codes = F.create_map(*items)
        return df.select(*ids, F.transform(column, lambda t: F.coalesce(
            F.try_element_at(codes, t), F.lit(1))).alias("token_ids"))
    keyed = df.select(*ids, column).withColumn("_row", F.monotonically_increasing_id())
    parts = keyed.select("*", F.posexplode_outer(column).alias("_i", "token"))
    small = broadcast_if_small(vocab.select("token", F.col("id").alias("_id")))
    coded = parts.join(small, "token", "left").withColumn("_id", F.coalesce("_id", F.lit(1)))
    # One row per input row, whatever its ids are; a null array stays null and an empty one empty.
    item = F.when(F.col("_i").isNotNull(), F.struct("_i", "_id"))
    out = coded.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in ids], F.first(F.col(column).isNull()).alias("_null"),
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_id"]).alias("_codes"))
    return out.select(*ids, F.when(~F.col("_null"), F.col("_codes")).alias("token_ids"))


def encode_category(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Dense codes of the reference's sorted values; -1 for values it never had."""
    distinct = reference.select(column).distinct()
    codes = range_totals(distinct, [F.col(column)], {"_code": F.lit(1)})
    return (df.join(codes.select(column, (F.col("_code") - 1).alias("code")), column, "left")
            .withColumn("code", F.coalesce("code", F.lit(-1))))


def dedup_vectors(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Distinct (rounded vector, label); the grouping is combined map-side."""
    keys = vector_keys(features)
    out = vector_columns(df, features).select(*keys, label).distinct()
    return out.select(*[F.col(k).alias(f) for k, f in zip(keys, features)], label)


def class_weight(df: DataFrame, label: str = "label", cap: float | None = K.MAX_CLASS_WEIGHT
                 ) -> DataFrame:
    """negatives / positives, at least 1 and at most the cap."""
    out = df.agg(F.count_if(F.col(label) == 0).alias("negatives"),
                 F.count_if(F.col(label) == 1).alias("positives"))
    ratio = F.greatest(F.lit(1.0), F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)))
    return out.withColumn("weight", F.least(ratio, F.lit(cap)) if cap else ratio)


def time_fraction(df: DataFrame, frac: float = 0.7, keys: list[str] | None = None,
                  us: str = "us", tie: str = "audit_id", bucket_us: int = 3_600_000_000
                  ) -> DataFrame:
    """First ``frac`` of the rows by time is train. Positions come from bucket prefix sums."""
    pos = running_totals(df, [F.col(us), F.col(tie)], F.floor(F.col(us) / bucket_us),
                         {"_pos": F.lit(1)}, keys)
    return pos.withColumn("split", F.when(
        F.col("_pos") <= F.floor(F.col("_pos_all") * frac), "train").otherwise("test")
    ).drop("_pos", "_pos_all")


def halves(df: DataFrame, row_id: str = "row_id", keys: list[str] | None = None,
           bucket_rows: int = 100_000) -> DataFrame:
    """First half of the rows by id is for calibration, the rest for evaluation."""
    pos = running_totals(df, [F.col(row_id)], F.floor(F.col(row_id) / bucket_rows),
                         {"_pos": F.lit(1)}, keys)
    return pos.withColumn("half", F.when(
        F.col("_pos") <= F.floor(F.col("_pos_all") / 2), "calibration").otherwise("evaluation")
    ).drop("_pos", "_pos_all")


def tool_part(tool: Column, user: Column, session: Column) -> Column:
    """Partition of a window by tool, identity and session."""
    uid = last_segment(user)
    trained = [f"{t}|{u}" for t, users in K.TRAIN_IDENTITIES.items() for u in users]
    held = {t: f"{t}_eval" for t in (
        "stratus", "peirates", "lowslow", "persistence", "lateralext", "compromised", "lateral",
        "escv")}
    held["rakkess"] = "recon_eval"
    # The varied identities of these two tools are evaluated, their older templates dropped.
    varied = F.when(uid.contains("impv"), "impact_eval").otherwise("drop")
    return F.coalesce(
        F.when(F.concat_ws("|", tool, uid).isin(trained), "train"),
        lookup(held, tool),
        F.when(tool == "impact", varied),
        F.when(tool == "evasion", F.when(uid.contains("evav"), "evasion_eval").otherwise("drop")),
        F.when(is_recon(uid), F.when(session.isin(5, 6), "recon_eval")
               .otherwise("train_recon_excl")),
        F.when(session.isin(5, 6), "test"),
        F.lit("train"))


def identity_split(df: DataFrame, assignment: DataFrame, key: str = "uid") -> DataFrame:
    """Split by an identity -> part table; unlisted identities are held out."""
    return df.join(broadcast_if_small(assignment), key, "left").withColumn("part", F.coalesce("part", F.lit("ho")))


def session_split(df: DataFrame, frac: float = 0.7, session: str = "session") -> DataFrame:
    """First ``frac`` of the session ids is train."""
    ids = df.select(session).distinct()
    pos = running_totals(ids, [F.col(session)], F.floor(F.col(session) / 1024), {"_p": F.lit(1)})
    part = F.when(F.col("_p") <= F.floor(F.col("_p_all") * frac), "train").otherwise("test")
    return df.join(small_side(pos.select(session, part.alias("split"))), session)


def holdout_file(df: DataFrame, held_out: str | None = None, frac: float = 0.7,
                 column: str = "source_file") -> DataFrame:
    """One named file held out, or the earliest ``frac`` of the files as train."""
    if held_out is not None:
        return df.withColumn("split", F.when(F.col(column) == held_out, "test").otherwise("train"))
    files = materialize(df.select(column).distinct())
    ranked = range_totals(files, [F.col(column)], {"_p": F.lit(1)})
    part = F.when(F.col("_p") <= F.floor(F.lit(files.count() * frac)), "train").otherwise("test")
    return df.join(broadcast_if_small(ranked.select(column, part.alias("split"))), column)


def leave_heavy_hitter_out(df: DataFrame, k: int, test_percent: int = 30, seed: int = 42,
                           key: str = "src_ip", label: str = "label", row_id: str = "row_id"
                           ) -> DataFrame:
    """Top-k attackers are test; benign rows split by hash; minor attackers are train."""
    top = topk_sources(df, k, key, label)
    marked = df.join(broadcast_if_small(top.select(key, F.lit(1).alias("_heavy"))), key, "left")
    draw = draw_number(draw_key([row_id], seed)) % 100 < test_percent
    test = F.when(F.col(label) == 1, F.coalesce(F.col("_heavy"), F.lit(0)) == 1).otherwise(draw)
    return marked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_heavy")


def stratified_split(df: DataFrame, frac: float = 0.8, label: str = "label",
                     row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly ``frac`` of each class in train, drawn by hash order."""
    out = df.withColumn("_h", draw_key([row_id], seed))
    pos = running_totals(out, [F.col("_h"), F.col(row_id)], draw_number(F.col("_h"), 3),
                         {"_p": F.lit(1)}, [label])
    return pos.withColumn("split", F.when(
        F.col("_p") <= F.floor(F.col("_p_all") * frac), "train").otherwise("test")
    ).drop("_h", "_p", "_p_all")


def sample_stratified(df: DataFrame, n: int, label: str = "label", row_id: str = "row_id",
                      seed: int = 123) -> DataFrame:
    """n rows, half from each class where possible, topped up from the rest."""
    out = df.withColumn("_h", draw_key([row_id], seed))
    pos = running_totals(out, [F.col("_h"), F.col(row_id)], draw_number(F.col("_h"), 3),
                         {"_p": F.lit(1)}, [label])
    first = F.when(F.col("_p") <= max(1, n // 2), 0).otherwise(1)
    return pos.orderBy(first, "_h", row_id).limit(n).drop("_h", "_p", "_p_all")


def sample_n(df: DataFrame, n: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    return df.orderBy(draw_key([row_id], seed), row_id).limit(n)


def strata_report(eps: DataFrame, profile: str = "profile", split: str = "split",
                  min_recon: int = 4) -> DataFrame:
    """Episodes per profile and half; ``passes`` when both halves have enough."""
    least = F.when(F.col(profile) == "recon", min_recon).otherwise(1)
    return eps.groupBy(profile).agg(
        F.count_if(F.col(split) == "train").alias("train_episodes"),
        F.count_if(F.col(split) == "test").alias("test_episodes")
    ).withColumn("passes", (F.col("train_episodes") > 0) & (F.col("test_episodes") >= least))


def assert_strata(report: DataFrame, profiles: list[str]) -> None:
    """Every profile in both halves and enough recon test episodes."""
    good = {r["profile"] for r in report.where(
        F.col("profile").isin(profiles) & F.col("passes")).collect()}
    if set(profiles) - good:
        raise ValueError(f"profiles short of episodes in a half: {sorted(set(profiles) - good)}")


def oversample(df: DataFrame, cond: Column, times: int = 12) -> DataFrame:
    """Repeat the rows of a small domain."""
    copies = F.when(cond, times).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Stack frames with differing columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of both sets, of the first only and of the second only."""
    return (a.intersect(b).withColumn("side", F.lit("both"))
            .unionByName(a.subtract(b).withColumn("side", F.lit("left")))
            .unionByName(b.subtract(a).withColumn("side", F.lit("right"))))
