"""Train, test and validation sides: exact, reproducible, and assigned without shuffling full rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.operators.encode import ONE_HOTS
from flowsift.operators.ranks import RANKED_ROWS, at_or_before, bucket_counts, digest_bucket, digest_columns, rank_cut
from flowsift.schema import SOURCE_DAY, TARGET, TIMESTAMP
from flowsift.session import materialise

# Share held out and the seed.
TEST_SHARE = 0.2
SEED = 42


def class_quotas(df: DataFrame, target: str = TARGET, share: float = TEST_SHARE, rows: Column | None = None) -> DataFrame:
    """Held-out rows per class: ``ceil(share * n)`` in total, split by largest remainder.

    The training side is apportioned and the rest held out; an exact tie favours the smaller class value.
    Products of row counts outgrow a long, hence the decimals. Where a row of ``df`` stands for several, ``rows`` says how many.
    """
    wide = "decimal(38,0)"
    classes = df.groupBy(target).agg(F.sum(F.lit(1) if rows is None else rows).cast("long").alias("rows"))
    everything = Window.partitionBy(F.lit(0))
    held = F.ceil(F.lit(share) * F.sum("rows").over(everything))
    sized = classes.withColumn("_all", F.sum("rows").over(everything)).withColumn("_train", F.col("_all") - held)
    product = F.col("rows").cast(wide) * F.col("_train").cast(wide)
    parts = sized.withColumn("_rest", (product % F.col("_all").cast(wide)).cast(wide)).withColumn(
        "_floor", ((product - F.col("_rest")) / F.col("_all").cast(wide)).cast("long")
    )
    spare = F.col("_train") - F.sum("_floor").over(everything)
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), target))
    return (
        parts.withColumn("_spare", spare)
        .withColumn("_turn", turn)
        .withColumn("train_rows", F.col("_floor") + (F.col("_turn") <= F.col("_spare")).cast("long"))
        .select(target, "rows", "train_rows", (F.col("rows") - F.col("train_rows")).alias("test_rows"))
    )


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    target: str = TARGET,
    share: float = TEST_SHARE,
    seed: int = SEED,
    names: tuple[str, str] = ("train", "test"),
    side: str = "side",
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Add ``side`` so that each class gives exactly its quota to the held-out side.

    Rows are ordered by the md5 of their unique ``key`` and the seed. Only key and target are read to
    find the cut, one row per class: once to count buckets, from which the quotas follow too, and once for the rows of the
    boundary bucket. The table itself is then tagged in a map-only pass. Pass a written table, not a long plan.
    The target holds the two classes 0 and 1, so the broadcast cut has at most two rows.
    """
    marked = digest_columns(df.withColumn("_class", F.col(target).cast("int")), key, seed)
    order = ["_digest", *key]
    slim = marked.select("_class", "_bucket", *order).filter(F.col("_class").isin(0, 1))
    counts = bucket_counts(slim, "_bucket", "_class")
    quotas = class_quotas(counts, "_class", share, F.col("_n")).filter("test_rows > 0")
    cut = rank_cut(slim, quotas.select("_class", F.col("test_rows").alias("quota")), "_bucket", order, "_class", counts, digest_bucket, ranked_rows)
    held = F.coalesce(at_or_before(order), F.lit(False))
    return (
        marked.join(F.broadcast(cut), "_class", "left")
        .withColumn(side, F.when(held, names[1]).otherwise(names[0]))
        .select(*df.columns, side)
    )


def nested_split(
    df: DataFrame,
    key: Sequence[str],
    target: str = TARGET,
    share: float = TEST_SHARE,
    seed: int = SEED,
    names: tuple[str, str, str] = ("train", "validation", "test"),
    side: str = "side",
    phase: str = "phase",
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Add ``side`` as ``stratified_split`` does, and ``phase``, which is what ``stratified_split`` by the same key and seed adds to the rows left for training.

    Both orders are the same, so a class's validation rows follow its test rows: the rows are counted once, both cuts come from one scan, and
    the table is tagged in one map-only pass. ``phase`` is null on the test side.
    """
    order = ["_digest", *key]
    marked = digest_columns(df.withColumn("_class", F.col(target).cast("int")), key, seed)
    slim = marked.select("_class", "_bucket", *order).filter(F.col("_class").isin(0, 1))
    counts = bucket_counts(slim, "_bucket", "_class")
    outer = materialise(class_quotas(counts, "_class", share, F.col("_n")), "quotas")
    left = class_quotas(outer.filter("train_rows > 0"), "_class", share, F.col("train_rows")).select("_class", F.col("test_rows").alias("_later"))
    ranks = F.array(F.struct(F.lit(0).alias("_part"), F.col("test_rows").alias("quota")), F.struct(F.lit(1).alias("_part"), (F.col("test_rows") + F.col("_later")).alias("quota")))
    wanted = outer.join(left, "_class", "left").select("_class", "test_rows", "_later", F.inline(ranks)).filter(F.when(F.col("_part") == 0, F.col("test_rows")).otherwise(F.col("_later")) > 0)
    parts = F.explode(F.array(F.col("_class") * 2, F.col("_class") * 2 + 1)).alias("_group")  # of each row, once per cut
    quotas = wanted.select((F.col("_class") * 2 + F.col("_part")).alias("_group"), "quota")
    doubled = [d.select("*", parts).drop("_class") for d in (slim, counts)]
    cuts = materialise(rank_cut(doubled[0], quotas, "_bucket", order, "_group", doubled[1], digest_bucket, ranked_rows), "cuts")
    tagged = marked
    for part in (0, 1):  # at most a row per class each
        cut = cuts.filter(F.col("_group") % 2 == part).select(F.floor(F.col("_group") / 2).cast("int").alias("_class"), F.struct(*[F.col(f"_cut_{c}").alias(c) for c in order]).alias(f"_cut{part}"))
        tagged = tagged.join(F.broadcast(cut), "_class", "left")
    tested, watched = (F.coalesce(F.struct(*order) <= F.col(f"_cut{part}"), F.lit(False)) for part in (0, 1))
    sides = {side: F.when(tested, names[2]).otherwise(names[0]), phase: F.when(~tested, F.when(watched, names[1]).otherwise(names[0]))}
    return tagged.withColumns(sides).select(*df.columns, side, phase)


def tail_split(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    share: float = TEST_SHARE,
    names: tuple[str, str] = ("train", "validation"),
    side: str = "side",
) -> DataFrame:
    """The last ``max(1, floor(share * n))`` rows in ``order`` become validation rows.

    ``bucket`` never decreases along ``order`` and bounds what one task ranks: the day and file
    block of merged records, or a range of row numbers.
    """
    keyed = df.withColumn("_bucket", bucket)
    slim = keyed.select(F.lit(0).alias("_all"), "_bucket", *order)
    counts = bucket_counts(slim, "_bucket", "_all")
    total = counts.groupBy("_all").agg(F.sum("_n").alias("_rows"))
    tail = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("_rows"))).cast("long")
    quotas = total.select("_all", (F.col("_rows") - tail).alias("quota")).filter("quota > 0")
    cut = rank_cut(slim, quotas, "_bucket", order, "_all", counts)
    last = cut.select(F.struct(*[F.col(f"_cut_{c}").alias(c) for c in order])).scalar()
    early = F.coalesce(F.struct(*order) <= last, F.lit(False))
    return df.withColumn(side, F.when(early, names[0]).otherwise(names[1]))


def day_table(df: DataFrame, day: str = SOURCE_DAY, ts: str = TIMESTAMP, target: str = TARGET) -> DataFrame:
    """Per source day: first and last timestamp, rows, attacks and attack share."""
    n = F.count("*")
    attacks = F.count_if(F.col(target) == 1)
    return df.groupBy(day).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        n.alias("rows"),
        attacks.alias("attack_rows"),
        (attacks * 100.0 / n).alias("attack_pct"),
    )


def day_sides(
    days: DataFrame,
    day: str = SOURCE_DAY,
    share: float = TEST_SHARE,
    test_days: int | None = None,
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """Whole trailing days become the test side: ``test_days`` of them, or until they hold ``share`` of the rows.

    Works on the day table, one row per day file.
    """
    latest = Window.partitionBy(F.lit(0)).orderBy(F.desc("first_ts"), F.desc(day))
    if test_days is not None:
        n_days = days.count()
        if not 1 <= test_days < n_days:
            raise ValueError(f"test_days must lie between 1 and {n_days - 1}, got {test_days}")
        is_test = F.row_number().over(latest) <= test_days
    else:
        later = F.coalesce(F.sum("rows").over(latest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        is_test = later < F.lit(share) * F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return days.withColumn("_test", is_test).withColumn(
        "side", F.when(F.col("_test"), names[1]).otherwise(names[0])
    ).drop("_test")


def assign_days(df: DataFrame, sides: DataFrame, day: str = SOURCE_DAY, side: str = "side") -> DataFrame:
    """Tag rows with the side of their day and with ``day_start``, the day's first timestamp.

    The day table has one row per day file. Its size is Spark's to measure: a small one is broadcast, and with
    a long one the rows of a busy day are split over tasks.
    """
    wanted = sides.select(day, F.col("side").alias(side), F.col("first_ts").alias("day_start"))
    return df.join(wanted, day)


def day_bucket(rows_each: int = 1_000_000, row: str = "row_no", day: str = SOURCE_DAY) -> Column:
    """Ranges of a day that one task can rank, however large the day; grows along (day_start, day, row).

    Days are led by the time they start: their names need not sort by date.
    """
    return F.struct("day_start", day, F.floor(F.col(row) / rows_each).alias("block"))


def split_drift(df: DataFrame, side: str = "side", target: str = TARGET) -> DataFrame:
    """Attack share of all, train and test rows, and the gap between the sides in percentage points."""
    attack = F.col(target).cast("double") * 100.0
    train, test = F.col(side) == "train", F.col(side) == "test"
    shares = df.agg(
        F.avg(attack).alias("all_pct"),
        F.avg(F.when(train, attack)).alias("train_pct"),
        F.avg(F.when(test, attack)).alias("test_pct"),
    )
    return shares.withColumn("drift", F.abs(F.col("train_pct") - F.col("test_pct")))


def class_weight(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Weight of an attack row: benign rows over attack rows."""
    benign, attack = F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)
    return df.agg(
        benign.alias("benign_rows"),
        attack.alias("attack_rows"),
        F.when(attack > 0, benign / F.nullif(attack.cast("double"), F.lit(0.0))).alias("weight"),
    )


def to_matrix(df: DataFrame, key: Sequence[str] = (), target: str = TARGET, side: str | None = "side") -> DataFrame:
    """Model columns only: float features, one-hot bytes and target; the timestamp goes.

    Rows keep their target, so no join has to pair features and answers again.
    """
    types = dict(df.dtypes)
    features = feature_columns(df, key, target, side)
    cast = [F.col(c) if c in ONE_HOTS else F.col(c).cast("float").alias(c) for c in features]
    unfit = [c for c in features if types[c] == "string"]
    if unfit:
        raise ValueError(f"columns are not numeric: {unfit}")
    tail = [target] + ([side] if side and side in df.columns else [])
    return df.select(*key, *cast, *tail)


def feature_columns(
    df: DataFrame, key: Sequence[str] = (), target: str = TARGET, side: str | None = "side"
) -> list[str]:
    """What a model sees: neither key, target, side, timestamp nor day."""
    return [c for c in df.columns if c not in {*key, target, side, TIMESTAMP, SOURCE_DAY}]


def pair_features_and_target(features: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Put separately stored features and targets back together by row key."""
    return features.join(targets, list(key), "inner")


def union_days(days: Sequence[DataFrame]) -> DataFrame:
    """Stack day slices by column name; all must have the same columns."""
    first = days[0]
    for i, other in enumerate(days[1:], start=1):
        missing = sorted(set(first.columns) - set(other.columns))
        extra = sorted(set(other.columns) - set(first.columns))
        if missing or extra:
            raise ValueError(f"day {i} differs: missing {missing}, extra {extra}")
    stacked = first
    for other in days[1:]:
        stacked = stacked.unionByName(other)
    return stacked
