"""The 14 features of a transaction, from flat columns, and their derivation from raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.functions.dates import day_of_week, epoch_seconds

#: Flat columns that ``vectorize`` reads.
INPUTS = ("amount", "installments", "ts", "customer_avg", "tx_count_24h", "is_known", "risk", "merchant_avg", "is_online", "card_present", "km_from_home", "last_sec", "km_from_last")

#: Users whose histories are split by day, at most: what the broadcast of their ids may hold.
HEAVY_USERS = 1 << 19


def feature_list() -> list[Column]:
    """Features 0..13 as float columns over INPUTS. last_sec is null where there was no transaction before."""
    c = F.col
    average = F.when(c("customer_avg") == 0, S.f32(1)).otherwise(S.f32(c("customer_avg")))
    minutes = S.ratio(epoch_seconds(c("ts")) - c("last_sec"), 60)
    none = c("last_sec").isNull()
    return [
        S.clamp01(S.ratio(c("amount"), S.MAX_AMOUNT)),
        S.clamp01(S.ratio(c("installments"), S.MAX_INSTALLMENTS)),
        S.clamp01(S.ratio(S.ratio(c("amount"), average), S.AMOUNT_VS_AVERAGE)),
        S.ratio(F.hour("ts"), 23),
        S.ratio(day_of_week(c("ts")), 6),
        F.when(none, S.f32(-1)).otherwise(S.clamp01(S.ratio(F.greatest(minutes, S.f32(0)), S.MAX_MINUTES))),
        F.when(none, S.f32(-1)).otherwise(S.clamp01(S.ratio(c("km_from_last"), S.MAX_KM))),
        S.clamp01(S.ratio(c("km_from_home"), S.MAX_KM)),
        S.clamp01(S.ratio(c("tx_count_24h"), S.MAX_COUNT_24H)),
        S.f32(c("is_online").cast("int")),
        S.f32(c("card_present").cast("int")),
        F.when(c("is_known"), S.f32(0)).otherwise(S.f32(1)),
        S.f32(c("risk")),
        S.clamp01(S.ratio(c("merchant_avg"), S.MAX_MERCHANT_AVERAGE)),
    ]


def vectorize(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows with INPUTS -> keep, features (array of 14 floats) and q (their codes)."""
    features = rows.select(*keep, F.array(*feature_list()).alias("features"))
    return features.withColumn("q", S.quantize(F.col("features")))


def event_base(events: DataFrame) -> DataFrame:
    """Events with merchant key k, whole cents and epoch seconds."""
    return events.select(
        "event_id", "user_id", "event_type", "ts", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        epoch_seconds(F.col("ts")).alias("sec"),
    )


def merchant_risk(k: Column) -> Column:
    """Risk by merchant key, where events carry no category: the first nine keys of eleven have one each."""
    codes = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311"]
    out = S.f32(S.MCC_DEFAULT)
    for i, code in enumerate(codes):
        out = F.when(k % 11 == i, S.f32(S.MCC_RISK[code])).otherwise(out)
    return out


def user_history(base: DataFrame, heavy_rows: int = 1 << 20) -> DataFrame:
    """What a scoring request says of a user's past, from the events before each event.

    One exchange by user serves all windows. Users with ``heavy_rows`` events or more, counted first, would each be ordered in one task;
    they are split by day (``history_by_day``), to the same results. They are told apart by a broadcast of HEAVY_USERS at
    most: if there are more, those with the most events.
    """
    counts = base.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= heavy_rows)
    levels = {r["level"]: r["users"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("users")).collect()}
    if not levels:
        return history_by_user(base)
    least = min(levels)
    while sum(users for level, users in levels.items() if level >= least) > HEAVY_USERS:
        least += 1
    heavy = F.broadcast(counts.where(F.floor(F.log2("n")) >= least).select(F.col("user_id").alias("heavy_user")))
    own = F.col("user_id").eqNullSafe(F.col("heavy_user"))
    return history_by_user(base.join(heavy, own, "left_anti")).unionByName(history_by_day(base.join(heavy, own, "left_semi")))


def history_by_user(base: DataFrame) -> DataFrame:
    """``user_history`` by windows over whole users (the one by user and merchant included, as it is sorted within users)."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prior = before.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86400, -1)
    same = Window.partitionBy("user_id", "k").orderBy("ts", "event_id")
    return base.withColumns(
        {
            "prior_cents": F.sum("cents").over(prior),
            "prior_n": F.count("*").over(prior),
            "last_sec": F.lag("sec").over(before),
            "last_k": F.lag("k").over(before),
            "tx_count_24h": F.count("*").over(day),
            "is_known": F.row_number().over(same) > 1,
        }
    )


def history_by_day(base: DataFrame) -> DataFrame:
    """``user_history`` by windows over a user's days, so that a user with a large share of all events is dealt over many tasks.

    What earlier days add comes as rows of their own, which sort before the day's events: yesterday's events for the
    24-hour count, merchants met on earlier days, and one row with totals and the last event so far. Those rows come from
    aggregates by day, of which a user has as many as days. Events without a time are a day of their own, before all others.
    """
    rows = base.withColumn("day", F.floor(F.col("sec") / 86400))
    days = rows.groupBy("user_id", "day").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.max_by(F.struct("sec", "k"), F.struct("ts", "event_id")).alias("last"))
    by_day = Window.partitionBy("user_id").orderBy("day")
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("user_id", "day", F.sum("cents").over(earlier).alias("cents"), F.sum("n").over(earlier).alias("n"), F.lag("last").over(by_day).alias("last"))
    carried = carried.where("n > 0").select("user_id", "day", "cents", "n", F.col("last.sec").alias("sec"), F.col("last.k").alias("k"), F.lit(2).alias("turn"))
    met = rows.groupBy("user_id", "k", "day").agg(F.count("*").alias("n"))
    met = met.select("user_id", "k", "day", F.row_number().over(Window.partitionBy("user_id", "k").orderBy("day")).alias("nth"))
    met = met.where("nth > 1").select("user_id", "k", "day", F.lit(1).alias("seen"), F.lit(1).alias("turn"))
    yesterday = rows.where("day IS NOT NULL").select("user_id", (F.col("day") + 1).alias("day"), "sec", F.lit(1).alias("recent"), F.lit(0).alias("turn"))
    own = rows.withColumns({"n": F.lit(1).cast("long"), "recent": F.lit(1), "seen": F.lit(1), "turn": F.lit(3)})
    every = own.unionByName(carried, True).unionByName(met, True).unionByName(yesterday, True)
    before = Window.partitionBy("user_id", "day").orderBy("turn", "ts", "event_id")
    prior = before.rowsBetween(Window.unboundedPreceding, -1)
    last_day = Window.partitionBy("user_id", "day").orderBy("sec").rangeBetween(-86400, -1)
    same = Window.partitionBy("user_id", "day", "k").orderBy("turn", "ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    found = every.withColumns(
        {
            "prior_cents": F.sum("cents").over(prior),
            "prior_n": F.coalesce(F.sum("n").over(prior), F.lit(0).cast("long")),
            "last_sec": F.lag("sec").over(before),
            "last_k": F.lag("k").over(before),
            "tx_count_24h": F.coalesce(F.sum("recent").over(last_day), F.lit(0).cast("long")),
            "is_known": F.coalesce(F.sum("seen").over(same) > 0, F.lit(False)),
        }
    )
    return found.where("turn = 3").select(*base.columns, "prior_cents", "prior_n", "last_sec", "last_k", "tx_count_24h", "is_known")


def event_transactions(events: DataFrame) -> DataFrame:
    """Flat transactions (INPUTS) with event_id and event_type, one per event."""
    base = event_base(events)
    merchants = base.groupBy("k").agg((F.sum("cents") / F.count("*") / 100).alias("merchant_avg"))
    rows = user_history(base).join(merchants, "k", "left")  # an event without a merchant has no average
    return rows.select(
        "event_id",
        "event_type",
        F.col("value").alias("amount"),
        (F.col("event_id") % 12 + 1).alias("installments"),
        "ts",
        F.when(F.col("prior_n") > 0, F.col("prior_cents") / F.col("prior_n") / 100).otherwise(F.lit(1.0)).alias("customer_avg"),
        "tx_count_24h",
        "is_known",
        merchant_risk(F.col("k")).alias("risk"),
        "merchant_avg",
        F.col("event_type").isin("view", "click").alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        (F.col("k") * 10).alias("km_from_home"),
        "last_sec",
        (F.abs(F.col("k") - F.col("last_k")) * 10).alias("km_from_last"),
    )


def event_vectors(events: DataFrame) -> DataFrame:
    """(vec_id, label, q): the codes of every event; an event of type error is a fraud."""
    return transaction_vectors(event_transactions(events))


def transaction_vectors(transactions: DataFrame) -> DataFrame:
    """``event_vectors`` of transactions that were made before."""
    found = vectorize(transactions, ["event_id", "event_type"])
    return found.select(F.col("event_id").alias("vec_id"), (F.col("event_type") == "error").cast("int").alias("label"), "q")


def embedding_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q): the codes of every embedding; an odd label is a fraud."""
    return embeddings.select("vec_id", (F.col("label") % 2).cast("int").alias("label"), S.quantize(F.col("embedding")).alias("q"))


def random_vectors(spark: SparkSession, n: int, dims: int = S.DIMS, seed: int = 7) -> DataFrame:
    """(vec_id, q): n synthetic queries with codes in -10000..9999, the same for the same seed on any cluster."""
    codes = F.array(*[(F.pmod(F.xxhash64("id", F.lit(i), F.lit(seed)), F.lit(20000)) - 10000).cast("int") for i in range(dims)])
    return spark.range(n).select(F.col("id").alias("vec_id"), codes.alias("q"))


def jittered(queries: DataFrame, dims: int, spread: int, seed: str = "jitter") -> DataFrame:
    """(vec_id, q): queries with each code moved by -spread .. spread, the same for the same seed on any cluster."""

    def moved(i: int) -> Column:
        text = F.concat(F.lit(f"{seed}:{i}:"), F.col("vec_id").cast("string"))
        h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
        code = F.get("q", i) + F.pmod(h, F.lit(2 * spread + 1)) - spread
        return F.least(F.greatest(code, F.lit(-int(S.SCALE))), F.lit(int(S.SCALE))).cast("int")

    return queries.select("vec_id", F.array(*[moved(i) for i in range(dims)]).alias("q"))
