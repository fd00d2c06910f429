"""Sources and sinks.

Base tables are Parquet (`<dir>/<name>.parquet`). The synthetic tables hold no
support vocabulary and no reply pointers, so two derived views add them
deterministically (see FIXTURES.md section 3): `messages` (turns plus a
support phrase) and `tweets` (a reply graph over the turns, three brands).
Everything else is computed from these by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# --------------------------------------------------------------------------
# FIXED VALUES (FIXTURES.md 3.1): phrases prepended to turns. Index i is
# chosen by (conv_id*7+turn) % 17 for users and (conv_id*5+turn) % 7 for
# assistants; the last entry of each list is the empty phrase.
# --------------------------------------------------------------------------
USER_PHRASES = [
    "My parcel is late and still waiting. ",
    "It says delivered but I never received it. ",
    "You sent the wrong item. ",
    "Where is my refund? Mail me at jo.doe@example.com. ",
    "I was charged twice on card 4111-1111-1111-1111. ",
    "Please cancel order 404-1234567-1234567. ",
    "How do I return this? Call 555-123-4567. ",
    "I am locked out of my account. ",
    "The app shows an error at https://t.co/abc123. ",
    "Is it available again soon? ",
    "My gift card balance is wrong. ",
    "The promo code fails, zip 98109. ",
    "Worst service, I am angry. ",
    "Thank you so much, great job. ",
    "Click here, you are a winner. ",
    "hello! ",
    "",
]
BRAND_PHRASES = [
    "Sorry for the trouble. ",
    "Please contact us by phone. ",
    "Your refund is on its way. ",
    "We will send a replacement. ",
    "You can track your parcel here. ",
    "See the link above. ",
    "",
]

# Reply-graph fixture: 3 brands, every 5th conversation branches at turn 0,
# every 11th root points to a parent that does not exist.
N_BRANDS = 3
UNKNOWN_PARENT_BASE = 900000000
EPOCH_BASE = "2017-10-01 00:00:00"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
ALT_TS_FORMAT = "dd/MM/yyyy HH:mm"

TWEET_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.StringType()),
])


# tables whose rows carry long texts: per-row regex / tokenising work dominates
TEXT_TABLES = {"documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all cores. Only where the session asks for it
    (`spark.ticketlake.spreadScans`, an option of local test and bench sessions,
    whose tables are one row group); scans of large inputs have splits enough."""
    spark = df.sparkSession
    if spark.conf.get("spark.ticketlake.spreadScans", "false") != "true":
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _pick(phrases: list[str], idx: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(p) for p in phrases]), (idx + 1).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, phrase, text (phrase || original text)."""
    c = read_table(spark, sf_dir, "conversations")
    user = _pick(USER_PHRASES, (F.col("conv_id") * 7 + F.col("turn")) % len(USER_PHRASES))
    brand = _pick(BRAND_PHRASES, (F.col("conv_id") * 5 + F.col("turn")) % len(BRAND_PHRASES))
    phrase = (F.when(F.col("role") == "user", user)
              .when(F.col("role") == "assistant", brand)
              .otherwise(F.lit("")))
    return c.select("conv_id", "turn", "role", phrase.alias("phrase"),
                    F.concat(phrase, F.col("text")).alias("text"))


def _created_ntz(sec: F.Column) -> F.Column:
    return F.timestamp_add("SECOND", sec, F.lit(EPOCH_BASE).cast("timestamp_ntz"))


def tweet_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed reply graph: tweet_id BIGINT, author_id, inbound, created_at
    TIMESTAMP_NTZ, text, parent_id BIGINT (null for roots), conv_id, turn."""
    m = messages(spark, sf_dir)
    conv, turn = F.col("conv_id"), F.col("turn")
    parent = (F.when(turn == 0, F.when(conv % 11 == 0, F.lit(UNKNOWN_PARENT_BASE) + conv))
              .when(conv % 5 == 0, conv * 100)
              .otherwise(conv * 100 + turn - 1))
    return m.select(
        (conv * 100 + turn).alias("tweet_id"),
        F.when(F.col("role") == "assistant",
               F.concat(F.lit("Brand"), (conv % N_BRANDS).cast("string")))
         .otherwise(conv.cast("string")).alias("author_id"),
        (F.col("role") != "assistant").alias("inbound"),
        _created_ntz(conv * 3600 + turn * 60).alias("created_at"),
        F.col("text"),
        parent.alias("parent_id"),
        conv, turn,
    )


def raw_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply graph as a CSV-like dump: every field a string, parents as
    float-looking text ('123.0'), children as an ordered comma list, and
    every 13th conversation written in another timestamp format."""
    g = tweet_graph(spark, sf_dir)
    kids = (g.filter(F.col("parent_id").isNotNull())
             .groupBy(F.col("parent_id").alias("pid"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("tweet_id")),
                                           lambda x: x.cast("string")), ",").alias("kids")))
    ts = F.when(F.col("conv_id") % 13 == 12, F.date_format("created_at", ALT_TS_FORMAT)) \
          .otherwise(F.date_format("created_at", TS_FORMAT))
    return (g.join(kids, g.tweet_id == kids.pid, "left")
             .select(F.col("tweet_id").cast("string").alias("tweet_id"), "author_id", "inbound",
                     ts.alias("created_at"), "text",
                     F.col("kids").alias("response_tweet_id"),
                     F.when(F.col("parent_id").isNotNull(),
                            F.concat(F.col("parent_id").cast("string"), F.lit(".0")))
                      .alias("in_response_to_tweet_id")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn table for conversation assembly over every conversation: the
    assistant plays the brand, everybody else is the customer."""
    m = messages(spark, sf_dir)
    conv, turn = F.col("conv_id"), F.col("turn")
    return m.select(
        conv.alias("conversation_id"),
        (conv * 100 + turn).alias("tweet_id"),
        (F.col("role") == "assistant").alias("is_brand"),
        (F.col("role") != "assistant").alias("inbound"),
        _created_ntz(conv * 3600 + turn * 60).alias("created_at"),
        F.col("text"),
    )


# ---------------------------------------------------------------- file I/O

def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Dump scan with an explicit schema (tweets contain newlines and quotes)."""
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the filter reaches the scan, whose row groups and
    folders that cannot hold the key are not read."""
    return df.filter(F.col(key) == F.lit(value))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# -------------------------------------------------- typed readers and writers

#: Columns of the file formats, in order, with the value an absent column or a
#: null takes (None: stays null).
CONVERSATION_COLUMNS = {"conversation_id": ("string", None), "conversation": ("string", ""), "customer_problem": ("string", ""),
                        "brand_responses": ("string", ""), "turn_count": ("bigint", 2), "customer_turns": ("bigint", None),
                        "first_timestamp": ("timestamp_ntz", None), "last_timestamp": ("timestamp_ntz", None)}
CASE_COLUMNS = {"case_id": ("string", None), "conversation_id": ("string", ""), "customer_problem": ("string", ""),
                "conversation": ("string", ""), "brand_responses": ("string", ""), "resolution": ("string", ""),
                "intent": ("string", "general_inquiry"), "resolution_quality": ("string", "weak"), "turn_count": ("bigint", 2)}
GOLDEN_COLUMNS = {"example_id": ("string", None), "customer_message": ("string", ""), "intent": ("string", "general_inquiry"),
                  "intent_notes": ("string", ""), "expected_action": ("string", "auto_handle"),
                  "reference_response": ("string", ""), "difficulty": ("string", "easy"), "turn_count": ("bigint", 2)}


def typed(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The columns in their types; absent ones and nulls take their default."""
    out = []
    for name, (kind, default) in columns.items():
        c = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((c if default is None else F.coalesce(c, F.lit(default).cast(kind))).alias(name))
    return df.select(*out)


def read_typed(spark: SparkSession, path: str, columns: dict[str, tuple[str, object]], fmt: str = "csv") -> DataFrame:
    """Read a conversation, case or golden file (CSV with a header, JSON lines
    or Parquet) without inferring types from the data."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "json":
        df = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).json(path)
    else:
        df = spark.read.parquet(path)
    return typed(df, columns)
