"""Generated-sample sources and sinks (SRC-4, SRC-10, SRC-11, SNK-1, SNK-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: the hand-written seed questions -------------------------------
SAMPLE_QUESTIONS = [
    "If you have 3 apples and you buy 2 more, how many apples do you have in total?",
    "What is the product of 12 and 15?",
    "A train travels at 60 miles per hour for 2 hours. How far does it travel?",
    "If a rectangle has a length of 8 cm and a width of 5 cm, what is its area?",
    "John has twice as many candies as Mary. If Mary has 15 candies, how many does John have?",
    "A car uses 3 gallons of fuel to travel 30 miles. How many gallons are needed to travel 120 miles?",
    "If a book costs $15 and you have $60, how many books can you buy?",
    "What is the sum of the angles in a triangle?",
    "If you save $200 each month, how much will you have saved after one year?",
    "A garden has 5 rows of flowers with 12 flowers in each row. How many flowers are there in total?",
    "If it takes 5 workers 4 hours to build a wall, how long would it take 10 workers to build the same wall, assuming they work at the same rate?",
    "Sarah bought 7 packs of stickers, each containing 9 stickers. How many stickers did she buy in total?",
    "A baker made 48 cupcakes and wants to package them equally into boxes of 6. How many boxes does he need?",
    "The temperature dropped from 20°C to -5°C overnight. What was the total change in temperature?",
    "A tank holds 150 liters of water. If 45 liters are used, how much water remains in the tank?",
]
# ---- end of fixed values ------------------------------------------------------------

SAMPLE_SCHEMA = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])


def sample_questions_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLE_QUESTIONS)), "qid int, question string")


def read_samples(
    spark: SparkSession, path: str, array_file: bool = False, extra_fields: list[T.StructField] | None = None
) -> DataFrame:
    """Samples with a declared schema (never inferred). JSON lines by default
    (splittable); ``array_file=True`` reads one JSON array per file. A missing
    key comes back NULL; ``validate_samples`` quarantines such rows."""
    schema = T.StructType(list(SAMPLE_SCHEMA.fields) + list(extra_fields or []))
    r = spark.read.schema(schema).option("mode", "FAILFAST")
    if array_file:
        r = r.option("multiLine", True)
    return r.json(path)


def write_samples_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON lines, non-ASCII kept as is; NULL fields are omitted."""
    df.write.mode(mode).json(path)


def write_samples_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row; fields with quotes or newlines are quoted."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def read_samples_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )


def programmatic_questions(keys: DataFrame, key_col: str, seed: int = 7) -> DataFrame:
    """One arithmetic question per key row (SRC-10): operands 1-100 and an
    operation from a seeded md5 of the key; division draws the divisor b and
    sets a = b·U(1..10) so it is exact. Fully parallel and reproducible."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")))

    def part(i: int) -> F.Column:
        return F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")

    a, b, op, c = part(0), part(1), part(2), part(3)
    a1, b1 = (F.pmod(a, F.lit(100)) + 1).cast("string"), (F.pmod(b, F.lit(100)) + 1).cast("string")
    div_b = F.pmod(c, F.lit(100)) + 1
    div_a = div_b * (F.pmod(a, F.lit(10)) + 1)
    k = F.pmod(op, F.lit(4))
    q = (
        F.when(k == 0, F.concat(F.lit("What is "), a1, F.lit(" plus "), b1, F.lit("?")))
        .when(k == 1, F.concat(F.lit("What is "), a1, F.lit(" minus "), b1, F.lit("?")))
        .when(k == 2, F.concat(F.lit("What is the product of "), a1, F.lit(" and "), b1, F.lit("?")))
        .otherwise(F.concat(F.lit("What is "), div_a.cast("string"), F.lit(" divided by "), div_b.cast("string"), F.lit("?")))
    )
    return keys.select(key_col, q.alias("question"))
