"""Label tables derived from the ``part`` table (FIXTURES.md).

The driver's tables hold no labels. These views turn every part into one
application and its label lines, with planted faults, and grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APPLICATIONS_SQL = """
SELECT concat('L', cast(p_partkey AS string)) AS label_id, p_partkey AS k,
 CASE p_partkey % 3 WHEN 0 THEN 'Distilled Spirits' WHEN 1 THEN 'Wine' ELSE 'Beer / Malt Beverage' END AS beverage_type,
 concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' Distillery' WHEN 1 THEN ' Winery' ELSE ' Brewery' END) AS brand_name,
 CASE p_partkey % 3
  WHEN 0 THEN CASE p_size % 5 WHEN 0 THEN 'Vodka' WHEN 1 THEN 'Straight Rye Whisky' WHEN 2 THEN 'Bourbon Whiskey' WHEN 3 THEN 'Gin' ELSE 'Scotch Whisky' END
  WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN 'Red Wine' WHEN 1 THEN 'White Wine' ELSE 'Table Wine' END
  ELSE CASE p_size % 3 WHEN 0 THEN 'Pale Ale' WHEN 1 THEN 'Lager' ELSE 'Stout' END END AS class_type,
 cast(CASE p_partkey % 3 WHEN 0 THEN 40 + p_size % 11 WHEN 1 THEN 11 + p_size % 4 ELSE 4 + p_size % 5 END AS string) AS alcohol_pct,
 CASE WHEN p_partkey % 3 = 0 THEN cast(2 * (40 + p_size % 11) AS string) ELSE '' END AS proof,
 CASE p_size % 5 WHEN 0 THEN '750 mL' WHEN 1 THEN '1 L' WHEN 2 THEN '24 fl oz' WHEN 3 THEN '12 fl oz' ELSE '355 mL' END AS net_contents_ml,
 concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' Distillery' WHEN 1 THEN ' Winery' ELSE ' Brewery' END) AS bottler_name,
 'Frederick' AS bottler_city, 'MD' AS bottler_state,
 CASE WHEN p_partkey % 4 = 0 THEN 'true' ELSE 'false' END AS imported,
 CASE WHEN p_partkey % 4 = 0 THEN 'Scotland' ELSE '' END AS country_of_origin
FROM part
"""

# One row per label line: (line_no, present, text). A single scan of the applications.
LINES_SQL = """
SELECT label_id, k, line.line_no AS line_no, line.text AS text
FROM (SELECT label_id, k, explode(filter(array(
 named_struct('line_no', 1, 'present', true, 'text', CASE WHEN k % 7 = 0 THEN replace(upper(brand_name),'O','0') ELSE upper(brand_name) END),
 named_struct('line_no', 2, 'present', true, 'text', class_type),
 named_struct('line_no', 3, 'present', k % 19 <> 0, 'text', concat(cast(cast(alcohol_pct AS int) + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS string), '% ALC/VOL', CASE WHEN proof <> '' THEN concat(' (', proof, ' PROOF)') ELSE '' END)),
 named_struct('line_no', 4, 'present', true, 'text', CASE WHEN k % 23 = 0 THEN replace(net_contents_ml,'0','O') ELSE net_contents_ml END),
 named_struct('line_no', 5, 'present', k % 17 <> 0, 'text', concat('Bottled by ', bottler_name, ', Frederick, MD')),
 named_struct('line_no', 6, 'present', k % 8 = 0, 'text', 'Product of Scotland'),
 named_struct('line_no', 7, 'present', true, 'text', 'GOVERNMENT WARNING: (1) According to the Surgeon General,'),
 named_struct('line_no', 8, 'present', true, 'text', 'women should not drink alcoholic beverages during pregnancy because of the risk of birth defects.'),
 named_struct('line_no', 9, 'present', k % 13 <> 0, 'text', '(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.')
), x -> x.present)) AS line FROM {apps})
"""

# Second, less certain pass on every fifth label, shifted by two pixels right, one down.
BLOCKS_SQL = """
SELECT label_id, pass_id, line_no, text,
 10 + 2 * pass_id AS x1, 40 * line_no + pass_id AS y1,
 10 + 2 * pass_id + 8 * length(text) AS x2, 40 * line_no + 28 + pass_id AS y2,
 cast(90 - 10 * pass_id - line_no AS double) AS confidence
FROM (SELECT *, explode(CASE WHEN k % 5 = 0 THEN array(0, 1) ELSE array(0) END) AS pass_id
      FROM {lines})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the session's partitions, for costly work on files of few row groups."""
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped applications, as a submission file would hold them, plus ``k``.

    The driver's part file is a single row group, which one task would read;
    spreading it by label_id lets the rest of the plan use all cores.
    """
    apps = spark.sql(
        APPLICATIONS_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")
    )
    return spread(spark, apps, "label_id")


def label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of both passes with ``block_id`` = pass * 100 + line."""
    lines = spark.sql(LINES_SQL, apps=submitted(spark, sf_dir))
    blocks = spark.sql(BLOCKS_SQL, lines=lines)
    return blocks.withColumn("block_id", F.col("pass_id") * 100 + F.col("line_no"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word per space-separated token, and a far-off token on every sixth label."""
    blocks = label_blocks(spark, sf_dir)
    tokens = blocks.select(
        "*", F.posexplode(F.split("text", " ")).alias("i", "token")
    ).withColumn(
        "offset",
        F.expr("length(substring_index(text, ' ', i))")
        + F.when(F.col("i") > 0, 1).otherwise(0),
    )
    word = tokens.select(
        "label_id", "pass_id", "line_no", (F.col("i") + 1).alias("word_no"),
        F.col("token").alias("text"), F.col("confidence").alias("conf"),
        (F.col("x1") + 8 * F.col("offset")).alias("left"), F.col("y1").alias("top"),
        (8 * F.length("token")).alias("width"),
    )
    far = (
        blocks.filter(F.expr("cast(substring(label_id, 2) as bigint) % 6 = 0"))
        .select(
            "label_id", "pass_id", "line_no", F.lit(1000).alias("word_no"),
            F.lit("LOT").alias("text"), F.col("confidence").alias("conf"),
            (F.col("x2") + 300).alias("left"), F.col("y1").alias("top"),
            F.lit(24).alias("width"),
        )
    )
    return word.unionByName(far).select(
        "label_id", "pass_id", "word_no", F.lit(1).alias("block_num"),
        F.lit(1).alias("par_num"), F.col("line_no").alias("line_num"), "text", "conf",
        "left", "top", "width", F.lit(28).alias("height"),
    )


def planted_statements(statements: DataFrame) -> DataFrame:
    """(label_id, text) with misread words: letters mistaken, doubled, lost and swapped, by label number."""
    k = F.expr("cast(substring(label_id, 2) as bigint)")
    text = F.when(k % 2 == 0, F.upper("text")).otherwise(F.col("text"))
    for every, old, new in [
        (3, "Surgeon", "Surge0n"), (4, "PREGNANCY", "PREGNANGY"), (5, "beverages", "bevverages"), (6, "MACHINERY", "MACHNERY"),
        (7, "problems", "porblems"), (8, "GOVERNMENT", "G0VERNMENTT"), (9, "health", "hea1th"), (10, "SULFITES", "SULPHITES"),
        (11, "operate", "xxerxte"), (12, "SHOULD", "SH0ULD"),
    ]:
        text = F.replace(text, F.lit(old), F.when(k % every == 0, new).otherwise(old))
    # a word of its own on every label, near no reference word or near one by chance
    return statements.withColumn("text", F.concat(text, F.lit(" birt"), (k % 50).cast("string")))
