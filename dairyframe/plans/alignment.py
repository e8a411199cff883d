"""Header alignment and cleaning over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.functions import text as tx
from dairyframe.operators import alignment as al
from dairyframe.plans import query

# Header texts handed out by record content, so that the number of headers grows with lineitem.
HEADER_TEXTS = (
    "Days in Milk", "DIM", "Milk kg", "Cow ID", "Parity", "PCTF", "305ME", "Achieved305Milk", "Notes",
    "TestId", "DailyMilkingYield", "DaysInMilk", "MILK", "ID", " Milking_Yield ", "Quality",
)
HEADERS_SQL = f"""
    SELECT l_orderkey AS file_id, l_linenumber * 100 + l_partkey % 100 AS position,
           (['{"','".join(HEADER_TEXTS)}'])[1 + l_partkey % {len(HEADER_TEXTS)}] AS header FROM lineitem"""
NORM = "regexp_replace(lower(trim(header)), '[^a-z0-9]+', '', 'g')"


def _headers(spark, sf_dir):
    texts = F.array(*[F.lit(t) for t in HEADER_TEXTS])
    return ds.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        (F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("position"),
        F.element_at(texts, (1 + F.col("l_partkey") % len(HEADER_TEXTS)).cast("int")).alias("header"),
    )


@query(
    "norm_header",
    f"""SELECT {NORM} AS norm, count(*) AS n
        FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS header FROM documents) GROUP BY 1""",
)
def norm_header(spark, sf_dir):
    words = ds.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]+")).alias("header"))
    return words.groupBy(tx.norm_header(F.col("header")).alias("norm")).agg(F.count(F.lit(1)).alias("n"))


def _alias_rows() -> str:
    rows = []
    for canonical, aliases in al.LACTATION_ALIASES.items():
        seen: list[str] = []
        for alias in aliases:
            norm = tx.norm_header_text(alias)
            if norm not in seen:
                rows.append(f"('{canonical}', '{norm}', {len(seen)})")
                seen.append(norm)
    return ", ".join(rows)


@query(
    "resolve_columns",
    f"""WITH h AS ({HEADERS_SQL}), alias(canonical, norm, rank) AS (VALUES {_alias_rows()}),
        m AS (SELECT file_id, canonical, arg_min(header, rank * 4294967296 + position) AS pick
              FROM h JOIN alias ON {NORM} = alias.norm GROUP BY 1, 2)
        SELECT f.file_id, max(CASE WHEN canonical = 'DaysInMilk' THEN pick END) AS dim,
               max(CASE WHEN canonical = 'MilkingYield' THEN pick END) AS milk_kg,
               max(CASE WHEN canonical = 'TestId' THEN pick END) AS test_id
        FROM (SELECT DISTINCT file_id FROM h) f LEFT JOIN m USING (file_id) GROUP BY 1""",
)
def resolve(spark, sf_dir):
    return al.resolve_columns_in_catalogue(_headers(spark, sf_dir))


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in sorted({tx.norm_header_text(n) for n in names}))


@query(
    "detect_format",
    f"""WITH h AS (SELECT file_id, {NORM} AS norm FROM ({HEADERS_SQL})),
        w AS (SELECT file_id, bool_or(norm = 'id') AND bool_or(norm = 'dim') AND bool_or(norm = 'milk')
                       AND bool_or(norm IN ({_in(al.EXPORT_SIGNALS)})) AS export,
                     bool_or(norm IN ({_in(al.LACTATION_ALIASES["DaysInMilk"])}))
                       AND bool_or(norm IN ({_in(al.LACTATION_ALIASES["MilkingYield"])})) AS testday,
                     bool_or(norm = 'testid') AND bool_or(norm = 'daysinmilk')
                       AND bool_or(norm = 'dailymilkingyield') AND NOT bool_or(norm = 'milkingyield') AS exact,
                     bool_or(norm IN ({_in(al.STAT_ALIASES)})) AS stats
              FROM h GROUP BY 1)
        SELECT file_id, CASE WHEN export THEN 'herd_export' WHEN testday THEN 'test_day'
                             WHEN stats THEN 'aggregated' END AS format,
               NOT export AND testday AND NOT exact AS needs_review FROM w""",
)
def detect(spark, sf_dir):
    return al.detect_format_in_catalogue(_headers(spark, sf_dir))


@query(
    "standardize_columns",
    ds.with_views("testday", "SELECT test_id, dim, milk_kg FROM testday WHERE dim <= 305"),
)
def standardize(spark, sf_dir):
    uploaded = ds.testday(spark, sf_dir).drop("pos").toDF("Animal Number", "Days In Milk", "Daily Milking Yield (kg)")
    return al.standardize_columns(uploaded)


PRICE_TEXT_SQL = """
    SELECT o_orderkey, CASE o_orderkey % 6
             WHEN 0 THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',') WHEN 1 THEN CAST(o_totalprice AS VARCHAR) || '*'
             WHEN 2 THEN '  ' WHEN 3 THEN ' ' || CAST(o_totalprice AS VARCHAR) || ' ' WHEN 4 THEN 'n/a'
             ELSE CAST(o_totalprice AS VARCHAR) END AS cell FROM orders"""


@query(
    "parse_number",
    f"""SELECT o_orderkey AS row_id,
               TRY_CAST(CASE WHEN cell2 LIKE '%,%' AND cell2 NOT LIKE '%.%' THEN replace(cell2, ',', '.') ELSE cell2 END AS DOUBLE) AS value
        FROM (SELECT o_orderkey, regexp_replace(trim(cell), '\\*+$', '') AS cell2 FROM ({PRICE_TEXT_SQL}))""",
)
def parse_number(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    which = key % 6
    cell = (
        F.when(which == 0, F.replace(price, F.lit("."), F.lit(",")))
        .when(which == 1, F.concat(price, F.lit("*")))
        .when(which == 2, F.lit("  "))
        .when(which == 3, F.concat(F.lit(" "), price, F.lit(" ")))
        .when(which == 4, F.lit("n/a"))
        .otherwise(price)
    )
    return ds.table(spark, sf_dir, "orders").select(key.alias("row_id"), tx.parse_number(cell).alias("value"))


@query(
    "filter_finite",
    ds.with_views(
        "testday",
        """SELECT test_id, dim, milk_kg FROM (SELECT *, count(*) OVER (PARTITION BY test_id) AS n FROM
             (SELECT test_id, dim, milk_kg FROM testday WHERE dim % 10 <> 0 AND dim % 17 <> 0)) WHERE n >= 2""",
    ),
)
def finite(spark, sf_dir):
    dim = F.col("dim")
    milk = F.when(dim % 10 == 0, F.lit(float("nan"))).when(dim % 17 != 0, F.col("milk_kg"))
    return al.filter_finite(ds.testday(spark, sf_dir).select("test_id", "dim", milk.alias("milk_kg")))


@query(
    "filter_event_type",
    ds.with_views(
        "testday",
        """SELECT dim % 4 AS kind, count(*) AS n, count(CASE WHEN dim % 4 = 3 THEN 1 END) AS ignored,
                  sum(CASE WHEN dim % 4 <> 3 THEN milk_kg END) AS kept_kg FROM testday GROUP BY 1""",
    ),
)
def event_type(spark, sf_dir):
    kind = F.col("dim") % 4
    event = (
        F.when(kind == 0, "MilkRecording").when(kind == 1, " milkrecording ").when(kind == 3, "Calving")
    )
    tagged = ds.testday(spark, sf_dir).select(kind.alias("kind"), "milk_kg", al.is_milk_event(event).alias("keep"))
    return tagged.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("keep")).alias("ignored"),
        F.sum(F.when(F.col("keep"), F.col("milk_kg"))).alias("kept_kg"),
    )


@query(
    "reject_rows",
    ds.with_views(
        "testday",
        """SELECT CASE WHEN dim % 13 = 0 THEN 'no_id' WHEN dim % 11 = 0 THEN 'no_dim' WHEN dim % 7 = 0 THEN 'no_milk'
                       WHEN dim % 5 = 0 THEN 'negative_milk' ELSE 'kept' END AS reason, count(*) AS n
           FROM testday GROUP BY 1""",
    ),
)
def reject(spark, sf_dir):
    dim = F.col("dim")
    dirty = ds.testday(spark, sf_dir).select(
        F.when(dim % 13 == 0, "").otherwise(F.col("test_id").cast("string")).alias("cow_id"),
        F.when(dim % 11 != 0, dim).alias("dim"),
        F.when(dim % 7 == 0, F.lit(None)).when(dim % 5 == 0, -F.col("milk_kg")).otherwise(F.col("milk_kg")).alias("milk_kg"),
    )
    return al.reject_counts(dirty, al.reject_reason(F.col("cow_id"), F.col("dim"), F.col("milk_kg")))


@query(
    "unit_lb_kg",
    ds.with_views(
        "aly",
        """SELECT test_id, yield_kg * 0.45359237 AS from_lb,
                  CASE WHEN test_id % 2 = 0 THEN yield_kg * 2.20462 ELSE yield_kg END AS shown FROM aly""",
    ),
)
def unit(spark, sf_dir):
    kg = F.col("yield_kg")
    unit_name = F.when(F.col("test_id") % 2 == 0, "lbs").otherwise("kg")
    return ds.aly(spark, sf_dir).select(
        "test_id", tx.lb_to_kg(kg).alias("from_lb"), tx.in_unit(kg, unit_name).alias("shown")
    )


@query(
    "norm_id",
    """SELECT o_orderkey AS row_id, CASE WHEN TRY_CAST(id AS DOUBLE) = floor(TRY_CAST(id AS DOUBLE))
              THEN CAST(CAST(TRY_CAST(id AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(id) END AS id
       FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '.0' WHEN 1 THEN ' ' || o_orderkey || ' '
                    WHEN 2 THEN 'C' || o_orderkey ELSE o_orderkey || '.5' END AS id FROM orders)""",
)
def norm_id(spark, sf_dir):
    key = F.col("o_orderkey")
    text = key.cast("string")
    raw = (
        F.when(key % 4 == 0, F.concat(text, F.lit(".0")))
        .when(key % 4 == 1, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(key % 4 == 2, F.concat(F.lit("C"), text))
        .otherwise(F.concat(text, F.lit(".5")))
    )
    return ds.table(spark, sf_dir, "orders").select(key.alias("row_id"), tx.norm_id(raw).alias("id"))


@query(
    "first_attr",
    ds.with_views(
        "testday",
        """SELECT test_id, arg_min(parity, pos) FILTER (WHERE parity > 0) AS parity,
                  arg_min(herd_id, pos) FILTER (WHERE herd_id IS NOT NULL) AS herd_id
           FROM (SELECT test_id, pos, CASE WHEN dim % 3 <> 0 THEN dim % 4 END AS parity,
                        CASE WHEN dim % 5 <> 0 THEN dim % 25 END AS herd_id FROM testday) GROUP BY 1""",
    ),
)
def first_attr(spark, sf_dir):
    dim = F.col("dim")
    rows = ds.testday(spark, sf_dir).select(
        "test_id", "pos", F.when(dim % 3 != 0, dim % 4).alias("parity"), F.when(dim % 5 != 0, dim % 25).alias("herd_id")
    )
    return al.first_attr(rows)


NESTED_SQL = """
    SELECT test_id, CAST(row_number() OVER (PARTITION BY test_id ORDER BY dim, milk_kg) - 1 AS INTEGER) AS slot, dim, milk_kg FROM testday"""


def nested_rows(records):
    zipped = F.arrays_zip("dim", "milk_kg")
    return records.select("test_id", F.posexplode(zipped).alias("slot", "r")).select("test_id", "slot", "r.dim", "r.milk_kg")


@query("nest_lactation", ds.with_views("testday", NESTED_SQL))
def nest(spark, sf_dir):
    return nested_rows(al.nest_lactation(ds.testday(spark, sf_dir)))


@query(
    "nest_chunks",
    ds.with_views(
        "testday",
        "SELECT test_id, row_number() OVER (PARTITION BY test_id ORDER BY dim, pos) - 1 AS slot, dim, milk_kg FROM testday",
    ),
)
def nest_in_chunks(spark, sf_dir):
    """Chunks of three records, laid out again by their offsets."""
    rows = al.nest_chunks(ds.testday(spark, sf_dir), size=3)
    laid = rows.select("test_id", "offset", F.posexplode(F.arrays_zip("dim", "milk_kg")).alias("at", "r"))
    return laid.select("test_id", (F.col("offset") + F.col("at")).alias("slot"), "r.dim", "r.milk_kg")


@query("unnest_lactation", ds.with_views("testday", "SELECT test_id, dim, milk_kg FROM testday"))
def unnest(spark, sf_dir):
    return al.unnest_lactation(al.nest_lactation(ds.testday(spark, sf_dir)))


@query(
    "dedup_day",
    ds.with_views(
        "testday",
        """SELECT test_id, dim, arg_max(milk_kg, pos) AS last_kg, arg_min(milk_kg, pos) AS first_kg,
                  round(avg(milk_kg), 6) AS mean_kg FROM testday GROUP BY 1, 2""",
    ),
)
def dedup(spark, sf_dir):
    return al.day_values(ds.testday(spark, sf_dir)).withColumn("mean_kg", F.round("mean_kg", 6))


@query(
    "build_lactations",
    """WITH raw AS (
         SELECT CAST(l_orderkey AS VARCHAR) AS id, 1 + l_suppkey % 2 AS parity,
                1 + (l_partkey * 7 + l_linenumber * 41) % 330 AS dim, l_quantity * 0.45359237 AS kg, l_shipdate AS d,
                CASE WHEN l_partkey % 3 <> 0 AND l_partkey % 7 <> 0 THEN 2000 + l_partkey % 20 END AS born,
                CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 100000 + (l_suppkey % 1000) * 100
                  + CAST(l_quantity AS BIGINT) AS pos
         FROM lineitem WHERE l_linenumber <> 5),
       heads AS (SELECT id, parity, max(d) AS latest,
                        arg_min(born, CAST(dim AS HUGEINT) * 10000000000000000000 + pos) FILTER (WHERE born IS NOT NULL) AS born
                 FROM raw GROUP BY 1, 2)
       SELECT id || '_' || parity AS cow_id,
              'Cow ' || id || CASE WHEN h.born IS NOT NULL THEN ' (b. ' || h.born || ')' ELSE '' END || ' - parity ' || parity AS display_name,
              parity, CAST(row_number() OVER (PARTITION BY id, parity ORDER BY dim, kg) - 1 AS INTEGER) AS slot,
              dim, round(kg, 2) AS milk_kg
       FROM raw JOIN heads h USING (id, parity) WHERE latest >= TIMESTAMP '1997-01-01' AND latest <= TIMESTAMP '2000-12-31'""",
)
def build(spark, sf_dir):
    c = F.col
    partkey = c("l_partkey")
    raw = ds.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" "), c("l_orderkey").cast("string"), F.lit(" ")).alias("cow_id"),
        (1 + c("l_suppkey") % 2).alias("parity"),
        (1 + (partkey * 7 + c("l_linenumber") * 41) % 330).alias("dim"),
        F.when(c("l_linenumber") == 5, "-").otherwise(F.replace(c("l_quantity").cast("string"), F.lit("."), F.lit(","))).alias("milk_lb"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("test_date"),
        F.when(partkey % 7 == 0, "unknown")
        .when(partkey % 3 != 0, F.concat(F.lit("5/14/"), (2000 + partkey % 20).cast("string")))
        .alias("birth_date"),
        (c("l_linenumber").cast("bigint") * 1000000000000000000 + partkey * 100000 + (c("l_suppkey") % 1000) * 100
         + c("l_quantity").cast("bigint")).alias("pos"),
    )
    out = al.build_lactations(raw, low="1997-01-01", high="2000-12-31")
    zipped = F.arrays_zip("dim", "milk_kg")
    return out.select("cow_id", "display_name", "parity", F.posexplode(zipped).alias("slot", "r")).select(
        "cow_id", "display_name", "parity", "slot", "r.dim", "r.milk_kg"
    )


@query(
    "plausible_yields",
    ds.with_views(
        "aly cow",
        """SELECT parity, bool_and(yield_kg * parity > 0 AND yield_kg * parity < 100000) AS plausible
           FROM aly JOIN cow USING (test_id) GROUP BY 1""",
    ),
)
def plausible(spark, sf_dir):
    scaled = ds.aly(spark, sf_dir).join(ds.cow(spark, sf_dir), "test_id")
    scaled = scaled.withColumn("yield_kg", F.col("yield_kg") * F.col("parity"))
    return al.plausible_yields(scaled, by=["parity"])


# a fifth of the ground truth carries ids of no lactation
COVERED_TRUTH = "SELECT CASE WHEN test_id % 10 < 8 THEN test_id ELSE -1 - test_id END AS test_id FROM aly"


@query(
    "coverage_check",
    ds.with_views(
        "testday aly",
        f"""SELECT count(*) AS lactations, count(t.test_id) AS covered, count(t.test_id) / count(*) >= 0.8 AS accepted
            FROM (SELECT DISTINCT test_id FROM testday) c LEFT JOIN ({COVERED_TRUTH}) t USING (test_id)""",
    ),
)
def coverage(spark, sf_dir):
    test_id = F.col("test_id")
    truth = ds.aly(spark, sf_dir).withColumn("test_id", F.when(test_id % 10 < 8, test_id).otherwise(-1 - test_id))
    return al.coverage_check(ds.testday(spark, sf_dir), truth)


@query(
    "failure_threshold",
    f"""SELECT count(*) AS total, count(*) - count(v) AS failed, (count(*) - count(v)) / count(*) <= 0.2 AS accepted
        FROM (SELECT TRY_CAST(replace(cell, ',', '.') AS DOUBLE) AS v FROM ({PRICE_TEXT_SQL}))""",
)
def failures(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    cell = (
        F.when(key % 6 == 1, F.concat(price, F.lit("*"))).when(key % 6 == 2, "  ").when(key % 6 == 4, "n/a").otherwise(price)
    )
    rows = ds.table(spark, sf_dir, "orders").select(tx.comma_number(cell).alias("value"))
    return al.failure_threshold(rows.filter("value is not null"), rows.filter("value is null"))


@query(
    "cap_payload",
    ds.with_views(
        "testday",
        """SELECT test_id, min(pos) AS first_pos, count(*) AS records FROM testday GROUP BY 1
           ORDER BY first_pos, test_id""",
    ),
)
def cap(spark, sf_dir):
    records = ds.testday(spark, sf_dir).groupBy("test_id").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("records")
    )
    return al.cap_payload(records)
