"""Sources and sinks. File queries write an upload derived from the tables and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from dairyframe import datasets as ds
from dairyframe.operators import alignment as al
from dairyframe.plans import query
from dairyframe.plans.alignment import PRICE_TEXT_SQL
from dairyframe.session import scratch_path
from dairyframe.sources import delimited, files as fl, sinks

# An upload as text: comma decimals, flags, blanks, an event column and some unusable cells.
UPLOAD_SQL = """
    SELECT CASE WHEN dim % 29 = 0 THEN '' ELSE CAST(test_id AS VARCHAR) END AS id, dim, milk_kg, pos,
           dim % 23 = 0 AS bad, dim % 19 = 0 AS other_event FROM testday"""


def _upload(spark, sf_dir):
    dim = F.col("dim")
    milk = F.replace(F.col("milk_kg").cast("string"), F.lit("."), F.lit(","))
    return ds.testday(spark, sf_dir).select(
        F.when(dim % 29 == 0, "").otherwise(F.col("test_id").cast("string")).alias("TestId"),
        F.when(dim % 19 == 0, "Calving").when(dim % 2 == 0, "MilkRecording").alias("EventType"),
        dim.cast("string").alias("DaysInMilk"),
        F.when(dim % 23 == 0, "n/a").otherwise(F.concat(F.lit(" "), milk, F.lit("*"))).alias("DailyMilkingYield"),
    )


def _write_upload(df, path, sep=","):
    """``df`` as delimited files in the order of ``pos``, cells as they are."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows = df.repartitionByRange("pos").sortWithinPartitions("pos").drop("pos")
    rows.write.options(header=True, sep=sep, escape='"', **spaces).csv(path)
    return path


@query(
    "src_testday_csv",
    ds.with_views(
        "testday",
        """SELECT id AS test_id, CAST(count(*) AS BIGINT) AS n, sum(dim)::BIGINT AS dim_sum, sum(milk_kg) AS kg_sum FROM u
           WHERE NOT other_event AND NOT bad AND id <> '' GROUP BY 1""",
        u=UPLOAD_SQL,
    ),
)
def testday_csv(spark, sf_dir):
    """One upload in three layouts: columns in other orders, under other names and with other delimiters."""
    path = scratch_path(spark, "upload")
    names = ["TestId", "EventType", "DaysInMilk", "DailyMilkingYield"]
    layouts = [(names, names, ";"), (names[::-1], ["Milk_kg", "Days in Milk", "event_type", "Animal_ID"], ","), ([*names[2:], *names[:2]], ["DIM", "Milk", "CowId", "EventType"], ";")]
    for i, (order, headers, sep) in enumerate(layouts):
        part = _upload(spark, sf_dir).filter(F.pmod(F.xxhash64(*names), F.lit(3)) == i)
        part.select(*[F.col(c).alias(h) for c, h in zip(order, headers)]).write.options(header=True, sep=sep).csv(f"{path}/{i}")
    rows = fl.usable_test_days(fl.parse_test_day_files(spark, path))
    return rows.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dim").alias("dim_sum"), F.sum("milk_kg").alias("kg_sum")
    )


@query(
    "src_benchmark_testday_csv",
    ds.with_views(
        "testday cow",
        """SELECT 'T' || t.test_id AS test_id, CAST(row_number() OVER (PARTITION BY t.test_id ORDER BY dim, pos) - 1 AS INTEGER) AS slot,
                  dim, milk AS milk_kg, parity
           FROM (SELECT test_id, dim, pos, milk_kg + 0.5 AS milk FROM testday WHERE dim % 31 <> 0) t
           JOIN (SELECT test_id, arg_min(dim % 4, pos) FILTER (WHERE dim % 3 <> 0) AS parity FROM testday WHERE dim % 31 <> 0 GROUP BY 1) p USING (test_id)""",
    ),
)
def benchmark_csv(spark, sf_dir):
    dim = F.col("dim")
    uploaded = ds.testday(spark, sf_dir).select(
        F.concat(F.lit(" T"), F.col("test_id").cast("string")).alias("Cow_Id"),
        F.when(dim % 3 != 0, (dim % 4).cast("string")).alias("LACT"),
        dim.cast("string").alias("dim"),
        F.when(dim % 31 == 0, "0")
        .otherwise(F.replace((F.col("milk_kg") + 0.5).cast("string"), F.lit("."), F.lit(",")))
        .alias("Milk"),
        "pos",
    )
    path = _write_upload(uploaded, scratch_path(spark, "benchmark"))
    records = fl.benchmark_lactations(delimited.read_uploads(spark, path, fl.parse_benchmark_test_day))
    zipped = F.arrays_zip("dim", "milk_kg")
    return records.select("test_id", "parity", F.posexplode(zipped).alias("slot", "r")).select(
        "test_id", "slot", "r.dim", "r.milk_kg", "parity"
    )


def _price_cells(spark, sf_dir):
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
    return ds.table(spark, sf_dir, "orders").select(
        (key % 5000).cast("string").alias("TestId"), cell.alias("LactationYield"), key.alias("pos")
    )


COMMA_SQL = f"SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS test_id, o_orderkey AS pos, TRY_CAST(replace(cell, ',', '.') AS DOUBLE) AS v FROM ({PRICE_TEXT_SQL})"


@query("src_actual_yield_csv", f"SELECT test_id, arg_max(v, pos) AS yield_kg FROM ({COMMA_SQL}) WHERE v >= 0 GROUP BY 1")
def actual_csv(spark, sf_dir):
    return fl.read_actual_yields(spark, _write_upload(_price_cells(spark, sf_dir), scratch_path(spark, "actual"), ";"))


@query(
    "src_submission_csv",
    f"""SELECT 'good' AS kind, test_id, arg_max(v, pos) AS yield_kg, 1 AS n FROM ({COMMA_SQL}) WHERE v IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'failed', test_id, NULL, count(*) FROM ({COMMA_SQL}) WHERE v IS NULL GROUP BY 2""",
)
def submission_csv(spark, sf_dir):
    good, failed = fl.read_submission(spark, _write_upload(_price_cells(spark, sf_dir), scratch_path(spark, "submission")))
    bad = failed.groupBy("test_id").agg(F.count(F.lit(1)).alias("n"))
    return good.select(F.lit("good").alias("kind"), "test_id", "yield_kg", F.lit(1).cast("bigint").alias("n")).unionByName(
        bad.select(F.lit("failed").alias("kind"), "test_id", F.lit(None).cast("double").alias("yield_kg"), "n")
    )


@query(
    "src_aggregated_csv",
    """SELECT round(avg(c_acctbal), 4) AS "Achieved305Milk", round(avg(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 600 END), 4) AS "DaysInMilk",
              0 AS "Achieved305Milk_bad", count(*) FILTER (WHERE c_custkey % 7 = 0) AS "DaysInMilk_bad" FROM customer""",
)
def aggregated_csv(spark, sf_dir):
    key = F.col("c_custkey")
    uploaded = ds.table(spark, sf_dir, "customer").select(
        F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("305 Milk"),
        F.when(key % 7 == 0, "unknown").otherwise((key % 600).cast("string")).alias("DIM"),
        F.col("c_name").alias("Remarks"),
        key.alias("pos"),
    )
    out = fl.read_aggregated(spark, _write_upload(uploaded, scratch_path(spark, "aggregated")))
    return out.withColumns({c: F.round(c, 4) for c in ("Achieved305Milk", "DaysInMilk")})


@query(
    "src_herd_export_csv",
    ds.with_views(
        "testday",
        """SELECT CAST(test_id AS VARCHAR) AS test_id, count(*) AS n, round(sum(milk_kg * 0.45359237), 4) AS kg_sum,
                  round(arg_max(milk_kg * 500 * 0.45359237, pos) FILTER (WHERE dim % 3 = 0), 4) AS direct_kg
           FROM testday WHERE dim % 37 <> 0 GROUP BY 1""",
    ),
)
def herd_export(spark, sf_dir):
    dim, milk = F.col("dim"), F.col("milk_kg")
    comma = F.replace(milk.cast("string"), F.lit("."), F.lit(","))
    uploaded = ds.testday(spark, sf_dir).select(
        F.concat(F.lit("  "), F.col("test_id").cast("string"), F.lit(" ")).alias("ID"),
        dim.cast("string").alias("DIM"),
        F.when(dim % 37 == 0, "0").otherwise(F.concat(comma, F.lit("*"))).alias("MILK"),
        F.when(dim % 3 == 0, (milk * 500).cast("bigint").cast("string")).alias("305ME"),
        "pos",
    )
    path = _write_upload(uploaded, scratch_path(spark, "herd-export"), ";")
    rows = delimited.read_uploads(spark, path, fl.parse_herd_export)
    direct = F.when(F.col("direct_kg") > 0, F.col("pos"))
    return rows.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("milk_kg"), 4).alias("kg_sum"),
        F.round(F.max_by(F.when(F.col("direct_kg") > 0, F.col("direct_kg")), direct), 4).alias("direct_kg"),
    )


@query(
    "src_quoted_csv",
    "SELECT doc_id, source, sha256(coalesce(text, '')) AS sha256, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM documents",
)
def quoted_csv(spark, sf_dir):
    """Whole documents, line breaks and quotes included, as cells of delimited files, read back split by split."""
    path = scratch_path(spark, "quoted")
    rows = ds.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = fl.read_delimited(spark, path, multi_line=True)
    text = F.coalesce("text", F.lit(""))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.sha2(text, 256).alias("sha256"), F.length(text).cast("long").alias("chars"))


@query("src_binary_reject", "SELECT page_id, page_id % 5 < 2 AS rejected FROM pages")
def binary_reject(spark, sf_dir):
    page = F.col("page_id")
    content = (
        F.when(page % 5 == 0, F.concat("html", F.lit("\x00")))
        .when(page % 5 == 1, F.concat(F.repeat(F.lit("\x01"), F.length("html")), "url"))
        .otherwise(F.col("html"))
    )
    rows = ds.table(spark, sf_dir, "pages").select("page_id", F.encode(content, "UTF-8").alias("content"))
    text, binary = fl.split_binary(rows)
    return text.select("page_id", F.lit(False).alias("rejected")).unionByName(
        binary.select("page_id", F.lit(True).alias("rejected"))
    )


@query(
    "src_lactation_json",
    ds.with_views(
        "daily",
        """SELECT CAST(user_id AS VARCHAR) AS animal_id, CAST(1 + user_id % 5 AS INTEGER) AS parity, user_id % 25 AS herd_id,
                  CAST(count(*) AS INTEGER) AS days, CAST(count(value) AS INTEGER) AS known, round(sum(value), 4) AS total FROM daily GROUP BY user_id""",
    ),
)
def lactation_json(spark, sf_dir):
    path = scratch_path(spark, "documents")
    user = F.col("user_id")
    documents = ds.daily(spark, sf_dir).select(
        user.cast("string").alias("animal_id"),
        (1 + user % 5).cast("int").alias("parity"),
        (user % 25).alias("herd_id"),
        "milk",
        F.array(F.lit("calving")).alias("events"),
    )
    documents.write.option("ignoreNullFields", "false").json(path)
    rows = fl.read_lactation_json(spark, path, pattern="*.json", lines=True)
    return rows.select(
        "animal_id",
        "parity",
        "herd_id",
        F.size("milk").alias("days"),
        F.size(F.filter("milk", lambda v: v.isNotNull())).alias("known"),
        F.round(F.aggregate("milk", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 4).alias("total"),
    )


@query("sink_export_csv", ds.with_views("testday cow", """SELECT CAST(test_id AS VARCHAR) AS "TestId", herd_id, parity, dim, milk_kg FROM testday JOIN cow USING (test_id)"""))
def export_csv(spark, sf_dir):
    records = al.nest_lactation(ds.testday(spark, sf_dir)).join(ds.cow(spark, sf_dir), "test_id")
    path = scratch_path(spark, "export")
    sinks.write_csv(sinks.export_rows(records, herd=True), path)
    return spark.read.csv(path, header=True, schema="TestId string, herd_id bigint, parity int, dim int, milk_kg double")


@query(
    "sink_json_gzip",
    ds.with_views(
        "testday",
        "SELECT count(*) AS row_count, count(DISTINCT test_id) AS record_count, sum(dim)::BIGINT AS dim_sum FROM testday",
    ),
)
def json_gzip(spark, sf_dir):
    records = al.nest_lactation(ds.testday(spark, sf_dir))
    path = scratch_path(spark, "payload")
    counts = sinks.write_json_gzip(records, path, record_id="test_id")
    rows = al.unnest_lactation(spark.read.schema("test_id bigint, dim array<int>, milk_kg array<double>").json(path))
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(counts["record_count"]).alias("record_count"),
        F.sum("dim").alias("dim_sum"),
    )


PRESET_SQL = """
    SELECT 'demo' AS dataset, CASE WHEN test_id % 20 = 0 THEN 'small' WHEN test_id % 4 = 0 THEN 'medium' ELSE 'large' END AS size,
           CASE WHEN parity <= 2 THEN 'recent' ELSE 'old' END AS period, test_id AS cow_id, parity FROM cow"""


def _preset_cows(spark, sf_dir):
    key = F.col("test_id")
    return ds.cow(spark, sf_dir).select(
        F.lit("demo").alias("dataset"),
        F.when(key % 20 == 0, "small").when(key % 4 == 0, "medium").otherwise("large").alias("size"),
        F.when(F.col("parity") <= 2, "recent").otherwise("old").alias("period"),
        key.alias("cow_id"),
        "parity",
    )


@query(
    "sink_preset_partitions",
    ds.with_views("cow", f"SELECT dataset, size, period, count(*) AS cows, sum(parity)::BIGINT AS parities FROM ({PRESET_SQL}) GROUP BY 1, 2, 3"),
)
def preset_partitions(spark, sf_dir):
    path = scratch_path(spark, "presets")
    sinks.write_presets(_preset_cows(spark, sf_dir), path)
    rows = spark.read.schema("cow_id bigint, parity int, dataset string, size string, period string").json(path)
    return rows.groupBy("dataset", "size", "period").agg(F.count(F.lit(1)).alias("cows"), F.sum("parity").alias("parities"))


def _preset_documents(spark, sf_dir):
    """Documents of about a hundred lactations of one size and period each, as an exporter would cut them."""
    key = F.col("test_id").cast("string")
    cows = al.nest_lactation(ds.testday(spark, sf_dir)).join(ds.aly(spark, sf_dir), "test_id")
    cow = F.struct(
        key.alias("cow_id"), key.alias("display_name"), F.lit(1).alias("parity"), F.lit(1).cast("bigint").alias("herd_id"), "dim", "milk_kg"
    )
    kind = _preset_cows(spark, sf_dir).select(F.col("cow_id").alias("test_id"), "dataset", "size", "period")
    document = ["dataset", "size", "period", (F.col("test_id") / 100).cast("bigint").alias("doc")]
    documents = cows.join(kind, "test_id").groupBy(*document).agg(
        F.collect_list(cow).alias("cows"), F.map_from_entries(F.collect_list(F.struct(key, "yield_kg"))).alias("actual_yields")
    )
    path = scratch_path(spark, "preset-docs")
    documents.select("dataset", "size", "period", "cows", "actual_yields", F.size("cows").cast("bigint").alias("cow_count")).write.json(path)
    return path


@query(
    "src_preset_json",
    ds.with_views(
        "testday aly cow",
        """SELECT test_id, CAST(n AS INTEGER) AS records, yield_kg FROM (SELECT test_id, count(*) AS n FROM testday GROUP BY 1) JOIN aly USING (test_id)""",
    ),
)
def preset_json(spark, sf_dir):
    presets = fl.read_presets(spark, _preset_documents(spark, sf_dir), lines=True)
    records = fl.preset_cows(presets).select(F.col("cow_id").alias("test_id"), F.size("dim").alias("records"))
    joined = records.join(fl.preset_yields(presets), "test_id")
    return joined.select(F.col("test_id").cast("bigint").alias("test_id"), "records", "yield_kg")


@query(
    "src_preset_counts",
    ds.with_views(
        "testday cow",
        f"""SELECT period, count(CASE WHEN size = 'small' THEN 1 END) AS small, count(CASE WHEN size = 'medium' THEN 1 END) AS medium,
                   count(CASE WHEN size = 'large' THEN 1 END) AS large
            FROM ({PRESET_SQL}) WHERE cow_id IN (SELECT test_id FROM testday) GROUP BY 1""",
    ),
)
def preset_counts(spark, sf_dir):
    """Counted from written documents, of which only the heads are read."""
    heads = fl.read_preset_heads(spark, _preset_documents(spark, sf_dir), lines=True)
    return sinks.preset_counts(heads, ["small", "medium", "large"])


def _artifacts(spark, sf_dir):
    return ds.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("artifact_id"),
        (F.col("doc_id") * 7919 % 1009).alias("created_at"),
        F.col("lang").alias("content_type"),
        F.lit("utf-8").alias("encoding"),
        F.col("text").alias("content"),
    )


@query(
    "sink_content_dedup",
    """SELECT sha256(c) AS sha256, CAST(strlen(c) AS INTEGER) AS size, lang AS content_type, 'utf-8' AS encoding,
              arg_min(doc_id, (doc_id * 7919 % 1009) * 1000000000 + doc_id) AS kept_id, count(*) AS copies
       FROM (SELECT doc_id, lang, text AS c FROM documents) GROUP BY 1, 2, 3""",
)
def dedup(spark, sf_dir):
    return sinks.content_dedup(_artifacts(spark, sf_dir))


@query(
    "sink_content_links",
    """SELECT doc_id AS artifact_id, first_value(doc_id) OVER (PARTITION BY text, lang ORDER BY doc_id * 7919 % 1009, doc_id) AS kept_id FROM documents""",
)
def links(spark, sf_dir):
    return sinks.content_links(_artifacts(spark, sf_dir))


@query(
    "sink_unreferenced",
    """SELECT doc_id AS artifact_id FROM documents WHERE doc_id NOT IN (SELECT o_orderkey % 3000 FROM orders WHERE o_custkey % 2 = 0)
         AND doc_id NOT IN (SELECT c_custkey * 3 FROM customer) AND doc_id NOT IN (SELECT p_partkey * 5 FROM part)""",
)
def orphans(spark, sf_dir):
    orders = ds.table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 3000).alias("file_id"))
    customers = ds.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("raw_id"))
    parts = ds.table(spark, sf_dir, "part").select((F.col("p_partkey") * 5).alias("stats_id"))
    references = {"orders": (orders, ["file_id"]), "customers": (customers, ["raw_id"]), "parts": (parts, ["stats_id"])}
    return sinks.unreferenced(_artifacts(spark, sf_dir), references).select("artifact_id")


@query(
    "src_binary_files",
    """SELECT 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS label, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS size,
              sum(coalesce(strlen(text), 0) + 1)::BIGINT AS content_bytes, sum(length(text) - length(replace(text, 'e', '')))::BIGINT AS letters_e
       FROM documents GROUP BY 1""",
)
def binary_files(spark, sf_dir):
    """The documents as files in one folder per language, listed and read whole."""
    path = scratch_path(spark, "binary")
    ds.table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path)
    text = F.decode("content", "UTF-8")
    return fl.read_files(spark, path, pattern="*.txt").groupBy("label").agg(
        F.sum("size").alias("size"),
        F.sum(F.length("content")).cast("bigint").alias("content_bytes"),
        F.sum(F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("")))).cast("bigint").alias("letters_e"),
    )
