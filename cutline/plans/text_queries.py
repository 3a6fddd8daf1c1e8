"""Texts that surround a series: vocabularies, probe results, override lines, policies, files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions import settings
from cutline.operators import match
from cutline.sources import readers, writers
from cutline.staging import temporary

from .tables import LINES_SQL, lines, table


def vocab_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts as help texts whose every word is an option: distinct names of two kinds, with the number of texts that have them."""
    helps = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "aom").otherwise("vpx").alias("kind"), F.concat(F.lit("--"), F.replace(F.col("text"), F.lit(" "), F.lit(" --"))).alias("help"))
    names = helps.select("kind", F.explode(match.option_names(F.col("help"), F.col("kind"))).alias("param"))
    return names.groupBy("kind", "param").agg(F.count(F.lit(1)).alias("texts"))


def option_names_x265(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary of help texts of the kind x265, one a part: a short and a long name in one word, a name that can be negated, one that is cut off at a sign, and words that are no names."""
    size, key = F.col("p_size").cast("string"), (F.col("p_partkey") % 40).cast("string")
    text = F.concat(F.lit("   -"), F.substring(F.lit("abcdefghij"), (F.col("p_size") % 10 + 1).cast("int"), F.lit(1)), F.lit("/--size-"), size, F.lit(" <int> - of a -- part\n   --[no-]flag"), key, F.lit("   on\n --value"), size, F.lit(":<a|b>  default")).alias("help")
    return match.vocabulary(table(spark, sf, "part").select(F.lit("x265").alias("kind"), text))


def _tokens(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("text", r"[ \n]+")).alias("token")).distinct()


def unknown_terms(spark: SparkSession, sf: str) -> DataFrame:
    return match.unknown(_tokens(table(spark, sf, "documents")), _tokens(table(spark, sf, "benchmark")), ["token"])


def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Part names and brands with a letter left out, be it the first, or cut short, and the known name that each resembles most."""
    parts = table(spark, sf, "part")
    known = parts.select("p_name").union(parts.select("p_brand")).distinct()
    place = (F.length("p_name") % 5 + 1).cast("int")
    typos = known.select(F.explode(F.array(F.concat(F.substring("p_name", F.lit(1), place - 1), F.substring("p_name", place + 1, F.length("p_name"))), F.substring("p_name", F.lit(2), F.length("p_name")), F.left("p_name", F.lit(4)))).alias("p_name"))
    return match.suggestions(typos, known, "p_name").select("p_name", "suggestion", F.round("similarity", 6).alias("similarity"))


def _probe(df: DataFrame) -> DataFrame:
    """Probe results in JSON made of parts: every third has no count, every fifth an unreadable one."""
    nb = F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).when(F.col("p_partkey") % 5 == 0, "N/A").otherwise((F.col("p_size") * 100).cast("string"))
    stream = F.struct(
        (F.col("p_size") * 16).alias("width"), (F.col("p_size") * 9).alias("height"), F.lit("yuv420p10le").alias("pix_fmt"), F.when(F.col("p_partkey") % 4 == 0, "smpte2084").otherwise("bt709").alias("color_transfer"),
        F.concat((F.col("p_partkey") % 30 + 1).cast("string"), F.lit("000/1001")).alias("avg_frame_rate"), nb.alias("nb_frames"),
    )
    return df.withColumn("probe", F.to_json(F.struct(F.array(stream).alias("streams"))))


def series_info_json(spark: SparkSession, sf: str) -> DataFrame:
    """Probe results read; counts that they lack come from the order lines."""
    counted = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("counted"))
    parts = _probe(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")).join(counted, "p_partkey", "left")
    read = parts.select("p_partkey", "p_brand", "p_size", readers.series_info(F.col("probe"), F.col("counted")).alias("i"))
    tokens = F.array(F.lit("--crf=30"), F.when(F.col("p_size") % 2 == 0, "--transfer=SMPTE2084").otherwise("bt.601"))
    versions = settings.version(F.concat(F.lit("tool v"), F.col("p_size").cast("string"), F.lit(".2."), (F.col("p_partkey") % 7).cast("string"), F.lit("-dirty")))
    found = settings.positions(F.concat_ws(", ", F.col("p_size").cast("string"), "p_brand", F.lit("12")))
    return read.select(
        "p_partkey", "i.n_elements", "i.width", "i.height", "i.transfer", F.round(settings.rate(F.concat_ws("/", "i.rate_num", "i.rate_den")), 6).alias("rate"),
        settings.length_limit(F.lit(None).cast("long"), F.lit(10.0), settings.rate(F.concat_ws("/", "i.rate_num", "i.rate_den"))).alias("limit"),
        settings.model_name(F.col("p_size") > 25, F.col("p_partkey") % 2 == 0).alias("model"), settings.transfer_curve(tokens, F.col("i.transfer")).alias("curve"), versions["major"].alias("major"), versions["patch"].alias("patch"),
        F.element_at(found["good"], 1).alias("first_position"), F.size(found["good"]).alias("positions"), F.element_at(found["bad"], 1).alias("bad_position"), settings.setting_text(F.col("p_size") / 4).alias("setting"),
    )


def series_sanity(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as elements whose size or rate changes in some series: accepted ones with their number, others with the reason."""
    rows = table(spark, sf, "lineitem").select("l_partkey", F.when((F.col("l_partkey") % 5 == 0) & (F.col("l_linenumber") == 1), 640).otherwise(1280).alias("width"), F.lit(720).alias("height"), F.when((F.col("l_partkey") % 7 == 0) & (F.col("l_linenumber") == 2), 25).otherwise(24).alias("rate_num"), F.lit(1).alias("rate_den"))
    good, bad = readers.constant(rows, ["l_partkey"])
    return good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad.withColumn("n", F.lit(None).cast("long")))


def _override_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = (
        F.when(k % 6 == 0, F.concat((k * 10).cast("string"), F.lit(" -1 aom --cq-level="), (k + 20).cast("string"), F.lit(" -x 60 --min-scene-len 12")))
        .when(k % 6 == 1, F.concat(F.lit("  "), (k * 10).cast("string"), F.lit(" "), (k * 10 + 50).cast("string"), F.lit(" rav1e reset --speed 6 --photon-noise 4")))
        .when(k % 6 == 2, F.concat((k * 10).cast("string"), F.lit(" 5 aom")))
        .when(k % 6 == 3, F.concat((k * 10).cast("string"), F.lit(" 9999 aom")))
        .when(k % 6 == 4, F.concat((k * 10).cast("string"), F.lit(" 400 rav1e -s 3")))
        .otherwise(F.when(k % 4 == 1, "   ").otherwise("from here to there"))
    )
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("series"), text.alias("line"))


def overrides_text(spark: SparkSession, sf: str) -> DataFrame:
    """Override lines made of nations, read and checked: accepted ones with their options, others with the reason."""
    from cutline.operators import segments

    raw = _override_lines(spark, sf)
    good, bad = readers.overrides(raw, F.lit(500).cast("long"))
    info = raw.select("series", F.lit(500).cast("long").alias("n_elements"))
    formats = F.create_map(*(F.lit(x) for k in readers.KINDS for x in (k, "annexb" if k in ("x264", "x265") else "ivf")))
    kept, rejected = segments.checked(good, info, ["series"], F.lit("aom"), formats)
    columns = ["series", "start", "end", "kind", "reset", "reject_reason"]
    shown = kept.withColumn("reject_reason", F.lit(None).cast("string")).select(*columns, F.col("options")["-x"].alias("max_len"), F.col("options")["--photon-noise"].alias("noise"), F.map_keys("options").alias("_k"))
    shown = shown.withColumn("options", F.array_join(F.array_sort("_k"), " ")).drop("_k")
    null = lambda n: F.lit(None).cast("string").alias(n)
    rejects = rejected.select(*columns, null("max_len"), null("noise"), null("options"))
    unread = bad.select("series", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), null("kind"), F.lit(None).cast("boolean").alias("reset"), "reject_reason", null("max_len"), null("noise"), null("options"))
    return shown.unionByName(rejects).unionByName(unread)


#: target, limits, probes, statistic, methods and resolution as texts, by order key modulo their number.
POLICY_TEXTS = [
    ("80-85", "10-50", "4", "auto", "natural-pchip", "1280x720"), ("90", "8-35", "3", "percentile=1", "linear-akima", None), ("0", None, None, "standard-deviation=-0.25", None, None),
    ("85-80", None, None, None, None, None), ("x", None, None, None, None, None), (None, "50-10", None, None, None, None), (None, None, "0", None, None, None), (None, None, None, "percentile=101", None, None),
    (None, None, None, "typical", None, None), (None, None, None, None, "pchip-natural", None), (None, None, None, None, None, "720"),
]


def policy_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Policies of order priorities and statuses read from texts; rejected ones with the reason, and how many orders have them."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(POLICY_TEXTS)], "m int, target string, limits string, probes string, statistic string, methods string, resolution string")
    uses = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % len(POLICY_TEXTS)).cast("int").alias("m")).agg(F.count(F.lit(1)).alias("orders"))
    good, bad = settings.normalised_policies(uses.join(F.broadcast(rows), "m"))
    null = lambda n, kind: F.lit(None).cast(kind).alias(n)
    kept = good.select("m", "orders", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "min_q", "max_q", "n_probes", "stat_name", "stat_value", "method_3", "method_4", "width", null("reject_reason", "string"))
    lost = bad.select("m", "orders", null("low", "double"), null("high", "double"), null("min_q", "int"), null("max_q", "int"), null("n_probes", "int"), null("stat_name", "string"), null("stat_value", "double"), null("method_3", "string"), null("method_4", "string"), null("width", "int"), "reject_reason")
    return kept.unionByName(lost)


def zip_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Three channels of the order lines, of which the third lacks some positions, zipped by position."""
    rows = lines(spark, sf).withColumn("series_id", F.col("l_partkey").cast("string"))
    channel = lambda df, c: df.select("series_id", "pos", F.col(c).alias("score"))
    zipped = readers.zipped_channels(channel(rows, "l_quantity"), channel(rows, "l_discount"), channel(rows.filter("pos % 7 < 5"), "l_tax"))
    return zipped.select("series_id", "pos", F.round("score", 6).alias("score"))


def paired_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as inputs, regions as their second inputs; nations beyond the fifth get the first region."""
    return readers.paired(table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_name").alias("name")), "name")


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' ledgers by customer written as JSON documents, one to a line, and read again, counted by the customer's number modulo 20."""
    folder = temporary(spark, f"roundtrip-{uuid.uuid4().hex}")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("series_id"), F.format_string("%09d", "o_orderkey").alias("unit"), (F.col("o_orderkey") % 9 + 1).cast("long").alias("n_elements"), F.col("o_totalprice").cast("long").alias("size_bytes"))
    writers.documents(writers.ledger_json(orders, 0), folder)
    units = readers.ledger(spark, folder, lines=True)[0]
    series = F.concat(F.lit("c"), F.pmod(F.col("series_id").cast("long"), F.lit(20)).cast("string"))
    return units.groupBy(series.alias("series_id")).agg(F.count(F.lit(1)).alias("units"), F.sum("n_elements").alias("elements"), F.sum("size_bytes").alias("bytes"))


QUERIES = {f.__name__: f for f in (vocab_tokens, option_names_x265, unknown_terms, fuzzy_match, series_info_json, series_sanity, overrides_text, policy_texts, zip_channels, paired_inputs, json_roundtrip)}

SQL = {
    "option_names_x265": """SELECT 'x265' AS kind, param FROM (SELECT '-' || substr('abcdefghij', (p_size % 10 + 1)::INT, 1) AS param FROM part UNION SELECT '--size-' || p_size FROM part
        UNION SELECT '--flag' || (p_partkey % 40) FROM part UNION SELECT '--no-flag' || (p_partkey % 40) FROM part UNION SELECT '--value' || p_size FROM part)""",
    "vocab_tokens": r"""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'aom' ELSE 'vpx' END AS kind, unnest(string_split_regex('--' || replace(text, ' ', ' --'), '[ \t\n\r\f]+')) AS w FROM documents),
        n AS (SELECT DISTINCT doc_id, kind, CASE WHEN regexp_extract(w, '^[-_0-9A-Za-z]*') = w THEN CASE WHEN kind = 'vpx' THEN regexp_replace(w, '-$', '') ELSE w END
            WHEN length(regexp_extract(w, '^[-_0-9A-Za-z]*')) > 1 THEN regexp_extract(w, '^[-_0-9A-Za-z]*') END AS param FROM h WHERE w LIKE '-%' AND w NOT IN ('-', '--'))
        SELECT kind, param, count(*) AS texts FROM n WHERE param IS NOT NULL GROUP BY kind, param""",
    "unknown_terms": "SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS token FROM documents) WHERE token NOT IN (SELECT unnest(string_split_regex(text, '[ \\n]+')) FROM benchmark)",
    "fuzzy_match": """WITH k AS (SELECT p_name FROM part UNION SELECT p_brand FROM part),
        a AS (SELECT substr(p_name, 1, length(p_name) % 5) || substr(p_name, length(p_name) % 5 + 2) AS t FROM k UNION SELECT substr(p_name, 2) FROM k UNION SELECT left(p_name, 4) FROM k),
        s AS (SELECT t, p_name, jaro_winkler_similarity(t, p_name) AS s FROM a, k),
        r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(s, 12) DESC, p_name) AS rn FROM s WHERE s > 0.75) SELECT t AS p_name, p_name AS suggestion, round(s, 6) AS similarity FROM r WHERE rn = 1""",
    "series_info_json": """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), p AS (SELECT *, (p_partkey % 30 + 1) * 1000 AS rn FROM part LEFT JOIN c ON l_partkey = p_partkey)
        SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN n ELSE p_size * 100 END::BIGINT AS n_elements, p_size * 16 AS width, p_size * 9 AS height, CASE WHEN p_partkey % 4 = 0 THEN 'smpte2084' ELSE 'bt1886' END AS transfer,
          round(rn / 1001.0::DOUBLE, 6) AS rate, round(rn / 1001.0::DOUBLE * 10)::BIGINT AS "limit", CASE WHEN p_size > 25 THEN 'vmaf_4k_v0.6.1' ELSE 'vmaf_v0.6.1' END || CASE WHEN p_partkey % 2 = 0 THEN 'neg' ELSE '' END AS model,
          CASE WHEN p_size % 2 = 0 THEN 'smpte2084' ELSE 'bt1886' END AS curve, p_size AS major, (p_partkey % 7)::INT AS patch, p_size::BIGINT AS first_position, 2 AS positions, p_brand AS bad_position,
          rtrim(rtrim(printf('%.2f', p_size / 4.0::DOUBLE), '0'), '.') AS setting FROM p""",
    "series_sanity": """WITH e AS (SELECT l_partkey, l_partkey % 5 = 0 AND l_linenumber = 1 AS small, l_partkey % 7 = 0 AND l_linenumber = 2 AS fast FROM lineitem),
        g AS (SELECT l_partkey, count(*) AS n, count(DISTINCT small) AS sizes, count(DISTINCT fast) AS rates FROM e GROUP BY l_partkey)
        SELECT l_partkey, CASE WHEN sizes = 1 AND rates = 1 THEN n END AS n, CASE WHEN sizes > 1 THEN 'size changes' WHEN rates > 1 THEN 'rate changes' END AS reject_reason FROM g""",
    "overrides_text": """WITH n AS (SELECT n_nationkey AS k FROM nation)
        SELECT k AS series, CASE WHEN k % 6 <> 5 THEN k * 10 END::BIGINT AS start, CASE k % 6 WHEN 0 THEN 500 WHEN 1 THEN k * 10 + 50 WHEN 2 THEN 5 WHEN 3 THEN 9999 WHEN 4 THEN 400 END::BIGINT AS "end",
          CASE k % 6 WHEN 1 THEN 'rav1e' WHEN 4 THEN 'rav1e' WHEN 5 THEN NULL ELSE 'aom' END AS kind, CASE WHEN k % 6 <> 5 THEN k % 6 = 1 END AS reset,
          CASE k % 6 WHEN 2 THEN 'start must be before end' WHEN 3 THEN 'past the end of the series' WHEN 4 THEN 'change of kind without reset' WHEN 5 THEN 'invalid syntax' END AS reject_reason,
          CASE WHEN k % 6 = 0 THEN '60' END AS max_len, CASE WHEN k % 6 = 1 THEN '4' END AS noise, CASE k % 6 WHEN 0 THEN '--cq-level --min-scene-len -x' WHEN 1 THEN '--photon-noise --speed' END AS options
        FROM n WHERE NOT (k % 6 = 5 AND k % 4 = 1)""",
    "zip_channels": f"WITH {LINES_SQL} SELECT l_partkey::VARCHAR AS series_id, pos, round((4 * l_quantity + l_discount + l_tax) / 6, 6) AS score FROM l WHERE pos % 7 < 5",
    "paired_inputs": "WITH a AS (SELECT row_number() OVER (ORDER BY n_name) AS i, n_name FROM nation), b AS (SELECT row_number() OVER (ORDER BY r_name) AS i, r_name FROM region) SELECT a.i, n_name AS first, coalesce(r_name, (SELECT min(r_name) FROM region)) AS second FROM a LEFT JOIN b USING (i)",
    "json_roundtrip": "SELECT 'c' || (o_custkey % 20) AS series_id, count(*) AS units, sum(o_orderkey % 9 + 1)::BIGINT AS elements, sum(trunc(o_totalprice)::BIGINT)::BIGINT AS bytes FROM orders GROUP BY 1",
    "policy_texts": """WITH u AS (SELECT (o_orderkey % 11)::INT AS m, count(*) AS orders FROM orders GROUP BY 1)
        SELECT m, orders, CASE m WHEN 0 THEN 80 WHEN 1 THEN 89.1 WHEN 2 THEN 0.00099 END::DOUBLE AS low, CASE m WHEN 0 THEN 85 WHEN 1 THEN 90.9 WHEN 2 THEN 0.00101 END::DOUBLE AS high, CASE m WHEN 0 THEN 10 WHEN 1 THEN 8 END AS min_q, CASE m WHEN 0 THEN 50 WHEN 1 THEN 35 END AS max_q,
          CASE m WHEN 0 THEN 4 WHEN 1 THEN 3 END AS n_probes, CASE m WHEN 0 THEN 'auto' WHEN 1 THEN 'percentile' WHEN 2 THEN 'standard-deviation' END AS stat_name, CASE m WHEN 1 THEN 1 WHEN 2 THEN -0.25 END::DOUBLE AS stat_value,
          CASE m WHEN 0 THEN 'natural' WHEN 1 THEN 'linear' END AS method_3, CASE m WHEN 0 THEN 'pchip' WHEN 1 THEN 'akima' END AS method_4, CASE m WHEN 0 THEN 1280 END AS width,
          CASE m WHEN 3 THEN 'target: min must be below max' WHEN 4 THEN 'target is no number or range' WHEN 5 THEN 'limits: min must be below max' WHEN 6 THEN 'probes must be 1 or more' WHEN 7 THEN 'unknown statistic' WHEN 8 THEN 'unknown statistic' WHEN 9 THEN 'unknown methods' WHEN 10 THEN 'resolution must be WxH' END AS reject_reason
        FROM u""",
}
