"""Scalar functions: strings, dates, numbers, arrays, maps, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.nearest import nearest
from tessera.plans.base import Registry
from tessera.sources.tables import table

registry = Registry()
query = registry.query


@query("""
    SELECT p_partkey, upper(p_brand) AS up, lower(p_type) AS low, CAST(length(p_name) AS INTEGER) AS len, substr(p_name, 2, 4) AS part, p_brand || '-' || p_type AS both, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded,
      rpad(p_brand, 12, '*') AS right_pad, trim('  ' || p_brand || ' ') AS trimmed, replace(p_name, 'a', '@') AS swapped, reverse(p_brand) AS back, repeat('x', 3) AS thrice, CAST(instr(p_name, 'a') AS INTEGER) AS at,
      split_part(p_name, '_', 1) AS head, md5(p_name) AS digest, sha256(p_name) AS sha, translate(p_brand, 'ABC', 'abc') AS mapped, p_name LIKE '%1%' AS has_one, left(p_name, 3) AS l3, right(p_name, 3) AS r3,
      CAST(levenshtein(p_brand, p_type) AS INTEGER) AS distance, CAST(ascii(p_brand) AS INTEGER) AS code, starts_with(p_name, 'P') AS starts FROM part""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(brand).alias("up"), F.lower(kind).alias("low"), F.length(name).alias("len"), F.substr(name, F.lit(2), F.lit(4)).alias("part"), F.concat(brand, F.lit("-"), kind).alias("both"),
        F.lpad(F.col("p_size").cast("string"), 5, "0").alias("padded"), F.rpad(brand, 12, "*").alias("right_pad"), F.trim(F.concat(F.lit("  "), brand, F.lit(" "))).alias("trimmed"), F.replace(name, F.lit("a"), F.lit("@")).alias("swapped"),
        F.reverse(brand).alias("back"), F.repeat(F.lit("x"), 3).alias("thrice"), F.instr(name, "a").alias("at"), F.split_part(name, F.lit("_"), F.lit(1)).alias("head"), F.md5(name).alias("digest"), F.sha2(name, 256).alias("sha"),
        F.translate(brand, "ABC", "abc").alias("mapped"), name.like("%1%").alias("has_one"), F.left(name, F.lit(3)).alias("l3"), F.right(name, F.lit(3)).alias("r3"), F.levenshtein(brand, kind).alias("distance"), F.ascii(brand).alias("code"), F.startswith(name, F.lit("P")).alias("starts"),
    )


@query(r"""
    SELECT doc_id, regexp_extract(text, '([A-Za-z]+) the', 1) AS before_the, CAST(len(regexp_extract_all(text, 'the')) AS INTEGER) AS n_the, regexp_matches(text, '[0-9]{3}') AS has_number,
      md5(regexp_replace(text, '[aeiou]', '', 'g')) AS consonants, CAST(len(string_split_regex(text, '[ \n]+')) AS INTEGER) AS n_words FROM documents""")
def regular_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_extract(text, "([A-Za-z]+) the", 1).alias("before_the"), F.regexp_count(text, F.lit("the")).alias("n_the"), F.rlike(text, F.lit("[0-9]{3}")).alias("has_number"),
        F.md5(F.regexp_replace(text, "[aeiou]", "")).alias("consonants"), F.size(F.split(text, r"[ \n]+")).alias("n_words"),
    )


@query("""
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow,
      CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(weekofyear(o_orderdate) AS INTEGER) AS woy, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, last_day(o_orderdate) AS month_end, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS later,
      CAST(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS INTEGER) AS days_left, strftime(o_orderdate, '%Y/%m/%d') AS text, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, o_orderdate + INTERVAL 2 MONTH AS two_months FROM orders""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.day(day).alias("d"), F.quarter(day).alias("q"), F.dayofweek(day).alias("dow"), F.dayofyear(day).alias("doy"), F.weekofyear(day).alias("woy"),
        F.date_trunc("month", day).cast("timestamp_ntz").alias("month_start"), F.last_day(day).alias("month_end"), F.date_add(day, 10).alias("later"), F.date_diff(F.lit("2002-01-01").cast("date"), day).alias("days_left"),
        F.date_format(day, "yyyy/MM/dd").alias("text"), F.unix_seconds(day.cast("timestamp")).alias("seconds"), (day + F.expr("interval 2 months")).alias("two_months"),
    )


@query("""
    SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(l_extendedprice, 1) AS rounded, floor(l_extendedprice)::BIGINT AS low, ceil(l_extendedprice)::BIGINT AS high, abs(l_discount - 0.05) AS distance, l_orderkey % 7 AS modulo, CAST(l_orderkey // 7 AS BIGINT) AS whole,
      round(sqrt(l_quantity), 9) AS root, round(ln(l_quantity), 9) AS log, round(exp(l_discount), 9) AS e, round(pow(l_quantity, 1.5), 6) AS power, CAST(sign(l_discount - 0.05) AS DOUBLE) AS direction, greatest(l_quantity, l_linenumber) AS most,
      least(l_quantity, l_linenumber) AS fewest, nullif(l_linenumber, 1) AS not_one, coalesce(nullif(l_linenumber, 1), -1) AS filled, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'middle' ELSE 'small' END AS kind, l_orderkey & 12 AS bits, xor(l_orderkey, 5) AS flipped FROM lineitem""")
def numeric_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, quantity, key, line = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.round(price, 1).alias("rounded"), F.floor(price).alias("low"), F.ceil(price).alias("high"), F.abs(F.col("l_discount") - 0.05).alias("distance"), (key % 7).alias("modulo"),
        F.expr("l_orderkey div 7").alias("whole"), F.round(F.sqrt(quantity), 9).alias("root"), F.round(F.ln(quantity), 9).alias("log"), F.round(F.exp("l_discount"), 9).alias("e"), F.round(F.pow(quantity, F.lit(1.5)), 6).alias("power"),
        F.signum(F.col("l_discount") - 0.05).alias("direction"), F.greatest(quantity, line.cast("double")).alias("most"), F.least(quantity, line.cast("double")).alias("fewest"), F.nullif(line, F.lit(1)).alias("not_one"),
        F.coalesce(F.nullif(line, F.lit(1)), F.lit(-1)).alias("filled"), F.when(quantity > 40, "big").when(quantity > 20, "middle").otherwise("small").alias("kind"), key.bitwiseAND(12).alias("bits"), key.bitwiseXOR(5).alias("flipped"),
    )


@query("""
    SELECT user_id, list_sort(l) AS sorted, CAST(len(l) AS INTEGER) AS n, list_sort(list_distinct([x % 5 for x in l])) AS residues, list_sort([x for x in l if x % 2 = 0]) AS even, list_contains(l, 7) AS has7,
      CAST(list_sum(l) AS BIGINT) AS total, list_max(l) AS top, list_slice(list_sort(l), 1, 3) AS first3, list_sort(l)[1] AS head, array_to_string(list_sort(l), '-') AS joined FROM (SELECT user_id, list(event_id) AS l FROM events GROUP BY user_id)""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("l"))
    return lists.select(
        "user_id", F.col("l").alias("sorted"), F.size("l").alias("n"), F.sort_array(F.array_distinct(F.transform("l", lambda x: x % 5))).alias("residues"), F.filter("l", lambda x: x % 2 == 0).alias("even"), F.array_contains("l", 7).alias("has7"),
        F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("l").alias("top"), F.slice("l", 1, 3).alias("first3"), F.element_at("l", 1).alias("head"), F.array_join(F.transform("l", lambda x: x.cast("string")), "-").alias("joined"),
    )


@query("SELECT event_type, part, count(*) AS n FROM (SELECT event_type, unnest(string_split(event_type, 'e')) AS part FROM events) GROUP BY ALL")
def explode_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "events").select("event_type", F.explode(F.split("event_type", "e")).alias("part"))
    return parts.groupBy("event_type", "part").agg(F.count("*").alias("n"))


@query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1 FROM events""")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k long, missing string")
    variant = F.variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), parsed["missing"].alias("missing"), (variant + 1).alias("k1"))


@query("SELECT user_id, m['click'] AS clicks, CAST(cardinality(m) AS INTEGER) AS kinds, list_sort(map_keys(m)) AS names, m['absent'] AS absent FROM (SELECT user_id, map_from_entries(list((event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.try_element_at("m", F.lit("click")).alias("clicks"), F.size("m").alias("kinds"), F.sort_array(F.map_keys("m")).alias("names"), F.try_element_at("m", F.lit("absent")).alias("absent"))


@query("SELECT n_nationkey, n_name, TRY_CAST(n_name AS INTEGER) AS bad, TRY_CAST('12' AS INTEGER) AS good, CAST(n_nationkey AS VARCHAR) AS text, n_nationkey / nullif(n_regionkey, 0) AS ratio, n_regionkey IS NULL AS missing, n_name IS DISTINCT FROM 'NATION_3' AS other FROM nation")
def casts_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", F.col("n_name").try_cast("int").alias("bad"), F.lit("12").try_cast("int").alias("good"), F.col("n_nationkey").cast("string").alias("text"), F.try_divide("n_nationkey", "n_regionkey").alias("ratio"),
        F.col("n_regionkey").isNull().alias("missing"), (~F.col("n_name").eqNullSafe("NATION_3")).alias("other"),
    )


@query("""
    SELECT a.vec_id AS query_id, b.vec_id AS match_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 9) AS similarity
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) <= 5""")
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every hundredth vector, against all others."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@query("SELECT conv_id, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ' ' ORDER BY turn) AS outline, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversation_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("t"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns_"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return grouped.select("conv_id", F.array_join(F.col("turns_.t"), " ").alias("outline"), "turns", "chars")


@query(r"""
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, split_part(split_part(url, '#', 1), '?', 2) AS query, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS links FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")).alias("query"), F.regexp_count("html", F.lit("<a ")).alias("links"))


@query("""
    SELECT doc_id, regexp_extract_all(text, '[0-9]{4}') AS years, CAST(len(regexp_extract_all(text, '([A-Z])[a-z]+', 1)) AS INTEGER) AS capitals, regexp_extract(text, '[a-z]+') AS first_word FROM documents""")
def regexp_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = F.regexp_extract_all("text", F.lit("([A-Z])[a-z]+"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]{4}"), F.lit(0)).alias("years"), F.size(capitals).alias("capitals"), F.regexp_extract("text", "[a-z]+", 0).alias("first_word"))


@query("SELECT r_name, CASE r_name WHEN 'AFRICA' THEN 'A162' WHEN 'AMERICA' THEN 'A562' WHEN 'ASIA' THEN 'A200' WHEN 'EUROPE' THEN 'E610' ELSE 'M342' END AS sound FROM region")
def soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_name", F.soundex("r_name").alias("sound"))


@query("""
    SELECT event_id, CAST(to_json({'event_id': event_id, 'event_type': event_type, 'k': CAST(json_extract_string(props, '$.k') AS BIGINT)}) AS VARCHAR) AS written, json_extract_string(props, '$.k') AS k,
      'STRUCT<k: BIGINT>' AS shape FROM events""")
def json_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.to_json(F.struct("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")))
    return table(spark, sf_dir, "events").select("event_id", row.alias("written"), F.json_tuple("props", "k").alias("k"), F.schema_of_json(F.lit('{"k": 1}')).alias("shape"))


@query("""
    SELECT n_regionkey, list_transform(list_zip(k, n), lambda x: CAST(x[1] AS VARCHAR) || '=' || x[2]) AS pairs, list_reverse_sort(k) AS falling, list_transform(k, lambda x: x * 3) AS tripled
    FROM (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS k, list(n_name ORDER BY n_name) AS n FROM nation GROUP BY 1)""")
def array_and_map_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"), F.sort_array(F.collect_list("n_name")).alias("names"))
    pairs = F.transform(F.arrays_zip("keys", "names"), lambda x: F.concat(x["keys"].cast("string"), F.lit("="), x["names"]))
    falling = F.array_sort("keys", lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    doubled = F.map_from_arrays("keys", F.transform("keys", lambda x: x * 2))
    summed = F.map_zip_with(F.map_from_arrays("keys", "keys"), doubled, lambda k, a, b: a + b)
    return lists.select("n_regionkey", pairs.alias("pairs"), falling.alias("falling"), F.sort_array(F.map_values(summed)).alias("tripled"))


@query("SELECT event_id, ts + INTERVAL 1 MONTH + INTERVAL 3 DAY + INTERVAL 2 HOUR AS later, ts - INTERVAL (user_id % 5) DAY AS earlier FROM events")
def made_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from numbers, constant and from columns."""
    days = F.make_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("user_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.make_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(3), F.lit(2))).alias("later"), (F.col("ts") - days).alias("earlier"))
