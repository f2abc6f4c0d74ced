"""Queries that apply the scalar function pack, group by group, to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.experts import STATUS, UNITS, call
from quillon.functions.small_programs import ELEMENTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The rows dealt out among all cores: a file of few bytes, else one task's, means much work where each row is a program's."""
    return spark.read.parquet(f"{d}/{name}.parquet").repartition(4 * spark.sparkContext.defaultParallelism)


def args(**columns: Column | str | int | float) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in columns.items()])


def six(c: Column) -> Column:
    return F.round(c * 1e6) / 1e6


@query("x_arithmetic", """
SELECT p_partkey, round(p_size + p_retailprice, 6) AS added, round(p_size - p_retailprice, 6) AS less, round(p_size * p_retailprice, 6) AS times,
  CASE WHEN p_size <> 25 THEN round(p_retailprice / (p_size - 25), 6) END AS over, p_size * p_size * 1.0::DOUBLE AS squared, p_partkey % p_size AS rest,
  p_partkey > 1 AND len(list_filter(range(2, CAST(floor(sqrt(p_partkey)) AS BIGINT) + 1), lambda x: p_partkey % x = 0)) = 0 AS prime,
  CAST(gcd(p_partkey, p_size) AS BIGINT) AS divisor, CAST(lcm(p_partkey, p_size) AS BIGINT) AS multiple, CAST(factorial(CAST(p_size % 20 AS INTEGER)) AS BIGINT) AS product,
  to_base(p_partkey, 16) AS hexadecimal, p_partkey AS back,
  ['', 'M', 'MM', 'MMM'][CAST(n // 1000 AS INT) + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][CAST(n // 100 % 10 AS INT) + 1]
    || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][CAST(n // 10 % 10 AS INT) + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][CAST(n % 10 AS INT) + 1] AS roman, n AS of_roman,
  round(p_size / 100.0 * p_retailprice, 6) AS share, pow(floor(sqrt(p_partkey) + 0.5), 2) = p_partkey AS square, round(p_retailprice * (1 + p_size / 100.0), 6) AS more, round(p_retailprice * (1 - p_size / 100.0), 6) AS fewer
FROM (SELECT *, CAST(p_partkey % 3999 + 1 AS INT) AS n FROM part)""")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_partkey") % 3999 + 1).cast("int")
    a = lambda op, **k: call("arithmetic", op, args(**k))
    size, price, key = F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey")
    both = {"a": size, "b": price}
    return table(spark, d, "part").select(
        "p_partkey", six(a("add", **both)).alias("added"), six(a("sub", **both)).alias("less"), six(a("mul", **both)).alias("times"), six(a("div", a=price, b=size - 25)).alias("over"),
        a("pow", a=size, b=2.0).alias("squared"), a("mod", a=key, b=F.col("p_size").cast("long")).alias("rest"), a("is_prime", n=key).alias("prime"),
        a("gcd", a=key, b=F.col("p_size").cast("long")).alias("divisor"), a("lcm", a=key, b=F.col("p_size").cast("long")).alias("multiple"), a("factorial", n=F.col("p_size") % 20).alias("product"),
        a("to_base", n=key, base=16).alias("hexadecimal"), a("from_base", s=a("to_base", n=key, base=2), base=2).alias("back"), a("to_roman", n=n).alias("roman"), a("from_roman", s=a("to_roman", n=n)).alias("of_roman"),
        six(a("percent_of", pct=size, n=price)).alias("share"), a("is_perfect_square", n=key).alias("square"), six(a("percent_increase", n=price, pct=size)).alias("more"), six(a("percent_decrease", n=price, pct=size)).alias("fewer"))


@query("x_date", """
SELECT o_orderkey, date_diff('day', DATE '1995-03-01', o_orderdate::DATE) AS days, dayofweek(o_orderdate::DATE) AS weekday, CAST(strftime(o_orderdate::DATE + CAST(o_custkey % 1000 - 500 AS INT), '%Y%m%d') AS INT) AS later,
  (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap, day(last_day(o_orderdate::DATE)) AS in_month, CAST(floor(date_diff('day', DATE '1995-03-01', o_orderdate::DATE) / 7.0) AS BIGINT) AS weeks FROM orders""")
def date(spark: SparkSession, d: str) -> DataFrame:
    day = F.struct(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"))
    first = F.struct(F.lit(1995).alias("year"), F.lit(3).alias("month"), F.lit(1).alias("day"))
    a = lambda op, **k: call("date", op, args(**k))
    later = a("add_days", date=day, days=(F.col("o_custkey") % 1000 - 500).cast("int"))
    span = {"from": first, "to": day}
    return table(spark, d, "orders").select(
        "o_orderkey", a("days_between", **span).alias("days"), a("day_of_week", date=day).alias("weekday"), (later["year"] * 10000 + later["month"] * 100 + later["day"]).alias("later"),
        a("is_leap_year", year=F.year("o_orderdate")).alias("leap"), a("days_in_month", year=F.year("o_orderdate"), month=F.month("o_orderdate")).alias("in_month"), a("weeks_between", **span).alias("weeks"))


_SI = " ".join(f"WHEN '{u}' THEN {factor!r}::DOUBLE" for u, (_, factor) in UNITS.items())


@query("x_unit", f"""
SELECT l_orderkey, l_linenumber, round(l_quantity * 1000 / 1609.344, 6) AS miles, round(l_quantity * 9 / 5 + 32, 6) AS fahrenheit, NULL::DOUBLE AS none, CASE ['m', 'kg', 'min', 'gal'][l_linenumber % 4 + 1] {_SI} END AS si,
  ['length', 'mass', 'time', 'volume'][l_linenumber % 4 + 1] AS kind, (SELECT count(*) FROM (VALUES {", ".join(f"('{g}')" for g, _ in UNITS.values())}) u(g) WHERE g = ['length', 'mass', 'time', 'volume'][l_linenumber % 4 + 1]) AS units FROM lineitem""")
def unit(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, **k: call("unit", op, args(**k))
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("l_linenumber") % 4 + 1)
    info = a("unit_info", unit=of(["m", "kg", "min", "gal"]))
    convert = lambda x, y: a("convert", **{"value": "l_quantity", "from": F.lit(x), "to": F.lit(y)})
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", six(convert("km", "mi")).alias("miles"), six(convert("C", "F")).alias("fahrenheit"), convert("km", "kg").alias("none"), info["to_si"].alias("si"), info["group"].alias("kind"),
        F.size(a("list_units", group=of(["length", "mass", "time", "volume"]))).cast("long").alias("units"))


@query("x_statistics", """
WITH v AS (SELECT l_orderkey, list(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(list_avg(v), 6) AS mean, round(list_median(v), 6) AS median, list_min(v) AS least, list_max(v) AS most, array_to_string(list_transform(list_sort(v), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS sorted, len(v) AS n,
  round(list_stddev_pop(v), 6) AS stddev, round(list_var_pop(v), 6) AS variance, list_sum(v) AS total, list_max(v) - list_min(v) AS span,
  array_to_string(list_transform(list_sort(list_filter(list_distinct(v), lambda x: len(list_filter(v, lambda y: y = x)) = list_max(list_transform(v, lambda z: len(list_filter(v, lambda y: y = z)))))), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS modes FROM v""")
def statistics(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op: call("statistics", op, args(values="v"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return rows.select(
        "l_orderkey", six(a("mean")).alias("mean"), six(a("median")).alias("median"), a("min").alias("least"), a("max").alias("most"), text(a("sort")).alias("sorted"), a("count").cast("long").alias("n"),
        six(a("stddev")).alias("stddev"), six(a("variance")).alias("variance"), a("sum").alias("total"), a("range").alias("span"), text(a("mode")).alias("modes"))


_SHAPES = {
    "circle_area": ("r", "pi() * r * r"), "circle_circumference": ("r", "2 * pi() * r"), "circle_diameter": ("r", "2 * r"), "sphere_volume": ("r", "4.0 / 3 * pi() * r * r * r"), "sphere_surface_area": ("r", "4 * pi() * r * r"),
    "triangle_area_bh": ("base=a height=b", "a * b / 2"), "rectangle_perimeter": ("l=a w=b", "2 * (a + b)"), "rectangle_area": ("l=a w=b", "a * b"), "hypotenuse": ("a b", "sqrt(a * a + b * b)"), "cylinder_volume": ("r h=b", "pi() * r * r * b"),
    "cone_volume": ("r h=b", "pi() * r * r * b / 3"), "cube_volume": ("s=a", "a * a * a"), "box_volume": ("l=a w=b h=r", "a * b * r"), "square_area": ("s=a", "a * a"), "square_perimeter": ("s=a", "4 * a"),
    "triangle_area_heron": ("a=a b=a c=a", "sqrt(3.0) / 4 * a * a"), "trapezoid_area": ("a b h=r", "(a + b) / 2 * r"), "ellipse_area": ("a b", "pi() * a * b"),
}
_ANGLES = {
    "sin": ("x", "sin(x)"), "cos": ("x", "cos(x)"), "tan": ("x", "tan(x)"), "atan": ("x", "atan(x)"), "asin": ("x=y", "CASE WHEN abs(y) <= 1 THEN asin(y) END"), "acos": ("x=y", "CASE WHEN abs(y) <= 1 THEN acos(y) END"),
    "sec": ("x", "1 / cos(x)"), "csc": ("x", "1 / sin(x)"), "cot": ("x", "1 / tan(x)"), "deg_to_rad": ("deg=x", "radians(x)"), "rad_to_deg": ("rad=x", "degrees(x)"),
}


def _each(group: str, ops: dict[str, tuple[str, str]]) -> list[Column]:
    named = lambda spec: {p.split("=")[0]: p.split("=")[-1] for p in spec.split()}
    return [six(call(group, op, args(**named(spec)))).alias(op) for op, (spec, _) in ops.items()]


def _each_sql(ops: dict[str, tuple[str, str]]) -> str:
    return ", ".join(f"round({sql}, 6) AS {op}" for op, (_, sql) in ops.items())


@query("x_geometry", f"SELECT p_partkey, {_each_sql(_SHAPES)} FROM (SELECT p_partkey, p_size / 7.0::DOUBLE AS r, p_size / 3.0::DOUBLE AS a, (p_partkey % 90 + 10) / 9.0::DOUBLE AS b FROM part)")
def geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 7).alias("r"), (F.col("p_size") / 3).alias("a"), ((F.col("p_partkey") % 90 + 10) / 9).alias("b"))
    return rows.select("p_partkey", *_each("geometry", _SHAPES))


@query("x_trig", f"SELECT p_partkey, {_each_sql(_ANGLES)} FROM (SELECT p_partkey, (p_partkey % 997 + 1) / 311.0::DOUBLE AS x, (p_partkey % 401 - 200) / 150.0::DOUBLE AS y FROM part)")
def trig(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 997 + 1) / 311).alias("x"), ((F.col("p_partkey") % 401 - 200) / 150).alias("y"))
    return rows.select("p_partkey", *_each("trig", _ANGLES))


_ABC = "abcdefghijklmnopqrstuvwxyz"
_turned = lambda n: (_ABC + _ABC.upper(), _ABC[n:] + _ABC[:n] + (_ABC[n:] + _ABC[:n]).upper())


@query("x_string_ops", f"""
SELECT p_partkey, reverse(p_name) AS backwards, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') = reverse(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) AS palindrome,
  list_sort(string_split(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), '')) = list_sort(string_split(regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g'), '')) AS anagram,
  translate(p_name, '{_turned(3)[0]}', '{_turned(3)[1]}') AS moved, translate(p_name, '{_turned(13)[0]}', '{_turned(13)[1]}') AS turned, upper(p_name) AS up, lower(p_type) AS down, length(p_name) AS n,
  CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INT) AS times, CAST((length(p_name) - length(replace(p_name, 're', ''))) / 2 AS INT) AS twice, len(list_filter(string_split_regex(p_name, '\\s+'), lambda w: w <> '')) AS words,
  contains(p_name, 'ar') AS has, starts_with(p_name, 's') AS starts, ends_with(p_name, 'n') AS ends FROM part""")
def string_ops(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, **k: call("string_ops", op, args(**k))
    s = {"s": "p_name"}
    return table(spark, d, "part").select(
        "p_partkey", a("reverse", **s).alias("backwards"), a("is_palindrome", **s).alias("palindrome"), a("is_anagram", a="p_name", b="p_type").alias("anagram"), a("caesar", **s, shift=3).alias("moved"), a("rot13", **s).alias("turned"),
        a("uppercase", **s).alias("up"), a("lowercase", s="p_type").alias("down"), a("length", **s).cast("long").alias("n"), a("count_char", **s, ch=F.lit("e")).alias("times"), a("count_substring", **s, needle=F.lit("re")).alias("twice"),
        a("count_words", **s).cast("long").alias("words"), a("contains", **s, needle=F.lit("ar")).alias("has"), a("starts_with", **s, prefix=F.lit("s")).alias("starts"), a("ends_with", **s, suffix=F.lit("n")).alias("ends"))


@query("x_hash", """
SELECT p_partkey, to_base64(encode(p_name)) AS b64, p_name AS b64_back, lower(hex(encode(p_name))) AS hexadecimal, p_name AS hex_back, url_encode(p_type || ' 100%/é') AS url, p_type || ' 100%/é' AS url_back,
  '0x' || lpad(lower(hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_brand, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296))), 8, '0') AS fnv FROM part""")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, s: call("hash", op, args(s=s))
    name, url = F.col("p_name"), F.concat("p_type", F.lit(" 100%/é"))
    return table(spark, d, "part").select(
        "p_partkey", a("base64_encode", name).alias("b64"), a("base64_decode", a("base64_encode", name)).alias("b64_back"), a("hex_encode", name).alias("hexadecimal"), a("hex_decode", a("hex_encode", name)).alias("hex_back"),
        a("url_encode", url).alias("url"), a("url_decode", a("url_encode", url)).alias("url_back"), a("fnv1a_32", F.col("p_brand")).alias("fnv"))


@query("x_finance", """
SELECT o_orderkey, round(v * pow(1 + r / 100, y), 5) AS future, round(v / pow(1 + r / 100, y), 5) AS present, round(v * (pow(1 + r / 100, y) - 1), 5) AS compound, round(v * r * y / 100, 5) AS simple, round(0.6 - 0.4 / r, 6) AS kelly,
  round((v - 1000) / 1000, 6) AS roi, round(-1000 + v / (1 + r / 100) + v / pow(1 + r / 100, 2), 5) AS npv, round(v * (r / 1200) / (1 - pow(1 + r / 1200, -y * 12)), 5) AS mortgage, round(0.9 * 0.01 / r, 6) AS bayes, NULL::DOUBLE AS none
FROM (SELECT o_orderkey, o_totalprice AS v, (o_custkey % 12 + 1)::DOUBLE AS r, (o_orderkey % 30 + 1)::DOUBLE AS y FROM orders)""")
def finance(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, **k: call("finance", op, args(**k))
    five = lambda c: F.round(c * 1e5) / 1e5
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), (F.col("o_custkey") % 12 + 1).cast("double").alias("r"), (F.col("o_orderkey") % 30 + 1).cast("double").alias("y"))
    loan = {"rate_pct": "r", "years": "y"}
    return rows.select(
        "o_orderkey", five(a("future_value", pv="v", **loan)).alias("future"), five(a("present_value", fv="v", **loan)).alias("present"), five(a("compound_interest", principal="v", **loan)).alias("compound"),
        five(a("simple_interest", principal="v", **loan)).alias("simple"), six(a("kelly", p=0.6, b="r")).alias("kelly"), six(a("roi", gain="v", cost=1000.0)).alias("roi"),
        five(a("npv", cash_flows=F.array(F.lit(-1000.0), F.col("v"), F.col("v")), discount_pct="r")).alias("npv"), five(a("mortgage_payment", principal="v", annual_rate_pct="r", years="y")).alias("mortgage"),
        six(a("bayes", p_b_given_a=0.9, p_a=0.01, p_b="r")).alias("bayes"), a("bayes", p_b_given_a=0.9, p_a=0.01, p_b=0.0).alias("none"))


_CODE = "CAST(event_id % 400 + 200 AS INT)"


@query("x_http_status", f"""
SELECT event_id, reason, CASE WHEN reason IS NOT NULL THEN CAST({_CODE} // 100 AS VARCHAR) || 'xx' END AS category
FROM (SELECT event_id, CASE {_CODE} {" ".join(f"WHEN {c} THEN '{r.replace(chr(39), chr(39) * 2)}'" for c, r in STATUS.items())} END AS reason FROM events)""")
def http_status(spark: SparkSession, d: str) -> DataFrame:
    found = call("http_status", "lookup", args(code=(F.col("event_id") % 400 + 200).cast("int")))
    return table(spark, d, "events").select("event_id", found["reason"].alias("reason"), found["category"].alias("category"))


_ALL = lambda text, f: f"list_sum(list_transform(range(len({text})), lambda i: {f.replace('@', f'CAST(substr({text}, CAST(i + 1 AS INT), 1) AS BIGINT)')}))"
_ISBN13 = "(10 - " + _ALL("s", "@ * CASE WHEN i % 2 = 0 THEN 1 ELSE 3 END") + " % 10) % 10"
_ISBN10 = "(11 - " + _ALL("t", "@ * (10 - i)") + " % 11) % 11"
_LUHN = "(10 - " + _ALL("reverse(n)", "CASE WHEN i % 2 = 0 THEN CASE WHEN @ > 4 THEN 2 * @ - 9 ELSE 2 * @ END ELSE @ END") + " % 10) % 10"


@query("x_isbn", f"""
WITH a AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS t, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS s FROM part),
b AS (SELECT p_partkey, t, s || CAST({_ISBN13} AS VARCHAR) AS isbn13, t || CASE {_ISBN10} WHEN 10 THEN 'X' ELSE CAST({_ISBN10} AS VARCHAR) END AS isbn10 FROM a)
SELECT p_partkey, isbn13, isbn10, true AS ok13, true AS ok10, isbn13[13] = '5' AS guess FROM b""")
def isbn(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, c: call("isbn", op, args(isbn=c))
    nine = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    rows = table(spark, d, "part").select("p_partkey", nine.alias("t"), a("isbn10_to_isbn13", F.concat(nine, F.lit("0"))).alias("isbn13"))
    rows = rows.withColumn("isbn10", a("isbn13_to_isbn10", F.col("isbn13")))
    return rows.select("p_partkey", "isbn13", "isbn10", a("validate", F.col("isbn13"))["valid"].alias("ok13"), a("validate", F.col("isbn10"))["valid"].alias("ok10"), a("validate", F.concat(F.lit("978"), "t", F.lit("5")))["valid"].alias("guess"))


@query("x_luhn", f"""
SELECT o_orderkey, {_LUHN} AS digit, true AS good, {_LUHN} = 7 AS guess, CASE WHEN n[1] = '4' THEN 'visa' WHEN regexp_matches(n, '^3[47]') THEN 'amex' WHEN regexp_matches(n, '^(5[1-5]|2[2-7])') THEN 'mastercard' WHEN regexp_matches(n, '^6(011|5)') THEN 'discover' ELSE 'unknown' END AS kind
FROM (SELECT o_orderkey, CAST(o_orderkey % 9 + 1 AS VARCHAR) || lpad(CAST(o_orderkey * 104729 % 100000000000000 AS VARCHAR), 14, '0') AS n FROM orders)""")
def luhn(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, c: call("luhn", op, args(number=c))
    n = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lpad((F.col("o_orderkey") * 104729 % 100000000000000).cast("string"), 14, "0"))
    rows = table(spark, d, "orders").select("o_orderkey", n.alias("n")).withColumn("digit", a("generate_check_digit", F.col("n")).cast("long"))
    return rows.select("o_orderkey", "digit", a("check", F.concat("n", "digit")).alias("good"), a("check", F.concat("n", F.lit("7"))).alias("guess"), a("card_type", F.col("n")).alias("kind"))


@query("x_markov", """
SELECT p_partkey, round(0.2 * a + 0.5 * b + 0.3, 6) AS expected, round(q / (p + q), 6) AS first, round(p / (p + q), 6) AS second
FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, (p_size % 9 + 1) / 20.0::DOUBLE AS p, (p_partkey % 9 + 1) / 20.0::DOUBLE AS q FROM part)""")
def markov(spark: SparkSession, d: str) -> DataFrame:
    p, q = (F.col("p_size") % 9 + 1) / 20, (F.col("p_partkey") % 9 + 1) / 20
    chances = F.array(*map(F.lit, (0.2, 0.5, 0.3)))
    steady = call("markov", "steady_state", args(matrix=F.array(F.array(1 - p, p), F.array(q, 1 - q))))
    expected = call("markov", "expected_value", args(outcomes=F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(1.0)), probabilities=chances))
    return table(spark, d, "part").select("p_partkey", six(expected).alias("expected"), six(steady[0]).alias("first"), six(steady[1]).alias("second"))


_BIT = lambda i, j, of: f"(({of} >> {3 * i + j}) & 1)" if 0 <= i < 3 and 0 <= j < 3 else "0"


def _next_sql(of: str) -> str:
    """The number whose bits are the next generation of a three by three grid of bits."""
    cells = []
    for i in range(3):
        for j in range(3):
            around = " + ".join(_BIT(i + a, j + b, of) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
            cells.append(f"CASE WHEN ({around}) = 3 OR ({around}) = 2 AND {_BIT(i, j, of)} = 1 THEN {1 << (3 * i + j)} ELSE 0 END")
    return "(" + " + ".join(cells) + ")"


@query("x_conway", f"SELECT p_partkey, b AS one, {_next_sql('b')} AS two, CAST(bit_count(CAST({_next_sql('b')} AS BIGINT)) AS INT) AS live FROM (SELECT p_partkey, {_next_sql('a')} AS b FROM (SELECT p_partkey, CAST(p_partkey * 37 % 512 AS INT) AS a FROM part))")
def conway(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_partkey") * 37 % 512).cast("int")
    grid = F.array(*[F.array(*[F.shiftright(n, 3 * i + j).bitwiseAND(1) for j in range(3)]) for i in range(3)])
    number = lambda g: sum((F.shiftleft(g[i][j], 3 * i + j) for i in range(3) for j in range(3)), F.lit(0))
    two = call("conway", "simulate", args(grid=grid, generations=2))
    return table(spark, d, "part").select("p_partkey", number(call("conway", "step", args(grid=grid))).alias("one"), number(two["grid"]).alias("two"), two["live"].alias("live"))


@query("x_logic", """
SELECT p_partkey, p_size % 2 = 0 AND (p_partkey % 3 = 0 OR NOT (p_size > 25)) AS holds, ['tautology', 'contradiction', 'contingent'][p_partkey % 3 + 1] AS kind, 4 AS rows, 'A OR B' AS simple FROM part""")
def logic(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, **k: call("logic", op, args(**k))
    size, key = F.col("p_size"), F.col("p_partkey")
    known = F.create_map(F.lit("Even"), size % 2 == 0, F.lit("third"), key % 3 == 0, F.lit("big"), size > 25)
    of = F.element_at(F.array(*map(F.lit, ("A OR NOT A", "A AND not A", "A OR B"))), (key % 3 + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", a("eval", expr=F.lit("Even AND (third OR NOT big)"), assignments=known).alias("holds"), a("classify", expr=of).alias("kind"),
        F.size(a("truth_table", expr=F.lit("A and B"))["rows"]).cast("long").alias("rows"), a("simplify", expr=F.lit("NOT NOT A OR (B OR A) OR FALSE")).alias("simple"))


@query("x_dijkstra", """
SELECT p_partkey, least(a + b, c)::DOUBLE AS distance, CASE WHEN a + b < c THEN 'x/y/z' ELSE 'x/z' END AS path, true AS there, false AS back, (a + b + c - greatest(a, b, c))::DOUBLE AS tree
FROM (SELECT p_partkey, p_size AS a, p_partkey % 17 + 1 AS b, p_partkey % 41 + 10 AS c FROM part) WHERE a + b <> c""")
def dijkstra(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, **k: call("dijkstra", op, args(**k))
    w = [F.col("p_size"), F.col("p_partkey") % 17 + 1, F.col("p_partkey") % 41 + 10]
    edges = F.array(*[F.array(F.lit(x), F.lit(y), c.cast("string")) for (x, y), c in zip(("xy", "yz", "xz"), w, strict=True)])
    to = lambda x, y: {"edges": edges, "from": F.lit(x), "to": F.lit(y)}
    way = a("shortest_path", **to("x", "z"))
    return table(spark, d, "part").where(w[0] + w[1] != w[2]).select(
        "p_partkey", way["distance"].alias("distance"), F.array_join(way["path"], "/").alias("path"), a("reachable", **to("x", "z"))["reachable"].alias("there"), a("reachable", **to("z", "x"))["reachable"].alias("back"),
        a("mst", edges=edges)["weight"].alias("tree"))


@query("x_graph", """
SELECT o_orderkey, 'o' AS central, n AS degree, n >= 3 AS cycle, CASE WHEN n = 1 THEN 2 ELSE 1 END AS parts, n < 3 AS bipartite, CASE WHEN n < 3 THEN 'o' END AS first, n + 1 AS nodes
FROM (SELECT l_orderkey AS o_orderkey, least(count(*), 4) AS n FROM lineitem GROUP BY 1) WHERE n >= 2""")
def graph(spark: SparkSession, d: str) -> DataFrame:
    """A star with a ray for each line of an order, up to four; from three lines on its first three points are a ring."""
    a = lambda op, **k: call("graph", op, args(**k))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.least(F.count("*"), F.lit(4)).alias("n")).where("n >= 2")
    point = lambda i: F.concat(F.lit("p"), i.cast("string"))
    rays = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.array(F.lit("o"), point(i)))
    edges = F.when(F.col("n") >= 3, F.concat(rays, F.array(F.array(F.lit("p1"), F.lit("p2")), F.array(F.lit("p2"), F.lit("o"))))).otherwise(rays)
    top, order = a("most_central", edges=rays), a("topological_sort", edges=edges)
    return rows.select(
        "o_orderkey", top["node"].alias("central"), top["degree"].cast("long").alias("degree"), a("has_cycle", edges=edges, directed=F.lit(True)).alias("cycle"), a("connected_components", edges=edges).alias("parts"),
        a("is_bipartite", edges=edges).alias("bipartite"), F.get(order, F.lit(0)).alias("first"), F.size(a("degrees", edges=edges)).cast("long").alias("nodes"))


@query("x_sql", "SELECT p_partkey, CAST(p_size + p_partkey % 7 AS VARCHAR) AS total, '\"' || p_brand || '\"' AS brand FROM part")
def sql(spark: SparkSession, d: str) -> DataFrame:
    run = lambda script: call("sql", "execute", args(sql=script))
    head = F.concat(F.lit("CREATE TABLE t (x int, b text); INSERT INTO t VALUES ("), F.col("p_size"), F.lit(", '"), F.col("p_brand"), F.lit("'); INSERT INTO t VALUES ("), F.col("p_partkey") % 7, F.lit(", 'other');"))
    return table(spark, d, "part").select("p_partkey", run(F.concat(head, F.lit("SELECT sum(x) FROM t"))).alias("total"), run(F.concat(head, F.lit("SELECT b FROM t WHERE b <> 'other'"))).alias("brand"))


_Z = "CAST(p_partkey % 118 + 1 AS INT)"


@query("x_element", f"""
WITH e(z, symbol, name, mass) AS (VALUES {", ".join(f"({z}, '{s}', '{n}', {float(m)}::DOUBLE)" for z, (s, n, m) in enumerate(ELEMENTS, 1))})
SELECT p_partkey, e.symbol, e.name, e.mass, e.z, 118 AS n FROM part JOIN e ON e.z = {_Z}""")
def element(spark: SparkSession, d: str) -> DataFrame:
    a = lambda op, **k: call("element", op, args(**k))
    found = a("by_number", z=(F.col("p_partkey") % 118 + 1).cast("int"))
    again = a("by_name", name=F.upper(a("by_symbol", symbol=F.lower(found["symbol"]))["name"]))
    rows = table(spark, d, "part").select("p_partkey", again.alias("e"), F.size(a("list", any=F.lit(""))).cast("long").alias("n"))
    return rows.select("p_partkey", "e.symbol", "e.name", "e.mass", "e.z", "n")
