"""Queries that Catalyst plans whole: shapes, checksums, keys, intervals and scores, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checksums import luhn_valid_column, verhoeff_valid_column
from ..operators.candidates import BANK_CODES, UPI_HANDLES
from ..operators.redact import has_signal
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _tokens(text: Column, not_token: str) -> Column:
    return F.filter(F.split(text, not_token), lambda x: x != "")


_NOT_WORD = r"[^\p{L}\p{N}\p{M}_@]+"
_SHAPES = {
    "PAN": ("^[A-Za-z]{5}[0-9]{4}[A-Za-z]$", lambda x: F.upper(F.substring(x, 4, 1)).isin(*"PCHFATBLJG")),
    "IFSC": ("^[A-Za-z]{4}0[A-Za-z0-9]{6}$", lambda x: F.upper(F.substring(x, 1, 4)).isin(*sorted(BANK_CODES))),
    "VOTER": ("^[A-Za-z]{3}[0-9]{7}$", lambda x: F.lit(False)),
    "PASSPORT": ("^[A-Za-z][0-9]{7}$", lambda x: F.lit(False)),
}


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_NOT_WORD}'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w FROM w),
s AS (SELECT doc_id, upper(w) AS w, CASE WHEN regexp_matches(w, '{_SHAPES["PAN"][0]}') THEN 'PAN' WHEN regexp_matches(w, '{_SHAPES["IFSC"][0]}') THEN 'IFSC'
  WHEN regexp_matches(w, '{_SHAPES["VOTER"][0]}') THEN 'VOTER' WHEN regexp_matches(w, '{_SHAPES["PASSPORT"][0]}') THEN 'PASSPORT' END AS type FROM t)
SELECT doc_id, type, count(*) AS n, count(*) FILTER (WHERE (type = 'PAN' AND substr(w, 4, 1) IN ('P','C','H','F','A','T','B','L','J','G')) OR (type = 'IFSC' AND substr(w, 1, 4) IN ({", ".join(f"'{x}'" for x in sorted(BANK_CODES))}))) AS n_valid
FROM s WHERE type IS NOT NULL GROUP BY doc_id, type""")
def code_shapes(spark, sf_dir):
    """Identity codes by shape, and how many are valid by their own form."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(_tokens(F.col("text"), _NOT_WORD)).alias("w"))
    kind = valid = None
    for name, (pattern, ok) in _SHAPES.items():
        hit = F.col("w").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        valid = F.when(hit, ok(F.col("w"))) if valid is None else valid.when(hit, ok(F.col("w")))
    return w.select("doc_id", kind.alias("type"), valid.alias("v")).filter("type is not null").groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if("v").alias("n_valid"))


_LUHN = "list_sum(list_transform(range(1, length({0}) + 1), lambda i: (CASE WHEN i % 2 = 0 THEN (CASE WHEN substr(reverse({0}), i, 1)::INT > 4 THEN substr(reverse({0}), i, 1)::INT * 2 - 9 ELSE substr(reverse({0}), i, 1)::INT * 2 END) ELSE substr(reverse({0}), i, 1)::INT END))) % 10 = 0"


@query(f"SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE {_LUHN.format('o_orderkey::VARCHAR')}) AS n_valid FROM orders GROUP BY o_orderstatus")
def luhn_keys(spark, sf_dir):
    """Order keys that pass the Luhn check."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(luhn_valid_column(F.col("o_orderkey").cast("string"))).alias("n_valid"))


@query("""
WITH RECURSIVE perm(r, i, v) AS (
  SELECT 0, i, i FROM range(10) t(i)
  UNION ALL SELECT r + 1, i, ([1, 5, 7, 6, 2, 8, 3, 0, 9, 4])[v + 1] FROM perm WHERE r < 7),
p AS (SELECT list(v ORDER BY r, i) AS tab FROM perm),
d AS (SELECT list(CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN 5 + (a + b - 5) % 5 WHEN b < 5 THEN 5 + (a - 5 - b + 5) % 5 ELSE (a - b + 5) % 5 END ORDER BY a, b) AS tab FROM range(10) x(a), range(10) y(b)),
k AS (SELECT o_orderstatus, o_orderkey, reverse(o_orderkey::VARCHAR) AS s FROM orders),
st AS (SELECT o_orderstatus, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ((i - 1) % 8) * 10 + substr(s, i, 1)::INT)), lambda c, x: d.tab[c * 10 + p.tab[x + 1] + 1]) AS c FROM k, p, d)
SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE c = 0) AS n_valid FROM st GROUP BY o_orderstatus""")
def verhoeff_keys(spark, sf_dir):
    """Order keys that pass the Verhoeff check, by a native fold."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(verhoeff_valid_column(F.col("o_orderkey").cast("string"))).alias("n_valid"))


_RUN = r"[0-9]+(?:[ .\x{2d}\x{2010}-\x{2015}\x{2212}]{1,3}[0-9]+)*"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_RUN}')) AS n_runs, coalesce(list_max(list_transform(regexp_extract_all(text, '{_RUN}'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')))), 0)::BIGINT AS most_digits FROM documents")
def digit_runs(spark, sf_dir):
    """Runs of digit groups, and the digits of the longest."""
    runs = F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.coalesce(longest, F.lit(0)).cast("long").alias("most_digits"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN}')) AS run FROM documents),
c AS (SELECT doc_id, regexp_replace(run, '[^0-9]', '', 'g') AS digits FROM t),
f AS (SELECT doc_id, digits FROM c WHERE length(digits) BETWEEN 13 AND 19)
SELECT doc_id, digits AS card_key, count(*) AS n, bool_and({_LUHN.format('digits')}) AS luhn_ok, bool_and(regexp_matches(digits, '^(4|5[1-5]|3[47]|6011|64[4-9]|65|60|62|8[12]|30[0-5]|36|3[89]|35)')) AS known_prefix FROM f GROUP BY doc_id, digits""")
def card_numbers(spark, sf_dir):
    """Runs of 13 to 19 digits by value key, with the check digit and a prefix of an issuer."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias("run"))
    digits = runs.select("doc_id", F.regexp_replace("run", "[^0-9]", "").alias("card_key")).filter(F.length("card_key").between(13, 19))
    prefix = F.col("card_key").rlike("^(4|5[1-5]|3[47]|6011|64[4-9]|65|60|62|8[12]|30[0-5]|36|3[89]|35)")
    return digits.groupBy("doc_id", "card_key").agg(F.count(F.lit(1)).alias("n"), F.bool_and(luhn_valid_column(F.col("card_key"))).alias("luhn_ok"), F.bool_and(prefix).alias("known_prefix"))


_MAIL = r"[A-Za-z0-9!#$%&*+^_|~.-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"


@query(f"SELECT lower(m) AS email_key, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS m FROM documents) GROUP BY lower(m)")
def email_keys(spark, sf_dir):
    """E-mail addresses by value key."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("m"))
    return found.groupBy(F.lower("m").alias("email_key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""SELECT lower(h) AS handle, lower(h) IN ({", ".join(f"'{x}'" for x in sorted(UPI_HANDLES))}) AS known, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@([A-Za-z][A-Za-z0-9]*)', 1)) AS h FROM documents) GROUP BY 1, 2""")
def payment_handles(spark, sf_dir):
    """What follows an "@", and whether it is a known payment handle."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._-]+@([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("h"))
    return found.groupBy(F.lower("h").alias("handle")).agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("handle").isin(*sorted(UPI_HANDLES)))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9.]+')) AS r FROM documents),
a AS (SELECT doc_id, trim(r, '.') AS r FROM t),
o AS (SELECT doc_id, list_transform(string_split(r, '.'), lambda x: x::INT) AS q FROM a WHERE regexp_matches(r, '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$'))
SELECT doc_id, array_to_string(q, '.') AS address, (q[1] IN (0, 127) OR q[1] >= 224) AS nobody, count(*) AS n FROM o WHERE list_max(q) <= 255 GROUP BY 1, 2, 3""")
def ipv4_addresses(spark, sf_dir):
    """Dotted quads by canonical address, and whether a single host can own it."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9.]+"), F.lit(0))).alias("r")).select("doc_id", F.expr("trim(BOTH '.' FROM r)").alias("r"))
    octets = runs.filter(F.col("r").rlike("^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$")).select("doc_id", F.split("r", "[.]").cast("array<int>").alias("q")).filter(F.array_max("q") <= 255)
    return octets.groupBy("doc_id", F.array_join(F.col("q").cast("array<string>"), ".").alias("address"), (F.col("q")[0].isin(0, 127) | (F.col("q")[0] >= 224)).alias("nobody")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS d FROM documents UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders)
SELECT (d[1:4])::INT AS year, count(*) AS n, count(*) FILTER (WHERE try_cast(d AS DATE) IS NOT NULL AND (d[1:4])::INT BETWEEN 1900 AND 2099) AS n_real FROM t GROUP BY 1""")
def calendar_dates(spark, sf_dir):
    """Dates as written, and how many are days of the calendar."""
    written = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0))).alias("d"))
    written = written.union(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd")))
    year = F.substring("d", 1, 4).cast("int")
    real = F.expr("try_to_date(d, 'yyyy-MM-dd')").isNotNull() & year.between(1900, 2099)
    return written.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(real).alias("n_real"))


_SIGNAL_SQL = "[^\\x00-\\x7F]|[0-9@:]|(?i:pass|pwd|secret|token|bearer|api.?key|access.?key|private.?key|otp|pin|cvv|cvc|sk-|gh[pousr]_|github_pat|glpat-|akia|asia|[sr]k_|whsec_|rzp_|xox|xapp-|aiza|npm_|hf_|eyj|-----begin)"


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{_SIGNAL_SQL}')) AS n_signal FROM documents GROUP BY lang")
def prefilter(spark, sf_dir):
    """Texts that the native prefilter lets through to detection."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(has_signal(F.col("text"))).alias("n_signal"))


@query("""
WITH m AS (SELECT conv_id, turn, lower(split_part(text, ' ', 1)) AS key FROM conversations),
f AS (SELECT conv_id, key, min(turn) AS turn FROM m GROUP BY 1, 2)
SELECT conv_id, key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, key) AS idx FROM f""")
def value_numbering(spark, sf_dir):
    """Numbers by first appearance in a conversation; the values are the messages' first words."""
    first = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("turn"))
    return first.select("conv_id", "key", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "key")).cast("long").alias("idx"))


@query("""
WITH s AS (SELECT user_id, event_id AS a, event_id + 1 + floor(abs(value))::BIGINT AS b FROM events),
g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def span_union(spark, sf_dir):
    """Union of overlapping or touching spans."""
    own = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 1 + F.floor(F.abs("value"))).cast("long").alias("b"))
    order = Window.partitionBy("user_id").orderBy("a", "b")
    fresh = F.when(F.col("a") <= F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("fresh", fresh).withColumn("island", island).groupBy("user_id", "island").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


@query("""
WITH t AS (SELECT event_id, user_id, event_type, event_id AS a, event_id + 20 AS b FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
d AS (SELECT user_id, event_type, event_id AS a, event_id + 10 AS b FROM events WHERE event_type <> (SELECT min(event_type) FROM events)),
c AS (SELECT t.event_id, bool_or(d.a <= t.a AND t.b <= d.b + 10) AS covered, bool_or(d.a IS NOT NULL) AS touched FROM t LEFT JOIN d ON t.user_id = d.user_id AND d.a < t.b AND t.a < d.b GROUP BY t.event_id)
SELECT count(*) AS spans, count(*) FILTER (WHERE covered) AS redacted, count(*) FILTER (WHERE touched AND NOT covered) AS partial, count(*) FILTER (WHERE NOT touched) AS missed FROM c""")
def overlap_score(spark, sf_dir):
    """Truth against detections of the same key: covered, partly covered, missed (equi-join with an interval condition)."""
    e = table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    marked = e.join(F.broadcast(kind))  # one row
    t = marked.filter("event_type = k").select("event_id", "user_id", F.col("event_id").alias("a"), (F.col("event_id") + 20).alias("b"))
    d = marked.filter("event_type <> k").select(F.col("user_id").alias("u"), F.col("event_id").alias("x"), (F.col("event_id") + 10).alias("y"))
    c = t.join(d, (t["user_id"] == d["u"]) & (F.col("x") < F.col("b")) & (F.col("a") < F.col("y")), "left").groupBy("event_id")
    c = c.agg(F.bool_or((F.col("x") <= F.col("a")) & (F.col("b") <= F.col("y") + 10)).alias("covered"), F.bool_or(F.col("x").isNotNull()).alias("touched"))
    return c.agg(F.count(F.lit(1)).alias("spans"), F.count_if("covered").alias("redacted"), F.count_if(F.col("touched") & ~F.col("covered")).alias("partial"), F.count_if(~F.col("touched")).alias("missed"))


@query("""
WITH s AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P' GROUP BY 1),
f AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(s.k, f.k) AS key, coalesce(s.n, 0) AS stored, coalesce(f.n, 0) AS fresh, CASE WHEN s.k IS NULL THEN 'new' WHEN f.k IS NULL THEN 'gone' WHEN f.n < s.n THEN 'worse' WHEN f.n > s.n THEN 'better' ELSE 'same' END AS verdict
FROM s FULL OUTER JOIN f ON s.k = f.k""")
def baseline_gate(spark, sf_dir):
    """Stored against fresh counts by key."""
    o = table(spark, sf_dir, "orders")
    s = o.filter("o_orderkey % 2 = 0 AND o_orderstatus <> 'P'").groupBy(F.col("o_orderstatus").alias("key")).agg(F.count(F.lit(1)).alias("stored"))
    f = o.filter("o_orderkey % 2 = 1").groupBy(F.col("o_orderstatus").alias("key")).agg(F.count(F.lit(1)).alias("fresh"))
    verdict = F.when(F.col("stored").isNull(), "new").when(F.col("fresh").isNull(), "gone").when(F.col("fresh") < F.col("stored"), "worse").when(F.col("fresh") > F.col("stored"), "better").otherwise("same")
    return s.join(f, "key", "full").select("key", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("fresh", F.lit(0)).alias("fresh"), verdict.alias("verdict"))


@query("""
SELECT lang, count(*) AS truth, sum(toxic)::BIGINT AS right_type, CASE WHEN count(*) = 0 THEN '-' ELSE (sum(toxic) * 1000 // count(*) // 10)::VARCHAR || '.' || (sum(toxic) * 1000 // count(*) % 10)::VARCHAR END AS recall,
       sum(toxic) / nullif(sum(quality), 0)::DOUBLE AS precision
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def truncated_percent(spark, sf_dir):
    """Shares cut to one decimal, never rounded up; undefined for nothing of nothing."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("truth"), F.sum("toxic").alias("right_type"), F.sum("quality").alias("q"))
    per = F.floor(F.col("right_type") * 1000 / F.col("truth"))
    text = F.concat(F.floor(per / 10).cast("string"), F.lit("."), (per % 10).cast("string"))
    return own.select("lang", "truth", "right_type", F.when(F.col("truth") == 0, "-").otherwise(text).alias("recall"), F.try_divide("right_type", "q").alias("precision"))


@query("""
WITH v AS (SELECT user_id, event_type, sum(event_id % 7) AS required, sum(CASE WHEN value > 0 THEN event_id % 7 ELSE 0 END) AS covered, bool_and(value > 0) AS typed FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS "values", count(*) FILTER (WHERE covered = required) AS redacted, count(*) FILTER (WHERE covered > 0 AND covered < required) AS partial, count(*) FILTER (WHERE typed) AS typed FROM v GROUP BY 1""")
def two_level_score(spark, sf_dir):
    """Pieces to values, values to types."""
    hit = F.col("value") > 0
    v = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.col("event_id") % 7).alias("required"), F.sum(F.when(hit, F.col("event_id") % 7).otherwise(0)).alias("covered"), F.bool_and(hit).alias("typed"))
    return v.groupBy("event_type").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.col("covered") == F.col("required")).alias("redacted"), F.count_if((F.col("covered") > 0) & (F.col("covered") < F.col("required"))).alias("partial"), F.count_if("typed").alias("typed"))


@query("SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_digest(spark, sf_dir):
    """SHA-256 of a conversation's messages in order."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return own.select("conv_id", F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"), 256).alias("digest"), F.size("m").cast("long").alias("turns"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '[A-Za-z][A-Za-z0-9+.-]*://[^\s<>()"'']+')) AS urls, len(regexp_extract_all(html, '=\s*"[^"]*"')) AS attributes, len(regexp_extract_all(html, '\]\([^\s]*')) AS destinations FROM pages""")
def unsafe_places(spark, sf_dir):
    """Places of a page where a restored value could leak, by kind."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s<>()"']+""").alias("urls"), n(r'=\s*"[^"]*"').alias("attributes"), n(r"\]\([^\s]*").alias("destinations"))


@query(r"""
WITH t AS (SELECT conv_id, turn, '[PAN_' || turn || '] and Email_' || (turn + 1) || ' or [card ' || (conv_id % 5) || ']' AS text FROM conversations),
m AS (SELECT conv_id, unnest(regexp_extract_all(text, '(?i)\[(?:PAN|CARD|EMAIL)[_ ][1-9][0-9]{0,3}\]')) AS p FROM t)
SELECT upper(replace(p, ' ', '_')) AS placeholder, count(*) AS n, count(DISTINCT conv_id) AS convs FROM m GROUP BY 1""")
def placeholder_mentions(spark, sf_dir):
    """Bracketed placeholders in any case, by canonical form."""
    text = F.concat(F.lit("[PAN_"), "turn", F.lit("] and Email_"), F.col("turn") + 1, F.lit(" or [card "), F.col("conv_id") % 5, F.lit("]"))
    found = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(text, F.lit(r"(?i)\[(?:PAN|CARD|EMAIL)[_ ][1-9][0-9]{0,3}\]"), F.lit(0))).alias("p"))
    return found.groupBy(F.upper(F.translate("p", " ", "_")).alias("placeholder")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("convs"))


@query("SELECT user_id, max_by(value, ts) AS last_value, count(*) FILTER (WHERE value < prev) AS decreases FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id")
def usage_checks(spark, sf_dir):
    """The last count of a stream, and how often counts went down."""
    prev = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("prev", prev).groupBy("user_id").agg(F.max_by("value", "ts").alias("last_value"), F.count_if(F.col("value") < F.col("prev")).alias("decreases"))


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{M}]+'), lambda x: regexp_matches(x, '^\\p{Lu}')))) AS word FROM documents)
SELECT word, count(*) AS docs FROM w GROUP BY word HAVING count(*) >= 3""")
def capitalised_words(spark, sf_dir):
    """Capitalised words by the number of documents: candidates of a list of names."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{M}]+"), lambda x: x.rlike(r"^\p{Lu}")))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).filter("docs >= 3")


@query("""
SELECT role, count(*) AS messages, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) FILTER (WHERE octet_length(encode(text)) > 262144) AS too_large, count(*) FILTER (WHERE role NOT IN ('system', 'user', 'assistant')) AS refused FROM conversations GROUP BY role""")
def request_limits(spark, sf_dir):
    """Messages by role, their bytes, and those that a request could not hold."""
    size = F.octet_length("text")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(size).alias("bytes"), F.count_if(size > 262144).alias("too_large"), F.count_if(~F.col("role").isin("system", "user", "assistant")).alias("refused"))
