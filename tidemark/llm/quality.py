"""Quality rules, per document and per host, in DataFrame expressions alone.

Each document is measured once. Rule failures are summed by host (the sums are pre-aggregated before
they are shuffled, so a hot host costs one row a task); each rule's failure rate in a host is shrunk
towards the corpus by a beta prior fitted to all hosts by moments; and the hosts' verdicts are joined
back. A host whose shrunk rate of a base rule is above ``reject`` loses all its documents. One whose shrunk rates are
at most ``lenient`` times the corpus's, for every further rule that any document fails, has earned leniency: of its documents only the
base rules are asked. Any other host is strict: its documents must pass every rule. As rates are shrunk, a
host with few documents, or hosts that differ no more than chance has it, earn nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Carried, pick, words, written

SYMBOLS = "#*$%&|<>"
BASE_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
FURTHER_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines",  # one of three lines again says little
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
RULES = {rule: f"({test})" for rule, test in (BASE_RULES | FURTHER_RULES).items()}
#: Hosts up to so many rows are broadcast for the join; beyond, the join is shuffled and salted.
BROADCAST_HOSTS, SALTS = 100_000, 32


def let(value: Column, body) -> Column:
    """The body over a value that is computed once for a row, though the body may use it for each of many elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column) -> Column:
    """How many words of the array lie in a 3-word window that occurs twice or more.

    Windows are compared by 64-bit hashes. Only where two are equal are they sorted with their
    positions; covered words are then the sum of min(3, distance to the next such window)."""

    def positions(a: Column) -> Column:  # a: structs (hash, position), sorted
        same = lambda k: (((k > 0) & (F.get(a, k - 1)["h"] == F.get(a, k)["h"])) | ((k < F.size(a) - 1) & (F.get(a, k + 1)["h"] == F.get(a, k)["h"])))
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(a) - 1), same), lambda k: F.get(a, k)["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def count(h: Column) -> Column:
        sort = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(sort, positions), covered))

    def hashed(a: Column) -> Column:
        three = F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))
        return F.when(F.size(a) < 4, F.lit(0).cast("long")).otherwise(let(three, count))

    return let(w, hashed)


def measured(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """The table with the measures of each text added: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    A null or empty text measures zero throughout."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.lit(" \t\n\x0b\x0c\r")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, blank) != F.lit(""))
    two = F.struct(F.size("_w").cast("long").alias("n"), repeat_words(F.col("_w")).alias("r"))
    p = prefix
    df = df.withColumn("_w", words(F.col(text))).withColumn("_s", two).withColumn("_l", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))))
    df = df.withColumn(f"{p}n_words", F.col("_s.n")).withColumn(f"{p}n_repeat_words", F.col("_s.r")).withColumn(f"{p}n_lines", F.col("_l.n")).withColumn(f"{p}n_dup_lines", F.col("_l.d"))
    df = df.withColumn(f"{p}word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
    return df.withColumn(f"{p}n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")).drop("_w", "_s", "_l")


def verdicts(judged: DataFrame, host: str, rules: list[str], reject: float, lenient: float, base: list[str]) -> DataFrame:
    """Per host (column ``host``): ``verdict`` 'reject' or 'lenient'; strict hosts are left out.

    ``judged`` has a boolean column per rule. Null hosts are no hosts. With k failures of n
    documents, a rate is (k + m s) / (n + s): m the corpus's rate, and s the strength of a beta prior
    whose variance is that between hosts, kept within 1 and 10,000. Ties with a limit count as at most it."""
    sums = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    sums = written(sums, "hosts")
    total = sums.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in rules]).first()
    if not total["hosts"]:
        return sums.select("host", F.lit("").alias("verdict")).where("false")
    m = {r: total[r] / total["n"] for r in rules}
    spread = sums.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(m[r]), F.lit(2.0))).alias(r) for r in rules]).first()
    rates = {}
    for r in rules:
        noise = m[r] * (1 - m[r])
        between = spread[r] / total["n"] - noise * total["hosts"] / total["n"]
        s = min(10_000.0, max(1.0, noise / between - 1)) if between > 1e-12 else 10_000.0
        rates[r] = (F.col(r) + F.lit(m[r] * s)) / (F.col("n") + F.lit(s))
    bad = F.greatest(*[rates[r] for r in base], F.lit(0.0)) > F.lit(reject)
    ratios = [rates[r] / F.lit(m[r]) for r in rules if r not in base and m[r] > 0]
    good = F.greatest(*ratios, F.lit(0.0)) <= F.lit(lenient) if ratios else F.lit(True)
    verdict = F.when(bad, "reject").when(good, "lenient")
    return sums.select("host", verdict.alias("verdict")).where("verdict is not null")


def with_verdict(judged: DataFrame, host: str, found: DataFrame) -> DataFrame:
    """The table with a column ``_verdict``; null where the host has none. Few hosts are broadcast, after a count; many meet the rows by host and salt."""
    found = written(found, "verdicts")
    if found.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        return judged.join(F.broadcast(found.select(F.col("host").alias("_h"), F.col("verdict").alias("_verdict"))), F.col(host) == F.col("_h"), "left").drop("_h")
    salted = found.select(F.col("host").alias("_h"), F.col("verdict").alias("_verdict"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = judged.withColumn("_s", F.pmod(F.xxhash64(*[c for c, k in judged.dtypes if k in ("bigint", "int", "string")]), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col(host) == F.col("_h")) & (F.col("_s") == F.col("_salt")), "left").drop("_h", "_s", "_salt")


def _kept() -> Column:
    fine, passes = (~F.expr(" OR ".join(some)) for some in (BASE_RULES, RULES))
    return F.when(F.col("_verdict") == "reject", F.lit(False)).when(F.col("_verdict") == "lenient", fine).otherwise(passes)


def judge(docs: DataFrame, doc_id: str, text: str, host: str, reject: float = 0.9, lenient: float = 0.5) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, kept, and host_verdict ('strict' where the host has no other).

    Null and empty texts measure zero and fail the base rules. Rows with a null host are judged strictly. Repeated rows
    are judged each. An empty table gives an empty one."""
    rows = pick(docs, doc_id, text, host).toDF("doc_id", "text", "host")
    rows = measured(rows, "text").drop("text")
    for rule, test in RULES.items():
        rows = rows.withColumn(rule, F.expr(test))
    rows = written(rows, "quality")
    rows = with_verdict(rows, "host", verdicts(rows, "host", list(RULES), reject, lenient, list(BASE_RULES)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(" OR ".join(BASE_RULES)).alias("base_failed"), _kept().alias("kept"), F.coalesce("_verdict", F.lit("strict")).alias("host_verdict"))


def keep_good(docs: DataFrame, text: str, host: str, reject: float = 0.9, lenient: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, all their columns with them.

    Null and empty texts go, as they fail the base rules. Rows with a null host are judged strictly; a rate at a limit is within it. Of
    repeated rows all are kept or none. An empty table gives an empty one."""
    table = Carried(docs)
    rows = measured(table.frame, table.at(text), "_m_")
    for rule, test in RULES.items():
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"):
            test = test.replace(name, f"_m_{name}")
        rows = rows.withColumn(rule, F.expr(test))
    rows = written(rows.select(*table.frame.columns, *RULES), "quality")
    rows = with_verdict(rows, table.at(host), verdicts(rows, table.at(host), list(RULES), reject, lenient, list(BASE_RULES)))
    return table.back(rows.where(_kept()))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m1 AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS ls FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
rep AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_BLANK}, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM m1 LEFT JOIN rep USING (rid)),
j AS (SELECT *, {", ".join(f"({test}) AS {rule}" for rule, test in RULES.items())} FROM m),
h AS (SELECT source AS host, rule, count(*) AS n, sum(CAST(f AS BIGINT)) AS k
      FROM (SELECT source, unnest([{", ".join(f"'{r}'" for r in RULES)}]) AS rule, unnest([{", ".join(RULES)}]) AS f FROM j WHERE source IS NOT NULL) GROUP BY ALL),
tot AS (SELECT rule, count(*) AS hosts, sum(n) AS n, sum(k) / sum(n) AS m FROM h GROUP BY rule),
v AS (SELECT rule, any_value(tot.m) AS m, any_value(tot.m) * (1 - any_value(tot.m)) AS noise,
      sum(h.n * pow(h.k / h.n - tot.m, 2)) / any_value(tot.n) - any_value(tot.m) * (1 - any_value(tot.m)) * any_value(tot.hosts) / any_value(tot.n) AS between_hosts
      FROM h JOIN tot USING (rule) GROUP BY rule),
s AS (SELECT rule, m, CASE WHEN between_hosts > 1e-12 THEN least(10000.0, greatest(1.0, noise / between_hosts - 1)) ELSE 10000.0 END AS s FROM v),
rate AS (SELECT host, rule, m, (k + m * s) / (n + s) AS rate FROM h JOIN s USING (rule)),
ver AS (SELECT host, CASE WHEN max(CASE WHEN base THEN rate ELSE 0 END) > 0.9 THEN 'reject'
        WHEN max(CASE WHEN NOT base AND m > 0 THEN rate / m ELSE 0 END) <= 0.5 THEN 'lenient' ELSE 'strict' END AS verdict
        FROM (SELECT *, rule IN ({", ".join(f"'{r}'" for r in BASE_RULES)}) AS base FROM rate) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" OR ".join(BASE_RULES)}) AS base_failed,
       CASE coalesce(verdict, 'strict') WHEN 'reject' THEN false WHEN 'lenient' THEN NOT ({" OR ".join(BASE_RULES)}) ELSE NOT ({" OR ".join(RULES)}) END AS kept,
       coalesce(verdict, 'strict') AS host_verdict
FROM j LEFT JOIN ver ON j.source = ver.host
"""
