"""Quality rules with verdicts on hosts. DataFrame functions only.

Every document gets counts and rule failures of its own. Failures are summed by host (before the exchange, then after it). For each rule the
hosts' rates are taken as draws from a beta distribution, whose mean and strength are those of the greatest beta-binomial likelihood over
all hosts, on a grid. A host's rate is shrunk by that prior, and the host is rejected if the posterior says with a probability of about 0.98
(two standard deviations of the posterior beta) that the rate is above the limit of any rule: max_times the prior's mean, least_rate at least, and
half way from the mean to 1 at most. So a host is judged against its like, and one with few documents is not judged by
them alone. The verdict is joined back to the host's documents.

Defined cases: null and blank texts have no words (and so fail); a null host is a host like any other; rows that repeat are each judged;
where hosts differ no more than chance lets them, or there is one host alone, all shrink to the corpus rate and none is rejected; very long
texts are counted whole; an empty table gives no rows; other columns, whatever their names, are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import WHITE, by_place, materialise, only, words_column

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
#: The rules, as conditions on the counts of a document.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repetition": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}
#: The grid of priors: strengths (in documents), and odds of the mean as multiples of the corpus's odds.
STRENGTHS = [2.0**k for k in range(21)]
ODDS = [2.0 ** (k / 2) for k in range(-16, 5)]
#: Standard deviations of the posterior that a host's rate must be above the limit.
DEVIATIONS = 2.0


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of that many words that occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                y = F.get(s, k)
                return F.coalesce((x["h"] == y["h"]) & (F.slice(words, x["i"] + 1, window) == F.slice(words, y["i"] + 1, window)), F.lit(False))

            flags = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.sort_array(F.filter(flags, lambda i: i.isNotNull()))

        def length(p: Column) -> Column:
            following = F.transform(p, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - i, F.lit(window))))
            return F.aggregate(following, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(placed, lambda s: _let(repeated(s), length))

    n = F.size(words)
    of_words = F.transform(words, lambda w: F.xxhash64(w))
    hashes = _let(of_words, lambda hs: F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(hs, i, window))))
    counted = _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0).cast("long")))
    return F.when(n >= window, counted).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> dict[str, Column]:
    """Columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text column."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    return {
        "word_chars": F.length(F.translate(whole, WHITE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "line_counts": _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "word_counts": _let(words_column(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def judged(documents: DataFrame, host: str = "source") -> DataFrame:
    """A row for each document: given (struct of its columns by place), host, the counts, and failures (array of 0 and 1, in the order of RULES)."""
    plain, at = by_place(documents)
    rows = plain.select(F.struct(*plain.columns).alias("given"), F.col(at[host]).alias("host"), *(c.alias(n) for n, c in counts(F.col(at["text"])).items()))
    rows = rows.select("given", "host", "word_chars", "n_symbols", "line_counts.*", "word_counts.*")
    return rows.withColumn("failures", F.array(*(F.expr(r).cast("int") for r in RULES.values())))


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n, and for each rule f0, f1, ...: its failures."""
    return rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col("failures")[i]).alias(f"f{i}") for i in range(len(RULES))))


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, and back down; good to 1e-13 of the value for x > 0."""
    y = x + 8
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(steps)


def beta_priors(hosts: DataFrame) -> list[tuple[float, float]]:
    """(mean, strength) of each rule's prior. One row for each rule comes to the driver.

    Hosts that agree in documents and failures are one row with a count before the grid is laid over them. Of equal likelihoods the
    greatest strength counts, then the least mean. Where no document fails, or all do, the mean is that and the strength the grid's greatest.
    """
    each = hosts.select(F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col("n").cast("double").alias("n"), F.col(f"f{i}").cast("double").alias("f")) for i in range(len(RULES))))).alias("x")).select("x.*")
    each = materialise(each.groupBy("k", "n", "f").agg(F.count("*").alias("hosts")), "host-counts")
    rates = {r["k"]: r["m"] for r in each.groupBy("k").agg((F.sum(F.col("f") * F.col("hosts")) / F.sum(F.col("n") * F.col("hosts"))).alias("m")).collect()}
    out = {k: (m, STRENGTHS[-1]) for k, m in rates.items()}
    open_rates = [F.struct(F.lit(k).alias("of"), F.lit(m).alias("rate")) for k, m in sorted(rates.items()) if 0 < m < 1]
    if open_rates:
        cells = each.select("*", F.explode(F.filter(F.array(*open_rates), lambda x: x["of"] == F.col("k"))).alias("x")).select("*", F.col("x")["rate"].alias("p"))
        cells = cells.select("*", F.explode(F.array(*map(F.lit, ODDS))).alias("o")).select("*", F.explode(F.array(*map(F.lit, STRENGTHS))).alias("s"))
        cells = cells.select("k", "n", "f", "hosts", (F.col("p") * F.col("o") / (1 - F.col("p") + F.col("p") * F.col("o"))).alias("m"), "s")
        a, b, n, f, s = F.col("m") * F.col("s"), (1 - F.col("m")) * F.col("s"), F.col("n"), F.col("f"), F.col("s")
        signed = F.transform(F.array(a + f, b + n - f, s, s + n, a, b), lambda x, i: F.when(i < 3, 1.0).otherwise(-1.0) * _log_gamma(x))
        cells = cells.select("k", "m", "s", (F.aggregate(signed, F.lit(0.0), lambda t, x: t + x) * F.col("hosts")).alias("like"))
        fits = cells.groupBy("k", "m", "s").agg(F.round(F.sum("like"), 4).alias("fit"))
        best = fits.groupBy("k").agg(F.max(F.struct("fit", "s", (-F.col("m")).alias("low"))).alias("b"))
        out |= {r["k"]: (-r["b"]["low"], r["b"]["s"]) for r in best.collect()}
    return [out.get(k, (0.5, 1.0)) for k in range(len(RULES))]


def limits(priors: list[tuple[float, float]], max_times: float, least_rate: float) -> list[float]:
    """The rate of each rule that a host must not surely exceed."""
    return [min(max(max_times * m, least_rate), (1 + m) / 2) for m, _ in priors]


def host_verdicts(hosts: DataFrame, max_times: float = 3.0, least_rate: float = 0.2) -> DataFrame:
    """of_host, its shrunk rates (host_rate_<rule>), host_ok: false for a host that is rejected. hosts, a row for each, is read several times."""
    priors = beta_priors(hosts)
    rates = [(F.col(f"f{i}") + F.lit(m * s)) / (F.col("n") + F.lit(s)) for i, (m, s) in enumerate(priors)]
    errors = [F.sqrt(r * (1 - r) / (F.col("n") + F.lit(s) + 1)) for r, (_, s) in zip(rates, priors)]
    over = [r - DEVIATIONS * e > F.lit(x) for r, e, x in zip(rates, errors, limits(priors, max_times, least_rate))]
    shown = [F.round(r, 6).alias(f"host_rate_{name}") for r, name in zip(rates, RULES)]
    return hosts.select(F.col("host").alias("of_host"), *shown, (~F.greatest(*over)).alias("host_ok"))


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    return rows.join(verdicts, rows["host"].eqNullSafe(verdicts["of_host"])).drop("of_host")


BASE_FAILED = f"({RULES['few_words']}) or ({RULES['repetition']})"


def quality_report(documents: DataFrame, host: str = "source", max_times: float = 3.0, least_rate: float = 0.2) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the shrunk rates of its host, of each document (doc_id, text, host)."""
    rows = materialise(judged(only(documents, *dict.fromkeys(["doc_id", "text", host])), host).withColumn("given", F.struct("given.c0")), "quality")
    hosts = materialise(host_rates(rows), "hosts")
    out = with_verdicts(rows, host_verdicts(hosts, max_times, least_rate)).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.select(F.col("given.c0").alias("doc_id"), *COUNTS, "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), *(f"host_rate_{r}" for r in RULES))


def quality_filter(documents: DataFrame, host: str = "source", max_times: float = 3.0, least_rate: float = 0.2) -> DataFrame:
    """The documents, with all their columns, that quality_report would keep.

    The texts are read twice, for the hosts' rates and for the documents' own rules, rather than stored in between.
    """
    hosts = materialise(host_rates(judged(only(documents, *dict.fromkeys(["text", host])), host)), "hosts")
    kept = judged(documents, host).where(~F.expr(BASE_FAILED))
    return with_verdicts(kept, host_verdicts(hosts, max_times, least_rate)).where("host_ok").select("given.*").toDF(*documents.columns)


REPORT_SQL = r"""
with texts as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
split as (select r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts),
lines as (select r, unnest(string_split(t, chr(10))) as x from texts),
line_counts as (select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup from lines where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
starts as (select r, w, unnest(range(1, len(w) - 6)) as i from split where len(w) >= 8),
windows as (select r, i, count(*) over (partition by r, array_to_string(list_slice(w, i, i + 7), ' ')) as c from starts),
covered as (select r, count(distinct i + k) as n from windows, range(8) as s(k) where c > 1 group by r),
counts as (select r, doc_id, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines from split left join covered using (r) left join line_counts using (r)),
rules as (select *, unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > 3 * n_words, 10 * n_dup_lines > 3 * n_lines,
    n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)]) as failed, unnest(range(5)) as k from counts),
hosts as (select source, k, count(*)::double as n, sum(failed::int)::double as f from rules group by source, k),
corpus as (select k, sum(f) / sum(n) as p from hosts group by k),
grid as (select k, p * o / (1 - p + p * o) as m, pow(2, e)::double as s from corpus, (select pow(2, unnest(range(-16, 5)) / 2.0) as o), (select unnest(range(21)) as e) where p > 0 and p < 1),
fits as (select k, m, s, round(sum(lgamma(m * s + f) + lgamma((1 - m) * s + n - f) - lgamma(s + n) + lgamma(s) - lgamma(m * s) - lgamma((1 - m) * s)), 4) as fit
    from grid join hosts using (k) group by k, m, s),
best as (select k, m, s from fits qualify row_number() over (partition by k order by fit desc, s desc, m) = 1),
priors as (select k, m, s from best union all select k, p, 1048576.0 from corpus where p = 0 or p = 1),
rates as (select source, k, (f + m * s) / (n + s) as r, n + s + 1 as w, least(greatest(3 * m, 0.2), (1 + m) / 2) as most from hosts join priors using (k)),
verdicts as (select source, bool_and(r - 2 * sqrt(r * (1 - r) / w) <= most) as ok, max(round(r, 6)) filter (k = 0) as r0, max(round(r, 6)) filter (k = 1) as r1,
    max(round(r, 6)) filter (k = 2) as r2, max(round(r, 6)) filter (k = 3) as r3, max(round(r, 6)) filter (k = 4) as r4 from rates group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and ok as kept, r0 as host_rate_few_words, r1 as host_rate_repetition, r2 as host_rate_symbols,
    r3 as host_rate_lines, r4 as host_rate_word_length
from counts join verdicts on counts.source is not distinct from verdicts.source
"""
