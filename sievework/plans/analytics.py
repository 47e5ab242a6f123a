"""Queries of the reference's operator families over the test tables, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import graph, merge, quality, robustness, scoring, series, store, style
from sievework.sources.registry import union_of
from sievework.session import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---- store ------------------------------------------------------------------------------------------------------


@query("SELECT url, max(id) AS id, max(batch_no) AS batch_no, count(*) AS versions FROM jobs GROUP BY url")
def store_upsert(spark, root):
    jobs = table(spark, root, "jobs", "url", "id", "batch_no")
    return store.upserted(jobs.where("batch_no = 0"), jobs.where("batch_no > 0"), ["url"], F.struct("batch_no", "id"))


@query("SELECT source, count(*) AS n FROM jobs j WHERE batch_no = 12 AND (coalesce(trim(url), '') = '' OR url NOT IN (SELECT url FROM jobs WHERE batch_no < 12 AND url IS NOT NULL)) GROUP BY source")
def store_unseen(spark, root):
    jobs = table(spark, root, "jobs", "url", "source", "batch_no")
    return store.unseen(jobs.where("batch_no = 12"), jobs.where("batch_no < 12"), "url").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT id, scam_score, confidence FROM jobs WHERE scam_score > 0.5 AND confidence < 0.4 AND NOT isnan(confidence) ORDER BY scam_score DESC, id LIMIT 100")
def store_review_queue(spark, root):
    jobs = table(spark, root, "jobs", "id", "scam_score", "confidence").where("scam_score > 0.5 and confidence < 0.4 and not isnan(confidence)")
    return store.top(jobs, 100, F.desc("scam_score"), F.col("id"))


@query(r"SELECT id FROM jobs WHERE regexp_matches(lower(coalesce(title, '')), '(^|[^a-z0-9])purchase[^a-z0-9]+orders([^a-z0-9]|$)') OR regexp_matches(lower(coalesce(description, '')), '(^|[^a-z0-9])purchase[^a-z0-9]+orders([^a-z0-9]|$)')")
def store_phrase_search(spark, root):
    return store.phrase_search(table(spark, root, "jobs", "id", "title", "description"), "Purchase Orders", ["title", "description"]).select("id")


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'wound')) AS a, len(list_filter(w, lambda x: x = 'ledger')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(l) AS m, count_if(a > 0) AS da, count_if(b > 0) AS db FROM f)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score
FROM f, s WHERE a + b > 0""")
def store_ranked_search(spark, root):
    return store.bm25(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text", ["wound", "ledger"]).select("doc_id", r6("score").alias("score"))


@query("SELECT id, risk_level, (SELECT count(*) FROM jobs WHERE source = 'boardwell') AS total FROM jobs WHERE source = 'boardwell' ORDER BY id DESC LIMIT 25 OFFSET 50")
def store_page(spark, root):
    return store.page(table(spark, root, "jobs", "id", "source", "risk_level").where("source = 'boardwell'"), 3, 25, F.desc("id")).select("id", "risk_level", "total")


@query("SELECT id FROM jobs WHERE source = 'workmesh' AND is_remote = 1 AND scam_score <= 0.6 AND (contains(lower(title), 'data') OR contains(lower(company), 'data') OR contains(lower(description), 'data'))")
def store_search(spark, root):
    jobs = table(spark, root, "jobs", "id", "source", "is_remote", "scam_score", "title", "company", "description")
    return store.search(jobs, text="data", remote=True, source="workmesh", most_score=0.6).select("id")


@query(r"""
WITH r AS (SELECT sha256(lower(trim(regexp_replace(description, '\s+', ' ', 'g')))) AS digest, lower(coalesce(company, '')) AS owner, id FROM jobs WHERE trim(coalesce(description, '')) <> '')
SELECT digest, count(DISTINCT owner) AS owners, count(*) AS rows, min(id) AS first FROM r GROUP BY digest HAVING count(DISTINCT owner) > 1""")
def store_copied_elsewhere(spark, root):
    return store.copied_elsewhere(table(spark, root, "jobs", "id", "description", "company"), "id", "description", "company")


@query("SELECT source, id, rank FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY scam_score DESC, id) AS rank FROM jobs) WHERE rank <= 3")
def store_worst_per_source(spark, root):
    return store.latest_per(table(spark, root, "jobs", "id", "source", "scam_score"), ["source"], 3, F.desc("scam_score"), F.col("id")).select("source", "id", "rank")


@query("""SELECT count(*) AS jobs, count_if(scam_score >= 0.6) AS scams, count_if(user_reported = 1) AS reported, count(DISTINCT source) AS sources, round(avg(scam_score), 6) AS mean_score,
count_if(is_remote = 1) AS remote, count_if(confidence IS NULL OR isnan(confidence)) AS unknown FROM jobs""")
def store_stats(spark, root):
    jobs = table(spark, root, "jobs", "scam_score", "user_reported", "source", "is_remote", "confidence")
    return jobs.agg(
        F.count("*").alias("jobs"), F.count_if(F.col("scam_score") >= 0.6).alias("scams"), F.count_if(F.col("user_reported") == 1).alias("reported"), F.countDistinct("source").alias("sources"), r6(F.avg("scam_score")).alias("mean_score"),
        F.count_if(F.col("is_remote") == 1).alias("remote"), F.count_if(F.col("confidence").isNull() | F.isnan("confidence")).alias("unknown"),
    )


@query("SELECT source, risk_level, count(*) AS n, round(avg(scam_score), 6) AS mean_score FROM jobs GROUP BY source, risk_level")
def store_by_source_and_risk(spark, root):
    return table(spark, root, "jobs", "source", "risk_level", "scam_score").groupBy("source", "risk_level").agg(F.count("*").alias("n"), r6(F.avg("scam_score")).alias("mean_score"))


@query("SELECT source, round(count_if(scam_score >= 0.6) / count(*), 6) AS yield, count(*) AS jobs FROM jobs GROUP BY source ORDER BY yield DESC, source LIMIT 5")
def store_best_sources(spark, root):
    by = table(spark, root, "jobs", "source", "scam_score").groupBy("source").agg(r6(F.count_if(F.col("scam_score") >= 0.6) / F.count("*")).alias("yield"), F.count("*").alias("jobs"))
    return store.top(by, 5, F.desc("yield"), F.col("source"))


@query("""SELECT j.risk_level, count(*) AS pairs, count(r.report_id) AS reports, round(avg(r.our_prediction), 6) AS mean_prediction
FROM jobs j LEFT JOIN user_reports r ON j.url = r.url GROUP BY j.risk_level""")
def join_jobs_reports(spark, root):
    jobs, reports = table(spark, root, "jobs", "url", "risk_level"), table(spark, root, "user_reports", "url", "report_id", "our_prediction")
    return jobs.join(reports, "url", "left").groupBy("risk_level").agg(F.count("*").alias("pairs"), F.count("report_id").alias("reports"), r6(F.avg("our_prediction")).alias("mean_prediction"))


@query("SELECT source, count(*) AS n FROM jobs WHERE url NOT IN (SELECT url FROM user_reports WHERE url IS NOT NULL) GROUP BY source")
def join_never_reported(spark, root):
    return table(spark, root, "jobs", "url", "source").join(table(spark, root, "user_reports", "url").distinct(), "url", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT url FROM jobs UNION SELECT url FROM user_reports) UNION ALL SELECT 'except', count(*) FROM (SELECT url FROM user_reports EXCEPT SELECT url FROM jobs)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT url FROM user_reports INTERSECT SELECT url FROM jobs)""")
def set_urls(spark, root):
    a, b = table(spark, root, "jobs", "url"), table(spark, root, "user_reports", "url")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").unionByName(count(b.subtract(a), "except")).unionByName(count(b.intersect(a), "intersect"))


@query("""SELECT experience_level, count(*) AS n, round(quantile_cont(salary_min, 0.25), 6) AS p25, round(quantile_cont(salary_min, 0.5), 6) AS p50, round(quantile_cont(salary_min, 0.9), 6) AS p90
FROM postings WHERE salary_min > 0 AND NOT isnan(salary_min) GROUP BY experience_level""")
def agg_pay_percentiles(spark, root):
    pay = table(spark, root, "postings", "experience_level", "salary_min").where("salary_min > 0 and not isnan(salary_min)")
    return pay.groupBy("experience_level").agg(F.count("*").alias("n"), *[r6(F.percentile("salary_min", p)).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.9)])


# ---- quality ----------------------------------------------------------------------------------------------------

_CONF = "round(CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0 END, 6) AS {n}"


@query(
    "WITH m AS (SELECT processed, count_if(is_scam = 1 AND our_prediction >= 0.5) AS tp, count_if(is_scam <> 1 AND our_prediction >= 0.5) AS fp, count_if(is_scam <> 1 AND our_prediction < 0.5) AS tn, "
    "count_if(is_scam = 1 AND our_prediction < 0.5) AS fn FROM user_reports GROUP BY processed) SELECT *, "
    + ", ".join(_CONF.format(a=a, b=b, n=n) for a, b, n in (("(tp + tn)", "tp + fp + tn + fn", "accuracy"), ("tp", "tp + fp", "precision"), ("tp", "tp + fn", "recall"), ("2 * tp", "2 * tp + fp + fn", "f1")))
    + " FROM m"
)
def quality_confusion(spark, root):
    out = quality.confusion(table(spark, root, "user_reports", "processed", "is_scam", "our_prediction"), F.col("is_scam") == 1, F.col("our_prediction") >= 0.5, "processed")
    return out.select("processed", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_BINS = "SELECT least(CAST(floor(our_prediction * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(our_prediction) AS p, avg(is_scam) AS a FROM user_reports WHERE our_prediction IS NOT NULL GROUP BY 1"


@query(f"SELECT bin, n, round(p, 6) AS mean_prediction, round(a, 6) AS actual_rate FROM ({_BINS})")
def quality_calibration(spark, root):
    bins = quality.calibration(table(spark, root, "user_reports", "our_prediction", "is_scam"), "our_prediction", "is_scam")
    return bins.select("bin", "n", r6("mean_prediction").alias("mean_prediction"), r6("actual_rate").alias("actual_rate"))


@query(f"SELECT round(sum(n * abs(p - a)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM ({_BINS})")
def quality_calibration_error(spark, root):
    bins = quality.calibration(table(spark, root, "user_reports", "our_prediction", "is_scam"), "our_prediction", "is_scam")
    return quality.calibration_error(bins).select(r6("ece").alias("ece"), "n")


@query("""WITH s AS (SELECT j.source, r.report_id, sum((1 - r.was_correct) - 0.3e0 - 0.05e0) OVER (PARTITION BY j.source ORDER BY r.reported_at, r.report_id, j.id ROWS UNBOUNDED PRECEDING) AS p, r.reported_at, j.id
FROM user_reports r JOIN jobs j ON r.url = j.url),
c AS (SELECT source, p - least(0, min(p) OVER (PARTITION BY source ORDER BY reported_at, report_id, id ROWS UNBOUNDED PRECEDING)) AS c FROM s)
SELECT source, round(max(c), 6) AS peak, count_if(c > 3) AS alarms FROM c GROUP BY source""")
def quality_cusum(spark, root):
    reports, jobs = table(spark, root, "user_reports", "url", "report_id", "was_correct", "reported_at"), table(spark, root, "jobs", "url", "source", "id")
    out = quality.cusum(reports.join(jobs, "url"), "source", ["reported_at", "report_id", "id"], (1 - F.col("was_correct")).cast("double"), 0.3, 0.05)
    return out.groupBy("source").agg(r6(F.max("cusum")).alias("peak"), F.count_if(F.col("cusum") > 3).alias("alarms"))


@query("""WITH c AS (SELECT risk_level, is_remote, count(*) AS n FROM jobs GROUP BY 1, 2),
m AS (SELECT n, sum(n) OVER (PARTITION BY risk_level) AS a, sum(n) OVER (PARTITION BY is_remote) AS b, sum(n) OVER () AS t FROM c) SELECT round(sum(n / t * log2(n * t / (a * b))), 6) AS bits FROM m""")
def quality_mutual_information(spark, root):
    return quality.mutual_information(table(spark, root, "jobs", "risk_level", "is_remote"), "risk_level", "is_remote").select(r6("bits").alias("bits"))


_WORDS = "SELECT report_id, is_scam, list_distinct(regexp_extract_all(lower(coalesce(reason, '')), '[a-z]+')) AS f FROM user_reports"


@query(f"""WITH r AS ({_WORDS}), t AS (SELECT count(*) AS n, sum(is_scam) AS pos FROM r),
s AS (SELECT feature, count(*) AS have, sum(is_scam) AS hit FROM (SELECT unnest(f) AS feature, is_scam FROM r) GROUP BY feature),
x AS (SELECT *, have - hit AS h0, pos - hit AS h1, n - have - pos + hit AS h2 FROM s, t)
SELECT feature, have, round(have / n, 6) AS fire_rate, round(hit / have, 6) AS precision, round(
CASE WHEN hit > 0 THEN hit / n * log2(hit * n / (have * pos)) ELSE 0 END + CASE WHEN h0 > 0 THEN h0 / n * log2(h0 * n / (have * (n - pos))) ELSE 0 END
+ CASE WHEN h1 > 0 THEN h1 / n * log2(h1 * n / ((n - have) * pos)) ELSE 0 END + CASE WHEN h2 > 0 THEN h2 / n * log2(h2 * n / ((n - have) * (n - pos))) ELSE 0 END, 6) AS bits FROM x WHERE have >= 10 AND have < n""")
def quality_feature_information(spark, root):
    reports = table(spark, root, "user_reports", "report_id", "is_scam", "reason")
    out = quality.feature_information(reports, "report_id", T.tokens(F.col("reason")), F.col("is_scam") == 1)
    return out.where("have >= 10 and fire_rate < 1").select("feature", "have", *[r6(c).alias(c) for c in ("fire_rate", "precision", "bits")])


@query(f"""WITH r AS ({_WORDS}), t AS (SELECT count(*) AS n FROM r), s AS (SELECT report_id, unnest(f) AS i FROM r), c AS (SELECT i, count(*) AS c FROM s GROUP BY i),
p AS (SELECT x.i AS a, y.i AS b, count(*) AS together FROM s x JOIN s y ON x.report_id = y.report_id AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT a, b, together, round(together * n / (ca.c * cb.c), 6) AS lift FROM p JOIN c ca ON p.a = ca.i JOIN c cb ON p.b = cb.i, t""")
def quality_pair_lift(spark, root):
    out = quality.pair_lift(table(spark, root, "user_reports", "report_id", "reason"), "report_id", T.tokens(F.col("reason")), 20)
    return out.select("a", "b", "together", r6("lift").alias("lift"))


@query("""WITH d AS (SELECT event_type, count_if(event_id % 2 = 0) AS wa, count_if(event_id % 2 = 1) AS wb FROM events GROUP BY event_type),
s AS (SELECT event_type, wa / sum(wa) OVER () AS p, wb / sum(wb) OVER () AS q FROM d)
SELECT event_type, round(p, 6) AS p, round(q, 6) AS q, round((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS jsd,
round((q + 1e-9) * ln((q + 1e-9) / (p + 1e-9)), 6) AS kl FROM s""")
def quality_distribution_shift(spark, root):
    events = table(spark, root, "events", "event_id", "event_type").withColumn("w", F.lit(1))
    out = quality.distribution_shift(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "event_type", "w")
    return out.select("event_type", *[r6(c).alias(c) for c in ("p", "q", "jsd", "kl")])


@query(r"""WITH t AS (SELECT report_id, regexp_extract_all(lower(coalesce(reason, '')), '[a-z]+') AS w FROM user_reports),
g AS (SELECT DISTINCT report_id, array_to_string(w[i:i+2], ' ') AS ngram FROM t, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i) WHERE len(w) >= 3)
SELECT ngram, count(*) AS n FROM g GROUP BY ngram HAVING count(*) >= 3""")
def quality_ngrams(spark, root):
    rows = table(spark, root, "user_reports", "report_id", "reason").select("report_id", F.explode(F.array_distinct(T.ngrams(T.tokens(F.col("reason")), 3))).alias("ngram"))
    return rows.groupBy("ngram").agg(F.count("*").alias("n")).where("n >= 3")


# ---- series -----------------------------------------------------------------------------------------------------

_DAILY = """WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2), e AS (SELECT min(day) AS a, max(day) AS b FROM c),
g AS (SELECT event_type, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT event_type FROM c), e),
d AS (SELECT g.event_type, g.day, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.day = c.day)"""


def _daily(spark: SparkSession, root: str) -> DataFrame:
    return series.daily(table(spark, root, "events", "event_type", "ts"), "event_type", F.to_date("ts"))


@query(_DAILY + " SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n FROM d")
def series_daily(spark, root):
    return _daily(spark, root).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query(_DAILY + """, l AS (SELECT event_type, list(CAST(n AS DOUBLE) ORDER BY day) AS s FROM d GROUP BY event_type)
SELECT event_type, len(s) AS periods, round(list_reduce(s, lambda e, x: e * 0.7e0 + x * 0.3e0), 6) AS ema, list_max(s) AS peak, s[-1] AS last FROM l""")
def series_smoothed(spark, root):
    out = series.smoothed(_daily(spark, root), "event_type", "day", "n", 0.3)
    return out.select("event_type", F.col("periods").cast("long").alias("periods"), r6("ema").alias("ema"), "peak", "last")


@query(_DAILY + """, w AS (SELECT event_type, day, n, count(n) OVER p AS seen, avg(n) OVER p AS m, stddev_pop(n) OVER p AS s, avg(n) OVER q AS b FROM d
WINDOW p AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, round(CASE WHEN seen >= 3 THEN CASE WHEN s > 1e-12 THEN (n - m) / s ELSE 0 END END, 4) AS z, round(CASE WHEN b > 0 THEN n / b END, 6) AS burst FROM w""")
def series_anomalies(spark, root):
    out = series.anomalies(_daily(spark, root), "event_type", "day", "n")
    return out.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("z", 4).alias("z"), r6("burst").alias("burst"))


@query(_DAILY + """, w AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n,
sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, sum(n) OVER (PARTITION BY event_type) AS a, stddev_pop(n) OVER (PARTITION BY event_type) AS s FROM d),
x AS (SELECT *, round(abs((a - l) / (n - k) - l / k), 9) AS shift FROM w WHERE k >= 2 AND k <= n - 2),
y AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY shift DESC, k) AS i FROM x) SELECT event_type, strftime(day, '%Y-%m-%d') AS at, round(shift, 6) AS shift, shift > s AS significant FROM y WHERE i = 1""")
def series_change_points(spark, root):
    out = series.change_points(_daily(spark, root), "event_type", "day", "n")
    return out.select("event_type", F.date_format("at", "yyyy-MM-dd").alias("at"), r6("shift").alias("shift"), "significant")


@query(_DAILY + """, x AS (SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y FROM d),
f AS (SELECT event_type, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS sxy, var_pop(x) AS sxx, var_pop(y) AS syy FROM x GROUP BY event_type)
SELECT event_type, n, round(sxy / sxx, 6) AS slope, round(my + sxy / sxx * (n - mx), 6) AS next, round(1 - greatest(syy - sxy / sxx * sxy, 0) / syy, 6) AS r2, round(1.96 * sqrt(greatest(syy - sxy / sxx * sxy, 0)), 6) AS half_width FROM f""")
def series_forecast(spark, root):
    return series.forecast(_daily(spark, root), "event_type", "day", "n").select("event_type", "n", *[r6(c).alias(c) for c in ("slope", "next", "r2", "half_width")])


@query("""WITH r AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS gap, CAST(event_type <> lag(event_type) OVER w AS INTEGER) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_type))
SELECT user_id, count(*) AS events, round(avg(gap), 4) AS mean_gap, coalesce(sum(s), 0)::BIGINT AS switches FROM r GROUP BY user_id""")
def series_gaps(spark, root):
    events = table(spark, root, "events", "user_id", "ts", "event_type")
    out = series.gaps(events, "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "event_type")
    return out.select("user_id", "events", F.round("mean_gap", 4).alias("mean_gap"), "switches")


@query("""WITH r AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, CAST(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) > 86400 AS INTEGER) AS n FROM events),
s AS (SELECT user_id, t, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS session FROM r)
SELECT user_id, session, count(*) AS events, round(max(t) - min(t), 3) AS seconds FROM s GROUP BY 1, 2""")
def series_sessions(spark, root):
    out = series.sessions(table(spark, root, "events", "user_id", "ts"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 86400)
    return out.select("user_id", "session", "events", F.round("seconds", 3).alias("seconds"))


@query(_DAILY + """, r AS (SELECT event_type, CAST(n AS DOUBLE) AS v, lag(CAST(n AS DOUBLE), 1) OVER (PARTITION BY event_type ORDER BY day) AS p FROM d)
SELECT event_type, count(*) AS n, round(coalesce(corr(v, p), 0), 6) AS correlation FROM r WHERE p IS NOT NULL GROUP BY event_type""")
def series_lagged_correlation(spark, root):
    return series.lagged_correlation(_daily(spark, root), "event_type", "day", "n", 1).select("event_type", "n", r6("correlation").alias("correlation"))


@query("SELECT strftime(discovered_at AT TIME ZONE 'UTC', '%G-W%V') AS week, count(*) AS n FROM jobs GROUP BY 1")
def series_weeks(spark, root):
    day = F.to_date("discovered_at")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return table(spark, root, "jobs", "discovered_at").groupBy(week.alias("week")).agg(F.count("*").alias("n"))


# ---- graph ------------------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "postings", "company", "recruiter_name").where("trim(company) != '' and trim(recruiter_name) != ''")
    return rows.select(F.concat(F.lit("c:"), "company").alias("a"), F.concat(F.lit("r:"), "recruiter_name").alias("b")).distinct()


_EDGES = "WITH RECURSIVE e AS (SELECT DISTINCT 'c:' || company AS a, 'r:' || recruiter_name AS b FROM postings WHERE trim(company) <> '' AND trim(recruiter_name) <> ''), u AS (SELECT a AS s, b AS d FROM e UNION SELECT b, a FROM e)"


@query(_EDGES + ", w(node, seen) AS (SELECT s, s FROM u UNION SELECT w.node, u.d FROM w JOIN u ON w.seen = u.s) SELECT node, min(seen) AS component FROM w GROUP BY node")
def graph_components(spark, root):
    return graph.components(_edges(ship(spark), root), "a", "b")


@query(_EDGES + ", g AS (SELECT s, count(*) AS degree FROM u GROUP BY s) SELECT s AS node, degree, round(degree / (SELECT count(*) - 1 FROM g), 6) AS centrality FROM g")
def graph_degrees(spark, root):
    return graph.degrees(_edges(spark, root), "a", "b").select("node", "degree", r6("centrality").alias("centrality"))


@query(_EDGES + ", st AS (SELECT min(s) AS s FROM u), w(node, hop) AS (SELECT s, 0 FROM st UNION SELECT u.d, w.hop + 1 FROM w JOIN u ON w.node = u.s WHERE w.hop < 4) SELECT node, min(hop) AS hop FROM w GROUP BY node")
def graph_reach(spark, root):
    both = graph.undirected(_edges(ship(spark), root), "a", "b")
    return graph.reach(both, "src", "dst", both.agg(F.min("src").alias("node")), 4)


@query(_EDGES + """, st AS (SELECT min(s) AS s FROM u), h1 AS (SELECT u.d AS n, sum(0.5e0) AS x FROM st JOIN u ON st.s = u.s GROUP BY 1), h2 AS (SELECT u.d AS n, sum(x * 0.5e0) AS x FROM h1 JOIN u ON h1.n = u.s GROUP BY 1)
SELECT n AS node, round(sum(x), 6) AS strength FROM (SELECT s AS n, 1e0 AS x FROM st UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY n""")
def graph_propagated(spark, root):
    both = graph.undirected(_edges(ship(spark), root), "a", "b").withColumn("w", F.lit(1.0))
    return graph.propagated(both, "src", "dst", "w", both.agg(F.min("src").alias("node")), 2, 0.5).select("node", r6("strength").alias("strength"))


# ---- text -------------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS words, greatest(1, len(regexp_extract_all(x, '[.!?]+(\s|$)'))) AS sentences, len(regexp_extract_all(lower(x), '[aeiouy]+')) AS syllables, w FROM t)
SELECT doc_id, words, sentences, syllables, round(CASE WHEN words > 0 THEN 0.39 * words / sentences + 11.8 * syllables / words - 15.59 END, 6) AS grade,
round(CASE WHEN words > 0 THEN len(list_distinct(w[1:200])) / len(w[1:200]) END, 6) AS variety FROM p""")
def text_profile(spark, root):
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, root, "documents", "doc_id", "text").select("doc_id", t.alias("x"), T.tokens(t).alias("w"))
    p = rows.select("doc_id", F.size("w").alias("words"), T.sentences(F.col("x")).alias("sentences"), T.syllables(F.col("x")).alias("syllables"), F.slice("w", 1, 200).alias("h"))
    grade = F.when(F.col("words") > 0, 0.39 * F.col("words") / F.col("sentences") + 11.8 * F.col("syllables") / F.col("words") - 15.59)
    variety = F.when(F.col("words") > 0, F.size(F.array_distinct("h")) / F.size("h"))
    return p.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("words", "sentences", "syllables")], r6(grade).alias("grade"), r6(variety).alias("variety"))


@query(r"""SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(description, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda x: lower(x)))), ',') AS emails
FROM jobs WHERE contains(description, '@') AND len(regexp_extract_all(description, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) > 0""")
def text_emails(spark, root):
    rows = table(spark, root, "jobs", "id", "description").where(F.col("description").contains("@")).select("id", T.emails(F.col("description")).alias("e"))
    return rows.where(F.size("e") > 0).select("id", F.array_join("e", ",").alias("emails"))


@query(r"""WITH u AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\s<>()"'']+')), '[.,;:!?]+$', '') AS url FROM documents)
SELECT regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1), '^www\.', '') AS domain, count(*) AS n FROM u GROUP BY 1""")
def text_link_domains(spark, root):
    links = table(spark, root, "documents", "doc_id", "text").select(F.explode(T.urls(F.col("text"))).alias("url"))
    return links.groupBy(T.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(title, '')), '{p}') THEN '{n}'" for n, p in T.LEVELS) + " ELSE 'mid' END"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(employment_type, '')), '{p}') THEN '{n}'" for n, p in T.EMPLOYMENT) + " ELSE 'unknown' END"


@query(f"SELECT {_LEVEL} AS level, {_KIND} AS kind, count(*) AS n FROM jobs GROUP BY 1, 2")
def text_levels(spark, root):
    rows = table(spark, root, "jobs", "title", "employment_type").select(T.experience_level(F.col("title")).alias("level"), T.employment_type(F.col("employment_type")).alias("kind"))
    return rows.groupBy("level", "kind").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT lower(coalesce(posted_date, '')) AS x FROM postings),
q AS (SELECT regexp_extract(x, '(\d+)\s*(day|week|month|hour|minute)s?\s+ago', 1) AS n, regexp_extract(x, '(\d+)\s*(day|week|month|hour|minute)s?\s+ago', 2) AS u, x FROM p),
d AS (SELECT CASE WHEN n <> '' THEN CAST(n AS INTEGER) * CASE u WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 0 END WHEN regexp_matches(x, 'today|just (now|posted)') THEN 0 WHEN regexp_matches(x, 'yesterday') THEN 1 END AS days FROM q)
SELECT days, count(*) AS n FROM d GROUP BY days""")
def text_days_ago(spark, root):
    return table(spark, root, "postings", "posted_date").groupBy(T.days_ago(F.col("posted_date")).alias("days")).agg(F.count("*").alias("n"))


@query()
def text_similar_names(spark, root):
    from sievework.functions.similarity import jaro_winkler_udf

    similar = jaro_winkler_udf()
    c = table(ship(spark), root, "companies", "company_id", "name").select("company_id", F.regexp_replace(F.lower("name"), "[^a-z0-9 ]", "").alias("name")).where(F.length("name") >= 4).withColumn("block", F.substring("name", 1, 4))
    pairs = c.alias("x").join(c.alias("y"), "block").where("x.company_id < y.company_id").select(F.col("x.company_id").alias("a"), F.col("y.company_id").alias("b"), similar("x.name", "y.name").alias("s"))
    return pairs.where("s >= 0.9").select("a", "b", r6("s").alias("similarity"))


@query("""WITH c AS (SELECT company_id, name, right(name, 5) AS block FROM (SELECT company_id, regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g') AS name FROM companies) WHERE length(name) >= 5)
SELECT a.company_id AS a, b.company_id AS b, levenshtein(a.name, b.name) AS edits FROM c a JOIN c b ON a.block = b.block AND a.company_id < b.company_id WHERE levenshtein(a.name, b.name) <= 3""")
def text_edit_distance_join(spark, root):
    c = table(spark, root, "companies", "company_id", "name").select("company_id", F.regexp_replace(F.lower("name"), "[^a-z0-9 ]", "").alias("name")).where(F.length("name") >= 5).withColumn("block", F.right("name", F.lit(5)))
    pairs = c.alias("x").join(c.alias("y"), "block").where("x.company_id < y.company_id").select(F.col("x.company_id").alias("a"), F.col("y.company_id").alias("b"), F.levenshtein("x.name", "y.name", 3).cast("long").alias("edits"))
    return pairs.where("edits >= 0")


def _clean_names(spark, root):
    return table(spark, root, "companies", "company_id", "name").select("company_id", F.regexp_replace(F.lower("name"), "[^a-z0-9 ]", "").alias("name"))


@query()
def text_all_similar_names(spark, root):
    from sievework.functions.similarity import alike

    return alike(_clean_names(ship(spark), root), "company_id", "name", 0.9).select("a", "b", r6("similarity").alias("similarity"))


@query("""WITH c AS (SELECT company_id, regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g') AS name FROM companies)
SELECT a.company_id AS a, b.company_id AS b, levenshtein(a.name, b.name) AS edits FROM c a JOIN c b ON a.company_id < b.company_id AND length(a.name) > 0 AND length(b.name) > 0 WHERE levenshtein(a.name, b.name) <= 3""")
def text_all_edit_distances(spark, root):
    from sievework.functions.similarity import within_edits

    return within_edits(_clean_names(spark, root), "company_id", "name", 3)


@query()
def text_unmasked(spark, root):
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", T.unmasked(t).alias("clean"), (F.length(T.unmasked(t)) != F.length(t)).alias("changed"))


# ---- scores -----------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, root: str) -> DataFrame:
    return scoring.scored(table(spark, root, "jobs", "id", "title", "description"), "id", "title", "description")


def _signal_sql() -> str:
    low = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, '')))"
    both = "concat_ws(' ', coalesce(title, ''), coalesce(description, ''))"
    tests = {
        "asks_for_payment": "refundable deposit|registration charge|training charge|starter kit fee|equipment advance|background check payment|visa handling fee|courier bond",
        "asks_for_bank_access": "bank login|bank details up front|form for bank data|request for passwords",
        "untraceable_payment": "gift card|crypto|prepaid voucher|wire to a personal account|money sent through a stranger",
        "easy_money": "earn while you sleep|easy money|no experience needed|daily pay",
        "skips_interview": "no interview|offer before any interview",
        "moves_to_private_channel": "private messenger|encrypted chat|chat app|unlisted group|text message only|voice note",
        "hurries": "answer within [0-9]+ hours|only [0-9]+ seats left|expires in [0-9]+ hours|start tonight",
        "carries_link": "https?://",
        "states_requirements": "knowledge of|you bring [0-9]+ years|experience with",
        "states_benefits": "matched pension|health check|paid study days|childcare voucher|profit sharing",
        "describes_process": "probation lasts|meets every candidate|round closes",
    }
    weights = {"asks_for_payment": 0.9, "asks_for_bank_access": 0.92, "untraceable_payment": 0.88, "easy_money": 0.8, "skips_interview": 0.78, "moves_to_private_channel": 0.66, "hurries": 0.6, "short_text": 0.55, "shouting": 0.58, "carries_link": 0.52, "states_requirements": 0.35, "states_benefits": 0.3, "describes_process": 0.32}
    cases = {n: f"regexp_matches({low}, '{p}')" for n, p in tests.items()}
    cases["short_text"] = f"len(regexp_extract_all({both}, '[^\\s]+')) < 20"
    cases["shouting"] = f"(len(regexp_extract_all({both}, '[A-Z]{{4,}}')) >= 5 OR regexp_matches({both}, '[!?]{{2,}}'))"
    parts = " UNION ALL ".join(f"SELECT id, '{n}' AS name, {weights[n]} AS weight, {str(n.startswith(('states', 'describes'))).lower()} AS good FROM jobs WHERE {cases[n]}" for n in weights)
    return f"WITH f AS ({parts}), s AS (SELECT j.id, count(f.name) AS n, count_if(f.good) AS good, sum(ln(f.weight / (1 - f.weight))) AS l FROM jobs j LEFT JOIN f ON j.id = f.id GROUP BY j.id), r AS (SELECT id, n, good, l, CASE WHEN n = 0 THEN 0 ELSE 1 / (1 + exp(-l)) END AS score FROM s)"


_RISK = "CASE WHEN score < 0.2 THEN 'safe' WHEN score < 0.4 THEN 'low' WHEN score < 0.6 THEN 'suspicious' WHEN score < 0.8 THEN 'high' ELSE 'scam' END"


@query(_signal_sql() + f" SELECT id, n::BIGINT AS n, round(score, 6) AS score, round(CASE WHEN n = 0 THEN 0 ELSE (1 - exp(-0.3 * n)) * greatest(good, n - good) / n END, 6) AS confidence, {_RISK} AS risk FROM r")
def score_jobs(spark, root):
    return _scored(spark, root).select("id", F.size("signals").cast("long").alias("n"), r6("score").alias("score"), r6("confidence").alias("confidence"), "risk")


@query(_signal_sql() + " SELECT f.id, f.name, round(r.score - CASE WHEN r.n = 1 THEN 0 ELSE 1 / (1 + exp(-(r.l - ln(f.weight / (1 - f.weight))))) END, 6) AS share FROM f JOIN r ON f.id = r.id")
def score_attribution(spark, root):
    rows = _scored(spark, root).select("id", F.explode(scoring.attribution(F.col("signals"))).alias("a"))
    return rows.select("id", F.col("a.name").alias("name"), r6("a.share").alias("share"))


@query(_signal_sql() + f" SELECT j.source, {_RISK} AS risk, count(*) AS n, round(avg(score), 6) AS mean_score FROM r JOIN jobs j ON j.id = r.id GROUP BY 1, 2")
def score_summary(spark, root):
    jobs = scoring.prepared(table(spark, root, "jobs", "id", "source", "title", "description"), "title", "description")
    found = scoring.fired(scoring.text_signals(F.col("_both"), F.col("_low")))
    # Each step is a projection of its own, so that no pattern is matched twice.
    rows = jobs.select("source", found.alias("s")).select("source", scoring.score(F.col("s")).alias("score"))
    return rows.groupBy("source", scoring.risk(F.col("score")).alias("risk")).agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"))


@query()
def score_ensemble(spark, root):
    return _scored(spark, root).select("id", scoring.ensemble(F.col("signals")).alias("e")).select("id", r6("e.value").alias("value"), r6("e.spread").alias("spread"))


# ---- relational -------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def relational_pricing_summary(spark, root):
    rows = table(spark, root, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount")).alias("discount"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS value FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def relational_market(spark, root):
    o = table(spark, root, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))  # reduced before the joins
    c = table(spark, root, "customer", "c_custkey", "c_nationkey").join(o, F.col("c_custkey") == F.col("o_custkey"))
    n = table(spark, root, "nation", "n_nationkey", "n_name", "n_regionkey").join(table(spark, root, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("v"), 2).alias("value"))


@query("""WITH c AS (SELECT label, list_aggregate(list(e), 'count') AS n, list(e) AS l FROM (SELECT label, embedding AS e FROM embeddings) GROUP BY label) SELECT label, n::BIGINT AS n FROM c""")
def vector_labels(spark, root):
    return table(spark, root, "embeddings", "label", "embedding").groupBy("label").agg(F.count("embedding").alias("n"))


@query("""WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2),
y AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT vec_id, c.label, round(sqrt(sum((CAST(v AS DOUBLE) - m) ** 2)), 6) AS d FROM y JOIN c ON y.i = c.i GROUP BY 1, 2)
SELECT vec_id, label, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM d) WHERE k = 1""")
def vector_nearest_centroid(spark, root):
    rows = table(spark, root, "embeddings", "vec_id", "label", "embedding")
    centre = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m")).agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("centres"))
    # one row with as many centroids as there are labels
    distance = lambda c: F.round(F.sqrt(F.aggregate(F.zip_with("embedding", c["m"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)), 6)
    best = rows.join(F.broadcast(packed)).select("vec_id", F.array_min(F.transform("centres", lambda c: F.struct(distance(c).alias("d"), c["label"].alias("label")))).alias("b"))
    return best.select("vec_id", F.col("b.label").alias("label"), F.col("b.d").alias("distance"))


# ---- more of quality and style ----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT risk_level, is_remote, source, count(*) AS n FROM jobs GROUP BY 1, 2, 3), m AS (SELECT n, sum(n) OVER (PARTITION BY risk_level, source) AS a, sum(n) OVER (PARTITION BY is_remote, source) AS b,
sum(n) OVER (PARTITION BY source) AS z, sum(n) OVER () AS t FROM c) SELECT round(sum(n / t * log2(n * z / (a * b))), 6) AS bits FROM m""")
def quality_conditional_information(spark, root):
    return quality.conditional_information(table(spark, root, "jobs", "risk_level", "is_remote", "source"), "risk_level", "is_remote", "source").select(r6("bits").alias("bits"))


@query(f"""WITH r AS (SELECT f, our_prediction < 0.5 AS m FROM (SELECT list_distinct(regexp_extract_all(lower(coalesce(reason, '')), '[a-z]+')) AS f, our_prediction FROM user_reports WHERE is_scam = 1) WHERE our_prediction IS NOT NULL),
x AS (SELECT unnest(f) AS item, m FROM r) SELECT item, count_if(NOT m) AS caught, count_if(m) AS missed, round(count_if(m) / (count_if(NOT m) + 1), 6) AS ratio FROM x GROUP BY item""")
def quality_gaps(spark, root):
    reports = table(spark, root, "user_reports", "is_scam", "our_prediction", "reason").where("is_scam = 1")
    return quality.gap_ratio(reports, T.tokens(F.col("reason")), F.col("our_prediction") < 0.5).select("item", "caught", "missed", r6("ratio").alias("ratio"))


@query("""WITH r AS (SELECT scam_score AS o, least(scam_score * 1.2e0, 1e0) AS n FROM jobs WHERE scam_score IS NOT NULL), l AS (SELECT *, n - o AS d,
CASE WHEN o < 0.2 THEN 1 WHEN o < 0.4 THEN 2 WHEN o < 0.6 THEN 3 WHEN o < 0.8 THEN 4 ELSE 5 END <> CASE WHEN n < 0.2 THEN 1 WHEN n < 0.4 THEN 2 WHEN n < 0.6 THEN 3 WHEN n < 0.8 THEN 4 ELSE 5 END AS moved FROM r)
SELECT count(*) AS rows, count_if(moved) AS moved, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS spread, round(max(d), 6) AS rise, round(min(d), 6) AS fall FROM l""")
def quality_cascade_preview(spark, root):
    out = quality.cascade_preview(table(spark, root, "jobs", "scam_score"), F.col("scam_score"), F.least(F.col("scam_score") * 1.2, F.lit(1.0)), scoring.risk)
    return out.select("rows", "moved", *[r6(c).alias(c) for c in ("mean", "spread", "rise", "fall")])


@query()
def quality_minimal_set(spark, root):
    reports = table(spark, root, "user_reports", "reason", "is_scam")
    low = F.lower(F.coalesce(F.col("reason"), F.lit("")))
    words = ("gift", "fine", "slow", "crypto", "real", "wire", "vouchers")
    chosen = quality.minimal_set(reports.where("is_scam is not null"), {w: low.contains(w) for w in words}, F.col("is_scam") == 1)
    return spark.createDataFrame([(i + 1, n, round(b, 6)) for i, (n, b) in enumerate(chosen)], "step int, feature string, bits double")


_STYLE = r"""WITH t AS (SELECT doc_id, doc_type, crawled_at, coalesce(text, '') AS x, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents)"""


@query(_STYLE + r""", s AS (SELECT doc_id, doc_type, list_sum(list_transform(w, lambda a: len(a))) / len(w) AS a, len(w) / greatest(1, len(regexp_extract_all(x, '[.!?]+(\s|$)'))) AS b, len(list_distinct(w)) / len(w) AS c FROM t WHERE len(w) > 0)
SELECT doc_type, count(*) AS n, round(avg(a), 6) AS word_length, round(avg(b), 6) AS sentence_length, round(avg(c), 6) AS variety FROM s GROUP BY doc_type""")
def style_centroids(spark, root):
    rows = table(spark, root, "documents", "doc_id", "doc_type", "text").select("doc_type", style.fingerprint(F.col("text")).alias("v"))
    out = style.centroids(rows, "doc_type", "v")
    return out.select("doc_type", "n", *[r6(F.element_at("centre", i + 1)).alias(c) for i, c in enumerate(("word_length", "sentence_length", "variety"))])


@query()
def style_shifts(spark, root):
    rows = table(spark, root, "documents", "doc_id", "source", "text").select("source", "doc_id", style.fingerprint(F.col("text")).alias("v")).where("v is not null")
    return style.shifts(rows, "source", "doc_id", "v").select("source", "doc_id", r6("shift").alias("shift"))


@query(r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM eval_items), g AS (SELECT item_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS s FROM t WHERE len(w) > 1)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS similarity FROM g x JOIN g y ON x.item_id < y.item_id
WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.4""")
def style_families(spark, root):
    return style.families(table(spark, root, "eval_items", "item_id", "text"), "item_id", "text", 0.4).select("a", "b", r6("similarity").alias("similarity"))


@query()
def style_template_families(spark, root):
    return style.template_families(table(ship(spark), root, "jobs", "id", "description"), "id", "description", 0.75)


@query("""WITH v AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice > 0), d AS (SELECT CAST(floor(v / pow(10, floor(log10(v)))) AS INTEGER) AS digit, count(*) AS n FROM v GROUP BY 1)
SELECT i::INTEGER AS digit, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM d), 6) AS share, round(log10(1 + 1 / i), 6) AS expected FROM range(1, 10) r(i) LEFT JOIN d ON d.digit = i""")
def quality_leading_digits(spark, root):
    return quality.leading_digits(table(spark, root, "lineitem", "l_extendedprice"), "l_extendedprice").select("digit", "n", r6("share").alias("share"), r6("expected").alias("expected"))


@query(f"""WITH x AS (SELECT unnest(f) AS item, is_scam FROM ({_WORDS}) WHERE is_scam IS NOT NULL), n AS (SELECT item, count_if(is_scam = 1) AS hits, count_if(is_scam <> 1) AS misses FROM x GROUP BY item)
SELECT item, hits, misses, round((hits + 1) / (hits + misses + 2), 6) AS mean, round((hits + 1) / (hits + misses + 2) - 2 * sqrt((hits + 1e0) * (misses + 1e0) / (pow(hits + misses + 2e0, 2) * (hits + misses + 3e0))), 6) AS lower FROM n""")
def quality_posteriors(spark, root):
    out = quality.beta_posteriors(table(spark, root, "user_reports", "reason", "is_scam"), T.tokens(F.col("reason")), F.col("is_scam") == 1)
    return out.select("item", "hits", "misses", r6("mean").alias("mean"), r6("lower").alias("lower"))


@query("""WITH r AS (SELECT id, scam_score AS a, confidence AS b, signal_count / 10e0 AS c FROM jobs WHERE confidence IS NOT NULL AND NOT isnan(confidence)), m AS (SELECT *, (a + b + c) / 3 AS m FROM r)
SELECT id, round(0.6e0 * sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2)) / 3) + 0.4e0 * (1 - abs(m - 0.5e0) * 2), 6) AS value FROM m ORDER BY value DESC, id LIMIT 20""")
def quality_committee(spark, root):
    jobs = table(spark, root, "jobs", "id", "scam_score", "confidence", "signal_count").where("confidence is not null and not isnan(confidence)")
    return quality.committee(jobs.withColumn("c", F.col("signal_count") / 10), "id", ["scam_score", "confidence", "c"], 20)


@query("""WITH a AS (SELECT url, max(id) AS id FROM jobs WHERE batch_no <= 6 GROUP BY url), b AS (SELECT url, max(id) AS id FROM jobs WHERE batch_no >= 1 GROUP BY url)
SELECT CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN b ON a.url = b.url WHERE a.id IS DISTINCT FROM b.id GROUP BY 1""")
def store_snapshot_difference(spark, root):
    jobs = table(spark, root, "jobs", "url", "id", "batch_no")
    last = lambda df: df.groupBy("url").agg(F.max("id").alias("id"))
    return quality.snapshot_difference(last(jobs.where("batch_no <= 6")), last(jobs.where("batch_no >= 1")), "url", ["id"]).groupBy("change").agg(F.count("*").alias("n"))


@query("""SELECT recruiter_name, count(*) AS postings, count(DISTINCT lower(company)) AS companies, count_if(is_remote) AS remote, max(recruiter_connections) AS connections, round(avg(length(description)), 6) AS mean_length
FROM postings WHERE trim(recruiter_name) <> '' GROUP BY recruiter_name""")
def graph_profiles(spark, root):
    rows = table(spark, root, "postings", "recruiter_name", "company", "is_remote", "recruiter_connections", "description").where("trim(recruiter_name) != ''")
    features = [("postings", F.count("*")), ("companies", F.countDistinct(F.lower("company"))), ("remote", F.count_if("is_remote")), ("connections", F.max("recruiter_connections")), ("mean_length", r6(F.avg(F.length("description"))))]
    return graph.profiles(rows, "recruiter_name", features)


@query(_EDGES + """, w(node, seen) AS (SELECT s, s FROM u UNION SELECT w.node, u.d FROM w JOIN u ON w.seen = u.s), c AS (SELECT node, min(seen) AS component FROM w GROUP BY node),
f AS (SELECT 'r:' || recruiter_name AS node, count(*) AS v FROM postings WHERE trim(recruiter_name) <> '' GROUP BY 1)
SELECT component, count(*) AS size, min(c.node) AS hub, round(avg(v), 6) AS mean FROM c LEFT JOIN f ON c.node = f.node GROUP BY component""")
def graph_clusters(spark, root):
    members = graph.components(_edges(ship(spark), root), "a", "b")
    facts = table(spark, root, "postings", "recruiter_name").where("trim(recruiter_name) != ''").groupBy(F.concat(F.lit("r:"), "recruiter_name").alias("n")).agg(F.count("*").alias("v"))
    return graph.clusters(members, facts, "n", "v").select("component", "size", "hub", r6("mean").alias("mean"))


@query(_DAILY + """, e2 AS (SELECT event_type, day, CAST(n - lag(n) OVER w AS DOUBLE) AS d, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS back FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
g2 AS (SELECT *, d - lag(d) OVER w AS dd, CAST(sign(d) * sign(lag(d) OVER w) < 0 AS INTEGER) AS turn FROM e2 WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, round(avg(d), 6) AS velocity, round(avg(dd), 6) AS acceleration, coalesce(sum(turn), 0)::BIGINT AS turns, abs(avg(d)) < 1e-3 AS at_rest FROM g2 WHERE back <= 10 GROUP BY event_type""")
def series_velocity(spark, root):
    return series.velocity(_daily(spark, root), "event_type", "day", "n").select("event_type", r6("velocity").alias("velocity"), r6("acceleration").alias("acceleration"), "turns", "at_rest")


@query("""WITH r AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS recent FROM events)
SELECT user_id, max(recent) AS most, count_if(recent > 3) AS exceeded FROM r GROUP BY user_id""")
def series_rate(spark, root):
    rows = series.within_rate(table(spark, root, "events", "user_id", "ts"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), 43_200, 3)
    return rows.groupBy("user_id").agg(F.max("recent").alias("most"), F.count_if("exceeded").alias("exceeded"))


# ---- mutations, sources, robustness -----------------------------------------------------------------------------


@query("""WITH a AS (SELECT url, min(title) AS title, max(risk_level) AS risk_level FROM jobs WHERE batch_no < 6 GROUP BY url), b AS (SELECT url, min(title) AS title, max(risk_level) AS risk_level FROM jobs WHERE batch_no >= 6 GROUP BY url)
SELECT coalesce(a.url, b.url) AS url, coalesce(a.title, b.title) AS title, coalesce(b.risk_level, a.risk_level) AS risk_level FROM a FULL JOIN b ON a.url = b.url""")
def merge_columns(spark, root):
    jobs = table(spark, root, "jobs", "url", "title", "risk_level", "batch_no")
    one = lambda df: df.groupBy("url").agg(F.min("title").alias("title"), F.max("risk_level").alias("risk_level"))
    return merge.merged(one(jobs.where("batch_no < 6")), one(jobs.where("batch_no >= 6")), "url", keep=("title",))


@query("""WITH a AS (SELECT source, count(*) AS n, round(avg(scam_score), 6) AS mean FROM jobs WHERE batch_no < 12 GROUP BY source), b AS (SELECT source, count(*) AS n, round(avg(scam_score), 6) AS mean FROM jobs WHERE batch_no = 12 GROUP BY source)
SELECT coalesce(a.source, b.source) AS source, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS n, coalesce(b.mean, a.mean) AS mean FROM a FULL JOIN b ON a.source = b.source""")
def merge_counters(spark, root):
    jobs = table(spark, root, "jobs", "source", "scam_score", "batch_no")
    one = lambda df: df.groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("scam_score")).alias("mean"))
    return merge.accumulated(one(jobs.where("batch_no < 12")), one(jobs.where("batch_no = 12")), "source", ("n",), ("mean",))


@query(r"""SELECT sha256(lower(trim(regexp_replace(description, '\s+', ' ', 'g')))) AS digest, lower(coalesce(company, '')) AS owner, min(id) AS first FROM jobs WHERE trim(coalesce(description, '')) <> '' GROUP BY 1, 2""")
def merge_first_kept(spark, root):
    rows = table(spark, root, "jobs", "id", "description", "company", "batch_no").where("trim(coalesce(description, '')) != ''")
    rows = rows.select(T.content_hash(F.col("description")).alias("digest"), F.lower(F.coalesce("company", F.lit(""))).alias("owner"), F.col("id").alias("first"), "batch_no")
    return merge.first_kept(rows.where("batch_no = 0"), rows.where("batch_no > 0"), ["digest", "owner"], "first")


@query("""WITH k AS (SELECT DISTINCT url FROM jobs WHERE batch_no < 12 AND trim(url) <> ''), n AS (SELECT DISTINCT url FROM jobs WHERE batch_no = 12 AND trim(url) <> '')
SELECT count_if(k.url IS NULL) AS inserted, count_if(k.url IS NOT NULL) AS updated, (SELECT count(*) FROM jobs WHERE batch_no = 12 AND coalesce(trim(url), '') = '') AS rejected FROM n LEFT JOIN k ON n.url = k.url""")
def merge_batch_effect(spark, root):
    jobs = table(spark, root, "jobs", "url", "batch_no")
    return merge.batch_effect(jobs.where("batch_no < 12"), jobs.where("batch_no = 12"), "url")


@query("""WITH l AS (SELECT url, arg_max(is_scam, (reported_at, report_id)) AS verdict, count(*) AS reports FROM user_reports WHERE url IS NOT NULL GROUP BY url)
SELECT risk_level, verdict, count(*) AS jobs, sum(coalesce(reports, 0))::BIGINT AS reports FROM jobs LEFT JOIN l ON jobs.url = l.url GROUP BY 1, 2""")
def merge_verdicts(spark, root):
    out = merge.verdicts(table(spark, root, "jobs", "url", "risk_level"), table(spark, root, "user_reports", "url", "reported_at", "report_id", "is_scam"), "url", "reported_at", "report_id", "is_scam")
    return out.groupBy("risk_level", "verdict").agg(F.count("*").alias("jobs"), F.sum("reports").alias("reports"))


@query("""WITH a AS (SELECT url, 0 AS p FROM jobs UNION ALL SELECT url, 1 FROM postings), k AS (SELECT url, min(p) AS p FROM a WHERE trim(coalesce(url, '')) <> '' GROUP BY url)
SELECT p::INTEGER AS part, count(*) AS n FROM (SELECT p FROM k UNION ALL SELECT p FROM a WHERE trim(coalesce(url, '')) = '') GROUP BY p""")
def source_union(spark, root):
    parts = [table(spark, root, t, "url").withColumn("part", F.lit(i)) for i, t in enumerate(("jobs", "postings"))]
    return union_of(parts).groupBy("part").agg(F.count("*").alias("n"))


def _job_forms(spark, root):
    rows = scoring.prepared(table(ship(spark), root, "jobs", "id", "title", "description"), "title", "description")
    return robustness.variants(rows, "id", "_both").withColumn("_low", F.lower("_both"))


@query()
def robust_scores(spark, root):
    signals = scoring.fired(scoring.text_signals(F.col("_both"), F.col("_low")))
    rows = _job_forms(spark, root).select("id", "kind", signals.alias("s"))
    return robustness.robustness(rows, "id", scoring.score(F.col("s")))


@query()
def robust_survival(spark, root):
    fires = {s.name: s.fires for s in scoring.text_signals(F.col("_both"), F.col("_low"))}
    return robustness.survival(_job_forms(spark, root), "id", fires).select("signal", "kind", r6("kept").alias("kept"))


@query()
def robust_ablation(spark, root):
    score = lambda t: F.when(t.contains("gift cards"), 0.4).otherwise(0.0) + F.when(t.contains("crypto"), 0.3).otherwise(0.0)
    return robustness.ablation(table(spark, root, "user_reports", "report_id", "reason"), "report_id", "reason", ["gift cards", "crypto", "fine"], score)
