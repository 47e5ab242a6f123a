"""Look-ups, feedback figures and text measures of the reference's operator families, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import quality, scoring
from sievework.plans.analytics import _signal_sql, r6
from sievework.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ---- look-ups ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE event_id = 17")
def lookup_event(spark, root):
    """Point look-up with its JSON decoded; the filter reaches the scan."""
    return table(spark, root, "events", "event_id", "event_type", "props").where("event_id = 17").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT j.batch_no, count(*) AS n, count_if(k.url IS NOT NULL) AS known FROM jobs j LEFT JOIN (SELECT DISTINCT url FROM jobs WHERE batch_no = 0 AND url IS NOT NULL) k ON j.url = k.url WHERE j.batch_no > 0 GROUP BY 1")
def lookup_known_urls(spark, root):
    jobs = table(spark, root, "jobs", "url", "batch_no")
    known = jobs.where("batch_no = 0 and url is not null").select("url").distinct().withColumn("known", F.lit(True))
    return jobs.where("batch_no > 0").join(known, "url", "left").groupBy("batch_no").agg(F.count("*").alias("n"), F.count_if("known").alias("known"))


@query("SELECT c.company_id, count(*) AS postings FROM companies c JOIN jobs j ON lower(trim(j.company)) = lower(trim(c.name)) GROUP BY 1")
def lookup_company_any_case(spark, root):
    jobs = table(spark, root, "jobs", "company").groupBy(F.lower(F.trim("company")).alias("k")).agg(F.count("*").alias("n"))  # reduced before the join
    companies = table(spark, root, "companies", "company_id", "name").select("company_id", F.lower(F.trim("name")).alias("k"))
    return companies.join(jobs, "k").select("company_id", F.col("n").alias("postings"))


@query("SELECT url, count(*) AS reports FROM user_reports WHERE is_scam = 1 AND url IS NOT NULL AND trim(url) <> '' GROUP BY url")
def lookup_reported_urls(spark, root):
    return table(spark, root, "user_reports", "url", "is_scam").where("is_scam = 1 and trim(url) != ''").groupBy("url").agg(F.count("*").alias("reports"))


@query("SELECT j.risk_level, count(*) AS n FROM jobs j WHERE lower(trim(company)) IN (SELECT lower(trim(name)) FROM companies WHERE is_verified = 1) GROUP BY 1")
def lookup_safe_companies(spark, root):
    safe = table(spark, root, "companies", "name", "is_verified").where("is_verified = 1").select(F.lower(F.trim("name")).alias("k")).distinct()
    return table(spark, root, "jobs", "company", "risk_level").withColumn("k", F.lower(F.trim("company"))).join(safe, "k", "left_semi").groupBy("risk_level").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT lower(trim(domain)) AS d FROM companies WHERE trim(domain) <> '')
SELECT count(*) AS n, count_if(regexp_extract(lower(url), '^(?:https?://)?(?:www\\.)?([^/:?#]+)', 1) IN (SELECT d FROM e)) AS listed FROM jobs WHERE trim(url) <> ''""")
def lookup_listed_domains(spark, root):
    """Membership of a posting's host in a list of entities."""
    listed = table(spark, root, "companies", "domain").where("trim(domain) != ''").select(F.lower(F.trim("domain")).alias("d"), F.lit(True).alias("listed")).distinct()
    jobs = table(spark, root, "jobs", "url").where("trim(url) != ''").select(F.regexp_extract(F.lower("url"), r"^(?:https?://)?(?:www\.)?([^/:?#]+)", 1).alias("d"))
    return jobs.join(listed, "d", "left").agg(F.count("*").alias("n"), F.count_if("listed").alias("listed"))


@query("""WITH m AS (SELECT max(discovered_at) AS t FROM jobs) SELECT company, count_if(discovered_at > t - INTERVAL 24 HOUR) AS day, count(*) AS week FROM jobs, m WHERE discovered_at > t - INTERVAL 168 HOUR AND company IS NOT NULL GROUP BY company""")
def lookup_posting_velocity(spark, root):
    jobs = table(spark, root, "jobs", "company", "discovered_at").withColumn("t", F.col("discovered_at").cast("timestamp"))
    last = jobs.agg(F.max("t").alias("last"))  # one row
    rows = jobs.where("company is not null").join(F.broadcast(last)).where(F.col("t") > F.col("last") - F.expr("interval 168 hours"))
    return rows.groupBy("company").agg(F.count_if(F.col("t") > F.col("last") - F.expr("interval 24 hours")).alias("day"), F.count("*").alias("week"))


@query("""WITH d AS (SELECT CAST(reported_at AS DATE) AS day, count(*) AS n, count_if(was_correct = 1) AS correct FROM user_reports WHERE reported_at IS NOT NULL GROUP BY 1) SELECT day, n, correct FROM d WHERE day > (SELECT max(day) FROM d) - 30""")
def lookup_recent_days(spark, root):
    days = table(spark, root, "user_reports", "reported_at", "was_correct").where("reported_at is not null").groupBy(F.to_date("reported_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("was_correct") == 1).alias("correct"))
    last = days.agg(F.max("day").alias("last"))  # one row
    return days.join(F.broadcast(last)).where(F.col("day") > F.date_sub("last", 30)).select("day", "n", "correct")


# ---- feedback ---------------------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT source, url FROM jobs WHERE url IS NOT NULL GROUP BY 1, 2), r AS (SELECT url, count(*) AS n, count_if(was_correct = 1) AS c FROM user_reports WHERE url IS NOT NULL GROUP BY 1)
SELECT source, count(*) AS urls, coalesce(sum(n), 0)::BIGINT AS reports, round(count(r.url) / count(*), 6) AS coverage, round(CASE WHEN sum(n) > 0 THEN sum(c) / sum(n) ELSE 0 END, 6) AS accuracy FROM j LEFT JOIN r ON j.url = r.url GROUP BY source""")
def feedback_by_source(spark, root):
    jobs = table(spark, root, "jobs", "source", "url").where("url is not null").distinct()
    reports = table(spark, root, "user_reports", "url", "was_correct").where("url is not null").groupBy("url").agg(F.count("*").alias("n"), F.count_if(F.col("was_correct") == 1).alias("c"))
    out = jobs.join(reports, "url", "left").groupBy("source").agg(F.count("*").alias("urls"), F.coalesce(F.sum("n"), F.lit(0)).alias("reports"), r6(F.count("n") / F.count("*")).alias("coverage"), F.sum("c").alias("c"))
    return out.select("source", "urls", "reports", "coverage", r6(quality.ratio(F.coalesce("c", F.lit(0)), F.col("reports"))).alias("accuracy"))


@query("""WITH x AS (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(reason, '')), '[a-z]+'))) AS word FROM user_reports WHERE is_scam = 1 AND our_prediction < 0.5)
SELECT word, count(*) AS n FROM x WHERE length(word) > 3 GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def feedback_missed_words(spark, root):
    rows = table(spark, root, "user_reports", "reason", "is_scam", "our_prediction").where("is_scam = 1 and our_prediction < 0.5 and not isnan(our_prediction)")
    words = rows.select(F.explode(F.array_distinct(T.tokens(F.col("reason")))).alias("word")).where(F.length("word") > 3)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("""WITH m AS (SELECT max(reported_at) AS t FROM user_reports), r AS (SELECT CASE WHEN is_scam = 1 AND our_prediction < 0.5 THEN 'missed' WHEN is_scam = 0 AND our_prediction >= 0.5 THEN 'false alarm' END AS mode, reported_at > t - INTERVAL 672 HOUR AS recent
FROM user_reports, m WHERE reported_at > t - INTERVAL 1344 HOUR) SELECT mode, count_if(recent) AS recent, count_if(NOT recent) AS before, count_if(recent) - count_if(NOT recent) AS change FROM r WHERE mode IS NOT NULL GROUP BY mode""")
def feedback_failure_trend(spark, root):
    rows = table(spark, root, "user_reports", "reported_at", "is_scam", "our_prediction").withColumn("t", F.col("reported_at").cast("timestamp"))
    last = rows.agg(F.max("t").alias("last"))  # one row
    mode = F.when((F.col("is_scam") == 1) & (F.col("our_prediction") < 0.5), "missed").when((F.col("is_scam") == 0) & (F.col("our_prediction") >= 0.5), "false alarm")
    rows = rows.join(F.broadcast(last)).where(F.col("t") > F.col("last") - F.expr("interval 1344 hours")).select(mode.alias("mode"), (F.col("t") > F.col("last") - F.expr("interval 672 hours")).alias("new"))
    out = rows.where("mode is not null").groupBy("mode").agg(F.count_if("new").alias("recent"), F.count_if(~F.col("new")).alias("before"))
    return out.withColumn("change", F.col("recent") - F.col("before"))


@query("""WITH c AS (SELECT risk_level, count_if(batch_no <= 6) AS a, count_if(batch_no > 6) AS b FROM jobs WHERE risk_level IS NOT NULL GROUP BY 1), s AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c),
e AS (SELECT a, b, (a + b) * ta / (ta + tb) AS ea, (a + b) * tb / (ta + tb) AS eb FROM s) SELECT round(sum(pow(a - ea, 2) / ea + pow(b - eb, 2) / eb), 6) AS chi_square, count(*) - 1 AS freedom FROM e""")
def quality_chi_square(spark, root):
    jobs = table(spark, root, "jobs", "risk_level", "batch_no").where("risk_level is not null")
    cells = jobs.groupBy("risk_level").agg(F.count_if(F.col("batch_no") <= 6).alias("a"), F.count_if(F.col("batch_no") > 6).alias("b"))
    return quality.chi_square(cells, "a", "b").select(r6("chi_square").alias("chi_square"), "freedom")


@query("""WITH d AS (SELECT CAST(left(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), 1) AS INTEGER) AS d, count(*) AS n FROM lineitem WHERE l_extendedprice >= 1 GROUP BY 1), x AS (SELECT i, coalesce(n, 0) AS n, log10(1 + 1 / i) AS p, (SELECT sum(n) FROM d) AS t FROM range(1, 10) r(i) LEFT JOIN d ON d.d = i)
SELECT round(sum(pow(n - t * p, 2) / (t * p)), 6) AS chi_square, round(avg(abs(n / t - p)), 6) AS deviation FROM x""")
def quality_leading_digits_test(spark, root):
    digits = quality.leading_digits(table(spark, root, "lineitem", "l_extendedprice").where("l_extendedprice >= 1"), "l_extendedprice")
    return quality.leading_digits_test(digits).select(r6("chi_square").alias("chi_square"), r6("deviation").alias("deviation"))


_H = "(-{0} * log2({0}) - (1 - {0}) * log2(1 - {0}))"


@query(f"""WITH r AS (SELECT id, greatest(0.001e0, least(0.999e0, scam_score)) AS a, greatest(0.001e0, least(0.999e0, confidence)) AS b, greatest(0.001e0, least(0.999e0, signal_count / 10e0)) AS c FROM jobs WHERE scam_score IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence) AND signal_count IS NOT NULL)
SELECT id, round(greatest(a, b, c) - least(a, b, c), 6) AS spread, round(({_H.format('a')} + {_H.format('b')} + {_H.format('c')}) / 3, 6) AS entropy FROM r""")
def quality_disagreement(spark, root):
    jobs = table(spark, root, "jobs", "id", "scam_score", "confidence", "signal_count").where("scam_score is not null and confidence is not null and not isnan(confidence) and signal_count is not null")
    return quality.disagreement(jobs.withColumn("c", F.col("signal_count") / 10), "id", ["scam_score", "confidence", "c"]).select("id", r6("spread").alias("spread"), r6("entropy").alias("entropy"))


@query("""WITH r AS (SELECT id, scam_score AS a, confidence AS b, signal_count / 10e0 AS c FROM jobs WHERE scam_score IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence) AND signal_count IS NOT NULL), m AS (SELECT *, (0.5e0 * a + 0.3e0 * b + 0.2e0 * c) AS v, (a + b + c) / 3 AS m FROM r)
SELECT id, round(v, 6) AS value, round(greatest(0e0, 1 - 2 * sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2)) / 3)), 6) AS agreement FROM m""")
def quality_consensus(spark, root):
    jobs = table(spark, root, "jobs", "id", "scam_score", "confidence", "signal_count").where("scam_score is not null and confidence is not null and not isnan(confidence) and signal_count is not null")
    return quality.consensus(jobs.withColumn("c", F.col("signal_count") / 10), "id", {"scam_score": 0.5, "confidence": 0.3, "c": 0.2}).select("id", r6("value").alias("value"), r6("agreement").alias("agreement"))


# ---- attribution of scores --------------------------------------------------------------------------------------

_SCORED = _signal_sql() + ", g AS (SELECT f.id, f.name, ln(f.weight / (1 - f.weight)) AS w, r.l, r.n FROM f JOIN r ON f.id = r.id)"


@query(_SCORED + """ SELECT a.name AS a, b.name AS b, count(*) AS n, round(avg(1 / (1 + exp(-a.l)) - CASE WHEN a.n = 1 THEN 0 ELSE 1 / (1 + exp(-(a.l - a.w))) END - CASE WHEN a.n = 1 THEN 0 ELSE 1 / (1 + exp(-(a.l - b.w))) END
+ CASE WHEN a.n = 2 THEN 0 ELSE 1 / (1 + exp(-(a.l - a.w - b.w))) END), 6) AS effect FROM g a JOIN g b ON a.id = b.id AND a.name < b.name GROUP BY 1, 2""")
def score_interactions(spark, root):
    rows = scoring.scored(table(spark, root, "jobs", "id", "title", "description"), "id", "title", "description")
    pairs = rows.select(F.explode(scoring.interactions(F.col("signals"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"), r6(F.avg("p.effect")).alias("effect"))


@query(_SCORED + """, o AS (SELECT id, name, l - sum(w) OVER (PARTITION BY id ORDER BY w DESC, name) AS rest, row_number() OVER (PARTITION BY id ORDER BY w DESC, name) AS k FROM g WHERE l >= 0 AND w > 0)
SELECT id, min(k)::BIGINT AS removed FROM o WHERE rest < -1e-9 GROUP BY id""")
def score_least_removals(spark, root):
    """How few signals must fall for a posting to come below one half."""
    rows = scoring.scored(table(spark, root, "jobs", "id", "title", "description"), "id", "title", "description")
    return rows.select("id", scoring.least_removals(F.col("signals")).alias("removed")).where("removed is not null")


# ---- texts ------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), x AS (SELECT doc_id, w, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[013457@$]') THEN translate(t, '013457@$', 'oieastas') ELSE t END) AS y FROM d)
SELECT doc_id, md5(array_to_string(y, ' ')) AS clean, round(len(list_filter(list_zip(w, y), lambda z: z[1] <> z[2])) / len(w), 6) AS changed FROM x""")
def text_leet(spark, root):
    """Digits and signs that stand for letters inside words; the share of words that changes."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    rows = table(spark, root, "documents", "doc_id", "text").select("doc_id", words.alias("w")).select("doc_id", "w", F.transform("w", T.unleet).alias("y"))
    return rows.select("doc_id", F.md5(F.array_join("y", " ")).alias("clean"), r6(F.size(F.filter(F.arrays_zip("w", "y"), lambda z: z["w"] != z["y"])) / F.size("w")).alias("changed"))


@query(r"SELECT doc_id, regexp_matches(text, '\p{Latin}') AS latin, regexp_matches(text, '\p{Cyrillic}') AS cyrillic, regexp_matches(text, '\p{Greek}') AS greek, regexp_matches(text, '[\p{Latin}][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{Latin}]') AS mixed FROM documents WHERE text IS NOT NULL")
def text_scripts(spark, root):
    c = F.col("text")
    latin, cyrillic, greek = (rf"\p{{Is{n}}}" for n in ("Latin", "Cyrillic", "Greek"))
    return table(spark, root, "documents", "doc_id", "text").where("text is not null").select("doc_id", c.rlike(latin).alias("latin"), c.rlike(cyrillic).alias("cyrillic"), c.rlike(greek).alias("greek"), c.rlike(f"{latin}[{cyrillic}{greek}]|[{cyrillic}{greek}]{latin}").alias("mixed"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: len(regexp_extract_all(lower(x), '[a-z]+'))), lambda n: n > 0) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(n) AS sentences, round(sqrt(greatest(0e0, list_sum(list_transform(n, lambda x: x * x)) / len(n) - pow(list_avg(n), 2))) / list_avg(n), 6) AS variation FROM s WHERE len(n) > 0""")
def text_sentence_variation(spark, root):
    """Coefficient of variation of sentence lengths."""
    lengths = F.filter(F.transform(F.split("text", r"[.!?]+"), lambda x: F.size(T.tokens(x))), lambda n: n > 0)
    rows = table(spark, root, "documents", "doc_id", "text").where("text is not null").select("doc_id", lengths.alias("n")).where(F.size("n") > 0)
    total = lambda f: F.aggregate("n", F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    rows = rows.select("doc_id", F.size("n").alias("sentences"), (total(lambda x: x) / F.size("n")).alias("m"), (total(lambda x: x * x) / F.size("n")).alias("q"))
    return rows.select("doc_id", F.col("sentences").cast("long").alias("sentences"), r6(F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.pow("m", F.lit(2)))) / F.col("m")).alias("variation"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents), g AS (SELECT doc_id, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS g FROM t WHERE len(w) > 2)
SELECT doc_id, round(1 - len(list_distinct(g)) / len(g), 6) AS repeated FROM g""")
def text_trigram_repetition(spark, root):
    rows = table(spark, root, "documents", "doc_id", "text").select("doc_id", T.ngrams(T.tokens(F.col("text")), 3).alias("g")).where(F.size("g") > 0)
    return rows.select("doc_id", r6(1 - F.size(F.array_distinct("g")) / F.size("g")).alias("repeated"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\n[ \t]*\n'), lambda p: trim(regexp_replace(p, '\s', '', 'g')) <> ''))::BIGINT AS paragraphs FROM documents")
def text_paragraphs(spark, root):
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"[\s]", "") != "")
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", F.size(parts).cast("long").alias("paragraphs"))


@query("""WITH p AS (SELECT id, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(location, '')), '[a-z]+')) AS b FROM jobs)
SELECT id, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))))[:20], ' ') AS only FROM p""")
def text_word_difference(spark, root):
    """The words that only one of two texts has, the first 20 of them in order."""
    a, b = (F.array_distinct(T.tokens(F.col(c))) for c in ("title", "location"))
    both = F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))
    return table(spark, root, "jobs", "id", "title", "location").select("id", F.array_join(F.slice(both, 1, 20), " ").alias("only"))


# ---- sequences --------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2), p AS (SELECT user_id, string_agg(event_type, ' > ' ORDER BY t, event_type) AS playbook FROM f GROUP BY 1) SELECT playbook, count(*) AS users FROM p GROUP BY playbook""")
def series_playbooks(spark, root):
    """The order in which users take each step first, and how many share it."""
    first = table(spark, root, "events", "user_id", "event_type", "ts").groupBy("user_id", "event_type").agg(F.min("ts").alias("t"))  # a row per step
    steps = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_type"))).alias("s"))
    return steps.groupBy(F.array_join(F.transform("s", lambda x: x["event_type"]), " > ").alias("playbook")).agg(F.count("*").alias("users"))


@query("""WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2) SELECT a.event_type AS a, b.event_type AS b, round(corr(a.n, b.n), 6) AS r, count(*) AS days FROM c a JOIN c b ON a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2""")
def series_resonance(spark, root):
    """Pearson correlation of the daily counts of every two kinds of events."""
    daily = table(spark, root, "events", "event_type", "ts").where("ts is not null").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    x, y = daily.alias("x"), daily.alias("y")  # a row per kind and day
    both = x.join(y, (F.col("x.day") == F.col("y.day")) & (F.col("x.event_type") < F.col("y.event_type")))
    return both.groupBy(F.col("x.event_type").alias("a"), F.col("y.event_type").alias("b")).agg(r6(F.corr("x.n", "y.n")).alias("r"), F.count("*").alias("days"))


@query("""WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2), l AS (SELECT event_type, list(n ORDER BY day) AS v FROM c GROUP BY 1)
SELECT event_type, v[1] AS baseline, round(list_reduce(v, lambda a, x: 0.7e0 * a + 0.3e0 * x), 6) AS level, abs(list_reduce(v, lambda a, x: 0.7e0 * a + 0.3e0 * x) - v[1]) > 0.2e0 * v[1] AS alarm FROM l""")
def series_level_alarm(spark, root):
    """Exponentially weighted level with the first value as baseline; an alarm beyond a fifth of it."""
    daily = table(spark, root, "events", "event_type", "ts").where("ts is not null").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    lists = daily.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("v"))  # a value per day
    level = F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), F.element_at("v", 1), lambda a, x: a * 0.7 + x * 0.3)
    rows = lists.select("event_type", F.element_at("v", 1).alias("baseline"), level.alias("level"))
    return rows.select("event_type", "baseline", r6("level").alias("level"), (F.abs(F.col("level") - F.col("baseline")) > 0.2 * F.col("baseline")).alias("alarm"))


@query("""WITH p AS (SELECT lower(trim(company)) AS company, count(DISTINCT source) AS platforms, count(*) AS postings FROM jobs WHERE trim(company) <> '' GROUP BY 1) SELECT company, platforms, postings FROM p WHERE platforms >= 2""")
def graph_cross_platform(spark, root):
    rows = table(spark, root, "jobs", "company", "source").where("trim(company) != ''").groupBy(F.lower(F.trim("company")).alias("company"), "source").agg(F.count("*").alias("n"))
    return rows.groupBy("company").agg(F.count("source").alias("platforms"), F.sum("n").alias("postings")).where("platforms >= 2")
