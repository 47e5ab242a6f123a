"""Core operators on small cases, and all SQL-checked queries against their oracle on the smallest data."""

import math
import os

import pytest
from pyspark.sql import functions as F

from sievework import catalog
from sievework.functions import similarity
from sievework.functions import text as T
from sievework.operators import graph, quality, scoring, series, store
from sievework.sources import postings

DATA = "/root/testdata/sf0.001"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).head().y


def test_text_functions(spark):
    assert one(spark, T.squeezed(F.col("x")), "  A\n b\tC ") == "a b c"
    assert one(spark, T.unmasked(F.col("x")), "ра​у  meeeee") == "pay mee"
    assert one(spark, T.char_shingles(F.col("x"), 5), "abcdef") == ["abcde", "bcdef"] and one(spark, T.char_shingles(F.col("x"), 5), "") == []
    assert one(spark, T.ngrams(F.split("x", " "), 2), "a b c") == ["a b", "b c"] and one(spark, T.ngrams(F.split("x", " "), 4), "a b c") == []
    assert one(spark, T.emails(F.col("x")), "Write to B@x.example, a@y.co.uk.") == ["a@y.co.uk", "b@x.example"]
    assert one(spark, T.urls(F.col("x")), "see https://a.example/x. and https://a.example/x") == ["https://a.example/x"]
    assert one(spark, T.domain_of(F.col("x")), "https://user@WWW.Shop.example:80/a") == "shop.example"
    assert one(spark, T.days_ago(F.col("x")), "Posted 3 weeks ago") == 21 and one(spark, T.days_ago(F.col("x")), None) is None
    assert one(spark, T.grade_level(F.col("x")), None) is None


def test_name_similarity():
    assert round(similarity.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and similarity.jaro_winkler("", "x") == 0 and similarity.jaro_winkler("a", "a") == 1


def test_similar_names_against_brute_force(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    rows = spark.read.parquet(f"{DATA}/companies.parquet").select("company_id", F.regexp_replace(F.lower("name"), "[^a-z0-9 ]", "")).collect()
    names = [(i, n) for i, n in rows if len(n) >= 4]
    want = {(a, b) for a, x in names for b, y in names if a < b and x[:4] == y[:4] and similarity.jaro_winkler(x, y) >= 0.9}
    assert {(r.a, r.b) for r in catalog.queries()["text_similar_names"](spark, DATA).collect()} == want


def test_similarity_joins_lose_no_pair(spark):
    import random

    r = random.Random(4)
    names = ["lorkarwyn healthcare", "lrokarwyn healthcare sa", "yorglefax textiles s a", "yorglefax textiles sa", "", None, "a", "b", "abcd", "xbcd", "bcd", "same", "same", "née", "nee"]
    names += ["".join(r.choice("abc ") for _ in range(r.randrange(1, 15))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(names)), "k long, t string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    pairs = [(i, j) for j in range(len(names)) for i in range(j) if names[i] and names[j]]
    want = {(i, j): edits(names[i], names[j]) for i, j in pairs}
    assert {(x.a, x.b): x.edits for x in similarity.within_edits(df, "k", "t", 3).collect()} == {p: n for p, n in want.items() if n <= 3}
    got = [(x.a, x.b) for x in similarity.alike(df, "k", "t", 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in pairs if similarity.jaro_winkler(names[i], names[j]) >= 0.9} and (0, 1) in got


def test_company_pairs_outside_the_blocks_are_found(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    rows = spark.read.parquet(f"{DATA}/companies.parquet").select("company_id", F.regexp_replace(F.lower("name"), "[^a-z0-9 ]", "")).collect()
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and similarity.jaro_winkler(x, y) >= 0.9}
    assert {(r.a, r.b) for r in catalog.queries()["text_all_similar_names"](spark, DATA).collect()} == want


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 2, None), ("c", 1, "z"), ("a", 0, "q")], "k string, v int, t string")
    assert {(r.k, r.v, r.t, r.versions) for r in store.upserted(old, new, ["k"], F.col("v")).collect()} == {("a", 2, None, 3), ("b", 1, "y", 1), ("c", 1, "z", 1)}
    blank = spark.createDataFrame([("a",), ("",), (None,), ("z",)], "k string")
    assert sorted(str(r.k) for r in store.unseen(blank, old, "k").collect()) == ["", "None", "z"]
    docs = spark.createDataFrame([(1, "wound care and Wound"), (2, "care"), (3, None)], "i int, t string")
    assert [r.i for r in store.bm25(docs, "i", "t", ["wound"]).collect()] == [1]
    assert [r.i for r in store.phrase_search(docs, "Wound CARE", ["t"]).collect()] == [1]


def test_quality(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.1, 0), (1.0, 1), (0.95, 0), (None, 1)], "p double, y int")
    bins = {r.bin: (r.n, r.actual_rate) for r in quality.calibration(rows, "p", "y").collect()}
    assert bins == {0: (1, 0.0), 1: (1, 0.0), 9: (2, 0.5)}
    assert quality.confusion(rows.limit(0), F.col("y") == 1, F.col("p") > 0.5).head().f1 == 0
    steps = spark.createDataFrame([("g", i, v) for i, v in enumerate([0.0, 1.0, 1.0, 0.0, 1.0])], "g string, i int, v double")
    s, want = 0.0, []
    for v in [0.0, 1.0, 1.0, 0.0, 1.0]:
        s = max(0.0, s + v - 0.5)
        want.append(round(s, 6))
    assert [round(r.cusum, 6) for r in quality.cusum(steps, "g", ["i"], F.col("v"), 0.4, 0.1).orderBy("i").collect()] == want
    same = spark.createDataFrame([("a", 5), ("b", 7)], "n string, w int")
    assert all(abs(r.jsd) < 1e-12 for r in quality.distribution_shift(same, same, "n", "w").collect())


def test_series(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 5, 5, 5, 9, 9, 9, 9])], "g string, t int, n int")
    change = series.change_points(rows, "g", "t", "n").head()
    assert change["at"] == 4 and change["shift"] == 4 and change["significant"]
    ramp = spark.createDataFrame([("a", i, 3 * i + 1) for i in range(6)], "g string, t int, n int")
    fit = series.forecast(ramp, "g", "t", "n").head()
    assert round(fit["next"], 6) == 19 and round(fit["slope"], 6) == 3 and round(fit["r2"], 6) == 1
    flat = series.anomalies(rows.where("t < 4"), "g", "t", "n").orderBy("t").collect()
    assert flat[0].z is None and flat[3].z == 0


def test_graph(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(edges.limit(0), "a", "b").count() == 0
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.hop for r in graph.reach(edges, "a", "b", start, 3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_scores(spark):
    signals = [scoring.Signal("x", "red_flag", 0.9, 0.8, F.col("a")), scoring.Signal("y", "positive", 0.3, 0.5, F.col("b"))]
    df = spark.createDataFrame([(1, True, True), (2, False, None), (3, True, False)], "i int, a boolean, b boolean")
    rows = {r.i: r for r in df.select("i", scoring.fired(signals).alias("s")).select("i", scoring.score(F.col("s")).alias("p"), scoring.risk(scoring.score(F.col("s"))).alias("r"), scoring.attribution(F.col("s")).alias("w")).collect()}
    assert round(rows[1].p, 6) == round(1 / (1 + math.exp(-(math.log(9) + math.log(3 / 7)))), 6) and rows[2].p == 0 and rows[2].r == "safe" and rows[3].r == "scam"
    assert round(rows[3].w[0].share, 6) == 0.9


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"jobTitle": "Cook", "company_name": "X", "salary_from": "20,000", "remote": "Yes"}, {"title": ""}]')
    (tmp_path / "b.json").write_text('{"title": "Nurse"}\n{"title": broken\n{"position": "Clerk", "is_remote": false}')
    got = {(r.title, r.company, r.salary_min, r.is_remote) for r in postings.read_json(spark, str(tmp_path)).collect()}
    assert {("Cook", "X", 20000.0, True), ("Nurse", "", 0.0, False), ("Clerk", "", 0.0, False)} <= got
    (tmp_path / "l.csv").write_text("url,is_scam\na,1\nb,x\nc,0\n")
    assert {tuple(r) for r in postings.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {("a", 1), ("c", 0)}
    page = '<html><title>T</title><script type="application/ld+json">[{"@type":"Org"},{"@type":"JobPosting","title":"Cook","description":"<b>Hi</b> &amp; bye","hiringOrganization":{"name":"X"}}]</script><script>bad()</script><h1>H</h1></html>'
    pages = spark.createDataFrame([("u", page), ("v", "<h1>Head</h1><style>x</style><p>text</p>"), ("w", None)], "url string, html string")
    rows = {r.url: r for r in postings.from_html(pages, "url", "html").collect()}
    assert (rows["u"].title, rows["u"].company, rows["u"].description) == ("Cook", "X", "Hi & bye") and rows["v"].title == "Head" and "x" not in rows["v"].description.split() and rows["w"].description == ""
    pay = lambda t: tuple(one(spark, postings.pay_in_text(F.col("x")), t))
    assert pay("earn $20 - $25 per hour") == (20.0, 25.0, "hour") and pay("£45k to £60k a year") == (45000.0, 60000.0, "year") and pay("nothing") == (0.0, 0.0, None)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(fix(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = catalog.queries()[name](spark, DATA)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


def test_style(spark):
    from sievework.operators import style

    df = spark.createDataFrame([(1, "a", "One two three. Four, five!"), (2, "a", "one"), (3, "a", None), (4, "b", "")], "i int, g string, t string").select("i", "g", style.fingerprint(F.col("t")).alias("v"))
    got = {r.i: r.v for r in df.collect()}
    assert len(got[1]) == 4 + len(style.MARKS) + len(style.FUNCTION_WORDS) and got[1][1] == 2.5 and got[3] is None and got[4] is None
    moved = {r.i: r["shift"] for r in style.shifts(df.where("v is not null"), "g", "i", "v").collect()}
    assert moved[1] is None and round(moved[2], 9) == round(math.dist(got[1], got[2]), 9)
    texts = [(1, "the cat sat on the mat today"), (2, "the cat sat on the mat now"), (3, "the cat sat on the mat today"), (4, "nothing in common here"), (5, None), (6, "word")]
    pairs = {(r.a, r.b): r.similarity for r in style.families(spark.createDataFrame(texts, "k int, t string"), "k", "t", 0.6).collect()}
    assert set(pairs) == {(1, 2), (1, 3), (2, 3)} and pairs[1, 3] == 1.0


def test_ngrams_compute_the_words_once_a_row(spark):
    from pyspark.sql.types import ArrayType, StringType

    from sievework.functions import text as T

    calls = spark.sparkContext.accumulator(0)

    def parted(t):
        calls.add(1)
        return t.split()

    words = F.udf(parted, ArrayType(StringType())).asNondeterministic()(F.col("t"))
    df = spark.createDataFrame([("a b c d",), ("a b",), ("",)], "t string")
    assert [r.g for r in df.select(T.ngrams(words, 3).alias("g")).collect()] == [["a b c", "b c d"], [], []] and calls.value == 3
    # a page of 40,000 words: minutes when every run parts the text again
    import time

    began = time.time()
    page = spark.createDataFrame([(" ".join(["lorem", "ipsum", "dolor", "sit"] * 10_000),)], "t string")
    assert page.select(F.size(T.ngrams(T.tokens(F.col("t")), 3)).alias("n")).head().n == 39_998 and time.time() - began < 60


def test_template_families_of_jobs_against_brute_force(spark, tmp_path):
    import random

    r = random.Random(6)
    texts = []
    for _ in range(6):
        base = [r.choice("abcdefghijklmnop") * r.randrange(1, 4) for _ in range(40)]
        for edits in (0, 0, 1, 2, 4, 8):
            one = list(base)
            for at in r.sample(range(40), edits):
                one[at] = "new"
            texts.append(" ".join(one))
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "word", "two words"])]
    spark.createDataFrame(rows, "id long, description string").write.parquet(f"{tmp_path}/jobs.parquet")
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows if t and len(t.split()) > 1}
    family = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75:
                    family[j] = min(family[i], family[j])
    want = {(i, f) for i, f in family.items() if list(family.values()).count(f) > 1}
    assert {(x.id, x.family) for x in catalog.queries()["style_template_families"](spark, str(tmp_path)).collect()} == want and len(want) >= 12


def test_families_in_blocks_against_brute_force(spark, monkeypatch):
    import random

    from sievework.operators import style

    monkeypatch.setattr(style, "BLOCK", 20)  # every range of sizes in several parts, which meet one another
    r = random.Random(8)
    phrases = [" ".join(r.choice("abcdefghij") * r.randrange(1, 3) for _ in range(5)) for _ in range(12)]
    texts = [" ".join(r.choice(phrases) for _ in range(r.randrange(1, 9))) for _ in range(250)] + [f"only {w}" for w in "abc"]
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(5)
    for least in (0.4, 0.75, 1.0):
        want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}
        got = [(x.a, x.b) for x in style.families(df, "k", "t", least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_minimal_set(spark):
    rows = [(i % 2, i % 2, (i // 2) % 2, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "y int, a int, b int, c int")
    chosen = quality.minimal_set(df, {n: F.col(n) == 1 for n in "abc"}, F.col("y") == 1)
    assert [n for n, _ in chosen] == ["a"] and round(chosen[0][1], 9) == 1


def test_streams_equal_batch(spark, tmp_path):
    from sievework.streaming import events as S

    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 1.0), ("a", 86_400, 8.0), ("a", 2, 4.0)], "k string, t long, v double").select("k", F.timestamp_seconds("t").alias("at"), F.col("v").alias("value"))
    path = str(tmp_path / "events.parquet")
    rows.coalesce(1).write.parquet(path)
    counted = S.drained(S.windowed(S.stream_of(spark, path), "at", "k", "1 day", "10 days"), "w", "complete")
    assert {(r.k, r.start_us, r.n) for r in counted.collect()} == {("a", 0, 3), ("b", 0, 1), ("a", 86_400_000_000, 1)}
    assert S.drained(S.first_seen(S.stream_of(spark, path), "at", ["k"], "10 days").select("k"), "f", "append").count() == 2
    last = {r.k: (r.n, r.ema) for r in S.drained(S.running_average(S.stream_of(spark, path), "k", "at", "value", 0.5), "r", "update").collect()}
    assert last == {"a": (4, 2 * 0.125 + 4 * 0.125 + 4 * 0.25 + 8 * 0.5), "b": (1, 1.0)}


def test_merges(spark):
    from sievework.operators import merge

    old = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "k string, t string, n int")
    new = spark.createDataFrame([("a", "y", None), ("c", "z", 3)], "k string, t string, n int")
    assert {tuple(r) for r in merge.merged(old, new, "k", keep=("t",)).collect()} == {("a", "x", 1), ("b", None, 2), ("c", "z", 3)}
    assert {tuple(r) for r in merge.accumulated(old, new, "k", ("n",), ("t",)).collect()} == {("a", 1, "y"), ("b", 2, None), ("c", 3, "z")}
    blank = spark.createDataFrame([("a",), ("a",), ("q",), ("",), (None,)], "k string")
    assert merge.batch_effect(old, blank, "k").head().asDict() == {"inserted": 1, "updated": 1, "rejected": 2}
    reports = spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 1, 1), (None, 3, 1, 1)], "k string, at int, i int, v int")
    assert {(r.k, r.verdict, r.reports) for r in merge.verdicts(old, reports, "k", "at", "i", "v").collect()} == {("a", 1, 2), ("b", None, 0)}


def test_union_of_sources(spark):
    from sievework.sources.registry import union_of

    a, b = spark.createDataFrame([("u", 1), ("", 2)], "url string, n int"), spark.createDataFrame([("u", 3), ("v", 4), (None, 5)], "url string, n int")
    assert {tuple(r) for r in union_of([a, b]).collect()} == {("u", 1), ("v", 4), ("", 2), (None, 5)}


def test_robustness(spark):
    from sievework.operators import robustness

    df = spark.createDataFrame([(1, "send gift cards now. thanks"), (2, None), (3, "")], "i int, t string")
    forms = robustness.variants(df, "i", "t", n=2)
    assert forms.where("i = 1").count() == 1 + 2 * len(robustness.KINDS) and forms.where("i = 2").count() == 0
    assert sorted(map(tuple, forms.collect()), key=repr) == sorted(map(tuple, robustness.variants(df, "i", "t", n=2).collect()), key=repr)
    kept = {(r.signal, r.kind): r.kept for r in robustness.survival(forms, "i", {"g": F.lower("t").contains("gift cards")}).collect()}
    assert kept["g", "case"] == 1 and kept["g", "order"] == 1
    falls = robustness.ablation(df, "i", "t", ["gift cards", "wire"], lambda t: F.when(t.contains("gift"), 0.5).otherwise(0.1)).collect()
    assert [(r.i, r.word, round(r.fall, 6)) for r in falls] == [(1, "gift cards", 0.4)]


def test_robustness_queries_cover_all_signals_of_jobs(spark, tmp_path):
    from sievework.operators import robustness

    text = "Pay a refundable deposit, give your bank login, buy a gift card. Easy money, no interview, write by private messenger, answer within 3 hours!! See https://a.example. You need knowledge of law. We give profit sharing. Probation lasts a year."
    rows = [(1, "Clerk", text), (2, "Cook", "short"), (3, None, None)]
    spark.createDataFrame(rows, "id long, title string, description string").write.parquet(f"{tmp_path}/jobs.parquet")
    got = catalog.queries()["robust_survival"](spark, str(tmp_path)).collect()
    names = {s.name for s in scoring.text_signals(F.lit(""), F.lit(""))}
    assert {(r.signal, r.kind) for r in got} == {(n, k) for n in names for k in robustness.KINDS}
    assert {r.id for r in catalog.queries()["robust_scores"](spark, str(tmp_path)).collect()} == {1, 2, 3}
